"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Equal vectors are one node. The graph starts from a few sorts by random hyperplanes:
nodes that come next to each other in a sorted partition are compared in blocks. Then
NN-descent: the neighbours of each node, forward ones and a sample of those that point
to it, are compared with one another, and a pair that beats the worst neighbour of one
side goes into its list. ``TURNS`` turns are made.

A search starts at the query's own node and goes on from the best nodes found that have
not been looked at, to their neighbours, until all of the best ``LOOK`` have been. All
queries take each step together, as joins of the frontier with the graph and the vectors.

The graph and the walk use half-precision copies of the vectors, scaled by the largest
component; the final scores and ranks come from the vectors themselves, in doubles.

Everything per node is bounded: lists hold ``DEGREE`` neighbours, a node that very many
point to is sampled, and rows are dealt by node. Equal vectors give their first
``k + 1`` ids, which is all that an answer can hold.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without an id; shorter vectors count as continued
by zeros; rows that repeat id and vector are one candidate; equal scores go by the
smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelwright.session import spool

DEGREE = 40
SORTS = 11
BITS = 12
BLOCK = 3072
PER_BLOCK = 16
FORWARD = 20
BACKWARD = 20
TURNS = 2
LOOK = 44
EXPAND = 44
STEPS = 16
ROWS_PER_PART = 2 * BLOCK
SEED = 17


def usable(vector: Column) -> Column:
    fine = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vector.isNotNull() & F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    """Rows as doubles, continued by zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * wide:
        return flat.reshape(len(column), wide)
    out = np.zeros((len(column), wide))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _codes(column: pa.Array, wide: int) -> np.ndarray:
    """The half-precision copies, as floats."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, wide).astype(np.float32)


def _with_codes(vectors: DataFrame, wide: int, scale: float) -> DataFrame:
    """(node, vec) to (node, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = (_matrix(batch.column("vec"), wide) / scale).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([row.tobytes() for row in half], pa.binary())], ["node", "code"]
            )

    return vectors.select("node", "vec").mapInArrow(run, "node long, code binary")


def _directions(wide: int, turn: int) -> np.ndarray:
    return np.random.default_rng([SEED, turn]).normal(size=(wide, BITS + 1))


def _placed(vectors: DataFrame, wide: int, turn: int) -> DataFrame:
    """``vectors`` with a place in a random order in which near vectors tend to be near.

    The leading bits are sides of hyperplanes, the rest is a projection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = _directions(wide, turn)
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = _codes(batch.column("code"), wide) @ ways
            code = np.zeros(len(seen))
            for bit in range(BITS):
                code = code * 2 + (seen[:, bit] > 0)
            place = code + 0.5 + np.arctan(seen[:, BITS]) / np.pi
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])

    return vectors.mapInArrow(run, "node long, code binary, place double")


def _best(scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's largest finite scores."""
    most = min(most, scores.shape[1])
    columns = np.argpartition(-scores, most - 1, axis=1)[:, :most] if most else np.zeros((len(scores), 0), int)
    rows = np.repeat(np.arange(len(scores)), columns.shape[1])
    columns = columns.ravel()
    real = np.isfinite(scores[rows, columns])
    return rows[real], columns[real]


def _block_pairs(wide: int):
    def flush(nodes: list, vectors: list) -> pa.RecordBatch:
        ids, x = np.concatenate(nodes), np.vstack(vectors)
        scores = x @ x.T
        np.fill_diagonal(scores, -np.inf)
        a, b = _best(scores, PER_BLOCK)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[a]), pa.array(ids[b]), pa.array(scores[a, b].astype(np.float64))], ["u", "v", "score"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, vectors, held = [], [], 0
        for batch in batches:
            ids = batch.column("node").to_numpy()
            if not len(ids):
                continue
            x = _codes(batch.column("code"), wide)
            at = 0
            while at < len(ids):
                take = min(BLOCK - held, len(ids) - at)
                nodes.append(ids[at : at + take])
                vectors.append(x[at : at + take])
                held, at = held + take, at + take
                if held == BLOCK:
                    yield flush(nodes, vectors)
                    nodes, vectors, held = [], [], 0
        if held:
            yield flush(nodes, vectors)

    return run


def _lists(pairs: DataFrame, most: int = DEGREE) -> DataFrame:
    """Each node's best neighbours: (u, v, score)."""
    order = Window.partitionBy("u").orderBy(F.desc("score"), "v")
    single = pairs.groupBy("u", "v").agg(F.max("score").alias("score"))
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _first_graph(vectors: DataFrame, wide: int, parts: int) -> DataFrame:
    found = None
    for turn in range(SORTS):
        rows = (
            _placed(vectors, wide, turn)
            .repartitionByRange(parts, "place", "node").sortWithinPartitions("place", "node")
            .select("node", "code").mapInArrow(_block_pairs(wide), "u long, v long, score double")
        )
        found = rows if found is None else found.unionByName(rows)
    return spool(_lists(found), "graph")


def _compare(wide: int):
    """Rows (u, v, code, worst) in order of u: pairs of neighbours of one u that improve a list."""

    def join(ids: np.ndarray, worst: np.ndarray, x: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        wide_group = int(sizes.max())
        group = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        cube = np.zeros((len(sizes), wide_group, x.shape[1]), np.float32)
        cube[group, inside] = x
        names = np.full((len(sizes), wide_group), -1, np.int64)
        names[group, inside] = np.arange(len(ids))
        scores = cube @ cube.transpose(0, 2, 1)
        limit = np.full((len(sizes), wide_group), np.inf)
        limit[group, inside] = worst
        good = (scores > limit[:, :, None]) & (names[:, None, :] >= 0)
        good &= ~np.eye(wide_group, dtype=bool)
        g, a, b = np.nonzero(good)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[names[g, a]]), pa.array(ids[names[g, b]]), pa.array(scores[g, a, b].astype(np.float64))],
            ["u", "v", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            rest = None
            if not table.num_rows:
                continue
            batch = table.to_batches()[0]
            owner = batch.column("u").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            # The last group may go on in the next batch.
            rest = batch.slice(int(starts[-1]))
            yield from parts(batch.slice(0, int(starts[-1])))
        if rest is not None:
            yield from parts(rest)

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        owner = batch.column("u").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else []
        bounds = [*starts, len(owner)]
        for i in range(0, len(starts), 256):
            a, b = int(bounds[i]), int(bounds[min(i + 256, len(starts))])
            part = batch.slice(a, b - a)
            yield join(
                part.column("v").to_numpy(), part.column("worst").to_numpy(),
                _codes(part.column("code"), wide), np.diff(bounds[i : min(i + 256, len(starts)) + 1]),
            )

    return run


def _turn(graph: DataFrame, vectors: DataFrame, wide: int, parts: int, turn: int) -> DataFrame:
    """Improvements (u, v, score) found among neighbours of neighbours."""
    ahead = graph.where(F.col("rank") <= FORWARD).select("u", "v")
    sample = Window.partitionBy("u").orderBy(F.xxhash64(F.lit(turn), "u", "v"), "v")
    behind = (
        graph.select(F.col("v").alias("u"), F.col("u").alias("v"))
        .withColumn("n", F.row_number().over(sample)).where(F.col("n") <= BACKWARD).drop("n")
    )
    # A list that is not full takes anything.
    worst = graph.groupBy(F.col("u").alias("v")).agg(
        F.when(F.count(F.lit(1)) < DEGREE, F.lit(float("-inf"))).otherwise(F.min("score")).alias("worst")
    )
    known = vectors.select(F.col("node").alias("v"), "code").join(worst, "v")
    rows = ahead.unionByName(behind).distinct().join(known, "v").select("u", "v", "code", "worst")
    return rows.repartition(parts, "u").sortWithinPartitions("u").mapInArrow(
        _compare(wide), "u long, v long, score double"
    )


def build_graph(vectors: DataFrame, wide: int, count: int) -> DataFrame:
    """(u, v, score, rank) of ``vectors`` (node, code): about the DEGREE best neighbours of each node."""
    parts = max(1, -(-count // ROWS_PER_PART))
    graph = _first_graph(vectors, wide, parts)
    for turn in range(TURNS):
        better = spool(_turn(graph, vectors, wide, parts, turn).distinct(), "better")
        graph = spool(_lists(graph.select("u", "v", "score").unionByName(better)), "graph")
    return graph


def _scored(rows: DataFrame, wide: int) -> DataFrame:
    """(query, node, asks, code) to (query, node, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_codes(batch.column(n), wide) for n in ("asks", "code"))
            score = np.einsum("ij,ij->i", a, b).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), batch.column("node"), pa.array(score)],
                ["query", "node", "score"],
            )

    return rows.select("query", "node", "asks", "code").mapInArrow(run, "query long, node long, score double")


def search(graph: DataFrame, vectors: DataFrame, starts: DataFrame, wide: int, look: int = LOOK) -> DataFrame:
    """(query, node, score): the best nodes found for the vectors of the nodes ``starts`` (query)."""
    ahead = graph.select(F.col("u").alias("at"), F.col("v").alias("node"))
    fewest = Window.partitionBy("at").orderBy(F.desc("score"), "node")
    behind = (
        graph.select(F.col("v").alias("at"), F.col("u").alias("node"), "score")
        .withColumn("n", F.row_number().over(fewest)).where(F.col("n") <= DEGREE).select("at", "node")
    )
    ways = spool(ahead.unionByName(behind).distinct(), "ways")
    queries = spool(
        starts.select("query").distinct().join(
            vectors.select(F.col("node").alias("query"), F.col("code").alias("asks")), "query"
        ),
        "queries",
    )
    own = _scored(queries.select("query", F.col("query").alias("node"), "asks", F.col("asks").alias("code")), wide)
    found = spool(own.withColumn("done", F.lit(False)), "found")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    for _ in range(STEPS):
        ranked = found.withColumn("rank", F.row_number().over(best))
        front = Window.partitionBy("query").orderBy("rank")
        chosen = spool(
            ranked.where(~F.col("done") & (F.col("rank") <= look))
            .withColumn("turn", F.row_number().over(front)).where(F.col("turn") <= EXPAND)
            .select("query", F.col("node").alias("at")),
            "front",
        )
        if not chosen.head(1):
            break
        reached = (
            chosen.join(ways, "at").select("query", "node").distinct()
            .join(found.select("query", "node"), ["query", "node"], "left_anti")
        )
        # The query's copy goes to the node's place, so only scores come back.
        fresh = _scored(
            reached.join(queries, "query").join(vectors, "node"), wide
        ).withColumn("done", F.lit(False))
        marked = found.join(
            chosen.select("query", F.col("at").alias("node"), F.lit(True).alias("now")), ["query", "node"], "left"
        ).select("query", "node", "score", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        found = spool(
            marked.unionByName(fresh).withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= look).drop("rank"),
            "found",
        )
    return found.select("query", "node", "score")


def nearest(
    rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows found for each query row."""
    vector = F.col(vector_col)
    fine = rows.where(usable(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), vector.cast("array<float>").alias("vec"), is_query.alias("asks")
    )
    keyed = fine.withColumns({"a": F.xxhash64("vec"), "b": F.xxhash64(F.lit(SEED), "vec")})
    nodes = keyed.groupBy("a", "b").agg(F.min("id").alias("node"), F.min("vec").alias("vec"))
    nodes = spool(nodes, "nodes")
    vectors = nodes.select("node", "vec")
    few = Window.partitionBy("a", "b").orderBy("id")
    members = spool(
        keyed.select("a", "b", "id").distinct().withColumn("n", F.row_number().over(few))
        .where(F.col("n") <= k + 1).join(nodes.select("a", "b", "node"), ["a", "b"]).select("node", "id"),
        "members",
    )
    asked = spool(
        keyed.where("asks").select("a", "b", "id").distinct()
        .join(nodes.select("a", "b", "node"), ["a", "b"]).select("node", F.col("id").alias("query_id")),
        "asked",
    )
    wide, count, scale = vectors.agg(
        F.max(F.size("vec")), F.count(F.lit(1)),
        F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))),
    ).first()
    codes = spool(_with_codes(vectors, wide or 1, scale or 1.0), "codes")
    graph = build_graph(codes, wide or 1, count)
    found = search(graph, codes, asked.select(F.col("node").alias("query")), wide or 1, max(LOOK, k + 1))
    exact = F.aggregate(
        F.zip_with(F.col("x"), F.col("y"), lambda a, b: F.coalesce(a.cast("double") * b.cast("double"), F.lit(0.0))),
        F.lit(0.0), lambda a, b: a + b,
    )
    scored = (
        found.select("query", "node")
        .join(vectors.select(F.col("node").alias("query"), F.col("vec").alias("x")), "query")
        .join(vectors.select("node", F.col("vec").alias("y")), "node")
        .select("query", "node", exact.alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.withColumnRenamed("node", "query").join(scored, "query")
        .join(members.withColumnRenamed("id", "vec_id"), "node")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
