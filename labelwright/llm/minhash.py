"""Near-duplicates by an LSH forest over MinHash signatures.

Each tree reads a signature's values in an order of its own. Documents that agree on
the first ``DEPTHS[0]`` values of a tree form a region; a region with more than two
documents is divided again by further values, so dense regions go deeper than sparse
ones. In the sorted order of a tree, the documents of a region at some depth are those
with a common prefix of that length. Candidates are a region's members with two of
them: its first member, and its hub, the member that shares regions with most documents
over all trees. A template and its many copies meet through the hub, two copies among
strangers meet in the region that holds them alone. Each document's most frequent hub is
tried before all others; regions that this leaves in one component need no other candidates.
Regions are grouped aggregates and equi-joins; nothing collects a region.

Regions with more than two documents have other pairs as well. Those that still hold
several components when these candidates are linked are sorted: each document is compared
with the next ``NEXT`` of other components in the tree's full order, those with the longest
common prefixes. This goes on in new orders until one of them confirms no link. Sorts are range sorts; what lies on both sides of a cut between
two partitions is compared after them.

Documents with equal sets are one node from the start. Candidates whose signatures
agree too little for the threshold are left out by a margin of ``MARGIN`` standard
deviations; each document's best candidates are confirmed on full shingle sets first,
and then those between documents that are not connected yet. Since only connected
components are asked for, links inside a component need no confirmation, and
no pair is confirmed twice.

Defined results: words are lower-cased in A-Z; a text with fewer than five words is one
shingle, its words; null and empty texts have no shingles and are linked with nothing;
repeated rows are in one component; an id of null is never smallest, a component of
null ids has component_id null; shingles are compared as 64-bit hashes; extra columns
stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from labelwright.llm.common import free_name, give_back, likely_in, small_slices
from labelwright.llm.components import components
from labelwright.session import release, spool

WORDS = 5
THRESHOLD = 0.75
VALUES = 96
TREES = 24
DEPTHS = (3, 5, 8, 12, 18, 27)
MARGIN = 4.5
SEED = 11
NEXT = 4
ROWS_PER_SORT_PART = 1 << 16
CHUNK_ROWS = 1 << 14
SLICE_BYTES = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles as sorted 64-bit hashes, and where each text's begin and end."""
    size = len(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(lists)
    owner = np.repeat(np.arange(size), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    owner = owner[real.to_numpy(zero_copy_only=False)]
    table = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary)
    )
    code = table[coded.indices.to_numpy(zero_copy_only=False)]
    count = np.bincount(owner, minlength=size)
    n = len(code)
    # A shingle at each word that has enough words after it; short texts have one at the start.
    first = np.cumsum(count) - count
    left = np.repeat(first + count, count) - np.arange(n)
    starts = (left >= words) | (np.arange(n) == np.repeat(first, count))
    hashed = np.full(n, 0x243F6A8885A308D3, np.uint64)
    padded = np.concatenate([code, np.zeros(words, np.uint64)])
    for i in range(words):
        inside = left > i
        hashed = np.where(inside, _mix(hashed ^ (padded[i : i + n] + np.uint64(i))), hashed)
    owner, hashed = owner[starts], hashed[starts]
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    keep = np.ones(len(hashed), bool)
    keep[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    owner, hashed = owner[keep], hashed[keep]
    return hashed, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=size))]).astype(np.int64)


def _functions(values: int = VALUES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    odd = np.array([rng.getrandbits(64) | 1 for _ in range(values)], np.uint64)
    return odd, np.array([rng.getrandbits(64) for _ in range(values)], np.uint64)


def signatures(hashed: np.ndarray, upto: np.ndarray, values: int = VALUES) -> np.ndarray:
    """(texts with shingles, values): the least value of each hash function over the set."""
    starts = upto[:-1][upto[1:] > upto[:-1]]
    out = np.empty((len(starts), values), np.int32)
    if not len(starts):
        return out
    odd, shift = _functions(values)
    with np.errstate(over="ignore"):
        for k in range(values):
            value = ((hashed * odd[k] + shift[k]) >> np.uint64(32)).astype(np.uint32)
            out[:, k] = np.minimum.reduceat(value, starts).view(np.int32)
    return out


def _set_keys(hashed: np.ndarray, upto: np.ndarray) -> list[int | None]:
    """A 64-bit name of each set, None for empty ones."""
    raw = np.ascontiguousarray(hashed).view(np.uint8)
    return [
        int.from_bytes(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True)
        if b > a else None
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())
    ]


def _sketches(docs: DataFrame, text_col: str, names: dict[str, str]) -> DataFrame:
    """``docs`` without texts, with the size, the name and the signature of each shingle set."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = StructType([
        *kept, StructField(names["n"], LongType()), StructField(names["set"], LongType()),
        StructField(names["sig"], ArrayType(IntegerType(), False)),
    ])
    order = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches, text_col, SLICE_BYTES):
            hashed, upto = shingles(part.column(text_col))
            sig = signatures(hashed, upto)
            full = upto[1:] > upto[:-1]
            ends = np.concatenate([[0], np.cumsum(np.where(full, VALUES, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(ends), pa.array(sig.ravel()), mask=pa.array(~full)
            )
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in order], pa.array(np.diff(upto)),
                 pa.array(_set_keys(hashed, upto), pa.int64()), lists],
                [*order, names["n"], names["set"], names["sig"]],
            )
        give_back()

    return docs.mapInArrow(run, schema)


def _full_sets(texts: DataFrame) -> DataFrame:
    """(node, text) to (node, shingles)."""
    schema = "node long, shingles array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches, "text", SLICE_BYTES):
            hashed, upto = shingles(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(hashed.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("node"), lists], ["node", "shingles"])
        give_back()

    return texts.select("node", "text").mapInArrow(run, schema)


def _orders(values: int = VALUES, trees: int = TREES, turn: int = 0) -> list[list[int]]:
    """Each tree's order of the signature; at first, first values are shared by no two trees."""
    rng = random.Random(SEED + turn)
    out = []
    for t in range(trees):
        own = [(t * DEPTHS[0] + i) % values for i in range(DEPTHS[0])] if not turn else rng.sample(range(values), DEPTHS[0])
        rest = [i for i in range(values) if i not in own]
        rng.shuffle(rest)
        out.append(own + rest)
    return out


def _least_agreement() -> float:
    return THRESHOLD - MARGIN * (THRESHOLD * (1 - THRESHOLD) / VALUES) ** 0.5


def _sort_rows(turn: int):
    """(node, sig, trees, family) to a row per tree, with 8 bits of each value in the tree's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = np.array(_orders(turn=turn))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sig = part.column("sig").flatten().to_numpy().reshape(-1, VALUES).view(np.uint32)
                short = (sig ^ (sig >> np.uint32(16)))
                short = (short ^ (short >> np.uint32(8))).astype(np.uint8)
                masks = part.column("trees").to_numpy()
                row, tree = np.nonzero((masks[:, None] >> np.arange(TREES)) & 1)
                keys = np.ascontiguousarray(short[row[:, None], orders[tree]])
                ends = np.arange(len(row) + 1, dtype=np.int32) * VALUES
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree.astype(np.int32)),
                     pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(keys)]),
                     part.column("node").take(pa.array(row)), part.column("family").take(pa.array(row))],
                    ["tree", "key", "node", "family"],
                )

    return run


def _next_pairs(tree: np.ndarray, keys: np.ndarray, node: np.ndarray, family: np.ndarray) -> tuple:
    """Rows in a tree's order, each with the next ``NEXT`` of other families that share its first values."""
    n = len(node)
    ends = np.flatnonzero(np.append(family[1:] != family[:-1], True)) + 1
    after = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    row, other = np.arange(n), after.copy()
    out = []
    for _ in range(NEXT):
        inside = other < n
        row, other = row[inside], other[inside]
        near = (tree[row] == tree[other]) & (keys[row, : DEPTHS[0]] == keys[other, : DEPTHS[0]]).all(axis=1)
        row, other = row[near], other[near]
        agreement = (keys[row] == keys[other]).mean(axis=1)
        good = (agreement >= _least_agreement()) & (node[row] != node[other])
        a, b = node[row[good]], node[other[good]]
        out.append((np.minimum(a, b), np.maximum(a, b), agreement[good]))
        other = other + 1
        own = (other < n) & (family[np.minimum(other, n - 1)] == family[row])
        other = np.where(own, after[np.minimum(other, n - 1)], other)
    return tuple(map(np.concatenate, zip(*out)))


_PAIRS = "a long, b long, agreement double"
_CUTS = "cut int, tree int, key binary, node long, family long"


def _walk(cuts: bool):
    """Sorted rows to pairs, and with ``cuts`` also the rows at the partition's ends."""
    names = ["tree", "key", "node", "family"]
    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def pairs(table: pa.Table) -> tuple[list, np.ndarray]:
        tree, node, family = (table.column(x).to_numpy() for x in ("tree", "node", "family"))
        raw = b"".join(table.column("key").to_pylist())
        found = _next_pairs(tree, np.frombuffer(raw, np.uint8).reshape(-1, VALUES), node, family)
        # Later rows can need the last ones, and the last ones of other families than the last.
        others = np.flatnonzero(family != family[-1])[-NEXT:]
        tail = np.union1d(np.arange(max(0, len(node) - NEXT), len(node)), others)
        return [pa.array(x) for x in found], tail

    def shaped(found: list, cut: int | None = None, rows: pa.Table | None = None) -> pa.RecordBatch:
        size = rows.num_rows if rows is not None else len(found[0])
        none = lambda kinds: [pa.nulls(size, t) for t in kinds]
        left = found or none([pa.int64(), pa.int64(), pa.float64()])
        if not cuts:
            return pa.RecordBatch.from_arrays(left, ["a", "b", "agreement"])
        right = none([pa.int32(), *types]) if rows is None else [
            pa.array(np.full(size, cut, np.int32)), *[rows.column(x).combine_chunks() for x in names]
        ]
        return pa.RecordBatch.from_arrays([*left, *right], ["a", "b", "agreement", "cut", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, size, tail, first = [], 0, None, True

        def flush():
            nonlocal held, size, tail, first
            table = pa.Table.from_batches(held).combine_chunks()
            if first and cuts and part:
                yield shaped([], part - 1, table.slice(0, NEXT))
            found, last = pairs(table)
            yield shaped(found)
            tail, first = table.take(pa.array(last)).combine_chunks(), False
            held, size = tail.to_batches(), 0

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                held.append(batch.select(names).slice(at, CHUNK_ROWS))
                size += held[-1].num_rows
                if size >= CHUNK_ROWS:
                    yield from flush()
        if size:
            yield from flush()
        if cuts and tail is not None:
            yield shaped([], part, tail)

    return run


def sorted_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b, agreement) of neighbours in the orders of ``turn``.

    ``rows``: node, sig, trees (a bit for each tree to sort in), family (no pairs within one).
    """
    parts = 1 + rows.count() * TREES // ROWS_PER_SORT_PART
    walked = spool(
        rows.select("node", "sig", "trees", "family")
        .mapInArrow(_sort_rows(turn), "tree int, key binary, node long, family long")
        .repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
        .mapInArrow(_walk(True), f"{_PAIRS}, {_CUTS}"),
        "walked",
    )
    at_cuts = (
        walked.where("cut IS NOT NULL").select("cut", "tree", "key", "node", "family")
        .repartition(parts, "cut").sortWithinPartitions("cut", "tree", "key", "node")
        .mapInArrow(_walk(False), _PAIRS)
    )
    return walked.where("a IS NOT NULL").select("a", "b", "agreement").unionByName(at_cuts).groupBy("a", "b").agg(
        F.max("agreement").alias("agreement")
    )


def _region(tree: Column, depth: int) -> Column:
    """The region of a signature in a tree at a depth."""
    orders = F.array(*[F.array(*map(F.lit, order[:depth])) for order in _orders()])
    values = F.transform(F.get(orders, tree), lambda i: F.get("sig", i))
    return F.xxhash64(tree, F.lit(depth), values)


def _all_trees() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")


def crowded(nodes: DataFrame) -> DataFrame:
    """The ``nodes`` (node, sig) that share a region, and their ``crowd``: members of their regions, in all."""
    first = _in_trees(nodes).select("node", "region")
    shared = spool(
        first.groupBy("region").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "regions"
    )
    crowd = spool(
        first.join(shared, "region").groupBy("node").agg(F.sum("members").alias("crowd")), "crowd"
    )
    dense = spool(likely_in(nodes, F.col("node"), crowd, F.col("node")).join(crowd, "node"), "dense")
    release(shared, crowd)
    return dense


def _in_trees(nodes: DataFrame) -> DataFrame:
    """A row per tree, with its first region in place of the signature."""
    kept = [x for x in nodes.columns if x != "sig"]
    return nodes.select(*kept, "sig", _all_trees()).select(*kept, "tree", _region(F.col("tree"), DEPTHS[0]).alias("region"))


def hub_pairs(dense: DataFrame) -> DataFrame:
    """Each node's pair (a, b) with the hub that it meets in most of its first regions."""
    placed = _in_trees(dense).select("node", "crowd", "region")
    hubs = placed.groupBy("region").agg(F.max(F.struct("crowd", "node")).alias("hub"))
    met = placed.join(hubs, "region").select("node", F.col("hub.node").alias("hub")).where("node <> hub")
    return (
        met.groupBy("node", "hub").agg(F.count(F.lit(1)).alias("met"))
        .groupBy("node").agg(F.max(F.struct("met", "hub")).alias("most"))
        .select(F.least("node", "most.hub").alias("a"), F.greatest("node", "most.hub").alias("b")).distinct()
    )


def candidates(rooted: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ``rooted`` (node, crowd, sig, family), none within a family."""
    # A row per tree, with its regions at all depths in place of the signature.
    rows = rooted.select("node", "crowd", "family", "sig", _all_trees()).select(
        "node", "crowd", "family", F.array(*[_region(F.col("tree"), d) for d in DEPTHS]).alias("regions")
    )
    found, levels = None, []
    for level in range(len(DEPTHS)):
        placed = rows.withColumn("region", F.get("regions", F.lit(level)))
        regions = (
            placed.groupBy("region").agg(
                F.count(F.lit(1)).alias("members"), F.min(F.struct("node", "family")).alias("low"),
                F.max(F.struct("crowd", "node", "family")).alias("hub"),
                F.min("family").alias("x"), F.max("family").alias("y"),
            ).where("x <> y").drop("x", "y")
        )
        inside = spool(placed.join(regions, "region"), "level")
        levels.append(inside)
        pairs = None
        for other in ("low", "hub"):
            some = inside.where(F.col("family") != F.col(f"{other}.family")).select(
                F.least("node", f"{other}.node").alias("a"), F.greatest("node", f"{other}.node").alias("b")
            )
            pairs = some if pairs is None else pairs.unionByName(some)
        found = pairs if found is None else found.unionByName(pairs)
        rows = inside.where("members > 2").select("node", "crowd", "family", "regions")
    pairs = spool(found.distinct(), "met")
    release(*levels)
    return pairs


def _agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs whose signatures agree enough, with their ``agreement``."""
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e))
    return (
        pairs.select("a", "b")
        .join(signed.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        .join(signed.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        .select("a", "b", (same / F.lit(float(VALUES))).alias("agreement"))
        .where(F.col("agreement") >= _least_agreement())
    )


def _rooted(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """``nodes`` with their family: the root of the component, as far as it is known."""
    return nodes.join(reached, "node", "left").withColumn("family", F.coalesce("root", "node")).drop("root")


def _roots(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """``pairs`` with ``ra`` and ``rb``, the families of a and b."""
    root = lambda side: reached.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    return (
        pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
        .withColumn("ra", F.coalesce("ra", "a")).withColumn("rb", F.coalesce("rb", "b"))
    )


def _merged(reached: DataFrame, links: DataFrame) -> DataFrame:
    """``reached`` (node, root) after more links: only their ends' families are a graph, not all links."""
    joined = components(_roots(links, reached).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("_least"))
    return spool(
        reached.join(moved, "root", "left").select("node", F.coalesce("_least", "root").alias("root"))
        .unionByName(joined.join(reached.select("node"), "node", "left_anti")), "reached",
    )


def _apart(rooted: DataFrame, turn: int) -> DataFrame:
    """Candidates of the orders of ``turn`` between families that meet in a region."""
    placed = _in_trees(rooted.select("node", "family", "sig"))
    mixed = placed.groupBy("region").agg(
        F.count(F.lit(1)).alias("members"), F.min("family").alias("x"), F.max("family").alias("y")
    ).where("members > 2 AND x <> y").select("region")
    trees = F.bit_or(F.expr("shiftleft(1, tree)")) if not turn else F.lit((1 << TREES) - 1)
    left = placed.join(mixed, "region").groupBy("node").agg(trees.cast("int").alias("trees"))
    left = spool(left.join(rooted.select("node", "family", "sig"), "node"), "left")
    pairs = spool(sorted_pairs(left, turn), "apart")
    release(left)
    return pairs


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = F.size(F.array_intersect("xa", "xb"))
    union = F.size("xa") + F.size("xb") - both
    return (
        pairs.select("a", "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")
        .where(100 * both >= F.lit(round(100 * THRESHOLD)) * union).select("a", "b")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without texts, with n_shingles, component_id, kept, and ``component``, its inner name."""
    taken = docs.columns
    names = {x: free_name(taken, f"_{x}") for x in ("n", "set", "sig", "print")}
    printed = F.xxhash64(F.col(text_col))
    wide = spool(
        _sketches(docs.withColumn(names["print"], printed), text_col, names), "sketches"
    )
    signed = spool(
        wide.where(F.col(names["set"]).isNotNull())
        .select(F.col(names["set"]).alias("node"), F.col(id_col).alias("id"),
                F.col(names["print"]).alias("print"), F.col(names["sig"]).alias("sig"))
        .groupBy("node").agg(
            F.min("id").alias("id"), F.min(F.struct("id", "print")).alias("holder"),
            F.min("sig").alias("sig"),
        ),
        "signed",
    )
    # Signatures take most of the space: one table has them at a time, in the end ``dense``.
    sketches = spool(wide.drop(names["sig"], names["print"]), "sketches")
    release(wide)
    dense = crowded(signed.select("node", "sig"))
    nodes = spool(
        signed.select("node", "id", F.xxhash64("holder.print", "holder.id").alias("holder")), "nodes"
    )
    release(signed)
    texts = docs.select(F.xxhash64(printed, F.col(id_col)).alias("holder"), F.col(text_col).alias("text"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        # One document holds each set; its text is read again for the sets that pairs need.
        # Rows of equal id and text are dropped where the join has brought them together.
        needed = spool(
            pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            .join(nodes.select("node", "holder"), "node"),
            "needed",
        )
        held = likely_in(texts, F.col("holder"), needed, F.col("holder")).join(needed, "holder")
        sets = spool(_full_sets(held.dropDuplicates(["holder"])), "sets")
        links = spool(_confirmed(pairs, sets), "links")
        release(needed, sets)
        return links

    tested = []

    def untested(pairs: DataFrame) -> DataFrame:
        known = reduce(DataFrame.unionByName, tested)
        return spool(pairs.join(known, ["a", "b"], "left_anti"), "candidates")

    def linked(pairs: DataFrame) -> DataFrame | None:
        """The links among the pairs, or None without any."""
        tested.append(pairs.select("a", "b"))
        if not pairs.head(1):
            return None
        found = confirmed(pairs)
        return found if found.head(1) else None

    # Hubs first: a family that its hub holds together has no other candidates.
    near = spool(_agreeing(hub_pairs(dense), dense), "candidates")
    tested.append(near.select("a", "b"))
    reached = components(confirmed(near))
    pairs = untested(_agreeing(candidates(_rooted(dense, reached)), dense))
    if pairs.head(1):
        # Sets are read only for pairs that are confirmed: most others are inside a component by then.
        best = pairs.select(F.col("a").alias("node"), "*").unionByName(
            pairs.select(F.col("b").alias("node"), "*")
        ).groupBy("node").agg(F.max(F.struct("agreement", "a", "b")).alias("p"))
        more = linked(spool(best.select("p.a", "p.b").distinct(), "best"))
        if more is not None:
            reached = _merged(reached, more)
        more = linked(untested(_roots(pairs, reached).where("ra <> rb").select("a", "b")))
        if more is not None:
            reached = _merged(reached, more)
    turn = 0
    while True:
        more = linked(untested(_apart(_rooted(dense, reached), turn)))
        if more is None:
            break
        reached = _merged(reached, more)
        turn += 1
    placed = nodes.select("node", "id").join(reached, "node", "left").select(
        "node", "id", F.coalesce("root", "node").alias("component")
    )
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = spool(placed.select("node", "component").join(least, "component"), "components")
    kept = [n for n in taken if n != text_col and n.lower() not in OUT]
    row_id = F.col(f"s.{id_col}")
    alone = F.col(f"s.{names['set']}").isNull()
    chosen = F.when(alone, row_id).otherwise(F.col("c.component_id"))
    return sketches.alias("s").join(
        named.alias("c"), F.col(f"s.{names['set']}") == F.col("c.node"), "left"
    ).select(
        *[F.col(f"s.{n}") for n in kept],
        F.col(f"s.{names['n']}").alias("n_shingles"),
        chosen.alias("component_id"),
        row_id.eqNullSafe(chosen).alias("kept"),
        F.col("c.component").alias("component"),
    )


OUT = ("n_shingles", "component_id", "kept", "component")
