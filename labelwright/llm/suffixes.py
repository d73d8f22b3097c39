"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are told apart only through their first ``DEPTH`` bytes, most significant
digits first, and a suffix that is alone after a pass goes no further. Groups left after
the last pass are exactly the strings of ``DEPTH`` bytes that start at two places.

The first digit of a suffix is an anchor: of the ``ANCHOR``-byte strings inside its first
``DEPTH`` bytes, the one with the least hash, the leftmost of equal ones. Equal suffixes
have equal anchors at equal distance, and neighbours mostly share theirs, so a run of
neighbours goes through the passes as one row:

1. runs by anchor: an anchor that occurs once ends all suffixes of its run;
2. runs by all the bytes they see: equal runs are repeated as a whole;
3. parts of ``PART`` suffixes of the other runs, by the bytes that all suffixes of the
   part have in common;
4. single suffixes of what is left, by all ``DEPTH`` bytes.

Later passes keep one of the equal runs of pass 2 as a partner for others. Each pass is
a grouped count and an equi-join, both over hashes; text moves only for documents with
runs that pass 2 leaves open, and for those with something to remove.

Defined results: texts are their UTF-8 bytes, null is empty; matches never cross rows;
repeated rows are repeated strings; strings are judged on the input; texts shorter than
``DEPTH`` lose nothing; what is kept may be no valid UTF-8; extra columns stay; an empty
table gives no rows. Two strings are equal if two 64-bit hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from labelwright.llm.common import FILTER_BUCKETS, free_name, likely_in, small_slices
from labelwright.session import spool

DEPTH = 400
ANCHOR = 256
PART = 16
PIECE = 1 << 20
SEED = 5

_POSITION_BITS = np.uint64(28)
_BASE = 0x9E3779B97F4A7C15


def _byte_values(seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * (out[done - 1] * np.uint64(base))
            done += more
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of substrings, from sums of byte values times powers modulo 2**64."""

    _tables: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, data: bytes):
        n = len(data)
        if Hasher._tables is None or len(Hasher._tables[0]) <= n:
            size = max(n + 1, PIECE + 2 * DEPTH)
            Hasher._tables = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
        up, self.down = Hasher._tables
        raw = np.frombuffer(data, np.uint8)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_byte_values()[raw] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        with np.errstate(over="ignore"):
            return _mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, from running minima of blocks both ways."""
    n = len(values) - width + 1
    filled = np.concatenate([values, np.full(-len(values) % width, 2**64 - 1, np.uint64)])
    blocks = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _pieces(texts: list[bytes], depth: int, piece: int = PIECE) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """Concatenated stretches of about ``piece`` bytes: [(text, where in it)...], bytes.

    A long text is cut into stretches that overlap, so each suffix is whole in one.
    """
    parts, held, joined = [], 0, []
    for number, text in enumerate(texts):
        for at in range(0, len(text) - depth + 1, piece):
            part = text[at : at + piece + depth - 1]
            parts.append((number, at, len(part)))
            joined.append(part)
            held += len(part)
            if held >= piece:
                yield parts, b"".join(joined)
                parts, held, joined = [], 0, []
    if parts:
        yield parts, b"".join(joined)


def runs(texts: list[bytes], depth: int = DEPTH, anchor: int = ANCHOR, piece: int = PIECE) -> dict[str, np.ndarray]:
    """Runs of neighbouring suffixes with one anchor: text, place, low, high, anchor, seen."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "place", "low", "high", "anchor", "seen")}
    for parts, data in _pieces(texts, depth, piece):
        hasher = Hasher(data)
        hashes = hasher.every(anchor)
        n = len(data) - depth + 1
        ranked = (hashes >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(hashes), dtype=np.uint64)
        place = (_sliding_least(ranked, depth - anchor + 1) & np.uint64((1 << 28) - 1)).astype(np.int64)
        sizes = np.array([p[2] for p in parts])
        owner = np.repeat(np.arange(len(parts)), sizes)
        whole = owner[:n] == owner[depth - 1 :]
        same = np.zeros(n + 1, bool)
        same[1:n] = whole[1:] & whole[:-1] & (place[1:n] == place[: n - 1]) & (owner[1:n] == owner[: n - 1])
        low = np.flatnonzero(whole & ~same[:n])
        high = np.flatnonzero(whole & ~same[1:])
        place = place[low]
        with np.errstate(over="ignore"):
            shape = (place - low).astype(np.uint64) * np.uint64(depth + 1) + (high - low).astype(np.uint64)
            seen = _mix(hasher.of(low, high + depth) ^ _mix(shape + np.uint64(1)))
        which = owner[low]
        shift = np.array([p[1] for p in parts]) - (np.cumsum(sizes) - sizes)
        out["text"].append(np.array([p[0] for p in parts])[which])
        for name, value in (("place", place), ("low", low), ("high", high)):
            out[name].append(value + shift[which])
        out["anchor"].append(hashes[place].view(np.int64))
        out["seen"].append(seen.view(np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _all_runs(keyed: DataFrame) -> DataFrame:
    """(t1, t2, text) to one row per run."""
    schema = "t1 long, t2 long, anchor long, seen long, place int, low int, high int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches, "text", 4 << 20):
            found = runs(_bytes_of(part.column("text")))
            of = pa.array(found["text"])
            yield pa.RecordBatch.from_arrays(
                [part.column("t1").take(of), part.column("t2").take(of), pa.array(found["anchor"]),
                 pa.array(found["seen"]),
                 *[pa.array(found[n].astype(np.int32)) for n in ("place", "low", "high")]],
                ["t1", "t2", "anchor", "seen", "place", "low", "high"],
            )

    return keyed.mapInArrow(run, schema)


def _parts(opened: DataFrame) -> DataFrame:
    """(t1, t2, text, open: runs) to one row per part: common bytes, and each suffix, as hashes."""
    schema = (
        "t1 long, t2 long, anchor long, part int, common long, weight int, first int, suffixes array<bigint>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"].encode()
                found = {k: [] for k in ("anchor", "part", "common", "weight", "first", "suffixes")}
                for at in range(0, len(row["open"]), 2000):
                    _hash_parts(text, row["open"][at : at + 2000], found)
                n = len(found["anchor"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["t1"]] * n, pa.int64()), pa.array([row["t2"]] * n, pa.int64()),
                     pa.array(found["anchor"], pa.int64()), pa.array(found["part"], pa.int32()),
                     pa.array(found["common"], pa.int64()), pa.array(found["weight"], pa.int32()),
                     pa.array(found["first"], pa.int32()), pa.array(found["suffixes"], pa.list_(pa.int64()))],
                    ["t1", "t2", "anchor", "part", "common", "weight", "first", "suffixes"],
                )

    return opened.mapInArrow(run, schema)


def _hash_parts(text: bytes, opened: list[dict], out: dict[str, list], depth: int = DEPTH, anchor: int = ANCHOR) -> None:
    for run in opened:
        low, high, place = run["low"], run["high"], run["place"]
        hasher = Hasher(text[low : high + depth])
        start = np.arange(high - low + 1)
        suffixes = hasher.of(start, start + depth).view(np.int64)
        # Distance from the suffix to its anchor; a part is a fixed range of distances.
        ahead = place - low - start
        part = ahead // PART
        edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(start)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            number = int(part[a])
            left = number * PART
            right = depth - anchor - min(left + PART - 1, depth - anchor)
            begin, end = place - left - low, place + anchor + right - low
            common = hasher.of(np.array([begin]), np.array([end])).view(np.int64)[0]
            out["anchor"].append(run["anchor"])
            out["part"].append(number)
            out["common"].append(int(common))
            out["weight"].append(run["weight"])
            out["first"].append(low + a)
            out["suffixes"].append(suffixes[a:b])


def repeated_starts(keyed: DataFrame) -> DataFrame:
    """(t1, t2, text) to (t1, t2, low, high): runs of places where a repeated string starts."""
    every = _all_runs(keyed)
    anchors = spool(
        every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors"
    )
    shared = spool(
        likely_in(every, F.col("anchor"), anchors, F.col("anchor")).join(anchors, "anchor"), "runs"
    )
    kinds = spool(
        shared.groupBy("anchor", "seen").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "low", "high", "place")).alias("run")
        ),
        "kinds",
    )
    undecided = kinds.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.count(F.when(F.col("n") == 1, 1)).alias("alone")
    ).where("kinds > 1 AND alone > 0").select("anchor")
    opened = spool(
        kinds.join(undecided, "anchor", "left_semi").select(
            F.col("run.t1").alias("t1"), F.col("run.t2").alias("t2"),
            F.struct("anchor", "run.low", "run.high", "run.place",
                     F.least("n", F.lit(2)).cast("int").alias("weight")).alias("run"),
        ).groupBy("t1", "t2").agg(F.collect_list("run").alias("open")),  # bounded by the text's length
        "open",
    )
    texts = likely_in(keyed, F.col("t1"), opened, F.col("t1")).join(opened, ["t1", "t2"]).dropDuplicates(["t1", "t2"])
    parts = spool(_parts(texts), "parts")
    common = ["anchor", "part", "common"]
    alive = spool(parts.groupBy(*common).agg(F.sum("weight").alias("n")).where("n > 1").drop("n"), "alive")
    single = parts.join(alive, common, "left_semi").select(
        "t1", "t2", "anchor", "weight", "first", F.posexplode("suffixes").alias("i", "suffix")
    )
    equal = single.groupBy("anchor", "suffix").agg(F.sum("weight").alias("n")).where("n > 1").drop("n")
    # Runs of weight 2 are repeated as a whole already.
    found = single.where("weight = 1").join(spool(equal, "equal"), ["anchor", "suffix"], "left_semi").select(
        "t1", "t2", (F.col("first") + F.col("i")).alias("low"), (F.col("first") + F.col("i")).alias("high")
    )
    whole = shared.join(kinds.where("n > 1").select("anchor", "seen"), ["anchor", "seen"], "left_semi")
    return whole.select("t1", "t2", "low", "high").unionByName(found)


def without(text: bytes, lows: np.ndarray, highs: np.ndarray, depth: int = DEPTH) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went, and in how many spans."""
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, lows, 1)
    np.add.at(change, highs + depth, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _cut(rows: DataFrame, text_col: str, found: str, names: dict[str, str]) -> DataFrame:
    kept = [f for f in rows.schema.fields if f.name not in (text_col, found)]
    order = [f.name for f in kept]
    schema = StructType([
        *kept, StructField(names["kept"], BinaryType()), StructField(names["removed"], LongType()),
        StructField(names["spans"], LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches, text_col):
            left, removed, spans = [], [], []
            for text, starts in zip(_bytes_of(part.column(text_col)), part.column(found)):
                values = starts.values
                low, high = (values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                a, b, c = without(text, low, high)
                left.append(a)
                removed.append(b)
                spans.append(c)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in order], pa.array(left, pa.binary()),
                 pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                [*order, names["kept"], names["removed"], names["spans"]],
            )

    return rows.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without texts, with ``kept`` (the bytes left), ``n_bytes``, ``n_removed`` and ``n_spans``."""
    names = {n: free_name(docs.columns, f"_{n}") for n in ("t1", "t2", "starts", "kept", "removed", "spans", "b", "hit")}
    text = F.coalesce(F.col(text_col), F.lit(""))
    t1, t2 = F.xxhash64(text), F.xxhash64(F.lit(SEED), text)
    keyed = docs.select(t1.alias("t1"), t2.alias("t2"), text.alias("text")).where(F.octet_length("text") >= DEPTH)
    starts = spool(
        repeated_starts(keyed).groupBy("t1", "t2").agg(F.collect_set(F.struct("low", "high")).alias("starts")),
        "starts",  # bounded by the text's length
    )
    others = [n for n in docs.columns if n != text_col and n.lower() not in OUT]
    marked = docs.select(*others, text.alias(text_col)).withColumns({names["t1"]: t1, names["t2"]: t2})
    found = starts.select(*[F.col(n).alias(names[n]) for n in ("t1", "t2", "starts")])
    bucket = lambda c: F.pmod(c, F.lit(FILTER_BUCKETS)).cast("int")
    buckets = starts.select(bucket(F.col("t1")).alias(names["b"])).distinct().withColumn(names["hit"], F.lit(True))
    split = marked.withColumn(names["b"], bucket(F.col(names["t1"]))).join(
        F.broadcast(buckets), names["b"], "left"
    ).drop(names["b"])
    untouched = split.where(F.col(names["hit"]).isNull()).select(
        *others, F.col(text_col).cast("binary").alias("kept"),
        F.octet_length(text_col).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
    )
    touched = split.where(names["hit"]).drop(names["hit"]).join(found, [names["t1"], names["t2"]], "left").withColumn(
        names["starts"],
        F.coalesce(names["starts"], F.array().cast("array<struct<low:int,high:int>>")),
    )
    cut = _cut(touched, text_col, names["starts"], names).select(
        *others, F.col(names["kept"]).alias("kept"),
        (F.octet_length(names["kept"]) + F.col(names["removed"])).cast("long").alias("n_bytes"),
        F.col(names["removed"]).alias("n_removed"), F.col(names["spans"]).alias("n_spans"),
    )
    return untouched.unionByName(cut)


OUT = ("kept", "n_bytes", "n_removed", "n_spans")
