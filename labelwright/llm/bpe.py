"""Byte-level BPE by merge replay over the distinct pieces of each part of the corpus.

A pattern splits a text into pieces; a piece is encoded by itself. Each task keeps the
distinct pieces it has met. For those it meets for the first time it replays the merges
once for all of them together: an inverted index leads from a merge's rank to the
positions whose pair it joins, ranks come off a heap in order, and a merge looks only
at the two neighbours it touches. So a piece that fills the corpus is encoded once per
task, nothing is shuffled, and a lost executor costs the tasks it held.

Memory: texts and ids come in slices of bounded size, and the pieces a task remembers are
dropped when they exceed ``MEMORY`` bytes (they are then encoded again when met).
A text is never cut. The ranks are a broadcast whose size is checked. ``round_trip`` encodes
and decodes slice by slice in one Python step, where two would hold two workers a core.

Defined results: a null or empty text has no ids and decodes to nothing; special tokens
are ordinary text; repeated rows repeat; extra columns stay, those named like an output
are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from labelwright.llm.common import give_back, small_slices

#: Bytes of pieces that a task remembers; each costs ``PIECE`` beyond its own.
MEMORY = 24 << 20
PIECE = 200
SLICE_BYTES = 2 << 20
SLICE_IDS = 1 << 20
MAX_RANKS_BYTES = 64 << 20

#: White space as the rank files' library means it. Fixed values.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    with open(path, "rb") as lines:
        data = lines.read(MAX_RANKS_BYTES + 1)
    if len(data) > MAX_RANKS_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANKS_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern, white space taken in Unicode's sense."""
    import regex

    plain = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]")
    return regex.compile(plain.replace(r"\s", f"[{_SPACE}]")).findall


class Merges:
    """The ranks as arrays: which pairs join to which token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        joined = [
            (ranks[token[:cut]] * size + ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        pairs = np.array(sorted(joined), np.int64).reshape(-1, 2)
        self.size, self.keys, self.made = size, pairs[:, 0].copy(), pairs[:, 1].astype(np.int32)
        # Tokens that can join to one of no higher rank: their merges go one at a time.
        self.late = np.zeros(size, bool)
        for part in (self.keys // size, self.keys % size):
            self.late[part[self.made <= part]] = True

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for pairs that don't join."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)


NONE = np.int32(2**31 - 1)


def _alternate(linked: np.ndarray) -> np.ndarray:
    """Of places in order, ``linked`` if the next one overlaps: every other one of each run."""
    starts = np.concatenate([[True], ~linked])
    place = np.arange(len(starts))
    return (place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0


def replay(pieces: Sequence[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, and how many each has: every merge in rank order over all at once.

    Of one rank, a piece's leftmost merge goes first. Where a merge can bring up another
    of the same or a lower rank, a turn takes one place per piece and puts the rest back.
    """
    whole = np.fromiter((merges.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
    lengths = np.where(whole >= 0, 1, np.fromiter(map(len, pieces), np.int64, len(pieces)))
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    flat = b"".join([p if w < 0 else b"?" for p, w in zip(pieces, whole)])
    ids = merges.single[np.frombuffer(flat, np.uint8)]
    word = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    ids[(ends - lengths)[whole >= 0]] = whole[whole >= 0]
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    after[ends[lengths > 0] - 1] = -1
    before[(ends - lengths)[lengths > 0]] = -1
    rank_at = np.full(n, NONE, np.int32)
    inner = np.flatnonzero(after >= 0)
    rank_at[inner] = merges.join(ids[inner], ids[inner + 1])

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def put(places: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(ranks)]
        for rank, a, b in zip(ranks[bounds[:-1]].tolist(), bounds[:-1], bounds[1:]):
            if rank in index:
                index[rank].append(places[a:b])
            else:
                index[rank] = [places[a:b]]
                heapq.heappush(heap, rank)

    able = np.flatnonzero(rank_at != NONE).astype(np.int32)
    if len(able):
        put(able, rank_at[able])
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank_at[at] == rank]
        if not len(at):
            continue
        if len(at) > 1:
            if merges.late[rank]:
                first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                if not first.all():
                    index[rank] = [at[~first]]
                    heapq.heappush(heap, rank)
                    at = at[first]
            elif (linked := after[at[:-1]] == at[1:]).any():
                at = at[_alternate(linked)]
        gone = after[at]
        then = after[gone]
        ids[at] = rank
        ids[gone] = -1
        after[at] = then
        after[gone] = -1
        rank_at[gone] = NONE
        rank_at[at] = NONE
        more = then >= 0
        right, then = at[more], then[more]
        before[then] = right
        left = before[at]
        left = left[left >= 0]
        touched = np.concatenate([right, left])
        if not len(touched):
            continue
        ranks = merges.join(ids[touched], ids[after[touched]])
        rank_at[touched] = ranks
        able = ranks != NONE
        if able.any():
            put(touched[able], ranks[able])
    alive = ids >= 0
    return ids[alive], np.bincount(word[alive], minlength=len(pieces))


class Encoder:
    """Encodes texts slice by slice; remembers pieces between slices."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY):
        self.merges, self.split, self.memory = Merges(ranks), splitter(pattern), memory
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.flat = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's ids start and end."""
        if self.held > self.memory:
            self._forget()
        number, known = self.number, len(self.number)
        codes, counts = [], []
        for text in texts:
            pieces = self.split(text) if text else []
            codes.append(
                np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.int32, len(pieces))
            )
            counts.append(len(pieces))
        if len(number) > known:
            fresh = [p.encode() for p in islice(number, known, None)]
            self.held += sum(map(len, fresh)) + PIECE * len(fresh)
            ids, sizes = replay(fresh, self.merges)
            self.flat = np.concatenate([self.flat, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        starts = self.offsets[code]
        sizes = self.offsets[code + 1] - starts
        ends = np.cumsum(sizes)
        # Where the piece's ids are, minus where it begins in the output, plus the place there.
        where = np.repeat(starts - (ends - sizes), sizes)
        where += np.arange(len(where))
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return self.flat[where], upto


def _with_column(schema: StructType, name: str, kind) -> StructType:
    kept = [f for f in schema.fields if f.name.lower() != name.lower()]
    return StructType([*kept, StructField(name, kind, True)])


def _appended(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays(
        [*[batch.column(i) for i in kept], values], [*[batch.schema.names[i] for i in kept], name]
    )


def _shared_ranks(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(load_ranks(path))


class Decoder:
    """The bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for value, rank in ranks.items():
            self.token[rank] = value

    def decode(self, lists: pa.ListArray) -> pa.Array:
        token = self.token
        return pa.array([b"".join([token[i] for i in ids.tolist()]) for ids in _lists(lists)], pa.binary())


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "ids"
) -> DataFrame:
    """``docs`` with the ids of each text."""
    ranks = _shared_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for part in small_slices(batches, text_col, SLICE_BYTES):
            yield _appended(part, out, _encoded(encoder, part.column(text_col)))
        del encoder
        give_back()

    return docs.mapInArrow(run, _with_column(docs.schema, out, ArrayType(IntegerType(), True)))


def _encoded(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    ids, upto = encoder.encode(texts.to_pylist())
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()))


def decode(
    encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded",
    id_bytes: str | None = None,
) -> DataFrame:
    """``encoded`` with the bytes that the ids stand for. Null ids decode to nothing.

    ``id_bytes``: a column for the ids as little-endian unsigned 32-bit integers, if wanted.
    """
    ranks = _shared_ranks(encoded.sparkSession, ranks_path)
    schema = _with_column(encoded.schema, out, BinaryType())
    if id_bytes:
        schema = _with_column(schema, id_bytes, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(ranks.value)
        for batch in _few_ids(batches, ids_col):
            lists = batch.column(ids_col)
            batch = _appended(batch, out, decoder.decode(lists))
            if id_bytes:
                numbers = [ids.astype("<u4").tobytes() for ids in _lists(lists)]
                batch = _appended(batch, id_bytes, pa.array(numbers, pa.binary()))
            yield batch
        del decoder
        give_back()

    return encoded.mapInArrow(run, schema)


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "ids"
) -> DataFrame:
    """``docs`` with the ids of each text, and in place of the text what those ids decode to."""
    ranks = _shared_ranks(docs.sparkSession, ranks_path)
    schema = _with_column(_with_column(docs.schema, text_col, StringType()), out, ArrayType(IntegerType(), True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(ranks.value, pattern), Decoder(ranks.value)
        for part in small_slices(batches, text_col, SLICE_BYTES):
            lists = _encoded(encoder, part.column(text_col))
            part = _appended(part, text_col, decoder.decode(lists).cast(pa.string()))
            yield _appended(part, out, lists)
        del encoder, decoder
        give_back()

    return docs.mapInArrow(run, schema)


def _few_ids(batches: Iterator[pa.RecordBatch], ids_col: str) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of about ``SLICE_IDS`` ids; a longer list is one by itself."""
    for batch in batches:
        upto = batch.column(ids_col).offsets.to_numpy()
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(upto, upto[start] + SLICE_IDS, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each row's ids by themselves, none for null; never a batch as Python objects."""
    flat = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for row in range(len(column)):
        yield flat[offsets[row] : offsets[row + 1]] if valid[row] else flat[:0]
