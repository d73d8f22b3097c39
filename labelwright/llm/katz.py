"""Katz backoff language model of word pairs, learned and evaluated in one exchange.

Good-Turing discounts apply to counts of at most ``RELIABLE``; larger counts give up
``CONSTANT`` each, so every context that was seen keeps mass for words that did not
follow it. The weight of that mass is normalised exactly: over the words known to
training, the end mark and one class of unknown words, each context sums to 1. A token's
probability is evaluated recursively: the discounted count of the pair, or else the
context's backoff weight times the discounted count of the word, or else the mass of
unknown words.

The model is three partitioned tables, written by ``score``: ``words`` (count), ``contexts``
(count and backoff weight) and pairs (count), a row for each distinct pair in the file of the
part of its second word, hot ones by both words. ``look_up`` scores any texts by them. The
texts that ``score`` is given need no lookup: each sends its distinct pairs to the task that
counts them, in packed arrays, and back come

* per text, sums of logarithms that are final but for the discounts of small counts, of
  which it counts how often it needs each;
* per context, how many pairs have each small count, and the mass of the words seen;
* per text and context, how many pairs were unseen.

The count of the context, the divisor of each seen pair, is the count of the word before,
so it is added where that word is the second one. Discounts and weights then join the
grouped sums. Hot words, by a share that falls with the number of parts, have their counts
sent along and their pairs dealt by both words.

Defined results: a null or empty text is the end mark alone; repeated rows are learned
repeatedly and score alike; without any training text the only class is the unknown
word, at probability 1; extra columns stay; an empty table gives no rows. Words are
compared as 64-bit hashes, and so are rows of equal id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelwright.llm.common import WORD, free_name, give_back, small_slices
from labelwright.session import scratch_path, spool

RELIABLE = 5
CONSTANT = 0.5
#: A word is hot with more than 1 / (HOT_PER_PART * parts) of all tokens, within these bounds of
#: how many words can be hot; their counts go to every task.
HOT_PER_PART, LEAST_HOT, MOST_HOT = 8, 400, 1 << 16
SLICE_BYTES = 8 << 20
SLICE_ROWS = 30_000  # a text's place in its slice fits a short
PART_BYTES = 24 << 20
START = 0x1B873593CC9E2D51
END = 0x2545F4914F6CDD1D

_DOC, _CONTEXT, _UNSEEN, _COUNTS, _PAIR = range(5)
_SMALL = [f"r{i}" for i in range(1, RELIABLE + 2)]
_OUT = "kind int, key long, other long, x double, y double, n long, known long, " + ", ".join(
    f"{r} long" for r in _SMALL
)
_POSTINGS = (
    "part int, docs array<bigint>, learn array<boolean>, second binary, firsts binary, "
    "names binary, first binary, texts binary, doc array<smallint>, times binary"
)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(lists)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    table = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary)
    )
    counts = np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return table[coded.indices.to_numpy(zero_copy_only=False)], counts.astype(np.int64)


def _sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second hash of each pair, and its text. Texts run from START to END."""
    words, counts = _tokens(texts)
    size = len(counts)
    doc = np.repeat(np.arange(size, dtype=np.int32), counts + 1)
    second = np.full(len(words) + size, END, np.uint64)
    last = np.cumsum(counts + 1) - 1
    inner = np.ones(len(second), bool)
    inner[last] = False
    second[inner] = words
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[last - counts] = START
    return first, second, doc


def _word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): training tokens by slice, the end mark included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches, "text", SLICE_BYTES):
            part = part.filter(part.column("learn"))
            _, second, _ = _sequences(part.column("text"))
            word, n = np.unique(second, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])
        give_back()

    return docs.select("text", "learn").mapInArrow(run, "word long, n long")


def discounts(counts: dict[int, float], reliable: int = RELIABLE) -> list[float]:
    """What is kept of counts 1 to ``reliable``, from how many types have each count.

    Katz's form of Good-Turing. Where it gives nothing between 0 and 1 (too few counts of
    counts), ``CONSTANT`` is taken off the count.
    """
    n = [counts.get(r, 0) for r in range(reliable + 2)]
    cut = (reliable + 1) * n[reliable + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, reliable + 1):
        star = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        kept = (star - cut) / (1 - cut) if cut < 1 else 0.0
        out.append(kept if 0 < kept < 1 else (r - CONSTANT) / r)
    return out


@dataclass
class Unigrams:
    """What every task needs to know of single words: bounded numbers only."""

    total: int
    types: int
    kept: list[float]
    unknown: float
    hot: dict[int, int]

    def probability(self, count: np.ndarray) -> np.ndarray:
        """Of words with these training counts; 0 is the class of unknown words."""
        if not self.total:
            return np.ones(len(count))
        table = np.array([0.0, *[k * r for r, k in enumerate(self.kept, 1)]])
        small = np.minimum(count, RELIABLE)
        kept = np.where(count <= RELIABLE, table[small], count - CONSTANT)
        return np.where(count > 0, kept / self.total, self.unknown)


def hot_words(parts: int) -> int:
    """How many words can be hot at most: a word is hot beyond 1 / this of all tokens."""
    return min(max(LEAST_HOT, HOT_PER_PART * parts), MOST_HOT)


def _unigrams(words: DataFrame, parts: int) -> Unigrams:
    row = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, types = int(row[0]), int(row[1])
    small = {r[0]: r[1] for r in words.where(F.col("n") <= RELIABLE + 1).groupBy("n").count().collect()}
    kept = discounts(small)
    lost = sum((1 - k) * r * small.get(r, 0) for r, k in enumerate(kept, 1))
    lost += CONSTANT * (types - sum(small.get(r, 0) for r in range(1, RELIABLE + 1)))
    hot = words.where(F.col("n") > F.lit(total / hot_words(parts))).collect()
    return Unigrams(total, types, kept, lost / total if total else 1.0, {r.word: r.n for r in hot})


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Each stretch of ``values`` between two ``cuts``: its length, then its bytes, compressed.

    Bytes go by significance, low ones of all values first: numbers within a part are
    small, so most of the others are zero, which the shuffle's own codec does not see.
    """
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        planes = np.ascontiguousarray(values[a:b].view(np.uint8).reshape(b - a, values.itemsize).T)
        out.append(np.int32(b - a).tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True))
    return pa.array(out, pa.binary())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size, width = int(np.frombuffer(data, np.int32, 1)[0]), np.dtype(kind).itemsize
    planes = pa.decompress(data[4:], size * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, size).T).view(kind).ravel()


def _postings(docs: DataFrame, parts: int, hot: dict[int, int]) -> DataFrame:
    """Each slice's distinct pairs by part: second words, their first words, and the texts."""
    hot_words = np.array(sorted(hot), np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slice_ in small_slices(batches, "text", SLICE_BYTES, SLICE_ROWS):
            first, second, doc = _sequences(slice_.column("text"))
            part = _mix(second)
            if len(hot_words):
                both = np.isin(second, hot_words)
                part[both] = _mix(second[both] ^ _mix(first[both] + np.uint64(1)))
            part = (part % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((doc, first, second, part))
            part, second, first, doc = part[order], second[order], first[order], doc[order]
            del order
            n = len(part)
            new_part = np.concatenate([[True], part[1:] != part[:-1]])
            new_second = new_part | np.concatenate([[True], second[1:] != second[:-1]])
            new_pair = new_second | np.concatenate([[True], first[1:] != first[:-1]])
            new_text = new_pair | np.concatenate([[True], doc[1:] != doc[:-1]])
            t, p, s = (np.flatnonzero(x) for x in (new_text, new_pair, new_second))
            times = np.diff(np.append(t, n)).astype(np.int32)
            texts = np.diff(np.append(np.searchsorted(t, p), len(t))).astype(np.int32)
            firsts = np.diff(np.append(np.searchsorted(p, s), len(p))).astype(np.int32)
            starts = np.flatnonzero(new_part)
            # First words by number within their part: each hash goes once.
            which, named = part[p], first[p]
            by_name = np.lexsort((named, which))
            which, named = which[by_name], named[by_name]
            new_name = np.concatenate([[True], (which[1:] != which[:-1]) | (named[1:] != named[:-1])])
            place = np.cumsum(new_name) - 1
            begins = np.searchsorted(which[new_name], part[starts])
            number = np.empty(len(p), np.int32)
            number[by_name] = place - begins[np.searchsorted(part[starts], which)]
            names = named[new_name]
            cut = lambda at: np.append(np.searchsorted(at, starts), len(at)).astype(np.int32)
            packed = lambda values, at: _packed(values, cut(at))
            # Texts likewise: a part gets the keys of those it has pairs of.
            of_text = np.searchsorted(part[starts], part[t])
            met, local = np.unique(of_text * np.int64(slice_.num_rows) + doc[t], return_inverse=True)
            text_cut = np.searchsorted(met, np.arange(len(starts) + 1) * np.int64(slice_.num_rows))
            local = (local - text_cut[of_text]).astype(np.int16)
            met %= slice_.num_rows
            keys = slice_.column("row").to_numpy(zero_copy_only=False)[met]
            learn = slice_.column("learn").to_numpy(zero_copy_only=False)[met]
            text_cut = pa.array(text_cut.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[starts]), pa.ListArray.from_arrays(text_cut, pa.array(keys)),
                 pa.ListArray.from_arrays(text_cut, pa.array(learn)),
                 packed(second[s], s), packed(firsts, s),
                 _packed(names, np.append(begins, len(names))),
                 packed(number, p), packed(texts, p),
                 pa.ListArray.from_arrays(pa.array(cut(t)), pa.array(local)), packed(times, t)],
                ["part", "docs", "learn", "second", "firsts", "names", "first", "texts", "doc", "times"],
            )
        give_back()

    return docs.select("row", "learn", "text").mapInArrow(run, _POSTINGS)


def _dealt(postings: DataFrame, parts: int) -> DataFrame:
    """A task for each part: dealt by hash, some tasks would get several and sort them all."""
    return postings.repartitionById(parts, F.col("part")).sortWithinPartitions("part")


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _rows(kind: int, key: np.ndarray, other=None, x=None, y=None, n=None, known=None, small=None):
    size = len(key)
    zero, none = np.zeros(size, np.int64), np.zeros(size)
    small = np.zeros((RELIABLE + 1, size), np.int64) if small is None else small
    columns = [np.full(size, kind, np.int32), key, zero if other is None else other,
               none if x is None else x, none if y is None else y, zero if n is None else n,
               zero if known is None else known, *small]
    names = ["kind", "key", "other", "x", "y", "n", "known", *_SMALL]
    for a in range(0, size, 1 << 17):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[a : a + (1 << 17)]) for c in columns], names
        )


def _evaluate(grams: Unigrams):
    """A part's postings to rows of _OUT."""
    names = np.array(sorted(grams.hot), np.int64)
    totals = np.array([grams.hot[name] for name in names.tolist()], np.int64)

    def one(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, learn, second, first, texts, doc, times = lists = [], [], [], [], [], [], []
        base = 0
        # What is packed goes as it is unpacked, and the pieces of each column as it is put together.
        batches.reverse()
        while batches:
            batch = batches.pop()
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                docs.append(_flat(row, "docs"))
                learn.append(_flat(row, "learn").astype(bool))
                held = {name: row.column(name)[0].as_py() for name in ("second", "firsts", "names", "first", "texts", "times")}
                second.append(np.repeat(_unpacked(held["second"], np.int64), _unpacked(held["firsts"], np.int32)))
                first.append(_unpacked(held["names"], np.int64)[_unpacked(held["first"], np.int32)])
                texts.append(_unpacked(held["texts"], np.int32))
                doc.append(_flat(row, "doc").astype(np.int32) + np.int32(base))
                times.append(_unpacked(held["times"], np.int32))
                base += len(docs[-1])
        batch = row = held = None
        whole = []
        for pieces in lists:
            whole.append(np.concatenate(pieces))
            pieces.clear()
        docs, learn, second, first, texts, doc, times = whole
        whole.clear()
        # Pairs of several slices come together.
        order = np.lexsort((first, second)).astype(np.int32)
        second, first = second[order], first[order]
        fresh = np.concatenate([[True], (second[1:] != second[:-1]) | (first[1:] != first[:-1])])
        group = np.empty(len(order), np.int32)
        group[order] = np.cumsum(fresh, dtype=np.int32) - 1
        second, first = second[fresh], first[fresh]
        pair = np.repeat(group, texts)
        del order, fresh, group, texts
        count = np.bincount(pair, np.where(learn[doc], times, 0), minlength=len(second)).astype(np.int64)
        # A word's count is the sum over its pairs, but for hot words, which are in many parts.
        new = np.concatenate([[True], second[1:] != second[:-1]])
        word = np.cumsum(new) - 1
        own = np.bincount(word, count).astype(np.int64)
        if len(names):
            at = np.minimum(np.searchsorted(names, second[new]), len(names) - 1)
            own = np.where(names[at] == second[new], totals[at], own)
        own = own[word]
        chance = grams.probability(own)
        seen = count > 0
        small = seen & (count <= RELIABLE)
        with np.errstate(divide="ignore"):
            value = np.where(
                seen, np.log10(np.where(small, count, np.maximum(count - CONSTANT, CONSTANT))), np.log10(chance)
            )
        value -= np.where((own > 0) & (second != np.uint64(END).astype(np.int64)), np.log10(np.maximum(own, 1)), 0)
        plus = np.log10(own + 1.0)
        size = len(docs)
        used = np.zeros((RELIABLE + 1, size), np.int64)
        for r in range(1, RELIABLE + 1):
            at = (count == r)[pair]
            used[r - 1] = np.bincount(doc[at], times[at], minlength=size)
        total = np.bincount(doc, times, minlength=size).astype(np.int64)
        met = total > 0
        yield from _rows(
            _DOC, docs[met],
            x=np.bincount(doc, value[pair] * times, minlength=size)[met],
            y=np.bincount(doc, plus[pair] * times, minlength=size)[met],
            n=total[met],
            known=np.bincount(doc, (own > 0)[pair] * times, minlength=size).astype(np.int64)[met],
            small=used[:, met],
        )
        contexts, of = np.unique(first[seen], return_inverse=True)
        kinds = np.zeros((RELIABLE + 1, len(contexts)), np.int64)
        for r in range(1, RELIABLE + 2):
            at = (count[seen] == r) if r <= RELIABLE else (count[seen] > RELIABLE)
            kinds[r - 1] = np.bincount(of[at], minlength=len(contexts))
        yield from _rows(
            _CONTEXT, contexts, x=np.bincount(of, chance[seen], minlength=len(contexts)),
            n=np.bincount(of, count[seen], minlength=len(contexts)).astype(np.int64), small=kinds,
        )
        yield from _rows(_PAIR, first[seen], other=second[seen], n=count[seen])
        at = ~seen[pair]
        yield from _rows(_UNSEEN, first[pair[at]], other=docs[doc[at]], n=times[at].astype(np.int64))
        r = np.arange(1, RELIABLE + 2, dtype=np.int64)
        yield from _rows(_COUNTS, r, n=np.bincount(np.minimum(count, RELIABLE + 2), minlength=RELIABLE + 3)[1:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = np.flatnonzero(parts[1:] != parts[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)]):
                if b > a:
                    if part is not None and parts[a] != part:
                        yield from one(held)
                        held = []
                        give_back()
                    part = parts[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield from one(held)
        give_back()

    return run


def _log10(value: float) -> float:
    return float(np.log10(value)) if value > 0 else float("-inf")


@dataclass
class Fitted:
    """Paths of the model's tables, and what is known of it as a whole."""

    path: str
    grams: Unigrams
    kept: list[float]

    def words(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("word long, n long").parquet(f"{self.path}/words")

    def contexts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("word long, count long, weight double").parquet(f"{self.path}/contexts")

    def pairs(self, spark: SparkSession) -> DataFrame:
        """(first, second, n): how often each pair of training was met."""
        return _found(spark, self.path, _PAIR).select(
            F.col("key").alias("first"), F.col("other").alias("second"), "n"
        )


def _found(spark: SparkSession, path: str, kind: int) -> DataFrame:
    """What the tasks have found of one kind, not yet summed over parts."""
    return spark.read.schema(_OUT.replace("kind int, ", "") + ", kind int").parquet(f"{path}/found").where(
        F.col("kind") == kind
    )


def _kept_of(count: Column, kept: list[float]) -> Column:
    """The discounted ``count``."""
    table = F.array(*[F.lit(k * r) for r, k in enumerate(kept, 1)])
    return F.when(count <= RELIABLE, F.get(table, (count - 1).cast("int"))).otherwise(count - F.lit(CONSTANT))


def _text_pairs(docs: DataFrame) -> DataFrame:
    """(row, text) to (row, first, second, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches, "text", SLICE_BYTES, SLICE_ROWS):
            first, second, doc = _sequences(part.column("text"))
            order = np.lexsort((second, first, doc))
            first, second, doc = first[order], second[order], doc[order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [part.column("row").take(pa.array(doc[at])), pa.array(first[at].view(np.int64)),
                 pa.array(second[at].view(np.int64)), pa.array(np.diff(np.append(at, len(doc))))],
                ["row", "first", "second", "times"],
            )
        give_back()

    return docs.select("row", "text").mapInArrow(run, "row long, first long, second long, times long")


def look_up(docs: DataFrame, model: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of any texts, each distinct one once for an id: their tokens looked up in the model's tables.

    A token's pair, or else its context's weight times its word, or else the mass of unknown words.
    """
    spark, grams = docs.sparkSession, model.grams
    keyed = docs.select(
        F.xxhash64(F.lit("katz"), F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).dropDuplicates(["row"])
    lower = F.when(
        F.col("n").isNotNull(), _kept_of(F.col("n"), grams.kept) / F.lit(float(grams.total or 1))
    ).otherwise(F.lit(grams.unknown))
    chance = F.when(
        F.col("met").isNotNull(), _kept_of(F.col("met"), model.kept) / F.col("count")
    ).otherwise(F.coalesce("weight", F.lit(1.0)) * lower)
    tokens = (
        _text_pairs(keyed)
        .join(model.pairs(spark).withColumnRenamed("n", "met"), ["first", "second"], "left")
        .join(model.words(spark).withColumnRenamed("word", "second"), "second", "left")
        .join(model.contexts(spark).withColumnRenamed("word", "first"), "first", "left")
    )
    sums = tokens.groupBy("row").agg(F.sum(F.col("times") * F.log10(chance)).alias("score"))
    return keyed.select("row", "id").join(sums, "row").select(F.col("id").alias(id_col), "score")


def score(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, Fitted]:
    """``docs`` without texts, with n_tokens, n_known, train_tokens, base_score and score; and the model.

    ``learn`` says which rows the model is learned from.
    """
    spark = docs.sparkSession
    row = F.xxhash64(F.lit("katz"), F.col(id_col), F.col(text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(row.alias("row"), F.coalesce(learn, F.lit(True)).alias("learn"), text.alias("text"))
    path = scratch_path(spark, "katz")
    _word_counts(keyed).groupBy("word").agg(F.sum("n").alias("n")).write.parquet(f"{path}/words")
    facts = keyed.agg(F.sum(F.octet_length("text")), F.count(F.when(F.col("learn"), 1))).first()
    parts = max(1, -(-int(facts[0] or 0) // PART_BYTES))
    grams = _unigrams(spark.read.schema("word long, n long").parquet(f"{path}/words"), parts)
    # Pairs and contexts of texts are written as they are found; only what several parts share is summed.
    _dealt(_postings(keyed, parts, grams.hot), parts).mapInArrow(_evaluate(grams), _OUT).write.partitionBy(
        "kind"
    ).parquet(f"{path}/found")
    of_kind = lambda kind: _found(spark, path, kind)
    summed = lambda kind, *columns: of_kind(kind).groupBy("key").agg(*[F.sum(c).alias(c) for c in columns])
    kept = discounts({r.key: r.n for r in summed(_COUNTS, "n").collect()})
    free = sum((F.lit((1 - k) * r) * F.col(f"r{r}") for r, k in enumerate(kept, 1)), F.lit(CONSTANT) * F.col(_SMALL[-1]))
    summed(_CONTEXT, "x", "n", *_SMALL).select(
        F.col("key").alias("word"), F.col("n").alias("count"),
        (free / F.col("n") / (F.lit(1.0) - F.col("x"))).alias("weight"),
    ).write.parquet(f"{path}/contexts")
    model = Fitted(path, grams, kept)
    contexts = model.contexts(spark)
    backed = (
        of_kind(_UNSEEN).select(F.col("key").alias("word"), F.col("other").alias("row"), "n")
        .join(contexts, "word")
        .groupBy("row").agg(F.sum(F.col("n") * (F.log10("weight") + F.log10("count"))).alias("backed"))
    )
    used = sum((F.col(f"r{r}") * F.lit(_log10(k)) for r, k in enumerate(kept, 1)), F.lit(0.0))
    by_row = summed(_DOC, "x", "y", "n", "known", *_SMALL).select(
        F.col("key").alias("row"), (F.col("x") + used).alias("x"), "y", F.col("n").alias("all"), "known"
    )
    start = _log10(facts[1]) if facts[1] else 0.0
    base = _log10(grams.total + grams.types + 1)
    names = {n: free_name(docs.columns, f"_{n}") for n in ("row", "tokens")}
    kept_columns = [n for n in docs.columns if n != text_col and n.lower() not in OUT]
    whole = spool(by_row.join(backed, "row", "left"), "scores")
    tokens = F.col(names["tokens"])
    # Rows of equal id and text were summed together.
    copies = F.col("s.all") / tokens
    return docs.select(
        *kept_columns, row.alias(names["row"]),
        (F.regexp_count(text, F.lit(WORD)) + 1).cast("long").alias(names["tokens"]),
    ).alias("d").join(whole.alias("s"), F.col(names["row"]) == F.col("s.row")).select(
        *[F.col(f"d.{n}") for n in kept_columns],
        tokens.alias("n_tokens"),
        F.round(F.col("s.known") / copies).cast("long").alias("n_known"),
        F.lit(grams.total).cast("long").alias("train_tokens"),
        (F.col("s.y") / copies - tokens * F.lit(base)).alias("base_score"),
        ((F.col("s.x") + F.coalesce("s.backed", F.lit(0.0))) / copies - F.lit(start)).alias("score"),
    ), model


OUT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
