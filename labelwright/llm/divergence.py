"""Divergence of sources: how the words of each source differ from the others of its language.

Counting packs terms by length. A task takes a slice of documents as one byte array,
finds the terms in it with vector operations, and packs those of up to 8 bytes into one
64-bit word, those of up to 16 into two. Words are radix-sorted by 16-bit digits, the
lowest first, which leaves the documents of a term in order; the runs are its counts and
its numbers of documents. Longer terms go to a bucket for each length, sorted as bytes.
Slices give one row per group and term; Spark adds them up, keeps the terms of a language
that enough documents hold, and turns counts into integer shares.

Pairs of sources are not joined term by term. With p0 the share of a term that a source
does not have, the sum over all V kept terms is V f(p0, q0), plus corrections for terms
that one side has, which follow from how many terms have each share, plus corrections for
terms that both have. Only those need the terms themselves: rows dealt out by term pass
through tasks that add the corrections of each pair of sources in 64-bit integers.

Defined results: null text, language and source are empty strings, which are values like
any other; a repeated row is a document of its own; a language without kept terms has
pairs of value 0 and no terms; a language with one source has no pairs; an empty table
gives no rows; sums are exact (a sum beyond 64 bits is an error); extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelwright.llm.common import small_slices
from labelwright.session import spool

MIN_DOCS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
COUNTED = "lang string, source string, term string, n long, docs long"
#: Pairs of sources whose corrections a task holds before it passes them on.
HELD_PAIRS = 1 << 18


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by 64-bit ``words``, the first being the most significant."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of each term in the texts that ``offsets`` cuts ``data`` into.

    ``data`` is lower-case in A-Z; terms are runs of a-z and of bytes from 0x80.
    """
    held = ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = held[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = held[1:]
    starts = np.flatnonzero(held & (~before | cut[:-1]))
    ends = np.flatnonzero(held & (~after | cut[1:])) + 1
    return starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1


def _packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n_words: int) -> list[np.ndarray]:
    """Terms as big-endian 64-bit words, zeros behind their ends."""
    words = []
    for word in range(n_words):
        value = np.zeros(len(starts), np.uint64)
        for byte in range(8):
            at = 8 * word + byte
            inside = lengths > at
            value[inside] |= data[starts[inside] + at].astype(np.uint64) << np.uint64(56 - 8 * byte)
        words.append(value)
    return words


def _runs(changes: np.ndarray, groups: np.ndarray, docs: np.ndarray):
    """(first row, n, n_docs) of runs of one term in one group; rows are sorted by term, then document.

    ``changes``: where a row's term differs from the one before it.
    """
    fresh = changes.copy()
    fresh[1:] |= groups[1:] != groups[:-1]
    first = np.flatnonzero(fresh)
    seen = changes.copy()
    seen[1:] |= docs[1:] != docs[:-1]
    return first, np.diff(np.append(first, len(changes))), np.add.reduceat(seen.astype(np.int64), first)


def _strings(rows: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings from rows of bytes that zeros fill up."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    flat = np.ascontiguousarray(rows[np.arange(rows.shape[1]) < lengths[:, None]])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(flat))


def _bucket(data, starts, lengths, docs, group_of):
    """(terms, group, n, n_docs) of the terms of one bucket."""
    width = int(lengths.max())
    if width <= 16:
        words = _packed(data, starts, lengths, 1 if width <= 8 else 2)
        order = radix_order(words)
        words = [word[order] for word in words]
        changes = np.ones(len(order), bool)
        changes[1:] = np.logical_or.reduce([word[1:] != word[:-1] for word in words])
    else:
        rows = data[starts[:, None] + np.arange(width)]
        keys = np.ascontiguousarray(rows).view(f"S{width}").ravel()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        changes = np.ones(len(order), bool)
        changes[1:] = keys[1:] != keys[:-1]
    docs = docs[order]
    groups = group_of[docs]
    first, n, n_docs = _runs(changes, groups, docs)
    at = order[first]
    if width <= 16:
        raw = np.stack([word[first] for word in words], axis=1).astype(">u8")
        rows = np.ascontiguousarray(raw).view(np.uint8).reshape(len(first), -1)
    else:
        rows = rows[at]
    return _strings(rows, lengths[at]), groups[first], n, n_docs


def _slice_counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lang, source, text = (pc.fill_null(batch.column(name), "") for name in ("lang", "source", "text"))
    lang, source = lang.dictionary_encode(), source.dictionary_encode()
    pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    by_group = np.argsort(pair, kind="stable")
    pair = pair[by_group]
    # In the order of groups, so that the documents of a term are in it as well.
    text = text.take(pa.array(by_group)).cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    if offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].copy()
    offsets = offsets - offsets[0]
    data[(data >= 0x41) & (data <= 0x5A)] += 0x20
    starts, lengths, docs = _terms(data, offsets)
    if not len(starts):
        return
    bucket = np.where(lengths <= 8, 0, np.where(lengths <= 16, 1, lengths))
    for number in np.unique(bucket):
        chosen = np.flatnonzero(bucket == number)
        terms, groups, n, n_docs = _bucket(data, starts[chosen], lengths[chosen], docs[chosen], pair)
        yield pa.RecordBatch.from_arrays(
            [
                lang.dictionary.take(pa.array(groups // len(source.dictionary))),
                source.dictionary.take(pa.array(groups % len(source.dictionary))),
                terms, pa.array(n, pa.int64()), pa.array(n_docs, pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text"):
            yield from _slice_counts(batch)

    named = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return named.mapInArrow(count, COUNTED).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + kept)), in decimals that hold the product."""
    scaled = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, F.greatest(total + kept, F.lit(1)).cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of pairs of sources for the terms that both have.

    Rows come sorted by language and term: (lang, term, source, p, p0). A batch's last
    term waits for the next batch.
    """
    names = ["lang", "source", "item", "shared"]
    sums: dict[tuple, np.ndarray] = {}

    def released() -> Iterator[pa.RecordBatch]:
        rows = [(lang, a, b, v) for (lang, a, b), v in sums.items()]
        sums.clear()
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.string(),) * 3 + (pa.int64(),))], names
            )

    def add(table: pa.Table) -> None:
        if not table.num_rows:
            return
        table = table.combine_chunks()
        lang, term = table.column("lang").combine_chunks(), table.column("term").combine_chunks()
        fresh = np.ones(table.num_rows, bool)
        fresh[1:] = pc.or_(
            pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])
        ).to_numpy(zero_copy_only=False)
        number = np.cumsum(fresh)
        coded = table.column("source").combine_chunks().dictionary_encode()
        code, places = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        langs = lang.dictionary_encode()
        lang_code = langs.indices.to_numpy().astype(np.int64)
        p, p0 = table.column("p").to_numpy(), table.column("p0").to_numpy()
        keys, values = [], []
        step = 1
        while True:
            left = np.flatnonzero(number[step:] == number[:-step]) if step < len(number) else []
            if not len(left):
                break
            right = left + step
            for i, j in ((left, right), (right, left)):
                keys.append((lang_code[i] * len(places) + code[i]) * len(places) + code[j])
                values.append(_gaps(p[i], p[j]) - _gaps(p[i], p0[j]) - _gaps(p0[i], p[j]) + _gaps(p0[i], p0[j]))
            step += 1
            if sum(map(len, keys)) > 1 << 21 or step >= len(number):
                fold(keys, values, langs.dictionary.to_pylist(), places)
                keys, values = [], []
        fold(keys, values, langs.dictionary.to_pylist(), places)

    def fold(keys, values, langs, places) -> None:
        if not keys:
            return
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, np.concatenate(values))
        size = len(places)
        for key, value in zip(found.tolist(), total.tolist()):
            name = (langs[key // size // size], places[key // size % size], places[key % size])
            sums[name] = sums.get(name, 0) + value

    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        if not table.num_rows:
            continue
        end = table.num_rows - 1
        last = pc.and_(
            pc.equal(table.column("lang"), table.column("lang")[end]),
            pc.equal(table.column("term"), table.column("term")[end]),
        )
        cut = pc.index(last, True).as_py()
        add(table.slice(0, cut))
        waiting = table.slice(cut)
        if len(sums) > HELD_PAIRS:
            yield from released()
    if waiting is not None:
        add(waiting)
    yield from released()


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS,
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: each other source of the language, by falling divergence from it.
    Part ``term``: the source's terms with a larger share there than in the language, the
    ``term_ranks`` that stand out most.
    """
    whole = lambda name: F.sum(name).cast("decimal(38,0)")
    counts = spool(count_terms(docs, text_col, lang_col, source_col), "term-counts")
    kept = (
        counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
        .where(F.col("docs") >= min_docs).drop("docs")
    )
    held = spool(counts.drop("docs").join(kept, ["lang", "term"]), "kept-terms")
    groups = docs.select(
        F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source")
    ).distinct()
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = spool(
        groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang", "source",
            *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("total", "v", "lang_total")],
        ).withColumn("p0", _share(F.lit(0).cast("long"), F.col("total"), F.col("v"))),
        "groups",
    )
    shares = spool(
        held.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0",
            _share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"),
        ),
        "shares",
    )
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        _gap(F.col("p"), F.col("q")).alias("value"),
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= term_ranks)

    shared = (
        shares.select("lang", "term", "source", "p", "p0").repartition("lang", "term")
        .sortWithinPartitions("lang", "term", "source")
        .mapInArrow(_shared_terms, "lang string, source string, item string, shared long")
        .groupBy("lang", "source", "item").agg(whole("shared").alias("shared"))
    )
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    # How many terms of a group have each share: at most one row per distinct count.
    spread = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    one_sided = spread.join(others, "lang").where("source <> item")
    times = lambda value: F.sum(value.cast("decimal(38,0)") * F.col("n").cast("decimal(18,0)"))
    own = one_sided.groupBy("lang", "source", "item").agg(
        times(_gap(F.col("p"), F.col("q0")) - _gap(F.col("p0"), F.col("q0"))).alias("own")
    )
    other = one_sided.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(
        times(_gap(F.col("q0"), F.col("p")) - _gap(F.col("q0"), F.col("p0"))).alias("other")
    )
    keys = ["lang", "source", "item"]
    parts = [F.coalesce(name, F.lit(0)).cast("decimal(38,0)") for name in ("own", "other", "shared")]
    pairs = (
        groups.join(others, "lang").where("source <> item")
        .join(own, keys, "left").join(other, keys, "left").join(shared, keys, "left")
        .select(
            "lang", "source", F.lit("pair").alias("part"), "item",
            (F.col("v").cast("decimal(18,0)") * _gap(F.col("p0"), F.col("q0")).cast("decimal(19,0)")
             + parts[0] + parts[1] + parts[2]).cast("long").alias("value"),
        )
        .withColumn("rank", F.row_number().over(by_value))
    )
    return pairs.unionByName(terms)
