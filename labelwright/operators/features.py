"""Terms, vocabulary and TF-IDF weights as tables.

A document is repartitioned by id, into parts of bounded text. Its term counts, and later
its norm, then need no other shuffle. The vocabulary of a large table is found in two
steps, so that no task groups all terms: occurrences are added up in ``BUCKETS`` buckets of
terms, and only terms of buckets that can reach the vocabulary are grouped by term. Until
then a term is its one or two tokens: pairs of the many other buckets become no strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from labelwright.functions.text import ngrams, tokenize
from labelwright.session import spool

MAX_FEATURES = 10_000
MIN_DOCS = 2
#: Bytes of text whose terms one task counts.
PART_BYTES = 8 << 20
#: Up to this much text all terms are grouped at once.
WHOLE_BYTES = 64 << 20
BUCKETS = 1 << 20


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).collect()[0].n


def _in_parts(placed: DataFrame, id_col: str, n_bytes: int) -> DataFrame:
    """Documents by id, in parts of some ``PART_BYTES`` of text."""
    parts = -(-n_bytes // PART_BYTES)
    # A given number of parts is kept; without one, small tables get fewer tasks.
    if parts > placed.sparkSession.sparkContext.defaultParallelism:
        return placed.repartition(parts, id_col)
    return placed.repartition(id_col)


def term_counts(
    df: DataFrame, id_col: str, text_col: str = "text", n_max: int = 1, n_bytes: int | None = None
) -> DataFrame:
    """(id, term, tf) for every term of every document. ``n_bytes``: the size of the texts, if it is known."""
    placed = _in_parts(df.select(id_col, text_col), id_col, text_bytes(df, text_col) if n_bytes is None else n_bytes)
    tokens = placed.withColumn("_tokens", tokenize(F.col(text_col))).drop(text_col)
    # explode would also put a filter on the token count below the shuffle, which
    # tokenises every text a second time; explode_outer does not.
    return (
        tokens.select(id_col, F.explode_outer(ngrams(F.col("_tokens"), n_max)).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy(id_col, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def occurrences(df: DataFrame, text_col: str, n_max: int) -> DataFrame:
    """The other columns with ``_first`` and ``_second``, the tokens of each term, and the term's ``bucket``."""
    others = [name for name in df.columns if name != text_col]
    tokens = df.select(*others, tokenize(F.col(text_col)).alias("_tokens"))
    if n_max == 1:
        rows = tokens.select(*others, F.explode_outer("_tokens").alias("_first")).withColumn(
            "_second", F.lit(None).cast("string")
        )
    elif n_max == 2:
        after = F.slice("_tokens", 2, F.greatest(F.size("_tokens") - 1, F.lit(0)))
        zipped = F.arrays_zip(F.col("_tokens").alias("first"), after.alias("second"))
        # Each token alone, and with the next one if there is one.
        rows = (
            tokens.select(*others, F.explode_outer(zipped).alias("_at"))
            .select(*others, F.col("_at.first").alias("_first"), F.col("_at.second").alias("_next"),
                    F.explode(F.array(F.lit(1), F.lit(2))).alias("_length"))
            .filter((F.col("_length") == 1) | F.col("_next").isNotNull())
            .select(*others, "_first", F.when(F.col("_length") == 2, F.col("_next")).alias("_second"))
        )
    else:
        raise ValueError("n_max must be 1 or 2")
    bucket = F.pmod(F.xxhash64("_first", "_second"), F.lit(BUCKETS))
    return rows.filter(F.col("_first").isNotNull()).withColumn("bucket", bucket)


def vocabulary(
    terms: DataFrame, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(term, total, df): terms in enough documents, the most frequent first.

    Ties in the total count go to the alphabetically first term.
    """
    return (
        terms.groupBy("term")
        .agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
        .filter(F.col("df") >= min_docs)
        .orderBy(F.desc("total"), "term")
        .limit(max_features)
    )


def corpus_vocabulary(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    n_max: int = 1,
    max_features: int = MAX_FEATURES,
    min_docs: int = MIN_DOCS,
    n_bytes: int | None = None,
) -> DataFrame:
    """``vocabulary`` of a table's texts; a large table groups only terms that can be in it.

    A term occurs no more often than its bucket. Terms of the fullest buckets are counted
    first. If ``max_features`` of them reach what the fullest bucket left out holds, no other
    term can be among them; else their last total is a bound that the buckets of a second
    and last count must reach.
    """
    n_bytes = text_bytes(df, text_col) if n_bytes is None else n_bytes
    if n_bytes <= WHOLE_BYTES:
        return vocabulary(term_counts(df, id_col, text_col, n_max, n_bytes), max_features, min_docs)
    # Occurrences need no documents, so the texts are not shuffled.
    sizes = spool(
        occurrences(df.select(text_col), text_col, n_max).groupBy("bucket").agg(F.count(F.lit(1)).alias("size")),
        "buckets",
    )
    found = occurrences(_in_parts(df.select(id_col, text_col), id_col, n_bytes), text_col, n_max)

    def counted(least: int) -> DataFrame:
        """The vocabulary of the terms in buckets of ``least`` occurrences."""
        chosen = F.broadcast(sizes.filter(F.col("size") >= least).select("bucket"))
        possible = (
            found.join(chosen, "bucket", "left_semi")
            .select(id_col, F.concat_ws(" ", "_first", "_second").alias("term"))
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
        )
        return spool(vocabulary(possible, max_features, min_docs), "vocabulary").orderBy(F.desc("total"), "term")

    fullest = sizes.select("size").orderBy(F.desc("size")).limit(2 * max_features)
    least = fullest.agg(F.coalesce(F.min("size"), F.lit(0)).alias("n")).collect()[0].n
    words = counted(least)
    size = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("total"), F.lit(0)).alias("least")).collect()[0]
    reached = size.least if size.n == max_features else 0
    return words if reached >= least else counted(reached)


def smoothed_idf(df_col, n_docs):
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df_col)) + F.lit(1.0)


def tfidf(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    n_max: int = 1,
    max_features: int = MAX_FEATURES,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """(id, term, weight): (1 + ln tf) * smoothed idf, unit length per document.

    The vocabulary is broadcast: ``max_features`` bounds it.
    """
    n_bytes = text_bytes(df, text_col)
    terms = term_counts(df, id_col, text_col, n_max, n_bytes)
    words = corpus_vocabulary(df, id_col, text_col, n_max, max_features, min_docs, n_bytes)
    n_docs = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    raw = (
        terms.join(F.broadcast(words.select("term", "df")), "term")
        .withColumn(
            "_raw", (F.lit(1.0) + F.log(F.col("tf"))) * smoothed_idf(F.col("df"), n_docs)
        )
        .select(id_col, "term", "_raw")
    )
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("_raw") / norm).alias("weight"))
