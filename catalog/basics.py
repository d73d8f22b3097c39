"""Sources, projections, filters, profile, dedup, sampling and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import (
    CURATED,
    DIRTY,
    METADATA,
    PREDICTIONS,
    REVIEWS,
    SUSPECTS,
    curated,
    h,
    metadata,
    reviews,
    reviews_dirty,
    sql_digest,
    sql_h,
    sql_strip,
    suspects,
    table,
)
from catalog.registry import query
from labelwright import DOMAIN
from labelwright.contracts import RAW_REVIEW, REVIEW, first_present, with_defaults
from labelwright.functions.numeric import near_integer, round_half_even
from labelwright.functions.text import not_blank, strip_text, text_length, truncate_text
from labelwright.operators import dedup, filters, joins, position, profile, sampling
from labelwright.operators.assembly import metadata_coverage, sample_id
from labelwright.operators.confident import label_classes, label_decode, label_encode
from labelwright.operators.relabel import provenance_tag
from labelwright.plans.comparison import fixed_test_set, shortfall
from labelwright.plans.sanitize import sanitize, sanitize_funnel
from labelwright.session import scratch_path
from labelwright.sources import answers, files
from pyspark.sql.types import LongType, StructField, StructType

WITH_ID = [StructField("doc_id", LongType(), True)]


def typed(spark, sf_dir):
    return filters.project_reviews(reviews_dirty(spark, sf_dir), "doc_id")


# -- sources and sinks ---------------------------------------------------------


@query("scan_json", f"""WITH {REVIEWS} SELECT CASE WHEN b THEN NULL ELSE doc_id END AS doc_id,
  CASE WHEN b THEN NULL ELSE text END AS text, CASE WHEN b THEN NULL ELSE rating END AS rating,
  CASE WHEN b THEN NULL ELSE asin END AS asin, CASE WHEN b THEN NULL ELSE "reviewerID" END AS user_id
  FROM (SELECT *, {sql_h('b')} < 0.02 AS b FROM reviews)""")
def _(spark, sf_dir):
    """Some ratings are strings; a few lines are cut short and must come back as rows of nulls."""
    as_written = lambda rating: F.to_json(
        F.struct("doc_id", "text", rating.alias("rating"), "asin", F.col("reviewerID").alias("user_id"))
    )
    line = F.when(F.col("doc_id") % 3 == 0, as_written(F.col("rating").cast("string"))).otherwise(
        as_written(F.col("rating"))
    )
    broken = F.when(h("b") < 0.02, F.lit('{"text": "cut sho')).otherwise(line)
    path = scratch_path(spark, "json")
    reviews(spark, sf_dir).select(broken.alias("value")).write.text(path)
    lines = files.scan_json(spark, path, StructType(WITH_ID + RAW_REVIEW.fields))
    return lines.withColumn("rating", F.col("rating").try_cast("double"))


@query("scan_csv", f"WITH {DIRTY} SELECT * FROM typed")
def _(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.sink_csv(typed(spark, sf_dir), path)
    return files.scan_csv(spark, path, StructType(WITH_ID + REVIEW.fields))


@query("sink_csv", f"""WITH {REVIEWS} SELECT rating, count(*) AS n, sum(length(text))::BIGINT AS chars
  FROM reviews GROUP BY rating""")
def _(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.sink_csv(reviews(spark, sf_dir), path)
    back = files.scan_csv(spark, path, StructType(WITH_ID + REVIEW.fields))
    return back.groupBy("rating").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )


@query("report_sink", f"""WITH {REVIEWS} SELECT rating, count(*) AS n,
  round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM reviews GROUP BY rating""")
def _(spark, sf_dir):
    path = scratch_path(spark, "report")
    files.report_sink(profile.class_distribution(reviews(spark, sf_dir)), path)
    back = files.scan_csv(spark, path, "rating double, n bigint, pct double")
    return back.select("rating", "n", F.round("pct", 6).alias("pct"))


@query("checkpoint_table", f"""WITH {SUSPECTS} SELECT batch_id, count(*) AS n_rows,
  min(doc_id)::VARCHAR AS first_row FROM batched GROUP BY batch_id""")
def _(spark, sf_dir):
    """Two commits to the log, read back as one table."""
    rows = position.batch_rows(suspects(spark, sf_dir), "doc_id")
    log = rows.groupBy("batch_id").agg(
        F.transform(F.sort_array(F.collect_list("doc_id")), lambda i: i.cast("string")).alias("row_ids"),
        F.lit("[]").alias("raw"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"),
    )
    path = scratch_path(spark, "answers")
    answers.append_answers(log.filter("batch_id % 2 = 0"), path)
    answers.append_answers(log.filter("batch_id % 2 = 1"), path)
    return answers.read_answers(spark, path).select(
        "batch_id", F.size("row_ids").cast("bigint").alias("n_rows"), F.col("row_ids")[0].alias("first_row")
    )


@query("schema_contract", """SELECT doc_id, text AS body, 'unknown' AS origin, lang FROM documents""")
def _(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    full = with_defaults(documents, {"origin": F.lit("unknown"), "lang": F.lit("xx")})
    return full.select("doc_id", first_present(full, ["body", "text"]).alias("body"), "origin", "lang")


# -- projections and scalar functions ------------------------------------------


@query("project_reviews", f"WITH {DIRTY} SELECT * FROM typed")
def _(spark, sf_dir):
    return typed(spark, sf_dir)


@query("strip_text", f"WITH {DIRTY} SELECT doc_id, {sql_strip('text')} AS text FROM typed")
def _(spark, sf_dir):
    return typed(spark, sf_dir).select("doc_id", strip_text(F.col("text")).alias("text"))


@query("blank_test", f"WITH {DIRTY} SELECT doc_id, trim(text) <> '' AS filled FROM typed")
def _(spark, sf_dir):
    return typed(spark, sf_dir).select("doc_id", not_blank(F.col("text")).alias("filled"))


@query("text_length", f"WITH {DIRTY} SELECT doc_id, length(text)::INT AS n_chars FROM typed")
def _(spark, sf_dir):
    return typed(spark, sf_dir).select("doc_id", text_length(F.col("text")).alias("n_chars"))


@query("truncate_text", f"""WITH {DIRTY} SELECT doc_id, substring(text, 1, 500) AS t500,
  substring(text, 1, 80) AS t80, substring(text, 1, 60) AS t60 FROM typed""")
def _(spark, sf_dir):
    text = F.col("text")
    return typed(spark, sf_dir).select(
        "doc_id", *[truncate_text(text, n).alias(f"t{n}") for n in (500, 80, 60)]
    )


@query("round_half_even", f"WITH {REVIEWS} SELECT doc_id, round_even(rating / 2, 0)::DOUBLE AS rounded FROM reviews")
def _(spark, sf_dir):
    return reviews(spark, sf_dir).select("doc_id", round_half_even(F.col("rating") / 2).alias("rounded"))


@query("metric_round", f"""WITH {REVIEWS} SELECT rating, round(avg(length(text)), 2) AS mean_chars,
  round(count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share FROM reviews GROUP BY rating""")
def _(spark, sf_dir):
    counts = reviews(spark, sf_dir).groupBy("rating").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean_chars")
    )
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(
        "rating", F.round("mean_chars", 2).alias("mean_chars"), F.round(F.col("n") / total, 4).alias("share")
    )


@query("near_integer", f"""WITH {DIRTY} SELECT doc_id, CASE WHEN rating = 'NaN' THEN FALSE
  ELSE TRY_CAST(rating AS DOUBLE) = round_even(TRY_CAST(rating AS DOUBLE), 0) END AS whole FROM dirty""")
def _(spark, sf_dir):
    rating = F.col("rating").try_cast("double")
    return reviews_dirty(spark, sf_dir).select("doc_id", near_integer(rating).alias("whole"))


@query("column_fallback", f"""WITH {SUSPECTS} SELECT doc_id, coalesce(nullif(suggested_rating, 3), rating) AS hint
  FROM suspects""")
def _(spark, sf_dir):
    hint = F.nullif(F.col("suggested_rating"), F.lit(3.0))
    return suspects(spark, sf_dir).select("doc_id", F.coalesce(hint, "rating").alias("hint"))


@query("label_encode", f"""WITH {REVIEWS} SELECT doc_id,
  (dense_rank() OVER (ORDER BY rating) - 1)::INT AS label_index FROM reviews""")
def _(spark, sf_dir):
    rows = reviews(spark, sf_dir)
    return rows.select("doc_id", label_encode(label_classes(rows), F.col("rating")).alias("label_index"))


@query("label_decode", f"WITH {REVIEWS} SELECT doc_id, rating AS label FROM reviews")
def _(spark, sf_dir):
    rows = reviews(spark, sf_dir)
    classes = label_classes(rows)
    index = label_encode(classes, F.col("rating"))
    return rows.select("doc_id", label_decode(classes, index).alias("label"))


@query("provenance_tag", f"""WITH {REVIEWS} SELECT doc_id,
  CASE WHEN {sql_h('k')} < 0.3 THEN 'corrected' ELSE 'verified' END AS source FROM reviews""")
def _(spark, sf_dir):
    return reviews(spark, sf_dir).select("doc_id", provenance_tag(h("k") < 0.3).alias("source"))


@query("sample_id", f"""WITH {REVIEWS} SELECT doc_id, printf('GOLD_%06d',
  row_number() OVER (ORDER BY {sql_digest('position')}, doc_id) - 1) AS sample_id FROM reviews""")
def _(spark, sf_dir):
    placed = position.seeded_position(reviews(spark, sf_dir), "doc_id", "position")
    return placed.select("doc_id", sample_id(F.col("position")).alias("sample_id"))


@query("cast_text_rating", f"""WITH {DIRTY} SELECT doc_id, text, rating FROM typed
  WHERE text IS NOT NULL AND rating IS NOT NULL""")
def _(spark, sf_dir):
    """A CSV of strings read with a typed schema."""
    path = scratch_path(spark, "csv")
    files.sink_csv(reviews_dirty(spark, sf_dir).select("doc_id", "text", "rating"), path)
    back = files.scan_csv(spark, path, "doc_id bigint, text string, rating double")
    # NaN is missing too.
    return filters.drop_missing(back, "text", "rating")


@query("drop_column", f"WITH {CURATED} SELECT doc_id, text, rating FROM curated")
def _(spark, sf_dir):
    return curated(spark, sf_dir).drop("source")


# -- filters -------------------------------------------------------------------


@query("structural_filter", f"""WITH {DIRTY} SELECT * FROM typed WHERE text IS NOT NULL AND trim(text) <> ''
  AND length(text) >= 10 AND rating IS NOT NULL AND rating IN (1, 2, 3, 4, 5)""")
def _(spark, sf_dir):
    return filters.structural_filter(typed(spark, sf_dir))


@query("drop_missing", f"WITH {DIRTY} SELECT * FROM typed WHERE text IS NOT NULL AND rating IS NOT NULL")
def _(spark, sf_dir):
    return filters.drop_missing(typed(spark, sf_dir), "text", "rating")


@query("min_length", f"""WITH {DIRTY} SELECT doc_id, {sql_strip('text')} AS text FROM typed
  WHERE length({sql_strip('text')}) >= 10""")
def _(spark, sf_dir):
    return filters.min_length(typed(spark, sf_dir)).select("doc_id", "text")


SQL_VALID = """NOT isnan(rating) AND abs(rating - round_even(rating, 0)) < 1e-9
  AND round_even(rating, 0) IN (1, 2, 3, 4, 5)"""


@query("valid_rating", f"WITH {DIRTY} SELECT doc_id, round_even(rating, 0)::DOUBLE AS rating FROM typed WHERE {SQL_VALID}")
def _(spark, sf_dir):
    return filters.keep_valid_labels(typed(spark, sf_dir), overwrite=True).select("doc_id", "rating")


@query("split_by_flag", f"""WITH {REVIEWS} SELECT doc_id, CASE WHEN {sql_h('g')} < 0.2 THEN 'noisy'
  ELSE 'clean' END AS side FROM reviews""")
def _(spark, sf_dir):
    rows = reviews(spark, sf_dir).select("doc_id", (h("g") < 0.2).alias("flag"))
    noisy, clean = filters.split_by_flag(rows, "flag")
    return noisy.select("doc_id", F.lit("noisy").alias("side")).unionByName(
        clean.select("doc_id", F.lit("clean").alias("side"))
    )


@query("filter_funnel", f"""WITH {DIRTY}, steps AS (
  SELECT 0 AS step, 'raw' AS stage, count(*) AS kept FROM typed
  UNION ALL SELECT 1, 'text_present', count(*) FROM typed WHERE text IS NOT NULL
  UNION ALL SELECT 2, 'text_not_blank', count(*) FROM typed WHERE trim(text) <> ''
  UNION ALL SELECT 3, 'text_long_enough', count(*) FROM typed WHERE trim(text) <> '' AND length(text) >= 10
  UNION ALL SELECT 4, 'label_present', count(*) FROM typed
    WHERE trim(text) <> '' AND length(text) >= 10 AND rating IS NOT NULL
  UNION ALL SELECT 5, 'label_in_domain', count(*) FROM typed
    WHERE trim(text) <> '' AND length(text) >= 10 AND rating IN (1, 2, 3, 4, 5))
  SELECT step, stage, kept, coalesce(lag(kept) OVER (ORDER BY step) - kept, 0) AS dropped,
    round(100.0::DOUBLE * kept / max(kept) OVER (), 6) AS pct_of_raw FROM steps""")
def _(spark, sf_dir):
    return filters.filter_funnel(typed(spark, sf_dir), filters.structural_stages()).withColumn(
        "pct_of_raw", F.round("pct_of_raw", 6)
    )


@query("sanitize", f"""WITH {DIRTY}, firsts AS (SELECT * FROM typed
    QUALIFY row_number() OVER (PARTITION BY text, rating ORDER BY doc_id) = 1)
  SELECT doc_id, {sql_strip('text')} AS text, rating FROM firsts WHERE length({sql_strip('text')}) >= 10""")
def _(spark, sf_dir):
    return sanitize(typed(spark, sf_dir), "doc_id").select("doc_id", "text", "rating")


@query("sanitize_funnel", f"""WITH {DIRTY}, firsts AS (SELECT * FROM typed
    QUALIFY row_number() OVER (PARTITION BY text, rating ORDER BY doc_id) = 1),
  n AS (SELECT (SELECT count(*) FROM typed) AS n0, (SELECT count(*) FROM firsts) AS n1,
    (SELECT count(*) FROM firsts WHERE length({sql_strip('text')}) >= 10) AS n2)
  SELECT 0 AS step, 'raw' AS stage, n0 AS kept, 0::BIGINT AS dropped, 100::DOUBLE AS pct_of_raw FROM n
  UNION ALL SELECT 1, 'unique_text_label', n1, n0 - n1, round(100::DOUBLE * n1 / n0, 6) FROM n
  UNION ALL SELECT 2, 'text_long_enough', n2, n1 - n2, round(100::DOUBLE * n2 / n0, 6) FROM n""")
def _(spark, sf_dir):
    return sanitize_funnel(typed(spark, sf_dir), "doc_id").withColumn("pct_of_raw", F.round("pct_of_raw", 6))


# -- joins -----------------------------------------------------------------------


@query("metadata_enrich", f"""WITH {REVIEWS}, {METADATA}
  SELECT r.doc_id, r.text, r.rating, l.asin, l.title, l.brand, l.price, l.main_category
  FROM reviews r LEFT JOIN lookup l ON r.text = l.text""")
def _(spark, sf_dir):
    rows = reviews(spark, sf_dir).select("doc_id", "text", "rating")
    return joins.metadata_enrich(rows, metadata(spark, sf_dir), "doc_id", "meta_id")


@query("leakage_anti", f"""WITH {REVIEWS} SELECT doc_id, rating FROM reviews r WHERE NOT EXISTS
  (SELECT 1 FROM reviews t WHERE t.text = r.text AND t.doc_id % 7 = 0)""")
def _(spark, sf_dir):
    rows = reviews(spark, sf_dir)
    test = rows.filter("doc_id % 7 = 0").select("text", "rating")
    return joins.remove_leakage(rows, test, "doc_id").select("doc_id", "rating")


@query("leakage_anti_large", f"""WITH {REVIEWS} SELECT doc_id, rating FROM reviews r WHERE NOT EXISTS
  (SELECT 1 FROM reviews t WHERE t.text = r.text AND t.doc_id % 7 = 0)""")
def _(spark, sf_dir):
    """The same with a filter that lets every row through to the exact join."""
    rows = reviews(spark, sf_dir)
    test = rows.filter("doc_id % 7 = 0").select("text", "rating")
    return joins.remove_leakage(rows, test, "doc_id", buckets=1).select("doc_id", "rating")


@query("resume_anti", f"WITH {SUSPECTS} SELECT doc_id, text FROM suspects WHERE {sql_h('a')} >= 0.37")
def _(spark, sf_dir):
    rows = suspects(spark, sf_dir).select("doc_id", "text")
    return joins.resume_anti(rows, rows.filter(h("a") < 0.37), "doc_id")


@query("flag_join", f"""WITH {REVIEWS} SELECT doc_id, rating, {sql_h('g')} < 0.2 AS flagged FROM reviews""")
def _(spark, sf_dir):
    rows = reviews(spark, sf_dir).select("doc_id", "rating")
    flags = rows.filter(h("g") < 0.2).select("doc_id", F.lit(True).alias("flagged"))
    return joins.flag_join(rows, flags, "doc_id", "flagged")


# -- profile -----------------------------------------------------------------------


@query("row_count", """SELECT count(*) AS n_rows, 5::INT AS n_cols,
  'doc_id,text,lang,source,n_chars' AS columns FROM documents""")
def _(spark, sf_dir):
    return profile.table_shape(table(spark, sf_dir, "documents"))


@query("class_distribution", f"""WITH {DIRTY} SELECT rating, count(*) AS n,
  round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM typed), 6) AS pct
  FROM typed WHERE rating IS NOT NULL GROUP BY rating""")
def _(spark, sf_dir):
    return profile.class_distribution(typed(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


@query("missing_profile", f"""WITH {DIRTY}, n AS (SELECT count(*) AS n, count(*) - count(text) AS t,
    count(*) - count(rating) AS r FROM typed)
  SELECT 'text' AS "column", t AS n_missing, round(100.0::DOUBLE * t / n, 6) AS pct_missing FROM n
  UNION ALL SELECT 'rating', r, round(100.0::DOUBLE * r / n, 6) FROM n
  UNION ALL SELECT 'asin', 0, 0 FROM n""")
def _(spark, sf_dir):
    return profile.missing_profile(typed(spark, sf_dir), ["text", "rating", "asin"]).withColumn(
        "pct_missing", F.round("pct_missing", 6)
    )


SQL_LENGTHS = """round(avg(length(text)), 6) AS mean_chars,
  quantile_cont(length(text), 0.5)::DOUBLE AS median_chars, min(length(text))::INT AS min_chars,
  max(length(text))::INT AS max_chars, round(quantile_cont(length(text), 0.05), 6)::DOUBLE AS p5_chars,
  round(quantile_cont(length(text), 0.95), 6)::DOUBLE AS p95_chars"""


@query("text_length_stats", f"WITH {DIRTY} SELECT {SQL_LENGTHS} FROM typed")
def _(spark, sf_dir):
    stats = profile.text_length_stats(typed(spark, sf_dir))
    return stats.select(
        *[F.round(name, 6).alias(name) if name[0] == "p" or name == "mean_chars" else F.col(name)
          for name in stats.columns]
    )


SQL_DUPLICATES = """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, rating FROM typed)) AS dup_text_label,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM typed)) AS dup_text,
  (SELECT count(*) FROM (SELECT text FROM typed WHERE text IS NOT NULL GROUP BY text
    HAVING count(DISTINCT rating) > 1)) AS conflict_texts,
  (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM typed WHERE text IS NOT NULL GROUP BY text
    HAVING count(DISTINCT rating) > 1)) AS conflict_rows FROM typed"""


@query("duplicate_profile", f"WITH {DIRTY} {SQL_DUPLICATES}")
def _(spark, sf_dir):
    return profile.duplicate_profile(typed(spark, sf_dir))


@query("label_conflicts", f"""WITH {DIRTY} SELECT sha256(text) AS text_key, count(*) AS n_rows,
  count(DISTINCT rating) AS n_labels FROM typed WHERE text IS NOT NULL AND rating IS NOT NULL
  GROUP BY text HAVING count(DISTINCT rating) > 1""")
def _(spark, sf_dir):
    return profile.label_conflicts(typed(spark, sf_dir))


SQL_IMBALANCE = """n AS (SELECT rating, count(*) AS n FROM reviews GROUP BY rating)
  SELECT (SELECT rating FROM n ORDER BY n DESC, rating LIMIT 1) AS majority,
    (SELECT rating FROM n ORDER BY n, rating LIMIT 1) AS minority,
    round(max(n)::DOUBLE / min(n), 6) AS imbalance_ratio FROM n"""


@query("imbalance_ratio", f"WITH {REVIEWS}, {SQL_IMBALANCE}")
def _(spark, sf_dir):
    return profile.imbalance(reviews(spark, sf_dir)).withColumn(
        "imbalance_ratio", F.round("imbalance_ratio", 6)
    )


@query("majority_minority", """WITH n AS (SELECT lang, length(lang) AS k, count(*) AS n FROM documents GROUP BY ALL),
  s AS (SELECT CASE WHEN lang = 'en' THEN 1 WHEN lang = 'fr' THEN 2 WHEN lang = 'de' THEN 3 ELSE 4 END AS c,
    sum(n)::BIGINT AS n FROM n GROUP BY ALL)
  SELECT (SELECT c FROM s ORDER BY n DESC, c LIMIT 1) AS majority,
    (SELECT c FROM s ORDER BY n, c LIMIT 1) AS minority FROM (SELECT 1)""")
def _(spark, sf_dir):
    code = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).when(
        F.col("lang") == "de", 3
    ).otherwise(4)
    rows = table(spark, sf_dir, "documents").select(code.alias("rating"))
    return profile.imbalance(rows).select("majority", "minority")


@query("profile", f"""WITH {DIRTY}, total AS (SELECT count(*) AS n FROM typed),
  classes AS (SELECT rating, count(*) AS n FROM typed WHERE rating IS NOT NULL GROUP BY rating),
  lengths AS (SELECT {SQL_LENGTHS} FROM typed), dups AS ({SQL_DUPLICATES}),
  label AS (SELECT CASE WHEN isnan(rating) THEN 'NaN' ELSE rating::VARCHAR END AS k, n FROM classes)
  SELECT 'n_rows' AS metric, '' AS key, n::DOUBLE AS value FROM total
  UNION ALL SELECT 'n_cols', '', 3 FROM total
  UNION ALL SELECT 'missing', 'doc_id', 0 FROM total
  UNION ALL SELECT 'missing', 'text', count(*) - count(text) FROM typed
  UNION ALL SELECT 'missing', 'rating', count(*) - count(rating) FROM typed
  UNION ALL SELECT 'missing_pct', 'doc_id', 0 FROM total
  UNION ALL SELECT 'missing_pct', 'text', round(100.0::DOUBLE * (count(*) - count(text)) / count(*), 6) FROM typed
  UNION ALL SELECT 'missing_pct', 'rating', round(100.0::DOUBLE * (count(*) - count(rating)) / count(*), 6) FROM typed
  UNION ALL SELECT 'class_count', k, n FROM label
  UNION ALL SELECT 'class_pct', k, round(100.0::DOUBLE * label.n / total.n, 6) FROM label, total
  UNION ALL SELECT u.metric, '', u.value FROM (SELECT mean_chars, median_chars, min_chars::DOUBLE AS min_chars,
      max_chars::DOUBLE AS max_chars, p5_chars, p95_chars FROM lengths)
    UNPIVOT (value FOR metric IN (mean_chars, median_chars, min_chars, max_chars, p5_chars, p95_chars)) u
  UNION ALL SELECT u.metric, '', u.value::DOUBLE FROM (SELECT * FROM dups)
    UNPIVOT (value FOR metric IN (dup_text_label, dup_text, conflict_texts, conflict_rows)) u
  UNION ALL SELECT 'majority', '', rating FROM (SELECT rating FROM classes ORDER BY n DESC, rating LIMIT 1)
  UNION ALL SELECT 'minority', '', rating FROM (SELECT rating FROM classes ORDER BY n, rating LIMIT 1)
  UNION ALL SELECT 'imbalance_ratio', '', round(max(n)::DOUBLE / min(n), 6) FROM classes""")
def _(spark, sf_dir):
    rows = typed(spark, sf_dir).select("doc_id", "text", "rating")
    return profile.profile_dataset(rows).withColumn("value", F.round("value", 6))


# -- dedup and set operations ----------------------------------------------------


@query("row_id", """SELECT md5(d.k)||'-'||row_number() OVER (PARTITION BY d.k) AS row_id, text, lang
  FROM (SELECT text, lang, coalesce('V'||length(text)||':'||text, 'N')||
    coalesce('V'||length(lang)||':'||lang, 'N') AS k FROM documents) d""")
def _(spark, sf_dir):
    return dedup.assign_row_id(table(spark, sf_dir, "documents").select("text", "lang"))


@query("dedup_text_label", f"""WITH {DIRTY} SELECT * FROM typed
  QUALIFY row_number() OVER (PARTITION BY text, rating ORDER BY doc_id) = 1""")
def _(spark, sf_dir):
    return dedup.dedup_text_label(typed(spark, sf_dir), "doc_id")


@query("dedup_after_strip", f"""WITH {DIRTY} SELECT doc_id, {sql_strip('text')} AS text, rating FROM typed
  QUALIFY row_number() OVER (PARTITION BY {sql_strip('text')}, rating ORDER BY doc_id) = 1""")
def _(spark, sf_dir):
    return dedup.dedup_text_label(typed(spark, sf_dir), "doc_id", after_strip=True).select(
        "doc_id", "text", "rating"
    )


@query("dedup_text", f"""WITH {REVIEWS} SELECT * FROM reviews
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def _(spark, sf_dir):
    return dedup.dedup_text(reviews(spark, sf_dir), "doc_id")


# -- sampling, order and position ------------------------------------------------


@query("stratified_sample", f"""WITH {REVIEWS} SELECT * FROM reviews WHERE {sql_h('42')} <
  CASE WHEN rating = 1 THEN 0.5 ELSE 0.1 END""")
def _(spark, sf_dir):
    shares = {value: 0.1 for value in DOMAIN} | {1.0: 0.5}
    return sampling.stratified_sample(reviews(spark, sf_dir), shares, "doc_id")


def _sql_capped(cap: int) -> str:
    return f"""SELECT * FROM reviews QUALIFY row_number() OVER
      (PARTITION BY rating ORDER BY {sql_digest('42')}, doc_id) <= {cap}"""


@query("cap_per_class", f"WITH {REVIEWS} {_sql_capped(60)}")
def _(spark, sf_dir):
    return sampling.cap_per_class(reviews(spark, sf_dir), 60, "doc_id")


@query("fixed_test_set", f"""WITH {REVIEWS}, capped AS ({_sql_capped(90)}),
  firsts AS (SELECT doc_id, text, rating FROM capped
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)
  SELECT *, row_number() OVER (ORDER BY {sql_digest('42')}, doc_id) - 1 AS position FROM firsts""")
def _(spark, sf_dir):
    test = fixed_test_set(reviews(spark, sf_dir), "doc_id", per_class=90, shuffle=False)
    return position.seeded_position(test, "doc_id")


@query("test_set_shortfall", f"""WITH {REVIEWS} SELECT rating, count(*) AS available,
  greatest(200 - count(*), 0)::BIGINT AS short_by FROM reviews GROUP BY rating""")
def _(spark, sf_dir):
    return shortfall(reviews(spark, sf_dir))


@query("matched_stratified", f"""WITH {REVIEWS}, target AS (
    SELECT rating, count(*) AS n FROM reviews WHERE {sql_h('m')} < 0.3 AND rating <> 2 GROUP BY rating)
  SELECT r.* FROM reviews r JOIN target t ON r.rating = t.rating QUALIFY row_number() OVER
    (PARTITION BY r.rating ORDER BY {sql_digest('42', 'r.doc_id')}, r.doc_id) <= max(t.n) OVER (PARTITION BY r.rating)""")
def _(spark, sf_dir):
    rows = reviews(spark, sf_dir)
    return sampling.matched_stratified(rows, rows.filter((h("m") < 0.3) & (F.col("rating") != 2)), "doc_id")


@query("shuffle_rows", f"""WITH {REVIEWS} SELECT doc_id, rating,
  row_number() OVER (ORDER BY {sql_digest('7')}, doc_id) - 1 AS place FROM reviews""")
def _(spark, sf_dir):
    """The place of each row in the shuffled table, as it comes out of the sort."""
    rows = reviews(spark, sf_dir).select("doc_id", "rating")
    return position.numbered(position.shuffle_rows(rows, "doc_id", "7"), "place")


@query("row_position", f"""WITH {REVIEWS} SELECT doc_id,
  row_number() OVER (ORDER BY {sql_digest('42')}, doc_id) - 1 AS position,
  row_number() OVER (PARTITION BY rating ORDER BY {sql_digest('42')}, doc_id) - 1 AS class_position
  FROM reviews""")
def _(spark, sf_dir):
    rows = reviews(spark, sf_dir).select("doc_id", "rating")
    placed = position.seeded_position(rows, "doc_id")
    return position.seeded_position(placed, "doc_id", out="class_position", group_cols=["rating"]).drop("rating")


@query("ordered_position", f"""SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS position,
  FROM documents""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return position.ordered_position(rows, [F.desc("n_chars"), "doc_id"]).drop("n_chars")


@query("sample_n", f"WITH {REVIEWS} SELECT * FROM reviews ORDER BY {sql_digest('42')}, doc_id LIMIT 300")
def _(spark, sf_dir):
    return sampling.sample_n(reviews(spark, sf_dir), 300, "doc_id")


@query("sort_by_class", f"""WITH {REVIEWS} SELECT rating, count(*) AS n,
  row_number() OVER (ORDER BY rating) - 1 AS place FROM reviews GROUP BY rating""")
def _(spark, sf_dir):
    return position.ordered_position(profile.class_counts(reviews(spark, sf_dir)), ["rating"], "place")


@query("batch_rows", f"WITH {SUSPECTS} SELECT doc_id, batch_id, item_no FROM batched")
def _(spark, sf_dir):
    return position.batch_rows(suspects(spark, sf_dir), "doc_id").select("doc_id", "batch_id", "item_no")


# -- provenance figures ------------------------------------------------------------


@query("metadata_coverage", f"""WITH {REVIEWS}, {METADATA}, m AS (
    SELECT r.doc_id, l.asin, l.title FROM reviews r LEFT JOIN lookup l ON r.text = l.text)
  SELECT count(*) AS n_rows, count(asin) AS matched, round(100.0::DOUBLE * count(asin) / count(*), 6) AS matched_pct,
    count(title) AS with_title, count(*) - count(title) AS without_title FROM m""")
def _(spark, sf_dir):
    rows = reviews(spark, sf_dir).select("doc_id", "text")
    enriched = joins.metadata_enrich(rows, metadata(spark, sf_dir), "doc_id", "meta_id")
    return metadata_coverage(enriched).withColumn("matched_pct", F.round("matched_pct", 6))
