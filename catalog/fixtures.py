"""Input tables that every query starts from, derived from the given tables.

Each exists twice: as a DataFrame and as a SQL common table expression, so
that a query and its oracle share nothing but the rule. ``h(seed)`` is the
seeded hash of doc_id in [0, 1); see FIXTURES.md.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelwright.functions.hashing import seeded_digest, unit_interval
from labelwright.operators.relabel import build_requests

CLASSES = (1.0, 2.0, 3.0, 4.0, 5.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def h(seed: str, row_id: str = "doc_id") -> Column:
    return unit_interval(seeded_digest(F.col(row_id), seed))


def sql_h(seed: str, row_id: str = "doc_id") -> str:
    return f"(('0x'||substr(md5('{seed}:'||{row_id}),1,8))::BIGINT::DOUBLE/4294967296)"


def sql_digest(seed: str, row_id: str = "doc_id") -> str:
    return f"md5('{seed}:'||{row_id})"


def _ladder(value: Column, steps, otherwise) -> Column:
    chain = None
    for limit, result in steps:
        chain = F.when(value < limit, result) if chain is None else chain.when(value < limit, result)
    return chain.otherwise(otherwise)


# -- reviews: documents with a rating ----------------------------------------

_RATING_STEPS = [(0.60, 5.0), (0.80, 4.0), (0.90, 3.0), (0.96, 2.0)]


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = _ladder(h("r"), [(limit, F.lit(value)) for limit, value in _RATING_STEPS], F.lit(1.0))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        rating.alias("rating"),
        F.concat(F.lit("A"), (F.col("doc_id") % 50).cast("string")).alias("asin"),
        F.concat(F.lit("U"), (F.col("doc_id") % 97).cast("string")).alias("reviewerID"),
    )


REVIEWS = f"""reviews AS (
  SELECT doc_id, text,
    (CASE WHEN h < 0.60 THEN 5 WHEN h < 0.80 THEN 4 WHEN h < 0.90 THEN 3
          WHEN h < 0.96 THEN 2 ELSE 1 END)::DOUBLE AS rating,
    'A'||(doc_id % 50) AS asin, 'U'||(doc_id % 97) AS "reviewerID"
  FROM (SELECT *, {sql_h('r')} AS h FROM documents))"""


# -- reviews_dirty: string ratings, missing, blank and padded texts ------------

def reviews_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    dirty_text = _ladder(
        h("t"),
        [
            (0.03, F.lit(None).cast("string")),
            (0.06, F.lit("   ")),
            (0.09, F.concat(F.lit("\u00a0"), text, F.lit("\u00a0"))),
            (0.12, F.concat(F.lit("\n\t"), text, F.lit(" \u2003"))),
            (0.14, F.lit("  short   \t")),
        ],
        text,
    )
    rating = F.format_string("%d.0", F.col("rating").cast("int"))
    dirty_rating = _ladder(
        h("d"),
        [
            (0.02, F.lit(None).cast("string")),
            (0.04, F.lit("0.0")),
            (0.06, F.lit("7")),
            (0.08, F.lit("abc")),
            (0.10, F.lit("2.5")),
            (0.12, F.lit("NaN")),
        ],
        rating,
    )
    return reviews(spark, sf_dir).select(
        "doc_id",
        dirty_text.alias("text"),
        dirty_rating.alias("rating"),
        "asin",
        F.col("reviewerID").alias("user_id"),
    )


DIRTY = f"""{REVIEWS}, dirty AS (
  SELECT doc_id,
    CASE WHEN t < 0.03 THEN NULL WHEN t < 0.06 THEN '   '
         WHEN t < 0.09 THEN chr(160)||text||chr(160)
         WHEN t < 0.12 THEN chr(10)||chr(9)||text||' '||chr(8195)
         WHEN t < 0.14 THEN '  short   '||chr(9) ELSE text END AS text,
    CASE WHEN d < 0.02 THEN NULL WHEN d < 0.04 THEN '0.0' WHEN d < 0.06 THEN '7'
         WHEN d < 0.08 THEN 'abc' WHEN d < 0.10 THEN '2.5' WHEN d < 0.12 THEN 'NaN'
         ELSE rating::INT||'.0' END AS rating,
    asin, "reviewerID" AS user_id
  FROM (SELECT *, {sql_h('t')} AS t, {sql_h('d')} AS d FROM reviews)),
  typed AS (SELECT doc_id, text, TRY_CAST(nullif(rating, 'NaN') AS DOUBLE) AS rating, asin,
    user_id AS "reviewerID" FROM dirty)"""

# The 29 characters Python's str.strip() removes, for DuckDB's trim(text, chars).
SQL_WHITESPACE = "||".join(
    f"chr({code})"
    for code in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203),
                 8232, 8233, 8239, 8287, 12288]
)


def sql_strip(text: str) -> str:
    return f"trim({text}, {SQL_WHITESPACE})"


# -- labelled: documents with the given 0/1 quality label ----------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "text", F.col("quality").cast("double").alias("rating")
    )


LABELLED = """labelled AS (
  SELECT d.doc_id, d.text, l.quality::DOUBLE AS rating
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


# -- probs: class probabilities ------------------------------------------------


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = (F.col("rating") - 1).cast("int")
    weights = [
        h(f"p{j}") + F.when(index == j, F.lit(0.5)).otherwise(F.lit(0.0)) for j in range(5)
    ]
    held = reviews(spark, sf_dir).select(
        "doc_id", "text", "rating", index.alias("label_index"),
        *[weight.alias(f"_w{j}") for j, weight in enumerate(weights)],
    )
    total = reduce(lambda left, right: left + right, [F.col(f"_w{j}") for j in range(5)])
    return held.withColumn("_total", total).select(
        "doc_id", "text", "rating", "label_index",
        F.array(*[F.col(f"_w{j}") / F.col("_total") for j in range(5)]).alias("p"),
    )


PROBS = f"""{REVIEWS}, weights AS (
  SELECT doc_id, text, rating, rating::INT - 1 AS label_index, {
    ', '.join(f"{sql_h(f'p{j}')} + CASE WHEN rating::INT - 1 = {j} THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS w{j}"
              for j in range(5))}
  FROM reviews),
  probs AS (SELECT doc_id, text, rating, label_index, {
    ', '.join(f"w{j}/(w0+w1+w2+w3+w4) AS p{j}" for j in range(5))} FROM weights),
  long AS ({
    ' UNION ALL '.join(f"SELECT doc_id, label_index, {j} AS j, p{j} AS p FROM probs" for j in range(5))}),
  own AS (SELECT doc_id, p AS p_own FROM long WHERE j = label_index),
  best AS (SELECT doc_id, j AS argmax FROM long
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, j) = 1)"""

JOINT = f"""{PROBS},
  thresholds AS (SELECT label_index AS j, avg(p) AS threshold, count(*) AS n FROM long
    WHERE j = label_index GROUP BY label_index),
  sure AS (SELECT l.doc_id, l.label_index AS given, l.j AS confident
    FROM long l JOIN thresholds t ON l.j = t.j WHERE l.p >= t.threshold
    QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY l.p DESC, l.j) = 1),
  grid AS (SELECT a.i::INT AS given, b.i::INT AS confident
    FROM range(5) a(i), range(5) b(i)),
  found AS (SELECT given, confident, count(*) AS n FROM sure GROUP BY ALL),
  sizes AS (SELECT label_index AS given, count(*) AS size FROM probs GROUP BY ALL),
  cells AS (SELECT given, confident, coalesce(n, 0) AS n, coalesce(size, 0) AS size,
      CASE WHEN given = confident THEN greatest(coalesce(n, 0), 1) ELSE coalesce(n, 0) END AS c
    FROM grid LEFT JOIN found USING (given, confident) LEFT JOIN sizes USING (given)),
  shares AS (SELECT *, sum(c) OVER (PARTITION BY given) AS total FROM cells),
  floors AS (SELECT *, (c::HUGEINT * size) // total AS fl, (c::HUGEINT * size) % total AS rem FROM shares),
  turns AS (SELECT *, size - sum(fl) OVER (PARTITION BY given) AS missing,
      row_number() OVER (PARTITION BY given ORDER BY
        (given = confident AND fl = 0 AND rem > 0)::INT DESC, rem DESC, confident) AS turn FROM floors),
  joint AS (SELECT given, confident, n,
      (fl + CASE WHEN turn <= missing THEN 1 ELSE 0 END)::BIGINT AS calibrated FROM turns)"""


def sql_issues(frac: float) -> str:
    return f"""{JOINT},
  gaps AS (SELECT l.doc_id, l.label_index AS given, l.j, o.p_own - l.p AS gap
    FROM long l JOIN own o USING (doc_id) WHERE l.j <> l.label_index),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY given, j ORDER BY gap, doc_id) AS r FROM gaps),
  picked AS (SELECT DISTINCT r.doc_id FROM ranked r
    JOIN joint c ON c.given = r.given AND c.confident = r.j
    JOIN best b ON b.doc_id = r.doc_id
    WHERE r.r <= floor({frac} * c.calibrated) AND b.argmax <> r.given),
  scored AS (SELECT p.doc_id, p.text, p.rating, o.p_own AS label_quality_score,
      (k.doc_id IS NOT NULL) AS is_label_issue, (b.argmax + 1)::DOUBLE AS suggested_rating
    FROM probs p JOIN own o USING (doc_id) JOIN best b USING (doc_id)
    LEFT JOIN picked k ON k.doc_id = p.doc_id)"""


# -- predictions -----------------------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(h("e") < 0.7, F.col("rating")).otherwise(
        F.lit(1.0) + F.floor(h("f") * 5).cast("double")
    )
    return reviews(spark, sf_dir).select("doc_id", "rating", guess.alias("prediction"))


PREDICTIONS = f"""{REVIEWS}, predictions AS (
  SELECT doc_id, rating, CASE WHEN {sql_h('e')} < 0.7 THEN rating
    ELSE (1 + floor({sql_h('f')} * 5))::DOUBLE END AS prediction FROM reviews)"""



def sql_class_scores(p: str = "") -> str:
    """From ``{p}cells`` (actual, predicted, n) to ``{p}scores``, a row per class."""
    return f"""{p}sides AS (SELECT actual AS class, n AS support, 0 AS pn,
      CASE WHEN actual = predicted THEN n ELSE 0 END AS hits FROM {p}cells
    UNION ALL SELECT predicted, 0, n, 0 FROM {p}cells),
  {p}sums AS (SELECT class, sum(support)::BIGINT AS support, sum(pn)::BIGINT AS pn, sum(hits)::BIGINT AS hits
    FROM {p}sides GROUP BY class),
  {p}by_class AS (SELECT class, support, hits,
      CASE WHEN pn = 0 THEN 0 ELSE hits::DOUBLE / pn END AS precision,
      CASE WHEN support = 0 THEN 0 ELSE hits::DOUBLE / support END AS recall,
      CASE WHEN support + pn = 0 THEN 0 ELSE 2.0::DOUBLE * hits / (support + pn) END AS f1 FROM {p}sums)"""


SCORES = f"""{PREDICTIONS}, cells AS (
  SELECT rating AS actual, prediction AS predicted, count(*) AS n FROM predictions GROUP BY ALL),
  {sql_class_scores()}, scores AS (SELECT * FROM by_class)"""


# -- metadata ----------------------------------------------------------------------


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0")
    part = table(spark, sf_dir, "part")
    return documents.join(part, documents.doc_id == part.p_partkey).select(
        F.col("doc_id").alias("meta_id"),
        "text",
        F.concat(F.lit("A"), (F.col("doc_id") % 50).cast("string")).alias("asin"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("main_category"),
    )


METADATA = """metadata AS (
  SELECT d.doc_id AS meta_id, d.text, 'A'||(d.doc_id % 50) AS asin, p.p_name AS title,
    p.p_brand AS brand, p.p_retailprice AS price, p.p_type AS main_category
  FROM documents d JOIN part p ON d.doc_id = p.p_partkey WHERE d.doc_id % 3 = 0),
  lookup AS (SELECT * EXCLUDE (meta_id) FROM metadata
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY meta_id) = 1)"""


# -- curated: rows with provenance -------------------------------------------------


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _ladder(
        h("c"),
        [(0.1, F.lit("corrected")), (0.2, F.lit("verified")), (0.25, F.lit("original_noisy"))],
        F.lit("clean_original"),
    )
    return reviews(spark, sf_dir).select("doc_id", "text", "rating", source.alias("source"))


CURATED = f"""{REVIEWS}, curated AS (
  SELECT doc_id, text, rating, CASE WHEN h < 0.1 THEN 'corrected' WHEN h < 0.2 THEN 'verified'
    WHEN h < 0.25 THEN 'original_noisy' ELSE 'clean_original' END AS source
  FROM (SELECT *, {sql_h('c')} AS h FROM reviews))"""


# -- suspects and canned answers -----------------------------------------------------


def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).filter(h("n") < 0.5).select(
        "doc_id", "text", "rating",
        (F.lit(1.0) + F.floor(h("s") * 5).cast("double")).alias("suggested_rating"),
    )


SUSPECTS = f"""{REVIEWS}, suspects AS (
  SELECT doc_id, text, rating, (1 + floor({sql_h('s')} * 5))::DOUBLE AS suggested_rating
  FROM reviews WHERE {sql_h('n')} < 0.5),
  placed AS (SELECT *, row_number() OVER (ORDER BY {sql_digest('42')}, doc_id) - 1 AS pos FROM suspects),
  batched AS (SELECT * EXCLUDE (pos), pos // 5 AS batch_id, (pos % 5)::INT AS item_no FROM placed)"""


def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One canned raw answer per request; its shape goes by batch_id % 8."""
    requests = build_requests(suspects(spark, sf_dir), "doc_id")
    shape = F.col("batch_id") % 8

    # to_json gives {...}; ratings are put in as raw JSON so that shapes can break them.
    def as_record(item: Column, rating: Column) -> Column:
        body = F.to_json(
            F.struct(
                item["row_id"].alias("row_id"),
                item["text"].alias("text"),
                (item["suggested_rating"] != item["rating"]).alias("corrected"),
                F.lit("checked").alias("reason"),
            )
        )
        return F.concat(F.regexp_replace(body, r"\}$", ""), rating, F.lit("}"))

    def listing(rating_of) -> Column:
        records = F.transform("items", lambda item, place: as_record(item, rating_of(item, place)))
        return F.concat(F.lit("["), F.array_join(records, ","), F.lit("]"))

    good = lambda item, place: F.concat(F.lit(',"rating":'), item["suggested_rating"].cast("string"))
    first_lacks = lambda item, place: F.when(place == 0, F.lit("")).otherwise(good(item, place))
    odd = lambda item, place: F.concat(
        F.lit(',"rating":'),
        F.try_element_at(
            F.array(*[F.lit(v) for v in ("2.5", '"4"', "9", "true", "NaN")]), place + 1
        ),
    )
    first = F.col("items")[0]
    bracketed = F.struct(
        first["row_id"].alias("row_id"),
        F.concat(F.lit("[great] "), first["text"]).alias("text"),
        first["rating"].alias("rating"),
        first["suggested_rating"].alias("suggested_rating"),
    )
    nothing = F.lit(None)
    raw = (
        F.when(shape == 0, listing(good))
        .when(shape == 1, F.concat(F.lit("Here it is:\n"), listing(good), F.lit(" done")))
        .when(shape == 2, F.concat(F.lit('{"note":"[hint] used","reviews":'), listing(good), F.lit("}")))
        .when(shape == 3, as_record(first, good(first, nothing)))
        .when(shape == 4, as_record(bracketed, good(bracketed, nothing)))
        .when(shape == 5, listing(first_lacks))
        .when(shape == 6, listing(odd))
        .otherwise(F.lit("sorry, cannot"))
    )
    return requests.select(
        "batch_id",
        F.col("items.row_id").alias("row_ids"),
        raw.alias("raw"),
        F.lit(1).alias("attempts"),
        F.lit(None).cast("string").alias("error"),
    )


# What the canned answers mean, row by row, without reading any JSON.
ANSWERS = f"""{SUSPECTS}, shaped AS (SELECT *, batch_id % 8 AS shape FROM batched),
  records AS (SELECT batch_id, item_no, doc_id, text, rating, suggested_rating, shape,
      CASE WHEN shape = 5 AND item_no = 0 THEN 'missing_key'
           WHEN shape = 6 AND item_no IN (2, 3, 4) THEN 'invalid'
           WHEN shape = 6 AND item_no = 0 THEN 'normalized' ELSE 'ok' END AS outcome,
      CASE WHEN shape = 6 AND item_no = 0 THEN 2 WHEN shape = 6 AND item_no = 1 THEN 4
           ELSE suggested_rating END::DOUBLE AS new_rating,
      suggested_rating <> rating AS corrected
    FROM shaped WHERE shape <> 7 AND (shape NOT IN (3, 4) OR item_no = 0)),
  answers AS (SELECT doc_id, new_rating, corrected FROM records WHERE outcome IN ('ok', 'normalized')),
  outcomes AS (SELECT s.batch_id, s.doc_id, s.text, s.rating AS old_rating, a.new_rating, a.corrected,
      CASE WHEN a.doc_id IS NOT NULL THEN 'checked' WHEN s.shape = 7 THEN 'llm_error_fallback'
           ELSE 'llm_partial_batch_fallback' END AS reason,
      CASE WHEN a.doc_id IS NULL THEN 'original_noisy' WHEN a.corrected THEN 'corrected'
           ELSE 'verified' END AS source
    FROM shaped s LEFT JOIN answers a ON a.doc_id = s.doc_id)"""


# -- hotels ------------------------------------------------------------------------------


def hotels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies share a text; the value of the overall rating goes by doc_id."""
    value = _ladder(
        h("o"),
        [(0.05, F.lit("0.5")), (0.10, F.lit("3.7")), (0.15, F.lit("None"))],
        F.format_string("%d.0", F.lit(1) + F.floor(h("v") * 5).cast("int")),
    )
    ratings = _ladder(
        h("w"),
        [
            (0.04, F.lit("{'service': 4.0}")),
            (0.08, F.lit("not a dict")),
            (0.10, F.lit(None).cast("string")),
            (0.15, F.concat(F.lit("{'rooms': None, 'overall': "), value, F.lit("}"))),
        ],
        F.concat(F.lit("{'service': 4.0, 'overall': "), value, F.lit("}")),
    )
    return table(spark, sf_dir, "documents").select("doc_id", "text", ratings.alias("ratings"))


HOTELS = f"""hotels AS (
  SELECT doc_id, text, CASE WHEN w < 0.04 THEN 0.0::DOUBLE WHEN w < 0.10 THEN NULL
      WHEN o < 0.05 THEN 0.5::DOUBLE WHEN o < 0.10 THEN 3.7::DOUBLE WHEN o < 0.15 THEN NULL
      ELSE (1 + floor(v * 5))::DOUBLE END AS overall
  FROM (SELECT *, {sql_h('w')} AS w, {sql_h('o')} AS o, {sql_h('v')} AS v FROM documents)),
  present AS (SELECT * FROM hotels WHERE text IS NOT NULL AND overall IS NOT NULL),
  stripped AS (SELECT doc_id, {sql_strip('text')} AS text, overall FROM present
    WHERE length({sql_strip('text')}) >= 10),
  unique_text AS (SELECT * FROM stripped
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
  valid AS (SELECT doc_id, text, round_even(overall, 0)::DOUBLE AS rating FROM unique_text
    WHERE abs(overall - round_even(overall, 0)) < 1e-9 AND round_even(overall, 0) IN (1, 2, 3, 4, 5))"""
