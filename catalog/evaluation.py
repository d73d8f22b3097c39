"""Assembly, training, metrics, comparison and the second domain."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from catalog.fixtures import (
    CLASSES,
    CURATED,
    HOTELS,
    LABELLED,
    METADATA,
    PREDICTIONS,
    REVIEWS,
    SCORES,
    curated,
    h,
    hotels,
    labelled,
    metadata,
    predictions,
    reviews,
    sql_digest,
    sql_h,
    table,
)
from catalog.registry import query
from catalog.training import sql_cells, sql_evaluated, sql_hinge, sql_result
from labelwright.models import classifier, linear
from labelwright.operators import assembly, metrics
from labelwright.plans import comparison, out_of_domain
from labelwright.session import scratch_path
from labelwright.sources.files import report_sink, scan_csv

# -- gold table ----------------------------------------------------------------------

GOLD = f"""{CURATED}, {METADATA}, numbered AS (
    SELECT doc_id, text, rating, source, printf('GOLD_%06d',
      row_number() OVER (ORDER BY {sql_digest('position')}, doc_id) - 1) AS sample_id
    FROM curated WHERE length(text) >= 10),
  gold AS (SELECT n.doc_id, n.text, n.rating, n.source, n.sample_id, l.asin, l.title, l.brand, l.price,
    l.main_category FROM numbered n LEFT JOIN lookup l ON n.text = l.text)"""


def gold(spark, sf_dir, shuffle=False):
    return assembly.assemble_gold(
        curated(spark, sf_dir), "doc_id", metadata(spark, sf_dir), "meta_id", shuffle=shuffle
    )


@query("assemble_gold", f"WITH {GOLD} SELECT * FROM gold")
def _(spark, sf_dir):
    return gold(spark, sf_dir, shuffle=True)


SQL_BALANCE = """n AS (SELECT rating, count(*) AS n FROM curated GROUP BY rating),
  s AS (SELECT n::DOUBLE / sum(n) OVER () AS p FROM n)
  SELECT count(*) AS n_classes, round(-sum(p * ln(p + 1e-9)) / ln(count(*)), 6) AS balance_score FROM s"""


@query("class_balance", f"WITH {CURATED}, {SQL_BALANCE}")
def _(spark, sf_dir):
    return assembly.class_balance(curated(spark, sf_dir)).withColumn(
        "balance_score", F.round("balance_score", 6)
    )


@query("provenance_crosstab", f"""WITH {CURATED} SELECT rating, source, count(*) AS n,
  sum(count(*)) OVER (PARTITION BY rating)::BIGINT AS n_class,
  round(100.0::DOUBLE * sum(count(*)) OVER (PARTITION BY rating) / sum(count(*)) OVER (), 6) AS pct_class
  FROM curated GROUP BY rating, source""")
def _(spark, sf_dir):
    return assembly.provenance_crosstab(curated(spark, sf_dir)).withColumn(
        "pct_class", F.round("pct_class", 6)
    )


@query("assembly_report", f"""WITH {GOLD}, n AS (SELECT rating, count(*) AS n FROM gold GROUP BY rating),
  s AS (SELECT n::DOUBLE / sum(n) OVER () AS p FROM n),
  c AS (SELECT count(*) AS t, count(asin) AS a, count(title) AS w FROM gold)
  SELECT 'provenance' AS section, rating::VARCHAR AS key, source AS detail, count(*)::DOUBLE AS value
    FROM gold GROUP BY rating, source
  UNION ALL SELECT 'balance', 'n_classes', '', count(*) FROM s
  UNION ALL SELECT 'balance', 'balance_score', '', round(-sum(p * ln(p + 1e-9)) / ln(count(*)), 6) FROM s
  UNION ALL SELECT 'coverage', 'n_rows', '', t FROM c UNION ALL SELECT 'coverage', 'matched', '', a FROM c
  UNION ALL SELECT 'coverage', 'matched_pct', '', round(100.0::DOUBLE * a / t, 6) FROM c
  UNION ALL SELECT 'coverage', 'with_title', '', w FROM c
  UNION ALL SELECT 'coverage', 'without_title', '', t - w FROM c""")
def _(spark, sf_dir):
    return assembly.assembly_report(gold(spark, sf_dir)).withColumn("value", F.round("value", 6))


# -- models: the solver is Spark's, so rows and invariants are checked ----------------

QUALITY = (0.0, 1.0)
BINARY = {"classes": QUALITY}


def halves(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rows.filter(h("half") < 0.7), rows.filter(h("half") >= 0.7)


@query("train_text_classifier", rf"""WITH {LABELLED}, train AS (SELECT * FROM labelled WHERE {sql_h('half')} < 0.7),
  tokens AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS t FROM train),
  grams AS (SELECT doc_id, unnest(t) AS term FROM tokens UNION ALL
    SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i]||' '||t[i + 1])) FROM tokens),
  counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
  words AS (SELECT term, sum(tf) AS total, count(*) AS df FROM counts GROUP BY term
    HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 10000)
  SELECT term, round(ln((1.0::DOUBLE + (SELECT count(*) FROM train)) / (1 + df)) + 1, 6) AS idf FROM words""")
def _(spark, sf_dir):
    """The fitted vocabulary with its idf weights."""
    train, _ = halves(spark, sf_dir)
    model = classifier.train_text_classifier(train, "doc_id", **BINARY)
    return spark.createDataFrame(
        list(zip(model.stages[1].vocabulary, model.stages[2].getOrDefault("idf"))),
        "term string, idf double",
    ).withColumn("idf", F.round("idf", 6))


HALVES = f"""{LABELLED}, half_docs AS (SELECT doc_id AS d, text, rating, {sql_h('half')} < 0.7 AS fitted FROM labelled)"""


@query("predict", f"""WITH RECURSIVE {HALVES}, {sql_hinge('half_')}
  SELECT d AS doc_id, rating, CASE WHEN s > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
  FROM half_scores JOIN half_docs USING (d) WHERE NOT fitted""")
def _(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    model = classifier.train_text_classifier(train, "doc_id", **BINARY)
    return classifier.predict(model, test, QUALITY).select("doc_id", "rating", "prediction")


@query("model_sink", f"""WITH {LABELLED} SELECT doc_id, TRUE AS same FROM labelled WHERE {sql_h('half')} >= 0.7""")
def _(spark, sf_dir):
    """Do predictions before saving and after loading agree?"""
    train, test = halves(spark, sf_dir)
    model = classifier.train_text_classifier(train, "doc_id", **BINARY)
    path = scratch_path(spark, "model")
    model.write().save(path)
    before = classifier.predict(model, test, QUALITY).select("doc_id", F.col("prediction").alias("before"))
    after = classifier.predict(PipelineModel.load(path), test, QUALITY)
    return before.join(after, "doc_id").select(
        "doc_id", (F.col("before") == F.col("prediction")).alias("same")
    )


@query("decision_scores", f"""WITH RECURSIVE {HALVES}, {sql_hinge('half_')}
  SELECT d AS doc_id, class, round(CASE class WHEN 1 THEN s ELSE -s END, 3) AS score
  FROM half_scores JOIN half_docs USING (d), (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) c(class) WHERE NOT fitted""")
def _(spark, sf_dir):
    """Every class's score as a join of TF-IDF rows with the model's table of weights."""
    train, test = halves(spark, sf_dir)
    model = classifier.train_text_classifier(train, "doc_id", tolerance=1e-9, **BINARY)
    weighted = classifier.weighted_terms(model, test, "doc_id")
    scores = linear.relational_scores(weighted, classifier.weights_table(model, spark, QUALITY), test, "doc_id")
    return scores.withColumn("score", F.round("score", 3))


@query("optimality", f"""WITH RECURSIVE {HALVES}, {sql_hinge('half_')},
  m AS (SELECT s, CASE rating WHEN 1 THEN 1 ELSE -1 END AS y FROM half_scores JOIN half_docs USING (d) WHERE fitted)
  SELECT class, TRUE AS at_optimum, round(sum(greatest(0, 1 - y * s) ** 2), 3) AS loss
  FROM m, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) c(class) GROUP BY class""")
def _(spark, sf_dir):
    """The gradient at the fitted weights, from tables: below 1e-4 for each class; and the loss there."""
    train, _ = halves(spark, sf_dir)
    model = classifier.train_text_classifier(train, "doc_id", **BINARY)
    weighted, weights = classifier.weighted_terms(model, train, "doc_id"), classifier.weights_table(model, spark, QUALITY)
    norms = linear.hinge_certificate(weighted, train, weights, "doc_id", "rating", 1.0)
    sign = F.when(F.col("rating") == F.col("class"), 1.0).otherwise(-1.0)
    short = F.greatest(F.lit(0.0), 1.0 - sign * F.col("score"))
    losses = linear.relational_scores(weighted, weights, train, "doc_id").join(train, "doc_id").groupBy("class").agg(
        F.round(F.sum(short * short), 3).alias("loss")
    )
    return norms.join(losses, "class").select("class", (F.col("gradient_norm") < 1e-4).alias("at_optimum"), "loss")


@query("evaluate", f"""WITH RECURSIVE {HALVES}, {sql_evaluated('half_')} {sql_result('half_', 'all rows', QUALITY)}""")
def _(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    row, _ = classifier.evaluate("all rows", train, test, "doc_id", **BINARY)
    return row


COMPARED = f"""{LABELLED}, noisy AS (SELECT doc_id, text, CASE WHEN {sql_h('flip')} < 0.2 THEN 1 - rating ELSE rating END AS rating FROM labelled),
  test AS (SELECT * FROM (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY rating ORDER BY {sql_digest('42')}, doc_id) <= 20)
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
  v0 AS (SELECT * FROM noisy WHERE text NOT IN (SELECT text FROM test)),
  v1 AS (SELECT * FROM v0 QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
  v3 AS (SELECT * FROM labelled WHERE text NOT IN (SELECT text FROM test)
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
  target AS (SELECT rating, count(*) AS n FROM v3 GROUP BY rating),
  v2 AS (SELECT v1.* FROM v1 JOIN target t ON t.rating = v1.rating
    QUALIFY row_number() OVER (PARTITION BY v1.rating ORDER BY {sql_digest('42', 'v1.doc_id')}, v1.doc_id)
      <= max(t.n) OVER (PARTITION BY v1.rating)), """ + ", ".join(
    f"""v{k}_docs AS (SELECT doc_id AS d, text, rating, TRUE AS fitted FROM v{k} UNION ALL SELECT doc_id, text, rating, FALSE FROM test),
  {sql_evaluated(f'v{k}_')}""" for k in range(4)
)


@query("compare_variants", f"WITH RECURSIVE {COMPARED} " + " UNION ALL ".join(
    sql_result(f"v{k}_", name, QUALITY) for k, name in enumerate(comparison.VARIANTS)))
def _(spark, sf_dir):
    """Four training sets, one test set: raw, deduplicated, matched, corrected."""
    raw = labelled(spark, sf_dir)
    noisy = raw.withColumn("rating", F.when(h("flip") < 0.2, 1 - F.col("rating")).otherwise(F.col("rating")))
    full = comparison.dedup_text(noisy, "doc_id")
    test = comparison.fixed_test_set(raw, "doc_id", per_class=20)
    variants = comparison.build_variants(noisy, full, comparison.dedup_text(raw, "doc_id"), test, "doc_id")
    return comparison.compare_variants(variants, test, "doc_id", **BINARY)


@query("evaluate_ood", f"""WITH RECURSIVE {LABELLED}, en_docs AS (SELECT l.doc_id AS d, l.text, rating, lang = 'en' AS fitted
    FROM labelled l JOIN documents USING (doc_id) WHERE lang IS NOT NULL), {sql_hinge('en_')}, {sql_cells('en_')} SELECT * FROM en_cells""")
def _(spark, sf_dir):
    """A model trained on English documents, scored on the other languages."""
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = labelled(spark, sf_dir).join(lang, "doc_id")
    train, other = rows.filter("lang = 'en'"), rows.filter("lang <> 'en'")
    path = scratch_path(spark, "model")
    classifier.train_text_classifier(train, "doc_id", **BINARY).write().save(path)
    return classifier.evaluate_ood(path, other, classes=QUALITY)


# -- metrics ---------------------------------------------------------------------------


def cells(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir))


@query("confusion", f"""WITH {PREDICTIONS} SELECT rating AS actual, prediction AS predicted, count(*) AS n
  FROM predictions GROUP BY ALL""")
def _(spark, sf_dir):
    return cells(spark, sf_dir)


@query("accuracy", f"""WITH {PREDICTIONS} SELECT round(avg((rating = prediction)::INT), 9) AS accuracy FROM predictions""")
def _(spark, sf_dir):
    return metrics.overall_scores(cells(spark, sf_dir)).select(F.round("accuracy", 9).alias("accuracy"))


@query("f1_macro", f"WITH {SCORES} SELECT round(avg(f1), 9) AS f1_macro FROM scores")
def _(spark, sf_dir):
    return metrics.overall_scores(cells(spark, sf_dir)).select(F.round("f1_macro", 9).alias("f1_macro"))


@query("f1_weighted", f"WITH {SCORES} SELECT round(sum(f1 * support) / sum(support), 9) AS f1_weighted FROM scores")
def _(spark, sf_dir):
    return metrics.overall_scores(cells(spark, sf_dir)).select(F.round("f1_weighted", 9).alias("f1_weighted"))


@query("f1_per_class", f"""WITH {SCORES} SELECT c.class, round(coalesce(f1, 0), 9) AS f1
  FROM (VALUES (0.0::DOUBLE), (1.0), (2.0), (3.0), (4.0), (5.0)) c(class) LEFT JOIN scores USING (class)""")
def _(spark, sf_dir):
    """Class 0 does not occur and scores 0."""
    return metrics.f1_per_class(cells(spark, sf_dir), (0.0, *CLASSES)).withColumn("f1", F.round("f1", 9))


@query("classification_report", f"""WITH {SCORES} SELECT class::VARCHAR AS label, round(precision, 9) AS precision,
    round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM scores
  UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits)::DOUBLE / sum(support), 9), sum(support)::BIGINT FROM scores
  UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9),
    sum(support)::BIGINT FROM scores
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
    round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
    sum(support)::BIGINT FROM scores""")
def _(spark, sf_dir):
    report = metrics.classification_report(cells(spark, sf_dir))
    return report.select(
        "label", *[F.round(name, 9).alias(name) for name in ("precision", "recall", "f1")], "support"
    )


@query("result_row", f"""WITH {SCORES} SELECT 'fixture' AS experiment, 100::BIGINT AS n_train,
  round(sum(hits)::DOUBLE / sum(support), 4) AS accuracy, round(avg(f1), 4) AS f1_macro,
  round(sum(f1 * support) / sum(support), 4) AS f1_weighted,
  {', '.join(f'round(max(f1) FILTER (WHERE class = {c}), 4) AS "f1_class_{c:g}"' for c in CLASSES)} FROM scores""")
def _(spark, sf_dir):
    return metrics.result_row(cells(spark, sf_dir), "fixture", 100)


EFFECT_SEEDS = dict(zip(comparison.VARIANTS, (0.5, 0.6, 0.7, 0.8)))
SQL_EFFECTS = " UNION ALL ".join(
    f"SELECT {i} AS place, '{name}' AS experiment, count(*) FILTER (WHERE {sql_h('e')} < {share}) / count(*)::DOUBLE AS f1_macro FROM reviews"
    for i, (name, share) in enumerate(EFFECT_SEEDS.items(), 1)
)


@query("effect_decomposition", f"""WITH {REVIEWS}, results AS ({SQL_EFFECTS}),
  steps AS (SELECT *, lag(f1_macro) OVER (ORDER BY place) AS base FROM results)
  SELECT CASE place WHEN 2 THEN 'deduplication' WHEN 3 THEN 'class_balance' ELSE 'label_correction' END AS effect,
    experiment, round(f1_macro - base, 9) AS delta_f1, round((f1_macro - base) / base * 100, 6) AS delta_pct
  FROM steps WHERE place > 1""")
def _(spark, sf_dir):
    return comparison.effects(seeded_results(spark, sf_dir)).select(
        "effect", "experiment", F.round("delta_f1", 9).alias("delta_f1"), F.round("delta_pct", 6).alias("delta_pct")
    )


def seeded_results(spark, sf_dir):
    rows = reviews(spark, sf_dir)
    return reduce(
        DataFrame.unionByName,
        [
            rows.agg(F.avg((h("e") < share).cast("int")).alias("f1_macro")).select(
                F.lit(name).alias("experiment"), "f1_macro"
            )
            for name, share in EFFECT_SEEDS.items()
        ],
    )


@query("comparison_report", f"""WITH {REVIEWS}, results AS ({SQL_EFFECTS}),
  steps AS (SELECT *, lag(f1_macro) OVER (ORDER BY place) AS base FROM results),
  named AS (SELECT CASE place WHEN 2 THEN 'deduplication' WHEN 3 THEN 'class_balance' ELSE 'label_correction' END AS item,
    f1_macro - base AS d, (f1_macro - base) / base * 100 AS pct FROM steps WHERE place > 1)
  SELECT 'variant' AS section, experiment AS item, 'f1_macro' AS metric, round(f1_macro, 6) AS value FROM results
  UNION ALL SELECT 'effect', item, 'delta_f1', round(d, 6) FROM named
  UNION ALL SELECT 'effect', item, 'delta_pct', round(pct, 6) FROM named""")
def _(spark, sf_dir):
    """Written as a report and read back."""
    path = scratch_path(spark, "comparison-report")
    report = comparison.comparison_report(seeded_results(spark, sf_dir))
    report_sink(report, path)
    return scan_csv(spark, path, report.schema).withColumn("value", F.round("value", 6))


TEST = f"""test AS (SELECT doc_id, text, rating FROM
    (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY rating ORDER BY {sql_digest('42')}, doc_id) <= 20)
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)"""
VARIANTS = f"""{CURATED}, {TEST}, v0 AS (SELECT * FROM reviews WHERE text NOT IN (SELECT text FROM test)),
  v1 AS (SELECT * FROM v0 QUALIFY row_number() OVER (PARTITION BY text, rating ORDER BY doc_id) = 1),
  v3 AS (SELECT * FROM curated WHERE text NOT IN (SELECT text FROM test) AND doc_id % 3 <> 0),
  target AS (SELECT rating, count(*) AS n FROM v3 GROUP BY rating),
  v2 AS (SELECT v1.* FROM v1 JOIN target t ON t.rating = v1.rating
    QUALIFY row_number() OVER (PARTITION BY v1.rating ORDER BY {sql_digest('42', 'v1.doc_id')}, v1.doc_id)
      <= max(t.n) OVER (PARTITION BY v1.rating))"""


def variants(spark, sf_dir):
    raw = reviews(spark, sf_dir)
    full = comparison.dedup_text_label(raw, "doc_id")
    test = comparison.fixed_test_set(raw, "doc_id", per_class=20, shuffle=False)
    corrected = curated(spark, sf_dir).filter("doc_id % 3 <> 0")
    return comparison.build_variants(raw, full, corrected, test, "doc_id")


@query("build_variants", f"""WITH {VARIANTS}
  SELECT 'V0_with_duplicates' AS variant, doc_id, rating FROM v0 UNION ALL SELECT 'V1_full', doc_id, rating FROM v1
  UNION ALL SELECT 'V1_matched', doc_id, rating FROM v2 UNION ALL SELECT 'V1_corrected', doc_id, rating FROM v3""")
def _(spark, sf_dir):
    return reduce(
        DataFrame.unionByName,
        [
            frame.select(F.lit(name).alias("variant"), "doc_id", "rating")
            for name, frame in variants(spark, sf_dir).items()
        ],
    )


@query("variant_sizes", f"""WITH {VARIANTS}, n AS (
  SELECT 'V0_with_duplicates' AS variant, count(*) AS n FROM v0 UNION ALL SELECT 'V1_full', count(*) FROM v1
  UNION ALL SELECT 'V1_matched', count(*) FROM v2 UNION ALL SELECT 'V1_corrected', count(*) FROM v3)
  SELECT variant, n, (SELECT count(*) FROM v0) - n AS diff_from_first FROM n""")
def _(spark, sf_dir):
    return comparison.variant_sizes(variants(spark, sf_dir))


# -- second domain ------------------------------------------------------------------------


@query("extract_overall", f"WITH {HOTELS} SELECT doc_id, overall FROM hotels")
def _(spark, sf_dir):
    overall = out_of_domain.extract_overall(F.col("ratings"))
    return hotels(spark, sf_dir).select("doc_id", overall.alias("overall"))


@query("prepare_ood", f"WITH {HOTELS} SELECT * FROM valid ORDER BY {sql_digest('42')}, doc_id LIMIT 400")
def _(spark, sf_dir):
    return out_of_domain.prepare_ood(hotels(spark, sf_dir), "doc_id", n=400)


@query("ood_funnel", f"""WITH {HOTELS}, n AS (SELECT (SELECT count(*) FROM hotels) AS n0, (SELECT count(*) FROM present) AS n1,
    (SELECT count(*) FROM stripped) AS n2, (SELECT count(*) FROM unique_text) AS n3, (SELECT count(*) FROM valid) AS n4),
  steps AS (SELECT 0 AS step, 'raw' AS stage, n0 AS kept FROM n UNION ALL SELECT 1, 'not_missing', n1 FROM n
    UNION ALL SELECT 2, 'text_long_enough', n2 FROM n UNION ALL SELECT 3, 'unique_text', n3 FROM n
    UNION ALL SELECT 4, 'label_valid', n4 FROM n UNION ALL SELECT 5, 'sampled', least(n4, 400)::BIGINT FROM n)
  SELECT step, stage, kept, coalesce(lag(kept) OVER (ORDER BY step) - kept, 0) AS dropped,
    round(100.0::DOUBLE * kept / max(kept) OVER (), 6) AS pct_of_raw FROM steps""")
def _(spark, sf_dir):
    return out_of_domain.ood_funnel(hotels(spark, sf_dir), "doc_id", n=400).withColumn(
        "pct_of_raw", F.round("pct_of_raw", 6)
    )
