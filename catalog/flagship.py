"""The whole chain on given probabilities: everything but the model fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.fixtures import CLASSES, PROBS, REVIEWS, metadata, probs, reviews, sql_digest, sql_issues
from catalog.labels import obliging
from catalog.registry import query
from labelwright.operators.assembly import assemble_gold, provenance_crosstab
from labelwright.operators.filters import structural_filter
from labelwright.plans.curation import ask_model, curate
from labelwright.plans.noise import noise_split, score_labels
from labelwright.plans.sanitize import sanitize
from labelwright.session import scratch_path, spool

FRAC_NOISE = 0.5

_KEPT = """kept AS (SELECT * FROM (SELECT * FROM reviews WHERE text IS NOT NULL AND trim(text) <> ''
    AND length(text) >= 10 QUALIFY row_number() OVER (PARTITION BY text, rating ORDER BY doc_id) = 1))"""
_CHAIN = sql_issues(FRAC_NOISE).replace(
    PROBS, PROBS.replace(REVIEWS, f"{REVIEWS}, {_KEPT}").replace(
        "FROM reviews),\n  probs", "FROM kept),\n  probs"
    )
)


@query("full_run", f"""WITH {_CHAIN},
  placed AS (SELECT *, row_number() OVER (ORDER BY {sql_digest('42')}, doc_id) - 1 AS pos
    FROM scored WHERE is_label_issue),
  failed AS (SELECT pos // 5 AS batch_id, bool_or(doc_id % 97 = 7) AS f FROM placed GROUP BY ALL),
  answered AS (SELECT p.doc_id, CASE WHEN f THEN p.rating ELSE p.suggested_rating END AS rating,
      CASE WHEN f THEN 'original_noisy' WHEN p.rating <> p.suggested_rating THEN 'corrected'
        ELSE 'verified' END AS source FROM placed p JOIN failed b ON b.batch_id = p.pos // 5),
  gold AS (SELECT doc_id, rating, source FROM answered UNION ALL
    SELECT doc_id, rating, 'clean_original' FROM scored WHERE NOT is_label_issue)
  SELECT rating, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY rating)::BIGINT AS n_class,
    round(100.0::DOUBLE * sum(count(*)) OVER (PARTITION BY rating) / sum(count(*)) OVER (), 6) AS pct_class
  FROM gold GROUP BY rating, source""")
def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, deduplicate, flag, ask, assemble; gold rows per class and source."""
    rows = sanitize(structural_filter(reviews(spark, sf_dir)), "doc_id")
    scored = spool(
        rows.join(probs(spark, sf_dir).select("doc_id", "label_index", "p"), "doc_id"), "scored"
    )
    noisy, clean = noise_split(spool(score_labels(scored, "doc_id", CLASSES, FRAC_NOISE), "flagged"))
    log = ask_model(
        noisy, obliging, scratch_path(spark, "answers"), "doc_id", callers=8, wait_seconds=0.0
    )
    curated = curate(noisy, clean, log, "doc_id").curated
    gold = assemble_gold(curated, "doc_id", metadata(spark, sf_dir), "meta_id", shuffle=False)
    return provenance_crosstab(gold).withColumn("pct_class", F.round("pct_class", 6))
