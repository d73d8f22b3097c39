"""Text features, confident learning and label correction."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from catalog.fixtures import (
    ANSWERS,
    CLASSES,
    CURATED,
    JOINT,
    LABELLED,
    PROBS,
    REVIEWS,
    SUSPECTS,
    answer_log,
    h,
    labelled,
    probs,
    reviews,
    sql_digest,
    sql_h,
    sql_issues,
    suspects,
    table,
)
from catalog.registry import query
from catalog.training import sql_logistic
from labelwright.functions.text import bigrams, tokenize
from labelwright.models.folds import assign_folds, oof_probabilities
from labelwright.operators import confident, features, relabel
from labelwright.operators.filters import split_by_flag
from labelwright.operators.relabel import INSTRUCTION
from labelwright.plans.curation import ask_model, curate
from labelwright.plans.noise import detect_noise, noise_split, score_labels
from labelwright.session import scratch_path, spool

# -- text features ---------------------------------------------------------------

SQL_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
TERMS = f"""tokens AS (SELECT doc_id, {SQL_TOKENS} AS t FROM documents),
  unigrams AS (SELECT doc_id, unnest(t) AS term FROM tokens),
  terms AS (SELECT doc_id, term, count(*) AS tf FROM unigrams GROUP BY ALL),
  words AS (SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM terms GROUP BY term
    HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 10000)"""


@query("tokenize", f"""WITH {TERMS} SELECT doc_id, len(t)::INT AS n_tokens,
  md5(array_to_string(t, ' ')) AS tokens_md5 FROM tokens""")
def _(spark, sf_dir):
    tokens = tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5")
    )


@query("ngrams", f"""WITH {TERMS} SELECT doc_id, greatest(len(t) - 1, 0)::INT AS n_bigrams,
  md5(array_to_string(list_transform(range(1, len(t)), lambda i: t[i]||' '||t[i + 1]), '|')) AS bigrams_md5 FROM tokens""")
def _(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("_t"))
    pairs = bigrams(F.col("_t"))
    return tokens.select(
        "doc_id", F.size(pairs).alias("n_bigrams"), F.md5(F.array_join(pairs, "|")).alias("bigrams_md5")
    )


@query("vocabulary", f"WITH {TERMS} SELECT * FROM words")
def _(spark, sf_dir):
    return features.corpus_vocabulary(table(spark, sf_dir, "documents"), "doc_id")


@query("vocabulary_bigrams", f"""WITH {TERMS}, grams AS (SELECT * FROM unigrams UNION ALL
    SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i]||' '||t[i + 1])) FROM tokens),
  counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL)
  SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM counts GROUP BY term
  HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 10000""")
def _(spark, sf_dir):
    return features.corpus_vocabulary(table(spark, sf_dir, "documents"), "doc_id", n_max=2)


@query("tfidf", f"""WITH {TERMS}, n AS (SELECT count(*) AS n FROM documents),
  raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + n.n) / (1 + w.df)) + 1) AS v
    FROM terms JOIN words w USING (term), n)
  SELECT doc_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""")
def _(spark, sf_dir):
    return features.tfidf(table(spark, sf_dir, "documents"), "doc_id").withColumn(
        "weight", F.round("weight", 6)
    )


# -- confident learning --------------------------------------------------------------


@query("argmax_label", f"WITH {PROBS} SELECT doc_id, argmax FROM best")
def _(spark, sf_dir):
    return probs(spark, sf_dir).select("doc_id", confident.argmax_label(F.col("p")).alias("argmax"))


@query("fold_assignment", f"""WITH {LABELLED} SELECT doc_id, rating,
  (ntile(5) OVER (PARTITION BY rating ORDER BY {sql_digest('42')}, doc_id) - 1)::INT AS fold FROM labelled""")
def _(spark, sf_dir):
    return assign_folds(labelled(spark, sf_dir), "doc_id").select("doc_id", "rating", "fold")


@query("oof_probabilities", f"""WITH RECURSIVE {LABELLED}, oof_docs AS (SELECT doc_id AS d, text, rating, TRUE AS fitted,
    (ntile(5) OVER (PARTITION BY rating ORDER BY {sql_digest('42')}, doc_id) - 1)::INT AS fold FROM labelled),
  {sql_logistic('oof_')}
  SELECT d AS doc_id, rating, fold, 2::INT AS n_p, 1::DOUBLE AS p_sum, round(1 / (1 + exp(-s)), 4) AS p_good
  FROM oof_scores JOIN oof_docs USING (d)""")
def _(spark, sf_dir):
    """Every labelled document scored once, by the model of the other folds."""
    scored = oof_probabilities(labelled(spark, sf_dir), "doc_id", classes=(0.0, 1.0), tolerance=1e-10)
    return scored.select("doc_id", "rating", "fold", F.size("p").alias("n_p"),
                         F.round(F.col("p")[0] + F.col("p")[1], 6).alias("p_sum"), F.round(F.col("p")[1], 4).alias("p_good"))


@query("detect_noise", f"""WITH {LABELLED} SELECT doc_id, rating, true AS scored FROM labelled""")
def _(spark, sf_dir):
    """Each row is noisy or clean, none is lost; fitted on up to 3,000 rows of each class."""
    rows = labelled(spark, sf_dir)
    noisy, clean = noise_split(detect_noise(rows, "doc_id", classes=(0.0, 1.0)))
    parts = [part.select("doc_id", "rating", F.col("label_quality_score").between(0, 1).alias("scored"))
             for part in (noisy, clean)]
    return parts[0].unionByName(parts[1])


@query("class_thresholds", f"""WITH {JOINT} SELECT j AS label_index, round(threshold, 9) AS threshold, n
  FROM thresholds""")
def _(spark, sf_dir):
    return confident.class_thresholds(probs(spark, sf_dir)).withColumn("threshold", F.round("threshold", 9))


@query("confident_joint", f"WITH {JOINT} SELECT given, confident, n, calibrated FROM joint")
def _(spark, sf_dir):
    return confident.confident_joint(spool(probs(spark, sf_dir)), len(CLASSES))


@query("find_label_issues", f"WITH {sql_issues(1.0)} SELECT doc_id, is_label_issue FROM scored")
def _(spark, sf_dir):
    rows = spool(probs(spark, sf_dir).select("doc_id", "label_index", "p"))
    return confident.find_label_issues(rows, len(CLASSES), "doc_id", frac_noise=1.0).select(
        "doc_id", "is_label_issue"
    )


@query("find_label_issues_default", f"WITH {sql_issues(0.05)} SELECT doc_id, is_label_issue FROM scored")
def _(spark, sf_dir):
    rows = spool(probs(spark, sf_dir).select("doc_id", "label_index", "p"))
    return confident.find_label_issues(rows, len(CLASSES), "doc_id").select("doc_id", "is_label_issue")


def scored(spark, sf_dir):
    return spool(score_labels(spool(probs(spark, sf_dir)), "doc_id", CLASSES, 0.5))


SCORED = sql_issues(0.5)


@query("label_quality", f"WITH {SCORED} SELECT doc_id, round(label_quality_score, 9) AS label_quality_score FROM scored")
def _(spark, sf_dir):
    own = confident.label_quality(F.col("p"), F.col("label_index"))
    return probs(spark, sf_dir).select("doc_id", F.round(own, 9).alias("label_quality_score"))


@query("suggested_label", f"WITH {SCORED} SELECT doc_id, suggested_rating FROM scored")
def _(spark, sf_dir):
    guess = confident.label_decode(CLASSES, confident.argmax_label(F.col("p")))
    return probs(spark, sf_dir).select("doc_id", guess.alias("suggested_rating"))


@query("issue_flag", f"""WITH {SCORED} SELECT doc_id, text, rating, round(label_quality_score, 9) AS
  label_quality_score, is_label_issue, suggested_rating FROM scored""")
def _(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("label_quality_score", F.round("label_quality_score", 9))


@query("noise_split", f"""WITH {SCORED} SELECT is_label_issue, count(*) AS n, sum(doc_id)::BIGINT AS ids
  FROM scored GROUP BY ALL""")
def _(spark, sf_dir):
    noisy, clean = split_by_flag(scored(spark, sf_dir), "is_label_issue")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")]
    return noisy.groupBy(F.lit(True).alias("is_label_issue")).agg(*sums).unionByName(
        clean.groupBy(F.lit(False).alias("is_label_issue")).agg(*sums)
    )


@query("rank_issues", f"""WITH {SCORED} SELECT doc_id,
  row_number() OVER (ORDER BY label_quality_score, doc_id) AS issue_rank FROM scored WHERE is_label_issue""")
def _(spark, sf_dir):
    noisy, _ = split_by_flag(scored(spark, sf_dir), "is_label_issue")
    return confident.rank_issues(noisy, "doc_id").select("doc_id", "issue_rank")


@query("worst_k", f"""WITH {SCORED} SELECT doc_id, text, rating, suggested_rating
  FROM scored WHERE is_label_issue ORDER BY label_quality_score, doc_id LIMIT 5""")
def _(spark, sf_dir):
    noisy, _ = split_by_flag(scored(spark, sf_dir), "is_label_issue")
    return confident.worst_k(noisy, "doc_id").select("doc_id", "text", "rating", "suggested_rating")


@query("issues_per_class", f"""WITH {SCORED} SELECT rating, count(*) AS n,
  count(*) FILTER (WHERE is_label_issue) AS flagged FROM scored GROUP BY rating""")
def _(spark, sf_dir):
    return confident.issues_per_class(scored(spark, sf_dir), "rating")


@query("noise_summary", f"""WITH {SCORED} SELECT count(*) AS n_input, count(*) FILTER (WHERE is_label_issue) AS n_flagged,
  count(*) FILTER (WHERE NOT is_label_issue) AS n_clean,
  round(100.0::DOUBLE * count(*) FILTER (WHERE is_label_issue) / count(*), 6) AS pct_flagged FROM scored""")
def _(spark, sf_dir):
    return confident.noise_summary(scored(spark, sf_dir)).withColumn("pct_flagged", F.round("pct_flagged", 6))


@query("noise_report", f"""WITH {SCORED}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE is_label_issue) AS f FROM scored),
  worst AS (SELECT * FROM scored WHERE is_label_issue ORDER BY label_quality_score, doc_id LIMIT 5)
  SELECT 'summary' AS section, 'n_input' AS key, '' AS detail, n::DOUBLE AS value FROM s
  UNION ALL SELECT 'summary', 'n_flagged', '', f FROM s UNION ALL SELECT 'summary', 'n_clean', '', n - f FROM s
  UNION ALL SELECT 'summary', 'pct_flagged', '', round(100.0::DOUBLE * f / n, 6) FROM s
  UNION ALL SELECT 'class', rating::VARCHAR, '', count(*) FILTER (WHERE is_label_issue) FROM scored GROUP BY rating
  UNION ALL SELECT 'worst', doc_id::VARCHAR, rating::INT||' -> '||suggested_rating::INT||': '||text,
    round(label_quality_score, 6) FROM worst""")
def _(spark, sf_dir):
    return confident.noise_report(scored(spark, sf_dir), "doc_id").withColumn("value", F.round("value", 6))


# -- label correction --------------------------------------------------------------------

SQL_ITEM = """doc_id::VARCHAR AS row_id, text, rating::INT AS rating,
  suggested_rating::INT AS suggested_rating"""


@query("build_requests", f"WITH {SUSPECTS} SELECT batch_id, item_no, {SQL_ITEM} FROM batched")
def _(spark, sf_dir):
    requests = relabel.build_requests(suspects(spark, sf_dir), "doc_id")
    return requests.select("batch_id", F.posexplode("items").alias("item_no", "_i")).select(
        "batch_id", "item_no", "_i.*"
    )


@query("build_prompt", f"WITH {SUSPECTS} SELECT batch_id, item_no, true AS instructed, {SQL_ITEM} FROM batched")
def _(spark, sf_dir):
    """The prompt read back: instruction in front, then the items as JSON."""
    prompts = relabel.build_prompt(relabel.build_requests(suspects(spark, sf_dir), "doc_id"))
    head = len(relabel.INSTRUCTION)
    return prompts.select(
        "batch_id",
        F.col("prompt").startswith(relabel.INSTRUCTION).alias("instructed"),
        F.posexplode(
            F.from_json(F.col("prompt").substr(F.lit(head + 1), F.length("prompt")), f"array<{relabel.ITEM_TYPE}>")
        ).alias("item_no", "_i"),
    ).select("batch_id", "item_no", "instructed", "_i.*")


def obliging(prompt: str) -> str:
    """Stands in for the model: takes every hint, but never answers about 7s."""
    items = json.loads(prompt[len(INSTRUCTION):])
    if any(int(item["row_id"]) % 97 == 7 for item in items):
        raise RuntimeError("no answer")
    return json.dumps([
        {"row_id": i["row_id"], "text": i["text"], "rating": i["suggested_rating"],
         "corrected": i["rating"] != i["suggested_rating"], "reason": "hint"}
        for i in items
    ])


@query("batch_complete", f"""WITH {SUSPECTS} SELECT batch_id, count(*)::INT AS n_rows,
  CASE WHEN bool_or(doc_id % 97 = 7) THEN 3 ELSE 1 END AS attempts,
  CASE WHEN bool_or(doc_id % 97 = 7) THEN 'RuntimeError: no answer' END AS error
  FROM batched GROUP BY batch_id""")
def _(spark, sf_dir):
    prompts = relabel.build_prompt(relabel.build_requests(suspects(spark, sf_dir), "doc_id"))
    log = relabel.complete_batches(prompts, obliging, callers=8, wait_seconds=0.0)
    return log.select("batch_id", F.size("row_ids").alias("n_rows"), "attempts", "error")


@query("parse_response", f"""WITH {ANSWERS} SELECT batch_id,
  CASE WHEN batch_id % 8 = 7 THEN NULL WHEN batch_id % 8 IN (3, 4) THEN 1 ELSE count(*) END::INT AS n_items
  FROM shaped GROUP BY batch_id""")
def _(spark, sf_dir):
    return relabel.parse_responses(spool(answer_log(spark, sf_dir), "answers")).select(
        "batch_id", F.size("items").alias("_n"), F.col("items").isNull().alias("_none")
    ).select("batch_id", F.when(~F.col("_none"), F.col("_n")).alias("n_items"))


def parsed_and_records(spark, sf_dir):
    parsed = relabel.parse_responses(spool(answer_log(spark, sf_dir), "answers"))
    return parsed, relabel.sanitize_records(parsed)


@query("sanitize_record", f"""WITH {ANSWERS} SELECT batch_id, item_no AS pos, doc_id::VARCHAR AS row_id, outcome,
  CASE WHEN outcome IN ('ok', 'normalized') THEN new_rating END AS rating FROM records""")
def _(spark, sf_dir):
    return parsed_and_records(spark, sf_dir)[1].select("batch_id", "pos", "row_id", "outcome", "rating")


@query("tag_source", f"""WITH {ANSWERS} SELECT doc_id::VARCHAR AS row_id,
  CASE WHEN corrected THEN 'corrected' ELSE 'verified' END AS source FROM records
  WHERE outcome IN ('ok', 'normalized')""")
def _(spark, sf_dir):
    records = parsed_and_records(spark, sf_dir)[1].filter("rating is not null")
    return records.select("row_id", relabel.provenance_tag(F.col("corrected")).alias("source"))


@query("reconcile_batch", f"""WITH {ANSWERS} SELECT batch_id, doc_id::VARCHAR AS row_id, new_rating AS rating, reason
  FROM outcomes""")
def _(spark, sf_dir):
    outcomes = relabel.batch_outcomes(*parsed_and_records(spark, sf_dir))
    return outcomes.select("batch_id", "row_id", F.col("answer.rating").alias("rating"), "reason")


@query("fallback_rows", f"""WITH {ANSWERS} SELECT batch_id, doc_id::VARCHAR AS row_id, reason FROM outcomes
  WHERE new_rating IS NULL""")
def _(spark, sf_dir):
    return relabel.fallback_rows(relabel.batch_outcomes(*parsed_and_records(spark, sf_dir)))


@query("apply_outcomes", f"""WITH {ANSWERS} SELECT doc_id, text, coalesce(new_rating, old_rating) AS rating, source,
  reason FROM outcomes""")
def _(spark, sf_dir):
    outcomes = relabel.batch_outcomes(*parsed_and_records(spark, sf_dir))
    return relabel.apply_outcomes(suspects(spark, sf_dir), outcomes, "doc_id").drop("suggested_rating")


@query("apply_outcomes_partial", f"""WITH {ANSWERS}
  SELECT doc_id, CASE WHEN batch_id % 3 = 0 THEN old_rating ELSE coalesce(new_rating, old_rating) END AS rating,
    CASE WHEN batch_id % 3 = 0 THEN 'original_noisy' ELSE source END AS source,
    CASE WHEN batch_id % 3 = 0 THEN 'not_asked' ELSE reason END AS reason FROM outcomes""")
def _(spark, sf_dir):
    """A log that covers part of the flagged rows: each of them comes back once."""
    log = spool(answer_log(spark, sf_dir), "answers").filter("batch_id % 3 <> 0")
    return curate(suspects(spark, sf_dir), reviews(spark, sf_dir), log, "doc_id").corrected.select(
        "doc_id", "rating", "source", "reason"
    )


@query("union_tagged", f"""WITH {CURATED} SELECT doc_id, rating,
  CASE WHEN doc_id % 2 = 0 THEN 'clean_original' ELSE 'verified' END AS source FROM curated""")
def _(spark, sf_dir):
    rows = reviews(spark, sf_dir)
    checked = rows.filter("doc_id % 2 = 1").withColumn("source", F.lit("verified"))
    return relabel.union_tagged(rows.filter("doc_id % 2 = 0"), checked, ["doc_id", "rating"])


def curation(spark, sf_dir):
    clean = reviews(spark, sf_dir).filter(h("n") >= 0.5)
    log = spool(answer_log(spark, sf_dir), "answers")
    return curate(suspects(spark, sf_dir), clean, log, "doc_id")


@query("assemble_curated", f"""WITH {ANSWERS} SELECT doc_id, text, rating, 'clean_original' AS source FROM reviews
  WHERE {sql_h('n')} >= 0.5
  UNION ALL SELECT doc_id, text, coalesce(new_rating, old_rating), source FROM outcomes""")
def _(spark, sf_dir):
    return curation(spark, sf_dir).curated


@query("curation_counters", f"""WITH {ANSWERS}, calls AS (SELECT count(DISTINCT batch_id) AS n,
    count(DISTINCT batch_id) FILTER (WHERE shape = 7) AS f FROM shaped)
  SELECT 'calls' AS counter, n::DOUBLE AS value FROM calls
  UNION ALL SELECT 'successes', n - f FROM calls UNION ALL SELECT 'failures', f FROM calls
  UNION ALL SELECT 'failure_pct', round(100.0::DOUBLE * f / n, 6) FROM calls
  UNION ALL SELECT 'records_discarded', count(*) FROM records WHERE outcome IN ('invalid', 'missing_key')
  UNION ALL SELECT 'records_normalized', count(*) FROM records WHERE outcome = 'normalized'
  UNION ALL SELECT 'rows_corrected', count(*) FROM outcomes WHERE source = 'corrected'
  UNION ALL SELECT 'rows_verified', count(*) FROM outcomes WHERE source = 'verified'
  UNION ALL SELECT 'rows_original_noisy', count(*) FROM outcomes WHERE source = 'original_noisy'
  UNION ALL SELECT 'rows_not_asked', 0""")
def _(spark, sf_dir):
    return curation(spark, sf_dir).counters.withColumn("value", F.round("value", 6))


@query("failure_log", f"""WITH {ANSWERS}
  SELECT DISTINCT batch_id, -1 AS pos, 'failed' AS outcome, 'unusable answer' AS detail FROM shaped WHERE shape = 7
  UNION ALL SELECT batch_id, item_no, outcome, CASE WHEN shape = 5 THEN 'no rating'
      ELSE list_extract(['2.5', '4', '9', 'true', 'NaN'], item_no + 1) END||': '||text
    FROM records WHERE outcome <> 'ok'""")
def _(spark, sf_dir):
    return curation(spark, sf_dir).reasons


@query("ask_model", f"""WITH {SUSPECTS}, failed AS (
    SELECT batch_id, bool_or(doc_id % 97 = 7) AS f FROM batched GROUP BY batch_id)
  SELECT doc_id, CASE WHEN f THEN b.rating ELSE suggested_rating END AS rating,
    CASE WHEN f THEN 'original_noisy' WHEN b.rating <> suggested_rating THEN 'corrected' ELSE 'verified' END AS source
  FROM batched b JOIN failed USING (batch_id)""")
def _(spark, sf_dir):
    """Ask, log in two commits, and ask again: the second run finds nothing to do."""
    rows, path = suspects(spark, sf_dir), scratch_path(spark, "answers")
    n_batches = -(-rows.count() // relabel.BATCH_SIZE)
    for _ in range(2):
        log = ask_model(rows, obliging, path, "doc_id", callers=8, wait_seconds=0.0,
                        batches_per_commit=max(n_batches // 2, 1))
    return curate(rows, reviews(spark, sf_dir), log, "doc_id").corrected.select("doc_id", "rating", "source")


@query("find_label_issues_sorted", f"WITH {sql_issues(1.0)} SELECT doc_id, is_label_issue FROM scored")
def _(spark, sf_dir):
    """The same with the edge buckets over the window bound: the distributed sort."""
    rows = spool(probs(spark, sf_dir).select("doc_id", "label_index", "p"))
    return confident.find_label_issues(
        rows, len(CLASSES), "doc_id", frac_noise=1.0, window_rows=0
    ).select("doc_id", "is_label_issue")
