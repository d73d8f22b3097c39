"""Step 4: ask a model about the suspects only, and put the table together."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from labelwright import DOMAIN, SEED
from labelwright.operators.joins import resume_anti
from labelwright.operators.relabel import (
    BATCH_SIZE,
    INSTRUCTION,
    apply_outcomes,
    assemble_curated,
    batch_outcomes,
    build_prompt,
    build_requests,
    complete_batches,
    curation_counters,
    failure_reasons,
    parse_responses,
    sanitize_records,
    unanswered_counter,
)
from labelwright.session import discard, spool
from labelwright.sources.answers import adopt, answered_ids, append_answers, read_answers


@dataclass(frozen=True)
class Curation:
    curated: DataFrame
    corrected: DataFrame
    counters: DataFrame
    reasons: DataFrame


def ask_model(
    flagged: DataFrame,
    complete: Callable[[str], str],
    log_path: str,
    id_col: str,
    text_col: str = "text",
    label_col: str = "rating",
    callers: int | None = None,
    batches_per_commit: int = 100_000,
    instruction: str = INSTRUCTION,
    seed: str = SEED,
    **retry,
) -> DataFrame:
    """Answer every flagged row that the log lacks; returns the whole log.

    The log is committed every ``batches_per_commit`` requests, and each answer is kept
    beside it from the moment it comes. A task that is lost, or a restart after a stop at
    any point, asks only for the rows without an answer.
    """
    spark = flagged.sparkSession
    journal = f"{log_path.rstrip('/')}-journal"
    adopt(spark, journal, log_path)
    keyed = flagged.withColumn("row_id", F.col(id_col).cast("string"))
    pending = resume_anti(keyed, answered_ids(read_answers(spark, log_path)), "row_id")
    requests = build_requests(
        pending.drop("row_id"), id_col, text_col, label_col, size=BATCH_SIZE, seed=seed
    )
    prompts = spool(build_prompt(requests, instruction), "prompts")
    n_batches = prompts.count()
    for start in range(0, n_batches, batches_per_commit):
        part = prompts.filter(
            (F.col("batch_id") >= start) & (F.col("batch_id") < start + batches_per_commit)
        )
        append_answers(
            complete_batches(part, complete, callers, journal=journal, **retry), log_path
        )
    discard(spark, journal)
    return read_answers(spark, log_path)


def curate(
    flagged: DataFrame,
    clean: DataFrame,
    log: DataFrame,
    id_col: str,
    text_col: str = "text",
    label_col: str = "rating",
    domain: Sequence[float] = DOMAIN,
) -> Curation:
    """Read the answer log and build the curated table and its figures.

    ``log`` holds all runs, whose request numbers may repeat; rows are matched
    by (request, row), which stays unique because no row is asked twice.
    """
    parsed = spool(parse_responses(log), "parsed")
    records = sanitize_records(parsed, domain)
    outcomes = batch_outcomes(parsed, records)
    corrected = apply_outcomes(flagged, outcomes, id_col, label_col)
    return Curation(
        curated=assemble_curated(clean, corrected, id_col, text_col, label_col, domain),
        corrected=corrected,
        counters=curation_counters(parsed, records, outcomes).unionByName(
            unanswered_counter(corrected)
        ),
        reasons=failure_reasons(parsed, records),
    )
