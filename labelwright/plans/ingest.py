"""Step 1: raw reviews to a filtered, sampled table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from labelwright import DOMAIN, SEED
from labelwright.operators.filters import (
    filter_funnel,
    project_reviews,
    structural_filter,
    structural_stages,
)
from labelwright.operators.sampling import stratified_sample


def ingest(
    raw: DataFrame,
    id_col: str,
    fractions: Mapping[float, float] | None = None,
    domain: Sequence[float] = DOMAIN,
    seed: str = SEED,
) -> DataFrame:
    """Project, filter and sample in one narrow pass: no shuffle at all.

    Without ``fractions`` no row is left out.
    """
    reviews = structural_filter(project_reviews(raw, id_col), domain=domain)
    return stratified_sample(reviews, fractions, id_col, seed=seed) if fractions else reviews


def ingest_funnel(raw: DataFrame, id_col: str, domain: Sequence[float] = DOMAIN) -> DataFrame:
    return filter_funnel(project_reviews(raw, id_col), structural_stages(domain=domain))
