"""Column contracts of each stage, checked against the schema at plan time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    StringType,
    StructField,
    StructType,
)


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


TEXT, NUMBER, FLAG = StringType(), DoubleType(), BooleanType()

# A rating may come as a number or a string; project_reviews casts it.
RAW_REVIEW = _schema(text=TEXT, rating=TEXT, asin=TEXT, user_id=TEXT)
REVIEW = _schema(text=TEXT, rating=NUMBER, asin=TEXT, reviewerID=TEXT)
SCORED_REVIEW = StructType(
    REVIEW.fields
    + _schema(label_quality_score=NUMBER, is_label_issue=FLAG, suggested_rating=NUMBER).fields
)
CURATED = _schema(text=TEXT, rating=NUMBER, source=TEXT)
METADATA = _schema(text=TEXT, asin=TEXT, title=TEXT, brand=TEXT, price=NUMBER, main_category=TEXT)
LABELLED_TEXT = _schema(text=TEXT, rating=NUMBER)
HOTEL = _schema(ratings=TEXT, text=TEXT)

METADATA_COLUMNS = ("asin", "title", "brand", "price", "main_category")


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error naming the columns it lacks."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def present_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [name for name in wanted if name in df.columns]


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add each optional column that ``df`` lacks."""
    absent = {name: value for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df


def first_present(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first of ``candidates`` that exists, decided at plan time."""
    for name in candidates:
        if name in df.columns:
            return F.col(name)
    raise ValueError(f"none of {list(candidates)} in {df.columns}")
