"""Frames that several registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean_listings, typed_listings
from ..operators.star import listing_view, with_calculated_columns
from ..sources.listings import raw_listings


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_listings(raw_listings(spark, sf_dir))


def clean(spark: SparkSession, sf_dir: str, keep: list[str] | None = None, staged: bool = False) -> DataFrame:
    return clean_listings(raw_listings(spark, sf_dir, staged), keep)


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_calculated_columns(listing_view(clean(spark, sf_dir)))


def r6(c):
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def as_dates(df: DataFrame) -> DataFrame:
    """Timestamps as plain dates in ISO text, which every engine compares alike."""
    return df.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c, t in df.dtypes if t in ("date", "timestamp", "timestamp_ntz")}
    )


def as_doubles(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c, t in df.dtypes if t.startswith("decimal")})
