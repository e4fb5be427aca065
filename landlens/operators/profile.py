"""Column profile of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint", "decimal")


def _is_number(dtype: str) -> bool:
    return dtype.startswith(NUMBERS)


def _plain(name: str) -> str:
    return f"`{name}`"


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, missing cells, distinct values; range and mean of numbers.

    Plain figures come from one pass. Exact distinct counts come from one (column, value)
    shuffle for all columns together; several distinct aggregates in one query would
    multiply every row by their number inside a single aggregate instead.
    """
    kinds = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        col = F.col(_plain(c))
        aggs.append(F.count(col).alias(f"n{i}"))
        if _is_number(kinds[c]):
            aggs += [
                F.min(col).cast("double").alias(f"lo{i}"),
                F.max(col).cast("double").alias(f"hi{i}"),
                F.avg(col).cast("double").alias(f"mean{i}"),
            ]
        if approximate:
            aggs.append(F.approx_count_distinct(col).alias(f"d{i}"))
    flat = df.agg(*aggs)
    none = F.lit(None).cast("double")
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.lit(kinds[c]).alias("dtype"),
                (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
                F.round(F.try_divide((F.col("rows") - F.col(f"n{i}")).cast("double"), F.col("rows")) * 100, 2).alias("null_percent"),
                (F.col(f"lo{i}") if _is_number(kinds[c]) else none).alias("min"),
                (F.col(f"hi{i}") if _is_number(kinds[c]) else none).alias("max"),
                (F.round(F.col(f"mean{i}"), 2) if _is_number(kinds[c]) else none).alias("mean"),
                (F.col(f"d{i}") if approximate else F.lit(None).cast("long")).alias("unique_count"),
                F.col("rows").alias("total_rows"),
                F.lit(len(df.columns)).cast("long").alias("total_columns"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    profile = flat.select(F.inline(entries))
    if approximate:
        return profile
    distinct = distinct_counts(df)
    joined = profile.drop("unique_count").join(distinct, "name", "left")
    return joined.select(*[F.coalesce("unique_count", F.lit(0)).alias("unique_count") if c == "unique_count" else F.col(c) for c in profile.columns])


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(_plain(c)).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).where(F.col("value").isNotNull())


def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact distinct values of every column through one shuffle on (column, value)."""
    return _long(df, df.columns).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("unique_count"))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column; ties go to the smaller value.

    Counts are taken first, then each of 64 value shards keeps its own best k, so the
    last ranking of a column sees at most 64*k rows.
    """
    counts = _long(df, columns).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc("value")]
    sharded = counts.withColumn("shard", F.pmod(F.hash("value"), F.lit(64)))
    local = sharded.withColumn("r", F.row_number().over(Window.partitionBy("name", "shard").orderBy(*order)))
    best = local.where(F.col("r") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(*order)))
    return best.where(F.col("rank") <= k).select("name", "value", "n", "rank")


def sample_rows(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """First rows by an explicit order, missing cells shown as NaN text."""
    return df.orderBy(*order).limit(n).select(
        *[F.coalesce(F.col(_plain(c)).cast("string"), F.lit("NaN")).alias(c) for c in df.columns]
    )
