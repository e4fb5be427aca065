"""Exact percentiles whose memory does not grow with the data.

The built-in exact percentile keeps every distinct value of a group in one task.
Here values are counted first (equal values collapse before the shuffle), the
distinct values are cut into ordered ranges by their magnitude, the ranges that hold a
wanted rank are cut again into equal parts of their own span, twice, and only the parts
that hold a wanted rank are sorted. However values are concentrated, a part holds no more
than 2**16 different ones. Interpolation is linear between two ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..session import materialise

STEPS = 64  # ranges per factor e of magnitude
FLOOR = 746 * STEPS  # the logarithm of a double is never below -746
PARTS = 1 << 15  # parts into which a range with a wanted rank is cut again
LEVELS = 2  # times that this is done: a range holds less than 2**46 doubles, so a last part holds 2**16 of them at most


def magnitude_range(v: Column) -> Column:
    """Ordered range number of a value: a step function of its sign and logarithm.

    It needs no statistics of the data, so every task agrees on it. There are at most
    a few thousand ranges over any realistic span, and under 200,000 over all doubles.
    """
    step = (F.floor(F.ln(F.abs(v)) * STEPS) + FLOOR).cast("int")
    return F.when(v > 0, step).when(v < 0, -step).otherwise(0)


def _wanted_ranges(counts: DataFrame, keys: list[str], parents: list[str], digit: str, ps: Sequence[float]) -> DataFrame:
    """The ranges that hold a wanted rank, with the rows in front of them and their least and greatest value."""
    known = ["__before", "__total"] if parents else []
    totals = counts.groupBy(*keys, *parents, digit, *known).agg(F.sum("__n").alias("__rn"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    run = Window.partitionBy(*keys, *parents).orderBy(digit)
    total = F.col("__total") if parents else F.sum("__rn").over(Window.partitionBy(*keys))
    before = F.sum("__rn").over(run) - F.col("__rn") + (F.col("__before") if parents else F.lit(0))
    target = totals.select(*keys, *parents, digit, "__rn", "__lo", "__hi", before.alias("__before"), total.alias("__total"))
    wanted = F.lit(False)
    for p in ps:
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        for rank in (F.floor(pos), F.ceil(pos)):
            wanted = wanted | ((rank >= F.col("__before")) & (rank < F.col("__before") + F.col("__rn")))
    return target.where(wanted)


def _inside(counts: DataFrame, ranges: DataFrame, keys: list[str], parents: list[str]) -> DataFrame:
    """The values of the wanted ranges, with what is known of their range.

    Null-safe on every key: a plain equality would push a not-null filter into one of the two branches, and the counting
    shuffle could then not be shared between them.
    """
    own = [*keys, *parents]
    facts = ["__before", "__total", "__lo", "__hi"]
    other = ranges.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(own)], *[F.col(x).alias(f"_{x}") for x in facts])
    same = F.lit(True)
    for i, k in enumerate(own):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    found = counts.select(*own, "__v", "__n").join(other, same, "inner")
    return found.select(*own, "__v", "__n", *[F.col(f"_{x}").alias(x) for x in facts])


def _sub_range() -> Column:
    """Number of a value's part of its range, in order of values: equal parts from the least to the greatest."""
    width = F.col("__hi") - F.col("__lo")
    part = F.floor((F.col("__v") - F.col("__lo")) / width * PARTS).cast("int")
    return F.when(width > 0, F.least(part, F.lit(PARTS - 1))).otherwise(0)


def exact_percentiles(
    df: DataFrame, value: str, ps: Sequence[float], names: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """One row per group: inclusive percentiles `ps` of `value` under `names`, and `n`.

    Missing values, NaN and infinities are left out; a group without values has no row.
    """
    # A constant joins the group columns, so an ungrouped call follows the same path.
    keys = ["__g", *by]
    v = finite(F.col(value).cast("double"))
    counts = (
        df.select(F.lit(0).alias("__g"), *by, v.alias("__v"))
        .where(F.col("__v").isNotNull())
        .groupBy(*keys, "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__r0", magnitude_range(F.col("__v")))
    )
    # Every level reads the counts again; what they are made of, often a long plan, is planned and run once.
    counts = materialise(counts, "value-counts")
    found, parents = None, []
    for level in range(LEVELS + 1):
        digit = f"__r{level}"
        if found is not None:
            counts = _inside(counts, found, keys, parents).withColumn(digit, _sub_range())
        found = _wanted_ranges(counts, keys, parents, digit, ps)
        parents = [*parents, digit]
    hits = _inside(counts, found, keys, parents)
    inside = Window.partitionBy(*keys, *parents).orderBy("__v")
    ranked = hits.withColumn("__end", F.col("__before") + F.sum("__n").over(inside))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__end") - F.col("__n")) & (rank < F.col("__end")), F.col("__v")))

    outs, cols = [], []
    for p, name in zip(ps, names, strict=True):
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        outs += [at(F.floor(pos)).alias(f"__lo_{name}"), at(F.ceil(pos)).alias(f"__hi_{name}")]
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    got = ranked.groupBy(*keys).agg(F.max("__total").alias("n"), *outs)
    return got.select(*by, "n", *cols)


def with_scalar(df: DataFrame, name: str, frame: DataFrame) -> DataFrame:
    """Add the single row of `frame` as one struct column.

    It is a scalar subquery that runs once, not a join; later columns read the struct,
    so the plan holds the subquery a single time.
    """
    return df.withColumn(name, frame.select(F.struct(*[F.col(c) for c in frame.columns])).scalar())


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the median of each column, all from one pass over the table."""
    long = unpivot(df, columns)
    by_name = exact_percentiles(long, "value", [0.5], ["p50"], by=["feature"])
    return by_name.agg(*[F.max(F.when(F.col("feature") == c, F.col("p50"))).alias(c) for c in columns])


def unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as (feature, value) rows of doubles."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")


def approx_percentiles(df: DataFrame, value: str, ps: Sequence[float], by: Sequence[str] = (), accuracy: int = 10000) -> DataFrame:
    """One-pass sketch for uses that accept a rank error of 1/accuracy."""
    return df.groupBy(*by).agg(F.percentile_approx(value, list(ps), accuracy).alias("percentiles"))
