"""Report measures.

A measure that must ignore the axis filter takes the whole selected frame and enters
as a scalar subquery; one that ignores every filter takes the unfiltered frame. The
two inputs are explicit arguments, never hidden state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.numeric import blank_as_zero, exact_mean, safe_divide
from .quantiles import exact_percentiles

ID = "product_id"


def listing_count(approximate: bool = False) -> Column:
    """Distinct listings; the sketch is an option for dashboards that accept its error."""
    return F.approx_count_distinct(ID) if approximate else F.count_distinct(F.col(ID))


def share(condition: Column, of: Column) -> Column:
    """Rows that meet a condition over rows with a value, 0 on an empty input."""
    hits = F.count(F.when(condition, of)).cast("double")
    return safe_divide(hits, F.count(of).cast("double"), 0.0)


def strong_title_share() -> Column:
    return share(F.col("legal_class") == R.TITLE_STRONG, F.col(ID))


def crowding_share() -> Column:
    return share(R.crowding(F.col("area"), F.col("bedrooms")), F.col(ID))


def mean_unit_price_per_area() -> Column:
    """Mean of unit price over area where the area is positive (divides by area again)."""
    ratio = F.try_divide(F.col("unit_price").cast("double"), F.col("area"))
    return F.avg(F.when(F.col("area") > 0, ratio))


def overall(df: DataFrame, measure: Column) -> Column:
    """One value over a frame, as a scalar subquery."""
    return df.agg(measure.alias("v")).scalar()


def cheap_limit(selected: DataFrame) -> Column:
    """Fifth percentile of the unit price over the whole selection."""
    return exact_percentiles(selected, "unit_price", [0.05], ["p05"]).select("p05").scalar()


def filtered_median(df: DataFrame, condition: Column, value: str, name: str) -> DataFrame:
    return exact_percentiles(df.where(condition), value, [0.5], [name]).select(name)


def bins(df: DataFrame, axis: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Listings per bin; distinct ids are dropped by (bin, id) before the bin is counted."""
    return df.groupBy(axis).agg(listing_count().alias("n_listings"), *extra)


def with_peak(binned: DataFrame) -> DataFrame:
    """The count again on the fullest bins, blank elsewhere, and the reference line."""
    marked = binned.withColumn("max_line", overall(binned, F.max("n_listings")))
    return marked.withColumn("peak", F.when(F.col("n_listings") == F.col("max_line"), F.col("n_listings")))


def peak_bins(binned: DataFrame, axis: str) -> DataFrame:
    """Labels of the fullest bins in ascending order, joined by a comma."""
    top = binned.where(F.col("n_listings") == overall(binned, F.max("n_listings")))
    text = F.format_string("%.2f", F.col(axis).cast("double"))
    values = F.array_sort(F.collect_list(F.struct(F.col(axis), text.alias("label"))))
    return top.where(F.col(axis).isNotNull()).agg(F.array_join(F.transform(values, lambda x: x["label"]), ", ").alias("peak_bins"))


def highlight(lo: Column, hi: Column, peak: Column, mean: Column, radius: float = 2.0) -> Column:
    """Colour class of a bin: near the peak bin, or around the mean."""
    near = hi.between(peak - radius, peak + radius)
    around = (mean >= lo) & (mean <= hi)
    return F.when(lo.isNull(), None).otherwise(F.when(near | around, "highlight").otherwise("neutral"))


def cheap_share(selected: DataFrame) -> DataFrame:
    """Limit, cheap listings, all listings and their quotient for a card."""
    limited = selected.select(ID, "unit_price").withColumn("cheap_limit", cheap_limit(selected))
    cheap = blank_as_zero(F.col("unit_price")) <= F.col("cheap_limit")
    # A listing may have dear and cheap rows, so reduce to one flag per listing first.
    per_id = limited.groupBy(ID).agg(
        F.max(F.coalesce(cheap, F.lit(False))).alias("is_cheap"), F.max("cheap_limit").alias("cheap_limit")
    )
    out = per_id.agg(
        F.max("cheap_limit").alias("cheap_limit"),
        F.count_if("is_cheap").alias("cheap_listings"),
        F.count(F.lit(1)).alias("listings"),
    )
    quotient = safe_divide(F.col("cheap_listings").cast("double"), F.col("listings").cast("double"))
    return out.withColumn("cheap_share", quotient)


def share_within(df: DataFrame, category: str, series: str) -> DataFrame:
    """Counts per (category, series) and their share of the category."""
    from pyspark.sql import Window

    counts = df.groupBy(category, series).agg(F.count(ID).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy(category))
    return counts.withColumn("share", F.try_divide(F.col("n_rows").cast("double"), total.cast("double")))


def mean_by_type(whole: DataFrame, selected_types: Sequence[str] | None = None) -> DataFrame:
    """Mean unit price that ignores every filter but the property type's own."""
    rows = whole if not selected_types else whole.where(F.col("property_class").isin(list(selected_types)))
    return rows.agg(exact_mean(F.col("unit_price")).alias("type_mean"))


def box_stats(df: DataFrame, group: str, value: str, sample: str | None = None) -> DataFrame:
    """Quartiles, whiskers (min, max), mean and count per group, over per-sample sums."""
    rows = df.select(group, F.col(value).alias("v"))
    if sample is not None:
        rows = df.groupBy(group, sample).agg(F.sum(value).alias("v"))
    quart = exact_percentiles(rows, "v", [0.25, 0.5, 0.75], ["q1", "q2", "q3"], by=[group]).drop("n")
    rest = rows.groupBy(group).agg(
        F.min("v").cast("double").alias("low"),
        F.max("v").cast("double").alias("high"),
        F.try_divide(F.sum("v").cast("double"), F.count("v")).alias("mean"),
        F.count("v").alias("samples"),
    )
    side = quart.withColumnRenamed(group, "__g")
    return rest.join(side, rest[group].eqNullSafe(side["__g"]), "left").drop("__g")


def trend_line(df: DataFrame, x: Column, y: Column, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line per group."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def outlier_table(df: DataFrame, features: dict[str, str]) -> DataFrame:
    """Quartiles, fences, upper percentiles and count of each feature, from one pass."""
    long = df.select(*[F.col(c).try_cast("double").alias(label) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double").alias(label) for label, c in features.items()])
    rows = long.unpivot([], list(features), "feature", "value")
    q = exact_percentiles(rows, "value", [0.25, 0.75, 0.95, 0.99], ["q1", "q3", "p95", "p99"], by=["feature"])
    iqr = F.col("q3") - F.col("q1")
    r = lambda c: F.bround(c, 3) + F.lit(0.0)
    source = F.create_map(*[F.lit(x) for kv in features.items() for x in kv])
    return q.select(
        "feature",
        F.element_at(source, F.col("feature")).alias("source_column"),
        r(F.col("q1")).alias("q1"),
        r(F.col("q3")).alias("q3"),
        r(iqr).alias("iqr"),
        r(F.col("q1") - 1.5 * iqr).alias("threshold_low"),
        r(F.col("q3") + 1.5 * iqr).alias("threshold_high"),
        r(F.col("p95")).alias("p95"),
        r(F.col("p99")).alias("p99"),
        F.col("n").alias("count"),
    )
