"""The three report pages and the two notebooks as sets of frames.

Every page takes the selected view and, where a measure ignores the selection, the
whole view. A page returns plain frames by visual; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import blank_as_zero, exact_mean
from ..functions.rules import QUALITY_WEAK_POOR
from ..functions.text import keyword_flags, style_features
from ..operators import measures as M
from ..operators.quantiles import exact_percentiles
from ..operators.star import with_price_segment

LISTING = ["product_id", "posted_date"]


def select_rows(view: DataFrame, filters: Mapping[str, Sequence] | None) -> DataFrame:
    """Report, page and slicer choices: every named column must hold one of its values."""
    for column, values in (filters or {}).items():
        view = view.where(F.col(column).isin(list(values)))
    return view


def price_histogram(view: DataFrame) -> DataFrame:
    """Listings per half-billion price bin with tooltips, peak mark, reference line, colour."""
    tips = [
        F.sum("price_billion").alias("price_sum"),
        F.min("price_billion").alias("lo"),
        F.max("price_billion").alias("hi"),
        *[F.min(c).alias(c) for c in ("city", "district", "post_rank")],
    ]
    binned = M.with_peak(M.bins(view, "price_bin", tips))
    at_peak = M.bins(view, "price_bin").where(F.col("price_bin").isNotNull())
    peak = M.overall(at_peak, F.max(F.struct("n_listings", (-F.col("price_bin")).alias("b"))))
    marked = binned.withColumns({"__peak": peak, "__mean": M.overall(view, F.avg("price_billion"))})
    colour = M.highlight(F.col("lo"), F.col("hi"), -F.col("__peak.b"), F.col("__mean"))
    return marked.withColumn("colour", colour).drop("__peak", "__mean", "lo", "hi")


def unit_price_histogram(view: DataFrame) -> DataFrame:
    """Listings per unit-price bin with the maximum line and the cheap mark."""
    binned = M.with_peak(M.bins(view, "unit_price_bin5")).drop("peak")
    return binned.withColumn("is_cheap", blank_as_zero(F.col("unit_price_bin5")) < M.cheap_limit(view))


def shape_points(view: DataFrame) -> DataFrame:
    """One point per listing with a mean depth ratio below 20, and its cheap mark."""
    points = view.groupBy(*LISTING, "plot_shape").agg(
        F.avg("depth_ratio").alias("x"), exact_mean(F.col("unit_price")).alias("y"), exact_mean(F.col("price_total")).alias("price")
    )
    near = points.where(blank_as_zero(F.col("x")) < 20)
    return near.withColumn("is_cheap", blank_as_zero(F.col("y")) < M.cheap_limit(view))


def pricing_page(view: DataFrame, filters: Mapping[str, Sequence] | None = None) -> dict[str, DataFrame]:
    v = select_rows(view, filters)
    points = shape_points(v)
    return {
        "card_peak": M.peak_bins(M.bins(v, "price_bin"), "price_bin"),
        "card_cheap": M.cheap_share(v),
        "price_histogram": price_histogram(v),
        "unit_price_histogram": unit_price_histogram(v),
        "shape_points": points,
        "shape_trend": M.trend_line(points, F.col("x"), F.col("y")),
    }


def segment_by_tier(view: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    rows = with_price_segment(view, whole)
    return rows.groupBy("segment", "segment_order", "tier").agg(M.listing_count().alias("n_listings"))


def quality_share(view: DataFrame) -> DataFrame:
    """Share of quality groups inside each tier, without the weakest group."""
    return M.share_within(view.where(F.col("quality_group") != QUALITY_WEAK_POOR[0]), "tier", "quality_group")


def paid_tier_page(view: DataFrame, filters: Mapping[str, Sequence] | None = None) -> dict[str, DataFrame]:
    """Segments by tier, quality inside tiers, days on site against unit price."""
    v = select_rows(view, filters)
    types = (filters or {}).get("property_class")
    days = v.select(*LISTING, "tier", "days_shown", "unit_price")
    return {
        "segment_by_tier": segment_by_tier(v, view),
        "quality_share": quality_share(v),
        "days_points": days,
        "days_reference": M.mean_by_type(view, types),
    }


def district_trend(view: DataFrame, districts: DataFrame) -> DataFrame:
    """Mean price trend of each district shape; a shape without listings stays."""
    means = view.groupBy("district").agg(F.avg("price_trend_1y").alias("trend"))
    return districts.join(means, districts["name"] == means["district"], "left").select("name", "trend")


def district_matrix(view: DataFrame, without: Sequence[str] = ("Quận 2",)) -> DataFrame:
    """Districts by falling trend with a grand total."""
    rows = view.where(F.col("district").isNull() | ~F.col("district").isin(list(without)))
    out = rows.rollup("district").agg(F.avg("price_trend_1y").alias("trend"), F.grouping("district").alias("is_total"))
    return out.orderBy(F.desc("trend"))


def kpi_card(view: DataFrame) -> DataFrame:
    median = exact_percentiles(view, "unit_price", [0.5], ["p50"]).select("p50").scalar()
    card = view.agg(
        F.avg("price_trend_1y").alias("mean_trend"),
        exact_mean(F.col("unit_price")).alias("mean_unit_price"),
        M.crowding_share().alias("crowding"),
    )
    return card.withColumn("median_unit_price", median)


def area_bedroom_bubbles(view: DataFrame) -> DataFrame:
    rows = view.where(blank_as_zero(F.col("area")) < 250)
    out = rows.groupBy("property_class", "area", "bedrooms").agg(F.count("product_id").alias("size"), F.avg("bedrooms").alias("m"))
    return out.where(blank_as_zero(F.col("m")) < 30).drop("m")


def anomaly_page(view: DataFrame, districts: DataFrame, filters: Mapping[str, Sequence] | None = None) -> dict[str, DataFrame]:
    v = select_rows(view, filters)
    return {
        "district_map": district_trend(v, districts),
        "district_matrix": district_matrix(v),
        "quality_box": M.box_stats(v, "quality_group", "unit_price", sample="product_id"),
        "card": kpi_card(v),
        "bubbles": area_bedroom_bubbles(v),
    }


def with_text_features(rows: DataFrame, text: str = "description") -> DataFrame:
    """Seller-tone flags and style figures of a description."""
    return rows.withColumns({**keyword_flags(F.col(text)), **style_features(F.col(text))})


def text_effects(rows: DataFrame, price: Column) -> dict[str, DataFrame]:
    """Does the tone of a description go with price, tier and rooms?"""
    f = with_text_features(rows).withColumn("__price", price)
    return {
        "distress_price": exact_percentiles(f, "__price", [0.25, 0.5, 0.75], ["q1", "median", "q3"], by=["has_ngop_kw"]),
        "hype_rate": f.groupBy("post_rank").agg((F.avg(F.col("has_marketing_kw").cast("int")) * 100).alias("rate")).orderBy("rate"),
        "shouting": f.groupBy("post_rank").agg(F.avg("exclamation_count").alias("mean_marks")),
        "cashflow_rooms": exact_percentiles(
            f.where(F.col("bedrooms") <= 20), "bedrooms", [0.25, 0.5, 0.75], ["q1", "median", "q3"], by=["has_dongtien_kw"]
        ),
    }
