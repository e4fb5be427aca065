"""Numeric, conditional and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numeric as N
from ..operators.star import deduplicated, with_calculated_columns, with_price_segment
from .checks import CALC, CLEAN
from .frames import as_dates, clean, typed, view
from .registry import query, table


@query(
    "n1_safe_divide",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END, 6) AS ratio, "
    "round(CASE WHEN l_discount = 0 THEN -1 ELSE l_tax / l_discount END, 6) AS ratio_or FROM lineitem",
)
def n1(spark, d):
    a, b = F.col("l_tax"), F.col("l_discount")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(N.safe_divide(a, b), 6).alias("ratio"), F.round(N.safe_divide(a, b, -1.0), 6).alias("ratio_or")
    )


def _clean_columns(name, sql_cols, cols):
    sql = f"{CLEAN} SELECT src_pos, {sql_cols} FROM clean"

    @query(name, sql)
    def run(spark, d):
        return clean(spark, d).select("src_pos", *[F.col(c).cast("double").alias(c) if c == "unit_price" else F.col(c) for c in cols])

    return run


_clean_columns("n2_guarded_unit_price", "unit_price", ["unit_price"])
_clean_columns("n4_road_width", "road_width, road_class", ["road_width", "road_class"])
_clean_columns("n5_frontage", "frontage, frontage_class", ["frontage", "frontage_class"])
_clean_columns("n6_price_trend", "price_trend_1y, trend_class", ["price_trend_1y", "trend_class"])
_clean_columns("n7_rooms", "bedrooms, bathrooms, property_class", ["bedrooms", "bathrooms", "property_class"])


@query("n3_half_step", "SELECT l_partkey, l_tax, round_even(l_quantity * 0.13 * 2, 0) / 2 AS half FROM lineitem")
def n3(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_tax", N.half_step(F.col("l_quantity") * 0.13).alias("half"))


@query(
    "n8_floor_bins",
    "SELECT o_orderkey, floor(o_totalprice / 5) * 5.0::DOUBLE AS bin5, floor(o_totalprice / 2) * 2.0::DOUBLE AS bin2, floor(o_totalprice / 0.5) * 0.5::DOUBLE AS bin_half FROM orders",
)
def n8(spark, d):
    x = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", N.bin_floor(x, 5.0).alias("bin5"), N.bin_floor(x, 2.0).alias("bin2"), N.bin_floor(x, 0.5).alias("bin_half")
    )


@query("n9_toward_zero_bins", "SELECT c_custkey, trunc(c_acctbal / 50) * 50.0::DOUBLE + 0.0::DOUBLE AS bin FROM customer")
def n9(spark, d):
    return table(spark, d, "customer").select("c_custkey", (N.bin_toward_zero(F.col("c_acctbal"), 50.0) + F.lit(0.0)).alias("bin"))


@query("n10_depth_ratio", f"{CALC} SELECT src_pos, product_id, round(depth_ratio, 6) AS depth_ratio FROM calc")
def n10(spark, d):
    v = _keyed_view(spark, d)
    return v.select("src_pos", "product_id", F.round("depth_ratio", 6).alias("depth_ratio"))


def _keyed_view(spark, d):
    """The calculated view with its row-order column kept for comparison."""
    cols = [
        "product_id", "posted_date", "expiry_date", "price_total", "unit_price", "area", "frontage", "frontage_class", "road_width",
        "road_class", "bedrooms", "floors", "legal_class", "post_rank", "src_pos",
    ]
    return with_calculated_columns(deduplicated(clean(spark, d).select(*cols)))


def _class_counts(name, by_sql, by):
    @query(name, f"{CALC} SELECT {by_sql}, count(*) AS n FROM calc GROUP BY ALL")
    def run(spark, d):
        return view(spark, d).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))

    return run


_class_counts("c1_road_class", "road_class", ["road_class"])
_class_counts("c2_frontage_class", "frontage_class", ["frontage_class"])
_class_counts("c3_property_class", "property_class", ["property_class"])
_class_counts("c4_trend_class", "trend_class", ["trend_class"])
_class_counts("c5_plot_shape", "plot_shape, plot_shape_order", ["plot_shape", "plot_shape_order"])
_class_counts("c8_quality_group", "quality_group, quality_order", ["quality_group", "quality_order"])
_class_counts("c9_paid_tier", "tier, post_rank", ["tier", "post_rank"])
_class_counts("c10_title_group", "title_group, legal_class", ["title_group", "legal_class"])


@query(
    "c6_c7_price_segment",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.75) AS p75 FROM orders)
    SELECT o_orderkey, CASE WHEN o_totalprice <= round(p25) THEN 'Bình dân' WHEN o_totalprice <= round(p75) THEN 'Trung bình' ELSE 'Cao cấp' END AS segment,
    CASE WHEN o_totalprice <= p25 THEN 1 WHEN o_totalprice <= p75 THEN 2 ELSE 3 END AS segment_order FROM orders, q""",
)
def c6(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price_total"))
    return with_price_segment(rows).drop("price_total")


@query("c6_segment_counts", f"{CALC}, q AS (SELECT quantile_cont(price_total, 0.25) AS p25, quantile_cont(price_total, 0.75) AS p75 FROM calc) "
    "SELECT CASE WHEN price_total IS NULL THEN 'Không xác định' WHEN price_total <= round(p25) THEN 'Bình dân' WHEN price_total <= round(p75) THEN 'Trung bình' ELSE 'Cao cấp' END AS segment, count(*) AS n FROM calc, q GROUP BY 1")
def c6_counts(spark, d):
    return with_price_segment(view(spark, d)).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("d1_parse_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed FROM orders")
def d1(spark, d):
    text = F.concat(F.lit("Ngày đăng "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" - hết"))
    return as_dates(table(spark, d, "orders").select("o_orderkey", D.parse_date(text).alias("parsed")))


@query(
    "d1_impossible_date",
    "SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), least(month(o_orderdate), 28)), '%Y-%m-%d') END AS parsed FROM orders",
)
def d1_bad(spark, d):
    # Day and month swapped: days above 12 make an impossible month.
    text = F.date_format("o_orderdate", "MM/dd/yyyy")
    return as_dates(table(spark, d, "orders").select("o_orderkey", D.parse_date(text).alias("parsed")))


@query(
    "d2_default_dates",
    f"{CLEAN} SELECT src_pos, strftime(coalesce(posted_date, DATE '2024-01-01'), '%Y-%m-%d') AS posted, strftime(coalesce(expiry_date, posted_date + 30), '%Y-%m-%d') AS expiry FROM clean",
)
def d2(spark, d):
    posted, expiry = D.default_dates(F.to_date("posted_date"), F.to_date("expiry_date"), F.to_date(F.lit("2024-01-01")))
    return as_dates(typed(spark, d).select("src_pos", posted.alias("posted"), expiry.alias("expiry")))


@query(
    "d3_days_between",
    "SELECT o_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def d3(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_orderkey", "l_linenumber", "l_partkey", D.days_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("days"))


@query(
    "d4_date_parts",
    "SELECT o_orderkey, year(o_orderdate) AS \"year\", month(o_orderdate) AS month_no, monthname(o_orderdate) AS \"month\", quarter(o_orderdate) AS quarter_no, 'Qtr ' || quarter(o_orderdate)::STRING AS quarter, day(o_orderdate) AS \"day\" FROM orders",
)
def d4(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *[c.alias(k) for k, c in D.date_parts(F.col("o_orderdate")).items()])


@query("d5_iso_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def d5(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query(
    "f9_risk_flag_counts",
    f"{CALC} SELECT is_overcrowded, is_fire_risk, count(*) AS n FROM calc GROUP BY ALL",
)
def flags(spark, d):
    return view(spark, d).groupBy("is_overcrowded", "is_fire_risk").agg(F.count(F.lit(1)).alias("n"))
