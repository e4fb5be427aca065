"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import exact_mean
from ..operators import measures as M
from ..operators.profile import column_profile
from ..operators.quantiles import exact_medians, exact_percentiles
from ..sources.tables import read_pages
from .checks import CALC, TYPED
from .frames import typed, view
from .registry import query, table


def _money(c):
    return F.col(c).cast("decimal(18,2)")


@query("a1_listing_count", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def a1(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n"))


@query("a2_count_present", f"{TYPED} SELECT count(area) AS n_area, count(price_total) AS n_price, count(*) AS n FROM typed")
def a2(spark, d):
    return typed(spark, d).agg(
        F.count("area").alias("n_area"), F.count("price_total").alias("n_price"), F.count(F.lit(1)).alias("n")
    )


@query("a3_sum", "SELECT l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total FROM lineitem GROUP BY 1")
def a3(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(_money("l_extendedprice")).cast("double").alias("total"))


@query("a4_average", "SELECT l_linestatus, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE / count(l_extendedprice) AS mean FROM lineitem GROUP BY 1")
def a4(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(exact_mean(_money("l_extendedprice")).alias("mean"))


@query("a5_min_max", "SELECT p_type, min(p_name) AS first_name, max(p_name) AS last_name, min(p_size) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1")
def a5(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(
        F.min("p_name").alias("first_name"), F.max("p_name").alias("last_name"), F.min("p_size").alias("lo"), F.max("p_retailprice").alias("hi")
    )


@query("a6_median", "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def a6(spark, d):
    med = exact_percentiles(table(spark, d, "orders"), "o_totalprice", [0.5], ["median"], by=["o_orderpriority"])
    return med.select("o_orderpriority", F.round("median", 4).alias("median"))


@query(
    "a7_percentiles",
    "SELECT round(quantile_cont(o_totalprice, 0.05), 4) AS p05, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, "
    "round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, count(*) AS n FROM orders",
)
def a7(spark, d):
    names = ["p05", "p25", "p75", "p99"]
    out = exact_percentiles(table(spark, d, "orders"), "o_totalprice", [0.05, 0.25, 0.75, 0.99], names)
    return out.select("n", *[F.round(c, 4).alias(c) for c in names])


@query(
    "a8_mean_of_row_ratio",
    f"{CALC} SELECT round(avg(unit_price / area) FILTER (WHERE area > 0), 6) AS mean_ratio FROM calc",
)
def a8(spark, d):
    return view(spark, d).agg(F.round(M.mean_unit_price_per_area(), 6).alias("mean_ratio"))


@query(
    "a9_conditional_shares",
    f"{CALC} SELECT count(*) FILTER (WHERE legal_class = 'Sổ hồng/Sổ đỏ')::DOUBLE / count(*) AS strong_title, "
    "count(*) FILTER (WHERE coalesce(area, 0) <= 40 AND coalesce(bedrooms, 0) >= 3)::DOUBLE / count(*) AS crowding FROM calc",
)
def a9(spark, d):
    return view(spark, d).agg(M.strong_title_share().alias("strong_title"), M.crowding_share().alias("crowding"))


@query(
    "a10_cheap_share",
    f"{CALC}, lim AS (SELECT quantile_cont(unit_price, 0.05) AS cheap_limit FROM calc) SELECT cheap_limit, "
    "count(DISTINCT product_id) FILTER (WHERE coalesce(unit_price, 0) <= cheap_limit) AS cheap_listings, count(DISTINCT product_id) AS listings, "
    "count(DISTINCT product_id) FILTER (WHERE coalesce(unit_price, 0) <= cheap_limit)::DOUBLE / count(DISTINCT product_id) AS cheap_share FROM calc, lim GROUP BY cheap_limit",
)
def a10(spark, d):
    return M.cheap_share(view(spark, d))


@query(
    "a11_filtered_medians",
    f"{CALC} SELECT median(unit_price) FILTER (WHERE interior = 'Thô') AS bare_shell, "
    "median(unit_price) FILTER (WHERE interior = 'Không nội thất') AS unfurnished, "
    "median(unit_price) FILTER (WHERE quality_group = 'Pháp lý yếu + Hẻm nhỏ') AS weak_alley FROM calc",
)
def a11(spark, d):
    v = view(spark, d)
    # Three filters, one pass: each row brings its value once per filter it meets.
    conds = {
        "bare_shell": F.col("interior") == "Thô",
        "unfurnished": F.col("interior") == "Không nội thất",
        "weak_alley": F.col("quality_group") == "Pháp lý yếu + Hẻm nhỏ",
    }
    flat = v.select(*[F.when(cond, F.col("unit_price").cast("double")).alias(k) for k, cond in conds.items()])
    return exact_medians(flat, list(conds))


@query(
    "a12_group_effects",
    f"{TYPED} SELECT has_ngop_kw, median(price_total / area) FILTER (WHERE area > 0) AS median_price, avg(CASE WHEN has_elevator THEN 1.0 WHEN NOT has_elevator THEN 0.0 END)::DOUBLE * 100 AS elevator_rate FROM typed GROUP BY 1",
)
def a12(spark, d):
    rows = typed(spark, d).withColumn("ratio", F.when(F.col("area") > 0, F.col("price_total") / F.col("area")))
    med = exact_percentiles(rows, "ratio", [0.5], ["median_price"], by=["has_ngop_kw"]).drop("n")
    rate = rows.groupBy("has_ngop_kw").agg((F.avg(F.col("has_elevator").cast("int")) * 100).alias("elevator_rate"))
    return med.join(rate, "has_ngop_kw")


@query(
    "a13_two_key_count",
    "SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL",
)
def a13(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count_distinct("o_custkey").alias("n"))


@query(
    "a13_pivoted_count",
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
)
def a13_pivot(spark, d):
    out = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.fillna(0)


@query(
    "a14_share_within",
    f"{CALC} SELECT tier, quality_group, count(*) AS n_rows, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY tier) AS share FROM calc GROUP BY tier, quality_group",
)
def a14(spark, d):
    return M.share_within(view(spark, d), "tier", "quality_group")


@query(
    "a15_bin_tooltips",
    f"{CALC} SELECT price_bin, count(DISTINCT product_id) AS n_listings, sum(price_total::BIGINT)::DOUBLE AS price_sum, min(city) AS city, min(district) AS district, min(post_rank) AS post_rank FROM calc GROUP BY 1",
)
def a15(spark, d):
    tips = [F.sum("price_total").cast("double").alias("price_sum")] + [F.min(c).alias(c) for c in ("city", "district", "post_rank")]
    return M.bins(view(spark, d), "price_bin", tips)


@query(
    "a16_bubbles",
    f"{CALC} SELECT property_class, area, bedrooms, count(*) AS size FROM calc WHERE area < 250 GROUP BY ALL HAVING avg(bedrooms) < 30",
)
def a16(spark, d):
    rows = view(spark, d).where(F.col("area") < 250)
    out = rows.groupBy("property_class", "area", "bedrooms").agg(F.count("product_id").alias("size"), F.avg("bedrooms").alias("m"))
    return out.where(F.col("m") < 30).drop("m")


@query(
    "a17_point_scatter",
    "SELECT l_orderkey, l_returnflag, avg(l_quantity) AS x, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE / count(*) AS y FROM lineitem GROUP BY ALL",
)
def a17(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(
        F.avg("l_quantity").alias("x"), exact_mean(_money("l_extendedprice")).alias("y")
    )


@query(
    "a18_box_plot",
    """WITH s AS (SELECT l_returnflag, l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS v, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS m FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS q2, round(quantile_cont(v, 0.75), 4) AS q3,
    min(v) AS low, max(v) AS high, round(sum(m)::DOUBLE / count(v), 6) AS mean, count(v) AS samples FROM s GROUP BY 1""",
)
def a18(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", _money("l_extendedprice").alias("price"))
    out = M.box_stats(rows, "l_returnflag", "price", sample="l_orderkey")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "q2", "q3")} | {"mean": F.round("mean", 6)})


@query(
    "a19_matrix_with_total",
    "SELECT n_name, grouping(n_name) AS is_total, sum(CAST(s_acctbal AS DECIMAL(18,2)))::DOUBLE / count(*) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_name)",
)
def a19(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.rollup("n_name").agg(
        F.grouping("n_name").cast("long").alias("is_total"), exact_mean(_money("s_acctbal")).alias("mean")
    )


@query(
    "a20_kpi_card",
    "SELECT avg(l_quantity) AS mean_qty, count(DISTINCT l_orderkey) AS orders, round(sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE, 2) AS total, "
    "count(*) FILTER (WHERE l_discount > 0.05)::DOUBLE / count(*) AS deep_share FROM lineitem",
)
def a20(spark, d):
    return table(spark, d, "lineitem").agg(
        F.avg("l_quantity").alias("mean_qty"),
        F.count_distinct("l_orderkey").alias("orders"),
        F.sum(_money("l_extendedprice")).cast("double").alias("total"),
        M.share(F.col("l_discount") > 0.05, F.col("l_orderkey")).alias("deep_share"),
    )


@query(
    "a21_location_drill",
    f"{CALC} SELECT city, district, ward, grouping(city, district, ward) AS level, count(*) AS n FROM calc GROUP BY ROLLUP (city, district, ward)",
)
def a21(spark, d):
    return view(spark, d).rollup("city", "district", "ward").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


@query(
    "a22_date_drill",
    "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS dd, count(*) AS n FROM orders GROUP BY ROLLUP (y, q, m, dd)",
)
def a22(spark, d):
    x = F.col("o_orderdate")
    rows = table(spark, d, "orders").select(F.year(x).alias("y"), F.quarter(x).alias("q"), F.month(x).alias("m"), F.dayofmonth(x).alias("dd"))
    return rows.rollup("y", "q", "m", "dd").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a23_outlier_table",
    """WITH q AS (SELECT 'quantity' AS feature, 'l_quantity' AS source_column, l_quantity AS v FROM lineitem UNION ALL
      SELECT 'discount', 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'price', 'l_extendedprice', l_extendedprice FROM lineitem),
    s AS (SELECT feature, source_column, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99, count(*) AS "count" FROM q GROUP BY ALL)
    SELECT feature, source_column, round_even(q1, 3) AS q1, round_even(q3, 3) AS q3, round_even(q3 - q1, 3) AS iqr, round_even(q1 - 1.5 * (q3 - q1), 3) + 0.0::DOUBLE AS threshold_low,
      round_even(q3 + 1.5 * (q3 - q1), 3) AS threshold_high, round_even(p95, 3) AS p95, round_even(p99, 3) AS p99, "count" FROM s""",
)
def a23(spark, d):
    return M.outlier_table(
        table(spark, d, "lineitem"), {"quantity": "l_quantity", "discount": "l_discount", "price": "l_extendedprice"}
    )


_PROFILE = "SELECT '{c}' AS name, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, {lo} AS \"min\", {hi} AS \"max\", {mean} AS mean, count(*) AS total_rows FROM customer"


def _profile_sql():
    parts = []
    for c in ("c_custkey", "c_nationkey", "c_acctbal"):
        parts.append(_PROFILE.format(c=c, lo=f"min({c})::DOUBLE", hi=f"max({c})::DOUBLE", mean=f"round(avg({c}), 2)"))
    for c in ("c_name", "c_mktsegment"):
        parts.append(_PROFILE.format(c=c, lo="NULL::DOUBLE", hi="NULL::DOUBLE", mean="NULL::DOUBLE"))
    return " UNION ALL ".join(parts)


@query("a24_column_profile", _profile_sql())
def a24(spark, d):
    return column_profile(table(spark, d, "customer")).select("name", "null_count", "unique_count", "min", "max", "mean", "total_rows")


@query(
    "a25_trend_line",
    "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1",
)
def a25(spark, d):
    out = M.trend_line(table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("a26_run_counters", "SELECT count(*) AS total, count(DISTINCT url) AS addresses FROM pages")
def a26(spark, d):
    return read_pages(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_distinct("url").alias("addresses"))
