"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.quantiles import exact_percentiles, with_scalar
from ..operators.relational import null_safe_lookup, pending, sequence_order_sql, update_by_key
from ..operators.star import (
    DETAILS, DETAILS_JOIN, FEATURES, LOCATION, deduplicated, dim_features, dim_location, dim_product, dim_property_details,
)
from ..sources.tables import date_table
from .checks import CALC, CLEAN, RAW
from .frames import clean, typed
from .registry import query, table


def _key_sql(cols, name):
    return f"SELECT {', '.join(cols)}, row_number() OVER (ORDER BY {sequence_order_sql(cols)}) AS {name} FROM (SELECT DISTINCT {', '.join(cols)} FROM clean)"


def _null_safe(cols):
    return " AND ".join(f"f.{c} IS NOT DISTINCT FROM k.{c}" for c in cols)


@query(
    "j1_location_lookup",
    f"{CLEAN}, dim AS ({_key_sql(LOCATION, 'location_skey')}) SELECT f.product_id, f.src_pos, k.location_skey FROM dedup f LEFT JOIN dim k ON {_null_safe(LOCATION)}",
)
def j1(spark, d):
    c = clean(spark, d)
    fact = deduplicated(c.select("product_id", "posted_date", *LOCATION, "src_pos"))
    return null_safe_lookup(fact, dim_location(c), LOCATION, ["location_skey"]).select("product_id", "src_pos", "location_skey")


@query(
    "j2_feature_lookup",
    f"{CLEAN}, dim AS ({_key_sql(FEATURES, 'feature_skey').replace(sequence_order_sql(FEATURES), sequence_order_sql(FEATURES, 1))}) "
    f"SELECT f.product_id, f.src_pos, k.feature_skey FROM dedup f LEFT JOIN dim k ON {_null_safe(FEATURES)}",
)
def j2(spark, d):
    c = clean(spark, d)
    fact = deduplicated(c.select("product_id", "posted_date", *FEATURES, "src_pos"))
    return null_safe_lookup(fact, dim_features(c), FEATURES, ["feature_skey"]).select("product_id", "src_pos", "feature_skey")


@query(
    "j3_details_lookup",
    f"{CLEAN}, dim AS ({_key_sql(DETAILS, 'status_skey')}) SELECT f.product_id, f.src_pos, k.status_skey FROM dedup f LEFT JOIN dim k ON {_null_safe(DETAILS_JOIN)}",
)
def j3(spark, d):
    c = clean(spark, d)
    fact = deduplicated(c.select("product_id", "posted_date", *DETAILS_JOIN, "src_pos"))
    return null_safe_lookup(fact, dim_property_details(c), DETAILS_JOIN, ["status_skey"]).select("product_id", "src_pos", "status_skey")


@query(
    "j4_product_lookup",
    f"{CLEAN}, dim AS (SELECT product_id, row_number() OVER (ORDER BY {sequence_order_sql(['product_id'], 4)}) AS product_skey FROM (SELECT DISTINCT product_id FROM clean)) "
    "SELECT f.product_id, f.src_pos, k.product_skey FROM dedup f LEFT JOIN dim k USING (product_id)",
)
def j4(spark, d):
    c = clean(spark, d)
    fact = deduplicated(c.select("product_id", "posted_date", "src_pos"))
    return null_safe_lookup(fact, dim_product(c), ["product_id"], ["product_skey"]).select("product_id", "src_pos", "product_skey")


@query(
    "j5_star_join",
    "SELECT r_name, n_name, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY ALL",
)
def j5(spark, d):
    region = table(spark, d, "region").where(F.col("r_name") == "ASIA")
    places = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, d, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return lines.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(price).cast("double").alias("total"))


@query(
    "j6_date_part_join",
    "SELECT year(ts) AS \"year\", 'Qtr ' || quarter(ts)::STRING AS quarter, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def j6(spark, d):
    events = table(spark, d, "events")
    # The date table has one row per day between two dates, so it fits any executor.
    dates = date_table(events, "ts").select("date", "year", "quarter")
    joined = events.join(F.broadcast(dates), F.to_date("ts") == F.col("date"), "left")
    return joined.groupBy("year", "quarter", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("j7_dimension_attribute", f"{CALC} SELECT product_id, src_pos, title_group FROM calc")
def j7(spark, d):
    c = clean(spark, d)
    fact = deduplicated(c.select("product_id", "posted_date", *DETAILS_JOIN, "src_pos"))
    dim = dim_property_details(c)
    return null_safe_lookup(fact, dim, DETAILS_JOIN, ["title_group"]).select("product_id", "src_pos", "title_group")


@query(
    "j8_pending_rows",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def j8(spark, d):
    done = table(spark, d, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return pending(table(spark, d, "customer").select("c_custkey", "c_name"), done, "c_custkey")


@query(
    "j9_region_map",
    "SELECT n_name AS name, count(s_suppkey) AS n_suppliers, sum(CAST(s_acctbal AS DECIMAL(18,2)))::DOUBLE AS balance FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
)
def j9(spark, d):
    shapes = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    agg = table(spark, d, "supplier").groupBy("s_nationkey").agg(
        F.count("s_suppkey").alias("n_suppliers"), F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("balance")
    )
    joined = shapes.join(agg, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.select("name", F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"), "balance")


@query(
    "j10_scalar_back_to_rows",
    "SELECT o_orderkey, round(o_totalprice - (SELECT median(o_totalprice) FROM orders), 4) + 0.0::DOUBLE AS gap FROM orders",
)
def j10(spark, d):
    orders = table(spark, d, "orders")
    mid = exact_percentiles(orders, "o_totalprice", [0.5], ["m"]).select("m")
    rows = with_scalar(orders.select("o_orderkey", "o_totalprice"), "s", mid)
    return rows.select("o_orderkey", (F.round(F.col("o_totalprice") - F.col("s.m"), 4) + 0.0).alias("gap"))


@query(
    "j11_update_by_key",
    f"""{RAW}, upd AS (SELECT url, max(TRY_CAST(bedrooms AS DOUBLE)) AS frontage, CAST(NULL AS DOUBLE) AS road_width FROM listings
        WHERE city = 'Hà Nội' GROUP BY url)
        SELECT src_pos, l.url, CASE WHEN u.url IS NULL THEN TRY_CAST(l.frontage AS DOUBLE) ELSE u.frontage END AS frontage,
        CASE WHEN u.url IS NULL THEN TRY_CAST(l.road_width AS DOUBLE) ELSE u.road_width END AS road_width
        FROM listings l LEFT JOIN upd u ON l.url = u.url""",
)
def j11(spark, d):
    rows = typed(spark, d)
    base = rows.select("src_pos", "url", "frontage", "road_width")
    updates = rows.where(F.col("city") == "Hà Nội").groupBy("url").agg(
        F.max("bedrooms").cast("double").alias("frontage"), F.lit(None).cast("double").alias("road_width")
    )
    return update_by_key(base, updates, "url", ["frontage", "road_width"])
