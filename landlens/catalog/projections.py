"""Projections and type conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rules as R
from ..operators.clean import BOOL_COLUMNS, MODEL_NAMES, OUTPUT_ORDER, clean_listings, with_model_names
from ..operators.relational import ensure_columns
from ..sources.listings import raw_listings
from .checks import CLEAN, RAW, TYPED
from .frames import as_dates, as_doubles, clean, r6, typed
from .registry import query, table

_RENAMED = [c for c in MODEL_NAMES if c != "price_per_m2"]


@query(
    "p1_rename_columns",
    f"{RAW} SELECT product_id, " + ", ".join(f'{c} AS "{MODEL_NAMES[c]}"' for c in _RENAMED) + " FROM listings",
)
def p1(spark, d):
    return with_model_names(raw_listings(spark, d).select("product_id", *_RENAMED))


@query("p2_keep_columns", f"{RAW} SELECT city, district, ward, street, full_address FROM listings")
def p2(spark, d):
    return raw_listings(spark, d).select("city", "district", "ward", "street", "full_address")


@query("p3_drop_columns", "SELECT * EXCLUDE (n_regionkey) FROM nation")
def p3(spark, d):
    return table(spark, d, "nation").drop("n_regionkey")


@query(
    "p4_output_order",
    f"{CLEAN} SELECT * REPLACE (CAST(posted_date AS STRING) AS posted_date, CAST(expiry_date AS STRING) AS expiry_date) "
    f"FROM (SELECT {', '.join(OUTPUT_ORDER)} FROM clean)",
)
def p4(spark, d):
    return as_dates(as_doubles(clean(spark, d).select(*OUTPUT_ORDER)))


@query(
    "p5_computed_columns",
    f"{TYPED} SELECT product_id, src_pos, coalesce(area < 40 AND bedrooms >= 3, FALSE) AS is_overcrowded, "
    "coalesce(floors >= 4 AND road_width <= 4, FALSE) AS is_fire_risk FROM typed",
)
def p5(spark, d):
    return typed(spark, d).select(
        "product_id",
        "src_pos",
        R.overcrowded(F.col("area"), F.col("bedrooms")).alias("is_overcrowded"),
        R.fire_risk(F.col("floors"), F.col("road_width")).alias("is_fire_risk"),
    )


@query(
    "p6_declared_casts",
    f"{TYPED} SELECT product_id, price_total, area, frontage, road_width, bedrooms, bathrooms, floors, price_trend_1y, "
    "CAST(posted_date AS STRING) AS posted_date, CAST(expiry_date AS STRING) AS expiry_date FROM typed",
)
def p6(spark, d):
    cols = ["product_id", "price_total", "area", "frontage", "road_width", "bedrooms", "bathrooms", "floors", "price_trend_1y"]
    return as_dates(typed(spark, d).select(*cols, "posted_date", "expiry_date"))


@query(
    "p6_json_property_casts",
    "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def p6_events(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")
    )


@query("p7_text_to_boolean", f"{TYPED} SELECT product_id, src_pos, {', '.join(BOOL_COLUMNS)} FROM typed")
def p7(spark, d):
    return typed(spark, d).select("product_id", "src_pos", *BOOL_COLUMNS)


@query("p8_replace_spellings", f"{CLEAN} SELECT city, count(*) AS n FROM clean GROUP BY city")
def p8(spark, d):
    return (
        raw_listings(spark, d).replace(R.CITY_SPELLINGS, subset=["city"]).groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    )


@query("p9_fill_missing_rooms", f"{CLEAN} SELECT product_id, src_pos, bedrooms, bathrooms FROM clean")
def p9(spark, d):
    return clean_listings(raw_listings(spark, d), keep=["product_id", "bedrooms", "bathrooms"])


@query(
    "p10_coerce_and_drop",
    f"{RAW} SELECT src_pos, TRY_CAST(road_width AS DOUBLE) AS road_width FROM listings WHERE TRY_CAST(road_width AS DOUBLE) IS NOT NULL",
)
def p10(spark, d):
    rows = raw_listings(spark, d).select("src_pos", N.to_double(F.col("road_width")).alias("road_width"))
    return rows.dropna(subset=["road_width"])


@query(
    "p11_ensure_columns",
    f"{RAW} SELECT product_id, frontage, CAST(NULL AS DOUBLE) AS balcony, CAST(NULL AS STRING) AS view_note FROM listings",
)
def p11(spark, d):
    rows = raw_listings(spark, d).select("product_id", "frontage")
    return ensure_columns(rows, {"frontage": "double", "balcony": "double", "view_note": "string"})


@query("p12_price_in_billions", f"{TYPED} SELECT product_id, src_pos, round(price_total / 1000, 6) + 0.0::DOUBLE AS price_billion FROM typed")
def p12(spark, d):
    return typed(spark, d).select("product_id", "src_pos", r6(F.col("price_total") / 1000).alias("price_billion"))
