"""Page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import clean_numeric
from ..operators import pages as P
from ..operators.relational import update_by_key
from ..sources.pages import SITE, listing_pages
from ..sources.tables import read_pages
from .frames import as_dates
from .registry import query

def as_of():
    return F.to_date(F.lit("2024-01-01"))


def quiet_pages(spark, d):
    return listing_pages(spark, d).select("page_id", "url", H.drop_silent(F.col("html")).alias("quiet"))


def cut_pages(spark, d):
    return quiet_pages(spark, d).withColumn("tags", H.tags(F.col("quiet")))


_FRONT = "CASE WHEN p_partkey % 8 = 0 THEN 7.5::DOUBLE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_size * 0.5)::DECIMAL(18,2)::DOUBLE END"
_ROAD = "(p_size * 0.9)::DECIMAL(18,2)::DOUBLE"
_PRICE = "CASE WHEN p_partkey % 50 <> 9 THEN p_retailprice::DECIMAL(18,2)::DOUBLE * 1000 END"
_TREND = "(CASE WHEN p_partkey % 2 = 1 THEN -1 ELSE 1 END) * (p_size * 0.1)::DECIMAL(18,2)::DOUBLE"
_TITLE = "'Nhà ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' & sân' ELSE '' END"
_ID = "CASE WHEN p_partkey % 3 = 0 THEN 'P' ELSE '' END || p_partkey::STRING"
_URL = "'https://nha.example.com/ban-nha-' || lower(p_type) || '-pr' || p_partkey"


@query(
    "h1_visible_text",
    r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>', ' ', 'g'), '(?s)<[a-zA-Z/!?][^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) > 0 AS has_text FROM pages""",
)
def h1(spark, d):
    return read_pages(spark, d).select("page_id", (F.length(H.page_text(F.col("html"))) > 0).alias("has_text"))


@query(
    "h1_text_of_plain_pages",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>', ' ', 'g'), '(?s)<[a-zA-Z/!?][^>]*>', ' ', 'g') AS t FROM pages)
    SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\s\x{a0}]+', ' ', 'g'))) AS digest FROM p""",
)
def h1_plain(spark, d):
    return read_pages(spark, d).select("page_id", F.md5(H.page_text(F.col("html")).cast("binary")).alias("digest"))


@query("h2_page_title", f"SELECT p_partkey AS page_id, {_TITLE} AS title FROM part")
def h2(spark, d):
    return cut_pages(spark, d).select("page_id", H.page_title("tags", SITE).alias("title"))


@query(
    "h3_page_links",
    "SELECT p_partkey AS page_id, 0 AS pos, 'https://nha.example.com/ban/nha-pr' || (p_partkey + 1) AS link FROM part UNION ALL "
    "SELECT p_partkey, 2, 'https://nha.example.com/nha-' || p_partkey || '-pr' || p_partkey || '?ref=1' FROM part",
)
def h3(spark, d):
    return P.page_links(listing_pages(spark, d), SITE)


@query("h3_links_of_given_pages", "SELECT page_id, 0 AS n FROM pages WHERE regexp_matches(html, 'href=\"[^\"]*-pr[0-9]+[?\"]')")
def h3_given(spark, d):
    return P.page_links(read_pages(spark, d), "example").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "h4_label_value_items",
    f"SELECT p_partkey AS page_id, (p_size % 7)::DOUBLE AS bedrooms, (1 + p_size % 5)::DOUBLE AS bathrooms, (1 + p_size % 6)::DOUBLE AS floors, 'Đông - Nam' AS direction, {_ROAD} AS road_width, 'Sổ đỏ/Sổ hồng' AS legal_status, 'Đầy đủ' AS interior FROM part",
)
def h4(spark, d):
    rows = cut_pages(spark, d).select("page_id", P.spec_items("tags").alias("specs"))
    v = lambda f: P.spec_value(F.col("specs"), f)
    numbers = [clean_numeric(v(f)).alias(f) for f in ("bedrooms", "bathrooms", "floors", "road_width")]
    return rows.select("page_id", *numbers, *[v(f).alias(f) for f in ("direction", "legal_status", "interior")])


@query("h5_area_and_frontage", f"SELECT p_partkey AS page_id, (p_size * 3)::DOUBLE AS area, {_FRONT} AS frontage FROM part")
def h5(spark, d):
    rows = cut_pages(spark, d).select("page_id", "tags", P.spec_items("tags").alias("specs"))
    return rows.select("page_id", P.area_value(F.col("specs")).alias("area"), P.frontage_value(F.col("specs"), "tags").alias("frontage"))


def _infos(spark, d):
    return cut_pages(spark, d).select("page_id", P.info_items("tags").alias("infos"))


@query("h6_total_price", f"SELECT p_partkey AS page_id, {_PRICE} AS price_total FROM part")
def h6(spark, d):
    return _infos(spark, d).select("page_id", P.total_price_value(F.col("infos")).alias("price_total"))


# The first number of the item is the total price: the rule is kept as it is.
@query("h7_unit_price", "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 50 <> 9 THEN p_retailprice::DECIMAL(18,2)::DOUBLE END AS price_per_m2 FROM part")
def h7(spark, d):
    return _infos(spark, d).select("page_id", P.unit_price_value(F.col("infos")).alias("price_per_m2"))


@query("h8_post_rank", "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 50 <> 9 THEN 'Tin VIP ' || p_type END AS post_rank FROM part")
def h8(spark, d):
    return _infos(spark, d).select("page_id", P.post_rank_value(F.col("infos")).alias("post_rank"))


@query("h9_price_trend", f"SELECT p_partkey AS page_id, {_TREND} AS price_trend_1y FROM part")
def h9(spark, d):
    return cut_pages(spark, d).select("page_id", P.price_trend_value("tags").alias("price_trend_1y"))


@query(
    "h10_range_address_id_verified",
    f"SELECT p_partkey AS page_id, p_size::DOUBLE AS lo, (p_size * 2)::DOUBLE AS hi, 'Đường D' || p_size || ', Phường ' || p_brand || ', Quận ' || p_size || ', Hồ Chí Minh' AS address, {_ID} AS product_id, p_partkey % 2 = 0 AS is_verified FROM part",
)
def h10(spark, d):
    found = cut_pages(spark, d).select(
        "page_id",
        P.price_range("tags").alias("range"),
        F.expr(H.first_text("tags", "re__address-line-1")).alias("address"),
        P.page_product_id(F.col("quiet"), F.col("url"), F.lit("")).alias("product_id"),
        P.is_verified("tags").alias("is_verified"),
    )
    return found.select("page_id", F.col("range.lo").alias("lo"), F.col("range.hi").alias("hi"), "address", "product_id", "is_verified")


def _comma(x: str) -> str:
    return f"replace(({x})::DECIMAL(18,2)::VARCHAR, '.', ',')"


_ADDRESS = "'Đường D' || p_size || ', Phường ' || p_brand || ', Quận ' || p_size || ', Hồ Chí Minh'"
# The visible text of a rendered page, which has no description section and so is the description.
_PAGE_TEXT = f"""concat_ws(' ', 'Nhà ' || p_name || ' | nha.example.com - bán', CASE WHEN p_partkey % 2 = 0 THEN 'Nhà ' || p_name || ' & sân' END,
  CASE WHEN p_partkey % 3 = 0 THEN '..' END, {_ADDRESS},
  CASE WHEN p_partkey % 50 <> 9 THEN 'Khoảng giá ' || {_comma("p_retailprice")} || ' tỷ ~' || {_comma("p_size * 1.5")} || ' triệu/m² Loại tin Tin VIP ' || p_type END,
  'Diện tích ' || {_comma("p_size * 3")} || ' m ²', CASE WHEN p_partkey % 4 <> 0 THEN 'Mặt tiền ' || {_comma("p_size * 0.5")} || ' m' END,
  CASE WHEN p_partkey % 8 = 0 THEN 'Mặt tiền 7,5 m' END, 'Đường vào ' || {_comma("p_size * 0.9")} || ' m', 'Số phòng ngủ ' || p_size % 7 || ' phòng',
  'Số phòng tắm, vệ sinh ' || (1 + p_size % 5) || ' phòng', 'Số tầng ' || (1 + p_size % 6) || ' tầng', 'Hướng nhà Đông - Nam Pháp lý Sổ đỏ/Sổ hồng Nội thất Đầy đủ',
  {_comma("p_size * 0.1")} || '%', p_size || ' - ' || p_size * 2, CASE WHEN p_partkey % 5 = 0 THEN 'Có thang máy' END,
  'Ngày đăng 01/02/2024 Ngày hết hạn 15/03/2024 sau ngoài này')"""
_MERGED = f"""SELECT {_ID} AS product_id, {_TITLE} AS title, {_URL} AS url, 'Hồ Chí Minh' AS city, 'Quận ' || p_size AS district, 'Phường ' || p_brand AS ward, 'Đường D' || p_size AS street,
  {_ADDRESS} AS full_address, {_PRICE} AS price_total, CASE WHEN p_partkey % 50 <> 9 THEN p_retailprice::DECIMAL(18,2)::DOUBLE END AS price_per_m2,
  p_size::DOUBLE AS price_min_range, (p_size * 2)::DOUBLE AS price_max_range, (p_size * 3)::DOUBLE AS area, {_FRONT} AS frontage, {_ROAD} AS road_width,
  p_size % 7 AS bedrooms, 1 + p_size % 5 AS bathrooms, 1 + p_size % 6 AS floors, 'Đông - Nam' AS direction, 'Đầy đủ' AS interior, 'Sổ đỏ/Sổ hồng' AS legal_status,
  CASE WHEN p_partkey % 50 <> 9 THEN 'Tin VIP ' || p_type ELSE '' END AS post_rank, {_TREND} AS price_trend_1y, p_partkey % 2 = 0 AS is_verified, p_partkey % 5 = 0 AS has_elevator,
  false AS near_park, false AS is_frontage_road, {_PAGE_TEXT} AS description, '2024-02-01' AS posted_date, '2024-03-15' AS expiry_date,
  CASE WHEN p_partkey % 50 = 7 THEN 'blocked page' WHEN p_partkey % 50 = 9 THEN 'no price or area' END AS reject_reason FROM part"""


def extracted(spark, d):
    return P.extract_listings(listing_pages(spark, d), SITE, as_of())


@query("h11_merge_priority", _MERGED)
def h11(spark, d):
    return as_dates(extracted(spark, d))


@query("h12_strict_backfill", f"SELECT {_URL} AS url, CASE WHEN p_partkey % 4 <> 0 THEN (p_size * 0.5)::DECIMAL(18,2)::DOUBLE END AS frontage, {_ROAD} AS road_width FROM part")
def h12(spark, d):
    pages = cut_pages(spark, d).select("url", P.spec_items("tags").alias("specs")).select("url", P.strict_fields(F.col("specs")).alias("f"))
    found = pages.select("url", F.col("f.frontage").alias("frontage"), F.col("f.road_width").alias("road_width"))
    base = listing_pages(spark, d).select("url", F.lit(None).cast("double").alias("frontage"), F.lit(None).cast("double").alias("road_width"))
    return update_by_key(base, found, "url", ["frontage", "road_width"])


@query("h13_valid_and_rejected", f"SELECT coalesce(reject_reason, 'valid') AS outcome, count(*) AS n FROM ({_MERGED}) GROUP BY 1")
def h13(spark, d):
    return extracted(spark, d).groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("q9_extract_listings", f"SELECT * EXCLUDE (reject_reason) FROM ({_MERGED}) WHERE reject_reason IS NULL")
def q9(spark, d):
    valid, _ = P.split_listings(listing_pages(spark, d), SITE, as_of())
    return as_dates(valid)


# Title, id and outcome of every given page by patterns of their own; a page with an id would go on to its location.
_SILENT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"
_DECODED = "replace(replace(replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_PLAIN = "trim(regexp_replace(" + _DECODED.format("regexp_replace({}, '(?s)<[a-zA-Z/!?][^>]*>', ' ', 'g')") + r", '[\s\x{{a0}}]+', ' ', 'g'))"


@query(
    "q9_extract_given_pages",
    rf"""WITH quiet AS (SELECT url, regexp_replace(html, '{_SILENT}', ' ', 'g') AS q FROM pages),
    cut AS (SELECT url, {_PLAIN.format(r"regexp_extract(q, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1)")} AS title,
      coalesce(nullif(regexp_extract(url, '(?i)pr(\d+)', 1), ''), regexp_extract({_PLAIN.format('q')}, '(?i)pr(\d+)', 1)) AS product_id FROM quiet)
    SELECT url, coalesce(nullif(title, ''), url) AS title, product_id, CASE WHEN product_id = '' THEN 'no product id' ELSE 'valid' END AS outcome FROM cut""",
)
def q9_given(spark, d):
    out = P.extract_listings(read_pages(spark, d), SITE, as_of())
    return out.select("url", "title", "product_id", F.coalesce("reject_reason", F.lit("valid")).alias("outcome"))
