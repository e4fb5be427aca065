"""String functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import description as D
from ..functions import text as T
from ..functions.address import address_parts, parse_address, parse_location, street_part
from ..functions.rules import (
    CASHFLOW_WORDS, DISTRESS_WORDS, HYPE_WORDS, WEAK_TITLE_WORDS, clean_label, direction_label, interior_label,
    strip_trailing_dots, title_label,
)
from ..sources.listings import raw_listings
from ..sources.tables import read_pages
from .checks import CLEAN, INTERIOR_SQL, RAW, TITLE_SQL, has
from .registry import query, table

_WS = r"[\s\x{0B}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NORM = rf"trim(regexp_replace(text, '{_WS}+', ' ', 'g'))"


def documents(spark, d):
    return table(spark, d, "documents")


@query("t1_normalize_text", f"SELECT doc_id, md5({_NORM}) AS digest FROM documents")
def t1(spark, d):
    return documents(spark, d).select("doc_id", F.md5(T.normalize_text(F.col("text")).cast("binary")).alias("digest"))


@query(
    "t2_normalized_lines",
    rf"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\x0B\f\r\x{{85}}\x{{2028}}\x{{2029}}\x1c-\x1e]')) AS text FROM documents)
    SELECT doc_id, count(*) AS n_lines, sum(length({_NORM})) AS n_chars FROM l WHERE {_NORM} <> '' GROUP BY 1""",
)
def t2(spark, d):
    lines = documents(spark, d).select("doc_id", F.explode(T.normalize_lines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("t3_strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def t3(spark, d):
    return documents(spark, d).select("doc_id", F.md5(T.strip_accents(F.col("text")).cast("binary")).alias("digest"))


@query("t3_strip_accents_listings", f"{RAW} SELECT src_pos, strip_accents(full_address) AS plain FROM listings")
def t3_listings(spark, d):
    return raw_listings(spark, d).select("src_pos", T.strip_accents(F.col("full_address")).alias("plain"))


@query("t4_canonical_key", f"SELECT doc_id, md5(lower(strip_accents({_NORM}))) AS digest FROM documents")
def t4(spark, d):
    return documents(spark, d).select("doc_id", F.md5(T.canonical(F.col("text")).cast("binary")).alias("digest"))


@query(
    "t5_delete_marks",
    "SELECT doc_id, md5(trim(regexp_replace(translate(text, '.,?', ''), '[\\x00-\\x1f\\x7f]', '', 'g'))) AS digest FROM documents",
)
def t5(spark, d):
    return documents(spark, d).select("doc_id", F.md5(clean_label(F.translate("text", ".,?", "")).cast("binary")).alias("digest"))


@query("t6_strip_trailing_dots", "SELECT doc_id, length(rtrim(trim(text), '.')) AS n FROM documents")
def t6(spark, d):
    return documents(spark, d).select("doc_id", F.length(strip_trailing_dots(F.col("text"))).alias("n"))


@query("t7_blank_to_unknown", f"{CLEAN} SELECT direction, count(*) AS n FROM clean GROUP BY 1")
def t7(spark, d):
    rows = raw_listings(spark, d).select(direction_label(F.col("direction")).alias("direction"))
    return rows.groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t8_interior_classes",
    f"{RAW}, x AS (SELECT lower(trim(translate(interior, '.,?', ''))) AS it FROM listings) SELECT {INTERIOR_SQL} AS interior, count(*) AS n FROM x GROUP BY 1",
)
def t8(spark, d):
    rows = raw_listings(spark, d).select(interior_label(F.col("interior")).alias("interior"))
    return rows.groupBy("interior").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t9_title_classes",
    f"{RAW}, x AS (SELECT rtrim(trim(legal_status), '.') AS lt FROM listings) SELECT {TITLE_SQL} AS legal_class, count(*) AS n FROM x GROUP BY 1",
)
def t9(spark, d):
    rows = raw_listings(spark, d).select(title_label(strip_trailing_dots(F.col("legal_status"))).alias("legal_class"))
    return rows.groupBy("legal_class").agg(F.count(F.lit(1)).alias("n"))


_FLAG_SQL = ", ".join(
    f"{has('low', *words)} AS {name}"
    for name, words in {
        "has_ngop_kw": DISTRESS_WORDS, "has_marketing_kw": HYPE_WORDS, "has_dongtien_kw": CASHFLOW_WORDS, "has_phaply_yeu_kw": WEAK_TITLE_WORDS,
    }.items()
)


@query("t10_keyword_flags", f"{RAW}, x AS (SELECT src_pos, product_id, lower(coalesce(description, '')) AS low FROM listings) SELECT src_pos, product_id, {_FLAG_SQL} FROM x")
def t10(spark, d):
    rows = raw_listings(spark, d).select("src_pos", "product_id", "description")
    return rows.withColumns(T.keyword_flags(F.col("description"))).drop("description")


@query("t10_keyword_flags_documents", f"WITH x AS (SELECT doc_id, lower(text) AS low FROM documents) SELECT doc_id, {_FLAG_SQL} FROM x")
def t10_docs(spark, d):
    return documents(spark, d).select("doc_id", *[c.alias(k) for k, c in T.keyword_flags(F.col("text")).items()])


@query(
    "t11_amenity_flags",
    f"""{RAW}, x AS (SELECT src_pos, product_id, lower(strip_accents(coalesce(description, ''))) AS k FROM listings)
    SELECT src_pos, product_id, regexp_matches(k, 'thang\\s*may|elevat') AS has_elevator, regexp_matches(k, 'cong\\s*vien|bo\\s*song|ho\\s*nuoc|view\\s*thong\\s*thoang') AS near_park,
    regexp_matches(k, 'mat\\s*tien\\s*duong|mat\\s*duong') AS is_frontage_road, regexp_matches(replace(k, 'đ', 'd'), 'mat\\s*tien\\s*duong|mat\\s*duong') AS is_frontage_road_folded FROM x""",
)
def t11(spark, d):
    rows = raw_listings(spark, d).select("src_pos", "product_id", "description")
    folded = T.description_flags(F.col("description"), fold_d=True)["is_frontage_road"].alias("is_frontage_road_folded")
    return rows.select("src_pos", "product_id", *[c.alias(k) for k, c in T.description_flags(F.col("description")).items()], folded)


@query(
    "t12_style_features",
    r"SELECT doc_id, length(text) AS desc_len, length(text) - length(replace(text, '!', '')) AS exclamation_count, round(length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))::DOUBLE / (length(text) + 1), 6) AS caps_lock_ratio FROM documents",
)
def t12(spark, d):
    f = T.style_features(F.col("text"))
    return documents(spark, d).select(
        "doc_id", f["desc_len"].alias("desc_len"), f["exclamation_count"].alias("exclamation_count"), F.round(f["caps_lock_ratio"], 6).alias("caps_lock_ratio")
    )


# Prices rendered in the four ways a page writes them; the number read back must be the price.
@query(
    "t13_number_from_text",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2))::DOUBLE AS european, CAST(l_extendedprice AS DECIMAL(18,2))::DOUBLE AS english, CAST(l_extendedprice AS DECIMAL(18,2))::DOUBLE AS comma_only, -CAST(l_quantity AS DOUBLE) AS negative FROM lineitem",
)
def t13(spark, d):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    english = F.format_number(price, 2)
    european = F.translate(english, ",.", ".,")
    plain = F.regexp_replace(price.cast("string"), r"\.", ",")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        T.clean_numeric(F.concat(F.lit("~ "), european, F.lit(" tỷ"))).alias("european"),
        T.clean_numeric(F.concat(F.lit("giá "), english, F.lit(" triệu/m²"))).alias("english"),
        T.clean_numeric(plain).alias("comma_only"),
        T.clean_numeric(F.concat(F.lit("-"), F.col("l_quantity").cast("int").cast("string"), F.lit("%"))).alias("negative"),
    )


_MONEY_SQL = "SELECT l_partkey, l_tax, CASE WHEN l_linenumber % 3 = 0 THEN {a} WHEN l_linenumber % 3 = 1 THEN {b} ELSE {c} END AS amount FROM (SELECT *, CAST(l_quantity AS BIGINT)::DOUBLE AS q FROM lineitem)"


def _money_text():
    m = F.col("l_linenumber") % 3
    q = F.col("l_quantity").cast("bigint").cast("string")
    return F.when(m == 0, F.concat(q, F.lit(" triệu/m²"))).when(m == 1, F.concat(q, F.lit(" tỷ"))).otherwise(F.concat(q, F.lit(" tr./m²")))


@query("t14_total_price_text", _MONEY_SQL.format(a="q / 1000", b="q", c="q / 1000"))
def t14(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_tax", T.parse_money_total(_money_text()).alias("amount"))


@query("t15_unit_price_text", _MONEY_SQL.format(a="q", b="q * 1000", c="q"))
def t15(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_tax", T.parse_money_per_m2(_money_text()).alias("amount"))


@query("t16_first_match", "SELECT doc_id, coalesce(nullif(regexp_extract(text, '(\\d+)\\s*%', 1), ''), nullif(regexp_extract(text, '\\b\\d{4}\\b', 0), '')) AS hit FROM documents")
def t16(spark, d):
    return documents(spark, d).select("doc_id", T.first_match(F.col("text"), [(r"(\d+)\s*%", 1), (r"\b\d{4}\b", 0)]).alias("hit"))


@query(
    "t17_figures_from_text",
    f"""{RAW} SELECT src_pos, product_id, TRY_CAST(frontage AS DOUBLE) AS frontage, TRY_CAST(road_width AS DOUBLE) AS road_width, TRY_CAST(area AS DOUBLE) AS area, TRY_CAST(price_total AS DOUBLE) AS price_total,
    TRY_CAST(bedrooms AS INT) AS bedrooms, TRY_CAST(bathrooms AS INT) AS bathrooms, TRY_CAST(floors AS INT) AS floors, posted_date FROM listings
    WHERE TRY_CAST(frontage AS DOUBLE) IS NOT NULL AND TRY_CAST(road_width AS DOUBLE) IS NOT NULL AND TRY_CAST(area AS DOUBLE) IS NOT NULL AND price_total IS NOT NULL AND bedrooms IS NOT NULL AND bathrooms IS NOT NULL AND floors IS NOT NULL""",
)
def t17(spark, d):
    r = raw_listings(spark, d)
    present = F.lit(True)
    for c in ("frontage", "road_width", "area", "price_total"):
        present = present & F.col(c).try_cast("double").isNotNull()
    for c in ("bedrooms", "bathrooms", "floors"):
        present = present & F.col(c).isNotNull()
    comma = lambda c: F.regexp_replace(c, r"\.", ",")
    text = F.concat(
        F.lit("Bán nhà "), "floors", F.lit(" tầng, "), "bedrooms", F.lit(" PN, "), "bathrooms", F.lit(" WC, Mặt tiền "), comma("frontage"),
        F.lit(" m, Đường vào "), comma("road_width"), F.lit(" m, Giá "), comma("price_total"), F.lit(" tỷ, Diện tích "), comma("area"),
        F.lit(" m². Ngày đăng "), F.date_format(F.to_date("posted_date"), "dd/MM/yyyy"),
    )
    rows = r.where(present).select("src_pos", "product_id", text.alias("text"))
    # composed in a projection of its own: every pattern reads it
    rows = rows.select("src_pos", "product_id", "text", T.compose(F.col("text")).alias("composed"))
    f = T.figures_of_composed(F.col("composed"), F.array("text"))
    keep = ["frontage", "road_width", "area", "price_total", "bedrooms", "bathrooms", "floors"]
    posted = F.date_format(f["posted_date"], "yyyy-MM-dd").alias("posted_date")
    return rows.select("src_pos", "product_id", *[f[k].alias(k) for k in keep], posted)


@query(
    "t18_line_lookup",
    f"{RAW} SELECT src_pos, product_id, nullif(trim(regexp_replace(coalesce(legal_status, ''), '\\s+', ' ', 'g')), '') AS below, 'Phường ' || city AS containing FROM listings WHERE coalesce(trim(legal_status), '') <> ''",
)
def t18(spark, d):
    text = F.concat(F.lit("Tin\nPháp  lý\n"), "legal_status", F.lit("\nPhường "), "city", F.lit("\nHết"))
    rows = raw_listings(spark, d).where(F.coalesce(F.trim("legal_status"), F.lit("")) != "").select("src_pos", "product_id", T.normalize_lines(text).alias("lines"))
    return rows.select(
        "src_pos", "product_id",
        T.find_line_after_label(F.col("lines"), ["Pháp lý", "Phap ly"]).alias("below"),
        T.find_line_containing(F.col("lines"), ["phường"]).alias("containing"),
    )


@query(
    "t19_address_split",
    f"{RAW} SELECT DISTINCT full_address, city, district, ward FROM listings",
)
def t19(spark, d):
    rows = raw_listings(spark, d).select("full_address").distinct()
    place = rows.withColumn("p", parse_address(F.col("full_address"), fold_d=True))
    return place.select("full_address", F.col("p.city").alias("city"), F.col("p.district").alias("district"), F.col("p.ward").alias("ward"))


@query("t20_street_part", f"{RAW} SELECT DISTINCT full_address, street FROM listings")
def t20(spark, d):
    rows = raw_listings(spark, d).select("full_address").distinct()
    return rows.select("full_address", street_part(address_parts(F.col("full_address"))).alias("street"))


@query(
    "t21_location_line",
    f"{RAW} SELECT DISTINCT title, full_address, city, district FROM listings",
)
def t21(spark, d):
    rows = raw_listings(spark, d).select("title", "full_address").distinct()
    page = F.concat(F.lit("Trang chủ\n"), "title", F.lit("\nGiá 5 tỷ\n"), "full_address", F.lit("\nquận khác, xã khác"))
    lines = rows.select("title", T.normalize_lines(page).alias("lines"))
    place = lines.withColumn("p", parse_location(F.col("lines"), F.col("title"), fold_d=True))
    return place.select("title", F.col("p.full_address").alias("full_address"), F.col("p.city").alias("city"), F.col("p.district").alias("district"))


@query("t22_description_section", f"{RAW} SELECT src_pos, product_id, coalesce(description, title) AS section FROM listings")
def t22(spark, d):
    r = raw_listings(spark, d)
    page = F.concat_ws("\n", "title", F.lit("Thông tin  mô tả"), "description", F.lit("Ngày đăng"), F.lit("01/01/2024"))
    return r.select("src_pos", "product_id", D.section_description(page, F.col("title")).alias("section"))


# A page text with chrome on both sides of the seller's words.
def _chrome():
    return F.concat(
        "title", F.lit(" Tải ứng dụng 0 1 Đăng nhập Đăng tin Thông tin mô tả : "), F.coalesce("description", F.lit("")),
        F.lit(" - - Nội dung: - dòng 3/5 hết. 2/ mục ${x.y} hai Ngày đăng 28/04/2026 Facebook"),
    )


_CLEANED = "coalesce(description || chr(10) || '- Nội dung:', 'Nội dung:') || chr(10) || '- dòng hết.' || chr(10) || '2/ mục hai'"


@query(
    "t23_cut_between_markers",
    f"{RAW} SELECT src_pos, product_id, trim(coalesce(description, 'Nội dung')) AS body FROM listings",
)
def t23(spark, d):
    text = F.concat(F.lit("đầu trang MÔ TẢ: "), F.coalesce("description", F.lit("- - Nội dung")), F.lit(" MÃ TIN 5 Loại tin"))
    rows = raw_listings(spark, d)
    return rows.select("src_pos", "product_id", D.trim_between_markers(text, "nha.example.com", "").alias("body"))


@query("t24_title_prefix", f"{RAW} SELECT src_pos, product_id, coalesce(description, 'x') AS rest FROM listings")
def t24(spark, d):
    text = F.concat(F.upper("title"), F.lit(" - : ."), F.coalesce("description", F.lit("x")))
    return raw_listings(spark, d).select("src_pos", "product_id", D.remove_title_prefix(text, F.col("title")).alias("rest"))


@query("t25_noise_words", f"{RAW} SELECT src_pos, product_id, trim(coalesce(description, '') || ' hết') AS rest FROM listings")
def t25(spark, d):
    text = F.concat(F.lit("đăng KÝ Xem tất cả 3/5 "), F.coalesce("description", F.lit("")), F.lit(" ${a} 0 1 Facebook hết"))
    return raw_listings(spark, d).select("src_pos", "product_id", D.remove_noise(text).alias("rest"))


@query(
    "t26_line_breaks",
    f"{RAW} SELECT src_pos, product_id, title || ':' || chr(10) || '- một.' || chr(10) || '- hai' || chr(10) || 'Đặc biệt, ba' || chr(10) || '4/ bốn' || chr(10) || '* năm' AS text FROM listings",
)
def t26(spark, d):
    text = F.concat("title", F.lit(": - một. - hai   Đặc biệt, ba 4/ bốn * năm"))
    return raw_listings(spark, d).select("src_pos", "product_id", D.format_description(text).alias("text"))


@query(
    "t27_clean_description",
    f"{RAW} SELECT src_pos, product_id, trim({_CLEANED}, chr(10) || ' ') AS cleaned FROM listings",
)
def t27(spark, d):
    r = raw_listings(spark, d)
    return r.select("src_pos", "product_id", D.clean_description(_chrome(), F.col("title"), "nha.example.com").alias("cleaned"))


@query("t28_product_id", f"{RAW} SELECT product_id AS expected, product_id AS found, src_pos FROM listings")
def t28(spark, d):
    return raw_listings(spark, d).select(F.col("product_id").alias("expected"), T.product_id(F.col("url")).alias("found"), "src_pos")


@query("t28_product_id_pages", "SELECT page_id, regexp_extract(lower(url), 'pr([0-9]+)', 1) AS found FROM pages")
def t28_pages(spark, d):
    return read_pages(spark, d).select("page_id", T.product_id(F.col("url")).alias("found"))
