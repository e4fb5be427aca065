"""Listing pages rendered from the part table: one detail page per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt

SITE = "nha.example.com"


def _comma(x: Column) -> Column:
    return F.regexp_replace(x.cast("decimal(18,2)").cast("string"), r"\.", ",")


def _spec(title: str, value: Column) -> Column:
    return F.concat(
        F.lit('<div class="re__pr-specs-content-item"><span class="icon"></span><span class="re__pr-specs-content-item-title">'),
        F.lit(title), F.lit('</span><span class="re__pr-specs-content-item-value">'), value, F.lit("</span></div>\n"),
    )


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and html; some pages are blocked or lack their prices.

    Parts are dealt by their key before pages are rendered: the table may be one file with one row group.
    """
    part = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    part = dealt(part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "p_partkey")
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    when = lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise("")
    info = F.concat(
        F.lit('<div class="re__pr-short-info js"><div class="re__pr-short-info-item js__pr"><span class="title">Khoảng giá</span><div><span class="value">'),
        _comma(F.col("p_retailprice")), F.lit(' tỷ</span></div><span class="ext">~'), _comma(size * 1.5),
        F.lit(" triệu/m²</span></div><div class='re__pr-short-info-item'><span class=\"title\">Loại tin</span><span class=\"value\">Tin VIP "),
        F.col("p_type"), F.lit("</span></div></div>\n"),
    )
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>Nhà "), F.col("p_name"), F.lit(" | nha.example.com - bán</title><script>var a='<h1>x</h1>';</script><style>.re__pr-short-info-item{}</style></head><body>\n"),
        when(k % 2 == 0, F.lit("<h1 class='t'>Nhà <b>"), F.col("p_name"), F.lit("</b> &amp; s&#226;n</h1>")),
        when(k % 3 == 0, F.lit('<div data-x="1" id="product-detail-web" prid="P'), text(k), F.lit('">..</div>')),
        F.lit('<span class="re__pr-short-description re__address-line-1 x">Đường D'), text(size), F.lit(",  Phường "), F.col("p_brand"), F.lit(", Quận "), text(size), F.lit(", Hồ Chí Minh</span>\n"),
        when(k % 50 != 9, info),
        _spec("Diện tích", F.concat(_comma(size * 3), F.lit(" m<sup>²</sup>"))),
        when(k % 4 != 0, _spec("Mặt tiền", F.concat(_comma(size * 0.5), F.lit(" m")))),
        when(k % 8 == 0, F.lit('<span class="ext">Mặt tiền 7,5 m</span>')),
        _spec("Đường vào", F.concat(_comma(size * 0.9), F.lit(" m"))),
        _spec("Số phòng ngủ", F.concat(text(size % 7), F.lit(" phòng"))),
        _spec("Số phòng tắm, vệ sinh", F.concat(text(1 + size % 5), F.lit(" phòng"))),
        _spec("Số tầng", F.concat(text(1 + size % 6), F.lit(" tầng"))),
        _spec("Hướng nhà", F.lit("Đông - Nam")),
        _spec("Pháp lý", F.lit("Sổ đỏ&#x2F;Sổ hồng")),
        _spec("Nội thất", F.lit("Đầy &nbsp;đủ")),
        F.lit('<div class="re__block-ldp-pricing-cta re__'), F.when(k % 2 == 1, "down").otherwise("up"), F.lit('-trend"><div><span class="cta-number">'), _comma(size * 0.1), F.lit("%</span></div></div>\n"),
        F.lit('<div class="meter-range"><span class="min">'), text(size), F.lit('</span>-<span class="max">'), text(size * 2), F.lit("</span></div>\n"),
        when(k % 2 == 0, F.lit('<i class="marking-product__KYC"></i>')),
        when(k % 5 == 0, F.lit("<p>Có thang máy</p>")),
        F.lit("<p>Ngày đăng 01/02/2024</p><p>Ngày hết hạn 15/03/2024</p>"),
        F.lit('<a href="/ban/nha-pr'), text(k + 1), F.lit('">sau</a><a href="https://other.example.org/x-pr1">ngoài</a><a href=\'nha-'), text(k), F.lit("-pr"), text(k), F.lit("?ref=1'>này</a>"),
        when(k % 50 == 7, F.lit("<div class='CF-Challenge'></div>")),
        F.lit("</body></html>"),
    )
    url = F.concat(F.lit(f"https://{SITE}/ban-nha-"), F.lower("p_type"), F.lit("-pr"), text(k))
    return part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))
