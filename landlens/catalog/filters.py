"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.numeric import exact_mean
from ..operators import measures as M
from ..operators.pages import is_blocked, page_links
from ..operators.quantiles import exact_percentiles
from ..operators.relational import needs_backfill
from ..sources.listings import raw_listings
from ..sources.tables import read_pages
from .checks import CALC, CLEAN, RAW, TYPED
from .frames import clean, r6, typed, view
from .registry import query, table


@query(
    "f1_dimension_filter_reaches_fact",
    "SELECT o_orderkey, o_totalprice, n_name FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_7')",
)
def f1(spark, d):
    nation = table(spark, d, "nation").where(F.col("n_name").isin("NATION_1", "NATION_7"))
    customer = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        table(spark, d, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "o_totalprice", "n_name")
    )


@query(
    "f1_city_filter",
    f"{CALC} SELECT city, count(DISTINCT product_id) AS n_listings FROM calc WHERE city IN ('Thành phố Hồ Chí Minh') GROUP BY city",
)
def f1_city(spark, d):
    rows = view(spark, d).where(F.col("city").isin("Thành phố Hồ Chí Minh"))
    return rows.groupBy("city").agg(M.listing_count().alias("n_listings"))


@query(
    "f2_exclusion_filter",
    f"{CALC} SELECT quality_group, count(*) AS n FROM calc WHERE quality_group NOT IN ('Pháp lý yếu + Hẻm nhỏ') GROUP BY quality_group",
)
def f2(spark, d):
    keep = ~F.col("quality_group").isin(R.QUALITY_WEAK_POOR[0])
    return view(spark, d).where(keep).groupBy("quality_group").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f2_exclusion_keeps_missing",
    f"{RAW} SELECT product_id, ward FROM listings WHERE ward IS NULL OR ward NOT IN ('Phường FURNITURE')",
)
def f2_nulls(spark, d):
    ward = F.col("ward")
    return raw_listings(spark, d).select("product_id", "ward").where(ward.isNull() | ~ward.isin("Phường FURNITURE"))


@query(
    "f3_inclusion_list",
    "SELECT n_nationkey, n_name FROM nation WHERE n_name IN (SELECT 'NATION_' || r_regionkey FROM region)",
)
def f3(spark, d):
    # A long list is a table: a semi join instead of a long IN.
    wanted = table(spark, d, "region").select(F.concat(F.lit("NATION_"), "r_regionkey").alias("n_name"))
    return table(spark, d, "nation").select("n_nationkey", "n_name").join(wanted, "n_name", "left_semi")


@query("f4_raw_column_filter", f"{TYPED} SELECT product_id, src_pos, area FROM typed WHERE area < 100")
def f4(spark, d):
    return typed(spark, d).select("product_id", "src_pos", "area").where(F.col("area") < 100)


@query(
    "f5_having_on_mean",
    f"{CALC} SELECT product_id, posted_date::STRING AS posted_date, plot_shape, round(avg(depth_ratio), 6) + 0.0::DOUBLE AS mean_ratio "
    "FROM calc GROUP BY ALL HAVING avg(depth_ratio) < 20",
)
def f5(spark, d):
    rows = view(spark, d).withColumn("posted_date", F.date_format("posted_date", "yyyy-MM-dd"))
    means = rows.groupBy("product_id", "posted_date", "plot_shape").agg(F.avg("depth_ratio").alias("mean_ratio"))
    return means.where(F.col("mean_ratio") < 20).withColumn("mean_ratio", r6(F.col("mean_ratio")))


@query("f6_slicer_values", "SELECT DISTINCT p_type FROM part")
def f6(spark, d):
    return table(spark, d, "part").select("p_type").distinct().orderBy("p_type")


@query(
    "f6_slicer_selection",
    f"{CALC} SELECT property_class, count(DISTINCT product_id) AS n_listings FROM calc WHERE property_class = 'Tòa nhà / CHDV' GROUP BY 1",
)
def f6_selected(spark, d):
    rows = view(spark, d).where(F.col("property_class") == R.SERVICED)
    return rows.groupBy("property_class").agg(M.listing_count().alias("n_listings"))


@query(
    "f7_measure_with_own_filter",
    f"{CALC} SELECT city, (sum(CAST(unit_price AS DECIMAL(18,4))) FILTER (WHERE interior = 'Thô'))::DOUBLE / count(*) FILTER (WHERE interior = 'Thô' AND unit_price IS NOT NULL) AS bare_mean, sum(CAST(price_total AS BIGINT))::DOUBLE AS total FROM calc GROUP BY city",
)
def f7(spark, d):
    bare = F.when(F.col("interior") == "Thô", F.col("unit_price"))
    return view(spark, d).groupBy("city").agg(
        exact_mean(bare).alias("bare_mean"), F.sum("price_total").cast("double").alias("total")
    )


@query(
    "f8_blank_tolerant_filter",
    f"{TYPED} SELECT product_id, src_pos FROM typed WHERE coalesce(area, 0) <= 40 AND coalesce(bedrooms, 0) >= 3",
)
def f8(spark, d):
    return typed(spark, d).where(R.crowding(F.col("area"), F.col("bedrooms"))).select("product_id", "src_pos")


@query(
    "f9_guarded_flags",
    f"{CLEAN} SELECT coalesce(area < 40 AND bedrooms >= 3, FALSE) AS is_overcrowded, "
    "coalesce(floors >= 4 AND road_width <= 4, FALSE) AS is_fire_risk, count(*) AS n FROM clean GROUP BY ALL",
)
def f9(spark, d):
    return (
        clean(spark, d)
        .select(
            R.overcrowded(F.col("area"), F.col("bedrooms")).alias("is_overcrowded"),
            R.fire_risk(F.col("floors"), F.col("road_width")).alias("is_fire_risk"),
        )
        .groupBy("is_overcrowded", "is_fire_risk")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("f10_iterator_filter", f"{TYPED} SELECT count(*) AS n, count(DISTINCT product_id) AS ids FROM typed WHERE area IS NOT NULL AND area > 0")
def f10(spark, d):
    rows = typed(spark, d).where(F.col("area").isNotNull() & (F.col("area") > 0))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("product_id").alias("ids"))


@query(
    "f11_bedroom_box",
    f"{TYPED} SELECT has_dongtien_kw, quantile_cont(bedrooms, 0.25) AS q1, quantile_cont(bedrooms, 0.5) AS q2, "
    "quantile_cont(bedrooms, 0.75) AS q3 FROM typed WHERE bedrooms <= 20 GROUP BY 1",
)
def f11(spark, d):
    rows = typed(spark, d).where(F.col("bedrooms") <= 20)
    return exact_percentiles(rows, "bedrooms", [0.25, 0.5, 0.75], ["q1", "q2", "q3"], by=["has_dongtien_kw"]).drop("n")


_BLOCKED_SQL = """(html IS NULL OR html = ''
  OR contains(lower(html), '<title>just a moment</title>') OR contains(lower(html), 'cf-challenge-running')
  OR contains(lower(html), 'cf_chl_opt') OR contains(lower(html), 'cf-challenge-hcaptcha')
  OR contains(lower(html), 'attention required! | cloudflare') OR contains(lower(html), 'id="challenge-form"')
  OR contains(lower(html), 'id="challenge-running"')
  OR (length(html) < 15000 AND (contains(lower(html), 'cf-challenge') OR contains(lower(html), 'attention required'))))"""


@query("f12_blocked_pages", f"SELECT page_id, {_BLOCKED_SQL} AS blocked FROM pages")
def f12(spark, d):
    return read_pages(spark, d).select("page_id", is_blocked(F.col("html")).alias("blocked"))


# Each page is given markers by its id, so every branch of the rule is reached.
@query(
    "f12_blocked_markers",
    f"""WITH marked AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN html || '<div ID="Challenge-Form">' WHEN 1 THEN html || 'CF-Challenge'
      WHEN 2 THEN '' WHEN 3 THEN html || 'Attention required! | Cloudflare' ELSE html END AS html FROM pages)
      SELECT page_id, {_BLOCKED_SQL} AS blocked FROM marked""",
)
def f12_marked(spark, d):
    m = F.col("page_id") % 5
    html = (
        F.when(m == 0, F.concat("html", F.lit('<div ID="Challenge-Form">')))
        .when(m == 1, F.concat("html", F.lit("CF-Challenge")))
        .when(m == 2, "")
        .when(m == 3, F.concat("html", F.lit("Attention required! | Cloudflare")))
        .otherwise(F.col("html"))
    )
    return read_pages(spark, d).select("page_id", is_blocked(html).alias("blocked"))


@query(
    "f13_detail_links",
    f"""{RAW} SELECT DISTINCT url AS link FROM listings""",
)
def f13(spark, d):
    # One page per listing that links to the listing, to another host and to a list page.
    html = F.concat(
        F.lit('<a class="x" href="'), F.regexp_replace("url", "^https://nha.example.com", ""), F.lit('">a</a>'),
        F.lit('<a href="https://other.example.org/x-pr5">b</a><a href="/nha-dat-ban/p2">c</a>'),
    )
    pages = raw_listings(spark, d).select(
        F.col("src_pos").alias("page_id"), F.lit("https://nha.example.com/ban/p3?x=1").alias("url"), html.alias("html")
    )
    return page_links(pages, "nha.example.com").select("link").distinct()


@query(
    "f14_required_fields",
    f"""{TYPED} SELECT src_pos, CASE WHEN price_total IS NULL OR area IS NULL THEN 'no price or area' END AS reject_reason FROM typed""",
)
def f14(spark, d):
    rows = typed(spark, d)
    reason = F.when(F.col("price_total").isNull() | F.col("area").isNull(), "no price or area")
    return rows.select("src_pos", reason.alias("reject_reason"))


@query(
    "f15_backfill_candidates",
    f"{RAW} SELECT product_id, src_pos FROM listings WHERE trim(coalesce(url, '')) <> '' AND "
    "(coalesce(lower(trim(frontage)), '') IN ('', 'nan') OR coalesce(lower(trim(road_width)), '') IN ('', 'nan'))",
)
def f15(spark, d):
    return needs_backfill(raw_listings(spark, d), "url", ["frontage", "road_width"]).select("product_id", "src_pos")
