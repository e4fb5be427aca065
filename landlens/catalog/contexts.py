"""Filter-context operators, sequence keys, ordering, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import bin_floor, blank_as_zero, exact_mean
from ..operators import measures as M
from ..operators.profile import sample_rows, top_values
from ..operators.relational import first_per_key, first_seen, grow_set, pending, sequence_order_sql, with_sequence_key
from ..operators.star import with_price_segment
from ..sources.listings import raw_listings
from ..sources.tables import read_pages
from .checks import CALC, CLEAN, RAW
from .frames import clean, view
from .registry import query, table


def order_bins(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("product_id"), bin_floor(F.col("o_totalprice"), 25000.0).alias("bin"), "o_totalprice"
    )
    return rows


_BINS = "bins AS (SELECT floor(o_totalprice / 25000) * 25000 AS bin, count(DISTINCT o_orderkey) AS n_listings, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)"


@query(
    "w1_share_of_selection",
    "WITH s AS (SELECT * FROM orders WHERE o_orderstatus <> 'P') SELECT o_orderpriority, count(*)::DOUBLE / (SELECT count(*) FROM s) AS share FROM s GROUP BY 1",
)
def w1(spark, d):
    selected = table(spark, d, "orders").where(F.col("o_orderstatus") != "P")
    whole = M.overall(selected, F.count(F.lit(1)))
    groups = selected.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return groups.select("o_orderpriority", (F.col("n").cast("double") / whole).alias("share"))


@query(
    "w2_whole_table_threshold",
    f"{CALC} SELECT city, count(*) FILTER (WHERE price_total <= (SELECT quantile_cont(price_total, 0.25) FROM calc)) AS low_priced FROM calc WHERE city <> 'Hà Nội' GROUP BY city",
)
def w2(spark, d):
    v = view(spark, d)
    marked = with_price_segment(v.where(F.col("city") != "Hà Nội"), whole=v)
    return marked.groupBy("city").agg(F.count_if(F.col("segment_order") == 1).alias("low_priced"))


@query(
    "w3_mean_of_own_type",
    "SELECT p_partkey, p_type, (sum(p_retailprice::DECIMAL(18,2)) OVER (PARTITION BY p_type))::DOUBLE / count(*) OVER (PARTITION BY p_type) AS type_mean FROM part",
)
def w3(spark, d):
    # The type has few values, so mean per type plus a lookup beats a window over rows.
    part = table(spark, d, "part").select("p_partkey", "p_type", F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    means = part.groupBy("p_type").agg(exact_mean(F.col("price")).alias("type_mean"))
    return part.drop("price").join(means, "p_type")


@query(
    "w3_mean_without_type_filter",
    f"{CALC} SELECT sum(unit_price::DECIMAL(18,4))::DOUBLE / count(unit_price) AS type_mean FROM calc WHERE property_class IN ('Tòa nhà / CHDV')",
)
def w3_selected(spark, d):
    return M.mean_by_type(view(spark, d), ["Tòa nhà / CHDV"])


@query(
    "w4_peak_marker",
    f"WITH {_BINS} SELECT bin, n_listings, CASE WHEN n_listings = (SELECT max(n_listings) FROM bins) THEN n_listings END AS peak, (SELECT max(n_listings) FROM bins) AS max_line FROM bins",
)
def w4(spark, d):
    return M.with_peak(M.bins(order_bins(spark, d), "bin"))


@query("w5_reference_line", f"WITH {_BINS} SELECT max(n_listings) AS max_line FROM bins")
def w5(spark, d):
    return M.bins(order_bins(spark, d), "bin").agg(F.max("n_listings").alias("max_line"))


@query(
    "w6_highlight_class",
    f"""WITH {_BINS}, s AS (SELECT (SELECT min(bin) FROM bins WHERE n_listings = (SELECT max(n_listings) FROM bins)) AS peak, (SELECT avg(o_totalprice) FROM orders) AS mean)
    SELECT bin, CASE WHEN hi BETWEEN peak - 30000 AND peak + 30000 OR mean BETWEEN lo AND hi THEN 'highlight' ELSE 'neutral' END AS colour FROM bins, s""",
)
def w6(spark, d):
    rows = order_bins(spark, d)
    extra = [F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")]
    binned = M.with_peak(M.bins(rows, "bin", extra))
    peak = M.overall(binned.where(F.col("peak").isNotNull()), F.min("bin"))
    marked = binned.withColumns({"peak_at": peak, "mean": M.overall(rows, F.avg("o_totalprice"))})
    colour = M.highlight(F.col("lo"), F.col("hi"), F.col("peak_at"), F.col("mean"), radius=30000.0)
    return marked.select("bin", colour.alias("colour"))


@query(
    "w7_cheap_bins",
    f"{CALC}, lim AS (SELECT quantile_cont(unit_price, 0.05) AS p05 FROM calc) SELECT unit_price_bin5, coalesce(unit_price_bin5, 0) < p05 AS is_cheap, count(DISTINCT product_id) AS n_listings FROM calc, lim GROUP BY ALL",
)
def w7(spark, d):
    v = view(spark, d)
    binned = M.bins(v, "unit_price_bin5")
    return binned.withColumn("is_cheap", blank_as_zero(F.col("unit_price_bin5")) < M.cheap_limit(v))


@query(
    "w8_sequence_key",
    f"SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY {sequence_order_sql(['c_custkey'])}) AS customer_skey FROM customer",
)
def w8(spark, d):
    return with_sequence_key(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"], "customer_skey")


@query(
    "w9_first_row_per_key",
    f"{CLEAN} SELECT product_id, posted_date::STRING AS posted_date, src_pos, price_total FROM dedup",
)
def w9(spark, d):
    rows = clean(spark, d).select("product_id", "posted_date", F.col("price_total").cast("double"), "src_pos")
    out = first_per_key(rows, ["product_id", "posted_date"], ["src_pos"])
    return out.withColumn("posted_date", F.date_format("posted_date", "yyyy-MM-dd"))


@query(
    "w9_first_line_per_order",
    "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1",
)
def w9_lines(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = table(spark, d, "lineitem").select("l_orderkey", *order)
    return first_per_key(rows, ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_quantity")


@query(
    "w10_first_value_per_page",
    "SELECT page_id, regexp_extract(html, '<p>(.*?)</p>', 1) AS first_paragraph FROM pages WHERE regexp_matches(html, '<p>.*?</p>')",
)
def w10(spark, d):
    paragraphs = F.posexplode(F.regexp_extract_all("html", F.lit(r"<p>([^\n]*?)</p>"), F.lit(1)))
    found = read_pages(spark, d).select("page_id", paragraphs.alias("pos", "text")).where(F.col("text").isNotNull())
    return found.groupBy("page_id").agg(F.min_by("text", "pos").alias("first_paragraph"))


@query(
    "k1_sort_by_aggregate",
    "SELECT n_regionkey, count(*) AS n, max(n_name) AS last_name FROM nation GROUP BY 1 ORDER BY 3 DESC",
)
def k1(spark, d):
    out = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.max("n_name").alias("last_name"))
    return out.orderBy(F.desc("last_name"))


@query(
    "k2_sort_label_by_order_column",
    f"{CALC} SELECT DISTINCT plot_shape, plot_shape_order, quality_group, quality_order FROM calc",
)
def k2(spark, d):
    cols = ["plot_shape", "plot_shape_order", "quality_group", "quality_order"]
    return view(spark, d).select(*cols).distinct().orderBy("plot_shape_order", "quality_order")


@query(
    "k3_top_with_ties_joined",
    """WITH b AS (SELECT o_orderpriority || '/' || o_orderstatus AS label, max(o_orderdate) AS x FROM orders GROUP BY 1),
    t AS (SELECT label FROM b WHERE x = (SELECT max(x) FROM b)) SELECT string_agg(label, ', ' ORDER BY label) AS labels FROM t""",
)
def k3(spark, d):
    label = F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("label")
    binned = table(spark, d, "orders").groupBy(label).agg(F.max("o_orderdate").alias("x"))
    top = binned.where(F.col("x") == M.overall(binned, F.max("x")))
    return top.agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("labels"))


@query(
    "k3_peak_bin_label",
    "WITH b AS (SELECT floor(l_quantity / 5) * 5 AS bin, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) "
    "SELECT string_agg(printf('%.2f', bin), ', ' ORDER BY bin) AS peak_bins FROM b WHERE n = (SELECT max(n) FROM b)",
)
def k3_bins(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("product_id"), bin_floor(F.col("l_quantity"), 5.0).alias("bin"))
    return M.peak_bins(M.bins(rows, "bin"), "bin")


@query(
    "k4_top_values",
    """WITH v AS (SELECT 'p_brand' AS name, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM v) SELECT * FROM r WHERE rank <= 5""",
)
def k4(spark, d):
    return top_values(table(spark, d, "part"), ["p_brand", "p_type"], 5)


@query("k5_sample_rows", "SELECT r_regionkey::STRING AS r_regionkey, coalesce(r_name, 'NaN') AS r_name FROM region ORDER BY r_regionkey LIMIT 3")
def k5(spark, d):
    return sample_rows(table(spark, d, "region"), ["r_regionkey"], 3)


@query("k6_sort_by_rate", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*) AS rate FROM orders GROUP BY 1 ORDER BY 2")
def k6(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(M.share(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("rate")).orderBy("rate")


@query("k7_latest_entries", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def k7(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "event_type").limit(10)


@query(
    "k8_top_k_parameter",
    "SELECT n_name, sum(CAST(s_acctbal AS DECIMAL(18,2)))::DOUBLE / count(*) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def k8(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    means = rows.groupBy("n_name").agg(exact_mean(F.col("s_acctbal").cast("decimal(18,2)")).alias("mean"))
    return means.orderBy(F.desc("mean"), "n_name").limit(10)


@query("u1_distinct_rows", f"{CLEAN} SELECT DISTINCT direction, interior, legal_status, legal_class, post_rank FROM clean")
def u1(spark, d):
    return clean(spark, d).select("direction", "interior", "legal_status", "legal_class", "post_rank").distinct()


@query("u2_distinct_on_keys", f"{RAW} SELECT DISTINCT city, district, ward, street, full_address FROM listings")
def u2(spark, d):
    cols = ["city", "district", "ward", "street", "full_address"]
    return raw_listings(spark, d).select(*cols).dropDuplicates(cols)


@query(
    "u3_first_seen_links",
    "SELECT l_partkey, min(row(l_orderkey, l_linenumber))[1] AS first_order, min(row(l_orderkey, l_linenumber))[2] AS first_line FROM lineitem GROUP BY 1",
)
def u3(spark, d):
    seen = first_seen(table(spark, d, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber"])
    return seen.select("l_partkey", F.col("first_at.l_orderkey").alias("first_order"), F.col("first_at.l_linenumber").alias("first_line"))


@query("u4_set_difference", "SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def u4(spark, d):
    orders = table(spark, d, "orders")
    return pending(orders.select("o_custkey").distinct(), orders.where(F.col("o_orderpriority") == "5-LOW"), "o_custkey")


@query("u5_grow_processed_set", "SELECT url FROM pages UNION SELECT replace(url, 'http:', 'https:') FROM pages")
def u5(spark, d):
    pages = read_pages(spark, d)
    return grow_set(pages, pages.select(F.replace("url", F.lit("http:"), F.lit("https:")).alias("url")), "url")
