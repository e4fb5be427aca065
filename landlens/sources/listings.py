"""Raw listing records derived from the benchmark tables.

One plain SELECT that Spark SQL and a checking engine run unchanged. Every
cell is text, as a CSV scan delivers it: numbers with blanks and bad cells,
booleans in mixed spelling, Vietnamese labels that reach every rule branch.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt, materialise

BASE_TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")

LISTINGS_CTE = """
listing_base AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice,
         l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus, l.l_shipdate,
         o.o_orderdate, o.o_orderpriority, c.c_acctbal, c.c_mktsegment, n.n_nationkey, r.r_regionkey,
         p.p_name, p.p_size, p.p_type,
         l.l_orderkey * 10 + l.l_linenumber AS pid
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
listing_place AS (
  SELECT b.*,
    CASE r_regionkey WHEN 0 THEN 'Hồ Chí Minh' WHEN 1 THEN 'Hà Nội' WHEN 2 THEN 'Bà Rịa Vũng Tàu'
                     WHEN 3 THEN 'Hòa Bình' ELSE 'Đà Nẵng' END AS city,
    CASE WHEN n_nationkey < 14 THEN 'Quận ' || CAST(n_nationkey + 1 AS STRING)
         ELSE 'Huyện ' || CAST(n_nationkey + 1 AS STRING) END AS district,
    CASE WHEN l_partkey % 19 = 4 THEN NULL ELSE 'Phường ' || c_mktsegment END AS ward,
    CASE l_suppkey % 5 WHEN 0 THEN 'Đường D' || CAST(l_suppkey % 9 AS STRING)
                       WHEN 1 THEN 'Hẻm ' || CAST(l_suppkey % 7 AS STRING)
                       WHEN 2 THEN 'Quốc lộ ' || CAST(l_suppkey % 4 AS STRING)
                       WHEN 3 THEN 'TL' || CAST(l_suppkey % 6 AS STRING)
                       ELSE NULL END AS street,
    'Bán nhà ' || p_name || ' ' || lower(p_type) AS title,
    CASE l_partkey % 6
      WHEN 0 THEN 'Chủ kẹt tiền bán gấp! Sổ riêng! Giá tốt.'
      WHEN 1 THEN 'SIÊU PHẨM duy nhất, có thang máy, gần công viên.'
      WHEN 2 THEN 'Dòng tiền ổn định, cho thuê full phòng 20 triệu/tháng.'
      WHEN 3 THEN 'Nhà vi bằng, giấy tay, hẻm yên tĩnh'
      WHEN 4 THEN 'Mặt tiền đường lớn, view thông thoáng, bờ sông.'
      ELSE 'Nhà ở ngay' END AS phrase
  FROM listing_base b
),
listings AS (
  SELECT
    CAST(pid AS STRING) AS product_id,
    title,
    'https://nha.example.com/ban-nha-' || CAST(l_partkey AS STRING) || '-pr' || CAST(pid AS STRING) AS url,
    city, district, ward, street,
    concat_ws(', ', street, ward, district, city) AS full_address,
    CASE WHEN l_partkey % 23 = 7 THEN NULL ELSE phrase END AS description,
    CASE WHEN l_partkey % 29 = 3 THEN NULL
         ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END AS price_total,
    CASE WHEN l_partkey % 31 = 1 THEN NULL WHEN l_partkey % 31 = 2 THEN '0'
         WHEN l_partkey % 31 = 3 THEN 'không rõ'
         ELSE CAST(CAST(l_quantity * 3 AS DECIMAL(10,1)) AS STRING) END AS area,
    CASE WHEN l_suppkey % 13 = 1 THEN NULL WHEN l_suppkey % 13 = 2 THEN '0' WHEN l_suppkey % 13 = 3 THEN ''
         ELSE CAST(CAST(p_size * 0.5 + (l_linenumber % 3) * 0.13 AS DECIMAL(10,2)) AS STRING) END AS frontage,
    CASE WHEN l_suppkey % 11 = 1 THEN NULL WHEN l_suppkey % 11 = 2 THEN 'n/a'
         ELSE CAST(CAST(p_size * 0.9 AS DECIMAL(10,1)) AS STRING) END AS road_width,
    CASE WHEN l_suppkey % 7 = 1 THEN NULL WHEN l_partkey % 17 = 3 THEN '35'
         ELSE CAST(1 + l_partkey % 12 AS STRING) END AS bedrooms,
    CASE WHEN l_suppkey % 7 = 2 THEN NULL WHEN l_partkey % 37 = 3 THEN '18'
         ELSE CAST(1 + l_partkey % 8 AS STRING) END AS bathrooms,
    CASE WHEN l_partkey % 15 = 6 THEN NULL ELSE CAST(l_linenumber AS STRING) END AS floors,
    CASE WHEN l_suppkey % 17 = 4 THEN NULL
         ELSE CAST(CAST(c_acctbal / 40 AS DECIMAL(18,5)) AS STRING) END AS price_trend_1y,
    CASE p_size % 7 WHEN 0 THEN 'Đông' WHEN 1 THEN ' Tây - Nam ' WHEN 2 THEN '' WHEN 3 THEN NULL
                    WHEN 4 THEN 'Bắc' WHEN 5 THEN 'Nam' ELSE 'Đông - Bắc' END AS direction,
    CASE p_size % 11 WHEN 0 THEN 'Đầy đủ.' WHEN 1 THEN 'Nội thất hiện đại' WHEN 2 THEN 'Bàn giao thô'
                     WHEN 3 THEN 'Nhà trống' WHEN 4 THEN 'Sổ photo' WHEN 5 THEN NULL WHEN 6 THEN ' ? '
                     WHEN 7 THEN 'Cơ bản CĐT' WHEN 8 THEN 'Full, máy lạnh' WHEN 9 THEN 'Để lại nội thất'
                     ELSE 'Như cũ' END AS interior,
    CASE p_size % 10 WHEN 0 THEN 'Sổ hồng/Sổ đỏ' WHEN 1 THEN 'Sổ chung.' WHEN 2 THEN 'Hợp đồng mua bán'
                     WHEN 3 THEN 'HĐMB...' WHEN 4 THEN ' SHR. ' WHEN 5 THEN 'Đang chờ sổ' WHEN 6 THEN 'Đang làm hồ sơ'
                     WHEN 7 THEN 'Giấy tay' WHEN 8 THEN NULL ELSE 'Sổ đỏ' END AS legal_status,
    CASE o_orderpriority WHEN '5-LOW' THEN 'Tin thường' WHEN '1-URGENT' THEN 'Tin VIP Kim Cương'
                         WHEN '2-HIGH' THEN 'Tin VIP Vàng' WHEN '3-MEDIUM' THEN 'Tin VIP Bạc' ELSE NULL END AS post_rank,
    CASE l_linenumber % 4 WHEN 0 THEN ' True ' WHEN 1 THEN 'FALSE' WHEN 2 THEN '' ELSE NULL END AS has_elevator,
    CASE l_suppkey % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'False' ELSE 'x' END AS near_park,
    CASE l_suppkey % 2 WHEN 0 THEN 'true' ELSE 'false' END AS is_frontage_road,
    CASE WHEN l_partkey % 6 = 0 THEN 'True' ELSE 'False' END AS has_ngop_kw,
    CASE WHEN l_partkey % 6 = 1 THEN 'True' ELSE 'False' END AS has_marketing_kw,
    CASE WHEN l_partkey % 6 = 2 THEN 'True' ELSE 'False' END AS has_dongtien_kw,
    CASE WHEN l_partkey % 6 = 3 THEN 'True' ELSE 'False' END AS has_phaply_yeu_kw,
    CAST(length(phrase) AS STRING) AS desc_len,
    CASE WHEN l_partkey % 6 = 0 THEN '2' ELSE '0' END AS exclamation_count,
    CAST(CAST(l_discount AS DECIMAL(10,4)) AS STRING) AS caps_lock_ratio,
    CAST(CAST(o_orderdate AS DATE) AS STRING) AS posted_date,
    CASE WHEN l_partkey % 43 = 9 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS expiry_date,
    lpad(CAST(l_partkey AS STRING), 12, '0') || lpad(CAST(l_suppkey AS STRING), 12, '0')
      || lpad(CAST(CAST(l_quantity AS BIGINT) AS STRING), 6, '0')
      || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), 14, '0')
      || lpad(CAST(CAST(round(l_discount * 100) AS BIGINT) AS STRING), 3, '0')
      || lpad(CAST(CAST(round(l_tax * 100) AS BIGINT) AS STRING), 3, '0')
      || CAST(CAST(l_shipdate AS DATE) AS STRING) || l_returnflag || l_linestatus AS src_pos
  FROM listing_place
)
"""


# the joins of an order with its customer and place, and that of a line with its part, which come first
_ORDER_JOINS = re.compile(r"JOIN orders o ON .*?JOIN part p ON l\.l_partkey = p\.p_partkey", re.DOTALL)


def raw_listings(spark: SparkSession, sf_dir: str, staged: bool = False) -> DataFrame:
    """All raw records as text columns; `src_pos` orders rows like a file does.

    ``staged``, for callers that read them several times: the joined tables are written once, and records are made from there.

    Lines are dealt by their order, which the join with orders asks for anyway: a table may be one
    file with one row group, and its rows would stay in one task behind broadcast joins. Joins follow the text but for two
    things: customers meet the orders before the lines do, for there are several lines to an order and a large customer table
    would have all lines shuffled for it; and parts meet the lines before the orders do, for a large part table has the lines
    shuffled for it, which then are narrow.
    """
    base = {name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet") for name in BASE_TABLES}
    parted = base["lineitem"].join(base.pop("part"), F.col("l_partkey") == F.col("p_partkey"))
    base["lineitem"] = dealt(parted, "l_orderkey")
    places = base.pop("nation").join(base.pop("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = base["orders"].join(base.pop("customer"), F.col("o_custkey") == F.col("c_custkey"))
    # dealt too, for rows of a small table would follow the few parts of this one
    base["orders"] = dealt(orders.join(places, F.col("c_nationkey") == F.col("n_nationkey")), "o_orderkey")
    sql = _ORDER_JOINS.sub("JOIN orders ON l.l_orderkey = o_orderkey", LISTINGS_CTE)
    sql = re.sub(r"\b[ocnrp]\.(?=[ocnrp]_)", "", sql)
    sql = re.sub(r"\b(FROM|JOIN) (%s)\b" % "|".join(BASE_TABLES), r"\1 {\2}", sql)
    if staged:
        joined, sql = sql.split("listing_place AS", 1)
        joined = spark.sql(f"WITH {joined.rstrip().rstrip(',')} SELECT * FROM listing_base", **base)
        base = {"listing_base": materialise(joined, "listing-base", compression="zstd")}
        sql = "listing_place AS" + sql.replace("FROM listing_base", "FROM {listing_base}")
    return spark.sql(f"WITH {sql} SELECT * FROM listings", **base)
