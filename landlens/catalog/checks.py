"""SQL building blocks that the checking engine runs on the same tables."""

from __future__ import annotations

from ..sources.listings import LISTINGS_CTE

RAW = f"WITH {LISTINGS_CTE}"


def _bool(c: str) -> str:
    return f"CASE lower(trim({c})) WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS {c}"


TYPED_CTE = f"""
typed AS (
  SELECT CAST(product_id AS BIGINT) AS product_id, title, url, city AS raw_city, district, ward, street, full_address, description,
    CAST(round_even(TRY_CAST(price_total AS DOUBLE), 0) AS BIGINT) AS price_total,
    TRY_CAST(area AS DOUBLE) AS area, TRY_CAST(frontage AS DOUBLE) AS frontage,
    TRY_CAST(road_width AS DOUBLE) AS road_width, CAST(TRY_CAST(bedrooms AS DOUBLE) AS BIGINT) AS bedrooms,
    CAST(TRY_CAST(bathrooms AS DOUBLE) AS BIGINT) AS bathrooms, CAST(TRY_CAST(floors AS DOUBLE) AS BIGINT) AS floors,
    TRY_CAST(price_trend_1y AS DOUBLE) AS price_trend_1y,
    direction AS raw_direction, interior AS raw_interior, legal_status AS raw_legal, post_rank,
    {_bool('has_elevator')}, {_bool('near_park')}, {_bool('is_frontage_road')}, {_bool('has_ngop_kw')},
    {_bool('has_marketing_kw')}, {_bool('has_dongtien_kw')}, {_bool('has_phaply_yeu_kw')},
    CAST(desc_len AS BIGINT) AS desc_len, CAST(exclamation_count AS BIGINT) AS exclamation_count,
    CAST(caps_lock_ratio AS DOUBLE) AS caps_lock_ratio,
    TRY_CAST(posted_date AS DATE) AS posted_date, TRY_CAST(expiry_date AS DATE) AS expiry_date, src_pos
  FROM listings
),
med AS (
  SELECT median(road_width) AS m_road, median(frontage) AS m_front, median(bedrooms) AS m_bed,
         median(bathrooms) AS m_bath, median(price_trend_1y) AS m_trend
  FROM typed
)
"""


def has(c: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


INTERIOR_SQL = f"""CASE
  WHEN it IS NULL OR it = '' OR {has('it', 'sổ photo', 'tỷ', 'gu riêng', 'hoàn thiện bên ngoài', 'như hình')} THEN 'Không rõ'
  WHEN {has('it', 'trống')} THEN 'Không nội thất'
  WHEN {has('it', 'thô')} THEN 'Thô'
  WHEN {has('it', 'luxury', 'châu âu', 'nhật bản', 'nhập khẩu', 'cao cấp')}
    OR (contains(it, 'nội thất') AND {has('it', 'đẹp', 'hiện đại', 'tinh tế', 'sang trọng')}) THEN 'Cao cấp'
  WHEN {has('it', 'chủ đầu tư', 'cđt', 'mới nguyên', 'nguyên bản', 'cơ bản')} THEN 'Cơ bản'
  WHEN {has('it', 'ful', 'đủ nội thất', 'đầy đủ', 'có nội thất', 'có sẵn', 'xịn', 'dính tường', 'ở luôn', 'máy lạnh',
            'tủ bếp', 'sofa', 'tủ lạnh', 'giường', 'bếp', 'full', 'hoàn thiện nội thất', 'sẵn nội thất')}
    OR ({has('it', 'tặng', 'để lại')} AND {has('it', 'nội thất', 'full')}) THEN 'Đầy đủ'
  ELSE 'Không rõ' END"""

TITLE_SQL = f"""CASE
  WHEN lt IS NULL THEN NULL
  WHEN {has('lower(lt)', 'chung', 'sdc')} THEN 'Sổ chung'
  WHEN {has('lower(lt)', 'hợp đồng', 'hđmb', 'hdmb')} THEN 'Hợp đồng mua bán'
  WHEN {has('lower(lt)', 'sổ', 'sh', 'sr')} THEN 'Sổ hồng/Sổ đỏ'
  WHEN {has('lower(lt)', 'chờ', 'hồ sơ')} THEN 'Đang chờ sổ'
  ELSE 'Chưa xác định' END"""

CLEAN_CTE = f"""
labelled AS (
  SELECT t.*, m.*, lower(trim(translate(raw_interior, '.,?', ''))) AS it, rtrim(trim(raw_legal), '.') AS lt,
    coalesce(road_width, m_road) AS rw0, coalesce(frontage, m_front) AS fr0, coalesce(price_trend_1y, m_trend) AS tr0,
    CASE WHEN area IS NULL OR area = 0 THEN 0.0::DOUBLE ELSE CAST(price_total AS DOUBLE) / area END AS up0,
    coalesce(bedrooms, CAST(round_even(m_bed, 0) AS BIGINT)) AS bed1,
    coalesce(bathrooms, CAST(round_even(m_bath, 0) AS BIGINT)) AS bath1
  FROM typed t CROSS JOIN med m
),
rounded AS (
  SELECT *,
    CASE WHEN rw0 <= 15 THEN round_even(rw0 * 2, 0) / 2 WHEN rw0 <= 30 THEN round_even(rw0, 0) ELSE 30.0::DOUBLE END AS rw1,
    CASE WHEN fr0 > 20 THEN 20.0::DOUBLE WHEN fr0 >= 10 THEN round_even(fr0 * 2, 0) / 2 ELSE round_even(fr0, 1) END AS fr1,
    greatest(least(round_even(tr0, 1), 150), -50) AS tr1,
    CASE WHEN up0 > 100 THEN round_even(up0, 0) ELSE round_even(up0, 1) END AS up1
  FROM labelled
),
clean AS (
  SELECT product_id, title, url,
    CASE raw_city WHEN 'Bà Rịa Vũng Tàu' THEN 'Bà Rịa - Vũng Tàu' WHEN 'Hồ Chí Minh' THEN 'Thành phố Hồ Chí Minh'
                  WHEN 'Hòa Bình' THEN 'Hoà Bình' ELSE raw_city END AS city,
    district, ward, street, full_address, CAST(price_total AS DOUBLE) AS price_total, area, up1 AS unit_price,
    CASE WHEN bed1 > 30 OR bath1 > 15 THEN 'Khách sạn / Tòa nhà lớn' WHEN bed1 > 10 OR bath1 > 6 THEN 'Tòa nhà / CHDV'
         ELSE 'Nhà ở dân dụng' END AS property_class,
    fr1 AS frontage,
    CASE WHEN fr1 = 5 THEN 'Tiêu chuẩn (5m)' WHEN fr1 < 5 THEN 'Nhỏ (<5m)' WHEN fr1 <= 10 THEN 'Khá (5-10m)'
         ELSE 'Rất rộng (>10m)' END AS frontage_class,
    rw1 AS road_width,
    CASE WHEN rw1 <= 3 THEN 'Ngõ nhỏ (<3m)' WHEN rw1 <= 5 THEN 'Ngõ xe ba gác (3-5m)'
         WHEN rw1 <= 10 THEN 'Đường xe hơi (5-10m)' ELSE 'Đường lớn (>10m)' END AS road_class,
    bed1 AS bedrooms, bath1 AS bathrooms, floors,
    CASE WHEN raw_direction IS NULL OR trim(raw_direction) = '' THEN 'Không rõ' ELSE trim(raw_direction) END AS direction,
    {INTERIOR_SQL} AS interior, lt AS legal_status, {TITLE_SQL} AS legal_class, post_rank, tr1 AS price_trend_1y,
    CASE WHEN tr1 < 0 THEN 'Giảm giá' WHEN tr1 <= 5 THEN 'Ổn định (0-5%)' WHEN tr1 <= 20 THEN 'Tăng trưởng (5-20%)'
         WHEN tr1 <= 50 THEN 'Tăng trưởng nóng (20-50%)' ELSE 'Tăng trưởng đột biến (>50%)' END AS trend_class,
    has_elevator, near_park, has_ngop_kw, has_marketing_kw, has_dongtien_kw, has_phaply_yeu_kw,
    desc_len, exclamation_count, caps_lock_ratio, description, posted_date, expiry_date, src_pos
  FROM rounded
),
dedup AS (
  SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY product_id, posted_date ORDER BY src_pos) = 1
)
"""

QUALITY_SQL = """
calc0 AS (
  SELECT *, price_total / 1000 AS price_billion, floor(price_total / 1000 / 0.5::DOUBLE) * 0.5::DOUBLE AS price_bin,
    CASE WHEN frontage = 0 THEN NULL ELSE area / (frontage * frontage) END AS depth_ratio,
    datediff('day', posted_date, expiry_date) AS days_shown,
    floor(unit_price / 5) * 5 AS unit_price_bin5, floor(unit_price / 2) * 2 AS unit_price_bin2,
    trunc(area / 50) * 50 AS area_bin,
    CASE WHEN post_rank = 'Tin thường' THEN 'Tin thường' ELSE 'Tin VIP' END AS tier,
    CASE WHEN legal_class IS NULL THEN '(Blank)'
         WHEN legal_class IN ('Chưa xác định', 'Hợp đồng mua bán') THEN 'Chưa xác định & Hợp đồng mua bán'
         ELSE legal_class END AS title_group,
    frontage_class IN ('Tiêu chuẩn (5m)', 'Khá (5-10m)', 'Rất rộng (>10m)') AS good_front,
    road_class IN ('Đường xe hơi (5-10m)', 'Đường lớn (>10m)') AS good_road
  FROM dedup
),
calc AS (
  SELECT *,
    CASE WHEN frontage IS NULL OR area IS NULL THEN 'Thiếu thông tin' WHEN coalesce(depth_ratio, 0) < 1.5 THEN 'Mặt tiền rộng'
         WHEN depth_ratio < 3 THEN 'Cân đối' WHEN depth_ratio < 5 THEN 'Nhà hẹp dài' ELSE 'Ống siêu dài' END AS plot_shape,
    CASE WHEN frontage IS NULL OR area IS NULL THEN 99 WHEN coalesce(depth_ratio, 0) < 1.5 THEN 1
         WHEN depth_ratio < 3 THEN 2 WHEN depth_ratio < 5 THEN 3 ELSE 4 END AS plot_shape_order,
    CASE WHEN title_group IN ('Chưa xác định & Hợp đồng mua bán', 'Sổ chung') AND NOT good_front AND NOT good_road
           THEN 'Pháp lý yếu + Hẻm nhỏ'
         WHEN title_group IN ('Chưa xác định & Hợp đồng mua bán', 'Sổ chung') THEN 'Pháp lý yếu + Vị trí trung bình'
         WHEN title_group = 'Sổ hồng/Sổ đỏ' AND (good_front OR good_road) THEN 'Sổ đỏ + Vị trí tốt'
         WHEN title_group = 'Sổ hồng/Sổ đỏ' THEN 'Sổ đỏ + Nhà hẻm'
         ELSE 'Khác (Dữ liệu chưa xác định)' END AS quality_group,
    CASE WHEN title_group IN ('Chưa xác định & Hợp đồng mua bán', 'Sổ chung') AND NOT good_front AND NOT good_road THEN 4
         WHEN title_group IN ('Chưa xác định & Hợp đồng mua bán', 'Sổ chung') THEN 3
         WHEN title_group = 'Sổ hồng/Sổ đỏ' AND (good_front OR good_road) THEN 1
         WHEN title_group = 'Sổ hồng/Sổ đỏ' THEN 2 ELSE 5 END AS quality_order,
    coalesce(area < 40 AND bedrooms >= 3, FALSE) AS is_overcrowded,
    coalesce(floors >= 4 AND road_width <= 4, FALSE) AS is_fire_risk
  FROM calc0
)
"""

TYPED = f"{RAW}, {TYPED_CTE}"
CLEAN = f"{TYPED}, {CLEAN_CTE}"
CALC = f"{CLEAN}, {QUALITY_SQL}"
