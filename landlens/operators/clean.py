"""From raw text records to the typed, imputed and classified listing table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rules as R
from .quantiles import exact_medians, with_scalar

TEXT_COLUMNS = [
    "title", "url", "description", "city", "district", "ward", "street", "full_address", "direction", "interior",
    "legal_status", "post_rank",
]
LONG_COLUMNS = ["product_id", "price_total", "bedrooms", "bathrooms", "floors", "desc_len", "exclamation_count"]
DOUBLE_COLUMNS = ["area", "frontage", "road_width", "price_trend_1y", "caps_lock_ratio"]
BOOL_COLUMNS = [
    "has_elevator", "near_park", "is_frontage_road", "has_ngop_kw", "has_marketing_kw", "has_dongtien_kw",
    "has_phaply_yeu_kw",
]
TIME_COLUMNS = ["posted_date", "expiry_date"]
IMPUTED = ["road_width", "frontage", "bedrooms", "bathrooms", "price_trend_1y"]
IMPUTED_CLASSES = ["road_class", "frontage_class", "property_class", "trend_class"]

OUTPUT_ORDER = [
    "product_id", "title", "url", "city", "district", "ward", "street", "full_address", "price_total", "area",
    "unit_price", "property_class", "frontage", "frontage_class", "road_width", "road_class", "bedrooms", "bathrooms",
    "floors", "direction", "interior", "legal_status", "legal_class", "post_rank", "price_trend_1y", "trend_class",
    "has_elevator", "near_park", "has_ngop_kw", "has_marketing_kw", "has_dongtien_kw", "has_phaply_yeu_kw", "desc_len",
    "exclamation_count", "caps_lock_ratio", "description", "posted_date", "expiry_date",
]

# Column names of the listing model.
MODEL_NAMES = {
    "title": "Bất động sản", "description": "Mô tả", "price_total": "Khoảng giá", "price_per_m2": "Đơn giá",
    "area": "Diện tích", "frontage": "Mặt tiền", "road_width": "Đường vào", "bedrooms": "Số phòng ngủ",
    "bathrooms": "Số phòng tắm, vệ sinh", "floors": "Số tầng", "price_trend_1y": "Biến động giá",
    "city": "Thành phố", "district": "Quận", "ward": "Phường", "street": "Đường", "full_address": "Địa chỉ",
    "direction": "Hướng nhà", "interior": "Nội thất", "legal_status": "Pháp lý", "post_rank": "Loại tin",
    "has_elevator": "Có thang máy", "near_park": "Gần công viên", "is_frontage_road": "Nhà mặt tiền",
    "posted_date": "Ngày đăng", "has_ngop_kw": "Có dấu hiệu bán gấp", "has_marketing_kw": "Có từ khóa marketing",
    "has_dongtien_kw": "Có từ khóa dòng tiền", "has_phaply_yeu_kw": "Có dấu hiệu pháp lý yếu",
    "desc_len": "Độ dài mô tả", "exclamation_count": "Số dấu chấm than", "caps_lock_ratio": "Tỷ lệ chữ in hoa",
}
MODEL_CLASS_NAMES = {
    "unit_price": "Đơn giá", "property_class": "Loại hình BĐS", "frontage_class": "Loại Mặt tiền",
    "road_class": "Phân loại Đường", "legal_class": "Pháp lý Chuẩn hóa", "trend_class": "Xu hướng giá",
}


def typed_listings(raw: DataFrame) -> DataFrame:
    """Declared casts over text cells: a bad cell is null, never an error."""
    casts = {c: N.to_long(F.col(c)) for c in LONG_COLUMNS}
    casts |= {c: N.to_double(F.col(c)) for c in DOUBLE_COLUMNS}
    casts |= {c: R.text_to_bool(F.col(c)) for c in BOOL_COLUMNS}
    casts |= {c: F.col(c).try_cast("timestamp") for c in TIME_COLUMNS}
    casts["product_id"] = F.col("product_id").try_cast("bigint")
    return raw.withColumns({c: e for c, e in casts.items() if c in raw.columns})


def normalise_labels(df: DataFrame) -> DataFrame:
    legal = R.strip_trailing_dots(F.col("legal_status"))
    return (
        df.withColumns(
            {
                "direction": R.direction_label(F.col("direction")),
                "interior": R.interior_label(F.col("interior")),
                "legal_status": legal,
                "legal_class": R.title_label(legal),
            }
        )
        .replace(R.CITY_SPELLINGS, subset=["city"])
    )


def impute_and_classify(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Fill gaps with whole-table medians, round, cap and label.

    The one-row median frame enters as a scalar subquery: no join, no collect.
    """
    med = {c: F.col(f"__med.{c}") for c in IMPUTED}
    fill = {c: F.coalesce(F.col(c).cast("double"), med[c]) for c in IMPUTED}
    beds = F.coalesce(F.col("bedrooms"), F.bround(med["bedrooms"], 0).cast("long"))
    baths = F.coalesce(F.col("bathrooms"), F.bround(med["bathrooms"], 0).cast("long"))
    filled = with_scalar(df, "__med", medians).withColumns(
        {
            "unit_price": N.guarded_unit_price(F.col("price_total"), F.col("area")),
            "road_width": N.segmented_road(fill["road_width"]),
            "frontage": N.segmented_frontage(fill["frontage"]),
            "bedrooms": beds,
            "bathrooms": baths,
            "price_trend_1y": N.capped_trend(fill["price_trend_1y"]),
            "price_total": F.col("price_total").cast(N.MONEY),
        }
    )
    return with_classes(filled).drop("__med")


def with_classes(df: DataFrame) -> DataFrame:
    """The classes of imputed measures, each by its own measure alone."""
    return df.withColumns(
        {
            "road_class": R.road_class(F.col("road_width")),
            "frontage_class": R.frontage_class(F.col("frontage")),
            "property_class": R.property_class(F.col("bedrooms"), F.col("bathrooms")),
            "trend_class": R.trend_class(F.col("price_trend_1y")),
        }
    )


def clean_listings(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The cleaned wide table in its output order, plus the row-order column if present.

    The medians take a pass over the table of their own, so they are looked for only if a column to keep depends on them.
    """
    typed = typed_listings(raw)
    kept = keep or OUTPUT_ORDER
    medians = exact_medians(typed, IMPUTED) if {*kept} & {*IMPUTED, *IMPUTED_CLASSES} else _no_medians(typed)
    done = impute_and_classify(normalise_labels(typed), medians)
    order = [c for c in ("src_pos",) if c in raw.columns]
    return done.select(*kept, *order)


def _no_medians(df: DataFrame) -> DataFrame:
    """A row in place of the medians, for columns that don't depend on them."""
    return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in IMPUTED])


def with_model_names(df: DataFrame) -> DataFrame:
    """Rename to the column names of the listing model."""
    names = {k: v for k, v in {**MODEL_NAMES, **MODEL_CLASS_NAMES}.items() if k in df.columns}
    if "price_per_m2" in names and "unit_price" in names:
        names.pop("price_per_m2")
    return df.withColumnsRenamed(names)
