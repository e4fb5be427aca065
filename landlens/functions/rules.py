"""Label rules as data, turned into `when` chains; the first match wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import blank_as_zero, depth_ratio


@dataclass(frozen=True)
class KeywordRule:
    """A label given when any single word, or one word of every group, occurs."""

    label: str
    any_of: tuple[str, ...] = ()
    groups: tuple[tuple[str, ...], ...] = ()

    def matches(self, text: Column) -> Column:
        hit = contains_any(text, self.any_of) if self.any_of else F.lit(False)
        if self.groups:
            every = F.lit(True)
            for group in self.groups:
                every = every & contains_any(text, group)
            hit = hit | every
        return hit


def contains_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """True when one of the plain words occurs: one pass with a quoted alternation."""
    return text.rlike("|".join(quote(w) for w in words))


def quote(word: str) -> str:
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|/&#~" else ch for ch in word)


def chain(branches: list[tuple[Column, object]], default: object) -> Column:
    out = None
    for cond, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


# --- Fixed values: labels and keyword lists of the listing model -------------------------

UNKNOWN = "Không rõ"
LEGAL_DEFAULT = "Sổ hồng/Sổ đỏ"

ROAD_STEPS = [(3, "Ngõ nhỏ (<3m)"), (5, "Ngõ xe ba gác (3-5m)"), (10, "Đường xe hơi (5-10m)")]
ROAD_ELSE = "Đường lớn (>10m)"

FRONTAGE_STANDARD = "Tiêu chuẩn (5m)"
FRONTAGE_SMALL = "Nhỏ (<5m)"
FRONTAGE_FAIR = "Khá (5-10m)"
FRONTAGE_WIDE = "Rất rộng (>10m)"

HOTEL = "Khách sạn / Tòa nhà lớn"
SERVICED = "Tòa nhà / CHDV"
DWELLING = "Nhà ở dân dụng"

TREND_FALL = "Giảm giá"
TREND_STEPS = [(5, "Ổn định (0-5%)"), (20, "Tăng trưởng (5-20%)"), (50, "Tăng trưởng nóng (20-50%)")]
TREND_ELSE = "Tăng trưởng đột biến (>50%)"

SHAPE_MISSING = ("Thiếu thông tin", 99)
SHAPE_STEPS = [(1.5, "Mặt tiền rộng", 1), (3, "Cân đối", 2), (5, "Nhà hẹp dài", 3)]
SHAPE_ELSE = ("Ống siêu dài", 4)

SEGMENT_BLANK = ("Không xác định", 4)
SEGMENT_LOW = ("Bình dân", 1)
SEGMENT_MID = ("Trung bình", 2)
SEGMENT_HIGH = ("Cao cấp", 3)

GOOD_FRONTAGE = [FRONTAGE_STANDARD, FRONTAGE_FAIR, FRONTAGE_WIDE]
GOOD_ROAD = ["Đường xe hơi (5-10m)", ROAD_ELSE]
TITLE_STRONG = LEGAL_DEFAULT
TITLE_SHARED = "Sổ chung"
TITLE_CONTRACT = "Hợp đồng mua bán"
TITLE_WAITING = "Đang chờ sổ"
TITLE_UNKNOWN = "Chưa xác định"
TITLE_MERGED = "Chưa xác định & Hợp đồng mua bán"
QUALITY_WEAK_POOR = ("Pháp lý yếu + Hẻm nhỏ", 4)
QUALITY_WEAK = ("Pháp lý yếu + Vị trí trung bình", 3)
QUALITY_STRONG_GOOD = ("Sổ đỏ + Vị trí tốt", 1)
QUALITY_STRONG = ("Sổ đỏ + Nhà hẻm", 2)
QUALITY_OTHER = ("Khác (Dữ liệu chưa xác định)", 5)

TIER_REGULAR = "Tin thường"
TIER_PAID = "Tin VIP"

INTERIOR_RULES = [
    KeywordRule(UNKNOWN, ("sổ photo", "tỷ", "gu riêng", "hoàn thiện bên ngoài", "như hình")),
    KeywordRule("Không nội thất", ("trống",)),
    KeywordRule("Thô", ("thô",)),
    KeywordRule(
        "Cao cấp",
        ("luxury", "châu âu", "nhật bản", "nhập khẩu", "cao cấp"),
        (("nội thất",), ("đẹp", "hiện đại", "tinh tế", "sang trọng")),
    ),
    KeywordRule("Cơ bản", ("chủ đầu tư", "cđt", "mới nguyên", "nguyên bản", "cơ bản")),
    KeywordRule(
        "Đầy đủ",
        (
            "ful", "đủ nội thất", "đầy đủ", "có nội thất", "có sẵn", "xịn", "dính tường", "ở luôn", "máy lạnh",
            "tủ bếp", "sofa", "tủ lạnh", "giường", "bếp", "full", "hoàn thiện nội thất", "sẵn nội thất",
        ),
        (("tặng", "để lại"), ("nội thất", "full")),
    ),
]

TITLE_RULES = [
    KeywordRule(TITLE_SHARED, ("chung", "sdc")),
    KeywordRule(TITLE_CONTRACT, ("hợp đồng", "hđmb", "hdmb")),
    KeywordRule(TITLE_STRONG, ("sổ", "sh", "sr")),
    KeywordRule(TITLE_WAITING, ("chờ", "hồ sơ")),
]

DISTRESS_WORDS = [
    "ngộp", "giảm giá", "bán gấp", "kẹt tiền", "nợ ngân hàng", "phá sản", "hạ chào", "cứu chủ", "cần tiền",
]
HYPE_WORDS = ["siêu phẩm", "cực hiếm", "có 1 không 2", "hot nhất", "duy nhất", "vip", "đẳng cấp", "tuyệt đỉnh"]
CASHFLOW_WORDS = ["dòng tiền", "doanh thu", "cho thuê", "full phòng", "ch trọ", "chdv", "thu nhập"]
WEAK_TITLE_WORDS = ["vi bằng", "giấy tay", "đang chờ sổ", "chưa sổ", "hdmb", "hợp đồng mua bán"]

CITY_SPELLINGS = {
    "Bà Rịa Vũng Tàu": "Bà Rịa - Vũng Tàu",
    "Hồ Chí Minh": "Thành phố Hồ Chí Minh",
    "Hòa Bình": "Hoà Bình",
}


# --- Classifiers ---------------------------------------------------------------------


def road_class(width: Column) -> Column:
    return chain([(width <= edge, label) for edge, label in ROAD_STEPS], ROAD_ELSE)


def frontage_class(width: Column) -> Column:
    return chain(
        [(width == 5, FRONTAGE_STANDARD), (width < 5, FRONTAGE_SMALL), (width <= 10, FRONTAGE_FAIR)], FRONTAGE_WIDE
    )


def property_class(bedrooms: Column, bathrooms: Column) -> Column:
    return chain(
        [((bedrooms > 30) | (bathrooms > 15), HOTEL), ((bedrooms > 10) | (bathrooms > 6), SERVICED)], DWELLING
    )


def trend_class(trend: Column) -> Column:
    return chain([(trend < 0, TREND_FALL)] + [(trend <= edge, label) for edge, label in TREND_STEPS], TREND_ELSE)


def plot_shape(area: Column, frontage: Column) -> tuple[Column, Column]:
    """Label and sort order; a zero frontage leaves the ratio blank, which counts as 0."""
    ratio = blank_as_zero(depth_ratio(area, frontage))
    missing = area.isNull() | frontage.isNull()
    label = chain([(missing, SHAPE_MISSING[0])] + [(ratio < e, n) for e, n, _ in SHAPE_STEPS], SHAPE_ELSE[0])
    order = chain([(missing, SHAPE_MISSING[1])] + [(ratio < e, o) for e, _, o in SHAPE_STEPS], SHAPE_ELSE[1])
    return label, order


def price_segment(price: Column, p25: Column, p75: Column) -> tuple[Column, Column]:
    """Label by rounded thresholds, order by the unrounded ones: they may disagree."""
    label = chain(
        [
            (price.isNull(), SEGMENT_BLANK[0]),
            (price <= F.round(p25, 0), SEGMENT_LOW[0]),
            (price <= F.round(p75, 0), SEGMENT_MID[0]),
        ],
        SEGMENT_HIGH[0],
    )
    order = chain(
        [(price.isNull(), SEGMENT_BLANK[1]), (price <= p25, SEGMENT_LOW[1]), (price <= p75, SEGMENT_MID[1])],
        SEGMENT_HIGH[1],
    )
    return label, order


def quality_group(frontage_cls: Column, road_cls: Column, title_grp: Column) -> tuple[Column, Column]:
    good_front = F.coalesce(frontage_cls.isin(GOOD_FRONTAGE), F.lit(False))
    good_road = F.coalesce(road_cls.isin(GOOD_ROAD), F.lit(False))
    weak = F.coalesce(title_grp.isin([TITLE_MERGED, TITLE_SHARED]), F.lit(False))
    strong = F.coalesce(title_grp == TITLE_STRONG, F.lit(False))
    poor = ~good_front & ~good_road
    branches = [
        (weak & poor, QUALITY_WEAK_POOR),
        (weak, QUALITY_WEAK),
        (strong & (good_front | good_road), QUALITY_STRONG_GOOD),
        (strong, QUALITY_STRONG),
    ]
    return (
        chain([(c, v[0]) for c, v in branches], QUALITY_OTHER[0]),
        chain([(c, v[1]) for c, v in branches], QUALITY_OTHER[1]),
    )


def paid_tier(post_rank: Column) -> Column:
    return chain([(post_rank == TIER_REGULAR, TIER_REGULAR)], TIER_PAID)


def title_group(title_class: Column) -> Column:
    return chain(
        [(title_class.isNull(), "(Blank)"), (title_class.isin([TITLE_UNKNOWN, TITLE_CONTRACT]), TITLE_MERGED)],
        title_class,
    )


def overcrowded(area: Column, bedrooms: Column) -> Column:
    return F.coalesce((area < 40) & (bedrooms >= 3), F.lit(False))


def fire_risk(floors: Column, road_width: Column) -> Column:
    return F.coalesce((floors >= 4) & (road_width <= 4), F.lit(False))


def crowding(area: Column, bedrooms: Column) -> Column:
    """Blank-tolerant relative of `overcrowded`: a blank area counts as 0, and 40 is in."""
    return (blank_as_zero(area) <= 40) & (blank_as_zero(bedrooms) >= 3)


def keyword_label(text: Column, rules: list[KeywordRule], default: str) -> Column:
    return chain([(rule.matches(text), rule.label) for rule in rules], default)


def clean_label(text: Column) -> Column:
    """Trim and drop control characters."""
    return F.btrim(F.regexp_replace(text, r"\p{Cntrl}", ""))


def direction_label(text: Column) -> Column:
    cleaned = clean_label(text)
    return F.when(cleaned.isNull() | (cleaned == ""), UNKNOWN).otherwise(cleaned)


def interior_label(text: Column) -> Column:
    def label(lowered: Column) -> Column:
        blank = lowered.isNull() | (lowered == "")
        return F.when(blank, UNKNOWN).otherwise(keyword_label(lowered, INTERIOR_RULES, UNKNOWN))

    # every rule reads the cleaned text, which is made once
    return F.get(F.transform(F.array(F.lower(clean_label(F.translate(text, ".,?", "")))), label), F.lit(0))


def strip_trailing_dots(text: Column) -> Column:
    return F.rtrim(F.btrim(text), F.lit("."))


def title_label(text: Column) -> Column:
    """Class of the legal title; a missing text has no class."""
    def label(lowered: Column) -> Column:
        return F.when(lowered.isNotNull(), keyword_label(lowered, TITLE_RULES, TITLE_UNKNOWN))

    return F.get(F.transform(F.array(F.lower(text)), label), F.lit(0))


def text_to_bool(text: Column) -> Column:
    word = F.lower(F.btrim(text))
    return F.when(word == "true", True).when(word == "false", False)
