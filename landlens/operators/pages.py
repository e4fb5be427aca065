"""From a table of raw pages to valid listings and rejects."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions.address import parse_address, parse_location
from ..functions.dates import default_dates
from ..functions.description import section_description
from ..functions.rules import contains_any
from ..functions.text import let
from ..session import materialise

# Markers of blocked pages and class names of the listing site's markup.
BLOCK_STRONG = [
    "<title>just a moment</title>", "cf-challenge-running", "cf_chl_opt", "cf-challenge-hcaptcha",
    "attention required! | cloudflare", 'id="challenge-form"', 'id="challenge-running"',
]
BLOCK_WEAK = ["cf-challenge", "attention required"]
SHORT_PAGE = 15000
SPEC_ITEM = "re__pr-specs-content-item"
INFO_ITEM = "re__pr-short-info-item"
PRICE_UNITS = ["triệu", "tỷ", "m²", "m2"]
SPEC_FIELDS = [
    ("bedrooms", ["số phòng ngủ", "bedroom"]),
    ("bathrooms", ["số phòng tắm, vệ sinh", "vệ sinh", "bathroom"]),
    ("floors", ["số tầng", "lầu", "floor"]),
    ("direction", ["hướng nhà", "direction"]),
    ("frontage", ["mặt tiền", "frontage"]),
    ("road_width", ["đường vào", "hẻm", "road"]),
    ("legal_status", ["pháp lý", "legal"]),
    ("interior", ["nội thất", "interior"]),
]

LISTING_COLUMNS = [
    "product_id", "title", "url", "city", "district", "ward", "street", "full_address", "price_total", "price_per_m2",
    "price_min_range", "price_max_range", "area", "frontage", "road_width", "bedrooms", "bathrooms", "floors",
    "direction", "interior", "legal_status", "post_rank", "price_trend_1y", "is_verified", "has_elevator", "near_park",
    "is_frontage_road", "description", "posted_date", "expiry_date",
]


def is_blocked(html: Column) -> Column:
    """Empty page, challenge page, or a short page with a weak challenge marker."""
    def marked(low: Column) -> Column:
        # one search for each marker: faster on whole pages than one pass with all of them
        strong, weak = (reduce(or_, [low.contains(w) for w in words]) for words in (BLOCK_STRONG, BLOCK_WEAK))
        return strong | ((F.length(html) < SHORT_PAGE) & weak)

    return F.coalesce(html == "", F.lit(True)) | let(F.lower(html), marked)


def spec_items(tags: str) -> Column:
    """Array of (title, key, value, strict) for the specification items among a page's tags.

    `strict` marks items that have both a title and a value element.
    """

    def read(head: str, inner: str, whole: str) -> str:
        title, value = (H.first_text(inner, f"{SPEC_ITEM}-{part}") for part in ("title", "value"))
        return f"named_struct('title', {title}, 'value', {value}, 'attr', {H.attribute(head, 'title')}, 'text', {H.tag_text(whole)})"

    items = F.expr(H.each_element(tags, SPEC_ITEM, read))

    def item(i: Column) -> Column:
        return let(
            F.coalesce(i["title"], i["attr"], F.lit("")),
            lambda shown: F.struct(
                F.lower(shown).alias("title"),
                T.canonical(shown).alias("key"),
                F.coalesce(i["value"], i["text"]).alias("value"),
                (i["title"].isNotNull() & i["value"].isNotNull()).alias("strict"),
            ),
        )

    return F.transform(items, item)


def info_items(tags: str) -> Column:
    """Array of (title, attr, value, text) for the short-info items among a page's tags."""

    def read(head: str, inner: str, whole: str) -> str:
        title, value = (H.first_text(inner, part) for part in ("title", "value"))
        return f"named_struct('title', {title}, 'value', {value}, 'attr', coalesce({H.attribute(head, 'title')}, ''), 'text', {H.tag_text(whole)})"

    items = F.expr(H.each_element(tags, INFO_ITEM, read))

    def item(i: Column) -> Column:
        return F.struct(
            T.canonical(F.coalesce(i["title"], i["attr"])).alias("title"),
            F.lower(i["attr"]).alias("attr"),
            F.coalesce(i["value"], i["text"]).alias("value"),
            i["text"].alias("text"),
        )

    return F.transform(items, item)


def spec_value(specs: Column, field: str) -> Column:
    """Value text of the last item that belongs to a field; earlier fields claim an item first."""
    conds = []
    for name, words in SPEC_FIELDS:
        conds.append((name, words))
        if name == field:
            break

    def mine(i: Column) -> Column:
        own = contains_any(i["title"], conds[-1][1])
        for _, words in conds[:-1]:
            own = own & ~contains_any(i["title"], words)
        return own

    return F.get(F.reverse(F.filter(specs, mine)), F.lit(0))["value"]


def area_value(specs: Column) -> Column:
    hit = F.get(F.reverse(F.filter(specs, lambda i: i["key"].contains("dien tich"))), F.lit(0))
    return T.clean_numeric(hit["value"])


def listed_frontage(specs: Column) -> Column:
    own = F.filter(specs, lambda i: ~i["key"].contains("dien tich") & i["key"].contains("mat tien"))
    return T.clean_numeric(F.get(F.reverse(own), F.lit(0))["value"])


def span_frontage(tags: str) -> Column:
    """Figure of the first `ext` span that names the frontage and no price."""
    texts = F.expr(H.each_element(tags, "ext", lambda head, inner, whole: H.tag_text(whole), "span"))
    named = F.filter(
        texts, lambda x: ~contains_any(F.lower(x), PRICE_UNITS) & T.canonical(x).contains("mat tien")
    )
    return T.clean_numeric(F.get(named, F.lit(0)))


def frontage_value(specs: Column, tags: str) -> Column:
    """Frontage item, else the span's."""
    return F.coalesce(listed_frontage(specs), span_frontage(tags))


def total_price_value(infos: Column) -> Column:
    """Amount of the first info item with a number and a unit, in millions."""

    def priced(i: Column) -> Column:
        amount = T.clean_numeric(i["text"])
        scale = let(
            T.canonical(i["text"]),
            lambda k: F.when(k.contains("ty"), 1000.0).when(k.contains("trieu") | k.contains("tr"), 1.0),
        )
        usable = i["text"].rlike(r"\d") & ~contains_any(i["attr"], ["loai tin", "ma tin", "ngay dang"])
        return F.when(usable, amount * scale)

    return F.get(F.filter(F.transform(infos, priced), lambda x: x.isNotNull()), F.lit(0))


def unit_price_value(infos: Column) -> Column:
    """First number of the first item priced per square metre."""
    amounts = F.transform(infos, lambda i: F.when(i["text"].rlike("/m²|/m2"), T.clean_numeric(i["text"])))
    return F.get(F.filter(amounts, lambda x: x.isNotNull()), F.lit(0))


def post_rank_value(infos: Column) -> Column:
    hits = F.filter(infos, lambda i: i["title"].contains("loai tin") | i["title"].contains("post rank"))
    return F.nullif(F.get(hits, F.lit(0))["value"], F.lit(""))


def price_trend_value(tags: str) -> Column:
    """Trend figure; a block of the falling class makes it negative."""
    block = f"transform({H.elements(tags, 're__block-ldp-pricing-cta')}, e -> named_struct('classes', e.classes, 'text', {H.first_text('e.inner', 'cta-number')}))"
    charts = f"filter({H.elements(tags, 're__chart-col')}, e -> contains(e.classes, ' re__col-2 '))"
    old = f"transform({charts}, e -> {H.first_text('e.inner', '', 'strong')})"

    def figure(first: Column) -> Column:
        value = T.clean_numeric(first["text"])
        return F.when(first["classes"].contains("down-trend"), -F.abs(value)).otherwise(value)

    return F.coalesce(let(F.get(F.expr(block), F.lit(0)), figure), T.clean_numeric(F.get(F.expr(old), F.lit(0))))


def price_range(tags: str) -> Column:
    """Struct(lo, hi) of the range block, which is cut once for both."""
    both = H.bound(H.first_inner(tags, "meter-range"), lambda b: f"named_struct('lo', {H.first_text(b, 'min')}, 'hi', {H.first_text(b, 'max')})")
    return let(F.expr(both), lambda r: F.struct(T.clean_numeric(r["lo"]).alias("lo"), T.clean_numeric(r["hi"]).alias("hi")))


def is_verified(tags: str) -> Column:
    return F.coalesce(F.expr(H.has_class(tags, "marking-product__KYC")), F.lit(False))


def page_product_id(quiet: Column, url: Column, text: Column) -> Column:
    head = F.regexp_extract(quiet, r"(?is)<[a-z][^>]*\bid\s*=\s*[\"']?product-detail-web(?![\w-])[^>]*>", 0)
    # most pages lack the name, which is found faster than the tag
    head = F.when(quiet.rlike("(?i)product-detail-web"), F.nullif(head, F.lit("")))
    own = F.regexp_extract(head, r"(?is)\sprid\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(own, r"(?is)^\sprid\s*=\s*[\"']?|[\"']$", "")), F.lit("")), T.product_id(url, text))


def non_zero(x: Column) -> Column:
    """Missing for zero too: a zero found on the page gives way to the next source."""
    return F.nullif(x, F.lit(0).cast("double"))


def page_fields(pages: DataFrame, site: str, as_of: Column, fold_d: bool = True) -> DataFrame:
    """All listing fields of each page, before validation.

    Each stage is its own projection, so a page is stripped and cut into tags once, and its
    items are built once, whatever number of fields reads them.
    """
    quiet = pages.select(
        "url", is_blocked(F.col("html")).alias("blocked"), H.drop_silent(F.col("html")).alias("quiet")
    )
    cut = quiet.withColumn("tags", H.tags(F.col("quiet")))
    parts = cut.select(
        "url",
        "blocked",
        "quiet",
        H.page_title("tags", site).alias("page_title"),
        T.compose(H.inner_text(F.col("quiet"), " ")).alias("text"),
        spec_items("tags").alias("specs"),
        info_items("tags").alias("infos"),
        F.expr(H.first_text("tags", "re__address-line-1")).alias("address_line"),
        price_range("tags").alias("range"),
        price_trend_value("tags").alias("price_trend_1y"),
        is_verified("tags").alias("marked"),
        span_frontage("tags").alias("span_frontage"),
    )
    lines = F.filter(F.array("text"), lambda x: x != "")
    # The visible text is one normalised line, so it is also its own key source: its key is made once for all rules.
    line_key = F.lower(T.strip_accents(F.col("text")))
    keyed = parts.withColumns({"lines": lines, "line_key": line_key})
    items = F.transform(F.col("lines"), lambda x: F.struct(x.alias("line"), F.col("line_key").alias("key")))
    own_items = F.when(F.col("text").isNotNull(), items)
    keyed = keyed.withColumn("description", section_description(F.col("text"), F.col("page_title"), own_items))
    text_key = F.translate("line_key", "đ", "d") if fold_d else F.col("line_key")
    # without a section the description is the text
    shown_key = F.when(F.col("description") == F.col("text"), text_key).otherwise(T.canonical(F.coalesce("description", F.lit("")), fold_d))
    near = parse_address(F.col("address_line"), fold_d)
    far = parse_location(F.col("lines"), F.col("page_title"), fold_d)
    text_figures = T.figures_of_composed(F.col("text"), F.col("lines"), items=items)
    placed = keyed.withColumns(
        {
            "near": near,
            "fig": F.struct(*[v.alias(k) for k, v in text_figures.items()]),
            "amenity": F.struct(*[v.alias(k) for k, v in T.description_flags(F.col("description"), fold_d, shown_key).items()]),
            "text_key": text_key,
        }
    ).withColumn("place", F.when(F.col("near.city") != "", F.col("near")).otherwise(far))

    spec = lambda f: spec_value(F.col("specs"), f)
    figure = lambda f: F.col(f"fig.{f}")
    whole = lambda f: non_zero(F.floor(T.clean_numeric(spec(f))).cast("double"))
    count = lambda f: F.coalesce(whole(f), figure(f).cast("double")).cast("int")
    # an item for the floors stands for one floor at least
    floors = F.coalesce(whole("floors"), F.when(spec("floors").isNotNull(), 1.0), figure("floors").cast("double")).cast("int")
    filled = lambda c: F.nullif(c, F.lit(""))
    posted, expiry = default_dates(figure("posted_date"), figure("expiry_date"), as_of)
    verified_words = ["tin xac thuc", "da xac thuc"]
    return placed.select(
        "blocked",
        page_product_id(F.col("quiet"), F.col("url"), F.col("text")).alias("product_id"),
        F.coalesce(filled(F.col("page_title")), F.col("url")).alias("title"),
        "url",
        F.col("place.city").alias("city"),
        F.col("place.district").alias("district"),
        F.col("place.ward").alias("ward"),
        F.col("place.street").alias("street"),
        F.col("place.full_address").alias("full_address"),
        F.coalesce(non_zero(total_price_value(F.col("infos"))), figure("price_total") * 1000.0).alias("price_total"),
        F.coalesce(non_zero(unit_price_value(F.col("infos"))), figure("price_per_m2")).alias("price_per_m2"),
        F.col("range.lo").alias("price_min_range"),
        F.col("range.hi").alias("price_max_range"),
        F.coalesce(non_zero(area_value(F.col("specs"))), figure("area")).alias("area"),
        F.coalesce(
            non_zero(F.coalesce(listed_frontage(F.col("specs")), F.col("span_frontage"))), non_zero(T.clean_numeric(spec("frontage"))), figure("frontage")
        ).alias("frontage"),
        F.coalesce(non_zero(T.clean_numeric(spec("road_width"))), figure("road_width")).alias("road_width"),
        count("bedrooms").alias("bedrooms"),
        count("bathrooms").alias("bathrooms"),
        floors.alias("floors"),
        F.coalesce(filled(spec("direction")), figure("direction")).alias("direction"),
        spec("interior").alias("interior"),
        F.coalesce(filled(spec("legal_status")), figure("legal_status")).alias("legal_status"),
        F.coalesce(post_rank_value(F.col("infos")), F.lit("")).alias("post_rank"),
        "price_trend_1y",
        (F.col("marked") | contains_any(F.col("text_key"), verified_words)).alias("is_verified"),
        F.col("amenity.has_elevator").alias("has_elevator"),
        F.col("amenity.near_park").alias("near_park"),
        F.col("amenity.is_frontage_road").alias("is_frontage_road"),
        "description",
        posted.alias("posted_date"),
        expiry.alias("expiry_date"),
    )


def with_reject_reason(fields: DataFrame) -> DataFrame:
    """First rule a record breaks, null for a valid record."""
    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    reason = (
        F.when(F.col("blocked"), "blocked page")
        .when(blank("product_id"), "no product id")
        .when(blank("city") | blank("district"), "no location")
        .when(F.col("price_total").isNull() | F.col("price_per_m2").isNull() | F.col("area").isNull(), "no price or area")
    )
    return fields.withColumn("reject_reason", reason)


def extract_listings(pages: DataFrame, site: str, as_of: Column, fold_d: bool = True) -> DataFrame:
    """Valid and rejected records in one table; filter on `reject_reason`."""
    return with_reject_reason(page_fields(pages, site, as_of, fold_d)).select(*LISTING_COLUMNS, "reject_reason")


def split_listings(pages: DataFrame, site: str, as_of: Column, fold_d: bool = True, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid listings and rejects, with the columns asked for (all, if none are named).

    Extraction is the dear step and both sides need it, so its result is written once
    to the shared folder and the two sides are filters over that table. Fields that neither
    the columns nor the outcome need are not extracted.
    """
    found = extract_listings(pages, site, as_of, fold_d).select(*(columns or LISTING_COLUMNS), "reject_reason")
    table = materialise(found, "extracted")
    valid = table.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return valid, table.where(F.col("reject_reason").isNotNull())


def strict_fields(specs: Column) -> Column:
    """Struct(frontage, road_width) read only from exact specification titles.

    Values that name a price or an area unit are skipped; the first figure wins.
    """

    def figure(label: str) -> Column:
        own = F.filter(specs, lambda i: i["strict"] & (i["key"] == label) & ~contains_any(F.lower(i["value"]), PRICE_UNITS))
        values = F.filter(F.transform(own, lambda i: T.clean_numeric(i["value"])), lambda x: x.isNotNull())
        return F.get(values, F.lit(0))

    return F.struct(figure(T.plain_key("Mặt tiền")).alias("frontage"), figure(T.plain_key("Đường vào")).alias("road_width"))


def resolved_path(reference: Column) -> Column:
    """An absolute path, with what follows it, without its `.` and `..` segments."""
    path = F.regexp_extract(reference, r"^[^?#]*", 0)

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    def clean(parts: Column) -> Column:
        kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
        # a path that ends in a dot segment names a folder
        folder = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise("")
        return let(F.concat(F.lit("/"), F.array_join(kept, "/")), lambda p: F.concat(p, F.when(p == "/", "").otherwise(folder)))

    dotted = F.concat(let(F.split(path, "/"), clean), F.substr(reference, F.length(path) + 1))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), dotted).otherwise(reference)


def page_links(pages: DataFrame, host: str) -> DataFrame:
    """Detail-page links of each page: absolute, on the host, numbered by position.

    Relative references are resolved against the page's own address.
    """
    hrefs = F.regexp_extract_all(
        H.drop_silent(F.col("html")), F.lit(r"(?is)<a\b[^>]*?\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"), F.lit(1)
    )
    found = pages.select("page_id", "url", F.posexplode(hrefs).alias("pos", "quoted"))
    href = F.btrim(H.unescape(F.regexp_replace("quoted", "^[\"']|[\"']$", "")))
    origin = F.regexp_extract("url", r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract("url", r"^([a-zA-Z][\w+.-]*):", 1)
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-zA-Z][\w+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    folder = F.regexp_replace(path, r"[^/]*$", "")
    link = F.col("href")
    absolute = (
        F.when(link.rlike(r"^[a-zA-Z][\w+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, resolved_path(link)))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace("url", r"#.*$", ""), link))
        .when(link == "", F.col("url"))
        .otherwise(F.concat(origin, resolved_path(F.concat(F.when(folder == "", "/").otherwise(folder), link))))
    )
    resolved = found.withColumn("href", href).withColumn("link", absolute)
    netloc = F.regexp_extract("link", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)
    rest = F.regexp_replace(F.regexp_replace("link", r"^[a-zA-Z][\w+.-]*://[^/?#]*", ""), r"#.*$", "")
    detail = rest.rlike(r"(?i)/[^\s?#]*-pr\d+(?:\?|$)")
    return resolved.where(((netloc == "") | netloc.contains(host)) & detail).select("page_id", "pos", "link")
