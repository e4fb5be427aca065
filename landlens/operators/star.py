"""Star schema: four dimensions, two date tables, the listing fact and its calculated columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numeric as N
from ..functions import rules as R
from ..session import materialise
from ..sources.tables import date_table
from .clean import IMPUTED_CLASSES, with_classes
from .quantiles import exact_percentiles, with_scalar
from .relational import first_per_key, first_rows, null_safe_lookup, with_sequence_key

LOCATION = ["city", "district", "ward", "street", "full_address"]
FEATURES = [
    "has_elevator", "near_park", "has_ngop_kw", "has_marketing_kw", "has_dongtien_kw", "has_phaply_yeu_kw",
]
DETAILS = ["direction", "interior", "legal_status", "legal_class", "post_rank"]
DETAILS_JOIN = ["direction", "interior", "legal_status", "post_rank"]
PRODUCT = [
    "title", "url", "description", "desc_len", "exclamation_count", "caps_lock_ratio", "product_id",
]
FACT = [
    "price_total", "area", "unit_price", "property_class", "frontage", "frontage_class", "road_width", "road_class",
    "bedrooms", "bathrooms", "floors", "price_trend_1y", "trend_class", "posted_date", "expiry_date",
    "location_skey", "feature_skey", "status_skey", "product_skey",
]

#: What the fact and the dimensions that it looks up are made of.
FACT_INPUT = list(dict.fromkeys(["product_id", *[c for c in FACT if not c.endswith("_skey")], *LOCATION, *FEATURES, *DETAILS]))


#: Role -> the fact's date column that its own date table is joined by.
DATE_ROLES = {"posted": "posted_date", "expiry": "expiry_date"}
DATE_LEVELS = ["year", "quarter_no", "quarter", "month_no", "month", "day"]


def dim_dates(fact: DataFrame, role: str) -> DataFrame:
    """Every day of the years that the role's column spans, with its drill levels; the day is the key."""
    return date_table(fact, DATE_ROLES[role]).select("date", *DATE_LEVELS)


def with_date_levels(rows: DataFrame, dates: DataFrame, role: str) -> DataFrame:
    """``rows`` with ``<role>_year`` .. ``<role>_day`` of their date; a row without a date has none."""
    levels = dates.select(F.col("date").alias("__date"), *[F.col(c).alias(f"{role}_{c}") for c in DATE_LEVELS])
    return rows.join(levels, F.to_date(DATE_ROLES[role]) == F.col("__date"), "left").drop("__date")


def dim_location(clean: DataFrame) -> DataFrame:
    return with_sequence_key(clean.select(*LOCATION).dropDuplicates(LOCATION), LOCATION, "location_skey")


def dim_features(clean: DataFrame) -> DataFrame:
    return with_sequence_key(clean.select(*FEATURES).distinct(), FEATURES, "feature_skey", digits=1)


def dim_property_details(clean: DataFrame) -> DataFrame:
    """Distinct on five columns, looked up by four: the fifth is a function of the title text."""
    dim = with_sequence_key(clean.select(*DETAILS).distinct(), DETAILS, "status_skey")
    return dim.withColumns(
        {"tier": R.paid_tier(F.col("post_rank")), "title_group": R.title_group(F.col("legal_class"))}
    )


def product_keys(clean: DataFrame) -> DataFrame:
    """product_id and product_skey of the product dimension, without its texts."""
    return with_sequence_key(clean.select("product_id").distinct(), ["product_id"], "product_skey", digits=4)


def dim_product(clean: DataFrame) -> DataFrame:
    """The texts of each product's first row; only its key is numbered, so they are shuffled once."""
    first = first_per_key(clean.select(*PRODUCT, "src_pos", "posted_date"), ["product_id"], ["src_pos", "posted_date"])
    return null_safe_lookup(first.select(*PRODUCT), product_keys(clean), ["product_id"], ["product_skey"])


def deduplicated(clean: DataFrame) -> DataFrame:
    """First row of each (product, posting date)."""
    return first_per_key(clean, ["product_id", "posted_date"], ["src_pos"])


def with_risk_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "is_overcrowded": R.overcrowded(F.col("area"), F.col("bedrooms")),
            "is_fire_risk": R.fire_risk(F.col("floors"), F.col("road_width")),
        }
    )


def fact_listings(clean: DataFrame, dims: dict[str, DataFrame], columns: list[str] | None = None) -> DataFrame:
    """Distinct listings with the four surrogate keys, the flags and a sequence id; or those ``columns`` of them and the id.

    The dedup is the only shuffle of whole rows. The keys of the three dimensions of values are looked up before it, so it moves
    them in place of the texts; product keys and ids are numbered over (product, posting date) alone, and a listing's pair meets
    its rows in the dedup itself.
    """
    wanted = columns or FACT
    rows = null_safe_lookup(clean, dims["location"], LOCATION, ["location_skey"])
    rows = null_safe_lookup(rows, dims["features"], FEATURES, ["feature_skey"])
    rows = null_safe_lookup(rows, dims["details"], DETAILS_JOIN, ["status_skey"])
    # classes are named after the dedup, by the measures that it moves
    classes = [] if columns else IMPUTED_CLASSES
    own = [c for c in wanted if c not in ("product_skey", "posted_date", *classes)]
    rows = rows.select("product_id", "posted_date", F.struct(*own).alias("__row"), F.struct("src_pos").alias("__at"))
    ids = listing_keys(clean, dims["product"]).select("product_id", "posted_date", F.struct("product_skey", "listing_id").alias("__ids"))
    # a pair of keys has no place in the order, and `min_by` passes over it
    both = rows.unionByName(ids, allowMissingColumns=True)
    first = both.groupBy("product_id", "posted_date").agg(F.min_by("__row", "__at").alias("__row"), F.max("__ids").alias("__ids"))
    taken = {c: F.col(f"__row.{c}") for c in own} | {"product_skey": F.col("__ids.product_skey"), "posted_date": F.col("posted_date")}
    fact = first.select(*[taken[c].alias(c) for c in wanted if c in taken], F.col("__ids.listing_id").alias("listing_id"))
    return fact if columns else with_risk_flags(with_classes(fact)).select(*FACT, "is_overcrowded", "is_fire_risk", "listing_id")


def with_listing_id(fact: DataFrame) -> DataFrame:
    """(product, posting date) is unique after the dedup, so it can carry the sequence."""
    return with_sequence_key(fact, ["product_skey", "posted_date"], "listing_id", digits=4)


def listing_keys(clean: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """product_id, posted_date, product_skey and listing_id of the fact, by the product dimension if there is one.

    The lookups are many to one and a listing's first row has its key, so ids need neither the other columns nor row order.
    """
    listings = materialise(clean.select("product_id", "posted_date").distinct(), "listing-keys", compression="zstd")
    rows = null_safe_lookup(listings, product_keys(listings) if products is None else products, ["product_id"], ["product_skey"])
    return with_listing_id(rows)


def listing_ids(clean: DataFrame) -> DataFrame:
    """product_skey, posted_date and listing_id of the fact, for callers that read no more of it."""
    return listing_keys(clean).select("product_skey", "posted_date", "listing_id")


def build_star(clean: DataFrame, stage: bool = True, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """All tables of the star; the product dimension if its texts are there, of the fact ``columns`` if given.

    The cleaned table feeds five branches. It is written once to the shared folder, so
    the branches read parquet columns instead of repeating casts and medians, and a
    lost executor costs only its own tasks. The fact looks up written dimensions: their size is known before its rows are moved.
    """
    base = materialise(clean, "clean-listings") if stage else clean
    makers = {"location": dim_location, "features": dim_features, "details": dim_property_details}
    dims = {name: materialise(make(base), f"dim-{name}") for name, make in makers.items()}
    dates = {f"{role}_dates": dim_dates(base, role) for role in DATE_ROLES}
    # the fact looks up keys alone; of the whole dimension the texts would be shuffled with them
    keys = materialise(product_keys(base), "product-keys", compression="zstd")
    fact = fact_listings(base, {**dims, "product": keys}, columns)
    products = {"product": dim_product(base)} if {*PRODUCT} <= {*base.columns} else {}
    return {**dims, **products, **dates, "product_keys": keys, "fact": fact}


def write_star(clean: DataFrame, root: str) -> None:
    """Write the star; the fact is built from the written dimensions, keys and all."""
    spark = clean.sparkSession
    base = materialise(clean, "clean-listings")
    makers = {
        "location": dim_location, "features": dim_features, "details": dim_property_details, "product": dim_product,
    }
    dims = {}
    for name, make in makers.items():
        make(base).write.mode("overwrite").parquet(f"{root}/dim_{name}")
        dims[name] = spark.read.parquet(f"{root}/dim_{name}")
    for role in DATE_ROLES:
        dim_dates(base, role).write.mode("overwrite").parquet(f"{root}/dim_{role}_dates")
    fact_listings(base, dims).write.mode("overwrite").parquet(f"{root}/fact_listings")


def read_star(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a written star."""
    names = ["location", "features", "details", "product", *[f"{role}_dates" for role in DATE_ROLES]]
    return {n: spark.read.parquet(f"{root}/dim_{n}") for n in names} | {"fact": spark.read.parquet(f"{root}/fact_listings")}


def star_view(star: dict[str, DataFrame]) -> DataFrame:
    """Fact rows with dimension attributes, over surrogate keys (many to one), and the drill levels of both dates."""
    loc = star["location"]
    det = star["details"]
    fact = star["fact"]
    for role in DATE_ROLES:
        fact = with_date_levels(fact, star[f"{role}_dates"], role)
    return (
        fact
        .join(loc, "location_skey", "left")
        .join(det, "status_skey", "left")
        .join(star["features"], "feature_skey", "left")
        .join(star["product_keys" if "product_keys" in star else "product"].select("product_skey", "product_id"), "product_skey", "left")
    )


def listing_view(clean: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The star's fact with its location and title attributes, without surrogate keys.

    Each dimension holds the distinct values of columns that the row itself carries, so
    reading them off the row equals the key lookup and needs no join. Only the columns
    asked for pass the dedup shuffle.
    """
    wanted = columns or [
        "price_total", "area", "unit_price", "property_class", "frontage", "frontage_class", "road_width", "road_class",
        "bedrooms", "bathrooms", "floors", "price_trend_1y", "trend_class", "expiry_date", "city", "district", "ward",
        "interior", "legal_class", "post_rank",
    ]
    base = [c for c in wanted if c not in ("product_id", "posted_date", "src_pos")]
    rows = clean.select("product_id", "posted_date", *base, "src_pos")
    return first_rows(rows, ["product_id", "posted_date"], ["src_pos"]).drop("src_pos")


def with_calculated_columns(view: DataFrame) -> DataFrame:
    """Calculated columns of the fact that depend on the row alone."""
    ty = F.col("price_total").cast("double") / 1000
    shape, shape_order = R.plot_shape(F.col("area"), F.col("frontage"))
    out = view.withColumns(
        {
            "price_billion": ty,
            "price_bin": N.bin_floor(ty, 0.5),
            "depth_ratio": N.depth_ratio(F.col("area"), F.col("frontage")),
            "plot_shape": shape,
            "plot_shape_order": shape_order,
            "days_shown": D.days_between(F.col("posted_date"), F.col("expiry_date")),
            "unit_price_bin5": N.bin_floor(F.col("unit_price").cast("double"), 5.0),
            "unit_price_bin2": N.bin_floor(F.col("unit_price").cast("double"), 2.0),
            "area_bin": N.bin_toward_zero(F.col("area"), 50.0),
            "tier": R.paid_tier(F.col("post_rank")),
            "title_group": R.title_group(F.col("legal_class")),
        }
    )
    label, order = R.quality_group(F.col("frontage_class"), F.col("road_class"), F.col("title_group"))
    return with_risk_flags(out.withColumns({"quality_group": label, "quality_order": order}))


def with_price_segment(view: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Segment by the quartiles of the whole table, whatever filters the view has."""
    marks = exact_percentiles(whole if whole is not None else view, "price_total", [0.25, 0.75], ["p25", "p75"])
    label, order = R.price_segment(F.col("price_total").cast("double"), F.col("__q.p25"), F.col("__q.p75"))
    marked = with_scalar(view, "__q", marks.select("p25", "p75"))
    return marked.withColumns({"segment": label, "segment_order": order}).drop("__q")
