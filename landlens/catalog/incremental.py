"""Incremental ingest: streams that run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.pages import split_listings
from ..operators.relational import needs_backfill, pending
from ..session import shared_dir
from ..sources.listings import raw_listings
from ..sources.pages import SITE, listing_pages
from ..streaming import ingest as I
from .checks import RAW
from .registry import query, table

_VALID = "p_partkey % 50 NOT IN (7, 9)"
_URL = "'https://nha.example.com/ban-nha-' || lower(p_type) || '-pr' || p_partkey"


@query("x1_resumable_ingest", "SELECT page_id, url FROM pages")
def x1(spark, d):
    out, checkpoint = shared_dir(spark, "pages"), shared_dir(spark, "progress")
    # The second run resumes from the checkpoint and finds nothing new.
    for _ in range(2):
        stream = I.page_stream(spark, I.table_path(d, "pages"), glob=None).select("page_id", "url")
        I.append_parquet(stream, out, checkpoint).awaitTermination()
    return spark.read.schema("page_id bigint, url string").parquet(out)


@query("x2_first_delivery_per_url", "SELECT user_id, event_type FROM events GROUP BY ALL")
def x2(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(I.table_path(d, "events"))
    unique = stream.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    out = shared_dir(spark, "events")
    I.append_parquet(unique, out, shared_dir(spark, "progress")).awaitTermination()
    return spark.read.schema("user_id bigint, event_type string").parquet(out)


@query("x3_batched_page_ingest", f"SELECT {_URL} AS url FROM part WHERE {_VALID}")
def x3(spark, d):
    folder = shared_dir(spark, "incoming")
    # Every page arrives twice, in two deliveries.
    for _ in range(2):
        listing_pages(spark, d).coalesce(4).write.mode("append").parquet(folder)
    out, checkpoint = shared_dir(spark, "listings"), shared_dir(spark, "progress")
    as_of = F.to_date(F.lit("2024-01-01"))
    I.ingest_pages(spark, folder, out, checkpoint, SITE, as_of, max_files=6).awaitTermination()
    return I.read_listings(spark, out).select("url")


@query("x4_rejects_stay_pending", f"SELECT {_URL} AS url FROM part WHERE NOT ({_VALID})")
def x4(spark, d):
    pages = listing_pages(spark, d)
    done, _ = split_listings(pages, SITE, F.to_date(F.lit("2024-01-01")), columns=["url"])
    return pending(pages.select("url"), done, "url")


@query(
    "x4_backfill_overwrite",
    f"{RAW} SELECT count(*) AS n FROM listings WHERE url <> ''",
)
def x4_overwrite(spark, d):
    rows = needs_backfill(raw_listings(spark, d), "url", ["frontage", "road_width"], overwrite=True)
    return rows.agg(F.count(F.lit(1)).alias("n"))
