"""Incremental page ingest with Structured Streaming.

The stream's checkpoint remembers the files already read; the state store remembers
the addresses already delivered. A batch that runs again writes the same folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pages import extract_listings

PAGE_SCHEMA = "page_id bigint, url string, html string"


def table_path(sf_dir: str, name: str) -> str:
    """A table's path for a stream, be the table one file or a folder of part files.

    The pattern in it makes the source list what matches instead of taking a single file for a folder.
    """
    return f"{sf_dir.rstrip('/')}/{name}.parque[t]"


def page_stream(spark: SparkSession, folder: str, glob: str | None = "*.parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def first_versions(pages: DataFrame) -> DataFrame:
    """One delivery per address and text over the life of the stream, for what is extracted depends on no more.

    That also deals the pages before the dear step: a batch may be a few files, each with one row group. The state holds 16 bytes a version.
    """
    parts = [F.col("url").isNull().cast("string"), F.coalesce("url", F.lit("")), F.lit("\n"), F.col("html").isNull().cast("string"), F.coalesce("html", F.lit(""))]
    version = F.unhex(F.md5(F.concat(F.length(F.coalesce("url", F.lit(""))).cast("string"), *parts)))
    return pages.withColumn("__version", version).dropDuplicates(["__version"]).drop("__version")


def first_by_url(rows: DataFrame) -> DataFrame:
    """One delivery per address and outcome over the life of the stream.

    A rejected address stays open: its first valid version is still delivered.
    """
    outcome = F.when(F.col("reject_reason").isNull(), "valid").otherwise("rejected")
    return rows.withColumn("outcome", outcome).dropDuplicates(["url", "outcome"])


def append_parquet(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch exactly once, then stop when the input is used up."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_pages(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    site: str,
    as_of: Column,
    glob: str | None = "*.parquet",
    max_files: int | None = None,
) -> StreamingQuery:
    """Pages to listings: valid rows and rejects go to two tables, one folder per batch.

    Writing a batch into its own folder in overwrite mode makes a repeated batch
    harmless; the rows a batch holds are fixed by the checkpoint.
    """
    pages = first_versions(page_stream(spark, folder, glob, max_files))
    rows = first_by_url(extract_listings(pages, site, as_of))

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_listings(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(out).where("outcome = 'valid'").drop("outcome", "batch", "reject_reason")


def read_rejects(spark: SparkSession, out: str) -> DataFrame:
    """Failed rows; their addresses are fed again on the next run of a repair job."""
    return spark.read.option("basePath", out).parquet(out).where("outcome = 'rejected'").drop("outcome", "batch")
