"""Scans and sinks: CSV, parquet, JSON log, district shapes, date tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import date_parts
from ..session import materialise

LOG_SCHEMA = (
    "timestamp string, user_prompt string, explanation string, generated_code string, executed_code string, "
    "code_modified boolean, result_summary string, error string"
)
SHAPES_SCHEMA = (
    "objects map<string, struct<type:string, geometries:array<struct<type:string, "
    "properties:struct<level2_id:string,name:string,label_lon:double,label_lat:double>>>>>"
)


# An unquoted empty cell is read as `nullValue`, which no cell holds, and so told from a quoted one.
CSV_FORMAT = {
    "nullValue": "\x00", "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE",
}


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files as text, `first` for the first of a file; quoted cells may hold line breaks.

    Files are read by splits. A line ends inside a cell if the quotes up to it are odd in number: lines are counted within
    their split, splits within their file, so no task reads a whole file. A split that no cell with a line break touches has
    a record in every line, and its lines stay where they are. In the others the lines of one record are put together; only
    what crosses the edge of a split is gathered again. A compressed file is one split.
    """
    value = F.col("value")
    lines = (
        spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
        .select(
            value, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"), ((F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2).alias("odd"),
        )
    )
    # one row a split, hence the broadcast
    by_file = Window.partitionBy("file").orderBy("block")
    splits = lines.groupBy("file", "block").agg(F.sum("odd").alias("odds"), F.min("line").alias("top"))
    inside, left = (F.sum("odds").over(by_file) - F.col("odds")) % 2, F.sum("odds").over(by_file) % 2
    states = materialise(splits.select("file", "block", "top", inside.alias("inside"), left.alias("left"), ((F.col("odds") == 0) & (inside == 0)).alias("plain")), "csv-splits")
    known = F.broadcast(states.select(F.col("file").alias("__file"), F.col("block").alias("__block"), "top", "inside", "left", "plain"))
    in_split = Window.partitionBy("file", "block").orderBy("line")
    joined = lines.join(known, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    single = joined.where("plain").select("file", F.col("value").alias("text"), ((F.col("block") == 0) & (F.col("line") == F.col("top"))).alias("first"))
    joined = joined.where(~F.col("plain"))
    starts = (((F.col("inside") + F.sum("odd").over(in_split) - F.col("odd")) % 2) == 0).cast("int")
    numbered = joined.withColumn("starts", starts).withColumn("record", F.sum("starts").over(in_split))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    records = numbered.groupBy("file", "block", "record").agg(text.alias("text"), F.max("left").alias("left"))
    last = F.max("record").over(Window.partitionBy("file", "block"))
    records = records.withColumn("whole", (F.col("record") > 0) & ((F.col("record") < last) | (F.col("left") == 0)))
    whole = records.where("whole").select("file", "text", ((F.col("block") == 0) & (F.col("record") == 1)).alias("first"))
    # at most two parts a split
    home = F.sum((F.col("record") > 0).cast("int")).over(Window.partitionBy("file").orderBy("block", "record"))
    parts = records.where(~F.col("whole")).withColumn("home", home)
    order = F.array_sort(F.collect_list(F.struct("block", "record", "text")))
    broken = parts.groupBy("file", "home").agg(order.alias("parts")).select(
        "file", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"),
        ((F.col("parts")[0]["block"] == 0) & (F.col("parts")[0]["record"] == 1)).alias("first"),
    )
    return single.unionByName(whole).unionByName(broken).withColumn("text", F.regexp_replace("text", r"\r$", ""))


def _cells(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """file and the cells of every record as text; the header of each file must name the columns."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = csv_records(spark, path).where(F.col("text") != "").withColumn("cell", F.from_csv("text", F.lit(schema), CSV_FORMAT))
    names = F.array(*[F.col("cell")[c] for c in columns])
    wrong = F.raise_error(F.concat(F.lit("the header of "), "file", F.lit(" names other columns"))).cast("boolean")
    kept = F.when(~F.col("first"), True).when(names == F.array(*[F.lit(c) for c in columns]), False).otherwise(wrong)
    return rows.where(kept).select("file", *[F.col("cell")[c].alias(c) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV files below a path as text columns, line breaks and empty cells kept; an unquoted empty cell is missing."""
    return _cells(spark, path, columns).drop("file")


def iso_dates(df: DataFrame) -> DataFrame:
    """Date and time columns as ISO text."""
    casts = {
        c: F.date_format(c, "yyyy-MM-dd" if t == "date" else "yyyy-MM-dd'T'HH:mm:ss")
        for c, t in df.dtypes
        if t in ("date", "timestamp", "timestamp_ntz")
    }
    return df.withColumns(casts)


#: Records of a compressed file, which one task has to read.
COMPRESSED_RECORDS = 200_000


def write_csv(df: DataFrame, path: str, append: bool = False, compression: str = "none") -> None:
    """Write or append a CSV dataset; each part file has the header, dates are ISO.

    A compressed file cannot be read by splits, so its records are bounded.
    """
    (
        iso_dates(df)
        .write.mode("append" if append else "overwrite")
        .option("header", True)
        .option("compression", compression)
        .option("maxRecordsPerFile", 0 if compression == "none" else COMPRESSED_RECORDS)
        .option("escape", '"')
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_segments(spark: SparkSession, root: str, columns: Sequence[str]) -> DataFrame:
    """All segment folders below a root as one table; the folder names the segment."""
    folder = F.regexp_extract("file", r"/segment=([^/]*)/[^/]*$", 1)
    return _cells(spark, root, columns).withColumn("segment", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).drop("file")


def write_segments(df: DataFrame, root: str, segment: Column) -> None:
    """One folder per property segment; filters on the segment prune folders."""
    (
        df.withColumn("segment", segment)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .partitionBy("segment")
        .csv(root)
    )


def append_log(df: DataFrame, path: str) -> None:
    """Append session entries as JSON lines."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The latest entries; a bounded top-k, so no full sort is planned."""
    return spark.read.schema(LOG_SCHEMA).json(path).orderBy(F.desc("timestamp")).limit(limit)


def shape_properties(document: Column) -> Column:
    """Array of region properties inside a TopoJSON text, polygon arcs unread."""
    parsed = F.from_json(document, SHAPES_SCHEMA)
    groups = F.transform(F.map_values(parsed["objects"]), lambda o: o["geometries"])
    return F.transform(F.flatten(groups), lambda g: g["properties"])


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a TopoJSON file: id, name and label position."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.inline(shape_properties(F.col("value"))))


def date_table(df: DataFrame, column: str) -> DataFrame:
    """Every day from 1 January of the first year to 31 December of the last year."""
    span = df.agg(F.min(F.to_date(column)).alias("a"), F.max(F.to_date(column)).alias("b"))
    days = F.sequence(
        F.make_date(F.year("a"), F.lit(1), F.lit(1)), F.make_date(F.year("b"), F.lit(12), F.lit(31))
    )
    dates = span.select(F.explode(days).alias("date"))
    return dates.withColumns(date_parts(F.col("date")))


def literal_table(spark: SparkSession, rows: Sequence[Sequence], columns: Mapping[str, str]) -> DataFrame:
    """A small table typed in the program."""
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
