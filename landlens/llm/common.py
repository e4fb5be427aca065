"""What the operators share: row maps over Arrow batches, bounded caches, tokenizer files."""

from __future__ import annotations

import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words kept per Python worker by the word caches; a full cache starts anew, so memory is bounded.
CACHE_WORDS = 1_000_000
#: Longer words are computed every time, so that one entry stays small.
CACHE_CHARS = 64
#: Rows a batch function sees at once.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The path of a public tokenizer's file; the files stay where they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}-code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Map column lists to column lists, ``rows`` rows at a time. ``make`` runs once a task and returns the function."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship_code(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def fold(key: str | Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % modulus


def crc(data: bytes) -> int:
    return zlib.crc32(data)


class WordCache(dict):
    """word -> value, computed by ``fn`` on first sight; it starts anew when it is full."""

    def __init__(self, fn: Callable[[str], object], words: int = CACHE_WORDS):
        super().__init__()
        self.fn, self.words = fn, words

    def __missing__(self, word: str):
        value = self.fn(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.words:
                self.clear()
            self[word] = value
        return value


def sum_vectors(parts: DataFrame) -> DataFrame:
    """Add up vectors that tasks give in slices: rows (part long, slice int, data binary of float64) to (slice, data).

    Sums go through groups of 64 parts first, so that no task gathers the slices of all parts.
    """
    import numpy as np
    import pandas as pd

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<f8") for x in rows["data"])
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // 64], "slice": [int(rows["slice"].iloc[0])], "data": [total.tobytes()]})

    schema = "part long, slice int, data binary"
    some = parts.groupBy("slice", F.floor(F.col("part") / 64).alias("__group")).applyInPandas(add, schema)
    return some.groupBy("slice").applyInPandas(add, schema).select("slice", "data")
