"""Token ids in word-aligned files: Simple-8b words with escapes, in blocks with their own offsets.

A block holds the ids of whole documents. Its header gives the number of words, of ids and of exceptions; the body is 64-bit
little-endian words, then the exceptions. The upper 4 bits of a word select how many ids the other 60 bits hold; selector 15
is an escape, whose 60 bits are an index into the block's exceptions (ids that need more than 60 bits). Word counts follow
from the selectors, so one cumulative sum gives every word's place, and all words of one selector are unpacked together.

Files are written by Spark in ascending doc_id order: texts are dealt into ranges of doc_id, each range is one shard whose
blocks are rows (shard, block, document ids, document ends, payload). A reader needs the blocks alone. Spark commits whole
shards, so a lost executor leaves no half-written one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landlens.llm.common import crc, map_rows, ship_code, table, tokenizer_file
from landlens.llm.tokens import word_tokenizer
from landlens.session import shared_dir

#: Ids per word for selectors 0 to 14 (60 // count bits each): fixed values of the format.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
MAGIC = 0x38423853
#: Ids in a block, about: a block is closed when it holds as many.
BLOCK_IDS = 1 << 16
TOKENIZER = "word_bpe_49k.json"
END = 1
BLOCKS = "first_doc long, shard int, block int, n_ids long, doc_ids binary, doc_ends binary, payload binary"


def encode_block(ids: np.ndarray) -> bytes:
    """Pack ids (unsigned 64-bit) into words; greedy, the most ids a word can hold."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    large = ids >> np.uint64(60) != 0
    exceptions = ids[large]
    least = np.zeros(n, np.uint8)  # the first selector whose bits hold an id
    for count in COUNTS:
        least += ids >= np.uint64(1 << 60 // count)
    tops = {1: least}  # the largest of so many from a place on; any number is covered by two powers of two
    while (size := max(tops)) * 2 <= min(n, COUNTS[0]):
        tops[2 * size] = np.maximum(tops[size][: n - 2 * size + 1], tops[size][size:])
    best = np.full(n, ESCAPE, np.uint8)  # the selector of a word that starts here
    for selector in range(len(COUNTS) - 1, -1, -1):
        count = COUNTS[selector]
        if count > n:
            continue
        size = 1 << count.bit_length() - 1
        top = np.maximum(tops[size][: n - count + 1], tops[size][count - size :])
        np.putmask(best[: n - count + 1], top <= selector, selector)
    step = np.array([*COUNTS, 1, 1], np.int64)[best].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    chosen = best[starts] if n else np.zeros(0, np.uint8)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, count in enumerate(COUNTS):
        mine = np.flatnonzero(chosen == selector)
        if len(mine):
            bits = 60 // count
            first, held = starts[mine], words[mine]
            for k in range(count):
                held |= ids[first + k] << np.uint64(bits * k)
            words[mine] = held
    escaped = chosen == ESCAPE
    words[escaped] |= np.arange(int(escaped.sum()), dtype=np.uint64)
    header = np.array([MAGIC, len(words), n, len(exceptions)], "<u8")
    return header.tobytes() + words.astype("<u8").tobytes() + exceptions.astype("<u8").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block, unpacked selector by selector."""
    magic, n_words, n, n_exceptions = (int(x) for x in np.frombuffer(data, "<u8", 4))
    if magic != MAGIC or len(data) != 8 * (4 + n_words + n_exceptions):
        raise ValueError("not a whole block of this format")
    words = np.frombuffer(data, "<u8", n_words, 32)
    exceptions = np.frombuffer(data, "<u8", n_exceptions, 32 + 8 * n_words)
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    ends = np.cumsum(np.array([*COUNTS, 1, 1], np.int64)[chosen])
    if (int(ends[-1]) if n_words else 0) != n:
        raise ValueError("the words of the block don't hold as many ids as its header says")
    starts = ends - np.array([*COUNTS, 1, 1], np.int64)[chosen]
    out = np.zeros(n, np.uint64)
    for selector, count in enumerate(COUNTS):
        mine = np.flatnonzero(chosen == selector)
        if len(mine):
            bits = 60 // count
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            values = words[mine][:, None] >> shifts & np.uint64((1 << bits) - 1)
            out[starts[mine][:, None] + np.arange(count)] = values
    escaped = np.flatnonzero(chosen == ESCAPE)
    out[starts[escaped]] = exceptions[(words[escaped] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of every text (null: empty) with the end id behind them to ``out``, in ascending doc_id order.

    Rows with a null doc_id come first; rows with equal ids follow each other in the order of their texts.
    """
    ship_code(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, end = word_tokenizer(path), np.uint32(end_id).tobytes()
        shard, number = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        parts: list[bytes] = []
        ends: list[int] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number, size
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = {
                "first_doc": [names[0]], "shard": [shard], "block": [number], "n_ids": [size],
                "doc_ids": [np.array([-1 if x is None else x for x in names], "<i8").tobytes() + np.array([x is None for x in names], np.uint8).tobytes()],
                "doc_ends": [np.array(ends, "<i8").tobytes()], "payload": [encode_block(ids)],
            }
            number, size = number + 1, 0
            names.clear(), parts.clear(), ends.clear()
            kinds = {"shard": pa.int32(), "block": pa.int32(), "doc_ids": pa.binary(), "doc_ends": pa.binary(), "payload": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in row.items()], names=list(row))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1).to_pylist()), strict=True):
                    names.append(doc_id)
                    parts.append(ids + end)
                    size += len(ids) // 4 + 1
                    ends.append(size)
                    if size >= block_ids:
                        yield block()
        if names:
            yield block()

    ordered.mapInArrow(write, BLOCKS).write.mode("errorifexists").parquet(out)


def read_ids(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with ``keep_ids`` the ids, from the files."""
    blocks = spark.read.parquet(path)
    # one row a shard and one a block of a shard: their sums give every block's place
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    index = blocks.select("shard", "block", "n_ids").join(shards, "shard")
    within = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    index = index.select("shard", "block", (F.coalesce(F.sum("n_ids").over(within), F.lit(0)) + F.col("before")).alias("start"))
    schema = "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")

    def make():
        def run(cols):
            out = {n: [] for n in ("shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32", "ids")}
            for shard, block, names, ends, payload in zip(*(cols[c] for c in ("shard", "block", "doc_ids", "doc_ends", "payload")), strict=True):
                ids = decode_block(payload)
                data = ids.astype("<u4").tobytes()
                stops = np.frombuffer(ends, "<i8").tolist()
                doc_ids = np.frombuffer(names, "<i8", len(stops)).tolist()
                missing = names[8 * len(stops) :]
                at = 0
                for k, stop in enumerate(stops):
                    row = (shard, block, None if missing[k] else doc_ids[k], at, stop - at, crc(data[4 * at : 4 * stop]))
                    for n, v in zip(out, row, strict=False):
                        out[n].append(v)
                    if keep_ids:
                        out["ids"].append(ids[at:stop].astype(np.int64))
                    at = stop
            return out

        return run

    rows = map_rows(blocks.select("shard", "block", "doc_ids", "doc_ends", "payload"), make, schema, rows=1)
    joined = rows.join(index, ["shard", "block"])
    kept = ["n_tokens", "ids_crc32", *["ids"] * keep_ids]
    return joined.select("doc_id", (F.col("start") + F.col("inside")).alias("start"), *kept)


def op6_id_files(spark, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "id-files")
    write_ids(table(spark, sf_dir, "documents"), tokenizer_file(TOKENIZER), out)
    return read_ids(spark, out)
