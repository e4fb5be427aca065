"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every shingle of five words is hashed once. The hash's upper bits choose one of ``BINS`` bins, a bin keeps its smallest hash.
An empty bin takes the value of the first filled bin in a probing order of its own (the same for all documents); that order
is a hash of the pair of bins, so the first filled one is the one with the smallest hash. Of each value the ``BITS`` low-order
bits are kept, two hex digits a bin. Two fingerprints' share of equal bins is corrected for chance agreement of the low bits.

All of it is array expressions of one row; a document is never spread over rows, so a fingerprint shuffles nothing.
A text of one to four words is one shingle; an empty or null one has none: its fingerprint is the empty string, alike to
itself (1) and to nothing else (0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landlens.llm.common import table
from landlens.session import materialise

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 8
#: Neighbouring doc_ids that one task orders together, about.
BUCKET_DOCS = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all runs of ``words`` words; of the whole text if it has fewer; empty if it has none."""
    hashes = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(n >= words, each).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, runs)


def bin_minima(hashes: Column) -> Column:
    """The smallest hash of each filled bin, in bin order of signed hashes."""
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def densified(minima: Column) -> Column:
    """A value for every bin; an empty bin's comes from the first filled bin of its probing order."""

    def fill(filled: Column) -> Column:
        bins = F.transform(filled, bin_of)

        def value(b: Column, have: Column) -> Column:
            at = F.array_position(have, b)
            probe = F.array_min(F.transform(filled, lambda m: F.struct(F.xxhash64(b, bin_of(m)).alias("order"), m.alias("m"))))
            return F.when(at > 0, F.get(filled, (at - 1).cast("int"))).otherwise(probe["m"])

        return let(bins, lambda have: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: value(b.cast("bigint"), have)))

    return let(minima, lambda m: F.when(F.size(m) > 0, fill(m)).otherwise(F.array().cast("array<bigint>")))


def fingerprint(text: Column) -> Column:
    """Hex string, two digits a bin; empty for a text without words."""
    low = F.transform(densified(bin_minima(shingle_hashes(F.coalesce(text, F.lit(""))))), lambda v: F.substring(F.hex(v.bitwiseAND((1 << BITS) - 1) + (1 << BITS)), 2, 2))
    return F.array_join(low, "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of shingles in common (0 to 1) of two fingerprints."""
    chance = 1.0 / (1 << BITS)
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * 2 + 1, F.lit(2)) == F.substring(b, i * 2 + 1, F.lit(2))))
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.when(a == b, 1.0).otherwise(corrected))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row; other columns are not looked at."""
    return docs.select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint, next_text and next_fingerprint in descending doc_id order; after the last comes the first.

    Rows with equal ids follow each other in the order of their texts, rows without an id come last. Texts move once, to
    buckets of neighbouring ids; the bucket's last row takes its successor from the list of the buckets' first rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = max(1, ((high or 0) - (low or 0) + 1) * BUCKET_DOCS // max(1, n))
    docs = docs.withColumn("__b", F.coalesce(F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(low or 0)) / width).cast("long"), F.lit(-1)))
    tops = docs.groupBy("__b").agg(F.max("doc_id").alias("__top"))
    every = W.orderBy(F.desc("__b"))  # one row a bucket
    # the bucket whose last row this bucket's first row follows
    tops = tops.withColumn("__for", F.lag("__b").over(every)).withColumn("__last", F.min("__b").over(W.partitionBy()))
    tops = materialise(tops.select("__b", "__top", F.coalesce("__for", "__last").alias("__for")), "fingerprint-buckets")
    heads = docs.alias("d").join(tops.alias("t"), (F.col("d.__b") == F.col("t.__b")) & F.col("d.doc_id").eqNullSafe(F.col("t.__top")))
    heads = heads.groupBy(F.col("t.__for").alias("__b")).agg(F.min("d.text").alias("__head")).withColumn("__head_print", fingerprint(F.col("__head")))
    order = W.partitionBy("__b").orderBy(F.desc_nulls_last("doc_id"), "text")
    rows = docs.withColumn("fingerprint", fingerprint(F.col("text")))
    rows = rows.withColumn("__next", F.lead("text").over(order)).withColumn("__next_print", F.lead("fingerprint").over(order)).join(heads, "__b", "left")
    return rows.select("doc_id", "text", "fingerprint", F.coalesce("__next", "__head").alias("next_text"), F.coalesce("__next_print", "__head_print").alias("next_fingerprint"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text whose second half is the next document's beginning, with their likeness."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select(
        "doc_id", "n_chars", "fingerprint", "next_fingerprint", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
