"""Joins, dedup and sequence keys that hold up under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_lookup(fact: DataFrame, dim: DataFrame, keys: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Left lookup in which a missing key matches a missing key.

    Spark plans the null-safe equality as an equi-join, so a small dimension is
    broadcast by its measured size and a large one is sorted and merged, with
    skewed fact partitions split by adaptive execution.
    """
    side = dim.select(*[F.col(k).alias(f"__{k}") for k in keys], *take)
    cond = None
    for k in keys:
        c = fact[k].eqNullSafe(side[f"__{k}"])
        cond = c if cond is None else cond & c
    return fact.join(side, cond, "left").drop(*[f"__{k}" for k in keys])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of each key by an explicit order.

    An aggregate, not a window: each task keeps one row per key before the shuffle,
    so a key that holds a third of all rows costs one row per task.
    """
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    picked = df.groupBy(*keys).agg(F.min_by(row, rank).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`first_per_key` for a caller that reads few of the columns: the others are pruned before the shuffle.

    The limit on the row number is pushed in front of the shuffle, so here too a task keeps one row per key.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_first() for o in order]))
    return df.withColumn("__place", place).where(F.col("__place") == 1).drop("__place")


def key_bucket(keys: Sequence[str], digits: int) -> Column:
    """Leading hex digits of a digest over the key columns; nulls have their own mark."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("␀")) for k in keys]
    return F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, digits)


def with_sequence_key(df: DataFrame, keys: Sequence[str], name: str, digits: int = 3) -> DataFrame:
    """Dense key 1..n over rows that are unique by `keys`.

    Rows are spread over 16**digits digest buckets, numbered inside their bucket and
    shifted by the rows in the buckets before it. The order is a function of the data,
    so a task that runs again gives the same numbers; no task sorts the whole table.
    The offset table has at most 16**digits rows, hence the broadcast.
    """
    bucketed = df.withColumn("__bucket", key_bucket(keys, digits))
    sizes = bucketed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__bucket")) - F.col("__n")
    offsets = sizes.select(F.col("__bucket").alias("__b"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys]))
    numbered = bucketed.withColumn("__i", inside)
    joined = numbered.join(F.broadcast(offsets), numbered["__bucket"] == offsets["__b"], "inner")
    return joined.withColumn(name, (F.col("__before") + F.col("__i")).cast("long")).drop(
        "__bucket", "__b", "__before", "__i"
    )


def sequence_order_sql(keys: Sequence[str], digits: int = 3) -> str:
    """The ORDER BY list that `with_sequence_key` follows."""
    parts = ", ".join(f"coalesce(CAST({k} AS STRING), '␀')" for k in keys)
    tail = ", ".join(f"{k} NULLS FIRST" for k in keys)
    return f"substr(md5(concat_ws('|', {parts})), 1, {digits}), {tail}"


def pending(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is not yet done."""
    return candidates.join(done.select(key), key, "left_anti")


def first_seen(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Distinct keys with the position at which each was first met."""
    return df.groupBy(key).agg(F.min(F.struct(*order)).alias("first_at"))


def grow_set(done: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union of two key sets; adding the same key twice changes nothing."""
    return done.select(key).unionByName(new.select(key)).distinct()


def needs_backfill(df: DataFrame, url: str, fields: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Rows with an address in which a field is missing, blank or the text `nan`."""
    def absent(c: str) -> Column:
        text = F.lower(F.btrim(F.col(c).cast("string")))
        return F.coalesce(text.isin("", "nan"), F.lit(True))

    usable = F.coalesce(F.btrim(F.col(url)), F.lit("")) != ""
    if overwrite:
        return df.where(usable)
    missing = absent(fields[0])
    for c in fields[1:]:
        missing = missing | absent(c)
    return df.where(usable & missing)


def update_by_key(base: DataFrame, updates: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Base rows with `fields` replaced where an update row exists, also by null.

    `updates` holds one row per key, so the join cannot multiply base rows.
    """
    side = updates.select(
        F.col(key).alias("__key"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in fields]
    )
    joined = base.join(side, base[key] == side["__key"], "left")
    cols = [
        F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in base.columns
    ]
    return joined.select(*cols)


def ensure_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Add missing columns as nulls of the given type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns})
