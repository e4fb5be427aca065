"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation over blocks.

Components become integers, floor(256 * x). Rows are hashed into blocks of candidates and, for the query set, into blocks of
queries. Each pair of a query block and a candidate block is one group of a co-grouped map: the candidate block is turned into
postings (term -> rows that have it, with weights); for one term after another the query rows that hold the term add
weight times weight at the posting's rows of a dense score array; a partition selection keeps each query's k best, ties to
the smaller id; a last ranking merges the blocks. Groups are bounded on both sides by the block sizes, and all pairs of
blocks are looked at, so results are exact.

Weights and scores beyond 64 bits count as the largest or smallest 64-bit number; all others are exact, since blocks whose sums
could leave 64 bits are computed with Python integers. Vectors that are null, empty of meaning (a null, NaN or infinite component) or lack an id take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landlens.llm.common import ship_code, table
from landlens.session import materialise

SCALE = 256
K = 5
QUERY_EVERY = 50
#: Rows of a block on either side, on average.
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
RESULT = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, w array<long>: usable vectors as integer weights."""
    x = F.col(vector_col)
    # a non-finite float turns into NaN or null under these comparisons
    finite = F.forall(x, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    usable = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(finite)
    return usable.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("w"))


def postings(weights: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows, weights) of the rows where the term's weight isn't 0."""
    sizes = np.array([len(w) for w in weights], np.int64)
    rows = np.repeat(np.arange(len(weights)), sizes)
    terms = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = np.concatenate(weights) if len(weights) else np.zeros(0, np.int64)
    keep = values != 0
    rows, terms, values = rows[keep], terms[keep], values[keep]
    order = np.argsort(terms, kind="stable")
    rows, terms, values = rows[order], terms[order], values[order]
    cuts = np.flatnonzero(np.diff(terms)) + 1
    starts = np.concatenate([[0], cuts]) if len(terms) else np.zeros(0, np.int64)
    return {int(terms[s]): (r, v) for s, r, v in zip(starts, np.split(rows, cuts), np.split(values, cuts), strict=False)}


def search_block(query_ids: np.ndarray, queries: list[np.ndarray], ids: np.ndarray, candidates: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best in the block; a row is never its own answer."""
    largest = [max((max(int(w.max()), -int(w.min())) for w in side if len(w)), default=0) for side in (queries, candidates)]
    # products and sums of such weights can leave 64 bits: Python integers, in smaller steps
    wide = largest[0] * largest[1] * max((len(w) for w in queries), default=0) >= 2**63
    number = object if wide else np.int64
    index = postings(candidates)
    out = []
    step = max(1, (400_000 if wide else 4_000_000) // max(1, len(ids)))  # dense scores of a few queries at a time
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))  # rows in id order, so that ties go to the smaller id
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        scores = np.zeros((len(part), len(ids)), number)
        for term, (q_rows, q_weights) in postings(part).items():
            if term in index:
                rows, weights = index[term]
                weights, q_weights = weights.astype(number, copy=False), q_weights.astype(number, copy=False)
                places = place[rows]
                if len(rows) == len(ids):
                    dense = np.empty(len(ids), number)
                    dense[places] = weights
                    for q, w in zip(q_rows, q_weights, strict=True):
                        scores[q] += w * dense
                else:
                    for q, w in zip(q_rows, q_weights, strict=True):
                        scores[q, places] += w * weights
        if wide:
            scores = np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64)
        for q in range(len(part)):
            row = scores[q]
            own = ids[by_id] == query_ids[at + q]
            free = np.flatnonzero(~own)
            if len(free) > k:
                found = row[free]
                edge = np.partition(found, len(found) - k)[len(found) - k]
                above, equal = free[found > edge], free[found == edge]
                free = np.concatenate([above, equal[: k - len(above)]])
            out.append((np.full(len(free), at + q), by_id[free], row[free]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def top_k(vectors: DataFrame, is_query: Column, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for ``vectors`` (vec_id, w) kept in a table; ``is_query`` names the query rows.

    Every row but those with the query's own id is a candidate. Repeated ids are candidates of their own; a repeated query
    row is asked once (the row with the smallest weights). An empty table gives no rows.
    """
    ship_code(vectors.sparkSession)
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("w").alias("w"))
    n_rows, n_queries = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    q_blocks, c_blocks = max(1, -(-n_queries // query_block)), max(1, -(-n_rows // candidate_block))
    left = queries.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"), "vec_id", "w"
    )
    right = vectors.select(
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("__q"), F.pmod(F.xxhash64("vec_id", "w"), F.lit(c_blocks)).cast("int").alias("cb"), "vec_id", "w"
    ).select(F.col("__q").cast("long").alias("qb"), "cb", "vec_id", "w")

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        q_ids, c_ids = q["vec_id"].to_numpy(np.int64), c["vec_id"].to_numpy(np.int64)
        ask, found, score = search_block(q_ids, [np.asarray(w, np.int64) for w in q["w"]], c_ids, [np.asarray(w, np.int64) for w in c["w"]], k)
        return pd.DataFrame({"query_id": q_ids[ask], "vec_id": c_ids[found], "score": score})

    near = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(search, RESULT)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
e AS (SELECT vec_id, unnest(w) AS w, generate_subscripts(w, 1) AS t FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM e q JOIN e c ON q.t = c.t AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
  GROUP BY q.vec_id, c.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
) WHERE rank <= 5
"""


def op10_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = materialise(integers(table(spark, sf_dir, "embeddings")), "top-k-weights")
    return top_k(vectors, F.col("vec_id") % QUERY_EVERY == 0)
