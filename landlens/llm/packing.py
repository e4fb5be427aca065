"""Best-fit packing of documents into sequences, with exact complements found by hashing of length sums.

Only lengths decide where pieces go, and there are at most ``size`` different ones. The plan is therefore made on the counts of
the lengths (a table of at most ``size`` rows, whatever the corpus holds): the longest piece left opens a sequence, its gap is
looked up among single lengths, sums of two and sums of three, all under the counts that are left, and only when no
combination fills it exactly does the largest fitting piece go in (best fit), after which the rest of the gap is looked up
again. A sequence found once is repeated as often as the counts allow, so the plan is a short list of runs.

Spark then numbers the pieces of each length, in slices that are cut to a row bound (one length may hold a third of all
rows), and each numbered piece finds its sequence and place in the runs by binary search.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landlens.llm.common import crc, map_rows, table, tokenizer_file
from landlens.llm.tokens import word_tokenizer
from landlens.session import materialise

SIZE = 2048
END = 0
TOKENIZER = "byte_bpe_50k.json"
#: Rows of one length that one task numbers, on average.
SLICE_ROWS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


class LengthIndex:
    """Counts of lengths with an index of the sums of two lengths that are left."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64)
        self.size = len(counts) - 1
        self.pair_ways = np.zeros(self.size + 1, np.int64)
        for a in np.flatnonzero(self.counts):
            self._pairs_of(int(a), 1, upto=int(a))

    def _pairs_of(self, a: int, sign: int, upto: int | None = None) -> None:
        """Add or drop the sums of ``a`` with the lengths present (up to ``upto``, itself included)."""
        others = np.flatnonzero(self.counts[: (self.size if upto is None else upto) + 1])
        sums = others + a
        self.pair_ways[sums[sums <= self.size]] += sign

    def take(self, lengths: dict[int, int], times: int) -> None:
        for a, n in lengths.items():
            if self.counts[a] == n * times:
                self._pairs_of(a, -1)
            self.counts[a] -= n * times

    def largest(self, limit: int, used: dict[int, int]) -> int:
        """The largest length of at most ``limit`` that is left beside those used, or 0."""
        for a in np.flatnonzero(self.counts[: limit + 1])[::-1]:
            if a and self.counts[a] > used.get(int(a), 0):
                return int(a)
        return 0

    def exact(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """One, two or three lengths left that sum to ``gap``; larger ones first, so that short pieces stay for later."""

        def left(*lengths: int) -> bool:
            return all(self.counts[a] - used.get(a, 0) >= lengths.count(a) for a in set(lengths))

        if left(gap):
            return [gap]
        here = np.flatnonzero(self.counts[:gap])
        here = here[here > 0][::-1]
        if self.pair_ways[gap]:
            for a in here[(here >= gap - here) & (self.counts[gap - here] > 0)]:
                if left(int(a), gap - int(a)):
                    return [int(a), gap - int(a)]
        for a in here[(3 * here >= gap) & (self.pair_ways[gap - here] > 0)]:
            rest = gap - int(a)
            low = here[(here <= a) & (here < rest)]
            for b in low[(low >= rest - low) & (self.counts[rest - low] > 0)]:
                if left(int(a), int(b), rest - int(b)):
                    return [int(a), int(b), rest - int(b)]
        return None


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, times it is made), for counts[length]; uses every piece once."""
    index, size, out = LengthIndex(counts), len(counts) - 1, []
    while True:
        first = index.largest(size, {})
        if not first:
            return out
        made, used, gap = [first], {first: 1}, size - first
        while gap:
            more = index.exact(gap, used)
            if more is None:
                best = index.largest(gap, used)
                if not best:
                    break
                more = [best]
            for a in more:
                used[a] = used.get(a, 0) + 1
            made += more
            gap -= sum(more)
        times = min(int(index.counts[a]) // n for a, n in used.items())
        index.take(used, times)
        out.append((made, times))


def runs(sequences: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces per sequence, first sequence, offset): where the pieces of a rank go."""
    at: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for made, times in sequences:
        offset = 0
        for a in dict.fromkeys(made):
            n = made.count(a)
            rows.setdefault(a, []).append((at.get(a, 0), n, sequence, offset))
            at[a] = at.get(a, 0) + n * times
            offset += a * n
        sequence += times
    return {a: np.array(r, np.int64) for a, r in rows.items()}


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole if they fit, else full pieces behind a first one that may be shorter."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return ([(0, head)] if head else []) + [(s, size) for s in range(head, n, size)]


def tokenized_pieces(docs: DataFrame, path: str, end_id: int = END, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """Pieces of every text's ids with the end id behind them; ``keep_ids`` adds the ids themselves (little-endian, 32 bits)."""
    schema = PIECES + (", ids binary" if keep_ids else "")

    def make():
        tokens, end = word_tokenizer(path), np.uint32(end_id).tobytes()

        def run(cols):
            out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, ids in zip(cols["doc_id"], tokens.encode(cols["text"]), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + length)]
                    for name, value in zip(out, (doc_id, k, start, length, crc(part), part), strict=True):
                        out[name].append(value)
            return out

        return run

    return map_rows(docs.select("doc_id", "text"), make, schema)


def place(pieces: DataFrame, size: int = SIZE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add sequence_id and offset to pieces (of 1 to ``size`` tokens) that are kept in a table.

    Rows that are equal in all columns are pieces of their own. Null ids are numbered like others.
    """
    found = pieces.groupBy("length").count().collect()  # at most ``size`` rows
    counts = np.zeros(size + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["count"]
    placed = runs(plan(counts))
    slices = max(1, -(-int(counts.max()) // slice_rows))
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    sliced = pieces.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    before = (
        sliced.groupBy("length", "__slice").agg(F.count("*").alias("n"))
        .withColumn("__before", F.sum("n").over(W.partitionBy("length").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)))
        .select("length", "__slice", F.coalesce("__before", F.lit(0)).alias("__before"))
    )
    ranked = sliced.withColumn("__row", F.row_number().over(W.partitionBy("length", "__slice").orderBy(*order))).join(before, ["length", "__slice"])
    ranked = ranked.select(*pieces.columns, (F.col("__row") - 1 + F.col("__before")).alias("__rank"))
    kept = pieces.columns

    def make():
        def run(cols):
            length, rank = np.array(cols["length"], np.int64), np.array(cols.pop("__rank"), np.int64)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for a in np.unique(length):
                mine, rows = length == a, placed[int(a)]
                r = rank[mine]
                row = rows[np.searchsorted(rows[:, 0], r, side="right") - 1]
                turn, nth = np.divmod(r - row[:, 0], row[:, 1])
                sequence[mine], offset[mine] = row[:, 2] + turn, row[:, 3] + nth * a
            return cols | {"sequence_id": sequence, "offset": offset}

        return run

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return map_rows(ranked.select(*kept, "__rank"), make, f"{schema}, sequence_id long, offset long", rows=8192)


def pack(docs: DataFrame, path: str, end_id: int = END, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """Pack whole texts (null: empty, so the end id alone) into sequences of at most ``size`` tokens.

    One row per piece. No piece is dropped; a document is cut only when it is longer than a sequence. An empty table packs
    to an empty one. Columns other than doc_id and text are not looked at.
    """
    pieces = materialise(tokenized_pieces(docs, path, end_id, size, keep_ids), "pack-pieces")
    return place(pieces, size)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file(TOKENIZER))
