"""Near copies by improved consistent weighted sampling over TF-IDF shingles, and by plain minima of their hashes.

A text is the weighted set of its shingles of five words: how often a shingle occurs, times its inverse document frequency. Document
frequencies are counted for each shingle hash over all documents, in ranges of hashes. No task and no driver holds them all: the rows
are numbered in parts, each range replies to every part that asked with the frequencies of the part's shingles, and part and replies
meet again. From there on a text carries the frequencies of its shingles, a byte or so each.

The text that a large group of copies shares weighs little for it, as many documents hold it, so what tells the copies apart weighs too
much. Two texts are therefore also near copies if their sets without weights have that similarity, both of all shingles and of those
that at most 1 in ``COMMON`` texts holds: beyond that share, shingles are what documents have in common, and do not make copies.

Each of the ``BANDS * ROWS`` samples picks a shingle with a quantised weight such that two sets pick the same with a probability
equal to their weighted Jaccard similarity. ``ROWS`` samples make a band's key. Texts with equal sets are one node from here on,
whatever their ids. Of the nodes that share a key, each is compared with the first one, then with ``CENTERS`` others; links
join classes. What shares a key and still is in different classes is a candidate pair if ``AGREE`` of the samples agree in
their low bits, and a pair is looked at under the first key it shares. Every comparison is that of the whole texts' exact
similarities; ``SIMILARITY`` or more links them. Least hashes of the set without weights are samples too, of as many bands and marks.

At a similarity of exactly 0.8 a pair shares a key with a probability of 0.999 and has the bits with one of 0.9998, at 0.85 of
0.99999 both. Texts under a key of more than ``CROWD`` that is still open get ``FINE`` samples in all, of which ``FINE_AGREE`` must
agree too; a pair of a similarity of 0.8 has them with a probability of 0.99996. So a large group of copies that differ from
each other by more than the similarity allows costs its pairs' comparison of sample bits, not of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landlens.llm.common import BATCH_ROWS, map_rows, ship_code, table
from landlens.session import dealt, materialise

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Of 64 samples' lowest four bits, so many must agree; at a similarity of 0.8, 52 do on average (deviation 3.1).
AGREE = 40
CENTERS = 4
#: Shingles that more than 1 in so many texts hold are left to the weighted similarity.
COMMON = 32
#: Members of a key from which on they are compared by more samples; 416 of them agree on average at a similarity of 0.8 (deviation 8.8).
CROWD = 16
FINE, FINE_AGREE = 512, 381
#: Rows whose shingles are counted, and looked up, together (a power of two).
PART_ROWS = 512
#: Hash ranges in which frequencies are counted, and the shingles a task adds up before it gives them to the ranges.
RANGE_BITS = 10
PENDING = 1 << 21
#: Random variates per table (a power of two; the tables fit a core's cache); a sample draws its two rows by hash.
VARIATES = 1 << 13
SEED = 20
#: Bytes of text that are hashed together, and shingles that are sampled together: they bound the memory beside the texts.
TEXT_BYTES = 1 << 20
SAMPLED = 1 << 13
#: Hash values that tell most texts that nobody compares; at most so many are sent to the tasks.
SLOTS = 1 << 22
#: White space beyond the ASCII kinds.
ODD_SPACE = r"[\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MIX
    return x ^ x >> np.uint64(29)


class Shingler:
    """Texts to sorted distinct shingle hashes with their counts, without a step per word.

    A word's hash is a polynomial in its bytes (as random numbers) modulo 2^64: the difference of two prefix sums, moved to
    the word's start by the inverse of the base.
    """

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.byte = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.up, self.down = self._powers(TEXT_BYTES)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers 0 to n - 1 of the base and of its inverse."""
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), x, np.uint64)])) for x in (self.BASE, self.INVERSE))

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's words start (one more than there are texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if pc.any(pc.match_substring_regex(texts, ODD_SPACE)).as_py():
            texts = pc.replace_substring_regex(texts, ODD_SPACE, " ")
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, "<i8")[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        letter = ~self.space[raw]
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        filled = ends[1:] > ends[:-1]
        heads, tails = ends[:-1][filled], ends[1:][filled] - 1
        first[heads], last[tails] = letter[heads], letter[tails]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = (self.up, self.down) if n <= len(self.up) else self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[raw] * up[:n], out=sums[1:])
        return _mix((sums[stops] - sums[starts]) * down[starts]), np.searchsorted(starts, ends)

    def many(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(sorted hashes, counts) of every text; both empty for a text without words."""
        out = []
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // TEXT_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high == low:
                continue
            h, at = self.words(texts.slice(low, high - low))
            n = max(0, len(h) - WORDS + 1)
            mixed = np.full(n, np.uint64(WORDS), np.uint64)
            for k in range(WORDS):
                mixed = _mix(mixed * _FOLD + h[k : k + n])
            for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
                if b - a >= WORDS:
                    out.append(np.unique(mixed[a : b - WORDS + 1], return_counts=True))
                elif b > a:  # fewer words than a shingle has: one shingle
                    one = np.full(1, np.uint64(b - a), np.uint64)
                    for k in range(a, b):
                        one = _mix(one * _FOLD + h[k : k + 1])
                    out.append((one, np.ones(1, np.int64)))
                else:
                    out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        return out

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.many(pa.array([text], pa.string()))[0]


_SHINGLER: list[Shingler] = []


def shingler() -> Shingler:
    """One per worker process."""
    if not _SHINGLER:
        _SHINGLER.append(Shingler())
    return _SHINGLER[0]


class Weights:
    """Shingle hashes to the ln of their weights, ln(ln(1 + N / df)). ``listed``: sorted hashes; others have a df of 1."""

    def __init__(self, n: int, listed: np.ndarray, df: np.ndarray):
        self.listed, self.logs = listed, np.log(np.log1p(n / np.maximum(df, 1)))
        self.rest = float(np.log(np.log1p(n))) if n else 0.0

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.rest)
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, h), len(self.listed) - 1)
            hit = self.listed[at] == h
            out[hit] = self.logs[at[hit]]
        return out


def log_weights(df: np.ndarray, n: int) -> np.ndarray:
    """The ln of the weights of shingles that ``df`` of ``n`` texts hold."""
    return np.log(np.log1p(n / np.maximum(df, 1)))


def pack(df: np.ndarray) -> bytes:
    """Counts from 1 on as their number, a byte each, and the larger ones in full behind."""
    return np.uint32(len(df)).tobytes() + np.minimum(df, 255).astype(np.uint8).tobytes() + df[df >= 255].astype("<i8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    df = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    df[df == 255] = np.frombuffer(data, "<i8", -1, 4 + n)
    return df


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and part, written: the same rows have the same part whenever they are read."""
    part = F.floor(F.monotonically_increasing_id() / PART_ROWS).alias("part")
    return materialise(docs.select("doc_id", "text", part), "near-parts")


def _counted(docs: DataFrame) -> DataFrame:
    """slice, part, h, df: a part's distinct hashes of a range with the texts of the part that hold them (maybe in several rows).

    ``docs``: text, part. In slice -1 the number of texts that have words.
    """
    ship_code(docs.sparkSession)
    edges = np.arange(1, 1 << RANGE_BITS, dtype=np.uint64) << np.uint64(64 - RANGE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, n, part, pending, size = shingler(), 0, None, [], 0

        def rows(found: list) -> pa.RecordBatch:
            columns = [pa.array([x[c] for x in found], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["slice", "part", "h", "df"])

        def give() -> pa.RecordBatch:
            h, df = np.unique(np.concatenate(pending), return_counts=True)
            cuts = np.searchsorted(h, edges)
            split = zip(np.split(h, cuts), np.split(df.astype("<i4"), cuts), strict=True)
            return rows([(k, part, a.tobytes(), b.tobytes()) for k, (a, b) in enumerate(split) if len(a)])

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                parts = batch.column(1).slice(at, BATCH_ROWS).to_pylist()
                for its, (h, _) in zip(parts, shingle.many(batch.column(0).slice(at, BATCH_ROWS)), strict=True):
                    if size and (its != part or size >= PENDING):
                        yield give()
                        pending, size = [], 0
                    part = its
                    if len(h):
                        n += 1
                        pending.append(h)
                        size += len(h)
        if size:
            yield give()
        yield rows([(-1, -1, b"", np.array([n], "<i4").tobytes())])

    return docs.select("text", F.col("part").cast("long")).mapInArrow(count, "slice int, part long, h binary, df binary")


def _read(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a range's rows, one after the other."""
    return np.concatenate([np.frombuffer(x, "<u8") for x in rows["h"]]), np.concatenate([np.frombuffer(x, "<i4") for x in rows["df"]]).astype(np.int64)


def part_frequencies(docs: DataFrame) -> DataFrame:
    """part, slice, dfs: how many of all texts hold each of a part's distinct hashes in a range, by the order of the hashes.

    ``docs``: text, part. In part -1 the number of texts that have words.
    """

    def reply(rows: pd.DataFrame) -> pd.DataFrame:
        h, df = _read(rows)
        if rows["slice"].iloc[0] < 0:
            return pd.DataFrame({"part": [-1], "slice": [-1], "dfs": [np.array([df.sum()], "<i8").tobytes()]})
        known, which = np.unique(h, return_inverse=True)
        total = np.bincount(which, weights=df).astype(np.int64)
        ends = np.cumsum(rows["h"].map(len).to_numpy() // 8)
        asked: dict[int, list] = {}
        for part, mine in zip(rows["part"].tolist(), np.split(which, ends[:-1]), strict=True):
            asked.setdefault(part, []).append(mine)
        replies = [pack(total[mine[0] if len(mine) == 1 else np.unique(np.concatenate(mine))]) for mine in asked.values()]
        return pd.DataFrame({"part": list(asked), "slice": int(rows["slice"].iloc[0]), "dfs": replies})

    return _counted(docs).groupBy("slice").applyInPandas(reply, "part long, slice int, dfs binary")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """h, df: the shingle hashes of two documents or more; and a row with a null h and the number of texts that have words."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        h, df = _read(rows)
        if rows["slice"].iloc[0] < 0:
            return pd.DataFrame({"h": pd.array([None], "Int64"), "df": [int(df.sum())]})
        known, which = np.unique(h, return_inverse=True)
        total = np.bincount(which, weights=df).astype(np.int64)
        several = total > 1
        return pd.DataFrame({"h": pd.array(known[several].view(np.int64), "Int64"), "df": total[several]})

    return _counted(docs.select("text", F.lit(0).alias("part"))).groupBy("slice").applyInPandas(add, "h long, df long")


def inverse_frequencies(docs: DataFrame, listed: int | None = None) -> Weights:
    """The weights of all shingles in one list, for tables so small that it fits the driver; classes are found without it.

    ``listed`` bounds the list, for a caller who wants the most frequent shingles: the others are left out, lowest first.
    """
    found = materialise(document_frequencies(docs), "near-frequencies")
    n = found.where("h IS NULL").agg(F.sum("df")).first()[0] or 0
    shingles, least, total = found.where("h IS NOT NULL"), 2, 0
    if listed is not None:
        for df, times in sorted(((r[0], r[1]) for r in shingles.groupBy("df").count().collect()), reverse=True):
            total += times
            if total > listed:
                least = df + 1
                break
    rows = shingles.where(F.col("df") >= least).toArrow()
    h = rows.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Weights(n, h[order], rows.column("df").to_numpy()[order])


class Sampler:
    """Consistent weighted samples of weighted shingle sets; the first samples are the same whatever their number."""

    def __init__(self, log_weight: Callable[[np.ndarray], np.ndarray] | None = None, samples: int = BANDS * ROWS):
        """``log_weight``: hashes to the ln of their weights, for callers that don't give those with the sets."""
        rng = np.random.default_rng(SEED)
        self.log_weight = log_weight
        self.r = rng.gamma(2, 1, VARIATES)
        self.per_r = 1 / self.r
        self.beta = rng.random(VARIATES)
        # ln a = ln c - r (t - beta) - r: the part that doesn't depend on t and beta
        self.rest = np.log(rng.gamma(2, 1, VARIATES)) - self.r
        self.factors = rng.integers(1, 2**63, samples, dtype=np.uint64) | np.uint64(1)

    def _least(self, h: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each sample and stretch of ``h`` the least ln a, and the sample drawn there (of equals the first one's)."""
        sizes = np.diff(np.append(starts, len(h)))
        high = np.uint64(65 - VARIATES.bit_length())
        least, picked = np.empty((len(self.factors), len(starts))), np.empty((len(self.factors), len(starts)), np.uint64)
        for k, factor in enumerate(self.factors):
            drawn = h * factor
            a, b = (drawn >> high).view(np.int64), (drawn >> np.uint64(32) & np.uint64(VARIATES - 1)).view(np.int64)
            beta = self.beta.take(b, mode="clip")
            t = self.per_r.take(a, mode="clip")
            t *= weight
            t += beta
            np.floor(t, out=t)
            beta -= t
            beta *= self.r.take(a, mode="clip")
            beta += self.rest.take(a, mode="clip")
            least[k] = np.minimum.reduceat(beta, starts)
            at = np.flatnonzero(beta == np.repeat(least[k], sizes))
            if len(at) > len(starts):
                owner = np.searchsorted(starts, at, side="right") - 1
                at = at[np.flatnonzero(np.diff(owner, prepend=-1))]
            picked[k] = _mix(h[at] + t[at].astype(np.int64).view(np.uint64) * _FOLD)
        return least, picked

    def picked(self, sets: list[tuple[np.ndarray, np.ndarray]], logs: list[np.ndarray] | None = None) -> np.ndarray:
        """The samples of each set (none of them empty), a row a sample. ``logs``: the ln of the weights of each set's shingles.

        Sets are sampled in blocks of ``SAMPLED`` shingles; of a set's parts in several blocks the least one counts.
        """
        sizes = np.array([len(h) for h, _ in sets])
        ends = np.cumsum(sizes)
        h = np.concatenate([h for h, _ in sets])
        weight = (self.log_weight(h) if logs is None else np.concatenate(logs)) + np.log(np.concatenate([n for _, n in sets]))
        low = np.full((len(self.factors), len(sets)), np.inf)
        picked = np.zeros((len(self.factors), len(sets)), np.uint64)
        for at in range(0, len(h), SAMPLED):
            stop = min(at + SAMPLED, len(h))
            some = np.arange(np.searchsorted(ends, at, side="right"), np.searchsorted(ends, stop - 1, side="right") + 1)
            least, drawn = self._least(h[at:stop], weight[at:stop], np.maximum((ends - sizes)[some] - at, 0))
            lower = least < low[:, some]
            low[:, some] = np.where(lower, least, low[:, some])
            picked[:, some] = np.where(lower, drawn, picked[:, some])
        return picked

    def keys(self, sets: list[tuple[np.ndarray, np.ndarray]], logs: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each set (none of them empty) an int64 key a band, and the samples' marks."""
        picked = self.picked(sets, logs)
        return band_keys(picked, 1), self.marks(picked)

    @staticmethod
    def marks(picked: np.ndarray) -> np.ndarray:
        """For each set its samples' lowest four bits, 16 samples to an int64."""
        marks = np.zeros((len(picked) // 16, picked.shape[1]), np.uint64)
        for k, sample in enumerate(picked):
            marks[k // 16] |= (sample & np.uint64(15)) << np.uint64(4 * (k % 16))
        return marks.T.astype(np.int64)


class PlainSampler:
    """For each sample the least hash of a set without weights."""

    def __init__(self, samples: int = BANDS * ROWS):
        self.factors = np.random.default_rng(SEED + 1).integers(1, 2**63, samples, dtype=np.uint64) | np.uint64(1)

    def picked(self, sets: list[np.ndarray]) -> np.ndarray:
        """The samples of each set of hashes (none of them empty), a row a sample."""
        sizes = np.array([len(h) for h in sets])
        out = np.empty((len(self.factors), len(sets)), np.uint64)
        group = np.cumsum(sizes) // SAMPLED
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sets)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            h, starts = np.concatenate(sets[low:high]), np.cumsum(sizes[low:high]) - sizes[low:high]
            for k, factor in enumerate(self.factors):
                out[k, low:high] = np.minimum.reduceat(h * factor, starts)
        return out


def band_keys(picked: np.ndarray, tag: int) -> np.ndarray:
    """For each set an int64 key a band, a row a set; bands are told apart by their number from ``tag`` on."""
    out = np.empty((BANDS, picked.shape[1]), np.uint64)
    for band in range(BANDS):
        key = np.full(picked.shape[1], np.uint64(tag + band), np.uint64)
        for k in range(ROWS):
            key = _mix(key * _FOLD + picked[band * ROWS + k])
        out[band] = key
    return out.T.astype(np.int64)


_SAMPLERS: dict[tuple[type, int], Sampler | PlainSampler] = {}


def _sampler(kind: type, samples: int) -> Sampler | PlainSampler:
    """One of a kind per worker process."""
    if (kind, samples) not in _SAMPLERS:
        _SAMPLERS[kind, samples] = kind(samples=samples)
    return _SAMPLERS[kind, samples]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], log_weight: Callable[[np.ndarray], np.ndarray]) -> float:
    """Sum of the smaller weights over the sum of the larger ones; 0 for an empty set."""
    return jaccard(a, b, log_weight(a[0]), log_weight(b[0]))


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], logs_a: np.ndarray, logs_b: np.ndarray) -> float:
    """`weighted_jaccard` with the ln of the weights of the shingles of both."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    wa, wb = np.exp(logs_a) * a[1], np.exp(logs_b) * b[1]
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    return float(both / (wa.sum() + wb.sum() - both))


def rare(df: np.ndarray, n: int) -> np.ndarray:
    """Whether at most 1 in ``COMMON`` of ``n`` texts holds a shingle."""
    return df * COMMON <= n


def plain_similarity(a: np.ndarray, b: np.ndarray, rare_a: np.ndarray, rare_b: np.ndarray) -> float:
    """The Jaccard similarity of two sets of hashes or of their rare ones, whichever is less; 0 for empty sets."""
    _, i, _ = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both, both_rare, sum_rare = len(i), int(rare_a[i].sum()), int(rare_a.sum() + rare_b.sum())
    return min(both / (len(a) + len(b) - both), both_rare / (sum_rare - both_rare)) if both_rare else 0.0


def signatures(docs: DataFrame, frequencies: DataFrame, n: int) -> DataFrame:
    """doc_id, same (hash of the text), digest, weight, keys, marks, dfs: a row per row of ``docs``; without words the last five are null.

    The keys and marks of the set without weights stand behind the others, if the text has rare shingles.

    ``docs``: doc_id, text, part, as they were counted; ``frequencies``: those of their parts; ``n``: texts that have words.
    """
    ship_code(docs.sparkSession)
    schema = "doc_id long, same binary, digest binary, weight double, keys array<long>, marks array<long>, dfs binary"
    kinds = {"doc_id": pa.int64(), "same": pa.binary(), "digest": pa.binary(), "weight": pa.float64(), "keys": pa.list_(pa.int64()), "marks": pa.list_(pa.int64()), "dfs": pa.binary()}

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        rows, replies = rows.combine_chunks(), replies.sort_by("slice")
        sets = shingler().many(pa.chunked_array(rows.column("text").chunks, pa.string()).combine_chunks())
        out = {c: [None] * len(sets) for c in list(kinds)[2:]}
        full = [i for i, s in enumerate(sets) if len(s[0])]
        if full:
            known, df = np.unique(np.concatenate([sets[i][0] for i in full])), np.concatenate([unpack(x) for x in replies.column("dfs").to_pylist()])
            if len(known) != len(df):
                raise RuntimeError("a part has other rows than when it was counted")
            dfs = [df[np.searchsorted(known, sets[i][0])] for i in full]
            logs = [log_weights(x, n) for x in dfs]
            for i, row, bits, x, w in zip(full, *_sampler(Sampler, BANDS * ROWS).keys([sets[i] for i in full], logs), dfs, logs, strict=True):
                h, times = sets[i]
                out["keys"][i], out["marks"][i], out["dfs"][i] = row, bits, pack(x)
                out["digest"][i] = hashlib.blake2b(h.tobytes() + times.tobytes(), digest_size=16).digest()
                out["weight"][i] = float((np.exp(w) * times).sum())
            kept = [(i, sets[i][0][some]) for i, x in zip(full, dfs, strict=True) if (some := rare(x, n)).any()]
            if kept:
                picked = _sampler(PlainSampler, BANDS * ROWS).picked([h for _, h in kept])
                for (i, _), row, bits in zip(kept, band_keys(picked, BANDS + 1), Sampler.marks(picked), strict=True):
                    out["keys"][i], out["marks"][i] = np.append(out["keys"][i], row), np.append(out["marks"][i], bits)
        made = {"doc_id": rows.column("doc_id"), "same": rows.column("same"), **{c: pa.array(v, kinds[c]) for c, v in out.items()}}
        return pa.table({c: made[c].cast(k) for c, k in kinds.items()})

    rows = docs.select(F.col("doc_id").cast("long"), text_key("text").alias("same"), "text", "part")
    return rows.groupBy("part").cogroup(frequencies.where("part >= 0").groupBy("part")).applyInArrow(run, schema)


def fine_marks(texts: DataFrame, n: int) -> DataFrame:
    """node, fine: the marks of ``FINE`` samples, and behind them those of the set without weights, if a text has rare shingles.

    ``texts``: node, text, dfs, a row per node, all with words.
    """
    ship_code(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                sets, dfs = shingler().many(part.column(1)), [unpack(x) for x in part.column(2).to_pylist()]
                marks = list(Sampler.marks(_sampler(Sampler, FINE).picked(sets, [log_weights(x, n) for x in dfs])))
                kept = [(i, h[some]) for i, ((h, _), x) in enumerate(zip(sets, dfs, strict=True)) if (some := rare(x, n)).any()]
                if kept:
                    for (i, _), bits in zip(kept, Sampler.marks(_sampler(PlainSampler, FINE).picked([h for _, h in kept])), strict=True):
                        marks[i] = np.append(marks[i], bits)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks, pa.list_(pa.int64()))], names=["node", "fine"])

    return texts.select("node", "text", "dfs").mapInArrow(run, "node long, fine array<long>")


def text_key(text: str) -> Column:
    """16 bytes that tell texts apart; null for a null text."""
    return F.unhex(F.md5(F.col(text)))


def verified(pairs: DataFrame, texts: DataFrame, n: int, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: those of ``pairs`` whose texts are similar enough. ``texts``: node, text, dfs, a row per node."""
    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"), F.col("dfs").alias(f"dfs_{s}"))
    # dealt, as few bytes of pairs can be many comparisons
    both = dealt(pairs, "b").join(side("a"), "a").join(side("b"), "b")

    def make():
        shingle = shingler()
        last: list = [None, None, None]

        def run(cols):
            good = []
            for i, (id_b, text_a, dfs_a, text_b, dfs_b) in enumerate(zip(*(cols[c] for c in ("b", "text_a", "dfs_a", "text_b", "dfs_b")), strict=True)):
                if last[0] != id_b:  # rows come sorted by b from the join
                    last[:] = [id_b, shingle(text_b), unpack(dfs_b)]
                a, b, df_a, df_b = shingle(text_a), last[1], unpack(dfs_a), last[2]
                if plain_similarity(a[0], b[0], rare(df_a, n), rare(df_b, n)) >= similarity or jaccard(a, b, log_weights(df_a, n), log_weights(df_b, n)) >= similarity:
                    good.append(i)
            return {c: [cols[c][i] for i in good] for c in ("a", "b")}

        return run

    return map_rows(both.select("a", "b", "text_a", "dfs_a", "text_b", "dfs_b"), make, "a long, b long", rows=64)


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each linked node reaches. ``links``: a, b, kept in a table.

    Labels fall to the least of the neighbours' labels and then to their label's label, until nothing changes; each round is a
    written table.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "near-labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("__n")).agg(F.min("label").alias("__near"))
        step = labels.join(around, labels["node"] == F.col("__n")).select("node", "label", F.least("label", "__near").alias("__to"))
        jump = labels.select(F.col("node").alias("__j"), F.col("label").alias("__jump"))
        moved = step.join(jump, F.col("__to") == F.col("__j"), "left").select("node", F.least("__to", F.coalesce("__jump", "__to")).alias("label"), F.col("label").alias("was"))
        moved = materialise(moved, "near-labels")
        labels = moved.select("node", "label")
        if moved.where("label <> was").limit(1).count() == 0:
            return labels


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, same, node for every row of ``docs``: rows of one class have the same node; null for texts without words."""
    docs = numbered(docs)
    frequencies = materialise(part_frequencies(docs), "near-frequencies")
    n = sum(int(np.frombuffer(r["dfs"], "<i8")[0]) for r in frequencies.where("part < 0").collect())
    rows = materialise(signatures(docs, frequencies, n), "near-signatures")
    # equal digests have equal keys and weights, so any of them will do; one row's text stands for all
    agg = [F.min(F.struct("doc_id", "same")).alias("home"), *[F.first(c).alias(c) for c in ("keys", "weight", "marks", "dfs")]]
    reps = rows.where("digest IS NOT NULL").groupBy("digest").agg(*agg)
    # numbers are unique, and fixed by the written table
    reps = materialise(reps.withColumn("rep", F.monotonically_increasing_id()), "near-reps")
    banded = reps.select("rep", F.explode("keys").alias("key"))
    shared = materialise(banded.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1"), "near-keys")
    # only keys that several share; the numbers alone meet there, as the rest of a row would be moved once a band
    banded = materialise(banded.join(shared, "key").join(reps.select("rep", "weight", F.transform("keys", _short).alias("keys"), "marks"), "rep"), "near-bands")
    pairs = materialise(banded.where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct(), "near-pairs")
    wanted = reps.select("rep", "home", "dfs").join(banded.select("rep").distinct(), "rep", "left_semi")
    wanted = materialise(wanted.select(F.col("rep").alias("node"), F.col("home.doc_id").alias("__id"), F.col("home.same").alias("__same"), "dfs"), "near-wanted")
    # a row is found by id and text, so that copies of one text do not meet; most others go by their slot before texts are moved
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    slots = wanted.select(slot("__same").alias("__slot")).distinct()
    near = docs.select("doc_id", "text").join(F.broadcast(slots), slot(text_key("text")) == F.col("__slot"), "left_semi")
    home = (text_key("text") == F.col("__same")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    texts = near.join(wanted, home).groupBy("node").agg(F.first("text").alias("text"), F.first("dfs").alias("dfs"))
    texts = materialise(texts, "near-texts")
    links = materialise(verified(pairs, texts, n, similarity), "near-found")
    labels = components(links)
    labels = _cross_links(banded, pairs, links, labels, texts, n, similarity)
    nodes = reps.select("digest", "rep").join(labels, F.col("rep") == F.col("node"), "left")
    nodes = nodes.select("digest", F.coalesce("label", "rep").alias("node"))
    return materialise(rows.select("doc_id", "same", "digest").join(nodes, "digest", "left").select("doc_id", "same", "node"), "near-classes")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest id of the class) for every row of ``docs``; other columns are not looked at.

    Texts without words are alone, also among themselves; a text of fewer than five words is one shingle. Texts, not ids, make
    classes: rows with one id and different texts may be in different classes. A row with a null doc_id has the class of its
    text like others (null if no row of the class has an id).
    """
    rows = _classes(docs, similarity)
    least = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "node", "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"))


def _short(key: Column) -> Column:
    """A key's upper half, by which a pair's first shared key is found: keys of all bands stand in every band's row."""
    return F.shiftright(key, 32).cast("int")


def agreeing(a: Column, b: Column, kind: int = 0) -> Column:
    """How many samples agree in their four bits: those with weights, or for ``kind`` 1 those without (null where a side has none)."""
    ones = F.lit(0x1111111111111111)
    total = F.lit(BANDS * ROWS)
    for k in range(BANDS * ROWS // 16):
        at = F.lit(kind * BANDS * ROWS // 16 + k)
        x = F.get(a, at).bitwiseXOR(F.get(b, at))
        some = x
        for bit in (1, 2, 3):
            some = some.bitwiseOR(F.shiftrightunsigned(x, bit))
        total = total - F.bit_count(some.bitwiseAND(ones))
    return total


def finely_agreeing(a: Column, b: Column, kind: int = 0) -> Column:
    """Whether enough of the fine samples agree, with or without weights like `agreeing`; true where one side has none."""
    ones = F.lit(0x1111111111111111)
    a, b = (F.slice(x, kind * FINE // 16 + 1, FINE // 16) for x in (a, b))

    def unlike(x: Column) -> Column:
        some = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(some.bitwiseOR(F.shiftrightunsigned(some, 2)).bitwiseAND(ones))

    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + unlike(x))
    return F.coalesce(total <= FINE - FINE_AGREE, F.lit(True))


def _candidates(one: DataFrame, two: DataFrame, similarity: float, where: Column) -> DataFrame:
    """a, b (a > b): rows under one key, in different classes, that may be similar; each pair under the first key it shares.

    Pairs whose total weights differ by more than the similarity allows cannot be similar by weights.
    """
    fine = ["fine"] * ("fine" in one.columns)
    one, two = (x.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "weight", "label", "marks", "keys", *fine)]) for x, s in ((one, "x"), (two, "y")))
    slack = similarity * (1 - 1e-9)
    close = (F.col("weight_x") >= F.col("weight_y") * slack) & (F.col("weight_y") >= F.col("weight_x") * slack)
    first = F.get(F.array_intersect("keys_x", "keys_y"), F.lit(0)) == _short(one["key"])
    alike = [F.coalesce(agreeing(F.col("marks_x"), F.col("marks_y"), kind) >= AGREE, F.lit(False)) for kind in (0, 1)]
    alike[0] = close & alike[0]
    if fine:
        alike = [x & finely_agreeing(F.col("fine_x"), F.col("fine_y"), kind) for kind, x in enumerate(alike)]
    wanted = where & (F.col("label_x") != F.col("label_y")) & (alike[0] | alike[1]) & first
    pairs = one.join(two, (one["key"] == two["key"]) & wanted)
    return pairs.select(F.greatest("rep_x", "rep_y").alias("a"), F.least("rep_x", "rep_y").alias("b")).distinct()


def _cross_links(banded: DataFrame, pairs: DataFrame, links: DataFrame, labels: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """Compare what shares a key and is in different classes, and add the links found.

    A key whose members are all of one class needs nothing more. In the others all members are first compared with a few of
    them, which joins most of a large group; then members of different classes are compared, those of crowded keys by more samples.
    """
    seen = pairs
    for step in ("centers", "rest"):
        rows = banded.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep")).drop("node", "first")
        open_keys = rows.groupBy("key").agg(F.min("label").alias("__l"), F.max("label").alias("__m")).where("__l <> __m").select("key")
        rows = materialise(rows.join(open_keys, "key", "left_semi"), "near-open")
        if step == "centers":
            whole = F.struct("rep", "weight", "label", "marks", "keys")
            picks = [F.min_by(whole, F.xxhash64(F.col("rep"), F.lit(k))) for k in range(CENTERS)]
            centers = rows.groupBy("key").agg(F.array_distinct(F.array(*picks)).alias("c")).select("key", F.explode("c").alias("c")).select("key", "c.*")
            more = _candidates(rows, materialise(centers, "near-centers"), similarity, F.lit(True))
        else:
            crowd = rows.where(F.col("n") > CROWD).select(F.col("rep").alias("node")).distinct()
            fine = materialise(fine_marks(dealt(texts.join(crowd, "node", "left_semi"), "node"), n), "near-fine")
            rows = materialise(rows.join(fine, F.col("rep") == F.col("node"), "left").drop("node"), "near-crowds")
            more = _candidates(rows, rows, similarity, F.col("rep_x") > F.col("rep_y"))
        more = materialise(more.join(seen, ["a", "b"], "left_anti"), "near-more")
        extra = materialise(verified(more, texts, n, similarity), "near-extra")
        seen = seen.union(more)
        if extra.limit(1).count():
            links = materialise(links.union(extra), "near-found")
            labels = components(links)
    return labels


def without_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class: that of the smallest id (null last), and of those the least text key; all columns stay.

    Rows without words stay, all of them. Of rows that repeat both id and text one stays.
    """
    rows = _classes(docs, similarity).where("node IS NOT NULL")
    best = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "same")).alias("__best"))
    mine = F.struct(F.col("doc_id").isNull(), "doc_id", "same")
    told = materialise(rows.join(best, "node").groupBy(F.col("doc_id").alias("__id"), F.col("same").alias("__same")).agg(F.max(mine.eqNullSafe(F.col("__best"))).alias("__stays"), F.count("*").alias("__n")), "near-told")
    key = (text_key("text") == F.col("__same")) & docs["doc_id"].eqNullSafe(F.col("__id"))
    left = docs.join(told.where("NOT __stays").select("__id", "__same"), key, "left_anti")
    repeated = told.where("__stays AND __n > 1").select("__id", "__same")
    once = left.join(repeated, key, "left_anti")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = left.join(repeated, key).groupBy("__id", "__same").agg(F.first(whole).alias("__row"))
    return once.unionByName(several.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
