"""Periodic runs of words: maximal stretches that repeat with a smallest period, and texts with each run cut to one period.

Method: an enhanced suffix array (order, ranks, common prefix lengths) over the word numbers of a few texts at a time.
Every interval of equal common prefix length d splits into children; each suffix i of all but its largest child asks through
the ranks whether i+d or i-d lies in the same interval, which makes a square of period d there. Where the square cannot move
one word to the right it is the last square of its run; moved to the left as far as it goes (word by word, all squares at
once, long moves by slices) it gives the run. Squares of multiples of a period lie in the run of the period and are merged
into it. Work is of the order n log n and no tree is built.

Nulls and empty texts have no words. A row without an id is not rewritten. Repeated rows each give their row; an empty table
gives no rows; further columns of any name are ignored. Long texts are handled whole, alone if need be.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from landlens.llm.common import map_rows, table

#: A run has this many words at least, and two periods.
LEAST_WORDS = 12
#: Words that are indexed together; a longer text is indexed alone.
WORDS_AT_ONCE = 1 << 17
#: Steps that all squares move together before the rest moves by slices.
JOINT_STEPS = 24

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the suffixes, their ranks, and the common prefix length of each with the one before it.

    Suffixes are sorted by 1, 2, 4, ... symbols; only those still tied are sorted again. The ranks of each round are kept for
    the common prefix lengths.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)
    first = np.empty(n, bool)
    sorted_s = s[order]
    first[0] = True
    first[1:] = sorted_s[1:] != sorted_s[:-1]
    heads = np.flatnonzero(first)
    rank[order] = heads[np.cumsum(first) - 1]
    rounds = []
    h = 1
    while True:
        rounds.append((h, rank.astype(np.int32)))
        size = np.diff(np.append(heads, n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            break
        at = np.flatnonzero(tied)
        i = order[at]
        behind = i + h
        key = rank[i] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[at] = i[by]
        key = key[by]
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = key[1:] != key[:-1]
        first[at] = first[at] | new
        heads = np.flatnonzero(first)
        rank = np.empty(n, np.int64)
        rank[order] = heads[np.cumsum(first) - 1]
        h *= 2
    common = np.zeros(n, np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for h, r in reversed(rounds):
        same = (a < n) & (b < n)
        same[same] = r[a[same]] == r[b[same]]
        common[1:][same] += h
        a[same] += h
        b[same] += h
    return order, rank, common


def intervals(common: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(depth, left, children's starts with the end behind them) of every interval of depth 1 or more, by one stack."""
    n = len(common)
    found = []
    # only borders of depth 1 or more and the places behind them matter
    near = np.flatnonzero(common)
    if not len(near):
        return found
    stack: list[list] = []
    last = -2
    for k, d in zip(near.tolist(), common[near].tolist(), strict=True):
        if k != last + 1:
            while stack:
                depth, left, cuts = stack.pop()
                cuts.append(last + 1)
                found.append((depth, left, cuts))
        left = k - 1
        while stack and stack[-1][0] > d:
            depth, left, cuts = stack.pop()
            cuts.append(k)
            found.append((depth, left, cuts))
        if stack and stack[-1][0] == d:
            stack[-1][2].append(k)
        else:
            stack.append([d, left, [left, k]])
        last = k
    end = min(last + 1, n)
    while stack:
        depth, left, cuts = stack.pop()
        cuts.append(end)
        found.append((depth, left, cuts))
    return found


def branching_squares(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares that do not go on one word to the right."""
    n = len(s)
    none = np.empty(0, np.int64)
    order, rank, common = suffix_array(s)
    found = intervals(common)
    if not found:
        return none, none
    depth = np.array([x[0] for x in found], np.int64)
    lo = np.array([x[1] for x in found], np.int64)
    hi = np.array([x[2][-1] for x in found], np.int64)
    kids = np.array([len(x[2]) - 1 for x in found], np.int64)
    cuts = np.array([c for x in found for c in x[2]], np.int64)
    # children: (interval, from, to), without the largest of each interval
    inner = np.ones(len(cuts), bool)
    inner[np.cumsum(kids + 1) - 1] = False
    begin = cuts[inner]
    end = cuts[np.flatnonzero(inner) + 1]
    of = np.repeat(np.arange(len(found)), kids)
    size = end - begin
    by = np.lexsort((size, of))
    largest = by[np.cumsum(kids) - 1]
    keep = np.ones(len(begin), bool)
    keep[largest] = False
    begin, size, of = begin[keep], size[keep], of[keep]
    place = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    who = np.repeat(of, size)
    i, d = order[place], depth[who]
    starts, periods = [], []
    for first in (i, i - d):  # the suffix of the smaller child is the first or the second half of the square
        second = first + d
        ok = (first >= 0) & (second < n)
        other = np.where(first == i, second, first)[ok]
        f, p, w = first[ok], d[ok], who[ok]
        r = rank[other]
        ok = (r >= lo[w]) & (r < hi[w])
        f, p = f[ok], p[ok]
        behind = f + 2 * p
        stops = (behind >= n) | (s[np.minimum(f + p, n - 1)] != s[np.minimum(behind, n - 1)])
        starts.append(f[stops])
        periods.append(p[stops])
    start, period = np.concatenate(starts), np.concatenate(periods)
    both = np.unique(start * (n + 1) + period)
    return both // (n + 1), both % (n + 1)


def leftmost(s: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far each square moves to the left: the first word of its run."""
    at = start.copy()
    live = np.arange(len(at))
    for _ in range(JOINT_STEPS):
        live = live[at[live] > 0]
        live = live[s[at[live] - 1] == s[at[live] - 1 + period[live]]]
        if not len(live):
            return at
        at[live] -= 1
    for k in live.tolist():
        x, p, step = int(at[k]), int(period[k]), 4 * JOINT_STEPS
        while x > 0:
            y = max(0, x - step)
            unlike = np.flatnonzero(s[y:x] != s[y + p : x + p])
            if len(unlike):
                x = y + int(unlike[-1]) + 1
                break
            x, step = y, 2 * step
        at[k] = x
    return at


def runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of every maximal run of two periods or more, by start and period."""
    start, period = branching_squares(s)
    end = start + 2 * period
    by = np.lexsort((period, end))
    start, period, end = start[by], period[by], end[by]
    got: list[np.ndarray] = []
    # squares with one end: the smallest period makes a run; those inside it are of multiples of its period
    while len(end):
        head = np.ones(len(end), bool)
        head[1:] = end[1:] != end[:-1]
        group = np.cumsum(head) - 1
        left = leftmost(s, start[head], period[head])
        got.append(np.stack([left, end[head], period[head]]))
        rest = start < left[group]
        start, period, end = start[rest], period[rest], end[rest]
    if not got:
        return (np.empty(0, np.int64),) * 3
    left, end, period = np.concatenate(got, axis=1)
    by = np.lexsort((period, left))
    return left[by], end[by], period[by]


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's change of every tenth document: from one word on it repeats its own words."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def find_runs(texts: list[list[bytes]], least: int = LEAST_WORDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of ``least`` words or more of each text: (start, length, period), numbered from the text's first word."""
    out: list = [None] * len(texts)
    at = 0
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and (to == at or total + len(texts[to]) + 1 <= WORDS_AT_ONCE):
            total += len(texts[to]) + 1
            to += 1
        numbers: dict[bytes, int] = {}
        parts, bounds = [], [0]
        for k, words in enumerate(texts[at:to]):
            parts.extend([numbers.setdefault(w, len(numbers)) for w in words])
            parts.append(-1 - k)  # no other text has this sign
            bounds.append(len(parts))
        left, end, period = runs(np.array(parts, np.int64))
        long = end - left >= np.maximum(least, 2 * period)
        left, end, period = left[long], end[long], period[long]
        edges = np.searchsorted(left, bounds)
        for k in range(to - at):
            mine = slice(edges[k], edges[k + 1])
            out[at + k] = (left[mine] - bounds[k], end[mine] - left[mine], period[mine])
        at = to
    return out


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not len(start):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return [words[k] for k in kept.tolist()]


def _describe() -> Callable[[dict[str, list]], dict[str, list]]:
    def run(rows: dict[str, list]) -> dict[str, list]:
        # a word is what ASCII white space leaves, which is how bytes are split
        texts = [rewritten((t or "").encode().split(), i) for i, t in zip(rows["doc_id"], rows["text"], strict=True)]
        out: dict[str, list] = {f: [] for f in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_kept")}
        for words, (start, length, period) in zip(texts, find_runs(texts), strict=True):
            lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
            kept = collapsed(words, start, length, period)
            best = (None,) * 3
            if len(start):
                k = np.lexsort((period, start, -length))[0]
                best = (int(start[k]), int(length[k]), int(period[k]))
            out["n_runs"].append(len(start))
            for name, value in zip(("start", "length", "period"), best, strict=True):
                out[name].append(value)
            out["exponent_milli"].append(None if best[0] is None else 1000 * best[1] // best[2])
            out["runs_sha256"].append(hashlib.sha256(lines.encode()).hexdigest())
            out["collapsed_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            out["n_words"].append(len(words))
            out["n_kept"].append(len(kept))
        return {"doc_id": rows["doc_id"], **out}

    return run


def _texts() -> Callable[[dict[str, list]], dict[str, list]]:
    def run(rows: dict[str, list]) -> dict[str, list]:
        texts = [(t or "").encode().split() for t in rows["text"]]
        spans, left = [], []
        for words, (start, length, period) in zip(texts, find_runs(texts), strict=True):
            spans.append([{"start": a, "length": b, "period": c} for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)])
            left.append(b" ".join(collapsed(words, start, length, period)).decode())
        return {"doc_id": rows["doc_id"], "runs": spans, "collapsed": left}

    return run


def text_runs(docs: DataFrame) -> DataFrame:
    """Runs of each text as (start, length, period), and the text with each run cut to its first period."""
    return map_rows(docs.select("doc_id", "text"), _texts, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs of every document, every tenth one rewritten first; one pass, no shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return map_rows(docs, _describe, SCHEMA)
