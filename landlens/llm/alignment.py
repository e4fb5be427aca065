"""Tokens of one text under two tokenizers, cut into groups at the byte offsets where tokens of both end.

A is a byte-level tokenizer of the ``tokenizers`` library, which reads a space and the text; B is a ``sentencepiece`` model,
which reads the text and adds that space itself. Spans that the libraries report (characters for A, bytes in the serialised
form of B) are the coarse cuts. They cannot tell the parts of a character of several bytes, of a byte-fallback run, or of the
added space; such tokens are cut by the bytes that they decode to. Every token is compared with the text's bytes: texts that
do not come back whole have no tokens.

Both tokenizers always end a token in front of the first white space behind a word, so texts are cut there and equal parts are
aligned once per worker. A text whose parts do not come back whole is aligned in one piece.

Corpus counts of linked id pairs: tasks number the pairs of a block of documents, so that a document keeps only small numbers;
pair counts are summed by shuffle, joined back once per block and pair, and met with the block's documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landlens.llm.common import CACHE_CHARS, map_rows, ship_code, table, tokenizer_file
from landlens.session import materialise

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Parts of texts that a worker remembers.
PARTS = 450_000
#: Parts that are aligned together, and characters of texts whose new parts are.
PARTS_AT_ONCE = 4_000
CHARS_AT_ONCE = 1 << 19
#: A block of documents ends with the document that reaches this many links.
BLOCK_LINKS = 1 << 20

SPACE = "▁"  # sentencepiece writes a space so
#: The white space that starts a part, its run, and all up to the next one that follows a word.
_PART = re.compile(r"[ \n]\s*+(?:\S++(?:[^\S \n]\s*+)?)*+")
#: A part that is a word, and signs behind it; a part with at most one white space, in front.
_HEAD_SIGNS = re.compile(r"([ \n]?[^\W\d_]+)([!-/:-@\[-`{-~]+)")
_SIMPLE = re.compile(r"[ \n]?\S+")


def byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet: printing bytes stand for themselves, the others for U+0100 and up, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def byte_sizes(text: str) -> np.ndarray:
    """Bytes of each character in UTF-8."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)


def cuts(spans: list[tuple[int, int]], pieces: list[bytes], raw: bytes) -> list[int] | None:
    """End offset of every token, or None where the tokens are not the text.

    A span holds if it starts at the last cut and covers the token's bytes; else the token's bytes are counted.
    """
    ends, at = [], 0
    for (lo, hi), piece in zip(spans, pieces, strict=True):
        if lo != at or raw[lo:hi] != piece:
            hi = at + len(piece)
            if raw[at:hi] != piece:
                return None
        ends.append(hi)
        at = hi
    return ends if at == len(raw) else None


class Aligner:
    """Groups of parts of texts, remembered."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        size = self.b.get_piece_size()
        texts = [self.b.id_to_piece(i) for i in range(size)]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(texts)]
        plain = [t for i, t in enumerate(texts) if not self.b.is_byte(i)]
        #: no entry goes on behind a word into white space, so parts can be encoded one by one
        self.splits = not any("\n" in t or re.search(f"[^{SPACE}]{SPACE}", t) for t in plain)
        self.inner = {t[k : k + 2] for t in plain for k in range(len(t) - 1)}
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, data in self.a_bytes.items():
            self.a_sizes[i] = len(data)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.known: dict[str, tuple | None] = {}

    def learn(self, new: set[str]) -> dict[str, tuple | None]:
        """Align new parts and remember them, but for long ones, which are returned."""
        known, extra = self.known, {}
        halves, plain = {}, set()
        for part in new:
            if len(part) > CACHE_CHARS:
                extra[part] = self.align(part, inside=True)
                continue
            both = _HEAD_SIGNS.fullmatch(part)
            # both tokenizers cut between a letter and signs that no entry holds side by side
            if both and part[both.end(1) - 1 : both.end(1) + 1] not in self.inner:
                halves[part] = both.groups()
                plain.update(both.groups())
            else:
                plain.add(part)
        simple = []
        for p in plain:
            if p in known:
                continue
            if _SIMPLE.fullmatch(p):
                simple.append(p)
            else:
                known[p] = self.align(p, inside=True)
        for at in range(0, len(simple), PARTS_AT_ONCE):
            some = simple[at : at + PARTS_AT_ONCE]
            got = self.align_many(some)
            known.update(zip(some, got or [self.align(p, inside=True) for p in some], strict=True))
        for part, (head, signs) in halves.items():
            h, t = known[head], known[signs]
            known[part] = h and t and (h[0] + t[0], f"{h[1]};{t[1]}", h[2] + t[2])
        return extra

    def align_many(self, parts: list[str]) -> list[tuple] | None:
        """``align`` of parts with at most one white space each, in front, in one call of each library.

        A line end stands in front of every part: alone it is a token of its own for both. None if it is not.
        """
        text = "\n" + "\n".join(parts)
        raw = text.encode()
        size = byte_sizes(text)
        place = np.concatenate([[0], np.cumsum(size)])
        start = place[np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]]) + 1]  # of each part, in bytes
        stop = np.append(start[1:] - 1, len(raw))
        got = self.a.encode(text, add_special_tokens=False)
        a, spans = np.array(got.ids, np.int64), place[np.array(got.offsets, np.int64)]
        a, a_end = self._inner_tokens(a, spans[:, 0], spans[:, 1], self.a_bytes, self.a_sizes, raw, start)
        pieces = list(self.b.encode(text, return_type="proto").pieces)[1:]  # the added space
        b = np.array([p.id for p in pieces], np.int64)
        lo, hi = np.array([p.begin for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64)
        b, b_end = self._inner_tokens(b, lo, hi, self.b_bytes, self.b_sizes, raw, start)
        if a is None or b is None:
            return None
        common = np.intersect1d(a_end, b_end)
        if not np.isin(stop, common).all():
            return None
        codes = a[np.searchsorted(a_end, common)] << 32 | b[np.searchsorted(b_end, common)]
        a_last, b_last = np.isin(a_end, common), np.isin(b_end, common)
        side = np.concatenate([2 * np.searchsorted(common, a_end), 2 * np.searchsorted(common, b_end) + 1])
        by = np.argsort(side, kind="stable")
        ids = np.concatenate([a, b])[by].tolist()
        behind = np.concatenate([a_last, 2 * b_last])[by].tolist()
        words = [f"{i}{',|;'[k]}" for i, k in zip(ids, behind, strict=True)]
        n_a, n_b = (np.bincount(np.searchsorted(stop, e), minlength=len(parts)) for e in (a_end, b_end))
        to = np.cumsum(n_a + n_b).tolist()
        links = np.cumsum(np.bincount(np.searchsorted(stop, common), minlength=len(parts))).tolist()
        raw_codes = codes.astype("<i8").tobytes()
        out, x, y = [], 0, 0
        for k, n in enumerate((n_a << 32 | n_b).tolist()):
            out.append((n, "".join(words[x : to[k]])[:-1], raw_codes[8 * y : 8 * links[k]]))
            x, y = to[k], links[k]
        return out

    @staticmethod
    def _inner_tokens(ids, lo, hi, table, sizes, raw, start):
        """Ids and end offsets without the line ends in front of the parts; None where the tokens are not the text.

        Where a token's span ends at or before the next one's start is a coarse cut; between two of them the tokens' bytes count.
        """
        if b"".join([table[i] for i in ids.tolist()]) != raw:
            return None, None
        clean = np.ones(len(ids), bool)
        clean[1:] = lo[1:] >= hi[:-1]
        run = np.cumsum(clean) - 1
        total = np.cumsum(sizes[ids])
        end = lo[clean][run] + total - (total - sizes[ids])[clean][run]
        at = np.searchsorted(end, start)
        if end[-1] != len(raw) or not np.array_equal(end[np.minimum(at, len(end) - 1)], start) or (sizes[ids[at]] != 1).any() or (end != total).any():
            return None, None
        keep = np.ones(len(ids), bool)
        keep[at] = False
        return ids[keep], end[keep]

    def align(self, text: str, inside: bool):
        """Groups of a text that starts with the added space, or of a part: a line end in front keeps B from adding a space."""
        raw = text.encode()
        got = self.a.encode(text, add_special_tokens=False)
        a = got.ids
        spans = got.offsets
        if len(raw) != len(text):
            place = np.concatenate([[0], np.cumsum(byte_sizes(text))])
            spans = [(int(place[lo]), int(place[hi])) for lo, hi in spans]
        a_ends = cuts(spans, [self.a_bytes[i] for i in a], raw)
        if a_ends is None:
            return None
        pieces = self.b.encode("\n" + text if inside else text[1:], return_type="proto").pieces
        b, spans = [p.id for p in pieces], [(p.begin, p.end) for p in pieces]
        if inside:  # the added space, the line end
            if len(b) < 2 or self.b_bytes[b[0]] != b" " or self.b_bytes[b[1]] != b"\n":
                return None
            b, spans = b[2:], [(lo - 1, hi - 1) for lo, hi in spans[2:]]
        else:
            spans = [(lo + 1, hi + 1) for lo, hi in spans]
        b_ends = cuts(spans, [self.b_bytes[i] for i in b], raw)
        if b_ends is None:
            return None
        a_at = {e: k for k, e in enumerate(a_ends)}
        groups, codes, i, j = [], [], 0, 0
        for k, e in enumerate(b_ends):
            m = a_at.get(e)
            if m is not None:
                groups.append(f"{','.join(map(str, a[i : m + 1]))}|{','.join(map(str, b[j : k + 1]))}")
                codes.append(a[m] << 32 | b[k])
                i, j = m + 1, k + 1
        return len(a) << 32 | len(b), ";".join(groups), np.array(codes, "<i8").tobytes()

    def documents(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, bytes]]:
        """(n_a, n_b, groups as text, linked pairs as bytes) of each text; zeros and empties for one without tokens."""
        at = 0
        while at < len(texts):
            to, total = at, 0
            while to < len(texts) and (to == at or total + len(texts[to] or "") <= CHARS_AT_ONCE):
                total += len(texts[to] or "")
                to += 1
            # B writes a space and U+2581 alike, so such a text does not come back
            wholes = ["" if not t or SPACE in t else " " + t for t in texts[at:to]]
            split = [_PART.findall(w) if self.splits else [] for w in wholes]
            new = set().union(*split).difference(self.known)
            if len(self.known) + len(new) > PARTS:
                self.known.clear()
                new = set().union(*split)
            extra = self.learn(new)
            for whole, names in zip(wholes, split, strict=True):
                yield self._joined(whole, [extra[p] if p in extra else self.known[p] for p in names] if extra else [self.known[p] for p in names])
            at = to

    def _joined(self, whole: str, parts: list) -> tuple[int, int, str, bytes]:
        if whole and (not parts or None in parts):
            parts = [self.align(whole, inside=False)]
        if not parts or None in parts:
            return 0, 0, "", b""
        counts, groups, codes = zip(*parts, strict=True)
        total = sum(counts)
        return total >> 32, total & 0xFFFFFFFF, ";".join(groups), b"".join(codes)


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker, kept between tasks with its parts."""
    key = (a_path, b_path)
    if key not in _LOADED:
        _LOADED[key] = Aligner(a_path, b_path)
    return _LOADED[key]


def aligned_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, groups: the ids of both tokenizers and the bytes of space+text that they cover, in order."""
    def make() -> Callable[[dict[str, list]], dict[str, list]]:
        tool = aligner(a_path, b_path)

        def run(rows: dict[str, list]) -> dict[str, list]:
            out = []
            for _, _, text, _ in tool.documents(rows["text"]):
                groups, at = [], 0
                for group in filter(None, text.split(";")):
                    a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
                    end = at + sum(len(tool.a_bytes[i]) for i in a)
                    groups.append({"start": at, "end": end, "a_ids": a, "b_ids": b})
                    at = end
                out.append(groups)
            return {"doc_id": rows["doc_id"], "groups": out}

        return run

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, groups array<struct<start:long,end:long,a_ids:array<int>,b_ids:array<int>>>")


_BLOCKS = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("links", pa.binary()),
        ("pairs", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int64())),
    ]
)
_BLOCK_SCHEMA = "block long, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, links binary, pairs array<long>, times array<long>"


def narrow(pairs: int) -> str:
    """Type of a block's pair numbers."""
    return "<u2" if pairs <= 1 << 16 else "<u4"


def _block_rows(block: int, docs: list[tuple], codes: list[bytes]) -> pa.RecordBatch:
    """The documents of a block with the numbers of their links' pairs, and one row that lists the pairs with their counts."""
    sizes = [len(c) // 8 for c in codes]
    pairs, number, times = np.unique(np.frombuffer(b"".join(codes), "<i8"), return_inverse=True, return_counts=True)
    number = number.astype(narrow(len(pairs)))
    edges = np.cumsum([0, *sizes])
    links = [number[lo:hi].tobytes() for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    doc_id, n_a, n_b, digest = (list(x) for x in zip(*docs, strict=True))
    n, none = len(docs), [None]
    columns = [[block] * (n + 1), doc_id + none, n_a + none, n_b + none, sizes + none, digest + none, links + none]
    columns += [none * n + [pairs], none * n + [times]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCKS, strict=True)], schema=_BLOCKS)


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        codes: list[bytes] = []
        held = 0
        for batch in batches:
            for doc_id, (n_a, n_b, groups, linked) in zip(batch.column(0).to_pylist(), tool.documents(batch.column(1).to_pylist()), strict=True):
                rows.append((doc_id, n_a, n_b, hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
                codes.append(linked)
                held += len(linked) // 8 + 1
                if held >= BLOCK_LINKS:
                    yield _block_rows(block, rows, codes)
                    block, rows, codes, held = block + 1, [], [], 0
        if rows:
            yield _block_rows(block, rows, codes)

    return docs.select("doc_id", "text").mapInArrow(run, _BLOCK_SCHEMA)


def _score_block(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Documents of one block with the corpus counts of their links."""
    size = int(pairs["at"].max()) + 1 if len(pairs) else 0
    total, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = pairs["at"].to_numpy(np.int64)
    total[at] = pairs["total"].to_numpy(np.int64)
    best[at] = pairs["best"].to_numpy(np.int64)
    links = [np.frombuffer(x, narrow(size)) for x in docs["links"]]
    out = docs.drop(columns=["block", "links"])
    out["n_groups"] = out["n_links"]
    out["n_best"] = [int(best[x].sum()) for x in links]
    out["count_sum"] = [int(total[x].sum()) for x in links]
    return out


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of ``docs``: tokens, groups, links, and what the corpus says of the linked pairs.

    A token has at least one byte, so an offset ends at most one token of each side and every group has one link, between its
    last tokens. Rows without an id and repeated rows are documents like the others; other columns are not looked at.
    """
    rows = materialise(_blocks(docs, a_path, b_path), "aligned")
    listed = rows.where(F.col("pairs").isNotNull()).select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "x"))
    listed = listed.select(F.col("block").alias("of"), "at", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = materialise(listed.groupBy("pair").agg(F.sum("times").alias("total")), "pair-counts").withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    # one row per id of B's vocabulary
    highest = counts.groupBy("b").agg(F.max("total").alias("highest"))
    judged = counts.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))
    met = listed.select("of", "at", "pair").join(judged, "pair").select("of", "at", "total", "best")
    texts = rows.where(F.col("pairs").isNull()).select("block", "doc_id", "n_a", "n_b", "n_links", "groups_sha256", "links")
    out = texts.groupBy("block").cogroup(met.groupBy("of")).applyInPandas(_score_block, _OUT)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_OUT = "doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, n_groups long, n_best long, count_sum long"


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under both tokenizers, over the whole table."""
    return align_documents(table(spark, sf_dir, "documents"), tokenizer_file(A_FILE), tokenizer_file(B_FILE))
