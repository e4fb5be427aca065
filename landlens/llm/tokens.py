"""Ids of public tokenizers for whole texts, with equal words encoded once per worker.

A tokenizer of the ``tokenizers`` library splits a text before it merges. Where a split is certain to fall in front of a
space (byte-level rule: a space belongs to the word behind it) or to drop white space (word rule), the text is cut there and
the parts are looked up; parts not seen before go to the library together. A text in which a cut isn't certain goes to the
library whole. Results equal those of one call on the whole text.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from landlens.llm.common import CACHE_CHARS, CACHE_WORDS

#: Ids remembered per worker, four bytes each.
CACHE_IDS = 1 << 23
#: New words that go to the library as one text, with a mark between them.
JOINED = 512


class Numbers(dict):
    """word -> number in order of first sight; ``new`` gathers the words that got a number."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Ragged:
    """Rows of ids behind each other: row k is ids[starts[k] : starts[k] + sizes[k]]."""

    def __init__(self):
        self.starts, self.sizes, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.n_ids = 0

    def put(self, rows: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Set ``rows`` to ``ids``, cut into ``sizes``."""
        if not len(rows):
            return
        self.starts, self.sizes = (_room(x, int(rows.max()) + 1) for x in (self.starts, self.sizes))
        self.ids = _room(self.ids, self.n_ids + len(ids))
        self.starts[rows] = self.n_ids + np.cumsum(sizes) - sizes
        self.sizes[rows] = sizes
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``rows`` behind each other, and where each row ends."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[rows] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.ids[at], ends


def _room(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


class WordTokenizer:
    """Whole texts to little-endian unsigned 32-bit ids.

    Parts of texts are numbered as they come; a batch is an array of numbers, and its ids are taken together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = "Split" in str(self.tokenizer.pre_tokenizer) and "Replace" in str(self.tokenizer.normalizer)
        # the mark is always a token of its own between two words, and words without its character never give that token
        self.mark = " \x01 " if self.drops_space else "\n"
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.known = Numbers(), Ragged()

    def parts(self, text: str) -> list[str]:
        """Parts whose ids, put together, are those of the text."""
        if "<|" in text:  # a special token's name is found before all else
            return [text]
        if self.drops_space:
            # white space is dropped; only ASCII white space is cut at, and only between characters that can't compose
            odd = any(c in text for c in _SEPARATORS) if text.isascii() else _ODD_SPACE.search(text)
            return [text] if odd else text.split()
        # a space between two others belongs to a run of white space, whose last one may go to the next word
        if "  " in text or ((not text.isascii() or any(c in text for c in _WHITE)) and _SPACE_RUN.search(text)):
            return [text]
        lines = text.split("\n")
        if len(lines) > 2 and not all(lines[1:-1]) or any(line != line.strip() for line in lines):
            lines = [text]  # line ends beside other white space stay inside their part
        out: list[str] = []
        for k, line in enumerate(lines):
            if k:  # a line end between two other characters is always split off
                out.append("\n")
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out += [" " + p for p in rest]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.parts(t) if t else [] for t in texts]
        ends = np.cumsum([len(p) for p in split])
        rows = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(ends[-1]) if len(ends) else 0)
        if self.numbers.new:
            self._learn()
        ids, stops = self.known.take(rows)
        data = ids.tobytes()
        cuts = (4 * np.concatenate([[0], stops])[np.concatenate([[0], ends]).astype(np.int64)]).tolist()
        if len(self.numbers) > CACHE_WORDS or self.known.n_ids > CACHE_IDS:
            self._forget()  # what is remembered stays bounded, but for one batch
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self) -> None:
        """Encode the parts that got a number; a long one may be a whole text, and is encoded like the others."""
        numbers = self.numbers
        ask, joined = [], []
        for w in numbers.new:  # it grows while heads get their numbers
            # letters with one sign behind them are always split in front of the sign; lower case may end in a mark, which would join it
            if w[-1] in _SIGNS and 1 < len(w) <= CACHE_CHARS and (head := w[:-1]).removeprefix(" ").lower().isalpha():
                joined.append((numbers[w], numbers[head], numbers[w[-1]]))
            else:
                ask.append(w)
        numbers.new = []
        sign = self.mark.strip(" ")
        plain, rest = [], []
        for w in ask:
            bare = w.removeprefix(" ")
            # one word without white space, mark or special name; letters and digits alone are none of these
            one = len(w) <= CACHE_CHARS and (bare.isalnum() or (sign not in w and "<|" not in w and bare.split() == [bare]))
            (plain if one else rest).append(w)
        rest += self._learn_joined(plain)
        got = self._ids(rest)
        self._keep(rest, np.fromiter(map(len, got), np.int64, len(got)), got)
        if joined:
            whole, *both = np.array(joined, np.int64).T
            ids, ends = self.known.take(np.stack(both, axis=1).ravel())
            self.known.put(whole, np.diff(ends[1::2], prepend=0), ids)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        # without offsets, which nobody asks for
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, parts: list[str], sizes: np.ndarray, ids: list[list[int]]) -> None:
        rows = np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts))
        self.known.put(rows, sizes, np.concatenate([np.array(x, np.uint32) for x in ids] or [np.zeros(0, np.uint32)]))

    def _learn_joined(self, words: list[str]) -> list[str]:
        """Encode words many at a time; those of a text whose marks don't come back one between two words are returned."""
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        again: list[str] = []
        for group, got in zip(groups, self._ids([self.mark.join(g) for g in groups]), strict=True):
            ids = np.array(got, np.uint32)
            marks = np.flatnonzero(ids == self.mark_id)
            if len(marks) != len(group) - 1:
                again += group
                continue
            sizes = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
            self._keep(group, sizes, [ids[ids != self.mark_id]])
        return again


_SIGNS = ".,;:!?"
#: ASCII characters that only some rules take for white space, and the ASCII white space beside the space and the line end.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WHITE = ("\t", "\r", "\f", "\v", " \n", "\n ", *_SEPARATORS)
#: Any white space beyond the ASCII kinds, and the separators that only some rules take for white space.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0 ᠎ -‍ -  ⁠　﻿]|\s[̀-ͯ҃ͅ-҉᪰-᫿᷀-᷿⃐-⃿゙゚︠-︯]")
_SPACE_RUN = re.compile(r"\s \s|[\n\t\r\f\v\x1c-\x1f\x85\xa0  -  -  　] | [\n\t\r\f\v\x1c-\x1f\x85\xa0  -  -  　]")

_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file, kept between tasks with its words."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task one core
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
