"""SentencePiece encoding and decoding (merge type) by backtracking.

A text is turned into symbols the way the model's normaliser asks for (spaces become U+2581, one is put in front). No
vocabulary entry has a U+2581 after another character, so no merge crosses from a word into the space that follows it; each
run of U+2581 with the word behind it is therefore encoded on its own, and equal words are encoded once per worker.

A word is encoded left to right. An Aho-Corasick automaton over the vocabulary gives the longest entry that starts at each
character. The longest one is tried first; it is taken if the pair of it and its left neighbour, merged anew from single
characters, falls apart into exactly these two. Otherwise the next shorter entry is tried, and when none is left the last
token is taken back and its end position is marked in a bit field, so that no position fails twice. Adjacent pairs decide
validity, so the result is the one that merging by score produces.

Characters outside the vocabulary become byte tokens and separate what stands on either side.
"""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import DataFrame

from landlens.llm.common import WordCache, map_rows, tokenizer_file

SPACE = "▁"
BARE = "\x00"
MODEL = "piece_bpe_32k.model"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """Vocabulary, merge order and byte tokens of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        # the library only reads the file: its entries, scores and kinds
        spm = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts: list[str] = []
        self.kinds: list[str] = []
        self.bytes = [0] * 256
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in range(spm.vocab_size()):
            text = spm.id_to_piece(i)
            kind = "unknown" if spm.is_unknown(i) else "control" if spm.is_control(i) else "byte" if spm.is_byte(i) else "unused" if spm.is_unused(i) else "normal"
            self.texts.append(text)
            self.kinds.append(kind)
            if kind == "byte":
                self.bytes[int(text[3:5], 16)] = i
            elif kind == "normal":
                self.ids[text] = i
                self.score[text] = spm.get_score(i)
        self.unknown = spm.unk_id()
        self.splits_at_spaces = not any(SPACE in t.lstrip(SPACE) for t in self.ids)
        self.automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.inner = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.sizes = [len(t) for t in self.texts]

    # -- merging, for the checks of neighbours ------------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Merge single characters, best score first and leftmost among equals."""
        parts, get, none = list(text), self.score.get, float("-inf")
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            parts[at] += parts.pop(at + 1)
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Do the two tokens stay apart, and each whole, when their text is merged anew? left -1: the right one alone."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        parts = [self.texts[right]] if left < 0 else [self.texts[left], self.texts[right]]
        known = self.pairs[left << 32 | right] = self.merge("".join(parts)) == parts
        return known

    def next_shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of the token, or -1."""
        known = self.shorter.get(token)
        if known is None:
            text = self.texts[token]
            known = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
            self.shorter[token] = known
        return known

    # -- encoding ------------------------------------------------------------------------------------------------------------

    def longest(self, word: str) -> array:
        """For each position the longest entry that starts there, or -1."""
        out = array("i", [-1]) * len(word)
        for end, (token, size) in self.automaton.iter(word):
            out[end - size + 1] = token  # ends only grow, so the last one is the longest
        return out

    def encode_run(self, longest: array, start: int, end: int, out: list[int]) -> None:
        """Encode the characters start..end, all of them in the vocabulary."""
        sizes, pairs, fits, shorter = self.sizes, self.pairs, self.fits, self.next_shorter
        tokens: list[int] = []
        failed: bytearray | None = None
        pos, token, last = start, longest[start], -1
        while pos < end:
            while token != -1:
                stop = pos + sizes[token]
                if stop <= end and (failed is None or not failed[(stop - start) >> 3] >> ((stop - start) & 7) & 1):
                    known = pairs.get(last << 32 | token)
                    if known or (known is None and fits(last, token)):
                        break
                token = shorter(token)
            if token != -1:
                tokens.append(token)
                pos, last = stop, token
                if pos < end:
                    token = longest[pos]
            else:
                if not tokens:
                    raise ValueError("the vocabulary lacks a character that it was found to have")
                if failed is None:
                    failed = bytearray((end - start) // 8 + 1)
                failed[(pos - start) >> 3] |= 1 << ((pos - start) & 7)
                token = tokens.pop()
                pos -= sizes[token]
                token, last = shorter(token), tokens[-1] if tokens else -1
        out += tokens

    def encode_word(self, word: str) -> list[int]:
        out: list[int] = []
        longest = self.longest(word)
        ids, pos, size = self.ids, 0, len(word)
        while pos < size:
            if word[pos] in ids:
                stop = pos + 1
                while stop < size and word[stop] in ids:
                    stop += 1
                self.encode_run(longest, pos, stop, out)
                pos = stop
            else:
                out += [self.bytes[b] for b in word[pos].encode("utf-8")]
                pos += 1
        return out

    def encode_part(self, part: str) -> list[int]:
        return self.encode_word(part[1:] if part.startswith(BARE) else SPACE + part)

    def words(self, text: str | None) -> list[str]:
        """The parts of a text that can be encoded one by one: without the U+2581 that starts them, or behind ``BARE`` if none does."""
        if not text:
            return []
        if self.splits_at_spaces and SPACE not in text and BARE not in text:
            # a line end is outside the vocabulary, so no merge crosses it
            plain = (text if "\n" in self.ids else text.replace("\n", f" {BARE}\n")).split(" ")
            if "" not in plain:
                return plain
        text = text.replace(" ", SPACE)
        if not self.splits_at_spaces or BARE in text:
            return [BARE + SPACE + text]
        out, run = [], ""
        for part in text.split(SPACE):
            if part:
                out.append(run + part)
                run = ""
            else:
                run += SPACE
        if run:
            out.append(run[1:])
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for word in self.words(text) for i in self.encode_part(word)]

    # -- decoding ------------------------------------------------------------------------------------------------------------

    def decode_word(self, ids: list[int]) -> str:
        """Token texts put together, with U+2581 kept; byte tokens are read as UTF-8, stray bytes as U+FFFD."""
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == "byte":
                raw.append(int(self.texts[i][3:5], 16))
                continue
            if raw:
                out.append(utf8(bytes(raw)))
                raw.clear()
            if i >= 0 and self.kinds[i] != "control":
                out.append(" ⁇ " if self.kinds[i] == "unknown" else self.texts[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return surface(self.decode_word(ids))


def utf8(raw: bytes) -> str:
    """UTF-8 text; each byte that starts no whole character is one U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def surface(joined: str) -> str:
    return (joined[1:] if joined.startswith(SPACE) else joined).replace(SPACE, " ")


_MODELS: dict[str, tuple[PieceModel, WordCache]] = {}


def load(path: str) -> tuple[PieceModel, WordCache]:
    """The model and its word cache, kept by the worker between tasks."""
    if path not in _MODELS:
        model = PieceModel(path)

        def both(word: str) -> tuple[str, str]:
            cut = len(word.rstrip(".,;:!?"))
            if 0 < cut < len(word) and word[cut - 1 : cut + 1] not in model.inner:  # no entry spans the cut
                ids, text = cache[word[:cut]]
                tail = model.encode_word(word[cut:])
                return f"{ids},{','.join(map(str, tail))}", text + model.decode_word(tail)
            ids = model.encode_part(word)
            return ",".join(map(str, ids)), model.decode_word(ids)

        cache = WordCache(both)
        _MODELS[path] = model, cache
    return _MODELS[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>: the tokens of each text. A null or empty text has none; other columns are not looked at."""

    def make():
        model, cache = load(path)

        def run(cols):
            return {"doc_id": cols["doc_id"], "ids": [[int(i) for w in model.words(t) for i in cache[w][0].split(",")] for t in cols["text"]]}

        return run

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the texts that the ids stand for. Null ids give an empty text."""

    def make():
        model, _ = load(path)
        return lambda cols: {"doc_id": cols["doc_id"], "text": [model.decode(i or []) for i in cols["ids"]]}

    return map_rows(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode in one pass over the texts and keep the digests of both.

    One row per row of ``docs``, a null id or a repeated one included. A null or empty text has 0 tokens and the digests of
    the empty string.
    """

    def make():
        model, cache = load(path)

        def run(cols):
            n, ids, decoded = [], [], []
            for text in cols["text"]:
                pairs = [cache[w] for w in model.words(text)]
                joined = ",".join([p[0] for p in pairs])
                n.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(surface("".join([p[1] for p in pairs])).encode()).hexdigest())
            return {"doc_id": cols["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

        return run

    return map_rows(docs.select("doc_id", "text"), make, SCHEMA)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from landlens.llm.common import table

    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_file(MODEL))
