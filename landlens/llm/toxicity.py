"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

The kernel compares two words by the three-letter subsequences they share; a subsequence of a longer span counts less, by
``DECAY`` for each letter it skips. Inserted letters therefore lower the likeness of an insult to its plain form only a
little, and signs between letters are not seen at all; letters written singly ("a b c d") are read as one word.

Insults also stand inside longer words (a stem with endings), so a word's likeness to a landmark is that of its likest part: parts
are as long as the landmark and up to ``SLACK`` letters longer.

Landmarks are words and word beginnings that lean to the toxic side, by the deviation of their document counts, at least ``LEAN_SHARE``
as much as the one that leans most. They are chosen one after another, each for the documents that hold none of those before it; words that merely stand beside an insult, or stood in a few toxic documents, are none. A sentence's response to a landmark is
that of its likest word, responses below ``LEAST`` are 0, and the Nyström map makes them features of a linear machine (squared hinge,
solved by Newton steps). It is trained on sentences: of each labelled document
the ``SENTENCES`` with the strongest responses, of toxic documents the strongest alone. A document's score is that of its worst
sentence, turned into a probability by a logistic fit on the training documents.

Landmarks and machine are fitted on a bounded sample, at most ``FIT_DOCS`` documents of each label (those with the smallest
hash of the id; equal texts count once), the landmarks on one half of it and the machine on the other, so that words that stood in
toxic documents by chance gain no weight; the labels of held-out documents are never read. All texts are scored whole.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlens.llm.common import fold, map_rows, table
from landlens.session import materialise

FOLDS, HELD_OUT = 5, 0
FIT_DOCS = 2000
LANDMARKS = 32
DECAY = 0.5
SPAN = 5
SLACK = 2
LEAST = 0.6
LEAN_SHARE = 0.4
#: Candidates for landmarks that are looked at document by document: those that lean most.
CANDIDATES = 4000
#: Word beginnings of up to so many letters are candidates beside whole words of up to 24.
STEM_LETTERS = 12
SENTENCES = 3
MIN_LETTERS = 4
#: Words that a worker remembers as unlike all landmarks.
SEEN_WORDS = 600_000
_LETTERS = re.compile(r"[\W_]+")
_DIGITS = str.maketrans("01345", "oieas")
#: A sign inside a word ends no sentence.
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")
#: Four or more single characters in a row, with a space or sign between each.
_SPELLED = re.compile(r"(?<!\w)\w(?:[ .\-_*]\w){3,}(?!\w)")


def plain(word: str) -> str:
    """The word's letters in lower case, digits read as the letters they look like, runs of one letter cut to two."""
    return re.sub(r"(.)\1{2,}", r"\1\1", _LETTERS.sub("", word.lower()).translate(_DIGITS))


def subsequences(word: str) -> dict[str, float]:
    """Three-letter subsequences that span at most SPAN letters more than one, with their weights summed."""
    out: dict[str, float] = defaultdict(float)
    n = len(word)
    for i in range(n):
        for k in range(i + 2, min(n, i + SPAN + 1)):
            weight = DECAY ** (k - i - 2)
            for j in range(i + 1, k):
                out[word[i] + word[j] + word[k]] += weight
    return out


def likeness(a: dict[str, float], b: dict[str, float]) -> float:
    dot = sum(v * b[u] for u, v in a.items() if u in b)
    return dot / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5 if dot else 0.0


def least_norms(size: int) -> np.ndarray:
    """The square root of the least self-likeness of words of 0 to ``size`` letters."""
    sizes = np.arange(size + 1)
    gaps = np.arange(2, SPAN + 1)
    return np.sqrt((np.maximum(0, sizes[:, None] - gaps) * (gaps - 1) * DECAY ** (2.0 * (gaps - 2))).sum(axis=1).clip(1e-9))


def part_likeness(word: str, mark: dict[str, float], size: int) -> float:
    """The likeness of the word's likest part to a landmark of ``size`` letters."""
    best = likeness(subsequences(word), mark)
    for n in range(size, min(len(word) - 1, size + SLACK) + 1):
        for at in range(len(word) - n + 1):
            best = max(best, likeness(subsequences(word[at : at + n]), mark))
    return best


class Landmarks:
    """Responses of words to the landmarks; words that no landmark answers to are found in bulk."""

    def __init__(self, words: list[str]):
        self.words = words
        self.maps = [subsequences(w) for w in words]
        grams = sorted({u for m in self.maps for u in m})
        self.table = np.full(1 << 18, -1, np.int32)
        # several three-letter strings may share a code; weights then add up, so that bounds stay upper bounds
        codes = sorted({self._code(u) for u in grams})
        place = {c: i for i, c in enumerate(codes)}
        self.table[codes] = np.arange(len(codes), dtype=np.int32)
        self.weights = np.zeros((max(1, len(codes)), max(1, len(words))), np.float32)
        for j, m in enumerate(self.maps):
            norm = sum(v * v for v in m.values()) ** 0.5 or 1.0
            for u, v in m.items():
                self.weights[place[self._code(u)], j] += v / norm
        self.norms = least_norms(max([0, *map(len, words)]))
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.hot: dict[str, dict[int, float]] = {}
        self.seen: set[str] = set()

    @staticmethod
    def _letter(c: np.ndarray) -> np.ndarray:
        return np.where(c < 128, c, c % 31 + 1) & 63

    def _code(self, u: str) -> int:
        a, b, c = (int(x) for x in self._letter(np.array([ord(x) for x in u])))
        return a << 12 | b << 6 | c

    def bounds(self, words: list[str]) -> np.ndarray:
        """An upper bound of the likeness of each word's likest part to each landmark."""
        sizes = np.array([len(w) for w in words], np.int64)
        letters = self._letter(np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64))
        owner = np.repeat(np.arange(len(words)), sizes)
        at, code, weight = [], [], []
        for gap in range(2, SPAN + 1):
            if len(letters) <= gap:
                continue
            inside = owner[:-gap] == owner[gap:]
            ends = letters[:-gap] << 12 | letters[gap:]
            for middle in range(1, gap):
                found = self.table[ends | letters[middle : len(letters) - gap + middle] << 6]
                hit = np.flatnonzero(inside & (found >= 0))
                at.append(owner[hit])
                code.append(found[hit])
                weight.append(np.full(len(hit), DECAY ** (gap - 2), np.float32))
        best = np.zeros((len(words), len(self.words)))
        if at and len(owners := np.concatenate(at)):
            order = np.argsort(owners, kind="stable")
            owners = owners[order]
            rows = self.weights[np.concatenate(code)[order]] * np.concatenate(weight)[order][:, None]
            starts = np.flatnonzero(np.diff(owners, prepend=-1))
            best[owners[starts]] = np.add.reduceat(rows, starts, axis=0)
        return best / self.norms[np.minimum(sizes[:, None], self.sizes)]

    def learn(self, words: set[str]) -> None:
        """Sort words not met before into those that a landmark answers to and the others."""
        if len(self.hot) > SEEN_WORDS:
            self.hot.clear()
            self.seen.clear()
        new = [w for w in words if w not in self.hot and w not in self.seen]
        if len(self.seen) + len(new) > SEEN_WORDS:
            self.seen.clear()
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            letters = [plain(w) for w in part]
            long = [i for i, w in enumerate(letters) if len(w) >= MIN_LETTERS]
            bound = self.bounds([letters[i] for i in long]) if long else []
            for row, j in zip(*(x.tolist() for x in np.nonzero(np.asarray(bound) >= LEAST)), strict=True) if long else ():
                i = long[row]
                v = part_likeness(letters[i], self.maps[j], len(self.words[j]))
                if v >= LEAST:
                    self.hot.setdefault(part[i], {})[j] = v
        self.seen.update(w for w in new if w not in self.hot and len(w) <= 64)

    def sentences(self, text: str, words: set[str]) -> list[dict[int, float]]:
        """The responses of the sentences that have any; ``words`` are the text's, known to learn()."""
        spelled = [plain(m) for m in _SPELLED.findall(text)]
        if spelled:
            self.learn(set(spelled))
        out = [self.hot[w] for w in spelled if w in self.hot]
        if self.hot.keys() & words:
            for sentence in _SENTENCE.split(text):
                got: dict[int, float] = {}
                for w in set(sentence.split()):
                    for j, v in self.hot.get(w, {}).items():
                        got[j] = max(v, got.get(j, 0.0))
                if got:
                    out.append(got)
        return out


def text_words(text: str | None) -> set[str]:
    """Words as they stand between white space and sentence ends."""
    return set(_SENTENCE.sub(" ", text).split()) if text else set()


class Machine:
    """A fitted model: the landmarks, the weight of each response, and the logistic of the score."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, slope: float, shift: float):
        self.landmarks, self.weights, self.bias, self.slope, self.shift = landmarks, weights, bias, slope, shift

    def margin(self, sentences: list[dict[int, float]]) -> float:
        return max((sum(self.weights[j] * v for j, v in s.items()) for s in [{}, *sentences])) + self.bias

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss (the last column of x is the bias), by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(50):
        inside = y * (x @ w) < 1
        a = x[inside]
        new = np.linalg.solve(ridge + cost * a.T @ a, cost * a.T @ y[inside])
        if np.abs(new - w).max() < 1e-8:
            break
        w = 0.5 * w + 0.5 * new if _ > 20 else new
    return w


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of y = 1, by Newton steps with a light prior."""
    p = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones(len(margins))], 1)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        h = x.T @ (x * (q * (1 - q))[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (y - q) - 1e-2 * (p - [1.0, 0.0]))
        p = p + np.clip(step, -2, 2)
    return float(max(p[0], 1e-3)), float(p[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[DataFrame, float]:
    """doc_id, toxic, text of the training sample, and the toxic share of all training labels (0 if there are none).

    A doc_id labelled both ways counts as toxic.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold("doc_id", FOLDS) != HELD_OUT)
    ids = docs.where(F.col("text").isNotNull()).select("doc_id").join(known, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = materialise(ids, "toxicity-labels")
    share = ids.agg(F.avg("toxic")).first()[0] or 0.0
    parts = [ids.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs) for t in (1, 0)]
    ids = materialise(parts[0].unionByName(parts[1]), "toxicity-sample")  # at most twice fit_docs rows
    texts = docs.select("doc_id", "text").join(ids, "doc_id").where(F.col("text").isNotNull())
    return texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), share


def stems(text: str | None) -> set[str]:
    """The plain words of a text and their beginnings."""
    out = set()
    for w in {plain(w) for w in text_words(text)}:
        if MIN_LETTERS <= len(w) <= 24:
            out.add(w)
        out.update(w[:n] for n in range(MIN_LETTERS, min(len(w), STEM_LETTERS + 1)))
    return out


def lean(toxic, clean, share, root):
    """Deviation of the toxic count from the expected one; for columns and numbers alike."""
    expected = (toxic + clean) * share
    return (toxic - expected) / root(expected * (1 - share) + 1.0)


def choose_landmarks(sample: DataFrame, count: int = LANDMARKS) -> list[str]:
    """Words and word beginnings that lean most to the toxic side, each over the documents that hold none chosen before."""

    def make():
        def run(cols):
            out: dict[tuple[str, int], int] = defaultdict(int)
            for text, toxic in zip(cols["text"], cols["toxic"], strict=True):
                for w in stems(text):
                    out[w, toxic] += 1
            return {"word": [k[0] for k in out], "toxic": [k[1] for k in out], "n": list(out.values())}

        return run

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return []
    counts = map_rows(sample.select("toxic", "text"), make, "word string, toxic int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")
    )
    share = totals[1] / (totals[0] + totals[1])
    ranked = counts.where("t >= 3").select("word", lean(F.col("t"), F.col("c"), share, F.sqrt).alias("lean")).where("lean > 0")
    # longer ones first among equals: a stem, not its first letters
    words = [r["word"] for r in ranked.orderBy(F.desc("lean"), F.desc(F.length("word")), "word").limit(CANDIDATES).collect()]
    place = {w: i for i, w in enumerate(words)}

    def find():
        return lambda cols: {"toxic": cols["toxic"], "held": [sorted(place[w] for w in stems(t) if w in place) for t in cols["text"]]}

    rows = map_rows(sample.select("toxic", "text"), find, "toxic int, held array<int>").where(F.size("held") > 0).collect()  # of the bounded sample
    held = np.zeros((len(rows), len(words)), bool)
    for k, r in enumerate(rows):
        held[k, r["held"]] = True
    toxic = np.array([r["toxic"] for r in rows], bool)
    clean = held[~toxic].sum(axis=0)
    first = lean(held[toxic].sum(axis=0), clean, share, np.sqrt)
    leaning = first >= LEAN_SHARE * first.max(initial=0.0)
    left, chosen = held[toxic], []
    while len(chosen) < count and len(left) and words:
        t = left.sum(axis=0)
        leans = np.where(leaning & (t > 0), lean(t, clean, share, np.sqrt), 0.0)
        best = int(leans.argmax())
        if leans[best] <= 0:
            break
        chosen.append(words[best])
        left = left[~left[:, best]]
    return chosen


def responses(rows: DataFrame, landmarks: list[str], keep: int = SENTENCES) -> DataFrame:
    """doc_id, toxic, and the strongest sentences' responses as flat lists (landmark numbers, values)."""

    def make():
        marks = Landmarks(landmarks)

        def run(cols):
            out = {"toxic": cols["toxic"], "marks": [], "values": []}
            for text in cols["text"]:
                words = text_words(text)
                marks.learn(words)
                best = sorted(marks.sentences(text, words), key=lambda s: -sum(s.values()))[:keep]
                out["marks"].append([list(s) for s in best])
                out["values"].append([list(s.values()) for s in best])
            return out

        return run

    return map_rows(rows.select("toxic", "text"), make, "toxic int, marks array<array<int>>, values array<array<double>>")


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Machine:
    """Fit on the labelled sample. Without documents of both labels every score is the labels' share (0.5 without any)."""
    sample, share = labelled_sample(docs, labels, fit_docs)
    sample = materialise(sample, "toxicity-texts")
    half = F.xxhash64(F.col("text"), F.lit("half")) % 2 == 0  # copies fall in one half
    landmarks = choose_landmarks(sample.where(half))
    if not landmarks or sample.where(~half).select("toxic").distinct().count() < 2:
        shares = [r["toxic"] for r in sample.select("toxic").limit(1).collect()]
        return Machine([], np.zeros(0), 0.0, 1.0, {0: -5.0, 1: 5.0}.get(shares[0], 0.0) if shares else -1e-6)
    maps = [subsequences(w) for w in landmarks]
    kernel = np.array([[likeness(a, b) for b in maps] for a in maps])
    values, vectors = np.linalg.eigh(kernel + 1e-3 * np.eye(len(maps)))
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T  # the Nyström map
    found = responses(sample.where(~half), landmarks).collect()
    x, y, owner, docs_y = [], [], [], []
    for r in found:
        sentences = [dict(zip(m, v, strict=True)) for m, v in zip(r["marks"], r["values"], strict=True)] or [{}]
        for s in sentences[: 1 if r["toxic"] else None]:
            row = np.zeros(len(landmarks))
            for j, v in s.items():
                row[j] = v
            x.append(row)
            y.append(1.0 if r["toxic"] else -1.0)
        docs_y.append(float(r["toxic"]))
        owner.append(sentences)
    x, y = np.array(x) @ root, np.array(y)
    w = squared_hinge(np.concatenate([x, np.ones((len(x), 1))], 1), y)
    machine = Machine(landmarks, root @ w[:-1], float(w[-1]), 1.0, 0.0)
    machine.slope, machine.shift = logistic(np.array([machine.margin(s) for s in owner]), np.array(docs_y))
    # the sample holds more toxic documents than the labels do: back to their odds
    drawn = float(np.mean(docs_y))
    machine.shift += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of every row; a null or empty text has the score of a sentence that no landmark answers to."""

    def make():
        marks = Landmarks(machine.landmarks)

        def run(cols):
            words = [text_words(t) for t in cols["text"]]
            marks.learn(set().union(*words))
            scores = [machine.probability(machine.margin(marks.sentences(t, w) if t else [])) for t, w in zip(cols["text"], words, strict=True)]
            return {"doc_id": cols["doc_id"], "score": scores}

        return run

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a row without an id is not held out."""
    scored = score(docs, train(docs, labels))
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose text isn't predicted toxic, all columns kept; texts are judged row by row, so no ids are matched."""
    machine = train(docs, labels)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def make():
        marks = Landmarks(machine.landmarks)

        def run(cols):
            words = [text_words(t) for t in cols["text"]]
            marks.learn(set().union(*words))
            keep = [machine.probability(machine.margin(marks.sentences(t, w) if t else [])) < 0.5 for t, w in zip(cols["text"], words, strict=True)]
            return {name: [v for v, k in zip(values, keep, strict=True) if k] for name, values in cols.items()}

        return run

    return map_rows(docs, make, schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
