"""Language-model scores: a gated recurrent network in numpy with a class-factored output.

Words are counted over all training documents. The ``CLASSES * SLOTS`` most frequent tokens (the document end among them) are the
network's vocabulary; other words are one of five tokens by their look, and their own probability behind it is the smoothed
share of the word among such words. Output is factored: a softmax over classes (tokens of like frequency), then one over the
class's slots, so a token costs CLASSES + SLOTS products.

Training goes over all training documents by truncated back-propagation (``STEPS`` steps, Adam), with the state carried from
window to window of a document and reset between documents. Every task trains on its own partition from the weights of the round
before; weights are averaged by tokens, in slices. A first round over one document in ``WARM_UP`` brings the tasks to common weights,
the second goes over the others.

Scoring runs ``STREAMS`` documents side by side, with their state carried across windows until each one ends, so a text's score is
that of the whole text. Counts of rare words are joined, not sent around: a scored row lists its rare words, and counts meet
them in a shuffle. What all tasks get is the network and the ``SHARED_WORDS`` most frequent words, both of a fixed size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.llm.common import WordCache, fold, ship_code, sum_vectors, table
from landlens.session import materialise

FOLDS, HELD_OUT = 5, 1
CLASSES, SLOTS = 16, 32
HIDDEN, EMBEDDED = 16, 12
STREAMS = 512
TRAIN_STREAMS = 512
STEPS = 16
WINDOW = 32
RATE = 8e-3
#: Tokens of a segment when a task trains on what is left at its end.
SEGMENT = 64
WARM_UP = 16
SHARED_WORDS = 30_000
#: Counts a task holds before it hands them on.
COUNTED = 300_000
LOOKS = 5
#: No word is empty, so the empty word is the document end.
END = b""
SLICES = 32


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case; words between spaces, tabs and line ends (U+0009 to U+000D)."""
    return text.encode().lower().split() if text else []


def look(word: bytes) -> int:
    """Which of the five kinds of word outside the vocabulary it is."""
    last = word[-1]
    if last == 46:
        return 0
    if last == 44:
        return 1
    if not word.isascii():
        return 2
    return 3 if chr(last).isalnum() else 4


def look_sql(word: Column) -> Column:
    return (
        F.when(word.endswith("."), 0).when(word.endswith(","), 1).when(F.length(word) != F.octet_length(word), 2)
        .when(word.rlike("[0-9A-Za-z]$"), 3).otherwise(4)
    )


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all texts of ``docs``; the empty word counts the documents."""
    ship_code(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            found[END] += batch.num_rows
            for text in batch.column(0):
                found.update(words_of(text.as_py()))
                if len(found) > COUNTED:
                    yield rows()
        if found:
            yield rows()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Vocabulary:
    """Shared words with their counts, tokens of the network, and what looks outside it sum to."""

    def __init__(self, top: list[tuple[bytes, int]], total: int, distinct: int, looks: dict[int, tuple[int, int]]):
        self.total, self.distinct = total, distinct
        self.counts = dict(top)
        self.counts.setdefault(END, 0)
        room = CLASSES * SLOTS - LOOKS
        inside = sorted(self.counts, key=lambda w: (w != END, -self.counts[w], w))[:room]
        for w in inside:  # looks hold what is outside the vocabulary
            if w != END:
                n, v = looks.get(look(w), (0, 0))
                looks[look(w)] = n - self.counts[w], v - 1
        self.look_total = [looks.get(k, (0, 0)) for k in range(LOOKS)]
        tokens = [(n, k) for k, (n, _) in enumerate(self.look_total)] + [(self.counts[w], w) for w in inside]
        tokens.sort(key=lambda t: (-t[0], str(t[1])))
        self.ids = {w: i for i, (_, w) in enumerate(tokens) if isinstance(w, bytes)}
        self.look_ids = [next(i for i, (_, w) in enumerate(tokens) if w == k and isinstance(w, int)) for k in range(LOOKS)]
        self.frequency = np.zeros(CLASSES * SLOTS)
        self.frequency[: len(tokens)] = [max(0, n) + 0.5 for n, _ in tokens]

    def base_denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def look_denominators(self) -> np.ndarray:
        return np.array([n + 0.5 * (v + 1) for n, v in self.look_total])

    def token_id(self, word: bytes) -> int:
        known = self.ids.get(word)
        return self.look_ids[look(word)] if known is None else known


class TokenIds:
    """Texts' words to token ids, with the document end behind them; words are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.cache, self.end = WordCache(vocabulary.token_id), vocabulary.ids[END]

    def __call__(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words) + 1, np.int32)
        out[:-1] = list(map(self.cache.__getitem__, words))
        out[-1] = self.end
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """The gated recurrent network; weights in one float32 vector with named views."""

    def __init__(self, flat: np.ndarray | None = None, frequency: np.ndarray | None = None):
        v, h, d, c, s = CLASSES * SLOTS, HIDDEN, EMBEDDED, CLASSES, SLOTS
        self.shapes = {"e": (v, d), "wx": (d, 3 * h), "bx": (3 * h,), "u": (h, 3 * h), "wc": (h, c), "bc": (c,), "wo": (c, h, s), "bo": (c, s)}
        self.size = sum(int(np.prod(x)) for x in self.shapes.values())
        self.flat = np.zeros(self.size, np.float32) if flat is None else flat.astype(np.float32)
        self.views(self.flat, self.__dict__)
        if flat is None:
            rng = np.random.default_rng(8)
            for name, scale in (("e", 0.3), ("wx", d**-0.5), ("u", h**-0.5), ("wc", 0.05), ("wo", 0.05)):
                getattr(self, name)[...] = rng.normal(0, scale, self.shapes[name])
            by_class = np.maximum(frequency, 1e-9).reshape(c, s)
            self.bc[...] = np.log(by_class.sum(1) / by_class.sum())
            self.bo[...] = np.where(by_class > 1e-8, np.log(by_class / by_class.sum(1, keepdims=True)), -30)

    def views(self, flat: np.ndarray, into: dict) -> dict:
        at = 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            into[name] = flat[at : at + n].reshape(shape)
            at += n
        return into

    def inputs(self) -> np.ndarray:
        """What each token adds to the gates."""
        return self.e @ self.wx + self.bx

    def step(self, gx: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        gh = h @ self.u
        zr = sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        inner = gh[:, 2 * HIDDEN :]
        n = np.tanh(gx[:, 2 * HIDDEN :] + r * inner)
        return n + z * (h - n), z, r, n, inner

    def output(self, hs: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln probabilities of the tokens behind the states; with ``grads`` also the gradient of their negative sum."""
        n = len(ids)
        kind, slot = np.divmod(ids, SLOTS)
        logits = hs @ self.wc + self.bc
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        total = p.sum(1, keepdims=True)
        out = logits[np.arange(n), kind] - np.log(total[:, 0])
        back = None
        if grads is not None:
            p /= total
            p[np.arange(n), kind] -= 1
            grads["wc"] += hs.T @ p
            grads["bc"] += p.sum(0)
            back = p @ self.wc.T
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            mine = order[cuts[c] : cuts[c + 1]]
            if not len(mine):
                continue
            state, own = hs[mine], slot[mine]
            logits = state @ self.wo[c] + self.bo[c]
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            total = p.sum(1, keepdims=True)
            at = np.arange(len(mine))
            out[mine] += logits[at, own] - np.log(total[:, 0])
            if grads is not None:
                p /= total
                p[at, own] -= 1
                grads["wo"][c] += state.T @ p
                grads["bo"][c] += p.sum(0)
                back[mine] += p @ self.wo[c].T
        return out, back

    def gradients(self, ids: np.ndarray, previous: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient over one window (steps x streams), the state after it, and the summed ln probability.

        ``previous`` are the tokens before ``ids`` (a document's first one follows the document end), ``fresh`` marks first tokens.
        """
        steps, streams = ids.shape
        flat = np.zeros(self.size, np.float32)
        grads = self.views(flat, {})
        table = self.inputs()
        kept, states = [], np.empty((steps, streams, HIDDEN), np.float32)
        for t in range(steps):
            h = h * ~fresh[t][:, None]
            new, z, r, n, inner = self.step(table[previous[t]], h)
            kept.append((h, z, r, n, inner))
            h = states[t] = new
        logp, back = self.output(states.reshape(-1, HIDDEN), ids.reshape(-1), grads)
        back = back.reshape(steps, streams, HIDDEN)
        d_gates = np.empty((steps, streams, 3 * HIDDEN), np.float32)
        dh = np.zeros((streams, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, n, inner = kept[t]
            dh = dh + back[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            g = np.concatenate([dz, dr, dn * r], 1)
            grads["u"] += before.T @ g
            d_gates[t, :, :HIDDEN], d_gates[t, :, HIDDEN : 2 * HIDDEN], d_gates[t, :, 2 * HIDDEN :] = dz, dr, dn
            dh = (dh * z + g @ self.u.T) * ~fresh[t][:, None]
        d = d_gates.reshape(-1, 3 * HIDDEN)
        tokens = previous.reshape(-1)
        grads["bx"] += d.sum(0)
        grads["wx"] += self.e[tokens].T @ d
        de = d @ self.wx.T
        for k in range(EMBEDDED):
            grads["e"][:, k] = np.bincount(tokens, de[:, k], len(self.e))
        return flat, h, float(logp.sum())


class Trainer:
    """Adam over windows of token streams."""

    def __init__(self, network: Network, end: int):
        self.network, self.end, self.tokens, self.updates = network, end, 0, 0
        self.m, self.v = np.zeros(network.size, np.float32), np.zeros(network.size, np.float32)
        self.queues: list[list[np.ndarray]] = [[] for _ in range(TRAIN_STREAMS)]  # documents dealt to a stream and not yet used
        self.sizes = [0] * TRAIN_STREAMS
        self.h = np.zeros((TRAIN_STREAMS, HIDDEN), np.float32)
        self.last = np.full(TRAIN_STREAMS, end)

    def add(self, docs: list[np.ndarray]) -> None:
        """Deal documents to the shortest streams and train while all hold a window."""
        for ids in docs:
            k = self.sizes.index(min(self.sizes))
            self.queues[k].append(ids)
            self.sizes[k] += len(ids)
        self.run()

    def finish(self) -> None:
        """Train on what the streams still hold: cut into segments, those of one length side by side."""
        by_size: dict[int, list[np.ndarray]] = {}
        for queue in self.queues:
            for ids in queue:
                for at in range(0, len(ids), SEGMENT):
                    part = ids[at : at + SEGMENT]
                    by_size.setdefault(len(part), []).append(part)
        for size, parts in sorted(by_size.items()):
            for at in range(0, len(parts), TRAIN_STREAMS):
                some = np.array(parts[at : at + TRAIN_STREAMS], np.int64).T
                ids, fresh = some & 0xFFFFFF, np.zeros(some.shape, bool)
                fresh[0] = True
                previous = np.concatenate([np.full((1, some.shape[1]), self.end), ids[:-1]])
                state = np.zeros((some.shape[1], HIDDEN), np.float32)
                for t in range(0, size, STEPS):
                    part = slice(t, t + STEPS)
                    grad, state, _ = self.network.gradients(ids[part], previous[part], fresh[part], state)
                    # few streams weigh less, so that leftovers don't pull the weights about
                    self.update(grad / (STEPS * max(some.shape[1], TRAIN_STREAMS // 8)))
                self.tokens += some.size

    def run(self) -> None:
        """Train on the windows that all streams can fill."""
        live, steps = range(TRAIN_STREAMS), STEPS
        usable = min(self.sizes) // steps * steps
        if not usable:
            return
        ids = np.empty((usable, len(live)), np.int64)
        fresh = np.zeros((usable, len(live)), bool)
        for j, k in enumerate(live):
            at = 0
            queue = self.queues[k]
            while at < usable:
                head = queue[0]
                n = min(len(head), usable - at)
                ids[at : at + n, j] = head[:n] & 0xFFFFFF
                fresh[at : at + n, j] = head[:n] >> 24 > 0
                if n == len(head):
                    queue.pop(0)
                else:
                    queue[0] = head[n:]
                at += n
            self.sizes[k] -= usable
        previous = np.concatenate([self.last[None, :], ids[:-1]])
        previous[fresh] = self.end
        self.last = ids[-1]
        for at in range(0, usable, steps):
            part = slice(at, at + steps)
            grad, self.h, _ = self.network.gradients(ids[part], previous[part], fresh[part], self.h)
            self.update(grad / (steps * TRAIN_STREAMS))
            self.tokens += steps * TRAIN_STREAMS

    def update(self, grad: np.ndarray) -> None:
        self.updates += 1
        norm = float(np.sqrt(grad @ grad))
        if norm > 1:
            grad /= norm
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        rate = RATE * (1 - 0.99**self.updates) ** 0.5 / (1 - 0.9**self.updates) / (1 + self.updates / 2000)
        self.network.flat -= rate * self.m / (np.sqrt(self.v) + 1e-8)


def marked(ids: np.ndarray) -> np.ndarray:
    """Token ids with bit 24 set on the document's first one."""
    out = ids.copy()
    out[0] |= 1 << 24
    return out


def train_round(docs: DataFrame, words: Vocabulary, flat: np.ndarray) -> np.ndarray:
    """One pass over ``docs``: every partition trains from ``flat``, the results are averaged by their tokens."""
    sent = docs.sparkSession.sparkContext.broadcast((words, flat))
    ship_code(docs.sparkSession)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, start = sent.value
        trainer, token_ids = Trainer(Network(start), vocabulary.ids[END]), TokenIds(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                trainer.add([marked(token_ids(words_of(t))) for t in batch.column(0).slice(at, 512).to_pylist()])
        trainer.finish()
        if trainer.tokens:
            parts = np.array_split(trainer.network.flat.astype(np.float64) * trainer.tokens, SLICES)
            data = [np.array([trainer.tokens], "<f8").tobytes(), *[p.astype("<f8").tobytes() for p in parts]]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(data), pa.int64()), pa.array(range(-1, SLICES), pa.int32()), pa.array(data, pa.binary())], names=["part", "slice", "data"])

    summed = sum_vectors(docs.select("text").mapInArrow(train, "part long, slice int, data binary")).collect()  # one network
    found = {r["slice"]: np.frombuffer(r["data"], "<f8") for r in summed}
    if not found:
        return flat
    return (np.concatenate([found[i] for i in range(SLICES)]) / found[-1][0]).astype(np.float32)


class Scorer:
    """Whole-document ln probabilities, STREAMS documents side by side."""

    def __init__(self, network: Network, end: int):
        self.network, self.end, self.table = network, end, network.inputs()

    def __call__(self, docs: list[np.ndarray]) -> np.ndarray:
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))  # long ones start first
        waiting = iter(order)
        out = np.zeros(len(docs))
        streams = min(STREAMS, len(docs))
        owner = np.full(streams, -1)
        at = np.zeros(streams, np.int64)
        h = np.zeros((streams, HIDDEN), np.float32)
        last = np.full(streams, self.end)
        while True:
            for k in np.flatnonzero(owner < 0):
                i = next(waiting, None)
                if i is None:
                    break
                owner[k], at[k], h[k], last[k] = i, 0, 0, self.end
            live = np.flatnonzero(owner >= 0)
            if not len(live):
                return out
            # a window in which streams may end and be taken over within: the next document starts inside it
            ids = np.full((WINDOW, len(live)), -1, np.int64)
            whose = np.full((WINDOW, len(live)), -1, np.int64)
            fresh = np.zeros((WINDOW, len(live)), bool)
            for j, k in enumerate(live):
                filled = 0
                while filled < WINDOW:
                    if owner[k] < 0:
                        i = next(waiting, None)
                        if i is None:
                            break
                        owner[k], at[k] = i, 0
                        fresh[filled, j] = True
                    doc = docs[owner[k]]
                    n = min(WINDOW - filled, len(doc) - at[k])
                    ids[filled : filled + n, j] = doc[at[k] : at[k] + n]
                    whose[filled : filled + n, j] = owner[k]
                    at[k] += n
                    filled += n
                    if at[k] == len(doc):
                        owner[k] = -1
            previous = np.concatenate([last[live][None, :], ids[:-1]])
            previous[fresh] = self.end
            states = np.empty((WINDOW, len(live), HIDDEN), np.float32)
            state = h[live]
            for t in range(WINDOW):
                if fresh[t].any():
                    state = state * ~fresh[t][:, None]
                state = states[t] = self.network.step(self.table[previous[t]], state)[0]
            h[live], last[live] = state, ids[-1]
            real = np.flatnonzero(whose.reshape(-1) >= 0)
            logp, _ = self.network.output(states.reshape(-1, HIDDEN)[real], ids.reshape(-1)[real])
            out += np.bincount(whose.reshape(-1)[real], logp, len(docs))


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """The most frequent words (SHARED_WORDS, a fixed number), and sums over all."""
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(SHARED_WORDS).collect()
    looks = counts.where(F.col("word") != "").groupBy(look_sql(F.col("word")).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    end = counts.where(F.col("word") == "").collect()
    found = {r["word"].encode(): r["c"] for r in [*top, *end]}
    return Vocabulary(list(found.items()), total or 0, distinct, {r["k"]: (r["n"], r["v"]) for r in looks})


def train(docs: DataFrame, words: Vocabulary) -> np.ndarray:
    """Weights after a round over one document in WARM_UP and a round over the others."""
    flat = Network(None, words.frequency).flat
    early = F.pmod(F.xxhash64("doc_id"), F.lit(WARM_UP)) == 0
    for part in (docs.where(early), docs.where(~early)):
        flat = train_round(part, words, flat)
    return flat


SCORED = "doc_id long, part int, row long, n_tokens long, n_shared long, log_shared double, log_model double, rare array<struct<word:string,n:int>>"


def score(docs: DataFrame, counts: DataFrame, words: Vocabulary, flat: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``; a null text is an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast((words, flat))
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, weights = sent.value
        scorer, token_ids = Scorer(Network(weights), vocabulary.ids[END]), TokenIds(vocabulary)
        counted = vocabulary.counts
        logs = {w: float(np.log10(c + 0.5)) for w, c in counted.items()}
        under = np.log10(vocabulary.look_denominators()).tolist()
        inside, part, row = vocabulary.ids, TaskContext.get().partitionId(), 0
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))]
        names = ["doc_id", "part", "row", "n_tokens", "n_shared", "log_shared", "log_model", "rare"]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                cols: list[list] = [[] for _ in names]
                ids, own = [], []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                    tokens = words_of(text.as_py())
                    ids.append(token_ids(tokens))
                    known, log_known, outside, rare = 0, 0.0, 0.0, []
                    tokens.append(END)
                    for w, n in Counter(tokens).items():
                        c = counted.get(w)
                        if c is None:
                            rare.append({"word": w.decode(), "n": n})
                        else:
                            log_known += n * logs[w]
                            if c:
                                known += n
                        if w not in inside:
                            outside += n * ((0.0 if c is None else logs[w]) - under[look(w)])
                    own.append(outside)
                    for col, v in zip(cols, (doc_id, part, row, len(tokens), known, log_known, None, rare), strict=True):
                        col.append(v)
                    row += 1
                cols[6] = (scorer(ids) / np.log(10) + np.array(own)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    # written once, so that a row keeps its number
    scored = materialise(docs.select("doc_id", "text").mapInArrow(run, SCORED), "gru-scores")
    rare = scored.select("part", "row", F.explode("rare").alias("r")).select("part", "row", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    rare = rare.join(counts, "word", "left").groupBy("part", "row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_rare"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_rare")
    )
    rows = scored.drop("rare").join(rare, ["part", "row"], "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    base = F.col("log_shared") + log_rare - F.col("n_tokens") * F.lit(float(np.log10(words.base_denominator())))
    return rows.select(
        "doc_id", "n_tokens", (F.col("n_shared") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("log_model") + log_rare).alias("score"),
    )


def judge(docs: DataFrame) -> DataFrame:
    """Train on the documents outside the held-out fold and score all; a row without an id trains and is not held out."""
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    training = docs.select("doc_id", "text").where(~held_out)
    counts = materialise(word_counts(training), "gru-counts")
    words = vocabulary_of(counts)
    flat = train(training, words)
    return score(docs, counts, words, flat).withColumn("held_out", held_out)


def op8_gru_scores(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
