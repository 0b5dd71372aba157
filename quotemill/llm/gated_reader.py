"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as two vectors: the mean of its letter n-grams' vectors (hashed, so unknown and disguised words are read
too) and a vector of the word itself if the vocabulary has it. Two gated recurrent layers read a window of ``WINDOW`` words
in both directions; attention weighs their states, and a logistic unit scores the pooled state. A document is read in all
overlapping windows, to its end; its score is that of its worst window.

Training needs windows, labels are of documents. First those windows of a toxic document count as toxic that hold a word whose
letter n-grams stand in toxic documents more than clean windows' words do; after each pass, those that the network finds
toxic; and always the worst one. Windows of clean documents are clean; half of those learned from are the ones the network
rates highest. Gradients are written out by hand and tested against finite differences.

Scoring projects each distinct word once through the input weights; a window is then a gather and one small product per
word. Remembered projections and windows in work are bounded per worker, whatever the texts.

Defined cases: null, empty and wordless texts score 0. With no toxic or no clean labelled row to learn from, everything
scores 0. Runs of more than ``LONGEST`` letters are read in pieces. A null doc_id is held out of nothing and never learned
from; a doc_id with several labels counts as toxic if one says so, null labels say nothing; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .tasks import map_rows, texts

WINDOW = 32
STRIDE = 24
LONGEST = 48
GRAMS = 8192
GRAM_SIZES = (3, 4)
LETTERS = 16  # size of a letter n-gram's vector
WORDS = 8  # size of a word's vector
HIDDEN = 8
ATTENTION = 8
VOCABULARY = 2000
# labelled documents that the network learns from, and their longest text: bounds of the driver's work
TOXIC_ROWS = 2000
CLEAN_ROWS = 4000
SAMPLE_CHARS = 8000
PASSES = 4
STEPS = 150  # updates in a pass at least
TOGETHER = 96  # windows in an update
REMEMBERED = 200_000  # words whose projections a worker keeps
AT_ONCE = 2048  # windows in work

WORD = re.compile(rf"\w{{1,{LONGEST}}}")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def starts_of(n: int) -> range | list[int]:
    """First words of the overlapping windows of a text of n words; the last window ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


def gram_numbers(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter n-grams of all words in one array, and where each word's begin. A word is framed by U+0002, U+0003."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    numbers, owners = [], []
    for size in GRAM_SIZES:
        n = len(points) - size + 1
        if n <= 0:
            continue
        code = np.full(n, size, np.uint64)
        for i in range(size):
            code = (code * np.uint64(0x9E3779B97F4A7C15) + points[i : i + n]) & np.uint64(0xFFFFFFFFFFFF)
        inside = word[:n] == word[size - 1 :]
        numbers.append((((code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(GRAMS))[inside].astype(np.int64))
        owners.append(word[:n][inside])
    every, owner = np.concatenate(numbers), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return every[order], np.searchsorted(owner[order], np.arange(len(words)))


def scattered(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sum of ``rows`` per number in ``at``, for numbers below ``size``."""
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    out[ordered[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters by name, float32. ``words`` numbers the vocabulary from 1; 0 is every other word."""

    def __init__(self, words: dict[str, int], seed: int = 5):
        rng = np.random.default_rng(seed)
        width = LETTERS + WORDS

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.words, self.kind = words, np.float32
        self.p = {
            "grams": normal(GRAMS, LETTERS, scale=0.5), "vocab": normal(len(words) + 1, WORDS, scale=0.1),
            "bias": np.zeros((2, 3 * HIDDEN), np.float32), "out": normal(2 * HIDDEN, scale=0.3), "out_b": np.zeros(1, np.float32),
            "in": normal(2, width, 3 * HIDDEN, scale=width**-0.5), "rec": normal(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            "att": normal(2 * HIDDEN, ATTENTION, scale=0.3), "att_v": normal(ATTENTION, scale=0.3),
        }
        self.p["vocab"][0] = 0

    def word_inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """One row per word: letters' mean, word's vector."""
        grams, first = gram_numbers(words)
        counts = np.diff(np.append(first, len(grams)))
        letters = np.add.reduceat(self.p["grams"][grams], first, axis=0) / counts[:, None]
        known = np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))
        return np.hstack((letters, self.p["vocab"][known])).astype(self.kind), (grams, counts, known)

    def projections(self, inputs: np.ndarray) -> np.ndarray:
        """(2 directions, words, 3 gates x hidden)."""
        return np.stack([inputs @ self.p["in"][d] + self.p["bias"][d] for d in (0, 1)]).astype(self.kind)

    def read(self, table: np.ndarray, windows: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows of word numbers (rows of ``table``); positions from a window's length on are padding."""
        b, t_max = windows.shape
        padded = lengths.min(initial=t_max) < t_max
        columns = np.ascontiguousarray(windows.T)
        states = np.zeros((t_max, b, 2 * HIDDEN), self.kind)
        steps: list[list] = [[None] * t_max, [None] * t_max]
        for d, order in ((0, range(t_max)), (1, range(t_max - 1, -1, -1))):
            h = np.zeros((b, HIDDEN), self.kind)
            u, half = self.p["rec"][d], table[d]
            for t in order:
                x = half.take(columns[t], axis=0)
                a = h @ u
                zr = sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
                new = n + z * (h - n)
                if padded:
                    new = np.where((t < lengths)[:, None], new, h)
                if keep:
                    steps[d][t] = (h, a, z, r, n)
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h = new
        hidden = np.tanh(states @ self.p["att"])
        e = hidden @ self.p["att_v"]
        if padded:
            e = np.where(np.arange(t_max)[:, None] < lengths, e, self.kind(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, states)
        logits = pooled @ self.p["out"] + self.p["out_b"][0]
        return (logits, (steps, states, hidden, w, pooled, padded)) if keep else logits

    def gradients(self, words: list[str], windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean logistic loss of the windows and its gradient by every parameter."""
        p = self.p
        inputs, (grams, counts, known) = self.word_inputs(words)
        table = self.projections(inputs)
        logits, (steps, states, hidden, w, pooled, padded) = self.read(table, windows, lengths, keep=True)
        b, t_max = windows.shape
        loss = float(np.mean(np.logaddexp(0, logits) - labels * logits))
        d_logit = ((sigmoid(logits) - labels) / b).astype(self.kind)
        g = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = w[:, :, None] * d_pooled
        d_w = np.einsum("bh,tbh->tb", d_pooled, states)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        g["att_v"] = np.einsum("tb,tba->a", d_e, hidden)
        d_hidden = d_e[:, :, None] * p["att_v"] * (1 - hidden**2)
        g["att"] = np.einsum("tbh,tba->ha", states, d_hidden)
        d_states = d_states + d_hidden @ p["att"].T
        d_steps: list[list] = [[None] * t_max, [None] * t_max]
        g["rec"] = np.zeros_like(p["rec"])
        for d, order in ((0, range(t_max - 1, -1, -1)), (1, range(t_max))):
            carried = np.zeros((b, HIDDEN), self.kind)
            for t in order:
                dh = d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN] + carried
                h, a, z, r, n = steps[d][t]
                skipped = 0
                if padded:
                    on = (t < lengths)[:, None]
                    # attention never weighs padding, so nothing but the carried state passes through it
                    dh, skipped = np.where(on, dh, 0), np.where(on, 0, dh)
                dz = dh * (h - n) * z * (1 - z)
                dn = dh * (1 - z) * (1 - n * n)
                an = a[:, 2 * HIDDEN :]
                dr = dn * an * r * (1 - r)
                da = np.hstack((dz, dr, dn * r))
                d_steps[d][t] = np.hstack((dz, dr, dn))
                g["rec"][d] += h.T @ da
                carried = dh * z + da @ p["rec"][d].T + skipped
        at = windows.T.ravel()
        d_table = np.stack([scattered(np.concatenate(d), at, len(words)) for d in d_steps])
        g["in"] = np.stack([inputs.T @ half for half in d_table])
        g["bias"] = d_table.sum(axis=1)
        d_inputs = sum(half @ p["in"][d].T for d, half in enumerate(d_table))
        g["grams"] = scattered(np.repeat(d_inputs[:, :LETTERS] / counts[:, None], counts, axis=0), grams, GRAMS)
        g["vocab"] = scattered(d_inputs[:, LETTERS:], known, len(p["vocab"]))
        g["vocab"][0] = 0  # words outside the vocabulary are known by their letters only
        return loss, g


class Reader:
    """Scores texts; remembers projections of words."""

    def __init__(self, network: Network):
        self.network = network
        self.number: dict[str, int] = {}
        self.table = np.zeros((2, 1024, 3 * HIDDEN), np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        new = list(set(words) - self.number.keys())
        if new:
            if len(self.number) + len(new) > REMEMBERED:
                self.number, new = {}, list(set(words))
            used = len(self.number)
            size = self.table.shape[1]
            if used + len(new) > size:
                grown = np.zeros((2, max(2 * size, used + len(new)), 3 * HIDDEN), np.float32)
                grown[:, :used] = self.table[:, :used]
                self.table = grown
            for start in range(0, len(new), 8192):
                some = new[start : start + 8192]
                inputs, _ = self.network.word_inputs(some)
                self.table[:, used + start : used + start + len(some)] = self.network.projections(inputs)
            self.number.update(zip(new, range(used, used + len(new)), strict=True))
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def logits(self, texts: list[str]) -> list[np.ndarray]:
        """Of all windows of every text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        rows: list[tuple[list[str], list[int]]] = []
        owners: list[int] = []
        waiting = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            starts = starts_of(len(words))
            # pieces of whole windows, so that the work on a very long text is bounded too
            for first in range(0, len(starts), AT_ONCE):
                some = starts[first : first + AT_ONCE]
                rows.append((words[some[0] : some[-1] + WINDOW], [s - some[0] for s in some]))
                owners.append(i)
                waiting += len(some)
                if waiting >= AT_ONCE:
                    self._flush(rows, owners, out)
                    rows, owners, waiting = [], [], 0
        self._flush(rows, owners, out)
        return [np.concatenate(o) if o else np.zeros(0, np.float32) for o in out]

    def _flush(self, rows: list, owners: list[int], out: list[list[np.ndarray]]) -> None:
        if not rows:
            return
        numbers = self._numbers([w for words, _ in rows for w in words])
        at, firsts, lengths, sizes = 0, [], [], []
        for words, starts in rows:
            firsts.extend(at + s for s in starts)
            lengths.extend([min(WINDOW, len(words))] * len(starts))
            sizes.append(len(starts))
            at += len(words)
        firsts, lengths = np.array(firsts), np.array(lengths)
        found = np.empty(len(firsts), np.float32)
        numbers = np.append(numbers, np.zeros(WINDOW, np.int32))
        # whole windows need no masks, so they are read apart from short ones
        for group in (np.flatnonzero(lengths == WINDOW), np.flatnonzero(lengths < WINDOW)):
            for start in range(0, len(group), AT_ONCE):
                some = group[start : start + AT_ONCE]
                widest = int(lengths[some].max())
                windows = numbers[firsts[some][:, None] + np.arange(widest)]
                found[some] = self.network.read(self.table, windows, lengths[some])
        at = 0
        for owner, size in zip(owners, sizes, strict=True):
            out[owner].append(found[at : at + size])
            at += size

    def scores(self, texts: list[str]) -> list[float]:
        return [float(sigmoid(x.max().astype(np.float64))) if len(x) else 0.0 for x in self.logits(texts)]


class Adam:
    def __init__(self, rate: float):
        self.rate, self.n, self.m, self.v = rate, 0, {}, {}

    def step(self, parameters: dict, gradients: dict) -> None:
        self.n += 1
        for name, g in gradients.items():
            m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
            v = self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * g * g
            scale = self.rate * np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)
            parameters[name] -= (scale * m / (np.sqrt(v) + 1e-7)).astype(np.float32)


def first_targets(rows: list[list[str]], owner: np.ndarray, windows: list[list[str]], toxic: np.ndarray) -> np.ndarray:
    """Windows of toxic documents that hold a word whose n-grams tell toxic documents from clean ones: by the log-odds of
    documents per n-gram, averaged over a word, above all but a hundredth of the clean windows."""
    labels = np.zeros(len(rows), bool)
    labels[owner] = toxic
    seen = np.zeros((2, GRAMS))
    for words, label in zip(rows, labels, strict=True):
        seen[int(label), np.unique(gram_numbers(sorted(set(words)))[0])] += 1
    odds = np.log((seen[1] + 0.5) / (labels.sum() + 1)) - np.log((seen[0] + 0.5) / ((~labels).sum() + 1))
    names = sorted({w for words in rows for w in words})
    grams, first = gram_numbers(names)
    value = dict(zip(names, (np.add.reduceat(odds[grams], first) / np.diff(np.append(first, len(grams)))).tolist(), strict=True))
    worst = np.array([max(value[w] for w in words) for words in windows])
    return toxic & (worst > np.quantile(worst[~toxic], 0.99))


def threshold(values: np.ndarray, toxic: np.ndarray) -> float:
    """The cut between two values that tells the classes apart with the fewest errors; of several, the widest gap's."""
    order = np.argsort(values, kind="stable")
    v, y = values[order].astype(float), toxic[order]
    errors = np.cumsum(y)[:-1] + np.cumsum(~y[::-1])[::-1][1:]
    gaps = np.diff(v)
    at = min(np.flatnonzero(gaps > 0), key=lambda i: (errors[i], -gaps[i]), default=None)
    return 0.0 if at is None else float((v[at] + v[at + 1]) / 2)


def train(rows: list[tuple[str, int]], passes: int = PASSES, seed: int = 3) -> Network | None:
    """A network for (text, toxic) rows; nothing if one of the classes is missing."""
    labelled = [(w, int(y)) for w, y in ((words_of(t), y) for t, y in rows) if w]
    if len({y for _, y in labelled}) < 2:
        return None
    in_texts = Counter(w for words, _ in labelled for w in set(words))
    common = sorted((w for w, n in in_texts.items() if n >= 5), key=lambda w: (-in_texts[w], w))[:VOCABULARY]
    network = Network({w: i + 1 for i, w in enumerate(common)}, seed)
    rng, adam = np.random.default_rng(seed), Adam(0.01)
    pieces = [(i, words[s : s + WINDOW]) for i, (words, _) in enumerate(labelled) for s in starts_of(len(words))]
    owner, windows = np.array([i for i, _ in pieces]), [w for _, w in pieces]
    toxic = np.array([labelled[i][1] for i in owner], bool)
    target = first_targets([w for w, _ in labelled], owner, windows, toxic)
    ranked = rng.random(len(windows))
    for turn in range(passes):
        on, off = np.flatnonzero(target), np.flatnonzero(~toxic)
        half = min(len(on), len(off))
        hardest = off[np.argsort(-ranked[off], kind="stable")]
        clean = np.concatenate((hardest[:half], rng.permutation(hardest[half:])[:half]))
        every = np.concatenate((on, clean))
        epochs = max(1, -(-STEPS * TOGETHER // max(len(every), 1)))
        chosen = np.concatenate([rng.permutation(every) for _ in range(epochs)])
        if turn == passes - 1:
            adam.rate = 0.003
        for start in range(0, len(chosen), TOGETHER):
            some = chosen[start : start + TOGETHER]
            names = sorted({w for i in some for w in windows[i]})
            number = {w: i for i, w in enumerate(names)}
            lengths = np.array([len(windows[i]) for i in some])
            numbers = np.zeros((len(some), WINDOW), np.int64)
            for row, i in zip(numbers, some, strict=True):
                row[: len(windows[i])] = [number[w] for w in windows[i]]
            _, gradients = network.gradients(names, numbers, lengths, target[some].astype(np.float32))
            adam.step(network.p, gradients)
        if turn < passes - 1:
            ranked = np.concatenate(Reader(network).logits([" ".join(words) for words, _ in labelled]))
            worst = np.full(len(labelled), -np.inf, np.float32)
            np.maximum.at(worst, owner, ranked)
            target = toxic & ((ranked > 0) | (ranked == worst[owner]))
    worst = np.array([x.max() for x in Reader(network).logits([" ".join(words) for words, _ in labelled])])
    network.p["out_b"] -= np.float32(threshold(worst, np.array([y for _, y in labelled], bool)))
    return network


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Network | None:
    """Learn from a bounded number of labelled documents of each class that are not held out."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(toxic_rows).unionByName(
        known.where("toxic = 0").orderBy(*order).limit(clean_rows)
    )
    chosen = texts(docs).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(sample), "doc_id")  # bounded by the sample
    # one row per document, in an order of its own, so that the same rows teach the same network
    rows = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy(*order).collect()
    return train([(r.text, r.toxic) for r in rows])


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def make():
        reader = Reader(network) if network else None

        def work(columns):
            found = reader.scores(columns["text"]) if reader else [0.0] * len(columns["text"])
            return {"doc_id": columns["doc_id"], "score": found}

        return work

    found = map_rows(texts(docs), "doc_id long, score double", make)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents scored by a network learned from the labelled ones that are not held out."""
    return score(docs, learn(docs, labels))
