"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of two inputs: a vector of its own, if enough training
texts hold it, and the vectors of its character n-grams (with its ends marked), so
that unseen forms of a word are known by their parts. Runs longer than ``PIECE``
characters, as of scripts without blanks, are read as overlapping pieces. A window of ``WINDOW`` words
is read in both directions by gated recurrent units; attention over the states
gives one vector and a logit. Windows start every ``STEP`` words, so that they
overlap, and cover the whole text; the document's logit is that of its worst
window, put on a probability scale fitted on the training documents.

Training is numpy in one task, on at most ``PER_CLASS`` labelled documents of
each class (those with the least hashes of their ids; the bound is the only
sample). First every window carries its document's label; then rounds train on
each document's worst windows. Labels are read from the rows given for training
only; ids, languages and sources are no inputs. The classes' true frequencies
enter as weights of the last fit.

A null text counts as empty; a text without words gets the score of an empty
window. Rows repeated as a whole are scored alike. With labels of one class only,
or none, every score is 0.
"""

from __future__ import annotations

import pickle
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_batches, text_or_empty
from newsloom.session import bound_batches

WINDOW, STEP = 24, 12
SIZE, HIDDEN = 16, 8
NGRAMS, BUCKETS = (3, 4, 5, 6), 1 << 15
PIECE, OVERLAP = 60, 12
LEAST_DOCS = 3
PER_CLASS = 1000
FIRST_WINDOWS = 12_000  # per class, in the first phase
ROUNDS = 5
THRESHOLD = 0.7
CACHED_WORDS = 100_000
WINDOWS_AT_ONCE, WORDS_AT_ONCE = 512, 4096  # what is made of them at once stays in a core's cache
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """The words of a text; a longer one than ``PIECE`` as overlapping pieces, each a word of its own."""
    found = WORD.findall(text.lower())
    if max(map(len, found), default=0) <= PIECE:
        return found
    return [w[i : i + PIECE] for w in found for i in range(0, max(1, len(w) - OVERLAP), PIECE - OVERLAP)]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ (table & 1) * np.uint32(0xEDB88320)
    return table


CRC = _crc_table()


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (by CRC-32) of all words' n-grams, by word, length and place, and the word of each."""
    marked = [f"^{w}$".encode() for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    text = np.frombuffer(b"".join(marked), np.uint8)
    crc, buckets = np.full(len(text), 0xFFFFFFFF, np.uint32), np.empty((len(NGRAMS), len(text)), np.int32)
    for k in range(max(NGRAMS)):
        byte = text[k:]  # of the n-grams that begin k bytes before
        crc = crc[: len(byte)]
        crc = CRC[(crc ^ byte) & 255] ^ (crc >> 8)
        if k + 1 in NGRAMS:
            buckets[NGRAMS.index(k + 1), : len(crc)] = ~crc % BUCKETS
    n = np.maximum(sizes[:, None] - np.array(NGRAMS) + 1, 0)
    first = np.cumsum(n).reshape(n.shape) - n
    at = (np.cumsum(sizes) - sizes)[:, None] + np.arange(len(NGRAMS)) * len(text) - first
    grams = buckets.ravel()[np.repeat(at.ravel(), n.ravel()) + np.arange(n.sum())]
    return grams, np.repeat(np.arange(len(words), dtype=np.int32), n.sum(axis=1))


def window_starts(n: int) -> range:
    """Starts of the windows over n words: every STEP words until one reaches the end."""
    return range(0, max(1, n - WINDOW + STEP), STEP)


# --- the network ----------------------------------------------------------------


@dataclass
class Net:
    vocabulary: dict[str, int]
    p: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the word table (0: unknown) and the n-grams as (buckets, word of each)."""
        rows = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        grams, of = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i in range(0, len(words), WORDS_AT_ONCE):
            found, word = ngrams(words[i : i + WORDS_AT_ONCE])
            grams.append(found)
            of.append(word + np.int32(i))
        return rows, np.concatenate(grams), np.concatenate(of)

    def vectors(self, rows: np.ndarray, grams: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.bincount(of, minlength=len(rows)).astype(np.float32)
        weight = 1.0 / np.sqrt(np.maximum(n, 1.0))
        x = self.p["word"][rows]
        if len(grams):
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            x[of[starts]] += np.add.reduceat(self.p["gram"][grams], starts, axis=0) * weight[of[starts], None]
        return x, weight

    def projected(self, words: list[str]) -> np.ndarray:
        """The words' inputs to the gates of both directions."""
        x, _ = self.vectors(*self.inputs(words))
        return np.concatenate([x @ self.p["in_f"] + self.p["bias_f"], x @ self.p["in_b"] + self.p["bias_b"]], axis=1)

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
        """Logits of windows from their gates' inputs (time x windows x 6 HIDDEN); with ``keep`` also the steps."""
        p, h3 = self.p, 3 * HIDDEN
        f, tape_f = _run(gates[:, :, :h3], mask, p["rec_f"], False, keep)
        b, tape_b = _run(gates[:, :, h3:], mask, p["rec_b"], True, keep)
        states = np.concatenate([f, b], axis=2)
        hidden = np.tanh(states @ p["att"] + p["att_bias"])
        energy = np.where(mask > 0, hidden @ p["att_v"], np.float32(-1e9))
        share = np.exp(energy - energy.max(axis=0)) * mask
        share /= np.maximum(share.sum(axis=0), np.float32(1e-9))
        pooled = np.einsum("tb,tbk->bk", share, states)
        logits = pooled @ p["out"] + p["out_bias"][0]
        return logits, (states, hidden, share, pooled, tape_f, tape_b) if keep else None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1.0))


def _run(gates: np.ndarray, mask: np.ndarray, rec: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
    steps, n, _ = gates.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    tape = []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        u = h @ rec
        zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        un = u[:, 2 * HIDDEN :]
        c = np.tanh(gates[t, :, 2 * HIDDEN :] + r * un)
        step = mask[t][:, None] * (1 - z)
        if keep:
            tape.append((t, h, z, r, un, c))
        h = h + step * (c - h)
        out[t] = h
    return out, tape


def _back(d_out: np.ndarray, mask: np.ndarray, rec: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of ``rec``, from those of the states."""
    d_gates = np.zeros((*d_out.shape[:2], 3 * HIDDEN), np.float32)
    d_rec = np.zeros_like(rec)
    d_h = np.zeros(d_out.shape[1:], np.float32)
    for t, h, z, r, un, c in reversed(tape):
        d_h = d_h + d_out[t]
        m = mask[t][:, None]
        d_c = d_h * m * (1 - z) * (1 - c * c)
        d_z = -d_h * m * (c - h) * z * (1 - z)
        d_r = d_c * un * r * (1 - r)
        g = d_gates[t]
        g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :] = d_z, d_r, d_c
        d_u = np.concatenate([d_z, d_r, d_c * r], axis=1)
        d_rec += h.T @ d_u
        d_h = d_h * (1 - m * (1 - z)) + d_u @ rec.T
    return d_gates, d_rec


# --- training -------------------------------------------------------------------


def new_net(texts: list[list[str]], seed: int) -> Net:
    held = Counter(w for t in texts for w in set(t))
    words = sorted(w for w, n in held.items() if n >= LEAST_DOCS)
    rng = np.random.default_rng(seed)

    def normal(*shape: int, by: float) -> np.ndarray:
        return (rng.standard_normal(shape) * by).astype(np.float32)

    p = {"word": normal(len(words) + 1, SIZE, by=0.05), "gram": normal(BUCKETS, SIZE, by=0.1)}
    p["word"][0] = 0
    for d in "fb":
        p[f"in_{d}"] = normal(SIZE, 3 * HIDDEN, by=0.4)
        p[f"bias_{d}"] = np.zeros(3 * HIDDEN, np.float32)
        p[f"rec_{d}"] = normal(HIDDEN, 3 * HIDDEN, by=0.3)
    p |= {"att": normal(2 * HIDDEN, HIDDEN, by=0.3), "att_bias": np.zeros(HIDDEN, np.float32), "att_v": normal(HIDDEN, by=0.3)}
    p |= {"out": normal(2 * HIDDEN, by=0.3), "out_bias": np.zeros(1, np.float32)}
    return Net({w: i + 1 for i, w in enumerate(words)}, p)


class Trainer:
    """Adam over windows given as rows of word numbers (-1: behind the end)."""

    def __init__(self, net: Net, words: list[str], rate: float = 0.01) -> None:
        self.net, self.rate, self.t = net, rate, 0
        self.rows, self.grams, self.of = net.inputs(words)
        self.begin = np.searchsorted(self.of, np.arange(len(words) + 1))
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def _words(self, windows: np.ndarray) -> tuple:
        """The distinct words of the windows, their n-grams, and the windows in their numbers."""
        used, at = np.unique(np.maximum(windows, 0), return_inverse=True)
        n = self.begin[used + 1] - self.begin[used]
        of = np.repeat(np.arange(len(used)), n)
        grams = self.grams[np.repeat(self.begin[used] - np.cumsum(n) + n, n) + np.arange(len(of))]
        return self.rows[used], grams, of, at.reshape(windows.shape)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """Of all windows; every word is projected once."""
        parts = []
        for i in range(0, len(self.rows), WORDS_AT_ONCE):
            begin = self.begin[i : i + WORDS_AT_ONCE + 1]
            inner = slice(begin[0], begin[-1])
            x, _ = self.net.vectors(self.rows[i : i + WORDS_AT_ONCE], self.grams[inner], self.of[inner] - i)
            p = self.net.p
            parts.append(np.concatenate([x @ p["in_f"] + p["bias_f"], x @ p["in_b"] + p["bias_b"]], axis=1))
        table, out = np.concatenate(parts), []
        for i in range(0, len(windows), WINDOWS_AT_ONCE):
            part = windows[i : i + WINDOWS_AT_ONCE].T
            out.append(self.net.forward(table[np.maximum(part, 0)], (part >= 0).astype(np.float32))[0])
        return np.concatenate(out)

    def _pass(self, windows: np.ndarray, keep: bool = False) -> tuple:
        p = self.net.p
        rows, grams, of, at = self._words(windows)
        x, weight = self.net.vectors(rows, grams, of)
        both = np.concatenate([x @ p["in_f"] + p["bias_f"], x @ p["in_b"] + p["bias_b"]], axis=1)
        mask = (windows.T >= 0).astype(np.float32)
        logits, tape = self.net.forward(both[at.T], mask, keep)
        return logits, (rows, grams, of, at, x, weight, mask, tape)

    def step(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        p, h3 = self.net.p, 3 * HIDDEN
        logits, (rows, grams, of, at, x, weight, mask, tape) = self._pass(windows, keep=True)
        states, hidden, share, pooled, tape_f, tape_b = tape
        d = ((_sigmoid(logits) - labels) * weights / weights.sum()).astype(np.float32)
        g = {"out": pooled.T @ d, "out_bias": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["out"]
        d_share = np.einsum("bk,tbk->tb", d_pooled, states)
        d_energy = share * (d_share - (share * d_share).sum(axis=0))
        d_hidden = d_energy[:, :, None] * p["att_v"] * (1 - hidden * hidden)
        g["att_v"] = np.einsum("tb,tbk->k", d_energy, hidden)
        flat = d_hidden.reshape(-1, HIDDEN)
        g["att"], g["att_bias"] = states.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
        d_states = share[:, :, None] * d_pooled + d_hidden @ p["att"].T
        d_f, g["rec_f"] = _back(d_states[:, :, :HIDDEN], mask, p["rec_f"], tape_f)
        d_b, g["rec_b"] = _back(d_states[:, :, HIDDEN:], mask, p["rec_b"], tape_b)
        d_gates = np.concatenate([d_f, d_b], axis=2) * mask[:, :, None]
        each, order = at.T.ravel(), np.argsort(at.T.ravel(), kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(each[order]) > 0])
        d_both = np.zeros((len(rows), 2 * h3), np.float32)
        d_both[each[order][starts]] = np.add.reduceat(d_gates.reshape(-1, 2 * h3)[order], starts, axis=0)
        g["in_f"], g["in_b"] = x.T @ d_both[:, :h3], x.T @ d_both[:, h3:]
        g["bias_f"], g["bias_b"] = d_both[:, :h3].sum(axis=0), d_both[:, h3:].sum(axis=0)
        d_x = d_both[:, :h3] @ p["in_f"].T + d_both[:, h3:] @ p["in_b"].T
        self.t += 1
        for name, at_rows, values in (
            ("word", rows, d_x * (rows > 0)[:, None]),
            ("gram", grams, (d_x * weight[:, None])[of]),
        ):
            self._sparse(name, at_rows, values)
        for name, value in g.items():
            self._adam(name, slice(None), value)

    def _sparse(self, name: str, rows: np.ndarray, values: np.ndarray) -> None:
        if not len(rows):
            return
        order = np.argsort(rows, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
        self._adam(name, rows[order][starts], np.add.reduceat(values[order], starts, axis=0))

    def _adam(self, name: str, at: np.ndarray | slice, grad: np.ndarray) -> None:
        m, v = self.m[name], self.v[name]
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        step = self.rate * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.99**self.t)) + 1e-6)
        self.net.p[name][at] -= step.astype(np.float32)


def windows_of(numbers: np.ndarray) -> np.ndarray:
    """Rows of WINDOW word numbers; -1 behind the end."""
    starts = np.array(window_starts(len(numbers)))
    padded = np.full(int(starts[-1]) + WINDOW, -1, np.int32)
    padded[: len(numbers)] = numbers
    return padded[starts[:, None] + np.arange(WINDOW)]


def train(texts: list[str], labels: list[int], rates: tuple[float, float] = (0.5, 0.5), seed: int = 7) -> Net | None:
    """A network from labelled texts; ``rates`` are the shares of labels 0 and 1 among all labelled rows."""
    y = np.array(labels, np.float32)
    if not (y == 1).any() or not (y == 0).any():
        return None
    tokens = [[sys.intern(w) for w in words_of(t)] for t in texts]  # one object per word
    net = new_net(tokens, seed)
    words = sorted({w for t in tokens for w in t}) or [""]
    number = {w: i for i, w in enumerate(words)}
    per_text = [windows_of(np.array([number[w] for w in t], np.int32)) for t in tokens]
    del tokens
    windows, doc = np.concatenate(per_text), np.repeat(np.arange(len(texts)), [len(w) for w in per_text])
    trainer, rng = Trainer(net, words), np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)

    def epoch(chosen: np.ndarray, weights: np.ndarray, size: int) -> None:
        order = rng.permutation(len(chosen))
        for i in range(0, len(order), size):
            some = chosen[order[i : i + size]]
            trainer.step(windows[some], y[doc[some]], weights[order[i : i + size]])

    first = np.concatenate([rng.permutation(np.flatnonzero(y[doc] == c))[:FIRST_WINDOWS] for c in (0, 1)])
    label = y[doc[first]]
    epoch(first, np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())).astype(np.float32), 256)
    for _ in range(ROUNDS):
        worst = _worst(trainer.logits(windows), doc, 2)
        for _ in range(2):
            epoch(worst, weight[doc[worst]], 256)
    top = np.maximum.reduceat(trainer.logits(windows), np.flatnonzero(np.r_[True, np.diff(doc) > 0]))
    prior = np.where(y == 1, rates[1] / y.mean(), rates[0] / (1 - y.mean()))
    net.scale = _fitted(top.astype(np.float64), y.astype(np.float64), prior)
    return net


def _worst(logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The n windows with the highest logits of each document."""
    order = np.lexsort((-logits, doc))
    place = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
    return order[place < n]


def _fitted(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope (kept positive) and shift of a logistic curve, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, d = weights * p * (1 - p), weights * (p - y)
        hess = np.array([[np.sum(w * x * x) + 0.5, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-3]])
        step = np.linalg.solve(hess, np.array([np.sum(d * x) + 0.5 * (a - 1), np.sum(d)]))
        a, b = a - float(np.clip(step[0], -0.5, 0.5)), b - float(np.clip(step[1], -1, 1))
        a = max(a, 0.05)
    return a, b


# --- scoring --------------------------------------------------------------------


class Scorer:
    """Scores texts; remembers the projections of the words it has met."""

    def __init__(self, net: Net) -> None:
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 6 * HIDDEN), np.float32)

    def _numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.number) > CACHED_WORDS:
            self._forget()
        number = self.number
        new = [w for w in set().union(*texts) if w not in number]
        if new:
            at = len(number)
            number.update(zip(new, range(at, at + len(new)), strict=True))
            if at + len(new) > len(self.table):
                grown = np.zeros((2 * (at + len(new)), 6 * HIDDEN), np.float32)
                grown[:at] = self.table[:at]
                self.table = grown
            for i in range(0, len(new), WORDS_AT_ONCE):
                part = new[i : i + WORDS_AT_ONCE]
                self.table[at + i : at + i + len(part)] = self.net.projected(part)
        return [np.fromiter(map(number.__getitem__, t), np.int32, len(t)) for t in texts]

    def scores(self, texts: list[str]) -> np.ndarray:
        per_text = [windows_of(n) for n in self._numbers([words_of(t) for t in texts])]
        starts = np.cumsum([0, *[len(w) for w in per_text[:-1]]])
        windows = np.concatenate(per_text)
        logits = np.empty(len(windows), np.float32)
        for i in range(0, len(windows), WINDOWS_AT_ONCE):
            part = windows[i : i + WINDOWS_AT_ONCE]
            mask = (part.T >= 0).astype(np.float32)
            logits[i : i + len(part)] = self.net.forward(self.table[np.maximum(part.T, 0)], mask)[0]
        a, b = self.net.scale
        return 1 / (1 + np.exp(-(a * np.maximum.reduceat(logits, starts).astype(np.float64) + b)))


# --- tables ---------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Net | None:
    """Trains on at most ``per_class`` labelled documents of each class, none of them held out."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [
        usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select(F.col("doc_id").alias("_of"), "toxic")
        for c in (0, 1)
    ]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class rows
    rows = (
        docs.join(few, F.col("doc_id") == F.col("_of"))
        .select("doc_id", text_or_empty().alias("text"), "toxic")
        .orderBy(F.xxhash64("doc_id"), "text")
        .limit(2 * per_class)
    )
    total = sum(counts.values()) or 1
    rates = (counts.get(0, 0) / total, counts.get(1, 0) / total)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch["text"].to_pylist()
            labels += batch["toxic"].to_pylist()
        net = train(texts, labels, rates) if texts else None
        if net is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)])], ["net"])

    # The limit leaves one partition. Of the task only the weights and the vocabulary return, so that
    # neither the texts nor what training needs is ever in the driver's memory.
    made = map_batches(rows.select("text", "toxic").coalesce(1), trained, "net binary").collect()
    return pickle.loads(made[0]["net"]) if made else None


def scored(docs: DataFrame, net: Net | None, keys: dict[str, Column], text: bool = False) -> DataFrame:
    """The key columns, with ``text`` also the text as ``_text``, and ``score`` of every row of ``docs``."""
    names = [*keys, "_text"] if text else list(keys)
    rows = docs.select(*[c.alias(n) for n, c in keys.items()], F.col("text").alias("_text"))
    if net is None:
        return rows.select(*names, F.lit(0.0).alias("score"))
    kept = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # its size is set by the parameters above

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                values = scorer.scores([t or "" for t in part["_text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part[n] for n in names], pa.array(values)], [*names, "score"])

    return map_batches(rows, score, f"{kept}, score double")


def predicted(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")


def clean_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Rows travel whole, each text once, through the scoring task, so nothing is joined back.
    """
    at = {c: "_text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = scored(docs, fit(docs, labels), {k: F.col(c) for c, k in at.items() if c != "text"}, text=True)
    return rows.where(predicted(F.col("score")) == 0).select(*[F.col(k).alias(c) for c, k in at.items()])
