"""Masked pseudo-likelihood of documents from a bidirectional window network.

Every token is predicted from the ``SIDE`` tokens on each side, itself hidden; a
document's score is the sum of the conditional log-probabilities of all its tokens.
Tokens are lower-case words. The network gives the probability of a token's class,
in two levels: its group of classes, then the class within the group. The exact
counts of the whole corpus give the word's share of its class, so that different
words of one class keep their own probabilities.

The counts of all words are a Spark table that grows with the corpus. The ``KNOWN``
commonest words have a rank that tasks hold (a broadcast of bounded size): the
``SINGLE`` first are classes of their own, the others form bands of like frequency
and about equal mass. All further words are one class, and their counts meet the
documents in a join; none of them is frequent, so no key of it is hot. Words of
more than ``LONGEST`` characters are named by a 128-bit digest.

Training passes over every position of every document: each task fits the network
to its rows, from common first weights, and the weights are averaged by the
positions seen. The ``INPUTS`` - 1 commonest words are told apart as neighbours.
Scores depend on how the files are split into tasks, as the averaged weights do;
they are rounded to six digits.

``n_alone`` counts the tokens whose word stands in no other row: of a document that
occurs twice there are none.

A null text counts as empty and scores 0 over 0 tokens. Rows repeated as a whole
are scored alike. Texts are scored whole. Key columns may be null and repeat.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_batches, text_or_empty, written

KNOWN = 1 << 16
SINGLE, GROUPS, EACH = 128, 8, 32
CLASSES = GROUPS * EACH
INPUTS, HIDDEN = 4096, 16
SIDE = 2
BATCH, RATE = 4096, 0.1
CHUNK = 4096
COUNTED_WORDS = 400_000
AT_ONCE = 1 << 14
LONGEST = 64
WORD = re.compile(r"\w+")
MARKS = string.punctuation.replace("_", "")  # none is part of a word
SLOTS = tuple(d for d in range(-SIDE, SIDE + 1) if d)
STARTS = (np.arange(len(SLOTS)) * (INPUTS + 1)).astype(np.uint16)  # of the slots' parts of the table
FAR = 40  # logits end there


def words_of(text: str) -> list[str]:
    """The matches of ``WORD`` in the lower-case text; only parts with unusual marks need the expression itself."""
    text = text.lower()
    for mark in MARKS:
        text = text.replace(mark, " ")
    parts = text.split()
    if "".join(parts).isalnum():
        return parts
    return [w for part in parts for w in ((part,) if part.isalnum() else WORD.findall(part))]


def named(words: list[str]) -> list[str]:
    """The words as tables hold them; no word holds a blank, so digests are told from words."""
    return [w if len(w) <= LONGEST else " " + hashlib.blake2b(w.encode(), digest_size=16).hexdigest() for w in words]


def ranks_of(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Places in the order of frequency; words that are not known share the one behind the last."""
    return np.fromiter(map(known.get, words, repeat(len(known))), np.int64, len(words))


def contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, the table rows of their neighbours: tokens x slots); row INPUTS of a slot marks a text's ends."""
    edge = np.full(SIDE, -1, np.int64)
    joined = np.concatenate([x for t in texts for x in (t, edge)] or [edge])
    padded = np.concatenate([edge, joined, edge])
    rows = np.where(padded >= 0, np.minimum(padded, INPUTS - 1), INPUTS).astype(np.uint16)
    at = np.flatnonzero(joined >= 0)
    return joined[at], np.stack([rows[at + SIDE + d] for d in SLOTS], axis=1) + STARTS


# --- what the counts give -------------------------------------------------------


class Statistics:
    """Of the known words and the class of all others: counts, classes, log-probabilities within the class and alone."""

    def __init__(self, words: list[str], counts: np.ndarray, total: int) -> None:
        self.known = {w: i for i, w in enumerate(words)}
        self.counts, self.total = counts.astype(np.int64), max(int(total), 1)
        n = len(words)
        self.classes = np.full(n + 1, CLASSES - 1)
        self.classes[:n][:SINGLE] = np.arange(min(n, SINGLE))
        if n > SINGLE:
            mass = np.cumsum(counts[SINGLE:]) / counts[SINGLE:].sum()
            bands = CLASSES - 1 - SINGLE
            self.classes[SINGLE:n] = SINGLE + np.minimum((mass * bands).astype(int), bands - 1)
        self.others = max(int(total) - int(self.counts.sum()), 0)
        mass = np.bincount(self.classes, weights=np.append(self.counts, self.others), minlength=CLASSES)
        # What the counts of further words add is joined later.
        self.within = np.append(np.log(self.counts / mass[self.classes[:n]]), 0.0)
        self.alone = np.append(np.log(self.counts / self.total), 0.0)
        self.prior = np.log((mass + 1) / (mass + 1).sum()).reshape(GROUPS, EACH)


# --- the network ----------------------------------------------------------------


def first_weights(prior: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, by: float) -> np.ndarray:
        return (rng.standard_normal(shape) * by).astype(np.float32)

    groups = np.log(np.exp(prior).sum(axis=1))
    return {
        "near": normal(len(SLOTS) * (INPUTS + 1), HIDDEN, by=0.2),
        "near_bias": np.zeros(HIDDEN, np.float32),
        "group": normal(HIDDEN, GROUPS, by=0.1),
        "group_bias": groups.astype(np.float32),
        "class": normal(GROUPS, HIDDEN, EACH, by=0.1),
        "class_bias": (prior - groups[:, None]).astype(np.float32),
    }


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _hidden(p: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    total = np.take(p["near"], rows[:, 0], axis=0)
    for slot in range(1, len(SLOTS)):
        total += np.take(p["near"], rows[:, slot], axis=0)
    total += p["near_bias"]
    return np.tanh(total, out=total)


def _softmax(logits: np.ndarray) -> np.ndarray:
    np.exp(np.clip(logits, -FAR, FAR, out=logits), out=logits)
    logits /= (logits @ np.ones(logits.shape[1], logits.dtype))[:, None]
    return logits


def _by_group(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their group, and where each group begins."""
    groups = (classes // EACH).astype(np.uint8)
    return np.argsort(groups, kind="stable"), np.searchsorted(np.sort(groups), np.arange(GROUPS + 1))


def class_log_probs(p: dict[str, np.ndarray], near: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    order, starts = _by_group(wanted)
    classes = wanted[order]
    h = _hidden(p, np.take(near, order, axis=0))
    found = _softmax(h @ p["group"] + p["group_bias"])[np.arange(len(order)), classes // EACH]
    for g in range(GROUPS):
        a, b = starts[g], starts[g + 1]
        if a < b:
            shares = _softmax(h[a:b] @ p["class"][g] + p["class_bias"][g])
            found[a:b] *= shares[np.arange(b - a), classes[a:b] % EACH]
    out = np.empty(len(order))
    out[order] = np.log(np.maximum(found, np.float32(1e-30)))
    return out


class Trainer:
    """Adagrad over batches of positions."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p = {k: v.copy() for k, v in p.items()}
        self.v = {k: np.full_like(v, 1e-4) for k, v in p.items()}
        self.seen = 0

    def step(self, near: np.ndarray, wanted: np.ndarray) -> None:
        p, n = self.p, len(near)
        order, starts = _by_group(wanted)
        classes, rows = wanted[order], np.take(near, order, axis=0)
        h = _hidden(p, rows)
        d = _softmax(h @ p["group"] + p["group_bias"])
        d[np.arange(n), classes // EACH] -= 1
        d_h = d @ p["group"].T
        g = {"group": h.T @ d, "group_bias": d.sum(axis=0), "class": np.zeros_like(p["class"]), "class_bias": np.zeros_like(p["class_bias"])}
        for k in range(GROUPS):
            a, b = starts[k], starts[k + 1]
            if a < b:
                d = _softmax(h[a:b] @ p["class"][k] + p["class_bias"][k])
                d[np.arange(b - a), classes[a:b] % EACH] -= 1
                g["class"][k], g["class_bias"][k] = h[a:b].T @ d, d.sum(axis=0)
                d_h[a:b] += d @ p["class"][k].T
        d_h *= 1 - h * h
        g["near_bias"] = d_h.sum(axis=0)
        for name, value in g.items():
            self._adagrad(name, slice(None), value)
        flat_rows = rows.ravel()
        by = np.argsort(flat_rows, kind="stable")
        held = flat_rows[by]
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        self._adagrad("near", held[first], np.add.reduceat(np.take(d_h, by // len(SLOTS), axis=0), first, axis=0))
        self.seen += n

    def _adagrad(self, name: str, at: np.ndarray | slice, grad: np.ndarray) -> None:
        p, v = self.p[name], self.v[name]
        some = isinstance(at, np.ndarray)
        squares = grad * grad
        squares += np.take(v, at, axis=0) if some else v[at]
        v[at] = squares
        grad = np.float32(RATE) * grad
        grad /= np.sqrt(squares, out=squares)
        p[at] = np.subtract(np.take(p, at, axis=0) if some else p[at], grad, out=grad)


# --- tables ---------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, written in the shared folder; tasks add up before anything is shuffled."""

    def made(counter: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(named(list(counter)), pa.string()), pa.array(list(counter.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for batch in batches:
            for text in batch["_text"]:
                counter.update(words_of(text.as_py()))
                if len(counter) >= COUNTED_WORDS:
                    yield made(counter)
                    counter = Counter()
        if counter:
            yield made(counter)

    rows = map_batches(docs.select(text_or_empty().alias("_text")), count, "word string, n long")
    return written(rows.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def statistics_of(counts: DataFrame, known: int = KNOWN) -> Statistics:
    """At most ``known`` words of at most ``LONGEST`` characters reach the driver."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.orderBy(F.col("n").desc(), "word").limit(known).toPandas()
    return Statistics(rows["word"].tolist(), rows["n"].to_numpy(np.int64), total)


def fit(docs: DataFrame, statistics: Statistics) -> dict[str, np.ndarray]:
    """Weights averaged over the tasks that each train on their share of the documents."""
    first = first_weights(statistics.prior)
    size = flat(first).size
    shared = docs.sparkSession.sparkContext.broadcast((first, statistics.known, statistics.classes))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, known, classes = shared.value
        trainer = Trainer(start)
        near, wanted, held = [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                ranks, around = contexts([ranks_of(words_of(t.as_py()), known) for t in batch["_text"].slice(i, 64)])
                near.append(around)
                wanted.append(classes[ranks])
                held += len(ranks)
                if held >= 32 * BATCH:
                    _learn(trainer, np.concatenate(near), np.concatenate(wanted))
                    near, wanted, held = [], [], 0
        if held:
            _learn(trainer, np.concatenate(near), np.concatenate(wanted))
        if trainer.seen:
            part, values = TaskContext.get().partitionId(), flat(trainer.p)
            chunks = [values[i : i + CHUNK].tobytes() for i in range(0, size, CHUNK)]
            n = len(chunks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, trainer.seen)), pa.array(chunks)],
                ["chunk", "part", "n", "weights"],
            )

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n, total = None, 0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([(total / n).tobytes()])], ["chunk", "mean"])

        for batch in batches:
            for row in batch.to_pylist():
                values = np.frombuffer(row["weights"], np.float32).astype(np.float64) * row["n"]
                if row["chunk"] != chunk:
                    if chunk is not None:
                        yield done()
                    chunk, n, total = row["chunk"], 0, np.zeros(len(values))
                n, total = n + row["n"], total + values
        if chunk is not None:
            yield done()

    parts = map_batches(docs.select(text_or_empty().alias("_text")), local, "chunk int, part int, n long, weights binary")
    ordered = parts.repartition("chunk").sortWithinPartitions("chunk", "part")
    means = {r["chunk"]: np.frombuffer(r["mean"]) for r in map_batches(ordered, averaged, "chunk int, mean binary").collect()}
    return shaped(np.concatenate([means[c] for c in sorted(means)]), first) if means else first


def _learn(trainer: Trainer, near: np.ndarray, wanted: np.ndarray) -> None:
    order = np.random.default_rng(len(wanted)).permutation(len(wanted))
    for i in range(0, len(order), BATCH):
        some = order[i : i + BATCH]
        trainer.step(np.take(near, some, axis=0), np.take(wanted, some))


def known_sums(docs: DataFrame, weights: dict[str, np.ndarray], statistics: Statistics, keys: dict[str, Column]) -> DataFrame:
    """Per row the key columns, a number ``_row``, ``n_tokens``, what known words give, and ``_rest``: the other words with their number."""
    names = list(keys)
    rows = docs.select(*[c.alias(n) for n, c in keys.items()], text_or_empty().alias("_text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast((weights, statistics))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, stats = shared.value
        n_known, number = len(stats.known), TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                words = [words_of(t.as_py()) for t in part["_text"]]
                texts = [ranks_of(w, stats.known) for w in words]
                ranks, near = contexts(texts)
                wanted, logs = stats.classes[ranks], np.empty(len(ranks))
                for i in range(0, len(ranks), AT_ONCE):
                    logs[i : i + AT_ONCE] = class_log_probs(p, near[i : i + AT_ONCE], wanted[i : i + AT_ONCE])
                m = len(texts)
                n = np.array([len(t) for t in texts], np.int64)
                doc = np.repeat(np.arange(m), n)
                sums = [np.bincount(doc, weights=x, minlength=m) for x in (logs + stats.within[ranks], stats.alone[ranks])]
                # A word that is commoner than the longest of these texts stands elsewhere, too.
                few = (ranks < n_known) & (np.append(stats.counts, 0)[ranks] <= n.max(initial=0))
                pairs, times = np.unique((doc * (n_known + 1) + ranks)[few], return_counts=True)
                whole = times == stats.counts[pairs % (n_known + 1)]
                alone = np.bincount(pairs[whole] // (n_known + 1), weights=times[whole], minlength=m).astype(np.int64)
                rest = [Counter(w[i] for i in np.flatnonzero(r == n_known).tolist()) for w, r in zip(words, texts, strict=True)]
                ends = np.cumsum([0, *map(len, rest)], dtype=np.int32)
                others, of = named([w for x in rest for w in x]), [c for x in rest for c in x.values()]
                held = pa.StructArray.from_arrays([pa.array(others, pa.string()), pa.array(of, pa.int64())], ["word", "n"])
                arrays = [np.arange(number, number + m), n, *sums, alone]
                number += m
                yield pa.RecordBatch.from_arrays(
                    [*[part[c] for c in names], *map(pa.array, arrays), pa.ListArray.from_arrays(pa.array(ends), held)],
                    [*names, "_row", "n_tokens", "_log_prob", "_unigram", "_alone", "_rest"],
                )

    return map_batches(
        rows, score, f"{kept}_row long, n_tokens long, _log_prob double, _unigram double, _alone long, _rest array<struct<word:string,n:bigint>>"
    )


def pseudo_likelihood(docs: DataFrame, keys: dict[str, Column], known: int = KNOWN) -> DataFrame:
    """The key columns, n_tokens, log_prob (sum over all tokens), mean_log_prob, unigram_log_prob and n_alone of every row.

    Counts, trains and scores in three passes over ``docs``. Names of key columns may not begin with an underscore.
    """
    counts = word_counts(docs)
    statistics = statistics_of(counts, known)
    base = written(known_sums(docs, fit(docs, statistics), statistics, keys), "known-sums")
    rest = base.select("_row", F.explode("_rest").alias("x")).select("_row", "x.word", F.col("x.n").alias("times")).join(counts, "word")
    more = rest.groupBy("_row").agg(
        F.sum("times").alias("_times"), F.sum(F.col("times") * F.log("n")).alias("_logs"), F.sum(F.when(F.col("times") == F.col("n"), F.col("times"))).alias("_whole")
    )

    def joined(known_part: str, of: int) -> Column:
        further = F.col("_logs") - F.col("_times") * F.lit(float(np.log(max(of, 1))))
        return F.col(known_part) + F.coalesce(further, F.lit(0.0))

    total = joined("_log_prob", statistics.others)
    return base.join(more, "_row", "left").select(
        *keys,
        "n_tokens",
        F.round(total, 6).alias("log_prob"),
        F.round(total / F.greatest("n_tokens", F.lit(1)), 6).alias("mean_log_prob"),
        F.round(joined("_unigram", statistics.total), 6).alias("unigram_log_prob"),
        (F.col("_alone") + F.coalesce("_whole", F.lit(0))).alias("n_alone"),
    )
