"""Ranked lexical search with FP-trees of the documents.

Items (queries) name the terms that matter. A first pass over the documents keeps
of each its number of words and how often it holds each of these terms; that table
is small, written in the shared folder, and gives the corpus statistics.

Then each task reads its part of it in blocks of bounded size. A block's documents
are ordered by their terms, commonest first, so that they share the paths of a
trie; chains are one edge, and neighbours with little below them share a bucket of
at most ``BUCKET`` different vectors. Every subtree knows the largest tf of each of
its terms and its least m. The score rises with tf and falls with m, so these
bound what any document below can score. Per item the tree is searched depth
first, children with higher bounds first; a subtree goes unread if its bound is
below the worst of the best k so far. Those are carried on from block to block.

Documents with equal terms, counts and lengths score the same for every item, so
of each such group the k least ids are enough. Each task sends at most k rows per
item. Items are taken in groups of at most ``ITEM_TERMS`` term entries, which are
what is broadcast; each group is one pass.

Null texts have no terms; items without terms have no rows. Rows with a null id
come before others at equal scores. Every row of ``items`` is answered by itself,
repeated ones too, and repeated documents are documents of their own.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import map_batches, text_or_empty, written

K = 20
BUCKET = 48
BLOCK_DOCS, BLOCK_TERMS = 8192, 1 << 21
ITEM_TERMS = 1 << 20
PIECE = 1 << 20
# Fixed value: bytes of a term are digits, letters (lower-cased) and all from 0x80 on; others divide.
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """How often each term stands in a text; long texts are read in pieces that end between terms."""
    folded = text.translate(_FOLD)
    if len(folded) <= PIECE:
        return Counter(folded.split())
    counts: Counter = Counter()
    start = 0
    while start < len(folded):
        stop = folded.find(b" ", start + PIECE)
        stop = len(folded) if stop < 0 else stop
        counts.update(folded[start:stop].split())
        start = stop
    return counts


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 75 + (25 * n * n_docs) // n_terms


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


# --- the tree of a block --------------------------------------------------------


@dataclass
class Block:
    """Documents as lists: ids, n, m, and per document its terms (commonest first) and their counts."""

    ids: list
    n: np.ndarray
    m: np.ndarray
    ends: np.ndarray
    terms: np.ndarray
    tfs: np.ndarray


class Tree:
    """Nodes in preorder. An inner node has its children's terms and bounds in one piece."""

    def __init__(self, block: Block, k: int = K, bucket: int = BUCKET) -> None:
        self._entries(block, k)
        self._grow(bucket)
        self._summarise()

    def _entries(self, block: Block, k: int) -> None:
        """Different vectors in the order of their paths, each with the k least ids that have it."""
        ends, terms, tfs = block.ends, block.terms.astype(np.int64), block.tfs.astype(np.int64)
        spelled, counted = terms.astype(">u4").tobytes(), tfs.astype(">u8").tobytes()
        keys = [spelled[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        sizes = [counted[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        n = block.n.tolist()
        order = sorted((i for i in range(len(n)) if keys[i]), key=lambda i: (keys[i], sizes[i], n[i], block.ids[i]))
        self.ids: list[list] = []
        chosen: list[int] = []
        for i in order:
            j = chosen[-1] if chosen else -1
            if j >= 0 and keys[i] == keys[j] and sizes[i] == sizes[j] and n[i] == n[j]:
                if len(self.ids[-1]) < k:
                    self.ids[-1].append(block.ids[i])
            else:
                chosen.append(i)
                self.ids.append([block.ids[i]])
        at = np.array(chosen, np.int64)
        lengths = ends[at + 1] - ends[at] if len(at) else np.zeros(0, np.int64)
        self.starts = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        flat = np.repeat(ends[at] - self.starts[:-1], lengths) + np.arange(self.starts[-1]) if len(at) else np.zeros(0, np.int64)
        self.terms, self.tfs, self.m = terms[flat], tfs[flat], block.m[at] if len(at) else np.zeros(0, np.int64)
        self.gains = saturated(self.tfs, np.repeat(self.m, lengths))
        self.keys = [keys[i] for i in chosen]

    def _grow(self, bucket: int) -> None:
        """Ranges of entries: (from, to), and the children of those that are no bucket."""
        self.ranges: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        if not self.keys:
            return
        waiting = [(0, len(self.keys), -1)]
        while waiting:
            low, high, parent = waiting.pop()
            node = len(self.ranges)
            self.ranges.append((low, high))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if high - low > bucket:
                waiting.extend((a, b, node) for a, b in self._split(low, high, bucket))

    def _split(self, low: int, high: int, bucket: int) -> Iterator[tuple[int, int]]:
        """The children of a range: by the first term behind what all its paths share, small neighbours together."""
        keys = self.keys
        one, other = (np.frombuffer(keys[i], ">u4") for i in (low, high - 1))
        n = min(len(one), len(other))
        apart = np.flatnonzero(one[:n] != other[:n])
        shared = 4 * int(apart[0] if len(apart) else n)
        here = bisect_right(keys, keys[low][:shared], low, high)  # paths that end here
        for start in range(low, here, bucket):
            yield start, min(here, start + bucket)
        start = at = here
        while at < high:
            branch = int.from_bytes(keys[at][: shared + 4]) + 1
            stop = bisect_left(keys, branch.to_bytes(shared + 4), at, high)
            if stop - start > bucket and start < at:
                yield start, at
                start = at
            at = stop
            if stop - start > bucket:
                yield start, stop
                start = stop
        if start < high:
            yield start, high

    def _summarise(self) -> None:
        """From the buckets up: each node's terms with their largest tf, and its least m."""
        size = len(self.ranges)
        tops: list = [None] * size
        self.below: list = [None] * size
        for node in range(size - 1, -1, -1):
            low, high = self.ranges[node]
            if not self.children[node]:
                a, b = self.starts[low], self.starts[high]
                terms, tfs, m = self.terms[a:b], self.tfs[a:b], self.m[low:high].min()
            else:
                kids = [tops[c] for c in self.children[node]]
                terms, tfs = (np.concatenate([x[i] for x in kids]) for i in (0, 1))
                m = min(x[2] for x in kids)
                bounds = np.concatenate([saturated(x[1], x[2]) for x in kids])
                begins = np.r_[0, np.cumsum([len(x[0]) for x in kids])[:-1]]
                self.below[node] = (terms, bounds, begins)
                for c in self.children[node]:
                    tops[c] = None
            order = np.lexsort((tfs, terms))
            terms, tfs = terms[order], tfs[order]
            last = np.r_[terms[1:] != terms[:-1], True]
            tops[node] = (terms[last], tfs[last], m)

    def search(self, worth: np.ndarray, best: list[tuple], k: int = K) -> int:
        """Puts the documents that belong among the ``best`` k (-score, id) in place; returns how many entries were scored.

        ``worth`` is the item's weight of every term, 0 for those it does not have.
        """
        read = 0
        waiting = [(None, 0)] if self.ranges else []
        while waiting:
            bound, node = waiting.pop()
            least = -best[-1][0] if len(best) == k else 1
            if bound is not None and bound < least:
                continue
            if self.below[node] is not None:
                terms, gains, begins = self.below[node]
                bounds = np.add.reduceat(worth[terms] * gains, begins)
                kids = self.children[node]
                waiting.extend((int(bounds[i]), kids[i]) for i in np.argsort(bounds, kind="stable") if bounds[i] >= least)
                continue
            low, high = self.ranges[node]
            a, b = self.starts[low], self.starts[high]
            scores = np.add.reduceat(worth[self.terms[a:b]] * self.gains[a:b], self.starts[low:high] - a)
            read += high - low
            hits = np.flatnonzero(scores >= least)
            if len(hits):
                best += [(-int(scores[i]), x) for i in hits for x in self.ids[low + i]]
                best.sort()
                del best[k:]
        return read


# --- tables ---------------------------------------------------------------------


def item_terms(items: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The key columns and each item's ``terms`` and ``counts``, for items that have any."""
    names = list(keys)
    rows = items.select(*[c.alias(n) for n, c in keys.items()], text_or_empty().cast("binary").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(x.as_py()) for x in batch.column(len(names))]
            lists = [pa.array([list(c) for c in found], pa.list_(pa.binary()))]
            lists.append(pa.array([list(c.values()) for c in found], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *lists], [*names, "terms", "counts"])

    return map_batches(rows, count, f"{kept}, terms array<binary>, counts array<long>").where(F.size("terms") > 0)


def restricted(docs: DataFrame, doc_id: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of every document that has a term: its number of terms, and those of the vocabulary."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty().cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for i, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                found = term_counts(text.as_py())
                if found:
                    held = found.keys() & known.keys()
                    ids.append(i)
                    sizes.append(found.total())
                    terms.append([known[t] for t in held])
                    tfs.append([found[t] for t in held])
            lists = [pa.array(x, pa.list_(kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return map_batches(rows, count, "id long, n long, terms array<int>, tfs array<long>")


def frequencies(rows: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms with repeats, and in how many documents each term of the vocabulary is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch["terms"].flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    size = rows.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(n_terms, np.int64)
    # At most one row per term of the items' vocabulary.
    for r in map_batches(rows.select("terms"), count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return size["docs"], size["terms"], df


def _blocks(batches: Iterator[pa.RecordBatch], place: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Block]:
    """Blocks of at most ``BLOCK_DOCS`` documents and about ``BLOCK_TERMS`` terms; terms by their place in the order."""

    def made(parts: list[pa.RecordBatch]) -> Block:
        rows = pa.Table.from_batches(parts).combine_chunks()
        lists = rows["terms"].combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        terms = place[lists.flatten().to_numpy(zero_copy_only=False)]
        tfs = rows["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((terms, np.repeat(np.arange(len(lengths)), lengths)))
        n = rows["n"].to_numpy()
        ids = [(i is not None, i or 0) for i in rows["id"].to_pylist()]  # null first
        return Block(ids, n, length_factor(n, n_docs, n_terms), np.r_[0, np.cumsum(lengths)], terms[order], tfs[order])

    held, docs, terms = [], 0, 0
    for batch in batches:
        sizes = np.cumsum(batch["terms"].value_lengths().to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            fits = int(np.searchsorted(sizes, before + BLOCK_TERMS - terms, side="right"))
            stop = min(max(fits, start + (not held)), start + BLOCK_DOCS - docs, batch.num_rows)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                docs += stop - start
                terms += int(sizes[stop - 1] - before)
            if stop < batch.num_rows:
                yield made(held)
                held, docs, terms = [], 0, 0
            start = stop
    if held:
        yield made(held)


def best_of(rows: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score): the best k documents per item and task. ``items`` are (terms, weights by now) by number."""
    shared = rows.sparkSession.sparkContext.broadcast((items, place))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, order = shared.value
        best: list[list[tuple]] = [[] for _ in asked]
        worth = np.zeros(len(order), np.int64)
        for block in _blocks(batches, order, n_docs, n_terms):
            tree = Tree(block, k)
            for number, (terms, weights) in enumerate(asked):
                worth[terms] = weights
                tree.search(worth, best[number], k)
                worth[terms] = 0
        found = [(number, i if known else None, -score) for number, x in enumerate(best) for score, (known, i) in x]
        columns = [pa.array([f[c] for f in found], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "id", "score"])

    return map_batches(rows, search, "item int, id long, score long")


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 per row of ``items``."""
    spark = docs.sparkSession
    asked = written(item_terms(items, {"key": F.col(item_id)}), "search-items")
    entries = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    groups = -(-entries // ITEM_TERMS)
    kind = asked.schema["key"].dataType.simpleString()
    out = None
    for group in range(groups):
        own = asked.where(F.pmod(F.xxhash64("key", "terms"), F.lit(groups)) == group).collect()
        names = sorted({t for r in own for t in r["terms"]})
        vocabulary = {bytes(t): i for i, t in enumerate(names)}
        rows = written(restricted(docs, doc_id, vocabulary), "search-docs")
        n_docs, n_terms, df = frequencies(rows, len(names))
        if not n_docs:
            continue
        place = np.empty(len(names), np.int64)
        place[np.lexsort((np.arange(len(names)), -df))] = np.arange(len(names))
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        numbers = [np.array([vocabulary[bytes(t)] for t in r["terms"]], np.int64) for r in own]
        priced = [(place[x], weights[x] * np.array(r["counts"], np.int64)) for x, r in zip(numbers, own, strict=True)]
        found = best_of(rows, priced, place, n_docs, n_terms, k)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        labels = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(own)], f"item int, key {kind}")
        top = top.join(labels, "item").select(
            F.col("key").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"
        )
        out = top if out is None else out.unionByName(top)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
