"""SimHash near-duplicates by Golay-code fuzzy keys.

A 64-bit fingerprint is cut into four 16-bit segments. Of three wrong bits, at
least one segment has none, and for some pair of segments (i, j) of ``PAIRS``
segment i has none and segment j at most one: if two segments are free of errors,
the pair of those two is in ``PAIRS`` one way round; if only one is, each of the
others has exactly one error, and every segment comes first in some pair.

Segment j is read as a word of the perfect (23, 12) Golay code (seven zero bits in
front), whose decoder maps each word to the one codeword within distance three.
A fingerprint is filed under segment i and the codeword of segment j, and looked
up under segment i and the codewords of segment j and of its 16 neighbours at
distance one: one to six different indices. So two fingerprints within three bits
meet in at least one key, and the exact distance decides.

Equal fingerprints are one node, whatever their number; pairs are verified inside
the join and only links leave it. Keys are cut by 28 bits, and a hot key is a
skewed join, which Spark splits. A null text counts as empty; texts without words
have fingerprint zero and link like others. A row with a null id gets the
component of its fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_batches, row_key, text_or_empty, whole_rows, written
from newsloom.llm.components import components

MAX_BITS = 3
SHINGLE = 3
SEED = 42
PAIRS = ((0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3))
GENERATOR = 0b101011100011  # of the (23, 12) Golay code


# --- fingerprints ---------------------------------------------------------------


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # of bytes: ASCII letters and ASCII blanks only
    if not words:
        return 0
    parts = zip(*[words[i:] for i in range(SHINGLE)]) if len(words) >= SHINGLE else [words]
    return majority([xxhash.xxh64_intdigest(b" ".join(part), SEED) for part in parts])


def majority(hashed: list[int] | np.ndarray) -> int:
    """The fingerprint of some unsigned 64-bit hashes: a bit is 1 if over half of them have it."""
    bits = np.zeros(64, np.int64)
    for start in range(0, len(hashed), 1 << 16):
        some = np.array(hashed[start : start + (1 << 16)], dtype=">u8")
        bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashed)).tobytes(), "big")


def fingerprints(docs: DataFrame, keys: dict) -> DataFrame:
    """The given key columns and ``fp`` (the fingerprint as a signed long) per row."""
    names = list(keys)
    rows = docs.select(*[c.alias(n) for n, c in keys.items()], text_or_empty().cast("binary").alias("_bytes"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", fp long"

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py()) for x in batch["_bytes"]]
            column = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], column], [*names, "fp"])

    return map_batches(rows, hash_texts, schema)


# --- the code -------------------------------------------------------------------


@lru_cache(1)
def codeword_index() -> np.ndarray:
    """For each 23-bit word the index (12 bits) of its nearest codeword."""
    weights = np.arange(1 << 12, dtype=np.int64)
    words = np.zeros(1 << 12, np.int64)
    for bit in range(12):
        words ^= np.where(weights >> bit & 1, GENERATOR << bit, 0)
    flips = [0]
    for a in range(23):
        flips.append(1 << a)
        for b in range(a):
            flips.append(1 << a | 1 << b)
            flips.extend(1 << a | 1 << b | 1 << c for c in range(b))
    out = np.full(1 << 23, -1, np.int16)
    for flip in flips:
        out[words ^ flip] = weights
    assert (out >= 0).all()  # the code is perfect
    return out


@lru_cache(1)
def segment_keys() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own index per 16-bit segment; and all indices within one flip, as (values, offsets)."""
    segments = np.arange(1 << 16)
    index = codeword_index()
    near = np.stack([index[segments], *[index[segments ^ (1 << b)] for b in range(16)]], axis=1)
    near.sort(axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    return index[segments], near[new], np.r_[0, np.cumsum(new.sum(axis=1))]


def _keys(fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in fps) of the keys to file (or, with ``probe``, to look up)."""
    own, near, offsets = segment_keys()
    parts = [(fps.view(np.uint64) >> np.uint64(16 * i)).astype(np.int64) & 0xFFFF for i in range(4)]
    keys, at = [], []
    for number, (i, j) in enumerate(PAIRS):
        head = (number << 28) | (parts[i] << 12)
        if not probe:
            keys.append(head | own[parts[j]])
            at.append(np.arange(len(fps)))
            continue
        begin, n = offsets[parts[j]], offsets[parts[j] + 1] - offsets[parts[j]]
        each = np.repeat(np.arange(len(fps)), n)
        within = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        keys.append(head[each] | near[begin[each] + within])
        at.append(each)
    return np.concatenate(keys), np.concatenate(at)


def fuzzy_keys(nodes: DataFrame, probe: bool) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy().astype(np.int64)
            if len(fps):
                keys, at = _keys(fps, probe)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at])], ["key", "fp"])

    return map_batches(nodes.select("fp"), make, "key long, fp long")


# --- links and groups -----------------------------------------------------------


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints within three bits, each at least once."""
    filed = fuzzy_keys(nodes, probe=False).withColumnRenamed("fp", "a")
    asked = fuzzy_keys(nodes, probe=True).select(F.col("key").alias("asked"), F.col("fp").alias("b"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS) & (F.col("a") != F.col("b"))
    return asked.join(filed, (F.col("key") == F.col("asked")) & near).select("a", "b")


def nodes_of(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("fp").agg(F.min("_id").alias("least_id")), "fingerprint-nodes")


def grouped(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (with _id and ``fp``) without _id, with the component of their fp by the links ``found``, and its least _id."""
    groups = components(found).withColumnRenamed("node", "fp")
    joined = nodes.join(groups, "fp", "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component")
    )
    least = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labels = written(joined.join(least, "component").select("fp", "component", "component_id"), "fingerprint-labels")
    return rows.join(labels, "fp").drop("_id")


def labelled(docs: DataFrame, keys: dict) -> DataFrame:
    """The key columns, ``fp`` and ``component_id`` (least reachable doc_id) of every row."""
    rows = written(fingerprints(docs, {**keys, "_id": F.col("doc_id")}), "fingerprints")
    nodes = nodes_of(rows)
    return grouped(rows, nodes, links(nodes))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    return labelled(docs, {"doc_id": F.col("doc_id")}).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the least doc_id (a null id only if all are).

    Of repeated rows one stays.
    """
    return kept_of(docs, labelled(docs, {"_row": row_key(docs), "_doc": F.col("doc_id")}))


def kept_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay by their labels (_row, _doc, component, component_id)."""
    stays = found.where(F.col("_doc").eqNullSafe(F.col("component_id"))).groupBy("component").agg(
        F.min("_row").alias("_row")
    )
    kept = stays.select(F.col("_row").alias("kept"))
    return whole_rows(docs).join(kept, F.col("key") == F.col("kept"), "left_semi").dropDuplicates(["key"]).select("row.*")
