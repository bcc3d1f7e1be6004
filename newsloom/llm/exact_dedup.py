"""Exact dedup of arriving batches against immutable snapshots.

A snapshot is written once: the distinct texts with their SHA-256 digests, and
for each bucket of digests a static binary fuse filter. The texts of a new batch
are grouped among themselves first. Their digests are then screened against the
filters; those that pass, true or false positives, are joined to the snapshot's
exact rows and compared byte by byte.

Hot groups are combined map-side (one row per task and text) before anything is
shuffled. Buckets are cut by digest, and digests in a batch are distinct by then,
so no bucket is hot; a filter covers about ``KEYS_PER_FILTER`` digests and the
number of buckets follows the snapshot.

A null text counts as empty. A null id is smaller than any other. Rows repeated
as a whole count in ``group_size``, and one of them stays. Two different texts
with one digest stop the job with an error: they are found by the byte check and
never merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_batches, release, text_or_empty, written
from newsloom.session import ship_package

KEYS_PER_FILTER = 1 << 10
FILTER_SCHEMA = "bucket int, seed long, segment long, reach long, cells binary"


# --- the filter -----------------------------------------------------------------


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _cells(h: np.ndarray, segment: int, reach: int) -> np.ndarray:
    """The three cells of each key, in three neighbouring segments."""
    low = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(reach)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low)
    third = (first + np.uint64(2 * segment)) ^ (h & low)
    return np.stack([first, second, third]).astype(np.int64)


def _tags(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment, reach, cells) of a binary fuse filter with 16-bit tags over int64 keys."""
    keys = np.unique(keys).view(np.uint64)
    n = len(keys)
    segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    wanted = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    reach = max(1, math.ceil(wanted / segment) - 2) * segment
    size = reach + 2 * segment
    for seed in range(1, 1000):
        h = _mixed(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        cells = _cells(h, segment, reach)
        layers = _peeled(cells, size)
        if layers is None:
            continue
        tags, out = _tags(h), np.zeros(size, np.uint16)
        for members, at in reversed(layers):
            a, b, c = out[cells[:, members]]
            out[at] = tags[members] ^ a ^ b ^ c  # out[at] itself is still zero
        return seed, segment, reach, out.tobytes()
    raise RuntimeError("no seed gives a filter")


def _peeled(cells: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Layers of (keys, the cell each of them owns); None if some keys hold each other."""
    n = cells.shape[1]
    count = np.bincount(cells.ravel(), minlength=size)
    total = np.bincount(cells.ravel(), weights=np.tile(np.arange(n), 3), minlength=size).astype(np.int64)
    layers, left, look = [], n, np.flatnonzero(count == 1)
    while len(look):
        members, first = np.unique(total[look], return_index=True)
        layers.append((members, look[first]))
        left -= len(members)
        touched = cells[:, members].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, np.tile(members, 3))
        look = np.unique(touched)
        look = look[count[look] == 1]
    return layers if not left else None


def in_filter(keys: np.ndarray, seed: int, segment: int, reach: int, cells: bytes) -> np.ndarray:
    h = _mixed(keys.view(np.uint64), seed * 0x9E3779B97F4A7C15 % (1 << 64))
    a, b, c = np.frombuffer(cells, np.uint16)[_cells(h, segment, reach)]
    return (a ^ b ^ c) == _tags(h)


# --- groups and snapshots -------------------------------------------------------


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _key() -> Column:
    return F.xxhash64("digest")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.shiftrightunsigned(_key(), 33), F.lit(buckets)).cast("int")


def grouped(docs: DataFrame) -> DataFrame:
    """One row per text of a batch: digest, text, keep_id, n. Grouping on the text compares its bytes."""
    text = text_or_empty()
    return (
        docs.select("doc_id", text.alias("text"), digest_of(text).alias("digest"))
        .groupBy("digest", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )


@dataclass(frozen=True)
class Snapshot:
    """An immutable set of texts: ``texts`` (digest, text, keep_id, n) and one filter per bucket."""

    texts: DataFrame
    filters: DataFrame
    buckets: int


def write_snapshot(groups: DataFrame) -> Snapshot:
    texts = written(groups, "snapshot-texts")
    buckets = max(1, math.ceil(texts.count() / KEYS_PER_FILTER))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = build_filter(rows["key"].to_numpy(np.int64))
        return pd.DataFrame([(rows["bucket"].iloc[0], *made)], columns=["bucket", "seed", "segment", "reach", "cells"])

    ship_package(groups.sparkSession)
    keys = texts.select(_bucket(buckets).alias("bucket"), _key().alias("key"))
    filters = keys.groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)
    return Snapshot(texts, written(filters, "snapshot-filters"), buckets)


def screened(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Digests of the batch that the snapshot's filters do not rule out.

    Each task reads its buckets in order, the filter of a bucket before its
    digests, so that it holds one filter and one Arrow batch at a time.
    """
    asked = groups.select(
        _bucket(snapshot.buckets).alias("bucket"),
        F.lit(1).alias("kind"),
        "digest",
        _key().alias("key"),
        *[F.lit(None).cast(t).alias(c) for c, t in snapshot.filters.dtypes if c != "bucket"],
    )
    held = snapshot.filters.select(
        "bucket",
        F.lit(0).alias("kind"),
        F.lit(None).cast("binary").alias("digest"),
        F.lit(None).cast("long").alias("key"),
        *[c for c in snapshot.filters.columns if c != "bucket"],
    )

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, made = None, None
        for batch in batches:
            bucket, kind = batch["bucket"].to_numpy(), batch["kind"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])])
            for start, end in zip(starts, [*starts[1:], len(bucket)], strict=True):
                part = batch.slice(start, end - start)
                if not kind[start]:
                    row = part.to_pylist()[-1]
                    current, made = row["bucket"], [row[c] for c in ("seed", "segment", "reach", "cells")]
                elif current == bucket[start]:
                    may = in_filter(part["key"].to_numpy().astype(np.int64), *made)
                    yield pa.RecordBatch.from_arrays([part["digest"].filter(pa.array(may))], ["digest"])

    return map_batches(
        asked.unionByName(held).repartition("bucket").sortWithinPartitions("bucket", "kind"), screen, "digest binary"
    )


def matches(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The batch's texts that the snapshot holds, byte for byte: digest, keep_id and n of the batch's group."""
    passed = screened(groups, snapshot)
    ours = groups.join(passed, "digest", "left_semi").alias("ours")
    theirs = snapshot.texts.join(passed, "digest", "left_semi").alias("theirs")
    same = (F.col("ours.digest") == F.col("theirs.digest")) & (F.col("ours.text") == F.col("theirs.text"))
    return ours.join(theirs, same).select("ours.digest", "ours.keep_id", "ours.n")


# --- a table of documents -------------------------------------------------------


def text_groups(docs: DataFrame) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size.

    Half of the table, by a hash of the id, arrives first and becomes a snapshot;
    the other half is the batch that is checked against it.
    """
    late = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    snapshot = write_snapshot(grouped(docs.where(~late)))
    batch = written(grouped(docs.where(late)), "batch-texts")
    matched = written(matches(batch, snapshot), "matches")
    found = matched.select("digest", F.col("keep_id").alias("found_id"), F.col("n").alias("found_n"))
    old = snapshot.texts.join(found, "digest", "left").select(
        "digest",
        F.greatest("keep_id", "found_id").alias("keep_id"),
        (F.col("n") + F.coalesce("found_n", F.lit(0))).alias("group_size"),
    )
    new = batch.join(found, "digest", "left_anti").select("digest", "keep_id", F.col("n").alias("group_size"))
    groups = written(old.unionByName(new), "text-groups")
    if not groups.groupBy("digest").count().where("count > 1").isEmpty():
        raise ValueError("two different texts have one SHA-256 digest")
    release(batch, matched, snapshot.texts, snapshot.filters)
    return groups


def dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = text_groups(docs)
    rows = docs.select("doc_id", digest_of(text_or_empty()).alias("digest"))
    alike = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return (
        alike.join(groups, "digest")
        .select("*", copies.alias("copy"))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per distinct text."""
    groups = text_groups(docs).select(F.col("digest").alias("kept_digest"), F.col("keep_id").alias("kept_id"))
    keyed = docs.select(digest_of(text_or_empty()).alias("digest"), F.struct("*").alias("row"))
    stays = (F.col("digest") == F.col("kept_digest")) & F.col("row.doc_id").eqNullSafe(F.col("kept_id"))
    return keyed.join(groups, stays, "left_semi").dropDuplicates(["digest"]).select("row.*")
