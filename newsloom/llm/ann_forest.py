"""Approximate nearest neighbours with a forest of random-projection trees.

Trees: each node splits by a hyperplane between two sampled vectors at the median
of the sample. The planes are fitted on at most ``SAMPLE`` vectors (those with the
least hashes); their number is fixed by ``TREES`` and ``DEPTH``, so they are
broadcast. Every vector is filed under its leaf in every tree.

Search: one priority queue per query holds open nodes of all trees, ordered by the
sum of squared distances to the planes that separate them from the query. Leaves
are taken from it until ``SHARE`` of all leaves are visited, and further until one
tree alone has shown k candidates, so small tables are searched whole. The share
is the same at every size; it is what recall costs for vectors that do not
cluster. In each visited leaf all candidates are scored exactly.

Rows of a leaf are cut into tiles by their counted number, and probes are sent to
each tile. A task reads a tile and then the probes for it as a stream. Equal
vectors are one entry with their k + 1 least ids, chosen with map-side limits: no
further id can be among the nearest, so nothing is lost.

Vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, nor do rows without an id. Rows repeated as a
whole count once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import map_batches, written

TREES, DEPTH, SHARE = 12, 6, 0.125
SAMPLE = 8192
TILE_ROWS = 4096
SEED = 17


@dataclass(frozen=True)
class Forest:
    planes: np.ndarray  # trees x inner nodes x dimensions
    cuts: np.ndarray  # trees x inner nodes

    @property
    def depth(self) -> int:
        return int(np.log2(self.cuts.shape[1] + 1))


def fit_forest(sample: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    inner = (1 << depth) - 1
    planes = np.zeros((trees, inner, sample.shape[1]))
    cuts = np.zeros((trees, inner))
    for tree in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            rows = members.pop(node)
            plane = rng.standard_normal(sample.shape[1])
            if len(rows) > 1:
                a, b = rng.choice(rows, 2, replace=False)
                if (sample[a] != sample[b]).any():
                    plane = sample[a] - sample[b]
            plane /= np.linalg.norm(plane)
            at = sample[rows] @ plane
            cut = np.median(at) if len(rows) else 0.0
            planes[tree, node], cuts[tree, node] = plane, cut
            members[2 * node + 1], members[2 * node + 2] = rows[at < cut], rows[at >= cut]
    return Forest(planes, cuts)


def sides(forest: Forest, vectors: np.ndarray) -> np.ndarray:
    """Signed distances, vectors x trees x inner nodes."""
    trees, inner, size = forest.planes.shape
    return (vectors @ forest.planes.reshape(-1, size).T).reshape(-1, trees, inner) - forest.cuts


def leaves_of(forest: Forest, vectors: np.ndarray) -> np.ndarray:
    """Leaf number of each vector in each tree."""
    at = sides(forest, vectors)
    node = np.zeros(at.shape[:2], np.int64)
    for _ in range(forest.depth):
        right = np.take_along_axis(at, node[:, :, None], 2)[:, :, 0] >= 0
        node = 2 * node + 1 + right
    return node - forest.cuts.shape[1]


def probed(at: np.ndarray, counts: np.ndarray, k: int, share: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order in which one query's queue gives them; ``at`` are its signed distances."""
    trees, inner = at.shape
    wanted = max(1, round(share * trees * (inner + 1)))
    queue = [(0.0, tree, 0) for tree in range(trees)]
    out: list[tuple[int, int]] = []
    seen = [0] * trees
    while queue and (len(out) < wanted or max(seen) <= k):
        cost, tree, node = heapq.heappop(queue)
        if node >= inner:
            leaf = node - inner
            out.append((tree, leaf))
            seen[tree] += int(counts[tree, leaf])
            continue
        side = float(at[tree, node])
        near = 2 * node + 1 + (side >= 0)
        heapq.heappush(queue, (cost, tree, near))
        heapq.heappush(queue, (cost + side * side, tree, 4 * node + 3 - near))
    return out


# --- tables ---------------------------------------------------------------------


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part, once each."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good = rows.where(F.col(key).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(
        F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("vector")
    )
    common = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size("vector") == (common["n"] if common else 0)).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, each summed in the same order wherever it stands."""
    return (a * b).sum(axis=1)


def nearest(rows: DataFrame, key: str, vector: str, is_query: Column, k: int = 20, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found with the largest inner products, for each query row."""
    points = written(usable(rows, key, vector).withColumn("_q", is_query), "vectors")
    first = Window.partitionBy("vector").orderBy("id")
    entries = written(
        points.select("id", "vector")
        .withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") <= k + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids")),
        "vector-entries",
    )
    result = "query_id long, vec_id long, score double"
    sample = entries.orderBy(F.xxhash64("vector")).limit(SAMPLE).select("vector").collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = rows.sparkSession.sparkContext.broadcast(fit_forest(np.array([r[0] for r in sample])))
    trees, leaves = forest.value.cuts.shape[0], forest.value.cuts.shape[1] + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = leaves_of(forest.value, _matrix(batch["vector"]))
                for tree in range(trees):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), tree, np.int32)), pa.array(at[:, tree].astype(np.int32)), batch["vector"], batch["ids"]],
                        ["tree", "leaf", "vector", "ids"],
                    )

    filed = map_batches(entries, place, "tree int, leaf int, vector array<double>, ids array<long>")
    counts = np.zeros((trees, leaves), np.int64)
    entry_counts = np.zeros((trees, leaves), np.int64)
    for r in filed.groupBy("tree", "leaf").agg(F.sum(F.size("ids")).alias("n"), F.count(F.lit(1)).alias("m")).collect():
        counts[r["tree"], r["leaf"]], entry_counts[r["tree"], r["leaf"]] = r["n"], r["m"]
    tiles = np.maximum(1, -(-entry_counts // TILE_ROWS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                at = sides(forest.value, _matrix(part["vector"]))
                found = [(i, *p) for i, row in enumerate(at) for p in probed(row, counts, k, share)]
                which, tree, leaf = np.array(found, np.int32).T
                taken = part.take(pa.array(which))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree), pa.array(leaf), taken["vector"], taken["id"], pa.array(tiles[tree, leaf].astype(np.int32))],
                    ["tree", "leaf", "vector", "id", "tiles"],
                )

    probes = map_batches(
        points.where("_q").select("id", "vector"), probe, "tree int, leaf int, vector array<double>, id long, tiles int"
    )
    tile_table = F.array(*[F.array(*[F.lit(int(x)) for x in row]) for row in tiles])
    tile = F.pmod(F.xxhash64("vector"), F.element_at(F.element_at(tile_table, F.col("tree") + 1), F.col("leaf") + 1))
    kept = filed.select("tree", "leaf", tile.cast("int").alias("tile"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "vector", "ids")
    asked = probes.select(
        "tree",
        "leaf",
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"),
        F.lit(1).alias("kind"),
        "id",
        "vector",
        F.lit(None).cast("array<long>").alias("ids"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, ids = None, [], []
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("tree", "leaf", "tile", "kind")], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                part, name = batch.slice(start, end - start), tuple(keys[start][:3])
                if not keys[start][3]:
                    if current != name:
                        current, held, ids = name, [], []
                    held.append(_matrix(part["vector"]))
                    ids.extend(part["ids"].to_pylist())
                    continue
                if current != name:
                    continue
                held = [np.concatenate(held)]
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    yield _best(_matrix(some["vector"]), some["id"].to_numpy(), held[0], ids, k)

    spread = kept.unionByName(asked).repartition("tree", "leaf", "tile").sortWithinPartitions("tree", "leaf", "tile", "kind")
    hits = map_batches(spread, score, result).distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _best(queries: np.ndarray, query_ids: np.ndarray, held: np.ndarray, ids: list[list[int]], k: int) -> pa.RecordBatch:
    """The k nearest rows of a tile for each query (its own row left out), with exact scores."""
    rough = queries @ held.T
    take = min(k + 1, rough.shape[1])  # the query's own entry may be one of them
    least = np.partition(rough, rough.shape[1] - take, axis=1)[:, rough.shape[1] - take]
    slack = 1e-9 * (1.0 + np.abs(least))
    q, c = np.nonzero(rough >= (least - slack)[:, None])
    scores = _inner(queries[q], held[c])
    out_q, out_v, out_s = [], [], []
    for a, b, s in zip(query_ids[q].tolist(), c.tolist(), scores.tolist(), strict=True):
        for v in ids[b]:
            if v != a:
                out_q.append(a)
                out_v.append(v)
                out_s.append(s)
    return pa.RecordBatch.from_arrays(
        [pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "vec_id", "score"]
    )
