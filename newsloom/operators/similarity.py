"""Most similar articles by cosine.

Two plans:

* :func:`similar_to` answers a short request list by one scan of the index;
* :func:`top_k` answers many requests, up to "every article", and
  :func:`top_k_approximate` does so from the nearest lists only.

``top_k`` is exact without comparing every pair. Candidates are split into lists
around pivots. A request first visits its nearest lists, which gives a lower
bound on its k-th best score; then it visits just those lists whose best
possible score, by the triangle inequality on angles, reaches that bound.
Pivots are broadcast while they are small. Beyond that they form a tree: only its
upper level is broadcast, vectors and requests go to the branches near them, and
the lower level meets them there in a join.

``top_k_approximate`` files each vector under ``spill`` lists: the nearest, and
others chosen so that they explain what the nearest leaves over. A request visits
lists until the next one is more than ``stop`` radians farther than the nearest.

What keeps hot groups small:

* equal vectors are collapsed before anything else, on both sides. All copies
  score the same, so the lowest ids are enough;
* requests are cut into a bounded number of chunks, whatever their number is. A task
  holds one chunk and the best matches that its requests have so far, and streams
  the candidates past it list by list; each request meets only the lists it
  visits. So a vector is sent once per chunk, and not once per list;
* few requests make few chunks; then candidates are cut into tiles of at least
  ``rows_per_tile`` vectors, too;
* each task emits its own top k per request, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.columns import with_evaluated
from newsloom.functions.vectors import cosine
from newsloom.schemas import DEFAULT_K, MAX_K, MIN_K, SCORE_FLOOR
from newsloom.session import shared_dir, ship_package, stored

# Scores are rounded before ranking, so that ties are ties and not floating-point noise.
RANK_DIGITS = 9
SLACK = 1e-8
ROWS_PER_TILE = 2048
QUERIES_PER_PRODUCT = 512
VISITS_PER_BATCH = 8192
# Requests are cut into CELLS chunks, unless these would hold more or less than this.
CELLS = 16
MIN_CHUNK, MAX_CHUNK = 2048, 1 << 16
PAIRS_PER_CHUNK = 1 << 22
QUERIES_PER_BATCH = 1024
ROWS_PER_BRANCH_PART = 1 << 16
# Pivots are broadcast up to this size; larger sets become a tree.
MAX_PIVOT_BYTES = 64 << 20
# How much a further list is to differ from the nearest, against how near it is to be itself.
SPILL_WEIGHT = 1.0
STOP = 0.25


def normal_requests(requests: DataFrame) -> DataFrame:
    """Requests with the default for a missing k, and null for an empty filter."""
    normal = requests.withColumn("k", F.coalesce(F.col("k"), F.lit(DEFAULT_K)))
    if "category_filter" in requests.columns:
        normal = normal.withColumn("category_filter", F.nullif(F.col("category_filter"), F.lit("")))
    return normal


def check_requests(requests: DataFrame) -> DataFrame:
    """Add ``status``: ``invalid`` when k is out of bounds. A missing k is the default, an empty filter none."""
    return normal_requests(requests).withColumn(
        "status", F.when(F.col("k").between(MIN_K, MAX_K), "ok").otherwise("invalid")
    )


def with_source(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Add the source vector; a source that is not indexed gets the status ``source_missing``."""
    sources = index.select("news_id", "embedding")
    found = requests.join(sources, "news_id", "left")
    missing = (F.col("status") == "ok") & F.col("embedding").isNull()
    return found.withColumn("status", F.when(missing, "source_missing").otherwise(F.col("status")))


def similar_to(index: DataFrame, news_id: int, k: int = DEFAULT_K, category: str | None = None) -> DataFrame:
    """Top k for one article: (rank, news_id, title, category, similarity_score).

    The one source vector becomes a constant of the plan and a top-k heap keeps k
    rows per task; candidates are neither joined nor shuffled.
    """
    if not MIN_K <= k <= MAX_K:
        raise ValueError(f"k must be between {MIN_K} and {MAX_K}")
    source = index.where(F.col("news_id") == news_id).select("embedding").first()
    candidates = index.where(F.col("news_id") != news_id)
    if category:
        candidates = candidates.where(F.col("category") == category)
    if source is None or source["embedding"] is None:
        score = F.lit(None).cast("double")
    else:
        score = cosine(F.array(*[F.lit(x) for x in source["embedding"]]), F.col("embedding"))
    # The floor is applied to the k best: the order is descending, so it cuts the same rows,
    # and as a filter below the ranking it would compute every score twice.
    order = [F.col("_ranked").desc(), F.col("news_id")]
    best = (
        candidates.select("news_id", "title", "category", score.alias("_score"))
        .withColumn("_ranked", F.round("_score", RANK_DIGITS))
        .orderBy(*order)
        .limit(k)
        .where(F.col("_score") >= SCORE_FLOOR)
    )
    return best.select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"),
        "news_id",
        "title",
        "category",
        F.round("_score", 4).alias("similarity_score"),
    )


def pair_scores(pairs: DataFrame, index: DataFrame, many: bool = False) -> DataFrame:
    """Cosine for a given list of pairs (left_id, right_id).

    With ``many`` pairs a vector is not sent once per pair: left articles are cut into
    chunks, each with its pairs, and every vector is sent once per chunk. The pairs of
    one left article are one row.
    """
    if many:
        return _many_pair_scores(pairs, index)
    left = index.select(F.col("news_id").alias("left_id"), F.col("embedding").alias("_left"))
    right = index.select(F.col("news_id").alias("right_id"), F.col("embedding").alias("_right"))
    return _joined_scores(pairs, left, right)


def _joined_scores(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    joined = pairs.join(left, "left_id").join(right, "right_id")
    return joined.select("left_id", "right_id", cosine(F.col("_left"), F.col("_right")).alias("similarity"))


def _many_pair_scores(pairs: DataFrame, index: DataFrame) -> DataFrame:
    ship_package(pairs.sparkSession)
    packed = stored(pairs.groupBy("left_id").agg(F.collect_list("right_id").alias("ids")), "pairs")
    size = packed.agg(F.count("*").alias("lefts"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("pairs")).first()
    dim = index.agg(F.max(F.size("embedding")).alias("dim")).first()["dim"]
    plain = (F.size("embedding") == F.lit(dim)) & ~F.exists("embedding", lambda x: x.isNull())
    vectors = index.select("news_id", "embedding", F.coalesce(plain, F.lit(False)).alias("_plain"))
    chunks = max(min(CELLS, -(-size["lefts"] // MIN_CHUNK)), -(-size["lefts"] // MAX_CHUNK), -(-size["pairs"] // PAIRS_PER_CHUNK), 1)
    given = vectors.where("_plain").drop("_plain")
    asking = packed.join(given.withColumnRenamed("news_id", "left_id"), "left_id").select(
        F.pmod(F.xxhash64("left_id"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(0).alias("side"), F.col("left_id").alias("id"), "embedding", "ids"
    )
    sent = given.where("news_id is not null").select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("side"), F.col("news_id").alias("id"), "embedding",
        F.lit(None).cast("array<bigint>").alias("ids"),
    )
    stream = asking.unionByName(sent).repartition("chunk").sortWithinPartitions("chunk", "side")

    def score_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, held = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "side")]).astype(np.int64)
            edges = np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1 if batch.num_rows else []
            for start, stop in zip([0, *edges], [*edges, batch.num_rows]):
                if start == stop:
                    continue
                rows, here = batch.slice(int(start), int(stop - start)), marks[0, start]
                if here != current:
                    current, parts, held = here, [], None
                if marks[1, start] == 0:
                    parts.append(rows)
                elif parts or held is not None:
                    if held is None:
                        held, parts = _Pairs(parts), []
                    yield from held.meet(rows)

    scored = stream.mapInArrow(score_chunks, "left_id bigint, right_id bigint, similarity double")
    odd = vectors.where(~F.col("_plain")).drop("_plain")
    if odd.limit(1).count():
        # Vectors that are missing or of another length score as they do in short lists.
        known = packed.select("left_id", F.explode("ids").alias("right_id"))
        left, right = (lambda v: v.toDF("left_id", "_left")), (lambda v: v.toDF("right_id", "_right"))
        every = vectors.drop("_plain")
        scored = scored.unionByName(_joined_scores(known, left(odd), right(every))).unionByName(_joined_scores(known, left(given), right(odd)))
    return scored


class _Pairs:
    """The left vectors of a chunk and their pairs, ordered by the right id."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.unit = _unit(np.concatenate([_matrix(p.column("embedding")) for p in parts]))
        self.left = np.concatenate([p.column("id").to_numpy(zero_copy_only=False) for p in parts])
        ids = pa.concat_arrays([p.column("ids") for p in parts])
        row = np.repeat(np.arange(len(ids), dtype=np.int32), ids.value_lengths().to_numpy(zero_copy_only=False))
        right = ids.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(right, kind="stable")
        self.row, self.right = row[order], right[order]

    def meet(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, unit = rows.column("id").to_numpy(zero_copy_only=False), _unit(_matrix(rows.column("embedding")))
        first, last = (np.searchsorted(self.right, ids, side=side) for side in ("left", "right"))
        n = last - first
        at = np.repeat(np.arange(len(ids)), n)
        pair = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        for p in _pieces(len(at)):
            row, col = self.row[pair[p]], at[p]
            columns = [self.left[row], ids[col], np.einsum("ij,ij->i", self.unit[row], unit[col])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["left_id", "right_id", "similarity"])


# --- lists ---------------------------------------------------------------------------------


def choose_pivots(index: DataFrame, n_lists: int, levels: int | None = None) -> np.ndarray | PivotTree:
    """``n_lists`` unit vectors of the index, by lowest hash of the id. Any pivots keep the search exact.

    With two ``levels``, which is the choice for pivots too large to broadcast,
    they stay a table, and only about the root of their number is collected.
    """
    given = index.where(F.exists("embedding", lambda x: x != 0))
    dim = (given.select(F.size("embedding").alias("dim")).first() or {"dim": 0})["dim"]
    if levels is None:
        levels = 1 if n_lists * dim * 8 <= MAX_PIVOT_BYTES else 2
    if levels == 1:
        return _collected(given, n_lists)
    tops = _collected(given, max(1, min(math.isqrt(n_lists), MAX_PIVOT_BYTES // (8 * max(1, dim)))))
    # Numbered by ids alone; the vectors join them afterwards.
    order = [F.xxhash64("news_id"), F.col("news_id")]
    chosen = given.select("news_id").orderBy(*order).limit(n_lists)
    numbered = chosen.select("news_id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("number"))
    own = given.join(numbered, "news_id").select("number", "embedding").dropDuplicates(["number"])
    shared_dir(index.sparkSession)
    placed = with_list(own, tops).select(F.col("list_id").alias("top_id"), "number", "embedding").checkpoint()
    return PivotTree(tops, placed, n_lists) if len(tops) else tops


def _collected(given: DataFrame, n: int) -> np.ndarray:
    rows = given.select(F.xxhash64("news_id").alias("_h"), "news_id", "embedding").orderBy("_h", "news_id").limit(n).collect()
    pivots = np.array([r["embedding"] for r in rows], dtype=np.float64)
    return _unit(pivots) if pivots.size else pivots.reshape(0, 0)


@dataclass(frozen=True)
class PivotTree:
    """Upper pivots as a matrix; the lower ones as a table (top_id, number, embedding) that joins what is routed."""

    tops: np.ndarray
    pivots: DataFrame
    n_lists: int

    def __len__(self) -> int:
        return self.n_lists


def train_lists(index: DataFrame, n_lists: int = 100, seed: int = 1) -> np.ndarray:
    """List centres by k-means on all unit vectors."""
    given = index.where(F.exists("embedding", lambda x: x != 0))
    vectors = given.select(array_to_vector("embedding").alias("v"))
    model = KMeans(k=n_lists, seed=seed, featuresCol="v", distanceMeasure="cosine", maxIter=10).fit(vectors)
    return _unit(np.array(model.clusterCenters(), dtype=np.float64))


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1.0, norms)


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def with_list(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add each vector's nearest list and its cosine to that list's pivot."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch, QUERIES_PER_PRODUCT):
                cosines = _unit(_matrix(part.column("embedding"))) @ shared.value.T
                nearest = cosines.argmax(axis=1)
                best = cosines[np.arange(len(nearest)), nearest]
                columns = part.columns + [pa.array(nearest, pa.int32()), pa.array(best, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names + ["list_id", "pivot_cosine"])

    return vectors.mapInArrow(assign, f"{fields}, list_id int, pivot_cosine double")


def with_lists(vectors: DataFrame, centres: np.ndarray, spill: int) -> DataFrame:
    """Each vector once per list it is filed under: the nearest, and further ones.

    A further list is near the vector as well, and its own error points elsewhere
    than the nearest list's does: a request that misses the vector's nearest list
    because of that error is likely to visit the other.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    spill = max(1, min(spill, len(centres)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch, QUERIES_PER_PRODUCT):
                unit, at = _unit(_matrix(part.column("embedding"))), np.arange(part.num_rows)
                cosines = unit @ shared.value.T
                lists = [cosines.argmax(axis=1)]
                if spill > 1:
                    left = _unit(unit - cosines[at, lists[0]][:, None] * shared.value[lists[0]])
                    along = np.einsum("ij,ij->i", unit, left)[:, None] - left @ shared.value.T
                    loss = 2.0 - 2.0 * cosines + SPILL_WEIGHT * along**2
                    loss[at, lists[0]] = np.inf
                    lists += list(np.argsort(loss, axis=1, kind="stable")[:, : spill - 1].T)
                for chosen in lists:
                    columns = part.columns + [pa.array(chosen, pa.int32()), pa.array(cosines[at, chosen], pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, part.schema.names + ["list_id", "pivot_cosine"])

    return vectors.mapInArrow(assign, f"{fields}, list_id int, pivot_cosine double")


def _at_branches(rows: DataFrame, tree: PivotTree, within) -> tuple[DataFrame, Callable]:
    """``rows`` (with top_id) where the tree's lower pivots are: one branch and part of its rows to a group.

    ``within(part, numbers, pivots)`` gets a batch of rows of one branch with the
    numbers and unit vectors of its pivots, and yields batches. Rows of a branch are
    cut into parts by their counted number, and its pivots go to each part.
    """
    names = rows.columns
    parts = rows.groupBy("top_id").agg(F.ceil(F.count("*") / ROWS_PER_BRANCH_PART).cast("int").alias("_parts"))
    spread = rows.join(parts, "top_id").withColumn("_part", F.pmod(F.xxhash64("embedding"), F.col("_parts")).cast("int"))
    blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names if c not in ("top_id", "embedding")]
    lower = tree.pivots.join(parts, "top_id").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    lower = lower.select("top_id", "embedding", "number", "_part", *blank, F.lit(0).alias("_side"))
    sent = spread.select("top_id", "embedding", F.lit(None).cast("int").alias("number"), "_part", *[c for c in names if c not in ("top_id", "embedding")], F.lit(1).alias("_side"))
    cell = ["top_id", "_part"]
    stream = lower.unionByName(sent).repartition(*cell).sortWithinPartitions(*cell, "_side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, numbers, vectors = None, [], []
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*cell, "_side")]).astype(np.int64)
            edges = np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1 if batch.num_rows else []
            for start, stop in zip([0, *edges], [*edges, batch.num_rows]):
                if start == stop:
                    continue
                run, here = batch.slice(int(start), int(stop - start)), tuple(marks[:2, start])
                if here != current:
                    current, numbers, vectors = here, [], []
                if marks[2, start] == 0:
                    numbers.append(run.column("number").to_numpy(zero_copy_only=False))
                    vectors.append(_unit(_matrix(run.column("embedding"))))
                elif numbers:
                    held, known = np.concatenate(vectors), np.concatenate(numbers).astype(np.int64)
                    for part in _blocks(run, QUERIES_PER_PRODUCT):
                        yield from within(part.select(names), known, held)

    return stream, meet


def _with_list_by_tree(vectors: DataFrame, tree: PivotTree) -> DataFrame:
    """As :func:`with_list`, by the nearest upper pivot and the nearest lower one under it; adds ``top_id`` and ``top_cosine``."""
    upper = with_list(vectors, tree.tops).withColumnRenamed("list_id", "top_id").withColumnRenamed("pivot_cosine", "top_cosine")
    # An upper pivot without lower ones owns nothing; its vectors go to the branch of the first pivot that has some.
    held = tree.pivots.agg(F.sort_array(F.collect_set("top_id")).alias("held")).first()["held"]
    if len(held) < len(tree.tops):
        full = np.array(held)
        own = with_list(vectors, tree.tops[full])
        names = F.array(*[F.lit(int(t)) for t in full])
        upper = own.select(*vectors.columns, F.element_at(names, F.col("list_id") + 1).alias("top_id"), F.col("pivot_cosine").alias("top_cosine"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in upper.schema)

    def nearest(part: pa.RecordBatch, numbers: np.ndarray, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
        cosines = _unit(_matrix(part.column("embedding"))) @ pivots.T
        best = cosines.argmax(axis=1)
        columns = [pa.array(numbers[best], pa.int32()), pa.array(cosines[np.arange(len(best)), best])]
        yield pa.RecordBatch.from_arrays(part.columns + columns, part.schema.names + ["list_id", "pivot_cosine"])

    stream, meet = _at_branches(upper, tree, nearest)
    return stream.mapInArrow(meet, f"{fields}, list_id int, pivot_cosine double")


def _visits_by_tree(queries: DataFrame, tree: PivotTree, top_reach: np.ndarray, reach: np.ndarray, nprobe: int, beyond: bool) -> DataFrame:
    """As :func:`_visits`. ``beyond`` names every list that can reach the bound, those of the first round too."""
    upper = _visits(queries, tree.tops, top_reach, 1, beyond, again=True).withColumnRenamed("list_id", "top_id")
    names = upper.columns
    shared = queries.sparkSession.sparkContext.broadcast(reach)

    def route(part: pa.RecordBatch, numbers: np.ndarray, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
        cosines = np.clip(_unit(_matrix(part.column("embedding"))) @ pivots.T, -1.0, 1.0)
        radius = shared.value[numbers]
        near = _near(part, np.where(np.isfinite(radius)[None, :], cosines, -2.0), radius, nprobe, beyond, again=True)
        yield from _copies(part, near & np.isfinite(radius)[None, :], numbers)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in upper.schema)
    stream, meet = _at_branches(upper, tree, route)
    return stream.mapInArrow(meet, f"{fields}, list_id int").select(*[c for c in names if c != "top_id"], "list_id")


# --- the search ----------------------------------------------------------------------------


REQUEST = ["news_id", "k", "category_filter"]
QUERY = ["space", "key_a", "key_b"]


def _distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(space, embedding, ids): one row per distinct vector, with its ``keep`` lowest ids in order.

    The row limit runs before the exchange as well, so a third of all rows being
    copies of one vector costs each map task ``keep`` rows.
    """
    nonzero = rows.where(F.exists("embedding", lambda x: x != 0)).select("*", *_vector_key())
    rank = F.row_number().over(Window.partitionBy(*QUERY).orderBy("news_id"))
    lowest = nonzero.withColumn("_rank", rank).where(F.col("_rank") <= keep)
    # Grouped by the window's own columns, so that one exchange serves both.
    return lowest.groupBy(*QUERY).agg(
        F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("news_id")).alias("ids")
    ).drop("key_a", "key_b")


def _vector_key() -> list[Column]:
    """128 bits that stand for a vector in groupings and joins, so that it need not be compared or carried."""
    return [F.xxhash64("embedding").alias("key_a"), F.xxhash64(F.lit("b"), "embedding").alias("key_b")]


def _near(part: pa.RecordBatch, cosines: np.ndarray, radius: np.ndarray, nprobe: int, beyond: bool, stop: float = 0.0, again: bool = False) -> np.ndarray:
    """Which of the lists each query visits, see :func:`_visits`."""
    near = np.zeros(cosines.shape, dtype=bool)
    first = np.argsort(-cosines, axis=1, kind="stable")[:, :nprobe]
    np.put_along_axis(near, first, True, axis=1)
    if stop > 0.0:
        angles = np.arccos(np.clip(cosines, -1.0, 1.0))
        near |= angles <= angles.min(axis=1, keepdims=True) + stop
    if beyond:
        gap = np.maximum(np.arccos(np.clip(cosines, -1.0, 1.0)) - radius[None, :], 0.0)
        bound = part.column("bound").to_numpy(zero_copy_only=False)
        open_ = np.cos(np.minimum(gap, np.pi)) + SLACK >= bound[:, None]
        near = open_ if again else ~near & open_
    return near


def _copies(part: pa.RecordBatch, near: np.ndarray, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    row, visited = np.nonzero(near)
    # A query may visit every list, so its copies leave in pieces.
    for start in range(0, len(row), VISITS_PER_BATCH):
        piece = slice(start, start + VISITS_PER_BATCH)
        copies = part.take(pa.array(row[piece]))
        yield pa.RecordBatch.from_arrays(copies.columns + [pa.array(numbers[visited[piece]], pa.int32())], part.schema.names + ["list_id"])


def _visits(
    queries: DataFrame, pivots: np.ndarray, reach: np.ndarray, nprobe: int, beyond: bool, stop: float = 0.0, again: bool = False
) -> DataFrame:
    """One row per query and list to visit.

    First round: the ``nprobe`` nearest lists, and all that are at most ``stop``
    radians farther than the nearest. ``beyond``: every other list whose best
    possible score reaches the query's ``bound``; with ``again``, not only others.
    """
    shared = queries.sparkSession.sparkContext.broadcast((pivots, reach))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius = shared.value
        for batch in batches:
            for part in _blocks(batch, QUERIES_PER_PRODUCT):
                cosines = np.clip(_unit(_matrix(part.column("embedding"))) @ centres.T, -1.0, 1.0)
                used = np.isfinite(radius)[None, :]
                near = _near(part, np.where(used, cosines, -2.0), radius, nprobe, beyond, stop, again)
                yield from _copies(part, near & used, np.arange(len(centres)))

    return queries.mapInArrow(route, f"{fields}, list_id int")


def _grid(candidates: Column, requests: Column, rows_per_tile: int, share: Column | None = None) -> list[Column]:
    """Into how many tiles the candidates of a set go and into how many chunks its requests, from their numbers.

    Sets that are searched together divide the cells by their ``share`` of the pairs.
    """

    def pieces(n: Column, size: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / size)).cast("int")

    cells = F.lit(CELLS) if share is None else F.ceil(F.lit(CELLS) * share).cast("int")
    chunks = F.greatest(F.least(pieces(requests, MIN_CHUNK), cells), pieces(requests, MAX_CHUNK))
    tiles = F.least(F.greatest(F.lit(1), F.floor(cells / chunks)).cast("int"), pieces(candidates, rows_per_tile))
    return [tiles.alias("tiles"), chunks.alias("chunks")]


@dataclass(frozen=True)
class _Route:
    """Which lists a query visits, see :func:`_visits`; without pivots those named in its column ``lists``, or all if there is none."""

    pivots: np.ndarray | None = None
    reach: np.ndarray | None = None
    nprobe: int = 1
    beyond: bool = False
    stop: float = 0.0
    #: Whether an id stands in a query's list once, or as often as there are rows of it.
    once: bool = False


def _score(queries: DataFrame, candidates: DataFrame, grid: DataFrame, keep: int, floor: float, route: _Route, bounds: bool = False) -> DataFrame:
    """(space, key_a, key_b, ids, scores): the best ids per query and tile, as many as its ``keep``, in one row.

    With ``bounds`` it is (space, key_a, key_b, n, scores): of how many vectors, up to
    ``keep``, the scores are known; the least one where they are all in one tile.
    ``grid`` has tiles and chunks per space, or for all alike.
    """
    if "space" in grid.columns:
        candidates, queries = candidates.join(grid, "space"), queries.join(grid, "space")
    else:
        sizes = grid.first()
        numbers = [F.lit(sizes[c]).alias(c) for c in ("tiles", "chunks")]
        candidates, queries = candidates.select("*", *numbers), queries.select("*", *numbers)

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def slot(value: Column, n: str) -> Column:
        return F.pmod(F.xxhash64(value), F.col(n)).cast("int")

    named = F.col("lists") if "lists" in queries.columns else F.lit(None).cast("array<int>").alias("lists")
    # A query goes to one chunk, once per tile; a candidate to one tile, once per chunk.
    asking = (
        queries.withColumn("chunk", slot(F.col("key_a"), "chunks"))
        .withColumn("tile", every("tiles"))
        .select("space", "tile", "chunk", F.lit(0).alias("side"), F.lit(-1).alias("list_id"),
                F.lit(None).cast("array<bigint>").alias("ids"), "embedding", "key_a", "key_b", "bound", named, "keep", (F.col("tiles") == 1).alias("whole"))
    )
    tiled = (
        candidates.withColumn("tile", slot(F.col("ids")[0], "tiles"))
        .withColumn("chunk", every("chunks"))
        .select("space", "tile", "chunk", F.lit(1).alias("side"), "list_id", "ids", "embedding",
                F.lit(None).cast("bigint").alias("key_a"), F.lit(None).cast("bigint").alias("key_b"),
                F.lit(None).cast("double").alias("bound"), F.lit(None).cast("array<int>").alias("lists"),
                F.lit(None).cast("int").alias("keep"), F.lit(None).cast("boolean").alias("whole"))
    )
    cell = ["space", "tile", "chunk"]
    stream = asking.unionByName(tiled).repartition(*cell).sortWithinPartitions(*cell, "side", "list_id")
    shared = queries.sparkSession.sparkContext.broadcast(route)

    def score_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, asked = None, [], None
        for batch in batches:
            for here, side, number, rows in _runs(batch):
                if here != current:
                    if asked is not None:
                        yield from asked.bounds() if bounds else asked.packed()
                    current, parts, asked = here, [], None
                if side == 0:
                    parts.append(rows)
                elif parts or asked is not None:
                    if asked is None:
                        asked, parts = _Asked(parts, keep, floor, shared.value), []
                    asked.meet(number, rows)
        if asked is not None:
            yield from asked.bounds() if bounds else asked.packed()

    made = "n bigint, scores array<double>" if bounds else "ids array<bigint>, scores array<double>"
    return stream.mapInArrow(score_cells, f"space string, key_a bigint, key_b bigint, {made}")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int, pa.RecordBatch]]:
    """Cut a sorted batch where the cell, the side or the list changes."""
    if batch.num_rows == 0:
        return
    space = batch.column("space").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    rest = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "chunk", "side", "list_id")]
    marks = np.stack([space, *rest]).astype(np.int64)
    edges = np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1
    for start, stop in zip([0, *edges], [*edges, batch.num_rows]):
        cell = (batch.column("space")[int(start)].as_py(), *(int(c[start]) for c in rest[:2]))
        yield cell, int(rest[2][start]), int(rest[3][start]), batch.slice(int(start), int(stop - start))


class _Asked:
    """The queries of a chunk and the best ``keep`` vectors that each has met, or fewer if it says so.

    Single precision finds who can be among them, double precision decides. The
    rough scores are off by less than ``error``, so nothing is missed.
    """

    def __init__(self, parts: list[pa.RecordBatch], keep: int, floor: float, route: _Route):
        rows = pa.Table.from_batches(parts).combine_chunks()
        self.keys, self.keep, self.floor = rows.select(QUERY), keep, floor
        self.limit, self.whole, self.once = np.full(rows.num_rows, keep), False, route.once
        if "keep" in rows.column_names:
            self.limit, self.whole = rows.column("keep").to_numpy().astype(np.int64), rows.column("whole")[0].as_py()
        self.exact = _unit(np.concatenate([_matrix(p.column("embedding")) for p in parts]))
        self.rough = self.exact.astype(np.float32)
        self.error = (self.exact.shape[1] + 16) * 2.0**-24 + 10.0**-RANK_DIGITS
        self.needed = rows.column("bound").to_numpy().astype(np.float64)
        n = len(self.exact)
        self.score, self.first = np.full((n, keep), -np.inf), np.zeros((n, keep), np.int64)
        self.ref, self.n = np.zeros((n, keep), np.int64), np.zeros(n, np.int64)
        # The id lists of the vectors that ``ref`` names.
        self.pool, self.pooled = [], 0
        self.visiting = self._lists(parts, route)

    def _lists(self, parts: list[pa.RecordBatch], route: _Route) -> Callable[[int], np.ndarray]:
        """The queries that visit a list."""
        n = len(self.exact)
        if route.pivots is None:
            lists = pa.concat_arrays([p.column("lists") for p in parts])
            if lists.null_count:
                return lambda number: np.arange(n)
            named = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((row, named))
            named, row = named[order], row[order]
            return lambda number: np.unique(row[slice(*np.searchsorted(named, [number, number + 1]))])
        bits = []
        bound = pa.array(self.needed)
        for start in range(0, n, QUERIES_PER_PRODUCT):
            some = slice(start, start + QUERIES_PER_PRODUCT)
            cosines = np.clip(self.exact[some] @ route.pivots.T, -1.0, 1.0)
            used = np.isfinite(route.reach)[None, :]
            part = pa.RecordBatch.from_arrays([bound[some]], ["bound"])
            near = _near(part, np.where(used, cosines, -2.0), route.reach, route.nprobe, route.beyond, route.stop, again=True) & used
            bits.append(np.packbits(near, axis=1).T)
        packed = np.concatenate(bits, axis=1)
        return lambda number: np.flatnonzero(packed[number >> 3] & (128 >> (number & 7)))

    def meet(self, number: int, rows: pa.RecordBatch) -> None:
        """Let the queries that visit a list meet some vectors of it."""
        asking = self.visiting(number)
        if not len(asking):
            return
        vectors, ids = _unit(_matrix(rows.column("embedding"))), rows.column("ids")
        lengths = ids.value_lengths().to_numpy(zero_copy_only=False)
        firsts = ids.flatten().to_numpy(zero_copy_only=False)[np.cumsum(lengths) - lengths]
        rough = np.ascontiguousarray(vectors.T, dtype=np.float32)
        for start in range(0, len(asking), QUERIES_PER_PRODUCT):
            at = asking[start : start + QUERIES_PER_PRODUCT]
            scores = self.rough[at] @ rough
            if len(vectors) > self.keep:
                # The keep-th best of these vectors is a lower bound, too.
                open_ = np.flatnonzero(self.n[at] < self.limit[at])
                if len(open_):
                    worst = len(vectors) - self.keep
                    reached = np.partition(scores[open_], worst, axis=1)[:, worst].astype(np.float64) - self.error
                    self.needed[at[open_]] = np.maximum(self.needed[at[open_]], reached)
            least = (self.needed[at] - 2 * self.error).astype(np.float32)
            row, col = np.divmod(np.flatnonzero(scores >= least[:, None]), scores.shape[1])
            if len(row):
                row = at[row]
                exact = np.concatenate([np.einsum("ij,ij->i", self.exact[row[p]], vectors[col[p]]) for p in _pieces(len(row))])
                good = exact >= self.floor
                self._merge(row[good], exact[good], firsts, col[good], ids)

    def _merge(self, row: np.ndarray, exact: np.ndarray, firsts: np.ndarray, col: np.ndarray, ids: pa.Array) -> None:
        if not len(row):
            return
        used, own = np.unique(col, return_inverse=True)
        hit = np.unique(row)
        old_row, old_col = np.nonzero(np.arange(self.keep) < self.n[hit][:, None])
        old_row = hit[old_row]
        row = np.concatenate([old_row, row])
        exact = np.concatenate([self.score[old_row, old_col], exact])
        first = np.concatenate([self.first[old_row, old_col], firsts[col]])
        ref = np.concatenate([self.ref[old_row, old_col], own + self.pooled])
        self.pool.append(ids.take(pa.array(used)))
        self.pooled += len(used)
        ranked = np.round(exact, RANK_DIGITS)
        order = np.lexsort((first, -ranked, row))
        row, exact, first, ref, ranked = row[order], exact[order], first[order], ref[order], ranked[order]
        # A vector that is filed under several lists is met again.
        new = np.r_[True, (row[1:] != row[:-1]) | (first[1:] != first[:-1])]
        row, exact, first, ref, ranked = row[new], exact[new], first[new], ref[new], ranked[new]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        best = place < self.limit[row]
        row, place = row[best], place[best]
        self.score[row, place], self.first[row, place], self.ref[row, place] = exact[best], first[best], ref[best]
        self.n[hit] = np.bincount(np.searchsorted(hit, row), minlength=len(hit))
        full = place == self.limit[row] - 1
        self.needed[row[full]] = np.maximum(self.needed[row[full]], ranked[best][full])
        if self.pooled > 2 * self.ref.size + (1 << 16):
            self._shrink()

    def _shrink(self) -> None:
        """Forget the id lists that no query needs any more."""
        held = np.arange(self.keep) < self.n[:, None]
        used, at = np.unique(self.ref[held], return_inverse=True)
        self.pool = [pa.concat_arrays(self.pool).take(pa.array(used))]
        self.ref[held], self.pooled = at, len(used)

    def found(self) -> Iterator[pa.RecordBatch]:
        """The best vectors of each query; a query, by its number here, is in one batch."""
        if not self.pool:
            return
        ids = pa.concat_arrays(self.pool)
        asking = np.flatnonzero(self.n)
        for p in _pieces(len(asking), QUERIES_PER_BATCH):
            some = asking[p]
            at, place = np.nonzero(np.arange(self.keep) < self.n[some][:, None])
            columns = [c.combine_chunks() for c in self.keys.take(pa.array(some[at])).columns]
            columns += [ids.take(pa.array(self.ref[some][at, place])), pa.array(self.score[some][at, place]), pa.array(some[at])]
            yield pa.RecordBatch.from_arrays(columns, [*QUERY, "ids", "score", "query"])

    def packed(self) -> Iterator[pa.RecordBatch]:
        """The same as a row per query, by ids instead of vectors."""
        for rows in self.found():
            some, at = np.unique(rows.column("query").to_numpy(), return_inverse=True)
            lists = rows.column("ids")
            times = lists.value_lengths().to_numpy(zero_copy_only=False)
            one, score, at = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(rows.column("score").to_numpy(), times), np.repeat(at, times)
            if self.once:
                order = np.lexsort((-score, one, at))
                order = order[np.r_[True, (np.diff(at[order]) != 0) | (np.diff(one[order]) != 0)]]
                one, score, at = one[order], score[order], at[order]
            order = np.lexsort((one, -np.round(score, RANK_DIGITS), at))
            one, score, at = one[order], score[order], at[order]
            best = np.arange(len(at)) - np.searchsorted(at, at, side="left") < self.limit[some][at]
            yield self._rows(some, at[best], [("ids", one[best])], score[best])

    def bounds(self) -> Iterator[pa.RecordBatch]:
        """How many vectors each query has met, and their scores; where it meets no others elsewhere, the least, once it has enough."""
        asking = np.flatnonzero(self.n == self.limit if self.whole else self.n)
        for p in _pieces(len(asking), QUERIES_PER_BATCH):
            some = asking[p]
            known = np.arange(self.keep) < self.n[some][:, None]
            if self.whole:
                yield self._rows(some, np.arange(len(some)), [], np.where(known, self.score[some], np.inf).min(axis=1))
            else:
                yield self._rows(some, np.nonzero(known)[0], [], self.score[some][known])

    def _rows(self, some: np.ndarray, at: np.ndarray, named: list, score: np.ndarray) -> pa.RecordBatch:
        """A row per query with lists of what stands ``at`` its place."""
        ends = pa.array(np.searchsorted(at, np.arange(len(some) + 1)), pa.int32())
        columns = [c.combine_chunks() for c in self.keys.take(pa.array(some)).columns]
        columns += [pa.ListArray.from_arrays(ends, pa.array(v)) for _, v in named] or [pa.array(self.n[some])]
        columns.append(pa.ListArray.from_arrays(ends, pa.array(score)))
        return pa.RecordBatch.from_arrays(columns, [*QUERY, *([n for n, _ in named] or ["n"]), "scores"])


def _pieces(n: int, size: int = 1 << 16) -> Iterator[slice]:
    for start in range(0, n, size):
        yield slice(start, min(n, start + size))


def _search(
    requests: DataFrame,
    candidates: DataFrame,
    pivots: np.ndarray | PivotTree,
    nprobe: int,
    exact: bool,
    max_k: int,
    grid: DataFrame,
    copies: int,
    spill: int = 1,
    stop: float = 0.0,
) -> DataFrame:
    """(news_id, k, category_filter, rank, match_id, score) for requests with ``space`` and ``embedding``."""
    spark = requests.sparkSession
    shared_dir(spark)  # makes checkpoint() usable
    ship_package(spark)
    keep = max_k + 1  # one more, because the article itself is dropped at the end
    if "space" in grid.columns:
        grid = grid.checkpoint()  # one row per set, read in every round
    tiles = grid.agg(F.coalesce(F.max("tiles"), F.lit(1)).alias("tiles")).first()["tiles"]
    distinct = _distinct_vectors(candidates, keep)
    usable = F.exists("embedding", lambda x: x != 0)
    keyed = requests.where(usable).select(*REQUEST, "space", "embedding", *_vector_key())
    # A query keeps what its own requests need, besides the rows of the article itself: at most ``copies``.
    own = F.least(F.lit(keep), F.col("k") + copies).cast("int").alias("keep")
    largest = F.row_number().over(Window.partitionBy(*QUERY).orderBy(F.col("k").desc(), "news_id"))
    vectors = keyed.withColumn("_rank", largest).where("_rank <= 1").select(*QUERY, "embedding", own)
    queries = vectors.withColumn("bound", F.lit(SCORE_FLOOR))

    if len(pivots) <= 1:
        only = F.lit(0).alias("list_id")
        found = _score(queries, distinct.select("*", only), grid, keep, SCORE_FLOOR, _Route(once=spill > 1))
    else:
        tree = isinstance(pivots, PivotTree)
        # Lists are read for their radius, by both rounds and for their counts.
        if tree:
            listed = stored(_with_list_by_tree(distinct, pivots), "listed")
            top_reach = _radii(listed, "top_id", "top_cosine", len(pivots.tops))
        else:
            listed = stored(with_lists(distinct, pivots, spill) if spill > 1 else with_list(distinct, pivots), "listed")
        reach = _radii(listed, "list_id", "pivot_cosine", len(pivots))

        def scored(asking: DataFrame, beyond: bool, bounds: bool = False) -> DataFrame:
            if not tree:
                return _score(asking, listed, grid, keep, SCORE_FLOOR, _Route(pivots, reach, nprobe, beyond, stop, spill > 1), bounds)
            visits = _visits_by_tree(asking, pivots, top_reach, reach, nprobe, beyond)
            lists = visits.groupBy(*QUERY).agg(F.collect_list("list_id").alias("lists"))
            return _score(asking.join(lists, QUERY), listed, grid, keep, SCORE_FLOOR, _Route(once=beyond), bounds)

        further = exact and int(np.isfinite(reach).sum()) > nprobe
        if further:
            # The first round only says how good the worst of the best must be. What is found, the second finds.
            known = stored(scored(queries, beyond=False, bounds=True), "bounds").groupBy(*QUERY)
            known = known.agg(F.sum("n").alias("n"), F.sort_array(F.flatten(F.collect_list("scores")), asc=False).alias("scores"))
            least = F.element_at("scores", F.least("keep", F.size("scores")))
            bound = F.when(F.col("n") >= F.col("keep"), least).otherwise(F.lit(SCORE_FLOOR))
            queries = vectors.join(known, QUERY, "left").select(*vectors.columns, bound.alias("bound"))
        found = scored(queries, beyond=further)
        spill = 2 if tree and further else spill

    # One list per distinct query vector, then one per request.
    zipped = F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("score"))
    order = (-F.rint(F.col("m.score") * 10.0**RANK_DIGITS)).alias("order")
    if spill > 1 or tiles > 1:
        pairs = found.select(*QUERY, F.explode(zipped).alias("m")).select(*QUERY, order, "m.id", "m.score")
        if spill > 1:
            pairs = pairs.groupBy(*QUERY, "id").agg(F.min("order").alias("order"), F.max("score").alias("score"))
        gathered = F.sort_array(F.collect_list(F.struct("order", "id", "score")))
        lists = pairs.groupBy(*QUERY).agg(F.slice(gathered, 1, keep).alias("matches"))
        asked = keyed.select(*REQUEST, *QUERY).join(lists, QUERY)
    else:
        # Zipped after the exchange: apart, the lists are shorter.
        asked = with_evaluated(keyed.select(*REQUEST, *QUERY).join(found, QUERY), "matches", zipped)
    others = F.filter("matches", lambda m: m["id"] != F.col("news_id"))
    top = asked.select(*REQUEST, F.posexplode(F.slice(others, 1, F.col("k"))).alias("_pos", "m"))
    return top.select(
        *REQUEST,
        (F.col("_pos") + 1).alias("rank"),
        F.col("m.id").alias("match_id"),
        F.col("m.score").alias("score"),
    )


def _radii(listed: DataFrame, name: str, cosine: str, n: int) -> np.ndarray:
    """The largest angle between a list's pivot and its vectors, one number per list; nan for an empty list."""
    reach = np.full(n, np.nan)
    for row in listed.groupBy(name).agg(F.min(cosine).alias("c")).collect():
        reach[row[name]] = np.arccos(np.clip(row["c"], -1.0, 1.0)) + SLACK
    return reach


def _with_details(matches: DataFrame, index: DataFrame) -> DataFrame:
    details = index.select(F.col("news_id").alias("match_id"), "title", "category")
    return matches.join(details, "match_id").select(
        F.col("news_id").alias("source_news_id"),
        "k",
        "category_filter",
        "rank",
        F.col("match_id").alias("news_id"),
        "title",
        "category",
        F.round("score", 4).alias("similarity_score"),
    )


def _spaces(requests: DataFrame, index: DataFrame, unfiltered: bool, filtered: bool) -> tuple[DataFrame, DataFrame]:
    """Tag requests and candidates with the candidate set they belong to: everything, or one category.

    Candidates are doubled only if both kinds of request are present.
    """
    every, own = F.lit("*"), F.concat(F.lit("="), F.col("category"))
    space = F.when(F.col("category_filter").isNull(), every).otherwise(F.concat(F.lit("="), F.col("category_filter")))
    if unfiltered and filtered:
        tag = F.explode(F.array(every, own))
    else:
        tag = own if filtered else every
    if not unfiltered:
        # Only the categories asked for; with a table partitioned by category, only their files.
        wanted = requests.select(F.col("category_filter").alias("category")).distinct()
        index = index.join(wanted, "category", "left_semi")
    return requests.withColumn("space", space), index.select("news_id", "embedding", tag.alias("space"))


def default_lists(n_rows: int, n_spaces: int, rows_per_tile: int) -> int:
    """About one tile per list and candidate set, and no more lists than the root of the rows: those are broadcast."""
    return max(1, min(-(-n_rows // (max(1, n_spaces) * rows_per_tile)), math.isqrt(n_rows)))


def top_k(
    requests: DataFrame,
    index: DataFrame,
    n_lists: int | None = None,
    nprobe: int = 8,
    rows_per_tile: int = ROWS_PER_TILE,
    details: bool = True,
    levels: int | None = None,
    among: DataFrame | None = None,
) -> DataFrame:
    """Exact top k per request (news_id, k, category_filter); a null filter searches everything.

    Requests that are invalid or whose source is not indexed yield no rows.
    ``levels`` of pivots follow from their size unless given. With ``among``, only
    these rows are candidates, while the sources are still those of ``index``.
    """
    return _top_k(requests, index, None, n_lists, nprobe, rows_per_tile, True, details, levels=levels, among=among)


def top_k_approximate(
    requests: DataFrame,
    index: DataFrame,
    centres: np.ndarray,
    nprobe: int = 4,
    rows_per_tile: int = ROWS_PER_TILE,
    details: bool = True,
    spill: int = 2,
    stop: float = STOP,
) -> DataFrame:
    """Top k from lists near each source; scores are exact, members may be missed.

    Each vector is filed under ``spill`` lists. A request visits at least ``nprobe``
    lists, and all up to ``stop`` radians farther than the nearest: many where lists
    are about equally near, few where one stands out.
    """
    return _top_k(requests, index, centres, None, nprobe, rows_per_tile, False, details, spill=spill, stop=stop)


def scored_share(requests: DataFrame, index: DataFrame, centres: np.ndarray, nprobe: int = 4, spill: int = 2, stop: float = STOP) -> DataFrame:
    """(n_lists, lists_visited, scored_share): per request on average, the lists and the share of vectors that are scored."""
    ship_package(index.sparkSession)
    usable = index.where(F.exists("embedding", lambda x: x != 0))
    filed = with_lists(usable.select("news_id", "embedding"), centres, spill).groupBy("list_id").agg(F.count("*").alias("rows"))
    asked = requests.select("news_id").distinct().join(usable, "news_id").select("news_id", "embedding")
    went = _visits(asked, centres, np.zeros(len(centres)), nprobe, False, stop).groupBy("list_id").agg(F.count("*").alias("visits"))
    sizes = usable.agg(F.count("*").alias("vectors")).crossJoin(asked.agg(F.count("*").alias("requests")))
    sums = went.join(filed, "list_id").agg(F.sum("visits").alias("visits"), F.sum(F.col("visits") * F.col("rows")).alias("scored"))
    return sums.crossJoin(sizes).select(
        F.lit(len(centres)).alias("n_lists"),
        (F.col("visits") / F.col("requests")).alias("lists_visited"),
        (F.col("scored") / F.col("requests") / F.col("vectors")).alias("scored_share"),
    )


def _top_k(
    requests: DataFrame,
    index: DataFrame,
    pivots: np.ndarray | None,
    n_lists: int | None,
    nprobe: int,
    rows_per_tile: int,
    exact: bool,
    details: bool,
    spill: int = 1,
    stop: float = 0.0,
    levels: int | None = None,
    among: DataFrame | None = None,
) -> DataFrame:
    sources, index = index, index if among is None else among
    checked = check_requests(requests).where("status = 'ok'")
    no_filter = F.col("category_filter").isNull()
    shape = checked.agg(
        F.approx_count_distinct("news_id").alias("sources"),
        F.coalesce(F.max("k"), F.lit(MIN_K)).alias("max_k"),
        F.coalesce(F.bool_or(no_filter), F.lit(True)).alias("unfiltered"),
        F.coalesce(F.bool_or(~no_filter), F.lit(False)).alias("filtered"),
    ).first()
    tagged, candidates = _spaces(checked, index, shape["unfiltered"], shape["filtered"])
    asked = with_source(tagged, sources).where("status = 'ok'")
    copies = index.groupBy("news_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("n")).first()["n"]
    n_sets = F.lit(1) if shape["unfiltered"] else F.approx_count_distinct("category")
    size = index.agg(F.count("*").alias("n"), n_sets.alias("sets")).first()
    if pivots is None:
        if n_lists is None:
            n_lists = default_lists(size["n"], size["sets"], rows_per_tile)
        pivots = choose_pivots(index, n_lists, levels) if n_lists > 1 else np.empty((0, 0))
    # The sizes come from plain counts, before any vector is touched.
    if shape["filtered"]:
        given = candidates.groupBy("space").agg(F.count("*").alias("_candidates"))
        wanted = tagged.select("space", "news_id").distinct().groupBy("space").agg(F.count("*").alias("_requests"))
        pairs = F.col("_candidates").cast("double") * F.col("_requests")
        share = pairs / F.sum(pairs).over(Window.partitionBy(F.lit(0)))
        sized = given.join(wanted, "space").withColumn("_share", share)
        grid = sized.select("space", *_grid(F.col("_candidates"), F.col("_requests"), rows_per_tile, F.col("_share")))
    else:
        grid = index.sparkSession.range(1).select(*_grid(F.lit(size["n"]), F.lit(shape["sources"]), rows_per_tile))
    found = _search(asked, candidates, pivots, nprobe, exact, shape["max_k"], grid, copies, spill, stop)
    return _with_details(found, index) if details else found


def all_requests(index: DataFrame, k: int = DEFAULT_K, same_category: bool = False) -> DataFrame:
    """One request per indexed article."""
    scope = F.col("category") if same_category else F.lit(None).cast("string")
    return index.select("news_id", F.lit(k).alias("k"), scope.alias("category_filter"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true matches that were found, over all sources."""
    hits = truth.select("source_news_id", "news_id").join(
        found.select("source_news_id", "news_id", F.lit(1).alias("hit")), ["source_news_id", "news_id"], "left"
    )
    return hits.agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))
