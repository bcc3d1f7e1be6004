"""Sentence weights, centrality and ranking within each document.

Everything here is keyed by document. :func:`split_documents` sends each text
once to the task that owns its ``doc_id``; all later groupings and windows have
``doc_id`` among their keys, so Spark adds no further exchange. ``doc_id`` must
be unique and not null, see :func:`newsloom.operators.constraints.keep_one_per_key`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.columns import with_evaluated
from newsloom.functions.text import clean_sentences, clean_text, terms
from newsloom.functions.vectors import dot
from newsloom.operators.embedding import Embedder
from newsloom.session import bound_batches, ship_package

SCORE_DIGITS = 9
LOWER_INDEX_FIRST, HIGHER_INDEX_FIRST = "lower", "higher"


def with_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, cleaned, sentences, n_sentences), without a shuffle."""
    cleaned = docs.select("doc_id", clean_text(F.col("text")).alias("cleaned"))
    split = with_evaluated(cleaned, "sentences", clean_sentences(F.col("cleaned")))
    return split.withColumn("n_sentences", F.size("sentences"))


def split_documents(docs: DataFrame) -> DataFrame:
    """:func:`with_sentences`, with each document placed by its id.

    The text is split below the exchange, which carries the sentences, so users
    that share the exchange share the splitting. The null filter is one Spark
    would add to some users of the result and not to others; stating it keeps the
    exchange identical, so that it is reused.
    """
    return with_sentences(docs.where("doc_id is not null")).drop("cleaned").repartition("doc_id")


def explode_sentences(split: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, idx, sentence).

    The outer form, because Spark would otherwise push a filter on the size of
    the array, regular expressions and all, down below the exchange. The filter
    reads ``n_sentences`` so that every user asks the exchange for the same
    columns, and is wrapped so that no null check on it is moved below.
    """
    exploded = split.select("doc_id", "n_sentences", F.posexplode_outer("sentences").alias("idx", "sentence"))
    return exploded.where(F.coalesce(F.col("idx") < F.col("n_sentences"), F.lit(False)))


def _by(*keys: str) -> Window:
    """A window over ``keys`` that sorts on their hash first.

    The hash decides nearly every comparison on its 8-byte prefix; the keys
    themselves are still compared, so hash collisions do not matter.
    """
    return Window.partitionBy(F.xxhash64(*keys), *keys)


CELL = "array<struct<n_sentences:int,idx:int,term:string,tf:bigint,df:bigint,idf:double,weight:double,sentence_score:double>>"
TERMS_PER_BLOCK = 1 << 18


def tfidf_weights(sentences: DataFrame) -> DataFrame:
    """Unit-length TF-IDF rows (doc_id, n_sentences, idx, term, tf), where a document's own sentences are the corpus.

    Adds ``df``, ``idf = ln((1 + n) / (1 + df)) + 1``, the L2-normalised ``weight`` and, on
    one row of each sentence, ``sentence_score``, see :func:`sparse_centrality`. A sentence
    without terms keeps one row with a null term. The sentences of a document are gathered
    where they are and weighed together, so there is no exchange, sort or window over terms.
    """
    row = F.struct(F.col("n_sentences").cast("int").alias("n"), F.col("idx").cast("int").alias("idx"), terms(F.col("sentence")).alias("terms"))
    gathered = sentences.groupBy("doc_id").agg(F.collect_list(row).alias("_rows"))
    ship_package(sentences.sparkSession)
    bound_batches(sentences.sparkSession)

    @F.arrow_udf(CELL)
    def weighed(rows: pa.Array) -> pa.Array:
        return _in_blocks(rows, rows, rows.flatten().field("terms"), _tfidf_cells)

    cells = gathered.select("doc_id", F.explode(weighed("_rows")).alias("_cell"))
    made = cells.select("doc_id", "_cell.*")
    made._gathered = gathered
    return made


def _in_blocks(documents: pa.Array, rows: pa.Array, terms: pa.Array | None, function: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``function`` of some documents at a time, which bounds what it needs.

    ``rows`` are the documents' lists; about ``TERMS_PER_BLOCK`` of the terms of their rows, or of the rows, go together.
    """
    ends = np.cumsum(_lengths(rows))
    if terms is not None:
        ends = np.r_[0, np.cumsum(_lengths(terms))][ends]
    cuts = np.r_[0, np.flatnonzero(np.diff(ends // TERMS_PER_BLOCK)) + 1, len(documents)]
    return pa.concat_arrays([function(documents.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:])])


def _tfidf_cells(rows: pa.Array) -> pa.Array:
    """Per document the cells of :func:`tfidf_weights`, from lists of (n, idx, terms)."""
    flat = rows.flatten()
    doc = np.repeat(np.arange(len(rows)), _lengths(rows))
    n, idx = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "idx"))
    # Rows of one document with equal numbers are one sentence; all with one idx share a norm.
    width = int(idx.max(initial=0)) + 1
    place, held = np.unique(doc * width + idx, return_inverse=True)
    height = int(n.max(initial=0)) + 1
    sentence, own = np.unique(held * height + n, return_inverse=True)
    norm_of, n_of = sentence // height, sentence % height
    doc_of, idx_of = place[norm_of] // width, place[norm_of] % width
    m, words = _lengths(flat.field("terms")), flat.field("terms").flatten().dictionary_encode()
    none = len(words.dictionary)
    size = none + 1
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cells, tf = np.unique(np.concatenate([np.repeat(own, m) * size + codes, own[m == 0] * size + none]), return_counts=True)
    row, code = cells // size, cells % size
    doc = doc_of[row]
    _, term, df = np.unique(doc * size + code, return_inverse=True, return_counts=True)
    tf = np.where(code == none, 0, tf)
    df = np.where(code == none, 0, df[term])
    idf = np.log((1.0 + n_of[row]) / (1.0 + df)) + 1.0
    raw = tf * idf
    norm = np.sqrt(np.bincount(norm_of[row], raw * raw, len(place)))[norm_of[row]]
    weight = np.divide(raw, norm, out=np.zeros(len(raw)), where=norm > 0)
    # u_i.u_j summed over j is u_i.(the sum of all u_j): a total per term is enough.
    score = np.bincount(norm_of[row], weight * np.bincount(term, weight)[term], len(place))
    first = np.r_[True, norm_of[row][1:] != norm_of[row][:-1]] if len(row) else np.zeros(0, bool)
    text = words.dictionary.take(pa.array(code, mask=code == none))
    columns = [n_of[row].astype(np.int32), idx_of[row].astype(np.int32), text, tf, df, idf, weight]
    names = ["n_sentences", "idx", "term", "tf", "df", "idf", "weight", "sentence_score"]
    arrays = [*[pa.array(c) for c in columns], pa.array(score[norm_of[row]], mask=~first)]
    return pa.ListArray.from_arrays(_offsets(doc, len(rows)), pa.StructArray.from_arrays(arrays, names))


def _offsets(doc: np.ndarray, n: int) -> pa.Array:
    """Where the cells of each of ``n`` documents begin, from the ascending document of each cell."""
    return pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))


def sparse_centrality(weights: DataFrame) -> DataFrame:
    """Row sums of each document's sentence similarity matrix, self included.

    The sum over j of u_i.u_j equals u_i.(sum over j of u_j), so one total per
    (document, term) is enough and no sentence pair is formed. The rows of
    :func:`tfidf_weights` carry the sums, made where the documents are; weights from
    elsewhere are summed here.
    """
    if "sentence_score" in weights.columns:
        return weights.where("sentence_score is not null").select("doc_id", "idx", F.round("sentence_score", SCORE_DIGITS).alias("score"))
    totals = weights.withColumn("_total", F.sum("weight").over(_by("doc_id", "term")))
    score = F.round(F.sum(F.col("weight") * F.col("_total")), SCORE_DIGITS)
    return totals.groupBy("doc_id", "idx").agg(score.alias("score"))


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _tfidf_centrality(terms: pa.Array) -> np.ndarray:
    """One score per sentence of some documents, each a list of sentences, each a list of terms."""
    n, sentences = _lengths(terms), terms.flatten()
    m = _lengths(sentences)
    words = sentences.flatten().dictionary_encode()
    size = max(1, len(words.dictionary))
    # One cell per (sentence, term), then its place among the (document, term).
    cells, tf = np.unique(np.repeat(np.arange(len(m)), m) * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row = cells // size
    doc = np.repeat(np.arange(len(n)), n)[row]
    _, place, df = np.unique(doc * size + cells % size, return_inverse=True, return_counts=True)
    raw = tf * (np.log((1.0 + n[doc]) / (1.0 + df[place])) + 1.0)
    weight = raw / np.sqrt(np.bincount(row, raw * raw, len(m)))[row]
    return np.bincount(row, weight * np.bincount(place, weight)[place], len(m))


def with_tfidf_scores(split: DataFrame, block: int = 1 << 20) -> DataFrame:
    """:func:`sparse_centrality` of whole documents as an array ``scores``, one per sentence.

    Works where the documents are: no exchange, no sort and no row per term. Only the
    terms go to the Python workers, and only the scores come back. The documents of
    a batch are taken in blocks of about ``block`` terms. Null sentences give null scores.
    """
    ship_package(split.sparkSession)
    bound_batches(split.sparkSession)

    @F.arrow_udf("array<double>")
    def scored(terms: pa.Array) -> pa.Array:
        sizes, n = _lengths(terms.flatten()), _lengths(terms)
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(n)]
        cuts = np.r_[0, np.flatnonzero(np.diff(ends // block)) + 1, len(n)]
        parts = [_tfidf_centrality(terms.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:])]
        offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32), mask=np.r_[terms.is_null().to_numpy(zero_copy_only=False), False])
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts), pa.float64()))

    return split.withColumn("scores", scored(F.transform("sentences", terms)))


def pick_top_scores(scored: DataFrame, ratio: float, ties: str = LOWER_INDEX_FIRST) -> DataFrame:
    """:func:`pick_top` for documents that carry their sentences and ``scores``."""
    k = n_kept(F.col("n_sentences"), ratio)
    ranked = F.transform("scores", lambda s, i: F.struct((-F.round(s, SCORE_DIGITS)).alias("s"), (i if ties == LOWER_INDEX_FIRST else -i).alias("t"), i.alias("i")))
    best = F.array_sort(F.transform(F.slice(F.sort_array(ranked), 1, k), lambda r: r["i"]))
    # Where nothing scores, the first sentences stand for the document.
    nothing = F.coalesce(F.round(F.array_max("scores"), SCORE_DIGITS), F.lit(0.0)) == 0
    chosen = F.when(nothing, F.slice("sentences", 1, k)).otherwise(F.transform(best, lambda i: F.col("sentences")[i]))
    return scored.select("doc_id", F.coalesce(F.array_join(chosen, " "), F.lit("")).alias("summary"))


def embed_sentences(sentences: DataFrame, embedder: Embedder) -> DataFrame:
    """One vector per sentence."""
    return embedder.embed(sentences, "sentence", "embedding")


def dense_centrality(embedded: DataFrame) -> DataFrame:
    """:func:`sparse_centrality` for dense vectors (doc_id, idx, embedding).

    The rows are sorted by document while they hold one vector of floats; unit vectors
    and sums, several times wider, are made behind the sort, which the window uses.
    """
    narrow = embedded.select("doc_id", "idx", "embedding").sortWithinPartitions("doc_id")
    vectors = narrow.select("doc_id", "idx", array_to_vector("embedding").alias("_vector"))
    unit = Normalizer(inputCol="_vector", outputCol="_unit", p=2.0).transform(vectors)
    total = Summarizer.metrics("sum").summary(F.col("_unit")).over(Window.partitionBy("doc_id"))
    summed = unit.select("doc_id", "idx", "_unit", total.alias("_total")).select(
        "doc_id",
        "idx",
        vector_to_array("_unit").alias("_unit"),
        vector_to_array(F.col("_total").getField("sum")).alias("_total"),
    )
    score = F.round(dot(F.col("_unit"), F.col("_total")), SCORE_DIGITS)
    return summed.select("doc_id", "idx", score.alias("score"))


def position_scores(sentences: DataFrame) -> DataFrame:
    """Earlier sentences score higher: 1 - idx / n."""
    score = 1.0 - F.col("idx") / F.col("n_sentences")
    return sentences.select("doc_id", "idx", F.round(score, SCORE_DIGITS).alias("score"))


def rank_sentences(scored: DataFrame, ties: str = LOWER_INDEX_FIRST) -> DataFrame:
    """(doc_id, idx, score, rank), best first."""
    tie = F.col("idx").asc() if ties == LOWER_INDEX_FIRST else F.col("idx").desc()
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), tie)
    return scored.select("doc_id", "idx", "score", F.row_number().over(order).alias("rank"))


def n_kept(n_sentences: Column, ratio: float) -> Column:
    """All of up to two sentences, else ``max(1, int(n * ratio))``."""
    share = (n_sentences * F.lit(float(ratio))).cast("int")
    return F.when(n_sentences <= 2, n_sentences).otherwise(F.greatest(F.lit(1), share))


def pick_top(split: DataFrame, scored: DataFrame, ratio: float, ties: str = LOWER_INDEX_FIRST) -> DataFrame:
    """(doc_id, summary): the top sentences in document order.

    Indices and scores are gathered per document, at most one pair per sentence;
    the texts stay where they are. A document in which nothing scores keeps its
    first sentences. Joining the kept sentences of a short document gives back
    its cleaned text, so it needs no branch of its own.
    """
    tie = F.col("idx") if ties == LOWER_INDEX_FIRST else -F.col("idx")
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), tie.alias("t"), "idx")))
    ranked = scored.groupBy("doc_id").agg(order.alias("_ranked"), F.max("score").alias("_best"))
    k = n_kept(F.col("n_sentences"), ratio)
    best = F.array_sort(F.slice(F.transform("_ranked", lambda r: r["idx"]), 1, k))
    lead = F.slice("sentences", 1, k)
    chosen = F.when(F.col("_best").isNull() | (F.col("_best") == 0), lead).otherwise(
        F.transform(best, lambda i: F.col("sentences")[i])
    )
    return split.join(ranked.hint("merge"), "doc_id", "left").select(
        "doc_id", F.coalesce(F.array_join(chosen, " "), F.lit("")).alias("summary")
    )


def similarity_rows(weights: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the sentence similarity matrix for the wanted (doc_id, idx) only.

    The full matrix is the product of ``weights`` with its transpose and is never
    written out: its size is quadratic in the sentences of a document. What
    :func:`tfidf_weights` has gathered meets the wanted rows by ``doc_id`` where it is and is
    weighed there, so that no row per term is sent, sorted or joined; weights from
    elsewhere are gathered by document first.
    """
    ship_package(weights.sparkSession)
    bound_batches(weights.sparkSession)
    gathered = getattr(weights, "_gathered", None)
    weigh, counted = _tfidf_cells, "terms"
    if gathered is None:
        weigh, counted = None, None
        cell = F.struct(F.col("idx").cast("int").alias("idx"), "term", F.col("weight").cast("double").alias("weight"))
        gathered = weights.groupBy("doc_id").agg(F.collect_list(cell).alias("_rows"))
    # A row asked for twice counts twice, as in a join.
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.col("idx").cast("int")).alias("_asked"))

    @F.arrow_udf("array<struct<row_idx:int,idx:int,similarity:double>>")
    def compared(both: pa.Array) -> pa.Array:
        rows = both.field("_rows")
        return _in_blocks(both, rows, rows.flatten().field(counted) if counted else None, lambda x: _similarities(x, weigh))

    joined = gathered.join(asked.hint("shuffle_hash"), "doc_id")
    made = joined.select("doc_id", F.explode(compared(F.struct("_rows", "_asked"))).alias("_pair"))
    return made.select("doc_id", "_pair.row_idx", "_pair.idx", F.round("_pair.similarity", SCORE_DIGITS).alias("similarity"))


def _similarities(both: pa.Array, weigh: Callable[[pa.Array], pa.Array] | None) -> pa.Array:
    """Per document (row_idx, idx, similarity) of its wanted rows with the sentences that share a term."""
    n, out = len(both), []
    cells, asked = both.field("_rows"), both.field("_asked")
    cells = weigh(cells) if weigh else cells
    flat = cells.flatten()
    idx, weight = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("idx", "weight"))
    # A null term is no term that two sentences share.
    codes = pc.fill_null(flat.field("term").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    starts, wants = np.r_[0, np.cumsum(_lengths(cells))], np.r_[0, np.cumsum(_lengths(asked))]
    wanted = asked.flatten().to_numpy(zero_copy_only=False)
    for d in range(n):
        here = slice(starts[d], starts[d + 1])
        row, code, own = idx[here], codes[here], weight[here]
        terms_, term = np.unique(code, return_inverse=True)
        numbers, place = np.unique(row, return_inverse=True)
        for w, times in zip(*np.unique(wanted[wants[d] : wants[d + 1]], return_counts=True)):
            at = row == w
            if at.any():
                # Each cell of the row times the cells of the same term.
                factor = np.bincount(term[at], own[at], len(terms_))[term]
                shared = (np.bincount(term[at], minlength=len(terms_))[term] > 0) & (code >= 0)
                met = np.unique(place[shared])
                sums = times * np.bincount(place[shared], (own * factor)[shared], len(numbers))[met]
                out.append((np.full(len(met), d), np.full(len(met), w, np.int32), numbers[met].astype(np.int32), sums))
    doc, row, other, sums = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))
    pairs = pa.StructArray.from_arrays([pa.array(row), pa.array(other), pa.array(sums)], ["row_idx", "idx", "similarity"])
    return pa.ListArray.from_arrays(_offsets(doc, n), pairs)
