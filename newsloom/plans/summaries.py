"""Summarizers and the two-summary job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import SUMMARY_LETTERS, clean_text, has_text, tidy_generated
from newsloom.operators import centrality as C
from newsloom.operators.embedding import Embedder, get_embedder, once_per_worker
from newsloom.operators.merge import upsert
from newsloom.schemas import DEFAULT_RATIO, SHORT_FALLBACK_RATIO
from newsloom.session import shared_dir, ship_package

# A summarizer maps documents (doc_id, text) and a ratio to (doc_id, summary).
Summarizer = Callable[[DataFrame, float], DataFrame]
# A generator maps a batch of prompts to as many texts; None marks a failed prompt.
Generator = Callable[[list[str]], list[str | None]]

# Fixed values.
PROMPT_PREFIXES = ("summarize: ", "tóm tắt: ", "")
NO_SUMMARY = "Không thể tạo tóm tắt (Unable to generate summary)"


def position_column(cleaned_sentences: Column, ratio: float) -> Column:
    n = F.size(cleaned_sentences)
    return F.array_join(F.slice(cleaned_sentences, 1, C.n_kept(n, ratio)), " ")


def position_summary(docs: DataFrame, ratio: float = DEFAULT_RATIO) -> DataFrame:
    """The leading sentences. Position scores fall with the index, so nothing is ranked or shuffled."""
    split = C.with_sentences(docs)
    return split.select("doc_id", position_column(F.col("sentences"), ratio).alias("summary"))


def position_summary_of_split(split: DataFrame, ratio: float = DEFAULT_RATIO) -> DataFrame:
    """:func:`position_summary` of documents already placed; it reads the columns that the other methods read."""
    lead = F.slice("sentences", 1, C.n_kept(F.col("n_sentences"), ratio))
    return split.select("doc_id", F.array_join(lead, " ").alias("summary"))


def tfidf_summary(docs: DataFrame, ratio: float = DEFAULT_RATIO) -> DataFrame:
    """The most central sentences by TF-IDF, found document by document without a shuffle."""
    return tfidf_summary_of_split(C.with_sentences(docs), ratio)


def tfidf_summary_of_split(split: DataFrame, ratio: float = DEFAULT_RATIO) -> DataFrame:
    return C.pick_top_scores(C.with_tfidf_scores(split), ratio, ties=C.HIGHER_INDEX_FIRST)


def embedding_summary(
    docs: DataFrame,
    ratio: float = DEFAULT_RATIO,
    embedder: Embedder | None = None,
    ties: str = C.LOWER_INDEX_FIRST,
) -> DataFrame:
    return embedding_summary_of_split(C.split_documents(docs), ratio, embedder, ties)


def embedding_summary_of_split(
    split: DataFrame,
    ratio: float = DEFAULT_RATIO,
    embedder: Embedder | None = None,
    ties: str = C.LOWER_INDEX_FIRST,
) -> DataFrame:
    embedded = C.embed_sentences(C.explode_sentences(split), embedder or get_embedder())
    return C.pick_top(split, C.dense_centrality(embedded), ratio, ties)


def row_summarizer(name: str, load: Callable[[], Callable[[str, float], str]]) -> Summarizer:
    """Adapt a ``(text, ratio) -> str`` function; ``load()`` runs once per Python worker."""

    def summarize(docs: DataFrame, ratio: float = DEFAULT_RATIO) -> DataFrame:
        @F.pandas_udf("string")
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            function = once_per_worker(f"summarizer:{name}", load)
            for texts in batches:
                yield texts.map(lambda t: None if t is None else function(t, ratio))

        ship_package(docs.sparkSession)
        return docs.select("doc_id", apply("text").alias("summary"))

    return summarize


def _generate_batch(generator: Generator, texts: list[str], usable: Callable[[str], bool], keep_last: bool) -> list[str]:
    """Try the prompts in turn on the texts that have no usable output yet."""
    out = [NO_SUMMARY] * len(texts)
    open_rows = list(range(len(texts)))
    for prefix in PROMPT_PREFIXES:
        if not open_rows:
            break
        prompts = [prefix + texts[i] for i in open_rows]
        unanswered = []
        for i, answer in zip(open_rows, _answers(generator, prompts), strict=True):
            if answer is not None and (keep_last or usable(answer)):
                out[i] = answer
            elif keep_last:
                out[i] = NO_SUMMARY
            if answer is None or not usable(answer):
                unanswered.append(i)
        open_rows = unanswered
    return out


def _answers(generator: Generator, prompts: list[str]) -> list[str | None]:
    """One call per batch; if it raises, prompt by prompt so that one bad text fails alone."""
    try:
        return generator(prompts)
    except Exception:
        if len(prompts) == 1:
            return [None]
    return [_answers(generator, [p])[0] for p in prompts]


def generated_summary(
    docs: DataFrame, name: str, load: Callable[[], Generator], keep_last: bool = False
) -> DataFrame:
    """Host a text generator: (doc_id, summary), null where the generator cannot be loaded.

    ``keep_last`` selects the variant that keeps the last output even if it has
    no letters, and tests for letters without folding case.
    """
    letters = frozenset(SUMMARY_LETTERS)

    def usable(text: str) -> bool:
        return not letters.isdisjoint(text if keep_last else text.lower())

    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            generator = once_per_worker(f"generator:{name}", load)
        except Exception:
            generator = None
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            given = texts.notna()
            if generator is not None and given.any():
                out[given] = _generate_batch(generator, texts[given].tolist(), usable, keep_last)
            yield out

    ship_package(docs.sparkSession)
    raw = docs.select("doc_id", generate(clean_text(F.col("text"))).alias("summary"))
    return raw.select("doc_id", tidy_generated(F.col("summary")).alias("summary"))


_summarizers: dict[str, Summarizer] = {
    "position": position_summary,
    "tfidf": tfidf_summary,
    "embedding": embedding_summary,
}
# The same from the result of ``centrality.split_documents``, so that several methods can share it.
_of_split: dict[str, Summarizer] = {
    "position": position_summary_of_split,
    "tfidf": tfidf_summary_of_split,
    "embedding": embedding_summary_of_split,
}


def register_summarizer(name: str, summarizer: Summarizer) -> None:
    _summarizers[name] = summarizer
    _of_split.pop(name, None)


def get_summarizer(name: str) -> Summarizer:
    if name not in _summarizers:
        raise KeyError(f"no summarizer named {name!r}; known: {sorted(_summarizers)}")
    return _summarizers[name]


def summarize_split(name: str, docs: DataFrame, split: DataFrame, ratio: float) -> DataFrame:
    """The named method on the shared ``split`` where it can start from it, else on ``docs``."""
    if name in _of_split:
        return _of_split[name](split, ratio)
    return get_summarizer(name)(docs, ratio)


register_summarizer("embedding-b", partial(embedding_summary, embedder=get_embedder("hashed-b"), ties=C.HIGHER_INDEX_FIRST))


def summary_requests(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests (news_id, force) with the stored summaries and two cache verdicts.

    ``generate_hit`` needs both summaries and no ``force``; ``read_hit`` needs either.
    """
    stored = results.select("news_id", "summary_short", "summary_default")
    short, default = has_text(F.col("summary_short")), has_text(F.col("summary_default"))
    return (
        requests.join(stored, "news_id", "left")
        .withColumn("generate_hit", short & default & ~F.coalesce("force", F.lit(False)))
        .withColumn("read_hit", short | default)
    )


def summarize_misses(
    requests: DataFrame,
    articles: DataFrame,
    results: DataFrame,
    generator: tuple[str, Callable[[], Generator]] | None = None,
    embedder: Embedder | None = None,
) -> DataFrame:
    """Both summaries for every request that is not a generate hit.

    Returns (news_id, status, summary_short, summary_default, short_method,
    default_method). Status is ``ok``, ``not_found`` or ``no_content``. Without a
    generator or an embedder the position summary takes its place.
    """
    misses = summary_requests(requests, results).where(~F.col("generate_hit")).select("news_id")
    content = articles.select(F.col("id").alias("news_id"), F.lit(True).alias("_known"), F.col("content_plain_text").alias("text"))
    found = misses.join(content, "news_id", "left")
    usable = has_text(F.col("text"))
    status = F.when(F.col("_known").isNull(), "not_found").when(~usable, "no_content").otherwise("ok")
    statused = found.withColumn("status", status)
    docs = statused.where("status = 'ok'").select(F.col("news_id").alias("doc_id"), "text")

    # The extractive branches start from this placement by document and add no shuffle of their own;
    # the generator reads the cleaned texts and is joined.
    split = C.split_documents(docs)
    fallback = split.select(
        "doc_id",
        position_column(F.col("sentences"), SHORT_FALLBACK_RATIO).alias("_lead_short"),
        position_column(F.col("sentences"), DEFAULT_RATIO).alias("_lead_default"),
    )
    made = fallback
    nothing = F.lit(None).cast("string")
    if generator is None:
        made = made.withColumn("_generated", nothing)
    else:
        made = made.join(generated_summary(docs, *generator).withColumnRenamed("summary", "_generated"), "doc_id", "left")
    if embedder is None:
        made = made.withColumn("_central", nothing)
    else:
        embedded = C.embed_sentences(C.explode_sentences(split), embedder)
        central = C.pick_top(split, C.dense_centrality(embedded), DEFAULT_RATIO)
        made = made.join(central.withColumnRenamed("summary", "_central"), "doc_id", "left")
    made = made.select(
        F.col("doc_id").alias("news_id"),
        F.coalesce("_generated", "_lead_short").alias("summary_short"),
        F.coalesce("_central", "_lead_default").alias("summary_default"),
        F.when(F.col("_generated").isNull(), "position").otherwise("generated").alias("short_method"),
        F.when(F.col("_central").isNull(), "position").otherwise("embedding").alias("default_method"),
    )
    failed = statused.where("status <> 'ok'").select("news_id", "status")
    return made.select("news_id", F.lit("ok").alias("status"), *made.columns[1:]).unionByName(
        failed, allowMissingColumns=True
    )


def store_summaries(results: DataFrame, made: DataFrame, as_of: Column) -> DataFrame:
    """The results table after the upsert; rows with errors write nothing.

    The upsert reads its updates in three places, so the summaries are written to
    the checkpoint folder first instead of being made three times.
    """
    shared_dir(made.sparkSession)
    updates = made.where("status = 'ok'").select("news_id", "summary_short", "summary_default").checkpoint()
    return upsert(results, updates, as_of)
