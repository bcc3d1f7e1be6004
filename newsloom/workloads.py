"""The registered queries: every operator over the whole test tables.

How the tables stand in for articles, indexes, results and requests is described
in README.md. Nested and timestamp results are written as text, so that another
engine can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import payloads, text as X
from newsloom.functions.columns import with_evaluated
from newsloom.functions.vectors import l2_normalize
from newsloom.operators import centrality as C
from newsloom.operators import constraints, merge, stats
from newsloom.operators import similarity as S
from newsloom.operators.embedding import get_embedder
from newsloom.plans import audio, indexing, recommend, summaries
from newsloom.plans.compare import compare_methods
from newsloom.schemas import AUDIO_FILE, EMBEDDING, RESULT
from newsloom.session import scratch_path, stored
from newsloom.sources import articles as A
from newsloom.sources.batches import BatchTable
from newsloom.sources.buckets import BucketTable
from newsloom.streaming.index_stream import index_stream
from newsloom.streaming.ttl import computed_once
from newsloom.streaming.ttl_split import COMPUTED, computed_once_split

EARLIER, AS_OF = "2024-01-01 00:00:00", "2024-01-16 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]


def at(time: str) -> Column:
    return F.lit(time).cast("timestamp")


def shown(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


# --- the tables as articles, index, results and requests -----------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def as_articles(documents: DataFrame) -> DataFrame:
    split = with_evaluated(documents, "_s", X.clean_sentences(X.clean_text(F.col("text"))))
    titled = F.size("_s") >= 2
    return split.select(
        F.col("doc_id").alias("id"),
        F.when(titled, F.col("_s")[0]).alias("title"),
        F.when(titled, F.col("_s")[1]).alias("description"),
        F.nullif("source", F.lit("src0")).alias("category"),
        F.lit(None).cast("bigint").alias("publisher_id"),
        F.col("text").alias("content_plain_text"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_articles(table(spark, sf_dir, "documents"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("news_id"),
        F.col("label").cast("string").alias("category"),
        F.concat(F.lit("title "), F.col("vec_id").cast("string")).alias("title"),
        "embedding",
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results for the labelled documents: some with one summary, some with two, some with audio."""
    word = F.col("doc_id").cast("string")
    record = F.struct(
        F.lit("Binh").alias("voice_id"),
        F.lit("d").alias("description"),
        F.concat(F.lit("u/"), word).alias("url"),
        F.concat(F.lit("audio/Binh/"), word).alias("s3_key"),
        word.alias("filename"),
    )
    files = F.when(F.col("toxic") == 1, F.array(record)).otherwise(F.array().cast([*RESULT][1].dataType))
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("news_id"),
        files.cast("array<" + AUDIO_FILE.simpleString() + ">").alias("audio_files"),
        F.when(F.col("quality") == 1, F.concat(F.lit("short "), word)).alias("summary_short"),
        F.concat(F.lit("medium "), word).alias("summary_medium"),
        F.when(F.col("toxic") == 0, F.concat(F.lit("default "), word)).otherwise("").alias("summary_default"),
        at(EARLIER).alias("created_at"),
        at(EARLIER).alias("updated_at"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (news_id, k, category_filter, ts) from the event log; some k are out of bounds."""
    category = F.when(F.col("event_type") == "click", F.pmod("event_id", F.lit(10)).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("news_id"),
        F.floor("value").cast("int").alias("k"),
        category.alias("category_filter"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cached list per key: the last request before the reference time computed it."""
    key = payloads.category_key(F.col("category_filter"))
    seen = request_log(spark, sf_dir).where(F.col("ts") <= at(AS_OF)).withColumn("category_key", key)
    computed = seen.groupBy("news_id", "k", "category_key").agg(F.max("ts").alias("computed_at"))
    item = F.struct(
        (F.col("news_id") + 1).alias("news_id"),
        F.lit("cached").alias("title"),
        F.col("category_key").alias("category"),
        F.lit(0.5).alias("similarity_score"),
    )
    stamped = recommend.expiring(computed.withColumn("items", F.array(item)), F.col("computed_at"), 86400)
    return stamped.select("news_id", "k", "category_key", "items", "computed_at", "expires_at")


def vector_text(vector: str) -> Column:
    """Non-zero buckets as ``bucket:count`` in bucket order."""
    numbered = F.transform(F.col(vector), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    used = F.filter(numbered, lambda p: p["x"] != 0)
    return F.array_join(
        F.transform(used, lambda p: F.concat_ws(":", p["i"].cast("string"), p["x"].cast("int").cast("string"))), ","
    )


# --- queries -------------------------------------------------------------------------------


def list_articles(spark, sf_dir):
    return A.list_articles(articles(spark, sf_dir)).drop("publisher_id")


def checked_articles(spark, sf_dir):
    """Articles written as JSON lines, every seventh of them cut off, and read again with their quarantine."""
    folder = scratch_path(spark, "lines")
    whole = F.to_json(F.struct(F.col("id"), F.col("content_plain_text")))
    cut = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"title":"cut'))
    given = articles(spark, sf_dir)
    given.select(F.when(F.col("id") % 7 == 0, cut).otherwise(whole).alias("value")).write.text(folder)
    rows, quarantine = A.read_checked(spark, folder)
    lines = quarantine.select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("content"), "record")
    return rows.select(F.col("id").cast("string").alias("id"), F.col("content_plain_text").alias("content"), F.lit(None).cast("string").alias("record")).unionByName(lines)


def articles_in_category(spark, sf_dir):
    return A.list_articles(articles(spark, sf_dir), "src3").drop("publisher_id")


def article_page(spark, sf_dir):
    return A.page_of(A.list_articles(articles(spark, sf_dir)), page=2, size=75).drop("publisher_id")


def known_ids(spark, sf_dir):
    """Requested ids, some of which are not articles."""
    return table(spark, sf_dir, "events").select((F.col("user_id") * 9).alias("news_id")).distinct()


def fetch_content(spark, sf_dir):
    found = A.fetch_fields(known_ids(spark, sf_dir), articles(spark, sf_dir), ["title", "content_plain_text"])
    return found.select("news_id", "title", "content_plain_text", "status")


def index_table(spark: SparkSession) -> BatchTable:
    return BatchTable(spark, scratch_path(spark, "index"), EMBEDDING, partition_by="category")


def append_batches(spark, sf_dir):
    rows = index(spark, sf_dir).withColumn("created_at", at(EARLIER)).withColumn("updated_at", at(EARLIER))
    stored = index_table(spark)
    stored.append(rows.where("category < '5'"), "first")
    stored.append(rows.where("category >= '5'"), "second")
    stored.append(rows, "second")
    numbers = F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string")), ",")
    return stored.read().select("news_id", "category", "title", numbers.alias("vector"))


def shown_results(rows: DataFrame) -> DataFrame:
    return rows.select(
        "news_id",
        F.size("audio_files").cast("bigint").alias("n_audio"),
        "summary_short",
        "summary_medium",
        "summary_default",
        shown(F.col("created_at")).alias("created_at"),
        shown(F.col("updated_at")).alias("updated_at"),
    )


def result_updates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("news_id"),
        F.when(F.col("lang") == "en", F.concat(F.lit("new "), F.col("n_chars").cast("string"))).alias("summary_short"),
    )


def upsert_results(spark, sf_dir):
    return shown_results(merge.upsert(results(spark, sf_dir), result_updates(spark, sf_dir), at(AS_OF)))


def file_text(files: str) -> Column:
    """Audio records with all their fields."""
    parts = ("voice_id", "description", "url", "s3_key", "filename")
    return F.array_join(F.transform(files, lambda a: F.concat_ws("|", *[a[p] for p in parts])), ",")


def merged_updates(spark, sf_dir):
    """Several updates per article, each with another column, from the event log; the latest non-null value of each counts."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("news_id"),
        "event_id",
        F.when(F.col("event_type") == "click", F.concat(F.lit("s"), F.col("event_id").cast("string"))).alias("summary_short"),
        F.when(F.col("event_type") != "click", F.concat(F.lit("d"), F.col("event_id").cast("string"))).alias("summary_default"),
    )
    return merge.merged_updates(events, "news_id", "event_id")


def published_results(spark, sf_dir):
    """The stored results after two published changes: updates by article, then deletions; read back with all records."""
    stored = BucketTable(spark, scratch_path(spark, "results"), RESULT, n_buckets=16)
    stored.create(results(spark, sf_dir))
    stored.upsert(result_updates(spark, sf_dir), at(AS_OF))
    stored.delete(french(spark, sf_dir))
    return shown_results(stored.read()).withColumnRenamed("n_audio", "_n").join(
        stored.read().select("news_id", file_text("audio_files").alias("audio_files")), "news_id"
    ).drop("_n")


def links_after_delete(spark, sf_dir):
    """The links that stay when the results of French documents are deleted."""
    keys = results(spark, sf_dir).select(F.explode("audio_files").alias("a")).select("a.s3_key")
    links = keys.withColumn("signed_at", at(AS_OF))
    return audio.drop_links(links, results(spark, sf_dir), french(spark, sf_dir)).select("s3_key")


def french(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("news_id"))


def delete_results(spark, sf_dir):
    return shown_results(merge.delete_keys(results(spark, sf_dir), french(spark, sf_dir)))


def deletion_report(spark, sf_dir):
    return merge.deletion_report(results(spark, sf_dir), french(spark, sf_dir))


def one_per_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return constraints.keep_one_per_key(events, "user_id", [F.col("value").desc(), F.col("event_id")])


def duplicate_counts(spark, sf_dir):
    return constraints.count_duplicates(table(spark, sf_dir, "events"), "user_id")


def row_constraints(spark, sf_dir):
    """Index rows with faults planted by the documents' own columns."""
    documents = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    fault = F.col("n_chars") % 7
    rows = documents.join(vectors, "doc_id", "left").select(
        "doc_id",
        F.when(fault != 0, F.col("doc_id")).alias("news_id"),
        F.when(fault != 1, F.expr("repeat(source, cast(n_chars % 20 as int))")).alias("category"),
        F.when(fault != 2, F.col("lang")).alias("title"),
        F.when(fault == 3, F.slice("embedding", 1, 5)).otherwise(F.col("embedding")).alias("embedding"),
    )
    checked = constraints.with_violations(rows, dim=64)
    return checked.select("doc_id", F.array_join("violations", ",").alias("violations"))


def result_defaults(spark, sf_dir):
    bare = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("news_id"),
        F.lit(None).cast("array<" + AUDIO_FILE.simpleString() + ">").alias("audio_files"),
        F.when(F.col("quality") == 1, at(EARLIER)).alias("created_at"),
    )
    filled = constraints.with_result_defaults(bare, at(AS_OF))
    return filled.select(
        "news_id",
        F.size("audio_files").cast("bigint").alias("n_audio"),
        shown(F.col("created_at")).alias("created_at"),
        shown(F.col("updated_at")).alias("updated_at"),
    )


def titled_articles(spark, sf_dir):
    return articles(spark, sf_dir).where(X.has_text(F.col("title"))).select("id", "title")


def content_status(spark, sf_dir):
    """Requested articles whose content is present, empty or absent; empty is planted by language."""
    given = articles(spark, sf_dir).join(
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id"
    )
    content = F.when(F.col("lang") == "fr", "").when(F.col("lang") == "de", None).otherwise(F.col("content_plain_text"))
    status = F.when(X.has_text(F.col("content")), "ok").otherwise("no_content")
    return given.withColumn("content", content).select("id", status.alias("status"))


def request_bounds(spark, sf_dir):
    return S.check_requests(request_log(spark, sf_dir)).select("event_id", "k", "status")


def usable_summaries(spark, sf_dir):
    text = F.col("text")
    no_capitals = F.regexp_replace(text, "[a-z]", "")
    return docs(spark, sf_dir).select(
        "doc_id",
        X.is_usable_summary(text).alias("usable"),
        X.is_usable_summary(no_capitals).alias("usable_capitals"),
        X.is_usable_summary(no_capitals, fold_case=False).alias("usable_capitals_exact"),
    )


def clean_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


def sentences(spark, sf_dir):
    split = docs(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("idx", "sentence"))
    return split.select("doc_id", F.col("idx").cast("bigint").alias("idx"), "sentence")


def embedding_inputs(spark, sf_dir):
    text = X.embedding_input(F.col("title"), F.nullif("description", F.col("title")))
    return articles(spark, sf_dir).select("id", text.alias("embedding_text"))


def lead_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.lead_words(F.col("text")).alias("lead"))


def printable_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.drop_unprintable(F.col("text")).alias("printable"))


def tidied_titles(spark, sf_dir):
    """Titles as if they had been generated."""
    return articles(spark, sf_dir).select("id", X.tidy_generated(F.col("title")).alias("tidied"))


def tidied_documents(spark, sf_dir):
    """Whole documents as if they had been generated."""
    return docs(spark, sf_dir).select("doc_id", X.tidy_whole(F.col("text")).alias("tidied"))


def default_categories(spark, sf_dir):
    return articles(spark, sf_dir).select("id", X.category_or_unknown(F.col("category")).alias("category"))


def sentence_terms(spark, sf_dir):
    split = C.explode_sentences(C.with_sentences(docs(spark, sf_dir)))
    return split.select(
        "doc_id", F.col("idx").cast("bigint").alias("idx"), F.array_join(X.terms(F.col("sentence")), " ").alias("terms")
    )


def artifact_manifest(spark, sf_dir):
    work = docs(spark, sf_dir).withColumnRenamed("doc_id", "news_id").join(
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("news_id"), "lang"), "news_id"
    )
    voiced = work.withColumn("voice_id", F.when(F.col("lang") == "fr", "Binh")).withColumn("description", F.col("lang"))
    named = audio.manifest(voiced, at(AS_OF))
    return named.withColumn("generated_at", shown(F.col("generated_at"))).withColumn(
        "text_length", F.col("text_length").cast("bigint")
    )


def cached_payloads(spark, sf_dir):
    """Cached lists through JSON and back."""
    stored = cache(spark, sf_dir).select(
        payloads.cache_key(F.col("news_id"), F.col("k"), F.col("category_key")).alias("key"),
        payloads.encode_items(F.col("items")).alias("payload"),
    )
    items = stored.select("key", F.explode(payloads.decode_items(F.col("payload"))).alias("item"))
    return items.select("key", "item.*")


def unit_vectors(spark, sf_dir):
    unit = index(spark, sf_dir).select("news_id", F.posexplode(l2_normalize(F.transform("embedding", lambda x: x * 3))).alias("pos", "x"))
    return unit.select("news_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def pair_cosines(spark, sf_dir):
    """Cosine of each vector with the one that has the next id."""
    pairs = index(spark, sf_dir).select(F.col("news_id").alias("left_id"), (F.col("news_id") + 1).alias("right_id"))
    scored = S.pair_scores(pairs, index(spark, sf_dir))
    return scored.withColumn("similarity", F.round("similarity", 6))


def article_embeddings(spark, sf_dir):
    text = X.embedding_input(F.col("title"), F.col("description"))
    given = articles(spark, sf_dir).where(X.has_text(F.col("title"))).select("id", text.alias("t"))
    return get_embedder().embed(given, "t", "v").select("id", vector_text("v").alias("vector"))


def sentence_embeddings(spark, sf_dir):
    split = C.explode_sentences(C.with_sentences(docs(spark, sf_dir)))
    embedded = C.embed_sentences(split, get_embedder())
    return embedded.select("doc_id", F.col("idx").cast("bigint").alias("idx"), vector_text("embedding").alias("vector"))


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("news_id"))


def new_articles(spark, sf_dir):
    return indexing.not_indexed(articles(spark, sf_dir), labelled(spark, sf_dir)).select("id", "category")


def known_articles(spark, sf_dir):
    return indexing.already_indexed(articles(spark, sf_dir), labelled(spark, sf_dir)).select("id", "category")


def request_sources(spark, sf_dir):
    asked = S.check_requests(request_log(spark, sf_dir).withColumn("news_id", F.col("news_id") * 5))
    found = S.with_source(asked, index(spark, sf_dir))
    return found.select("event_id", "news_id", "status")


def article_categories(spark, sf_dir):
    return indexing.with_categories(known_ids(spark, sf_dir), articles(spark, sf_dir))


def article_exists(spark, sf_dir):
    ids = articles(spark, sf_dir).select(F.col("id").alias("news_id"))
    return A.with_existence(known_ids(spark, sf_dir), ids)


def forced_requests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("news_id"), (F.col("lang") == "fr").alias("force")
    )


def summary_cache(spark, sf_dir):
    return summaries.summary_requests(forced_requests(spark, sf_dir), results(spark, sf_dir)).select(
        "news_id", "generate_hit", "read_hit"
    )


def audio_cache(spark, sf_dir):
    looked = audio.audio_requests(forced_requests(spark, sf_dir).select("news_id"), results(spark, sf_dir))
    return looked.select("news_id", "hit")


def audio_work_list(spark, sf_dir):
    """Documents and some unknown ids; nothing is made for those."""
    asked = table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("news_id"))
    work = audio.work_list(asked, articles(spark, sf_dir), results(spark, sf_dir), audio.default_voices(spark))
    return work.select("news_id", "voice_id", "description", "status", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))


def missing_voices(spark, sf_dir):
    return audio.missing_voices(articles(spark, sf_dir), results(spark, sf_dir), audio.default_voices(spark))


def ranked(matches: DataFrame) -> DataFrame:
    return matches.select(
        "source_news_id", F.col("rank").cast("bigint").alias("rank"), "news_id", "title", "category", "similarity_score"
    )


def similar_to_one(spark, sf_dir):
    found = S.similar_to(index(spark, sf_dir), news_id=7, k=50)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


def similar_to_one_in_category(spark, sf_dir):
    found = S.similar_to(index(spark, sf_dir), news_id=7, k=50, category="3")
    return found.withColumn("rank", F.col("rank").cast("bigint"))


def top_k_all(spark, sf_dir):
    rows = index(spark, sf_dir)
    return ranked(S.top_k(S.all_requests(rows), rows))


def top_k_all_by_lists(spark, sf_dir):
    """The same result through sixteen lists, two of them in the first round."""
    rows = index(spark, sf_dir)
    return ranked(S.top_k(S.all_requests(rows), rows, n_lists=16, nprobe=2))


def top_k_same_category(spark, sf_dir):
    rows = index(spark, sf_dir)
    return ranked(S.top_k(S.all_requests(rows, k=50, same_category=True), rows))


def top_k_other_category(spark, sf_dir):
    rows = index(spark, sf_dir)
    other = F.pmod(F.col("category").cast("int") + 3, F.lit(10)).cast("string")
    asked = rows.select("news_id", F.lit(50).alias("k"), other.alias("category_filter"))
    return ranked(S.top_k(asked, rows))


def top_k_all_by_tree(spark, sf_dir):
    """The same result through sixteen lists under four branches, the lower pivots met in a join."""
    rows = index(spark, sf_dir)
    return ranked(S.top_k(S.all_requests(rows), rows, n_lists=16, nprobe=2, levels=2))


# These vectors hardly cluster, so one list each and a wide stop find most for what is scored.
LISTS, NEAR = 32, {"nprobe": 4, "spill": 1, "stop": 0.5}


def top_k_approximate(spark, sf_dir):
    rows = index(spark, sf_dir)
    return ranked(S.top_k_approximate(S.all_requests(rows), rows, S.train_lists(rows, n_lists=LISTS), **NEAR))


def top_k_approximate_all_lists(spark, sf_dir):
    """Visiting every list, with each vector filed twice, leaves nothing out and repeats nothing: the exact result."""
    rows = index(spark, sf_dir)
    return ranked(S.top_k_approximate(S.all_requests(rows), rows, S.train_lists(rows, n_lists=LISTS), nprobe=LISTS, spill=2))


def approximate_recall(spark, sf_dir):
    """Recall of the approximate search, and the share of vectors that it scores."""
    rows = index(spark, sf_dir)
    requests, centres = S.all_requests(rows), S.train_lists(rows, n_lists=LISTS)
    found = S.recall(S.top_k_approximate(requests, rows, centres, **NEAR), S.top_k(requests, rows))
    return found.crossJoin(S.scored_share(requests, rows, centres, **NEAR))


def shown_ranks(scored: DataFrame, ties: str) -> DataFrame:
    ranks = C.rank_sentences(scored, ties)
    return ranks.select(
        "doc_id", F.col("idx").cast("bigint").alias("idx"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


def position_ranking(spark, sf_dir):
    split = C.explode_sentences(C.split_documents(docs(spark, sf_dir)))
    return shown_ranks(C.position_scores(split), C.LOWER_INDEX_FIRST)


def tfidf_ranking(spark, sf_dir):
    split = C.explode_sentences(C.split_documents(docs(spark, sf_dir)))
    return shown_ranks(C.sparse_centrality(C.tfidf_weights(split)), C.HIGHER_INDEX_FIRST)


def embedding_ranking(spark, sf_dir):
    split = C.explode_sentences(C.split_documents(docs(spark, sf_dir)))
    scored = C.dense_centrality(C.embed_sentences(split, get_embedder()))
    return shown_ranks(scored, C.LOWER_INDEX_FIRST)


def total_indexed(spark, sf_dir):
    return stats.total_indexed(index(spark, sf_dir))


def count_by_category(spark, sf_dir):
    return stats.count_by_category(index(spark, sf_dir))


def index_stats(spark, sf_dir):
    made = stats.index_stats(index(spark, sf_dir))
    entries = F.array_sort(F.map_entries("by_category"))
    pairs = F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return made.select("total_embeddings", F.array_join(pairs, ",").alias("by_category"))


def index_tally(spark, sf_dir):
    return stats.tally(indexing.statused_batch(articles(spark, sf_dir), labelled(spark, sf_dir)))


def collected_audio(spark, sf_dir):
    work = audio.work_list(
        labelled(spark, sf_dir), articles(spark, sf_dir), results(spark, sf_dir), audio.default_voices(spark)
    ).where("status = 'ok'")
    files = audio.audio_files(audio.manifest(work, at(AS_OF)), n_voices=2)
    line = F.transform("audio_files", lambda a: F.concat_ws("|", a["voice_id"], a["url"]))
    return files.select("news_id", F.array_join(line, ",").alias("audio_files"))


def tfidf_weights(spark, sf_dir):
    """Per sentence: its terms and the sums of their counts, document frequencies and weights."""
    weights = C.tfidf_weights(C.explode_sentences(C.split_documents(docs(spark, sf_dir))))
    sums = weights.where("term is not null").groupBy("doc_id", "idx").agg(
        F.count("*").alias("n_terms"),
        F.sum("tf").alias("tf"),
        F.sum("df").alias("df"),
        F.round(F.sum("idf"), 6).alias("idf"),
        F.round(F.sum("weight"), 6).alias("weight"),
    )
    return sums.withColumn("idx", F.col("idx").cast("bigint"))


def similarity_rows(spark, sf_dir):
    """For each document the similarity of its best sentence to every sentence that shares a term with it."""
    weights = C.tfidf_weights(C.explode_sentences(C.split_documents(docs(spark, sf_dir))))
    best = C.rank_sentences(C.sparse_centrality(weights), C.HIGHER_INDEX_FIRST).where("rank = 1")
    rows = C.similarity_rows(weights, best)
    return rows.select(
        "doc_id", F.col("row_idx").cast("bigint").alias("row_idx"), F.col("idx").cast("bigint").alias("idx"), F.round("similarity", 6).alias("similarity")
    )


def compared_methods(spark, sf_dir):
    made = compare_methods(docs(spark, sf_dir), ["position", "tfidf", "embedding"])
    return made.select(
        "method", "n_docs", F.round("avg_summary_chars", 4).alias("avg_summary_chars"), F.round("avg_compression", 6).alias("avg_compression")
    )


def position_summary(spark, sf_dir):
    return summaries.position_summary(docs(spark, sf_dir))


def tfidf_summary(spark, sf_dir):
    return summaries.tfidf_summary(A.dealt(docs(spark, sf_dir)))


def embedding_summary(spark, sf_dir):
    return summaries.embedding_summary(docs(spark, sf_dir))


def second_embedder_summary(spark, sf_dir):
    return summaries.get_summarizer("embedding-b")(docs(spark, sf_dir), 0.3)


def short_documents(spark, sf_dir):
    split = C.with_sentences(docs(spark, sf_dir)).where("n_sentences <= 2")
    return split.select("doc_id", "cleaned", summaries.position_column(F.col("sentences"), 0.3).alias("summary"))


def two_summaries(spark, sf_dir):
    made = summaries.summarize_misses(
        forced_requests(spark, sf_dir), articles(spark, sf_dir), results(spark, sf_dir), embedder=get_embedder()
    )
    return made


def stored_summaries(spark, sf_dir):
    made = summaries.summarize_misses(forced_requests(spark, sf_dir), articles(spark, sf_dir), results(spark, sf_dir))
    return shown_results(summaries.store_summaries(results(spark, sf_dir), made, at(AS_OF)))


def seeded_index(spark, sf_dir) -> BatchTable:
    """An index that already holds the labelled documents."""
    stored = index_table(spark)
    known = articles(spark, sf_dir).join(labelled(spark, sf_dir).withColumnRenamed("news_id", "id"), "id", "left_semi")
    indexing.index_batch(known, stored, at(EARLIER))
    return stored


def shown_index(rows: DataFrame) -> DataFrame:
    return rows.select(
        "news_id", "category", "title", vector_text("embedding").alias("vector"), shown(F.col("created_at")).alias("created_at")
    )


def index_snapshot(spark, sf_dir):
    stored = seeded_index(spark, sf_dir)
    indexing.index_batch(articles(spark, sf_dir), stored, at(AS_OF))
    return shown_index(stored.read())


def index_from_stream(spark, sf_dir):
    stored = seeded_index(spark, sf_dir)
    query = index_stream(document_stream(spark, sf_dir), stored, at(AS_OF), scratch_path(spark, "index-stream"))
    query.awaitTermination()
    return shown_index(stored.read())


def cache_lookup(spark, sf_dir):
    looked = recommend.read_cache(request_log(spark, sf_dir), cache(spark, sf_dir), at(AS_OF))
    return looked.select("event_id", "category_key", "hit", F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"))


def cache_write_back(spark, sf_dir):
    """The cache after the log's misses were computed and stored."""
    _, after = recommend.serve(request_log(spark, sf_dir), index(spark, sf_dir), cache(spark, sf_dir), at(AS_OF))
    ids = F.transform("items", lambda i: i["news_id"].cast("string"))
    return after.select(
        "news_id", F.col("k").cast("bigint").alias("k"), "category_key",
        F.array_join(ids, ",").alias("items"), shown(F.col("expires_at")).alias("expires_at"),
    )


def cache_refresh(spark, sf_dir):
    """The log's lists over four fifths of the articles, refreshed after the last fifth was indexed."""
    rows, late = index(spark, sf_dir), F.col("news_id") % 5 == 0
    log = request_log(spark, sf_dir).select("news_id", "k", "category_filter")
    before = stored(recommend.expiring(recommend.missed_lists(log, rows.where(~late)), at(AS_OF)), "lists")
    after = recommend.refreshed_lists(before, rows.where(late), rows, at(AS_OF))
    ids = F.transform("items", lambda i: i["news_id"].cast("string"))
    return after.select("news_id", F.col("k").cast("bigint").alias("k"), "category_key", F.array_join(ids, ",").alias("items"))


def cache_invalidation(spark, sf_dir):
    """What stays cached after articles of the first three categories were indexed."""
    indexed = index(spark, sf_dir).where("category in ('0', '1', '2')").select("category")
    kept = recommend.invalidate(cache(spark, sf_dir), indexed)
    return kept.select("news_id", F.col("k").cast("bigint").alias("k"), "category_key")


def cache_after_indexing(spark, sf_dir):
    """What stays cached after new articles of three sources, each named like a cached category, were indexed."""
    statused = indexing.index_batch(arriving_articles(articles(spark, sf_dir)), seeded_index(spark, sf_dir), at(AS_OF))
    kept = recommend.invalidate(cache(spark, sf_dir), statused.where("status = 'indexed'").select("category"))
    return kept.select("news_id", F.col("k").cast("bigint").alias("k"), "category_key")


INDEXED_AT = "2024-01-15 12:00:00"


def arriving_articles(articles: DataFrame) -> DataFrame:
    """Articles of three sources, each named like a cached category."""
    given = articles.where("category in ('src1', 'src2', 'src3')")
    return given.withColumn("category", F.substring("category", 4, 10))


def hits_since(spark, sf_dir, epochs: str) -> DataFrame:
    looked = recommend.read_cache(request_log(spark, sf_dir), cache(spark, sf_dir), at(AS_OF), indexing.read_epochs(spark, epochs))
    return looked.select("event_id", "category_key", "hit")


def cache_hits_after_batch(spark, sf_dir):
    """Hits once a snapshot has been indexed: only lists computed later, without a call to drop any."""
    epochs = scratch_path(spark, "epochs")
    indexing.index_batch(arriving_articles(articles(spark, sf_dir)), seeded_index(spark, sf_dir), at(INDEXED_AT), epochs=epochs)
    return hits_since(spark, sf_dir, epochs)


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream. As a pattern its path may be one file or a folder of them; a source takes no bare file."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def document_stream(spark, sf_dir) -> DataFrame:
    return as_articles(arriving(spark, sf_dir, "documents"))


def cache_hits_after_stream(spark, sf_dir):
    """The same after the articles arrived in a stream."""
    epochs, checkpoint = scratch_path(spark, "epochs"), scratch_path(spark, "index-stream")
    given = arriving_articles(document_stream(spark, sf_dir))
    index_stream(given, seeded_index(spark, sf_dir), at(INDEXED_AT), checkpoint, epochs=epochs).awaitTermination()
    return hits_since(spark, sf_dir, epochs)


def without_categories(articles: DataFrame) -> DataFrame:
    """Every third article arrives without its category."""
    return articles.withColumn("category", F.when(F.col("id") % 3 != 0, F.col("category")))


def index_from_stream_by_catalog(spark, sf_dir):
    """Articles that arrive without a category get it from the article table."""
    stored = seeded_index(spark, sf_dir)
    catalog = lambda: articles(spark, sf_dir).select("id", "category")
    given = without_categories(document_stream(spark, sf_dir))
    index_stream(given, stored, at(AS_OF), scratch_path(spark, "index-stream"), catalog=catalog).awaitTermination()
    return shown_index(stored.read())


def stream_tally(spark, sf_dir):
    """The tallies of all micro-batches of the stream together."""
    tallies = scratch_path(spark, "tallies")
    query = index_stream(document_stream(spark, sf_dir), seeded_index(spark, sf_dir), at(AS_OF), scratch_path(spark, "index-stream"), tallies=tallies)
    query.awaitTermination()
    counts = ["indexed", "skipped", "already_indexed", "no_title", "invalid"]
    made = spark.read.schema("batch_id bigint, " + ", ".join(f"{c} bigint" for c in counts)).parquet(tallies)
    return made.agg(*[F.sum(c).alias(c) for c in counts])


def links_to_refresh(spark, sf_dir):
    """Stored artifacts against links signed at the times of the event log."""
    signed = table(spark, sf_dir, "events").groupBy(
        F.concat(F.lit("audio/Binh/"), (F.col("user_id") * 3).cast("string")).alias("s3_key")
    ).agg(F.max(F.when(F.col("ts").cast("timestamp") <= at(AS_OF), F.col("ts").cast("timestamp"))).alias("signed_at"))
    return audio.links_to_refresh(results(spark, sf_dir), signed, at(AS_OF))


def computed_once_stream(spark, sf_dir):
    requests = arriving(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts")
    out = scratch_path(spark, "computed")
    writer = computed_once(requests).writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "ttl"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    made = spark.read.schema("key string, computed_at timestamp, expires_at timestamp, n_requests bigint").parquet(out)
    return made.select("key", shown(F.col("computed_at")).alias("computed_at"), shown(F.col("expires_at")).alias("expires_at"), "n_requests")


def computed_once_hot(spark, sf_dir):
    """The same of three keys, so that each holds a third of all requests, spread over tasks."""
    requests = arriving(spark, sf_dir, "events").select((F.col("event_id") % 3).cast("string").alias("key"), "ts")
    out = scratch_path(spark, "computed")
    computed_once_split(requests, out, scratch_path(spark, "expiries"), scratch_path(spark, "ttl")).awaitTermination()
    made = spark.read.schema(COMPUTED).parquet(out)
    return made.select("key", shown(F.col("computed_at")).alias("computed_at"), shown(F.col("expires_at")).alias("expires_at"), "n_requests")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        list_articles, checked_articles, articles_in_category, article_page, fetch_content, append_batches,
        upsert_results, merged_updates, published_results, links_after_delete, delete_results, deletion_report, one_per_key, duplicate_counts,
        row_constraints, result_defaults,
        titled_articles, content_status, request_bounds, usable_summaries,
        clean_text, sentences, embedding_inputs, lead_words, printable_text, tidied_titles, tidied_documents,
        default_categories, sentence_terms, artifact_manifest, cached_payloads,
        unit_vectors, pair_cosines, article_embeddings, sentence_embeddings,
        new_articles, known_articles, request_sources, article_categories, article_exists,
        summary_cache, audio_cache, audio_work_list, missing_voices,
        similar_to_one, similar_to_one_in_category, top_k_all, top_k_all_by_lists, top_k_all_by_tree,
        top_k_same_category, top_k_other_category, top_k_approximate, approximate_recall,
        top_k_approximate_all_lists,
        position_ranking, tfidf_ranking, embedding_ranking,
        total_indexed, count_by_category, index_stats, index_tally, collected_audio,
        tfidf_weights, similarity_rows, compared_methods,
        position_summary, tfidf_summary, embedding_summary, second_embedder_summary,
        short_documents, two_summaries, stored_summaries,
        index_snapshot, index_from_stream, cache_lookup, cache_write_back, cache_refresh, cache_invalidation,
        cache_after_indexing, cache_hits_after_batch, cache_hits_after_stream,
        index_from_stream_by_catalog, stream_tally,
        links_to_refresh, computed_once_stream, computed_once_hot,
    )
}
