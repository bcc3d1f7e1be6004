"""Audio bookkeeping: what is missing, what was made, which links to renew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import artifacts as A
from newsloom.functions.text import has_text
from newsloom.operators.merge import upsert
from newsloom.schemas import LINK_MARGIN_SECONDS, LINK_TTL_SECONDS

# The default voices and their descriptions.
DEFAULT_VOICES = [("Doan", "Giọng nữ miền Nam"), ("Binh", "Giọng nam miền Bắc")]


def default_voices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_VOICES, "voice_id string, description string")


def _listed(voices: DataFrame) -> Column:
    """The voice table as one array, a scalar subquery of the plan that uses it."""
    return voices.agg(F.sort_array(F.collect_list(F.struct("voice_id", "description")))).scalar()


def audio_requests(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests (news_id) with the stored ``audio_files`` and ``hit``: whether there are any."""
    stored = results.select("news_id", "audio_files")
    has_audio = F.coalesce(F.size("audio_files") > 0, F.lit(False))
    return requests.join(stored, "news_id", "left").withColumn("hit", has_audio)


def work_list(requests: DataFrame, articles: DataFrame, results: DataFrame, voices: DataFrame) -> DataFrame:
    """One row per missing artifact: (news_id, voice_id, description, status, text).

    The voices become one array that every article is exploded by, so there is
    no join to fan out and articles are not shuffled for it. Status is ``ok``,
    ``not_found`` or ``no_content``; the latter two have no voice.
    """
    misses = audio_requests(requests, results).where(~F.col("hit")).select("news_id")
    content = articles.select(F.col("id").alias("news_id"), F.lit(True).alias("_known"), F.col("content_plain_text").alias("text"))
    found = misses.join(content, "news_id", "left")
    status = F.when(F.col("_known").isNull(), "not_found").when(~has_text(F.col("text")), "no_content").otherwise("ok")
    every = _listed(voices)
    nothing = F.array(F.lit(None).cast("struct<voice_id:string,description:string>"))
    fanned = found.withColumn("status", status).withColumn(
        "_voice", F.explode(F.when(F.col("status") == "ok", every).otherwise(nothing))
    )
    return fanned.select("news_id", "_voice.voice_id", "_voice.description", "status", "text")


def missing_voices(articles: DataFrame, results: DataFrame, voices: DataFrame) -> DataFrame:
    """(news_id, voice_id) pairs that no stored record covers."""
    names = _listed(voices).getField("voice_id")
    wanted = articles.select(F.col("id").alias("news_id"), F.explode(names).alias("voice_id"))
    made = results.select("news_id", F.explode("audio_files").alias("a")).select("news_id", "a.voice_id")
    return wanted.join(made, ["news_id", "voice_id"], "left_anti")


def manifest(
    work: DataFrame,
    as_of: Column,
    prefix: str = "audio",
    endpoint: str = "http://localhost:9000",
    bucket: str = "news",
    default_voice: str = "Doan",
) -> DataFrame:
    """Names and metadata for each work row (news_id, voice_id, description, text)."""
    voice = F.coalesce("voice_id", F.lit(default_voice))
    named = work.withColumn("voice_id", voice).withColumn("filename", A.file_name(F.col("text"), as_of))
    keyed = named.withColumn("s3_key", A.object_key(prefix, F.col("voice_id"), F.col("filename")))
    return keyed.select(
        "news_id",
        "voice_id",
        "description",
        A.public_url(endpoint, bucket, F.col("s3_key")).alias("url"),
        "s3_key",
        "filename",
        F.length("text").alias("text_length"),
        A.generated_at(F.col("filename")).alias("generated_at"),
        A.fits_speech(F.col("text")).alias("fits_speech"),
    )


def audio_files(made: DataFrame, n_voices: int | None = None) -> DataFrame:
    """(news_id, audio_files): one record per voice, ordered by voice.

    With ``n_voices``, only articles that have them all: an article with a failed
    voice stores nothing.
    """
    record = F.struct("voice_id", "description", "url", "s3_key", "filename")
    files = made.groupBy("news_id").agg(F.sort_array(F.collect_list(record)).alias("audio_files"))
    return files if n_voices is None else files.where(F.size("audio_files") == n_voices)


def store_audio(results: DataFrame, files: DataFrame, as_of: Column) -> DataFrame:
    return upsert(results, files, as_of)


def drop_links(links: DataFrame, results: DataFrame, deleted: DataFrame) -> DataFrame:
    """The links (s3_key, ...) without those of result rows (news_id) that are deleted.

    A key that a row which stays refers to as well keeps its link.
    """
    files = results.select("news_id", F.explode("audio_files").alias("a")).select("news_id", "a.s3_key")
    gone = files.join(deleted.select("news_id"), "news_id", "left_semi").select("s3_key")
    shared = files.join(deleted.select("news_id"), "news_id", "left_anti").select("s3_key")
    return links.join(gone.join(shared, "s3_key", "left_anti"), "s3_key", "left_anti").select(links.columns)


def links_to_refresh(results: DataFrame, links: DataFrame, as_of: Column) -> DataFrame:
    """(news_id, voice_id, s3_key) of artifacts whose link is absent or about to expire.

    ``links`` is (s3_key, signed_at). A link lives a day and is renewed a minute early.
    """
    lifetime = F.make_interval(secs=F.lit(LINK_TTL_SECONDS - LINK_MARGIN_SECONDS))
    current = links.where(F.col("signed_at") + lifetime > as_of).select("s3_key")
    artifacts = results.select("news_id", F.explode("audio_files").alias("a")).select("news_id", "a.voice_id", "a.s3_key")
    keyed = artifacts.where(has_text(F.col("s3_key")))
    return keyed.join(current, "s3_key", "left_anti").select("news_id", "voice_id", "s3_key")
