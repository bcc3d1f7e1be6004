"""Table schemas, request bounds and fixed parameters."""

from __future__ import annotations

from pyspark.sql import types as T

ARTICLE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("publisher_id", T.LongType()),
        T.StructField("content_plain_text", T.StringType()),
    ]
)

EMBEDDING = T.StructType(
    [
        T.StructField("news_id", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

AUDIO_FILE = T.StructType(
    [
        T.StructField("voice_id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("s3_key", T.StringType()),
        T.StructField("filename", T.StringType()),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("news_id", T.LongType()),
        T.StructField("audio_files", T.ArrayType(AUDIO_FILE)),
        T.StructField("summary_short", T.StringType()),
        T.StructField("summary_medium", T.StringType()),
        T.StructField("summary_default", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

RECOMMENDED = T.StructType(
    [
        T.StructField("news_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("similarity_score", T.DoubleType()),
    ]
)

CACHED_LIST = T.StructType(
    [
        T.StructField("news_id", T.LongType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("category_key", T.StringType()),
        T.StructField("items", T.ArrayType(RECOMMENDED)),
        T.StructField("computed_at", T.TimestampType()),
        T.StructField("expires_at", T.TimestampType()),
    ]
)

# Fixed values.
MAX_CATEGORY_CHARS = 50
UNKNOWN_CATEGORY = "UNKNOWN"
ALL_CATEGORIES_KEY = "all"
SCORE_FLOOR = 0.1
DEFAULT_K, MIN_K, MAX_K = 10, 1, 50
DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE = 50, 200
CACHE_TTL_SECONDS = 3600
LINK_TTL_SECONDS, LINK_MARGIN_SECONDS = 86400, 60
SPEECH_MIN_CHARS, SPEECH_MAX_CHARS = 1, 5000
DEFAULT_RATIO = 0.3
SHORT_FALLBACK_RATIO = 0.2
COMPARE_RATIO = 0.4
