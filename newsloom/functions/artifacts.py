"""Names and metadata of audio artifacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.schemas import SPEECH_MAX_CHARS, SPEECH_MIN_CHARS

NAME_TIME = "yyyyMMdd_HHmmss"


def file_name(text: Column, as_of: Column) -> Column:
    """``tts_<time>_<first eight hex digits of the text's md5>.wav``."""
    return F.concat(
        F.lit("tts_"),
        F.date_format(as_of, NAME_TIME),
        F.lit("_"),
        F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8),
        F.lit(".wav"),
    )


def object_key(prefix: str, voice_id: Column, name: Column) -> Column:
    """The voice is part of the key: the name alone collides when two voices share a second."""
    return F.concat_ws("/", F.lit(prefix), voice_id, name)


def public_url(endpoint: str, bucket: str, key: Column) -> Column:
    return F.concat_ws("/", F.lit(endpoint), F.lit(bucket), key)


def generated_at(name: Column) -> Column:
    """Read the time back from a file name."""
    part = F.split(name, "_")
    stamp = F.concat_ws("_", part[1], F.split(part[2], r"\.")[0])
    return F.to_timestamp(stamp, NAME_TIME)


def fits_speech(text: Column) -> Column:
    return F.length(text).between(SPEECH_MIN_CHARS, SPEECH_MAX_CHARS)
