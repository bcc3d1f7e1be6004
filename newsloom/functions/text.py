r"""Text functions.

Java's ``\s`` is ASCII-only unless ``(?U)`` is set, and even then it leaves out
the separators U+001C..U+001F, which count as whitespace here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.repeats import shorten_repeats
from newsloom.schemas import UNKNOWN_CATEGORY

SPACES = r"(?U)[\s\x1c-\x1f]+"
EDGE_SPACES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
SENTENCE_GAP = r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"
# After cleaning every gap is one plain space.
CLEAN_SENTENCE_GAP = r" (?<=[.!?] )"
CLEAN_URL = r"https?://[^ ]+|www\.[^ ]+"
TERM = r"[\p{L}\p{N}_]{2,}"
NOT_PRINTABLE = r"(?U)[^\x00-\x7f\u00c0-\u1ef9\s]"
REPEATED_UNIT = r"(.+?)\1{2,}"

# The letters of which a usable summary holds at least one.
SUMMARY_LETTERS = (
    "abcdefghijklmnopqrstuvwxyz"
    "áàảãạăắằẳẵặâấầẩẫậ"
    "éèẻẽẹêếềểễệ"
    "íìỉĩị"
    "óòỏõọôốồổỗộơớờởỡợ"
    "úùủũụưứừửữự"
    "ýỳỷỹỵ"
    "đ"
)


def strip(text: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.regexp_replace(text, EDGE_SPACES, "")


def clean_text(text: Column) -> Column:
    """One space between words, no links, no outer whitespace."""
    spaced = F.regexp_replace(text, SPACES, " ")
    unlinked = F.regexp_replace(F.regexp_replace(spaced, CLEAN_URL, ""), "  +", " ")
    # A byte search decides whether the two further passes are needed.
    may_link = text.contains("://") | text.contains("www.")
    return F.trim(F.when(may_link, unlinked).otherwise(spaced))


def sentences(text: Column) -> Column:
    """Split any text after ``.``, ``!`` or ``?`` followed by whitespace."""
    parts = F.transform(F.split(text, SENTENCE_GAP), strip)
    return F.filter(parts, lambda s: s != "")


def clean_sentences(cleaned: Column) -> Column:
    """:func:`sentences` for the output of :func:`clean_text`, without the per-sentence trim."""
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(
        F.split(cleaned, CLEAN_SENTENCE_GAP)
    )


def terms(sentence: Column) -> Column:
    """Lower-case word runs of two or more characters."""
    return F.regexp_extract_all(F.lower(sentence), F.lit(TERM), F.lit(0))


def lead_words(text: Column, max_words: int = 150) -> Column:
    """The text itself if it is short enough, else its first words and an ellipsis."""
    words = F.split(strip(text), SPACES)
    cut = F.concat(F.array_join(F.slice(words, 1, max_words), " "), F.lit("..."))
    return F.when(F.size(words) <= max_words, text).otherwise(cut)


def drop_unprintable(text: Column) -> Column:
    """Delete characters outside ASCII, U+00C0..U+1EF9 and whitespace, then space evenly."""
    kept = F.regexp_replace(text, NOT_PRINTABLE, "")
    return F.trim(F.regexp_replace(kept, SPACES, " "))


def tidy_generated(text: Column) -> Column:
    """Post-process generated text.

    The last pattern shortens every unit repeated three or more times and takes
    quadratic time, so this is for summaries; :func:`tidy_whole` is for articles.
    """
    return F.regexp_replace(drop_unprintable(text), REPEATED_UNIT, "$1")


def tidy_whole(text: Column) -> Column:
    """The same result as :func:`tidy_generated` in O(n log n), in Python workers."""
    return shorten_repeats(drop_unprintable(text))


def is_usable_summary(text: Column, fold_case: bool = True) -> Column:
    """Whether the text holds any Latin or Vietnamese letter."""
    probe = F.lower(text) if fold_case else text
    return F.coalesce(probe.rlike(f"[{SUMMARY_LETTERS}]"), F.lit(False))


def embedding_input(title: Column, description: Column) -> Column:
    """Title and description, or the title alone."""
    no_description = description.isNull() | (description == "")
    return F.when(no_description, title).otherwise(F.concat_ws(" ", title, description))


def category_or_unknown(category: Column) -> Column:
    return F.when(category.isNull() | (category == ""), UNKNOWN_CATEGORY).otherwise(category)


def has_text(text: Column) -> Column:
    """Not null and not empty; blanks count as text."""
    return text.isNotNull() & (text != "")
