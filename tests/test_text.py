import random
import re
import time

from pyspark.sql import functions as F

from newsloom.functions import artifacts, text as X
from newsloom.functions.repeats import shorten
from newsloom.operators import centrality as C

EDGE_TEXTS = [
    "",
    "   ",
    "http://only.example/link",
    "See www.example.org/a?b now. And https://x.y/z too!  End",
    "joinedhttp://x.y rest. http:// alone www. alone",
    "One.Two. Three!Four? Five",
    "a b　c\x85d\x1ce\x1ff g",
    "Chào bạn! Hôm nay trời đẹp? Vâng... Đúng vậy.",
    "Wait?! Really... yes. . ! ?",
    "No end",
    " \t\n Mixed \r\n whitespace \x0b here.\x0cNext. ",
    "Same. Same. Same. Same.",
    "x" * 300 + ". " + "y",
    "“Quotes” – and — dashes… 1000 hahaha !!!! 😀 ok",
]


def random_texts(n=300, seed=5):
    pieces = ["a", "Đ", "é", "1", ".", "!", "?", " ", "  ", "\n", " ", "　", "\x1d", "www.", "http://", "https://", "_", "-", " ", "ß", "İ"]
    dice = random.Random(seed)
    return ["".join(dice.choice(pieces) for _ in range(dice.randint(0, 60))) for _ in range(n)]


TEXTS = EDGE_TEXTS + random_texts()


def without_link(word):
    starts = [m for m in (word.find("http://"), word.find("https://"), word.find("www.")) if m >= 0]
    for begin in sorted({i for mark in ("http://", "https://", "www.") for i in range(len(word)) if word.startswith(mark, i)}):
        mark = next(m for m in ("https://", "http://", "www.") if word.startswith(m, begin))
        if len(word) > begin + len(mark):
            return word[:begin]
    assert starts is not None
    return word


def expected_clean(text):
    return " ".join(w for w in map(without_link, text.split()) if w)


def expected_sentences(text):
    out, start = [], 0
    for i, c in enumerate(text):
        if c.isspace() and i > 0 and text[i - 1] in ".!?":
            out.append(text[start:i])
            start = i
    out.append(text[start:])
    return [s.strip() for s in out if s.strip()]


def shorten_repeats(text):
    """Replace every unit that follows itself at least twice by one copy, shortest unit first."""
    out, i = [], 0
    while i < len(text):
        for p in range(1, (len(text) - i) // 3 + 1):
            unit, copies = text[i : i + p], 1
            while text.startswith(unit, i + copies * p):
                copies += 1
            if copies >= 3:
                out.append(unit)
                i += copies * p
                break
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def run(spark, *columns, texts=TEXTS):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return rows.select("id", *columns).orderBy("id").collect()


def test_clean_text(spark):
    for row in run(spark, "text", X.clean_text(F.col("text")).alias("got")):
        assert row.got == expected_clean(row.text), repr(row.text)


def test_sentences(spark):
    both = run(
        spark,
        "text",
        X.sentences(F.col("text")).alias("any"),
        X.clean_sentences(X.clean_text(F.col("text"))).alias("clean"),
    )
    for row in both:
        assert row.any == expected_sentences(row.text), repr(row.text)
        assert row.clean == expected_sentences(expected_clean(row.text)), repr(row.text)


def test_joined_sentences_give_back_the_cleaned_text(spark):
    c = X.clean_text(F.col("text"))
    for row in run(spark, c.alias("c"), F.array_join(X.clean_sentences(c), " ").alias("joined")):
        assert row.c == row.joined


def test_terms(spark):
    for row in run(spark, "text", F.lower("text").alias("low"), X.terms(F.col("text")).alias("got")):
        assert row.got == re.findall(r"\w\w+", row.low), repr(row.text)


def test_lead_words(spark):
    texts = ["", "  a b ", "a b c", " a　b\nc d ", "w " * 10]
    for row in run(spark, "text", X.lead_words(F.col("text"), 3).alias("got"), texts=texts):
        words = row.text.split()
        assert row.got == (row.text if len(words) <= 3 else " ".join(words[:3]) + "...")


def test_tidy_generated(spark):
    cases = {
        "Wait...": "Wait.",
        "1000 times": "10 times",
        "hahaha ok": "ha ok",
        "“A” – b": "A b",
        "ok \U0001f600 then": "ok then",
        "aabb": "aabb",
        "": "",
    }
    texts = list(cases) + random_texts(100, seed=9)
    for row in run(spark, "text", X.tidy_generated(F.col("text")).alias("got"), texts=texts):
        kept = "".join(c for c in row.text if ord(c) <= 0x7F or 0xC0 <= ord(c) <= 0x1EF9 or c.isspace())
        assert row.got == shorten_repeats(" ".join(kept.split())), repr(row.text)
        if row.text in cases:
            assert row.got == cases[row.text]


def test_shortened_repeats():
    """Equal to the pattern, on texts dense with repeats."""
    pattern, dice = re.compile(r"(.+?)\1{2,}", re.S), random.Random(3)
    for _ in range(4000):
        letters = dice.choice(["a", "ab", "abc", "ab \U0001f600"])
        word = lambda n: "".join(dice.choice(letters) for _ in range(n))
        text = word(dice.randint(0, 40)) + word(dice.randint(1, 14)) * dice.randint(1, 5) + word(dice.randint(0, 20))
        assert shorten(text) == pattern.sub(r"\1", text), repr(text)


def test_shortening_long_texts():
    dice = random.Random(3)
    unit = "".join(dice.choice("abcdefgh ") for _ in range(100_000))
    start = time.time()
    assert shorten(unit * 10) == unit  # what stands in the unit stays
    assert shorten("a" * 1_000_000) == "a"
    assert time.time() - start < 60


def test_whole_documents_are_tidied_like_summaries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(8)
    both = docs.select(X.tidy_generated(F.col("text")).alias("want"), X.tidy_whole(F.col("text")).alias("got"))
    rows = both.unionByName(docs.limit(1).select(F.lit(None).cast("string").alias("want"), X.tidy_whole(F.lit(None).cast("string")).alias("got"))).collect()
    assert len(rows) == 201 and all(r.want == r.got for r in rows)


def test_usable_summary(spark):
    texts = ["abc", "ABC", "Ộ", "123 !?", "", "漢字", "ÀÁ 1"]
    got = run(spark, X.is_usable_summary(F.col("text")).alias("fold"), X.is_usable_summary(F.col("text"), False).alias("exact"), texts=texts)
    assert [r.fold for r in got] == [True, True, True, False, False, False, True]
    assert [r.exact for r in got] == [True, False, False, False, False, False, False]


def test_embedding_input_and_category(spark):
    rows = spark.createDataFrame(
        [("t", "d", "c"), ("t", "", ""), ("t", None, None), ("t", " ", "x" * 51)], "title string, description string, category string"
    )
    got = rows.select(X.embedding_input(F.col("title"), F.col("description")).alias("e"), X.category_or_unknown(F.col("category")).alias("c")).collect()
    assert [r.e for r in got] == ["t d", "t", "t", "t  "]
    assert [r.c for r in got] == ["c", "UNKNOWN", "UNKNOWN", "x" * 51]


def test_kept_sentences_match_truncation(spark):
    ns = spark.range(0, 400).select(F.col("id").cast("int").alias("n"))
    for ratio in (0.2, 0.3, 0.4):
        for row in ns.select("n", C.n_kept(F.col("n"), ratio).alias("k")).collect():
            assert row.k == (row.n if row.n <= 2 else max(1, int(row.n * ratio)))


def test_artifact_names(spark):
    rows = spark.createDataFrame([("xin chào", "Doan")], "text string, voice string")
    at = F.lit("2026-02-07 22:40:00").cast("timestamp")
    name = artifacts.file_name(F.col("text"), at)
    row = rows.select(name.alias("n"), artifacts.generated_at(name).alias("t"), artifacts.object_key("p", F.col("voice"), name).alias("k")).first()
    assert re.fullmatch(r"tts_20260207_224000_[0-9a-f]{8}\.wav", row.n)
    assert str(row.t) == "2026-02-07 22:40:00" and row.k == f"p/Doan/{row.n}"


def test_batches_of_documents_stay_small(spark):
    """Workers get whole documents in batches of a thousand rows, unless the user chose a number."""
    from newsloom.functions.text import tidy_whole
    from newsloom.session import DOCUMENTS_PER_BATCH

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for given, want in (("10000", str(DOCUMENTS_PER_BATCH)), ("777", "777")):
        spark.conf.set(name, given)
        try:
            rows = spark.createDataFrame([("ab ab ab ",)], "text string").select(tidy_whole(F.col("text")).alias("t"))
            assert spark.conf.get(name) == want and rows.count() == 1
        finally:
            spark.conf.unset(name)
