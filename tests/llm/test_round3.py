"""Lexical search, byte-level BPE and whitening against brute force, with the awkward cases."""

import base64
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from newsloom.llm import byte_codec, lexical_tree, whitening

DOCS = "doc_id long, text string, n long, id string, item string, terms string, key string"
LONG = "Alpha beta\tgamma-delta ÄÖ 12 " * 60_000


def documents(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z", "k") for i, t in pairs], DOCS).repartition(4)


# --- lexical search -------------------------------------------------------------


def terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def brute_search(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + (25 * c.total() * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in terms(text)
                if c[t]
            )
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(item, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def crowd():
    dice = random.Random(7)
    words = [f"w{n}" for n in range(60)]
    common = [10 / (n + 1) for n in range(60)]
    docs = [(i, " ".join(dice.choices(words, common, k=dice.randrange(0, 80)))) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(150)]  # a large group of copies
    docs += [(2000 + i, "w1 w2 w3 w4 w5 " * (1 + i % 3)) for i in range(120)]  # one set of terms, several counts
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, "w50 w51"), (3000, None), (3001, ""), (3002, "... --"), (3003, "É é W1 w-1\x00w2")]
    items = [(n, " ".join(dice.choices(words, k=dice.randrange(1, 30)))) for n in range(25)]
    items += [(90, None), (91, "?"), (92, "nowhere"), (93, "w1 w1 W1 w50"), (93, "w1 w1 W1 w50"), (None, "é w2"), (94, "w3 w4 w5")]
    return docs, items


@pytest.mark.parametrize("bucket,block", [(48, 8192), (2, 97), (1, 10_000)])
def test_search_equals_brute_force(spark, monkeypatch, bucket, block):
    docs, items = crowd()
    monkeypatch.setattr(lexical_tree.Tree.__init__, "__defaults__", (20, bucket))
    monkeypatch.setattr(lexical_tree, "BLOCK_DOCS", block)
    table = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in items], "item_id long, text string, key string, terms string, rank int")
    for k in (1, 20):
        got = sorted(map(tuple, lexical_tree.ranked(documents(spark, docs), table, k=k).collect()), key=str)
        assert got == brute_search(docs, items, k)


def test_search_in_groups_and_empty(spark, monkeypatch):
    docs, items = crowd()
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical_tree, "ITEM_TERMS", 60)
    monkeypatch.setattr(lexical_tree, "BLOCK_TERMS", 500)
    monkeypatch.setattr(lexical_tree, "PIECE", 40)
    got = sorted(map(tuple, lexical_tree.ranked(documents(spark, docs), table).collect()), key=str)
    assert got == brute_search(docs, items, 20)
    none = documents(spark, docs).limit(0)
    for a, b in ((none, table), (documents(spark, docs), table.limit(0)), (none, table.limit(0))):
        assert lexical_tree.ranked(a, b).collect() == []
    long = [(1, LONG), (2, "alpha"), (3, "ÄÖ" * 50_000)]
    asked = [(1, LONG[:400]), (2, "ÄÖ" * 50_000)]
    got = sorted(map(tuple, lexical_tree.ranked(documents(spark, long), spark.createDataFrame(asked, "item_id long, text string")).collect()), key=str)
    assert got == brute_search(long, asked, 20)


def test_search_prunes():
    """Bounds keep the search from reading every document."""
    docs, _ = crowd()
    counts = [Counter(terms(t)) for _, t in docs if terms(t)]
    order = {t: n for n, (t, _) in enumerate(Counter(t for c in counts for t in c).most_common())}
    lists = [sorted((order[t], f) for t, f in c.items()) for c in counts]
    flat = [x for ls in lists for x in ls]
    n = np.array([c.total() for c in counts])
    block = lexical_tree.Block(
        list(range(len(counts))), n, lexical_tree.length_factor(n, len(n), int(n.sum())), np.r_[0, np.cumsum([len(x) for x in lists])],
        np.array([t for t, _ in flat]), np.array([f for _, f in flat]),
    )
    tree = lexical_tree.Tree(block, 20, 8)
    worth = np.zeros(len(order), np.int64)
    worth[[order["w40"], order["w41"]]] = 3000
    assert 0 < tree.search(worth, []) < 0.6 * len(tree.ids)
    assert len(tree.ids) < len(counts) - 200  # copies are one entry


# --- byte-level BPE -------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return byte_codec.read_ranks()


@pytest.fixture(scope="module")
def judge(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("judge", pat_str=byte_codec.PATTERN, mergeable_ranks=table, special_tokens={})


def test_pattern_is_that_of_the_file():
    assert byte_codec.PATTERN == pytest.importorskip("public_tokenizers").PATTERN


def test_bytes_as_tiktoken(ranks, judge):
    dice = random.Random(3)
    letters = "aab  \n\n==--  11'tsé漢😀\t́‍\xa0\x00"
    texts = ["".join(dice.choice(letters) for _ in range(dice.randrange(80))) for _ in range(3000)]
    # Runs and repeated units, where pairs of tokens overlap.
    texts += ["".join(dice.choice(["a", "=", "-", "ab", "na", "xyz", " ", "ha", "_", "\n"]) * dice.randrange(1, 40) for _ in range(12)) for _ in range(3000)]
    texts += [f"x{chr(c)}1 {chr(c)}{chr(c)} z" for c in range(0x3200) if not 0xD800 <= c < 0xE000]
    texts += ["", " ", "<|endoftext|>", "word" * 20_000, "=" * 50_000]
    codec = byte_codec.ByteCodec(ranks)
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        for text, ids in zip(part, codec.encode(part), strict=True):
            assert ids.tolist() == judge.encode_ordinary(text), text[:100]


def test_every_character_splits_alike(ranks, judge):
    """Both libraries' classes of characters agree, over all of Unicode."""
    codec = byte_codec.ByteCodec(ranks)
    chars = [chr(c) for c in range(0x3200, 0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(chars), 20_000):
        part = [f"a{c}1 {c}" for c in chars[start : start + 20_000]]
        made = codec.encode(part)
        wrong = [t for t, ids in zip(part, made, strict=True) if ids.tolist() != judge.encode_ordinary(t)]
        assert not wrong, wrong[:5]


def test_encoded_and_decoded(spark, ranks, judge, monkeypatch):
    monkeypatch.setattr(byte_codec, "CACHED_BYTES", 2000)
    pairs = [(1, "Hello wörld 漢字😀"), (2, None), (3, ""), (3, "Hello wörld 漢字😀"), (None, "  \n x"), (4, LONG[:200_000])]
    docs = documents(spark, pairs).withColumn("ids", F.lit(1)).withColumn("_text", F.lit("no"))
    rows = byte_codec.encoded(docs, {"doc_id": F.col("doc_id")}, ranks, offsets=True, decode=True).collect()
    texts = Counter((i, t or "") for i, t in pairs)
    for r in rows:
        text = bytes(r.decoded).decode()
        texts[r.doc_id, text] -= 1
        assert r.ids == judge.encode_ordinary(text) and r.n_tokens == len(r.ids) == len(r.starts)
        for token, a, b in zip(r.ids[:300], r.starts, r.ends):
            assert judge.decode_single_token_bytes(token) in text[a:b].encode()
        assert not text or (r.starts[0], r.ends[-1]) == (0, len(text))
    assert not +texts and len(rows) == len(pairs)
    assert byte_codec.encoded(docs.limit(0), {"doc_id": F.col("doc_id")}, ranks).collect() == []
    half = judge.encode_ordinary("漢")[:1]
    given = [(1, judge.encode_ordinary("a漢😀")), (2, None), (3, []), (4, [None, 99_999_999, -4]), (5, half)]
    table = spark.createDataFrame(given, "doc_id long, ids array<int>")
    back = {r.doc_id: r for r in byte_codec.decoded(table, {"doc_id": F.col("doc_id")}, ranks).collect()}
    assert [back[i].text for i in range(1, 5)] == ["a漢😀", "", "", ""]
    assert bytes(back[5].bytes) == judge.decode_single_token_bytes(half[0]) and "�" in back[5].text


# --- whitening ------------------------------------------------------------------


def exact_covariance(x):
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    off = [[Fraction(n * r[j] - sums[j], n) for j in range(d)] for r in x]
    return sums, np.array([[float(sum(r[i] * r[j] for r in off) / n) for j in range(d)] for i in range(d)])


def vectors(seed=5, n=90, d=7):
    dice = np.random.default_rng(seed)
    mixed = dice.normal(size=(n, d)) @ dice.normal(size=(d, d)) + 3
    return [[float(np.float32(c)) for c in row] for row in mixed]


def test_whitening_equals_brute_force(spark):
    good = vectors()
    rows = [(i, v) for i, v in enumerate(good)] + [(500, None), (501, [1.0, None] + [0.0] * 5), (502, [float("nan")] * 7), (503, [float("inf")] + [0.0] * 6)]
    rows += [(3, good[3]), (None, good[4])]
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, n long, v long, component long").repartition(5)
    got = whitening.whitened(table, {"vec_id": F.col("vec_id")}, "embedding", components=5).collect()
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    sums, cov = exact_covariance(x)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:5], axes[:, ::-1][:, :5]
    n = len(kept)
    assert len(got) == 5 * n
    white = (np.array(x) - np.array([Fraction(s, n) for s in sums], object)).astype(float) @ axes / np.sqrt(values)
    want = Counter()
    for (i, _), r, w in zip(kept, x, white, strict=True):
        deviation = sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))
        want.update((i, c + 1, deviation, round(abs(w[c]), 7)) for c in range(5))
    assert Counter((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 7)) for r in got) == want
    for r in got:
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
        assert r.identity_error == got[0].identity_error < 1e-6
    by = {c: np.array([r.whitened for r in sorted(got, key=lambda r: (str(r.vec_id), r.deviation)) if r.component == c]) for c in range(1, 6)}
    off = np.array([[by[a] @ by[b] / n for a in by] for b in by]) - np.eye(5)
    assert np.abs(off).max() < 1e-6  # one sign for all rows


def test_whitening_awkward(spark):
    schema = "vec_id long, embedding array<double>"
    key = {"vec_id": F.col("vec_id")}
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, schema), key, "embedding").collect() == []
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, 2.0])], schema), key, "embedding").collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)]
    # One direction only, and a short vector that counts as ending in zero.
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(8)] + [(9, [1.0])], schema), key, "embedding").collect()
    assert {r.whitened for r in flat if r.component == 2} == {0.0} and flat[0].identity_error < 1e-9
    assert {r.explained for r in flat if r.component == 1} == {1.0}


def test_sums_stay_exact():
    big = np.array([[2**40, -(2**40), 3], [1, 2, 3]], np.int64)
    assert whitening.square_sums(big).tolist() == [2 * 2**80 + 9, 14]
    fitted = whitening.Whitening(10**6, np.array([0]), np.array([5]), np.eye(1), np.ones(1), 1.0)
    assert fitted.deviations(np.array([[2**45]])) == [(10**6 * 2**45 - 5) ** 2]
    with pytest.raises(OverflowError):
        whitening.integers(pa.array([[1e30]], pa.list_(pa.float64())), 1)
