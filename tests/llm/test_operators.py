"""The training-data operators against brute force, on small tables with the awkward cases."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import (
    ann_forest,
    components,
    edit_counts,
    exact_dedup,
    html_text,
    license_scan,
    masked_lm,
    mixing,
    piece_codec,
    shingle_join,
    simhash,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, size string"
LONG = "word and more of it\n" * 3000


def rows_of(texts, ids=None):
    ids = ids or range(len(texts))
    return [(i, t, "en", f"s{n % 3}" if n % 5 else None, None, "x", "y") for n, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["a b c", "a b c", None, "", "  ", LONG, LONG, "a b c ", "Released under the MIT License.", "é ü\tn", "a b c"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, None, 1]
    return spark.createDataFrame(rows_of(texts, ids), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# --- exact dedup ----------------------------------------------------------------


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 5000):
        keys = rng.integers(-(2**63), 2**63 - 1, n)
        made = exact_dedup.build_filter(keys)
        assert exact_dedup.in_filter(keys, *made).all()
        others = rng.integers(-(2**63), 2**63 - 1, 20_000)
        assert exact_dedup.in_filter(others, *made).mean() < 0.001


def test_exact_dedup(docs, nothing):
    got = sorted(map(tuple, exact_dedup.dedup(docs).collect()), key=str)
    groups = {}
    plain = [(r.doc_id, r.text or "") for r in docs.collect()]
    for i, t in plain:
        groups.setdefault(t, []).append(i)
    want, seen = [], set()
    for i, t in plain:
        keep = max(groups[t], key=lambda x: -1 if x is None else x)
        stays = i == keep and (i, t) not in seen
        seen.add((i, t))
        want.append((i, keep, len(groups[t]), stays, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.dedup(nothing).count() == 0 and exact_dedup.kept_rows(nothing).count() == 0


def test_matches_compare_bytes(spark):
    """A filter hit whose bytes differ is no match."""
    old = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    snapshot = exact_dedup.write_snapshot(exact_dedup.grouped(old))
    new = exact_dedup.grouped(spark.createDataFrame([(900 + i, f"text {i * 2}") for i in range(300)], "doc_id long, text string"))
    assert exact_dedup.matches(new, snapshot).count() == 150
    other = new.withColumn("text", F.concat("text", F.lit("!")))  # same digests, other bytes
    assert exact_dedup.matches(other, snapshot).count() == 0


# --- license scan ---------------------------------------------------------------


def test_license_scan(spark, docs, nothing):
    got = {(r.doc_id, r.n_words): r for r in license_scan.scan(docs).collect()}
    hit = got[(8, 5)]
    assert (hit.n_base, hit.first_word, hit.last_word, hit.base_labels, hit.labels, hit.score) == (1, 3, 3, "mit", "mit,mit-notice", 1.0)
    assert license_scan.scan(docs).count() == docs.count() and license_scan.scan(nothing).count() == 0
    texts = ["MIT license mit-LICENSE", "general\npublic license", "apachelicense", "the mit", "gnu general public license v3 apache license"]
    found = license_scan.scan(spark.createDataFrame(rows_of(texts), DOCS)).orderBy("doc_id").collect()
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in found] == [
        (2, 0, 2, "mit"), (1, 0, 0, "gpl"), (0, None, None, ""), (0, None, None, ""), (2, 1, 5, "apache,gpl")
    ]


def test_similarity_join_finds_all(spark):
    rnd = random.Random(3)
    templates = tuple((f"t{i}", " ".join(rnd.sample("abcdefghijklmnopqrst", rnd.randint(3, 9)))) for i in range(12))
    texts = ["\n".join(" ".join(rnd.choices("abcdefghijklmnopqrst", k=rnd.randint(0, 18))) for _ in range(3)) for _ in range(80)]
    rows = license_scan.block_matches(spark.createDataFrame(rows_of(texts), DOCS), {"k": F.col("doc_id")}, templates, 0.6)
    want = []
    for i, t in enumerate(texts):
        for label, notice in templates:
            tokens, n, held = set(notice.split()), len(notice.split()), t.split()
            for b in range(0, len(held), n):
                share = len(tokens & set(held[b : b + 2 * n])) / len(tokens)
                if share >= 0.6 - 1e-12:
                    want.append((i, b // n, label, round(share, 9)))
    assert sorted((r.k, r.block, r.label, round(r.containment, 9)) for r in rows.collect()) == sorted(want)


def test_wrapped_notices_are_found(spark):
    full = dict(license_scan.TEMPLATES)
    def wrapped(text, width, margin):
        lines, line = [], ""
        for w in text.split():
            if len(line) + len(w) > width:
                lines.append(margin + line)
                line = ""
            line += w + " "
        return "\n".join([*lines, margin + line])
    texts = [f"int x;\n{wrapped(t, w, m)}\nint y; " + "z " * 50 for t in full.values() for w in (20, 70) for m in ("", " * ")]
    texts += [full["mit-text"].replace("obtaining a copy of this software", ""), " ".join(full["mit-full"].split()[::3])]
    got = license_scan.scan(spark.createDataFrame(rows_of(texts), DOCS)).orderBy("doc_id").collect()
    for i, label in enumerate(label for label in full for _ in range(4)):
        assert label in got[i].labels.split(",") and got[i].score == 1.0
    assert got[-1].labels == got[-2].labels == "" and got[-1].score == 0


# --- SimHash --------------------------------------------------------------------


def test_golay_keys_meet_within_one_bit():
    own, near, offsets = simhash.segment_keys()
    assert 1 <= np.diff(offsets).min() and np.diff(offsets).max() <= 17
    rng = np.random.default_rng(0)
    for word in rng.integers(0, 1 << 16, 200):
        keys = set(near[offsets[word] : offsets[word + 1]].tolist())
        assert all(int(own[word ^ flip]) in keys for flip in [0, *[1 << b for b in range(16)]])


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(4):
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                b ^= 1 << int(bit)
            fps.add(b)
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {frozenset((r.a, r.b)) for r in found.collect()}
    want = {frozenset((x, y)) for x in signed for y in signed if x != y and ((x ^ y) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and len(want) > 50


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (200, 200)] + [(300, 300 + i) for i in range(30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[329] == 300 and 200 not in got


def test_near_duplicates(docs, nothing):
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert rows[(2, "0" * 16)] == rows[(4, "0" * 16)] == 2
    assert simhash.near_duplicates(docs).count() == docs.count()
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 0), (False, 2), (False, 5), (False, 8), (True, None)]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_per_group(nothing).count() == 0


# --- mixing ---------------------------------------------------------------------


def test_mixing(spark, docs, nothing):
    rnd = random.Random(4)
    texts = [" ".join("w" * rnd.randint(0, 30)) for _ in range(600)]
    many = spark.createDataFrame(
        [(i, t, "en", None if i % 40 == 0 else "abcdefg"[min(6, int(rnd.expovariate(0.7)))], 0, "", "") for i, t in enumerate(texts)], DOCS
    )
    rows = mixing.mixed_sizes(many).collect()
    assert rows == mixing.mixed_sizes(many.repartition(5)).collect() or sorted(rows) == sorted(mixing.mixed_sizes(many.repartition(5)).collect())
    targets, taken = {}, {}
    for r in rows:
        assert r.taken <= 3 * r.size
        targets[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    sizes = {r.source: r.source_size for r in rows}
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want, open_, left = {}, {s: i % 3 + 1 for i, s in enumerate(order)}, total
    while True:
        level = left / sum(open_.values())
        above = [s for s in open_ if 3 * sizes[s] < open_[s] * level]
        if not above:
            break
        for s in above:
            want[s] = 3 * sizes[s]
            left -= want[s]
            del open_[s]
    want |= {s: w * level for s, w in open_.items()}
    assert targets == pytest.approx(want) and sum(targets.values()) == pytest.approx(total)
    assert all(abs(taken[s] - targets[s]) <= 40 for s in targets)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixing.mixed_rows(nothing).count() == 0
    assert mixing.mixed_sizes(docs).count() == docs.count() and mixing.mixed_sizes(nothing).count() == 0


# --- HTML -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def labeller():
    return html_text.train(html_text.training_pages(900))


def test_blocks():
    html = "<head><title>t</title></head><body><p>a&amp;b<br>c &nbsp; d<p><b>e<div>f</div><script>x</script>g<li>h<li>i<!-- n -->"
    assert [b[0] for b in html_text.blocks_of(html)] == ["a&b c d", "e", "f", "g", "h", "i"]


def test_open_heads_and_other_content():
    texts = lambda html: [b[0] for b in html_text.blocks_of(html)]
    assert texts("<html><head><title>T</title><article><p>Body") == ["Body"]
    assert texts("<head><meta x><noscript>n</noscript><script>s</script>words<p>p") == ["words", "p"]
    assert texts("<p>x <math>a</math> y<object>o</object><p><svg><title>t</title><text>d</text></svg>") == ["x a yo", "d"]
    assert texts("<body><iframe>i</iframe><p>a<style>b</style>c<template>d</template></i></p></p>e") == ["ac", "e"]
    last = html_text.blocks_of(f'<div class="{" ".join(f"u{i}" for i in range(14))} comment-list">x')[0]
    assert last[2] == "c:list" and "c:comment" in last[1].added


def test_deep_pages_take_time_in_proportion(labeller):
    start = time.monotonic()
    for page in (
        "<div>x" * 40_000,
        "".join(f'<div class="c{i}">x' for i in range(40_000)),
        "<b>" * 40_000 + "<p>x</p>" * 40_000,
        "<i>" * 40_000 + "</u>" * 40_000,
    ):
        logits, _ = labeller.run([html_text.Features().of(html_text.blocks_of(page + "z"))])
        assert np.isfinite(logits).all()
    assert time.monotonic() - start < 60


def test_labeller_path_gradients():
    rng, reader = np.random.default_rng(2), html_text.Features()
    paths = html_text.Paths([reader.of(html_text.blocks_of(h))[0] for h in ("<div class='a b'><p>x<p id=c>y<div>z", "t<ul><li>u<li class=a>v")])
    table, d = rng.standard_normal((html_text.PATHS, 3)), rng.standard_normal((6, 3))
    rows, values = paths.gradients(d)
    full = np.zeros_like(table)
    np.add.at(full, rows, values)
    for r in set(rows.tolist()):
        moved = table.copy()
        moved[r] += 0.01
        assert full[r].sum() == pytest.approx(((paths.means(moved) - paths.means(table)) * d).sum() / 0.01, abs=1e-3)


def test_labeller_on_new_layouts(labeller):
    reader, right, n = html_text.Features(), 0, 0
    for html, labels in html_text.training_pages(150, seed=77):
        logits, _ = labeller.run([reader.of(html_text.blocks_of(html))])
        right += int(((logits[:, 0] > 0) == (np.array(labels) == 1)).sum())
        n += len(labels)
    assert right / n > 0.98


def test_extracted(spark, labeller):
    page = "<html><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T</h1><p>One.<p>Two  x</article><footer>&copy; z</footer>"
    long = "<body><article>" + "<p>Some words of a text.</p>" * 3000 + "</article>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", long), (None, "u", "<<p>"), (1, "u", page)]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), labeller, {"page_id": F.col("page_id"), "url": F.col("url")})
    texts = [(r.page_id, r.text, r.n_chars) for r in got.collect()]
    assert texts.count((1, "T\n\nOne.\n\nTwo x", 14)) == 2 and (2, "", 0) in texts and (3, "", 0) in texts
    assert next(t for t in texts if t[0] == 4)[1].count("\n\n") == 2999 and len(texts) == 6


# --- nearest neighbours ---------------------------------------------------------


def test_forest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[100:140] = x[100]  # a group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7000, None), (7001, [0.0] * 16), (7002, [float("nan")] * 16), (None, x[0].tolist()), (7003, [1.0])]
    table = spark.createDataFrame([*rows, rows[3]], "vec_id long, embedding array<float>")
    got = ann_forest.nearest(table, "vec_id", "embedding", F.col("id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    full, hits = x.astype(np.float64), 0
    assert sorted(by) == list(range(0, 1500, 20))
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        scores = (full * full[q]).sum(axis=1)
        assert all(r.score == scores[r.vec_id] for r in found) and len(found) == 20
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        scores[q] = -np.inf
        hits += len({r.vec_id for r in found} & set(np.lexsort((np.arange(1500), -scores))[:20].tolist()))
    assert hits / (20 * len(by)) >= 0.9


def test_forest_small_tables(spark):
    few = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = ann_forest.nearest(few, "vec_id", "embedding", F.col("id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [4, 3, 2, 1]
    assert ann_forest.nearest(few.where("vec_id > 90"), "vec_id", "embedding", F.lit(True)).count() == 0


# --- toxicity -------------------------------------------------------------------


def bag(rnd, bad):
    text = [rnd.choice("lorem ipsum dolor sit amet elit sed do tempor magna aliqua".split()) for _ in range(rnd.randint(5, 120))]
    if bad:
        text.insert(rnd.randrange(len(text)), rnd.choice(["grobble", "grobbler", "vexnit"]))
    return " ".join(text)


def test_network_gradients():
    """The numpy gradients against differences."""
    rnd = random.Random(1)
    tokens = [toxicity.words_of(bag(rnd, i % 2)) for i in range(4)]
    net = toxicity.new_net(tokens, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = sorted({w for t in tokens for w in t})
    trainer = toxicity.Trainer(net, words)
    windows = np.concatenate([toxicity.windows_of(np.array([words.index(w) for w in t]))[:1] for t in tokens])
    y, ones, got = np.array([0, 1, 0, 1.0]), np.ones(4), {}
    trainer._adam = lambda name, at, grad: got.setdefault(name, (at, grad))
    trainer.step(windows, y, ones)

    def loss():
        z = trainer._pass(windows)[0].astype(np.float64)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    for name in ("rec_f", "rec_b", "in_f", "att", "att_v", "out"):
        flat = net.p[name].reshape(-1)
        at = int(np.abs(np.asarray(got[name][1])).argmax())
        old, eps = flat[at], 1e-2
        flat[at] = old + eps
        up = loss()
        flat[at] = old - eps
        down = loss()
        flat[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(np.asarray(got[name][1]).reshape(-1)[at], rel=0.1, abs=2e-4), name


def test_toxicity_held_out(spark, docs, nothing):
    rnd = random.Random(2)
    rows = [(i, bag(rnd, i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (9999, None)], "doc_id long, toxic int")
    net = toxicity.fit(table, labels)
    keys = {"doc_id": F.col("doc_id"), "held_out": toxicity.held_out(F.col("doc_id"))}
    held = [r for r in toxicity.scored(table, net, keys).collect() if r.held_out]
    right = sum((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in held)
    assert len(held) > 90 and right / len(held) > 0.9
    assert toxicity.scored(docs, net, {"doc_id": F.col("doc_id")}).count() == docs.count()
    assert all(0 <= r.score <= 1 for r in toxicity.scored(docs, net, {"doc_id": F.col("doc_id")}).collect())
    assert toxicity.scored(nothing, net, {"doc_id": F.col("doc_id")}).count() == 0
    assert toxicity.fit(nothing, labels) is None
    kept = toxicity.clean_rows(docs, labels.where("doc_id > 100"))  # nothing to train on: everything stays
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_long_words_are_read_to_their_end():
    for n in (1, 59, 60, 61, 108, 109, 500):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = toxicity.words_of(word)
        assert pieces[0] == word[: toxicity.PIECE] and len(pieces[-1]) <= toxicity.PIECE
        assert all(any(word[i : i + 3] in p for p in pieces) for i in range(n))
    rnd = random.Random(9)
    labels = [i % 2 for i in range(200)]
    net = toxicity.train([bag(rnd, bad) for bad in labels], labels)
    ends = ["x" * 90 + "".join(bag(rnd, bad).split()) for bad in (0, 1)]
    got = toxicity.Scorer(net).scores(ends)
    assert got[0] != got[1]


def test_windows_cover_texts():
    for n in range(0, 120):
        w = toxicity.windows_of(np.arange(n))
        assert set(w.ravel().tolist()) - {-1} == set(range(n)) and (n == 0 or (w >= 0).any(axis=1).all())


# --- language model -------------------------------------------------------------


def test_ngrams_of_many_words():
    dice = random.Random(4)
    words = ["", "a", "漢字", *["".join(dice.choices("abcé漢😀", k=dice.randrange(70))) for _ in range(300)]]
    for given in ([], [""], words):
        want = []
        for at, word in enumerate(given):
            marked = f"^{word}$".encode()
            want += [(zlib.crc32(marked[i : i + n]) % toxicity.BUCKETS, at) for n in toxicity.NGRAMS for i in range(len(marked) - n + 1)]
        grams, of = toxicity.ngrams(given)
        assert list(zip(grams.tolist(), of.tolist(), strict=True)) == want
    net = toxicity.new_net([words], 1)
    rows, grams, of = net.inputs(words * 20)  # more than are hashed at once
    assert len(rows) == 20 * len(words) > toxicity.WORDS_AT_ONCE and of[-1] == len(rows) - 1 and len(grams) == 20 * len(want)


def test_toxicity_trains_in_a_task(spark, monkeypatch):
    """The driver gets the network only, and it is the one that the texts give."""
    rnd = random.Random(5)
    rows = [(i, bag(rnd, i % 2), i % 2) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity.np, "lexsort", None)  # of the driver's process; training calls it
    net = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    monkeypatch.undo()
    used = table.where(~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).collect()
    rates = [sum(r.toxic == c for r in used) / len(used) for c in (0, 1)]
    want = toxicity.train([r.text for r in used], [r.toxic for r in used], tuple(rates))
    assert net.vocabulary == want.vocabulary and all(np.allclose(net.p[k], want.p[k], atol=1e-4) for k in want.p)
    only = table.where("toxic = 1")
    assert toxicity.fit(only.select("doc_id", "text"), only.select("doc_id", "toxic")) is None


def test_masked_lm_trains_on_every_position(spark):
    texts = ["one two three"] * 3 + ["four", "", "five six"]
    table = spark.createDataFrame(rows_of(texts), DOCS).coalesce(1)
    statistics = masked_lm.statistics_of(masked_lm.word_counts(table))
    first, weights = masked_lm.first_weights(statistics.prior), masked_lm.fit(table, statistics)
    changed = (weights["near"] != first["near"]).any(axis=1).reshape(len(masked_lm.SLOTS), -1).any(axis=0)
    for w in "one two three five six".split():  # each is a neighbour of a position
        assert changed[statistics.known[w]]
    assert not changed[statistics.known["four"]] and (weights["group"] != first["group"]).all()


def test_masked_lm_words(monkeypatch):
    """Words are those of the expression, which usual texts do not need."""
    texts = ["", " ", "One, two.Three!", "a_b _ c-d's", "x·y €5 “z” ٣ ½ é\u0301", "p\x1cq\u2028r\u0085s\x00t", "ǅ İstanbul %&*$| 1,2"]
    texts += ["".join(random.Random(i).choices("aZ_é1½ .,·\t\n\x1f\u3000一\ud800", k=60)) for i in range(200)]
    texts += [f"a{chr(c)}b" for c in range(0x3100)]
    assert [masked_lm.words_of(t) for t in texts] == [re.findall(r"\w+", t.lower()) for t in texts]
    monkeypatch.setattr(masked_lm, "WORD", None)
    assert masked_lm.words_of("Über 12 words (100%); that's \"all\"!") == ["über", "12", "words", "100", "that", "s", "all"]


def test_masked_lm_gradients():
    rng = np.random.default_rng(4)
    statistics = masked_lm.Statistics([f"w{i}" for i in range(300)], np.arange(300, 0, -1) * 5, 300000)
    p = {k: v.astype(np.float64) for k, v in masked_lm.first_weights(statistics.prior).items()}
    near, wanted = rng.integers(0, 50, (40, len(masked_lm.SLOTS))) + masked_lm.STARTS, rng.integers(0, masked_lm.CLASSES, 40)
    trainer = masked_lm.Trainer(p)
    seen = {}
    trainer._adagrad = lambda name, at, grad: seen.update({name: (at, grad)})
    trainer.step(near.astype(np.uint16), wanted)
    for name, (at, grad) in seen.items():
        full = np.zeros_like(p[name])
        full[at] = grad
        for i in rng.choice(np.flatnonzero(full.ravel()), 5):
            values = []
            for by in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in p.items()}
                moved[name].ravel()[i] += by
                values.append(-masked_lm.class_log_probs(moved, near, wanted).sum())
            assert full.ravel()[i] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-5)


def test_masked_lm_equals_brute_force(spark):
    rnd = random.Random(8)
    once = " ".join(f"x{i} the" for i in range(40))
    texts = [" ".join(rnd.choices([f"v{i}" for i in range(400)], [1 / (i + 1) for i in range(400)], k=rnd.randint(0, 90))) for _ in range(60)]
    twice = " ".join(f"y{i} the" for i in range(40))
    texts += [once, twice, twice, "Q" * 100 + " " + "q" * 101 + " the", "q" * 100]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    keys = {"doc_id": F.col("doc_id")}
    got = {r.doc_id: r for r in masked_lm.pseudo_likelihood(table, keys, known=150).collect()}
    assert len(got) == len(texts)
    statistics = masked_lm.statistics_of(masked_lm.word_counts(table), 150)
    p = masked_lm.fit(table, statistics)
    split = [t.lower().split() for t in texts]
    counts = collections.Counter(w for t in split for w in t)
    ranked = sorted(counts, key=lambda w: (-counts[w], w))[:150]
    mass = collections.Counter()
    class_of = {}
    for w in counts:
        class_of[w] = int(statistics.classes[ranked.index(w) if w in ranked else 150])
        mass[class_of[w]] += counts[w]

    def share(logits, k):
        return logits[k] - np.log(np.exp(logits).sum())

    for i, t in enumerate(split):
        total = 0.0
        for j, w in enumerate(t):
            u = p["near_bias"].astype(float)
            for slot, d in enumerate((-2, -1, 1, 2)):
                inside = 0 <= j + d < len(t)
                row = (ranked.index(t[j + d]) if t[j + d] in ranked else 150) if inside else masked_lm.INPUTS
                u = u + p["near"][slot * (masked_lm.INPUTS + 1) + row]
            h, (g, c) = np.tanh(u), divmod(class_of[w], masked_lm.EACH)
            total += share(h @ p["group"] + p["group_bias"], g) + share(h @ p["class"][g] + p["class_bias"][g], c)
            total += np.log(counts[w] / mass[class_of[w]])
        assert got[i].n_tokens == len(t) and got[i].log_prob == pytest.approx(total, rel=1e-4, abs=1e-4)
        assert got[i].unigram_log_prob == pytest.approx(sum(np.log(counts[w] / sum(counts.values())) for w in t), abs=1e-4)
        assert got[i].n_alone == sum(counts[w] == t.count(w) for w in t)
    assert got[60].n_alone == 40 and got[61].n_alone == got[62].n_alone == 0
    assert got[61].log_prob == got[62].log_prob > got[60].log_prob + 10


def test_masked_lm_uses_both_sides(spark, docs, nothing):
    rnd = random.Random(6)
    def text(n):
        out = []
        for _ in range(n):
            k = rnd.randrange(20)
            out += [f"a{k}", f"b{k}", f"c{k}"]
        return " ".join(out)
    table = spark.createDataFrame([(i, text(120)) for i in range(800)], "doc_id long, text string").coalesce(1)
    keys = {"doc_id": F.col("doc_id")}
    rows = masked_lm.pseudo_likelihood(table, keys).collect()
    assert sum(r.log_prob for r in rows) > 0.8 * sum(r.unigram_log_prob for r in rows)
    edge = {(r.doc_id, r.n_tokens): r.log_prob for r in masked_lm.pseudo_likelihood(docs, keys).collect()}
    assert edge[(2, 0)] == 0 and edge[(5, 15000)] < 0 and masked_lm.pseudo_likelihood(nothing, keys).count() == 0


# --- tokens ---------------------------------------------------------------------


def odd_texts(n, seed):
    rnd = random.Random(seed)
    parts = ["  ", " ", "a", "the", "\n", "é", "日", "🎉", "<s>", "<0x0A>", "\t", "   ", "x", "'ll", "12"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_codec_parity_and_round_trip(spark, docs, nothing):
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    codec = piece_codec.Codec(piece_codec.read_model())
    texts = odd_texts(800, 1) + ["", " ", "▁x ▁", LONG]
    done = codec.encode(texts)
    ids = [x.tolist() for x, _, _ in done]
    assert ids == judge.encode(texts) and all(p for _, p, _ in done)
    assert codec.decode(ids) == judge.decode(ids)
    assert [b for _, _, b in done] == [a == b for a, b in zip(texts, judge.decode(ids), strict=True)]
    model, keys = piece_codec.read_model(), {"doc_id": F.col("doc_id")}
    rows = piece_codec.encoded(docs, {**keys, "was": F.coalesce("text", F.lit(""))}, model)
    assert rows.where("round_trip and parity").count() == docs.count()
    back = piece_codec.decoded(rows, {"was": F.col("was")}, model)
    assert back.where("was = text").count() == docs.count() and piece_codec.encoded(nothing, keys, model).count() == 0


def test_unigram_models(tmp_path):
    """A unigram model written by hand: the scores decide, with byte fallback."""
    import struct

    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data if len(data) < 128 else bytes([n << 3 | 2, len(data) & 127 | 128, len(data) >> 7]) + data

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind]))

    pieces = [("<unk>", 0, 2), *[(f"<0x{i:02X}>", 0, 6) for i in range(256)], ("▁", -3, 1), ("▁ab", -2, 1), ("ab", -2.5, 1), ("a", -4, 1), ("b", -4, 1), ("abb", -9, 1)]
    trainer = field(2, bytes([3 << 3, 1]) + bytes([0x98, 0x02, 1]))
    normalizer = field(3, bytes([3 << 3, 1, 4 << 3, 0]))
    data = b"".join(piece(*p) for p in pieces) + trainer + normalizer
    done = piece_codec.Codec(data).encode(["ab abb b", "aé  b", "", "abab"])
    assert all(p for _, p, _ in done) and len(done[0][0]) > 3


def test_edits_equal_full_counts(spark, docs, nothing):
    counter = edit_counts.Counter(edit_counts.read_ranks())
    rnd = random.Random(8)
    for text in odd_texts(150, 2) + [LONG, ""]:
        tree = edit_counts.Tree(*counter.split(text))
        for _ in range(5):
            start = rnd.randint(-2, len(text) + 3)
            text = tree.edit(text, start, start + rnd.choice([0, 1, 3, 40]), rnd.choice(["", " ", "'", "word", " \n", "a" * 200, " b" * 200]), counter)
            assert tree.pieces() == counter.split(text) and tree.n_chars == len(text)
            assert tree.n_tokens == len(counter.encoding.encode_ordinary(text))
    tree = edit_counts.Tree(*counter.split(LONG))
    tree.edit(LONG, 30_000, 30_004, "xy", counter)
    assert tree.encoded < 10  # of thousands
    ranks, keys = edit_counts.read_ranks(), {"doc_id": F.col("doc_id")}
    first = edit_counts.counted(docs, keys, ranks, edit_counts.sample_edits(F.coalesce("text", F.lit(""))), full=True)
    assert first.count() == docs.count() and edit_counts.counted(nothing, keys, ranks).count() == 0
    more = spark.createDataFrame([(5, 2, 0, 4, "x"), (5, 1, 9, 9, "yy"), (77, 1, 0, 0, "")], "doc_id long, seq int, start int, end int, replacement string")
    after = edit_counts.recounted(edit_counts.attach(first, more), keys, ranks, F.col("edits")).collect()
    for r in after:
        assert r.edited_tokens == len(counter.encoding.encode_ordinary(r.edited_text)) and r.edited_chars == len(r.edited_text)


# --- shingle join ---------------------------------------------------------------


def shingles(text):
    words = "".join(c.lower() if c < "\x80" else c for c in text).replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_take_any_columns_and_rows(spark):
    """Names that operators use inside, nulls in any column, repeated rows, empty tables."""
    names = "_row _own_row _kept_row _copies _copy copies _kept_id _text_digest _kept_digest key row digest fp n hub component"
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names.split())
    text = " ".join(f"w{i}" for i in range(60))
    given = [(1, text, "a"), (2, text, "a"), (2, text, "a"), (3, text + " end", None), (None, "one", "a"), (4, None, "b"), (5, None, None), (6, "", "b"), (7, "x " * 9, "b")]
    rows = [(*r, *[str(k) if (k + n) % 3 else None for k in range(len(names.split()))]) for n, r in enumerate(given)]
    table = spark.createDataFrame(rows, schema)
    for stage in (exact_dedup.kept_rows, shingle_join.one_per_group, simhash.one_per_group, mixing.mixed_rows):
        kept = stage(table)
        assert kept.columns == table.columns
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in rows}
        assert stage(table.limit(0)).collect() == []
    assert sorted(r.doc_id for r in exact_dedup.kept_rows(table).where("doc_id is not null").collect()) == [2, 3, 6, 7]
    assert sorted(r.doc_id for r in shingle_join.one_per_group(table).where("doc_id is not null").collect()) == [1, 4, 7]


def test_row_keys_tell_nulls_apart(spark):
    from newsloom.llm.common import row_key

    rows = spark.createDataFrame([("x", None), (None, "x"), (None, None), ("", None)], "a string, b string")
    assert rows.select(row_key(rows).alias("k")).distinct().count() == 4


@pytest.mark.parametrize("frequent", [8, 10**9])
def test_shingle_groups_equal_brute_force(spark, monkeypatch, frequent):
    """Whatever the order of the shingles, by their frequency or by hash alone."""
    monkeypatch.setattr(shingle_join, "FREQUENT", frequent)
    monkeypatch.setattr(shingle_join, "COUNTED", 3000)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = rnd.choices(words, k=60)
    texts = []
    for g in range(12):
        base = rnd.choices(words, k=rnd.choice((8, 40, 160, 200))) + (passage if g % 3 == 0 else [])
        for k in range(8 if g else 40):
            copy = list(base)
            for _ in range(rnd.randrange(1 + len(base) // 20)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    texts += ["", " ", "one two", "One  two", "one three"]
    sets = [shingles(t) for t in texts]
    assert [len(shingle_join.shingle_set(t.encode())) for t in texts] == [len(s) for s in sets]
    group, missed = list(range(len(texts))), 0
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
                bits = (simhash.fingerprint(texts[a].encode()) ^ simhash.fingerprint(texts[b].encode())).bit_count()
                missed += bits > simhash.MAX_BITS
    assert missed > 100  # what three bits do not see
    table = spark.createDataFrame(rows_of(texts), DOCS)
    got = {r.doc_id: r.component_id for r in shingle_join.labelled(table, {"doc_id": F.col("doc_id")}).collect()}
    first = min(got)
    assert got == {first + i: first + g for i, g in enumerate(group)}
    assert sorted(r.doc_id - first for r in shingle_join.one_per_group(table).collect()) == sorted(set(group))


def test_pipeline_asks_simhash(spark, monkeypatch):
    """Near copies are linked by SimHash first, whose links are checked exactly."""
    import corpus_pipeline

    rnd = random.Random(2)
    base = [f"w{rnd.randrange(9000)}" for _ in range(1500)]
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join(["start", *base]), " ".join(base[:700]), "other words altogether and more"]
    table = spark.createDataFrame(rows_of(texts), DOCS)
    links, met = simhash.links, []

    def watched(nodes):
        found = links(nodes)
        met.append(found.count())
        return found

    monkeypatch.setattr(simhash, "links", watched)
    kept = corpus_pipeline.without_near_copies(spark, table, "")
    first = table.agg(F.min("doc_id")).first()[0]
    assert sorted(r.doc_id - first for r in kept.collect()) == [0, 3, 4]
    assert met and met[0] > 0
