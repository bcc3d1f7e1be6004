import math
import re
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsloom.operators import centrality as C
from newsloom.operators.embedding import get_embedder, hashed_embedder, model_embedder
from newsloom.plans import summaries
from newsloom.plans.compare import compare_methods
from newsloom.sources.articles import dealt

# The plug-ins defined here reach the workers by value; this file is not shipped.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOCS = [
    (0, ""),
    (1, "Only one sentence here"),
    (2, "  First   one. Second http://x.y one.  "),
    (3, "The cat sat. The dog sat. A bird flew. The cat and the dog slept."),
    (4, "Same words. Same words. Same words. Same words. Same words. Same words. Same words."),
    (5, "a. b! c? d. e."),
    (6, "Tin tức hôm nay rất hay. Trời đẹp quá! Hôm nay trời mưa. Tin tức mới. x. Hôm qua trời đẹp. Hay lắm."),
    (7, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string")


def split(text):
    return [s for s in re.split(r"(?<=[.!?]) ", " ".join(re.sub(r"http\S+", "", text).split())) if s]


def scores_by_matrix(vectors):
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms == 0, 1, norms)
    return np.round((unit @ unit.T).sum(axis=1), 9)


def tfidf_vectors(sentences):
    words = [re.findall(r"\w\w+", s.lower()) for s in sentences]
    vocabulary = sorted({w for ws in words for w in ws})
    df = [sum(w in ws for ws in words) for w in vocabulary]
    return np.array([[ws.count(w) * (math.log((1 + len(words)) / (1 + d)) + 1) for w, d in zip(vocabulary, df)] for ws in words]).reshape(len(words), -1)


def expected(sentences, scores, ratio, higher_first):
    n = len(sentences)
    k = n if n <= 2 else max(1, int(n * ratio))
    if n > 2 and not scores.any():
        return " ".join(sentences[:k])
    order = sorted(range(n), key=lambda i: (-scores[i], -i if higher_first else i))
    return " ".join(sentences[i] for i in sorted(order[:k]))


def collected(made):
    rows = made.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r.summary for r in rows}


@pytest.mark.parametrize("ratio", [0.2, 0.3, 0.6])
def test_summaries_match_the_matrix_form(docs, ratio):
    position = collected(summaries.position_summary(docs.where("text is not null"), ratio))
    tfidf = collected(summaries.tfidf_summary(docs.where("text is not null"), ratio))
    central = collected(summaries.embedding_summary(docs.where("text is not null"), ratio))
    hashed = {r.t: r.v for r in hashed_vectors(docs).collect()}
    for i, text in DOCS[:-1]:
        parts = split(text)
        n = len(parts)
        assert position[i] == " ".join(parts[: n if n <= 2 else max(1, int(n * ratio))])
        if parts:
            assert tfidf[i] == expected(parts, scores_by_matrix(tfidf_vectors(parts)), ratio, True)
            assert central[i] == expected(parts, scores_by_matrix(np.array([hashed[p] for p in parts])), ratio, False)
        else:
            assert tfidf[i] == central[i] == ""


def hashed_vectors(docs):
    parts = C.explode_sentences(C.with_sentences(docs)).select(F.col("sentence").alias("t")).distinct()
    return get_embedder().embed(parts, "t", "v")


def test_hashed_embedder(spark):
    import hashlib

    rows = spark.createDataFrame([("two words, two",), ("",), (None,)], "t string")
    got = [r.v for r in hashed_embedder(8, "s").embed(rows, "t", "v").collect()]
    want = [0.0] * 8
    for w in ("two", "words", "two"):
        want[int(hashlib.md5(("s" + w).encode()).hexdigest()[:8], 16) % 8] += 1
    assert got == [want, [0.0] * 8, [0.0] * 8]


def test_dense_centrality_sorts_narrow_rows(spark, plan):
    """What is sorted holds the given vector only, and the window sorts nothing again; zero vectors score 0."""
    vectors = {1: [[3.0, 4.0], [0.0, 0.0], [3.0, 4.0]], 2: [[0.0, 0.0]], None: [[1.0, 1.0], [2.0, 0.0]]}
    rows = [(d, i, v) for d, vs in vectors.items() for i, v in enumerate(vs)]
    scored = C.dense_centrality(spark.createDataFrame(rows, "doc_id long, idx int, embedding array<float>"))
    assert scored.columns == ["doc_id", "idx", "score"]
    split = C.split_documents(spark.createDataFrame([(1, "A b. C d.")], "doc_id long, text string"))
    steps = plan(C.dense_centrality(C.embed_sentences(C.explode_sentences(split), get_embedder()))).splitlines()
    sorts = [i for i, step in enumerate(steps) if " Sort [" in step]
    assert len(sorts) == 1 and any(" Window [" in s for s in steps[: sorts[0]])
    below = steps[sorts[0] + 1].split("Generate")[-1] if "Generate" in steps[sorts[0] + 1] else steps[sorts[0] + 1]
    assert "_unit" not in below and "embedding" in below
    half = round(1 + 0.5**0.5, 9)
    want = [(1, 0, 2.0), (1, 1, 0.0), (1, 2, 2.0), (2, 0, 0.0), (None, 0, half), (None, 1, half)]
    assert sorted(map(str, map(tuple, scored.collect()))) == sorted(map(str, want))
    assert C.dense_centrality(spark.createDataFrame([], "doc_id long, idx int, embedding array<float>")).count() == 0


def test_tfidf_needs_one_exchange(docs, plan):
    text = plan(C.sparse_centrality(C.tfidf_weights(C.explode_sentences(C.split_documents(docs)))))
    assert text.count("Exchange hashpartitioning") == 1
    text = plan(C.dense_centrality(C.embed_sentences(C.explode_sentences(C.split_documents(docs)), get_embedder())))
    assert text.count("Exchange hashpartitioning") == 1 and "ArrowEval" not in text


def test_methods_split_once(spark, docs, plan):
    """All users of the split read one exchange; the comparison adds the scan of the lengths."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        alone = [plan(f(docs)) for f in (summaries.tfidf_summary, summaries.embedding_summary)]
        together = plan(compare_methods(docs, ["position", "tfidf", "embedding"]))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Exchange" not in alone[0] and "Sort" not in alone[0]
    for text, reused in [(alone[1], 1), (together, 3)]:
        assert text.count("ReusedExchange") == reused
        assert text.count("REPARTITION_BY_COL") == 1 + reused


@pytest.mark.parametrize("block", [1, 50, 1 << 20])
def test_scores_of_whole_documents(docs, block):
    """The arrays hold what the rows hold, however the documents are cut into blocks."""
    split = C.with_sentences(docs).coalesce(1)
    arrays = C.with_tfidf_scores(split, block).select("doc_id", F.posexplode("scores").alias("idx", "s"))
    got = {(r.doc_id, r.idx): round(r.s, 9) for r in arrays.collect()}
    rows = C.sparse_centrality(C.tfidf_weights(C.explode_sentences(C.split_documents(docs)))).collect()
    assert got == {(r.doc_id, r.idx): pytest.approx(r.score, abs=2e-9) for r in rows} and got


def test_dealt_scans(spark, docs):
    cores = spark.sparkContext.defaultParallelism
    few, many = docs.coalesce(1), docs.repartition(2 * cores)
    assert dealt(few).rdd.getNumPartitions() == cores and dealt(few).count() == docs.count()
    assert dealt(many) is many


def test_position_summary_does_not_shuffle(docs, plan):
    assert "Exchange" not in plan(summaries.position_summary(docs))


def test_similarity_rows(spark, docs):
    weights = C.tfidf_weights(C.explode_sentences(C.split_documents(docs.where("doc_id = 3"))))
    wanted = spark.createDataFrame([(3, i) for i in range(4)], "doc_id bigint, idx int")
    got = {(r.row_idx, r.idx): r.similarity for r in C.similarity_rows(weights, wanted).collect()}
    v = tfidf_vectors(split(DOCS[3][1]))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(4):
        for j in range(4):
            assert got.get((i, j), 0.0) == pytest.approx(unit[i] @ unit[j], abs=1e-8)


def flaky():
    def generate(prompts):
        if any("dog" in p for p in prompts) and len(prompts) > 1:
            raise RuntimeError("bad batch")
        out = []
        for p in prompts:
            if p.startswith("summarize: ") and "cat" in p:
                raise RuntimeError("bad prompt")
            out.append("123" if p.startswith("summarize: ") else p.upper()[:40])
        return out

    return generate


def never():
    raise RuntimeError("no weights")


def test_generation_chain(docs):
    some = docs.where("doc_id in (1, 3)")
    got = collected(summaries.generated_summary(some, "flaky", flaky))
    assert got[1] == "TÓM TẮT: ONLY ONE SENTENCE HERE"
    assert got[3].startswith("TÓM TẮT: THE CAT SAT. THE DOG SAT.")
    assert collected(summaries.generated_summary(some, "never", never)) == {1: None, 3: None}


def digits():
    return lambda prompts: ["1 2 3 4"] * len(prompts)


def test_generation_without_usable_output(docs):
    some = docs.where("doc_id = 1")
    assert collected(summaries.generated_summary(some, "digits", digits))[1] == summaries.NO_SUMMARY
    assert collected(summaries.generated_summary(some, "digits", digits, keep_last=True))[1] == "1 2 3 4"


def lengths():
    return lambda texts: np.array([[len(t), 1.0] for t in texts])


def test_plugins(docs):
    embedder = model_embedder("lengths", 2, lengths)
    got = {r.doc_id: r.v for r in embedder.embed(docs, "text", "v").collect()}
    assert got[1] == [22.0, 1.0] and got[7] is None
    central = collected(summaries.embedding_summary(docs.where("doc_id = 3"), 0.3, embedder))
    assert central[3] in split(DOCS[3][1])
    first = summaries.row_summarizer("first", lambda: lambda text, ratio: text.split(".")[0] + str(ratio))
    assert collected(first(docs.where("doc_id = 3"), 0.5))[3] == "The cat sat0.5"
    with pytest.raises(KeyError):
        summaries.get_summarizer("nothing")
    with pytest.raises(KeyError):
        get_embedder("nothing")


def test_two_summaries(spark):
    articles = spark.createDataFrame(
        [(i, t) for i, t in DOCS if i != 1], "id bigint, content_plain_text string"
    )
    results = spark.createDataFrame(
        [(3, "s", "d"), (4, "s", ""), (5, None, "d"), (6, "s", "d")], "news_id bigint, summary_short string, summary_default string"
    )
    requests = spark.createDataFrame(
        [(i, i == 6) for i in range(8)], "news_id bigint, force boolean"
    )
    looked = {r.news_id: (r.generate_hit, r.read_hit) for r in summaries.summary_requests(requests, results).collect()}
    assert looked == {0: (False, False), 1: (False, False), 2: (False, False), 3: (True, True), 4: (False, True), 5: (False, True), 6: (False, True), 7: (False, False)}
    made = {r.news_id: r for r in summaries.summarize_misses(requests, articles, results, ("digits", digits), get_embedder()).collect()}
    assert {i: r.status for i, r in made.items()} == {0: "no_content", 1: "not_found", 2: "ok", 4: "ok", 5: "ok", 6: "ok", 7: "no_content"}
    assert made[4].short_method == "generated" and made[4].default_method == "embedding"
    absent = {r.news_id: r for r in summaries.summarize_misses(requests, articles, results, ("never", never)).collect()}
    parts = split(DOCS[6][1])
    assert absent[6].summary_short == " ".join(parts[:1]) and absent[6].summary_default == " ".join(parts[:2])
    assert absent[6].short_method == absent[6].default_method == "position"


def test_compare(docs):
    table = compare_methods(docs.where("length(text) > 0"), ["position", "tfidf"]).toPandas().set_index("method")
    assert set(table.index) == {"position", "tfidf"} and (table.n_docs == 6).all()
    assert (table.avg_compression <= 1).all() and isinstance(table, pd.DataFrame)


def brute_weights(rows):
    """{(doc_id, n, idx, term): (tf, df, weight)} and scores {(doc_id, idx)}, cell by cell."""
    import math
    import re
    from collections import Counter, defaultdict

    tf, df, squares, totals, scores = Counter(), Counter(), Counter(), Counter(), defaultdict(float)
    for i, n, idx, text in rows:
        found = re.findall(r"\w{2,}", (text or "").lower())
        for t in found or [None]:
            tf[i, n, idx, t] += bool(found)
    for i, _, _, t in tf:
        df[i, t] += t is not None
    raw = {c: v * (math.log((1 + c[1]) / (1 + df[c[0], c[3]])) + 1) for c, v in tf.items()}
    for c, x in raw.items():
        squares[c[0], c[2]] += x * x
    made = {c: (tf[c], df[c[0], c[3]], x / squares[c[0], c[2]] ** 0.5 if squares[c[0], c[2]] else 0.0) for c, x in raw.items()}
    for c, (_, _, w) in made.items():
        totals[c[0], c[3]] += w
    for c, (_, _, w) in made.items():
        scores[c[0], c[2]] += w * totals[c[0], c[3]]
    return made, scores


@pytest.mark.parametrize("block", [1, 1 << 18])
def test_weights_of_odd_sentences(spark, plan, monkeypatch, block):
    """Repeated ids and sentences, empty and null ones; terms are neither sent, sorted nor joined."""
    monkeypatch.setattr(C, "TERMS_PER_BLOCK", block)
    rows = [(1, 3, 0, "cat dog"), (1, 3, 1, "dog dog bird"), (1, 3, 2, "!"), (2, 1, 0, "cat"), (2, 2, 0, "cat owl"), (2, 2, 1, None)]
    rows += [(3, 2, 0, "same words"), (3, 2, 0, "same words"), (3, 2, 1, "words ạo"), (4, 1, 0, "?")]
    given = spark.createDataFrame(rows, "doc_id bigint, n_sentences int, idx int, sentence string").repartition("doc_id")
    weights = C.tfidf_weights(given)
    want, scores = brute_weights(rows)
    got = {(r.doc_id, r.n_sentences, r.idx, r.term): (r.tf, r.df, r.weight) for r in weights.collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)
    assert {(r.doc_id, r.idx): r.score for r in C.sparse_centrality(weights).collect()} == pytest.approx(scores, abs=1e-8)
    assert {(r.doc_id, r.idx): r.score for r in C.sparse_centrality(weights.drop("sentence_score")).collect()} == pytest.approx(scores, abs=1e-8)
    best = C.rank_sentences(C.sparse_centrality(weights)).where("rank = 1")
    asked = best.union(best.where("doc_id = 1"))
    pairs = {}
    for r in best.collect():
        for (i, _, idx, t), (_, _, w) in want.items():
            for (j, _, other, u), (_, _, x) in want.items():
                if i == j == r.doc_id and idx == r.idx and t == u is not None:
                    pairs[i, idx, other] = pairs.get((i, idx, other), 0) + w * x * (2 if i == 1 else 1)
    for rows_ in (C.similarity_rows(weights, asked), C.similarity_rows(weights.select("*"), asked)):
        assert {(r.doc_id, r.row_idx, r.idx): r.similarity for r in rows_.collect()} == pytest.approx(pairs, abs=1e-8)
    text = plan(C.similarity_rows(weights, best))
    assert "SortMergeJoin" not in text and "term" not in "".join(x for x in text.splitlines() if "Exchange" in x or " Sort" in x)
