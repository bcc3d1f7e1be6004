import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions.vectors import cosine, l2_normalize
from newsloom.operators import similarity as S

SCHEMA = "news_id bigint, category string, title string, embedding array<float>"


def table(spark, rows):
    return spark.createDataFrame([(i, c, f"t{i}", None if v is None else [float(x) for x in v]) for i, c, v in rows], SCHEMA)


def brute_force(rows, news_id, k, category=None):
    vectors = {i: np.array(v, dtype=np.float32).astype(float) for i, _, v in rows if v is not None}
    source, out = vectors[news_id], []
    for i, c, v in rows:
        if i == news_id or v is None or (category is not None and c != category):
            continue
        scale = np.linalg.norm(source) * np.linalg.norm(vectors[i])
        score = float(source @ vectors[i] / scale) if scale else 0.0
        if score >= 0.1:
            out.append((-round(score, 9), i))
    return [(i, round(-s, 4)) for s, i in sorted(out)[:k]]


def answers(found):
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.source_news_id, r.k, r.category_filter or "", r["rank"])):
        got.setdefault((r.source_news_id, r.k, r.category_filter), []).append((r.news_id, r.similarity_score))
    return got


@pytest.fixture(scope="module")
def crowd():
    """Clusters, a third of all rows equal, zero and opposite vectors, a category of one."""
    dice = np.random.default_rng(3)
    centres = dice.normal(size=(5, 6))
    rows = [(i, f"c{i % 3}", centres[i % 5] + 0.3 * dice.normal(size=6)) for i in range(120)]
    rows += [(200 + i, f"c{i % 3}", centres[0]) for i in range(60)]
    rows += [(300, "c0", np.zeros(6)), (301, "c1", -centres[0]), (302, "alone", centres[1])]
    return rows


def test_cosine_and_norm(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = rows.select(cosine(F.col("a"), F.col("b")).alias("c"), l2_normalize(F.col("a")).alias("u")).collect()
    assert got[0].c == pytest.approx(0.96) and got[1].c == 0.0
    assert got[0].u == pytest.approx([0.6, 0.8]) and got[1].u == [0.0, 0.0]


@pytest.mark.parametrize("lists,nprobe,tile", [(None, 8, 2048), (1, 1, 7), (12, 1, 5), (6, 2, 1000)])
def test_top_k_equals_brute_force(spark, crowd, lists, nprobe, tile):
    index = table(spark, crowd)
    requests = S.all_requests(index, 1).union(S.all_requests(index, 10)).union(S.all_requests(index, 50))
    got = answers(S.top_k(requests, index, n_lists=lists, nprobe=nprobe, rows_per_tile=tile))
    for k in (1, 10, 50):
        for i, _, _ in crowd:
            assert got.get((i, k, None), []) == brute_force(crowd, i, k), (i, k)


def test_mixed_requests(spark, crowd):
    """Different k and filters for one source, filters of other categories, and requests without an answer."""
    index = table(spark, crowd)
    asked = [(0, 5, None), (0, 7, "c1"), (1, 50, "c0"), (302, 3, "alone"), (5, 4, "none"), (999, 5, None), (0, 51, None), (0, 0, "c1"), (300, 5, None)]
    requests = spark.createDataFrame(asked, "news_id bigint, k int, category_filter string")
    for lists in (None, 9):
        got = answers(S.top_k(requests, index, n_lists=lists, nprobe=1, rows_per_tile=16))
        for i, k, c in asked[:3]:
            assert got[(i, k, c)] == brute_force(crowd, i, k, c)
        assert set(got) == {asked[0], asked[1], asked[2]}
    statuses = S.with_source(S.check_requests(requests), index).select("status").collect()
    assert sorted(r.status for r in statuses) == ["invalid"] * 2 + ["ok"] * 6 + ["source_missing"]


def test_score_floor(spark):
    just = 0.1
    rows = [(1, "a", [1, 0]), (2, "a", [just + 1e-4, (1 - (just + 1e-4) ** 2) ** 0.5]), (3, "a", [just - 1e-4, (1 - (just - 1e-4) ** 2) ** 0.5])]
    index = table(spark, rows)
    assert [i for i, _ in answers(S.top_k(S.all_requests(index), index))[(1, 10, None)]] == [2]
    assert [r.news_id for r in S.similar_to(index, 1).collect()] == [2]


def test_similar_to(spark, crowd, plan):
    index = table(spark, crowd)
    for i, category in ((0, None), (200, None), (7, "c2"), (300, None), (999, None)):
        got = [(r.news_id, r.similarity_score) for r in S.similar_to(index, i, 12, category).orderBy("rank").collect()]
        assert got == ([] if i == 999 else brute_force(crowd, i, 12, category))
    text = plan(S.similar_to(index, 0))
    assert "TakeOrderedAndProject" in text and "Join" not in text


def test_plans_have_no_cross_join(spark, crowd, plan):
    index = table(spark, crowd)
    for same in (False, True):
        for lists in (None, 8):
            text = plan(S.top_k(S.all_requests(index, 10, same), index, n_lists=lists, nprobe=1))
            assert "CartesianProduct" not in text and "NestedLoop" not in text
            assert "WindowGroupLimit" in text


def test_scores_fall_and_recall(spark, crowd):
    index = table(spark, crowd)
    exact = S.top_k(S.all_requests(index), index)
    for matches in answers(exact).values():
        scores = [s for _, s in matches]
        assert scores == sorted(scores, reverse=True) and min(scores) >= 0.1
    centres = S.train_lists(index, n_lists=6)
    near = S.top_k_approximate(S.all_requests(index), index, centres, nprobe=3)
    assert S.recall(near, exact).first().recall > 0.9
    every = S.top_k_approximate(S.all_requests(index), index, centres, nprobe=6)
    assert S.recall(every, exact).first().recall == 1.0


@pytest.mark.parametrize("lists,nprobe,bytes_", [(9, 1, 1), (30, 2, 1), (16, 1, 64 << 20)])
def test_pivot_tree_equals_brute_force(spark, crowd, monkeypatch, lists, nprobe, bytes_):
    """Pivots that are too large to broadcast become a tree instead of an error; results stay exact."""
    monkeypatch.setattr(S, "MAX_PIVOT_BYTES", bytes_)
    monkeypatch.setattr(S, "ROWS_PER_BRANCH_PART", 7)
    index = table(spark, crowd)
    levels = 2 if bytes_ > 1 else None
    assert isinstance(S.choose_pivots(index, lists, levels), S.PivotTree)
    requests = S.all_requests(index, 10).union(S.all_requests(index, 3, same_category=True))
    got = answers(S.top_k(requests, index, n_lists=lists, nprobe=nprobe, rows_per_tile=11, levels=levels))
    for i, c, _ in crowd:
        assert got.get((i, 10, None), []) == brute_force(crowd, i, 10), i
        assert got.get((i, 3, c), []) == brute_force(crowd, i, 3, c), i


def test_pivot_tree_of_odd_tables(spark):
    zeros = table(spark, [(1, "a", [0, 0]), (2, "a", None)])
    assert len(S.choose_pivots(zeros, 4, 2)) == 0 and S.top_k(S.all_requests(zeros), zeros, n_lists=4, levels=2).count() == 0
    same = table(spark, [(i, "a", [1, 2]) for i in range(9)])
    got = answers(S.top_k(S.all_requests(same, 3), same, n_lists=5, nprobe=1, levels=2))
    assert [i for i, _ in got[(4, 3, None)]] == [0, 1, 2] and [i for i, _ in got[(0, 3, None)]] == [1, 2, 3]


def test_spilled_lists(spark, crowd):
    """Each vector is filed once per list; what two lists both find is one match; a wider stop visits more."""
    index = table(spark, crowd)
    centres = S.train_lists(index, n_lists=6)
    filed = S.with_lists(index.where("news_id <> 300").select("news_id", "embedding"), centres, 3).collect()
    lists = {}
    for r in filed:
        lists.setdefault(r.news_id, []).append(r.list_id)
    assert all(len(x) == len(set(x)) == 3 for x in lists.values()) and len(lists) == len(crowd) - 1
    first = S.with_list(index.where("news_id <> 300").select("news_id", "embedding"), centres).collect()
    assert all(lists[r.news_id][0] == r.list_id for r in first)
    exact = S.top_k(S.all_requests(index), index)
    every = S.top_k_approximate(S.all_requests(index), index, centres, nprobe=6, spill=3, stop=0.0)
    assert answers(every) == answers(exact)
    shares = [S.scored_share(S.all_requests(index), index, centres, nprobe=1, spill=1, stop=stop).first() for stop in (0.0, 0.5, 9.0)]
    assert shares[0].lists_visited == 1 < shares[1].lists_visited < shares[2].lists_visited == 6 and shares[2].scored_share == 1
    near = S.top_k_approximate(S.all_requests(index), index, centres, nprobe=1, spill=2, stop=0.6)
    assert S.recall(near, exact).first().recall > 0.9


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_registered_recall(spark, folder):
    from newsloom.workloads import approximate_recall

    found = approximate_recall(spark, f"/root/testdata/{folder}").first()
    assert found.recall >= 0.9 and found.scored_share < 0.95


@pytest.mark.parametrize("cells,least,most", [(3, 10, 1 << 15), (64, 1, 1 << 15), (4, 5, 20)])
def test_chunks_and_tiles_equal_brute_force(spark, crowd, monkeypatch, cells, least, most):
    """However requests and candidates are cut, and although id lists are forgotten meanwhile."""
    for name, value in (("CELLS", cells), ("MIN_CHUNK", least), ("MAX_CHUNK", most)):
        monkeypatch.setattr(S, name, value)
    index = table(spark, crowd)
    requests = S.all_requests(index, 4).union(S.all_requests(index, 50, same_category=True))
    for lists in (1, 12):
        got = answers(S.top_k(requests, index, n_lists=lists, nprobe=2, rows_per_tile=9))
        for i, c, _ in crowd:
            assert got.get((i, 4, None), []) == brute_force(crowd, i, 4), i
            assert got.get((i, 50, c), []) == brute_force(crowd, i, 50, c), i


def test_vectors_are_sent_once_per_chunk(spark):
    """Neither side is sent once per list or tile that it meets: six times the rows are sent as often, not six times as often."""
    def sent(n):
        row = spark.range(1).select(*S._grid(F.lit(n), F.lit(n), S.ROWS_PER_TILE)).first()
        return row.chunks + row.tiles

    assert sent(100_000) == sent(500_000) == S.CELLS + 1 and sent(600_000) <= S.CELLS + 4
    assert sent(1) == sent(2000) == 2


def test_forgotten_lists():
    import pyarrow as pa

    dice = np.random.default_rng(1)
    vectors = dice.normal(size=(4000, 3))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)

    def batch(rows, **more):
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * 3, pa.int32()), pa.array(rows.ravel()))
        return pa.RecordBatch.from_pydict({"embedding": flat, **more})

    asked = S._Asked([batch(vectors[:5], space=["*"] * 5, key_a=range(5), key_b=range(5), bound=[0.1] * 5, lists=pa.nulls(5, pa.list_(pa.int32())))], 2, 0.1, S._Route())
    order = np.argsort(vectors[:, 0])
    for at in np.array_split(order, 80):
        asked.meet(0, batch(vectors[at], ids=[[int(i), int(i) + 10000] for i in at]))
        asked._shrink() if asked.pool else None
    got = pa.Table.from_batches(list(asked.found())).to_pylist()
    assert len(got) == 10 and asked.pooled <= 10
    for q in range(5):
        best = np.argsort(-np.round(vectors @ vectors[q], 9), kind="stable")[:2]
        assert [r["ids"] for r in got if r["key_a"] == q] == [[int(i), int(i) + 10000] for i in best]


def test_rows_of_one_id_take_one_place():
    """Where ids are to stand once, copies of a row do not use up a query's places."""
    import pyarrow as pa

    vectors = np.array([[1.0, 0.0], [0.9, 0.1], [0.8, 0.2], [0.7, 0.3]])

    def batch(rows, **more):
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * 2, pa.int32()), pa.array(rows.ravel()))
        return pa.RecordBatch.from_pydict({"embedding": flat, **more})

    for once, want in ((True, [10, 11, 12]), (False, [10, 10, 11])):
        query = batch(vectors[:1], space=["*"], key_a=[0], key_b=[0], bound=[0.1], lists=pa.nulls(1, pa.list_(pa.int32())), keep=pa.array([3], pa.int32()), whole=[True])
        asked = S._Asked([query], 9, 0.1, S._Route(once=once))
        asked.meet(0, batch(vectors, ids=[[10 + i, 10 + i] for i in range(4)]))
        assert [r["ids"] for r in pa.Table.from_batches(list(asked.packed())).to_pylist()] == [want]
