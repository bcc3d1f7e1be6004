import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from newsloom import workloads as W
from newsloom.operators import constraints, merge, stats
from newsloom.plans import audio, indexing, recommend
from newsloom.schemas import EMBEDDING, RESULT
from newsloom.session import scratch_path
from newsloom.sources import articles as A
from newsloom.sources.batches import BatchTable
from newsloom.sources.buckets import BucketTable
from newsloom.streaming.index_stream import index_stream
from newsloom.streaming.ttl import computed_once, computed_once_native
from newsloom.streaming.ttl_split import COMPUTED, chained, computed_once_split, next_steps

ARTICLE_FIELDS = "id bigint, title string, description string, category string, publisher_id bigint, content_plain_text string"
EDGE_ARTICLES = [
    (1, "A title", "words", "c1", None, "Text one."),
    (2, None, "d", "c1", None, "x"),
    (3, "", "d", "c1", None, "x"),
    (4, "  ", None, None, None, ""),
    (5, "Five", "", "", None, None),
    (6, "Six", "d", "x" * 51, None, "x"),
    (7, "Seven", "d", "c2", None, "x"),
    (7, "Seven again", "d", "c2", None, "x"),
]


def at(text):
    return F.lit(text).cast("timestamp")


T0, T1 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


def index_of(spark):
    return BatchTable(spark, scratch_path(spark, "index"), EMBEDDING, partition_by="category")


def test_pages(spark):
    ids = [(i * 7 if i < 900 else 10**15 + i,) for i in range(1000)]
    rows = spark.createDataFrame(ids, "id bigint")
    for page in (0, 2, 9, 17, 19, 20):
        got = [r.id for r in A.page_of(rows, page, 50).collect()]
        assert got == sorted(i for i, in ids)[page * 50 : page * 50 + 50], page
    keys = [None] * 3 + [f"k{i:03}" for i in range(20)]
    named = spark.createDataFrame([(k,) for k in keys], "id string").repartition(4)
    for page in range(6):
        assert [r.id for r in A.page_of(named, page, 5).collect()] == keys[page * 5 : page * 5 + 5], page
    for page, size in ((-1, 10), (0, 0), (0, 201)):
        with pytest.raises(ValueError):
            A.page_of(rows, page, size)


def test_read_formats(spark, tmp_path):
    rows = spark.createDataFrame(EDGE_ARTICLES, ARTICLE_FIELDS)
    for fmt in ("parquet", "json", "orc"):
        rows.write.format(fmt).save(str(tmp_path / fmt))
        back = A.read_articles(spark, str(tmp_path / fmt), fmt)
        assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_violations(spark):
    rows = spark.createDataFrame(
        [(1, "c", "t", [1.0, 2.0]), (None, None, None, None), (2, "x" * 51, "t", [1.0]), (3, "x" * 50, "", [0.0, 0.0])],
        "news_id bigint, category string, title string, embedding array<float>",
    )
    checked = constraints.with_violations(rows, 2)
    assert [r.violations for r in checked.collect()] == [
        [], ["news_id_null", "category_null", "title_null", "embedding_null"], ["category_too_long", "embedding_dim"], []
    ]
    assert constraints.valid_rows(checked).count() == 2 and constraints.quarantined_rows(checked).count() == 2


def test_batch_table(spark):
    stored = BatchTable(spark, scratch_path(spark, "t"), EMBEDDING, partition_by="category")
    row = lambda i: spark.createDataFrame([(i, "c", "t", [1.0], None, None)], EMBEDDING)
    assert stored.read().count() == 0
    assert stored.append(row(1), "a") and not stored.append(row(2), "a")
    stored.append(row(3))
    assert sorted(r.news_id for r in stored.read().collect()) == [1, 3]

    broken = row(4).withColumn("title", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception):
        stored.append(broken, "b")
    assert sorted(r.news_id for r in stored.read().collect()) == [1, 3] and not stored.has_batch("b")

    stored.replace(stored.read().where("news_id = 3"))
    stored.append(row(5))
    assert sorted(r.news_id for r in stored.read().collect()) == [3, 5]
    stored.compact()
    assert len(stored.committed()) == 1 and stored.read().count() == 2
    assert not stored.append(row(6), "a")

    late = stored._name("delta", "late")
    stored.compact()
    stored._write(row(7), late)
    assert sorted(r.news_id for r in stored.read().collect()) == [3, 5, 7] and stored.has_batch("late")
    folders = stored.committed()
    kept = stored.read(folders).where("news_id <> 3")
    stored.append(row(8))
    stored.replace(kept, folders)
    assert sorted(r.news_id for r in stored.read().collect()) == [5, 7, 8]


def result(spark, rows):
    return spark.createDataFrame(rows, RESULT)


def test_upsert_and_delete(spark):
    t = dt.datetime(2023, 1, 1)
    file = ("Doan", "d", "u", "k", "f")
    existing = result(spark, [(1, [file], "s1", "m1", "d1", t, t), (2, [], None, "m2", None, t, t)])
    updates = spark.createDataFrame([(2, "new", None), (3, "three", "x")], "news_id bigint, summary_short string, summary_default string")
    after = {r.news_id: r for r in merge.upsert(existing, updates, at(T1)).collect()}
    assert after[1].updated_at == t and len(after[1].audio_files) == 1
    assert (after[2].summary_short, after[2].summary_medium, after[2].summary_default) == ("new", "m2", None)
    assert after[2].created_at == t and after[2].updated_at > t
    assert after[3].audio_files == [] and after[3].summary_medium is None and after[3].created_at == after[3].updated_at
    keys = spark.createDataFrame([(1,), (9,)], "news_id bigint")
    assert [r.news_id for r in merge.delete_keys(existing, keys).collect()] == [2]
    assert {r.news_id: r.deleted for r in merge.deletion_report(existing, keys).collect()} == {1: True, 9: False}


def test_index_twice_adds_nothing(spark):
    rows = spark.createDataFrame(EDGE_ARTICLES, ARTICLE_FIELDS)
    stored = index_of(spark)
    bad = scratch_path(spark, "quarantine")
    first = indexing.index_batch(rows, stored, at(T0), quarantine=bad)
    assert stats.tally(first).first().asDict() == {
        "indexed": 4, "skipped": 2, "already_indexed": 0, "no_title": 2, "invalid": 1
    }
    assert [r.violations for r in spark.read.parquet(bad).collect()] == [["category_too_long"]]
    got = {r.news_id: r for r in stored.read().collect()}
    assert set(got) == {1, 4, 5, 7} and got[4].category == got[5].category == "UNKNOWN" and got[7].title == "Seven"
    indexing.index_batch(rows, stored, at(T1))
    assert stored.read().count() == 4
    counted = stats.index_stats(stored.read()).first()
    assert counted.total_embeddings == 4 and counted.by_category == {"UNKNOWN": 2, "c1": 1, "c2": 1}


def test_index_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    rows = spark.createDataFrame(EDGE_ARTICLES, ARTICLE_FIELDS)
    stored, checkpoint = index_of(spark), str(tmp_path / "cp")

    def run():
        stream = spark.readStream.schema(ARTICLE_FIELDS).parquet(str(inbox))
        index_stream(stream, stored, at(T0), checkpoint).awaitTermination()

    rows.where("id < 5").coalesce(1).write.parquet(str(inbox), mode="append")
    run()
    assert sorted(r.news_id for r in stored.read().collect()) == [1, 4]
    rows.coalesce(1).write.parquet(str(inbox), mode="append")
    run()
    run()
    assert sorted(r.news_id for r in stored.read().collect()) == [1, 4, 5, 7]


def test_cache(spark):
    items = [(2, "t", "c", 0.5)]
    when = lambda h, m=0, s=0: dt.datetime(2024, 1, 1, h, m, s)
    from newsloom.schemas import CACHED_LIST

    cache = spark.createDataFrame(
        [
            (1, 10, "all", items, when(0), when(12, 0, 1)),
            (2, 10, "all", items, when(0), when(12)),
            (3, 10, "all", [], when(0), when(13)),
            (4, 10, "c1", items, when(0), when(13)),
        ],
        CACHED_LIST,
    )
    requests = spark.createDataFrame(
        [(1, 10, None), (2, 10, None), (3, 10, ""), (4, 10, None), (4, 10, "c1"), (1, 9, None)], "news_id bigint, k int, category_filter string"
    )
    looked = recommend.read_cache(requests, cache, at("2024-01-01 12:00:00")).collect()
    assert {(r.news_id, r.k, r.category_key) for r in looked if r.hit} == {(1, 10, "all"), (3, 10, "all"), (4, 10, "c1")}
    changed = spark.createDataFrame([("c2",)], "category string")
    assert [r.news_id for r in recommend.invalidate(cache, changed).collect()] == [4]
    assert recommend.invalidate(cache, changed.where("false")).count() == 4


def test_serve(spark):
    rows = [(1, "a", "t1", [1.0, 0.0]), (2, "a", "t2", [1.0, 0.1]), (3, "b", "t3", [0.0, 1.0]), (4, "alone", "t4", [1.0, 1.0])]
    index = spark.createDataFrame(rows, "news_id bigint, category string, title string, embedding array<float>")
    from newsloom.schemas import CACHED_LIST

    cache = spark.createDataFrame([], CACHED_LIST)
    asked = [(1, 5, None), (1, 5, "b"), (4, 5, "alone"), (9, 5, None), (1, 5, "none"), (1, 99, None)]
    requests = spark.createDataFrame(asked, "news_id bigint, k int, category_filter string")
    answers, after = recommend.serve(requests, index, cache, at(T0))
    got = {(r.news_id, r.k, r.category_key): (None if r["items"] is None else [i.news_id for i in r["items"]], r.cached) for r in answers.collect()}
    assert got == {
        (1, 5, "all"): ([2, 4], False), (1, 5, "b"): ([], False), (4, 5, "alone"): (None, False),
        (9, 5, "all"): (None, False), (1, 5, "none"): (None, False), (1, 99, "all"): (None, False),
    }
    again, _ = recommend.serve(requests, index, after, at("2024-01-01 00:59:59"))
    assert {(r.news_id, r.category_key) for r in again.collect() if r.cached} == {(1, "all"), (1, "b")}
    late, _ = recommend.serve(requests, index, after, at("2024-01-01 01:00:00"))
    assert not any(r.cached for r in late.collect())


def test_audio(spark):
    articles = spark.createDataFrame(EDGE_ARTICLES[:5] + EDGE_ARTICLES[6:7], ARTICLE_FIELDS)
    file = ("Doan", "d", "u", "k7", "f")
    results = result(spark, [(7, [file], None, None, None, None, None), (1, [], None, None, None, None, None)])
    requests = spark.createDataFrame([(1,), (4,), (5,), (7,), (99,)], "news_id bigint")
    voices = audio.default_voices(spark)
    work = audio.work_list(requests, articles, results, voices)
    got = sorted((r.news_id, r.status, r.voice_id or "") for r in work.collect())
    assert got == [(1, "ok", "Binh"), (1, "ok", "Doan"), (4, "no_content", ""), (5, "no_content", ""), (99, "not_found", "")]
    made = audio.manifest(work.where("status = 'ok'"), at(T0))
    assert audio.audio_files(made.where("voice_id = 'Doan'"), 2).count() == 0
    after = {r.news_id: r for r in audio.store_audio(results, audio.audio_files(made, 2), at(T1)).collect()}
    assert [f.voice_id for f in after[1].audio_files] == ["Binh", "Doan"] and len(after[7].audio_files) == 1
    assert sorted((r.news_id, r.voice_id) for r in audio.missing_voices(articles.where("id = 7"), results, voices).collect()) == [(7, "Binh")]

    links = spark.createDataFrame([("k7", dt.datetime(2024, 1, 1))], "s3_key string, signed_at timestamp")
    for seconds, due in ((86339, 0), (86340, 1), (86341, 1)):
        now = F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds))
        assert audio.links_to_refresh(results, links, now).count() == due


def test_ttl_stream(spark, tmp_path):
    def second(s):
        return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)

    schema = "key string, ts timestamp"
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(name, stream):
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp{name}"))
        writer.trigger(availableNow=True).start(str(tmp_path / name)).awaitTermination()

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(inbox, mode="append")
        run("out", computed_once(spark.readStream.schema(schema).parquet(inbox)))

    arrive([("a", second(0)), ("a", second(3599)), ("a", second(3600)), ("b", second(10)), ("a", second(3700))])
    arrive([("a", second(7199)), ("a", second(7200)), ("c", second(9000)), ("b", second(9000))])
    got = sorted((r.key, r.computed_at, r.n_requests) for r in spark.read.parquet(out).collect())
    assert got == [("a", second(0), 2), ("a", second(3600), 2), ("a", second(7200), 1), ("b", second(10), 1), ("b", second(9000), 1), ("c", second(9000), 1)]
    run("native", computed_once_native(spark.readStream.schema(schema).parquet(inbox)))
    assert {r.key for r in spark.read.parquet(str(tmp_path / "native")).collect()} == {"a", "b", "c"}


def test_updates_merge_by_column(spark):
    fields = "news_id bigint, seq int, summary_short string, summary_default string"
    given = [(1, 1, "S2", None), (1, 2, None, "D2"), (2, 1, "a", "x"), (2, 2, "b", None), (2, 3, None, None), (3, None, "only", None), (None, 1, "n", None)]
    updates = spark.createDataFrame(given, fields)
    got = {r.news_id: r[1:] for r in merge.merged_updates(updates, "news_id", "seq").collect()}
    assert got == {1: ("S2", "D2"), 2: ("b", "x"), 3: ("only", None), None: ("n", None)}
    assert {r.news_id: r[1:] for r in merge.merged_updates(updates.drop("seq")).collect()}[2] == ("b", "x")
    t = dt.datetime(2023, 1, 1)
    after = merge.upsert(result(spark, [(1, [], "s", "m", "d", t, t)]), updates.where("news_id = 1"), at(T1), order="seq").first()
    assert (after.summary_short, after.summary_medium, after.summary_default) == ("S2", "m", "D2")


def files_of(path):
    import glob
    import os

    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_bucket_table(spark, tmp_path):
    t = dt.datetime(2023, 1, 1)
    stored = BucketTable(spark, str(tmp_path / "results"), RESULT, n_buckets=8)
    stored.create(result(spark, [(i, [("Binh", "d", "u", f"k{i}", "f")], f"s{i}", None, None, t, t) for i in range(60)]))
    with pytest.raises(Exception):
        stored.create(result(spark, []))
    before = files_of(stored.path)
    updates = spark.createDataFrame([(3, "new", None), (3, None, "default"), (99, "added", None)], "news_id bigint, summary_short string, summary_default string")
    touched = stored.upsert(updates, at(T1))
    bucket = {r.id: r.b for r in spark.range(100).select("id", F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).collect()}
    assert touched == sorted({bucket[3], bucket[99]})
    after = files_of(stored.path)
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and all(after.get(f) == before[f] for f in kept) and not (set(before) - kept) & set(after)
    rows = {r.news_id: r for r in stored.read().collect()}
    assert len(rows) == 61 and (rows[3].summary_short, rows[3].summary_default) == ("new", "default") and rows[3].created_at == t
    assert rows[4].summary_short == "s4" and rows[99].audio_files == [] and rows[3].audio_files[0].s3_key == "k3"
    # Repeating a change gives the same; deleting all of a bucket removes it.
    stored.upsert(updates, at(T1))
    assert stored.read().count() == 61
    gone = [i for i in range(60) if bucket[i] == touched[0]] + [99] * (bucket[99] == touched[0])
    keys = spark.createDataFrame([(i,) for i in gone] + [(12345,)], "news_id bigint")
    assert stored.delete(keys) == [touched[0]] and not any(f"bucket={touched[0]}/" in f for f in files_of(stored.path))
    assert {r.news_id for r in stored.read().collect()} == set(rows) - set(gone)
    assert stored.delete(keys) == [] and stored.delete(keys.limit(0)) == [] and stored.upsert(updates.limit(0), at(T1)) == []


def test_links_go_with_their_rows(spark):
    t = dt.datetime(2023, 1, 1)
    files = lambda *keys: [("v", "d", "u", k, "f") for k in keys]
    stored = result(spark, [(1, files("a", "shared"), None, None, None, t, t), (2, files("b", "shared"), None, None, None, t, t), (3, [], None, None, None, t, t)])
    links = spark.createDataFrame([(k, t) for k in ("a", "b", "shared", "unknown")], "s3_key string, signed_at timestamp")
    drop = spark.createDataFrame([(1,), (3,), (7,)], "news_id bigint")
    assert {r.s3_key for r in audio.drop_links(links, stored, drop).collect()} == {"b", "shared", "unknown"}


def test_stream_looks_up_categories_and_dates_them(spark, tmp_path):
    inbox, epochs, tallies = tmp_path / "in", str(tmp_path / "epochs"), str(tmp_path / "tallies")
    catalog_path = str(tmp_path / "catalog")
    arriving = [(1, "One", "d", None, None, "x"), (2, "Two", "d", "", None, "x"), (3, "Three", "d", "own", None, "x"), (4, "Four", "d", None, None, "x"), (5, None, "d", "c", None, "x")]
    spark.createDataFrame([(1, "c1"), (1, "z"), (3, "other")], "id bigint, category string").write.parquet(catalog_path)
    stored, checkpoint = index_of(spark), str(tmp_path / "cp")

    def run(rows, when):
        spark.createDataFrame(rows, ARTICLE_FIELDS).coalesce(1).write.parquet(str(inbox), mode="append")
        stream = spark.readStream.schema(ARTICLE_FIELDS).parquet(str(inbox))
        catalog = lambda: spark.read.parquet(catalog_path)
        index_stream(stream, stored, at(when), checkpoint, catalog=catalog, epochs=epochs, tallies=tallies).awaitTermination()

    run(arriving, T0)
    assert {r.news_id: r.category for r in stored.read().collect()} == {1: "c1", 2: "UNKNOWN", 3: "own", 4: "UNKNOWN"}
    # The catalogue is read again for the next batch.
    spark.createDataFrame([(6, "late")], "id bigint, category string").write.parquet(catalog_path, mode="append")
    run([(6, "Six", "d", None, None, "x"), (3, "Three", "d", "own", None, "x")], T1)
    assert {r.news_id: r.category for r in stored.read().collect()}[6] == "late"
    counts = [(r.indexed, r.skipped, r.already_indexed, r.no_title, r.invalid) for r in spark.read.parquet(tallies).orderBy("batch_id").collect()]
    assert counts == [(4, 1, 0, 1, 0), (1, 1, 1, 0, 0)]
    dated = {r.category: str(r.indexed_at) for r in indexing.read_epochs(spark, epochs).collect()}
    assert set(dated) == {"c1", "UNKNOWN", "own", "late"} and dated["late"] > dated["own"]

    item = F.array(F.struct(F.lit(1).cast("bigint").alias("news_id"), F.lit("t").alias("title"), F.lit("c").alias("category"), F.lit(0.5).alias("similarity_score")))
    lists = spark.createDataFrame(
        [(1, 5, "own", T0), (2, 5, "own", "2024-01-01 00:00:01"), (3, 5, "all", "2024-01-01 12:00:00"), (4, 5, "all", "2024-01-02 00:00:01"), (5, 5, "quiet", "2023-12-31 00:00:00")],
        "news_id bigint, k int, category_key string, computed string",
    )
    cache = lists.select("news_id", "k", "category_key", item.alias("items"), F.col("computed").cast("timestamp").alias("computed_at"), at("2024-02-01 00:00:00").alias("expires_at"))
    asked = cache.select("news_id", "k", F.when(F.col("category_key") != "all", F.col("category_key")).alias("category_filter"))
    looked = recommend.read_cache(asked, cache, at("2024-01-03 00:00:00"), indexing.read_epochs(spark, epochs))
    assert {r.news_id: r.hit for r in looked.collect()} == {1: False, 2: True, 3: False, 4: True, 5: True}
    none = indexing.read_epochs(spark, epochs).limit(0)
    assert all(r.hit for r in recommend.read_cache(asked, cache, at("2024-01-03 00:00:00"), none).collect())


def test_checked_reading(spark, tmp_path):
    lines = ['{"id": 1, "title": "a"}', '{"id": 2, "title": "b', "", '{"id": 3, "publisher_id": "x"}', '{"title": null}', "[", '{"id": 4, "more": 1}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    rows, broken = A.read_checked(spark, str(tmp_path / "a.json"))
    # A value of the wrong type counts in queries that do not read its column, too.
    assert sorted((r.id or 0) for r in rows.select("id").collect()) == [0, 1, 4]
    assert rows.count() == 3 and broken.count() == 3
    assert sorted(r.record for r in broken.collect()) == sorted(["[", lines[1], lines[3]])
    assert all(r.file.endswith("a.json") for r in broken.collect())
    (tmp_path / "a.csv").write_text("1,t,d,c,7,text\nx,t,d,c,7,text\n2,t,d\n3,,,,,\n")
    rows, broken = A.read_checked(spark, str(tmp_path / "a.csv"), "csv")
    assert sorted(r.id for r in rows.collect()) == [1, 3]
    assert sorted(r.record for r in broken.select("record").collect()) == ["2,t,d", "x,t,d,c,7,text"]
    with pytest.raises(ValueError):
        A.read_checked(spark, "nowhere", "parquet")


def test_refreshed_lists(spark):
    from newsloom.schemas import CACHED_LIST

    dice = random.Random(4)
    columns = "news_id bigint, category string, title string, embedding array<float>"
    rows = [(i, "abc"[i % 3], f"t{i}", [dice.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100, "a", "copy", rows[3][3]), (101, "d", "alone", [1.0, 0.0, 0.0, 0.0]), (102, "a", "zero", [0.0] * 4)]
    index = spark.createDataFrame(rows, columns)
    late = F.col("news_id") % 4 == 0
    asked = spark.createDataFrame([(i, 1 + i % 9, c) for i in range(60) for c in (None, "a", "d")], "news_id bigint, k int, category_filter string")
    before = recommend.expiring(recommend.missed_lists(asked, index.where(~late)), at(T0)).checkpoint()

    def lists(table):
        return {(r.news_id, r.k, r.category_key): [tuple(i) for i in r["items"]] for r in table.collect()}

    def refreshed(indexed, time=T0):
        return recommend.refreshed_lists(before, indexed, index, at(time))

    want = lists(recommend.missed_lists(asked, index))
    held = lists(before)
    assert held and lists(refreshed(index.where(late))) == {k: want[k] for k in held}
    assert lists(refreshed(index)) == {k: want[k] for k in held}  # indexed again: no doubles
    assert lists(refreshed(index.where("false"))) == held
    assert refreshed(index.where(late), "2024-01-01 01:00:00").count() == 0
    stamped = refreshed(index.where(late), "2024-01-01 00:10:00")
    assert stamped.select("computed_at", "expires_at").distinct().collect() == [(dt.datetime(2024, 1, 1, 0, 10), dt.datetime(2024, 1, 1, 1))]
    assert stamped.columns == CACHED_LIST.names


def test_lists_of_an_article_are_searched_once(spark, monkeypatch):
    """The search gets one request per article and category, the one for most items; the lists are still those of each k."""
    from newsloom.operators import similarity as S

    dice = random.Random(5)
    rows = [(i, "ab"[i % 2], f"t{i}", [dice.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    index = spark.createDataFrame([*rows, *rows[:6]], "news_id bigint, category string, title string, embedding array<float>")
    asked = spark.createDataFrame([(i, k, c) for i in range(20) for k in (1, 4, 9, 51) for c in (None, "a")], "news_id bigint, k int, category_filter string")
    seen = []

    def search(requests, index, **options):
        seen.append(sorted(set(requests.select("news_id", "k", "category_filter").collect()), key=str))
        return S.top_k(requests, index, **options)

    monkeypatch.setattr(recommend, "top_k", search)
    late = F.col("news_id") % 3 == 0
    made = recommend.missed_lists(asked, index.where(~late)).checkpoint()
    after = recommend.refreshed_lists(recommend.expiring(made, at(T0)), index.where(late), index, at(T0), search).collect()
    for requests in seen:
        assert {r.k for r in requests} == {9} and len(requests) == len({(r.news_id, r.category_filter) for r in requests}) > 20
    assert len(seen) == 2 and {r.k for r in after} == {1, 4, 9}
    best = {(i, c): [] for i in range(20) for c in ("all", "a")}
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, _, _, v in rows}
    for (i, c), found in best.items():
        scores = [(-round(sum(x * y for x, y in zip(unit[i], unit[j])), 9), j) for j, own, _, _ in rows if j != i and c in ("all", own)]
        found += [j for score, j in sorted(scores) if -score >= 0.1]
    for r in after:
        # Copies of a row take places in the list that is cached; what is held after the merge is in order.
        ids = [x.news_id for x in r["items"]]
        assert len(set(ids)) == len(ids) <= r.k and [j for j in best[r.news_id, r.category_key] if j in ids] == ids


def test_what_is_indexed_once_more_is_shown_as_it_is_now(spark):
    columns = "news_id bigint, category string, title string, embedding array<float>"
    index = spark.createDataFrame([(i, "a", f"t{i}", [1.0, 0.1 * i]) for i in range(4)], columns)
    asked = spark.createDataFrame([(0, 2, None), (0, 3, None)], "news_id bigint, k int, category_filter string")
    before = recommend.expiring(recommend.missed_lists(asked, index), at(T0)).checkpoint()
    again = index.withColumn("title", F.concat(F.lit("a new "), "title"))
    for r in recommend.refreshed_lists(before, again.where("news_id in (1, 2)"), again, at(T0)).collect():
        assert [x.title for x in r["items"]] == ["a new t1", "a new t2", "t3"][: r.k]


def test_many_pairs(spark, monkeypatch):
    """Sent chunk by chunk they score as one by one: copies of ids, vectors that are zero, missing or of another length, unknown ids."""
    from newsloom.operators import similarity as S

    dice = random.Random(6)
    rows = [(i, [dice.gauss(0, 1) for _ in range(5)]) for i in range(50)]
    rows += [rows[3], rows[4], (4, rows[9][1]), (60, [0.0] * 5), (61, None), (62, [1.0, 2.0]), (63, [1.0, None, 2.0, 0.0, 1.0]), (None, rows[1][1])]
    index = spark.createDataFrame(rows, "news_id bigint, embedding array<float>")
    pairs = [(i, j) for i in [*range(0, 50, 3), 4, 60, 61, 62, 63, 99] for j in [*range(0, 50, 7), 4, 60, 61, 62, 63, 98]]
    pairs = spark.createDataFrame([*pairs, pairs[0], (None, 1), (1, None)], "left_id bigint, right_id bigint")

    def shown(scored):
        return sorted((r.left_id, r.right_id, None if r.similarity is None else round(r.similarity, 9) + 0.0) for r in scored.collect() if r.similarity is not None), scored.where("similarity is null").count()

    want = shown(S.pair_scores(pairs, index))
    for size in (1 << 22, 40):
        monkeypatch.setattr(S, "PAIRS_PER_CHUNK", size)
        assert shown(S.pair_scores(pairs, index, many=True)) == want
    assert S.pair_scores(pairs.limit(0), index, many=True).count() == 0


def test_stored_rows_leave_no_shuffle_files(spark):
    from newsloom.session import stored

    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (held.apply(i).getName() for i in range(held.size())) if name.startswith("shuffle_")}

    known = files()
    rows = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("a")).count().join(spark.range(7).toDF("a").repartition(3), "a"), "kept")
    assert rows.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
    for _ in range(50):
        if not (left := {f for f in files() - known if f.endswith(".data")}):
            break
        time.sleep(0.1)
    # The count's own shuffle may stay.
    assert len(left) <= 1


def by_hand(times, ttl):
    """(computed_at, n_requests) in microseconds."""
    made = []
    for t in sorted(times):
        if not made or t >= made[-1][0] + ttl:
            made.append([t, 0])
        made[-1][1] += 1
    return [tuple(m) for m in made]


def test_steps_of_one_hot_key(spark):
    """Times of one key, dense, sparse and repeated; its rows are dealt to many tasks."""
    dice = random.Random(7)
    for slices in (1, 64):
        asked = {"hot": [dice.randrange(40_000_000) for _ in range(3000)], "gaps": [i * 97_000_000 + dice.randrange(9) for i in range(40)], None: [5, 5, 2_000_005]}
        rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=t)) for k, ts in asked.items() for t in ts]
        steps = next_steps(spark.createDataFrame(rows, "key string, ts timestamp"), 2, slices)
        base = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
        got = sorted((str(r.key), r.t - base, r.n) for r in chained(steps).collect())
        assert got == sorted((str(k), t, n) for k, ts in asked.items() for t, n in by_hand(ts, 2_000_000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = steps.where("key = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(hot) > 1 and max(r["count"] for r in hot) < 3000 / 2


def test_split_ttl_stream(spark, tmp_path):
    def second(s):
        return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)

    schema = "key string, ts timestamp"
    inbox = str(tmp_path / "in")

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(inbox, mode="append")
        stream = spark.readStream.schema(schema).parquet(inbox)
        computed_once_split(stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"), lateness="1 hour").awaitTermination()

    def state(batch):
        return {r.key for r in spark.read.parquet(f"{tmp_path}/state/batch={batch}").where("expires_at is not null").collect()}

    arrive([("a", second(0)), ("a", second(3599)), ("a", second(3600)), ("b", second(10)), ("a", second(3700)), ("e", None)])
    # Out of order: the request at 3500 lies before a's last expiry and is a hit.
    arrive([("a", second(7200)), ("a", second(7199)), ("a", second(3500)), ("c", second(9000)), ("b", second(9000))])
    # Before the latest request by more than an hour: dropped.
    arrive([("d", second(5000)), ("d", second(5400)), ("b", second(9001))])
    got = sorted((r.key, r.computed_at, r.n_requests) for r in spark.read.schema(COMPUTED).parquet(f"{tmp_path}/out").collect())
    assert got == [
        ("a", second(0), 2), ("a", second(3600), 2), ("a", second(7200), 1), ("b", second(10), 1), ("b", second(9000), 1),
        ("c", second(9000), 1), ("d", second(5400), 1),
    ]
    assert state(0) == {"a", "b"} and state(1) == {"a", "b", "c"} and state(2) == {"a", "b", "c", "d"}
    arrive([("z", second(13000))])
    assert state(3) == {"a", "b", "c", "z"}


def test_streams_read_folders(spark, tmp_path):
    """A table that is a folder of files streams like one that is a single file."""
    documents = [(i, f"Title {i}. More words. Last.", "en", f"src{i % 4}", 28) for i in range(12)]
    days = ["2024-01-15 10:00:00", "2024-01-15 13:00:00", "2024-01-20 00:00:00"]
    events = [(i, i % 5, "click", 3.0, days[i % 3]) for i in range(30)]
    made = {
        "documents": spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long"),
        "events": spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, ts string"),
        "labels": spark.createDataFrame([(i, 1, 0) for i in (0, 5, 10)], "doc_id long, quality int, toxic int"),
    }
    for name, rows in made.items():
        rows.repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [tuple(r) for r in W.stream_tally(spark, str(tmp_path)).collect()] == [(9, 3, 3, 0, 0)]
    hits = [sorted(map(tuple, q(spark, str(tmp_path)).collect())) for q in (W.cache_hits_after_stream, W.cache_hits_after_batch)]
    assert hits[0] == hits[1] and len(hits[0]) == 30
    assert W.computed_once_stream(spark, str(tmp_path)).agg(F.sum("n_requests")).first()[0] > 0
