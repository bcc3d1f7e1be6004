"""The pipeline's rows against its stages done by brute force."""

import collections

import corpus_pipeline as P
from newsloom.llm import mixing, piece_codec, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.encode().lower().split()  # of bytes: ASCII letters and blanks only
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_pipeline(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    net = toxicity.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
    left = [i for i in docs if net is None or toxicity.Scorer(net).scores([docs[i].text])[0] < toxicity.THRESHOLD]
    keep = {}
    for i in sorted(left):
        keep[docs[i].text] = i
    left = sorted(keep.values())
    sets = [shingles(docs[i].text) for i in left]
    group = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if group[a] != group[b] and alike(sets[a], sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    left = [left[i] for i in sorted(set(group))]
    mixed = mixing.mixed_sizes(table.where(F.col("doc_id").isin(left)))
    want = collections.Counter({r.doc_id: r.copies for r in mixed.collect() if r.copies})
    rows = P.run(spark, SF).collect()
    assert collections.Counter(r.doc_id for r in rows) == want
    codec = piece_codec.Codec(piece_codec.read_model())
    for r in rows[:20]:
        assert r.ids == codec.encode([docs[r.doc_id].text])[0][0].tolist() and r.round_trip


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_sets_leave_in_small_pieces():
    """Sets and prefixes are made a few hundred at a time, and repeated shingles are counted in place."""
    import numpy as np
    import pyarrow as pa

    from newsloom.llm import shingle_join as J

    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    pieces = list(J.small(iter([batch])))
    assert max(p.num_rows for p in pieces) <= J.SETS_PER_BATCH and [x for p in pieces for x in p["x"].to_pylist()] == list(range(1000))
    dice = np.random.default_rng(2)
    for n in (1, 2, 50):
        values = np.sort(dice.integers(0, 12, n))
        starts, ends = J._runs_of_equals(values)
        known, counts = np.unique(values, return_counts=True)
        assert values[starts].tolist() == known[counts > 1].tolist() and (ends - starts).tolist() == counts[counts > 1].tolist()


def test_texts_travel_once_and_in_small_batches(spark, monkeypatch):
    """Scoring gets each text in one column, and both ends of the pipeline a thousand rows at a time."""
    docs = spark.createDataFrame([(i, None if i % 50 == 0 else f"word{i % 7} here", "s") for i in range(1500)], "doc_id long, text string, source string")
    net = toxicity.train(["good word", "bad thing"] * 5, [0, 1] * 5)
    seen = []

    def watched(rows, function, schema):
        seen.append(rows.columns)
        sizes = lambda batches: function(b for b in batches if b.num_rows <= 1000)
        return rows.mapInArrow(sizes, schema)

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(toxicity, "map_batches", watched)
    monkeypatch.setattr(piece_codec, "map_batches", watched)
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: net)
    monkeypatch.setattr(toxicity, "THRESHOLD", 2.0)  # every row stays
    try:
        spark.conf.unset(setting)
        kept = toxicity.clean_rows(docs.coalesce(1), docs)
        assert len(seen[0]) == len(docs.columns)
        assert kept.schema == docs.schema and kept.exceptAll(docs).count() == 0 and kept.count() == 1500
        spark.conf.unset(setting)
        assert piece_codec.encoded(docs.coalesce(1), {"doc_id": F.col("doc_id")}, piece_codec.read_model()).count() == 1500
    finally:
        spark.conf.unset(setting)


def test_codec_forgets():
    """Forgetting words changes no ids, and what is remembered stays within the bound and one batch."""
    texts = [f"some w{i} words x{i * i} und ähnliches {i}" for i in range(300)]
    data = piece_codec.read_model()
    whole = piece_codec.Codec(data).encode(texts)
    codec = piece_codec.Codec(data)
    old, piece_codec.CACHED_CHARS = piece_codec.CACHED_CHARS, 2000
    try:
        parts = [codec.encode(texts[i : i + 10]) for i in range(0, 300, 10)]
    finally:
        piece_codec.CACHED_CHARS = old
    assert [(x.tolist(), a, b) for x, a, b in whole] == [(x.tolist(), a, b) for part in parts for x, a, b in part]
    assert len(codec.cache) < 200
