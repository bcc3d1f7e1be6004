"""The registered queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (
    ann_forest,
    byte_codec,
    edit_counts,
    exact_dedup,
    html_text,
    lexical_tree,
    license_scan,
    masked_lm,
    mixing,
    piece_codec,
    simhash,
    toxicity,
    whitening,
)
from newsloom.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.scored(documents, net, {"doc_id": F.col("doc_id")}).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", toxicity.predicted(F.col("score")).alias("predicted")
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    net = html_text.train(html_text.training_pages())
    return html_text.extracted(pages, net, {"page_id": F.col("page_id"), "url": F.col("url")})


def op7_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return ann_forest.nearest(embeddings, "vec_id", "embedding", F.col("id") % 20 == 0, k=20)


def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")})


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return piece_codec.encoded(documents, {"doc_id": F.col("doc_id")}, piece_codec.read_model())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    edits = edit_counts.sample_edits(F.coalesce(F.col("text"), F.lit("")))
    return edit_counts.counted(documents, {"doc_id": F.col("doc_id")}, edit_counts.read_ranks(), edits)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_tree.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    made = byte_codec.encoded(documents, {"doc_id": F.col("doc_id")}, byte_codec.read_ranks(), decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return made.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), {"vec_id": F.col("vec_id")}, "embedding")


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_license_scan,
        op3_toxicity,
        op4_simhash,
        op5_source_mix,
        op6_html_text,
        op7_ann_forest,
        op8_masked_lm,
        op9_sentencepiece,
        op10_token_counts,
        op11_lexical_search,
        op12_byte_bpe,
        op13_whitening,
    )
}

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

ORACLE = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY text)""",
    "op2_license_scan": rf"""
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
        places AS (
            SELECT doc_id, i - 1 AS place, CASE
                WHEN words[i] = 'mit' AND words[i + 1] = 'license' THEN 'mit'
                WHEN words[i] = 'apache' AND words[i + 1] = 'license' THEN 'apache'
                WHEN words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license' THEN 'gpl' END AS label
            FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
        base AS (
            SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
                   list(DISTINCT label) AS labels
            FROM places WHERE label IS NOT NULL GROUP BY doc_id),
        templates AS (
            SELECT label, len(all_words) AS n, list_distinct(all_words) AS tokens
            FROM (SELECT label, regexp_extract_all(lower(notice), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS all_words
                  FROM (VALUES
                ('mit-notice', 'Released under the MIT License'),
                ('apache-2.0', 'Licensed under the Apache License, Version 2.0'),
                ('gpl-3.0', 'This work is licensed under the GNU General Public License, version 3'),
                ('mit-text', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and'
                 || ' associated documentation files'),
                ('mit-full', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and'
                 || ' associated documentation files (the Software), to deal in the Software without restriction,'
                 || ' including without limitation the rights to use, copy, modify, merge, publish, distribute,'
                 || ' sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is'
                 || ' furnished to do so, subject to the following conditions: The above copyright notice and this'
                 || ' permission notice shall be included in all copies or substantial portions of the Software. The'
                 || ' Software is provided as is, without warranty of any kind, express or implied, including but not'
                 || ' limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.'
                 || ' In no event shall the authors or copyright holders be liable for any claim, damages or other'
                 || ' liability, whether in an action of contract, tort or otherwise, arising from, out of or in'
                 || ' connection with the Software or the use or other dealings in the Software.'),
                ('isc-full', 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee'
                 || ' is hereby granted, provided that the above copyright notice and this permission notice appear in all'
                 || ' copies. The software is provided as is and the author disclaims all warranties with regard to this'
                 || ' software including all implied warranties of merchantability and fitness. In no event shall the'
                 || ' author be liable for any special, direct, indirect, or consequential damages or any damages'
                 || ' whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence'
                 || ' or other tortious action, arising out of or in connection with the use or performance of this'
                 || ' software.'),
                ('bsd-text', 'Redistribution and use in source and binary forms, with or without modification, are permitted'
                 || ' provided that the following conditions are met'),
                ('cc-by-4.0', 'This work is licensed under a Creative Commons Attribution 4.0 International License'),
                ('mpl-2.0', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0')) AS t(label, notice))),
        blocks AS (
            SELECT doc_id, label, tokens,
                   unnest(list_transform(range(0, len(words), n), lambda b: list_slice(words, b + 1, b + 2 * n))) AS block
            FROM w, templates),
        notices AS (
            SELECT doc_id, list(DISTINCT label) AS labels, max(shared / size) AS best
            FROM (SELECT doc_id, label, len(list_intersect(list_distinct(block), tokens)) AS shared, len(tokens) AS size FROM blocks)
            WHERE shared >= ceil(round(size * 0.9, 9)) GROUP BY doc_id)
        SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(
                   list_concat(coalesce(base.labels, []), coalesce(notices.labels, [])))), ','), '') AS labels,
               CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
        FROM w LEFT JOIN base USING (doc_id) LEFT JOIN notices USING (doc_id)""",
    "op5_source_mix": rf"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
            FROM documents),
        s AS (
            SELECT source, sum(size) AS source_size, 3 * sum(size) AS cap,
                   (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
            FROM d GROUP BY source),
        sorted AS (
            SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM s),
        levels AS (
            SELECT k, cap / weight AS bound,
                   ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                       / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM sorted),
        chosen AS (SELECT level FROM levels WHERE bound >= level ORDER BY k LIMIT 1),
        t AS (
            SELECT source, source_size, CASE WHEN cap < weight * level THEN cap ELSE weight * level END::DOUBLE AS target,
                   ('0x' || substr(md5('{mixing.SEED}:' || coalesce(source, '')), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS shift
            FROM s, chosen),
        n AS (
            SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS number FROM d)
        SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target,
               CASE WHEN source_size = 0 THEN 0
                    ELSE size * (floor(target / source_size * number + shift) - floor(target / source_size * (number - 1) + shift))
               END::BIGINT AS taken
        FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source""",
    "op11_lexical_search": rf"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS place, regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), {_TERM}) AS words
            FROM documents),
        s AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS terms FROM d WHERE len(words) > 0),
        q AS (
            SELECT item, item_id, term, count(*) AS times
            FROM (SELECT row_number() OVER () AS item, item_id,
                         unnest(regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), {_TERM})) AS term FROM benchmark)
            GROUP BY ALL),
        t AS (
            SELECT place, doc_id, n, term, count(*) AS tf
            FROM (SELECT place, doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d) GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, s),
        scored AS (
            SELECT item, item_id, place, doc_id,
                   sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms)))))::BIGINT AS score
            FROM q JOIN t USING (term) JOIN w USING (term), s GROUP BY ALL),
        ranks AS (
            SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS number FROM scored WHERE score > 0)
        SELECT item_id, number::INTEGER AS rank, doc_id, score FROM ranks WHERE number <= 20""",
}
