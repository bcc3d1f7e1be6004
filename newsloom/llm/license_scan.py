"""License scan: an exact set-similarity join of text blocks with license notices.

A template is the set of words of a notice. For a notice of n words the blocks of a
document are the runs of 2 * n words that begin at every n-th word of the whole text
(the last are shorter), so every n words in a row stand in one block together, however
their lines are wrapped and whatever stands around them. A block and a template link
when the block holds at least ``THRESHOLD`` of the template's words. Words are ordered by how many documents of the whole corpus
hold them, rarest first. A block that holds ``need`` of a template's ``size``
words holds one of its ``size - need + 1`` rarest (prefix filter), has at least
``need`` template words (length filter), and at the first word they share both
have ``need`` words left, that one included (positional filter). What passes is
counted exactly, so every qualifying pair is found.

Everything is DataFrame operations. Only words of the templates' prefixes are
ever exploded, so frequent words of the corpus cost nothing there; the templates
are a parameter and their tables are bounded by it, not by the data.

A null text counts as empty. Rows repeated as a whole are all returned.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.columns import with_evaluated
from newsloom.llm.common import text_or_empty

# Every ASCII character but digits and letters stands between words.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.9

# The phrases looked for, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license notices, by label.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        " and associated documentation files",
    ),
    (
        "mit-full",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        " and associated documentation files (the Software), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
        " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be"
        " included in all copies or substantial portions of the Software. The Software is provided as is,"
        " without warranty of any kind, express or implied, including but not limited to the warranties of"
        " merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors"
        " or copyright holders be liable for any claim, damages or other liability, whether in an action of"
        " contract, tort or otherwise, arising from, out of or in connection with the Software or the use or"
        " other dealings in the Software.",
    ),
    (
        "isc-full",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        " The software is provided as is and the author disclaims all warranties with regard to this software"
        " including all implied warranties of merchantability and fitness. In no event shall the author be liable"
        " for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from"
        " loss of use, data or profits, whether in an action of contract, negligence or other tortious action,"
        " arising out of or in connection with the use or performance of this software.",
    ),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met",
    ),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def spaced(text: Column) -> Column:
    """The text with A-Z lower-cased and a blank for whatever stands between words."""
    return F.translate(text, UPPER + GAPS, LOWER + " " * len(GAPS))


def words(blanked: Column) -> Column:
    return F.array_remove(F.split(blanked, " "), "")


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


# --- templates ------------------------------------------------------------------


def template_rows(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """template, label, length (its words) and tokens (its distinct words)."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(a).alias("label"), F.lit(b).alias("notice")) for i, (a, b) in enumerate(templates)]
    return (
        spark.range(1)
        .select(F.explode(F.array(*rows)).alias("t"))
        .select("t.template", "t.label", words(spaced(F.col("t.notice"))).alias("all"))
        .select("template", "label", F.size("all").alias("length"), F.array_distinct("all").alias("tokens"))
    )


def token_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template words, from the rarest in the corpus to the commonest; each document counts once."""
    held = F.explode(F.array_intersect(words(spaced(text_or_empty())), _literals(vocabulary)))
    counted = {r["token"]: r["n"] for r in docs.select(held.alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))


# --- the join -------------------------------------------------------------------


def block_matches(
    docs: DataFrame,
    keys: dict[str, Column],
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The key columns, block (its number among those of its length), label, containment of every pair that qualifies, once."""
    spark = docs.sparkSession
    rows = template_rows(spark, templates)
    known = rows.collect()
    order = token_order(docs, sorted({w for r in known for w in r["tokens"]}))
    rank = F.create_map(*[x for i, w in enumerate(order) for x in (F.lit(w), F.lit(i))])
    by_rank = lambda held: F.array_sort(F.transform(held, lambda w: F.try_element_at(rank, w)))
    size = F.size("tokens")
    sets = rows.select("label", "template", "length", by_rank(F.col("tokens")).alias("wanted"), size.alias("size")).withColumn(
        "need", F.ceil(F.round(F.col("size") * threshold, 9)).cast("int")
    )
    index = sets.select("*", F.posexplode("wanted").alias("at", "token")).where("at <= size - need")
    first: dict[int, set[int]] = {}
    for r in index.select("length", "token").collect():
        first.setdefault(r["length"], set()).add(r["token"])
    firsts = sorted(set().union(*first.values()))

    # A text without any of the first words as a substring has no match and need not be cut into words.
    may = reduce(or_, [F.col("_spaced").contains(order[i]) for i in firsts])
    texts = docs.select(*[c.alias(n) for n, c in keys.items()], text_or_empty().alias("_whole"))
    texts = with_evaluated(texts, "_spaced", spaced(F.col("_whole"))).drop("_whole")
    texts = with_evaluated(texts.where(may), "_words", words(F.col("_spaced"))).drop("_spaced")
    # Only lengths of which a text holds a first word; runs are cut before they are dealt out, so a row holds one.
    lengths = F.array(*[F.struct(F.lit(n).alias("length"), _literals([order[i] for i in sorted(f)]).alias("first")) for n, f in sorted(first.items())])
    texts = texts.select(*keys, "_words", F.explode(F.filter(lengths, lambda x: F.arrays_overlap(x["first"], F.col("_words")))).alias("_of"))
    n = F.col("_of.length")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_words") - 1) / n).cast("int")), lambda b: F.slice("_words", b * n + 1, 2 * n))
    blocks = texts.select(*keys, n.alias("_length"), F.col("_of.first").alias("_first"), F.posexplode(runs).alias("block", "run"))
    blocks = with_evaluated(
        blocks.where(F.arrays_overlap("run", "_first")).drop("_first"), "held", by_rank(F.array_intersect("run", _literals(order)))
    ).drop("run")
    smallest = min(math.ceil(round(len(r["tokens"]) * threshold, 9)) for r in known)
    seen = blocks.where(F.size("held") >= smallest).select(*keys, "_length", "block", "held", F.posexplode("held").alias("mine", "token")).where(
        F.col("token").isin(firsts)
    )
    left = F.least(F.col("size") - F.col("at"), F.size("held") - F.col("mine"))
    pairs = seen.join(F.broadcast(index), (seen["token"] == index["token"]) & (F.col("_length") == F.col("length"))).drop(seen["token"]).where((left >= F.col("need")) & (F.size("held") >= F.col("need")))
    shared = F.array_intersect("held", "wanted")
    # the first word that both hold is counted once, so a pair leaves the join once
    return (
        pairs.where((F.size(shared) >= F.col("need")) & (F.element_at(shared, 1) == F.col("token")))
        .select(*keys, "block", "label", (F.size(shared) / F.col("size")).alias("containment"))
    )


def _places_of(phrase: str, label: str, tokens: Column) -> Column:
    parts = phrase.split()

    def starts(i: Column) -> Column:
        met = F.get(tokens, i) == parts[0]
        for k in range(1, len(parts)):
            met = met & (F.get(tokens, i + k) == parts[k])
        return F.coalesce(met, F.lit(False))

    found = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), starts)
    return F.transform(found, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("place")))


def phrase_places(tokens: Column) -> Column:
    """Array of (label, place) of the phrases' places; only texts with the word that ends all phrases are walked through."""
    none = F.array().cast("array<struct<label:string,place:bigint>>")
    found = F.concat(*[_places_of(phrase, label, tokens) for phrase, label in PHRASES.items()])
    return F.when(F.array_contains(tokens, "license"), found).otherwise(none)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 where a phrase stands, else the best containment that qualifies, else 0.
    """
    text = text_or_empty()
    keys = {"_doc": F.col("doc_id"), "_text": F.md5(text)}
    notices = (
        block_matches(docs, keys, templates, threshold)
        .groupBy("_doc", "_text")
        .agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    )
    rows = docs.select("doc_id", spaced(text).alias("_spaced"), F.md5(text).alias("_key"))
    rows = with_evaluated(rows, "_words", words(F.col("_spaced")))
    rows = rows.select("doc_id", "_key", F.size("_words").cast("long").alias("n_words"), "_words")
    rows = with_evaluated(rows, "_places", phrase_places(F.col("_words"))).drop("_words")
    place = F.transform("_places", lambda p: p["place"])
    base = F.array_distinct(F.transform("_places", lambda p: p["label"]))
    nothing = F.array().cast("array<string>")
    joined = rows.join(
        notices, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_text")), "left"
    )
    n_base = F.size("_places").cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("_more", nothing))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
