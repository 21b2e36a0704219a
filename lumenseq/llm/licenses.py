"""License notices: fixed phrases by place, whole notices by an exact set-similarity join.

Text blocks are windows of words, twice as long as the templates they are held against and overlapping by half, so a notice
lies whole in some block wherever it starts. A block meets a template when it holds at least ``threshold`` of the template's
distinct words. The join is exact:

* all template words are ordered by the number of documents that hold them, rarest first; words of no template never count
  towards an overlap, so a block is cut down to its template words;
* length filter: a block with fewer template words than the overlap needed goes;
* prefix filter: of the needed overlap ``o`` at least one word is among the first ``|T| - o + 1`` of the template and the
  first ``|B| - o + 1`` of the block, so only those are joined; a document without any template prefix word has no blocks;
* positional filter: words at places i and j leave room for an overlap of ``min(i, j) + 1 + min(|T| - i - 1, |B| - j - 1)``;
* what is left is counted.

The index broadcast has one row per template prefix word, so its size is bounded by the templates given.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseq.llm.common import whole

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices and the labels they give.
TEMPLATES = {
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "Released under the MIT License": "mit-notice",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0",
    "Licensed under CC BY-SA 4.0": "cc-by-sa-4.0",
    "Licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl-header",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "This is free and unencumbered software released into the public domain": "unlicense",
}

#: Fixed value: what stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A document with a phrase, in any case; then places are looked up.
_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.lower()) if w]


def _lit_array(values, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of a phrase in an array of words, from 0."""
    def stands(i: Column) -> Column:
        found = F.lit(True)
        for k, word in enumerate(phrase):
            found = found & F.coalesce(F.get(words, i + k) == word, F.lit(False))
        return found

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), stands)


def _windows(length: int, least: int, ordered: list[str]) -> Column:
    """Windows of twice ``length`` words, one at each ``length``, cut down to the words of ``ordered``."""
    def window(i: Column) -> Column:
        held = F.array_intersect(F.slice("words", i * length + 1, 2 * length), _lit_array(ordered, "string"))
        return F.struct(F.lit(length).alias("length"), F.lit(least).alias("least"), held.alias("held"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / length).cast("int")), window)


def scan_blocks(rows: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """``_id, _key, similarity, found``: the best containment and the labels of each document that has a matching block.

    ``rows`` has ``_id, _key, words``.
    """
    sets = {name: template_words(text) for text, name in templates.items()}
    vocabulary = sorted({w for words in sets.values() for w in words})
    counts = dict(
        rows.select(F.explode(F.array_intersect("words", _lit_array(vocabulary, "string"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    )  # at most one row per template word
    ordered = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(ordered)}
    index, classes = [], {}
    for name, words in sets.items():
        ranks = sorted({rank[w] for w in words})
        need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
        length = max(8, 1 << (len(words) - 1).bit_length())
        classes[length] = min(classes.get(length, need), need)
        index += [(length, r, i, len(ranks), need, ranks, name) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    spark = rows.sparkSession
    lookup = F.broadcast(spark.createDataFrame(index, "length int, token int, i int, t int, need int, ranks array<int>, name string"))
    rare = _lit_array(sorted({ordered[x[1] - 1] for x in index}), "string")
    hopeful = rows.where(F.arrays_overlap("words", rare))
    per_class = [_windows(length, need, ordered) for length, need in sorted(classes.items())]
    blocks = (
        hopeful.select("_id", "_key", F.explode(F.concat(*per_class)).alias("b"))
        .where("size(b.held) >= b.least")
        .select("_id", "_key", "b.length", "b.least", F.array_sort(F.transform("b.held", lambda w: F.array_position(_lit_array(ordered, "string"), w).cast("int"))).alias("block"))
    )
    starts = blocks.select("_id", "_key", "length", "block", F.posexplode(F.slice("block", F.lit(1), F.size("block") - F.col("least") + 1)).alias("j", "token"))
    near = starts.join(lookup, ["length", "token"]).where(
        "size(block) >= need AND least(i, j) + 1 + least(t - i - 1, size(block) - j - 1) >= need")
    met = near.withColumn("_same", F.size(F.array_intersect("block", "ranks"))).where("_same >= need")
    return met.groupBy("_id", "_key").agg(F.max(F.col("_same") / F.col("t")).alias("similarity"), F.collect_set("name").alias("found"))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row of ``docs``.

    Score is 1 with a phrase, else the best containment of a template met, else 0. A null text is empty: no words, empty
    labels, null places. Repeated rows each give a row; rows with one id and different texts are told apart; a null id is an
    id like any other; long texts are scanned whole; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").alias("_id"), F.xxhash64(whole()).alias("_key"), whole().alias("_text"),
        F.array_remove(F.split(F.lower(whole()), GAP), "").alias("words"))
    met = scan_blocks(rows.select("_id", "_key", "words"), TEMPLATES if templates is None else templates, threshold)
    seen = "|".join(rf"{_SEP}+".join(p.split()) for p in PHRASES)
    some = F.col("_text").rlike(rf"(?i)(?:^|{_SEP})(?:{seen})(?:$|{_SEP})")
    nowhere = F.array().cast("array<int>")
    placed = rows.select("_id", "_key", F.size("words").cast("long").alias("n_words"), *[
        F.when(some, _places(F.col("words"), p.split())).otherwise(nowhere).alias(f"_p{k}") for k, p in enumerate(PHRASES)])
    every = F.concat(*[f"_p{k}" for k in range(len(PHRASES))])
    based = placed.select(
        "_id", "_key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_distinct(F.filter(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(v)) for k, v in enumerate(PHRASES.values())]), lambda x: x.isNotNull())).alias("_base"))
    met = met.select(F.col("_id").alias("_m"), F.col("_key").alias("_mk"), "similarity", "found")
    joined = based.join(met, (based["_key"] == F.col("_mk")) & based["_id"].eqNullSafe(F.col("_m")), "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        F.col("_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("score"))


def oracle(templates: dict[str, str] | None = None, threshold: float = 0.9) -> str:
    """The same in DuckDB SQL by holding every block against every template."""
    templates = TEMPLATES if templates is None else templates
    rows = []
    for text, name in templates.items():
        words = template_words(text)
        distinct = sorted(set(words))
        listed = ", ".join(f"'{w}'" for w in distinct)
        rows.append(f"({max(8, 1 << (len(words) - 1).bit_length())}, [{listed}], {max(1, math.ceil(threshold * len(distinct) - 1e-9))}, '{name}')")
    hits = " UNION ALL ".join(
        f"SELECT r, i, '{label}' AS label FROM place WHERE words[i + 1:i + {len(p.split())}] = [{', '.join(repr(w) for w in p.split())}]" for p, label in PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{GAP}'), lambda x: x <> '') AS words FROM documents),
place AS (SELECT r, words, unnest(range(len(words))) AS i FROM d WHERE list_contains(words, 'license') OR list_contains(words, 'cc')),
hit AS ({hits}),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS base FROM hit GROUP BY r),
t(length, words, need, name) AS (VALUES {', '.join(rows)}),
size AS (SELECT DISTINCT length FROM t),
block AS (SELECT r, length, words[b * length + 1:b * length + 2 * length] AS held FROM (SELECT r, words, length, unnest(range((len(words) + length - 1) // length)) AS b FROM d, size)),
met AS (SELECT r, name, len(list_intersect(list_distinct(held), t.words)) AS same, len(t.words) AS n, need FROM block JOIN t USING (length)),
best AS (SELECT r, max(same / n) AS similarity, list_distinct(list(name)) AS found FROM met WHERE same >= need GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(similarity, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r)"""
