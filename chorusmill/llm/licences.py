"""Licence scans by a positional index of rare words, with DataFrame functions only.

Licence notices are templates: words, and key phrases that a text must have. How many documents hold each template word
is counted over all documents; the index keeps each template's rarest words (highest inverse document frequency) with their
places. A file's places of those words are looked up in it; place in the file less place in the template is the same for all
words of one notice, but for small drifts, so postings are grouped by template and that difference. Where enough of a
template's rare words agree, the words of the file around that place must hold the template's key phrases.

Fixed phrases (`BASE`) are found beside this in the normal form of each text. Texts are read twice and never shuffled; only
files that hold enough rare words of some template are written with their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Phrases that are labels by themselves, as words (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Licence notices: label, text as words, key phrases (fixed values, the licences' own wording).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "apache org licenses license 2 0"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["distributed on an as is basis", "without warranties or conditions of any kind"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice", ["redistribution and use in source and binary forms", "with or without modification"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", ["you can redistribute it and or modify", "terms of the gnu general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license v 2 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["free and unencumbered software released into the public domain"]),
]
#: Rare words that the index has of each template: one for each so many words, within these bounds.
WORDS_PER_RARE, LEAST_RARE, MOST_RARE = 8, 4, 12
#: Of a template's rare words, how many in a hundred must agree in their place, and two at least.
AGREE = 60
#: Places by which words of one notice may drift apart, and by which key phrases may lie outside.
DRIFT, SLACK = 8, 8
#: Score of a document that has base phrases only.
BASE_SCORE = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def normal_form(text: Column) -> Column:
    """A-Z lowered, words with one space before and after each; a single space if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(" ")), _BETWEEN, " ")


def _spaces(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(" "), F.lit("")))


def _strings(words) -> Column:
    return F.array(*(F.lit(w) for w in sorted(words))).cast("array<string>")


def document_frequencies(docs: DataFrame, words: set[str]) -> dict[str, int]:
    """How many documents hold each of the given words; as many rows reach the driver as there are template words."""
    held = F.array_intersect(F.split(normal_form(F.col("text")), " "), _strings(words))
    counted = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def rare_word_index(frequency: dict[str, int], templates: list) -> list[list[tuple[str, int]]]:
    """For each template its rarest words with all their places; ties go to the lesser word, words that no file holds are left out."""
    index = []
    for _, text, _ in templates:
        words = text.split(" ")
        rare = sorted({w for w in words if frequency.get(w)}, key=lambda w: (frequency[w], w))[: min(MOST_RARE, max(LEAST_RARE, len(words) // WORDS_PER_RARE))]
        index.append([(w, k) for k, w in enumerate(words) if w in rare])
    return index


def _needed(postings: list[tuple[str, int]]) -> int:
    return max(2, -(-len({w for w, _ in postings}) * AGREE // 100))


def base_places(normal: Column, base: dict[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word, base_labels from a text's normal form."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in base.items():
        first, _, rest = phrase.partition(" ")
        mark = F.lit(f" {phrase} ")
        has = F.contains(normal, mark)
        # the next place may begin with this one's last space, so only the first word is taken
        counts.append(F.when(has, F.regexp_count(normal, F.lit(f" {first}(?= {rest} )"))).otherwise(0))
        before = F.substring(normal, F.lit(1), F.instr(normal, mark) - 1)
        after = F.substring_index(normal, f" {phrase} ", -1)
        firsts.append(F.when(has, _spaces(before)))
        lasts.append(F.when(has, _spaces(normal) - 1 - _spaces(after) - len(phrase.split(" "))))
        labels.append(F.when(has, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    least = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    most = F.greatest(*lasts) if len(lasts) > 1 else lasts[0]
    return {"n_base": total.cast("long"), "first_word": least.cast("long"), "last_word": most.cast("long"), "base_labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))}


def scan(docs: DataFrame, templates: list = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs (doc_id, text).

    The score is the largest share of a found template's rare words that agree, 0.5 at least with a base phrase, 0 without
    a label. Null and empty texts have no words and no labels; rows that repeat, null ids and ties keep a row each; other
    columns are not read. An empty table gives no rows.
    """
    frequency = document_frequencies(docs, {w for _, text, _ in templates for w in text.split(" ")})
    index = rare_word_index(frequency, templates)
    known = F.array_intersect(F.split(F.col("normal"), " "), _strings({w for p in index for w, _ in p}))
    few = lambda p: F.size(F.array_intersect("known", _strings({w for w, _ in p}))) >= _needed(p)
    any_template = F.lit(False)
    for (_, _, keys), postings in zip(templates, index, strict=True):
        held = few(postings)
        for key in keys:
            held = held & F.contains("normal", F.lit(f" {key} "))
        any_template = any_template | held
    texts = docs.select("doc_id", normal_form(F.col("text")).alias("normal")).withColumn("known", known)
    words = F.when(any_template, F.split(F.trim("normal"), " "))
    digest = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", (_spaces(F.col("normal")) - 1).cast("long").alias("n_words"), *(c.alias(n) for n, c in base_places(F.col("normal"), base).items()), words.alias("words"))
    digest = materialize(digest, "licence-words")
    found = _verified(digest.where("words IS NOT NULL").select("row", "words"), templates, index)
    rows = digest.drop("words").join(found, "row", "left")
    none = F.array().cast("array<string>")
    labels = F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("template_labels", none))), ",")
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("base_labels") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"))


def _verified(files: DataFrame, templates: list, index: list[list[tuple[str, int]]]) -> DataFrame:
    """(row, template_labels, share) of the files (row, words) in which a template is found."""
    spark = files.sparkSession
    postings = [(w, t, k, _needed(p), len({w for w, _ in p})) for t, p in enumerate(index) for w, k in p]
    # as many rows as the templates' rare words have places: a fixed list
    table = F.broadcast(spark.createDataFrame(postings, "word string, template int, place int, needed int, rare int"))
    met = files.select("row", F.posexplode("words").alias("at", "word")).join(table, "word")
    # two grids, so that places less than half a cell apart share a cell of one of them
    shift = F.col("at") - F.col("place")
    cells = F.array(F.struct(F.lit(0).alias("grid"), F.floor(shift / DRIFT).alias("cell")), F.struct(F.lit(1).alias("grid"), F.floor((shift + DRIFT // 2) / DRIFT).alias("cell")))
    dealt = met.select("row", "template", "word", "needed", "rare", shift.alias("shift"), F.explode(cells).alias("c")).select("*", "c.*")
    agreed = dealt.groupBy("row", "template", "grid", "cell", "needed", "rare").agg(F.size(F.collect_set("word")).alias("same"), F.min("shift").alias("shift")).where(F.col("same") >= F.col("needed"))
    about = F.broadcast(spark.createDataFrame([(t, label, len(text.split(" ")), [f" {k} " for k in keys]) for t, (label, text, keys) in enumerate(templates)], "template int, label string, size int, keys array<string>"))
    places = agreed.select("row", "template", (F.col("same") / F.col("rare")).alias("share"), "shift").join(about, "template")
    start = F.greatest(F.lit(0), F.col("shift") - SLACK)
    around = F.concat(F.lit(" "), F.array_join(F.slice("words", start + 1, F.col("size") + 2 * SLACK + DRIFT), " "), F.lit(" "))
    near = places.join(files, "row").withColumn("around", around)
    sure = near.where(F.forall("keys", lambda k: F.contains(F.col("around"), k)))
    return sure.groupBy("row").agg(F.collect_set("label").alias("template_labels"), F.max("share").alias("share"))
