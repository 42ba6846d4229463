"""License statements in texts: fixed phrases, and longer templates by diagonal voting.

All rolling k-grams of words of a text are joined to the positions where templates have them. A match votes for the
diagonal text position minus template position; a copy of a template lies on one diagonal, a copy with words added or lost
on neighbouring ones. Votes are summed by diagonal, diagonals close to each other are merged, and a merged span counts if
the template positions that it has cover enough of the template. Votes compare the words themselves, not only their hash.

Texts without certain words cannot reach that cover: these words are chosen so that the k-grams free of them are too few.
Everything is DataFrame expressions. Templates are a parameter; their k-grams are a small local table.

Results for odd rows: a null text counts as empty and has no words and no labels; repeated rows get equal results; a null
doc_id stays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.common import ascii_lower, saved

#: Fixed values of the contract: phrase and label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Words in a text whose letters A-Z are not lowered yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GRAM = 3
COVER = 0.7
#: Diagonals at most this far apart belong to one span.
NEAR_DIAGONALS = 3

#: Template k-grams that are sent to every task, at most; more of them are joined by a shuffle.
SENT_GRAMS = 20_000

#: Label and wording of common license statements.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
            "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def grams_of(words: Sequence[str], k: int = GRAM) -> list[str]:
    return [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]


def telling_words(templates: Sequence[tuple[str, str]], k: int, cover: float) -> list[str]:
    """Words of which a text that covers enough of a template has at least one."""
    texts = [grams_of(words_of(t), k) for _, t in templates]
    chosen: list[str] = []
    while True:
        # k-grams that hold a whole phrase only stand in texts with that phrase, which are scanned anyway
        free = [[g for g in grams if not set(g.split(" ")) & set(chosen) and not any(f" {p} " in f" {g} " for p, _ in PHRASES)]
                for grams in texts]
        open_grams = [g for own, grams in zip(free, texts, strict=True) if len(set(own)) >= cover * len(set(grams)) for g in own]
        if not open_grams:
            return chosen
        # a longer word is rarer in texts
        seen = Counter(w for g in open_grams for w in set(g.split(" ")))
        chosen.append(max(seen, key=lambda w: (len(w) > 5, seen[w], w)))


def scan_words(docs: DataFrame, telling: Sequence[str]) -> DataFrame:
    """Rows (doc_id, h1, h2, n_words, words); ``words``, lowered, only where a phrase or a template is possible."""
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("whole"))
    lowered = F.lower("whole")
    needed = {min(p.split(" "), key=lambda w: -len(w)) for p, _ in PHRASES if " " in p} - {"cc"} | set(telling)
    shortest = {w for w in needed if not any(v != w and v in w for v in needed)}
    maybe = F.lit(False)
    for word in sorted(shortest):
        maybe = maybe | F.contains("low", F.lit(word))
    maybe = maybe | (F.contains("low", F.lit("cc")) & F.col("low").rlike(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"))
    found = (whole.withColumn("low", lowered)
             .withColumn("maybe", maybe)
             .withColumn("words", F.regexp_extract_all(F.when(F.col("maybe"), ascii_lower(F.col("whole"))).otherwise(F.col("whole")),
                                                       F.lit(WORD), F.lit(0))))
    return found.select("doc_id", F.xxhash64("whole").alias("h1"), F.xxhash64(F.reverse("whole"), F.length("whole")).alias("h2"),
                        F.size("words").cast("long").alias("n_words"), F.when(F.col("maybe"), F.col("words")).alias("words"))


def phrase_columns(df: DataFrame) -> DataFrame:
    """Adds n_base, first_word, last_word and base (labels) from ``words``."""
    df = df.withColumn("line", F.when(F.col("words").isNotNull(), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
    counts, firsts, lasts, labels = [], [], [], []

    def words_in(part: Column) -> Column:
        return F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit(""))) - 1

    for place, (phrase, label) in enumerate(PHRASES):
        column = f"parts_{place}"
        df = df.withColumn(column, F.when(F.contains("line", F.lit(f" {phrase} ")), F.split("line", f"(?<= ){phrase}(?= )", -1)))
        parts = F.col(column)
        counts.append(F.coalesce(F.size(parts) - 1, F.lit(0)))
        firsts.append(F.when(parts.isNotNull(), words_in(F.get(parts, F.lit(0)))))
        lasts.append(F.when(parts.isNotNull(), F.col("n_words") - words_in(F.element_at(parts, -1)) - phrase.count(" ") - 1))
        labels.append(F.when(parts.isNotNull(), F.lit(label)))
    total = counts[0]
    for one in counts[1:]:
        total = total + one
    df = df.withColumns({
        "n_base": total.cast("long"), "first_word": F.least(*firsts).cast("long"), "last_word": F.greatest(*lasts).cast("long"),
        "base": F.array_distinct(F.array_sort(F.array_compact(F.array(*labels))))})
    return df.drop("line", *[f"parts_{i}" for i in range(len(PHRASES))])


def template_spans(scanned: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = GRAM, cover: float = COVER) -> DataFrame:
    """Rows (doc_id, h1, h2, label, first, last, cover) of verified spans; positions are words from 0, ends included."""
    spark = scanned.sparkSession
    rows = [(number, label, position, gram) for number, (label, text) in enumerate(templates)
            for position, gram in enumerate(grams_of(words_of(text), k))]
    sizes = Counter(number for number, *_ in rows)
    local = spark.createDataFrame([(*r, sizes[r[0]]) for r in rows], "template int, label string, place int, gram string, grams int")
    local = local.withColumn("hash", F.xxhash64("gram"))
    if len(rows) <= SENT_GRAMS:
        local = F.broadcast(local)
    gram = F.concat_ws(" ", *[F.get("words", F.col("at") + i) for i in range(k)])
    each = (scanned.where(F.size("words") >= k).select("doc_id", "h1", "h2", "words", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("at"))
            .select("doc_id", "h1", "h2", "at", gram.alias("own")))
    votes = (each.withColumn("hash", F.xxhash64("own")).join(local, "hash").where("own = gram")
             .groupBy("doc_id", "h1", "h2", "template", "label", "grams", (F.col("at") - F.col("place")).alias("diagonal"))
             .agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last")))
    text = Window.partitionBy("doc_id", "h1", "h2", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(text) > NEAR_DIAGONALS) | F.lag("diagonal").over(text).isNull()
    spans = (votes.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(text))
             .groupBy("doc_id", "h1", "h2", "template", "label", "grams", "span")
             .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"),
                  (F.max("last") + k - 1).alias("last"))
             .withColumn("cover", F.size("places") / F.col("grams")))
    return spans.where(F.col("cover") >= cover).select("doc_id", "h1", "h2", "label", "first", "last", "cover")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    ``score`` is 1 with a phrase, else the best cover of a template, else 0.
    """
    scanned = saved(phrase_columns(scan_words(docs, telling_words(TEMPLATES, GRAM, COVER))), "license-words")
    found = (template_spans(scanned).groupBy("doc_id", "h1", "h2")
             .agg(F.collect_set("label").alias("more"), F.max("cover").alias("best"))
             .select(F.col("doc_id").alias("same_id"), F.col("h1").alias("same1"), F.col("h2").alias("same2"), "more", "best"))
    same = F.col("same_id").eqNullSafe(F.col("doc_id")) & (F.col("same1") == F.col("h1")) & (F.col("same2") == F.col("h2"))
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return scanned.drop("words").join(found, same, "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
