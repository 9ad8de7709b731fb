"""License scans by diagonal voting (operator 3), built-in functions only.

Every rolling word k-gram of a text is hashed and joined to the positions of the same k-gram in the license templates
(two words for templates under ``SHORT`` words, three for others). A match at text word i and template word j votes for
the diagonal i - j; votes are aggregated per row, template and diagonal, diagonals within ``SLACK`` of each other are
merged (words added or lost inside a notice shift them), and spans are verified. Enough distinct template positions
must match: a share of the template's k-grams, or all but those that one changed word takes away; the latter, of templates
matched by pairs, only with the opening pair ("licensed under") and in those of ``LEAST`` pairs. So prose that only names a
license ("about the mit license") has too little of a notice. One of them must be a k-gram that only templates of this label have. And the span must be no longer than the template allows;
where a merged run is longer, its diagonals are verified one by one. Verified templates give labels beside the base
phrases; score is the best share of a template found, or 1 for a base phrase.

Templates are fixed and few, so they are broadcast; a row's hits are all that is shuffled.

Defined cases: null text is empty; texts shorter than a k-gram have no votes; repeated rows each return; a template
found twice is one label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"
# Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Notices by which licenses are stated, and opening passages of license texts.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "licensed under the gpl version 2"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("reserved", "copyright all rights reserved"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "released under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Templates of fewer words are matched by pairs of words, others by triples.
SHORT = 10
#: Diagonals this close are one.
SLACK = 3
#: Verified: this share of a template's k-grams, in a span of at most this many times its words.
SHARE, STRETCH = 0.75, 1.5
#: k-grams of a short template that may lack those of a changed word.
LEAST = 5


def templates(spark: SparkSession) -> DataFrame:
    """hash, template, label, width, its number of k-grams and words, place, and own: no other label has this k-gram."""
    rows = [(i, label, text.split(" ")) for i, (label, text) in enumerate(TEMPLATES)]
    df = spark.createDataFrame([(*r, 2 if len(r[2]) < SHORT else 3) for r in rows], "template int, label string, words array<string>, width int")
    df = df.withColumn("grams", F.when(F.col("width") == 2, rolling(F.col("words"), 2)).otherwise(rolling(F.col("words"), 3)))
    each = df.select("template", "label", "width", F.size("grams").alias("grams"), F.size("words").alias("t_words"), F.posexplode("grams").alias("place", "hash"))
    own = F.size(F.collect_set("label").over(Window.partitionBy("hash"))) == 1
    return each.withColumn("own", own)


def rolling(words: Column, width: int) -> Column:
    """Hashes of all windows of ``width`` words, in order."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    out = one
    for k in range(1, width):
        # get() past the end is null; such windows are cut off below
        nxt = F.slice(one, F.lit(k + 1), F.greatest(F.size(one) - k, F.lit(0)))
        out = F.zip_with(out, nxt, lambda a, b: F.xxhash64(a, b))
    return F.slice(out, F.lit(1), F.greatest(F.size(one) - (width - 1), F.lit(0)))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand one after another."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        ok = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            ok = ok & (F.get(words, i + k) == p)
        return ok

    last = F.size(words) - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def prepared(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (word number and label of each place), words' k-gram hashes."""
    raw = docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    words = raw.select("doc_id", F.filter(F.split(ascii_lower(F.col("_t")), GAP), lambda w: w != "").alias("words"))
    empty = F.array().cast("array<struct<at:int,label:string>>")

    def places(phrase: str, label: str) -> Column:
        found = F.transform(phrase_starts(F.col("words"), phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
        return F.when(F.array_contains("words", phrase.split(" ")[0]), found).otherwise(empty)

    bases = [places(phrase, label) for phrase, label in PHRASES]
    hits = F.concat(*(F.transform(rolling(F.col("words"), k), lambda h, i: F.struct(i.alias("at"), h.alias("hash"))) for k in (2, 3)))
    return words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.concat(*bases).alias("base"), hits.alias("hashes"))


def votes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One pass: for each row a record of its own, and a record for each k-gram that is in a template."""
    rows = prepared(docs, text_col).withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("_row", "doc_id", "n_words", "base", F.posexplode_outer("hashes").alias("i", "h")).select("_row", "doc_id", "n_words", "base", "i", "h.at", "h.hash")
    table = F.broadcast(templates(docs.sparkSession))
    # A row's first k-gram brings the row's own record, whether or not it is in a template.
    own = F.coalesce(F.col("i") == 0, F.lit(True))
    hit = each.join(table.withColumnRenamed("own", "telling"), "hash", "left").filter(F.col("template").isNotNull() | own)
    return hit.select("_row", F.when(own, F.struct("doc_id", "n_words", "base")).alias("own"), "at", "template", "label", "width", "grams", "t_words", "place", "telling")


def spans(hits: DataFrame) -> DataFrame:
    """_row, label, start, end (words, end exclusive), share of verified templates."""
    key = ["_row", "template", "label", "width", "grams", "t_words"]
    lines = hits.withColumn("d", F.col("at") - F.col("place")).groupBy(*key, "d").agg(
        F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_set("place").alias("places"), F.max("telling").alias("telling")
    )
    w = Window.partitionBy("_row", "template").orderBy("d")
    fresh = F.coalesce(F.col("d") - F.lag("d").over(w) > SLACK, F.lit(True))
    runs = lines.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(w))

    def sure(x: Column) -> Column:
        spared = (F.col("width") > 2) | (x["opens"] & (F.col("grams") >= LEAST))
        enough = (x["n"] >= SHARE * F.col("grams")) | (spared & (x["n"] >= F.col("grams") - F.col("width")))
        return enough & x["telling"] & (x["end"] - x["start"] <= STRETCH * F.col("t_words"))

    line = F.struct(F.col("lo").alias("start"), (F.col("hi") + F.col("width")).alias("end"), F.size("places").alias("n"), "telling", F.array_contains("places", 0).alias("opens"))
    merged = runs.groupBy(*key, "run").agg(
        F.struct(F.min("lo").alias("start"), (F.max("hi") + F.max("width")).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"), F.max("telling").alias("telling"), F.max(F.array_contains("places", 0)).alias("opens")).alias("whole"),
        F.collect_list(line).alias("lines"),
    )
    found = F.when(sure(F.col("whole")), F.array("whole")).otherwise(F.filter("lines", sure))
    each = merged.select("_row", "label", "grams", F.explode(found).alias("x"))
    return each.select("_row", "label", "x.start", "x.end", F.round(F.col("x.n") / F.col("grams"), 6).alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base and found (label, start, end, share of verified templates) of every row."""
    seen = materialize(votes(docs))
    rows = seen.filter("own is not null").groupBy("_row").agg(F.first("own").alias("own"))
    found = spans(seen.filter("template is not null")).groupBy("_row").agg(F.collect_list(F.struct("label", "start", "end", "share")).alias("found"))
    none = F.array().cast("array<struct<label:string,start:int,end:int,share:double>>")
    return rows.join(found, "_row", "left").select("own.*", F.coalesce("found", none).alias("found"))


def query(docs: DataFrame) -> DataFrame:
    base_labels = F.transform("base", lambda x: x["label"])
    sorted_join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    at = F.transform("base", lambda x: x["at"].cast("long"))
    best = F.array_max(F.transform("found", lambda x: x["share"]))
    return scan(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        sorted_join(base_labels).alias("base_labels"), sorted_join(F.concat(base_labels, F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
