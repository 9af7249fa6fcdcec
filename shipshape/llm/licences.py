"""License scan (operator 13): positional index of rare licence words, key phrases verified.

DataFrame functions only. A notice is a passage of a licence with the phrases that must stand in it;
a notice may be a single phrase. Document frequencies of all notice words are counted over all
documents, and each notice's words of highest IDF form a positional index: word -> (notice, place).
Every whole text is looked up in it. A word at place i of a file and place p of a notice votes for
the notice to begin at i - p; votes that agree (exactly for short notices, within a quarter of its
length for long ones, since names and years vary) are intersected by one grouping, in which the
key phrases found at the same relative place are verified. A key phrase is found by its own rarest
word, then compared word by word, so that no place of a phrase is missed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shipshape.llm.common import written

# Licences, a passage of each notice, and the phrases that must stand in it (none: the whole passage).
# The first three are the base phrases.
NOTICES = (
    ("mit", "under the MIT License", ()),
    ("apache-2", "Apache License, Version 2", ()),
    ("cc-by-nc", "CC BY-NC", ()),
    ("cc-by-sa", "CC BY-SA", ()),
    ("cc-by-nd", "CC BY-ND", ()),
    ("cc-by", "Creative Commons Attribution 4.0 International", ()),
    ("cc0", "CC0 1.0 Universal", ()),
    ("gpl-2", "GNU General Public License, version 2", ()),
    ("gpl-3", "GNU General Public License, version 3", ()),
    ("lgpl", "GNU Lesser General Public License", ()),
    ("agpl-3", "GNU Affero General Public License", ()),
    ("mpl-2", "Mozilla Public License, Version 2.0", ()),
    ("epl-2", "Eclipse Public License 2.0", ()),
    ("bsd", "under the BSD License", ()),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
     ("permission is hereby granted free of charge", "copy modify merge publish distribute sublicense and or sell")),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                 "http://www.apache.org/licenses/LICENSE-2.0", ("except in compliance with the license", "apache org licenses license 2 0")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice",
     ("redistribution and use in source and binary forms", "redistributions of source code must retain")),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
     ("gnu general public license as published", "either version 2 of the license")),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
     ("gnu general public license as published", "either version 3 of the license")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies",
     ("permission to use copy modify and or distribute this software", "notice and this permission notice appear in all copies")),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
     ("source code form is subject to the terms", "mozilla public license v 2 0")),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software", "into the public domain")),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
             "for any damages arising from the use of this software.", ("provided as is without any express or implied warranty", "in no event will the authors be held liable")),
)
BASE = 3
#: Of a notice's distinct words at most this many, and at most half, are in the index.
RARE = 8
#: A notice of fewer words must keep its relative places exactly.
SHORT = 12
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Notice:
    """One notice: its words, those of the index, and its key phrases as (place in the notice, words, offset of the rarest word)."""

    label: str
    words: tuple[str, ...]
    rare: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...], int], ...]

    @property
    def drift(self) -> int:
        return 0 if len(self.words) < SHORT else len(self.words) // 4

    @property
    def need(self) -> int:
        return max(min(2, len(self.rare)), (len(self.rare) + 1) // 2)


def split_words(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(_SPLIT, text.translate(str.maketrans(_UPPER, _LOWER))) if w)


def file_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased (null: none)."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _SPLIT), "")


def frequencies(docs: DataFrame, text_col: str, notices=NOTICES) -> dict[str, int]:
    """Number of documents that hold each notice word (absent: none) and, under "", of all documents; at most one row a word."""
    vocabulary = sorted({w for _, text, _ in notices for w in split_words(text)})
    held = F.array_intersect(file_words(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    counted = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counted.collect()}


def indexed(df: dict[str, int], notices=NOTICES) -> list[Notice]:
    """The notices with their words of highest IDF, which are those of the smallest document frequency (ties: by word)."""
    def rank(w: str) -> tuple[int, str]:
        return df.get(w, 0), w
    out = []
    for label, text, phrases in notices:
        words = split_words(text)
        distinct = sorted(set(words), key=rank)
        keys = []
        for phrase in map(split_words, phrases or (text,)):
            at = next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)
            keys.append((at, phrase, phrase.index(min(phrase, key=rank))))
        out.append(Notice(label, words, tuple(distinct[:min(RARE, (len(distinct) + 1) // 2)]), tuple(keys)))
    return out


def _looked_up(index: list[Notice]):
    """Column function words -> (hits, phrases): places of indexed words, and places at which a key phrase stands."""
    rare = sorted({w for n in index for w in n.rare} | {p[off] for n in index for _, p, off in n.phrases})
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(f).alias("f"), F.lit(p[off]).alias("word"), F.lit(off).alias("off"), F.lit(len(p)).alias("len"),
                              F.array(*map(F.lit, p)).alias("words")) for t, n in enumerate(index) for f, (_, p, off) in enumerate(n.phrases)))

    def of(w: Column) -> Column:
        return F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda h: h["x"].isin(rare))

    def checked(w: Column, hits: Column) -> Column:
        def at(h: Column) -> Column:
            stands = F.filter(keys, lambda k: F.when((k["word"] == h["x"]) & (h["i"] >= k["off"]), F.slice(w, h["i"] - k["off"] + 1, k["len"]) == k["words"]).otherwise(False))
            return F.transform(stands, lambda k: F.struct(k["t"].alias("t"), k["f"].alias("f"), (h["i"] - k["off"]).alias("start")))
        return F.flatten(F.transform(hits, at))

    def both(w: Column) -> Column:  # words and hits bound as variables, else their split is inlined and evaluated for every hit
        return F.get(F.transform(F.array(of(w)), lambda hits: F.struct(F.size(w).alias("n_words"), hits.alias("hits"), checked(w, hits).alias("phrases"))), 0)
    return lambda words: F.get(F.transform(F.array(words), both), 0)


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, base: int = BASE) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    The first ``base`` notices are the base phrases: n_base counts their places, first_word and
    last_word are the smallest and largest (null: none), base_labels their licences. ``found`` has
    each licence with the first word of a verified notice, ``labels`` their names joined by commas.
    ``score`` is the greatest share of one notice's indexed words and key phrases that stand at one
    relative place with at least half of the indexed ones (two, if there are two); 0 without such a place.
    A null or empty text has no words and no labels. Repeated rows and null ids are scanned each,
    without any merging. An empty table gives no rows.
    """
    df = frequencies(docs, text_col, notices)
    index = indexed(df, notices)
    spark = docs.sparkSession
    # a key of its own for every row, fixed by writing
    base_rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), _looked_up(index)(file_words(F.col(text_col))).alias("l"))
    rows = written(base_rows.select("key", "id", "l.*"))

    # votes: the notice, the place at which it would begin, and a bit for the indexed word (from 0) or the key phrase (from 32)
    postings = [(w, t, p, n.drift + 1, 1 << n.rare.index(w)) for t, n in enumerate(index) for p, w in enumerate(n.words) if w in n.rare]
    phrases = [(t, f, p, n.drift + 1, 1 << (32 + f)) for t, n in enumerate(index) for f, (p, _, _) in enumerate(n.phrases)]
    kinds = [(t, n.label, n.need, len(n.rare) + len(n.phrases), len(n.phrases)) for t, n in enumerate(index)]
    posted = spark.createDataFrame(postings, "x string, t int, p int, step int, bit long")
    keyed = spark.createDataFrame(phrases, "t int, f int, p int, step int, bit long")
    kind = spark.createDataFrame(kinds, "t int, label string, need int, parts int, keys int")  # all three of constant size
    votes = rows.select("key", F.explode("hits").alias("h")).select("key", "h.*").join(F.broadcast(posted), "x").select(
        "key", "t", "step", "bit", (F.col("i") - F.col("p")).alias("at"), F.lit(None).cast("int").alias("start"))
    spoken = rows.select("key", F.explode("phrases").alias("h")).select("key", "h.*").join(F.broadcast(keyed), ["t", "f"]).select(
        "key", "t", "step", "bit", (F.col("start") - F.col("p")).alias("at"), "start")
    # ranges of two steps that overlap by one: places at most a step less one apart share a range
    both = votes.union(spoken).withColumn("r", F.floor(F.col("at") / F.col("step")))
    both = both.select("*", F.explode(F.when(F.col("step") > 1, F.array("r", F.col("r") - 1)).otherwise(F.array("r"))).alias("range"))
    met = both.groupBy("key", "t", "range").agg(F.bit_or("bit").alias("bits"), F.min("start").alias("start")).join(F.broadcast(kind), "t")
    words, keys = F.bit_count(F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_count(F.shiftrightunsigned("bits", 32))
    met = met.where(words >= F.col("need")).select("key", "label", ((words + keys) / F.col("parts")).alias("share"), F.when(keys == F.col("keys"), F.col("start")).alias("start"))
    # at most one entry a licence
    met = met.groupBy("key", "label").agg(F.max("share").alias("share"), F.min("start").alias("start")).groupBy("key").agg(
        F.max("share").alias("score"), F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("label", F.col("start").cast("long").alias("start"))))).alias("found"))

    stood = F.filter("phrases", lambda p: p["t"] < base)
    starts = F.transform(stood, lambda p: p["start"].cast("long"))
    names = F.array(*(F.lit(n.label) for n in index[:base]))
    rows = rows.select("key", "id", F.col("n_words").cast("long").alias("n_words"), F.size(stood).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                       F.array_max(starts).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(F.transform(stood, lambda p: F.get(names, p["t"])))), ",").alias("base_labels"))
    found = F.coalesce("found", F.array().cast("array<struct<label:string,start:bigint>>"))
    return rows.join(met, "key", "left").select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.transform(found, lambda x: x["label"]), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), found.alias("found"))
