"""License scans by a positional index of rare words.

The words of licence texts, function words left out, are indexed with their places, and the corpus says how
rare each is. Places of a file where several of a template's rarest words stand in their relative positions
are candidates, and a candidate counts if the template's key phrases and enough of its words stand there too.
Of each template so many of the rarest words count that no text with enough of its words has too few of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import cut, tidy

# The phrases that count wherever they stand, and licence texts with their key phrases.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free"),
    ("mit", "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "deal; merge publish distribute sublicense"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice shall; substantial portions"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability", "noninfringement; authors"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "file except"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "applicable law; basis without warranties"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public license; even"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl; distributed"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions; must retain"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "binary form must reproduce"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "promote products derived; specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "contributors; disclaimed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "without fee"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "author disclaims all warranties"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "has waived"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released; public domain"),
    ("reserved", "copyright all rights reserved", "all rights reserved"),
]
#: Words that say nothing about a licence and aren't indexed.
FUNCTION_WORDS = frozenset("a an and any are as at be but can do for if in into is it its may no nor not of on one or so that the this to under use used was whom will with you".split())

_TABLE = bytearray(b" " * 256)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _TABLE[_b] = _b
for _b in range(65, 91):
    _TABLE[_b] = _b + 32
_TABLE = bytes(_TABLE)


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and all beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def postings() -> tuple[list[tuple], list[tuple]]:
    """(template, label, base, words, key words) and (word, template, place, key) of all templates."""
    templates, entries = [], []
    for n, (label, text, keys, base) in enumerate([(a, b, b, True) for a, b in BASE] + [(a, b, c, False) for a, b, c in TEMPLATES]):
        own, held = text.split(), set()
        for k in (key.split() for key in keys.split("; ")):
            at = next(i for i in range(len(own)) if own[i : i + len(k)] == k)
            held |= set(range(at, at + len(k)))
        rows = [(w, n, i, i in held) for i, w in enumerate(own) if base or w not in FUNCTION_WORDS]
        entries += rows
        templates.append((n, label, base, len(rows), sum(r[3] for r in rows)))
    return templates, entries


def hits(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, words, places): each row of `docs` with its indexed words, in order."""
    known = frozenset(w.encode() for w, *_ in postings()[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count, found, places = [], [], []
            for text in b["text"]:
                own = words(text)
                at = [i for i, w in enumerate(own) if w in known]
                count.append(len(own))
                found.append([own[i].decode() for i in at])
                places.append(at)
            yield pd.DataFrame({"row": b["row"], "doc_id": b["doc_id"], "n_words": np.array(count, np.int64), "words": found, "places": places})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInPandas(tidy(run), "row long, doc_id long, n_words long, words array<string>, places array<long>")


def opening(own: DataFrame, index: DataFrame, votes: int) -> DataFrame:
    """(row, template, start): places that a template's rarest words open. Of the words that a notice must have, its key phrases',
    only the `votes` with the highest IDF are looked up, and all of these must stand in their relative places. As no notice lacks
    one of them, none is lost."""
    rare = F.row_number().over(W.partitionBy("template").orderBy(F.coalesce("df", F.lit(0)), "place"))
    few = cut(index.filter("key").withColumn("nth", rare).filter(F.col("nth") <= votes))
    flat = own.select("row", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("places").alias("at"))))
    # the tables of templates are of a fixed size
    met = flat.join(F.broadcast(few), "word").groupBy("row", "template", (F.col("at") - F.col("place")).alias("start"), "keys").agg(F.count("*").alias("r"))
    return met.filter(F.col("r") == F.least(F.lit(votes), F.col("keys"))).select("row", "template", "start")


def scan(docs: DataFrame, votes: int = 2, share: float = 0.6) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    The base phrases count at all their places, first_word and last_word being the smallest and the
    largest of these (null without any). A template counts where its whole key phrases and `share` of its
    words stand in their relative places, whatever else the file has; `votes` of its key phrases' rarest words, by the
    documents of `docs` that have them, open such a place, and the other words are looked up at open places alone.
    labels has both kinds, distinct, sorted and joined with commas; score is the largest share of a
    template's words, half of it for a base phrase alone, else 0. A null text is empty. Repeated
    rows stay; an empty table gives no rows.
    """
    spark = docs.sparkSession
    templates, entries = postings()
    own = cut(hits(docs))
    known = F.broadcast(spark.createDataFrame(templates, "template int, label string, base boolean, size int, keys int"))
    common = own.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    index = cut(spark.createDataFrame(entries, "word string, template int, place int, key boolean").join(common, "word", "left").join(known, "template"))
    opened = cut(opening(own, index, votes))
    asked = opened.join(F.broadcast(index.select("template", "word", "place", "key")), "template").withColumn("at", F.col("start") + F.col("place"))
    there = own.join(opened.select("row").distinct(), "row", "left_semi").select("row", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("places").alias("at"))))
    votes_of = (
        asked.join(there, ["row", "at", "word"])
        .groupBy("row", "template", "start")
        .agg(F.count("*").alias("n"), F.count_if("key").alias("k"))
        .join(known, "template")
        .filter((F.col("k") == F.col("keys")) & (F.col("base") | ((F.col("n") >= 2) & (F.col("n") >= share * F.col("size")))))
    )
    found = votes_of.groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(F.col("n") / F.col("size") * F.when(F.col("base"), 0.5).otherwise(1.0)).alias("score"),
    )
    text = lambda name: F.coalesce(name, F.lit("")).alias(name)
    return own.select("row", "doc_id", "n_words").join(found, "row", "left").select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", text("base_labels"), text("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
