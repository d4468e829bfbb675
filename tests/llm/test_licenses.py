from __future__ import annotations

import random
import re

from quillspark.llm import licenses

BASE = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for label, p in BASE.items() for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "Released under the MIT License.", "x CC-BY y cc by cc by", "ALL RIGHTS RESERVED all rights reserved", "General public\nlicense", None, "", "cc\x00by", "all rights all rights reserved",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "mit apache license words apart under 2 0 gnu", "É cc by É é ccé by", "cc by " * 3000,
]


def test_scan_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(list(enumerate(TEXTS, 10_000)), "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert len(rows) == len(texts)
    for doc_id, text in texts.items():
        r = rows[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))
    label = lambda k: rows[10_000 + k]["labels"]
    assert (label(0), label(8), label(9), label(10), label(11)) == ("mit", "gpl", "apache-2.0", "cc-by,cc-by-nc", "")


def test_no_notice_is_lost_among_other_licence_words(spark):
    """A notice counts however common it is and however many rarer licence words its file has."""
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."
    other = "Plain words of a long text. " * 500
    docs = [(1, f"{grant} Licensed under CC BY-NC 4.0."), (2, f"{other} binary hereby waived possible fee redistribution {other} Released under the MIT License. {other}")]
    docs.append((3, f"{grant} {other} Licensed under the Apache License, Version 2.0. {other} Licensed under CC BY-NC 4.0. {other} binary waived possible fee"))
    docs += [(n, "Licensed under CC BY-NC 4.0. Released under the MIT License.") for n in range(10, 60)]
    rows = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (rows[1], rows[2], rows[3]) == ("cc-by,cc-by-nc,mit", "mit", "apache-2.0,cc-by,cc-by-nc,mit")


def by_hand(text):
    """Labels of the templates, one place after another."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low), {label for label, p in licenses.BASE if re.search(rf"(?<![^ ]){p}(?![^ ])", " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)))}
    for label, template, keys in licenses.TEMPLATES:
        own = template.split()
        held = {i for k in keys.split("; ") for i in range(template[: re.search(rf"(?<![^ ]){k}(?![^ ])", template).start()].count(" "), template[: re.search(rf"(?<![^ ]){k}(?![^ ])", template).end()].count(" ") + 1)}
        told = [i for i, w in enumerate(own) if w not in licenses.FUNCTION_WORDS]
        for at in range(-len(own), len(words)):
            same = {i for i in told if 0 <= at + i < len(words) and words[at + i] == own[i]}
            if len(same) >= 2 and len(same) >= 0.6 * len(told) and held <= same:
                found.add(label)
    return ",".join(sorted(found))


def test_labels_against_brute_force(spark):
    """Whole notices, some words changed, left out or added, several to a file and on their own."""
    r = random.Random(5)
    texts = [" ".join(t for _, t, _ in licenses.TEMPLATES), " x ".join(reversed([t.title() for _, t, _ in licenses.TEMPLATES]))]
    for _ in range(250):
        words = []
        for _, t, _ in r.sample(licenses.TEMPLATES, r.randint(1, 3)):
            own = t.split()
            for _ in range(r.randint(0, len(own) // 2)):
                k = r.randrange(len(own))
                own[k] = r.choice([own[k], "other", own[k].upper(), f"{own[k]} more", ""])
            words += [*own, *["plain"] * r.randint(0, 4)]
        texts.append(" ".join(words))
    rows = {x["doc_id"]: x["labels"] for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {*rows[0].split(",")} == {x for x, *_ in licenses.TEMPLATES} == {*rows[1].split(",")}
    for n, text in enumerate(texts):
        assert rows[n] == by_hand(text), text


def test_rare_words_open_few_places(spark, sf):
    """Only the rarest words of key phrases are looked up everywhere: a tenth of what all words would meet, at most."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = licenses.hits(docs).persist()
    templates, entries = licenses.postings()
    known = spark.createDataFrame(templates, "template int, label string, base boolean, size int, keys int")
    common = own.selectExpr("explode(array_distinct(words)) AS word").groupBy("word").agg({"*": "count"}).withColumnRenamed("count(1)", "df")
    index = spark.createDataFrame(entries, "word string, template int, place int, key boolean").join(common, "word", "left").join(known, "template")
    every = own.selectExpr("row", "inline(arrays_zip(words, places)) AS (word, at)").join(index, "word")
    starts = every.groupBy("row", "template", (every["at"] - every["place"]).alias("start")).count()
    opened = {tuple(r) for r in licenses.opening(own, index, 2).collect()}
    assert 0 < 10 * len(opened) <= starts.count()
    # without a word of a key phrase nothing opens, whatever else is there
    label, template, keys = next((a, b, c) for a, b, c in licenses.TEMPLATES if len(c.split("; ")[0].split()) > 1)
    cut = template.replace(keys.split("; ")[0].split()[0], "other")
    one = spark.createDataFrame([(1, cut), (2, template)], "doc_id long, text string")
    got = {r["doc_id"]: label in r["labels"].split(",") for r in licenses.scan(one).collect()}
    assert got == {1: False, 2: True}
