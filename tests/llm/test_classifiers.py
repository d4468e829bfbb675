from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np

from quillspark.llm import quality, toxicity


def test_chunks_cover_the_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = "".join(random.Random(n).choice("abcé") for _ in range(n))
        own, raw = quality.chunks(data), data.encode()
        back = bytearray(len(raw))
        for k, c in enumerate(own):
            part = bytes(c)[: max(0, len(raw) - k * quality.STEP)]
            back[k * quality.STEP : k * quality.STEP + len(part)] = part
        assert bytes(back) == raw and own.shape[1] == quality.CHUNK and (not raw or len(own) == 1 or (len(own) - 1) * quality.STEP < len(raw))


def test_gradient_is_the_slope():
    r = np.random.default_rng(3)
    docs = [r.integers(1, 200, (n, quality.CHUNK)).astype(np.uint8) for n in (1, 2, 3)]
    y, net = np.array([1, 0, 1], np.float32), quality.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        p = np.clip(np.array([net_score(d) for d in docs]), 1e-12, 1 - 1e-12)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    def net_score(d):
        own = net.pooled(d)
        z = net.head(np.hstack([own.max(0), own.mean(0), net._filled(d).mean()])[None])[0]
        return float(1 / (1 + np.exp(-z[0])))

    g = net._gradient(docs, y)
    for name, x in net.p.items():
        flat, slope = x.reshape(-1), np.asarray(g[name]).reshape(-1)
        for i in np.argsort(-np.abs(slope))[:3]:
            was = flat[i]
            flat[i] = was + 1e-4
            up = loss()
            flat[i] = was - 1e-4
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-4 - slope[i]) < 1e-3 + 0.05 * abs(slope[i]), name


def test_quality_held_out(spark):
    """Labels that follow from the text are learned; the held-out fifth is as good."""
    r = random.Random(4)
    docs, labels = [], []
    for n in range(500):
        good = n % 3 > 0
        words = ["".join(r.choice("aeioustnrl") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 150))]
        docs.append((n, " ".join(words if good else [w.upper() + "!!" for w in words]), "extra"))
        labels.append((n, int(good)))
    docs += [(1000, None, "x"), (1001, "", "y"), (None, "abc", None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (1000, None), (5, 0), (5, labels[5][1])], "doc_id long, quality int")
    found = quality.quality(rows, marks, rows=150)
    got = {x["doc_id"]: x for x in found.collect()}
    assert len(got) == len(docs) and found.columns == ["doc_id", "text", "held_out", "score", "predicted"]
    held = [n for n, _ in labels if zlib.crc32(str(n).encode()) % 5 == 0]
    assert all(got[n]["held_out"] == (n in held) for n, _ in labels) and held
    assert np.mean([got[n]["predicted"] == labels[n][1] for n in held]) > 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got.values())


def test_no_labels(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(rows, none).count() == 2 and toxicity.toxicity(rows, none).count() == 2
    assert quality.quality(rows.limit(0), none).count() == 0 and toxicity.toxicity(rows.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [x["predicted"] for x in quality.quality(rows, one).collect()] == [1, 1]


def test_toxicity_held_out(spark):
    r = random.Random(8)
    bad = ["vile", "rotten", "fiend"]
    docs, labels = [], []
    for n in range(1500):
        words = ["".join(r.choice("aeioustnrl") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 120))]
        toxic = n % 9 == 0
        for _ in range(3 * toxic):
            words[r.randrange(len(words))] = r.choice(bad) + r.choice(["", "ness", "ly", "s"])
        docs.append((n, " ".join(words).title()))
        if n % 2:
            labels.append((n, int(toxic)))
    docs += [(5000, None), (5001, ""), (None, "rotten")]
    found = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x["doc_id"]: x for x in found.collect()}
    assert len(got) == len(docs)
    held = [n for n in range(1500) if zlib.crc32(str(n).encode()) % 4 == 2]
    assert all(got[n]["held_out"] for n in held)
    hits = [got[n]["predicted"] for n in held if n % 9 == 0]
    clean = [got[n]["predicted"] for n in held if n % 9]
    assert np.mean(hits) > 0.9 and np.mean(clean) < 0.02


def test_hashes_depend_on_words_alone():
    at = lambda s: {int(h) for h in toxicity.hashes(np.frombuffer(s.encode(), np.uint8))[1]}
    assert at("Vile, thing") == at("xx vile") - at("xx") | at("thing") and at("vile") & at("vileness") and at("vile") != at("evil")


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 64)
    known = toxicity.hashes(np.frombuffer(b"rotten", np.uint8))[1]
    lexicon = toxicity.Lexicon(known)
    texts = ["fine " * 50 + "rotten", "", None, "fine", "rotten " * 40]
    text, place = lexicon.present(texts)
    assert sorted(set(text.tolist())) == [0, 4] and len(place) == 2 * len(lexicon.known)


def plain_quality(net, text):
    """A text's score by loops over its bytes."""
    data = list((text or "").encode("utf-8", "surrogatepass"))
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    starts = [0]
    while starts[-1] + quality.CHUNK < len(data):
        starts.append(starts[-1] + quality.STEP)
    tops, filled = [], []
    for s in starts:
        x = (data[s : s + quality.CHUNK] + [0] * quality.CHUNK)[: quality.CHUNK]
        again = [
            any(i - d - 3 >= 0 and all(x[i - k] and x[i - k] == x[i - k - d] for k in range(4)) for d in range(2, 25)) for i in range(quality.CHUNK)
        ]
        seen = [p["embed"][b] + [float(a)] for b, a in zip(x, again, strict=True)]
        best = [-math.inf] * quality.FILTERS
        for place in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            under = [v for e in seen[place : place + quality.WIDTH] for v in e]
            for f in range(quality.FILTERS):
                best[f] = max(best[f], sum(u * row[f] for u, row in zip(under, p["conv"], strict=True)))
        tops.append([max(b + c, 0) for b, c in zip(best, p["bias"], strict=True)])
        filled.append(math.log1p(sum(b > 0 for b in x)) / math.log1p(quality.CHUNK))
    features = [max(t) for t in zip(*tops, strict=True)] + [sum(t) / len(t) for t in zip(*tops, strict=True)] + [sum(filled) / len(filled)]
    hidden = [math.tanh(sum(v * row[h] for v, row in zip(features, p["hidden"], strict=True)) + p["hidden_bias"][h]) for h in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-sum(h * w for h, w in zip(hidden, p["out"], strict=True)) - p["out_bias"][0]))


def test_quality_against_loops(monkeypatch):
    r = random.Random(14)
    net = quality.Network(3)
    net.p["bias"] = np.random.default_rng(2).normal(0, 0.3, quality.FILTERS).astype(np.float32)
    texts = [None, "", "a", "abcabcabcabc abc", "".join(r.choice("abc é日!") for _ in range(900)), "x" * 513, "".join(r.choice("ab ") for _ in range(512))]
    monkeypatch.setattr(quality, "BATCH", 2)
    assert np.allclose(net.scores(texts), [plain_quality(net, t) for t in texts], atol=1e-5)


def plain_features(text):
    """Hashes of a text's words and of their starts, word by word."""
    out, whole = set(), (1 << 64) - 1
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode("utf-8", "surrogatepass").lower()):
        number = lambda part: sum(b * pow(int(toxicity._BASE), j, 1 << 64) for j, b in enumerate(part))
        for h in [2 * number(word) + 1, *[2 * (number(word[:n]) + n) for n in toxicity.STARTS if len(word) >= n]]:
            h &= whole
            h = (h ^ h >> 29) * int(toxicity._BASE) & whole
            out.add(h ^ h >> 32)
    return out


def test_toxicity_against_loops(monkeypatch):
    """Scores are the bias and the weight of each known feature that a text has, once, however the texts are cut."""
    r = random.Random(15)
    vocabulary = ["".join(r.choice("abcdefé日Q7") for _ in range(r.randint(1, 10))) for _ in range(60)]
    texts = [None, "", *["".join(r.choice(vocabulary) + r.choice(" ,.\n") for _ in range(r.randint(1, 150))) for _ in range(40)]]
    known = sorted(set().union(*map(plain_features, texts)))
    known = r.sample(known, len(known) // 2)
    lexicon = toxicity.Lexicon(np.array(known, np.uint64))
    weights = np.random.default_rng(4).normal(0, 1, len(known))
    weight = dict(zip(lexicon.known.tolist(), weights.tolist(), strict=True))
    want = [1 / (1 + math.exp(0.7 - sum(weight[h] for h in plain_features(t) if h in weight))) for t in texts]
    for piece in (1 << 20, 200):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert np.allclose(toxicity.scores((lexicon, weights, -0.7), texts), want, atol=1e-9)


def plain_risk(w, b, xp, xu, prior):
    """The two parts of the risk with sigmoid loss: of toxic text taken as toxic, and of clean text."""
    g = lambda x: 1 / (1 + math.exp(-(sum(a * c for a, c in zip(w, x, strict=True)) + b)))
    sp, su = sum(map(g, xp)) / len(xp), sum(map(g, xu)) / len(xu)
    return prior * (1 - sp), su - prior * sp


def test_training_lowers_the_corrected_risk():
    r = np.random.default_rng(9)
    xp = (r.random((60, 6)) < [0.8, 0.7, 0.5, 0.1, 0.1, 0.1]).astype(np.float32)
    clean = (r.random((180, 6)) < 0.1).astype(np.float32)
    xu, prior = np.concatenate([clean, xp[:20]]), 0.1
    w, b = toxicity.train(xp, xu, prior)
    risk = lambda w, b: (lambda a, c: a + max(0, c))(*plain_risk(list(w), b, xp.tolist(), xu.tolist(), prior))
    assert risk(w, b) < 0.5 * risk([3.0] * 6, -2.0) and risk(w, b) < prior
