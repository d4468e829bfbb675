"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover it whole. A byte is a learned embedding and one
lane that tells whether the bytes up to it stood shortly before as well. Learned filters over successive
bytes slide over each chunk and keep their largest value in it; the largest and the mean
of these over all chunks, and the number of bytes that the chunks have on average, go through a hidden layer into
one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.llm.common import fold, tidy

CHUNK, STEP = 512, 448
#: Bytes under a filter, bytes between its places, learned dimensions of a byte, filters, hidden units.
WIDTH, STRIDE, DIM, FILTERS, HIDDEN = 8, 2, 5, 32, 24
#: Numbers for a byte: its embedding and whether it repeats; how long a repeat is, and how far back it is looked for.
LANES, REPEAT, BACK = DIM + 1, 4, 24
#: Chunks that go through the network at once.
BATCH = 256
#: Rows that are scored at once.
ROWS = 512


def chunks(text: str | None) -> np.ndarray:
    """Overlapping chunks of the whole text's UTF-8 bytes, one a row, the last filled up with zeros."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, 1 + -(-(len(data) - CHUNK) // STEP))
    full = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    full[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(full, CHUNK)[::STEP]


def repeats(x: np.ndarray) -> np.ndarray:
    """For each byte of chunks, 1 if the REPEAT bytes up to it stand up to BACK bytes before as well; zeros are no bytes."""
    out, live = np.zeros(x.shape, bool), x > 0
    for d in range(2, BACK + 1):
        same = (x[:, d:] == x[:, :-d]) & live[:, d:]
        run = same[:, REPEAT - 1 :].copy()
        for k in range(1, REPEAT):
            run &= same[:, REPEAT - 1 - k : same.shape[1] - k]
        out[:, d + REPEAT - 1 :] |= run
    return out.astype(np.float32)


class Network:
    """The parameters by name, and what they make of chunks."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f32 = lambda x: x.astype(np.float32)
        self.p = {
            "embed": f32(r.normal(0, 0.5, (256, DIM))),
            "conv": f32(r.normal(0, 1 / np.sqrt(WIDTH * LANES), (WIDTH * LANES, FILTERS))),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": f32(r.normal(0, 1 / np.sqrt(2 * FILTERS), (2 * FILTERS + 1, HIDDEN))),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": f32(r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)),
            "out_bias": np.zeros(1, np.float32),
        }

    def _windows(self, x: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * LANES): the embedded bytes under the filters."""
        e = np.concatenate([self.p["embed"][x], repeats(x)[:, :, None]], 2).reshape(len(x), -1)
        places = (x.shape[1] - WIDTH) // STRIDE + 1
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(x), places, WIDTH * LANES), (s[0], STRIDE * LANES * s[1], s[1]))

    def pooled(self, x: np.ndarray, where: bool = False):
        """Each filter's largest value in each chunk, and the place where it is. Zeros after a text's end never win over it."""
        w = np.ascontiguousarray(self._windows(x))
        y = (w.reshape(-1, WIDTH * LANES) @ self.p["conv"]).reshape(len(x), -1, FILTERS)
        if not where:
            return np.maximum(y.max(1) + self.p["bias"], 0)
        at = y.argmax(1)
        top = np.take_along_axis(y, at[:, None], 1)[:, 0] + self.p["bias"]
        return np.maximum(top, 0), at, top > 0, w

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(features @ self.p["hidden"] + self.p["hidden_bias"])
        return h @ self.p["out"] + self.p["out_bias"], h

    @staticmethod
    def _filled(rows: np.ndarray) -> np.ndarray:
        """How far each chunk is filled, as a logarithm from 0 to 1."""
        return (np.log1p((rows != 0).sum(1)) / np.log1p(CHUNK)).astype(np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 for each whole text."""
        top, total = (np.zeros((len(texts), FILTERS), np.float32) for _ in range(2))
        filled, count = (np.zeros((len(texts), 1), np.float32) for _ in range(2))

        def add(rows: np.ndarray, owner: np.ndarray) -> None:
            own = self.pooled(rows)
            np.maximum.at(top, owner, own)
            np.add.at(total, owner, own)
            np.add.at(filled, owner, self._filled(rows)[:, None])
            np.add.at(count, owner, 1)

        held, owner, n = [], [], 0
        for k, text in enumerate(texts):
            own = chunks(text)
            for i in range(0, len(own), BATCH):
                held.append(own[i : i + BATCH])
                owner.append(np.full(len(held[-1]), k))
                n += len(held[-1])
                if n >= BATCH:
                    add(np.concatenate(held), np.concatenate(owner))
                    held, owner, n = [], [], 0
        if held:
            add(np.concatenate(held), np.concatenate(owner))
        z = self.head(np.hstack([top, total / np.maximum(count, 1), filled / np.maximum(count, 1)]))[0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -500, 500)))

    def train(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = 8, least: int = 700, batch: int = 48, rate: float = 0.004, seed: int = 5) -> None:
        """Adam on the log loss, for `epochs` or the `least` steps if these are more; each of `docs` is
        an array of chunks, each class weighs as much as it is common."""
        r, step = np.random.default_rng(seed), 0
        epochs = max(epochs, -(-least // max(1, len(docs) // batch)))
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            for some in np.array_split(r.permutation(len(docs)), max(1, len(docs) // batch)):
                step += 1
                g = self._gradient([docs[i] for i in some], labels[some].astype(np.float32))
                lr = rate * min(1.0, 2 * (1 - epoch / epochs))
                for k, x in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    x -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _gradient(self, docs: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        sizes = np.array([len(d) for d in docs])
        first, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(docs)), sizes)
        x = np.concatenate(docs)
        own, at, on, w = self.pooled(x, where=True)
        top = np.maximum.reduceat(own, first)
        filled = np.add.reduceat(self._filled(x), first) / sizes
        features = np.hstack([top, np.add.reduceat(own, first) / sizes[:, None], filled[:, None]]).astype(np.float32)
        z, h = self.head(features)
        dz = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = {"out": h.T @ dz, "out_bias": dz.sum(keepdims=True)}
        dh = np.outer(dz, self.p["out"]) * (1 - h * h)
        g["hidden"], g["hidden_bias"] = features.T @ dh, dh.sum(0)
        df = dh @ self.p["hidden"].T
        wins = own == top[owner]
        down = (df[:, :FILTERS][owner] * wins + (df[:, FILTERS:-1] / sizes[:, None])[owner]) * on
        g["bias"] = down.sum(0)
        chunk, _ = np.divmod(np.arange(down.size), FILTERS)
        under = w[chunk, at.ravel()]  # what each filter saw where it was largest
        g["conv"] = np.einsum("nfd,nf->df", under.reshape(len(x), FILTERS, -1), down)
        de = down[:, :, None] * self.p["conv"].T[None]
        places = at[:, :, None] * STRIDE + np.arange(WIDTH)
        seen = np.take_along_axis(x, places.reshape(len(x), -1), 1).ravel()
        g["embed"] = np.stack([np.bincount(seen, d, 256) for d in de.reshape(-1, LANES).T[:DIM]], 1).astype(np.float32)
        return g


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """All chunks and the labels of `rows` labelled documents of each class at most, the first by the hash
    of their ids."""
    own = labels.filter((fold(F.col("doc_id"), 5) != 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = [own.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]
    ids = [(r["doc_id"], int(r["quality"])) for p in picked for r in p.collect()]
    if not ids:
        return [], np.zeros(0)
    wanted = docs.sparkSession.createDataFrame(ids, "doc_id long, quality int")

    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id").select("doc_id", "quality", "text").collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [chunks(r["text"]) for r in found], np.array([r["quality"] for r in found])


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000) -> Network:
    """A network trained on the whole texts of `rows` labelled documents of each class at most, none held out. The output's bias
    then goes back from the sample's share of label 1 to the labels' own."""
    net = Network()
    x, y = training_rows(docs, labels, rows)
    if len(set(y.tolist())) == 2:
        net.train(x, y)
        own = labels.filter((fold(F.col("doc_id"), 5) != 0) & F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
        own, here = min(max(own, 1e-3), 1 - 1e-3), y.mean()
        net.p["out_bias"] += np.float32(np.log(own / (1 - own)) - np.log(here / (1 - here)))
    elif len(y):
        net.p["out"][:], net.p["out_bias"][:] = 0, 4.0 if y[0] else -4.0
    return net


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 3000) -> DataFrame:
    """`docs` (doc_id, text, more) with held_out, score and predicted.

    Learns from `rows` documents of each label at most, none held out (crc32 of the id as text, mod
    5, is 0). A null or empty text is one chunk of zeros and gets a score as any other. Labels of one
    class give a constant, no labels an untrained network. An id with two labels has the lower; a
    null id isn't held out. An empty table gives no rows. Columns named like the new ones give way.
    """
    net = fit(docs, labels, rows)
    docs = docs.drop("held_out", "score", "predicted").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), ROWS):
                some = b.slice(k, ROWS)
                scores = net.scores(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(scores, pa.float64())], [*some.schema.names, "score"])

    # whole rows go through Python: a UDF column would keep them on disk meanwhile
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(tidy(run), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
