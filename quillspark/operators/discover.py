"""Discovery: notes that are near an anchor but not linked to it, in two stages."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quillspark.functions import kernels
from quillspark.functions.vectors import normalized, strength
from quillspark.operators.search import blocks
from quillspark.sources.store import stored

#: Scored notes and spread that a z needs.
LEAST = 12
#: Anchors that go to all tasks, by the driver, at most, and their chunks that do at once; more anchors meet the others in a grid.
ANCHORS, CHUNKS = 1024, 4096
#: Rows of a cell of the grid: those that a task holds, and those that pass by.
HELD, PASSING = 1 << 14, 1 << 16
_FOUND = "anchor string, path string, d2 double, seq int"


def centroids(vectors: DataFrame) -> DataFrame:
    """(note_path, centroid): the mean of each note's vectors, at unit length."""
    cells = vectors.select("note_path", F.posexplode("vector").alias("d", "x"))
    means = cells.groupBy("note_path", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    own = means.groupBy("note_path").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("c"))
    return own.select("note_path", normalized(F.transform("c", lambda c: c["x"])).alias("centroid"))


def shortlist_size(limit: int) -> int:
    return max(200, 20 * limit)


def _numbered(some: DataFrame) -> tuple[pa.Array, DataFrame]:
    """The anchors of a block, and (anchor, no) of them: a row for each of a stated, bounded set."""
    ids = pc.unique(pa.array(some.select("anchor").toArrow().combine_chunks()["anchor"]))
    return ids, some.sparkSession.createDataFrame(list(zip(ids.to_pylist(), range(len(ids)), strict=True)), "anchor string, no int")


def _closest(vectors: DataFrame, own: DataFrame, names: DataFrame) -> DataFrame:
    """(anchor, path, d2, seq): how near each note of `vectors` comes to each anchor, by their best pair of chunks. `own` are the anchors'
    chunks (no, seq, vector), which go to all tasks CHUNKS at a time; each task takes the best of its rows before the shuffle."""
    rows = vectors.filter("vector is not null").sortWithinPartitions("note_path", "seq")
    own, out = stored(own.filter("vector is not null")), None
    parts = max(1, -(-own.count() // CHUNKS))
    for part in range(parts):
        some = (own.filter(F.pmod(F.xxhash64("no", "seq"), parts) == part) if parts > 1 else own).select("no", "vector").toArrow().combine_chunks()
        kernel = kernels.closest(some["no"].to_numpy(), kernels.matrix(pa.array(some["vector"])))
        found = rows.mapInArrow(kernel, StructType([StructField("no", IntegerType()), vectors.schema["note_path"], vectors.schema["seq"], StructField("d2", DoubleType())]))
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("no", "note_path").agg(F.min(F.struct("d2", "seq")).alias("p"))
    return best.join(F.broadcast(names), "no").select("anchor", F.col("note_path").alias("path"), "p.d2", "p.seq")


def _grid(own: DataFrame, rows: DataFrame, pairs: DataFrame | None, held: int) -> DataFrame:
    """(cell, side, note_path, seq, vector, other): anchors' rows (note_path, seq, vector) as side 0, `pairs` of an anchor and a note
    (anchor, note_path) as side 1 and `rows` as side 2, dealt out so that each anchor meets each note in one cell. A cell has about
    `held` of the anchors' rows and PASSING others, or fewer where there would be less cells than tasks; it is a partition of its own."""
    own, rows = (r.filter("vector is not null").select("note_path", F.col("seq").cast("int").alias("seq"), "vector") for r in (own, rows))
    # more cells down than across, as each cell across has a list of its own for each anchor
    across = max(1, -(-rows.count() // PASSING))
    down = max(1, -(-own.count() // held), -(-own.sparkSession.sparkContext.defaultParallelism // across))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("string").alias("other")
    left = own.select(each(across).alias("k"), "*").select((place("note_path", down) * across + F.col("k")).alias("cell"), F.lit(0).alias("side"), "note_path", "seq", "vector", none)
    right = rows.select(each(down).alias("k"), "*").select((F.col("k") * across + place("note_path", across)).alias("cell"), F.lit(2).alias("side"), "note_path", "seq", "vector", none)
    out = left.union(right)
    if pairs is not None:
        cell = place("anchor", down) * across + place("note_path", across)
        out = out.union(pairs.select(cell, F.lit(1), "note_path", F.lit(0), F.lit(None).cast(rows.schema["vector"].dataType), F.col("anchor").alias("other")))
    return out.repartitionById(down * across, F.col("cell")).sortWithinPartitions("cell", "side", "note_path", "seq")


def _few(anchors: DataFrame) -> bool:
    return anchors.limit(ANCHORS + 1).count() <= ANCHORS


def best_pairs(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, path, d2): how near each other note comes to each of `anchors` (anchor), by their best
    pair of chunks. A stated set of anchors, in blocks, against all vectors; `nearest_notes` has the head of each list."""
    out = None
    for some in blocks(anchors.distinct(), "anchor"):
        _, names = _numbered(some)
        own = vectors.join(F.broadcast(names), F.col("note_path") == F.col("anchor")).select("no", "seq", "vector")
        found = _closest(vectors.select("note_path", "seq", "vector"), own, names)
        out = found if out is None else out.unionByName(found)
    return out.filter("anchor <> path").select("anchor", "path", "d2")


def nearest_notes(vectors: DataFrame, k: int | None = None, bar: float = float("inf")) -> DataFrame:
    """(anchor, path, d2, rank from 0): the head of `best_pairs` for every note: the `k` nearest other notes, ties by path, or all
    whose distance is `bar` at most. No list is longer than that before it is shuffled."""
    own = vectors.select("note_path", "seq", "vector")
    found = _grid(own, own, None, HELD).mapInArrow(kernels.crossed(None if k is None else k + 1, bar), _FOUND)  # one more, as a note finds itself
    near = found.filter("anchor <> path").withColumn("rank", F.row_number().over(W.partitionBy("anchor").orderBy("d2", "path")) - 1)
    return (near if k is None else near.filter(F.col("rank") < k)).select("anchor", "path", "d2", "rank")


def pair_distances(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(anchor, path, d2, seq): the best pair of chunks of each of `pairs` (anchor, note_path), distinct ones; seq is the note's."""
    own = vectors.select("note_path", "seq", "vector")
    asked = own.join(pairs.select(F.col("anchor").alias("note_path")).distinct(), "note_path", "left_semi")
    return _grid(asked, own, pairs, PASSING).mapInArrow(kernels.paired, _FOUND)


def _shortlists(middle: DataFrame, both: DataFrame, a: DataFrame, size: int) -> DataFrame:
    """(anchor, note_path): the `size` nearest by centroid of many anchors a (anchor, own), without pairs in `both`."""
    own = a.select(F.col("anchor").alias("note_path"), F.lit(0).alias("seq"), F.col("own").alias("vector"))
    rows = middle.select("note_path", F.lit(0).alias("seq"), F.col("centroid").alias("vector"))
    near = W.partitionBy("anchor").orderBy("d2", "path")
    found = _grid(own, rows, both, HELD).mapInArrow(kernels.crossed(size), _FOUND)
    return found.withColumn("k", F.row_number().over(near)).filter(F.col("k") <= size).select("anchor", F.col("path").alias("note_path"))


def scored(vectors: DataFrame, middle: DataFrame, linked: DataFrame, anchors: DataFrame, limit: int, grade: bool = True) -> DataFrame:
    """(anchor, path, seq, d2, z): the whole population that `similar` takes its first `limit` from.

    `middle` are the centroids; notes in `linked` (a, b, either way) of the anchor and itself are out
    before the shortlist: the nearest by centroid, whose chunks are then compared exactly. z is the
    distance below the mean of all that were compared, in standard deviations of the sample.
    """
    a = anchors.distinct().join(middle.select(F.col("note_path").alias("anchor"), F.col("centroid").alias("own")), "anchor")
    both = linked.select("a", "b").union(linked.select("b", "a")).union(anchors.select("anchor", "anchor")).toDF("anchor", "note_path").distinct()
    near = W.partitionBy("query_id").orderBy(F.desc("near"), "note_path")
    size, out = shortlist_size(limit), None
    if not _few(a):
        out = pair_distances(vectors, stored(_shortlists(middle, both, a, size)))
    for some in blocks(a, "anchor") if out is None else ():
        ids, names = _numbered(some)
        asked = some.toArrow().combine_chunks()
        centers = kernels.matrix(pa.array(asked["own"]))[pc.index_in(ids, pa.array(asked["anchor"])).to_numpy()]
        # a row is not for the anchors it is linked with, at most as many as a block has
        skip = both.join(F.broadcast(names), "anchor").groupBy("note_path").agg(F.collect_list("no").alias("skip"))
        rows = middle.select("note_path", F.lit(0).alias("seq"), F.col("centroid").alias("vector")).join(skip, "note_path", "left").sortWithinPartitions("note_path")
        coarse = rows.mapInArrow(kernels.nearby(ids, centers, size), "query_id string, note_path string, seq int, near double")
        short = coarse.withColumn("k", F.row_number().over(near)).filter(F.col("k") <= size).select(F.col("query_id").alias("anchor"), "note_path")
        wanted = short.join(F.broadcast(names), "anchor").groupBy("note_path").agg(F.collect_list("no").alias("wanted"))
        own = vectors.join(F.broadcast(names), F.col("note_path") == F.col("anchor")).select("no", "seq", "vector")
        found = _closest(vectors.select("note_path", "seq", "vector").join(stored(wanted), "note_path"), own, names)
        out = found if out is None else out.unionByName(found)
    all_ = W.partitionBy("anchor")
    sd = F.stddev_samp("d2").over(all_)
    z = F.when(F.lit(grade) & (F.count("*").over(all_) >= LEAST) & (sd > 0), (F.avg("d2").over(all_) - F.col("d2")) / sd)
    return out.select("anchor", "path", "seq", "d2", z.alias("z"))


def similar(vectors: DataFrame, middle: DataFrame, linked: DataFrame, anchors: DataFrame, limit: int, grade: bool = True) -> DataFrame:
    """(anchor, path, seq, d2, score, z, band, rank): for each of `anchors` (anchor), the `limit`
    nearest notes by their best pair of chunks, of those that `scored` compares."""
    best = scored(vectors, middle, linked, anchors, limit, grade)
    rank = F.row_number().over(W.partitionBy("anchor").orderBy("d2", "path")) - 1
    return best.withColumn("rank", rank).filter(F.col("rank") < limit).select("anchor", "path", "seq", "d2", (-F.sqrt("d2")).alias("score"), "z", strength(F.col("z")).alias("band"), "rank")


def recheck(population: DataFrame) -> DataFrame:
    """(anchor, n, mean, sd, largest): z worked out again from a dumped population (anchor, path, d2, z), by sums of its own, and
    the largest difference from the z it has; null where there is none."""
    sums = population.groupBy("anchor").agg(F.count("*").alias("n"), F.avg("d2").alias("mean"))
    off = population.join(sums, "anchor").withColumn("off", F.col("d2") - F.col("mean"))
    sd = F.sqrt(F.sum(F.col("off") * F.col("off")) / (F.count("*") - 1))
    spread = off.groupBy("anchor").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.when(F.count("*") > 1, sd).alias("sd"))
    again = population.join(spread, "anchor").withColumn("again", F.when((F.col("n") >= LEAST) & (F.col("sd") > 0), (F.col("mean") - F.col("d2")) / F.col("sd")))
    return again.groupBy("anchor").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("sd").alias("sd"), F.max(F.abs(F.col("again") - F.col("z"))).alias("largest"))
