"""Hard negatives by exact integer scores from a residue number system.

Scores are integer inner products.  Every component is replaced by its balanced
residues modulo several primes below 256; the residue matrices are multiplied in
float32, whose sums over ``DIMS`` products of two residues stay below 2^24 and are
therefore exact; and the signed scores come back by Chinese remaindering (mixed
radix digits, balanced).  The number of primes follows from a bound on all scores
that is computed over the whole table: the largest sum of absolute components times
the largest component.

Selection is windowed and takes two scans.  The first keeps, per anchor, the best
rows of its label; they fix a score window per positive.  The second keeps, per
anchor and positive, the best rows of other labels inside that window.  Anchors go to
the executors in groups of at most ``GROUP_BYTES``, one broadcast at a time; every
task streams its part of all rows against the group and returns only its own best, so
what is shuffled is a few rows per anchor and task.  No label is ever brought
together, so one that holds a third of all rows costs nothing extra.

Cases: rows with a null label, a null vector or any null or non-finite component take
no part.  Shorter vectors are filled up with zeros.  A null vec_id is no anchor, keeps
its label and comes last among ties.  Repeated rows are rows of their own: the anchor
itself is left out once, by its place in the stored table.  An anchor without
positives, or a positive without rows in its window, gives no row.  An empty table
gives an empty result; other columns are ignored.  Scores that could pass a long
raise ArithmeticError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, stored, tidy

PRIMES = [p for p in range(251, 2, -2) if all(p % q for q in range(3, 16, 2))]
DIMS = (1 << 24) // 125**2    # products of two balanced residues that float32 adds exactly
GROUP_BYTES = 32 << 20        # components of the anchors in one broadcast
ROWS, ANCHORS = 4_096, 256    # one block of scores
NONE = np.iinfo(np.int64).min


def moduli(bound: int) -> list[int]:
    """The fewest primes whose product holds every score of -bound to bound."""
    product, out = 1, []
    for p in PRIMES:
        out.append(p)
        product *= p
        if product > 2 * bound + 1:
            return out
    raise ArithmeticError("scores are too large")


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues in -(p-1)/2 .. (p-1)/2."""
    return (x + p // 2) % p - p // 2


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [balanced(x, p).astype(np.float32) for p in primes]


def exact_scores(rows: list[np.ndarray], anchors: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The integer inner products (rows, anchors) of two sets of residue matrices."""
    value, weight = None, 1
    for p, a, b in zip(primes, rows, anchors):
        left = None
        for k in range(0, max(1, a.shape[1]), DIMS):
            part = balanced((a[:, k:k + DIMS] @ b[:, k:k + DIMS].T).astype(np.int32), p)
            left = part if left is None else left + part
        if value is None:
            value = balanced(left, p).astype(np.int64)
        else:
            value += balanced((left - value) % p * pow(weight, -1, p), p).astype(np.int64) * weight
        weight *= p
    return value


class Best:
    """The best ``size`` rows of every anchor so far: score descending, then vec_id
    (nulls last), then place."""

    def __init__(self, anchors: int, size: int):
        self.size = size
        self.score = np.full((anchors, size), NONE)
        self.vec, self.place = np.zeros((anchors, size), np.int64), np.zeros((anchors, size), np.int64)
        self.null = np.zeros((anchors, size), bool)

    def add(self, first: int, scores: np.ndarray, allowed: np.ndarray, vec, null, place):
        """Rows against anchors ``first`` and following."""
        masked = np.where(allowed, scores, NONE)
        floor = self.score[first:first + masked.shape[1], -1]
        hit = (masked >= floor) & allowed
        if hit.any(axis=0).sum() and hit.sum() > 4 * self.size * masked.shape[1] and len(masked) > self.size:
            kth = np.partition(masked, len(masked) - self.size, axis=0)[-self.size]
            hit &= masked >= kth
        r, c = np.nonzero(hit)
        if not len(r):
            return
        touched = np.unique(c)
        old = self.score[first + touched]
        oc, oslot = np.nonzero(old > NONE)
        at = first + touched[oc]
        anchor = np.concatenate([at, first + c])
        score = np.concatenate([self.score[at, oslot], masked[r, c]])
        v = np.concatenate([self.vec[at, oslot], vec[r]])
        n = np.concatenate([self.null[at, oslot], null[r]])
        p = np.concatenate([self.place[at, oslot], place[r]])
        order = np.lexsort((p, v, n, -score, anchor))
        anchor = anchor[order]
        starts = np.r_[0, np.flatnonzero(np.diff(anchor)) + 1]
        rank = np.arange(len(anchor)) - np.repeat(starts, np.diff(np.r_[starts, len(anchor)]))
        keep = rank < self.size
        order, anchor, rank = order[keep], anchor[keep], rank[keep]
        self.score[anchor, rank], self.vec[anchor, rank] = score[order], v[order]
        self.null[anchor, rank], self.place[anchor, rank] = n[order], p[order]

    def rows(self):
        """(anchor, score, vec, null, place) of what was kept."""
        a, s = np.nonzero(self.score > NONE)
        return a, self.score[a, s], self.vec[a, s], self.null[a, s], self.place[a, s]


def prepared(embeddings: DataFrame) -> DataFrame:
    """The rows that take part, stored: place, vec_id, label, q (integer components,
    all of one length)."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    label = F.col("label").cast("long")
    rows = embeddings.where(F.col("label").isNotNull() & x.isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform(x, lambda v: F.floor(256 * v.cast("double"))).alias("q"))
    return stored(rows.select(F.monotonically_increasing_id().alias("place"), "*"), "vectors")


def _numpy(batch, dims: int):
    """place, vec, null, label and components (rows, dims) of an Arrow batch."""
    col = {n: batch.column(batch.schema.get_field_index(n)) for n in ("place", "vec_id", "label", "q")}
    null = np.asarray(col["vec_id"].is_null())
    vec = np.asarray(col["vec_id"].fill_null(0))
    q = col["q"]
    size = np.diff(np.asarray(q.offsets))
    out = np.zeros((len(q), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = np.asarray(q.flatten())
    return np.asarray(col["place"]), vec, null, np.asarray(col["label"]), out


def _scan(vectors: DataFrame, group, dims: int, primes: list[int], windows, size: int):
    """(anchor, slot, score, vec_id, place): the best rows that every task finds for a
    group of anchors, of the anchor's label (``windows`` None, slot 0) or of other labels
    with a score in each of its windows.  Also the broadcast, to be given up after use."""
    sc = vectors.sparkSession.sparkContext
    place, _, _, label, q = group
    sent = sc.broadcast((place, label, residues(q, primes), windows))

    def run(batches):
        places, labels, matrices, bounds = sent.value
        best = [Best(len(places), size) for _ in range(1 if bounds is None else len(bounds))]
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                at, vec, null, own, x = _numpy(b.slice(start, ROWS), dims)
                mine = residues(x, primes)
                for first in range(0, len(places), ANCHORS):
                    part = slice(first, first + ANCHORS)
                    scores = exact_scores(mine, [m[part] for m in matrices], primes)
                    same = own[:, None] == labels[part]
                    if bounds is None:
                        best[0].add(first, scores, same & (at[:, None] != places[part]), vec, null, at)
                    else:
                        for keep, (low, high) in zip(best, bounds):
                            inside = (scores >= low[part]) & (scores <= high[part]) & ~same
                            keep.add(first, scores, inside, vec, null, at)
        for slot, keep in enumerate(best):
            a, score, vec, null, at = keep.rows()
            yield pa.RecordBatch.from_arrays(
                [pa.array(places[a]), pa.array(np.full(len(a), slot, np.int32)), pa.array(score),
                 pa.array(vec, pa.int64(), mask=null), pa.array(at)],
                ["anchor", "slot", "score", "vec_id", "place"])

    return vectors.select("place", "vec_id", "label", "q").mapInArrow(
        tidy(run), "anchor long, slot int, score long, vec_id long, place long"), sent


def _leading(found: DataFrame, size: int) -> DataFrame:
    """The best ``size`` rows of every (anchor, slot), with their rank."""
    w = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "place")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)


def mine(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for
    each anchor (vec_id divisible by ``every``) and each of its best rows of the same
    label, the best rows of other labels that score between ``low`` and ``high`` per
    cent of the positive."""
    spark = embeddings.sparkSession
    vectors = prepared(embeddings)
    size = F.aggregate("q", F.lit(0.0), lambda s, v: s + F.abs(v.cast("double")))
    top = F.array_max(F.transform("q", lambda v: F.abs(v.cast("double"))))
    seen = vectors.agg(F.max(F.size("q")).alias("d"), F.max(size).alias("sum"), F.max(top).alias("top"),
                       F.sum((F.col("vec_id") % every == 0).cast("long")).alias("n")).first()
    dims, bound, count = seen.d or 0, int((seen["sum"] or 0) * (seen.top or 0)), seen.n or 0
    if 100 * bound >= 1 << 62:
        raise ArithmeticError("scores of these vectors can pass a long")
    primes = moduli(bound)
    groups = max(1, -(-count * max(1, dims) * 8 // group_bytes))
    group = F.pmod(F.xxhash64("place"), F.lit(groups))
    anchors = stored(vectors.where(F.col("vec_id") % every == 0).withColumn("g", group), "anchors")

    def in_groups(name, windows, size, schema="anchor long, slot int, score long, vec_id long, place long"):
        path = shared_path(spark, name)
        spark.createDataFrame([], schema).write.parquet(path)
        for g in range(groups):
            batch = anchors.where(F.col("g") == g).toArrow().combine_chunks()
            if batch.num_rows:
                one = _numpy(batch.to_batches()[0], dims)
                found, sent = _scan(vectors, one, dims, primes, windows and windows(g, one[0]), size)
                found.write.mode("append").parquet(path)
                sent.destroy()
        return spark.read.schema(schema).parquet(path)

    pairs = stored(_leading(in_groups("positives", None, positives), positives).select(
        "anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "positive-pairs")

    def windows(g, places):
        """Lowest and highest score of every slot, for the anchors of a group."""
        mine = (pairs.join(anchors.where(F.col("g") == g).select(F.col("place").alias("anchor")), "anchor", "left_semi")
                .toArrow())
        bounds = [(np.ones(len(places), np.int64), np.zeros(len(places), np.int64)) for _ in range(positives)]
        order = np.argsort(places)
        row = order[np.searchsorted(places, np.asarray(mine["anchor"]), sorter=order)]
        score, slot = np.asarray(mine["positive_score"]), np.asarray(mine["slot"])
        for s, (least, most) in enumerate(bounds):
            has = slot == s
            least[row[has]], most[row[has]] = -(-low * score[has] // 100), high * score[has] // 100
        return bounds

    found = _leading(in_groups("negatives", windows, negatives), negatives)
    named = anchors.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(pairs, ["anchor", "slot"]).join(named, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
