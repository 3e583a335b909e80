"""Nearest neighbours along the curve and by full scan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.points import square_distance
from ..runtime import Stages

#: Query coordinates held by a task at once; more queries are scanned in several passes.
BLOCK_VALUES = 4_000_000


def curve_range(index: DataFrame, queries: DataFrame, length: int) -> DataFrame:
    """``(q, id, at)``: the window of ``length`` positions around each query, clamped at both ends. A hash join on exploded positions."""
    n = index.count()
    q = index.join(queries.select(F.col("id").alias("q")), F.col("id") == F.col("q")).select("q", "pos")
    lo = F.greatest(F.lit(0), F.least(F.col("pos") - length // 2, F.lit(n - length)))
    w = q.select("q", F.explode(F.sequence(lo, F.least(lo + length, F.lit(n)) - 1)).alias("at"))
    return w.join(index.select("id", F.col("pos").alias("at")), "at").select("q", "id", "at")


def curve_knn(index: DataFrame, queries: DataFrame, k: int, window: int) -> DataFrame:
    """``(q, id, d2, rank)``: the k nearest of the points at most ``window`` positions away (the query itself not among them)."""
    q = index.join(queries.select(F.col("id").alias("q")), F.col("id") == F.col("q")).select("q", "pos", F.col("coords").alias("qc"))
    w = q.select("q", "qc", F.explode(F.sequence(F.col("pos") - window, F.col("pos") + window)).alias("at"))
    near = w.join(index.select("id", "coords", F.col("pos").alias("at")), "at").where("id <> q").select("q", "id", square_distance(F.col("qc"), F.col("coords")).alias("d2"))
    return ranked(near, k)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d2", "id"))).where(F.col("rank") <= k)


def _in_blocks(points: DataFrame, queries: DataFrame, scan, schema: str, reduce) -> DataFrame:
    """``reduce`` of ``scan(batches, query ids, query coords)`` over all points, for one block of queries after the other.

    A block holds about BLOCK_VALUES numbers; with more than one each block's result is staged before the next is read, so the driver holds a single block.
    """
    spark = points.sparkSession
    asked = queries.where("id is not null and coords is not null").select("id", "coords")
    total = asked.agg(F.coalesce(F.sum(F.size("coords")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_VALUES))
    work, out = Stages(spark, "blocks"), None
    given = points.where("id is not null and coords is not null").select("id", "coords")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        sent = spark.sparkContext.broadcast((np.array([r.id for r in rows], np.int64), np.array([r.coords for r in rows], np.float64)))

        def run(batches, sent=sent):
            qi, qc = sent.value
            for pdf in batches:
                if len(pdf) and len(qi):
                    ids, x = pdf.id.to_numpy(np.int64), np.stack(pdf.coords.to_numpy()).astype(np.float64)
                    order = np.argsort(ids, kind="stable")
                    yield from scan(ids[order], x[order], qi, qc)

        found = reduce(given.mapInPandas(run, schema))
        if blocks > 1:
            found = work.write(found)
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def exact_knn(points: DataFrame, queries: DataFrame, k: int, with_self: bool = False) -> DataFrame:
    """``(q, id, d2, rank)`` by full scan of ``points(id, coords)`` for a stated query set, in blocks of queries.

    Each batch of points keeps its own k nearest of every query before anything is shuffled. Null ids and coords are left out; ties go by smaller id; no points or
    no queries give no rows. Coordinates are whole numbers below 2 ** 24.
    """

    def scan(ids, x, qi, qc):
        m = np.einsum("nd,nd->n", x, x)
        for lo in range(0, len(qi), 256):
            q = qc[lo : lo + 256]
            d = np.einsum("qd,qd->q", q, q)[:, None] + m[None, :] - 2 * q @ x.T
            if not with_self:
                d[qi[lo : lo + 256, None] == ids[None, :]] = np.inf
            if d.shape[1] > 4 * k:  # rows up to the k-th distance, in order of id: ties beyond k are cut below
                kth = np.partition(d, k - 1, axis=1)[:, k - 1]
                i, j = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
            else:
                i, j = np.nonzero(np.isfinite(d))
            v = d[i, j]
            o = np.lexsort((j, v, i))
            i, j, v = i[o], j[o], v[o]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield pd.DataFrame({"q": qi[lo : lo + 256][i[keep]], "id": ids[j[keep]], "d2": np.rint(v[keep]).astype(np.int64)})

    return _in_blocks(points, queries, scan, "q bigint, id bigint, d2 bigint", lambda found: ranked(found, k))


def accuracy(approximate: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """``(q, hits, accuracy)``: share of the exact k nearest that the other answer holds."""
    hit = approximate.select("q", "id").distinct().withColumn("hit", F.lit(1))
    return exact.join(hit, ["q", "id"], "left").groupBy("q").agg(F.count("hit").alias("hits")).withColumn("accuracy", F.col("hits") / F.lit(float(k)))


def count_within(points: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """``(q, n)``: points within a square distance of each query of a stated set, itself not counted; queries without any have 0."""

    def scan(ids, x, qi, qc):
        m, n = np.einsum("nd,nd->n", x, x), np.zeros(len(qi), np.int64)
        for lo in range(0, len(qi), 256):
            q = qc[lo : lo + 256]
            d = np.einsum("qd,qd->q", q, q)[:, None] + m[None, :] - 2 * q @ x.T
            n[lo : lo + 256] = ((d <= limit + 0.5) & (qi[lo : lo + 256, None] != ids[None, :])).sum(axis=1)
        yield pd.DataFrame({"q": qi, "n": n})

    return _in_blocks(points, queries, scan, "q bigint, n bigint", lambda found: found.groupBy("q").agg(F.sum("n").alias("n")))


def inferred_ratings(index: DataFrame, ratings: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(user, item, rating)``: the rating a user would give, from the k raters of the item nearest to the user along the curve.

    ``index(id, pos)`` orders the users, ``ratings(user, item, rating)``, ``wanted(user, item)``. Of the raters of the item (not the user) the k nearest positions are
    taken, ties by smaller id, and their ratings weighed k, k - 1, ... 1 (fewer raters: from their number down). Users without a position and items without other
    raters give no row. Raters of an item are numbered along the curve; a wanted user meets those with the k numbers before and behind by an equi-join.
    """
    at = index.select(F.col("id").alias("user"), "pos")
    known = ratings.where("rating is not null").join(at, "user").select("item", "pos", F.col("user").alias("other"), "rating", F.lit(False).alias("asks"))
    asks = wanted.distinct().join(at, "user").select("item", "pos", F.col("user").alias("other"), F.lit(None).cast(ratings.schema["rating"].dataType).alias("rating"), F.lit(True).alias("asks"))
    w = Window.partitionBy("item").orderBy("pos", "asks", "other").rowsBetween(Window.unboundedPreceding, 0)
    placed = known.unionByName(asks).withColumn("rn", F.count_if(~F.col("asks")).over(w))  # raters up to here; a rater's own number
    raters = placed.where("not asks").select("item", "rn", "pos", "other", "rating")
    x = placed.where("asks").select("item", F.col("other").alias("user"), F.col("pos").alias("p"), F.explode(F.sequence(F.col("rn") - k, F.col("rn") + k)).alias("rn")).join(raters, ["item", "rn"]).where("other <> user")
    x = x.select("user", "item", F.abs(F.col("pos") - F.col("p")).alias("gap"), "other", "rating")
    ranked_ = x.withColumn("rn", F.row_number().over(Window.partitionBy("user", "item").orderBy("gap", "other"))).where(F.col("rn") <= k)
    n = F.count("*").over(Window.partitionBy("user", "item"))
    return ranked_.withColumn("w", n - F.col("rn") + 1).groupBy("user", "item").agg((F.sum(F.col("w") * F.col("rating")) / F.sum("w")).alias("rating"))


def mean_rating_error(ratings: DataFrame, probe: DataFrame) -> DataFrame:
    """One row ``(rms, n)``: error of predicting each rated pair of ``probe(user, item)`` by the item's mean over the ratings not in the probe."""
    asked = probe.select("user", "item").distinct()
    means = ratings.join(asked, ["user", "item"], "left_anti").groupBy("item").agg(F.avg("rating").alias("mean"))
    r = ratings.join(asked, ["user", "item"]).join(means, "item")
    return r.agg(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("mean"), F.lit(2.0)))).alias("rms"), F.count("*").alias("n"))
