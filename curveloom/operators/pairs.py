"""Closest pairs of clusters. Points are ``(id, coords, label)`` with whole-number labels; rows with a null label are in no cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.points import square_distance
from ..runtime import Stages
from .knn import exact_knn
from .order import global_positions
from .runs import heads_before
from .stats import centroids, radii

#: Rows of either side that meet in one task.
BLOCK = 8192


def _matrix(t: pa.Table) -> np.ndarray:
    col = t["coords"].combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64)


def _meet(key: tuple, t: pa.Table) -> pa.Table:
    """For each label of the asking side its nearest point among the others in the block: (key, label, id1, other, id2, d2), ties by smaller ids."""
    t = t.sort_by("id")
    side = t["asks"].to_numpy(zero_copy_only=False)
    q, p = t.filter(pa.array(side)), t.filter(pa.array(~side))
    none = {"pair": pa.array([], pa.int64()), "label": pa.array([], pa.int64()), "id1": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "id2": pa.array([], pa.int64()), "d2": pa.array([], pa.int64())}
    if not q.num_rows or not p.num_rows:
        return pa.table(none)
    x, y = _matrix(q), _matrix(p)
    m, at, best = np.einsum("nd,nd->n", y, y), np.zeros(len(x), np.int64), np.zeros(len(x))
    for lo in range(0, len(x), 512):
        d = np.einsum("nd,nd->n", x[lo : lo + 512], x[lo : lo + 512])[:, None] + m[None, :] - 2 * x[lo : lo + 512] @ y.T
        at[lo : lo + 512] = np.argmin(d, axis=1)
        best[lo : lo + 512] = d.min(axis=1)
    label = q["label"].to_numpy()
    o = np.lexsort((q["id"].to_numpy(), best, label))
    first = o[np.unique(label[o], return_index=True)[1]]
    pick = pa.array(at[first])
    return pa.table({"pair": pa.array([key[0].as_py()] * len(first), pa.int64()), "label": pa.array(label[first], pa.int64()), "id1": q["id"].take(pa.array(first)), "other": p["label"].take(pick), "id2": p["id"].take(pick), "d2": pa.array(np.rint(best[first]).astype(np.int64))})


def nearest_between(asking: DataFrame, others: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(pair, label, id1, other, id2, d2)``: for each label of ``asking(pair, label, id, coords)`` its closest points to ``others`` of the same pair.

    Exact. Sides of a pair are dealt into blocks that meet two by two, so a pair of any size is spread over tasks that hold two blocks; blocks follow the counts, which
    are joined, not collected. Coordinates are whole numbers below 2 ** 24.
    """
    n = asking.groupBy("pair").agg(F.ceil(F.count("*") / block).cast("int").alias("m")).join(others.groupBy("pair").agg(F.ceil(F.count("*") / block).cast("int").alias("k")), "pair")
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rest = [F.col("label").cast("long").alias("label"), "id", F.col("coords").cast("array<int>").alias("coords")]
    homes = asking.join(n, "pair").select("pair", part("m").alias("i"), every("k").alias("j"), F.lit(True).alias("asks"), *rest)
    calls = others.join(n, "pair").select("pair", every("m").alias("i"), part("k").alias("j"), F.lit(False).alias("asks"), *rest)
    met = homes.unionByName(calls).groupBy("pair", "i", "j").applyInArrow(_meet, "pair bigint, label bigint, id1 bigint, other bigint, id2 bigint, d2 bigint")
    w = Window.partitionBy("pair", "label").orderBy("d2", "id1", "id2")
    return met.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def centroid_distances(points: DataFrame, cents: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, id1, id2, d2)`` for many pairs at once: the point of b nearest to the centroid of a, then the point of a nearest to that one. Approximate and one-sided,
    an upper bound of the closest distance."""
    one = points.select(F.col("label").alias("b"), F.col("id").alias("id2"), F.col("coords").alias("c2"))
    p = pairs.select("a", "b").join(cents.select(F.col("label").alias("a"), "centroid"), "a")
    to_b = one.join(p, "b").groupBy("a", "b").agg(F.min_by(F.struct("c2", "id2"), F.struct(square_distance(F.col("c2"), F.col("centroid")), "id2")).alias("x")).select("a", "b", "x.c2", "x.id2")
    d = points.select(F.col("label").alias("a"), F.col("id").alias("id1"), "coords").join(to_b, "a")
    return d.groupBy("a", "b", "id2").agg(F.min(F.struct(square_distance(F.col("coords"), F.col("c2")).alias("d2"), "id1")).alias("x")).select("a", "b", "x.id1", "id2", "x.d2")


def exact_distances(points: DataFrame, pairs: DataFrame, limit: float | None = None) -> DataFrame:
    """``(a, b, id1, id2, d2)``: the closest two points of each pair of clusters, those at most ``limit`` apart if given.

    The distance through the centroids bounds the closest one; only points that can reach the other cluster's ball within that bound (and the limit) are compared.
    Pairs of which nothing is left, or with a label without points, give no row.
    """
    spark = points.sparkSession
    work = Stages(spark, "distances")
    c = centroids(points)
    r = work.write(points.join(c, "label").groupBy("label").agg(F.sqrt(F.max(square_distance(F.col("coords"), F.col("centroid"))).cast("double")).alias("max_radius"), F.first("centroid").alias("centroid")))
    p = work.write(pairs.select("a", "b").distinct())
    near = centroid_distances(points, r, p).select("a", "b", "d2")
    cut = F.col("d2") if limit is None else F.least("d2", F.lit(int(limit)))
    far = F.sqrt(cut.cast("double")) * (1 + 1e-9)
    named = work.write(near.select(F.xxhash64("a", "b").alias("pair"), "a", "b", far.alias("far")))
    side = lambda me, it: (
        points.select(F.col("label").alias(me), "id", "coords")
        .join(named.join(r.select(F.col("label").alias(it), F.col("centroid").alias("c"), F.col("max_radius").alias("r")), it), me)
        .where(F.sqrt(square_distance(F.col("coords"), F.col("c")).cast("double")) <= F.col("r") + F.col("far") + 1)  # centroids are rounded
        .select("pair", F.col(me).alias("label"), "id", "coords")
    )
    found = nearest_between(side("a", "b"), side("b", "a")).join(named.select("pair", "a", "b"), "pair").select("a", "b", "id1", "id2", "d2")
    return found if limit is None else found.where(F.col("d2") <= limit)


def closest_pair(points: DataFrame, a, b) -> DataFrame:
    """One row ``(id1, id2, d2)``: the nearest two points of clusters a and b, exactly. Ties by smaller ids; no row if either is empty."""
    two = points.where(F.col("label").isin(a, b))
    pair = points.sparkSession.createDataFrame([(a, b)], "a bigint, b bigint")
    return exact_distances(two, pair).select("id1", "id2", "d2")


def closest_pair_by_centroid(points: DataFrame, a, b) -> DataFrame:
    """One row ``(id1, id2, d2)``: the point of b nearest to the centroid of a, then the point of a nearest to that one. Approximate and one-sided."""
    two = points.where(F.col("label").isin(a, b))
    return centroid_distances(two, centroids(two), points.sparkSession.createDataFrame([(a, b)], "a bigint, b bigint")).select("id1", "id2", "d2")


def closest_other_cluster(points: DataFrame, a) -> DataFrame:
    """One row ``(label, id1, id2, d2)``: the cluster nearest to a, and its witness; no row if there is no other.

    The nearest centroid gives a bound; only points within that bound of a's ball are compared.
    """
    p = points.where("label is not null")
    own, rest = p.where(F.col("label") == a), p.where(F.col("label") != a)
    c = centroids(own).select(F.col("centroid").alias("c"))
    to = centroids(rest).crossJoin(F.broadcast(c)).select(F.lit(a).cast("long").alias("a"), F.col("label").alias("b"), square_distance(F.col("centroid"), F.col("c")).alias("d")).orderBy("d", "b").limit(1)  # one centroid
    bound = centroid_distances(p, centroids(own), to).select(F.sqrt(F.col("d2").cast("double")).alias("far"))
    reach = radii(own).select("max_radius").crossJoin(bound).crossJoin(c)  # one row
    near = rest.crossJoin(F.broadcast(reach)).where(F.sqrt(square_distance(F.col("coords"), F.col("c")).cast("double")) <= F.col("max_radius") + F.col("far") + 1)
    one = F.lit(0).cast("long").alias("pair")
    found = nearest_between(own.select(one, "label", "id", "coords"), near.select(one, "label", "id", "coords"))
    return found.select(F.col("other").cast(points.schema["label"].dataType).alias("label"), "id1", "id2", "d2")


def cluster_candidates(points: DataFrame, least: int, neighbors: int, outliers: bool = False) -> DataFrame:
    """``(a, b, d2)`` by centroid, a < b: the pairs that are tried when all pairs of clusters of at least ``least`` points, or (``outliers``) of one of them with a smaller
    one, are taken in the order of their centroids' distance while either side has had fewer than ``neighbors`` tries.

    These are the pairs of which one is among the ``neighbors`` nearest of the other: its nearest are always tried, a later one only for the other's sake. Centroids are
    compared in blocks, none is left out; ties go by label.
    """
    c = Stages(points.sparkSession, "centroids").write(centroids(points).select(F.col("label").cast("long").alias("id"), F.col("centroid").alias("coords"), "n"))
    large, few = c.where(F.col("n") >= least), c.where(F.col("n") < least)
    near = exact_knn(large, few, neighbors).unionByName(exact_knn(few, large, neighbors)) if outliers else exact_knn(large, large, neighbors)
    return near.select(F.least("q", "id").alias("a"), F.greatest("q", "id").alias("b"), "d2").distinct()


def closest_clusters(points: DataFrame, neighbors: int, limit: int, least: int, exact: bool = True) -> DataFrame:
    """``(a, b, id1, id2, d2)`` of the candidate pairs of clusters of at least ``least`` points that are at most ``limit`` apart, exactly or through the centroids."""
    pairs = cluster_candidates(points, least, neighbors)
    if exact:
        return exact_distances(points, pairs, limit)
    return centroid_distances(points, centroids(points), pairs).where(F.col("d2") <= limit)


def closest_outliers(points: DataFrame, neighbors: int, limit: int | None, least: int) -> DataFrame:
    """``(a, b, id1, id2, d2)`` of the candidate pairs of a cluster below ``least`` points with one that isn't, at most ``limit`` apart by their closest points."""
    return exact_distances(points, cluster_candidates(points, least, neighbors, outliers=True), limit)


def swapped(pairs: DataFrame) -> DataFrame:
    """The same pairs from the other side."""
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("id2").alias("id1"), F.col("id1").alias("id2"), "d2")


def relabelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the labels that their two points have in ``labels(id, label)``; pairs whose points are in one cluster by now are left out."""
    x = pairs.drop("a", "b").join(labels.select(F.col("id").alias("id1"), F.col("label").alias("a")), "id1").join(labels.select(F.col("id").alias("id2"), F.col("label").alias("b")), "id2")
    return x.where("a <> b").select("a", "b", "id1", "id2", "d2")


def curve_closest_pair(index: DataFrame, a, b) -> DataFrame:
    """One row ``(id1, id2, d2)``: nearest of the colour changes between a and b along the curve; nothing between two points of these clusters but others counts."""
    x = global_positions(index.where(F.col("label").isin(a, b)).select("id", "label", "coords", "pos"), ["pos"], "at")
    nxt = x.select((F.col("at") - 1).alias("at"), F.col("id").alias("id2"), F.col("label").alias("l2"), F.col("coords").alias("c2"))
    j = x.join(nxt, "at").where("label <> l2").withColumn("d2", square_distance(F.col("coords"), F.col("c2")))
    return j.select(F.least("id", "id2").alias("id1"), F.greatest("id", "id2").alias("id2"), "d2").orderBy("d2", "id1", "id2").limit(1)


def curve_nearest(index: DataFrame, a, limit: int | None = None) -> DataFrame:
    """``(label, id1, id2, d2)``: for every other cluster the nearest of its meetings with cluster a that a scan along the curve sees, at most ``limit`` apart if given.

    Between two points of a that follow each other (others between them), a cluster's first point meets the one before and its last point the one behind.
    Approximate: an upper bound of the closest distance. The smallest ``d2`` is the cluster nearest to a. No point of a, or of others, gives no row; ties by smaller ids.
    """
    work = Stages(index.sparkSession, "scan")
    x = index.where("label is not null").select("pos", "id", "label", "coords")
    own = work.write(global_positions(x.where(F.col("label") == a).select("pos", "id", "coords"), ["pos"], "at"))
    y = heads_before(index.select("pos", "id", "label", "coords"), own).where(F.col("label") != a)
    seen = F.struct("pos", "id", "coords")
    gaps = y.groupBy("head", "label").agg(F.min_by(seen, "pos").alias("first"), F.max_by(seen, "pos").alias("last"))
    number = own.select(F.col("pos").alias("head"), "at")
    g = work.write(gaps.join(number, "head", "left").withColumn("at", F.coalesce("at", F.lit(-1).cast("long"))))
    mine = own.select("at", F.col("id").alias("id1"), F.col("coords").alias("c1"))
    met = g.select("label", "at", F.col("first").alias("p")).join(mine, "at").unionByName(g.select("label", (F.col("at") + 1).alias("at"), F.col("last").alias("p")).join(mine, "at"))
    d = met.select("label", "id1", F.col("p.id").alias("id2"), square_distance(F.col("c1"), F.col("p.coords")).alias("d2"))
    best = d.groupBy("label").agg(F.min(F.struct("d2", "id1", "id2")).alias("x")).select("label", "x.id1", "x.id2", "x.d2")
    return best if limit is None else best.where(F.col("d2") <= limit)
