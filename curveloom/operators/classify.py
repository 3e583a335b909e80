"""Unassisted clustering along the curve: search for a good order, cut it into runs, join near clusters, split by density."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.curve import curve_key, curve_order
from ..functions.points import permute, square_distance
from ..runtime import Stages
from .groups import joined_names, renamed
from .order import global_positions, sample_exact
from .pairs import closest_clusters, closest_outliers, nearest_between
from .runs import characteristic_distance, cluster_count, islands, neighbor_distances, revisited, window_density
from .stats import shrinkage

#: Rows up to which an order is measured in one task; more are measured by distributed positions, with the same result.
TASK_ROWS = 200_000

def jump(d2: np.ndarray, skip: int) -> int:
    """Characteristic distance of the steps along an order (see runs.characteristic_distance), for one array."""
    d, n, g = np.sort(d2), len(d2) + 1, skip + 1
    i = np.arange(g, len(d))
    if not len(i):
        return int(d[0]) if len(d) else 0
    now, before = d[i].astype(float), d[i - g].astype(float)
    ratio = np.where((before > 1) & (i > 10), now / np.maximum(before, 1), -1.0)
    run = np.maximum.accumulate(np.concatenate([[0.0], ratio]))[:-1]
    stop = np.nonzero((ratio > run) & (i > n // 2) & (ratio > 5))[0]
    if len(stop):
        i, now, before, ratio = (v[: stop[0] + 1] for v in (i, now, before, ratio))
    inc = now - before
    ii = int(i[np.argmax(inc)]) if inc.max() > 0 else 0
    ir = int(i[np.argmax(ratio)]) if ratio.max() > 0 else 0
    at = ii if ii == ir or ir < n // 2 else ir
    return int(d[max(0, at - skip - 1)])


def scramble(perm: list[int], n: int, rng: np.random.Generator) -> list[int]:
    """Shuffle n of the places, all if n covers them."""
    at = rng.permutation(len(perm))[: min(n, len(perm))]
    out = np.array(perm)
    out[at] = out[rng.permutation(at)]
    return out.tolist()


def halving(perm: list[int], round_: int, rng: np.random.Generator) -> list[int]:
    """Scramble all dimensions, then half as many each round, at least five."""
    return scramble(perm, max(min(len(perm), 5), len(perm) >> round_), rng)


def shrinking(perm: list[int], round_: int, rng: np.random.Generator) -> list[int]:
    """Scramble all dimensions, then 0.7 times as many each round, at least five."""
    return scramble(perm, max(min(len(perm), 5), int(len(perm) * 0.7**round_)), rng)


def merge_distance_of(gaps: DataFrame, n: int, skip: int) -> int:
    """The characteristic distance of the steps along an order of n points; few steps are looked through in one task, with the same result."""
    if n > TASK_ROWS:
        return characteristic_distance(gaps, n, skip).first().s

    def look(batches):
        d = np.concatenate([b["d2"].to_numpy() for b in batches] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_pydict({"s": pa.array([jump(d, skip)], pa.int64())})

    return gaps.select("d2").repartition(1).mapInArrow(look, "s bigint").first().s


def along_order(points: DataFrame, perm: list[int], dims: int, bits: int, skip: int) -> tuple[DataFrame, DataFrame, int]:
    """The index of all points in the order of ``perm``, its neighbour distances and their characteristic distance."""
    work = Stages(points.sparkSession, "measure")
    index = work.write(global_positions(points.select("id", "coords").withColumn("hkey", curve_key(permute(F.col("coords"), perm), dims, bits)), ["hkey", "id"]))
    gaps = work.write(neighbor_distances(index))
    return index, gaps, merge_distance_of(gaps, index.count(), skip)


def measure_order(points: DataFrame, perm: list[int], dims: int, bits: int, outlier: int, skip: int) -> int:
    """The number of clusters above ``outlier`` points when the order of ``perm`` is cut at its characteristic distance."""
    index, gaps, s = along_order(points, perm, dims, bits, skip)
    return cluster_count(islands(index, gaps, s), outlier).first().clusters


def default_metric(steps: np.ndarray, outlier: int, skip: int) -> int:
    """Number of clusters above ``outlier`` points when an order with these square steps is cut at its characteristic distance."""
    sizes = np.bincount(np.concatenate([[0], np.cumsum(steps > jump(steps, skip))]))
    return int((sizes > outlier).sum())


def order_search(points: DataFrame, dims: int, bits: int, outlier: int = 5, skip: int = 10, trials: int = 4, rounds: int = 250, patience: int = 3, seed: int = 1, strategy: Callable = halving, metric: Callable | None = None) -> tuple[list[int], int]:
    """The permutation of dimensions whose curve order has the fewest clusters, and that number over all points.

    The first order is measured on all points; trials on a sample, large enough to hold 100 points of an average cluster and 2,000 at least. A trial with less than a quarter of
    the first count isn't trusted: the sample grows by half. All trials of a round are one job. Up to seven dimensions permutations are tried one after the
    other, beyond that ``strategy(permutation, round, generator)`` gives the next ones. ``metric(square steps, outlier, skip)`` may replace the count of clusters in the
    trials. The winner is measured again on all points. Fewer than two points give the identity and their number of clusters, 0 or 1 for an outlier size of 0.
    """
    spark = points.sparkSession
    rng, count = np.random.default_rng(seed), metric or default_metric
    points = Stages(spark, "searched").write(points.select("id", "coords"))
    best = list(range(dims))
    n = points.count()
    if n < 2:
        return best, int(n > outlier)

    def measuring(perms: list[list[int]], how: Callable):
        def measure(key: tuple, t: pa.Table) -> pa.Table:
            ids, x = t["id"].to_numpy(), t["coords"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)[:, perms[key[0].as_py()]].astype(np.int64)
            o = curve_order(x, ids, bits)
            steps = np.concatenate([np.square(np.diff(x[o[lo : lo + 10_001]], axis=0)).sum(axis=1) for lo in range(0, len(o), 10_000)])
            return pa.table({"trial": pa.array([key[0].as_py()], pa.int32()), "clusters": pa.array([how(steps, outlier, skip)], pa.int32())})

        return measure

    def kernel(perms: list[list[int]], rows: DataFrame, how: Callable = default_metric) -> dict[int, int]:
        tried = rows.select("id", "coords", F.explode(F.array(*map(F.lit, range(len(perms))))).alias("trial"))
        return {row.trial: row.clusters for row in tried.groupBy("trial").applyInArrow(measuring(perms, how), "trial int, clusters int").collect()}

    counted = lambda perm: kernel([perm], points)[0] if n <= TASK_ROWS else measure_order(points, perm, dims, bits, outlier, skip)
    first = counted(best)
    size = int(min(n, max(2000, min(1.0, 100 / (n / max(1, first))) * n)))
    fewest, idle, rejected = first, 0, set()
    every = itertools.permutations(reversed(range(dims))) if dims <= 7 else None

    work = Stages(spark, "search")
    sample = work.write(sample_exact(points.select("id", "coords"), size, seed)) if size < n else work.write(points.select("id", "coords"))
    for r in range(rounds):
        perms = [list(p) for p in itertools.islice(every, trials)] if every else [strategy(best, r, rng) for _ in range(trials)]
        if not perms or fewest <= 2:
            break
        if size <= TASK_ROWS or metric:
            got = kernel(perms, sample, count)
        else:
            got = {k: measure_order(sample, p, dims, bits, outlier, skip) for k, p in enumerate(perms)}
        trusted = {k: c for k, c in got.items() if c >= first / 4 or size == n}
        if len(trusted) < len(got) and size not in rejected:
            rejected.add(size)
            size = min(n, 3 * size // 2)
            sample = work.write(sample_exact(points.select("id", "coords"), size, seed)) if size < n else work.write(points.select("id", "coords"))
        k = min(trusted, key=lambda i: (trusted[i], i), default=None)
        if k is not None and trusted[k] < fewest:
            best, fewest, idle = perms[k], trusted[k], 0
        else:
            idle += 1
        if idle >= patience:
            break
    return best, counted(best)


def merge_outliers(points: DataFrame, neighbors: int, limit: int | None, least: int) -> DataFrame:
    """Points with each cluster of fewer than ``least`` points put to the nearest of its candidate larger ones that is at most ``limit`` away by its closest points.

    Taken in the order of distance, a pair counts only while exactly one side is still an outlier; as every pair has one larger cluster, an outlier joins the first it meets.
    """
    few = points.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") < least)
    if few.isEmpty():
        return points
    pairs = closest_outliers(points, neighbors, limit, least)
    few = few.select(F.col("label").alias("name"))
    sides = pairs.select("d2", F.col("a").alias("name"), F.col("b").alias("to")).unionByName(pairs.select("d2", F.col("b").alias("name"), F.col("a").alias("to")))
    first = sides.join(few, "name").groupBy("name").agg(F.min_by("to", F.struct("d2", "to")).alias("root"))
    return renamed(points, first)


def curve_classify(points: DataFrame, dims: int, bits: int, outlier: int = 5, skip: int = 10, neighbors: int = 5, outlier_factor: float = 5.0, merge_distance: int | None = None, seed: int = 1, exact: bool = True, start: DataFrame | None = None, trials: int = 4, rounds: int = 250, strategy: Callable = halving) -> tuple[DataFrame, int]:
    """``(id, label)`` and the merge distance S: runs of the best order (and runs the walk comes back to), joined where clusters of at least ``outlier`` points are within S
    of one of their ``neighbors`` nearest by centroid, then smaller ones put to the nearest larger cluster within ``outlier_factor`` * S.

    Labels are the smallest id of a cluster. ``start(id, label)`` keeps the points of an initial cluster together from the beginning. ``exact`` compares clusters by their closest
    points, else through their centroids. Every cluster is compared, whatever their number; nothing but counts reaches the driver. Fewer than ten points are an error.
    """
    work = Stages(points.sparkSession, "classify")
    pts = work.write(points.select("id", "coords"))
    n = pts.count()
    if n < 10:
        raise ValueError("at least ten points are needed")
    perm, _ = order_search(pts, dims, bits, outlier, skip, trials=trials, rounds=rounds, seed=seed, strategy=strategy)
    index, gaps, s = along_order(pts, perm, dims, bits, skip)
    s = merge_distance if merge_distance and merge_distance > 0 else s
    runs = work.write(islands(index, gaps, s))
    ties = revisited(index, runs, s)
    if start is not None:
        held = start.where("label is not null").join(runs.select("id", "island"), "id")
        first = held.groupBy("label").agg(F.min("island").alias("a"))
        ties = ties.unionByName(held.join(first, "label").select("a", F.col("island").alias("b")).distinct())
    lab = renamed(runs.select("id", F.col("island").alias("label")), joined_names(work.write(ties)))
    lab = work.write(lab.join(pts, "id").select("id", "coords", "label"))
    near = closest_clusters(lab, neighbors, s, outlier, exact).select("a", "b")
    lab = work.write(renamed(lab, joined_names(near)).select("id", "coords", "label"))
    lab = work.write(merge_outliers(lab, neighbors, int(s * outlier_factor), outlier).select("id", "label"))
    names = lab.groupBy("label").agg(F.min("id").alias("name"))
    return lab.join(names, "label").select("id", F.col("name").alias("label")), s


def density_split(points: DataFrame, dims: int, bits: int, limit: int, window: int = 50, radius: int | None = None, mergeable_shrinkage: float = 0.0, unmergeable_fraction: float = 1 / 6) -> DataFrame:
    """``(id, label, part)``: each cluster of ``points(id, coords, label)`` split where density falls.

    Along the cluster's own curve order neighbours within ``limit`` are tied, densest first (the greater density of the two; points within ``radius``, ``limit`` if not given), unless
    both sides already hold ``unmergeable_fraction`` of the cluster, two points at least. Then every part below that size joins the part above it that is nearest by its closest points, if there is one. With a
    ``mergeable_shrinkage`` above 0, parts whose joint radius over the sum of theirs is at most that become one, transitively. Parts are named by their smallest id.
    Orders, densities and distances are distributed; a stretch of steps within the limit is tied in one task, which holds five numbers a point, whatever its size.
    """
    work = Stages(points.sparkSession, "density")
    p = points.where("label is not null").select("id", "coords", F.col("label").alias("_of"))
    keyed = p.withColumn("hkey", curve_key(F.col("coords"), dims, bits))
    index = work.write(global_positions(keyed, ["_of", "hkey", "id"]).drop("hkey"))
    ends = work.write(index.groupBy("_of").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("*").alias("n")))
    ends = ends.withColumn("cap", F.greatest(F.lit(2), F.floor(F.col("n") * unmergeable_fraction + 1e-9)).cast("long"))
    density = work.write(window_density(index.join(ends, "_of"), window, limit if radius is None else radius, bounds=("low", "high")))
    before = index.select((F.col("pos") + 1).alias("pos"), F.col("_of").alias("of0"), F.col("coords").alias("c0"))
    steps = index.join(before, "pos").where((F.col("_of") != F.col("of0")) | (square_distance(F.col("coords"), F.col("c0")) > limit)).select("pos", F.lit(1).alias("d2"))
    runs = work.write(islands(index, steps, 0))
    rows = runs.join(density, "id").join(index.select("id", "_of"), "id").join(ends, "_of").select("island", "pos", "id", "density", "cap")

    def tie(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        ids, d, k, most = pdf.id.to_numpy(), pdf.density.to_numpy(), len(pdf), int(pdf.cap.iloc[0])
        left, size = np.arange(k), np.ones(k, np.int64)  # parts are ranges: the first place of a part, and its size there

        def first_of(i):
            while left[i] != i:
                left[i] = left[left[i]]
                i = left[i]
            return i

        for i in np.argsort(-np.maximum(d[:-1], d[1:]), kind="stable").tolist():
            a, b = first_of(i), i + 1
            if size[a] < most or size[b] < most:
                left[b] = a
                size[a] += size[b]
        head = np.nonzero(left == np.arange(k))[0]
        part = np.repeat(np.minimum.reduceat(ids, head), np.diff(np.append(head, k)))
        return pd.DataFrame({"id": ids, "part": part})

    tied = rows.groupBy("island").applyInPandas(tie, "id bigint, part bigint")
    parts = work.write(index.select("id", "coords", "_of").join(tied, "id").join(ends.select("_of", "cap"), "_of"))
    sizes = parts.groupBy("_of", "part", "cap").agg(F.count("*").alias("n")).withColumn("small", F.col("n") < F.col("cap"))
    x = parts.join(sizes.select("part", "small"), "part").select(F.xxhash64("_of").alias("pair"), F.col("part").alias("label"), "id", "coords", "small")
    x = work.write(x)
    to = nearest_between(x.where("small").drop("small"), x.where("not small").drop("small")).select(F.col("label").alias("name"), F.col("other").alias("root"))
    now = work.write(renamed(parts.select("id", "coords", "_of", F.col("part").alias("label")), to).select("id", "coords", "_of", "label"))
    if mergeable_shrinkage > 0:
        of = now.select("_of", F.col("label").alias("a")).distinct()
        two = of.join(of.withColumnRenamed("a", "b"), "_of").where("a < b").select("a", "b")  # parts of one cluster: those left are at least a sixth of it, so few
        close = shrinkage(now.select("id", "coords", "label"), two).where(F.col("shrinkage") <= mergeable_shrinkage).select("a", "b")
        now = work.write(renamed(now, joined_names(close)))
    names = now.groupBy("label").agg(F.min("id").alias("part"))
    return now.join(names, "label").select("id", F.col("_of").alias("label"), "part")
