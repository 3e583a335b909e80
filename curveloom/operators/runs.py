"""Operators along an order: neighbour distances, characteristic distance, cluster counts, densities, runs."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.points import square_distance
from .order import global_positions


def neighbor_distances(index: DataFrame) -> DataFrame:
    """``(pos, id, d2)``: square distance to the point before along the curve; the first point has none. An equi-join on positions, no global window."""
    before = index.select((F.col("pos") + 1).alias("pos"), F.col("coords").alias("c0"))
    return index.join(before, "pos").select("pos", "id", square_distance(F.col("coords"), F.col("c0")).alias("d2"))


def characteristic_distance(gaps: DataFrame, points: int, skip: int) -> DataFrame:
    """One row ``(idx, s, median)`` of the sorted gaps: the step where distances jump from within clusters to between them.

    With stride g = skip + 1 the largest increase and the largest ratio (of later rows over values above 1) are found, ratios only up to the first
    in the upper half that is a new maximum above 5; the increase wins if both agree or the ratio lies in the lower half. Needs a gap.
    """
    g = 1 + skip
    d = global_positions(gaps.select("d2", F.col("pos").alias("_p")), ["d2", "_p"], "i").select("i", "d2")
    prev = d.select((F.col("i") + g).alias("i"), F.col("d2").alias("p"))
    r = d.join(prev, "i", "left").withColumn("inc", F.col("d2") - F.col("p")).withColumn("ratio", F.when((F.col("p") > 1) & (F.col("i") > 10), F.col("d2") / F.col("p")))
    half = points // 2
    # running maxima over ranges: a row can only break if its ratio is above 5, and few rows jump so far
    steep = r.where("ratio > 5")
    brk = steep.where(F.col("i") > half).select(F.col("i").alias("b"), F.col("ratio").alias("rb"))
    earlier = r.where(F.col("ratio").isNotNull()).select("i", "ratio")
    # the first row in the upper half above 5 that exceeds everything before it
    top_low = earlier.where(F.col("i") <= half).agg(F.coalesce(F.max("ratio"), F.lit(0.0)).alias("m"))
    first = brk.crossJoin(top_low).where("rb > m").agg(F.min("b").alias("b"))  # above the lower half, rows before the first such one are at most m or 5
    kept = r.crossJoin(first).where("b is null or i <= b")
    pick = kept.agg(F.max_by(F.struct("i", "inc"), F.struct("inc", -F.col("i"))).alias("x"), F.max_by("i", F.when(F.col("ratio").isNotNull(), F.struct("ratio", -F.col("i")))).alias("ir"))
    pick = pick.select(F.when(F.col("x.inc") > 0, F.col("x.i")).otherwise(F.lit(0)).alias("ii"), F.coalesce("ir", F.lit(0)).alias("ir"))
    at = pick.select(F.greatest(F.lit(0), F.when((F.col("ii") == F.col("ir")) | (F.col("ir") < half), F.col("ii")).otherwise(F.col("ir")) - skip - 1).cast("long").alias("idx"))
    s = at.join(d.select(F.col("i").alias("idx"), F.col("d2").alias("s")), "idx")
    m = s.withColumn("half", F.floor(F.col("idx") / 2)).join(d.select(F.col("i").alias("half"), F.col("d2").alias("median")), "half")
    return m.select("idx", "s", "median")


def heads_before(index: DataFrame, marks: DataFrame, name: str = "head") -> DataFrame:
    """``index`` with the last position of ``marks(pos)`` at or before each row, null before the first. Positions are cut into ranges; each range carries over the last
    mark of the ranges before it, so no window runs over all rows."""
    x = index.join(marks.select("pos").distinct().withColumn("_head", F.col("pos")), "pos", "left")
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.withColumn("_part", F.floor(F.col("pos") / max(1, -(-index.count() // n))))
    carry = x.groupBy("_part").agg(F.max("_head").alias("last"))
    carry = carry.withColumn("_carry", F.max("last").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", "_carry")  # a row per range
    w = Window.partitionBy("_part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("_seen", F.max("_head").over(w)).join(F.broadcast(carry), "_part").withColumn(name, F.coalesce("_seen", "_carry")).drop("_head", "_part", "_carry", "_seen")


def running_count(index: DataFrame, flag, name: str) -> DataFrame:
    """``index`` with the number of rows up to each position for which ``flag`` holds; ranges of positions are counted by themselves and shifted by those before."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = index.withColumn("_part", F.floor(F.col("pos") / max(1, -(-index.count() // n)))).withColumn("_one", F.coalesce(flag, F.lit(False)).cast("long"))
    sums = x.groupBy("_part").agg(F.sum("_one").alias("n"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")  # a row per range
    w = Window.partitionBy("_part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("_in", F.sum("_one").over(w)).join(F.broadcast(sums), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_one", "_in", "_before")


def islands(index: DataFrame, gaps: DataFrame, limit: int) -> DataFrame:
    """``(id, pos, island)``: runs along the curve that no step above ``limit`` breaks, named by their first position."""
    return heads_before(index.select("id", "pos"), gaps.where(F.col("d2") > limit)).select("id", "pos", F.coalesce("head", F.lit(0).cast("long")).alias("island"))


def revisited(index: DataFrame, runs: DataFrame, limit: int) -> DataFrame:
    """``(a, b)``: pairs of islands that a walk along the curve ties when it comes back to the cluster it has left.

    ``index(id, pos, coords)``, ``runs(id, pos, island)``. Where a step breaks the walk, the point is compared with the last point that joined a cluster; if near it joins that one and is
    itself the last. Only points between the end of one island of several points and the head of the next such island can do so: each of these stretches is walked by
    itself, in one pass over batches that keeps a single point.
    """
    sizes = runs.groupBy("island").agg(F.count("*").alias("n"), F.max("pos").alias("tail"))
    r = runs.join(sizes, "island")
    # the walk of a stretch starts at the tail of an island of several points; heads of islands follow
    turns = r.where("pos = island or (n > 1 and pos = tail)").select("pos", "island", "n", "tail")
    starts = turns.where("n > 1 and pos = tail").select("pos")
    both = heads_before(index.select("pos", "coords"), starts, "stretch").where("stretch is not null").join(turns, "pos")
    # a head that ends a stretch belongs to the stretch before it, its own tail starts the next
    rows = both.select("stretch", "pos", "island", "coords")

    def walk(key, batches):
        last = None
        for t in batches:
            for pos, island, c in zip(t["pos"].to_pylist(), t["island"].to_pylist(), t["coords"].to_pylist(), strict=True):
                x = np.array(c, np.int64)
                if last is None:
                    last = (island, x, pos)
                elif pos != last[2] and np.square(x - last[1]).sum() <= limit and island != last[0]:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([last[0]], pa.int64()), "b": pa.array([island], pa.int64())})
                    last = (last[0], x, pos)

    ordered = rows.repartition("stretch").sortWithinPartitions("stretch", "pos")
    return ordered.groupBy("stretch").applyInArrow(_typed(walk), "a bigint, b bigint")


def _typed(walk):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from walk(key, batches)

    return run


def cluster_count(isles: DataFrame, outlier: int) -> DataFrame:
    """One row ``(with_outliers, clusters, outlier_points)``: islands of at most ``outlier`` points are outliers."""
    n = isles.groupBy("island").count()
    return n.agg(F.count("*").alias("with_outliers"), F.count_if(F.col("count") > outlier).alias("clusters"), F.coalesce(F.sum(F.when(F.col("count") <= outlier, F.col("count"))), F.lit(0)).alias("outlier_points"))


def window_density(index: DataFrame, window: int, limit: int, bounds: tuple[str, str] | None = None, estimator=None) -> DataFrame:
    """``(id, density)``: points within square distance ``limit`` among the 2 * window nearest positions, the window shifted at both ends.

    ``bounds`` names columns with the first and last position of the row's own range, so that windows don't leave it. ``estimator`` is an aggregate expression
    over the columns ``d2`` (square distance to a point of the window, the point itself not among them) that replaces the count.
    """
    first, last = (F.col(bounds[0]), F.col(bounds[1])) if bounds else (F.lit(0), F.lit(index.count() - 1))
    lo = F.greatest(first, F.least(F.col("pos") - window, last - 2 * window))
    w = index.select("id", "coords", F.explode(F.sequence(lo, F.least(lo + 2 * window, last))).alias("at"))
    o = index.select(F.col("pos").alias("at"), F.col("id").alias("o"), F.col("coords").alias("oc"))
    met = w.join(o, "at").withColumn("d2", F.when(F.col("id") != F.col("o"), square_distance(F.col("coords"), F.col("oc"))))
    return met.groupBy("id").agg((estimator if estimator is not None else F.count_if(F.coalesce(F.col("d2") <= limit, F.lit(False)))).alias("density"))


def density_rank(density: DataFrame) -> DataFrame:
    """``(id, density, rank)``: 0 for the densest, equal ones alike; ranks come from the distinct densities only."""
    levels = density.select("density").distinct().withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("density"))) - 1)
    return density.join(levels, "density").select("id", "density", "rank")


def run_segments(rows: DataFrame, key: str, order: list[str], sign) -> DataFrame:
    """``(key, segments, rows)``: runs of equal sign along an order within each key."""
    w = Window.partitionBy(key).orderBy(*order)
    x = rows.withColumn("s", sign).withColumn("last", F.lag("s").over(w))
    return x.groupBy(key).agg(F.sum(F.when(F.col("last").isNull() | (F.col("last") != F.col("s")), 1).otherwise(0)).alias("segments"), F.count("*").alias("rows"))


def window_volume(spark, dims: int, bits: int, window: int) -> float:
    """Mean volume of the bounding boxes of ``window`` successive positions over the whole curve, by ``window``. A small utility: the curve has 2 ** (dims * bits) positions."""
    from ..functions.curve import curve_point

    p = spark.range(1 << dims * bits).select("id", curve_point(F.col("id"), dims, bits).alias("c"))
    w = p.select("id", "c", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("back")).select((F.col("id") - F.col("back")).alias("start"), "c").where(f"start >= 0 and start <= {(1 << dims * bits) - window}")
    box = w.groupBy("start").agg(*[(F.max(F.col("c")[i]) - F.min(F.col("c")[i]) + 1).cast("double").alias(f"e{i}") for i in range(dims)])
    volume = box.select((F.expr(" * ".join(f"e{i}" for i in range(dims))) / window).alias("v"))
    return volume.agg(F.avg("v")).first()[0]
