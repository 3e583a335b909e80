"""Clusters described and groupings compared. Inputs are ``(id, label)`` or ``(id, coords, label)``; rows with a null label are in no cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.points import square_distance


def centroids(points: DataFrame, by: str = "label") -> DataFrame:
    """``(by, centroid, n)``: mean per dimension, halves to even. Partial sums are made before the shuffle."""
    x = points.where(F.col(by).isNotNull()).select(by, F.posexplode("coords").alias("dim", "x"))
    m = x.groupBy(by, "dim").agg(F.bround(F.avg("x"), 0).cast("int").alias("x"), F.count("*").alias("n"))
    return m.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("n"))


def radii(points: DataFrame, by: str = "label") -> DataFrame:
    """``(by, n, max_radius, mean_radius)``: distances to the centroid."""
    c = centroids(points, by)
    d = points.join(c, by).withColumn("d", F.sqrt(square_distance(F.col("coords"), F.col("centroid")).cast("double")))
    return d.groupBy(by).agg(F.count("*").alias("n"), F.max("d").alias("max_radius"), F.avg("d").alias("mean_radius"))


def shrinkage(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, shrinkage)`` of joining two clusters of ``pairs(a, b)``: (2 max + mean) radius of both together over the sum of the parts'; null if both parts are single places."""
    weight = 2 * F.col("max_radius") + F.col("mean_radius")
    single = radii(points).select("label", weight.alias("w"))
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("label"))
    both = sides.join(points.select("label", "id", "coords"), "label").select(F.struct("a", "b").alias("pair"), "id", "coords")
    joined = radii(both, "pair").select("pair.a", "pair.b", weight.alias("w"))
    s = joined.join(single.select(F.col("label").alias("a"), F.col("w").alias("wa")), "a").join(single.select(F.col("label").alias("b"), F.col("w").alias("wb")), "b")
    return s.select("a", "b", (F.col("w") / F.nullif(F.col("wa") + F.col("wb"), F.lit(0.0))).alias("shrinkage"))


def partition_counts(labels: DataFrame, least: int) -> DataFrame:
    """One row ``(clusters, large, smallest_large, points, effective)``; effective is N ** 2 / sum(n ** 2)."""
    n = labels.where("label is not null").groupBy("label").count()
    big = F.col("count") >= least
    return n.agg(F.count("*").alias("clusters"), F.count_if(big).alias("large"), F.min(F.when(big, F.col("count"))).alias("smallest_large"), F.coalesce(F.sum("count"), F.lit(0)).alias("points"), (F.sum("count") * F.sum("count") / F.sum(F.col("count") * F.col("count"))).alias("effective"))


def contingency(gold: DataFrame, found: DataFrame) -> DataFrame:
    """``(gold, label, n)`` of the points both groupings have."""
    return gold.select("id", F.col("label").alias("gold")).join(found.select("id", "label"), "id").where("gold is not null and label is not null").groupBy("gold", "label").agg(F.count("*").alias("n"))


def b_cubed(gold: DataFrame, found: DataFrame, alpha: float = 0.5) -> DataFrame:
    """One row ``(precision, recall, f)`` from the contingency table: linear in points, no pairs."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in 0 .. 1")
    t = contingency(gold, found)
    t = t.withColumn("c", F.sum("n").over(Window.partitionBy("label"))).withColumn("g", F.sum("n").over(Window.partitionBy("gold")))
    r = t.agg((F.sum(F.col("n") * F.col("n") / F.col("c")) / F.sum("n")).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("g")) / F.sum("n")).alias("recall"))
    return r.withColumn("f", 1 / (alpha / F.col("precision") + (1 - alpha) / F.col("recall")))


def majority(gold: DataFrame, found: DataFrame) -> DataFrame:
    """``(label, gold, n, kinds)``: the commonest gold label of each cluster, ties by the smallest, and how many it holds."""
    t = contingency(gold, found)
    w = Window.partitionBy("label")
    return t.withColumn("kinds", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "gold"))).where("rn = 1").drop("rn")


def misplaced(gold: DataFrame, found: DataFrame) -> DataFrame:
    """``(id, label)`` of points whose gold label isn't the majority of their cluster."""
    m = majority(gold, found).select("label", F.col("gold").alias("main"))
    return gold.select("id", F.col("label").alias("gold")).join(found.select("id", "label"), "id").join(m, "label").where("gold <> main").select("id", "label")


def transitions(positions: DataFrame) -> DataFrame:
    """One row ``(partitions, segments, concord)`` of labels along ``pos``: distinct labels over runs of equal ones. Neighbours meet by an equi-join on the position."""
    before = positions.select((F.col("pos") + 1).alias("pos"), F.col("label").alias("last"))
    seg = positions.join(before, "pos", "left").agg(F.sum(F.when(F.col("last").isNull() | (F.col("last") != F.col("label")), 1).otherwise(0)).alias("segments"), F.countDistinct("label").alias("partitions"))
    return seg.select("partitions", "segments", (F.col("partitions") / F.col("segments")).alias("concord"))


def identical_clusters(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(label, other)`` of clusters with the same members in both groupings: overlap and both sizes agree; nothing is gathered."""
    t = contingency(a, b)
    na, nb = a.groupBy(F.col("label").alias("gold")).agg(F.count("*").alias("na")), b.groupBy("label").agg(F.count("*").alias("nb"))
    return t.join(na, "gold").join(nb, "label").where("n = na and n = nb").select(F.col("gold").alias("label"), F.col("label").alias("other"))


def grid_coarseness(points: DataFrame, dims: int, bits: int) -> DataFrame:
    """``(bit, coarseness)``: share of point pairs in one grid cell at each depth 0 .. bits - 1, from cell counts."""
    g = points.select(F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"), F.slice("coords", 1, dims).alias("c"))
    cells = g.groupBy("bit", F.expr(f"transform(c, x -> shiftright(x, {bits} - bit))").alias("cell")).count()
    n = F.sum("count")
    return cells.groupBy("bit").agg((F.sum(F.col("count") * (F.col("count") - 1)) / F.nullif(n * (n - 1), F.lit(0))).alias("coarseness"))


def bits_to_divide(coarseness: DataFrame, n: int, target: float, bits: int) -> DataFrame:
    """First depth with at most ``target`` points to a cell; ``bits`` if there is none."""
    return coarseness.where(F.col("coarseness") <= target / max(n, 1)).agg(F.coalesce(F.min("bit"), F.lit(bits)).alias("bit"))


def kendall_tau(rows: DataFrame) -> DataFrame:
    """One row ``(tau_a, tau_b)`` of columns x, y over few rows (a test utility: all pairs)."""
    a, b = rows.select("id", "x", "y"), rows.select(F.col("id").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"))
    p = a.join(b, F.col("id") < F.col("j")).select(F.signum(F.col("x") - F.col("u")).alias("s"), F.signum(F.col("y") - F.col("v")).alias("t"))
    r = p.agg(F.sum(F.col("s") * F.col("t")).alias("k"), F.count("*").alias("n"), F.sum(F.abs("s")).alias("nx"), F.sum(F.abs("t")).alias("ny"))
    return r.select((F.col("k") / F.col("n")).alias("tau_a"), (F.col("k") / F.sqrt(F.col("nx") * F.col("ny"))).alias("tau_b"))


def key_range(rows: DataFrame, key: str) -> DataFrame:
    """One row ``(low, high, n, dense)`` of an integer key; dense if the range holds at most twice as many numbers as there are distinct keys. No keys: nulls and 0."""
    r = rows.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("n"), F.count_distinct(F.col(key)).alias("kinds"))
    return r.select("low", "high", "n", F.coalesce(F.col("high") - F.col("low") + 1 <= 2 * F.col("kinds"), F.lit(False)).alias("dense"))


def repeats(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row ``(keys, repeated, differing)``: keys without nulls, those with several rows, and those whose rows differ in ``columns`` (nulls are a value)."""
    h = F.xxhash64(*[F.when(F.col(c).isNull(), F.lit(f"null {c}")).otherwise(F.col(c).cast("string")) for c in columns])
    g = rows.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n"), F.min(h).alias("low"), F.max(h).alias("high"))
    return g.agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("low") != F.col("high")).alias("differing"))
