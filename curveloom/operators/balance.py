"""Balancing: each dimension shifted so that its median lies in the middle of the range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.curve import bits_needed, curve_key
from ..functions.points import permute
from .order import global_positions


def dimension_stats(points: DataFrame) -> DataFrame:
    """``(dim, low, high, median, bits, shift)``: bits are those of the largest value of any dimension; the shift keeps all values within range.

    The median is that of the histogram of values, found in two digits of 16 bits, so a task holds at most 65,536 counts of a dimension.
    """
    x = points.select(F.posexplode("coords").alias("dim", "x")).where("x is not null")
    cells = x.groupBy("dim", F.shiftright("x", 16).alias("digit"), "x").agg(F.count("*").alias("n"))
    coarse = cells.groupBy("dim", "digit").agg(F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    w = Window.partitionBy("dim")
    run = w.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    coarse = coarse.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(run)).withColumn("lo", F.min("low").over(w)).withColumn("hi", F.max("high").over(w))
    rank = F.ceil(F.col("total") / 2)
    at = coarse.where((rank > F.col("upto") - F.col("n")) & (rank <= F.col("upto"))).select("dim", "digit", (rank - F.col("upto") + F.col("n")).alias("rank"), F.col("lo").alias("low"), F.col("hi").alias("high"))
    fine = cells.join(F.broadcast(at), ["dim", "digit"])  # a row per dimension
    fine = fine.withColumn("upto", F.sum("n").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    s = fine.where((F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto"))).select("dim", "low", "high", F.col("x").cast("long").alias("median"))
    top = s.agg(bits_needed(F.max("high") + 1).alias("bits"))
    s = s.crossJoin(top)  # one row
    half = F.expr("shiftleft(1L, greatest(bits - 1, 0))")
    shift = F.least(F.greatest(half - F.col("median"), -F.col("low").cast("long")), F.expr("shiftleft(1L, bits)") - 1 - F.col("high"))
    return s.select("dim", "low", "high", "median", "bits", shift.alias("shift"))


def balance(points: DataFrame, to_bits: int | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Points with shifted coordinates, at ``to_bits`` if given. The shifts, one per dimension, are broadcast."""
    s = (stats if stats is not None else dimension_stats(points)).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "shift"))), lambda v: v["shift"]).alias("shifts"), F.max("bits").alias("bits"))
    drop = F.greatest(F.lit(0), F.col("bits") - F.lit(to_bits if to_bits is not None else 64))
    out = points.crossJoin(F.broadcast(s)).withColumn("_drop", drop)  # one row
    return out.withColumn("coords", F.expr("transform(zip_with(coords, shifts, (x, s) -> x + s), v -> cast(shiftright(v, _drop) as int))")).drop("shifts", "bits", "_drop")


def balanced_index(points: DataFrame, dims: int, bits: int, to_bits: int | None = None, mapping: list[int] | None = None) -> DataFrame:
    """Points in the order of the curve through their balanced coordinates: ``hkey`` and ``pos`` at ``to_bits`` bits a dimension (``bits`` if not given), dimensions
    permuted first if asked. The points themselves keep their coordinates; ties go by id."""
    b = balance(points.withColumn("_raw", F.col("coords")), to_bits if to_bits is not None and to_bits < bits else None)
    c = permute(F.col("coords"), mapping) if mapping else F.col("coords")
    keyed = b.withColumn("hkey", curve_key(c, dims, to_bits or bits)).withColumn("coords", F.col("_raw")).drop("_raw")
    return global_positions(keyed, ["hkey", "id"])


def tendency(points: DataFrame, outlier: int) -> DataFrame:
    """One row: how far points fall into groups by the highest bit of their balanced coordinates.

    A group is large from ``outlier`` points on. Without large groups, or with 95 % of the points or more outside them, points are unclustered; with one large
    group singly clustered; with the largest over 66.666 % of the points in large groups majority clustered; else weakly, moderately or highly clustered as
    over 66.666 %, over 33.333 % or fewer of all points lie outside large groups. No points are unclustered.
    """
    cells = balance(points, 1).groupBy("coords").agg(F.count("*").alias("n"))
    big = F.col("n") >= outlier
    r = cells.agg(F.count("*").alias("cells"), F.count_if(big).alias("clusters"), F.coalesce(F.sum(F.when(~big, F.col("n"))), F.lit(0)).alias("outliers"), F.coalesce(F.sum(F.when(big, F.col("n"))), F.lit(0)).alias("clustered"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"))
    stray, major = 100.0 * F.col("outliers") / F.nullif(F.col("points"), F.lit(0)), 100.0 * F.col("largest") / F.nullif(F.col("clustered"), F.lit(0))
    verdict = F.when((F.col("clusters") == 0) | (stray >= 95.0), "unclustered").when(F.col("clusters") == 1, "singly clustered").when(major > 66.666, "majority clustered").when(stray > 66.666, "weakly clustered").when(stray > 33.333, "moderately clustered").otherwise("highly clustered")
    return r.withColumn("verdict", verdict)
