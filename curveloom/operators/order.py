"""Orders, positions and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.curve import curve_key
from ..runtime import Stages


def global_positions(df: DataFrame, keys: list[str], name: str = "pos", parts: int | None = None) -> DataFrame:
    """0-based position of each row in the order of ``keys`` without a single-task window: range partitions are numbered by themselves and shifted by the
    rows before them. Keys should be unique; nulls come first."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = Stages(spark, "positions").write(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    before = cut.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return cut.withColumn("_local", local).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def with_key(points: DataFrame, dims: int, bits: int, coords: str = "coords") -> DataFrame:
    """Adds ``hkey``; only the first ``dims`` coordinates are used."""
    return points.withColumn("hkey", curve_key(F.slice(coords, 1, dims), dims, bits))


def curve_index(points: DataFrame, dims: int, bits: int) -> DataFrame:
    """Points with ``hkey`` and their position along the curve, ties by id."""
    return global_positions(with_key(points, dims, bits), ["hkey", "id"])


def sort_like(rows: DataFrame, order: DataFrame, key: str, place: str) -> DataFrame:
    """Rows with the place their key has in ``order``; keys it lacks are left out."""
    return rows.join(order.select(key, place), key)


def top_by_distance(points: DataFrame, distance: Column, k: int, farthest: bool = False) -> DataFrame:
    """The k nearest or farthest rows, ties by smaller id; a bounded heap per task, then one merge."""
    d = points.withColumn("d2", distance)
    return d.orderBy(F.desc("d2") if farthest else F.asc("d2"), "id").limit(k)


def tied_groups(keyed: DataFrame, dims: int, bits: int, to_bits: int) -> DataFrame:
    """Groups of points that share the leading ``to_bits`` of every dimension, in curve order."""
    return keyed.groupBy(F.shiftright("hkey", dims * (bits - to_bits)).alias("prefix")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def sample_exact(rows: DataFrame, k: int, seed: int, id: str = "id") -> DataFrame:
    """Exactly k rows (all, if fewer), by a keyed hash: the same ones whatever the partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(id)), id).limit(k)


def sample_by(rows: DataFrame, key: str, k: int, seed: int, id: str = "id") -> DataFrame:
    """Exactly k rows of each key (all, if fewer), by a keyed hash; each task keeps at most k of a key before the shuffle. Null keys are a key."""
    w = Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), F.col(id)), id)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def shuffled(rows: DataFrame, seed: int, id: str = "id") -> DataFrame:
    """Rows with their ``place`` (from 0) in a random order, the same whatever the partitioning."""
    return global_positions(rows.withColumn("_draw", F.xxhash64(F.lit(seed), F.col(id))), ["_draw", id], "place").drop("_draw")
