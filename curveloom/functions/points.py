"""Scalar expressions on points: all built-in, none leaves the JVM."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quantize(values: Column, shift: float = 1.0, scale: float = 512.0, top: int = 1023) -> Column:
    """Floating values to 0 .. top: translate, scale, round down, clamp."""
    return F.transform(values, lambda x: F.least(F.lit(top), F.greatest(F.lit(0), F.floor((x.cast("double") + shift) * scale))).cast("int"))


def square_magnitude(coords: Column) -> Column:
    return F.aggregate(coords, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)


def square_distance(a: Column, b: Column) -> Column:
    """Exact while dims * max ** 2 < 2 ** 63."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("long") * (x - y)), F.lit(0).cast("long"), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, v: s + v)


def within(a: Column, b: Column, mag_a: Column, mag_b: Column, limit: Column) -> Column:
    """Whether the square distance is at most ``limit``; magnitudes settle far pairs before the coordinates are read."""
    low = F.pow(F.sqrt(mag_a) - F.sqrt(mag_b), F.lit(2.0)) <= limit + 1e-6 * (limit + mag_a)
    return low & (mag_a + mag_b - 2 * dot(a, b) <= limit)


def permute(coords: Column, mapping: list[int]) -> Column:
    if sorted(mapping) != list(range(len(mapping))):
        raise ValueError("not a permutation")
    return F.transform(F.array(*[F.lit(i) for i in mapping]), lambda i: F.get(coords, i))


def identity_mapping(dims: int) -> list[int]:
    return list(range(dims))


def random_mapping(dims: int, seed: int) -> list[int]:
    out = list(range(dims))
    random.Random(seed).shuffle(out)
    return out


def inverse_mapping(mapping: list[int]) -> list[int]:
    """The mapping that undoes another: permuting by both gives the point back."""
    out = [0] * len(mapping)
    for i, m in enumerate(mapping):
        out[m] = i
    return out


def all_permutations(spark: SparkSession, n: int) -> DataFrame:
    """``(perm array<int>)``: every permutation of 0 .. n - 1, decoded from its number in the factorial base; n of at most 12."""
    if n > 12:
        raise ValueError("too many permutations")
    x = spark.range(math.factorial(n)).select("id", F.array(*map(F.lit, range(n))).alias("rest"), F.expr("cast(array() as array<int>)").alias("perm"))
    for k in range(n, 0, -1):
        at = F.expr(f"cast(id div {math.factorial(k - 1)} % {k} as int)")
        x = x.withColumn("_at", at).select("id", F.concat("perm", F.array(F.get("rest", F.col("_at")))).alias("perm"), F.filter("rest", lambda v, i: i != F.col("_at")).alias("rest"))
    return x.select("perm")


def sparse_get(values: Column, d: int, missing: Column) -> Column:
    """A coordinate of a sparse point ``map<int, int>``."""
    return F.coalesce(F.try_element_at(values, F.lit(d)), missing)


def sparse_square_distance(a: Column, b: Column, missing: Column) -> Column:
    """Of two sparse points with the same value for missing coordinates: only dimensions that either has are touched."""
    diff = lambda d: (F.coalesce(F.try_element_at(a, d), missing) - F.coalesce(F.try_element_at(b, d), missing)).cast("long")
    return F.aggregate(F.array_union(F.map_keys(a), F.map_keys(b)), F.lit(0).cast("long"), lambda s, d: s + diff(d) * diff(d))


def densify(values: Column, dims: int, missing: Column) -> Column:
    """Dense coordinates of a sparse point ``map<int, int>``."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.try_element_at(values, d), missing))


def densify_drawn(values: Column, dims: int, id: Column, choices: Column) -> Column:
    """As :func:`densify`; each missing coordinate is a reproducible draw from ``choices`` keyed by point and dimension."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.try_element_at(values, d), F.get(choices, F.pmod(F.xxhash64(id, d), F.size(choices).cast("long")).cast("int"))))


def jaccard_distance(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; 0 for two empty ones."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / u)


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(square_magnitude(a).cast("double")) * F.sqrt(square_magnitude(b).cast("double")), F.lit(0.0))


def append(coords: Column, value: Column) -> Column:
    return F.concat(coords, F.array(value.cast("int")))


def point_text(coords: Column, most: int = 10) -> Column:
    head = F.concat_ws(",", F.transform(F.slice(coords, 1, most), lambda x: x.cast("string")))
    return F.concat(F.lit("["), head, F.when(F.size(coords) > most, F.lit(",...")).otherwise(F.lit("")), F.lit("]"))
