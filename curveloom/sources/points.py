"""Point tables: validation and one row per point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_points(points: DataFrame, datasets: DataFrame) -> DataFrame:
    """``(id, grp, coords, lim, outlier)`` of all valid points, one row per id.

    A row is no point if its id, dataset or coords is null, coords hold a null, a negative or have another length than the
    dataset's ``dims``. Repeated ids give one row; should copies differ, the smallest (dataset, coords) is kept. Extra columns are ignored.
    """
    d = datasets.select(F.col("dataset_id").alias("grp"), "dims", F.col("merge_square_distance").cast("long").alias("lim"), F.col("outlier_size").alias("outlier")).dropDuplicates(["grp"])
    p = points.select(F.col("point_id").cast("long").alias("id"), F.col("dataset_id").alias("grp"), "coords").where("id is not null and coords is not null and size(coords) > 0 and not exists(coords, x -> x is null or x < 0)")
    p = p.join(d, "grp").where("size(coords) = dims")
    one = p.groupBy("id").agg(F.min(F.struct("grp", "coords", "lim", "outlier")).alias("p"))
    return one.select("id", "p.grp", "p.coords", "p.lim", "p.outlier")
