"""Labels joined through pairs: connected components by the smallest reachable name."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Stages

#: Most rounds, and pairs up to which one task joins them all, with the same result.
ROUNDS, TASK_PAIRS = 80, 200_000


def _in_one_task(batches):
    t = pa.Table.from_batches(batches, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    names, at = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_inverse=True)
    a, b, root = at[: len(t)], at[len(t) :], np.arange(len(names))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        np.minimum.at(new, root, new)
        new = new[new]
        if (new == root).all():
            break
        root = new
    yield from pa.table({"name": names, "root": names[root]}).to_batches()


def joined_names(pairs: DataFrame) -> DataFrame:
    """``(name, root)`` for every name in ``pairs(a, b)``; root is the smallest name tied to it, directly or through others.

    Each round takes the smallest root among a name and its partners and then follows roots of roots, so long chains shrink fast. Everything stays distributed;
    pairs with a null end tie nothing; no pairs give no rows; an unfinished search is an error.
    """
    work = Stages(pairs.sparkSession, "joined")
    pairs = work.write(pairs.where("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    if pairs.count() <= TASK_PAIRS:
        return work.write(pairs.repartition(1).mapInArrow(_in_one_task, "name bigint, root bigint"))
    e = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*").distinct()
    e = work.write(e)
    at = work.write(e.groupBy(F.col("a").alias("name")).agg(F.min("b").alias("m")).select("name", F.least("name", "m").alias("root")))
    for _ in range(ROUNDS):
        roots = at.select(F.col("name").alias("b"), F.col("root").alias("r"))
        near = e.join(roots, "b").groupBy(F.col("a").alias("name")).agg(F.min("r").alias("r"))
        best = at.join(near, "name").select("name", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        # the old root hears of the new one too, so whole trees are hooked at once
        hooks = best.where("root < old").groupBy(F.col("old").alias("name")).agg(F.min("root").alias("hook"))
        hooked = work.write(best.join(hooks, "name", "left").select("name", F.least("root", F.coalesce("hook", "root")).alias("root"), F.least("root", F.coalesce("hook", "root")).alias("_to"), "old"))
        up = hooked.select(F.col("name").alias("_to"), F.col("root").alias("higher"))
        nxt = work.write(hooked.join(up, "_to", "left").select("name", F.least("root", F.coalesce("higher", "root")).alias("root"), "old").withColumn("moved", F.col("root") < F.col("old")))
        work.drop(hooked)
        if nxt.where("moved").isEmpty():
            return nxt.select("name", "root")
        at = nxt.select("name", "root")
    raise RuntimeError("names are not joined yet")


def renamed(points: DataFrame, roots: DataFrame) -> DataFrame:
    """Points with their label replaced by its root, if it has one."""
    to = roots.select(F.col("name").alias("label"), F.col("root").alias("_root"))
    return points.join(to, "label", "left").withColumn("label", F.coalesce("_root", "label")).drop("_root")
