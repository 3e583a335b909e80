"""Exact steps between clusters: a join of balls over the whole group, for what the approximate neighbour graph leaves open."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Stages
from .neighbors import _local_roots, _matrix

#: Rows a cell should hold, most cells of a group, and rows of either side that meet in one task.
PER, CELLS, BLOCK = 1024, 1024, 16_384
#: Numbers of the pivots that the driver and the tasks hold at once; more groups are done in passes.
PIVOT_VALUES = 16_000_000

_EPS = float(np.finfo(np.float64).eps)


def _to_pivots(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Square distances to the pivots, and a bound of their error that also holds for every point within ``r`` of the row."""
    c = (pivots - pivots[0]).astype(np.float64)
    x = x - pivots[0].astype(np.float64)
    m, mc = np.einsum("nd,nd->n", x, x), np.einsum("nd,nd->n", c, c)
    err = 4 * (x.shape[1] + 4) * _EPS * ((np.sqrt(m) + r) ** 2 + mc.max())
    return np.maximum(m[:, None] + mc[None, :] - 2 * (x @ c.T), 0), err[:, None]


def _meet(key: tuple, t: pa.Table) -> pa.Table:
    """One pair of clusters for each two that a step within the limit ties, between owned and visiting rows; pairs that others imply are left out."""
    own = t["owned"].to_numpy(zero_copy_only=False)
    if own.all() or not own.any():
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    lim = float(t["lim"][0].as_py())
    raw = _matrix(t["coords"])
    x = raw - raw[0].astype(np.int64)
    x = x.astype(np.float32 if np.abs(x).max() < 2**20 else np.float64)
    names, comp = np.unique(t["comp"].to_numpy(), return_inverse=True)
    m = np.einsum("nd,nd->n", x, x)
    bound = lim * (1 + 1e-6) + 4 * (x.shape[1] + 4) * float(np.finfo(x.dtype).eps) * float(m.max()) + 1
    root, top, out = np.arange(len(names)), np.argmax(np.bincount(comp)), []
    for rows, other in ((own & (comp != top), ~own), (own & (comp == top), ~own & (comp != top))):
        rows, other = np.nonzero(rows)[0], np.nonzero(other)[0]
        if not len(other):
            continue
        xo, mo = x[other], m[other]
        for lo in range(0, len(rows), 512):
            r = rows[lo : lo + 512]
            near = m[r][:, None] + mo[None, :] - 2 * (x[r] @ xo.T) <= bound
            near &= root[comp[r]][:, None] != root[comp[other]][None, :]
            i, j = np.nonzero(near)
            for at in range(0, len(i), 65_536):
                a, b = r[i[at : at + 65_536]], other[j[at : at + 65_536]]
                apart = root[comp[a]] != root[comp[b]]
                a, b = a[apart], b[apart]
                near_by = np.square(x[a].astype(np.float64) - x[b]).sum(axis=1) <= lim
                pairs = np.unique(np.stack([root[comp[a[near_by]]], root[comp[b[near_by]]]]), axis=1)
                if pairs.shape[1]:
                    tie = _local_roots(len(names), pairs[0], pairs[1])
                    out += [(names[k], names[tie[k]]) for k in np.unique(pairs) if tie[k] != k]
                    root = tie[root]
    return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})


def cluster_links(points: DataFrame, centres: DataFrame | None = None, per: int = PER, cells: int = CELLS, block: int = BLOCK, values: int = PIVOT_VALUES) -> DataFrame:
    """``(a, b)``: pairs of clusters of ``points(id, grp, coords, lim, comp)`` that tie all clusters with a step of square length <= ``lim`` between them.

    Exact, across all rows of a group. At most ``cells`` of the ``centres(grp, id, coords, weight)``, the heaviest, are the pivots of a group (sampled points if none
    are given): with the attractors of flow units a cell holds whole units and has few visitors. Each point is owned by the cell of its nearest one and
    visits each later cell that can hold a point within sqrt(lim) of another cluster, by the cell's radius (without its largest cluster for points
    of that cluster) and by the plane between the pivots. Visitors and owned rows meet in blocks, so no task holds more than two blocks.
    The pivots of many groups are held in passes of ``values`` numbers. Well parted clusters visit few cells; where everything is within sqrt(lim) of every cell and clusters are many, the work is all pairs.
    """
    spark = points.sparkSession
    work = Stages(spark, "links")
    one = work.write(points.where("lim >= 0").groupBy("grp", "lim", "coords", "comp").agg(F.min("id").alias("id")))
    empty = spark.createDataFrame([], "a bigint, b bigint")
    shape = one.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.size("coords")).alias("dims"))
    total = shape.agg(F.sum(F.least(F.lit(cells), F.ceil(F.col("n") / per)) * F.col("dims"))).first()[0] or 0
    passes = -(-total // values)
    if passes > 1:
        out = empty
        for k in range(passes):
            mine = F.pmod(F.xxhash64("grp"), F.lit(passes)) == k
            out = out.unionByName(_one_pass(one.where(mine), None if centres is None else centres.where(mine), per, cells, block))
        return out
    return _one_pass(one, centres, per, cells, block)


def _one_pass(one: DataFrame, centres: DataFrame | None, per: int, cells: int, block: int) -> DataFrame:
    """:func:`cluster_links` of the groups of ``one(id, grp, lim, coords, comp)``, all pivots at once."""
    spark = one.sparkSession
    work = Stages(spark, "links")
    empty = spark.createDataFrame([], "a bigint, b bigint")
    sizes = {r.grp: r.n for r in one.groupBy("grp").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").collect()}
    if not sizes:
        return empty
    most = F.broadcast(spark.createDataFrame([(g, int(min(cells, -(-k // per)))) for g, k in sizes.items()], "grp int, most int"))
    if centres is None:
        centres = one.select("grp", "id", "coords", F.lit(1).alias("weight"))
    w = Window.partitionBy("grp").orderBy(F.desc("weight"), F.xxhash64("id"), "id")
    rows = centres.join(most, "grp").withColumn("rn", F.row_number().over(w)).where((F.col("rn") <= cells) & (F.col("rn") <= F.col("most"))).collect()
    pivots, base, total = {}, {}, 0
    for g in sorted(sizes):
        pivots[g] = np.array([r.coords for r in sorted((r for r in rows if r.grp == g), key=lambda r: r.rn)], np.int64)
        base[g], total = total, total + len(pivots[g])
    given = spark.sparkContext.broadcast((pivots, base))
    fields = [("grp", pa.int32()), ("id", pa.int64()), ("comp", pa.int64()), ("lim", pa.int64()), ("coords", pa.list_(pa.int32())), ("cell", pa.int32())]
    columns = "grp int, id bigint, comp bigint, lim bigint, coords array<int>, cell int"

    def by_group(batches, known):
        for b in batches:
            grp = b["grp"].to_numpy(zero_copy_only=False)
            for g in np.unique(grp):
                if int(g) in known:
                    part = b.take(pa.array(np.nonzero(grp == g)[0]))
                    for lo in range(0, part.num_rows, 2048):
                        some = part.slice(lo, 2048)
                        yield int(g), some, _matrix(some["coords"]), float(some["lim"][0].as_py()) ** 0.5 * (1 + 1e-9)

    def own(batches):
        p, first = given.value
        for g, b, x, r in by_group(batches, p):
            d2, err = _to_pivots(x, p[g], r)
            at = np.argmin(d2, axis=1)
            d = np.sqrt(d2[np.arange(len(at)), at] + err[:, 0])
            yield pa.RecordBatch.from_arrays([*(b[c] for c, _ in fields[:5]), pa.array((first[g] + at).astype(np.int32)), pa.array(d)], schema=pa.schema([*fields, ("d", pa.float64())]))

    owned = work.write(one.select("grp", "id", "comp", "lim", "coords").mapInArrow(own, columns + ", d double"))
    parts = owned.groupBy("cell", "comp").agg(F.count("*").alias("n"), F.max("d").alias("d"))
    main = parts.groupBy("cell").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    known = parts.join(main, "cell").groupBy("cell", "main").agg(F.sum("n").alias("n"), F.max("d").alias("d"), F.max(F.when(F.col("comp") != F.col("main"), F.col("d"))).alias("other")).collect()
    radius, other, largest, count = np.full(total, -np.inf), np.full(total, -np.inf), np.full(total, -1, np.int64), {}
    for k in known:
        radius[k.cell], largest[k.cell], count[k.cell] = k.d, k.main, k.n
        if k.other is not None:
            other[k.cell] = k.other
    shape = spark.sparkContext.broadcast((radius, other, largest))

    def visit(batches):
        p, first = given.value
        radius, other, largest = shape.value
        for g, b, x, r in by_group(batches, p):
            lo, hi = first[g], first[g] + len(p[g])
            d2, err = _to_pivots(x, p[g], r)
            mine, comp = b["cell"].to_numpy(zero_copy_only=False) - lo, b["comp"].to_numpy(zero_copy_only=False)
            reach = np.where(comp[:, None] == largest[None, lo:hi], other[None, lo:hi], radius[None, lo:hi]) + r
            apart, slip = _to_pivots(p[g], p[g], 0.0)
            plane = d2 - d2[np.arange(len(mine)), mine][:, None] <= 2 * r * np.sqrt(apart + slip)[mine] + 4 * err
            goes = (np.sqrt(np.maximum(d2 - err, 0)) <= reach) & plane & (np.arange(hi - lo)[None, :] > mine[:, None])
            goes[np.arange(len(mine)), mine] = True
            to = [(lo + np.nonzero(row)[0]).tolist() for row in goes]
            yield pa.RecordBatch.from_arrays([*(b[c] for c, _ in fields), pa.array(to, pa.list_(pa.int32()))], schema=pa.schema([*fields, ("visits", pa.list_(pa.int32()))]))

    placed = work.write(owned.drop("d").mapInArrow(visit, columns + ", visits array<int>"))
    guests = placed.select("comp", F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").collect()
    todo = [(int(r.cell), int(-(-count[r.cell] // block)), int(-(-r.n // block))) for r in guests if r.cell in count]
    if not todo:
        return empty
    blocks = F.broadcast(spark.createDataFrame(todo, "cell int, m int, k int"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ["comp", "lim", "coords"]
    homes = placed.join(blocks, "cell").select("cell", part("m").alias("i"), every("k").alias("j"), F.lit(True).alias("owned"), *rest)
    calls = placed.select("id", *rest, F.explode("visits").alias("cell")).join(blocks, "cell").select("cell", every("m").alias("i"), part("k").alias("j"), F.lit(False).alias("owned"), *rest)
    tasks = max(8, min(20_000, sum(m * k for _, m, k in todo) // 8))
    met = homes.unionByName(calls).repartition(tasks, "cell", "i", "j").groupBy("cell", "i", "j").applyInArrow(_meet, "a bigint, b bigint")
    return work.write(met)
