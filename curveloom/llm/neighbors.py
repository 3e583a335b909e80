"""Problem 5: the k most similar vectors of every vector, by a robust-pruned directed graph over shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Stages, small, table
from ..sources.points import valid_points
from . import graph as G

#: Rows sampled of a part for its tree (so at most SAMPLE / 16 leaves a fit), rows a shard should hold, and rows above which a part is always cut.
SAMPLE, LEAF, CAP = 2048, 4096, 8192
#: A vector also visits the other side of cuts within SPILL steps over the root of the dimensions (the usual way along one direction), at most PROBES of them a level.
SPILL, PROBES = 0.7, 2
#: Numbers of the trees sent to the tasks at once, and most levels of trees.
TREE_VALUES, LEVELS = 16_000_000, 24
DEGREE, BEAM, ALPHA = 16, 32, 1.2

_FOUND = "id bigint, nbr bigint, d2 bigint"
_ROWS = "cell bigint, id bigint, owned boolean, lim bigint, coords array<int>"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def step_length(x: np.ndarray, lim: float | None) -> float:
    """Length of a step within the limit; without a limit the median distance of sampled rows to their nearest one."""
    if lim is not None:
        return float(lim) ** 0.5
    s = x[:512].astype(np.float64)
    m = np.einsum("nd,nd->n", s, s)
    d = m[:, None] + m[None, :] - 2 * s @ s.T
    np.fill_diagonal(d, np.inf)
    return float(np.sqrt(np.maximum(np.median(d.min(axis=1)), 0))) if len(s) > 1 else 1.0


def _fit(rows: DataFrame, big: DataFrame, sample: int, leaf: int, cap: int, seed: int) -> dict:
    """A projection tree per cell of ``big(cell, n)``, fitted by the executors on at most ``sample`` rows each: ``{cell: (nodes, leaves, step length)}``."""
    w = Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id")
    s = rows.where("owned").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= sample).join(big, "cell")

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        x = _matrix(t["coords"]).astype(np.float32)
        length = step_length(x, t["lim"][0].as_py())
        nodes = G.fit_tree(x, t["n"][0].as_py(), leaf, cap, length, seed)
        row = {"cell": key[0].as_py(), "length": length, "vector": [v for node in nodes for v in node[0].tolist()], "threshold": [node[1] for node in nodes], "child": [c for node in nodes for c in node[2:]]}
        return pa.Table.from_pylist([row], schema=pa.schema([("cell", pa.int64()), ("length", pa.float64()), ("vector", pa.list_(pa.float32())), ("threshold", pa.list_(pa.float64())), ("child", pa.list_(pa.int32()))]))

    out = {}
    for r in s.groupBy("cell").applyInArrow(fit, "cell bigint, length double, vector array<float>, threshold array<double>, child array<int>").collect():
        m = len(r.threshold)
        v = np.array(r.vector, np.float32).reshape(m, -1) if m else np.zeros((0, 0), np.float32)
        out[r.cell] = ([(v[i], r.threshold[i], r.child[2 * i], r.child[2 * i + 1]) for i in range(m)], m + 1, r.length)
    return out


def _place(rows: DataFrame, fitted: dict, base: dict, spill: float, probes: int) -> DataFrame:
    """Rows in the leaves of their cell's tree, owned by one and visiting those across near cuts; rows of other cells stay."""
    given = rows.sparkSession.sparkContext.broadcast((fitted, base))
    schema = pa.schema([("cell", pa.int64()), ("id", pa.int64()), ("owned", pa.bool_()), ("lim", pa.int64()), ("coords", pa.list_(pa.int32()))])

    def place(batches):
        fitted, base = given.value
        for b in batches:
            if not b.num_rows:
                continue
            cell, owned = b["cell"].to_numpy(zero_copy_only=False), b["owned"].to_numpy(zero_copy_only=False)
            for c in np.unique(cell):
                own = np.nonzero(cell == c)[0]
                if int(c) not in fitted:
                    yield pa.RecordBatch.from_arrays([b[n].take(pa.array(own)) for n in schema.names], schema=schema)
                    continue
                nodes, _, length = fitted[int(c)]
                for part, visits in ((own[owned[own]], probes), (own[~owned[own]], 0)):
                    if not len(part):
                        continue
                    x = _matrix(b["coords"].take(pa.array(part))).astype(np.float32)
                    leaf, row, other = G.apply_tree(nodes, x, spill * length / x.shape[1] ** 0.5 if visits else -1.0, visits)
                    at = np.concatenate([part, part[row]])
                    to = base[int(c)] + np.concatenate([leaf.astype(np.int64), other])
                    mine = np.concatenate([owned[part], np.zeros(len(row), bool)])
                    pick = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(to), b["id"].take(pick), pa.array(mine), b["lim"].take(pick), b["coords"].take(pick)], schema=schema)

    return rows.select("cell", "id", "owned", "lim", "coords").mapInArrow(place, _ROWS)


def shards(points: DataFrame, leaf: int = LEAF, cap: int = CAP, sample: int = SAMPLE, spill: float = SPILL, probes: int = PROBES, values: int = TREE_VALUES) -> tuple[DataFrame, int]:
    """``(cell, id, owned, lim, coords)`` of all points in shards of near vectors, and the number of shards.

    Every part above ``cap`` rows is cut by a tree fitted on its own sample, again and again until none is left, so the leaves follow the number of rows
    and so does the work: each level reads and writes every open row once. Each vector is owned by one shard; it visits at most ``probes`` others a level, those across
    cuts within ``spill`` / sqrt(dims) steps, and a visit makes no further ones. Only trees of at most ``values`` numbers are sent to the tasks at once; more cells are done in passes.
    """
    spark = points.sparkSession
    work = Stages(spark, "shards")
    rows = points.select((F.col("grp").cast("long") - F.lit(1 << 40)).alias("cell"), "id", F.lit(True).alias("owned"), "lim", F.col("coords").cast("array<int>").alias("coords"))
    closed, count, base = [], 0, 0
    for level in range(LEVELS):
        sizes = work.write(rows.where("owned").groupBy("cell").agg(F.count("*").alias("n"), F.max(F.size("coords")).alias("dims")))
        s = sizes.agg(F.count("*").alias("cells"), F.count_if(F.col("n") > cap).alias("big"), F.max("dims").alias("dims")).first()
        count += s.cells - s.big
        if not s.big:
            closed.append(rows)
            break
        passes = max(1, -(-s.big * (sample // 16) * s.dims // values))
        open_ = []
        for p in range(passes):
            mine = F.pmod(F.xxhash64("cell"), F.lit(passes)) == p
            big = small(sizes.where((F.col("n") > cap) & mine).select("cell", "n"), s.big)
            fitted = _fit(rows.where(mine) if passes > 1 else rows, big, sample, leaf, cap, seed=level * 7919 + 1)
            if not fitted:
                closed.append(rows.where(mine))
                continue
            first = {}
            for c in sorted(fitted):
                first[c], base = base, base + fitted[c][1]
            # cells of this level keep their numbers, cut ones get numbers from here on
            placed = work.write(_place(rows.where(mine) if passes > 1 else rows, fitted, first, spill, probes))
            low = min(first.values())
            closed.append(placed.where(F.col("cell") < low))
            open_.append(placed.where(F.col("cell") >= low))
        rows = open_[0]
        for o in open_[1:]:
            rows = rows.unionByName(o)
    else:
        raise RuntimeError("a part of the vectors can't be cut")
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out, count


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row tied to each row by the edges (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _search(k: int, degree: int, beam: int, alpha: float):
    def search(t: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], pa.int64()), "nbr": pa.array([], pa.int64()), "d2": pa.array([], pa.int64())})
        t = t.sort_by("id")
        ids, owned, lim = t["id"].to_numpy(), t["owned"].to_numpy(zero_copy_only=False), t["lim"].to_pandas().fillna(np.inf).to_numpy(np.float64)
        raw = _matrix(t["coords"])
        if not owned.any() or len(ids) < 2:
            return empty
        x = raw - np.round(raw[owned].mean(axis=0))
        x = x.astype(np.float32 if np.abs(x).max() < 2**20 else np.float64)  # whole numbers, exact in either
        # exact copies: one row of the graph each, with the smallest ids behind it
        _, first, cls = np.unique(x[owned], axis=0, return_index=True, return_inverse=True)
        u, own_ids = x[owned][first], ids[owned]
        order = np.lexsort((own_ids, cls))
        at = np.arange(len(order)) - np.searchsorted(cls[order], cls[order])
        mem = np.full((len(u), k + 1), -1, np.int64)
        keep = at <= k
        mem[cls[order][keep], at[keep]] = own_ids[order][keep]
        nbrs = G.build(u, degree, beam, alpha, seed=11)
        start = np.concatenate([np.arange(len(u), dtype=np.int32)[:, None], nbrs], axis=1)
        bi, _ = G.beam_search(u, nbrs, u, start, beam)
        bi = bi[:, : 2 * k + 2]
        got = [(np.nonzero(owned)[0], bi[cls])]
        if not owned.all():
            rng, visit = np.random.default_rng(3), np.nonzero(~owned)[0]
            entry = np.broadcast_to(rng.permutation(len(u))[: min(64, len(u))].astype(np.int32), (len(visit), min(64, len(u))))
            got.append((visit, G.beam_search(u, nbrs, x[visit], entry, beam)[0][:, : 2 * k + 2]))
        out, exact = [], u.astype(np.float64)
        for who, reps in got:
            for lo in range(0, len(who), 4096):
                p, r = who[lo : lo + 4096], reps[lo : lo + 4096]
                d = np.square(exact[np.maximum(r, 0)] - x[p].astype(np.float64)[:, None, :]).sum(axis=2)
                d = np.where(r < 0, np.inf, d)
                ci = mem[np.maximum(r, 0)].reshape(len(p), -1)
                cd = np.repeat(d, k + 1, axis=1)
                cd = np.where((ci < 0) | (ci == ids[p][:, None]), np.inf, cd)
                o = np.argsort(ci, axis=1, kind="stable")
                ci, cd = np.take_along_axis(ci, o, 1), np.take_along_axis(cd, o, 1)
                o = np.argsort(cd, axis=1, kind="stable")[:, :k]
                ci, cd = np.take_along_axis(ci, o, 1), np.take_along_axis(cd, o, 1)
                ok = np.isfinite(cd) & (cd <= lim[p][:, None])
                out.append((np.repeat(ids[p], ok.sum(axis=1)), ci[ok], cd[ok]))
        a, b, d = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.table({"id": a, "nbr": b, "d2": d.astype(np.int64)})

    return search


def nearest_vectors(points: DataFrame, k: int = 5, distinct: bool = False, leaf: int = LEAF, cap: int = CAP, sample: int = SAMPLE, spill: float = SPILL, probes: int = PROBES, degree: int = DEGREE, beam: int = BEAM) -> tuple[DataFrame, DataFrame]:
    """The k nearest vectors of each vector of its group: ``(id, nbr, d2)`` with ``d2 <= lim``, and the copies left aside.

    ``points(id, grp, coords, lim)``, one row per id, vectors of a group of one length; ``lim`` null sets no limit. Square distances are exact,
    ties go by smaller id. Every vector is indexed and queried: :func:`shards` deals each group into shards of near vectors, in each shard a directed
    graph is grown by greedy search and relaxed pruning, and beam search queries it for the vectors it owns and those that visit it. Loss comes from
    neighbours across cuts a vector doesn't visit and from the beam.
    Of vectors with more than ``k + 1`` exact copies only the ``k + 1`` smallest ids enter the graph; the second result ``(id, grp, coords)`` holds
    the others, whose neighbours are the k smallest copies: no group of copies is gathered in one task. ``distinct`` says that there are no copies.
    """
    spark = points.sparkSession
    work = Stages(spark, "nearest")
    pts = heads = points.select("id", "grp", "coords", "lim")
    rest = pts.select("id", "grp", "coords").where("false")
    if not distinct:
        pts = work.write(pts)
        w = Window.partitionBy("grp", "coords").orderBy("id")
        heads = work.write(pts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1).drop("rn"))
        if pts.count() > heads.count():
            rest = pts.join(heads.select("id"), "id", "left_anti").select("id", "grp", "coords")
    cells, n = shards(heads, leaf, cap, sample, spill, probes)
    found = cells.repartition(max(8, min(20_000, 2 * n)), "cell").groupBy("cell").applyInArrow(_search(k, degree, beam, ALPHA), _FOUND)
    found = work.write(found)
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("d2", "nbr"))), 1, k).alias("b")).select("id", F.explode("b").alias("b")).select("id", "b.nbr", "b.d2")
    return best, rest


def copy_neighbours(points: DataFrame, rest: DataFrame, k: int = 5) -> DataFrame:
    """``(id, nbr, d2)`` of the copies left aside: the k smallest ids of their vector, at distance 0."""
    w = Window.partitionBy("grp", "coords").orderBy("id")
    heads = points.join(rest.select("grp", "coords").distinct(), ["grp", "coords"], "left_semi").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return rest.join(heads.select("grp", "coords", F.col("id").alias("nbr")), ["grp", "coords"]).where("id <> nbr").select("id", "nbr", F.lit(0).cast("long").alias("d2"))


def neighbour_table(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    pts = valid_points(table(spark, sf_dir, "points"), table(spark, sf_dir, "datasets"))
    best, rest = nearest_vectors(pts, k)
    return best.select("id", "nbr", "d2").unionByName(copy_neighbours(pts, rest, k))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = neighbour_table(spark, sf_dir)
    return e.select(F.least("id", "nbr").alias("point_a"), F.greatest("id", "nbr").alias("point_b")).distinct()


QUERIES = {"p5_found": p5_found}

#: The exact answer by all pairs: quick at the scale of the comparison, where no neighbour is lost.
SQL = {
    "p5_found": """
WITH p AS (SELECT DISTINCT p.point_id AS id, p.dataset_id AS grp, p.coords, d.merge_square_distance AS lim FROM points p JOIN datasets d USING (dataset_id)
  WHERE p.coords IS NOT NULL AND len(p.coords) = d.dims AND NOT list_contains(list_transform(p.coords, lambda x: x IS NULL), true)),
n AS (SELECT a.id, b.id AS nbr, list_sum(list_transform(list_zip(a.coords, b.coords), lambda z: (z[1] - z[2])::BIGINT * (z[1] - z[2]))) AS d2, a.lim FROM p a JOIN p b ON a.grp = b.grp AND a.id <> b.id),
t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, nbr) <= 5)
SELECT DISTINCT least(id, nbr) AS point_a, greatest(id, nbr) AS point_b FROM t WHERE d2 <= lim
"""
}
