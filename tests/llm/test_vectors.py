import numpy as np
from pyspark.sql import functions as F

from curveloom import datagen
from curveloom.llm import clusters as K
from curveloom.llm import neighbors as N
from curveloom.sources.points import valid_points


def frame(spark, x, lim=30_000, grp=None):
    return spark.createDataFrame([(i * 3, int(grp[i]) if grp is not None else 1, [int(v) for v in p], lim, 5) for i, p in enumerate(x)], "id bigint, grp int, coords array<int>, lim bigint, outlier int")


def exact(x, lim, k=5):
    d = np.square(x[:, None].astype(float) - x[None]).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    o = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {(i * 3, int(j) * 3) for i in range(len(x)) for j in o[i] if d[i, j] <= lim}


def test_recall(spark):
    x, _ = datagen.gaussian_clusters(12, 20, (60, 200), seed=1)
    x = np.concatenate([x, datagen.uniform(150, 20, 1000, seed=2)])
    best, rest = N.nearest_vectors(frame(spark, x), leaf=300)
    got, want = {(r.id, r.nbr) for r in best.collect()}, exact(x, 30_000)
    assert rest.count() == 0 and len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97


def test_dense_part_is_cut(spark):
    """One dense ball above the cap is cut all the same, into shards of bounded size; visits make up for the cuts."""
    x = np.clip(500 + np.random.default_rng(4).normal(size=(900, 6)) * 40, 0, 1000).astype(int)
    cells, n = N.shards(frame(spark, x, 3_000), leaf=200, cap=300)
    sizes = cells.groupBy("cell").agg(F.count_if("owned").alias("own"), F.count("*").alias("n")).collect()
    assert len(sizes) == n >= 3 and max(r.own for r in sizes) <= 300 and sum(r.own for r in sizes) == 900
    best, _ = N.nearest_vectors(frame(spark, x, 3_000), leaf=200, cap=300)
    got, want = {(r.id, r.nbr) for r in best.collect()}, exact(x, 3_000)
    assert len(got & want) / len(want) >= 0.8  # half of the vectors lie at a cut here


def test_trees_in_passes_and_levels(spark):
    """A small sample needs several levels of trees, and a small bound of numbers sent several passes; every vector has one owner."""
    x, _ = datagen.gaussian_clusters(6, 8, (60, 90), seed=3)
    p = frame(spark, np.concatenate([x, x + 2000]), grp=np.arange(2 * len(x)) // len(x))
    cells, n = N.shards(p, leaf=20, cap=40, sample=64, values=100)
    own = cells.where("owned").groupBy("cell").count().collect()
    assert sum(r["count"] for r in own) == 2 * len(x) and max(r["count"] for r in own) <= 40 and len(own) == n
    assert cells.where("owned").select("id").distinct().count() == 2 * len(x)


def test_leaves_follow_the_rows():
    """Trees for 100 million rows: refitted on samples of the parts, leaves stay bounded and vectors visit few others."""
    from curveloom.llm import graph as G

    rng = np.random.default_rng(0)
    centres, dims, rows, length = rng.uniform(100, 900, (400, 32)), 32, 100_000_000, 170.0
    draw = lambda n: (centres[rng.integers(400, size=n)] + rng.normal(size=(n, dims)) * 18).astype(np.float32)
    first = G.fit_tree(draw(N.SAMPLE), rows, N.LEAF, N.CAP, length, 1)
    x = draw(200_000)
    leaf, row, _ = G.apply_tree(first, x, N.SPILL * length / dims**0.5, N.PROBES)
    copies, largest = 1 + len(row) / len(x), []
    for big in np.argsort(-np.bincount(leaf))[:4]:
        n = int((leaf == big).mean() * rows)
        part = x[leaf == big]
        while len(part) < 4 * N.SAMPLE:
            more = draw(200_000)
            part = np.concatenate([part, more[G.apply_tree(first, more)[0] == big]])
        tree = G.fit_tree(part[: N.SAMPLE], n, N.LEAF, N.CAP, length, 2)
        second, visits, _ = G.apply_tree(tree, part[N.SAMPLE :])
        assert len(visits) / len(second) <= N.PROBES
        largest.append(np.bincount(second).max() / len(second))
    assert copies <= 1.2 and len(first) >= 60 and max(largest) < 0.2  # the second level cuts on, whatever the rows


def test_copies(spark):
    x = np.concatenate([np.tile([[5, 5, 5]], (40, 1)), np.tile([[5, 5, 9]], (3, 1)), [[900, 900, 900]]])
    p = frame(spark, x, lim=100)
    best, rest = N.nearest_vectors(p)
    assert rest.count() == 34
    got = {(r.id, r.nbr) for r in best.select("id", "nbr").unionByName(N.copy_neighbours(p, rest).select("id", "nbr")).collect()}
    assert got == exact(x, 100)


def test_edge_inputs(spark):
    none = frame(spark, np.zeros((0, 3), int))
    assert N.nearest_vectors(none)[0].count() == 0
    assert N.nearest_vectors(frame(spark, np.array([[1, 2, 3]])))[0].count() == 0
    assert K.flow_clusters(none).count() == 0
    big = frame(spark, np.array([[2**31 - 1, 0], [2**31 - 2, 0], [2**31 - 1, 3], [0, 0]]), lim=20)
    assert {(r.id, r.nbr) for r in N.nearest_vectors(big)[0].collect()} == {(0, 3), (3, 0), (0, 6), (6, 0), (3, 6), (6, 3)}


def test_valid_points(spark):
    d = spark.createDataFrame([(1, "a", 2, 10, 50, 5)], "dataset_id int, dataset_name string, dims int, bits int, merge_square_distance bigint, outlier_size int")
    rows = [(1, 1, [1, 2], "x"), (1, 1, [1, 2], "y"), (2, 1, [1, None], "x"), (3, 1, [1], ""), (4, 1, None, None), (5, 9, [1, 2], "x"), (None, 1, [1, 2], "x"), (6, None, [1, 2], "x"), (7, 1, [], "x"), (8, 1, [3, 4], None)]
    p = spark.createDataFrame(rows, "point_id bigint, dataset_id int, coords array<int>, dims string")
    assert sorted(r.id for r in valid_points(p, d).collect()) == [1, 8]


def test_clusters_are_the_linked_parts(spark):
    x, _ = datagen.gaussian_clusters(6, 12, (20, 60), deviation=(10, 14), top=2000, seed=5)
    line = datagen.chain(3, 12, 40, 600, 3, top=4000, seed=6)
    lone = datagen.uniform(20, 12, 4000, seed=8)
    x = np.concatenate([x, line, lone, np.tile(x[:1], (9, 1))])
    lim = 12_000
    near = np.square(x[:, None].astype(float) - x[None]).sum(axis=2) <= lim
    want, seen = {}, set()
    for i in range(len(x)):
        if i not in seen:
            todo, part = [i], {i}
            while todo:
                u = todo.pop()
                for v in np.nonzero(near[u])[0].tolist():
                    if v not in part:
                        part.add(v), todo.append(v)
            seen |= part
            want |= {p * 3: (min(part) * 3, len(part)) for p in part}
    m = K.flow_clusters(frame(spark, x, lim)).cache()
    assert {r.id: (r.cluster_id, r["size"]) for r in m.collect()} == want
    assert m.agg(F.countDistinct("flow_cluster")).first()[0] >= m.agg(F.countDistinct("cluster_id")).first()[0]
    d = {r.cluster_id: r for r in K.describe_clusters(m).collect()}
    assert sum(r.units for r in d.values()) == m.select("flow_cluster").distinct().count()
    assert all(r["size"] == want[c][1] and len(r.typical) == min(3, r["size"]) and r.is_stray == (r["size"] <= 5) for c, r in d.items())


def test_markov_two_cliques(spark):
    e = [(a, b, 1.0) for s in (0, 10) for a in range(s, s + 5) for b in range(a + 1, s + 5)] + [(4, 10, 0.1), (3, 3, 1.0), (None, 1, 1.0), (1, 2, 0.0)]
    rows = K.markov_clusters(spark.createDataFrame(e, "a bigint, b bigint, weight double")).collect()
    names = {r.id: r.flow_cluster for r in rows}
    assert len({names[i] for i in range(5)}) == 1 and len({names[i] for i in range(10, 15)}) == 1 and names[0] != names[10]


def test_markov_star(spark):
    """A hub with equal weights keeps as few entries as any node."""
    star = spark.range(1, 801).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("weight"))
    rows = K.markov_clusters(star).collect()
    assert len(rows) == 801 and len({r.flow_cluster for r in rows}) < 801
    raw = star.select(F.col("a").alias("c"), F.col("b").alias("r"), F.col("weight").alias("v"))
    assert K._largest(raw, K.MOST).count() == K.MOST
    e = K._columns(raw.limit(30), 2.0, 0.01, K.MOST).first().e
    assert [x.r for x in e] == sorted(x.r for x in e) and len(e) == K.MOST and abs(sum(x.v for x in e) - 1) < 1e-9


def test_flow_is_an_error_when_unsettled(spark):
    import pytest

    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "a bigint, b bigint, weight double")
    with pytest.raises(RuntimeError):
        K.markov_clusters(e, max_steps=2)


def test_a_step_that_every_tree_parts(spark):
    """Two parts of a group of two shards, tied by their nearest two points only."""
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 200, (3000, 4)), rng.integers(0, 200, (3000, 4)) + [270, 0, 0, 0]
    lim = min(int(np.square(a[i : i + 500, None] - b[None]).sum(axis=2).min()) for i in range(0, 3000, 500))
    assert {(r.cluster_id, r.size) for r in K.flow_clusters(frame(spark, np.concatenate([a, b]), lim)).collect()} == {(0, 6000)}


def test_cluster_links(spark):
    """Against all pairs: many cells and blocks, copies of other clusters, two groups, coordinates up to 2 ** 31."""
    from curveloom.llm.links import cluster_links

    rng = np.random.default_rng(2)
    x, _ = datagen.gaussian_clusters(8, 10, (20, 60), deviation=(10, 20), top=1000, seed=3)
    x = np.concatenate([x, rng.integers(0, 1000, (60, 10)), x[:4]])
    x = np.concatenate([x, x[:90] + (2**31 - 1200)])
    grp, comp, lim = np.where(np.arange(len(x)) % 3 == 0, 2, 1), rng.integers(0, 40, len(x)), 9_000
    comp = comp * 2 + grp % 2
    near = (np.square(x[:, None].astype(float) - x[None]).sum(axis=2) <= lim) & (grp[:, None] == grp[None])

    def groups(pairs):
        root = {int(c): int(c) for c in comp}
        for a, b in pairs:
            a, b = root[a], root[b]
            root = {k: a if v == b else v for k, v in root.items()}
        return {frozenset(k for k in root if root[k] == v) for v in root.values()}

    df = spark.createDataFrame([(i, int(grp[i]), [int(v) for v in p], lim, int(comp[i])) for i, p in enumerate(x)], "id bigint, grp int, coords array<int>, lim bigint, comp bigint")
    lone = df.withColumn("comp", df.id)
    want = groups((int(comp[i]), int(comp[j])) for i, j in np.argwhere(near))
    assert groups((r.a, r.b) for r in cluster_links(df, per=150, block=120).collect()) == want
    comp = np.arange(len(x))
    want = groups((int(i), int(j)) for i, j in np.argwhere(near))
    assert groups((r.a, r.b) for r in cluster_links(lone, per=100).collect()) == want
    assert groups((r.a, r.b) for r in cluster_links(lone, per=100, values=50).collect()) == want  # a pass a group
