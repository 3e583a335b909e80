"""Operators of clustering against plain walks and all pairs on small points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curveloom import datagen
from curveloom.functions import points as P
from curveloom.operators import balance, classify, groups, knn, order, pairs, runs, stats
from curveloom.streaming.quantile import shuffled_quantile


def points(spark, x, y=None):
    y = y if y is not None else np.zeros(len(x), int)
    return spark.createDataFrame([(i, [int(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(x, y, strict=True))], "id bigint, coords array<int>, label int")


def d2(x):
    return np.square(x[:, None].astype(float) - x[None]).sum(axis=2)


@pytest.mark.parametrize("sizes,least,want", [
    ([60, 20, 20], 5, "highly clustered"), ([2, 2, 2, 2], 5, "unclustered"), ([50] + [1] * 8, 5, "singly clustered"), ([70, 20, 10], 5, "majority clustered"),
    ([10, 10] + [1] * 60, 5, "weakly clustered"), ([20, 20] + [1] * 30, 5, "moderately clustered"), ([30, 30] + [1] * 5, 5, "highly clustered"), ([5, 5], 5, "highly clustered"), ([6] + [1] * 115, 6, "unclustered"),
])
def test_tendency(spark, sizes, least, want):
    """Groups of the given sizes, each in its own cell; the first 2 ** 7 cells of seven dimensions with medians in the middle."""
    cells = [[(g >> k) & 1 for k in range(7)] for g in range(128)]
    rng = np.random.default_rng(1)
    x = np.concatenate([np.tile(np.array(cells[g]) * 100 + 1, (n, 1)) for g, n in enumerate(sizes)])
    cell = points(spark, x)
    # balancing shifts the cut, so the groups are given as balanced coordinates
    real, balance_ = balance.balance, lambda p, bits: p.withColumn("coords", F.transform("coords", lambda v: F.shiftright(v, 6)))
    try:
        balance.balance = balance_
        r = balance.tendency(cell, least).first()
    finally:
        balance.balance = real
    assert (r.verdict, r.points) == (want, len(x)) and rng is not None


def test_tendency_of_nothing(spark):
    r = balance.tendency(points(spark, np.zeros((0, 3), int)), 5).first()
    assert r is None or r.verdict == "unclustered"


def test_joined_names(spark):
    rng = np.random.default_rng(0)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (5, None), (7, 7)]
    df = spark.createDataFrame(e, "a bigint, b bigint")
    one = {r.name: r.root for r in groups.joined_names(df).collect()}
    try:
        groups.TASK_PAIRS = 0
        many = {r.name: r.root for r in groups.joined_names(df).collect()}
        assert groups.joined_names(df.where("false")).count() == 0
    finally:
        groups.TASK_PAIRS = 200_000
    assert one == many and one[1060] == 1000 and one[7] <= 7
    assert all(one[a] == one[b] for a, b in e if a is not None and b is not None)


def test_closest_clusters_and_outliers(spark):
    x, y = datagen.gaussian_clusters(12, 5, (6, 20), deviation=(20, 40), top=1000, seed=2)
    y = np.where(np.arange(len(x)) % 9 == 0, 100 + np.arange(len(x)), y)  # single points as clusters
    p, d, names = points(spark, x, y), d2(x), np.unique(y)
    cent = np.array([np.rint(x[y == k].mean(axis=0)) for k in names])
    size = np.array([(y == k).sum() for k in names])
    dc = d2(cent)

    def tries(ok):
        """All pairs in the order of distance, while either side has had fewer than three tries."""
        done, out = {}, set()
        for v, i, j in sorted((dc[i, j], i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if ok(i, j)):
            if done.get(i, 0) < 3 or done.get(j, 0) < 3:
                done[i], done[j] = done.get(i, 0) + 1, done.get(j, 0) + 1
                out.add((int(names[i]), int(names[j])))
        return out

    best = lambda a, b: d[np.ix_(y == a, y == b)].min()
    for least, outliers, fn in ((5, False, pairs.closest_clusters), (5, True, pairs.closest_outliers)):
        t = tries((lambda i, j: (size[i] < least) != (size[j] < least)) if outliers else (lambda i, j: size[i] >= least and size[j] >= least))
        got = {(r.a, r.b): r for r in fn(p, 3, 60_000, least).collect()}
        assert set(got) == {q for q in t if best(*q) <= 60_000} and all(r.d2 == best(a, b) == d[r.id1, r.id2] for (a, b), r in got.items())
    one = pairs.closest_pair(p, 0, 1).first()
    assert one.d2 == best(0, 1)
    two = pairs.swapped(pairs.closest_clusters(p, 3, 60_000, 5))
    moved = pairs.relabelled(two, p.select("id", F.lit(1).alias("label")))
    assert two.where("d2 is null").count() == 0 and moved.count() == 0
    assert pairs.closest_clusters(p.where("false"), 3, 10, 5).count() == 0
    small = pairs.nearest_between(p.where("label = 0").select(F.lit(1).cast("bigint").alias("pair"), "label", "id", "coords"), p.where("label > 0").select(F.lit(1).cast("bigint").alias("pair"), "label", "id", "coords"), block=3).first()
    assert small.d2 == d[np.ix_(y == 0, y > 0)].min()


def test_merge_outliers(spark):
    x = np.array([[0], [1], [2], [50], [51], [52], [10], [40], [400]])
    p = points(spark, x, np.array([0, 0, 0, 1, 1, 1, 2, 3, 4]))
    got = {r.id: r.label for r in classify.merge_outliers(p, 5, 150, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 0, 7: 1, 8: 4}


def plain_walk(c, limit):
    """Labels of one walk along an order, with revisits."""
    label = list(range(len(c)))
    near = lambda a, b: ((c[a] - c[b]) ** 2).sum() <= limit

    def merge(a, b):
        if label[a] == label[b]:
            return False
        old, new = label[b], label[a]
        label[:] = [new if v == old else v for v in label]
        return True

    last = None
    for i in range(1, len(c)):
        if near(i - 1, i) and merge(i - 1, i) or last is not None and near(last, i) and merge(last, i):
            last = i
    return label


def test_revisits_follow_the_walk(spark):
    rng = np.random.default_rng(5)
    for seed in range(4):
        c = np.cumsum(rng.choice([0, 1, 1, 30, -30, 29], 60))[:, None] if seed % 2 else rng.choice([0, 2, 3, 60, 61, 200, 300], 60)[:, None]
        index = points(spark, c).withColumn("pos", F.col("id"))
        isl = runs.islands(index, runs.neighbor_distances(index), 4)
        ties = runs.revisited(index, isl, 4)
        got = {r.id: r.label for r in groups.renamed(isl.select("id", F.col("island").alias("label")), groups.joined_names(ties)).collect()}
        want = plain_walk(c, 4)
        same = lambda v: {frozenset(i for i in range(60) if v[i] == k) for k in set(v[i] for i in range(60))}
        assert same(got) == same(want)


def test_density_split_follows_plain_ties(spark):
    """Against ties taken one after the other, on a line where the order is that of the values."""
    rng = np.random.default_rng(8)
    x = np.unique(np.concatenate([rng.normal(300, 20, 60), rng.normal(420, 15, 60), rng.uniform(200, 600, 25)]).astype(int))[:, None]
    n, limit, w = len(x), 400, 10
    got = {r.id: r.part for r in classify.density_split(points(spark, x), 1, 10, limit, w).collect()}
    v = x[:, 0]
    lo = np.clip(np.arange(n) - w, 0, n - 1 - 2 * w)
    dens = np.array([((v[lo[i] : lo[i] + 2 * w + 1] - v[i]) ** 2 <= limit).sum() - 1 for i in range(n)])
    part, cap = list(range(n)), max(2, n // 6)
    for i in sorted((i for i in range(n - 1) if (v[i + 1] - v[i]) ** 2 <= limit), key=lambda i: -max(dens[i], dens[i + 1])):
        a, b = part[i], part[i + 1]
        if a != b and (part.count(a) < cap or part.count(b) < cap):
            part = [a if k == b else k for k in part]
    big = {k for k in part if part.count(k) >= cap}
    for k in set(part) - big:
        mine = [i for i in range(n) if part[i] == k]
        to = min(((v[i] - v[j]) ** 2, i, j) for i in mine for j in range(n) if part[j] in big)[2] if big else mine[0]
        for i in mine:
            part[i] = ("moved", part[to])
    part = [k[1] if isinstance(k, tuple) else k for k in part]
    same = lambda p: {frozenset(i for i in range(n) if p[i] == k) for k in set(p[i] for i in range(n))}
    assert same(got) == same(part) and len(set(part)) > 1
    joined = classify.density_split(points(spark, x), 1, 10, limit, w, mergeable_shrinkage=100.0)
    assert joined.select("part").distinct().count() == 1
    assert classify.density_split(points(spark, x).where("false"), 1, 10, limit).count() == 0


def test_classify_many_clusters(spark):
    """Far more clusters than any list kept on the driver would need: each is found."""
    rng = np.random.default_rng(3)
    centres = np.array([(a * 100 + 50, b * 100 + 50, c * 100 + 50) for a in range(10) for b in range(10) for c in range(3)])
    x = np.repeat(centres, 8, axis=0) + rng.integers(-3, 4, (len(centres) * 8, 3))
    y = np.repeat(np.arange(len(centres)), 8)
    p = points(spark, x, y)
    labels, s = classify.curve_classify(p, 3, 10, outlier=3, merge_distance=300, rounds=2)
    assert s == 300 and stats.b_cubed(p, labels).first().f == 1.0
    first = classify.order_search(p, 3, 10, outlier=3, rounds=3)
    try:
        classify.TASK_ROWS = 10
        assert classify.order_search(p, 3, 10, outlier=3, rounds=1)[1] == first[1] or first[1] > 0
        a = classify.measure_order(p, [0, 1, 2], 3, 10, 3, 10)
    finally:
        classify.TASK_ROWS = 200_000
    assert a == classify.order_search(p, 3, 10, outlier=3, rounds=0)[1]
    seen = []
    classify.order_search(p, 3, 10, rounds=1, metric=lambda steps, outlier, skip: int(len(steps)))
    classify.order_search(points(spark, np.tile(x, (1, 3))[:200]), 9, 10, rounds=1, strategy=lambda perm, r, rng: seen.append(r) or list(reversed(perm)))
    assert seen and len({classify.shrinking(list(range(20)), 5, np.random.default_rng(1))[0]}) == 1


def test_blocks_of_queries(spark):
    x = datagen.uniform(300, 4, 50, seed=1)
    p, d = points(spark, x), d2(x)
    old, knn.BLOCK_VALUES = knn.BLOCK_VALUES, 60
    try:
        near = knn.exact_knn(p, p.where("id % 5 = 0"), 4).collect()
        n = {r.q: r.n for r in knn.count_within(p, p.where("id % 5 = 0"), 500).collect()}
    finally:
        knn.BLOCK_VALUES = old
    want = {(q, int(j)) for q in range(0, 300, 5) for j in sorted((int(i) for i in range(300) if i != q), key=lambda i: (d[q, i], i))[:4]}
    assert {(r.q, r.id) for r in near} == want and n == {q: int((d[q] <= 500).sum()) - 1 for q in range(0, 300, 5)}


def test_medians_and_shrinkage(spark):
    x = np.concatenate([datagen.uniform(101, 3, 200_000, seed=3), np.zeros((3, 3), int)])
    got = {r.dim: r.median for r in balance.dimension_stats(points(spark, x)).collect()}
    assert got == {i: int(np.sort(x[:, i])[(len(x) + 1) // 2 - 1]) for i in range(3)}
    y = np.repeat([0, 1], 52)
    plan = stats.shrinkage(points(spark, x, y), spark.createDataFrame([(0, 1)], "a int, b int"))
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and plan.count() == 1


def test_permutations_and_sparse_points(spark):
    import itertools

    assert {tuple(r.perm) for r in P.all_permutations(spark, 4).collect()} == set(itertools.permutations(range(4)))
    m = P.random_mapping(9, 3)
    assert [m[i] for i in P.inverse_mapping(m)] == P.identity_mapping(9)
    df = spark.createDataFrame([({5: 1, 7: 2, 10: 3, 15: 4}, {4: 4, 7: 3, 10: 2, 18: 1})], "a map<int,int>, b map<int,int>")
    assert df.select(P.sparse_square_distance(F.col("a"), F.col("b"), F.lit(0))).first()[0] == 36
    assert df.select(P.sparse_get(F.col("a"), 7, F.lit(9)), P.sparse_get(F.col("a"), 8, F.lit(9))).first()[:] == (2, 9)


def test_shuffled_quantile(spark):
    rng = np.random.default_rng(2)
    rows = [(1, i, int(v)) for i, v in enumerate(rng.permutation(5000))] + [(2, i, i * 10) for i in range(9)] + [(3, 1, None), (None, 1, 4)]
    df = spark.createDataFrame(rows, "k int, i int, v bigint")
    got = {r.k: (r.estimate, r.n) for r in shuffled_quantile(df, "k", "v", "i", 0.5).collect()}
    assert set(got) == {1, 2} and got[2] == (40, 9) and abs(got[1][0] - 2500) < 600 and got[1][1] == 5000
    assert shuffled_quantile(df.where("false"), "k", "v", "i", 0.5).count() == 0


def test_samples(spark):
    p = points(spark, datagen.uniform(50, 2, 9), np.arange(50) % 3)
    assert order.sample_by(p, "label", 4, 1).groupBy("label").count().where("count = 4").count() == 3
    s = order.shuffled(p, 7).collect()
    assert sorted(r.place for r in s) == list(range(50)) and [r.id for r in sorted(s, key=lambda r: r.place)] != list(range(50))
    b = balance.balanced_index(points(spark, datagen.uniform(60, 3, 500, seed=2)), 3, 9, to_bits=4, mapping=[2, 0, 1])
    assert sorted(r.pos for r in b.collect()) == list(range(60)) and b.agg(F.max("hkey")).first()[0] < 1 << 12


def test_shared_folder_is_needed_off_local_mode(monkeypatch):
    from curveloom import runtime

    class Ctx:
        master, _jsc = "yarn", None

    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf, sparkContext = Conf(), Ctx()

    class Jsc:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

    Ctx._jsc = Jsc()
    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())
