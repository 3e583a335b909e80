import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from curveloom import datagen
from curveloom.functions import points as P
from curveloom.operators import balance, classify, knn, order, pairs, runs, stats
from curveloom.streaming.quantile import batch_quantile, follow, stream_quantile


def points(spark, x, y=None):
    y = y if y is not None else np.zeros(len(x), int)
    return spark.createDataFrame([(i, [int(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(x, y, strict=True))], "id bigint, coords array<int>, label int")


def test_characteristic_distance(spark):
    x = [0, 1, 2, 4, 5, 7, 8, 10, 11, 12, 14, 15, *range(200, 225, 3), 500, *range(800, 815, 2)]
    idx = points(spark, np.array(x)[:, None]).withColumn("pos", F.col("id"))
    gaps = runs.neighbor_distances(idx)
    for skip, want, counts in ((0, (25, 9, 4), (6, 3, 1)), (2, (23, 9, 4), (8, 3, 1))):
        r = runs.characteristic_distance(gaps, len(x), skip).first()
        assert (r.idx, r.s, r.median) == want
        d2 = np.square(np.diff(x))
        assert classify.jump(d2, skip) == 9
        c = runs.cluster_count(runs.islands(idx, gaps, r.s), 1).first()
        assert (c.clusters, c.outlier_points) == counts[1:]


def test_b_cubed(spark):
    gold = spark.createDataFrame([(i, g) for i, g in enumerate("aaabbc")], "id long, label string")
    found = spark.createDataFrame([(i, g) for i, g in enumerate("112223")], "id long, label string")
    r = stats.b_cubed(gold, found).first()
    assert abs(r.precision - 7 / 9) < 1e-12 and abs(r.recall - 7 / 9) < 1e-12 and abs(r.f - 7 / 9) < 1e-12


def test_grid_coarseness(spark):
    p = points(spark, np.array([(0, 0), (1, 1), (2, 3), (7, 7), (6, 7), (7, 0)]))
    got = {r.bit: r.coarseness for r in stats.grid_coarseness(p, 2, 3).collect()}
    assert abs(got[0] - 1) < 1e-12 and abs(got[1] - 4 / 15) < 1e-12 and abs(got[2] - 2 / 15) < 1e-12


def test_sparse_distances(spark):
    df = spark.createDataFrame([({5: 1, 7: 2, 10: 3, 15: 4}, {4: 4, 7: 3, 10: 2, 18: 1})], "a map<int,int>, b map<int,int>")
    d = P.square_distance(P.densify(F.col("a"), 20, F.lit(0)), P.densify(F.col("b"), 20, F.lit(0)))
    assert df.select(d).first()[0] == 36
    d = P.square_distance(P.densify(F.col("a"), 20, F.lit(1)), P.densify(F.col("b"), 20, F.lit(0)))
    assert df.select(d).first()[0] == 42
    drawn = df.select(P.densify_drawn(F.col("a"), 20, F.lit(3), F.array(F.lit(8), F.lit(9)))).first()[0]
    assert drawn[5] == 1 and set(drawn) <= {1, 2, 3, 4, 8, 9}


def test_kendall(spark):
    y = [*range(10)]
    y[4], y[5] = y[5], y[4]
    r = stats.kendall_tau(spark.createDataFrame([(i, i, v) for i, v in enumerate(y)], "id int, x int, y int")).first()
    assert abs(r.tau_b - 43 / 45) < 1e-12


def test_within_never_wrong(spark):
    x = datagen.uniform(80, 5, 1000, seed=2)
    a = points(spark, x).withColumn("m", P.square_magnitude(F.col("coords")))
    b = a.select(F.col("id").alias("j"), F.col("coords").alias("c"), F.col("m").alias("n"))
    bad = a.join(b, F.col("id") < F.col("j")).where(P.within(F.col("coords"), F.col("c"), F.col("m"), F.col("n"), F.lit(300_000)) != (P.square_distance(F.col("coords"), F.col("c")) <= 300_000))
    assert bad.count() == 0


def test_positions_and_knn(spark):
    x, y = datagen.gaussian_clusters(4, 8, (30, 50), seed=3)
    p = points(spark, x, y)
    idx = order.curve_index(p, 8, 10).cache()
    rows = idx.orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(x)))
    assert [(bytes(r.hkey), r.id) for r in rows] == sorted((bytes(r.hkey), r.id) for r in rows)
    q = p.where("id % 20 = 0")
    exact = knn.exact_knn(p, q, 5)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for r in exact.collect():
        o = sorted((int(v), i) for i, v in enumerate(d[r.q]) if i != r.q)
        assert (r.d2, r.id) == o[r["rank"] - 1]
    acc = knn.accuracy(knn.curve_knn(idx, q, 5, len(x)), exact, 5)
    assert acc.agg(F.min("accuracy")).first()[0] == 1.0
    assert knn.exact_knn(p.where("false"), q, 5).count() == 0 and knn.exact_knn(p, q.where("false"), 5).count() == 0


def test_closest_pair(spark):
    x, y = datagen.gaussian_clusters(3, 6, (20, 30), seed=5)
    p = points(spark, x, y)
    r = pairs.closest_pair(p, 0, 1).first()
    a, b = np.nonzero(y == 0)[0], np.nonzero(y == 1)[0]
    d = ((x[a][:, None] - x[b][None]) ** 2).sum(axis=2)
    assert r.d2 == d.min()
    assert pairs.closest_pair(p, 0, 99).count() == 0


def test_balance_keeps_range(spark):
    p = points(spark, datagen.uniform(200, 4, 900, seed=1))
    rows = balance.balance(p).collect()
    assert all(0 <= v < 1024 for r in rows for v in r.coords)
    assert balance.tendency(p, 3).first().points == 200


def test_classify(spark):
    x, y = datagen.gaussian_clusters(8, 30, (80, 150), seed=7)
    p = points(spark, x, y)
    labels, s = classify.curve_classify(p, 30, 10)
    assert s > 0 and labels.count() == len(x)
    assert stats.b_cubed(p, labels).first().f >= 0.99
    start = p.select("id", F.when(F.col("id") < 5, 7).alias("label"))
    again, _ = classify.curve_classify(p, 30, 10, start=start)
    assert len({r.label for r in again.where("id < 5").collect()}) == 1
    parts = classify.density_split(p, 30, 10, s)
    assert parts.count() == len(x)


def test_classify_tiny(spark):
    try:
        classify.curve_classify(points(spark, datagen.uniform(5, 3, 10)), 3, 4)
    except ValueError:
        return
    raise AssertionError


def test_quantile(spark, tmp_path):
    v = np.random.default_rng(1).permutation(1000)
    assert 400 <= follow((0, 1, 1, 0), v, 0.5)[0] <= 600
    df = spark.createDataFrame([(1, i, int(x)) for i, x in enumerate(v)] + [(2, 0, None), (2, 1, 7)], "k int, i int, v bigint")
    got = {r.k: (r.estimate, r.n) for r in batch_quantile(df, "k", "v", "i", 0.5).collect()}
    assert 400 <= got[1][0] <= 600 and got[1][1] == 1000 and got[2] == (7, 1)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_quantile(s, "k", "v", 0.5).writeStream.outputMode("update").format("memory").queryName("quantile").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert {r.k: r.n for r in spark.table("quantile").collect()} == {1: 1000, 2: 1}


def test_empty(spark):
    p = points(spark, np.zeros((0, 3), int))
    assert stats.centroids(p).count() == 0
    assert order.curve_index(p, 3, 4).count() == 0
    assert stats.partition_counts(p, 2).first().clusters == 0


def test_window_volume(spark):
    assert runs.window_volume(spark, 2, 3, 2) == 1.0  # two neighbours share an edge: volume 2 by window 2
