import numpy as np

from curveloom import datagen as G


def test_shapes_of_point_sets():
    x, y = G.gaussian_clusters(4, 6, (20, 30), seed=1)
    f = G.filaments(x, y, 10, 2)
    assert f.shape == (40, 6) and f.min() >= 0 and f.max() <= 1000 and len(G.filaments(x, np.zeros(len(x)), 10, 2)) == 0
    a, k = G.overlapping_pair(8, 200, 0.25, seed=2)
    gap = np.linalg.norm(a[k == 0].mean(axis=0) - a[k == 1].mean(axis=0))
    assert abs(gap - 0.75 * 80 * 8**0.5) < 20
    p = G.line(50, np.array([0, 0]), np.array([100, 200]))
    assert np.abs(p[:, 1] - 2 * p[:, 0]).max() <= 2
    c = np.corrcoef(G.correlated(4000, 3, 0.7, seed=3).T)
    assert abs(c[0, 1] - 0.7) < 0.05
    e = G.linear_combinations(x, 2)
    assert e.shape[1] == 8 and (e[:, 6] >= x.min(axis=1) - 1).all() and (e[:, 6] <= x.max(axis=1) + 1).all()
    z = np.bincount(G.zipf(20_000, 50, 1.0, seed=4))
    assert z[0] == 0 and len(z) <= 51 and 1.7 < z[1] / z[2] < 2.3
    assert (G.zipf(100, 50, 1.0, seed=4) == G.zipf(100, 50, 1.0, seed=4)).all()
