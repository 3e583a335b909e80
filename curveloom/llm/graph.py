"""Numpy kernels of the neighbour graph: projection trees, robust pruning, beam search. All loops run over steps, never over rows."""

from __future__ import annotations

import numpy as np


def fit_tree(sample: np.ndarray, rows: int, leaf: int, cap: int, radius: float, seed: int, tries: int = 24) -> list[tuple]:
    """Nodes ``(vector, threshold, left, right)`` of a projection tree; children >= 0 are nodes, negative ones leaves -1, -2, ...

    Cuts lie where the fewest sampled points are near the cut, so groups of near points mostly stay together. A part of at most ``cap`` rows that can't
    be cut without parting many neighbours stays whole; a larger one is cut at the best place there is. Parts of fewer than 16 sampled points are left
    to a sample of their own.
    """
    rng, nodes, leaves = np.random.default_rng(seed), [], 0
    width, scale = 0.12 * radius, rows / max(1, len(sample))
    todo = [(np.arange(len(sample)), None, 0)]
    while todo:
        own, parent, side = todo.pop()
        cut = None
        if len(own) * scale > leaf and len(own) >= 16:
            a, b = rng.integers(len(own), size=(2, tries))
            u = sample[own[a]] - sample[own[b]] + rng.normal(size=(tries, sample.shape[1])).astype(np.float32)
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            proj = sample[own] @ u.T
            best = np.inf
            lows = np.quantile(proj, np.linspace(0.1, 0.9, 33), axis=0)
            most = 0.3 if len(own) * scale <= cap else np.inf
            for t in range(tries):
                p = np.sort(proj[:, t])
                mids = lows[:, t]
                near = (np.searchsorted(p, mids + width) - np.searchsorted(p, mids - width)) / len(p)
                left = np.searchsorted(p, mids, side="right") / len(p)
                cost = near / np.minimum(left, 1 - left).clip(1e-9)
                cost[np.minimum(left, 1 - left) < 0.08] = np.inf
                i = int(np.argmin(cost))
                if cost[i] < best and near[i] < most:
                    best, cut = cost[i], (t, mids[i])
        if cut is None:
            leaves += 1
            me = -leaves
        else:
            t, thr = cut
            me = len(nodes)
            nodes.append([u[t].astype(np.float32), float(thr), None, None])
            go = proj[:, t] <= thr
            todo += [(own[go], me, 2), (own[~go], me, 3)]
        if parent is not None:
            nodes[parent][side] = me
    return [tuple(n) for n in nodes]


def apply_tree(nodes: list[tuple], x: np.ndarray, slack: float = -1.0, probes: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf number (from 0) of every row, and visits ``(row, leaf)``: the other side of each cut that lies within ``slack``, for the ``probes`` nearest cuts of a row."""
    at = np.zeros(len(x), np.int32)
    none = np.zeros(0, np.int64)
    if not nodes:
        return at, none, none
    todo, met = [(0, np.arange(len(x)), None)], []
    while todo:
        k, own, far = todo.pop()
        if not len(own):
            continue
        if k < 0:
            if far is None:
                at[own] = -k - 1
            else:
                met.append((own, np.full(len(own), -k - 1), far))
            continue
        vector, thr, left, right = nodes[k]
        off = x[own] @ np.asarray(vector, np.float32) - thr
        go = off <= 0
        todo += [(left, own[go], None if far is None else far[go]), (right, own[~go], None if far is None else far[~go])]
        if far is None and slack >= 0:
            near = np.abs(off) <= slack
            todo += [(right, own[near & go], -off[near & go]), (left, own[near & ~go], off[near & ~go])]
    if not met:
        return at, none, none
    row, leaf, far = (np.concatenate(v) for v in zip(*met, strict=True))
    o = np.lexsort((leaf, far, row))
    row, leaf = row[o], leaf[o]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < probes
    return at, row[keep], leaf[keep].astype(np.int64)


def _unique_sorted(ids: np.ndarray, d: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``width`` nearest distinct ids (id -1 is no entry)."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
    same = np.zeros(ids.shape, bool)
    same[:, 1:] = ids[:, 1:] == ids[:, :-1]
    d = np.where(same | (ids < 0), np.inf, d)
    if d.shape[1] > width:
        part = np.argpartition(d, width - 1, axis=1)[:, :width]
        ids, d = np.take_along_axis(ids, part, 1), np.take_along_axis(d, part, 1)
    order = np.argsort(d, axis=1, kind="stable")
    ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
    return np.where(np.isinf(d), -1, ids), d


def _dist(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    diff = x[ids] - q[:, None, :]
    return np.einsum("bmd,bmd->bm", diff, diff)


def seeds(x: np.ndarray, rng: np.random.Generator, keep: int, trees: int = 3, cell: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """First proposals: nearest rows inside small cells of a few random projection trees."""
    n, d = x.shape
    all_ids, all_d = [], []
    levels = max(0, int(np.ceil(np.log2(max(1, n / cell)))))
    size = int(np.ceil(n / 2**levels))
    for _ in range(trees):
        pad = size * 2**levels - n
        order = np.concatenate([rng.permutation(n), rng.integers(n, size=pad)]).reshape(1, -1)
        for _ in range(levels):
            k = order.shape[1]
            u = x[order[:, rng.integers(k)]] - x[order[:, rng.integers(k)]] + rng.normal(size=(len(order), d)).astype(np.float32)
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            proj = np.einsum("skd,sd->sk", x[order], u)
            order = np.take_along_axis(order, np.argsort(proj, axis=1), 1).reshape(len(order) * 2, -1)
        for lo in range(0, len(order), 512):
            o = order[lo : lo + 512]
            c = x[o]
            c = c - c.mean(axis=1, keepdims=True)  # small numbers keep their digits
            m = np.einsum("skd,skd->sk", c, c)
            g = m[:, :, None] + m[:, None, :] - 2 * (c @ c.transpose(0, 2, 1))
            g[o[:, :, None] == o[:, None, :]] = np.inf
            w = min(keep, g.shape[2])
            part = np.argpartition(g, w - 1, axis=2)[:, :, :w] if g.shape[2] > w else np.broadcast_to(np.arange(w), g.shape)
            ids = np.full((o.size, keep), -1, np.int32)
            ds = np.full((o.size, keep), np.inf, np.float32)
            ids[:, :w] = np.take_along_axis(np.broadcast_to(o[:, None, :], g.shape), part, 2).reshape(o.size, w)
            ds[:, :w] = np.take_along_axis(g, part, 2).reshape(o.size, w)
            all_ids.append((o.ravel(), ids)), all_d.append(ds)
    rows, ids, ds = np.concatenate([r for r, _ in all_ids]), np.concatenate([i for _, i in all_ids]), np.concatenate(all_d)
    order = np.argsort(rows, kind="stable")
    rows, ids, ds = rows[order], ids[order], ds[order]
    first = np.searchsorted(rows, np.arange(n))
    out, dist = np.full((n, trees * keep), -1, np.int32), np.full((n, trees * keep), np.inf, np.float32)
    for t in range(trees):  # padding repeats a row now and then; its further copies are left out
        at = np.minimum(first + t, len(rows) - 1)
        ok = rows[at] == np.arange(n)
        out[ok, t * keep : (t + 1) * keep], dist[ok, t * keep : (t + 1) * keep] = ids[at[ok]], ds[at[ok]]
    dist = np.where(out < 0, np.inf, dist)
    return _unique_sorted(out, dist, trees * keep)


def robust_prune(x: np.ndarray, own: np.ndarray, ids: np.ndarray, d: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Keep near and diverse neighbours: a candidate goes when a kept one is ``alpha`` times nearer to it than the point itself."""
    out = np.full((len(own), degree), -1, np.int32)
    for lo in range(0, len(own), 2048):
        i, dd = ids[lo : lo + 2048], d[lo : lo + 2048]
        c = x[np.maximum(i, 0)] - x[own[lo : lo + 2048], None]
        m = np.einsum("bmd,bmd->bm", c, c)
        g = m[:, :, None] + m[:, None, :] - 2 * (c @ c.transpose(0, 2, 1))
        alive = (i >= 0) & (i != own[lo : lo + 2048, None])
        b = np.arange(len(i))
        for r in range(degree):
            pick = np.argmax(alive, axis=1)
            has = alive[b, pick]
            if not has.any():
                break
            out[lo + b[has], r] = i[b[has], pick[has]]
            alive &= ~(alpha * alpha * g[b, pick] <= dd) | ~has[:, None]
            alive[b, pick] = False
    return out


def _both_ways(x: np.ndarray, nbrs: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Add the reverse of every edge, nearest first; lists that grow too long are pruned again."""
    n, r = nbrs.shape
    src, dst = np.repeat(np.arange(n, dtype=np.int32), r), nbrs.ravel()
    ok = dst >= 0
    src, dst = src[ok], dst[ok]
    diff = x[src] - x[dst]
    order = np.lexsort((np.einsum("nd,nd->n", diff, diff), dst))
    src, dst = src[order], dst[order]
    at = np.arange(len(dst)) - np.searchsorted(dst, dst)
    width = 2 * degree  # pruning keeps at most ``degree`` and prefers near ones, so it is given the nearest of a hub's many
    keep = at < width
    back = np.full((n, width), -1, np.int32)
    back[dst[keep], at[keep]] = src[keep]
    ids = np.concatenate([nbrs, back], axis=1)
    out = np.empty((n, degree), np.int32)
    for lo in range(0, n, 4096):
        i = ids[lo : lo + 4096]
        d = np.where(i >= 0, _dist(x, x[lo : lo + 4096], np.maximum(i, 0)), np.inf)
        i, d = _unique_sorted(i, d, 2 * degree + 8)
        out[lo : lo + 4096] = robust_prune(x, np.arange(lo, lo + len(i)), i, d, degree, alpha)
    return out


def beam_search(x: np.ndarray, nbrs: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search from ``start`` (rows of ids, -1 for none): expands the nearest unexpanded entries of the beam until none is left. Every row is
    measured once per query: ``stamp`` notes by which column it was met, which also tells repeats within a step."""
    n, degree = nbrs.shape
    out_i, out_d = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), np.inf, x.dtype)
    block = int(min(512, max(64, 8_000_000 // max(1, n))))
    pick_one = lambda v, o: np.take_along_axis(v, o, 1)
    for lo in range(0, len(q), block):
        qq, s = q[lo : lo + block], start[lo : lo + block]
        b = len(qq)
        stamp = np.full(b * n, -1, np.int16)

        def meet(row, cand, ok):
            """First mention of each candidate not met before, with its square distance."""
            place, col = row[:, None] * n + np.maximum(cand, 0), np.arange(cand.shape[1], dtype=np.int16)[None, :]
            ok = ok & (cand >= 0) & (stamp[place] < 0)
            stamp[place[ok]] = np.broadcast_to(col, ok.shape)[ok]
            i, j = np.nonzero(ok & (stamp[place] == col))
            ids = cand[i, j]
            diff = x[ids] - qq[row[i]]
            return i, ids, np.einsum("nd,nd->n", diff, diff)

        def lists(i, ids, d, rows, least):
            count = np.bincount(i, minlength=rows)
            wide = max(least, int(count.max(initial=0)))
            at = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            ni, nd = np.full((rows, wide), -1, np.int32), np.full((rows, wide), np.inf, x.dtype)
            ni[i, at], nd[i, at] = ids, d
            return ni, nd

        act = np.arange(b)
        ai, ad = lists(*meet(act, s, np.ones(s.shape, bool)), b, beam)
        if ai.shape[1] > beam:
            o = np.argpartition(ad, beam - 1, axis=1)[:, :beam]
            ai, ad = pick_one(ai, o), pick_one(ad, o)
        an = ai < 0
        ids, d = ai, ad
        while True:
            open_ = np.where(an, np.inf, ad)
            pick = np.argpartition(open_, width - 1, axis=1)[:, :width]
            live = np.isfinite(pick_one(open_, pick))
            some = live.any(axis=1)
            ids[act[~some]], d[act[~some]] = ai[~some], ad[~some]
            if not some.any():
                break
            act, ai, ad, an, pick, live = act[some], ai[some], ad[some], an[some], pick[some], live[some]
            k = np.arange(len(act))[:, None]
            an[k, pick] |= live
            nb = nbrs[np.where(live, ai[k, pick], 0)].reshape(len(act), -1)
            i, cand, dist = meet(act, nb, np.repeat(live, degree, axis=1))
            better = dist < ad.max(axis=1)[i]
            if better.any():
                ni, nd = lists(i[better], cand[better], dist[better], len(act), 1)
                ci, cd, ce = np.concatenate([ai, ni], 1), np.concatenate([ad, nd], 1), np.concatenate([an, ni < 0], 1)
                o = np.argpartition(cd, beam - 1, axis=1)[:, :beam]
                ai, ad, an = pick_one(ci, o), pick_one(cd, o), pick_one(ce, o)
        o = np.argsort(d, axis=1, kind="stable")
        d = pick_one(d, o)
        out_i[lo : lo + block], out_d[lo : lo + block] = np.where(np.isinf(d), -1, pick_one(ids, o)), d
    return out_i, out_d


def build(x: np.ndarray, degree: int, beam: int, alpha: float, seed: int) -> np.ndarray:
    """Robust-pruned directed graph over the rows of ``x`` (distinct vectors). The first graph, random in the published method, ties rows of small random
    cells; greedy searches from every row over it then propose the neighbours that relaxed pruning chooses from."""
    rng = np.random.default_rng(seed)
    n = len(x)
    if n == 1:
        return np.full((1, degree), -1, np.int32)
    ids, _ = seeds(x, rng, 8)
    d = np.concatenate([np.where(i >= 0, _dist(x, x[lo : lo + 4096], np.maximum(i, 0)), np.inf) for lo in range(0, n, 4096) for i in [ids[lo : lo + 4096]]])
    ids, d = _unique_sorted(ids, d, ids.shape[1])
    nbrs = robust_prune(x, np.arange(n), ids, d, degree, alpha)
    nbrs = _both_ways(x, nbrs, degree, alpha)
    start = np.concatenate([np.arange(n, dtype=np.int32)[:, None], ids[:, :8]], axis=1)
    ids, d = beam_search(x, nbrs, x, start, beam)
    nbrs = robust_prune(x, np.arange(n), ids, d, degree, alpha)
    return _both_ways(x, nbrs, degree, alpha)
