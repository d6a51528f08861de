"""Numeric kernels on data whose size the gene axis or the segment table bounds."""

from __future__ import annotations

import numpy as np


def smoothing_width(n: int, window: int) -> int:
    return max(10, min(window, n // 3 + 1))


def smoothing_matrix(n: int, window: int) -> np.ndarray:
    """K[i, j]: weight of gene j in the smoothed value of gene i; beyond an end its value repeats."""
    w = smoothing_width(n, window)
    at = np.clip(np.arange(n)[:, None] + np.arange(-(w // 2), w - w // 2)[None, :], 0, n - 1)
    k = np.zeros((n, n))
    np.add.at(k, (np.repeat(np.arange(n), w), at.ravel()), 1.0 / w)
    return k


def breakpoints(x: np.ndarray, penalty: float, least: int) -> list[int]:
    """Ends of the segments that minimise squared error plus ``penalty`` a segment, each of at least ``least``.

    Exact optimal partitioning; ties go to the earliest last break.
    """
    n = len(x)
    s = np.concatenate([[0.0], np.cumsum(x)])
    q = np.concatenate([[0.0], np.cumsum(x * x)])
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    last = np.zeros(n + 1, int)
    for end in range(least, n + 1):
        start = np.arange(0, end - least + 1)
        cost = q[end] - q[start] - (s[end] - s[start]) ** 2 / (end - start)
        total = best[start] + cost + penalty
        at = int(np.argmin(total))
        best[end], last[end] = total[at], start[at]
    out, end = [], n
    while end > 0:
        out.append(end)
        end = int(last[end])
    return out[::-1]


def segment_chromosome(signal: np.ndarray, penalty_coef: float, min_seg_genes: int) -> list[tuple[int, int]]:
    """(start, end) of the segments of one chromosome; too short ones merge into the one before, or vanish if first."""
    n = len(signal)
    least = max(min_seg_genes, 2)
    std = float(np.std(signal)) if n else 0.0
    if n < 2 * least or std < 1e-4:
        ends = [n] if n else []
    else:
        ends = breakpoints((signal - np.median(signal)) / std, penalty_coef * np.log(max(n, 2)), least)
    out: list[tuple[int, int]] = []
    at = 0
    for end in ends:
        if end - at < min_seg_genes:
            if out:
                out[-1] = (out[-1][0], end)
        else:
            out.append((at, end))
        at = end
    return out


def two_gaussians(x: np.ndarray, steps: int = 100, tol: float = 1e-3, floor: float = 1e-6):
    """(weights, means, variances) of two components by EM from a quantile-seeded 2-means split; the first has the smaller mean."""
    x = np.sort(np.asarray(x, float))
    a, b = np.quantile(x, [0.1, 0.9])
    for _ in range(100):
        cut = (a + b) / 2
        low = x <= cut
        if low.all() or not low.any():
            low = np.arange(len(x)) < max(1, len(x) // 2)
        na, nb = x[low].mean(), x[~low].mean() if (~low).any() else x[low].mean()
        if (na, nb) == (a, b):
            break
        a, b = na, nb
    r = np.stack([low, ~low]).astype(float)
    before = -np.inf
    for _ in range(steps):
        n = r.sum(1) + 10 * np.finfo(float).eps
        w, m = n / len(x), r @ x / n
        v = (r * (x - m[:, None]) ** 2).sum(1) / n + floor
        log = np.log(w)[:, None] - 0.5 * (np.log(2 * np.pi * v)[:, None] + (x - m[:, None]) ** 2 / v[:, None])
        top = log.max(0)
        total = top + np.log(np.exp(log - top).sum(0))
        r = np.exp(log - total)
        if abs(total.mean() - before) < tol:
            break
        before = total.mean()
    o = np.argsort(m, kind="stable")
    return w[o], m[o], v[o]


def posterior_high(x: np.ndarray, mix) -> np.ndarray:
    """Probability of the component of the larger mean."""
    w, m, v = mix
    log = np.log(w)[:, None] - 0.5 * (np.log(v)[:, None] + (np.asarray(x)[None, :] - m[:, None]) ** 2 / v[:, None])
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def principal_components(x: np.ndarray, k: int) -> np.ndarray:
    x = x - x.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, :k] * s[:k]


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> list[dict[int, float]]:
    """Symmetric k-nearest-neighbour graph, one dict a row, in blocks of rows."""
    n = len(x)
    k = min(k, n - 1)
    norm = (x * x).sum(1)
    out: list[dict[int, float]] = [{} for _ in range(n)]
    for a in range(0, n, block):
        d = norm[a : a + block, None] + norm[None, :] - 2 * x[a : a + block] @ x.T
        d[np.arange(d.shape[0]), np.arange(a, a + d.shape[0])] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        for i, row in enumerate(near, a):
            for j in row.tolist():
                out[i][j] = out[j][i] = 1.0
    return out


def communities(graph: list[dict[int, float]], resolution: float, rounds: int = 10) -> np.ndarray:
    """Modularity communities by local moves and aggregation, in a fixed order."""
    own = np.arange(len(graph))
    g = graph
    total = sum(sum(d.values()) for d in g) or 1.0
    loops = np.zeros(len(g))
    for _ in range(rounds):
        n = len(g)
        com = list(range(n))
        deg = np.array([sum(d.values()) for d in g]) + loops
        mass = deg.copy()
        moved_any = False
        for _ in range(20):
            moved = False
            for i in range(n):
                links: dict[int, float] = {}
                for j, w in g[i].items():
                    links[com[j]] = links.get(com[j], 0.0) + w
                c = com[i]
                mass[c] -= deg[i]
                gain = lambda k: links.get(k, 0.0) - resolution * deg[i] * mass[k] / total  # noqa: B023, E731
                best, score = c, gain(c)
                for k in sorted(links):
                    if (s := gain(k)) > score + 1e-12:
                        best, score = k, s
                mass[best] += deg[i]
                if best != c:
                    com[i], moved, moved_any = best, True, True
            if not moved:
                break
        names = {c: k for k, c in enumerate(sorted(set(com)))}
        com = [names[c] for c in com]
        own = np.array([com[i] for i in own])
        if not moved_any or len(names) == n:
            break
        new: list[dict[int, float]] = [{} for _ in names]
        inner = np.zeros(len(names))
        for i, d in enumerate(g):
            inner[com[i]] += loops[i]
            for j, w in d.items():
                if com[i] == com[j]:
                    inner[com[i]] += w
                else:
                    new[com[i]][com[j]] = new[com[i]].get(com[j], 0.0) + w
        g, loops = new, inner
    return own


def ward_order(x: np.ndarray, most: int) -> np.ndarray:
    """Leaf order of Ward clustering by nearest-neighbour chains; identity below 3 or above ``most`` rows."""
    n = len(x)
    if n < 3 or n > most:
        return np.arange(n)
    size, mid, leaves = {i: 1 for i in range(n)}, {i: x[i].astype(float) for i in range(n)}, {i: [i] for i in range(n)}
    chain: list[int] = []
    nxt = n
    while len(size) > 1:
        if not chain:
            chain.append(min(size))
        a = chain[-1]
        keys = [k for k in size if k != a]
        m = np.array([mid[k] for k in keys])
        s = np.array([size[k] for k in keys])
        d = ((m - mid[a]) ** 2).sum(1) * size[a] * s / (size[a] + s)
        b = keys[int(np.argmin(d))]
        if len(chain) > 1 and d[keys.index(chain[-2])] <= d.min():
            b = chain[-2]
            chain = chain[:-2]
            total = size[a] + size[b]
            first, second = (a, b) if min(leaves[a]) < min(leaves[b]) else (b, a)
            mid[nxt] = (size[a] * mid[a] + size[b] * mid[b]) / total
            leaves[nxt] = leaves[first] + leaves[second]
            size[nxt] = total
            for k in (a, b):
                del size[k], mid[k], leaves[k]
            nxt += 1
        else:
            chain.append(b)
    return np.array(next(iter(leaves.values())))
