"""The recommender on small dense matrices, written without Spark: what the jobs must give."""

import numpy as np
import pandas as pd


def matrix(rows, users, items):
    m = pd.DataFrame(0, index=sorted(users), columns=sorted(items))
    for u, i, w in rows:
        m.loc[u, i] += w
    return m


def cosines(m):
    a = m.to_numpy(float)
    dots, n = a @ a.T, (a * a).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        c = dots / np.sqrt(n[:, None] * n[None, :])
    return pd.DataFrame(np.nan_to_num(c), index=m.index, columns=m.index)


def neighbors(m, k=5):
    out = []
    sim = cosines(m)
    for u in m.index:
        others = sorted((-sim.loc[u, v], v) for v in m.index if v != u)[:k]
        out += [(u, r, v, -c) for r, (c, v) in enumerate(others, 1)]
    return out


def ranking(m, user, k=5):
    near = [v for u, _, v, _ in neighbors(m, k) if u == user]
    total = m.loc[near].sum(axis=0)[m.loc[user] == 0]
    return sorted(((-w, i) for i, w in total.items()))


def pages(m, first, last, k=5):
    out = []
    for u in m.index:
        ranks = enumerate(ranking(m, u, k), 1)
        out += [(u, r, i, -w) for r, (w, i) in ranks if first <= r <= last]
    return out


def random_rows(seed, users=40, items=30, per_user=4, popular=0.4, copies=6):
    """Ratings with one item that many hold, groups of users with equal rows, users without."""
    rng = np.random.default_rng(seed)
    rows = {}
    for u in range(users):
        if u % 13 == 5:
            continue
        for i in rng.integers(3, items, rng.integers(0, per_user + 1)):
            rows[u, int(i)] = int(rng.integers(1, 12))
        for hot in range(3):
            if rng.random() < popular:
                rows[u, hot] = int(rng.choice([1, 10, 10, 11]))
    model = users // 2
    for u in range(users, users + copies):
        for (v, i), w in list(rows.items()):
            if v == model:
                rows[u, i] = w
    return [(u, i, w) for (u, i), w in rows.items()]
