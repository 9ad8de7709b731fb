"""Near-duplicate vectors against a plain version."""

import math
from collections import Counter

import numpy as np
import pytest

from attesta.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, cosine=0.98):
    able = [k for k, (_, v, la) in enumerate(rows) if la is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    n = [0] * len(rows)
    groups = {}
    for k in able:
        groups.setdefault((rows[k][2], len(rows[k][1])), []).append(k)
    for members in groups.values():
        x = np.array([rows[k][1] for k in members])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1)), strict=True):
            a, b = members[i], members[j]
            n[a] += 1
            n[b] += 1
            up[top(a)] = top(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        t = top(k)
        least[t] = min((x for x in (least.get(t), i) if x is not None), default=None)
    return Counter((i, n[k], least[top(k)], i == least[top(k)]) for k, (i, *_) in enumerate(rows))


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return Counter(tuple(r) for r in vector_dedup.link(df, **more).collect())


def cloud(seed, n=900, width=24, labels=3):
    """Single vectors, chains of near ones, and groups of near and of equal copies; half of all rows have one label."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        rows.append(rng.normal(size=width))
    for _ in range(25):
        v = rng.normal(size=width)
        for _ in range(int(rng.integers(2, 9))):
            rows.append(v.copy())
            v = v + 0.16 * rng.normal(size=width)  # near the threshold
    hub = rng.normal(size=width)
    rows += [hub + 0.02 * rng.normal(size=width) for _ in range(150)]
    rows += [hub] * 60 + [3.0 * hub] * 5
    label = np.where(rng.random(len(rows)) < 0.5, 0, rng.integers(0, labels, len(rows)))
    ids = rng.permutation(len(rows))
    return [(int(i), v.tolist(), int(la)) for i, v, la in zip(ids, rows, label, strict=True)]


@pytest.mark.parametrize("tile", [16, 2048])
def test_links(spark, tile):
    rows = cloud(1)
    got = result(spark, rows, tile=tile)
    assert got == plain(rows)
    assert sum(k[1] > 0 for k in got) > 150
    assert sum(not k[3] for k in got) > 100


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, [1.0, 0.0, 0.0], 1), (6, None, 1), (7, [], 1), (8, [0.0, -0.0], 1), (9, [nan, 1.0], 1),
        (10, [inf, 1.0], 1), (11, [None, 1.0], 1), (None, [1.0, 0.1], 1), (None, [0.0, 1.0], 2), (None, None, None), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (12, [0.0, 1.0], 1),
        (13, [1e-200, 1e-200], 3), (14, [1e200, 1e200], 3), (15, [-1.0, -1.0], 3), (16, [5.0], 4), (17, [5.0], 4), (18, [-5.0], 4), (19, [5e-324, 0.0], 5), (20, [1e308, 1e300], 5),
    ]
    assert result(spark, rows) == plain(rows)
    assert result(spark, []) == Counter()
    assert result(spark, rows[3:4]) == Counter({(4, 0, 4, True): 1})


def test_other_columns(spark):
    rows = cloud(2, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.withColumns({c: df["vec_id"] for c in ("id", "m", "key", "kept", "t", "width", "n_links", "component_id", "linked")})
    assert Counter(tuple(r) for r in vector_dedup.query(more).collect()) == plain(rows)


def test_tiles_keep_apart(spark):
    """Clusters far from each other never meet; no link is lost by that."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + 0.05 * rng.normal(size=(64, 16)) for c in centres])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame([(0, "0", 1, v, i) for i, v, _ in rows], "least long, label_key string, m long, v array<double>, id long")
    axes = vector_dedup.axes_of(df)
    tiles = vector_dedup.tiles_of(df, axes, 32)
    met, n = vector_dedup.meeting(tiles, 0.98).count(), tiles.count()
    assert met < n * (n - 1) / 2 / 5
    assert result(spark, rows, tile=32) == plain(rows)


def test_bounds_leave_pairs_early():
    """Squares of unlike vectors are left on the leading axes; like ones are all found."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 64)) * np.linspace(3, 0.1, 64)
    x[100] = x[7] + 0.001
    axes = {64: vector_dedup.Axes(x)}
    i, j = vector_dedup.tile_links(x, None, axes, 0.98)
    assert (i.tolist(), j.tolist()) == ([7], [100])
    placed = axes[64].place(x)
    first = placed[:, :8] @ placed[:, :8].T + np.outer(*[vector_dedup._suffixes(placed)[:, 8]] * 2)
    assert (first >= 0.98).mean() < 0.05
