import hashlib
import math
import random

import numpy as np
import pytest

from gridstats.llm import centroids

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def lloyd(rows, k, rounds, dim, scale, seed):
    """Plain rounds in Python integers over (vec_id, components)."""
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x):
            kept.append((vec_id, [math.floor(scale * v) for v in x]))
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i, x) for i, x in kept if i is not None)
    points = [x for _, _, x in starts[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(points))

    for _ in range(rounds):
        found = [nearest(x)[1] for _, x in kept]
        for n in range(len(points)):
            own = [x for (_, x), m in zip(kept, found, strict=True) if m == n]
            if own:
                points[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [(i, *nearest(x)[::-1]) for i, x in kept]
    sums = [sum(d for _, m, d in last if m == n) for n in range(len(points))]
    longest = 2**63 - 1
    return sorted(
        (
            (
                i,
                n,
                min(d, longest),
                min(sums[n], longest),
                min(sum(sums), longest),
                hashlib.sha256(",".join(map(str, points[n])).encode()).hexdigest(),
            )
            for i, n, d in last
        ),
        key=str,
    )


def compare(spark, rows, **how):
    frame = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)
    for name in ("cluster", "near", "upper", "whole", "distance"):  # clashing names
        frame = frame.selectExpr("*", f"label as `{name}`")
    found = sorted((tuple(r) for r in centroids.clustered(frame, **how).collect()), key=str)
    assert found == lloyd(rows, **how)
    return found


HOW = {"k": 8, "rounds": 6, "dim": 4, "scale": 16, "seed": 3}


def test_equals_plain_rounds(spark):
    draw = random.Random(1)
    rows = [(i, [draw.gauss(draw.choice([-2, 0, 3]), 0.7) for _ in range(4)]) for i in range(600)]
    compare(spark, rows, **HOW)


def test_ties_and_repeats(spark):
    """A small grid of integers has many equal distances, and rows that occur many times."""
    draw = random.Random(2)
    rows = [(i // 2, [draw.randint(0, 2) / 16 for _ in range(4)]) for i in range(300)]
    rows += [(500 + i, rows[0][1]) for i in range(200)]
    by_id = {}
    rows = [(i, by_id.setdefault(i, x)) for i, x in rows]  # rows that share an id are equal here
    compare(spark, rows, **HOW)


def test_odd_rows(spark):
    draw = random.Random(3)
    rows = [(i, [draw.random() for _ in range(4)]) for i in range(20)]
    rows += [(30, None), (31, []), (32, [1.0, None, 2.0, 3.0]), (33, [math.nan, 0.0, 0.0, 0.0])]
    rows += [(34, [math.inf, 0.0, 0.0, 0.0]), (35, [1.0] * 5), (None, [0.5] * 4), (36, [0.0] * 4), (37, [-0.01] * 4)]
    found = compare(spark, rows, **HOW)
    assert len(found) == 23


def test_large_numbers(spark):
    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1) * 10.0 ** draw.choice([0, 6, 12, 20]) for _ in range(4)]) for i in range(60)]
    found = compare(spark, rows, **HOW)
    assert any(r[4] == 2**63 - 1 for r in found)


@pytest.mark.parametrize("count", [0, 1, 3])
def test_fewer_rows_than_clusters(spark, count):
    rows = [(i, [float(i)] * 4) for i in range(count)]
    assert len(compare(spark, rows, **HOW) if count else centroids.clustered(
        spark.createDataFrame([], SCHEMA), **HOW).collect()) == count


def test_bounds_spare_rows():
    """After a small move most rows are not searched again, and the answer is that of all distances."""
    draw = np.random.default_rng(5)
    rows = np.floor(1024 * draw.normal(size=(2000, 8)) + 4096 * draw.integers(0, 6, size=(2000, 1))).astype(np.int64)
    points = centroids.Centroids([rows[i].copy() for i in range(0, 2000, 125)])
    state = np.zeros(2000, int), np.full(2000, -1), np.full(2000, np.inf), np.zeros(2000)
    state = centroids.assigned(rows, *state, points)
    later = centroids.Centroids([p + 3 for p in points.points])
    moved = later.moved_from(points)
    near, second, upper, lower = state
    upper, lower = upper + moved[near], np.maximum(lower - moved.max(), 0)
    spared = (upper < np.maximum(lower, later.half[near] * (1 - centroids.MARGIN))).mean()
    assert spared > 0.5
    state = centroids.assigned(rows, near, second, upper, lower, later)
    exact = np.stack([centroids.squared(rows, p) for p in later.points], axis=1)
    assert (state[0] == exact.argmin(axis=1)).all()
    own = np.take_along_axis(exact, state[0][:, None], axis=1)[:, 0]
    np.put_along_axis(exact, state[0][:, None], np.iinfo(np.int64).max, axis=1)
    assert (state[2] ** 2 >= own).all() and (state[3] ** 2 <= exact.min(axis=1)).all()
