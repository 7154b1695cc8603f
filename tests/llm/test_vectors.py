import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstats.llm import topk, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, links int"


@pytest.fixture
def embeddings(spark):
    draw = np.random.default_rng(8)
    base = draw.normal(size=(300, 24))
    near = base[:40].repeat(5, axis=0) + draw.normal(size=(200, 24)) * 0.25
    tight = base[0] + draw.normal(size=(300, 24)) * 0.05  # one large group
    rows = np.concatenate([base, near, tight, base[5:8], 2 * base[5:8]]).astype(np.float32)
    return rows


def frame(spark, rows, extra=()):
    listed = [(i, [float(x) for x in row], 0, 0) for i, row in enumerate(rows)]
    return spark.createDataFrame([*listed, *extra], SCHEMA)


ODD = [
    (10_001, None, 0, 0),
    (10_002, [0.0] * 24, 0, 0),
    (10_003, [float("nan")] + [1.0] * 23, 0, 0),
    (10_004, [None] + [1.0] * 23, 0, 0),
    (10_005, [float("inf")] + [1.0] * 23, 0, 0),
    (10_006, [], 0, 0),
    (10_050, None, 0, 0),
    (None, [1.0] * 24, 0, 0),
]


def test_links_equal_brute_force(spark, embeddings):
    units = embeddings.astype(float)
    units /= np.linalg.norm(units, axis=1)[:, None]
    linked = units @ units.T >= 0.95
    np.fill_diagonal(linked, False)
    root = np.arange(len(units))
    for _ in range(len(units)):
        low = np.minimum(root, np.where(linked, root, len(root)).min(axis=1))
        if (low == root).all():
            break
        root = low
    found = {r["vec_id"]: r for r in vectors.near_vectors(frame(spark, embeddings, ODD)).collect()}
    assert len(found) == len(embeddings) + len(ODD)
    links = np.array([found[i]["n_links"] for i in range(len(units))])
    assert (links <= linked.sum(axis=1)).all()
    assert links.sum() >= 0.995 * linked.sum()
    assert np.mean([found[i]["component_id"] == root[i] for i in range(len(units))]) > 0.99
    for vec_id, *_ in ODD:
        row = found[vec_id]
        assert (row["n_links"], row["component_id"], row["kept"]) == (0, vec_id, True)


def test_repeated_vectors_count_and_no_rows(spark):
    rows = [(3, [1.0, 2.0], 0, 0), (1, [1.0, 2.0], 0, 0), (1, [1.0, 2.0], 0, 0), (9, [2.0, 4.0], 0, 0), (4, [-1.0, 2.0], 0, 0)]
    found = vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [
        (1, 3, 1), (1, 3, 1), (3, 3, 1), (4, 0, 4), (9, 3, 1)
    ]
    empty = spark.createDataFrame([], SCHEMA)
    assert vectors.near_vectors(empty).count() == 0
    assert topk.top_k(empty, F.col("vec_id") % 50 == 0).count() == 0


def test_blocks_of_a_large_bucket(spark, embeddings, monkeypatch):
    once = sorted(vectors.near_vectors(frame(spark, embeddings)).collect())
    monkeypatch.setattr(vectors, "BLOCK", 16)
    assert sorted(vectors.near_vectors(frame(spark, embeddings)).collect()) == once


def test_hadamard_keeps_lengths():
    rows = np.random.default_rng(1).normal(size=(5, 64))
    turned = vectors.hadamard(rows)
    assert np.linalg.norm(turned, axis=1) == pytest.approx(np.linalg.norm(rows, axis=1))
    assert vectors.hadamard(turned) == pytest.approx(rows)


def brute_top(rows, ids, query, k):
    whole = np.floor(256 * rows.astype(float))
    at = ids.index(query)
    scores = sorted((-int(whole[at] @ whole[j]), ids[j]) for j in range(len(ids)) if ids[j] != query)
    return [(query, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]


@pytest.mark.parametrize("k", [1, 5, 2000])
def test_top_k_equals_brute_force(spark, embeddings, k, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    monkeypatch.setattr(topk, "QUERIES", 5)
    rows = np.concatenate([embeddings, np.zeros((30, 24), np.float32)])  # ties
    found = topk.top_k(frame(spark, rows, ODD[:1] + ODD[2:5] + ODD[6:]), F.col("vec_id") % 50 == 0, k)
    ids = list(range(len(rows)))
    expected = [x for q in ids if q % 50 == 0 for x in brute_top(rows, ids, q, k)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_top_k_of_few_and_of_large_numbers(spark):
    rows = [(0, [1e30, 1.0], 0, 0), (50, [1.0, 2.0], 0, 0)]
    frame = spark.createDataFrame(rows[1:], SCHEMA)
    assert topk.top_k(frame, F.col("vec_id") % 50 == 0).count() == 0
    rows = [(0, [2.0**23, 1.0, 3.0], 0, 0), (1, [2.0**23, 1.0], 0, 0), (2, [2.0**23 - 1, 1.0], 0, 0)]
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(1, 2**62 + 2**16), (2, 2**62 - 2**39 + 2**16)]


def test_top_k_with_repeated_query_rows(spark):
    draw = np.random.default_rng(5)
    rows = draw.normal(size=(400, 40)).astype(np.float32)
    listed = [(i + 1, [float(x) for x in row], 0, 0) for i, row in enumerate(rows)]
    query = (0, [4 * float(x) for x in rows[0]], 0, 0)
    found = topk.top_k(spark.createDataFrame([*listed, *[query] * 8], SCHEMA), F.col("vec_id") == 0, 5).collect()
    units = np.floor(256.0 * rows.astype(float))
    scores = units @ np.floor(256.0 * 4 * rows[0].astype(float))
    best = sorted(zip((-scores).astype(int).tolist(), range(1, 401), strict=True))[:5]
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [
        (k + 1, i, -s) for k, (s, i) in enumerate(best)
    ]


def test_scores_beyond_a_long(spark):
    rows = [(0, [1e15, 1.0], 0, 0), (1, [1e15, 2.0], 0, 0), (2, [-1e15, 1.0], 0, 0), (3, [1e15, 9.0], 0, 0), (4, [0.0, 1.0], 0, 0)]
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [
        (1, 1, 2**63 - 1), (2, 3, 2**63 - 1), (3, 4, 65536), (4, 2, 1 - 2**63)
    ]


def test_near_vectors_in_slices(spark, embeddings, monkeypatch):
    """A group whose links are many times what is compared at once."""
    once = sorted(vectors.near_vectors(frame(spark, embeddings)).collect())
    monkeypatch.setattr(vectors, "PAIRS", 7)
    assert sorted(vectors.near_vectors(frame(spark, embeddings)).collect()) == once


def test_block_of_mutually_near_vectors_stays_small():
    import tracemalloc

    import pandas as pd

    draw = np.random.default_rng(3)
    units = draw.normal(size=16) + draw.normal(size=(1024, 16)) * 0.01
    units /= np.linalg.norm(units, axis=1)[:, None]
    codes = np.zeros((vectors.TABLES, 1 + vectors.PROBES), np.int64).tobytes()
    rows = pd.DataFrame({
        "id": np.arange(1024), "tab": 0, "code": 0, "primary": True, "block": 0, "low": 0, "high": 0,
        "copies": 1, "unit": [u.tobytes() for u in units], "packed": [codes] * 1024,
    })
    tracemalloc.start()
    found = vectors.compare(rows, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found["links"] == 1023).all() and (found["root"] == 0).all()
    assert peak < 120 << 20
