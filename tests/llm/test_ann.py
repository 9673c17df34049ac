import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and i is not None]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            scores = sorted((-float((v * w).sum()), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out.setdefault(q, []).append([(i, pytest.approx(-s, abs=1e-9)) for s, i in scores])
    return out


def found(df, **more):
    out = {}
    for r in ann.search(df, is_query=F.col("vec_id") % 20 == 0, **more).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def sample(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    v = centres[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, dims))
    return [(i, [float(np.float32(x)) for x in v[i]], 0) for i in range(n)]


def test_exact_neighbours(spark):
    rows = sample(900, 16, 1, 0.4)
    rows += [(1000, None, 0), (1020, [], 0), (1040, [0.0] * 16, 0), (1060, [float("nan")] + [1.0] * 15, 0), (1080, [float("inf")] + [1.0] * 15, 0), (1100, [None] + [1.0] * 15, 0), (1120, [1.0, 2.0], 0), (1121, [2.0, 1.0], 0), (None, [1.0] * 16, 0)]
    random.Random(2).shuffle(rows)
    want = brute(rows, 20)
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(5), window=16, split_points=100, split_queries=20)
    assert got.keys() == want.keys()
    for q, (expected,) in want.items():
        assert [(i, s) for _, i, s in got[q]] == expected and [r for r, _, _ in got[q]] == list(range(1, len(expected) + 1))
    assert len(got[1120]) == 1


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0, 0.0], 0) for i in range(300)] + [(500 + i, [0.5, 0.5, float(i % 3)], 0) for i in range(60)]
    got, want = found(spark.createDataFrame(rows, SCHEMA)), brute(rows, 20)
    assert {q: [(i, s) for _, i, s in v] for q, v in got.items()} == {q: v[0] for q, v in want.items()}
    assert [i for _, i, _ in got[40]] == list(range(20)) and [i for _, i, _ in got[0]] == list(range(1, 21))


def test_windows_alone_reach_the_recall_on_clusters(spark):
    rows = sample(3000, 24, 3, 0.05)
    want = brute(rows, 20)
    got = found(spark.createDataFrame(rows, SCHEMA), exact=False, window=128, curves=8)
    hits = sum(len({i for i, _ in want[q][0]} & {i for _, i, _ in got.get(q, [])}) for q in want)
    assert hits / sum(len(v[0]) for v in want.values()) >= 0.9


def test_what_the_windows_find_without_structure(spark):
    """Independent directions in many dimensions: the windows alone find part of the neighbours, the check the rest."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(rng.standard_normal((3000, 64)))]
    want, df = brute(rows, 20), spark.createDataFrame(rows, SCHEMA)
    total = sum(len(v[0]) for v in want.values())
    recall = lambda got: sum(len({i for i, _ in want[q][0]} & {i for _, i, _ in got.get(q, [])}) for q in want) / total
    assert 0.5 < recall(found(df, exact=False)) and recall(found(df)) == 1.0


def test_clashing_columns_and_long_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(3000)], 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("point", "query", "v", "h", "score", "rank", "split", "n"):
        df = df.withColumn(name, F.lit("x"))
    assert {q: [(i, s) for _, i, s in v] for q, v in found(df).items()} == {q: v[0] for q, v in brute(rows, 20).items()}


def test_few_and_none(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame([(20, [1.0, 2.0], 0)], SCHEMA)) == {}
    assert [x[1] for x in found(spark.createDataFrame([(20, [1.0, 2.0], 0), (20, [1.0, 2.0], 0), (21, [3.0, 1.0], 1)], SCHEMA))[20]] == [21, 21]


def test_hilbert_keys_walk_the_grid():
    bits, n = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    keys = ann.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(1 << bits * n))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
