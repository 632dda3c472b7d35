import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillet.llm import topk_search as t

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k=10):
    usable = {}
    whole = []
    for vec_id, v, *_ in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(1024 * float(np.float32(x))) for x in v]
        whole.append((vec_id, ints))
        if vec_id % 100 == 0:
            usable[vec_id] = ints
    out = []
    for query, q in usable.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in whole if i != query)
        out += [(query, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def got(spark, rows):
    df = t.digest(spark.createDataFrame(rows, SCHEMA))
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def vectors(n, d, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.lognormal(0, 1, (n, 1)) * scale
    return [(i, [float(np.float32(v)) for v in x[i]], 0, "x") for i in range(n)]


def test_equals_brute_force_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(t, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(t, "QUERY_BLOCK", 3)
    monkeypatch.setattr(t, "STEP", 16)
    rows = vectors(900, 12, 1)
    assert got(spark, rows) == brute(rows)


def test_ties_nulls_short_and_special_vectors(spark):
    rows = vectors(150, 4, 2)
    same = [0.5, 0.25, -0.5, 1.0]
    rows += [(i, same, 0, "x") for i in range(200, 260)]  # ties beyond k, and a query among them
    rows += [(None, same, 0, "x"), (300, None, 0, "x"), (301, [0.1, None, 0.2, 0.3], 0, "x")]
    rows += [(400, [float("nan"), 1.0, 1.0, 1.0], 0, "x"), (401, [float("inf")] * 4, 0, "x")]
    rows += [(500, [2.0, 1.0], 0, "x"), (501, [], 0, "x"), (600, [0.0] * 4, 0, "x"), (700, [-1.0] * 4, 0, "x")]
    assert got(spark, rows) == brute(rows)


def test_repeated_rows(spark):
    rows = vectors(120, 3, 3)
    rows += [rows[7], rows[7]]
    assert got(spark, rows) == brute(rows)
    twice = [*rows, rows[100]]  # a repeated query counts once, and is no candidate of its own
    assert [x for x in got(spark, twice) if x[0] == 100] == [x for x in brute(rows) if x[0] == 100]


@pytest.mark.parametrize("rows", [[], [(5, [1.0], 0, "x")], [(100, [1.0], 0, "x")], [(100, None, 0, "x")], [(100, [], 0, "x")]])
def test_few_rows(spark, rows):
    assert got(spark, rows) == brute(rows) == []


def test_rotation_keeps_inner_products(spark):
    rows = spark.createDataFrame(vectors(60, 6, 4), SCHEMA)
    turn = t.rotation(t.integers(rows, "vec_id", "embedding"), 6)
    assert np.allclose(turn @ turn.T, np.eye(6))


def test_other_query_sets(spark):
    rows = vectors(40, 3, 5)
    found = t.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") < 2, k=3).collect()
    assert len(found) == 6 and {r["query_id"] for r in found} == {0, 1}


def test_blocks_are_dealt_to_tasks_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(t, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(t, "QUERY_BLOCK", 2)
    monkeypatch.setattr(t, "TILE_BYTES", 3 * 4 * 12)
    monkeypatch.setattr(t, "SHARD_BYTES", 200 * 4 * 12)
    rows = vectors(900, 12, 6)
    df = t.digest(spark.createDataFrame(rows, SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan  # blocks of queries or vectors would go through the driver
    assert sorted(map(tuple, df.collect())) == brute(rows)


@pytest.mark.parametrize(("bend", "scale", "pruned"), [(0.0, 1, False), (2.0, 1, True), (2.0, 1 << 13, True), (0.0, 1 << 13, False)])
def test_tile_equals_all_scores(monkeypatch, bend, scale, pruned):
    monkeypatch.setattr(t, "QUERY_STEP", 100)
    monkeypatch.setattr(t, "TRIAL_STEPS", 1)
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(3000, 32)) * 1000 * scale * np.arange(1, 33) ** -bend)
    x = x[np.argsort(-(x * x).sum(axis=1))]
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    ids = rng.permutation(3000)
    ids[5] = ids[6]
    mine = rng.permutation(3000)[:250]
    tile = t.Tile(ids[mine], x[mine], np.full(250, -np.inf), turn, 10)
    heads = set()
    for at in range(0, 3000, 700):
        tile.scan(ids[at : at + 700], x[at : at + 700])
        heads.add(tile.head)
    assert any(heads) == pruned
    score = x[mine] @ x.T
    score[ids[mine][:, None] == ids] = -np.inf
    for i, s in enumerate(score):
        best = np.lexsort((ids, -s))[:10]
        assert tile.found[i].tolist() == ids[best].tolist() and tile.score[i].tolist() == s[best].tolist()
    assert not tile.scan(np.array([7000]), np.zeros((1, 32)))


def test_integers_are_kept_in_the_smallest_type():
    for most, kind in ((32767, "<i2"), (-32768, "<i4"), (2**31 - 1, "<i4"), (2.0**40, "<f8")):
        got = t._narrow(np.array([[0.0, most]]))
        assert got.dtype.str == kind and got.tolist() == [[0, most]]
