"""The index of vectors: exact mode equals a full scan, the quick mode finds nine of ten, odd vectors have their cases."""

import random

import numpy as np
import pytest

from noteforge.operators import cells as ce
from noteforge.operators import retrieval as rt

VECTORS = "vec_id long, vector array<float>"
QUERIES = "query_id long, vector array<float>"


def rows(df):
    return sorted(map(tuple, df.select("query_id", "vec_id", "score", "rank").collect()))


def clustered(n, dim, groups, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    return [(i, (centres[i % groups] + r.normal(size=dim) * 0.6).tolist()) for i in range(n)]


def test_exact_mode_equals_a_full_scan_and_quick_mode_finds_nine_of_ten(spark, tmp_path):
    data = clustered(4000, 24, 40, 1)
    v, q = spark.createDataFrame(data, VECTORS), spark.createDataFrame(data[::50], QUERIES)
    kept = ce.build(spark, (tmp_path / "i").as_uri(), v)
    want = rows(rt.dense(q, v, 20))
    assert rows(kept.search(q, 20, exact=True)) == want
    quick = rows(rt.dense(q, v, 20, index=kept))
    assert len(quick) == len(want) and len({x[:2] for x in quick} & {x[:2] for x in want}) >= 0.9 * len(want)
    again = ce.load(spark, (tmp_path / "i").as_uri())
    assert rows(again.search(q, 20)) == quick and kept.probes < 10 and again.members.count() == 4000


def test_random_vectors_are_found_too(spark, tmp_path):
    """Without clusters the index looks into more cells: its number of cells is learnt from its own vectors."""
    r = np.random.default_rng(9)
    v = spark.createDataFrame([(i, r.normal(size=16).tolist()) for i in range(1500)], VECTORS)
    q = spark.createDataFrame([(i, r.normal(size=16).tolist()) for i in range(40)], QUERIES)
    kept = ce.build(spark, (tmp_path / "i").as_uri(), v)
    want = {x[:2] for x in rows(rt.dense(q, v, 20))}
    assert kept.probes > 8 and len({x[:2] for x in rows(kept.search(q, 20))} & want) >= 0.9 * len(want)


def test_copies_ties_and_odd_vectors(spark, tmp_path, monkeypatch):
    """A third of all rows is one vector; blocks are small, so the crowded cells have many."""
    monkeypatch.setattr(ce, "BLOCK", 8)
    monkeypatch.setattr(ce, "QUERIES", 3)
    r = random.Random(3)
    data = [(i, [1.0, 2.0, 0.0] if i % 3 == 0 else [float(r.randrange(-2, 3)) for _ in range(3)]) for i in range(300)]
    odd = [(900, None), (901, [1.0]), (902, [1.0, None, 2.0]), (903, [float("nan"), 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0]), (905, []), (906, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(r.sample(data + odd, len(data) + len(odd)), VECTORS)
    kept = ce.build(spark, (tmp_path / "i").as_uri(), v, fit=ce.Fit(trials=0))
    good = spark.createDataFrame(data + odd[-1:], VECTORS)
    asked = [(1, [1.0, 2.0, 0.0]), (2, [-1.0, 0.5, 2.0]), (3, [0.0, 0.0, 0.0]), (4, [0.0, 0.0, 5.0]), (5, [-1.0, -2.0, 0.0])]
    q = spark.createDataFrame(asked + [(6, None), (7, [1.0]), (8, [float("nan")] * 3)], QUERIES)
    for k in (7, 150):
        assert rows(kept.search(q, k, probes=1, exact=True)) == rows(rt.dense(spark.createDataFrame(asked, QUERIES), good, k)), k
    assert kept.search(q.limit(0), 5, exact=True).count() == 0


@pytest.mark.parametrize("data", [[], [(1, [0.0, 0.0])], [(5, [1.0, 1.0]), (4, [1.0, 1.0])]])
def test_few_vectors(spark, tmp_path, data):
    kept = ce.build(spark, (tmp_path / "i").as_uri(), spark.createDataFrame(data, VECTORS))
    q = spark.createDataFrame([(1, [1.0, 0.0])], QUERIES)
    want = [(1, i, round(float(v[0]) / max(np.hypot(*v), 1), 6), n) for n, (i, v) in enumerate(sorted(data), 1)]
    assert rows(kept.search(q, 3)) == rows(kept.search(q, 3, exact=True)) == want


def test_no_cells_of_queries_pass_the_driver(spark, tmp_path, monkeypatch):
    """Cells times queries outgrow both tables: whatever their bytes, no join sends them to every task by way of the driver."""
    data = clustered(600, 8, 6, 4)
    v, q = spark.createDataFrame(data, VECTORS), spark.createDataFrame(data[::10], QUERIES)
    plans, staged = {}, ce.staged
    monkeypatch.setattr(ce, "staged", lambda df, name, *a: plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, name, *a))
    kept = ce.build(spark, (tmp_path / "i").as_uri(), v)
    assert rows(kept.search(q, 5, exact=True)) == rows(rt.dense(q, v, 5))
    assert len(plans["scanned"]) == 4 and all("SortMergeJoin [cell" in p for p in plans["scanned"])
    assert all("ShuffledHashJoin [query_id" in p for p in plans["cells-of-queries"]) and all("SortMergeJoin [cell" in p for p in plans["class-scores"])
