import random

import numpy as np
import pytest

from noteforge.llm import dedup
from noteforge.llm.components import connected_components


def brute(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split() if t else []
        m = min(k, len(w))
        sets.append({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def copies(seed, n, most):
    """Near copies of one text with growing shares of changed words, some other texts and exact copies."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(n):
        share = most * r.random()
        rows.append((i + 10, " ".join(f"x{r.randrange(10**9)}" if r.random() < share else w for w in base)))
    rows += [(i + 2000, " ".join(f"w{r.randrange(5000)}" for _ in range(60))) for i in range(20)]
    rows += [(5000, rows[3][1]), (5001, rows[-1][1].upper()), (1, ""), (2, "one"), (3, "One"), (4, "a b"), (5, " \n\t ")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rules", [dedup.NearDuplicates(shingle=4), dedup.NearDuplicates(shingle=4, block=7, most_pairs=3), dedup.NearDuplicates(shingle=4, block=16, most_pairs=10**6)])
def test_same_components_as_brute_force(make, rules):
    rows = copies(1, 90, 0.12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(make(rows), rules).collect()}
    assert got == brute(rows, 4)


def test_nulls_ties_and_empty(make, spark):
    rows = [(1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (4, "q " * 5000)]
    out = dedup.near_duplicates(make(rows)).collect()
    assert len(out) == 6
    assert {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 2), (3, 3), (None, 3), (4, 4)}
    assert dedup.near_duplicates(make(rows).limit(0)).count() == 0
    kept = dedup.keep_one(make(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4] and kept.columns == make(rows).columns


def test_one_row_of_each_component_whatever_its_id(make):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(None if i % 3 == 0 else i, text(i)) for i in range(30)]
    rows += [(100, text(1)), (100, text(100)), (None, text(2)), (None, text(3)), (101, text(101)), (101, text(102)), (101, text(101)), (102, ""), (102, ""), (None, None), (None, " ")]
    kept = dedup.keep_one(make(rows))
    got = sorted((r.doc_id or -1, r.text or "") for r in kept.collect())
    want = rows[:30] + [(100, text(100)), (101, text(101)), (101, text(102)), (102, ""), (None, None), (None, " ")]
    assert got == sorted((d or -1, t or "") for d, t in want) and kept.columns == make(rows).columns


def test_estimate_follows_similarity():
    a, b = dedup.functions(512)
    r = np.random.default_rng(0)
    x = np.unique(r.integers(0, 2**63, 1000, dtype=np.uint64))
    y = np.concatenate([x[:800], r.integers(0, 2**63, 200, dtype=np.uint64)])
    true = 800 / 1200
    assert abs(float(dedup.estimate(dedup.registers(x, a, b), dedup.registers(y, a, b))) - true) < 0.08


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).distinct().collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(30))
