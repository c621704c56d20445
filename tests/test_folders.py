import random

import pytest

from noteforge.operators import indexing as ix


def test_descendants_of_deep_trees_and_of_cycles(spark):
    chain = [(f"f{i}", f"f{i - 1}" if i else None) for i in range(3000)]
    folders = spark.createDataFrame(chain, "id string, parent_id string")
    roots = spark.createDataFrame([("f0",), ("f2990",), ("elsewhere",)], "id string")
    got = {(x.root, x.id) for x in ix.descendants(folders, roots).collect()}
    assert got == {("f0", f"f{i}") for i in range(3000)} | {("f2990", f"f{i}") for i in range(2990, 3000)} | {("elsewhere", "elsewhere")}
    r = random.Random(1)
    tree = [(f"n{i}", f"n{r.randrange(i)}" if i and r.random() < 0.9 else r.choice([None, "gone"])) for i in range(60)]
    up = dict(tree)
    want = set()
    for i, _ in tree:
        at = i
        while at is not None:
            want.add((at, i))
            at = up.get(at)
    all_roots = spark.createDataFrame([(i,) for i, _ in tree] + [("gone",)], "id string")
    assert {(x.root, x.id) for x in ix.descendants(spark.createDataFrame(tree, "id string, parent_id string"), all_roots).collect()} == want | {("gone", "gone")}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None)], "id string, parent_id string")
    with pytest.raises(ValueError, match="cycle"):
        ix.descendants(ring, all_roots)
    assert ix.descendants(ring.limit(0), all_roots.limit(0)).count() == 0
