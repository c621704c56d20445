"""Canonical entities against the plain loop, overlaps and mixed answers."""

import hashlib
import json
import random

import numpy as np
from pyspark.sql import functions as F

from noteforge.operators import canonical as cn
from noteforge.operators import extraction as xt
from noteforge.operators import indexing as ix
from noteforge.operators import semantic as sm


def loop(rows, threshold, have=()):
    """One entity after another against all canonical ones so far."""
    unit = lambda v: None if not v or not np.linalg.norm(v) else np.asarray(v, float) / np.linalg.norm(v)
    canonical = [(k, unit(v)) for k, v in have]
    out = {}
    for _, key, v in sorted(rows):
        u = unit(v)
        scores = [round(float(u @ w), 12) if u is not None and w is not None and len(u) == len(w) else -1 for _, w in canonical]
        best = max(scores, default=-1)
        if best > threshold:
            out[key] = canonical[scores.index(best)][0]
        else:
            out[key] = key
            canonical.append((key, u))
    return out


def clusters(r, n, dim, spread):
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(max(1, n // 12))]
    return [[x + r.gauss(0, spread) for x in r.choice(centres)] for _ in range(n)]


def test_merge_equals_the_plain_loop(spark):
    r = random.Random(1)
    vectors = clusters(r, 260, 8, 0.4) + clusters(r, 20, 5, 0.4)
    vectors += [vectors[7]] * 60 + [[0.0] * 8, [], [2 * x for x in vectors[9]]]
    order = r.sample(range(10_000), len(vectors))
    rows = [(o, f"k{o}", v) for o, v in zip(order, vectors)] + [(20_000, "none", None)]
    have = [("old1", vectors[3]), ("old2", vectors[30]), ("old3", vectors[3])]
    df = spark.createDataFrame(rows, "ord long, key string, vector array<double>").repartition(7).withColumn("id", F.lit("clash"))
    known = spark.createDataFrame(have, "key string, vector array<double>")
    for rules in (cn.Near(first=20, block=50), cn.Near(), cn.Near(exact=False, bits=2, bands=60, first=40)):
        assert {x.key: x.canonical for x in cn.greedy_merge(df, None, rules).collect()} == loop(rows, 0.85)
    assert {x.key: x.canonical for x in cn.greedy_merge(df, known, cn.Near(first=50)).collect()} == loop(rows, 0.85, have)
    assert cn.greedy_merge(df.limit(0), known).count() == 0


def test_recall_of_the_bands(spark):
    r = random.Random(2)
    rows = [(i, v) for i, v in enumerate(clusters(r, 3000, 32, 0.28))]
    df = spark.createDataFrame(rows, "id long, v array<double>").select("id", F.lit(32).alias("dim"), cn.unit_vector(F.col("v")).alias("unit")).cache()
    found = [{(x.l, x.r) for x in cn.near_pairs(df, df, rules, earlier=True).collect()} for rules in (cn.Near(), cn.Near(exact=False))]
    assert found[1] <= found[0] and len(found[0]) > 1000 and len(found[1]) >= 0.9 * len(found[0])


def test_a_dense_cluster_does_not_list_its_pairs(spark):
    """Half of the entities lie around one point: later prefixes leave them out, so few pairs are compared in rounds."""
    r = random.Random(3)
    rows = [(i, f"k{i}", [1.0 + r.gauss(0, 0.01), r.gauss(0, 0.01)] if i % 2 else [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(800)]
    df = spark.createDataFrame(rows, "ord long, key string, vector array<double>")
    assert {x.key: x.canonical for x in cn.greedy_merge(df, None, cn.Near(first=16)).collect()} == loop(rows, 0.85)


def test_persist_merges_names_by_their_vectors(spark):
    entities = spark.createDataFrame([("n1", 0, "Berlin", "place", 0.5), ("n1", 1, "Paris", "place", None), ("n2", 0, "berlin city", "town", 0.9), ("n2", 1, "Old Rome", "place", 0.2), ("n3", 0, "Solo", "x", 0.1)], "note_id string, ord long, name string, type string, confidence double")
    relations = spark.createDataFrame([("n2", 0, "Berlin City", "Old Rome", "near", 0.7), ("n1", 0, "Berlin", "Paris", "near", 0.3)], "note_id string, ord long, `from` string, `to` string, type string, confidence double")
    vectors = spark.createDataFrame([("berlin", [1.0, 0.0]), ("berlin city", [0.99, 0.1]), ("paris", [0.0, 1.0]), ("old rome", [-1.0, 0.05]), ("rome", [-1.0, 0.0])], "key string, vector array<double>")
    empty = lambda ddl: spark.createDataFrame([], ddl)
    have = spark.createDataFrame([(f"ent_{hashlib.sha256(b"rome").hexdigest()[:16]}", "rome", "place", 0.4, ["Rome"])], "entity_id string, canonical_name string, type string, confidence double, aliases array<string>")
    layer = sm.Layer(have, empty("relation_id string, source_entity_id string, target_entity_id string, relation_type string, confidence double"), empty("relation_id string, chunk_id string, note_id string"), empty("id string, layer string, source_id string, target_id string, type string, weight double, source string"))
    notes = spark.createDataFrame([("n1",), ("n2",), ("n3",)], "note_id string")
    new = sm.persist(layer, notes, entities, relations, notes.withColumn("chunk_id", F.concat("note_id", F.lit(":0"))), vectors)
    got = {x.canonical_name: (sorted(x.aliases), x.confidence) for x in new.entities.collect()}
    assert got == {"rome": (["Old Rome", "Rome"], 0.4), "berlin": (["Berlin", "berlin city"], 0.9), "paris": (["Paris"], 0.6), "solo": (["Solo"], 0.1)}
    names = {x.entity_id: x.canonical_name for x in new.entities.collect()}
    assert {(names[x.source_entity_id], names[x.target_entity_id]) for x in new.relations.collect()} == {("berlin", "rome"), ("berlin", "paris")}
    mentions = {(x.source_id, names[x.target_id.removeprefix("entity:")]) for x in new.edges.where("type = 'mention'").collect()}
    assert ("note:n2", "berlin") in mentions and ("note:n2", "rome") in mentions
    plain = sm.persist(layer, notes, entities, relations, notes.withColumn("chunk_id", F.lit("c")))
    assert plain.entities.count() == 6


def test_overlap_keeps_the_blanks_of_the_tail():
    """The rule as the survey states it: the raw tail is prefixed; only the comparison looks behind its blanks."""
    first = "a" * 1500 + "\n\n" + "b" * 395 + " " + "c" * 100
    raw, out = ix.chunk_texts("", first + "\n\n" + "d" * 300, most=2000, overlap=101)
    assert raw[0].endswith("c" * 100) and out[1] == " " + "c" * 100 + "\n\n" + raw[1]
    again = "x" * 1980 + " " + "start of the next one"
    raw, out = ix.chunk_texts("", again + "\n\n" + "start of the next one and more " * 10, most=2002, overlap=22)
    assert raw[1].startswith("start of the next one") and out[1] == raw[1]
    raw, out = ix.chunk_texts("", again + "\n\n" + "start of the next one and more " * 10, most=2002, overlap=20)
    assert out[1] == again[-20:] + "\n\n" + raw[1]
    assert ix.chunk_texts("", again + "\n\n" + "z" * 100, most=2002, overlap=0)[1][1] == "z" * 100


def test_malformed_items_go_and_good_ones_stay_in_both_readers(spark):
    good = {"name": "A", "type": "t", "confidence": 0.5}
    answers = [
        json.dumps({"entities": ["x", good, 5, None, [good], {"name": 5}, {"name": "B"}, {"name": " "}, {"name": "C", "type": 7, "confidence": "0.5"}, {"name": "D", "confidence": True}, {"name": "E", "type": "", "confidence": 2}], "relations": [{"from": "A", "to": "B", "type": "r"}, {"from": "A", "to": 1, "type": "r"}, 3, {"from": "A", "to": "B"}, {"from": " ", "to": "B", "type": "r", "confidence": 1e-3}]}),
        json.dumps({"entities": good, "relations": "none"}), json.dumps([good]), "5", "null", "", "no json", "```json\n" + json.dumps({"entities": [good]}) + "\n```", '  ```\n{"entities": [{"name": "é \\"q\\""}]}\n```  \n', '{"entities": [{"name": "A", "name": "B"}]}', '{"entities": [{"name": "A", "confidence": NaN}]}',
    ]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)] + [(99, None)], "i long, a string")
    for x in df.select("i", xt.read_extraction(F.col("a")).alias("x"), xt.extraction_errors(xt.read_extraction(F.col("a"))).alias("e")).collect():
        if x.i == 99:
            assert not x.x.entities and not x.x.relations
            continue
        want = xt.parse_result(answers[x.i])
        got = {k: [{f: v for f, v in item.asDict().items() if v is not None} for item in x.x[k]] for k in ("entities", "relations")}
        assert got == want and x.e == xt.result_errors(want), answers[x.i]
    first = xt.parse_result(answers[0])
    assert [e["name"] for e in first["entities"]] == ["A", "B", " ", "C", "D", "E"] and [e["type"] for e in first["entities"]] == ["t", "unknown", "unknown", "unknown", "unknown", ""]
    assert xt.result_errors(first) == ["entity 2: blank name", "relation 1: blank from"]
