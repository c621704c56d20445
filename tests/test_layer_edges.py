"""Edges of the semantic layer cost nothing where nobody reads them."""

from pyspark.sql import functions as F

from noteforge.operators import semantic as sm
from noteforge.plans import layers


def test_relations_write_no_edges(spark, monkeypatch):
    names, staged = [], sm.staged
    monkeypatch.setattr(sm, "staged", lambda df, name, *a: names.append(name) or staged(df, name, *a))
    entities = spark.createDataFrame([("n1", 1, "Ann", "person", None), ("n1", 2, "Bolt", "thing", 0.7), ("n2", 1, "ann", "person", None)], "note_id string, ord long, name string, type string, confidence double")
    relations = spark.createDataFrame([("n1", 1, "Ann", "Bolt", "owns", 0.9)], "note_id string, ord long, `from` string, `to` string, type string, confidence double")
    notes = entities.select("note_id").distinct()
    layer = sm.persist(layers._empty_layer(spark), notes, entities, relations, notes.withColumn("chunk_id", F.concat("note_id", F.lit(":0"))))
    assert layer.relations.count() == 1 and "edges" not in names
    assert sorted(r["type"] for r in layer.edges.collect()) == ["mention"] * 3 + ["relation"]
