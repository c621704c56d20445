"""Queries of the structural index, the semantic layer, chats and event rules, over tables that stand in for notes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from noteforge.functions import text as tx
from noteforge.operators import chats as ch
from noteforge.operators import extraction as xt
from noteforge.operators import indexing as ix
from noteforge.operators import runs as rn
from noteforge.operators import semantic as sm
from noteforge.operators.retrieval import _hint
from noteforge.plans.catalog import _ENT, NOW, _events, _linked, _messages, query
from noteforge.sources import notes as src
from noteforge.sources.staging import staged
from noteforge.streaming import events as ev

# Structural index: parts as notes that link their name (their own title's earliest part) and brand; the brand is a tag too.


def _part_notes(spark, d):
    n = _linked(spark, d)
    return n.select("note_id", "title", "body", F.timestamp_micros(F.col("created_at") * 1_000_000).cast("timestamp_ntz").alias("created_at"))


def _brands(spark, d):
    return src.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("note_id"), F.col("p_brand").alias("tag_id"), F.upper("p_brand").alias("title"))


_TITLES = "t AS (SELECT lower(trim(p_name)) AS key, arg_min(p_partkey::VARCHAR, p_partkey) AS target FROM part GROUP BY ALL), l AS (SELECT p_partkey::VARCHAR AS note_id, target FROM part JOIN t ON key = lower(trim(p_name)))"


@query(f"""WITH {_TITLES} SELECT 'note:' || note_id || '->note:' || target || ':link' AS id, 'link' AS type, 1.0::DOUBLE AS weight FROM l UNION ALL SELECT 'note:' || target || '->note:' || note_id || ':backlink', 'backlink', 1.0 FROM l
UNION ALL SELECT 'note:' || p_partkey || '->tag:' || p_brand || ':tag', 'tag', 1.0 FROM part""")
def structural_edges(spark, d):
    n = _part_notes(spark, d)
    return ix.structural_edges(ix.resolve_links(ix.wiki_links(n), n), _brands(spark, d)).select("id", "type", "weight")


@query("SELECT 'note:' || p_partkey AS id, 'note' AS kind, p_name AS label, p_partkey::VARCHAR AS note_id FROM part UNION ALL SELECT DISTINCT 'tag:' || p_brand, 'entity', upper(p_brand), NULL FROM part")
def structural_nodes(spark, d):
    return ix.structural_nodes(_part_notes(spark, d), _brands(spark, d)).select("id", "kind", "label", "note_id")


@query("SELECT 'note:' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS label FROM part UNION ALL SELECT 'note:new' || p_partkey, p_name FROM part WHERE p_partkey % 7 = 0")
def upsert_nodes(spark, d):
    none = spark.createDataFrame([], "note_id string, tag_id string, title string")
    n = _part_notes(spark, d)
    old = ix.structural_nodes(n, none)
    k = F.col("note_id").cast("long")
    changed = n.where(k % 2 == 0).withColumn("title", F.upper("title")).union(n.where(k % 7 == 0).withColumn("note_id", F.concat(F.lit("new"), "note_id")))
    return ix.upsert_nodes(old, ix.structural_nodes(changed, none)).select("id", "label")


@query(f"""WITH {_TITLES}, gone AS (SELECT p_partkey::VARCHAR AS note_id FROM part WHERE p_size <= 10), e AS (SELECT 'note:' || note_id || '->note:' || target || ':link' AS id, note_id AS s, '' AS b FROM l UNION ALL SELECT 'note:' || target || '->note:' || note_id || ':backlink', target, note_id FROM l
UNION ALL SELECT 'note:' || p_partkey || '->tag:' || p_brand || ':tag', p_partkey::VARCHAR, '' FROM part) SELECT id FROM e WHERE s NOT IN (SELECT note_id FROM gone) AND b NOT IN (SELECT note_id FROM gone)""")
def drop_structural_edges(spark, d):
    n = _part_notes(spark, d)
    edges = ix.structural_edges(ix.resolve_links(ix.wiki_links(n), n), _brands(spark, d))
    gone = src.table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").cast("string").alias("note_id"))
    return ix.drop_structural(edges, gone).select("id")


def _indexed(spark, d):
    """Two runs: the first over all parts, the second over everything after parts of size 1 went and names of even keys changed."""
    now = F.lit(NOW).cast("timestamp_ntz")
    n, tags = _part_notes(spark, d), _brands(spark, d)
    first = ix.index_notes(ix.empty_tables(spark), n, n, tags, now)
    left = n.join(src.table(spark, d, "part").where("p_size > 1").select(F.col("p_partkey").cast("string").alias("note_id")), "note_id", "left_semi")
    changed = left.withColumn("title", F.when(F.col("note_id").cast("long") % 2 == 0, F.concat("title", F.lit(" new"))).otherwise(F.col("title")))
    return ix.index_notes(first.tables, changed, changed, tags, now, everything=True)


_CHANGED = "n AS (SELECT p_partkey::VARCHAR AS note_id, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' new' ELSE '' END AS title, 'see [[' || p_name || ']] and [[' || p_brand || '|brand]] or [[' || upper(p_name) || ']]' AS body FROM part WHERE p_size > 1)"


@query(f"WITH {_CHANGED} SELECT note_id || ':0' AS chunk_id, '# ' || title || chr(10) || chr(10) || body AS content FROM n")
def index_run_chunks(spark, d):
    return _indexed(spark, d).tables.chunks.select("chunk_id", "content")


@query(f"WITH {_CHANGED} SELECT note_id, sha256(title || chr(10) || body) AS content_hash, 'success' AS structural_status, 'stub' AS embedding_model FROM n")
def index_run_state(spark, d):
    return _indexed(spark, d).tables.state.select("note_id", "content_hash", "structural_status", "embedding_model")


@query("SELECT (SELECT count(*) FROM part WHERE p_size > 1 AND p_partkey % 2 = 0) AS processed, (SELECT count(*) FROM part WHERE p_size > 1 AND p_partkey % 2 = 1) AS skipped, (SELECT count(*) FROM part WHERE p_size = 1) AS purged, (SELECT count(*) FROM part WHERE p_size > 1) AS vectors")
def index_run_counts(spark, d):
    r = _indexed(spark, d)
    return spark.createDataFrame([(r.processed, r.skipped, r.purged, r.tables.vectors.count())], "processed long, skipped long, purged long, vectors long")


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS content FROM embeddings WHERE vec_id % 3 <> 1")
def chunk_replace(spark, d):
    """Notes of remainder 0 and 1 run again; those of 1 have no chunks any more."""
    e = src.table(spark, d, "embeddings").select("vec_id")
    old = e.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 3).alias("note"), F.lit("old").alias("content"))
    new = old.where("note = 0").withColumn("content", F.lit("new"))
    return ix.replace_for(ix.purge(old, spark.range(2).select(F.col("id").alias("note")), "note"), new, "note").select("chunk_id", "content")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'done' END AS semantic_status, 'success' AS structural_status, CASE WHEN doc_id % 2 = 0 THEN 'm' END AS extraction_model FROM documents")
def semantic_state_merge(spark, d):
    none = F.lit(None).cast("string")
    old = src.table(spark, d, "documents").select("doc_id", none.alias("semantic_status"), F.lit("success").alias("structural_status"), none.alias("extraction_model"))
    new = old.where("doc_id % 2 = 0").select("doc_id", F.lit("done").alias("semantic_status"), F.lit("m").alias("extraction_model"))
    return ix.merge(old, new, ["doc_id"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'old' ELSE 'new' END AS origin FROM part")
def insert_or_ignore(spark, d):
    p = src.table(spark, d, "part").select("p_partkey")
    old = p.where("p_partkey % 3 = 0").withColumn("origin", F.lit("old"))
    return ix.insert_missing(old, p.union(p).withColumn("origin", F.lit("new")), ["p_partkey"])


# Semantic layer: orders as notes; a line relates its supplier to its part by the return flag.


def _lines(spark, d):
    p = src.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    s = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    l = src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount")
    return staged(l.join(_hint(p, judged=p.select("l_partkey")), "l_partkey").join(_hint(s), "l_suppkey"), "lines")


def _extracted(lines):
    note, ord_, none = F.col("l_orderkey").cast("string").alias("note_id"), F.col("l_linenumber").cast("long").alias("ord"), F.lit(None).cast("double").alias("confidence")
    e = lines.select(note, ord_, F.col("s_name").alias("name"), F.lit("supplier").alias("type"), none).union(lines.select(note, ord_ + 100, F.upper("p_name"), F.lit("part"), none))
    r = lines.select(note, ord_, F.col("s_name").alias("from"), F.concat(F.lit(" "), "p_name", F.lit(".")).alias("to"), F.col("l_returnflag").alias("type"), (F.col("l_discount") * 8).alias("confidence"))
    return e, r


def _empty_layer(spark):
    make = lambda ddl: spark.createDataFrame([], ddl)
    return sm.Layer(
        make("entity_id string, canonical_name string, type string, confidence double, aliases array<string>"),
        make("relation_id string, source_entity_id string, target_entity_id string, relation_type string, confidence double"),
        make("relation_id string, chunk_id string, note_id string"),
        make("id string, layer string, source_id string, target_id string, type string, weight double, source string"),
    )


def _layer(spark, d):
    lines = _lines(spark, d)
    e, r = _extracted(lines)
    notes = e.select("note_id").distinct()
    return sm.persist(_empty_layer(spark), notes, e, r, notes.select("note_id", F.concat("note_id", F.lit(":0")).alias("chunk_id")))


_ID = "'ent_' || substr(sha256({0}), 1, 16)"
LINES = f"""x AS MATERIALIZED (SELECT l_orderkey::VARCHAR AS note_id, s_name, p_name, lower(l_returnflag) AS kind, l_discount * 8 AS c, {_ENT.format('s_name')} AS sk, {_ENT.format('p_name')} AS pk FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
y AS (SELECT *, {_ID.format('sk')} AS a, {_ID.format('pk')} AS b FROM x), z AS MATERIALIZED (SELECT *, 'rel_' || substr(sha256(a || '|' || b || '|' || kind), 1, 16) AS relation_id FROM y)"""
RELATIONS = f"{LINES}, rel AS (SELECT relation_id, a AS source_entity_id, b AS target_entity_id, kind AS relation_type, round(greatest(1 - pow(0.4, count(DISTINCT note_id)), max(c)), 6) AS confidence FROM z GROUP BY ALL)"


@query(f"WITH {RELATIONS} SELECT * FROM rel")
def semantic_relations(spark, d):
    return _layer(spark, d).relations


@query(f"WITH {RELATIONS} SELECT 'entity:' || source_entity_id || '->entity:' || target_entity_id || ':relation' AS id, 'relation' AS type, max(confidence) AS weight FROM rel GROUP BY ALL UNION ALL SELECT DISTINCT 'note:' || note_id || '->entity:' || e || ':mention', 'mention', 1.0 FROM (SELECT note_id, a AS e FROM z UNION ALL SELECT note_id, b FROM z)")
def semantic_edges(spark, d):
    return _layer(spark, d).edges.select("id", "type", "weight")


@query(f"WITH {LINES} SELECT e AS entity_id, n AS canonical_name, t AS type, 0.6::DOUBLE AS confidence, alias FROM (SELECT a AS e, sk AS n, 'supplier' AS t, string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS alias FROM z GROUP BY ALL UNION ALL SELECT b, pk, 'part', string_agg(DISTINCT upper(p_name), '|' ORDER BY upper(p_name)) FROM z GROUP BY ALL)")
def semantic_entities(spark, d):
    return _layer(spark, d).entities.withColumn("alias", F.array_join("aliases", "|")).drop("aliases")


@query(f"WITH {LINES}, k AS (SELECT * FROM z WHERE note_id NOT IN (SELECT o_orderkey::VARCHAR FROM orders WHERE o_orderstatus = 'F')) SELECT relation_id, round(1 - pow(0.4, count(DISTINCT note_id)), 6) AS confidence FROM k GROUP BY relation_id")
def semantic_purge(spark, d):
    """Relations after all notes of a status went: recomputed from the evidence that is left."""
    gone = src.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("note_id"))
    return sm.purge_notes(_layer(spark, d), gone).relations.select("relation_id", "confidence")


_MERGED = f"""{RELATIONS}, m AS (SELECT {_ID.format(_ENT.format('s1.s_name'))} AS absorbed, {_ID.format(_ENT.format('s2.s_name'))} AS surviving FROM supplier s1 JOIN supplier s2 ON s2.s_suppkey = s1.s_suppkey - 1 WHERE s1.s_suppkey % 2 = 0),
w AS (SELECT z.note_id, coalesce(m.surviving, z.a) AS a, z.b, z.kind, rel.confidence FROM z JOIN rel USING (relation_id) LEFT JOIN m ON m.absorbed = z.a)"""


@query(f"WITH {_MERGED} SELECT 'rel_' || substr(sha256(a || '|' || b || '|' || kind), 1, 16) AS relation_id, a AS source_entity_id, b AS target_entity_id, round(greatest(1 - pow(0.4, count(DISTINCT note_id)), max(confidence)), 6) AS confidence FROM w GROUP BY a, b, kind")
def entity_merge(spark, d):
    """Suppliers of even keys go into their predecessors."""
    layer = _layer(spark, d)
    s = src.table(spark, d, "supplier").select("s_suppkey", tx.entity_id(tx.entity_key(F.col("s_name"))).alias("e"))
    pairs = s.where("s_suppkey % 2 = 0").select((F.col("s_suppkey") - 1).alias("k"), F.col("e").alias("absorbed")).join(s.select(F.col("s_suppkey").alias("k"), F.col("e").alias("surviving")), "k").drop("k")
    nodes = layer.entities.select(F.concat(F.lit("entity:"), "entity_id").alias("id"), "entity_id")
    return sm.merge_into(layer, pairs, nodes)[0].relations.select("relation_id", "source_entity_id", "target_entity_id", "confidence")


@query("SELECT l_orderkey::VARCHAR AS note_id, l_partkey::VARCHAR AS entity_id FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 2) a FULL JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber >= 2) b USING (l_orderkey, l_partkey) WHERE a.l_orderkey IS NULL OR b.l_orderkey IS NULL")
def affected_entities(spark, d):
    l = src.table(spark, d, "lineitem").select("l_linenumber", F.col("l_orderkey").cast("string").alias("note_id"), F.col("l_partkey").cast("string").alias("entity_id"))
    return sm.affected(l.where("l_linenumber <= 2"), l.where("l_linenumber >= 2"))


@query("SELECT DISTINCT l_orderkey::VARCHAR AS note_id, l_partkey::VARCHAR AS entity_id FROM lineitem WHERE l_returnflag <> 'R'")
def entities_of_notes(spark, d):
    l = src.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("note_id"), F.col("l_partkey").cast("string").alias("entity_id"), "l_returnflag")
    edges = sm.mention_edges(l.select("note_id", "entity_id"))
    kept = sm.mention_edges(l.where("l_returnflag <> 'R'").select("note_id", "entity_id"))
    return sm.entities_of_notes(kept.union(edges.limit(50).withColumn("type", F.lit("relation"))))


@query("SELECT DISTINCT l_partkey AS relation_id, l_suppkey AS chunk_id, min(l_orderkey) AS note_id FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY ALL")
def evidence_add_remove(spark, d):
    """Evidence of lines one by one, each (relation, chunk) once, without that of some chunks."""
    l = src.table(spark, d, "lineitem").select(F.col("l_partkey").alias("relation_id"), F.col("l_suppkey").alias("chunk_id"), F.col("l_orderkey").alias("note_id"))
    have = sm.add_evidence(l.limit(0), l)
    return sm.remove_evidence(have, l.where("chunk_id % 5 = 0").select("chunk_id"), "chunk_id")


@query(f"WITH e AS (SELECT l_orderkey, l_linenumber, p_name AS name, l_discount, {_ENT.format('p_name')} AS key FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT l_orderkey::VARCHAR AS note_id, key, arg_min(name, l_linenumber) AS name, max(l_discount) AS confidence FROM e WHERE key <> '' GROUP BY ALL")
def entities_merged(spark, d):
    e = _lines(spark, d).select(F.col("l_orderkey").cast("string").alias("note_id"), F.col("l_linenumber").cast("long").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("l_discount").alias("confidence"))
    return xt.merge_entities(e).select("note_id", "key", "name", "confidence")


@query(f"WITH {LINES} SELECT note_id, sk AS from_key, pk AS to_key, kind, max(c) AS confidence FROM z GROUP BY ALL")
def relations_merged(spark, d):
    _, r = _extracted(_lines(spark, d))
    return xt.merge_relations(r).select("note_id", "from_key", "to_key", "kind", "confidence")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'entity 1: blank name|relation 0: blank to' WHEN 1 THEN '' ELSE 'relation 0: blank from|relation 0: blank type' END AS errors FROM orders")
def extraction_errors(spark, d):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, '{"entities":[{"name":"A","type":"t"},{"name":" "}],"relations":[{"from":"A","to":"","type":"r"}]}').when(k == 1, "no json").otherwise('```json\n{"entities":[],"relations":[{"from":" ","to":"B","type":""},{"to":"C"}]}\n```')
    return src.table(spark, d, "orders").select("o_orderkey", F.array_join(xt.extraction_errors(xt.read_extraction(raw)), "|").alias("errors"))


#: Lists in which good items stand among others of every JSON kind; both sides put them together from the order's columns.
_MIXED = """'{"entities":[' || array_to_string([
  '"' || o_orderstatus || '"', '{"name":"' || o_custkey || '","type":"' || o_orderpriority || '","confidence":0.' || o_orderkey % 10 || '}', 'null', '{"name":' || o_custkey || '}', '[]', '{"name":"b","type":' || o_custkey || ',"confidence":"0.9"}', '{"type":"t"}', '{"name":null}', 'true', '{"name":"c","confidence":1}'
][o_orderkey % 10 + 1:], ',') || '],"relations":' || (CASE WHEN o_orderkey % 7 = 0 THEN '{"from":"a"}' ELSE '[7,{"from":"a","to":"' || o_custkey || '","type":"r","confidence":' || o_custkey || '},{"from":"a","to":"b"},{"from":"a","to":1,"type":"r"},"x"]' END) || '}'"""


@query(f"""WITH r AS (SELECT o_orderkey, {_MIXED} AS raw FROM orders),
e AS (SELECT o_orderkey, json_transform_strict(raw->'entities', '["JSON"]') AS es, CASE WHEN json_type(raw, '$.relations') = 'ARRAY' THEN json_transform_strict(raw->'relations', '["JSON"]') ELSE [] END AS rs FROM r),
k AS (SELECT o_orderkey, list_filter(es, lambda x: json_type(x, '$.name') = 'VARCHAR') AS es, list_filter(rs, lambda x: json_type(x, '$.from') = 'VARCHAR' AND json_type(x, '$.to') = 'VARCHAR' AND json_type(x, '$.type') = 'VARCHAR') AS rs FROM e)
SELECT o_orderkey, array_to_string(list_transform(es, lambda x: x->>'name'), '|') AS names, array_to_string(list_transform(es, lambda x: CASE WHEN json_type(x, '$.type') = 'VARCHAR' THEN x->>'type' ELSE 'unknown' END), '|') AS types,
  array_to_string(list_transform(es, lambda x: CASE WHEN json_type(x, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN round(100 * (x->>'confidence')::DOUBLE)::BIGINT::VARCHAR ELSE '-' END), '|') AS hundredths, array_to_string(list_transform(rs, lambda x: x->>'to'), '|') AS ends FROM k""")
def extraction_mixed(spark, d):
    """Answers whose lists mix good items with strings, numbers, nulls, lists and items of wrong kinds: the good ones stay."""
    o = src.table(spark, d, "orders")
    c = lambda *parts: F.concat(*(F.lit(p) if p[:2] != "o_" else F.col(p).cast("string") for p in parts))
    items = F.array(
        c('"', "o_orderstatus", '"'), F.concat(c('{"name":"', "o_custkey", '","type":"', "o_orderpriority", '","confidence":0.'), F.col("o_orderkey") % 10, F.lit("}")), F.lit("null"), c('{"name":', "o_custkey", "}"), F.lit("[]"),
        c('{"name":"b","type":', "o_custkey", ',"confidence":"0.9"}'), F.lit('{"type":"t"}'), F.lit('{"name":null}'), F.lit("true"), F.lit('{"name":"c","confidence":1}'),
    )
    relations = F.when(F.col("o_orderkey") % 7 == 0, '{"from":"a"}').otherwise(c('[7,{"from":"a","to":"', "o_custkey", '","type":"r","confidence":', "o_custkey", '},{"from":"a","to":"b"},{"from":"a","to":1,"type":"r"},"x"]'))
    raw = F.concat(F.lit('{"entities":['), F.array_join(F.slice(items, (F.col("o_orderkey") % 10 + 1).cast("int"), F.lit(10)), ","), F.lit('],"relations":'), relations, F.lit("}"))
    x = o.select("o_orderkey", xt.read_extraction(raw).alias("x"))
    of = lambda column, f: F.array_join(F.transform(column, f), "|")
    hundredths = lambda e: F.coalesce(F.round(100 * e["confidence"]).cast("long").cast("string"), F.lit("-"))
    return x.select("o_orderkey", of("x.entities", lambda e: e["name"]).alias("names"), of("x.entities", lambda e: e["type"]).alias("types"), of("x.entities", hundredths).alias("hundredths"), of("x.relations", lambda r: r["to"]).alias("ends"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pending' WHEN doc_id % 3 = 1 THEN 'failed' ELSE 'success' END AS semantic_status, CASE WHEN doc_id % 3 = 1 THEN 'e' END AS error FROM documents")
def semantic_status(spark, d):
    n = src.table(spark, d, "documents").select(F.col("doc_id").alias("note_id"))
    state = n.where("note_id % 3 <> 0").select("note_id", F.when(F.col("note_id") % 3 == 1, "failed").otherwise("success").alias("semantic_status"), F.when(F.col("note_id") % 3 == 1, "e").alias("error"))
    return sm.semantic_status(state, n).withColumnRenamed("note_id", "doc_id")


@query("SELECT doc_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN '# Document ' || doc_id || chr(10) || chr(10) || rtrim(text) ELSE '# Document ' || doc_id || chr(10) || chr(10) || rtrim(text) END AS full_text FROM documents")
def full_content(spark, d):
    marker = tx.marker(2, ["a", "b"], ["L"])
    n = src.notes(spark, d)
    return n.select(F.substring("note_id", 2, 20).cast("long").alias("doc_id"), tx.full_content(F.concat(F.lit("  "), "title", F.lit(" ")), F.concat("body", F.lit("\n\n" + marker))).alias("full_text"))


@query("SELECT l_suppkey AS note_id, l_partkey AS entity_id, max(o_orderdate) AS updated_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def evidenced_ends(spark, d):
    """Both ends of every relation that a note evidences (a supplier's lines as evidence, each relation from a part to itself)."""
    o = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    l = src.table(spark, d, "lineitem").join(o, "l_orderkey")
    relations = l.select(F.col("l_partkey").alias("relation_id"), F.col("l_partkey").alias("source_entity_id"), F.col("l_partkey").alias("target_entity_id")).distinct()
    evidence = l.select(F.col("l_partkey").alias("relation_id"), F.col("l_suppkey").alias("note_id"))
    latest = l.groupBy("l_suppkey", "l_partkey").agg(F.max("o_orderdate").alias("updated_at")).select(F.col("l_suppkey").alias("note_id"), F.col("l_partkey").alias("entity_id"), "updated_at")
    ends = sm.evidenced_mentions(evidence, relations, latest.groupBy("note_id").agg(F.max("updated_at").alias("updated_at")))
    return ends.select("note_id", "entity_id").join(latest, ["note_id", "entity_id"])


# Runs, chats, events.


@query("SELECT event_id AS id, user_id AS queue, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def last_run(spark, d):
    e = src.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("queue"), "event_type", "ts", F.col("ts").alias("started_at"))
    return rn.run_by_id(e, rn.last_run(e).first().id).drop("started_at")


@query("""WITH r AS (SELECT user_id AS id, ts, event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'success' ELSE 'running' END AS status FROM events)
SELECT id, min(ts) AS started_at, max(CASE WHEN status <> 'running' THEN ts END) AS finished_at, arg_max(status, (ts, (status <> 'running')::INT)) AS status FROM r GROUP BY id""")
def run_log(spark, d):
    e = src.table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "success").otherwise("running")
    rows = e.select(F.col("user_id").alias("id"), F.lit("both").alias("pipeline"), F.lit("b").alias("batch_id"), F.col("ts").alias("at"), status.alias("status"), F.lit(1).alias("processed"), F.lit("").alias("errors"))
    return rn.run_rows(rows).select("id", "started_at", "finished_at", "status")


_TRIMMED = "m AS (SELECT conv_id, turn, role, text, sum(ceil(length(text) / 4.0) + 2) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS cost FROM conversations), b AS (SELECT conv_id, 'sys' || CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || '## Relevant notes' || chr(10) || '[1] T' || chr(10) || 'c' ELSE '' END AS s, 'next ' || conv_id AS t FROM conversations GROUP BY conv_id), k AS (SELECT * FROM m JOIN b USING (conv_id) WHERE cost + ceil(length(s) / 4.0) + ceil(length(t) / 4.0) <= 300)"


def _turns(spark, d):
    m = _messages(spark, d)
    c = m.select("conversation_id").distinct()
    return m, c.select("conversation_id", F.lit("sys").alias("system"), F.concat(F.lit("next "), "conversation_id").alias("text"), F.when(F.col("conversation_id") % 2 == 0, "[1] T\nc").alias("block"))


@query(f"WITH {_TRIMMED} SELECT conv_id AS conversation_id, count(k.turn) + 2 AS n, sha256('system' || any_value(b.s) || coalesce(string_agg(k.role || k.text, '' ORDER BY k.turn), '') || 'user' || any_value(b.t)) AS digest FROM b LEFT JOIN k USING (conv_id) GROUP BY conv_id")
def chat_prompts(spark, d):
    got = ch.prompts(*_turns(spark, d), budget=300)
    return got.select("conversation_id", F.size("prompt").cast("long").alias("n"), F.sha2(F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], m["content"])), ""), 256).alias("digest"))


@query(f"""WITH {_TRIMMED}, a AS (SELECT conv_id, 'answer ' || substr(sha256(any_value(b.s) || chr(10) || coalesce(string_agg(k.text, chr(10) ORDER BY k.turn) || chr(10), '') || any_value(b.t)), 1, 12) AS reply, any_value(b.t) AS t FROM b LEFT JOIN k USING (conv_id) GROUP BY conv_id),
l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT conv_id AS conversation_id, last + 1 AS seq, 'user' AS role, t AS content FROM a JOIN l USING (conv_id) UNION ALL SELECT conv_id, last + 2, 'assistant', reply FROM a JOIN l USING (conv_id)""")
def chat_turn(spark, d):
    """The messages that a turn adds; the stand-in provider answers with the digest of what it is asked."""
    m, turns = _turns(spark, d)
    now = F.lit(NOW).cast("timestamp_ntz")
    old = m.select("conversation_id", "seq", "role", "content", F.lit(None).cast("string").alias("error"), F.lit("2024-01-01").cast("timestamp_ntz").alias("changed_at"))
    talks = m.select("conversation_id").distinct().select("conversation_id", F.lit(None).cast("string").alias("title"), F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))
    _, after = ch.chat_turn(talks, old, turns, now, budget=300)
    return after.where(F.col("changed_at") == now).select("conversation_id", "seq", "role", "content")


@query("SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'bm25,tfidf,fuzzy,dense' WHEN 1 THEN 'bm25,fuzzy' WHEN 2 THEN 'bm25,tfidf,fuzzy,dense,graph' ELSE 'tfidf,fuzzy,dense' END AS retrievers FROM events")
def toggled_retrievers(spark, d):
    """Toggles in JSON: broken, two off, graph with both of its flags, graph without its second flag."""
    k = F.col("user_id") % 4
    text = F.when(k == 0, "{broken").when(k == 1, '{"tfidf":false,"dense":false}').when(k == 2, '{"graph":true,"graphEnabled":true}').otherwise('{"bm25":false,"graph":true}')
    t = src.table(spark, d, "events").select("event_id", ch.read_toggles(text).alias("t"))
    return t.select("event_id", F.array_join(tx.toggled(*(F.col(f"t.{c}") for c in ("bm25", "tfidf", "fuzzy", "dense", "graph", "graphEnabled"))), ",").alias("retrievers"))


@query("SELECT conv_id, string_agg('[' || (turn + 1) || '] t' || turn || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS block, string_agg((turn + 1) || ':n' || turn || ':t' || turn, ',' ORDER BY turn) AS citations FROM conversations GROUP BY conv_id")
def context_citations(spark, d):
    m = _messages(spark, d)
    hits = m.select(F.col("conversation_id").alias("query_id"), (F.col("seq") + 1).alias("place"), F.concat(F.lit("n"), "seq").alias("note_id"), F.concat(F.lit("t"), "seq").alias("title"), "content")
    got = ch.context_and_citations(hits)
    return got.select(F.col("query_id").alias("conv_id"), "block", F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["index"], c["note_id"], c["title"])), ",").alias("citations"))


@query("SELECT conv_id, turn, 'see [1] and [' || turn || '] or [x]' AS text, '1,' || turn AS numbers, 'see <a href=\"#cite-1\">[1]</a> and <a href=\"#cite-' || turn || '\">[' || turn || ']</a> or [x]' AS html FROM conversations")
def citation_numbers(spark, d):
    c = src.table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("see [1] and ["), "turn", F.lit("] or [x]")).alias("text"))
    return c.select("conv_id", "turn", "text", F.array_join(F.transform(tx.cited(F.col("text")), lambda n: n.cast("string")), ",").alias("numbers"), tx.with_citation_links(F.col("text")).alias("html"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
f AS (SELECT user_id, max(ts) + INTERVAL 1 MINUTE AS ts FROM s GROUP BY user_id, k), h AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 1 MINUTE THEN 0 ELSE 1 END AS new FROM f), j AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM h)
SELECT max(ts) + INTERVAL 1 MINUTE AS flush_at, count(DISTINCT user_id) AS n, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS notes FROM j GROUP BY k""")
def flush_batches(spark, d):
    out = ev.flush_batches(_events(spark, d).withColumn("note_id", F.col("note_id").cast("string")), "1 minute")
    return out.select("flush_at", "n", F.array_join("notes", ",").alias("notes"))


#: Sections of the notes below, by their place; a fence holds what looks like a heading, an underline makes one.
_SECTIONS = """[{'level': 0, 'heading': '', 'text': 'Order ' || o_orderkey || '.'}, {'level': 1, 'heading': 'Status ' || o_orderstatus, 'text': '# Status ' || o_orderstatus || chr(10) || 'The status.'},
  {'level': 1, 'heading': 'Priority', 'text': 'Priority' || chr(10) || '=======' || chr(10) || o_orderpriority}, {'level': -1, 'heading': 'Priority', 'text': '```sql' || chr(10) || '# no heading' || chr(10) || 'select ' || o_custkey || chr(10) || '```'},
  {'level': 1, 'heading': 'Priority', 'text': 'Behind.'}, {'level': 2, 'heading': 'Last', 'text': '## Last ##' || chr(10) || 'End of ' || o_orderkey || '.'}]"""


@query(f"SELECT o_orderkey AS note_id, (generate_subscripts(s, 1) - 1)::INT AS position, unnest(s).level::INT AS level, unnest(s).heading AS heading, unnest(s).text AS text FROM (SELECT o_orderkey, {_SECTIONS} AS s FROM orders)")
def note_sections(spark, d):
    """Notes with headings, an underlined one, a fence and, every third, front matter."""
    lines = "Order {0}.|# Status {1}|The status.||Priority|=======|{2}|```sql|# no heading|select {3}|```|Behind.|## Last ##|End of {0}.".replace("|", "\n")
    parts = re.split(r"\{(\d)\}", lines)
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"]
    body = F.concat(*(F.col(columns[int(p)]).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)))
    front = F.when(F.col("o_orderkey") % 3 == 0, "---\ntags: x\n# no heading\n---\n").otherwise("")
    return ix.note_sections(src.table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), F.concat(front, body).alias("body")))


def _locks(spark, d):
    """Requests, and the store's locks from three to five every day."""
    e = src.table(spark, d, "events").select(F.col("event_id").alias("request_id"), "ts")
    days = e.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).distinct()
    return e, days.select((F.col("day") + F.expr("interval 3 hours")).alias("began"), (F.col("day") + F.expr("interval 5 hours")).alias("ended"))


@query("SELECT event_id AS request_id, hour(ts) IN (3, 4) AS deferred, CASE WHEN hour(ts) IN (3, 4) THEN date_trunc('day', ts) + INTERVAL 5 HOUR ELSE ts END AS run_at FROM events")
def lock_gate(spark, d):
    return ev.gate(*_locks(spark, d)).select("request_id", "deferred", "run_at")


@query("""SELECT date_trunc('day', ts) + INTERVAL 5 HOUR AS run_at, 'deferred' AS kind, event_id AS request_id, ts FROM events WHERE hour(ts) IN (3, 4)
UNION ALL SELECT DISTINCT date_trunc('day', ts) + INTERVAL 5 HOUR, 'catch-up', NULL, NULL FROM events""")
def unlock_replay(spark, d):
    e, locks = _locks(spark, d)
    return ev.on_unlock(ev.gate(e, locks), locks)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
f AS (SELECT user_id, max(ts) + INTERVAL 5 MINUTE AS ts FROM s GROUP BY user_id, k), h AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM f), j AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM h)
SELECT DISTINCT max(ts) OVER (PARTITION BY k) + INTERVAL 5 MINUTE AS flush_at, user_id AS note_id FROM j""")
def flushed_notes(spark, d):
    """A row per flush and note; with this gap flushes take many notes."""
    return ev.flushes(_events(spark, d), "5 minutes")


@query()
def coalesced_requests(spark, d):
    e = src.table(spark, d, "events").select(F.col("user_id").alias("pipeline"), F.col("event_id").alias("request_id"), "ts")
    return ev.coalesced(e, 3600.0)


@query()
def extraction_stub(spark, d):
    """Entities and relations that the stand-in provider finds in notes and their chunks."""
    found = xt.extract(xt.units(src.notes(spark, d), "per-note+per-chunk"))
    return xt.merge_entities(xt.extracted_entities(found)).select("note_id", "key", "name", "type")
