"""What grows with the answer, or with the square of the input, stays out of shuffles, of the driver and of a task's memory."""

import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noteforge.operators import retrieval as rt
from noteforge.plans import catalog
from noteforge.sources.staging import staged


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_like_moves_no_pairs_of_equal_queries(spark):
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "OLT").otherwise("a b").alias("query"))
    queries = queries.union(spark.createDataFrame([(0, "olt"), (0, "a b"), (7, " ")], "query_id long, query string"))
    texts = spark.createDataFrame([("n1", "hot Bolt", "x"), ("n1", "a bolt", None), ("n2", "none", "a bolt of volts"), ("n3", None, None)], "id string, title string, body string")
    got = rt.like(queries, texts, ["title", "body"], "id")
    assert not re.search(r"hashpartitioning\(query_id#\d+L", plan(got))  # query_id is a long, the words that stand for queries are not
    pairs = [(r["query_id"], r["id"]) for r in got.collect()]
    assert sorted(pairs) == sorted((q, n) for q in range(300) for n in ("n1", "n2"))


def _corpus(spark):
    words = ["red", "blue", "ring", "bolt", "plate"]
    notes = [(f"n{i}", f"{words[i % 2]} {words[2 + i % 3]}") for i in range(60)]
    chunks = [(f"n{i}:{j}", f"n{i}", f"{t} part {i % 7} of kind{j}") for i, (_, t) in enumerate(notes) for j in range(2)]
    return spark.createDataFrame(notes, "note_id string, title string"), spark.createDataFrame(chunks, "chunk_id string, note_id string, content string")


def _finders(spark):
    notes, chunks = _corpus(spark)
    nodes = notes.select(F.concat(F.lit("node:"), "note_id").alias("id"), F.lit("structural").alias("layer"), F.lit("note").alias("kind"), F.col("title").alias("label"), "note_id")
    edges = nodes.select("layer", F.col("id").alias("source_id"), F.expr("concat('node:n', cast(substring(note_id, 2) AS int) + 1)").alias("target_id"), F.lit(1.0).alias("weight"))
    return {
        "fuzzy": lambda q: rt.fuzzy_chunks(q, notes, chunks, 5),
        "graph": lambda q: rt.graph_chunks(q, nodes, edges, chunks, 5),
        "bm25": lambda q: rt.bm25(q, chunks, 5),
        "tfidf": lambda q: rt.tfidf(q, chunks, 5),
    }


@pytest.mark.parametrize("name", ["fuzzy", "graph", "bm25", "tfidf"])
def test_equal_queries_are_scored_once(spark, monkeypatch, name):
    find = _finders(spark)[name]
    scored, top = [], rt.top
    monkeypatch.setattr(rt, "top", lambda df, *a: scored.append(df.count()) or top(df, *a))
    asked = ["red ring", "blue plate", None]
    alone = {r: [] for r in asked}
    for r in find(spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")).orderBy("query_id", "rank").collect():
        alone[asked[r["query_id"]]].append((r["chunk_id"], r["score"], r["rank"]))
    many = find(spark.range(60).select(F.col("id").alias("query_id"), F.element_at(F.array(*map(F.lit, asked)), (F.col("id") % 3 + 1).cast("int")).alias("query")))
    assert scored[len(scored) // 2 :] == scored[: len(scored) // 2]
    got = {i: [] for i in range(60)}
    for r in many.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["chunk_id"], r["score"], r["rank"]))
    assert len(alone["red ring"]) == 5 and all(got[i] == alone[asked[i % 3]] for i in got)


def test_a_title_gives_its_first_chunks_only(spark, monkeypatch):
    """Notes of one title are as many as the corpus likes; a query meets no more of their chunks than it returns."""
    notes, chunks = _corpus(spark)
    scored, top = [], rt.top
    monkeypatch.setattr(rt, "top", lambda df, *a: scored.append(df.count()) or top(df, *a))
    got = rt.fuzzy_chunks(spark.createDataFrame([(1, "red ring")], "query_id long, query string"), notes.union(notes), chunks, 3)
    assert scored[0] <= 3 * 6
    assert [r["chunk_id"] for r in got.orderBy("rank").collect()] == sorted(f"n{i}:{j}" for i in range(0, 60, 6) for j in range(2))[:3]


@pytest.mark.parametrize("most", [0, 3, 5])
def test_rare_terms_count_in_norms(spark, monkeypatch, most):
    _, chunks = _corpus(spark)
    queries = spark.createDataFrame([(1, "red ring part"), (2, "kind0 blue unknown")], "query_id long, query string")
    want = sorted(map(tuple, rt.tfidf(queries, chunks, 20).collect()))
    split = rt._frequent
    monkeypatch.setattr(rt, "_frequent", lambda df: split(df, most))
    known, rare = split(rt.document_frequency(chunks), most)
    assert known.count() <= most and rare is not None and known.count() + rare.count() == rt.document_frequency(chunks).count()
    assert sorted(map(tuple, rt.tfidf(queries, chunks, 20).collect())) == want


def test_a_task_holds_few_scores_of_vectors(spark, monkeypatch):
    """4,096 queries against a batch of 10,000 vectors: 328 MB of scores, if they were held at once."""
    asked = np.random.default_rng(1).normal(size=(4096, 2))
    queries = spark.createDataFrame(list(enumerate(asked.tolist())), "query_id long, vector array<double>")
    run, take = [], type(queries).mapInPandas
    monkeypatch.setattr(type(queries), "mapInPandas", lambda self, f, *a, **b: run.append(f) or take(self, f, *a, **b))
    rt.dense(queries, queries.withColumnRenamed("query_id", "vec_id"), 5)
    held = np.random.default_rng(2).normal(size=(10_000, 2))
    tracemalloc.start()
    found = pd.concat(run[0](iter([pd.DataFrame({"vec_id": np.arange(len(held)), "vector": list(held)})])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert (found.groupby("query_id").size() >= 5).all() and found["query_id"].nunique() == len(asked)
    one = held @ asked[7] / np.sqrt((held * held).sum(axis=1)) / np.sqrt((asked[7] ** 2).sum())
    assert set(np.argsort(-one)[:5]) <= set(found.loc[found["query_id"] == 7, "vec_id"])


@pytest.mark.parametrize("name", ["bm25", "tfidf"])
def test_no_pair_of_query_and_chunk_is_moved(spark, monkeypatch, name):
    """Pairs are summed where a chunk's postings lie; only the best of each task go on. Results don't depend on how postings are dealt."""
    find = _finders(spark)[name]
    queries = spark.createDataFrame([(1, "red ring part"), (2, "kind0 blue"), (3, "blue nothing"), (4, "red ring")], "query_id long, query string")
    found = find(queries)
    assert "hashpartitioning(chunk_id#" in plan(found)
    assert not re.search(r"hashpartitioning\(query_id#\w+, chunk_id#", plan(found))
    want = sorted(map(tuple, found.collect()))
    assert {r[0] for r in want} >= {1, 2, 4}
    monkeypatch.setattr(rt, "MET", 1)
    dealt = find(queries)
    assert int(re.search(r"hashpartitioning\(chunk_id#\w+, (\d+)\), REPARTITION_BY_NUM", plan(dealt))[1]) > 100
    assert sorted(map(tuple, dealt.collect())) == want
    monkeypatch.setattr(rt, "_few", lambda df, most=0: False)
    assert sorted(map(tuple, find(queries).collect())) == want


@pytest.mark.parametrize("name", ["context_block", "context_assemble"])
def test_no_text_is_moved_to_hits(spark, name):
    """Hits are few and go to their chunks, however large these are."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin [chunk_id#" in found
    assert "hashpartitioning(chunk_id#" not in found


@pytest.mark.parametrize("name", ["rrf_fuse", "contributing_retrievers", "rrf_disabled_retriever"])
def test_fused_queries_move_no_pairs(spark, name):
    found = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "hashpartitioning(chunk_id#" in found
    assert not re.search(r"hashpartitioning\(query_id#\w+, chunk_id#", found)


def test_tokens_are_made_once(spark):
    """A condition on tokens would make them a second time, below the shuffle that deals the chunks."""
    chunks = spark.createDataFrame([("a:0", "Red ring, red bolt"), ("b:0", None), ("c:0", " "), ("d:0", "the of")], "chunk_id string, content string").repartition(3)
    found = rt.postings(chunks)
    assert plan(found).count("regexp_replace(") == 1
    assert sorted(map(tuple, found.select("chunk_id", "term", "tf", "len").collect())) == [("a:0", "bolt", 1, 4), ("a:0", "red", 2, 4), ("a:0", "ring", 1, 4)]


@pytest.mark.parametrize("name", ["bm25", "tfidf"])
def test_a_task_meets_few_postings(spark, monkeypatch, name):
    """The join with the norms must not take the postings back to few partitions, whose tasks spill what they sum."""
    find = _finders(spark)[name]
    queries = spark.createDataFrame([(1, "red ring part"), (2, "kind0 blue")], "query_id long, query string")
    want = sorted(map(tuple, find(queries).collect()))
    monkeypatch.setattr(rt, "MET", 1)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = find(queries)
        dealt = re.findall(r"hashpartitioning\(chunk_id#\w+, (\d+)\)", plan(found))
        assert sorted(map(tuple, found.collect())) == want
    finally:
        spark.conf.set(key, before)
    assert int(dealt[0]) > 100  # the first from above is the postings'


def test_a_disabled_retriever_does_not_run(spark, monkeypatch):
    asked = []
    for name in ("bm25", "tfidf"):
        monkeypatch.setattr(rt, name, lambda *a, name=name, find=getattr(rt, name), **b: asked.append(name) or find(*a, **b))
    catalog.QUERIES["rrf_disabled_retriever"](spark, "/root/testdata/sf0.001")
    assert asked == ["tfidf"]


def test_contributing_retrievers_deal_postings_and_norms_alike(spark, monkeypatch):
    monkeypatch.setattr(rt, "MET", 1)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = plan(catalog.QUERIES["contributing_retrievers"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set(key, before)
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(chunk_id#\w+, (\d+)\), REPARTITION_BY_NUM", found)]
    assert len(dealt) == 3 and min(dealt) > 100  # postings of either retriever, and the norms


def test_a_retriever_that_fails_is_no_result(spark, monkeypatch):
    notes, chunks = _corpus(spark)
    queries = spark.createDataFrame([(1, "red ring")], "query_id long, query string")
    corpus = rt.Corpus(chunks, notes)
    assert {r["retrievers"] for r in rt.retrieve(queries, corpus).collect()} >= {"bm25,fuzzy,tfidf"}

    def down(*_):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="down"):
        rt.retrieve(queries, corpus, rt.Settings(rerank=True), reranker=down)
    monkeypatch.setattr(rt, "tfidf", down)
    with pytest.raises(RuntimeError, match="down"):
        rt.retrieve(queries, corpus)
    with pytest.raises(Exception):  # vectors without their column
        rt.retrieve(queries.withColumn("vector", F.array(F.lit(1.0))), rt.Corpus(chunks, notes, vectors=chunks.select("chunk_id")), requested=["dense"])


def test_no_table_of_the_corpus_is_broadcast_by_its_files(spark, monkeypatch):
    """Files far below Spark's threshold may hold more rows than the driver; only what was counted is broadcast."""
    notes, chunks = (staged(x, "corpus") for x in _corpus(spark))
    nodes = staged(notes.select(F.concat(F.lit("node:"), "note_id").alias("id"), F.lit("structural").alias("layer"), F.lit("note").alias("kind"), F.col("title").alias("label"), "note_id"), "corpus")
    edges = staged(nodes.select("layer", F.col("id").alias("source_id"), F.lit("node:n1").alias("target_id"), F.lit(1.0).alias("weight")), "corpus")
    vectors = staged(chunks.select("chunk_id", F.array(F.length("content").cast("double"), F.lit(1.0)).alias("vector")), "corpus")
    queries = staged(spark.createDataFrame([(1, "red ring", [3.0, 1.0])], "query_id long, query string, vector array<double>"), "corpus-queries")
    corpus = rt.Corpus(chunks, notes, vectors, nodes, edges)
    got = rt.with_texts(rt.retrieve(queries, corpus), corpus)
    lines, seen = plan(got).splitlines(), 0
    depth = [len(x) - len(x.lstrip(" :+-|")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            seen += 1
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            scans = [x for x in lines[i + 1 : below] if "FileScan" in x]
            assert scans and not any(re.search(r"\b(chunk_id|note_id|title|source_id|id)#", x.split("]")[0]) for x in scans), lines[i:below]
    assert seen and got.count() == 50
    assert {r for x in got.collect() for r in x["retrievers"].split(",")} == set(rt.RETRIEVERS)


def test_a_label_gives_its_first_chunks_only(spark, monkeypatch):
    """Nodes of one label are as many as the corpus likes; a query meets no more of their chunks than it returns."""
    notes, chunks = _corpus(spark)
    nodes = notes.select(F.concat(F.lit("node:"), "note_id").alias("id"), F.lit("structural").alias("layer"), F.lit("note").alias("kind"), F.col("title").alias("label"), "note_id")
    edges = nodes.select("layer", F.col("id").alias("source_id"), F.expr("concat('node:n', cast(substring(note_id, 2) AS int) + 1)").alias("target_id"), (F.expr("cast(substring(note_id, 2) AS int) % 4") / 3).alias("weight"))
    queries = spark.createDataFrame([(1, "red"), (2, "ring plate")], "query_id long, query string")
    want = {}
    for r in rt.graph(queries, nodes, edges, None).join(nodes.withColumnRenamed("id", "node_id"), "node_id").join(chunks, "note_id").collect():
        want.setdefault(r["query_id"], []).append((-r["score"], r["chunk_id"]))
    scored, top = [], rt.top
    monkeypatch.setattr(rt, "top", lambda df, *a: scored.append(df.count()) or top(df, *a))
    got = {}
    for r in rt.graph_chunks(queries, nodes, edges, chunks, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["chunk_id"]))
    assert got == {q: sorted(x)[:3] for q, x in want.items()} and len(got) == 2
    assert sum(scored) <= 2 * 6 * 3


def test_persist_moves_a_relation_once_and_no_names(spark, monkeypatch):
    """What a note says is moved by its note, once, with normal forms; names and types are counted where they lie."""
    from noteforge.operators import semantic as sm
    from noteforge.plans import layers

    rows = [(f"n{i % 40}", i, f" Bolt {i % 7}.", f"ring {i % 5}", "USES" if i % 2 else "uses ", None if i % 3 else 0.2 + i % 4 / 10) for i in range(200)]
    said = spark.createDataFrame(rows, "note_id string, ord long, from string, to string, type string, confidence double")
    entities = said.select("note_id", "ord", F.col("from").alias("name"), F.lit("tool").alias("type"), "confidence")
    entities = entities.union(said.select("note_id", "ord", F.upper("to"), F.lit("part"), F.lit(None).cast("double")))
    notes = said.select("note_id").distinct()
    plans, write = {}, sm.staged
    monkeypatch.setattr(sm, "staged", lambda df, name, *a: plans.setdefault(name, plan(df)) and write(df, name, *a))
    got = sm.persist(layers._empty_layer(spark), notes, entities, said, notes.select("note_id", F.concat("note_id", F.lit(":0")).alias("chunk_id")))
    assert "SortAggregate" not in plans["names"] and "SortAggregate" not in plans["relation-ends"] and "SortAggregate" not in plans["evidence"]
    assert plans["relation-ends"].count("Exchange hashpartitioning(note_id") <= 3  # the relations, their chunks and, for these, the notes
    of_note = {}  # of a relation in a note the highest confidence, 0.6 if none is known
    for n, _, a, b, _, c in rows:
        known = of_note.setdefault((a.strip(" .").lower(), b, n), [])
        known += [] if c is None else [c]
    want = {}
    for (a, b, n), known in of_note.items():
        want.setdefault((a, b), []).append(max(known, default=0.6))
    names = {e["entity_id"]: e["canonical_name"] for e in got.entities.collect()}
    assert {(names[r["source_entity_id"]], names[r["target_entity_id"]]): r["confidence"] for r in got.relations.collect()} == {k: round(max(1 - 0.4 ** len(v), *v), 6) for k, v in want.items()}
    assert got.evidence.count() == len(of_note) and all(r["relation_type"] == "uses" for r in got.relations.collect())
    assert {e["canonical_name"]: e["aliases"] for e in got.entities.collect()}["ring 1"] == ["RING 1"]


def test_every_entity_looks_for_a_similar_one(spark):
    from noteforge.operators import semantic as sm

    v = np.random.default_rng(3).integers(-2, 3, size=(150, 3)).astype(float)  # with copies, ties and zero vectors
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, [1.0, 2.0]), (901, [1.0, 2.1]), (902, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    n = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    s = np.round(np.round(n @ n.T, 9), 6)
    np.fill_diagonal(s, -1)
    c = 5.2 / (5 * 5.41) ** 0.5
    want = {i: (int(s[i].argmax()), s[i].max()) for i in range(150) if s[i].max() > 0.3} | {900: (901, c), 901: (900, c)}
    got = sm.similar_entities(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 0.3, block=16).collect()
    assert len(got) == len(want)
    assert {r["query_id"]: (r["vec_id"], round(r["score"], 5)) for r in got} == {k: (j, round(x, 5)) for k, (j, x) in want.items()}
    assert any(r["query_id"] % 50 for r in catalog.entity_similarity_pairs(spark, "/root/testdata/sf0.001").collect())
