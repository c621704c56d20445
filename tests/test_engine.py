"""The note engine against DuckDB on the smallest tables, and golden cases."""

import glob
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from noteforge.functions import text as tx
from noteforge.operators import chats as ch
from noteforge.operators import extraction as xt
from noteforge.operators import indexing as ix
from noteforge.operators import providers as pv
from noteforge.operators import retrieval as rt
from noteforge.operators import runs as rn
from noteforge.operators import semantic as sm
from noteforge.operators.canonical import Near
from noteforge.plans import catalog, layers
from noteforge.sources import migrations as mg
from noteforge.sources import notes as src
from noteforge.streaming import events as ev

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(df, columns):
    return sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(got, columns) == plain(want, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize(("a", "b", "d"), [("hello", "hello", 0), ("hello", "hallo", 1), ("hello", "helo", 1), ("hello", "hllo", 1), ("hello", "heoll", 2), ("", "hello", 5), ("ab", "ba", 1)])
def test_edit_distance(a, b, d):
    assert tx.distance(a, b) == d


def test_sections_and_chunks():
    text = "---\nx: 1\n---\n# One\nalpha\n\n```\n# no heading\n```\nbeta\n\nTwo\n===\ngamma"
    assert [(level, h) for level, h, _ in ix.sections(text)] == [(1, "One"), (-1, "One"), (1, "One"), (1, "Two")]
    raw, out = ix.chunk_texts("T", "word " * 1000, 500, 50)
    assert all(len(x) <= 500 for x in raw) and out[1].startswith(raw[0][-50:].lstrip()) and " ".join(raw).split() == ["#", "T", *["word"] * 1000]
    assert ix.chunk_texts("", "", 500, 50) == ([], [])


def test_noisy_or_and_counts(spark):
    df = spark.createDataFrame([("a", 0.6), ("b", None), ("b", 0.6), ("c", 0.6), ("c", 0.6), ("c", 0.6)], "k string, c double")
    from pyspark.sql import functions as F

    got = {r.k: round(r.v, 6) for r in df.groupBy("k").agg(sm.noisy_or(F.col("c")).alias("v")).collect()}
    assert got == {"a": 0.6, "b": 0.84, "c": 0.936}
    assert df.where("false").agg(sm.noisy_or(F.col("c")).alias("v")).first().v == 0


def test_fusion_and_context(spark):
    hits = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2)], "query_id long, chunk_id string, rank long")
    other = spark.createDataFrame([(1, "c1", 1), (1, "c3", 2)], "query_id long, chunk_id string, rank long")
    fused = {r.chunk_id: (r.score, r.retrievers) for r in rt.fuse({"bm25": hits, "tfidf": other}).collect()}
    assert fused["c1"] == (round(2 / 61, 9), "bm25,tfidf") and len(fused) == 3
    assert rt.fuse({"bm25": hits, "tfidf": other}, enabled={"tfidf": False}).count() == 2
    rows = [(1, f"c{i}", f"n{i // 3}", "x" * 200, 0.9 - i / 10) for i in range(5)] + [(1, "c0", "n0", "x" * 200, 0.1)]
    out = rt.assemble(spark.createDataFrame(rows, "query_id long, chunk_id string, note_id string, content string, score double"), 100, 2)
    assert [r.chunk_id for r in out.orderBy("place").collect()] == ["c0", "c1"]
    one = rt.assemble(spark.createDataFrame([(1, "big", "n", "x" * 9999, 1.0)], "query_id long, chunk_id string, note_id string, content string, score double"), 100)
    assert one.count() == 1


def test_parsers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("30m",), ("every 6h",), ("45s",), ("off",), ("1d",)], "t string")
    assert [r.v for r in df.select(tx.interval_ms(F.col("t")).alias("v")).collect()] == [1_800_000, 21_600_000, 45_000, None, 86_400_000]
    with pytest.raises(ValueError):
        tx.cron_field("61", 0, 59)
    t = spark.createDataFrame([("2024-01-01 12:00:00",), ("2024-01-01 13:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [r.v for r in t.select(tx.cron_matches(F.col("t"), "0 */6 * * *").alias("v")).collect()] == [True, False]
    q = spark.createDataFrame([("hello world",), (" ",), ('a "b"',)], "q string")
    assert [r.v for r in q.select(tx.fts_query(F.col("q")).alias("v")).collect()] == ["hello AND world", '""', 'a AND ""b""']
    m = tx.marker(1, ["a", "b"], ["L"])
    x = spark.createDataFrame([("text\n\n" + m,), ("plain",)], "t string").select(tx.parse_marker(F.col("t")).alias("m"), tx.strip_marker(F.col("t")).alias("s")).collect()
    assert (x[0].m.version, x[0].m.tags, x[0].m.links, x[0].s, x[1].m, x[1].s) == (1, ["a", "b"], ["L"], "text", None, "plain")


def test_bounded_buffer_and_rate_limit():
    assert ev.bounded_buffer([1, 2, 1, 3, 4], 3) == ([2, 3, 4], [1])
    limit = ev.RateLimit(2, 60)
    assert [limit.refuse("a", t, True) for t in (0, 1, 2, 59, 60, 61, 62)] == [False, False, True, True, False, False, True]


def test_debounce_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:09"), (2, "2024-01-01 01:00:00")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "note_id long, t string").select("note_id", F.col("t").cast("timestamp").alias("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = ev.debounce(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "5 seconds", watermark="1 minute")
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r.note_id, r.n) for r in spark.table("sessions").collect())
    assert got == [(1, 1), (1, 2)] and sorted((r.note_id, r.n) for r in ev.debounce(df, "5 seconds").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_greedy_merge_is_in_order(spark):
    r = random.Random(3)
    rows = [(i, f"k{i}", [r.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [(60, "zero", [0.0, 0.0, 0.0]), (61, "short", [1.0]), (62, "null", None)]
    have = [("known", rows[5][2])]

    def brute():
        unit = lambda v: np.asarray(v or [], float) / (np.linalg.norm(np.asarray(v or [], float)) or 1.0)
        canonical, out = [(k, unit(v)) for k, v in have], {}
        for _, k, v in rows:
            u = unit(v)
            near = [(float(u @ w), -n, name) for n, (name, w) in enumerate(canonical) if len(w) == len(u) and float(u @ w) > 0.85]
            out[k] = max(near)[2] if near else k
            if not near:
                canonical.append((k, u))
        return out

    df = spark.createDataFrame(rows, "ord long, key string, vector array<double>")
    existing = spark.createDataFrame(have, "key string, vector array<double>")
    for rules in (Near(block=7, first=9), Near()):
        assert {x.key: x.canonical for x in sm.greedy_merge(df, existing, rules).collect()} == brute()
    assert sm.greedy_merge(df.limit(0)).count() == 0


def test_entity_names_agree_in_any_form(spark):
    names = ["!!Hello!!", "hello", "Café", "Cafe\u0301", " CAFÉ ", "  two   words. "]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [x.k for x in df.select(tx.entity_key(F.col("n")).alias("k")).collect()] == ["hello", "hello", "café", "café", "café", "two words"]
    m = spark.createDataFrame([(1, "Alice", "a", 0.5), (2, "alice ", "b", None), (3, "ALICE", "c", 0.9)], "ord long, name string, type string, confidence double")
    (x,) = sm.canonicalize(m).collect()
    assert (x.type, x.confidence, x.aliases, x.mentions) == ("a", 0.9, ["ALICE", "Alice", "alice"], 3)


def test_intervals(spark):
    want = {"30m": 1_800_000, "30 min": 1_800_000, "30 mins": 1_800_000, "30 minutes": 1_800_000, "every 6h": 21_600_000, "Every 2 Hours": 7_200_000, "45s": 45_000, "1 day": 86_400_000, "off": None, "m": None, "5 weeks": None, "-3m": None}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {x.t: x.v for x in df.select("t", tx.interval_ms(F.col("t")).alias("v")).collect()} == want


def test_fusion_keys_notes_and_nothing(spark):
    hits = spark.createDataFrame([(1, None, "n1", 1), (1, "c2", "n2", 2)], "query_id long, chunk_id string, note_id string, rank long")
    other = spark.createDataFrame([(1, None, "n1", 1), (1, "c2", "other", 2)], "query_id long, chunk_id string, note_id string, rank long")
    got = {x.key: x for x in rt.fuse({"tfidf": other, "bm25": hits}).collect()}
    assert got["note:n1"].score == round(2 / 61, 9) and got["note:n1"].chunk_id is None and got["c2"].note_id == "n2"
    assert rt.fuse({"bm25": hits}, enabled={"bm25": False}).count() == 0 and rt.fuse({}).columns == rt.fuse({"bm25": hits}).columns


def test_facade_isolates_failures_and_settings(spark):
    chunks = spark.createDataFrame([("a:0", "a", "alpha beta gamma"), ("b:0", "b", "beta delta"), ("b:1", "b", "alpha alpha")], "chunk_id string, note_id string, content string")
    notes = spark.createDataFrame([("a", "alpha beta"), ("b", "other")], "note_id string, title string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "  "), (3, "zqzq xkxk")], "query_id long, query string")
    c = rt.Corpus(chunks, notes)  # no vectors and no graph: these two find nothing
    out = rt.retrieve(q, c).collect()
    assert {x.query_id for x in out} == {1} and {x.chunk_id for x in out} == {"a:0", "b:0", "b:1"} and out[0].rank == 1
    assert next(x for x in out if x.chunk_id == "a:0").retrievers == "bm25,fuzzy,tfidf"
    assert rt.retrieve(q, c, requested=["dense"]).count() == 0 and rt.retrieve(q, c, rt.Settings(enabled={})).count() == 0
    assert rt.retrieve(q, c, limit=1).count() == 1
    assert rt.chosen(["bm25", "graph"], rt.Settings(enabled={"bm25": True, "graph": False})) == ["bm25"]

    def broken(hits, queries):
        raise RuntimeError("down")

    assert rt.rerank(chunks, q, broken) is chunks and rt.rerank(chunks, q) is chunks
    s = rt.Settings(dense_k=1000, token_budget=1, rrf_k="x")
    assert len(s.validate()) == 3 and s.clamped().validate() == [] and (s.clamped().dense_k, s.clamped().token_budget, s.clamped().rrf_k) == (100, 500, 60)
    assert [rt.check_query("a", n) for n in (5, 0, 1000, "7", "x", None)] == [5, 10, 100, 7, 10, 10]
    for bad in ("", "  ", "x" * 501, None):
        with pytest.raises(ValueError):
            rt.check_query(bad)


def test_substrings_without_meeting_everything(spark):
    texts = [(1, "The quick (brown) fox"), (2, "a 100% sure thing"), (3, "Brownian motion!!"), (4, None), (5, "x_y and xay")]
    asked = [(1, "quick (brown) fox"), (2, "rown"), (3, "00% s"), (4, "!!"), (5, " "), (6, "x_y"), (7, "brown motion")]
    t, q = spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame(asked, "query_id long, query string")
    got = sorted((x.query_id, x.id) for x in rt.like(q, t, ["body"], "id").collect())
    assert got == sorted((i, j) for i, a in asked for j, b in texts if b and a.strip() and a.lower() in b.lower())
    plan = rt.like(q, t, ["body"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_labels_with_wildcards(spark):
    nodes = [("n1", "structural", "note", "alpha 100%"), ("n2", "structural", "note", "beta_x"), ("n3", "semantic", "note", "gamma"), ("t", "structural", "entity", "alphabet")]
    edges = [("structural", "t", "n1", 1.0), ("structural", "n2", "n1", 0.5), ("semantic", "n3", "n2", 0.8)]
    n = spark.createDataFrame(nodes, "id string, layer string, kind string, label string")
    e = spark.createDataFrame(edges, "layer string, source_id string, target_id string, weight double")
    q = spark.createDataFrame([(1, "alpha"), (2, "a_x"), (3, "%"), (4, "zzz"), (5, "b")], "query_id long, query string")
    found = lambda layer: {k: sorted(x.node_id for x in rows) for k in range(1, 6) if (rows := [x for x in rt.graph(q, n, e, layer=layer).collect() if x.query_id == k])}
    assert found("both") == {1: ["n1", "n2"], 2: ["n1", "n3"], 3: ["n1", "n2", "n3"], 5: ["n1", "n3"]}
    assert found("structural")[3] == ["n1", "n2"] and "n3" not in str(found("structural")) and found("semantic") == {}


def test_scopes(spark):
    notes = spark.createDataFrame([("1", "f1"), ("2", "f2"), ("3", "f3"), ("4", None)], "note_id string, parent_id string")
    folders = spark.createDataFrame([("f1", None), ("f2", "f1"), ("f3", "f2"), ("f4", "f1")], "id string, parent_id string")
    ids = lambda df: sorted(x.note_id for x in df.collect())
    assert ids(ix.resolve_scope(notes, folders, folder="f2")) == ["2", "3"] and ids(ix.resolve_scope(notes, folders, folder="")) == ["4"]
    assert ids(ix.resolve_scope(notes, note="3")) == ["3"] and len(ids(ix.resolve_scope(notes, everything=True))) == 4
    for bad in ({}, {"note": "1", "everything": True}):
        with pytest.raises(ValueError):
            ix.resolve_scope(notes, **bad)
    with pytest.raises(LookupError):
        ix.resolve_scope(notes, note="9")
    assert ids(ix.by_ids(notes, spark.createDataFrame([("1",), ("1",), ("9",)], "note_id string"))) == ["1"]


def test_index_run_without_provider_and_purge(spark):
    class Down(pv.StubProvider):
        def list_models(self):
            return []

    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    n = spark.createDataFrame([("a", "One", "see [[Two]] and [[None]]"), ("b", "Two", "text"), ("c", "Two", "")], "note_id string, title string, body string").withColumn("created_at", now)
    tags = spark.createDataFrame([("a", "t1", "Tag")], "note_id string, tag_id string, title string")
    first = ix.index_notes(ix.empty_tables(spark), n, n, tags, now, provider=Down())
    assert (first.processed, first.chunks, first.unresolved, first.tables.vectors.count(), first.error) == (3, 2, 1, 0, "the provider is down")
    assert {x.structural_status for x in first.tables.state.collect()} == {"pending"}
    second = ix.index_notes(first.tables, n, n, tags, now)
    assert second.processed == 3 and second.tables.vectors.count() == second.tables.chunks.count() == 2
    third = ix.index_notes(second.tables, n.where("note_id <> 'a'"), n.where("note_id <> 'a'"), tags, now, everything=True)
    assert (third.processed, third.skipped, third.purged) == (0, 2, 1)
    t = third.tables
    assert t.edges.count() == 0 and sorted(x.id for x in t.nodes.collect()) == ["note:b", "note:c", "tag:t1"] and t.chunks.count() == 1
    again = ix.index_notes(second.tables, n, n, tags, now, model="other")
    assert again.processed == 3 and {x.model for x in again.tables.vectors.collect()} == {"other"}


def test_extraction_with_retry_and_granularity(spark):
    class Wrong(pv.StubProvider):
        def extract(self, text):
            if "boom" in text:
                raise OSError("no route")
            return {"entities": [{"name": "", "type": "t"}], "relations": []} if "bad" in text else super().extract(text)

        def chat(self, messages, temperature=None, max_tokens=None):
            return "{}" if "again" in messages[1]["content"] else '```json\n{"entities": [{"name": 3}, {"name": " "}], "relations": [{"from": "a"}, {"from": "a", "to": "b", "type": ""}]}\n```'

    texts = spark.createDataFrame([("a", 0, "Alice met Bob Stone"), ("b", 0, "bad"), ("c", 0, "bad again"), ("d", 0, "boom")], "note_id string, unit int, text string")
    got = {x.note_id: x for x in xt.extract(texts, Wrong()).collect()}
    assert [e.name for e in got["a"].entities] == ["Alice", "Bob Stone"] and got["a"].relations[0].to == "Bob Stone" and got["a"].error is None
    assert "entity 0: blank name" in got["b"].error and "relation 0: blank type" in got["b"].error and got["c"].error is None and got["d"].error
    n = spark.createDataFrame([("s", "T", "short " + tx.marker(1, [], [])), ("l", "", "word " * 3000), ("e", "", " ")], "note_id string, title string, body string")
    count = lambda g: {x.note_id: x.n for x in xt.units(n, g, 8000).groupBy("note_id").agg(F.count("*").alias("n")).collect()}
    assert count("per-note") == {"s": 1, "l": 8} and count("per-chunk") == {"s": 1, "l": 8} and count("per-note+per-chunk") == {"s": 2, "l": 16}
    assert xt.units(n).where("note_id = 's'").first().text == "# T\n\nshort"
    with pytest.raises(ValueError):
        xt.units(n, "per-word")


def test_semantic_run_and_upkeep(spark):
    n = spark.createDataFrame([("a", "A", "Alice met Bob Stone"), ("b", "B", "Alice met Bob Stone"), ("c", "C", "nobody")], "note_id string, title string, body string")
    state = spark.createDataFrame([], "note_id string, content_hash string, semantic_status string, extraction_model string, error string")
    layer, state, changed = sm.run_semantic(layers._empty_layer(spark), n, state, spark.createDataFrame([("a", "a:0")], "note_id string, chunk_id string"))
    # titles are names too: "A" is a single letter and no name of the stand-in
    assert {x.canonical_name for x in layer.entities.collect()} == {"alice", "bob stone"}
    (r,) = layer.relations.collect()
    assert round(r.confidence, 6) == 0.84 and layer.evidence.count() == 2 and {x.semantic_status for x in state.collect()} == {"success"} and state.count() == 3
    assert sorted((x.note_id, x.entity_id) for x in changed.collect()) == sorted((k, x.entity_id) for k in "ab" for x in layer.entities.collect())
    again, _, none = sm.run_semantic(layer, n, state, spark.createDataFrame([("a", "a:0")], "note_id string, chunk_id string"))
    assert none.count() == 0 and again.relations.count() == 1
    less = sm.purge_notes(layer, n.where("note_id = 'a'"))
    assert [round(x.confidence, 6) for x in less.relations.collect()] == [0.6] and [round(x.weight, 6) for x in less.edges.where("type = 'relation'").collect()] == [0.6]
    assert sm.purge_notes(less, n.where("note_id = 'b'")).relations.count() == 0
    assert sorted(x.relation_id for x in sm.lazy_cascade(layer.evidence, n.where("note_id = 'a'")).collect()) == [r.relation_id]


def test_providers():
    sent = []

    def send(path, body, seconds):
        sent.append((path, body))
        if path == "/v1/models":
            yield b'{"data": [{"id": "m"}]}'
        elif path == "/v1/embeddings":
            yield b'{"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}'
        elif body["stream"]:
            yield from (b'data: {"choices":[{"delta":{"content":"He', b'llo"}}]}\r\n\r\n: x\n\ndata: {broken\n\ndata: {"choices":[{"delta":{}}]}\n\n', b'data: {"choices":[{"delta":{"content":" you"}}]}\n\ndata: [DONE]\n\ndata: {"choices":[{"delta":{"content":"late"}}]}\n\n')
        else:
            yield b'{"choices": [{"message": {"content": "{\\"entities\\": [{\\"name\\": \\"A\\"}]}"}}]}'

    p = pv.create_provider("http", model="m", send=send)
    assert list(p.chat_stream([])) == ["Hello", " you"] and [v.tolist() for v in p.embeddings(["a", "b"])] == [[1.0], [2.0]]
    assert p.extract("t") == {"entities": [{"type": "unknown", "name": "A"}], "relations": []} and sent[-1][1]["temperature"] == 0
    assert p.test_connection() == (True, "connected, models: m") and not pv.HttpProvider(model="other", send=send).test_connection()[0]

    def dead(path, body, seconds):
        raise OSError("refused")
        yield b""

    off = pv.HttpProvider(send=dead)
    assert off.list_models() == [] and not off.test_connection()[0]
    with pytest.raises(ValueError):
        pv.create_provider("nothing")
    time_, h = [0.0], None
    h = pv.Health(lambda: time_[0])
    assert h.peek() == "unknown" and h.check(off) == "down"
    time_[0] = 14.0
    assert h.check(p) == "down"
    time_[0] = 15.0
    assert h.peek() == "unknown" and h.check(p) == "up"
    time_[0] = 74.9
    assert h.check(off) == "up"
    h.invalidate()
    assert h.check(off) == "down"


def test_runner_and_batches(spark):
    done, seen = [], []

    def work(scope, progress, cancelled):
        done.append(scope["n"])
        progress(1, 1, scope["n"])
        if scope["n"] == 9:
            raise ValueError("x" * 2000)
        return {"processed": 2, "chunks": 4, "skipped": 1}, (["one"] if scope["n"] == 2 else [])

    clock = iter(range(1000))
    locked = [False]
    r = rn.Runner({"structural": work, "semantic": lambda s, p, c: ({"processed": 2, "entities": 3, "relations": 2}, [])}, lambda: locked[0], lambda: float(next(clock)))
    r.listeners.append(lambda run, a, b, what: seen.append((a, b, what)))
    ids = [r.enqueue("structural", {"n": n}, t) for n, t in ((1, "schedule"), (2, "manual"), (3, "event"), (4, "cli"), (5, "manual"), (9, "event"))]
    assert r.snapshot() == [ids[1], ids[4], ids[3], ids[2], ids[5], ids[0]]
    assert r.cancel(ids[3]) and not r.cancel("none")
    locked[0] = True
    assert r.work() == 0
    locked[0] = False
    assert r.work(1) == 1 and r.runs[ids[1]].status == "success" and r.work() == 4 and done == [2, 5, 3, 9, 1] and seen[0] == (1, 1, 2)
    log = {x.id: x for x in r.log(spark).collect()}
    assert log[ids[5]].status == "failed" and len(log[ids[5]].errors) == 1000 and log[ids[3]].status == "cancelled" and log[ids[1]].errors == "one"
    total = rn.run_batch(r, {"n": 7})
    assert (total["processed"], total["chunks"], total["entities"], total["relations"], total["skipped"], len(total["runs"])) == (4, 4, 3, 2, 1, 2)
    with pytest.raises(ValueError):
        r.enqueue("none", {})


def test_migrations(spark, tmp_path):
    at = tmp_path.as_uri()
    assert mg.applied(spark, at) == [] and mg.apply(spark, at) == [m.version for m in mg.MIGRATIONS]
    assert mg.apply(spark, at) == [] and spark.read.parquet(f"{at}/chunks").columns[0] == "chunk_id"
    more = mg.Migration(99, lambda spark, folder: spark.range(3).write.parquet(f"{folder}/extra"))
    assert mg.apply(spark, at, [more, *mg.MIGRATIONS]) == [99] and mg.applied(spark, at)[-1] == 99
    out = src.out_of_domain(spark.createDataFrame([("structural", "note"), ("odd", "note"), (None, "thing")], "layer string, kind string"))
    assert out.count() == 2


def test_coalesced_requests():
    c = ev.Coalesce(10.0)
    out = [x for r, t in (("a", 0), ("b", 1), ("c", 2), ("d", 12), ("e", 40)) for x in c.offer(r, float(t))] + c.end()
    assert out == [("a", 0.0, "run"), ("b", 2.0, "dropped"), ("c", 10.0, "run"), ("d", 20.0, "run"), ("e", 40.0, "run")]


def _files(spark, path, batches, schema):
    """One file a batch, read in order as a stream."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{path}/{i}")
    kind = spark.read.parquet(f"{path}/0").schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def _collect(stream, spark, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


T = "2024-01-01 00:{:02d}:{:02d}"


def test_rate_limit_stream(spark, tmp_path):
    batches = [[(1, T.format(0, i), i, True) for i in range(3)], [(1, T.format(0, 30), 3, True), (2, T.format(0, 31), 4, False)], [(1, T.format(1, 30), 5, True)], [(3, T.format(30, 0), 6, False)], [(1, T.format(31, 0), 7, True)]]
    s = ev.rate_limited_stream(_files(spark, tmp_path, batches, "note_id long, ts string, event_id long, failed boolean"), 2, 60.0, watermark="1 minute")
    assert {x.event_id: x.refused for x in _collect(s, spark, "limited")} == {0: False, 1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}


def test_buffer_stream(spark, tmp_path):
    batches = [[("q", k, T.format(0, i), i) for i, k in enumerate([1, 2, 1])], [("q", k, T.format(1, i), 10 + i) for i, k in enumerate([3, 4])]]
    s = ev.buffered_stream(_files(spark, tmp_path, batches, "queue string, note_id long, ts string, event_id long"), 3)
    assert [(x.note_id, x.outcome) for x in _collect(s, spark, "buffered")] == [(1, "waiting"), (2, "waiting"), (3, "waiting"), (1, "dropped"), (4, "waiting")]


def test_coalesced_stream(spark, tmp_path):
    batches = [[("p", T.format(0, 0), 1), ("p", T.format(0, 1), 2)], [("p", T.format(0, 2), 3)], [("q", T.format(20, 0), 4)], [("q", T.format(40, 0), 5)]]
    s = ev.coalesced_stream(_files(spark, tmp_path, batches, "pipeline string, ts string, request_id long"), 10.0, watermark="1 minute")
    got = [(x.pipeline, x.request_id, x.outcome) for x in _collect(s, spark, "coalesced")]
    assert sorted(got[:3]) == [("p", 1, "run"), ("p", 2, "dropped"), ("p", 3, "run")] or ("p", 3, "run") in got and ("p", 2, "dropped") in got
    assert ("q", 4, "run") in got and ("q", 5, "run") in got and len(got) == 5


def test_suppressed_stream(spark, tmp_path):
    e = _files(spark, tmp_path / "e", [[(1, T.format(0, 3), 1), (1, T.format(0, 9), 2), (2, T.format(0, 3), 3)], [(9, T.format(50, 0), 4)], [(9, T.format(55, 0), 5)]], "note_id long, ts string, event_id long")
    w = _files(spark, tmp_path / "w", [[(1, T.format(0, 1))], [(8, T.format(50, 0))], [(8, T.format(55, 0))]], "note_id long, ts string").withColumnRenamed("ts", "written_at")
    got = {x.event_id for x in _collect(ev.suppressed_stream(e, w, 5, watermark="1 minute"), spark, "suppressed")}
    assert {2, 3} <= got and 1 not in got


def test_titles_and_toggles_of_chats(spark):
    now = F.lit("2024-01-02").cast("timestamp_ntz")
    m = spark.createDataFrame([(1, 1, "user", "hello", None), (1, 2, "assistant", "hi", None)], "conversation_id long, seq long, role string, content string, error string").withColumn("changed_at", now)
    c = spark.createDataFrame([(1, "kept"), (2, None), (3, None)], "conversation_id long, title string").withColumn("updated_at", now)
    turns = spark.createDataFrame([(1, "s", "more"), (2, "s", "a  new\n talk " + "x" * 80)], "conversation_id long, system string, text string")

    class Failing(pv.StubProvider):
        def chat_stream(self, messages):
            if len(messages) > 2:
                raise OSError("gone")
            yield from ("a", "b")

    talks, after = ch.chat_turn(c, m, turns, now, Failing())
    titles = {x.conversation_id: x.title for x in talks.collect()}
    assert titles[1] == "kept" and titles[3] is None and titles[2].startswith("a new talk x") and len(titles[2]) == 61
    got = sorted((x.conversation_id, x.seq, x.role, x.content, x.error) for x in after.collect() if x.seq > 2 or x.conversation_id == 2)
    assert [(g[0], g[1], g[2], g[3]) for g in got] == [(1, 3, "user", "more"), (1, 4, "assistant", ""), (2, 1, "user", got[2][3]), (2, 2, "assistant", "ab")] and "gone" in got[1][4]
    j = spark.createDataFrame([('[{"index":1,"noteId":"n","title":"t"}]',), ("broken",), (None,)], "t string").select(ch.read_citations(F.col("t")).alias("c")).collect()
    assert [len(x.c) for x in j] == [1, 0, 0] and j[0].c[0].noteId == "n"
