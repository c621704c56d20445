"""Full-text search against SQLite's engine with the same analyzer; golden cases of the syntax and of snippets."""

import sqlite3
from collections import Counter

import pytest

from noteforge.functions.porter import analyze, stem
from noteforge.operators import search as se
from noteforge.plans import catalog
from noteforge.sources import notes as src

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, content, tokenize = 'porter unicode61')")
    con.executemany("INSERT INTO f VALUES (?, ?)", [(r[0], r[1]) for r in src.chunks(spark, SMALL).select("chunk_id", "content").collect()])
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'row')")
    return con


def test_analyzer(spark, index):
    got = Counter(w for r in src.chunks(spark, SMALL).select("content").collect() for w in analyze(r[0]))
    assert dict(index.execute("SELECT term, cnt FROM v")) == dict(got)
    assert [stem(w) for w in "caresses ponies ties cats agreed plastered motoring sky hopping relational adoption controll".split()] == "caress poni ti cat agre plaster motor sky hop relat adopt control".split()
    assert analyze("Éclair, naïve!") == ["eclair", "naiv"] and analyze(None) == []


@pytest.mark.parametrize("name", ["bm25_porter_topk", "search_syntax"])
def test_search_equals_sqlite(spark, index, name):
    asked = catalog._forms(spark, SMALL) if name == "search_syntax" else catalog.src.benchmark_queries(spark, SMALL).withColumn("query", catalog.tx.fts_query(catalog.F.col("query")))
    got: dict = {}
    for r in se.search(asked, src.chunks(spark, SMALL), None, fallback=False).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.score
    errors = matched = 0
    for query_id, query in asked.select("query_id", "query").collect():
        try:
            want = dict(index.execute("SELECT id, -bm25(f) FROM f WHERE f MATCH ?", (query,)).fetchall())
        except sqlite3.OperationalError:
            errors += 1
            with pytest.raises(se.SearchSyntaxError):
                se.parse(query)
            continue
        found = got.get(query_id, {})
        matched += len(want)
        assert found.keys() == want.keys(), query
        if "NEAR" not in query:
            assert all(abs(found[c] - want[c]) < 1e-4 for c in want), query
    assert errors if name == "bm25_porter_topk" else matched


def test_fallback_and_blank(spark):
    chunks = spark.createDataFrame([("c1", "a broken AND query"), ("c2", None), ("c3", "")], "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "broken AND"), (2, " "), (3, None), (4, '""')], "query_id int, query string")
    assert [(r.query_id, r.chunk_id, r.score) for r in se.search(queries, chunks).collect()] == [(1, "c1", 0.0)]
    assert se.search(queries, chunks.limit(0)).count() == 0
    literal = queries.where("query_id = 1").selectExpr("query_id", "query", "'a broken' AS literal")
    assert [(r.chunk_id, r.rank) for r in se.search(literal, chunks).collect()] == [("c1", 1)]


@pytest.mark.parametrize("bad", ["a AND", "OR b", "(a", "a)", '"a', "a.b", "NEAR(a b, x)", "a NOT", "*", "a (b)"])
def test_errors(bad):
    with pytest.raises(se.SearchSyntaxError):
        se.parse(bad)


def test_near():
    assert se.near([[0, 20], [3, 50]], [1, 1], 2) == [[0], [3]]
    assert se.near([[0, 20], [4, 50]], [1, 1], 2) == [[], []]


def test_snippet():
    assert se.snippet("The cats sat.", {"cat"}) == "The [cats] sat."
    text = " ".join(f"w{i}" for i in range(50)) + " cats and dogs here"
    cut = se.snippet(text, {"cat", "dog"}, 5)
    assert cut.startswith("…") and "[cats] and [dogs]" in cut and len(analyze(cut)) == 5
    assert se.snippet("plain words", {"cat"}) == "plain words" and se.snippet(None, {"cat"}) == ""


def test_a_worker_holds_few_words_of_texts(spark, monkeypatch):
    """A batch of many texts comes out in parts, whose stems are given away before the next texts are read; batches are small."""
    texts = spark.createDataFrame([(f"c{i}", f"alpha beta{i} gamma " * 20) for i in range(40)], "chunk_id string, content string")
    run, take = [], type(texts).mapInPandas
    with monkeypatch.context() as m:
        m.setattr(type(texts), "mapInPandas", lambda self, f, *a, **b: run.append(f) or take(self, f, *a, **b))
        want = sorted(map(str, se.positions(texts).collect()))
    monkeypatch.setattr(se, "WORDS", 300)
    parts = list(run[0](iter([texts.toPandas()])))
    assert len(parts) > 5 and max(sum(map(len, p["places"])) for p in parts) <= 360
    assert sorted((r.chunk_id, r.len, r.term, tuple(r.places)) for p in parts for r in p.itertuples()) == sorted((f"c{i}", 60, t, tuple(range(j, 60, 3))) for i in range(40) for j, t in enumerate(("alpha", f"beta{i}", "gamma")))
    assert len(want) == 120
    batches, staged = {}, se.staged
    monkeypatch.setattr(se, "staged", lambda df, name, batch=None: batches.setdefault(name, batch) and False or staged(df, name, batch))
    assert se.search(spark.createDataFrame([(1, "alpha gamma")], "query_id long, query string"), texts, None).count() == 40
    assert 0 < batches["positions"] <= 1000 and 0 < batches["seen"] <= 1000


def test_only_asked_stems_are_kept_and_no_pair_is_moved(spark, monkeypatch):
    """Other stems of the texts are neither staged nor moved; queries of single words need no places."""
    texts = [(f"c{i}", f"cats {'dogs ' * (i % 3)}or birds x{i} {'far ' * (i % 7)}mice {'running' if i % 2 else 'runs'}") for i in range(60)]
    chunks = spark.createDataFrame(texts, "chunk_id string, content string")
    forms = ["cat AND dog", "dog NOT bird", "bird OR zebra", "(zebra OR dog) NOT x3", "NEAR(bird mice, 3)", "NEAR(dog zebra)", '"cats dogs"', "mouse + ru*", "run* NOT dog", "mice"]
    queries = spark.createDataFrame(list(enumerate(forms)), "query_id long, query string")
    plans, kept, write = {}, {}, se.staged

    def staged(df, name, *a):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        kept[name] = write(df, name, *a)
        return kept[name]

    monkeypatch.setattr(se, "staged", staged)
    got = sorted(map(tuple, se.search(queries, chunks, None).collect()))
    assert {r[0] for r in kept["positions"].where("term IS NOT NULL").select("term").distinct().collect()} == {"cat", "dog", "bird", "mice", "run", "x3"}
    assert "hashpartitioning(query_id" not in plans["seen"] and "hashpartitioning(chunk_id" in plans["seen"]
    monkeypatch.setattr(se, "TABLED", -1)  # all by their places
    monkeypatch.setattr(se, "_few", lambda df: False)  # and with all stems
    assert sorted(map(tuple, se.search(queries, chunks, None).collect())) == got and len({r[0] for r in got}) >= 7
