"""Queries over a small corpus of parts, on which all five retrievers act: two chunks a note, links and brands as a graph, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteforge.functions import text as tx
from noteforge.operators import indexing as ix
from noteforge.operators import retrieval as rt
from noteforge.plans.catalog import _EDIT, _GRAMS, _tok, query
from noteforge.sources import notes as src


def corpus(spark, d) -> rt.Corpus:
    """Parts as notes: chunk 0 holds name and type, chunk 1 brand, size and name; nodes for notes (structural) and brands (semantic)."""
    p = src.table(spark, d, "part")
    note = F.concat(F.lit("p"), "p_partkey")
    rows = F.array(F.struct(F.lit(0).alias("i"), F.concat_ws(" ", "p_name", "p_type").alias("content")), F.struct(F.lit(1).alias("i"), F.concat_ws(" ", "p_brand", F.lit("size"), "p_size", "p_name").alias("content")))
    chunks = p.select(note.alias("note_id"), F.explode(rows).alias("r")).select(F.concat("note_id", F.lit(":"), "r.i").alias("chunk_id"), "note_id", "r.content")
    notes = p.select(note.alias("note_id"), F.col("p_name").alias("title"))
    vectors = src.table(spark, d, "embeddings").select(F.concat(F.lit("p"), "vec_id", F.lit(":0")).alias("chunk_id"), F.col("embedding").alias("vector"))
    nodes = p.select(F.concat(F.lit("note:p"), "p_partkey").alias("id"), F.lit("structural").alias("layer"), F.lit("note").alias("kind"), F.col("p_name").alias("label"), note.alias("note_id"))
    nodes = nodes.union(p.select(F.concat(F.lit("brand:"), "p_brand"), F.lit("semantic"), F.lit("entity"), "p_brand", F.lit(None).cast("string")).distinct())
    edges = p.select(F.lit("structural").alias("layer"), F.concat(F.lit("note:p"), "p_partkey").alias("source_id"), F.concat(F.lit("note:p"), F.col("p_partkey") + 1).alias("target_id"), F.lit(1.0).alias("weight"))
    edges = edges.union(p.select(F.lit("semantic"), F.concat(F.lit("note:p"), "p_partkey"), F.concat(F.lit("brand:"), "p_brand"), F.lit(0.5)))
    return rt.Corpus(chunks, notes, vectors, nodes, edges)


def asked(spark, d):
    """Every fiftieth part's name as a query, with the vector whose number is the part's, divided by fifty."""
    p = src.table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"), F.expr("p_partkey div 50").alias("vec_id"))
    return p.join(src.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id", "left").drop("vec_id")


def _rank(by: str, k: int) -> str:
    return f"row_number() OVER (PARTITION BY query_id ORDER BY {by}) AS rank", f"WHERE rank <= {k}"


CORPUS = f"""c AS MATERIALIZED (SELECT 'p' || p_partkey || ':0' AS chunk_id, 'p' || p_partkey AS note_id, p_name || ' ' || p_type AS content FROM part UNION ALL SELECT 'p' || p_partkey || ':1', 'p' || p_partkey, p_brand || ' size ' || p_size || ' ' || p_name FROM part),
q AS (SELECT p_partkey AS query_id, p_name AS query, p_partkey // 50 AS vec_id FROM part WHERE p_partkey % 50 = 0),
ct AS MATERIALIZED (SELECT *, {_tok('content')} AS ts FROM c),
p AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT chunk_id, len(ts) AS len, unnest(ts) AS term FROM ct) GROUP BY ALL), df AS MATERIALIZED (SELECT term, count(*) AS df FROM p GROUP BY term)"""
BM25 = f"""bq AS (SELECT query_id, unnest(list_distinct({_tok('query')})) AS term, len(list_distinct({_tok('query')})) AS terms FROM q),
bs AS (SELECT query_id, chunk_id, round(sum(greatest(1e-6, ln(((SELECT count(*) FROM c)::DOUBLE - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len(ts)) FROM ct)))), 6) AS score FROM bq JOIN p ON p.term = bq.term JOIN df ON df.term = bq.term GROUP BY query_id, chunk_id HAVING count(*) = any_value(terms)),
bm25 AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs) WHERE rank <= 50)"""
TFIDF = f"""dw AS (SELECT chunk_id, p.term, tf / len * (ln(((SELECT count(*) FROM c) + 1.0) / (df + 1)) + 1) AS w FROM p JOIN df ON p.term = df.term),
dn AS (SELECT chunk_id, sqrt(sum(w * w)) AS dn FROM dw GROUP BY chunk_id),
qt AS (SELECT query_id, len, term, count(*) AS tf FROM (SELECT query_id, len({_tok('query')}) AS len, unnest({_tok('query')}) AS term FROM q) GROUP BY ALL),
qw AS (SELECT query_id, qt.term, tf / len * coalesce(ln(((SELECT count(*) FROM c) + 1.0) / (df + 1)) + 1, 1.0) AS w FROM qt LEFT JOIN df ON qt.term = df.term),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM qw GROUP BY query_id),
ts AS (SELECT qw.query_id, dw.chunk_id, round(sum(dw.w * qw.w) / (any_value(dn) * any_value(qn)), 6) AS score FROM dw JOIN qw ON dw.term = qw.term JOIN dn ON dn.chunk_id = dw.chunk_id JOIN qn ON qn.query_id = qw.query_id GROUP BY ALL),
tfidf AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ts WHERE score > 0) WHERE rank <= 50)"""
FUZZY = f"""fq AS (SELECT query_id, {_EDIT.format('query')} AS qk FROM q), ft AS (SELECT p_partkey, {_EDIT.format('p_name')} AS tk FROM part),
fm AS (SELECT qk, tk, damerau_levenshtein(qk, tk) AS distance FROM (SELECT DISTINCT qk FROM fq), (SELECT DISTINCT tk FROM ft) WHERE list_has_any({_GRAMS.format('qk')}, {_GRAMS.format('tk')})),
fs AS (SELECT query_id, c.chunk_id, min(distance) AS distance FROM fq JOIN fm USING (qk) JOIN ft USING (tk) JOIN c ON c.note_id = 'p' || p_partkey WHERE distance < 10 GROUP BY ALL),
fuzzy AS (SELECT * FROM (SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM fs) WHERE rank <= 50)"""
DENSE = """dv AS (SELECT 'p' || vec_id || ':0' AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings WHERE 'p' || vec_id || ':0' IN (SELECT chunk_id FROM c)),
dq AS (SELECT query_id, embedding::DOUBLE[] AS v FROM q JOIN embeddings USING (vec_id)),
dense AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(round(list_cosine_similarity(dq.v, dv.v), 9), 6) DESC, chunk_id) AS rank FROM dq, dv) WHERE rank <= 20)"""


def graph_sql(layer: str = "both") -> str:
    of = "" if layer == "both" else f"WHERE layer = '{layer}'"
    return f"""gn AS (SELECT * FROM (SELECT 'note:p' || p_partkey AS id, 'structural' AS layer, 'note' AS kind, p_name AS label, 'p' || p_partkey AS note_id FROM part UNION ALL SELECT DISTINCT 'brand:' || p_brand, 'semantic', 'entity', p_brand, NULL FROM part) {of}),
ge AS (SELECT * FROM (SELECT 'structural' AS layer, 'note:p' || p_partkey AS a, 'note:p' || (p_partkey + 1) AS b, 1.0::DOUBLE AS w FROM part UNION ALL SELECT 'semantic', 'note:p' || p_partkey, 'brand:' || p_brand, 0.5 FROM part) {of}),
gt AS (SELECT query_id, unnest(string_split_regex(lower(query), '\\s+')) AS term FROM q), gs AS (SELECT DISTINCT query_id, id AS seed FROM gn JOIN gt ON contains(lower(label), term)),
gb AS (SELECT a AS seed, b AS id, w FROM ge UNION ALL SELECT b, a, w FROM ge),
gh AS (SELECT query_id, gn.note_id, round(max(w) / 2, 6) AS score FROM gs JOIN gb USING (seed) JOIN gn ON gn.id = gb.id AND kind = 'note' GROUP BY ALL),
graph AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM gh JOIN c USING (note_id)) WHERE rank <= 50)"""


FUSED = """u AS (SELECT query_id, chunk_id, rank, 'bm25' AS r FROM bm25 UNION ALL SELECT query_id, chunk_id, rank, 'tfidf' FROM tfidf UNION ALL SELECT query_id, chunk_id, rank, 'fuzzy' FROM fuzzy UNION ALL SELECT query_id, chunk_id, rank, 'dense' FROM dense UNION ALL SELECT query_id, chunk_id, rank, 'graph' FROM graph),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(r, ',' ORDER BY r) AS retrievers FROM u GROUP BY query_id, chunk_id),
all_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 50)"""
RETRIEVED = f"{CORPUS}, {BM25}, {TFIDF}, {FUZZY}, {DENSE}, {graph_sql()}, {FUSED}"


@query(f"WITH {RETRIEVED} SELECT query_id, chunk_id, note_id, score, retrievers, rank FROM all_hits JOIN c USING (chunk_id)")
def retrieve_all(spark, d):
    return rt.retrieve(asked(spark, d), corpus(spark, d)).select("query_id", "chunk_id", "note_id", "score", "retrievers", "rank")


#: At most one chunk of a note, then a budget that cuts most lists.
ASSEMBLED = f"""{RETRIEVED}, h AS (SELECT query_id, chunk_id, note_id, content, score, retrievers, ceil(length(content) / 4.0)::BIGINT AS tokens FROM all_hits JOIN c USING (chunk_id)),
one AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, note_id ORDER BY score DESC, chunk_id) <= 1),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS upto FROM one),
x AS (SELECT o.*, p_name AS title FROM o JOIN part ON note_id = 'p' || p_partkey WHERE NOT (upto > 100 AND upto - tokens > 0))"""


def _assembled(spark, d):
    c = corpus(spark, d)
    hits = rt.retrieve(asked(spark, d), c).drop("rank")
    return rt.assemble(rt.with_texts(hits, c), 100, 1)


@query(f"WITH {ASSEMBLED} SELECT query_id, count(*) AS n, sum(tokens)::BIGINT AS total_tokens, string_agg(chunk_id, ',' ORDER BY place) AS chunks FROM x GROUP BY query_id")
def chat_context(spark, d):
    got = rt.chat_context(_assembled(spark, d))
    return got.select("query_id", F.size("chunks").cast("long").alias("n"), "total_tokens", F.array_join(F.transform("chunks", lambda r: r["chunk_id"]), ",").alias("chunks"))


@query(f"WITH {ASSEMBLED} SELECT query_id, place, note_id, title, content AS chunk_text, score, retrievers FROM x")
def search_rows(spark, d):
    return rt.search_rows(_assembled(spark, d))


@query(f"""WITH {CORPUS}, {BM25}, {TFIDF}, a AS (SELECT query_id, chunk_id, 1.0::DOUBLE / rank AS score, rank FROM bm25 UNION ALL SELECT query_id, chunk_id, 0.9 / rank, rank FROM tfidf),
b AS (SELECT query_id, chunk_id, max(round(score, 6)) AS score FROM a GROUP BY ALL), h AS (SELECT query_id, chunk_id, note_id, score, ceil(length(content) / 4.0)::BIGINT AS tokens FROM b JOIN c USING (chunk_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, note_id) AS place, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, note_id ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, note_id ORDER BY score DESC, chunk_id) <= 1))
SELECT query_id, place, chunk_id, score FROM o WHERE NOT (upto > 120 AND upto - tokens > 0)""")
def context_of_repeated_hits(spark, d):
    """The same chunk found by two retrievers counts once, with its best score."""
    c, q = corpus(spark, d), asked(spark, d)
    index = rt.Index.of(c.chunks)
    hits = rt.bm25(q, c.chunks, index=index).withColumn("score", F.round(1 / F.col("rank"), 6)).union(rt.tfidf(q, c.chunks, index=index).withColumn("score", F.round(0.9 / F.col("rank"), 6)))
    return rt.assemble(hits.join(c.chunks, "chunk_id"), 120, 1).select("query_id", "place", "chunk_id", "score")


@query(f"WITH {CORPUS}, {graph_sql('structural')} SELECT query_id, chunk_id, score, rank FROM graph")
def graph_structural_chunks(spark, d):
    c = corpus(spark, d)
    return rt.graph_chunks(asked(spark, d), c.nodes, c.edges, c.chunks, layer="structural")


@query(f"WITH {CORPUS}, {FUZZY} SELECT query_id, chunk_id, (-distance)::DOUBLE AS score, rank FROM fuzzy")
def fuzzy_chunks(spark, d):
    c = corpus(spark, d)
    return rt.fuzzy_chunks(asked(spark, d), c.notes, c.chunks)


@query(f"WITH {CORPUS}, {DENSE} SELECT query_id, chunk_id, rank FROM dense")
def dense_chunks(spark, d):
    c = corpus(spark, d)
    return rt.dense(asked(spark, d).where("vector IS NOT NULL"), c.vectors.join(c.chunks.select("chunk_id"), "chunk_id", "left_semi"), 20, key="chunk_id").select("query_id", "chunk_id", "rank")


@query("SELECT p_partkey AS query_id, 'p' || m.k AS note_id, 0.0::DOUBLE AS score FROM (SELECT p_partkey, substr(p_name, 2, 3) AS t FROM part WHERE p_partkey % 50 = 0) q JOIN (SELECT p_partkey AS k, p_name FROM part) m ON contains(lower(m.p_name), lower(q.t))")
def like_inside_words(spark, d):
    """Three signs from inside a word: no word of the text equals them."""
    c = corpus(spark, d)
    q = src.table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.substring("p_name", 2, 3).alias("query"))
    return rt.like(q, c.notes, ["title"], "note_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def notes_by_ids(spark, d):
    p = src.table(spark, d, "part").select(F.col("p_partkey").alias("note_id"), "p_name")
    wanted = src.table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("note_id"))
    return ix.by_ids(p, wanted.union(spark.range(1).select(F.lit(-1)))).withColumnRenamed("note_id", "p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 7")
def note_by_id(spark, d):
    return ix.note_by_id(src.table(spark, d, "part").select(F.col("p_partkey").alias("note_id"), "p_name"), 7).withColumnRenamed("note_id", "p_partkey")


@query("SELECT 'c' || c_custkey AS note_id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def folder_scope(spark, d):
    c = src.table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("note_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    return ix.resolve_scope(c, src.folders(spark, d), folder="r1").select("note_id")


@query("SELECT DISTINCT 'd' || doc_id AS note_id, lang AS tag_id, upper(lang) AS title FROM documents UNION SELECT 'd' || doc_id, 'toxic', 'TOXIC' FROM labels WHERE toxic = 1")
def note_tags(spark, d):
    from noteforge.plans.catalog import _tagged

    return _tagged(spark, d)


@query("SELECT part.p_partkey AS id, CASE WHEN p_size <= 10 THEN 'small' ELSE 'large' END AS kind FROM part WHERE p_size > 10")
def out_of_domain(spark, d):
    rows = src.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 10, "small").otherwise("large").alias("kind"))
    return src.out_of_domain(rows, {"kind": ["small"]})


@query("SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'A' THEN 'enrichment' ELSE 'user' END AS source FROM lineitem WHERE l_returnflag <> 'A' OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def enrichment_removed(spark, d):
    from noteforge.operators import semantic as sm

    rows = src.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_returnflag") == "A", "enrichment").otherwise("user").alias("source"), F.concat(F.lit("note:"), "l_orderkey").alias("source_id"))
    gone = src.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("note_id"))
    return sm.without_enrichment(rows, gone).select("id", "source")


@query("SELECT vec_id, len(embedding)::BIGINT AS dims, true AS same FROM embeddings")
def vector_round_trip(spark, d):
    from noteforge.functions.vectors import from_bytes, to_bytes

    e = src.table(spark, d, "embeddings").withColumn("back", from_bytes(to_bytes("embedding")))
    return e.select("vec_id", F.size("back").cast("long").alias("dims"), (F.col("back") == F.col("embedding")).alias("same"))


@query("SELECT event_id, substr(sha256(user_id::VARCHAR || event_type), 1, 8) AS fingerprint, substr(repeat(event_type || ' & <\"' || '''>', 90), 1, 1000) AS error, replace(replace(replace(replace(replace(event_type || ' & <\"' || '''>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM events")
def small_functions(spark, d):
    text = F.concat("event_type", F.lit(" & <\"'>"))
    return src.table(spark, d, "events").select("event_id", tx.fingerprint(F.concat("user_id", "event_type")).alias("fingerprint"), tx.cut_error(F.repeat(text, 90)).alias("error"), tx.escape_html(text).alias("html"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE substr(text, 1, 20) END AS said FROM conversations")
def sse_texts(spark, d):
    """Streams of two deltas, broken JSON and other fields between them; odd ones say [DONE] before the second."""
    event = lambda t: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("delta"))).alias("choices"))), F.lit("\r\n\r\n"))
    c = src.table(spark, d, "conversations")
    first, rest = F.substring("text", 1, 20), F.expr("substring(text, 21)")
    done = F.when(F.col("turn") % 2 == 1, F.lit("data: [DONE]\n\n")).otherwise(F.lit(""))
    body = F.concat(F.lit(": hello\nevent: x\n\n"), event(first), F.lit("data: {broken\n\n"), done, event(rest))
    return c.select("conv_id", "turn", F.array_join(tx.sse_deltas(body), "").alias("said"))
