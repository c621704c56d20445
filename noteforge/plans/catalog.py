"""Queries of the note engine over the fixture tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from noteforge.functions import text as tx
from noteforge.operators import chats as ch
from noteforge.operators import extraction as xt
from noteforge.operators import canonical as cn
from noteforge.operators import cells as ce
from noteforge.operators import indexing as ix
from noteforge.operators import inverted as iv
from noteforge.operators import retrieval as rt
from noteforge.operators import runs as rn
from noteforge.operators import search as se
from noteforge.operators import semantic as sm
from noteforge.sources import notes as src
from noteforge.sources.staging import shared_dir
from noteforge.streaming import events as ev

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def _tok(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda t: length(t) > 1 AND t NOT IN ({STOPS}))"


DOCS = f"c AS MATERIALIZED (SELECT 'd' || doc_id || ':0' AS chunk_id, 'd' || doc_id AS note_id, text AS content, {_tok('text')} AS ts FROM documents)"
TERMS = "p AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT chunk_id, len(ts) AS len, unnest(ts) AS term FROM c) GROUP BY ALL), df AS MATERIALIZED (SELECT term, count(*) AS df FROM p GROUP BY term)"
TFIDF = f"""{DOCS}, {TERMS},
dw AS (SELECT chunk_id, p.term, tf / len * (ln(((SELECT count(*) FROM c) + 1.0) / (df + 1)) + 1) AS w FROM p JOIN df ON p.term = df.term),
dn AS (SELECT chunk_id, sqrt(sum(w * w)) AS dn FROM dw GROUP BY chunk_id),
qt AS (SELECT query_id, len, term, count(*) AS tf FROM (SELECT item_id AS query_id, len({_tok('text')}) AS len, unnest({_tok('text')}) AS term FROM benchmark) GROUP BY ALL),
qw AS (SELECT query_id, qt.term, tf / len * coalesce(ln(((SELECT count(*) FROM c) + 1.0) / (df + 1)) + 1, 1.0) AS w FROM qt LEFT JOIN df ON qt.term = df.term),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM qw GROUP BY query_id),
ts AS (SELECT qw.query_id, dw.chunk_id, round(sum(dw.w * qw.w) / (any_value(dn) * any_value(qn)), 6) AS score FROM dw JOIN qw ON dw.term = qw.term JOIN dn ON dn.chunk_id = dw.chunk_id JOIN qn ON qn.query_id = qw.query_id GROUP BY ALL),
tfidf AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ts WHERE score > 0) WHERE rank <= 50)"""
BM25 = f"""bq AS (SELECT item_id AS query_id, unnest(list_distinct({_tok('text')})) AS term, len(list_distinct({_tok('text')})) AS terms FROM benchmark),
bs AS (SELECT query_id, chunk_id, round(sum(greatest(1e-6, ln(((SELECT count(*) FROM c)::DOUBLE - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len(ts)) FROM c)))), 6) AS score FROM bq JOIN p ON p.term = bq.term JOIN df ON df.term = bq.term GROUP BY query_id, chunk_id HAVING count(*) = any_value(terms)),
bm25 AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs) WHERE rank <= 50)"""
RRF = "rrf AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(r, ',' ORDER BY r) AS retrievers FROM (SELECT query_id, chunk_id, rank, 'bm25' AS r FROM bm25 UNION ALL SELECT query_id, chunk_id, rank, 'tfidf' FROM tfidf) GROUP BY query_id, chunk_id)"


@query(f"SELECT doc_id, len(ts)::BIGINT AS n_tokens, array_to_string(ts, ' ') AS terms FROM (SELECT doc_id, {_tok('text')} AS ts FROM documents)")
def tokenize_terms(spark, d):
    t = src.table(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("terms"))


@query(f"WITH {DOCS}, {TERMS} SELECT term, df FROM df")
def doc_frequency(spark, d):
    return rt.document_frequency(src.chunks(spark, d))


@query(f"WITH {TFIDF} SELECT * FROM tfidf")
def tfidf_topk(spark, d):
    return rt.tfidf(src.benchmark_queries(spark, d), src.chunks(spark, d))


@query(f"WITH {DOCS}, {TERMS}, {BM25} SELECT * FROM bm25")
def bm25_topk(spark, d):
    return rt.bm25(src.benchmark_queries(spark, d), src.chunks(spark, d))


def _kept_index(spark, d):
    """An index of three runs: some of the chunks, of which many change, go and come again; in the end all of them as they are."""
    c = src.chunks(spark, d)
    k = F.xxhash64("chunk_id") % 7
    folder = f"{shared_dir(spark)}/noteforge/inverted-{uuid.uuid4().hex}"
    iv.sync(spark, folder, c.where(k != 0).withColumn("content", F.when(k == 1, F.concat(F.lit("once upon a time "), "content")).otherwise(F.col("content"))))
    iv.sync(spark, folder, c.where(k != 2).withColumn("content", F.when(k == 3, "nothing of what it was").otherwise(F.col("content"))))
    return iv.sync(spark, folder, c)


@query(f"WITH {DOCS}, {TERMS}, {BM25} SELECT * FROM bm25")
def bm25_kept_index(spark, d):
    return _kept_index(spark, d).bm25(src.benchmark_queries(spark, d))


@query(f"WITH {TFIDF} SELECT * FROM tfidf")
def tfidf_kept_index(spark, d):
    return _kept_index(spark, d).tfidf(src.benchmark_queries(spark, d))


@query(f"WITH {DOCS}, {TERMS} SELECT term, df FROM df")
def kept_frequencies(spark, d):
    return _kept_index(spark, d).frequencies


@query("SELECT item_id AS query_id, 'd' || doc_id AS note_id, 0.0::DOUBLE AS score FROM documents, benchmark WHERE contains(lower(documents.text), lower(benchmark.text))")
def like_fallback(spark, d):
    return rt.like(src.benchmark_queries(spark, d), src.notes(spark, d), ["body"], "note_id")


_EDIT = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_GRAMS = "list_distinct(list_transform(range(1, length('  ' || {0} || ' ') - 1), lambda i: substr('  ' || {0} || ' ', i, 3)))"


@query(f"""WITH q AS (SELECT p_partkey AS query_id, {_EDIT.format('p_name')} AS qk FROM part WHERE p_partkey % 50 = 0), t AS (SELECT DISTINCT p_name AS title, {_EDIT.format('p_name')} AS tk FROM part),
m AS (SELECT qk, tk, damerau_levenshtein(qk, tk) AS distance FROM (SELECT DISTINCT qk FROM q), (SELECT DISTINCT tk FROM t) WHERE list_has_any({_GRAMS.format('qk')}, {_GRAMS.format('tk')}))
SELECT query_id, title, distance, rank FROM (SELECT query_id, title, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, title) AS rank FROM q JOIN m USING (qk) JOIN t USING (tk)) WHERE rank <= 10""")
def fuzzy_title_topk(spark, d):
    part = src.table(spark, d, "part")
    return rt.fuzzy(part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query")), part.select(F.col("p_name").alias("title")))


DENSE_KNN = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(round(list_cosine_similarity(q.v, v.v), 9), 6) AS score FROM v q, v WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


@query(DENSE_KNN)
def dense_knn(spark, d):
    v = src.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return rt.dense(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v)


def _cells(spark, d):
    v = src.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), ce.build(spark, f"{shared_dir(spark)}/noteforge/cells-{uuid.uuid4().hex}", v)


@query(DENSE_KNN)
def dense_index_exact(spark, d):
    """What `dense_knn` finds, by cells whose bound reaches the k-th score."""
    q, kept = _cells(spark, d)
    return kept.search(q, 20, exact=True)


@query()
def dense_index_knn(spark, d):
    """The nearest vectors of the most promising cells; the test asks for nine of ten of the exact hits."""
    q, kept = _cells(spark, d)
    return kept.search(q, 20)


GRAPH_NODES = "n AS (SELECT 'c' || c_custkey AS id, 'note' AS kind, c_name AS label FROM customer UNION ALL SELECT 's' || s_suppkey, 'note', s_name FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'tag', n_name FROM nation)"
GRAPH_EDGES = "e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b, 1.0::DOUBLE AS w FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 0.5 FROM supplier)"


def _graph(spark, d):
    c, s, n = (src.table(spark, d, t) for t in ("customer", "supplier", "nation"))
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("note").alias("kind"), F.col("c_name").alias("label"))
    nodes = nodes.union(s.select(F.concat(F.lit("s"), "s_suppkey"), F.lit("note"), "s_name")).union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.lit("tag"), "n_name"))
    edges = c.select(F.concat(F.lit("c"), "c_custkey").alias("source_id"), F.concat(F.lit("n"), "c_nationkey").alias("target_id"), F.lit(1.0).alias("weight"))
    return nodes, edges.union(s.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.lit(0.5)))


@query(f"""WITH {GRAPH_NODES}, {GRAPH_EDGES}, q AS (SELECT n_nationkey AS query_id, unnest(string_split_regex(lower(n_name), '\\s+')) AS term FROM nation),
s AS (SELECT DISTINCT query_id, id AS seed FROM n JOIN q ON contains(lower(label), term)), b AS (SELECT a AS seed, b AS id, w FROM e UNION ALL SELECT b, a, w FROM e),
h AS (SELECT query_id, b.id AS node_id, round(max(w) / 2, 6) AS score FROM s JOIN b USING (seed) JOIN n ON n.id = b.id AND kind = 'note' GROUP BY ALL)
SELECT * FROM (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM h) WHERE rank <= 50""")
def graph_expand(spark, d):
    return rt.graph(src.table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("query")), *_graph(spark, d))


@query(f"WITH {GRAPH_EDGES} SELECT id AS node_id, count(*) AS degree, sum(w) AS weight FROM (SELECT a AS id, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY id")
def graph_degree(spark, d):
    _, e = _graph(spark, d)
    return e.select(F.col("source_id").alias("node_id"), "weight").union(e.select("target_id", "weight")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"))


def _hits(spark, d, enabled=None):
    """Hits of the enabled retrievers; the others don't run."""
    q, c = src.benchmark_queries(spark, d), src.chunks(spark, d)
    index = rt.Index.of(c)
    return {name: find(q, c, index=index) for name, find in (("bm25", rt.bm25), ("tfidf", rt.tfidf)) if (enabled or {}).get(name, True)}


@query(f"WITH {TFIDF}, {BM25}, {RRF} SELECT query_id, chunk_id, score FROM rrf")
def rrf_fuse(spark, d):
    return rt.fuse(_hits(spark, d)).select("query_id", "chunk_id", "score")


@query(f"WITH {TFIDF} SELECT query_id, chunk_id, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM tfidf")
def rrf_disabled_retriever(spark, d):
    enabled = {"bm25": False}
    return rt.fuse(_hits(spark, d, enabled), enabled=enabled).select("query_id", "chunk_id", "score")


@query(f"WITH {TFIDF}, {BM25}, {RRF} SELECT query_id, chunk_id, retrievers FROM rrf")
def contributing_retrievers(spark, d):
    return rt.fuse(_hits(spark, d)).select("query_id", "chunk_id", "retrievers")


@query(f"""WITH {TFIDF}, {BM25}, {RRF}, h AS (SELECT query_id, chunk_id, note_id, score, ceil(length(content) / 4.0)::BIGINT AS tokens FROM rrf JOIN c USING (chunk_id)),
o AS (SELECT *, row_number() OVER w AS place, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS upto FROM h WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id))
SELECT query_id, place, chunk_id, note_id, score, tokens FROM o WHERE NOT (upto > 4000 AND upto - tokens > 0)""")
def context_assemble(spark, d):
    sizes = src.chunks(spark, d).select("chunk_id", "note_id", tx.estimate_tokens(F.col("content")).alias("tokens"))
    hits = rt.of_chunks(rt.fuse(_hits(spark, d)).drop("note_id"), sizes)
    return rt.assemble(hits).select("query_id", "place", "chunk_id", "note_id", "score", "tokens")


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return src.table(spark, d, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


HASH = "sha256(nfc_normalize('Document ' || doc_id) || chr(10) || nfc_normalize(text))"


@query(f"SELECT 'd' || doc_id AS note_id, {HASH} AS content_hash FROM documents")
def content_hash(spark, d):
    return src.notes(spark, d).select("note_id", tx.content_hash(F.col("title"), F.col("body")).alias("content_hash"))


#: Documents hold no headings and fences, so a note is one section, cut at the last blank line, line end or blank in the second half.
_CUT = "coalesce(" + ", ".join(f"nullif((SELECT CASE WHEN p BETWEEN 1000 AND 2000 THEN p ELSE -1 END FROM (SELECT length(head) - strpos(reverse(head), reverse({m})) - {n} + 1 AS p, strpos(head, {m}) AS f FROM (SELECT substr(rest, 1, 2000 + {n}) AS head)) WHERE f > 0), -1)" for m, n in (("chr(10) || chr(10)", 2), ("chr(10)", 1), ("' '", 1))) + ", 2000)"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
CHUNKS = f"""w AS (SELECT doc_id, trim('# Document ' || doc_id || chr(10) || chr(10) || text, {_BLANKS}) AS t FROM documents WHERE trim(text, {_BLANKS}) <> ''),
r AS (SELECT doc_id, 0 AS n, NULL::VARCHAR AS piece, t AS rest FROM w UNION ALL SELECT doc_id, n + 1, trim(substr(rest, 1, cut), {_BLANKS}), trim(substr(rest, cut + 1), {_BLANKS}) FROM (SELECT *, CASE WHEN length(rest) <= 2000 THEN length(rest) ELSE {_CUT} END AS cut FROM r WHERE rest <> '')),
raw AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index, piece AS raw FROM r WHERE piece <> ''),
led AS (SELECT *, right(lag(raw) OVER (PARTITION BY doc_id ORDER BY chunk_index), 200) AS tail FROM raw),
ch AS (SELECT 'd' || doc_id || ':' || chunk_index AS chunk_id, 'd' || doc_id AS note_id, chunk_index, raw, CASE WHEN tail IS NULL OR trim(tail, {_BLANKS}) = '' THEN raw WHEN length(tail) > 20 AND starts_with(raw, substr(ltrim(tail, {_BLANKS}), 1, 20)) THEN raw ELSE tail || chr(10) || chr(10) || raw END AS content FROM led)"""


@query(f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, note_id, chunk_index, content, ceil(length(content) / 4.0)::BIGINT AS token_count FROM ch")
def chunk_notes(spark, d):
    return ix.chunk_notes(src.notes(spark, d)).select("chunk_id", "note_id", "chunk_index", "content", "token_count")


@query(f"WITH RECURSIVE {CHUNKS} SELECT note_id, chunk_index AS position, regexp_extract(raw, '^([^\n]*)', 1) AS heading FROM ch")
def chunk_sections(spark, d):
    c = ix.chunk_notes(src.notes(spark, d))
    return c.select("note_id", F.col("chunk_index").alias("position"), F.regexp_extract("raw", r"^([^\n]*)", 1).alias("heading"))


@query(f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, length(content) - length(raw) AS overlap FROM ch")
def chunk_overlap(spark, d):
    c = ix.chunk_notes(src.notes(spark, d))
    return c.select("chunk_id", (F.length("content") - F.length("raw")).cast("long").alias("overlap"))


def _linked(spark, d):
    """Parts as notes whose body links their brand and the names of two neighbours, one by an alias."""
    p = src.table(spark, d, "part")
    body = F.concat(F.lit("see [["), "p_name", F.lit("]] and [["), "p_brand", F.lit("|brand]] or [["), F.upper("p_name"), F.lit("]]"))
    return p.select(F.col("p_partkey").cast("string").alias("note_id"), F.col("p_name").alias("title"), body.alias("body"), F.col("p_partkey").alias("created_at"))


@query("SELECT p_partkey::VARCHAR AS note_id, 0::BIGINT AS position, p_name AS target, NULL::VARCHAR AS alias FROM part UNION ALL SELECT p_partkey::VARCHAR, 1, p_brand, 'brand' FROM part")
def wiki_links(spark, d):
    return ix.wiki_links(_linked(spark, d))


LINKS = "l AS (SELECT p_partkey::VARCHAR AS note_id, p_name AS target FROM part UNION ALL SELECT p_partkey::VARCHAR, p_brand FROM part), t AS (SELECT lower(trim(p_name)) AS key, arg_min(p_partkey::VARCHAR, p_partkey) AS target_id FROM part GROUP BY ALL), r AS (SELECT note_id, target, target_id FROM l LEFT JOIN t ON lower(trim(target)) = key)"


@query(f"WITH {LINKS} SELECT * FROM r")
def link_resolve(spark, d):
    n = _linked(spark, d)
    return ix.resolve_links(ix.wiki_links(n), n).select("note_id", "target", "target_id")


@query(f"WITH {LINKS} SELECT note_id, count(*) FILTER (WHERE target_id IS NULL) AS unresolved FROM r GROUP BY note_id")
def unresolved_links(spark, d):
    n = _linked(spark, d)
    return ix.unresolved(ix.resolve_links(ix.wiki_links(n), n))


@query(f"WITH {LINKS} SELECT DISTINCT 'note:' || target_id || '->note:' || note_id || ':backlink' AS id, 'note:' || target_id AS source_id, 'note:' || note_id AS target_id FROM r WHERE target_id IS NOT NULL")
def backlinks(spark, d):
    n = _linked(spark, d)
    edges = ix.structural_edges(ix.resolve_links(ix.wiki_links(n), n), _tagged(spark, d))
    return edges.where("type = 'backlink'").select("id", "source_id", "target_id")


@query("SELECT 'note:d' || doc_id || '->tag:' || tag || ':tag' AS id, 'note:d' || doc_id AS source_id, 'tag:' || tag AS target_id FROM (SELECT doc_id, lang AS tag FROM documents UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)")
def tag_edges(spark, d):
    none = spark.createDataFrame([], "note_id string, target_id string")
    return ix.structural_edges(none, _tagged(spark, d)).select("id", "source_id", "target_id")


def _tagged(spark, d):
    """note_id, tag_id, title: each document's language and, where it is labelled so, `toxic`, as tags of notes."""
    tags = src.table(spark, d, "documents").select(F.col("lang").alias("tag_id")).union(spark.range(1).select(F.lit("toxic"))).distinct().withColumn("title", F.upper("tag_id"))
    given = src.table(spark, d, "documents").select("doc_id", F.col("lang").alias("tag_id")).union(src.table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("toxic")))
    return ix.tags_of(tags, given.select(F.concat(F.lit("d"), "doc_id").alias("note_id"), "tag_id"))


@query("""SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY ALL""")
def page_links(spark, d):
    return src.table(spark, d, "pages").select("page_id", F.explode(F.expr("""regexp_extract_all(html, 'href="([^"]*)"', 1)""")).alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


FOLDERS = "f AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), t AS (SELECT id AS root, id FROM f UNION ALL SELECT root, f.id FROM t JOIN f ON f.parent_id = t.id)"


@query(f"WITH RECURSIVE {FOLDERS} SELECT root, id FROM t")
def folder_descendants(spark, d):
    f = src.folders(spark, d)
    return ix.descendants(f, f)


@query(f"WITH RECURSIVE {FOLDERS} SELECT root, 'c' || c_custkey AS note_id FROM t JOIN customer ON t.id = 'n' || c_nationkey WHERE root LIKE 'r%'")
def scope_notes(spark, d):
    f = src.folders(spark, d)
    scope = ix.descendants(f, f.where("parent_id IS NULL"))
    c = src.table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("note_id"), F.concat(F.lit("n"), "c_nationkey").alias("id"))
    return c.join(scope, "id").select("root", "note_id")


#: A state table derived from the documents: one note in seven is unknown, others changed, failed long ago or just now, or pending.
STATE = f"""s AS (SELECT 'd' || doc_id AS note_id, CASE WHEN doc_id % 7 = 1 THEN 'old' ELSE {HASH} END AS content_hash, CASE doc_id % 7 WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' WHEN 4 THEN 'pending' ELSE 'success' END AS structural_status,
CASE WHEN doc_id % 7 = 2 THEN TIMESTAMP '2024-01-01 11:55:00' ELSE TIMESTAMP '2024-01-01 10:00:00' END AS updated_at, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'old-model' ELSE 'model' END AS extraction_model FROM documents WHERE doc_id % 7 <> 0)"""


def _state(spark, d):
    n = src.notes(spark, d).withColumn("k", F.substring("note_id", 2, 20).cast("long"))
    m = F.col("k") % 7
    at = F.when(m == 2, F.lit("2024-01-01 11:55:00")).otherwise(F.lit("2024-01-01 10:00:00")).cast("timestamp_ntz")
    status = F.when(m.isin(2, 3), "failed").when(m == 4, "pending").otherwise("success")
    model = F.when(F.col("k") % 5 == 1, "old-model").when(F.col("k") % 5 > 1, "model")
    h = F.when(m == 1, "old").otherwise(tx.content_hash(F.col("title"), F.col("body")))
    return n.where(m != 0).select("note_id", h.alias("content_hash"), status.alias("structural_status"), at.alias("updated_at"), model.alias("extraction_model"))


NOW = "2024-01-01 12:00:00"


@query(f"""WITH {STATE}, r AS (SELECT n.note_id, CASE WHEN s.note_id IS NULL THEN 'no_state' WHEN hash <> content_hash THEN 'hash_changed' WHEN structural_status = 'failed' AND updated_at > TIMESTAMP '{NOW}' - INTERVAL 600 SECOND THEN 'cooldown'
WHEN structural_status = 'failed' THEN 'retry' WHEN structural_status <> 'success' THEN 'pending' ELSE 'hash_equal' END AS reason FROM (SELECT 'd' || doc_id AS note_id, {HASH} AS hash FROM documents) n LEFT JOIN s USING (note_id))
SELECT note_id, reason, reason NOT IN ('cooldown', 'hash_equal') AS process FROM r""")
def delta_decisions(spark, d):
    return ix.structural_delta(src.notes(spark, d), _state(spark, d), F.lit(NOW).cast("timestamp_ntz"))


@query(f"""WITH {STATE} SELECT n.note_id, CASE WHEN s.note_id IS NULL THEN 'no_state' WHEN hash <> content_hash THEN 'hash_changed' WHEN structural_status <> 'success' THEN 'status_not_success' WHEN coalesce(extraction_model, '') <> 'model' THEN 'model_changed' ELSE 'equal' END AS reason
FROM (SELECT 'd' || doc_id AS note_id, {HASH} AS hash FROM documents) n LEFT JOIN s USING (note_id)""")
def semantic_delta(spark, d):
    state = _state(spark, d).withColumnRenamed("structural_status", "semantic_status")
    return sm.semantic_delta(src.notes(spark, d), state, "model").select("note_id", "reason")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_notes(spark, d):
    return ix.orphans(src.table(spark, d, "documents"), src.table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def purge_children(spark, d):
    return ix.purge(src.table(spark, d, "labels"), src.table(spark, d, "documents").where("lang = 'en'"), "doc_id").select("doc_id", "quality", "toxic")


@query(f"""WITH {STATE} SELECT coalesce(n.note_id, s.note_id) AS note_id, coalesce(n.content_hash, s.content_hash) AS content_hash, coalesce(n.structural_status, s.structural_status) AS structural_status,
CASE WHEN n.structural_status = 'success' THEN n.updated_at ELSE s.updated_at END AS updated_at, s.extraction_model FROM s FULL JOIN (SELECT 'd' || doc_id AS note_id, {HASH} AS content_hash, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'success' END AS structural_status, TIMESTAMP '{NOW}' AS updated_at FROM documents WHERE doc_id % 2 = 0) n ON n.note_id = s.note_id""")
def index_state_merge(spark, d):
    k = F.substring("note_id", 2, 20).cast("long")
    new = src.notes(spark, d).where(k % 2 == 0).select("note_id", tx.content_hash(F.col("title"), F.col("body")).alias("content_hash"), F.when(k % 3 == 0, "failed").otherwise("success").alias("structural_status"), F.lit(NOW).cast("timestamp_ntz").alias("updated_at"))
    at = F.when(F.col("n.structural_status") == "success", F.col("n.updated_at")).otherwise(F.col("o.updated_at"))
    return ix.merge(_state(spark, d), new, ["note_id"], {"updated_at": at})


@query("SELECT 'd' || vec_id || ':0' AS chunk_id, CASE WHEN label = 5 THEN NULL ELSE 'm' || label END AS model FROM embeddings WHERE label <> 3")
def embedding_stale_models(spark, d):
    model = F.when(F.col("label") != 5, F.concat(F.lit("m"), "label"))
    return sm.stale_vectors(src.table(spark, d, "embeddings").select(F.concat(F.lit("d"), "vec_id", F.lit(":0")).alias("chunk_id"), model.alias("model")), "m3")


_ENT = "trim(regexp_replace(regexp_replace(lower(trim(nfc_normalize({0}))), '\\s+', ' ', 'g'), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))"


#: Part names with accents, composed on odd keys and decomposed on even ones, in signs and blanks that don't count.
_ACCENTED = "CASE WHEN p_partkey % 2 = 1 THEN '!!Café  ' || p_name || '.' ELSE ' Cafe' || chr(769) || ' ' || upper(p_name) END"


@query(f"SELECT p_partkey, {_ENT.format(_ACCENTED)} AS key, 'ent_' || substr(sha256({_ENT.format(_ACCENTED)}), 1, 16) AS entity_id FROM part")
def entity_normalize(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("!!Café  "), "p_name", F.lit("."))).otherwise(F.concat(F.lit(" Cafe\u0301 "), F.upper("p_name")))
    p = src.table(spark, d, "part").select("p_partkey", tx.entity_key(name).alias("key"))
    return p.withColumn("entity_id", tx.entity_id(F.col("key")))


@query(f"""SELECT 'ent_' || substr(sha256(key), 1, 16) AS entity_id, key AS canonical_name, arg_min(p_type, p_partkey) AS type, round(max(c), 6) AS confidence, string_agg(DISTINCT trim(p_name), '|' ORDER BY trim(p_name)) AS aliases, count(*) AS mentions
FROM (SELECT *, {_ENT.format('p_name')} AS key, p_size / 100.0 AS c FROM part) GROUP BY key""")
def entity_canonicalize(spark, d):
    p = src.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), (F.col("p_size") / 100.0).alias("confidence"))
    return sm.canonicalize(p).withColumns({"aliases": F.array_join("aliases", "|"), "confidence": F.round("confidence", 6)})


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(round(list_cosine_similarity(q.v, v.v), 9), 6) AS score FROM v q, v WHERE q.vec_id <> v.vec_id)
SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r = 1 AND score > 0.3""")
def entity_similarity_pairs(spark, d):
    v = src.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return sm.similar_entities(v, v.withColumnRenamed("vec_id", "query_id"), 0.3)


#: The plain loop: entities one after another, with the list of canonical ones so far.
_GREEDY = """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
p AS MATERIALIZED (SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 12) AS s FROM v a JOIN v b ON b.vec_id < a.vec_id) WHERE s > {t}),
n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, coalesce(bs, []) AS bs FROM v LEFT JOIN (SELECT a AS vec_id, list(b) AS bs FROM p GROUP BY a) USING (vec_id)),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS c UNION ALL SELECT n.i, CASE WHEN list_has_any(c, bs) THEN c ELSE list_append(c, vec_id) END FROM r JOIN n ON n.i = r.i + 1),
c AS (SELECT unnest(c) AS b FROM r WHERE i = (SELECT max(i) FROM r)),
g AS (SELECT a, first(b ORDER BY s DESC, b) AS b, max(s) AS s FROM p JOIN c USING (b) GROUP BY a)"""


def _entities(spark, d):
    return src.table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vector"))


@query(f"WITH RECURSIVE {_GREEDY.format(t=0.4)} SELECT vec_id AS ord, vec_id::VARCHAR AS key, coalesce(b, vec_id)::VARCHAR AS canonical FROM v LEFT JOIN g ON a = vec_id")
def entity_merge_greedy(spark, d):
    return cn.greedy_merge(_entities(spark, d), rules=cn.Near(threshold=0.4)).select("ord", "key", "canonical")


@query(f"WITH RECURSIVE {_GREEDY.format(t=0.35)} SELECT b::VARCHAR AS key, count(*) AS merged, round(min(s), 6) AS least FROM g GROUP BY b")
def entity_merge_sizes(spark, d):
    """How many entities went into each canonical one, with small blocks and prefixes."""
    m = cn.greedy_merge(_entities(spark, d), rules=cn.Near(threshold=0.35, block=100, first=64)).where("score IS NOT NULL")
    return m.groupBy(F.col("canonical").alias("key")).agg(F.count(F.lit(1)).alias("merged"), F.round(F.min("score"), 6).alias("least"))


@query("SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS aliases, max(p_size)::BIGINT AS confidence FROM part GROUP BY p_brand")
def alias_union(spark, d):
    p = src.table(spark, d, "part")

    def half(k):
        g = p.where(F.col("p_partkey") % 2 == k).groupBy("p_brand").agg(F.collect_set("p_type").alias("aliases"), F.max("p_size").cast("double").alias("confidence"))
        return g.select(F.col("p_brand").alias("entity_id"), F.lower("p_brand").alias("canonical_name"), F.lit("brand").alias("type"), "confidence", "aliases")

    out = sm.upsert_entities(half(0), half(1))
    return out.select(F.col("entity_id").alias("p_brand"), F.array_join(F.array_sort("aliases"), "|").alias("aliases"), F.col("confidence").cast("long").alias("confidence"))


@query("SELECT l_suppkey, l_partkey, count(*) AS n, round(greatest(1 - pow(0.4, count(*)), max(coalesce(l_discount, 0.6))), 6) AS confidence FROM lineitem GROUP BY ALL")
def relation_confidence(spark, d):
    return sm.relation_confidence(src.table(spark, d, "lineitem"), ["l_suppkey", "l_partkey"], "l_discount")


@query("SELECT l_suppkey, round(1 - product(1 - l_discount), 6) AS confidence FROM lineitem GROUP BY l_suppkey")
def noisy_or(spark, d):
    return src.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(sm.noisy_or(F.col("l_discount")), 6).alias("confidence"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)")
def zero_evidence_relations(spark, d):
    e = src.table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return sm.without_evidence(src.table(spark, d, "part").select("p_partkey", "p_name"), e, ["p_partkey"])


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS n_entities, CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END::BIGINT AS n_relations, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'unknown' ELSE o_orderpriority || '|unknown' END AS types FROM orders""")
def extraction_parse(spark, d):
    """Answers of four kinds: not JSON; one entity and one without a name; two entities in a fence; the same with relations, one without an end."""
    o = src.table(spark, d, "orders")
    two = F.concat(F.lit('{"entities":[{"name":"A","type":"'), "o_orderpriority", F.lit('","confidence":0.5},{"name":"B"}],"relations":'))
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, "invalid json").when(k == 1, '{"entities":[{"name":"A"},{"name":" "}]}').when(k == 2, F.concat(F.lit("```json\n"), two, F.lit("[]}\n```"))).otherwise(F.concat(two, F.lit('[{"from":"A","to":"B","type":"r"},{"from":"A","to":"","type":"r"}]}')))
    x = o.select("o_orderkey", xt.parse_extraction(raw).alias("x"))
    return x.select("o_orderkey", F.size("x.entities").cast("long").alias("n_entities"), F.size("x.relations").cast("long").alias("n_relations"), F.array_join(F.transform("x.entities", lambda e: e["type"]), "|").alias("types"))


@query("""WITH m AS (SELECT l_orderkey AS note_id, l_partkey AS entity_id, o_orderdate AS u FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT min(o_orderkey) AS note_id FROM orders), n AS (SELECT note_id, max(u) AS u FROM m WHERE entity_id IN (SELECT entity_id FROM m WHERE note_id IN (SELECT note_id FROM s)) AND note_id NOT IN (SELECT note_id FROM s) GROUP BY note_id)
SELECT note_id, 0::BIGINT AS hop FROM s UNION ALL SELECT note_id, 1 FROM (SELECT note_id FROM n ORDER BY u DESC, note_id LIMIT 50)""")
def cascade_neighbors(spark, d):
    o = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), F.col("o_orderdate").alias("updated_at"))
    m = src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_partkey").alias("entity_id")).join(o, "note_id")
    return sm.cascade(m, o.agg(F.min("note_id").alias("note_id")))


@query("""WITH m AS (SELECT l_orderkey AS note_id, p_name AS name, max(l_quantity) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT note_id, place, regexp_replace(regexp_replace(lower(name), '\\s+', '-', 'g'), '[^a-z0-9_\\-]', '', 'g') AS tag FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY c DESC, name) AS place FROM m) WHERE place <= 3""")
def enrichment_tags(spark, d):
    l, p = src.table(spark, d, "lineitem"), src.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    return sm.enrichment_tags(l.join(p, "l_partkey").groupBy(F.col("l_orderkey").alias("note_id"), "name").agg(F.max("l_quantity").alias("confidence")))


@query("""WITH t AS (SELECT lower(trim(p_name)) AS key, arg_min(p_partkey, p_partkey) AS target FROM part GROUP BY ALL), m AS (SELECT l_orderkey AS note_id, target, max(l_quantity) AS c FROM lineitem JOIN part ON l_partkey = p_partkey JOIN t ON key = lower(trim(p_name)) GROUP BY ALL)
SELECT note_id, place, target FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY c DESC, target) AS place FROM m) WHERE place <= 3""")
def enrichment_links(spark, d):
    p = src.table(spark, d, "part").select(F.col("p_partkey").alias("note_id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("created_at"))
    m = src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("note_id"), F.col("l_quantity").alias("confidence"))
    return sm.enrichment_links(m.join(p, "note_id").select(F.col("order").alias("note_id"), F.col("title").alias("name"), "confidence"), p)


RUNS = "r AS (SELECT event_id AS id, user_id AS queue, CASE event_type WHEN 'click' THEN 'structural' ELSE 'semantic' END AS pipeline, CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS status, ts AS started_at FROM events)"


def _runs(spark, d):
    return src.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("queue"), F.when(F.col("event_type") == "click", "structural").otherwise("semantic").alias("pipeline"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("ts").alias("started_at"))


@query(f"WITH {RUNS} SELECT * FROM r WHERE pipeline = 'semantic' AND status = 'failed' ORDER BY started_at DESC, id DESC LIMIT 20 OFFSET 20")
def run_history(spark, d):
    return rn.history(_runs(spark, d), "semantic", "failed", offset=20)


@query("SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 AND count(*) FILTER (WHERE event_type = 'purchase') = 0 THEN 'failed' ELSE 'success' END AS status FROM events GROUP BY user_id")
def run_status(spark, d):
    g = src.table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    return g.select("user_id", rn.run_status(F.col("e"), F.col("p")).alias("status"))


@query("SELECT event_id AS id, user_id AS queue, row_number() OVER (PARTITION BY user_id ORDER BY (event_id % 4) + 1 DESC, ts, event_id) AS place FROM events")
def run_queue_order(spark, d):
    e = src.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("queue"), (F.col("event_id") % 4 + 1).alias("priority"), F.col("ts").alias("enqueued_at"))
    return rn.queue_order(e).select("id", "queue", "place")


@query("SELECT l_orderkey AS batch_id, count(*) AS phases, count(*) AS processed, sum(l_quantity)::DOUBLE AS chunks, coalesce(string_agg(CASE WHEN l_returnflag <> 'N' THEN 'line ' || l_linenumber || ': ' || l_returnflag END, '; ' ORDER BY l_linenumber, l_returnflag), '') AS errors FROM lineitem GROUP BY l_orderkey")
def batch_rollup(spark, d):
    errors = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("line "), "l_linenumber", F.lit(": "), "l_returnflag"))
    phases = src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("place"), F.lit(1).cast("long").alias("processed"), F.col("l_quantity").cast("double").alias("chunks"), errors.alias("errors"))
    return rn.rollup(phases, ["processed", "chunks"])


@query("SELECT t AS tick FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-08', INTERVAL 1 MINUTE)) AS t) WHERE minute(t) IN (0, 30) AND hour(t) BETWEEN 6 AND 18 AND dayofweek(t) BETWEEN 1 AND 5")
def schedule_ticks(spark, d):
    return rn.cron_ticks(spark, "2024-01-01 00:00:00", "2024-01-08 00:00:00", "*/30 6-18 * * 1-5")


#: Forms of an interval and their milliseconds a unit (0: none).
FORMS = {"{}m": 60_000, "every {}h": 3_600_000, "{} min": 60_000, "{} minutes": 60_000, "every {} hours": 3_600_000, "{} Day": 86_400_000, " {}d ": 86_400_000, "{} secs": 1000, "every {} weeks": 0, "{}": 0}


@query("SELECT DISTINCT replace(f, '{}', p_size::VARCHAR) AS text, CASE WHEN ms = 0 THEN -1 ELSE p_size * ms END AS ms FROM part, (VALUES " + ", ".join(f"('{f}', {ms}::BIGINT)" for f, ms in FORMS.items()) + ") v(f, ms)")
def parse_interval(spark, d):
    s = src.table(spark, d, "part").select(F.col("p_size").cast("string").alias("n")).distinct()
    t = s.select(F.explode(F.array(*(F.replace(F.lit(f), F.lit("{}"), F.col("n")) for f in FORMS))).alias("text"))
    return t.select("text", F.coalesce(tx.interval_ms(F.col("text")), F.lit(-1)).alias("ms"))


def _events(spark, d):
    return src.table(spark, d, "events").select("event_id", F.col("user_id").alias("note_id"), "ts", (F.col("event_type") == "error").alias("failed"))


@query("""WITH g AS (SELECT user_id AS note_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY note_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT note_id, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM s GROUP BY note_id, k""")
def debounce_sessions(spark, d):
    return ev.debounce(_events(spark, d), "10 minutes")


@query("SELECT event_id, user_id AS note_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events w WHERE w.event_type = 'purchase' AND w.user_id = e.user_id AND e.ts >= w.ts AND e.ts < w.ts + INTERVAL 1 HOUR)")
def suppression_window(spark, d):
    writes = src.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("note_id"), F.col("ts").alias("written_at"))
    return ev.suppress(_events(spark, d), writes, 3600).select("event_id", "note_id")


@query("""WITH f AS (SELECT event_id, ts, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM events)
SELECT event_id, coalesce(ts < f + INTERVAL 600 SECOND, false) AS blocked FROM f""")
def retry_cooldown(spark, d):
    return ev.after_failure(_events(spark, d)).select("event_id", "blocked")


@query()
def rate_limit(spark, d):
    return ev.rate_limited(_events(spark, d), most=2, seconds=86_400)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def run_last_state(spark, d):
    return rn.last_state(src.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query("SELECT l_suppkey, l_partkey, count(*) AS n, round(1 - pow(0.4, count(*)), 6) AS confidence FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL")
def evidence_remove(spark, d):
    gone = src.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return sm.relation_confidence(ix.purge(src.table(spark, d, "lineitem"), gone, "l_orderkey"), ["l_suppkey", "l_partkey"])


@query(f"SELECT l_orderkey, l_linenumber::BIGINT AS line, 'ent_' || substr(sha256({_ENT.format('p_name')}), 1, 16) AS entity_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {_ENT.format('p_name')} IN (SELECT {_ENT.format('p_name')} FROM part WHERE p_size <= 5)")
def entity_name_lookup(spark, d):
    """Lines whose part's name, in upper case, is that of a known entity (parts of size 5 or less)."""
    known = sm.canonicalize(src.table(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.lit(0.5).alias("confidence")))
    names = src.table(spark, d, "lineitem").join(src.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("name")), "l_partkey")
    return sm.resolve_names(names, "name", known, "entity_id").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "entity_id")


def _messages(spark, d):
    return src.table(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


@query("SELECT conv_id AS conversation_id, count(*) AS messages, max(turn) AS last_seq, max(TIMESTAMP '2024-01-01' + to_hours(turn * conv_id % 7)) AS updated_at FROM conversations GROUP BY conv_id")
def conversation_list(spark, d):
    changed = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(seq * conversation_id % 7 AS int), 0, 0)")
    return ch.conversation_list(_messages(spark, d).withColumn("changed_at", changed))


@query("SELECT conv_id AS conversation_id, max(turn) + 1 AS next_seq FROM conversations GROUP BY conv_id")
def next_seq(spark, d):
    return _messages(spark, d).groupBy("conversation_id").agg((F.max("seq") + 1).alias("next_seq"))


@query("SELECT conv_id AS conversation_id, arg_max(text, turn) AS content FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, d):
    return _messages(spark, d).where("role = 'user'").groupBy("conversation_id").agg(F.max_by("content", "seq").alias("content"))


@query("SELECT conv_id AS conversation_id, turn AS seq, cost::BIGINT AS cost FROM (SELECT *, sum(ceil(length(text) / 4.0) + 2) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS cost FROM conversations) WHERE cost <= 400")
def history_trim(spark, d):
    return rn.trim_history(_messages(spark, d), 400).select("conversation_id", "seq", "cost")


@query("SELECT conv_id AS conversation_id, turn AS seq FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS l FROM conversations) WHERE l IS NULL OR turn <= l")
def regenerate_cut(spark, d):
    return rn.regenerate(_messages(spark, d)).select("conversation_id", "seq")


@query("SELECT conv_id AS conversation_id, turn AS seq, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS title FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)")
def auto_title(spark, d):
    return _messages(spark, d).select("conversation_id", "seq", tx.auto_title(F.col("content")).alias("title"))


@query(f"""WITH {TFIDF} SELECT query_id, sha256(string_agg('[' || rank || '] Document ' || substr(note_id, 2) || chr(10) || content, chr(10) || chr(10) ORDER BY rank)) AS block FROM tfidf JOIN c USING (chunk_id) WHERE rank <= 5 GROUP BY query_id""")
def context_block(spark, d):
    hits = rt.of_chunks(rt.tfidf(src.benchmark_queries(spark, d), src.chunks(spark, d), 5), src.chunks(spark, d))
    hits = hits.select("query_id", F.col("rank").alias("place"), F.concat(F.lit("Document "), F.substring("note_id", 2, 20)).alias("title"), "content")
    return rn.context_block(hits).withColumn("block", F.sha2("block", 256))


@query(f"""WITH {DOCS}, {TERMS}, {BM25} SELECT query_id, chunk_id, note_id, rank, score, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Document ' || doc_id END AS title FROM bm25 JOIN c USING (chunk_id) JOIN (SELECT doc_id, 'd' || doc_id AS note_id FROM documents) USING (note_id)""")
def title_search_left_join(spark, d):
    """Search rows keep chunks whose note isn't there (every third), with an empty title."""
    chunks = src.chunks(spark, d)
    hits = rt.bm25(src.benchmark_queries(spark, d), chunks).join(chunks.select("chunk_id", "note_id"), "chunk_id")
    some = src.notes(spark, d).where(F.substring("note_id", 2, 20).cast("long") % 3 != 0).select("note_id", "title")
    return hits.join(some, "note_id", "left").select("query_id", "chunk_id", "note_id", "rank", "score", F.coalesce("title", F.lit("")).alias("title"))


@query()
def embed_notes(spark, d):
    return sm.embed_chunks(src.chunks(spark, d)).select("chunk_id", "model", "dims", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 3).alias("norm"))


@query("SELECT item_id AS query_id, CASE WHEN trim(text) = '' THEN '\"\"' ELSE array_to_string(list_filter(string_split_regex(replace(trim(text), '\"', '\"\"'), '\\s+'), lambda t: t <> ''), ' AND ') END AS match FROM benchmark")
def fts_query_text(spark, d):
    return src.benchmark_queries(spark, d).select("query_id", tx.fts_query(F.col("query")).alias("match"))


@query(f"""WITH {STATE}, r AS (SELECT n.note_id, CASE WHEN s.note_id IS NULL THEN 'no_state' WHEN hash <> content_hash THEN 'hash_changed' WHEN structural_status = 'failed' AND updated_at > TIMESTAMP '{NOW}' - INTERVAL 600 SECOND THEN 'cooldown'
WHEN structural_status = 'failed' THEN 'retry' WHEN structural_status <> 'success' THEN 'pending' WHEN extraction_model <> 'model' THEN 'model_changed' ELSE 'hash_equal' END AS reason FROM (SELECT 'd' || doc_id AS note_id, {HASH} AS hash FROM documents) n LEFT JOIN s USING (note_id))
SELECT note_id, reason, reason NOT IN ('cooldown', 'hash_equal') AS process FROM r""")
def delta_embedding_model(spark, d):
    state = _state(spark, d).withColumnRenamed("extraction_model", "embedding_model")
    return ix.structural_delta(src.notes(spark, d), state, F.lit(NOW).cast("timestamp_ntz"), model="model")


def bm25_porter_topk(spark, d):
    asked = src.benchmark_queries(spark, d).withColumns({"literal": F.col("query"), "query": tx.fts_query(F.col("query"))})
    return se.search(asked, src.chunks(spark, d))


def _forms(spark, d):
    """Queries in each form of the syntax, from two words of every benchmark item."""
    w = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 3)
    two = src.table(spark, d, "benchmark").select("item_id", w.alias("w")).where("size(w) > 1").select("item_id", F.col("w")[0].alias("a"), F.col("w")[1].alias("b"))
    forms = ["{0} AND {1}", "{0} OR {1}", "{0} NOT {1}", "({1} OR {0}) NOT {0}", '"{0} {1}"', "{0} + {1}*", "NEAR({0} {1}, 5)", "{0} {1} OR", "{0} {1}"]
    each = [F.struct(F.lit(i).alias("form"), F.replace(F.replace(F.lit(f), F.lit("{0}"), F.col("a")), F.lit("{1}"), F.col("b")).alias("query")) for i, f in enumerate(forms)]
    return two.select("item_id", F.explode(F.array(*each)).alias("f")).select(F.concat_ws(":", "item_id", "f.form").alias("query_id"), "f.query")


def search_syntax(spark, d):
    return se.search(_forms(spark, d), src.chunks(spark, d), None)


def search_snippets(spark, d):
    asked, chunks = _forms(spark, d), src.chunks(spark, d)
    return se.with_snippets(se.search(asked, chunks, 10), chunks, asked)


QUERIES |= {f.__name__: f for f in (bm25_porter_topk, search_syntax, search_snippets)}  # stems have no SQL here

_STORE = "SELECT conv_id AS conversation_id, turn + 1 AS seq, role, text AS content, NULL::VARCHAR AS error, TIMESTAMP '2024-01-01 00:00:00' AS changed_at FROM conversations"
_LAST = "SELECT conv_id AS conversation_id, max(turn) + 1 AS seq FROM conversations GROUP BY conv_id"


def _store(spark, d):
    m = _messages(spark, d)
    return m.select("conversation_id", (F.col("seq") + 1).alias("seq"), "role", "content", F.lit(None).cast("string").alias("error"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("changed_at"))


def _ends(m):
    return m.groupBy("conversation_id").agg(F.max("seq").alias("seq"))


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"{_STORE} UNION ALL SELECT conversation_id, seq + place, role, content, NULL, TIMESTAMP '{NOW}' FROM ({_LAST}), (VALUES (1, 'user', 'next'), (2, 'assistant', 'reply')) v(place, role, content)")
def message_append(spark, d):
    m = _store(spark, d)
    two = F.array(*(F.struct(F.lit(p).alias("place"), F.lit(r).alias("role"), F.lit(c).alias("content")) for p, r, c in ((2, "assistant", "reply"), (1, "user", "next"))))
    return ch.append(m, m.select("conversation_id").distinct().select("conversation_id", F.explode(two).alias("n")).select("conversation_id", "n.*"), _now())


@query(f"SELECT m.conversation_id, m.seq, role, CASE WHEN l.seq IS NULL THEN content ELSE 'new' END AS content, error, CASE WHEN l.seq IS NULL THEN changed_at ELSE TIMESTAMP '{NOW}' END AS changed_at FROM ({_STORE}) m LEFT JOIN ({_LAST}) l ON m.conversation_id = l.conversation_id AND m.seq = l.seq")
def message_replace(spark, d):
    m = _store(spark, d)
    return ch.replace(m, _ends(m).withColumn("content", F.lit("new")), _now())


@query(f"SELECT m.conversation_id, m.seq, role, content, CASE WHEN l.seq IS NULL THEN error ELSE 'timeout' END AS error, changed_at FROM ({_STORE}) m LEFT JOIN ({_LAST}) l ON m.conversation_id = l.conversation_id AND m.seq = l.seq")
def message_error(spark, d):
    m = _store(spark, d)
    return ch.set_error(m, _ends(m).withColumn("error", F.lit("timeout")))


@query(f"SELECT m.* FROM ({_STORE}) m ANTI JOIN ({_LAST}) l ON m.conversation_id = l.conversation_id AND m.seq = l.seq")
def message_delete(spark, d):
    m = _store(spark, d)
    return ch.remove(m, _ends(m))


@query(f"SELECT * FROM ({_STORE}) WHERE conversation_id % 3 <> 0")
def conversation_delete(spark, d):
    m = _store(spark, d)
    return ch.delete(m, m.where("conversation_id % 3 = 0").select("conversation_id").distinct())


@query(f"SELECT conv_id AS conversation_id, CASE WHEN conv_id % 3 = 0 THEN 'renamed' END AS title, CASE WHEN conv_id % 3 = 0 THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at FROM conversations GROUP BY conv_id")
def conversation_update(spark, d):
    c = _store(spark, d).groupBy("conversation_id").agg(F.lit(None).cast("string").alias("title"), F.max("changed_at").alias("updated_at"))
    return ch.rename(c, c.where("conversation_id % 3 = 0").select("conversation_id", F.lit("renamed").alias("title")), _now())


from noteforge.plans import facade, layers  # noqa: E402, F401  # they add their queries
