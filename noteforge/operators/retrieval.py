"""Retrievers over many queries at once, fusion by reciprocal rank, context under a token budget, and the facade over all.

Every retriever gives query_id, chunk_id, score and rank. Term statistics come from one table of postings (an Index), which is
made without a shuffle and staged, so that several retrievers read it and none reads the texts again.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteforge.functions.text import damerau_levenshtein, edit_key, estimate_tokens, tokens, trigrams
from noteforge.operators.cells import Cells
from noteforge.operators.inverted import Inverted
from noteforge.operators.inverted import frequent as _frequent
from noteforge.sources.staging import staged

#: Queries are broadcast up to this many rows of terms; beyond it the join shuffles.
MOST_TERMS = 500_000
#: Postings met by queries' terms that a task takes, about. A pair of a query and a chunk takes some 200 bytes in sums and sorts.
MET = 1 << 20
#: Scores of vectors that a task holds at once, about.
TILE = 1 << 20
#: Trigrams that one edit can take from a text.
EDIT_GRAMS = 4
#: Of a query's trigrams, the rarest so many find the titles that bound the distance of the k nearest.
RAREST = 4


def _few(df: DataFrame, most: int = MOST_TERMS) -> bool:
    return df.limit(most + 1).count() <= most


def _hint(df: DataFrame, most: int = MOST_TERMS, judged: DataFrame | None = None) -> DataFrame:
    """df with a broadcast hint if `judged` (df by default; give its cheap source where df depends on the corpus) has at most `most` rows, else as _large()."""
    return F.broadcast(df) if _few(df if judged is None else judged, most) else _large(df)


def _large(df: DataFrame) -> DataFrame:
    """df, which grows with the corpus, with a hint that keeps it and what it meets from the driver: Spark broadcasts what it takes to be small by
    the size of its files, and rows are many times as large as those. A side with a broadcast hint of its own is still broadcast."""
    return df.hint("merge")


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf, len (tokens of the chunk): runs of each chunk's sorted tokens, without a shuffle."""
    # the contents are judged, not their tokens: a condition on these would make them once more, below a shuffle of the chunks
    t = chunks.where("content IS NOT NULL").select("chunk_id", F.array_sort(tokens(F.col("content"))).alias("t"))
    begins = t.withColumn("b", F.expr("filter(sequence(0, size(t)), i -> i < size(t) AND (i = 0 OR t[i] <> t[i - 1]))"))
    runs = "transform(b, (p, i) -> struct(t[p] AS term, cast(coalesce(get(b, i + 1), size(t)) - p AS bigint) AS tf))"
    return begins.selectExpr("chunk_id", "cast(size(t) AS bigint) AS len", f"explode({runs}) AS x").selectExpr("chunk_id", "x.term", "x.tf", "len")


def _once(queries: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `find` gives for queries(query_id, query), where equal queries are sought once, under the least of their query_ids."""
    asking = staged(queries.groupBy("query_id").agg(F.array_sort(F.collect_list("query")).alias("asked")), "asking")
    kinds = staged(asking.groupBy("asked").agg(F.min("query_id").alias("first")), "asked")
    hits = find(kinds.select(F.col("first").alias("query_id"), F.explode("asked").alias("query")))
    each = asking.join(kinds, "asked").select("query_id", "first")
    return hits.withColumnRenamed("query_id", "first").join(_hint(each, judged=asking), "first").select(*hits.columns)


@dataclass(frozen=True)
class Index:
    """Postings of a corpus with its number of chunks and tokens."""

    postings: DataFrame
    chunks: int
    tokens: int

    @staticmethod
    def of(chunks: DataFrame) -> Index:
        p = staged(postings(chunks), "postings")
        return Index(p, chunks.count(), p.agg(F.sum("tf")).first()[0] or 0)


def _dealt(q: DataFrame, few: bool, *sides: DataFrame) -> tuple[DataFrame, ...]:
    """sides, the postings of the terms of q(query_id, term, df) and what is joined to them by chunk, dealt by chunk: what queries make of a
    chunk is summed and cut to the best in its task, and no pair of a query and a chunk is moved. All sides are dealt alike, since a join
    else takes the number of partitions of the side that needs no shuffle. Where q's terms aren't few, the join with them moves the postings anyhow."""
    if not few:
        return sides
    met = q.agg(F.sum("df")).first()[0] or 0
    parts = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-met // MET))
    return tuple(side.repartition(parts, "chunk_id") for side in sides)


def document_frequency(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def top(df: DataFrame, k: int | None, by: list[Column]) -> DataFrame:
    """rank within each query; at most k rows of each (cut before the shuffle too)."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)))
    return (out.where(F.col("rank") <= k) if k else out).withColumn("rank", F.col("rank").cast("long"))


def tfidf(queries: DataFrame, chunks: DataFrame, k: int | None = 50, index: Index | Inverted | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: cosine of TF-IDF vectors, positive scores only. All chunks are scored, unless a kept index bounds them."""
    if isinstance(index, Inverted):
        return _once(queries, lambda q: index.tfidf(q, k))
    own = index or Index.of(chunks)
    return _once(queries, lambda q: _tfidf(q, k, own))


def _tfidf(queries: DataFrame, k: int | None, index: Index) -> DataFrame:
    """As tfidf(). Frequent terms come to the postings, which lie chunk by chunk; only the postings of rare terms are moved by their term."""
    p, n = index.postings, index.chunks
    df = staged(p.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    idf = F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1
    weigh = lambda x: x.select("chunk_id", "term", (F.col("tf") / F.col("len") * idf).alias("w"))
    known, rare = _frequent(df)
    d = weigh(p.join(F.broadcast(known), "term"))
    sums = d.groupBy("chunk_id").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    if rare is not None:
        seldom = weigh(p.join(F.broadcast(known.select("term")), "term", "left_anti").join(_large(rare), "term"))
        sums = sums.union(seldom.groupBy("chunk_id").agg(F.sum(F.col("w") * F.col("w")).alias("s"))).groupBy("chunk_id").agg(F.sum("s").alias("s"))
    norms = sums.select("chunk_id", F.sqrt("s").alias("dn"))
    own = postings(queries.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("content"))).withColumnRenamed("chunk_id", "query_id")
    few = _few(own)
    small = F.broadcast if few else (lambda x: x)
    held = df.join(small(own.select("term").distinct()), "term", "left_semi")
    q = staged(own.join(small(held), "term", "left").select("query_id", "term", "df", (F.col("tf") / F.col("len") * F.coalesce(idf, F.lit(1.0))).alias("qw")), "query-weights")
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    q = q.where("df IS NOT NULL")
    asked, norms = _dealt(q, few, p.join(small(q.select("term").distinct()), "term", "left_semi"), norms)
    met = asked.join(_large(norms), "chunk_id").join(small(q), "term").withColumn("w", F.col("tf") / F.col("len") * idf)
    dots = met.groupBy("query_id", "chunk_id", "dn").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    scored = dots.join(small(qn), "query_id").select("query_id", "chunk_id", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 6).alias("score"))
    return top(scored.where("score > 0"), k, [F.desc("score"), F.col("chunk_id")])


def bm25(queries: DataFrame, chunks: DataFrame, k: int | None = 50, index: Index | Inverted | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: chunks with all terms of the query, higher is better."""
    if isinstance(index, Inverted):
        return _once(queries, lambda q: index.bm25(q, k))
    own = index or Index.of(chunks)
    return _once(queries, lambda q: _bm25(q, k, own))


def _bm25(queries: DataFrame, k: int | None, index: Index) -> DataFrame:
    average = index.tokens / index.chunks if index.chunks else 1.0
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    q = staged(q.withColumn("terms", F.count(F.lit(1)).over(Window.partitionBy("query_id"))), "query-terms")
    few = _few(q)
    small = F.broadcast if few else (lambda x: x)
    p = index.postings.join(small(q.select("term").distinct()), "term", "left_semi")
    df = staged(p.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "asked-frequencies")
    q = q.join(small(df), "term")
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(float(index.chunks)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    gain = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.lit(average)))
    (asked,) = _dealt(q, few, p)
    met = asked.join(small(q), "term").withColumn("gain", gain)
    hits = met.groupBy("query_id", "chunk_id").agg(F.round(F.sum("gain"), 6).alias("score"), F.count(F.lit(1)).alias("n"), F.first("terms").alias("terms"))
    return top(hits.where("n = terms").select("query_id", "chunk_id", "score"), k, [F.desc("score"), F.col("chunk_id")])


def like(queries: DataFrame, texts: DataFrame, columns: list[str], key: str) -> DataFrame:
    """query_id, key, score 0 of the texts that hold the query as a substring (case-insensitive) in one of the columns.

    Nothing meets everything: a query is joined on a word that other signs enclose (a text that holds the query has that very
    word), or on the words of the vocabulary that hold its longest word, or, without any, on its first sign; then compared in
    full. Blank queries find nothing. Equal queries are sought once; what they find is given to each of them last, by a join
    that moves no text, so that nothing as large as the answer is shuffled.
    """
    asking = queries.where("trim(query) <> ''").groupBy("query_id").agg(F.array_sort(F.collect_set(F.lower("query"))).alias("asked"))
    asking = staged(asking, "like-asking")
    q = asking.select("asked").distinct().select("asked", F.explode("asked").alias("low"))
    longest = "array_max(transform(regexp_extract_all(low, '{0}', 1), w -> struct(length(w) AS n, w))).w"
    q = staged(q.withColumns({"inner": F.expr(longest.format("(?<=[^a-z0-9])([a-z0-9]+)(?=[^a-z0-9])")), "run": F.expr(longest.format("([a-z0-9]+)"))}), "like-queries")
    lows = [F.coalesce(F.lower(F.col(c)), F.lit("")) for c in columns]
    all_lows = F.concat_ws("\n", *lows)
    t = texts.select(F.col(key).alias("id"), F.array(*lows).alias("lows"), F.concat(F.split(all_lows, "[^a-z0-9]+"), F.split(F.regexp_replace(all_lows, "[a-z0-9]+", ""), "")).alias("keys"))
    t = t.select("id", "lows", F.explode(F.array_distinct("keys")).alias("at"))
    part = q.where("inner IS NULL AND run IS NOT NULL")
    keyed = q.where("inner IS NOT NULL").select("asked", "low", F.col("inner").alias("at")).union(q.where("run IS NULL").select("asked", "low", F.substring("low", 1, 1).alias("at")))
    if not part.isEmpty():
        words = t.select("at").distinct()
        held = _labelled(part.select(F.col("run").alias("query_id"), F.col("run").alias("term")).distinct(), words.select(F.col("at").alias("seed"), F.col("at").alias("label")))
        keyed = keyed.union(held.withColumnRenamed("query_id", "run").join(part, "run").select("asked", "low", F.col("seed").alias("at")))
    hits = t.join(_hint(keyed), "at").where(F.exists("lows", lambda x: F.contains(x, F.col("low")))).select("id", "asked")
    # small rows that many queries may share: dealt over all partitions, however few bytes they are
    hits = hits.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").distinct()
    return hits.join(_hint(asking), "asked").select("query_id", F.col("id").alias(key), F.lit(0.0).alias("score"))


def dense(queries: DataFrame, vectors: DataFrame, k: int = 20, block: int = 4096, key: str = "vec_id", index: Cells | None = None) -> DataFrame:
    """query_id, key, score, rank: exact cosine of queries(query_id, vector) and vectors(key, vector); by a kept index if there is one.

    Queries are taken in blocks of a fixed size; a block is a matrix that each task multiplies with its batches, about TILE
    scores at a time, keeping k rows of a query and batch. Vectors of other dimensions are left out; a zero vector scores 0.
    """
    if index is not None:
        return index.search(queries, k, key=key)
    parts = []
    rows = queries.select("query_id", "vector").orderBy("query_id")
    ids: list = []
    held: list = []
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"

    def scored(ids: list, held: list) -> DataFrame:
        q = np.array(held, dtype=np.float64)
        q /= np.maximum(np.sqrt((q * q).sum(axis=1, keepdims=True)), 1e-300)
        sent = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            names = np.array(ids)
            for b in batches:
                b = b[[v is not None and len(v) == q.shape[1] for v in b["vector"]]]
                if not len(b):
                    continue
                m = np.stack(b["vector"].to_numpy()).astype(np.float64)
                norm = np.sqrt((m * m).sum(axis=1))
                m /= np.maximum(norm, 1e-300)[:, None]
                keys, step = b[key].to_numpy(), max(1, TILE // len(b))
                for first in range(0, len(q), step):
                    s = np.einsum("nd,qd->qn", m, q[first : first + step])
                    s[:, norm == 0] = 0.0
                    s = np.round(s, 9)
                    low = np.partition(s, len(b) - k, axis=1)[:, len(b) - k] if len(b) > k else s.min(axis=1)
                    i, j = np.nonzero(s >= low[:, None])  # ties at the cut stay
                    yield pd.DataFrame({"query_id": names[first + i], key: keys[j], "score": s[i, j]})

        return vectors.select(key, "vector").mapInPandas(run, schema)

    for row in rows.toLocalIterator():
        ids.append(row[0])
        held.append(row[1])
        if len(ids) == block:
            parts.append(scored(ids, held))
            ids, held = [], []
    if ids or not parts:
        parts.append(scored(ids, held or [[0.0]]))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return top(out.withColumn("score", F.round("score", 6)), k, [F.desc("score"), F.col(key)])


def _title_pairs(sought: DataFrame, grams: DataFrame, judged: DataFrame) -> DataFrame:
    """qk, tk, most, least of sought(qk, g, most; rows of `judged`) and grams(tk, g): pairs that share a sought trigram and may be as near as `most` (null: any).

    An edit takes at most four trigrams away (a swap of neighbours; others three), and a length differs by at most the edits:
    the larger of both bounds is `least`. An edit distance without swaps is at most twice the one with them.
    """
    pairs = grams.join(_hint(sought, judged=judged), "g").groupBy("qk", "tk").agg(F.first("most").alias("most"))
    q, t = trigrams(F.col("qk")), trigrams(F.col("tk"))
    lost = F.greatest(F.size(q), F.size(t)) - F.size(F.array_intersect(q, t))
    pairs = pairs.withColumn("least", F.greatest(F.ceil(lost / EDIT_GRAMS), F.abs(F.length("qk") - F.length("tk")).cast("long")))
    return pairs.where("most IS NULL OR least <= most AND levenshtein(qk, tk, cast(2 * most AS int)) >= 0")


def _near_titles(queries: DataFrame, titles: DataFrame, closer_than: int | None, k: int | None = None) -> DataFrame:
    """query_id, title, distance of titles that share a trigram with the query: all that are closer, of the k nearest at least.

    With a bound of d edits only the 4 d + 1 rarest trigrams of a query are joined, since one of them stays in every title as
    near as that. For the k nearest the bound is the k-th distance among the titles that share one of the rarest trigrams.
    Each pair of normal forms is measured once.
    """
    q = queries.select("query_id", edit_key(F.col("query")).alias("qk"))
    t = titles.select("title", edit_key(F.col("title")).alias("tk")).distinct()
    grams = staged(t.select("tk").distinct().select("tk", F.explode(trigrams(F.col("tk"))).alias("g")), "title-grams")
    own = q.select("qk").distinct().select("qk", F.explode(trigrams(F.col("qk"))).alias("g"))
    held = grams.join(_hint(own.select("g").distinct()), "g", "left_semi").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rare_first = F.row_number().over(Window.partitionBy("qk").orderBy("n", "g"))
    own = asked = staged(own.join(held, "g").withColumn("place", rare_first).withColumn("most", F.lit(None if closer_than is None else closer_than - 1).cast("long")), "query-grams")
    if k is not None:
        some = _title_pairs(own.where(F.col("place") <= RAREST), grams, asked)
        some = some.withColumn("r", F.row_number().over(Window.partitionBy("qk").orderBy("least", "tk"))).where(F.col("r") <= 4 * k)
        measured = some.select("qk", "tk").withColumn("distance", damerau_levenshtein("qk", "tk"))
        by = Window.partitionBy("qk").orderBy("distance", "tk")
        bound = measured.withColumn("r", F.row_number().over(by)).where(F.col("r") == k).select("qk", F.col("distance").alias("bound"))
        own = own.join(bound, "qk", "left").withColumn("most", F.least("most", "bound")).drop("bound")
    pairs = _title_pairs(own.where(F.col("most").isNull() | (F.col("place") <= EDIT_GRAMS * F.col("most") + 1)), grams, asked)
    near = staged(pairs.select("qk", "tk", "most"), "title-pairs").withColumn("distance", damerau_levenshtein("qk", "tk"))
    near = near.where("most IS NULL OR distance <= most")
    return q.join(_large(near), "qk").join(_large(t), "tk").select("query_id", "title", "distance")


def fuzzy(queries: DataFrame, titles: DataFrame, k: int = 10, closer_than: int | None = None) -> DataFrame:
    """query_id, title, distance, rank: nearest titles that share a trigram with the query, by edit distance."""
    return top(_near_titles(queries, titles, closer_than, k), k, [F.col("distance"), F.col("title")])


def fuzzy_chunks(queries: DataFrame, notes: DataFrame, chunks: DataFrame, k: int = 50, closer_than: int | None = 10) -> DataFrame:
    """query_id, chunk_id, score, rank: chunks of the notes with the nearest titles, score the negative distance."""
    # of a title no more than the k least chunks can be among a query's first k (dense ranks: rows given twice don't count)
    of_title = notes.select("note_id", "title").join(_large(chunks.select("chunk_id", "note_id")), "note_id").select("title", "chunk_id")
    of_title = of_title.withColumn("r", F.dense_rank().over(Window.partitionBy("title").orderBy("chunk_id"))).where(F.col("r") <= k).drop("r")

    def find(q: DataFrame) -> DataFrame:
        hits = _near_titles(q, notes.select("title"), closer_than).join(_large(of_title), "title")
        hits = hits.groupBy("query_id", "chunk_id").agg(F.min("distance").alias("distance"))
        return top(hits.select("query_id", "chunk_id", (-F.col("distance")).cast("double").alias("score")), k, [F.desc("score"), F.col("chunk_id")])

    return _once(queries, find)


def _labelled(terms: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, seed of terms(query_id, term) and labels(seed, label) that hold the term; % and _ in it stand for any text or sign.

    Joined on the first up to three signs of the term's longest run without such signs, then compared in full.
    """
    run = "array_max(transform(split(term, '[%_]+'), r -> struct(length(r) AS n, r))).r"
    t = terms.withColumn("gram", F.expr(f"substring({run}, 1, 3)"))
    grams = F.array_distinct(F.expr("flatten(array(array(''), transform(sequence(1, greatest(length(label), 1)), i -> substring(label, i, 1)), transform(sequence(1, greatest(length(label) - 1, 1)), i -> substring(label, i, 2)), transform(sequence(1, greatest(length(label) - 2, 1)), i -> substring(label, i, 3))))"))
    found = labels.select("seed", "label", F.explode(grams).alias("gram")).join(_hint(t), "gram")
    return found.where(F.expr(r"label LIKE concat('%', replace(term, '\\', '\\\\'), '%')")).select("query_id", "seed").distinct()


def _of_layer(layer: str, *tables: DataFrame) -> tuple[DataFrame, ...]:
    return tables if layer == "both" else tuple(x.where(F.col("layer") == layer) for x in tables)


def _held_labels(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, label: the lower-case labels of nodes that hold a term of the query. Equal labels are compared once."""
    terms = queries.select("query_id", F.explode(F.filter(F.split(F.lower("query"), r"\s+"), lambda t: t != "")).alias("term"))
    labels = nodes.select(F.lower("label").alias("label")).distinct()
    return staged(_labelled(terms, labels.select(F.col("label").alias("seed"), "label")).withColumnRenamed("seed", "label"), "labels-held")


def _reached(seeds: DataFrame, by: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """by, id, weight: notes one hop from seeds(by, seed), either way, by their heaviest edge."""
    both = edges.select(F.col("source_id").alias("seed"), F.col("target_id").alias("id"), "weight").union(edges.select("target_id", "source_id", "weight"))
    hits = seeds.join(_large(both), "seed").groupBy(by, "id").agg(F.max("weight").alias("weight"))
    return hits.join(_large(nodes.where("kind = 'note'").select("id")), "id").select(by, "id", "weight")


def graph(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int | None = 50, layer: str = "both") -> DataFrame:
    """query_id, node_id, score, rank: notes one hop from nodes whose label holds a term of the query, either way.

    layer: `structural`, `semantic` or `both`, where nodes and edges have a layer.
    """
    nodes, edges = _of_layer(layer, nodes, edges)
    labels = nodes.select(F.col("id").alias("seed"), F.lower("label").alias("label"))
    seeds = labels.join(_hint(_held_labels(queries, nodes)), "label").select("query_id", "seed")
    hits = _reached(seeds, "query_id", nodes, edges)
    return top(hits.select("query_id", F.col("id").alias("node_id"), F.round(F.col("weight") / 2, 6).alias("score")), k, [F.desc("score"), F.col("node_id")])


def graph_chunks(queries: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, k: int = 50, layer: str = "both") -> DataFrame:
    """query_id, chunk_id, score, rank: the chunks of graph()'s notes. nodes(id, kind, label, note_id).

    Chunks are found label by label. A chunk among a query's first k is among the first k of the label that gives its score, so
    queries meet no more of a label's chunks than these.
    """
    own, links = _of_layer(layer, nodes, edges)

    def find(q: DataFrame) -> DataFrame:
        held = _held_labels(q, own)
        labels = own.select(F.col("id").alias("seed"), F.lower("label").alias("label"))
        seeds = labels.join(_hint(held.select("label").distinct(), judged=held), "label", "left_semi")
        of_label = _reached(seeds, "label", own, links).join(_large(nodes.select("id", "note_id")), "id").join(_large(chunks.select("chunk_id", "note_id")), "note_id")
        of_label = of_label.groupBy("label", "chunk_id").agg(F.max(F.round(F.col("weight") / 2, 6)).alias("score"))
        of_label = of_label.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "chunk_id"))).where(F.col("r") <= k).drop("r")
        hits = of_label.join(_hint(held), "label").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
        return top(hits, k, [F.desc("score"), F.col("chunk_id")])

    return _once(queries, find)


#: Order of retrievers where ranks tie.
RETRIEVERS = ("bm25", "tfidf", "fuzzy", "dense", "graph")


def clamp(value: float, low: float, high: float) -> float:
    return max(low, min(high, value))


def to_int(value: object, default: int) -> int:
    """A whole number from a number or text, the default otherwise."""
    try:
        return int(float(value))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return default


@dataclass(frozen=True)
class Settings:
    """Retrieval settings; clamped() brings numbers into their ranges (fixed values), validate() names what is out of them."""

    enabled: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(RETRIEVERS, True))
    dense_k: int = 20
    token_budget: int = 4000
    max_chunks_per_note: int = 3
    rrf_k: int = 60
    rerank: bool = False

    RANGES = {"dense_k": (1, 100), "token_budget": (500, 32000), "max_chunks_per_note": (1, 20), "rrf_k": (1, 200)}

    def clamped(self) -> Settings:
        default = Settings()
        return replace(self, **{n: int(clamp(to_int(getattr(self, n), getattr(default, n)), *r)) for n, r in self.RANGES.items()})

    def validate(self) -> list[str]:
        out = [] if isinstance(self.enabled, dict) else ["enabled must map retrievers to booleans"]
        for n, (low, high) in self.RANGES.items():
            v = getattr(self, n)
            if not isinstance(v, int) or isinstance(v, bool) or not low <= v <= high:
                out.append(f"{n} must be a whole number from {low} to {high}")
        return out if isinstance(self.rerank, bool) else [*out, "rerank must be a boolean"]


def chosen(requested: Iterable[str] | None, settings: Settings) -> list[str]:
    """Requested retrievers that are enabled, or all that are."""
    return [r for r in (RETRIEVERS if requested is None else requested) if settings.enabled.get(r, False)]


def check_query(query: object, limit: object = 10, longest: int = 500) -> int:
    """The limit of a search request, from 1 to 100; ValueError for a query that is blank or too long."""
    if not isinstance(query, str) or not query.strip():
        raise ValueError("the query must be a text that isn't blank")
    if len(query) > longest:
        raise ValueError(f"the query is longer than {longest}")
    return int(clamp(to_int(limit, 10) or 10, 1, 100))


HIT = "query_id {0}, key string, chunk_id string, note_id string, score double, retrievers string"


def fuse(hits: dict[str, DataFrame], rrf_k: int = 60, enabled: dict[str, bool] | None = None) -> DataFrame:
    """query_id, key, chunk_id, note_id, score, retrievers: reciprocal rank fusion of the enabled retrievers' hits.

    hits(query_id, chunk_id[, note_id], rank); a hit without chunk stands for its note (key `note:...`). Columns come from
    the first retriever's best hit. With nothing enabled the result is empty.
    """
    out = None
    for place, name in enumerate(RETRIEVERS):
        if name in hits and (enabled or {}).get(name, True):
            h = hits[name]
            note = F.col("note_id") if "note_id" in h.columns else F.lit(None).cast("string")
            one = h.select("query_id", "chunk_id", note.alias("note_id"), "rank", F.lit(place).alias("place"), F.lit(name).alias("retriever"))
            out = one if out is None else out.union(one)
    if out is None:
        some = next(iter(hits.values()), None)
        kind = some.schema["query_id"].dataType.simpleString() if some is not None else "bigint"
        return (some.sparkSession if some is not None else SparkSession.active()).createDataFrame([], HIT.format(kind))
    out = out.withColumn("key", F.coalesce("chunk_id", F.concat(F.lit("note:"), "note_id")))
    best = F.min_by(F.struct("chunk_id", "note_id"), F.struct("place", "rank"))
    fused = out.groupBy("query_id", "key").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("retriever")), ",").alias("retrievers"), best.alias("best"))
    return fused.select("query_id", "key", "best.chunk_id", "best.note_id", "score", "retrievers")


Reranker = Callable[[DataFrame, DataFrame], DataFrame]


def identity_reranker(hits: DataFrame, queries: DataFrame) -> DataFrame:
    return hits


def rerank(hits: DataFrame, queries: DataFrame, reranker: Reranker = identity_reranker) -> DataFrame:
    """What the reranker makes of hits and queries; hits as they are if it can't."""
    try:
        return reranker(hits, queries)
    except Exception:
        logging.getLogger(__name__).warning("the reranker failed", exc_info=True)
        return hits


@dataclass(frozen=True)
class Corpus:
    """What the retrievers search: chunks(chunk_id, note_id, content), notes(note_id, title), and where there are any,
    vectors(chunk_id, vector), nodes(id, layer, kind, label, note_id) and edges(layer, source_id, target_id, weight)."""

    chunks: DataFrame
    notes: DataFrame
    vectors: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    index: Index | Inverted | None = None


def retrieve(queries: DataFrame, corpus: Corpus, settings: Settings = Settings(), requested: Iterable[str] | None = None, limit: int = 50, layer: str = "both", reranker: Reranker = identity_reranker) -> DataFrame:
    """Fused hits (columns of fuse(), rank) of the requested and enabled retrievers, at most `limit` a query (of each retriever 50 or more).

    queries(query_id, query[, vector]); blank ones find nothing. A retriever finds nothing where there is nothing to search by it:
    `dense` without vectors of chunks or queries, `graph` without nodes or edges. What fails is raised, not left out of the hits.
    """
    settings, each_limit = settings.clamped(), max(limit, 50)
    queries = queries.where("trim(query) <> ''")
    names = chosen(requested, settings)
    index = corpus.index or (Index.of(corpus.chunks) if {"bm25", "tfidf"} & set(names) else None)
    each = {
        "bm25": lambda: bm25(queries, corpus.chunks, each_limit, index),
        "tfidf": lambda: tfidf(queries, corpus.chunks, each_limit, index),
        "fuzzy": lambda: fuzzy_chunks(queries, corpus.notes, corpus.chunks, each_limit),
        "dense": lambda: dense(queries.where("vector IS NOT NULL"), corpus.vectors.join(_large(corpus.chunks.select("chunk_id")), "chunk_id", "left_semi"), settings.dense_k, key="chunk_id"),
        "graph": lambda: graph_chunks(queries, corpus.nodes, corpus.edges, corpus.chunks, each_limit, layer),
    }
    lacking = {"dense": corpus.vectors is None or "vector" not in queries.columns, "graph": corpus.nodes is None or corpus.edges is None}
    hits = {name: each[name]() for name in names if not lacking.get(name, False)}
    if not hits:
        return queries.select("query_id").limit(0).selectExpr("query_id", *(f"cast(null AS {t}) AS {c}" for c, t in (("key", "string"), ("chunk_id", "string"), ("note_id", "string"), ("score", "double"), ("retrievers", "string"), ("rank", "bigint"))))
    fused = fuse(hits, settings.rrf_k).drop("note_id").join(_large(corpus.chunks.select("chunk_id", "note_id")), "chunk_id", "left")
    fused = fused.select("query_id", "key", "chunk_id", "note_id", "score", "retrievers")
    if settings.rerank:
        fused = reranker(fused, queries)
    return top(fused, limit, [F.desc("score"), F.col("key")])


def assemble(hits: DataFrame, budget: int = 4000, per_note: int = 3) -> DataFrame:
    """query_id, place, chunk_id, note_id, score, tokens of the context, and title, content and retrievers where hits have them.

    hits(query_id, chunk_id, note_id, content or tokens, score): of a chunk (or a note without chunk) the best hit, at most
    per_note of a note, then a prefix by score: the first is always kept, the first overflow ends it. Ties go by rank, then
    by content.
    """
    if "tokens" not in hits.columns:
        hits = hits.withColumn("tokens", F.coalesce(estimate_tokens(F.col("content")), F.lit(0)))
    ties = [F.col(c) for c in ("rank", "content") if c in hits.columns]
    key = F.coalesce("chunk_id", F.concat(F.lit("note:"), "note_id"))
    best = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", key).orderBy(F.desc("score"), *ties))).where("_n = 1")
    best = best.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "note_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("_n") <= per_note)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id", "note_id")
    best = best.withColumns({"_upto": F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(w).cast("long")})
    more = [c for c in ("title", "content", "retrievers") if c in hits.columns]
    return best.where(~((F.col("_upto") > budget) & (F.col("_upto") - F.col("tokens") > 0))).select("query_id", "place", "chunk_id", "note_id", "score", "tokens", *more)


def of_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with the columns of their chunks: hits are counted and, if few, go to the chunks, so that no chunk is moved."""
    return chunks.join(_hint(staged(hits, "hits")), "chunk_id")


def with_texts(hits: DataFrame, corpus: Corpus) -> DataFrame:
    """hits with title and content of their chunks and notes."""
    return hits.join(_large(corpus.chunks.select("chunk_id", "content")), "chunk_id", "left").join(_large(corpus.notes.select("note_id", "title")), "note_id", "left")


def chat_context(context: DataFrame) -> DataFrame:
    """query_id, chunks (place, chunk_id, note_id, title, content, score, retrievers), total_tokens of an assembled context."""
    row = F.struct("place", "chunk_id", "note_id", "title", "content", "score", "retrievers")
    return context.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("chunks"), F.sum(F.coalesce(estimate_tokens(F.col("content")), F.lit(0))).alias("total_tokens"))


def search_rows(context: DataFrame) -> DataFrame:
    """query_id, place, note_id, title, chunk_text, score, retrievers: an assembled context as a result list."""
    return context.select("query_id", "place", "note_id", F.coalesce("title", F.lit("")).alias("title"), F.col("content").alias("chunk_text"), "score", "retrievers")
