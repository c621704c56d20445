"""An inverted index that is kept: written once a run, read by every search, with exact early termination.

Chunks get ascending numbers; a block is the postings of one term among BLOCK numbers in a row, so the blocks of all terms
lie side by side and none grows with the corpus. A block's row holds the numbers as offsets into it, the counts and lengths,
and beside them what bounds any score in it: the highest count, share and the least length. Rows are sorted by term, so a
search for a few terms reads few row groups.

A run adds the blocks of new and changed chunks, tombstones for the old ones, and what it changes in the document
frequencies; these are summed when read, so any sequence of runs gives the statistics of a rebuild. Norms depend on all
frequencies and are written anew by each run, with the least one of each block; each run's texts are kept as counted terms, chunk
by chunk, so that norms are summed where a chunk lies. The list of runs is the last thing that is
written: a run that breaks leaves the index as it was.

A search bounds every block of every query by its rows' bounds, scores the most promising blocks, and then only those whose
bound reaches the k-th score found. Bounds never fall short of a score, so the hits are those of a full scan.

Defined cases: blank queries and chunks find and hold nothing (a blank chunk counts as a chunk); a null content is blank; a query
that no chunk fits has no rows; chunks of an empty table are removed; ties go by chunk_id. chunk_id tells chunks apart.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteforge.functions.text import tokens
from noteforge.sources import store
from noteforge.sources.staging import staged

#: Numbers that a block spans.
BLOCK = 256
#: Blocks of a query that are scored before the others are judged by their bounds.
FIRST = 8
#: So many distinct terms are sought by value, which skips row groups; more of them by a join.
BY_VALUE = 500
#: Rows that may be broadcast; they are counted first.
MOST = 500_000
#: Scores are rounded to six places: a bound may fall short of one by so much.
SLACK = 1e-6
TABLES = {
    "members": "num long, chunk_id string, print long, len long",
    "texts": "num long, len long, terms array<struct<term:string,tf:bigint>>",
    "blocks": "term string, block long, offsets array<int>, counts array<long>, lens array<long>, most long, share double, least long",
    "changes": "term string, d long",
    "dead": "num long",
    "norms": "num long, norm double",
    "floors": "block long, floor double",
}
BM25_GAIN = "{idf} * {tf} * 2.2D / ({tf} + 1.2D * (0.25D + 0.75D * {len} / {average}D))"


def frequent(df: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """df(term, df) as the most frequent terms, about `most` of them at most, and the others (None without any); told apart by powers of two."""
    power = F.floor(F.log2("df"))
    sizes = df.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("power")).collect()  # 64 rows at most
    held, least = 0, None
    for r in sizes:
        held += r["n"]
        if held > most:
            break
        least = r["power"]
    else:
        return df, None
    if least is None:
        return df.limit(0), df
    return df.where(power >= least), df.where(power < least)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST + 1).count() <= MOST else df


@dataclass(frozen=True)
class Inverted:
    """The index as a run left it."""

    members: DataFrame
    blocks: DataFrame
    frequencies: DataFrame
    dead: DataFrame
    norms: DataFrame
    floors: DataFrame
    chunks: int
    tokens: int

    def _terms(self, queries: DataFrame) -> DataFrame:
        """query_id, term, tf, len of the queries' tokens."""
        t = queries.select("query_id", tokens(F.col("query")).alias("t"))
        return staged(t.select("query_id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len")), "query-terms")

    def _sought(self, terms: DataFrame) -> DataFrame:
        """The blocks of the terms."""
        distinct = [r[0] for r in terms.select("term").distinct().limit(BY_VALUE + 1).collect()]
        if len(distinct) <= BY_VALUE:
            return self.blocks.where(F.col("term").isin(distinct))
        return self.blocks.join(_small(terms.select("term").distinct()), "term", "left_semi")

    def _known(self, terms: DataFrame) -> DataFrame:
        """term, df of the terms that there are."""
        own = self.frequencies.join(_small(terms.select("term").distinct()), "term", "left_semi")
        return staged(own, "query-frequencies")

    def _search(self, weighted: DataFrame, bound: str, gain: str, all_terms: bool, floors: bool, k: int | None) -> tuple[DataFrame, DataFrame]:
        """(hits, bounds) of weighted(query_id, term, terms, idf, w): exact sums of gain by query and chunk, pruned by the blocks' bounds."""
        q = staged(weighted, "query-weights")
        sought = self._sought(q)
        heads = sought.select("term", "block", "most", "share", "least").join(_small(q), "term")
        heads = heads.groupBy("query_id", "block").agg(F.sum(F.expr(bound)).alias("bound"), F.count(F.lit(1)).alias("n"), F.first("terms").alias("terms"))
        heads = heads.where("n = terms") if all_terms else heads
        if floors:
            heads = heads.join(self.floors, "block").withColumn("bound", F.col("bound") / F.col("floor"))
        line = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        first = staged(heads.withColumn("place", F.row_number().over(line)).where(F.col("place") <= FIRST).select("query_id", "block"), "first-blocks")
        found = staged(self._scored(first, q, sought, gain, all_terms), "first-scores")
        if k is None:
            rest = heads.select("query_id", "block", "bound")
        else:
            of_rank = Window.partitionBy("query_id").orderBy(F.desc("score"))
            least = found.withColumn("r", F.row_number().over(of_rank)).where(F.col("r") == k).select("query_id", F.col("score").alias("least_score"))
            rest = heads.join(_small(least), "query_id", "left").where(F.col("least_score").isNull() | (F.col("bound") + SLACK >= F.col("least_score"))).select("query_id", "block", "bound")
        rest = staged(rest.join(first, ["query_id", "block"], "left_anti"), "rest-blocks")
        return found.union(self._scored(rest, q, sought, gain, all_terms)), heads.select("query_id", "block").join(first.union(rest.select("query_id", "block")).withColumn("read", F.lit(1)), ["query_id", "block"], "left")

    def _scored(self, pairs: DataFrame, q: DataFrame, sought: DataFrame, gain: str, all_terms: bool) -> DataFrame:
        """query_id, num, score of the chunks in blocks of pairs(query_id, block)."""
        wanted = _small(pairs.select("query_id", "block").join(_small(q), "query_id"))
        rows = sought.select("term", "block", "offsets", "counts", "lens").join(wanted, ["term", "block"])
        rows = rows.select("query_id", "terms", "idf", "w", F.expr(f"inline(transform(arrays_zip(offsets, counts, lens), x -> struct(block * {BLOCK} + x.offsets AS num, x.counts AS tf, x.lens AS len)))"))
        sums = rows.groupBy("query_id", "num").agg(F.sum(F.expr(gain)).alias("score"), F.count(F.lit(1)).alias("n"), F.first("terms").alias("terms"))
        sums = (sums.where("n = terms") if all_terms else sums).join(_small(self.dead), "num", "left_anti")
        if not all_terms:
            sums = sums.join(self.norms, "num").withColumn("score", F.col("score") / F.col("norm"))
        return sums.select("query_id", "num", F.round("score", 6).alias("score"))

    def _named(self, hits: DataFrame, k: int | None) -> DataFrame:
        named = hits.join(self.members.select("num", "chunk_id"), "num").select("query_id", "chunk_id", "score").where("score > 0")
        line = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        out = named.withColumn("rank", F.row_number().over(line))
        return (out.where(F.col("rank") <= k) if k else out).withColumn("rank", F.col("rank").cast("long"))

    def _bm25(self, queries: DataFrame, k: int | None) -> tuple[DataFrame, DataFrame]:
        q = self._terms(queries)
        n, average = float(self.chunks), (self.tokens / self.chunks if self.chunks else 0.0) or 1.0
        idf = F.greatest(F.lit(1e-6), F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        own = q.withColumn("terms", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).join(_small(self._known(q)), "term")
        weighted = own.select("query_id", "term", "terms", idf.alias("idf"), F.lit(1.0).alias("w"))
        part = lambda tf, size: BM25_GAIN.format(idf="idf", tf=tf, len=size, average=repr(average))
        return self._search(weighted, part("most", "least"), part("tf", "len"), True, False, k)

    def bm25(self, queries: DataFrame, k: int | None = 50) -> DataFrame:
        """query_id, chunk_id, score, rank: chunks with all terms of a query, as retrieval.bm25() gives them."""
        return self._named(self._bm25(queries, k)[0], k)

    def _tfidf(self, queries: DataFrame, k: int | None) -> tuple[DataFrame, DataFrame]:
        q = self._terms(queries)
        idf = F.log(F.lit(self.chunks + 1.0) / (F.col("df") + 1)) + 1
        own = q.join(_small(self._known(q)), "term", "left").withColumn("idf", F.coalesce(idf, F.lit(1.0))).withColumn("w", F.col("tf") / F.col("len") * F.col("idf"))
        own = own.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id"))))
        weighted = own.select("query_id", "term", F.lit(0).alias("terms"), "idf", "w")
        return self._search(weighted, "w * idf * share", "w * idf * tf / len", False, True, k)

    def tfidf(self, queries: DataFrame, k: int | None = 50) -> DataFrame:
        """query_id, chunk_id, score, rank: cosines of TF-IDF vectors, as retrieval.tfidf() gives them."""
        return self._named(self._tfidf(queries, k)[0], k)

    def read_share(self, queries: DataFrame, kind: str, k: int = 50) -> DataFrame:
        """query_id, blocks, read: the blocks with a bound for each query, and how many of them a search scores."""
        _, bounds = {"bm25": self._bm25, "tfidf": self._tfidf}[kind](queries, k)
        return bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.count("read").alias("read"))


def _path(folder: str, run: str, name: str) -> str:
    return f"{folder}/{run}/{name}"


def load(spark: SparkSession, folder: str) -> Inverted | None:
    """The index in a folder; None where there is none."""
    found = store.load(spark, folder).get("runs")
    if found is None:
        return None
    runs = found.orderBy("number").collect()  # a row per run since the last rebuild
    of = lambda name, names: spark.read.schema(TABLES[name]).parquet(*(_path(folder, r, name) for r in names))
    every, last = [r["run"] for r in runs], [runs[-1]["run"]]
    frequencies = of("changes", every).groupBy("term").agg(F.sum("d").alias("df")).where("df > 0")
    return Inverted(of("members", every), of("blocks", every), frequencies, of("dead", every), of("norms", last), of("floors", last), runs[-1]["chunks"], runs[-1]["tokens"])


def _postings(blocks: DataFrame) -> DataFrame:
    """num, term, tf, len of blocks."""
    return blocks.select("term", F.expr(f"inline(transform(arrays_zip(offsets, counts, lens), x -> struct(block * {BLOCK} + x.offsets AS num, x.counts AS tf, x.lens AS len)))"))


def sync(spark: SparkSession, folder: str, chunks: DataFrame, rebuild: bool = False) -> Inverted:
    """Bring the index in folder to chunks(chunk_id, content): one run that adds what is new or changed and buries what is gone.

    rebuild leaves the earlier runs behind, which is due when many of their chunks are dead, and after a thousand runs.
    """
    kept = store.load(spark, folder).get("runs")
    rebuild = rebuild or kept is not None and "texts" not in kept.columns  # an index of earlier code kept no texts
    old = None if rebuild else load(spark, folder)
    before = [] if old is None else [r.asDict() for r in kept.orderBy("number").collect()]
    number = before[-1]["number"] + 1 if before else 0
    if number >= 1000:
        return sync(spark, folder, chunks, rebuild=True)
    run = f"run-{number}-{uuid.uuid4().hex}"
    now = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce("content", F.lit("")).alias("content")).withColumn("print", F.xxhash64("content"))
    gone = None
    if old is not None:
        live = old.members.join(old.dead, "num", "left_anti")
        gone = staged(live.join(now.select("chunk_id", "print"), ["chunk_id", "print"], "left_anti").select("num", "len"), "gone")
        now = now.join(live.select("chunk_id", "print"), ["chunk_id", "print"], "left_anti")
    runs = "transform(b, (p, i) -> struct(t[p] AS term, cast(coalesce(get(b, i + 1), size(t)) - p AS bigint) AS tf))"
    cut = now.withColumn("t", F.array_sort(tokens(F.col("content")))).withColumn("b", F.expr("filter(sequence(0, size(t)), i -> i < size(t) AND (i = 0 OR t[i] <> t[i - 1]))"))
    num = F.lit(number << 53) + F.monotonically_increasing_id()
    cut = cut.select(num.alias("num"), "chunk_id", "print", F.size("t").cast("long").alias("len"), F.expr(runs).alias("terms"))
    cut.write.parquet(_path(folder, run, "texts"))
    cut = spark.read.schema(cut.schema).parquet(_path(folder, run, "texts"))
    cut.select("num", "chunk_id", "print", "len").write.parquet(_path(folder, run, "members"))
    one = cut.select("num", "len", F.expr("inline(terms)"))
    entry = F.struct((F.col("num") % BLOCK).cast("int").alias("at"), "tf", "len")
    blocks = one.groupBy("term", F.expr(f"num div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("p"), F.max("tf").alias("most"), F.max(F.col("tf") / F.col("len")).alias("share"), F.min("len").alias("least"))  # at most BLOCK rows a group
    blocks = blocks.select("term", "block", F.col("p.at").alias("offsets"), F.col("p.tf").alias("counts"), F.col("p.len").alias("lens"), "most", "share", "least")
    blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(_path(folder, run, "blocks"))
    changes = one.groupBy("term").agg(F.count(F.lit(1)).alias("d"))
    total = cut.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    chunks_now, tokens_now = (before[-1]["chunks"], before[-1]["tokens"]) if before else (0, 0)
    chunks_now, tokens_now = chunks_now + total[0], tokens_now + total[1]
    if gone is not None:
        less = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        chunks_now, tokens_now = chunks_now - less[0], tokens_now - less[1]
        nums = gone.select("num")
        lost = old.blocks.join(nums.select(F.expr(f"num div {BLOCK}").alias("block")).distinct(), "block", "left_semi")
        lost = _postings(lost).join(nums, "num", "left_semi").groupBy("term").agg((-F.count(F.lit(1))).alias("d"))
        changes = changes.union(lost).groupBy("term").agg(F.sum("d").alias("d")).where("d <> 0")
        nums.write.parquet(_path(folder, run, "dead"))
    else:
        spark.createDataFrame([], TABLES["dead"]).write.parquet(_path(folder, run, "dead"))
    changes.write.parquet(_path(folder, run, "changes"))
    names = [*(b["run"] for b in before), run]
    of = lambda name: spark.read.schema(TABLES[name]).parquet(*(_path(folder, r, name) for r in names))
    df = of("changes").groupBy("term").agg(F.sum("d").alias("df")).where("df > 0")
    idf = F.log(F.lit(chunks_now + 1.0) / (F.col("df") + 1)) + 1
    w = F.col("tf") / F.col("len") * F.col("idf")
    df = staged(df.select("term", "df", idf.alias("idf")), "frequencies")
    # chunk by chunk, as the texts lie: only the sums are moved, and the postings of terms too rare to be sent to every task
    entries = of("texts").join(of("dead"), "num", "left_anti").select("num", "len", F.expr("inline(terms)"))
    known, rare = frequent(df)
    sums = entries.join(F.broadcast(known), "term").groupBy("num").agg(F.sum(w * w).alias("s"))
    if rare is not None:
        seldom = entries.join(F.broadcast(known.select("term")), "term", "left_anti").join(rare, "term")
        sums = sums.union(seldom.groupBy("num").agg(F.sum(w * w).alias("s"))).groupBy("num").agg(F.sum("s").alias("s"))
    norms = sums.select("num", F.sqrt("s").alias("norm"))
    norms.write.parquet(_path(folder, run, "norms"))
    spark.read.schema(TABLES["norms"]).parquet(_path(folder, run, "norms")).groupBy(F.expr(f"num div {BLOCK}").alias("block")).agg(F.min("norm").alias("floor")).write.parquet(_path(folder, run, "floors"))
    listed = [*before, {"number": number, "run": run, "chunks": chunks_now, "tokens": tokens_now}]
    store.save(spark, folder, {"runs": spark.createDataFrame([(r["number"], r["run"], r["chunks"], r["tokens"], True) for r in listed], "number long, run string, chunks long, tokens long, texts boolean")})
    return load(spark, folder)
