"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source (DataFrame functions only).

Each document gets integer measures. A sketch is a log-linear histogram of one measure: buckets are exact up to 127 and
keep six further bits of the leading position above (relative error at most 1/64), so that sketches merge by adding
counts, in any order, with one result. No cutoff is fixed: a group's fence is the larger of

    q3 + spread * (q3 - q2)       (median and upper quartile of its sketch)
    q2 + spread * mean excess     (the mean of what values exceed the median by)

The second serves measures that are 0 in most documents, whose quartiles agree: a value is out if it is more than `spread`
times the average excess, as long as such values make less than 1 / spread of the group. The mean excess is drawn towards
that of the merged sketch of the language, and that one's towards everything's, as if `min_rows` documents of it were in
the group, so that one odd sign in a small group isn't out by itself. A group of fewer than `min_rows` documents uses the
fence of its language, or else of everything.

Defined cases: null or empty text has no words and fails the base rules; null language or source is a group of its own;
repeated rows and ties are judged alike, one by one (a value equal to the fence is kept); an empty table gives an empty
result; extra columns pass through, but for those named like a result, which the result replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.base import BLANKS, WORD, fresh, read, small, staged

#: Measure -> SQL over the counts.
MEASURES = {
    "symbol_pm": "coalesce(1000 * n_symbols div nullif(word_chars, 0), 0)",
    "dup_line_pm": "coalesce(1000 * n_dup_lines div nullif(n_lines, 0), 0)",
    "repeat_pm": "coalesce(1000 * n_repeat_words div nullif(n_words, 0), 0)",
    "word_len_cm": "coalesce(100 * word_chars div nullif(n_words, 0), 0)",
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    #: how far beyond the quartile (in distances from the median) or the median (in mean excesses) a fence stands
    spread: int = 12
    min_rows: int = 30


def _without(df: DataFrame, names) -> list[str]:
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def measure(docs: DataFrame, packed_below: int = 1 << 20) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long); the text is read once.

    Words of 5-word windows that occur twice or more count as repeated. Hash and position of a window are packed in one
    long, so that sorting is a sort of longs: 44 bits of hash, 20 of position; equal neighbours are compared on all 64 bits.
    Texts of `packed_below` windows or more sort (hash, position) pairs instead.
    """
    keep = _without(docs, COUNTS)
    df = docs.select(*keep)
    t, w, lines, wh, g, again, s, sp, pos = fresh(df, "_t", "_w", "_lines", "_wh", "_g", "_again", "_s", "_sp", "_pos")
    df = df.withColumn(t, F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn(w, F.expr(f"filter(split({t}, '{BLANKS.replace(chr(92), chr(92) * 2)}'), x -> x != '')"))
    word = WORD.replace("\\", "\\\\")
    df = df.withColumn(lines, F.expr(f"filter(split({t}, '\\n'), x -> x rlike '{word}')"))
    df = df.withColumn(wh, F.expr(f"transform({w}, x -> xxhash64(x))"))
    df = df.withColumn(g, F.expr(f"if(size({wh}) < 6, array(), transform(sequence(0, greatest(size({wh}) - 5, 0)), i -> xxhash64({', '.join(f'{wh}[i + {k}]' for k in range(5))})))"))
    df = df.withColumn(again, F.expr(f"size(array_distinct({g})) < size({g})"))
    packed = f"sort_array(transform({g}, (x, i) -> (x & -1048576L) | i))"
    pairs = f"sort_array(transform({g}, (x, i) -> struct(x AS h, cast(i AS bigint) AS p)))"
    df = df.withColumn(s, F.expr(f"if({again} AND size({g}) < {packed_below}, {packed}, array())"))
    df = df.withColumn(sp, F.expr(f"if({again} AND size({g}) >= {packed_below}, {pairs}, array())"))
    at = lambda i: f"{g}[cast({s}[{i}] & 1048575L AS int)]"
    alike = f"filter(transform({s}, (x, i) -> if((i > 0 AND {at('i')} = {at('i - 1')}) OR (i < size({s}) - 1 AND {at('i')} = {at('i + 1')}), x & 1048575L, -1L)), p -> p >= 0)"
    alike_pairs = f"filter(transform({sp}, (x, i) -> if((i > 0 AND {sp}[i - 1].h = x.h) OR (i < size({sp}) - 1 AND {sp}[i + 1].h = x.h), x.p, -1L)), p -> p >= 0)"
    df = df.withColumn(pos, F.expr(f"sort_array(if(size({sp}) > 0, {alike_pairs}, {alike}))"))
    return df.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.expr(f"cast(regexp_count({t}, '[#*$%&|<>]') AS bigint)").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        F.expr(f"cast(size({lines}) - size(array_distinct({lines})) AS bigint)").alias("n_dup_lines"),
        F.expr(f"aggregate({pos}, struct(0L AS n, -5L AS last), (a, x) -> struct(a.n + least(5L, x - a.last) AS n, x AS last), a -> a.n)").alias("n_repeat_words"),
    )


#: Bucket of a measure and the largest value in a bucket, in SQL that both engines share.
BUCKET = "CASE WHEN {v} < 128 THEN {v} ELSE ({v} >> (length(bin({v})) - 7)) + 64 * (length(bin({v})) - 7) END"


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one mergeable histogram per group and measure."""
    stack = ", ".join(f"'{m}', {sql}" for m, sql in MEASURES.items())
    long = measured.where("NOT base_failed").selectExpr("lang", "source", f"stack({len(MEASURES)}, {stack}) AS (measure, v)")
    return long.selectExpr("lang", "source", "measure", f"cast({BUCKET.format(v='v')} AS bigint) AS bucket").groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame, rules: QualityRules) -> DataFrame:
    """(lang, source, <measure>_max ...) for each group, from its own sketch and those it merges into."""
    top = "CASE WHEN bucket < 128 THEN bucket ELSE (((bucket % 64) + 65) << cast(bucket div 64 - 1 AS int)) - 1 END"

    def quantiles(keys: list[str], tag: str) -> DataFrame:
        """n, median q2, upper quartile q3 and the sum of excesses e of each merged sketch."""
        merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        by = ", ".join([*keys, "measure"])
        run = merged.selectExpr(*keys, "measure", "n", f"{top} AS top", f"sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto", f"sum(n) OVER (PARTITION BY {by}) AS total")
        run = run.selectExpr("*", f"min(CASE WHEN 2 * upto >= total THEN top END) OVER (PARTITION BY {by}) AS q2")
        out = run.groupBy(*keys, "measure").agg(F.max("total"), F.max("q2"), F.expr("min(CASE WHEN 4 * upto >= 3 * total THEN top END)"), F.expr("sum(n * greatest(top - q2, 0))"))
        return out.toDF(*keys, "measure", *(f"{c}_{tag}" for c in ("n", "q2", "q3", "e")))

    own, lang, every = quantiles(["lang", "source"], "own"), quantiles(["lang"], "lang"), quantiles([], "every")
    both = (
        own.alias("o")
        .join(lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.measure") == F.col("l.measure")))
        .join(F.broadcast(every).alias("e"), F.col("o.measure") == F.col("e.measure"))
        .selectExpr("o.lang", "o.source", "o.measure", *(f"{c}_{t}" for t in ("own", "lang", "every") for c in ("n", "q2", "q3", "e")))
    )
    for sql in _fences(rules, " div "):
        both = both.selectExpr("*", sql)
    return both.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col("most"))).alias(f"{m}_max") for m in MEASURES))


def _fences(rules: QualityRules, div: str) -> list[str]:
    """Columns in order: mean excess (in thousandths) of everything, the language and the group; their fences; the one that holds."""
    rows, spread = rules.min_rows, rules.spread
    fence = lambda t: f"greatest(q3_{t} + {spread} * (q3_{t} - q2_{t}), q2_{t} + ({spread} * m_{t}){div}1000)"
    return [
        f"(1000 * e_every){div}n_every AS m_every",
        f"(1000 * e_lang + {rows} * m_every){div}(n_lang + {rows}) AS m_lang",
        f"(1000 * e_own + {rows} * m_lang){div}(n_own + {rows}) AS m_own",
        f"CASE WHEN n_own >= {rows} THEN {fence('own')} WHEN n_lang >= {rows} THEN {fence('lang')} ELSE {fence('every')} END AS most",
    ]


RESULTS = (*COUNTS, "base_failed", *MEASURES, *(f"{m}_max" for m in MEASURES), "kept")


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), keep_text: bool = True) -> DataFrame:
    """docs with the counts of measure(), base_failed, the measures, their thresholds and kept.

    The measured table is staged once; with keep_text=False the text isn't carried. Thresholds are broadcast if their
    counted rows allow it, else joined by shuffle with the documents of each group dealt over 32 salts.
    """
    measured = measure(docs.select(*_without(docs, RESULTS)))
    if not keep_text:
        measured = measured.drop("text")
    measured = measured.withColumn("base_failed", F.expr(f"n_words < {rules.min_words} OR 100 * n_repeat_words > 20 * n_words"))
    measured = staged(measured, "quality")
    cuts = staged(thresholds(staged(sketches(measured), "sketches"), rules), "fences")
    rows = cuts.count()
    own_lang, own_source, salt, deal = fresh(measured, "_lang", "_source", "_salt", "_deal")
    cuts = cuts.withColumnsRenamed({"lang": own_lang, "source": own_source})
    on = F.col("lang").eqNullSafe(F.col(own_lang)) & F.col("source").eqNullSafe(F.col(own_source))
    if rows > 200_000:
        cuts = cuts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(31))))
        measured = measured.withColumn(deal, F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int"))
        on = on & (F.col(deal) == F.col(salt))
    judged = measured.join(small(cuts, rows), on, "left").drop(own_lang, own_source, salt, deal)
    for m, sql in MEASURES.items():
        judged = judged.withColumn(m, F.expr(f"cast({sql} AS bigint)"))
    over = " OR ".join(f"{m} > {m}_max" for m in MEASURES)
    return judged.withColumn("kept", F.expr(f"NOT base_failed AND NOT coalesce({over}, false)"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    out = quality_rules(docs, keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LONG = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {sql.replace(' div ', ' // ')} AS v FROM j WHERE NOT base_failed" for m, sql in MEASURES.items()) + ")"


def _quantile_sql(keys: str, tag: str) -> str:
    by = f"{keys}, measure" if keys else "measure"
    top = "CASE WHEN bucket < 128 THEN bucket ELSE (((bucket % 64) + 65) << (bucket // 64 - 1)::INT) - 1 END"
    merged = f"SELECT {by}, {top} AS top, bucket, sum(n) AS n FROM sk GROUP BY {by}, bucket"
    run = f"SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM ({merged})"
    mid = f"SELECT *, min(CASE WHEN 2 * upto >= total THEN top END) OVER (PARTITION BY {by}) AS q2 FROM ({run})"
    return f"f_{tag} AS (SELECT {by}, max(total) AS n_{tag}, max(q2) AS q2_{tag}, min(CASE WHEN 4 * upto >= 3 * total THEN top END) AS q3_{tag}, sum(n * greatest(top - q2, 0)) AS e_{tag} FROM ({mid}) GROUP BY {by})"


def _fence_sql() -> str:
    """Nested selects, one for each column of _fences()."""
    out = "SELECT o.*, l.* EXCLUDE (lang, measure), e.* EXCLUDE (measure) FROM f_own o JOIN f_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN f_every e ON o.measure = e.measure"
    for sql in _fences(QualityRules(), " // "):
        out = f"SELECT *, {sql} FROM ({out})"
    return out


#: The same rules in DuckDB's SQL, with exact windows of words instead of hashes.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
n AS (SELECT rid, sum(least(5, i - prev)) AS n_repeat FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -5) AS prev FROM r) GROUP BY rid),
c AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN n USING (rid)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
l AS ({_LONG}),
sk AS (SELECT lang, source, measure, {BUCKET.format(v='v').replace('>> (length(bin(v)) - 7)', '>> (length(bin(v)) - 7)::INT')} AS bucket, count(*) AS n FROM l GROUP BY ALL),
{_quantile_sql('lang, source', 'own')},
{_quantile_sql('lang', 'lang')},
{_quantile_sql('', 'every')},
m AS ({_fence_sql()}),
x AS (SELECT lang, source, {', '.join(f"max(CASE WHEN measure = '{m}' THEN most END) AS {m}_max" for m in MEASURES)} FROM m GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({' OR '.join(f"{sql.replace(' div ', ' // ')} > {m}_max" for m, sql in MEASURES.items())}, false) AS kept
FROM j LEFT JOIN x ON j.lang IS NOT DISTINCT FROM x.lang AND j.source IS NOT DISTINCT FROM x.source
"""
