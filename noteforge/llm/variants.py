"""Spelling variants by a symmetric-delete join: near words share a key, forms follow frequency, roots follow forms.

1. Counts. Runs of Latin letters are lower-cased (A-Z only); of a run whose crc32 with its document's id is divisible by
   `planted`, one code point is deleted. Each task adds up its own counts before the shuffle.
2. Keys. Every word emits itself and its distinct single deletions, as 64-bit hashes that are updated from one deletion to
   the next, so that a word of a million letters costs a million short rows rather than as many long ones. A deletion out
   of a run of equal letters counts once, with the run's first and last place.
3. Pairs. Rows of equal keys are joined where their places overlap: a replacement deletes the same place on both sides, an
   insertion meets the other word itself. What shares a key is bounded by the alphabet times the word's length, not by the
   corpus, and the overlap leaves no pair that only shares a key. Pairs are then verified letter by letter.
4. Forms and roots. The nearest frequent word is a word's form; chains of forms are joined by doubling. A form has
   `least_ratio` times the count, so chains are as long as a logarithm of the largest count.

Defined cases: a null text has no words; a null doc_id counts as an empty one; repeated rows count each; runs may be of any
length; an empty table, or one without frequent words, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.base import drop_staged, free, read, staged

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Modulus and base of a key's polynomial: a Mersenne prime and a number without structure.
PRIME = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % PRIME


@dataclass(frozen=True)
class Variants:
    least_length: int = 6
    least_count: int = 5
    least_ratio: int = 5
    #: a run whose checksum this divides loses a letter (0: none does)
    planted: int = 199
    #: words, and their letters, that a task adds up before it hands them on
    held: int = 200_000
    held_letters: int = 16_000_000


def words_of(doc_id, text: str | None, rules: Variants) -> Counter:
    """Counts of a text's words of at least `least_length` letters."""
    out: Counter = Counter()
    if not text:
        return out
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
        size = len(word)
        if size < rules.least_length:
            continue
        if rules.planted:
            h = zlib.crc32(word.encode(), start)
            if h % rules.planted == 0:
                at = h % size
                word = word[:at] + word[at + 1 :]
                if size - 1 < rules.least_length:
                    continue
        out[word] += n
    return out


def word_counts(docs: DataFrame, rules: Variants = Variants()) -> DataFrame:
    """(word, n) of every word of docs (doc_id, text) that is long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        letters = 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in words_of(doc.as_py(), text.as_py(), rules).items():
                    if word not in held:
                        letters += len(word)
                    held[word] += n
                    if len(held) >= rules.held or letters >= rules.held_letters:
                        yield out()
                        letters = 0
        yield out()
        free()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rules.least_count)


def deletions(word: str) -> Iterator[tuple[int, int, int]]:
    """(key, first, last): the word itself, with all places, and its distinct single deletions with theirs."""
    codes, power, key, whole = [ord(c) + 1 for c in word], 1, 0, 0
    for k, c in enumerate(codes):
        whole = (whole + c * power) % PRIME
        if k:
            key = (key + c * below) % PRIME
        below, power = power, power * BASE % PRIME
    yield whole, 0, len(codes)
    first, power = 0, 1
    for i, c in enumerate(codes):
        nxt = codes[i + 1] if i + 1 < len(codes) else None
        if nxt != c:
            yield key, first, i
            first = i + 1
            if nxt is not None:
                key = (key + (c - nxt) * power) % PRIME
        power = power * BASE % PRIME


def _keys(words: DataFrame) -> DataFrame:
    """(key, id, first, last) of words(id, word)."""
    kinds = [("key", pa.int64()), ("id", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int]] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

        for batch in batches:
            for i, word in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for key, first, last in deletions(word.as_py()):
                    rows.append((key, i, first, last))
                    if len(rows) >= 20_000:
                        yield out()
                        rows = []
        yield out()
        free()

    return words.select("id", "word").mapInArrow(run, "key long, id long, first int, last int")


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), ids of words(id, word) that differ by exactly one letter more, less or other; each pair once."""
    keys = staged(_keys(words), "variant-keys")
    x, y = (keys.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "first", "last"))) for s in "xy")
    at = F.greatest("first_x", "first_y")
    pairs = x.join(y, "key").where((F.col("id_x") < F.col("id_y")) & (at <= F.least("last_x", "last_y"))).select("id_x", "id_y", at.alias("at"))
    text = words.select("id", "word")
    both = pairs.join(text.toDF("id_x", "word_x"), "id_x").join(text.toDF("id_y", "word_y"), "id_y")
    cut = lambda c, i: F.concat(F.substring(c, F.lit(1), i), F.substring(c, i + 2, F.length(c)))
    i, nx, ny = F.col("at"), F.length("word_x"), F.length("word_y")
    exact = F.when(nx == ny, cut("word_x", i) == cut("word_y", i)).when(nx == ny + 1, cut("word_x", i) == F.col("word_y")).when(nx + 1 == ny, F.col("word_x") == cut("word_y", i))
    return both.where(exact).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))


def roots(links: DataFrame) -> DataFrame:
    """(id, to, root) of links(id, to, root): `to` is followed to its end by doubling; root is the name of `to`."""
    up = staged(links, "variant-links")
    while True:
        more = staged(up.join(up.toDF("to", "next", "name"), "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.coalesce("name", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-links")
        drop_staged(up)
        up = more.drop("moved")
        if more.where("moved").isEmpty():
            return up


def variants(docs: DataFrame, rules: Variants = Variants()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word of docs (doc_id, text)."""
    counts = staged(word_counts(docs, rules), "variant-counts")
    words = staged(counts.withColumn("id", F.monotonically_increasing_id()), "variant-words")
    drop_staged(counts)
    pairs = staged(near_words(words), "variant-pairs")
    ends = pairs.union(pairs.select("b", "a")).toDF("id", "other")
    others = words.select(F.col("id").alias("other"), (-F.col("n")).alias("minus"), F.col("word").alias("near"))
    near = ends.join(others, "other").groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("minus", "near", "other")).alias("best"))
    judged = words.join(near, "id", "left").withColumn("is_form", F.coalesce(-F.col("best.minus") >= rules.least_ratio * F.col("n"), F.lit(False)))
    judged = staged(judged, "variant-forms")
    up = roots(judged.where("is_form").select("id", F.col("best.other").alias("to"), F.col("best.near").alias("root")))
    out = judged.join(up.select("id", "root"), "id", "left")
    form = lambda c: F.when(F.col("is_form"), c)
    return out.select("word", form(F.col("best.near")).alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form(-F.col("best.minus")).alias("form_n"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents", "doc_id", "text"))


#: The checksum by its published polynomial; near words by patterns with one place left open.
ORACLE = r"""
WITH RECURSIVE k AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) t(i))),
t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS n FROM t WHERE length(w) >= 6 GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1])), 4294967295) AS h FROM g, k),
m AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
p AS MATERIALIZED (SELECT word, i, left(word, i) AS l, substr(word, i + 2) AS r FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
e AS (SELECT x.word AS a, y.word AS b FROM p x JOIN p y ON x.l = y.l AND x.r = y.r AND x.word <> y.word UNION SELECT x.word, v.word FROM p x JOIN v ON x.l || x.r = v.word UNION SELECT v.word, x.word FROM p x JOIN v ON x.l || x.r = v.word),
b AS MATERIALIZED (SELECT a AS word, count(*) AS n_near, first(b ORDER BY v.n DESC, b) AS best, max(v.n) AS best_n FROM e JOIN v ON v.word = b GROUP BY a),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
u AS (SELECT word, form AS up, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT u.word, f.form, step + 1 FROM u JOIN f ON f.word = u.up WHERE f.form IS NOT NULL),
l AS (SELECT word, arg_max(up, step) AS root FROM u GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN l USING (word)
"""
