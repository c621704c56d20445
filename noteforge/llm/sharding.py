"""Sharding along a Hilbert curve (DataFrame functions only): quantise, sort by curve index, cut runs.

Language, source and magnitude of the size (its binary digits) are quantised to 5 bits each: a value's cell is where the middle
of its bytes stands among all bytes in the order of values, so that the halves of each dimension hold like shares whatever
the number of its values, and each takes part in the first bits of the curve. The index of a cell on the three-dimensional Hilbert curve orders the texts, a run of the order covers a
compact box of all three dimensions, and readers can skip shards. Rows of one text are neighbours (their cell is that of
the text's least language and source). The order is cut into runs of nearly equal bytes. A group of equal texts goes as
a whole to the run that its middle falls in; only a group larger than `tolerance` of a shard is cut like any other rows,
since a shard's bytes are to differ from an equal share by no more than that (and a row).

Global places come from a range partitioning, sums per partition and a window within each partition; no task sees more
than its range, and a text with a third of all rows is spread by doc_id.

Defined cases: null text counts as empty (size 1, crc 0); null language, source and doc_id sort first; ties (rows of one text
and doc_id) are interchangeable; repeated rows get slots of their own; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteforge.llm.base import read, shuffle_parts, small, staged

BITS = 5
#: Share of a shard that a group of equal texts may have to stay whole.
TOLERANCE = 0.05


def _curve_tables(n: int) -> tuple[list[int], list[int]]:
    """Digit and next state for each state and cell of one level, by the published rule of entry points and directions.

    A state is the entry corner e and direction d of the curve in a cube of 2**n cells, numbered d * 2**n + e.
    """
    full = (1 << n) - 1
    left = lambda x, k: (x << k % n | x >> (n - k % n)) & full
    trailing = lambda x: (x ^ (x + 1)).bit_length() - 1  # noqa: E731  # ones at the end
    digits, states = [], []
    for d in range(n):
        for e in range(1 << n):
            for cell in range(1 << n):
                gray, w = left(cell ^ e, n - (d + 1) % n), 0
                while gray:  # Gray code to number
                    w ^= gray
                    gray >>= 1
                even = max(0, (w - 1) // 2 * 2)
                entry, turn = even ^ even >> 1, trailing(w - 1 if w % 2 == 0 else w) % n if w else 0
                digits.append(w)
                states.append(((d + turn + 1) % n) * (1 << n) + (e ^ left(entry, d + 1)))
    return digits, states


def _curve_steps(n: int, bits: int, at: str) -> list[dict[str, str]]:
    """Columns x0 .. x(n-1) to their Hilbert index h by levels, as SQL: a dict per step. at: element of a list by place from 1."""
    digits, states = (", ".join(map(str, t)) for t in _curve_tables(n))
    steps = []
    for level in range(bits - 1, -1, -1):
        cell = " + ".join(f"((x{i} >> {level}) & 1) * {1 << i}" for i in range(n))
        steps.append({"c": f"s * {1 << n} + {cell} + 1"})
        steps.append({"h": f"h * {1 << n} + {at.format(digits, 'c')}", "s": at.format(states, "c")})
    return steps


def hilbert_index(df: DataFrame, dims: list[str], bits: int, out: str) -> DataFrame:
    """df with the Hilbert index of the integer columns dims (each 0 .. 2**bits-1)."""
    zero = F.lit(0).cast("long")
    now = df.select(F.struct(*df.columns).alias("row"), *(F.col(d).cast("int").alias(f"x{i}") for i, d in enumerate(dims)), zero.alias("h"), zero.alias("s"))
    for step in _curve_steps(len(dims), bits, "element_at(array({0}), cast({1} AS int))"):
        now = now.withColumns({c: F.expr(sql).cast("long") for c, sql in step.items()})
    return now.select("row.*", F.col("h").alias(out))


def _cells(texts: DataFrame, name: str) -> DataFrame:
    """texts(copies, size, name) with c_<name>: the place of the middle of the value's bytes among all, by sorted values, scaled to BITS bits."""
    values = staged(texts.groupBy(F.col(name).alias("_v")).agg(F.sum(F.col("copies") * F.col("size")).alias("_w")), f"values-{name}")
    n, total = values.agg(F.count(F.lit(1)), F.sum("_w")).first()
    order = F.col("_v").asc_nulls_first()
    ranged = staged(values.repartitionByRange(shuffle_parts(texts.sparkSession), order).withColumn("_p", F.spark_partition_id()), f"ranges-{name}")
    parts = ranged.groupBy("_p").agg(F.sum("_w").alias("_n"))
    parts = parts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # bounded: a row per range partition
    inside = F.coalesce(F.sum("_w").over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = staged(ranged.join(F.broadcast(parts), "_p").select("_v", (2 * (F.col("_before") + inside) + F.col("_w")).alias("_twice")), f"places-{name}")
    places = places.select("_v", F.expr(f"_twice * {1 << BITS} div {2 * max(total or 0, 1)}").cast("long").alias(f"c_{name}"))
    return texts.join(small(places, n), F.col(name).eqNullSafe(F.col("_v")), "left").drop("_v")


def shards(docs: DataFrame, n_shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, lang, source, curve, shard, slot of every row of docs (doc_id, text, lang, source)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    rows = staged(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"), "lang", "source"), "shard-rows")
    one = ["key", "size", "text_crc32"]
    texts = rows.groupBy(*one).agg(F.count(F.lit(1)).alias("copies"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    texts = staged(texts.withColumn("digits", F.length(F.bin("size"))), "shard-texts")
    total = texts.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    cells = _cells(_cells(_cells(texts, "lang"), "source"), "digits")
    cells = hilbert_index(cells, ["c_lang", "c_source", "c_digits"], BITS, "curve")
    group = F.col("copies") * F.col("size")
    texts = staged(cells.select(*one, "curve", group.alias("group"), (group * n_shards > F.lit(int(tolerance * total))).alias("large")), "shard-curve")
    # Rows of a text that isn't large share a range key and so a partition; those of a large one are dealt by doc_id.
    ranged = rows.join(texts, one).withColumn("deal", F.when(F.col("large"), F.col("doc_id")))
    order = [F.col("curve"), *map(F.col, one), F.col("deal").asc_nulls_first()]
    ranged = staged(ranged.repartitionByRange(shuffle_parts(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()), "shard-ranges")
    parts = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # bounded: a row per range partition
    parts = parts.select("part", F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("rows_before"))
    line = Window.partitionBy("part").orderBy(*order, F.col("doc_id").asc_nulls_first())
    placed = ranged.withColumns({"_b": F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_r": F.row_number().over(line) - 1})
    placed = placed.withColumn("_first", F.min("_b").over(Window.partitionBy("part", "curve", *one)))
    placed = placed.join(F.broadcast(parts), "part")
    # Twice the place that decides: the middle of a large group's row, or of any other group.
    twice = F.when(F.col("large"), 2 * F.col("_b") + F.col("size")).otherwise(2 * F.col("_first") + F.col("group")) + 2 * F.col("bytes_before")
    placed = placed.withColumns({"_twice": twice, "row": F.col("_r") + F.col("rows_before")})
    placed = placed.withColumn("shard", F.expr(f"cast(least(_twice * {n_shards} div {2 * max(total, 1)}, {n_shards - 1}) AS int)"))
    placed = staged(placed.select("doc_id", "size", "text_crc32", "lang", "source", "curve", "shard", "row"), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "lang", "source", "curve", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))


def op9_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    out = shards(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _oracle(n_shards: int = 8) -> str:
    """The same order and cuts over one sorted list; the checksum from its published table, byte by byte."""
    table = "SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) t(i))"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1])), 4294967295)"
    cell = lambda c: f"(SELECT any_value(x) FROM (SELECT {c} AS v, (2 * (sum(w) OVER (ORDER BY {c} NULLS FIRST) - w) + w)::BIGINT * {1 << BITS} // (2 * (SELECT total FROM s)) AS x FROM (SELECT {c}, sum(copies * size)::BIGINT AS w FROM g GROUP BY {c})) WHERE v IS NOT DISTINCT FROM g.{c})"
    curve = f"SELECT *, {cell('lang')} AS x0, {cell('source')} AS x1, {cell('digits')} AS x2, 0::BIGINT AS c, 0::BIGINT AS h, 0::BIGINT AS s FROM g"
    for step in _curve_steps(3, BITS, "[{0}][{1}]"):
        curve = f"SELECT * REPLACE ({', '.join(f'({sql})::BIGINT AS {c}' for c, sql in step.items())}) FROM ({curve})"
    return f"""
WITH k AS ({table}),
r AS MATERIALIZED (SELECT doc_id, strlen(t)::BIGINT + 1 AS size, {crc} AS text_crc32, ('0x' || substr(md5(t), 1, 15))::BIGINT AS key, lang, source FROM (SELECT *, coalesce(text, '') AS t FROM documents), k),
s AS MATERIALIZED (SELECT sum(size)::BIGINT AS total FROM r),
g AS MATERIALIZED (SELECT key, size, text_crc32, count(*) AS copies, min(lang) AS lang, min(source) AS source, length(bin(size)) AS digits FROM r GROUP BY key, size, text_crc32),
c AS (SELECT key, size, text_crc32, h AS curve, copies * size AS grp, copies * size * {n_shards} > floor({TOLERANCE} * total)::BIGINT AS large FROM ({curve}), s),
o AS (SELECT r.doc_id, size, text_crc32, key, curve, grp, large, sum(size) OVER w - size AS b, row_number() OVER w AS n FROM r JOIN c USING (key, size, text_crc32) WINDOW w AS (ORDER BY curve, key, size, text_crc32, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, min(b) OVER (PARTITION BY curve, key, size, text_crc32) AS first FROM o),
p AS (SELECT *, least((CASE WHEN large THEN 2 * b + size ELSE 2 * first + grp END) * {n_shards} // (2 * total), {n_shards - 1})::INT AS shard FROM f, s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS slot, NULL::INT AS grown_shard FROM p
"""


ORACLE = _oracle()
