"""License scans (DataFrame functions only): MinHash bands over overlapping windows, then exact shingle containment.

Texts are lower-cased and cut into runs of letters and digits; shingles are two words. Windows of 5 words begin at every
second word of a text and at every word of a template, so that a template of 6 words or more always has a window of its
own in the text. A window is retrieved for a template if one of 16 bands (of one MinHash row each) agrees with one of the
template's windows: a template of three words shares half of a window's shingles and is missed with probability
(1/2)^16 = 1.5e-5, one of five words with (2/5)^16. A retrieved window is verified exactly where it is found: the share of
the template's distinct shingles in the window and its surroundings must reach `containment`, and so must the share of those
shingles that no other license's templates have (else "gnu general" would do for "gnu affero general").

Templates (id, text) are a parameter, an id may have several; a text of more than 16 words is cut into parts that overlap by
half, and the shares of its parts are summed. The templates' band values (a row per word, part and band, `MOST_VALUES` at most)
and shingles are broadcast; a text's windows meet them in the task that reads the text, so texts are read once and never shuffled.

Defined cases: null or empty text and texts of one word match nothing; repeated rows get the same result, rows of one doc_id
that of all of them; a null doc_id is matched as one document; ties don't matter, as every license that reaches the shares is
named; templates of fewer than two words are refused; an empty table gives an empty result; scan() keeps extra columns but
for n_licenses, licenses and containment, which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.llm.base import fresh, read, staged

#: Notices (fixed values): license and text.
TEMPLATES = (
    ("agpl-3.0", "under the terms of the GNU Affero General Public License, version 3"),
    ("all-rights-reserved", "All rights reserved"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "under the terms of the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)


@dataclass(frozen=True)
class LicenseScan:
    step: int = 2
    bands: int = 16
    part: int = 16
    containment: float = 0.8


def _shingles(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the hashes of the text's two-word shingles, in order."""
    df = df.withColumn("_w", F.expr(f"transform(filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x != ''), x -> xxhash64(x))"))
    return df.withColumn(out, F.expr("if(size(_w) < 2, cast(array() AS array<bigint>), transform(sequence(0, greatest(size(_w) - 2, 0)), i -> xxhash64(get(_w, i), get(_w, i + 1))))")).drop("_w")


#: Shingles in a window; bound of the templates' band values, which are broadcast (about 24 bytes each).
SIZE, MOST_VALUES = 4, 10_000_000


def _windows(df: DataFrame, shingles: str, keep: list[str], step: int) -> DataFrame:
    """keep, at and w0..w3 (a window's shingles; short windows repeat their first); a row per window."""
    rest = ", ".join(f"coalesce(get({shingles}, i + {k}), get({shingles}, i)) AS w{k}" for k in range(1, SIZE))
    # No filter on the shingles: it would be pushed into the lambda that makes them.
    each = f"explode(if(size({shingles}) = 0, array(), transform(sequence(0, greatest(size({shingles}) - {SIZE - step + 1}, 0), {step}), i -> struct(i AS at, get({shingles}, i) AS w0, {rest}))))"
    return df.selectExpr(*keep, f"{each} AS _x").selectExpr(*keep, "_x.*")


def _band(j: int) -> str:
    """The MinHash of band j over a window."""
    return "least(" + ", ".join(f"xxhash64({j}, w{k})" for k in range(SIZE)) + ")"


def parts(templates, rules: LicenseScan) -> list[tuple[str, int, int, str]]:
    """License, form (number of the template), part and its text."""
    rows = []
    for form, (name, text) in enumerate(templates):
        words = text.split()
        if len(words) < 2:
            raise ValueError(f"template {name} has fewer than two words")
        starts = range(0, max(1, len(words) - rules.part // 2), rules.part // 2) if len(words) > rules.part else (0,)
        rows += [(name, form, n, " ".join(words[at : at + rules.part])) for n, at in enumerate(starts)]
    return rows


def _templates(spark: SparkSession, templates, rules: LicenseScan) -> DataFrame:
    """license, form, part, shingles, own (shingles that no other license has), total and owned (of all parts)."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    df = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quote(a)}, {f}, {n}, {quote(t)})" for a, f, n, t in parts(templates, rules)) + " AS t(license, form, part, text)")
    df = _shingles(df, "text", "shingles").withColumn("shingles", F.array_distinct("shingles"))
    each = df.select("license", "form", "part", F.explode("shingles").alias("s"))
    own = each.join(each.groupBy("s").agg(F.count_distinct("license").alias("n")).where("n = 1"), "s", "left_semi").groupBy("form", "part").agg(F.collect_set("s").alias("own"))
    df = df.join(own, ["form", "part"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<bigint>")))
    return staged(df.join(df.groupBy("form").agg(F.sum(F.size("shingles")).alias("total"), F.sum(F.size("own")).alias("owned")), "form"), "templates")


def matches(docs: DataFrame, templates=TEMPLATES, rules: LicenseScan = LicenseScan()) -> DataFrame:
    """doc_id, license, containment of every document and license that match."""
    known = _templates(docs.sparkSession, templates, rules)
    bands = F.explode(F.expr("array(" + ", ".join(map(_band, range(rules.bands))) + ")")).alias("value")
    table = staged(_windows(known, "shingles", ["form", "part"], 1).select("form", "part", bands).distinct(), "template-bands")
    if table.count() > MOST_VALUES:
        raise ValueError(f"the templates have more than {MOST_VALUES} band values: scan for them in several calls")
    windows = _windows(_shingles(docs.select("doc_id", "text"), "text", "shingles"), "shingles", ["doc_id", "shingles"], rules.step)
    near = F.expr(f"slice(shingles, greatest(at - {rules.part}, 0) + 1, {SIZE} + {rules.part} + least(at, {rules.part}))")
    found = windows.select("doc_id", "shingles", "at", bands).join(F.broadcast(table), "value").select("doc_id", "form", "part", near.alias("near"))
    pairs = found.join(F.broadcast(known.select("form", "part", "license", F.col("shingles").alias("_t"), "own", "total", "owned")), ["form", "part"])
    n = lambda c: F.size(F.array_intersect("near", c))
    best = pairs.groupBy("doc_id", "license", "form", "part").agg(F.max(n("_t")).alias("n"), F.max(n("own")).alias("m"), F.first("total").alias("total"), F.first("owned").alias("owned"))
    each = best.groupBy("doc_id", "license", "form").agg((F.sum("n") / F.first("total")).alias("containment"), (F.sum("m") / F.nullif(F.first("owned"), F.lit(0))).alias("own"))
    each = each.where((F.col("containment") >= rules.containment) & (F.coalesce("own", F.lit(1.0)) >= rules.containment))
    return each.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, rules: LicenseScan = LicenseScan()) -> DataFrame:
    """docs with n_licenses, licenses (ids, comma-joined) and containment (the highest)."""
    own = docs.drop("n_licenses", "licenses", "containment")
    (key,) = fresh(own, "_id")
    found = matches(docs, templates, rules).groupBy(F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias("n_licenses"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.max("containment").alias("containment"))
    out = own.join(staged(found, "licensed"), F.col("doc_id").eqNullSafe(F.col(key)), "left").drop(key)
    return out.withColumns({"n_licenses": F.coalesce("n_licenses", F.lit(0)).cast("long"), "licenses": F.coalesce("licenses", F.lit("")), "containment": F.coalesce("containment", F.lit(0.0))})


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = matches(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("n_licenses"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))
    out = docs.select("doc_id").join(staged(found, "licensed"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def _oracle() -> str:
    values = ", ".join(f"('{a}', {f}, {n}, '{t}')" for a, f, n, t in parts(TEMPLATES, LicenseScan()))
    return rf"""
WITH t AS (SELECT license, form, part, regexp_extract_all(lower(txt), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {values}) v(license, form, part, txt)),
ts AS (SELECT license, form, part, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM t),
one AS (SELECT x FROM (SELECT license, unnest(s) AS x FROM ts) GROUP BY x HAVING count(DISTINCT license) = 1),
tp AS (SELECT *, list_intersect(s, (SELECT list(x) FROM one)) AS own FROM ts),
tt AS (SELECT form, sum(len(s)) AS total, sum(len(own)) AS owned FROM tp GROUP BY form),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
ds AS (SELECT rid, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS s FROM d WHERE len(w) > 1),
x AS (SELECT rid, unnest(range(0, greatest(len(s) - 3, 0) + 1, 2)) AS i, s FROM ds),
k AS (SELECT DISTINCT rid, i, form, part FROM (SELECT rid, i, unnest(s[i + 1:i + 4]) AS sh FROM x) JOIN (SELECT form, part, unnest(s) AS sh FROM tp) USING (sh)),
p AS (SELECT rid, license, form, part, max(len(list_intersect(list_distinct(ds.s[greatest(i - 16, 0) + 1:i + 20]), tp.s))) AS n, max(len(list_intersect(list_distinct(ds.s[greatest(i - 16, 0) + 1:i + 20]), tp.own))) AS m FROM k JOIN ds USING (rid) JOIN tp USING (form, part) GROUP BY ALL),
f AS (SELECT rid, license, form, sum(n) AS n, sum(m) AS m FROM p GROUP BY ALL),
l AS (SELECT DISTINCT rid, license FROM f JOIN tt USING (form) WHERE n >= 0.8 * total AND m >= 0.8 * owned),
g AS (SELECT rid, count(*) AS n, string_agg(license, ',' ORDER BY license) AS l FROM l GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(l, '') AS licenses FROM d LEFT JOIN g USING (rid)
"""


ORACLE = _oracle()
