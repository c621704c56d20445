import random
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from noteforge.llm import decontaminate, packing, quality
from noteforge.llm.base import staged


def world(seed=6, n=120):
    """Documents of two languages with odd ones among them, and a benchmark item that some of them hold."""
    r = random.Random(seed)
    word = lambda lang: "".join(r.choice({"aa": "abcde", "bb": "fghij"}[lang]) for _ in range(r.randint(2, 8)))
    rows = [(i, " ".join(word(lang) for _ in range(60)), lang, "s") for i in range(n) for lang in [("aa", "bb")[i % 2]]]
    item = " ".join(word("aa") for _ in range(15))
    rows += [(200, rows[3][1], "bb", "s"), (201, rows[4][1] + " end", "aa", "s"), (202, "too short", "aa", "s"), (203, "12 34 " * 4 + " ".join(str(i * 7919) for i in range(40)), "aa", "s")]
    rows += [(204, rows[6][1][:200] + " " + item + " " + rows[8][1], "aa", "s"), (205, None, None, None), (206, item, "aa", "s"), (207, "ab " * 60, "aa", "s"), (208, " ".join(word("aa") + " ###" for _ in range(60)), "aa", "s")]
    rows += [(209, " ".join(word("bb") for _ in range(30_000)), "bb", "s"), (7, rows[7][1], "bb", "s"), (210, "", "aa", "t"), (211, rows[10][1] + "\n" + item.upper(), "aa", "t")]
    return rows, item


def test_stages_take_effect(make, spark, tmp_path):
    rows, item = world()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, columns = make(rows), make(rows).columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == columns, name
        seen.append({x.doc_id: x.text for x in docs.collect()})
    quality_, language, unique, clean = seen
    assert not {202, 205, 207, 208, 210} & set(quality_) and set(range(120)) <= set(quality_)
    assert 203 not in language and set(range(120)) <= set(language)
    assert not {200, 201} & set(unique) and set(range(120)) <= set(unique)
    assert item in unique[204] and item not in clean[204] and clean[3] == unique[3] and 206 not in clean
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    assert set(out.doc_id) == set(clean) and (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()


def brute_quality(rows):
    """Counts by words and windows, fences by sorted values: the same rules without sketches that merge."""
    counts = {}
    for k, (_, t, lang, source) in enumerate(rows):
        w, t = (t or "").split(), t or ""
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
        again = len({p for i, g in enumerate(grams) if g in often for p in range(i, i + 5)})
        lines = [x for x in t.split("\n") if x.split()]
        chars = sum(map(len, w))
        m = (1000 * sum(t.count(c) for c in "#*$%&|<>") // max(1, chars), 1000 * (len(lines) - len(set(lines))) // max(1, len(lines)), 1000 * again // max(1, len(w)), 100 * chars // max(1, len(w)))
        counts[k] = (lang, source, len(w) < 10 or 100 * again > 20 * len(w), m)
    top = lambda v: v if v < 128 else (((v >> (s := v.bit_length() - 7)) + 1) << s) - 1

    def of(keep, k, parent):
        """n, q2, q3, mean excess drawn towards the parent's."""
        t = sorted(top(c[3][k]) for c in counts.values() if not c[2] and keep(c))
        n = len(t)
        at = lambda a, b: next(x for i, x in enumerate(t) if b * sum(y <= x for y in t) >= a * n)
        q2, q3 = at(1, 2), at(3, 4)
        e = 1000 * sum(max(0, x - q2) for x in t)
        return n, q2, q3, e // n if parent is None else (e + 30 * parent) // (n + 30)

    kept = []
    for k, (lang, source, failed, m) in counts.items():
        over = False
        for j in range(4) if not failed else ():
            every = of(lambda c: True, j, None)
            own_lang = of(lambda c: c[0] == lang, j, every[3])
            own = of(lambda c: c[:2] == (lang, source), j, own_lang[3])
            _, q2, q3, mean = next((x for x in (own, own_lang) if x[0] >= 30), every)
            over |= m[j] > max(q3 + 12 * (q3 - q2), q2 + 12 * mean // 1000)
        if not failed and not over:
            kept.append(rows[k])
    return kept


def brute_unique(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for _, t, *_ in rows for w in [t.lower().split()]]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return [min(rows[i] for i in range(len(rows)) if group[i] == g) for g in dict.fromkeys(group)]


def brute_clean(rows, item):
    window = decontaminate.words(item)
    grams = {tuple(window[i : i + 10]) for i in range(len(window) - 9)}
    out = []
    for d, t, *rest in rows:
        first = len(decontaminate.words(t))
        while t is not None:
            w = decontaminate.words(t)
            hit = {p for i in range(len(w) - 9) if tuple(w[i : i + 10]) in grams for p in range(i, i + 10)}
            if not hit:
                break
            if len(w) - len(hit) < 0.5 * first:
                t = None
                break
            t = " ".join(x.decode() for i, x in enumerate(w) if i not in hit)  # texts here are words and blanks
        if t is not None:
            out.append((d, t))
    return out


def test_run_against_brute_force(make, spark, tmp_path):
    rows, item = world(9)
    docs = make(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    good = [r for r in brute_quality(rows) if any(map(str.isalpha, r[1]))]
    want = {d: t for d, t in brute_clean(brute_unique(good), item)}
    encode = packing.Encoder(packing.default_tokenizer()).whole
    pieces = set()
    for d, t in want.items():
        if d not in (204, 211):  # their blanks differ where a span was cut
            ids = encode(t) + bytes(4)
            pieces |= {(d, at // 4, len(p) // 4, zlib.crc32(p), len(ids) // 4) for at in range(0, len(ids), 4096) for p in [ids[at : at + 4096]]}
    got = {tuple(map(int, r)) for r in out[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False)}
    assert set(out.doc_id) == set(want) and {g for g in got if g[0] not in (204, 211)} == pieces and len(got) == len(out)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024


def test_run_on_an_empty_table(make, spark, tmp_path):
    make([(1, "x")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_fences_are_those_of_sorted_values(make):
    rows, _ = world(11)
    got = quality.quality_rules(make(rows)).where(F.col("kept")).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in brute_quality(rows))
