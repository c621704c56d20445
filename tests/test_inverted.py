"""The kept index: the same hits as a full scan after any runs, few blocks read, statistics equal to a rebuild's."""

import random

from pyspark.sql import functions as F

from noteforge.operators import inverted as iv
from noteforge.operators import retrieval as rt


def corpus(r, n):
    words = [f"w{i}" for i in range(300)]
    pick = lambda: words[min(299, int(r.expovariate(0.03)))]
    return {f"c{i}": " ".join(pick() for _ in range(r.randrange(60))) for i in range(n)}


def rows(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "chunk_id string, content string")


def test_runs_give_what_a_rebuild_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(iv, "BLOCK", 16)
    monkeypatch.setattr(iv, "FIRST", 2)
    r = random.Random(5)
    texts = corpus(r, 240) | {"blank": "", "odd": None, "alone": "zebra zebra w0"}
    q = spark.createDataFrame([(1, "w0 w1"), (2, "w5 w9 w0"), (3, "zebra"), (4, "nothing here"), (5, " "), (6, "w0 w0 w3 unknown"), (7, "w250")], "query_id long, query string")
    folder = (tmp_path / "kept").as_uri()
    assert iv.load(spark, folder) is None
    iv.sync(spark, folder, frame(spark, texts))
    for step in range(1):
        for key in r.sample(sorted(texts), 60):
            if r.random() < 0.4:
                del texts[key]
            else:
                texts[key] = " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(30)))
        texts |= {f"new{step}-{i}": t for i, t in enumerate(corpus(r, 30).values())}
        kept = iv.sync(spark, folder, frame(spark, texts))
    plain = frame(spark, texts)
    fresh = iv.sync(spark, (tmp_path / "fresh").as_uri(), plain)
    assert rows(kept.frequencies) == rows(fresh.frequencies) and (kept.chunks, kept.tokens) == (fresh.chunks, fresh.tokens) == (len(texts), rt.Index.of(plain).tokens)
    norms = lambda x: {(c, round(v, 9)) for c, v in x.members.join(x.dead, "num", "left_anti").join(x.norms, "num").select("chunk_id", "norm").collect()}
    assert norms(kept) == norms(fresh)
    for k in (3, None):
        assert rows(kept.tfidf(q, k)) == rows(rt.tfidf(q, plain, k))
    assert rows(rt.bm25(q, plain, 3, index=kept)) == rows(rt.bm25(q, plain, 3))
    (tmp_path / "kept" / "run-9-broken" / "members").mkdir(parents=True)  # a run that broke off before it was listed
    assert rows(iv.load(spark, folder).frequencies) == rows(fresh.frequencies)
    emptied = iv.sync(spark, folder, plain.limit(0))
    assert emptied.chunks == emptied.tokens == 0 and emptied.bm25(q).count() == emptied.tfidf(q).count() == emptied.frequencies.count() == 0


def test_blocks_that_cannot_reach_the_best_hits_are_not_scored(spark, tmp_path):
    """A term whose good chunks lie together: most of its blocks are left out, and the hits are the same."""
    r = random.Random(6)
    rare = {f"c{i:05}": " ".join(["fox"] * (20 if 4000 <= i < 4100 else 1) + [f"x{r.randrange(50)}" for _ in range(10 if 4000 <= i < 4100 else 80)]) for i in range(9000)}
    df = frame(spark, rare).coalesce(1).sortWithinPartitions("chunk_id")
    kept = iv.sync(spark, (tmp_path / "kept").as_uri(), df)
    q = spark.createDataFrame([(1, "fox"), (2, "fox x7")], "query_id long, query string")
    assert rows(kept.bm25(q, 20)) == rows(rt.bm25(q, df, 20)) and rows(kept.tfidf(q, 20)) == rows(rt.tfidf(q, df, 20))
    for kind in ("bm25", "tfidf"):
        blocks, read = kept.read_share(q, kind, 20).where("query_id = 1").select("blocks", "read").first()
        assert blocks >= 35 and read <= 0.3 * blocks, (kind, blocks, read)


def test_norms_are_summed_where_texts_lie(spark, tmp_path, monkeypatch):
    """Frequent terms come to the texts and only rare ones' postings are moved by their term, however many terms there are."""
    monkeypatch.setattr(iv, "BLOCK", 16)
    texts = corpus(random.Random(8), 120)
    split, sizes = iv.frequent, []
    plain = iv.sync(spark, (tmp_path / "all").as_uri(), frame(spark, texts))
    want = {(c, round(v, 9)) for c, v in plain.members.join(plain.norms, "num").select("chunk_id", "norm").collect()}

    def few(df):
        known, rare = split(df, 40)
        sizes.append((known.count(), rare.count()))
        return known, rare

    monkeypatch.setattr(iv, "frequent", few)
    folder = (tmp_path / "few").as_uri()
    iv.sync(spark, folder, frame(spark, dict(list(texts.items())[:70]) | {"c3": "w1 gone"}))
    kept = iv.sync(spark, folder, frame(spark, texts))
    assert all(0 < a <= 40 < b for a, b in sizes) and len(sizes) == 2
    assert {(c, round(v, 9)) for c, v in kept.members.join(kept.dead, "num", "left_anti").join(kept.norms, "num").select("chunk_id", "norm").collect()} == want


def test_an_index_without_texts_is_rebuilt(spark, tmp_path):
    folder, texts = (tmp_path / "kept").as_uri(), corpus(random.Random(8), 30)
    iv.sync(spark, folder, frame(spark, texts))
    listed = iv.store.load(spark, folder)["runs"].drop("texts").collect()
    iv.store.save(spark, folder, {"runs": spark.createDataFrame(listed, "number long, run string, chunks long, tokens long")})
    kept = iv.sync(spark, folder, frame(spark, texts | {"new": "w1 w2"}))
    assert kept.chunks == 31 and iv.store.load(spark, folder)["runs"].count() == 1
