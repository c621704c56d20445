import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteforge.llm import decontaminate, html, langid, licenses, packing, quality, sharding, toxicity, urls

CASES = [(1, None), (2, ""), (3, "word"), (3, "word"), (4, "Same text, said twice. " * 400), (None, "no id here at all"), (5, "\n\n \t"), (6, "é ñ ü 123 #$% " * 30)]


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_quality_counts_against_brute_force(make):
    r = random.Random(3)
    rows = [(1000 + i, "\n".join(" ".join(r.choice("ab cd ef gh # ij| kl".split()) for _ in range(r.randrange(9))) for _ in range(r.randrange(12)))) for i in range(120)] + CASES
    got = by_id(quality.quality_rules(make(rows)))
    for d, t in rows:
        w = (t or "").split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t")]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        x = got[d][0]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (x.base_failed and x.kept)
    assert quality.quality_rules(make(CASES).limit(0)).count() == 0


def test_quality_thresholds_follow_the_group(make):
    r = random.Random(5)
    plain = [(i, " ".join(f"w{r.randrange(999)}" for _ in range(60)), "en", "a") for i in range(60)]
    table = [(100 + i, " ".join(f"w{r.randrange(999)} |" for _ in range(60)), "en", "b") for i in range(60)]
    odd = [(500, table[0][1], "en", "a")]
    got = by_id(quality.quality_rules(make(plain + table + odd, extra=False)))
    assert got[5][0].kept and got[105][0].kept and not got[500][0].kept


def test_quality_fences_of_every_measure_differ_by_group(make):
    """Two sources with other levels of each measure: what is usual in one is out in the other, and no fence is the same."""
    r = random.Random(6)
    word = lambda n=5: "".join(r.choice("abcdefghij") for _ in range(n))
    line = lambda n=5: " ".join(word(n) for _ in range(12))

    def text(symbols, lines, repeats, length):
        some = [line(length) for _ in range(20)]
        again = [some[0][:20]] * lines
        return "\n".join([*some, *again, " ".join(["#"] * symbols), " ".join(some[1].split()[:repeats])])

    few = [(i, text(i % 2, i % 2, 5 * (i % 2), 5), "en", "a") for i in range(80)]
    many = [(100 + i, text(5 + i % 9, 2 + i % 3, 10 + i % 2, 9), "en", "b") for i in range(80)]
    odd = [(500 + k, many[k][1], "en", "a") for k in range(2)]
    rows = quality.quality_rules(make(few + many + odd, extra=False)).collect()
    for m in quality.MEASURES:
        fences = {x.source: x[f"{m}_max"] for x in rows}
        assert 0 < fences["a"] < fences["b"], m
    kept = {x.doc_id: x.kept for x in rows}
    assert np.mean([kept[i] for i in [*range(80), *range(100, 180)]]) > 0.9 and not kept[500] and not kept[501]


def test_quality_long_texts_ties_and_clashing_columns(make, spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["a", "bb", "ccc", "d d"]) for _ in range(r.randrange(80)))) for i in range(60)] + CASES
    both = [{(x.doc_id, x.text): x.n_repeat_words for x in quality.measure(make(rows), n).collect()} for n in (1 << 20, 3)]
    assert both[0] == both[1] and max(both[0].values()) > 20
    names = ["_g", "_s", "_sp", "_again", "_lang", "_source", "_t", "_salt"]
    clash = make(rows).withColumns({**{n: F.lit("mine") for n in names}, "kept": F.lit("old"), "n_words": F.lit("old"), "symbol_pm_max": F.lit("old")})
    got = quality.quality_rules(clash)
    assert all(x[n] == "mine" for x in got.collect() for n in names) and dict(got.dtypes)["kept"] == "boolean" and dict(got.dtypes)["n_words"] == "bigint"
    ties = quality.quality_rules(make([(i, "ten words here are just enough to pass the rules", "en", "s") for i in range(50)])).collect()
    assert len(ties) == 50 and all(x.kept for x in ties)


def test_shards(make, spark):
    rows = [(10_000 + i, "t" * (i % 50), "en de".split()[i % 2], f"s{i % 7}") for i in range(500)] + [(600 + i, "hot text", "en", "s1") for i in range(300)] + CASES
    out = sharding.shards(make(rows)).toPandas()
    assert len(out) == len(rows)
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    size = out.groupby("shard")["size"].sum()
    assert size.max() - size.min() <= out["size"].max() + 0.05 * size.sum()
    assert sharding.shards(make(rows).limit(0)).count() == 0
    grid = sharding.hilbert_index(spark.range(64).selectExpr("id div 8 AS a", "id % 8 AS b"), ["a", "b"], 3, "i").orderBy("i").collect()
    assert [r.i for r in grid] == list(range(64)) and all(abs(x.a - y.a) + abs(x.b - y.b) == 1 for x, y in zip(grid, grid[1:]))


def test_cells_cover_the_whole_range_by_one_rule(spark):
    for n in (4, 20, 3000):
        weights = [1 + i % 3 for i in range(n)]
        rows = [(None if i == 0 else f"s{i:05d}", w, 10) for i, w in enumerate(weights)]
        df = spark.createDataFrame(rows, "source string, copies long, size long")
        out = [r.c_source for r in sharding._cells(df, "source").orderBy(F.col("source").asc_nulls_first()).collect()]
        assert out == [(2 * sum(weights[:i]) + w) * 32 // (2 * sum(weights)) for i, w in enumerate(weights)]
        assert n < 3000 or set(out) == set(range(32))


def test_shards_are_boxes_and_cut_groups_only_where_the_law_needs_it(make):
    r = random.Random(12)
    rows = [(i, f"text {i} " + "x" * r.choice([10, 100, 1000]), r.choice(["de", "en", "es", "fr"]), f"s{r.randrange(16):02d}") for i in range(4000)]
    out = sharding.shards(make(rows)).toPandas()
    held = out.groupby("shard").agg({"lang": "nunique", "source": "nunique"})
    assert held.lang.mean() <= 3 and held.source.mean() <= 11  # 4 and 16 by chance
    size = sum(out["size"])
    for share, whole in ((0.045, True), (0.055, False)):  # of a shard, around the tolerance of 0.05
        n = int(share * size / 8 / 1000)
        group = [(10_000 + i, "y" * 999, "en", "s1") for i in range(n)]
        more = sharding.shards(make(rows + group)).toPandas()
        mine = more[more.doc_id >= 10_000]
        assert sorted(more.doc_id) == sorted([d for d, *_ in rows] + [d for d, *_ in group])
        assert mine.shard.nunique() == 1 or not whole
        each = more.groupby("shard")["size"].sum()
        assert (abs(each - size / 8) < 0.06 * size / 8 + 2000).all()
    hot = sharding.shards(make(rows + [(20_000 + i, "z" * 999, None, None) for i in range(3000)])).toPandas()
    assert hot[hot.doc_id >= 20_000].shard.nunique() > 2 and hot.groupby("shard")["size"].sum().std() < 3000
    clash = make(rows[:50]).withColumns({c: F.lit("mine") for c in ("x0", "t", "h", "curve", "_v", "row", "part")})
    assert sharding.shards(clash).count() == 50


def test_automaton_against_brute_force():
    for seed in range(200):
        r = random.Random(seed)
        k, al = r.choice([2, 3, 4]), [b"a", b"b", b"c"][: r.choice([2, 3])]
        items = [(str(i), [r.choice(al) for _ in range(r.randint(0, 7))]) for i in range(r.randint(0, 5))]
        t = [r.choice([*al, b"z"]) for _ in range(r.randint(0, 25))]
        spans, found = decontaminate.Automaton(items, k).match(t)
        hit, want = set(), set()
        for n, (_, w) in enumerate(x for x in items if x[1]):
            m = min(k, len(w))
            for a in range(len(w) - m + 1):
                for b in range(len(t) - m + 1):
                    if t[b : b + m] == w[a : a + m]:
                        hit |= set(range(b, b + m))
                        want.add(n)
        assert {p for x, y in spans for p in range(x, y)} == hit and found == want


def test_decontamination_cases(make, spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(7, item), (8, item), (9, None), (10, ""), (None, "short item"), (11, "Zwei Wörter")], "item_id long, text string")
    rows = [*CASES, (20, "Begin. ONE two, three four-five six seven eight nine ten and " + "more words " * 20), (21, "a zwei wörter b"), (22, item)]
    got = by_id(decontaminate.contamination(make(rows), bench))
    x = got[20][0]
    assert (x.n_hit, x.n_items, x.contaminated) == (10, 2, True) and x.items_sha256 == hashlib.sha256(b"7,8").hexdigest()
    assert got[21][0].n_hit == 2 and got[1][0].n_words == 0 and got[1][0].items_sha256 == hashlib.sha256(b"").hexdigest()
    clean = decontaminate.clean(make(rows), bench)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert 22 not in texts and texts[20].startswith("Begin.  and more") and texts[1] is None and texts[4] == CASES[4][1] and clean.columns == make(rows).columns
    assert decontaminate.contamination(make(rows), bench.limit(0)).where("contaminated").count() == 0


def test_cleaning_is_the_same_by_any_number_of_automata(make, spark):
    item = lambda k, n=10: [f"i{k}x{j}" for j in range(n)]
    filler = [f"f{j}" for j in range(40)]
    bench = spark.createDataFrame([(k, " ".join(item(k))) for k in range(6)], "item_id long, text string").coalesce(1)
    half = [*filler, *(w for k in range(6) for w in item(k))]  # 30 of 100 words by the first three items, 30 by the others
    joined = [*filler, *item(0)[:5], *item(5), *item(0)[5:], "end"]
    rows = [(1, " ".join(half)), (2, " ".join(joined)), (3, " ".join(filler)), (4, None), (5, " ".join([*filler, *item(4), "z"])), (5, " ".join(item(3)))]
    got = [sorted((r.doc_id, r.text or "", r.n_chars or 0) for r in decontaminate.clean(make(rows), bench, decontaminate.Decontamination(max_tokens=n)).collect()) for n in (200_000, 30, 10)]
    assert [(d, t.split()) for d, t, _ in got[0]] == [(2, [*filler, "end"]), (3, filler), (4, []), (5, [*filler, "z"])]
    assert got[0] == got[1] == got[2]
    assert decontaminate.clean(make(rows), bench, decontaminate.Decontamination(max_tokens=30)).columns == make(rows).columns


def test_packing_round_trip(make):
    r = random.Random(9)
    rows = [(1000 + i, " ".join(f"w{r.randrange(10**r.randrange(1, 7))}'s" for _ in range(r.randrange(900)))) for i in range(60)] + CASES + [(70, "x <|endoftext|> y"), (71, "日本語 ½ ² ١٢ \u00a0\x1c z  ")]
    rules = packing.Packing(packing.default_tokenizer())
    out = packing.pack(make(rows), rules).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(rules.tokenizer)
    want = sorted((d if d is not None else -1, at, len(p := ids[at : at + 1024]), zlib.crc32(p.tobytes()), len(ids)) for d, x in rows for ids in [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")] for at in range(0, len(ids), 1024))
    got = sorted((int(d) if d == d else -1, *map(int, rest)) for d, *rest in out[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False))
    assert got == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    assert packing.pack(make(rows).limit(0), rules).count() == 0


def test_plan_covers_the_histogram():
    r = random.Random(1)
    for n in (0, 1, 5, 400, 5000):
        h = {}
        for _ in range(n):
            s = r.randint(1, 128)
            h[s] = h.get(s, 0) + 1
        out = packing.plan(h, 128)
        held = {}
        for items, k in out:
            assert sum(items) <= 128
            for s in items:
                held[s] = held.get(s, 0) + k
        assert held == h
        if n == 5000:
            assert sum(k for _, k in out) <= 1.02 * sum(s * k for s, k in h.items()) / 128


def test_urls(spark):
    rows = [(1, None), (2, "no scheme/net/"), (3, "HTTP://A.Example.NET/en/x?q#f"), (4, "http://example.net/de/"), (5, "http://notexample.net/en/"), (6, "http://x.net"), (7, "http://example.com/de/1"), (8, "http://org/fr/"), (9, "x://my.org/fr/a"), (10, "http://evilnet/")]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [out[i].rule for i in range(1, 11)] == [None, None, "example.net/en/", "net/", "net/", None, "example.com/de/", "org/fr/", "org/fr/", None]
    assert out[1].host == "" and out[3].host == "a.example.net" and out[3].path == "/en/x" and out[4].verdict == "block" and out[3].verdict == "allow"


def brute_urls(rows, rules):
    out = []
    for i, u in rows:
        host, path = urls.parts(u)
        fits = [(len(r), v == "block", r, v) for r, v in rules for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, False, None, "allow"))
        out.append((i, host, path, best[2], best[3]))
    return out


def test_urls_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    name = lambda: ".".join(r.choice(["a", "bb", "net", "org"]) for _ in range(r.randint(1, 4)))
    rules = list({(name() + r.choice(["/", "/x", "/x/y", "/y"]), r.choice(["allow", "block"])) for _ in range(40)}) + [("net/", "allow"), ("net/", "block")]
    rows = [(i, f"{r.choice(['http', ''])}://{name().upper() if i % 3 == 0 else name()}{r.choice(['', '/', '/x', '/x/y?q', '/y#f', '/X'])}") for i in range(300)]
    rows += [(1000, None), (1000, None), (None, "://net/"), (2**53 + 1, "http://" + "a." * 100_000 + "net/x/y"), (1001, "http://" + "a" * 1_000_000 + ".net/x"), (1002, "http://net/" + "x" * 1_000_000), (1003, ""), (1004, "://"), (1005, "net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("mine") for c in ("rule", "host", "verdict", "_rule")})
    want = sorted(brute_urls(rows, rules), key=str)
    began = time.time()
    for most in (64_000_000, 300):
        monkeypatch.setattr(urls, "MOST_BYTES", most)
        assert sorted(map(tuple, urls.judge(pages, rules).collect()), key=str) == want
    assert time.time() - began < 60
    assert urls.judge(pages.limit(0), rules).count() == 0 and urls.judge(pages, []).where("verdict <> 'allow'").count() == 0
    with pytest.raises(ValueError):
        urls.judge(pages, [("nopath", "block")])


def test_html():
    page = '<html><head><title>T</title></head><body><div id="top-menu"><a href=1>Home</a></div><div class="content"><h2>Title &mdash; x</h2><p>One long text, with commas, and <b>so</b>\n on. It is text.<ul><li>First item.<li>Second item.</ul><div class="ad">Buy!</div><pre>a\nb</pre><section class="comments"><p>I liked it, really. So much.</p></section></div><aside><p>Side text, long, with, commas. Yes.</p></aside></body></html>'
    assert html.main_text(page) == "Title — x\n\nOne long text, with commas, and so on. It is text.\n\nFirst item.\n\nSecond item.\n\na b"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == "" and html.main_text("a < b") == "a < b"


def test_html_keeps_what_stands_outside_the_dominant_child():
    body = "".join(f"<p>Paragraph {i} of the body, with commas, and an end. It goes on, and on, for a while.</p>" for i in range(9))
    want = ["T", "A lead, of a few words.", *(f"Paragraph {i} of the body, with commas, and an end. It goes on, and on, for a while." for i in range(9))]
    for outer in ("article", "main", "div"):
        page = f'<body><nav><a href="/">Home</a></nav><{outer}><h1>T</h1><p>A lead, of a few words.</p><div class=body>{body}</div></{outer}><footer>Imprint, and more.</footer></body>'
        assert html.main_text(page).split("\n\n") == want
    parts = f"<section><h2>One</h2><p>Short, but a part of it.</p></section><blockquote>{body}</blockquote><section><h2>Two</h2><p>An end, in few words.</p></section>"
    assert html.main_text(f"<body><article>{parts}</article></body>").split("\n\n") == ["One", "Short, but a part of it.", *want[2:], "Two", "An end, in few words."]


def test_html_keeps_short_cells_items_and_captions():
    long = "A sentence, of words, is here. " * 10
    cells = [(f"Name {i}", f"{i}.5", f"{i} m") for i in range(4)]
    table = "<table><caption>Sizes</caption>" + "".join(f"<tr><th>{a}</th><td>{b}</td><td>{c}</td></tr>" for a, b, c in cells) + "</table>"
    lists = "<dl><dt>a<dd>b</dl><ul><li>x<ul><li>y</ul></ul><pre>k</pre>"
    links = '<div class=more><a href="/1">One</a> <a href="/2">Two</a></div>'
    want = [long.strip(), "Sizes", *(x for row in cells for x in row), "a", "b", "x", "y", "k", long.strip()]
    for page in (f"<article><p>{long}</p>{table}{lists}<p>{long}</p></article>{links}", f"<div>{links}</div><div><div class=x><p>{long}</p></div>{table}{lists}<p>{long}</p></div>"):
        assert html.main_text(f"<body>{page}</body>").split("\n\n") == want


def test_html_names_and_raw_elements_take_no_more_than_their_own():
    text = "One long text, with commas, and so on. It is text."
    for begin, end in (('<body class="has-sidebar">', "</body>"), ('<main class="page no-sidebar">', "</main>"), ('<article class="post share-enabled">', "</article>"), ('<article class="sidebar">', "</article>"), ('<div data-id="menu">', "</div>")):
        assert html.main_text(f'{begin}<h2 class="section-header">H</h2><p>{text}</p><div class="cookie-banner"><p>{text}</p></div>{end}') == f"H\n\n{text}"
    for raw in ('<svg viewBox="0"/>', "<svg><svg><text>a</text></svg><title>t</title></svg>", "<button>", "<button>a</button>", "<button><button>b</button>", "<select>", "<object>", "<noscript><p>n</p></noscript>"):
        assert html.main_text(f"<article><p>{text}</p>{raw}<p>{text}</p></article>") == f"{text}\n\n{text}"
    assert html.main_text(f"<article><p>{text}</p><button-group>Own text.</button-group><p>{text}</p></article>").split("\n\n") == [text, "Own text.", text]
    assert html.main_text("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be so.") == "Let x=1 be so."


def test_html_of_the_fixture_by_plain_cuts(spark):
    """The fixture's articles hold headings, paragraphs and line ends only: cutting at these tags gives their text too."""
    import html as entities
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    rows = pages.collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|ul|li|div)[^>]*>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))
    assert len(rows) > 200


def test_each_license_by_its_own_words(make):
    rows = [(1, "under the terms of the gnu general public license version 3"), (2, "Under the terms of the GNU Affero General Public License, version 3."), (3, "under the terms of the GNU Lesser General Public License"), (4, "This work is licensed under the GNU General Public License, version 3")]
    rows += [(10 + i, f"word{i} " * 9 + text + " and on " * 50) for i, (_, text) in enumerate(licenses.TEMPLATES)]
    rows += [(50, licenses.TEMPLATES[-3][1][:60]), (51, "z " * 40_000 + licenses.TEMPLATES[-3][1] + " z" * 40_000)]
    docs = make(rows).withColumns({c: F.lit("mine") for c in ("_id", "_w", "shingles", "at", "near", "license", "n_licenses")})
    got = {r.doc_id: (r.licenses, r.n_licenses, r._id) for r in licenses.scan(docs).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["gpl-3.0", "agpl-3.0", "lgpl", "gpl-3.0"]
    assert [got[10 + i][0] for i in range(len(licenses.TEMPLATES))] == [name for name, _ in licenses.TEMPLATES]
    assert licenses.TEMPLATES[-3][0] == "mit-text" and got[50][0] == "" and got[51] == ("mit-text", 1, "mine")


def test_many_templates(make):
    r = random.Random(2)
    texts = [(f"l{i}", " ".join(f"t{r.randrange(3000)}" for _ in range(40))) for i in range(300)]
    docs = make([(i, "some words before " + t + " some words behind") for i, (_, t) in enumerate(texts)] + [(900, "nothing of the kind " * 30)])
    got = {x.doc_id: x.licenses for x in licenses.scan(docs, texts).collect()}
    assert got == {**{i: name for i, (name, _) in enumerate(texts)}, 900: ""}


def test_html_marks_hold_for_the_element_they_name():
    long = ("A sentence, of words, is here. " * 4).strip()
    own = '<header class="entry-header"><h1>Title</h1><span>by me</span><nav>n</nav></header>'
    for page, want in (
        (f"<form><nav>x</nav><article><h1>Title</h1><p>{long}</p></article></form>", f"Title\n\n{long}"),
        (f'<form action="/"><div><h1>Title</h1><p>{long}</p></div><div class="footer">F</div></form>', f"Title\n\n{long}"),
        (f'<article class="no-comments">{own}<p>{long}</p><section class="post-comments"><p>{long} {long} {long}</p></section></article>', f"Title\n\n{long}"),
        (f'<div class="layout-with-header"><h1>Title</h1><p>{long}</p></div><div class="related-posts"><p>{long}</p></div>', f"Title\n\n{long}"),
        (f'<div class="content"><h1>Title</h1><p>{long}</p></div><ul class="comment-list"><li>{long} {long} {long}</li></ul>', f"Title\n\n{long}"),
        (f'<article><h1>Title</h1><p data-a="un closed>{long}</p></article>', f"Title\n\n{long}"),
    ):
        assert html.main_text(f"<body>{page}</body>") == want


def test_html_time_grows_with_the_page():
    n, text = 50_000, "A sentence, of words, is here."
    began = time.time()
    for page in ("<div>" * n + text, "<div>" * n + text + "</div>" * n, "<p class=x>" * n + text, "<div>" * n + "</span-x>" * n + '<a b="' * n, "<svg>" * n + text, "<b" * n):
        html.main_text(page)
    assert time.time() - began < 60  # well below the minutes that a quadratic form takes


def test_extract_over_a_table(spark):
    text = "One long text, with commas, and so on. It is text."
    rows = [(1, "u1", f"<article><p>{text}</p></article>"), (1, "u1", f"<article><p>{text}</p></article>"), (2, None, None), (None, "u3", ""), (2**53 + 1, "u4", f"<p>{text}</p>" + "<p>&eacute; 日本, so it is. And on.</p>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("mine"), "n_chars": F.lit("mine")})
    got = html.extract(pages).orderBy(F.col("page_id").asc_nulls_first(), "url").collect()
    assert [(r.page_id, r.url, r.text) for r in got[:1] + got[2:4]] == [(None, "u3", ""), (1, "u1", text), (2, None, "")]
    assert got[4].page_id == 2**53 + 1 and got[4].n_chars == len(got[4].text) == len(text) + 3000 * 25 and got[1] == got[2]
    assert html.extract(pages.limit(0)).count() == 0


def test_licenses(make):
    rows = [*CASES, (30, "Intro words here. Released under the MIT License. More."), (31, "x " * 500 + "licensed under the apache license version 2.0 " + "y " * 77), (32, "All rights reserved."), (33, "the license of the state")]
    got = by_id(licenses.scan(make(rows)))
    assert [got[i][0].licenses for i in (30, 31, 32, 33)] == ["mit", "apache-2.0", "all-rights-reserved", ""]
    assert got[1][0].n_licenses == 0 and len(got[3]) == 2 and licenses.scan(make(rows).limit(0)).count() == 0


def languages(n):
    r = random.Random(2)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    return [(i, " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(2, 7))) for _ in range(r.randint(3, 30))), lang, "s") for i in range(n) for lang in [r.choice(list(letters))]]


def test_language_id_held_out(make):
    rows = languages(400)
    out = by_id(langid.identify(make(rows + [(d, t, None, "s") for d, t in CASES if d != 3])))
    held = [(d, lang) for d, _, lang, _ in rows if out[d][0].held_out]
    assert len(held) > 30 and np.mean([out[d][0].lang_pred == lang for d, lang in held if d > 6]) >= 0.97
    assert all(x.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, xs in out.items() if d is not None for x in xs)
    assert all(0 <= x.score <= 1 for xs in out.values() for x in xs)
    alone = by_id(langid.identify(make([(1, None, None, "s"), (2, "12 34", None, "s"), (3, "text", None, "s")])))
    assert alone[1][0].lang_pred == alone[3][0].lang_pred == "und"


def test_language_id_held_out_on_the_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = langid.identify(docs).where("held_out AND lang IS NOT NULL").select("lang", "lang_pred", "score").collect()
    known = [r for r in rows if r.lang_pred != "und"]
    assert len(known) > 150 and np.mean([r.lang == r.lang_pred for r in known]) >= 0.99 and np.mean([r.score for r in known]) > 0.9


def test_grams_are_those_of_plain_slices():
    rules = langid.LanguageId(bits=12)
    hash_of = {}
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("aàB ñ日😀z.") for _ in range(r.randrange(12)))
        low = text.lower()
        at, n = langid.grams(text, rules)
        slices = [low[i : i + k] for k in (1, 2, 3) for i in range(len(low) - k + 1)]
        for s in set(slices):  # a slice has one bucket, wherever it stands
            hash_of.setdefault(s, langid.grams(s, langid.LanguageId(bits=12, longest=len(s)))[0])
        assert n.sum() == len(slices) and len(set(at.tolist())) == len(at)
        assert all(set(hash_of[s].tolist()) <= set(at.tolist()) for s in slices)


def test_rare_languages_and_odd_columns(make):
    rows = languages(200) + [(500 + i, "one two", f"rare{i}", "s") for i in range(5)]
    docs = make(rows).withColumns({"lang_pred": F.lit("old"), "score": F.lit("old"), "held_out": F.lit("old"), "_language": F.lit("mine")})
    got = langid.identify(docs.select("doc_id", "text", "lang", "lang_pred", "score", "held_out", "_language"), langid.LanguageId(texts=40, weights=1 << 12)).collect()
    assert {r.lang_pred for r in got if r.doc_id < 500} <= {"aa", "bb", "cc"} and len(got) == 205 and {r._language for r in got} == {"mine"} and {type(r.score) for r in got} == {float}
    assert langid.identify(make(rows).limit(0)).count() == 0
    long = langid.identify(make([*languages(200), (900, "abcde " * 50_000, None, "s"), (900, "abcde " * 50_000, None, "s")]))
    assert [r.lang_pred for r in long.where("doc_id = 900").collect()] == ["aa", "aa"]


def test_language_sample_takes_a_text_once(make):
    rows = [(d, t, "aa", "s") for d, t, _, _ in languages(400)]
    df = make(rows)
    least = df.orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 30))).first().text
    rules = langid.LanguageId(per_language=50)
    got = langid._sample(df.union(make([(1000 + i, least, "aa", "s") for i in range(2000)])), {"aa": 400}, 1.0, rules)
    assert len(got) == 50 and len({at.tobytes() for _, (at, _) in got}) == 50


def test_toxicity_held_out(make, spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(300)}"
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        t = [word() for _ in range(r.randint(5, 60))]
        for _ in range(r.randint(1, 5) * bad):
            t.insert(r.randrange(len(t)), r.choice(["vile", "foul", "nasty"]))
        rows.append((i, " ".join(t)))
        labels += [(i, int(bad))] if i < 400 else []
    model = toxicity.train(make(rows), spark.createDataFrame([*labels, (9999, 1), (5, None)], "doc_id long, toxic int"))
    out = by_id(toxicity.severity(make(rows + [(d, t) for d, t in CASES if d is None]), model))
    assert np.mean([out[i][0].toxic == (i % 4 == 0) for i in range(400, 600)]) >= 0.9
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    none = toxicity.train(make(rows), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.severity(make(CASES), none).where("toxic").count() == 0


def test_toxicity_on_held_out_labels(spark):
    """Learnt from the labels of even checksums, judged on the others; a word list of the fixture tells which of them show it."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = toxicity.train(docs, labels.where(even))
    rows = toxicity.severity(docs.join(labels.where(~even).withColumnRenamed("toxic", "truth"), "doc_id"), model).select("truth", "toxic", "grade").collect()
    bad, clean = [r for r in rows if r.truth], [r for r in rows if not r.truth]
    assert np.mean([r.toxic for r in bad]) > 0.8 and np.mean([r.grade > 0 for r in bad]) > 0.8
    assert np.mean([r.toxic for r in clean]) < 0.005 and len(bad) > 200


def test_toxicity_of_odd_rows(make, spark):
    text = lambda i: f"word{i % 40} other{i % 17} " + ("vile foul " if i % 3 == 0 else "fine good ") * 2
    rows = [(i, text(i)) for i in range(300)] + [(0, text(0))] * 3 + [(1, None), (None, text(3))]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(0, 0), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(make(rows), labels)
    judged = make(rows + [(400, "vile " * 20_000)]).withColumns({"toxic": F.lit("old"), "grade": F.lit("old"), "x": F.lit("mine")})
    got = by_id(toxicity.severity(judged, model))
    assert len({r.severity for r in got[0]}) == 1 and got[0][0].toxic and got[400][0].toxic and not got[2][0].toxic
    assert not [r for r in got[1] if r.text is None][0].toxic and got[None][0].toxic and got[0][0].x == "mine"
    assert toxicity.severity(judged.limit(0), model).count() == 0


def test_severity_grades_are_ordered():
    r = random.Random(8)
    rows = []
    for _ in range(800):
        g = r.randrange(4)
        rows.append((np.array(sorted({r.randrange(100, 400) for _ in range(10)} | {k for k in range(g)}), np.int64), g))
    model = toxicity.fit(rows, toxicity.Toxicity())
    each = [np.mean([model.at_least(x).sum() for x, y in rows if y == g]) for g in range(4)]
    assert each == sorted(each) and each[3] > each[0] + 1


def test_html_marked_elements_stay_apart_whatever_their_share():
    """Sidebars, notices, adverts and comments beside an article or plain text, however long they are; hidden text."""
    part = "<p>A sentence, of words, is here.</p>"
    text = "A sentence, of words, is here."
    two = f"{text}\n\n{text}"
    for names in ("sidebar", "sidebar widget", "cookie-notice", "alert", "ad-slot", "disqus_thread", "discussion", "post-discussion", "comments-area"):
        for kind in ("class", "id"):
            aside = f'<div {kind}="{names}">{part * 6}</div>'
            for page in (f"<body>{aside}<article>{part * 2}</article></body>", f"<body><div>{part * 2}</div>{aside}</body>", f"<body><article>{part}{aside}{part}</article></body>", f"<body><main>{part * 2}</main>{aside}</body>"):
                assert html.main_text(page) == two, page
    for hidden in ("hidden", 'hidden="hidden"', 'style="color:red; display : none"', "style='visibility:hidden'", "HIDDEN"):
        assert html.main_text(f"<article>{part}<div {hidden}>{part * 3}</div><p {hidden}>x</p>{part}</article>") == two
        assert html.main_text(f"<article>{part}<p>A sentence, of <span {hidden}>more <span>or</span> less</span>words, is here.</p></article>") == two
    assert html.main_text(f'<article><p class="hidden-gem" data-hidden="x" title="hidden">{text}</p><p hidden="until-found">{text}</p></article>') == two


def test_html_forms_hold_the_page_only_where_nothing_lies_outside():
    part = "<p>A sentence, of words, is here.</p>"
    text = "A sentence, of words, is here."
    form = f"<form><label>Name</label>{part * 5}</form>"
    assert html.main_text(f"<body><article>{part}</article>{form}</body>") == text
    assert html.main_text(f"<body><div>{part}</div>{form}</body>") == text
    assert html.main_text(f'<body><form><nav>x</nav><div class="sidebar">{part * 9}</div><h1>T</h1>{part}</form><form><label>Search, please.</label></form></body>') == f"T\n\n{text}"
    assert html.main_text(f"<body><form>{part * 4}</form><form><article>{part}</article></form></body>") == text
    assert html.main_text("<body><form><label>Name</label><input></form></body>") == ""


def test_every_language_is_learnt_within_the_bounds(make):
    """Three hundred languages, one of them with two thirds of all rows: each is told, by a model of bounded size."""
    r = random.Random(21)
    stems = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéèàçñöü") for _ in range(6)) for _ in range(300)]
    text = lambda k: " ".join(stems[k] + r.choice("aeiou") for _ in range(30))
    rows = [(i, text(0), "l0", "s") for i in range(1200)] + [(2000 + i, text(i % 299 + 1), f"l{i % 299 + 1}", "s") for i in range(1794)]
    rules = langid.LanguageId(weights=1 << 20, texts=900, grams=900 * 80, epochs=2)
    assert rules.of(300).bits == 11 and rules.of(4).bits == 15 and rules.of(10**6).bits == 8
    got = langid.identify(make(rows, extra=False), rules).where("held_out").collect()
    assert len({x.lang_pred for x in got}) > 200 and sum(x.lang == x.lang_pred for x in got) > 0.9 * len(got)


def test_near_duplicates_of_very_long_texts_share_a_bucket(make):
    """Long texts in one large bucket are compared in blocks that hold few of them."""
    from noteforge.llm import dedup

    r = random.Random(22)
    base = [f"w{r.randrange(10**6)}" for _ in range(6_000)]
    rows = []
    for i in range(12):
        words = base.copy()
        for _ in range(i * 55):
            words[r.randrange(len(words))] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    link = {(a, b) for a in range(12) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    label = list(range(12))
    for _ in range(12):
        for a, b in link:
            label[a] = label[b] = min(label[a], label[b])
    df = make(rows).withColumns({"digest": F.lit("x"), "regs": F.lit("y"), "label": F.lit(0), "node": F.lit(1)})
    for rules in (dedup.NearDuplicates(), dedup.NearDuplicates(most_pairs=2, block=3, block_shingles=20_000)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in dedup.near_duplicates(df, rules).collect()}
        assert got == {i: (len(sets[i]), label[i]) for i in range(12)} and len(set(label)) > 1
