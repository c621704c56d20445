"""Spelling variants, the audit of filters and the removal of repeats against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteforge.llm import audit, repeats, variants


def near(a, b):
    """Exactly one letter more, less or other."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, rules):
    counts = Counter()
    for doc, text in rows:
        for w in variants.RUN.findall(text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if rules.planted and h % rules.planted == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= rules.least_length and k >= rules.least_count}
    near_of = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in near_of.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= rules.least_ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near_of[w]), n[form[w]] if form[w] else None))
    return out


def test_deletions_are_distinct_and_their_keys_tell_strings_apart():
    for word in ["a", "aa", "abba", "aab", "misspell", "éèê", "x" * 40 + "y"]:
        whole, *rest = variants.deletions(word)
        assert whole[1:] == (0, len(word))
        made = {word[:first] + word[first + 1 :]: key for key, first, _ in rest}
        assert len(made) == len(rest) == len({word[:i] + word[i + 1 :] for i in range(len(word))})
        for text, key in made.items():
            assert next(iter(variants.deletions(text)))[0] == key
        for _, first, last in rest:
            assert len(set(word[first : last + 1])) == 1


def test_variants_against_brute_force(spark, make):
    r = random.Random(4)
    stems = ["separate", "necessary", "éléphant", "aabbaabb", "colour", "color×s", "xxxxxx", "Capital"]

    def form():
        w = r.choice(stems)
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abeéx") + w[i:], w[:i] + r.choice("abeéx") + w[i + 1 :]])
        return w

    rows = [(i, " ".join(form() for _ in range(60))) for i in range(80)] + [(7, None), (8, ""), (None, "Separate separate " * 9), (3, "separate, " * 30), (3, "separate, " * 30), (9, "q" * 3000 + " " + "q" * 2999 + "w" + " .")] + [(100 + i, "q" * 3000 + "é") for i in range(6)]
    for rules in (variants.Variants(), variants.Variants(planted=3, held=50), variants.Variants(planted=0, least_count=2, held_letters=500)):
        got = [tuple(x) for x in variants.variants(make(rows), rules).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_variants(rows, rules)
    assert variants.variants(make(rows).limit(0)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    n = 37
    links = spark.createDataFrame([(i, i + 1, f"w{i + 1}") for i in range(n)], "id long, to long, root string")
    assert {(x.id, x.to, x.root) for x in variants.roots(links).collect()} == {(i, n, f"w{n}") for i in range(n)}
    assert variants.roots(links.limit(0)).count() == 0


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert seen == set(permutations(range(n))) and sum(1 for _ in audit.swaps(n)) == len(seen) - 1


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = t.split()
        same = [x for x, u, _ in rows if (u or "") == t and x is not None]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and any(x < d for x in same)}
        docs.append((d, lang or "", {f for f, x in fails.items() if x}))
    out = {}
    for part in {p for _, p, _ in docs}:
        own = [(d, f) for d, p, f in docs if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [(d, x) for d, x in left if f in x]
                left = [(d, x) for d, x in left if f not in x]
                shapley[f] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, k), x in out.items():
            if p == part:
                x.append(shapley[order[k - 1]])
    return out


def test_audit_against_every_order_by_itself(spark, make):
    r = random.Random(8)
    rows = []
    for i in range(150):
        words = [r.choice(["ab", "Cd", "EF", "gh#", "i"]) if r.random() < 0.3 else f"w{r.randrange(400)}" for _ in range(r.choice([0, 3, 99, 100, 130]))]
        rows.append((i, " ".join(words), r.choice(["en", "fr", "", None])))
    rows += [(i + 200, rows[i % 40][1], "en") for i in range(60)] + [(3, rows[3][1], "en"), (None, rows[5][1], "en"), (None, None, None), (901, None, "en"), (900, "", "fr"), (950, "word " * 300_000, "de")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 260, 2)] + [(4, 1, 1), (None, 1, 1), (77777, 1, 0)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    df = make([(d, t, x, "s") for d, t, x in rows]).withColumn("mask", F.lit(0))
    got = audit.interactions(df, given).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(x.part, x.filter_order, x.step): [x[c] for c in names] for x in got} == plain_audit(rows, labels)
    assert len(got) == 600 * len({x or "" for _, _, x in rows})
    assert audit.interactions(df.limit(0), given).count() == 0
    assert audit.interactions(df, given.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def plain_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        begins = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out[d, len(t), sum(gone), begins, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()] += 1
    return out


def mixture(seed, n, letters):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randrange(30, 260))) for _ in range(7)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(r.randrange(6)):
            x = r.choice(base)
            x = x[r.randrange(len(x)) :] if r.random() < 0.4 else x
            x = x[: r.randrange(len(x) + 1)] if r.random() < 0.4 else x
            text += x + "".join(r.choice(letters) for _ in range(r.randrange(40)))
        rows.append((i, text))
    return [*rows, (1, rows[1][1]), (None, rows[2][1]), (None, None), (500, ""), (501, "x" * 700), (501, "x" * 700), (502, "é" * 333)]


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcdefghéü")])
def test_repeats_against_brute_force(make, seed, letters):
    rows = mixture(seed, 70, letters)
    small = repeats.Repeats(length=40, gram=8, sampled=2, range_bytes=900, run_bytes=2500, block_bytes=300, few=3)
    for rules in (small, repeats.Repeats(length=40, gram=16)):
        assert Counter(map(tuple, repeats.remove_repeats(make(rows), rules).collect())) == plain_repeats(rows, 40)
    assert repeats.remove_repeats(make(rows).limit(0)).count() == 0


def test_repeats_of_a_passage_shared_by_all_documents_over_several_ranges(make):
    """A gram whose contexts fill ranges: its windows are counted over all of them."""
    r = random.Random(9)
    letters = "abcdefgh"
    passage = "".join(r.choice(letters) for _ in range(90))
    rows = [(i, "".join(r.choice(letters) for _ in range(60)) + passage[: 90 - i % 3] + "".join(r.choice(letters) for _ in range(60))) for i in range(300)]
    rules = repeats.Repeats(length=40, gram=8, sampled=1, range_bytes=600, run_bytes=3000, block_bytes=300, few=4)
    assert Counter(map(tuple, repeats.remove_repeats(make(rows), rules).collect())) == plain_repeats(rows, 40)


def test_very_long_texts_keep_what_is_met_once(make):
    r = random.Random(10)
    text = "".join(r.choice("abcdefghijklmnop ") for _ in range(900_000))
    rows = [(1, text), (2, text[400_000:400_500]), (3, "z" * 150 + text[5:204] + "y")]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in repeats.remove_repeats(make(rows)).collect()}
    assert got == {1: (900_000, 500, 1), 2: (500, 500, 1), 3: (350, 0, 0)}


def test_merge_of_runs_keeps_order_and_common_prefixes():
    r = random.Random(11)
    for k in (1, 2, 3, 7, 12):
        runs = [sorted((bytes(r.choice(b"ab") for _ in range(r.randrange(1, 12))), i, 1, 2, False) for i in range(r.randrange(40))) for _ in range(k)]
        blocks = [list(repeats.front_coded(run, 20)) for run in runs]
        assert [[x[0] for x in repeats.decoded(b)] for b in blocks] == [[x[0] for x in run] for run in runs]
        out = list(repeats.merged([repeats.decoded(b) for b in blocks]))
        assert [x[0] for x in out] == sorted(x[0] for run in runs for x in run)
        assert all(y[1] == repeats.common(x[0], y[0]) for x, y in zip(out, out[1:]))
        assert sum(n for b in blocks for n, _, _ in b) == len(out)


def test_anchors_depend_on_the_window_alone():
    r = random.Random(12)
    rules = repeats.Repeats()
    shared = bytes(r.randrange(97, 123) for _ in range(700))
    places = []
    for _ in range(4):
        before = bytes(r.randrange(97, 123) for _ in range(r.randrange(500)))
        at, first, last, _ = repeats.anchors(before + shared + before[::-1], rules)
        of_window = np.repeat(at - len(before), last - first + 1)
        places.append(of_window[len(before) : len(before) + 501].tolist())
    assert all(p == places[0] for p in places)


def test_several_automata_find_what_one_finds(spark, make):
    """Texts are read once per automaton; copies and rows without an id are told apart from their text alone."""
    from noteforge.llm import decontaminate

    r = random.Random(13)
    word = lambda: f"w{r.randrange(60)}"
    items = [(f"i{n}", " ".join(word() for _ in range(r.choice([3, 9, 10, 14, 30])))) for n in range(25)] + [(None, " ".join(word() for _ in range(12))), ("empty", ""), ("null", None)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.randrange(8)))]
        for _ in range(r.randrange(3)):
            parts += [r.choice(items)[1] or "", " ".join(word() for _ in range(r.randrange(5)))]
        rows.append((i, " ".join(parts)))
    rows += [(3, rows[3][1]), (100, rows[3][1]), (None, rows[4][1]), (101, None), (102, "")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = make(rows).withColumns({"h1": F.lit("x"), "spans": F.lit("y"), "n_hit": F.lit(1), "items": F.lit("z")})
    one, many = (sorted(map(str, decontaminate.contamination(docs, benchmark, decontaminate.Decontamination(max_tokens=n)).collect())) for n in (10_000, 40))
    assert one == many and any("contaminated=True" in x for x in one) and len(one) == len(rows)
    assert decontaminate.contamination(docs.limit(0), benchmark, decontaminate.Decontamination(max_tokens=40)).count() == 0
