"""Fuzzy titles: distances against the plain recurrence, the nearest against a full comparison, few pairs measured."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from noteforge.functions import text as tx
from noteforge.operators import retrieval as rt


def plain_distance(a, b):
    """Least cost over prefixes; a swap joins two letters and all that lies between them."""
    best = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [i + j] if not i or not j else [best[i - 1, j] + 1, best[i, j - 1] + 1, best[i - 1, j - 1] + (a[i - 1] != b[j - 1])]
            for k in range(1, i):
                for m in range(1, j):
                    if a[k - 1] == b[j - 1] and b[m - 1] == a[i - 1]:
                        ways.append(best[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
            best[i, j] = min(ways)
    return best[len(a), len(b)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=9), st.text("abcd", max_size=9)), min_size=1, max_size=12), st.integers(1, 400))
def test_distances_in_slices(pairs, cells):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    assert tx.distances(a, b, cells).tolist() == [plain_distance(x, y) for x, y in pairs]


def test_no_pairs():
    assert tx.distances([], []).tolist() == []


def grams(t):
    p = f"  {t} "
    return {p[i : i + 3] for i in range(len(p) - 2)}


def test_nearest_titles_equal_a_full_comparison(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(150)]
    titles = [" ".join(r.choice(words) for _ in range(r.randrange(1, 7))) for _ in range(700)]

    def edited(t):
        for _ in range(r.randrange(4)):
            i = r.randrange(len(t) + 1)
            t = r.choice([t[:i] + "x" + t[i:], t[:i] + t[i + 1 :], t[:i] + t[i : i + 2][::-1] + t[i + 2 :]])
        return t

    titles += [edited(t) for t in titles[:200]] + [titles[0], titles[1].upper(), "", None]
    asked = [(i, edited(t)) for i, t in enumerate(titles[:24])] + [(90, ""), (91, None), (92, "zzz")]
    q = spark.createDataFrame(asked, "query_id long, query string")
    t = spark.createDataFrame([(x,) for x in titles], "title string")
    keys = {x: " ".join(x.lower().split()) for x in titles + [a for _, a in asked] if x is not None}
    pairs = sorted({(keys[a], keys[x]) for _, a in asked if a is not None for x in titles if x is not None})
    away = dict(zip(pairs, tx.distances([p[0] for p in pairs], [p[1] for p in pairs]).tolist(), strict=True))
    for k, closer in ((3, None), (10, 4)):
        want = []
        for i, text in asked:
            shared = {x for x in titles if None not in (x, text) and grams(keys[text]) & grams(keys[x])}
            near = sorted((away[keys[text], keys[x]], x) for x in shared)
            want += [(i, x, d, n) for n, (d, x) in enumerate([y for y in near if closer is None or y[0] < closer][:k], 1)]
        got = sorted(map(tuple, rt.fuzzy(q, t, k, closer).collect()))
        assert got == sorted(want), (k, closer)
