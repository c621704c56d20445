"""Main text of HTML pages by tag-path ratios.

A page is read as a sequence of tags and texts. Every run of text inside one block element is a block, with the path of
block elements from the root to it. Per path, text length, punctuation and blocks are summed; the ratios of length and of
punctuation to blocks are smoothed over neighbouring paths in page order and fused into a score. Paths that pass through
elements which mark menus, headers, footers, sidebars, notices, adverts, forms or reader comments (by element, role, id or
class) score nothing, and neither does what is hidden (by attribute or style). Where no unmarked text lies outside of forms,
the page lies in one: then forms that hold an article or main, else a heading or paragraph, aren't apart. What a marked
element's share of the page is changes nothing. Of an article's own header the headings stay. A path of
links is one whose text is linked for the most part. Chosen is the smallest element that
holds every block of other paths which passes the threshold or is a heading, cell, item, caption or pre, but never one
inside the article or main that holds them all. Its blocks are the main text, short ones too; only those on paths of
links have to pass the threshold, except headings and, in an article or main, cells, items, captions and pre.

Time and memory grow in proportion to the page: paths are numbers (parent, tag, class), elements are numbered in page order,
so that an element holds a range of numbers.

Defined cases: null or empty html, or a page without such text, gives an empty text; unclosed and stray tags are tolerated (an
unclosed svg, button or the like ends where it begins; a tag with an unbalanced quote ends at its first >), formulas in MathML are
text; names don't mark html, body, main, article and headings; implied ends (p, li, td, ...) are applied; repeated rows are
extracted one by one and alike; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from noteforge.llm.base import map_rows, read

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){0,400}+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){0,400}+)>"
    r"|<(?P<bad_end>/?)(?P<bad>[a-zA-Z][a-zA-Z0-9:-]*)[^<>]*+>"
    r"|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"([a-zA-Z_:@][\w:.@-]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++)))?", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# HTML's void and phrasing elements, elements that are no main text, and names that mark such.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
MATH = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mstyle mpadded mphantom mspace menclose merror mfenced semantics".split())
# Left out with all they hold, where they are closed.
SKIPPED = frozenset("svg object select button noscript template annotation annotation-xml".split())
NESTED = frozenset("svg object template".split())
ARTICLE = frozenset(["article", "main"])
# Elements that hold the page or the article, whose names tell of its layout.
PLAIN = ARTICLE | {"html", "body"}
HOLDERS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
APART = frozenset("nav header footer aside form head menu dialog fieldset".split())
NAMES = frozenset(
    "ad ads adv advert alert alerts adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion discussions disqus footer header masthead menu modal nav navbar navigation newsletter "
    "notice notices pagination pager popup promo promoted promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
PLACES = frozenset(["top", "bottom", "site", "global", "page", "main"])
# Of a compound name: parts that a marking name may be followed by, and those that tell of something else than the element.
SHAPES = frozenset("area bar block body box button buttons container content footer form inner item items link links list message outer overlay panel posts section slot space text thread title unit wrap wrapper zone".split())
OTHERS = frozenset("enabled has hide hides no not show shows with without".split())
COMMENTS = frozenset("comment comments discussion discussions disqus replies reply respond".split())
ENDS = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt td th tr".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
HEADING = re.compile(r"h[1-6]\Z")
# Short texts of these elements belong to what is around them.
KEPT = re.compile(r"(?:h[1-6]|td|th|li|dt|dd|pre|caption|figcaption)\Z")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass(frozen=True)
class TagPaths:
    #: a path passes with this share of the mean score of the page's or the chosen element's paths
    threshold: float = 0.05
    #: a path with more than this share of linked text is one of links, and has to pass
    linked: float = 0.5


class _Element:
    __slots__ = ("tag", "path", "parent", "at", "last", "own", "apart", "header")

    def __init__(self, tag: str, parent: _Element | None, at: int, path: int, own: str = ""):
        self.tag, self.parent, self.path = tag, parent, path
        self.at = self.last = at  # its number, and the last one inside
        self.own = own  # what marks it: "apart", "form" (void if the page lies in forms), "header" (of an article) or nothing
        self.apart = self.header = False  # by itself or what it is in; by an article's header only


def _names(token: str) -> str:
    """`apart`, `comments` or nothing, by one class, id or role: its words are NAMES and PLACES (top-menu), or NAMES with SHAPES behind (comment-list)."""
    words = [w.lower() for w in WORDS.findall(token)]
    if OTHERS.intersection(words) or not any(w in NAMES for w in words):
        return ""
    if words[-1] in COMMENTS or words[0] in COMMENTS and all(w in NAMES or w in SHAPES for w in words):
        return "comments"
    first = next(i for i, w in enumerate(words) if w in NAMES)
    whole = all(w in PLACES for w in words[:first]) and all(w in NAMES or w in PLACES or w in SHAPES for w in words[first:])
    return "apart" if whole else ""


def _marks(attrs: str) -> tuple[bool, str, bool]:
    """Whether names in class, id or role mark an element; its class; whether it is hidden."""
    marked = hidden = False
    mark = ""
    for name, a, b, c in ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            marked |= any(map(_names, value.split()))
            marked |= name == "role" and value.lower() in ("contentinfo", "complementary", "search")
            if name == "class":
                mark = "." + value.strip()
        elif name == "hidden":
            hidden |= value.lower() != "until-found"
        elif name == "style":
            hidden |= bool(UNSEEN.search(value))
    return marked, mark, hidden


def _skips(tokens: list[re.Match]) -> dict[int, int]:
    """Number of the end tag by number of the start tag of every closed element of SKIPPED."""
    out: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    for i, m in enumerate(tokens):
        tag = m["tag"] or m["bad"]
        if tag is None or (tag := tag.lower()) not in SKIPPED or (m["attrs"] or "").endswith("/"):
            continue
        open_ = begun.setdefault(tag, [])
        if not (m["end"] or m["bad_end"]):
            if tag not in NESTED:
                open_.clear()
            open_.append(i)
        elif open_:
            out[open_.pop()] = i
    return out


def blocks(page: str) -> list[tuple[_Element, str, int]]:
    """(element, text, length of linked text) of every block, in page order."""
    stack = [_Element("", None, 0, 0)]
    paths: dict[tuple[int, str, str], int] = {}
    opened: Counter[str] = Counter()
    elements = stack.copy()
    out: list[tuple[_Element, str, int]] = []
    run: list[str] = []
    linked, in_link, made = 0, 0, 0
    unseen, depth = "", 0  # a hidden phrasing element, and how many of its name are open in it

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append((stack[-1], text, linked))
        run.clear()
        linked = 0

    def pop() -> None:
        stack[-1].last = made
        opened[stack.pop().tag] -= 1

    tokens = list(TOKEN.finditer(page))
    skips, until = _skips(tokens), -1
    for i, m in enumerate(tokens):
        if i <= until:
            continue
        text = m["text"]
        if text is not None:
            if unseen:
                continue
            run.append(text)
            linked += len(text) if in_link else 0
            continue
        tag = m["tag"] or m["bad"]
        if tag is None:
            continue
        tag, ends, attrs = tag.lower(), m["end"] or m["bad_end"], m["attrs"] or ""
        if tag in SKIPPED:  # by itself where it isn't closed
            until = skips.get(i, i)
            continue
        if tag in INLINE or tag in MATH:
            if unseen:
                depth += (tag == unseen) * (-1 if ends else 1)
                unseen = unseen if depth else ""
            elif not ends and not attrs.endswith("/") and attrs and _marks(attrs)[2]:
                unseen, depth = tag, 1
            if tag == "a":
                in_link = 0 if ends else 1
            continue
        if tag == "br":
            run.append(" ")
            continue
        close()
        unseen = ""
        if tag in VOID:
            continue
        if ends:
            if opened[tag] > 0:
                while stack[-1].tag != tag:
                    pop()
                pop()
                in_link = 0
            continue
        while tag in ENDS.get(stack[-1].tag, ()):
            pop()
            in_link = 0
        if attrs.endswith("/") and tag not in ("p", "div", "li"):
            continue
        marked, mark, hidden = _marks(attrs)
        if hidden:
            own = "hidden"
        elif tag in PLAIN or HEADING.match(tag):
            own = ""
        elif tag == "header" and any(opened[x] > 0 for x in ARTICLE):
            own = "header"
        elif marked or tag in APART - {"form"}:
            own = "apart"
        else:
            own = "form" if tag == "form" else ""
        made += 1
        stack.append(_Element(tag, stack[-1], made, paths.setdefault((stack[-1].path, tag, mark), len(paths) + 1), own))
        elements.append(stack[-1])
        opened[tag] += 1
    close()
    for e in stack:
        e.last = made
    _judge(elements, out)
    return out


def _judge(elements: list[_Element], found: list[tuple[_Element, str, int]]) -> None:
    """Set apart and header of the elements (in order of their numbers)."""
    in_form = [False] * len(elements)
    for e in elements[1:]:
        above = e.parent
        if above.apart:
            e.header = above.header
            e.apart = not (e.header and HEADING.match(e.tag)) or e.own == "hidden"
        else:
            e.header = e.own == "header"
            e.apart = e.own not in ("", "form")
        in_form[e.at] = e.own == "form" or in_form[above.at]
    forms = [e for e in elements[1:] if e.own == "form" and not e.apart]
    if not forms:
        return
    whole = not any(len(text) > linked and not e.apart and not in_form[e.at] for e, text, linked in found)
    for names in (ARTICLE, HOLDERS) if whole else ():
        upto = [0]  # elements of these names before a number
        for e in elements:
            upto.append(upto[-1] + (e.tag in names and not e.apart))
        if kept := [e for e in forms if upto[e.last + 1] > upto[e.at]]:
            break
    else:
        kept = []
    void = {e.at for e in kept}
    inside = [False] * len(elements)  # in a form that is apart
    for e in elements[1:]:
        inside[e.at] = inside[e.parent.at] or e.own == "form" and e.at not in void
        e.apart |= inside[e.at]


def main_text(page: str | None, rules: TagPaths = TagPaths()) -> str:
    found = blocks(page) if page else []
    sums: dict[int, list[float]] = {}
    for e, text, linked in found:
        s = sums.setdefault(e.path, [0.0, 0.0, 0.0, 0.0, 0.0])
        s[0] += len(text) - linked
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
        if not e.apart:
            s[3] += len(text)
            s[4] += linked
    paths = list(sums)
    ratios = [(s[0] / s[2], s[1] / s[2]) for s in sums.values()]
    score: dict[int, float] = {}
    for i, p in enumerate(paths):
        near = [ratios[k] for k in (i - 1, i, i, i + 1) if 0 <= k < len(paths)]
        length, points = (sum(r[x] for r in near) / len(near) for x in (0, 1))
        score[p] = (0.5 * length + 0.5 * ratios[i][0]) * (1 + points) if sums[p][3] else 0.0
    open_paths = [p for p in paths if sums[p][3]]
    if not sum(score[p] for p in open_paths):
        return ""
    least = rules.threshold * sum(score[p] for p in open_paths) / len(open_paths)
    dense = {p for p in open_paths if sums[p][4] > rules.linked * sums[p][3]}
    ours = [(e, text) for e, text, _ in found if not e.apart]
    held = [e for e, _ in ours if e.path not in dense and (score[e.path] >= least or KEPT.match(e.tag))]
    chosen = _holder(held or [e for e, _ in ours if score[e.path] >= least])
    inside = [(e, text) for e, text in ours if chosen is None or chosen.at <= e.at <= chosen.last]
    each = {e.path: score[e.path] for e, _ in inside}
    least = rules.threshold * sum(each.values()) / max(1, len(each))
    always = KEPT if chosen is not None and chosen.tag in ARTICLE else HEADING
    return "\n\n".join(text for e, text in inside if e.path not in dense or each[e.path] >= least or always.match(e.tag))


def _holder(elements: list[_Element]) -> _Element | None:
    """The smallest element that holds all of elements, but the article or main around them all if there is one."""
    if not elements:
        return None
    now, last, found = min(elements, key=lambda e: e.at), max(e.at for e in elements), None
    while now is not None:
        if now.last >= last:
            if found is None or now.tag in ARTICLE:
                found = now
        now = now.parent
    return found


def extract(pages: DataFrame, rules: TagPaths = TagPaths(), key: str = "page_id") -> DataFrame:
    """key, url, text, n_chars of every row of pages(key, url, html)."""
    def begin():
        def run(pages: list[str | None]) -> dict[str, list]:
            texts = [main_text(p, rules) for p in pages]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return run

    return map_rows(pages, begin, ["html"], [key, "url"], "text string, n_chars long")


def op4_tag_path_ratios(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
