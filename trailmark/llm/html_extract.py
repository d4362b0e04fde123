"""Main text of HTML pages by the maximum-scoring subsequence.

A page is read as a sequence of tags and words. Words score positive and tags negative; the contiguous region with the
highest sum, found by one linear scan, holds the content. What stands in an element that by its tag, or by a class, id or
role as a whole, is a menu, header, footer, sidebar, notice, advert, form, comment section or no text at all scores nothing
and is left out of the region's text, so an advert in the middle of an article doesn't cut the region. The region then grows to
the page's own article, if it lies in one, or else to the whole paragraphs, lists and tables that its ends lie in. An element around
the page's own article is never left out, whatever its name; nor is a form, or an element with a compound name, that holds
half of the page's words or more.

The weights are log-odds from labelled pages: a page labels itself if it marks its content by an article or main element or the
role main. Tags and words are counted within and without that element, by kind of element, over such pages among the `SAMPLE`
pages with the least hashes (an aggregation with at most `KINDS` keys), together with prior counts that decide where no page
is labelled.

Lines end at the tags of blocks and at br; all other tags, unknown ones too, stand within a line.

Defined cases: null or empty html and pages without content give an empty text; unclosed elements end with the element
around them; an unfinished tag or comment at the end is no text; very long pages take time in proportion to their length;
of regions with equal sums the first counts; equal rows get equal results; no rows give no rows; further columns, of
whatever names, are not looked at.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, bounded_batches, hash_cut, table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|template|noscript|iframe|svg|textarea|xmp)\b(?:"[^"]*"|'[^']*'|[^'">])*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Tags at which a line ends.
BREAKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup
hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul""".split())
#: What the region is completed to where it begins or ends in one of them.
UNITS = frozenset("blockquote details dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CONTENT = frozenset(("article", "main"))
#: (opening tags, what they close, what holds it open)
IMPLIED = (
    (CLOSES_P, ("p",), ("button", "td", "th", "table", "li")), (frozenset(("li",)), ("li",), ("ul", "ol", "menu")), (frozenset(("td", "th")), ("td", "th"), ("table",)),
    (frozenset(("tr",)), ("tr",), ("table",)), (frozenset(("body",)), ("head",), ()),
)
LEFT_OUT = frozenset("aside audio button canvas datalist dialog fieldset footer form head menu nav object option select title video".split())
#: Class names, ids and roles of what isn't content; parts of a compound name too, see named().
NAMES = frozenset("""ad ads adbox advert adsbygoogle advertisement advertising adverts banner breadcrumb breadcrumbs comment commentlist comments commentary complementary consent contentinfo
cookie cookies discussion disqus feedback footer gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay
pager pagination paywall popup promo promoted promotion recommended related replies reply respond responses search share sharing sidebar signup social sponsor
sponsored subscribe subscription teaser teasers toolbar widget widgets""".split())
HEADS = frozenset("header head top".split())
OWN = frozenset("article post entry content main story body".split())
#: What a compound name may hold besides such names: "ad-box", "sidebar-left", "post-comments"; of OWN and PLACES only in front.
FILLERS = frozenset("""area bar block bottom box btn card col column container cta feed fixed form global group holder inner item items left line link links list mobile module
outer panel pane primary rail reader readers region right row secondary section site slot small sticky strip text thread tile top unit user users wrap wrapper zone""".split())
PLACES = frozenset("page blog".split())
#: Articles inside of such elements aren't the page's own; nor are those that have such a name, or one of BESIDE, themselves.
AROUND = frozenset("comment commentlist comments discussion disqus replies reply respond responses related recommended".split())
BESIDE = AROUND | frozenset("teaser teasers promo sponsored ad ads advert adverts".split())
WORDY = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main section dd figcaption".split())
KINDS = 200
#: Pages that the weights are learned from.
SAMPLE = 4000
_KNOWN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main section dd dt dl figure figcaption div body html li ul ol td th tr table tbody br hr img a b i em strong span center".split())


def kind_of(tag: str) -> str:
    return tag if tag in _KNOWN else "other"


def parts_of(name: str) -> list[str]:
    return [p.lower() for p in PARTS.findall(name) if not p.isdigit()]


def named(name: str, of: frozenset = NAMES) -> bool:
    """Whether a class name, id or role says that an element isn't content. A compound one does if nothing in it says anything else:
    "cookie-notice" and "post-comments" do, "no-sidebar", "has-search", "main-with-menu", "content-share-ready" and "related-work" don't."""
    parts = parts_of(name)
    at = [i for i, p in enumerate(parts) if p in of]
    return bool(at) and all(p in of or p in FILLERS or (p in OWN or p in PLACES) and i < at[0] for i, p in enumerate(parts))


class Element:
    __slots__ = ("attributes", "end", "gone", "mark", "own", "parent", "start", "tag")

    def __init__(self, tag: str, attributes: str, parent: Element | None, start: int):
        self.tag, self.parent, self.start, self.end, self.own, self.gone = tag, parent, start, start, False, None
        self.attributes = [(n.lower(), v.strip("\"'")) for n, v in ATTRIBUTE.findall(attributes)] if attributes else []
        #: article or main, by its tag or its role
        self.mark = tag if tag in CONTENT else "main" if ("role", "main") in self.attributes else None

    def names(self) -> list[str]:
        return [one for n, v in self.attributes if n in ("class", "id", "role") for one in v.split()]

    def size(self) -> int:
        return self.end - self.start


def left_out(e: Element, within: bool, half: float) -> bool:
    """Whether an element isn't content by its own tag and attributes. Never an element around the page's own article. A form
    and what has a compound name are only left out if they hold less than half of the page's words. within: inside of an article or main element."""
    if e.own:
        return False
    if e.tag in LEFT_OUT or e.tag == "header" and not within:
        return e.tag not in ("form", "fieldset") or e.size() < half
    if e.tag in ("body", "html"):
        return False
    if e.mark:
        return any(named(n, BESIDE) for n in e.names())
    for name, value in e.attributes:
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    for name in e.names():
        parts = parts_of(name)
        head = not within and not OWN & set(parts) and named(name, NAMES | HEADS)
        if (head or named(name)) and (len(parts) == 1 or e.size() < half):
            return True
    return False


def elements(page: str) -> tuple[list[tuple], int]:
    """What stands in the page, in order: (text, None, innermost element) or ("", tag, element within which the tag stands, element that it opens or None),
    and the number of words. Each closing tag costs the same, however many elements are open."""
    got: list[tuple] = []
    stack: list[Element] = []
    places: dict[str, list[int]] = {}  # tag -> where it stands in the stack
    n_words = at = 0

    def last(tags: tuple[str, ...]) -> int:
        return max([p[-1] for t in tags if (p := places.get(t))], default=-1)

    def pop(to: int) -> None:
        while len(stack) > to:
            e = stack.pop()
            e.end = n_words
            places[e.tag].pop()

    def words(raw: str) -> None:
        nonlocal n_words
        if raw:
            text = entities.unescape(raw)
            n_words += len(text.split())
            got.append((text, None, stack[-1] if stack else None))

    for m in TOKEN.finditer(page):
        words(page[at : m.start()])
        at = m.end()
        shut, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag, opened, around = tag.lower(), None, stack[-1] if stack else None
        if shut:
            if (i := last((tag,))) >= 0:
                pop(i)
        else:
            for closes, tags, stops in IMPLIED:
                if tag in closes:
                    if (i := last(tags)) > last(stops):
                        pop(i)
                    break
            if tag not in VOID:
                opened = Element(tag, attributes or "", stack[-1] if stack else None, n_words)
                places.setdefault(tag, []).append(len(stack))
                stack.append(opened)
        got.append(("", tag, around, opened))
    words(page[at:])
    pop(0)
    return got, n_words


def own_articles(opened: list[Element]) -> Element | None:
    """The page's own article, and marks the elements around the page's own article: the main or article element with most words that isn't a comment or teaser. An article
    beside a main element counts if it holds over half of its words."""
    found = []
    beside: dict[int, bool] = {}
    for e in opened:  # parents come before their children
        beside[id(e)] = bool(e.parent and beside[id(e.parent)]) or any(named(n, AROUND) for n in e.names())
        if e.mark and not beside[id(e)] and not any(named(n, BESIDE) for n in e.names()):
            found.append(e)
    main, article = (max([e for e in found if e.mark == t], key=Element.size, default=None) for t in ("main", "article"))
    article = article if article and (not main or 2 * article.size() > main.size()) else None
    for e in (main, article):
        while e and not e.own:
            e.own, e = True, e.parent
    return article or main


def parse(page: str) -> list[tuple[str, str, int, bool, object]]:
    """(kind, text, words, within, unit) in page order. Kinds: "t:" + tag, "w:" + nearest block element (with "+a" in links), or "" for what is left out;
    a tag's text is "\\n" if it ends a block. within: inside of an article or main element. unit: True in the page's own article, else
    the outermost of UNITS around it, or None."""
    read, n_words = elements(page)
    opened = [x[3] for x in read if x[1] and x[3]]
    mine = own_articles(opened)
    state = {None: (False, False, False, "body", None)}  # of an element: left out, within content, within a link, nearest block, unit
    for e in opened:
        gone, within, link, block, unit = state[e.parent]
        unit = True if e is mine else unit or (e if e.tag in UNITS else None)
        gone = gone or left_out(e, within, n_words / 2)
        state[e] = (gone, within or bool(e.mark) and not gone, link or e.tag == "a", block if e.tag not in BREAKS else e.tag, unit)
    out: list[tuple[str, str, int, bool, object]] = []
    for text, tag, around, *new in read:
        gone, within, link, block, unit = state[around]
        if tag is None:
            if not gone:
                out.append((f"w:{kind_of(block)}" + "+a" * link, text, len(text.split()), within, unit))
        else:
            if new[0]:
                gone, within = state[new[0]][:2]
            out.append(("" if gone else f"t:{kind_of(tag)}", "\n" if tag in BREAKS else "", 0, within, unit))
    return out


def label_counts(page: str | None) -> Counter:
    """(kind, within) -> number, of a page that marks its content; else nothing."""
    got: Counter = Counter()
    tokens = parse(page or "")
    if any(n and within for _, _, n, within, _ in tokens):
        for kind, _, n, within, _ in tokens:
            if kind and (n or kind[0] == "t"):
                got[kind, within] += n or 1
    return got


def prior(kind: str) -> tuple[float, float]:
    """Counts inside and outside of the content before any page is seen."""
    what, _, block = kind.partition(":")
    if what == "t":
        return (2.0, 1.0) if block in WORDY or block in ("br", "b", "i", "em", "strong") else (1.0, 3.0)
    if block.endswith("+a"):
        return (2.0, 3.0) if block[:-2] in WORDY else (1.0, 6.0)
    return (20.0, 1.0) if block in WORDY else (6.0, 2.0) if block in ("li", "td", "dd", "dt", "div", "figure", "body", "other", "th") else (3.0, 2.0)


class Weights:
    """Of a kind: its log-odds, held above zero for words outside of links and under zero for tags."""

    def __init__(self, counts: dict[tuple[str, bool], int]):
        self.counts = counts
        sums = [sum(n for (k, w), n in counts.items() if w is s) for s in (True, False)]
        self.scale = [min(1.0, 1000 / s) if s else 0.0 for s in sums]  # either side weighs as 1000 tokens at most
        self.known: dict[str, float] = {}

    def __call__(self, kind: str) -> float:
        if kind not in self.known:
            a, b = prior(kind)
            x = math.log((a + self.scale[0] * self.counts.get((kind, True), 0)) / (b + self.scale[1] * self.counts.get((kind, False), 0)))
            self.known[kind] = min(x, -0.02) if kind[0] == "t" else x if kind.endswith("+a") else max(x, 0.1)
        return self.known[kind]


def best_region(scores: list[float]) -> tuple[int, int]:
    """First index and end of the contiguous part with the highest positive sum; the earliest, and of these the longest."""
    best, at, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best > 0 and start == at:
            best, at, end = total, start, i + 1
    return at, end


def grown(tokens: list[tuple], at: int, end: int) -> tuple[int, int]:
    """The region with the whole of its own article if it lies in it, else with the whole of the units that its first and last words lie in."""
    some = [i for i in range(at, end) if tokens[i][2] and tokens[i][0]]
    if not some:
        return at, end
    if any(tokens[i][4] is True for i in some):
        mine = [i for i, t in enumerate(tokens) if t[4] is True]
        return min(at, mine[0]), max(end, mine[-1] + 1)
    first, last = tokens[some[0]][4], tokens[some[-1]][4]
    while first is not None and at and tokens[at - 1][4] is first:
        at -= 1
    while last is not None and end < len(tokens) and tokens[end][4] is last:
        end += 1
    return at, end


def extract(page: str | None, weight: Weights) -> str:
    if not page:
        return ""
    tokens = parse(page)
    marked = any(n and within for _, _, n, within, _ in tokens)
    scores = [0.0 if not kind else weight(kind) * (n if kind[0] == "w" else 1) * (-1 if marked and n and not within else 1) for kind, _, n, within, _ in tokens]
    at, end = grown(tokens, *best_region(scores))
    text = "".join([t if kind else "\n" if t else "" for kind, t in ((k, t if k[:1] != "w" else t.replace("\n", " ")) for k, t, *_ in tokens[at:end])])
    return "\n".join([x for x in (" ".join(block.split()) for block in text.split("\n")) if x])


def learn(spark: SparkSession, pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Weights:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: Counter = Counter()
        for b in batches:
            for page in b["html"]:
                got.update(label_counts(page))
        yield pd.DataFrame([(k, w, n) for (k, w), n in got.items()], columns=["kind", "within", "n"])

    rows = bare(pages, html_col).toDF("html").where("html is not null")
    cut = hash_cut(rows, F.xxhash64("html"), sample)
    rows = rows.where(F.xxhash64("html") <= cut) if cut is not None else rows.limit(0)
    found = rows.mapInPandas(run, "kind string, within boolean, n long").groupBy("kind", "within").agg(F.sum("n").alias("n"))
    return Weights({(r["kind"], r["within"]): r["n"] for r in found.collect()})  # kinds come from fixed lists: KINDS rows at most


def extracted(spark: SparkSession, pages: DataFrame, id_cols: list[str], html_col: str = "html") -> DataFrame:
    """id_cols, text and n_chars of each row."""
    bounded_batches(spark)
    weights = spark.sparkContext.broadcast(learn(spark, pages, html_col))

    @F.pandas_udf("string")
    def text_of(htmls: pd.Series) -> pd.Series:
        return pd.Series([extract(h, weights.value) for h in htmls], dtype=object)

    got = bare(pages, *id_cols, html_col).select(*[F.col(f"`{c}`") for c in id_cols], text_of(F.col(f"`{html_col}`")).alias("text"))
    return got.select("*", F.length("text").cast("long").alias("n_chars"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, table(spark, sf_dir, "pages"), ["page_id", "url"])


QUERIES = {"op10_html_extract": op10_html_extract}
SQL: dict[str, str] = {}
