"""Operator 8: main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf tag path.  Text length and punctuation are aggregated per path
and divided by the number of the path's blocks; both are fused with the number of blocks, the share of text outside links and the share in
the same part of the page as the headline into one ratio per path, which is smoothed along the page, mostly between blocks of the same part of the tree.  Paths whose ratio reaches the threshold that the page itself
sets are content, and their blocks are the text.

What a path's tags, roles and names say is a bounded nudge of its ratio: menus, footers, adverts and what lies outside the page's
article element need about three times the ratio, and what reads like an article but is none (comments, sidebars, lists of
related pages, notices) about eight times.  So names decide between paths of much the same ratio; a higher ratio outvotes them, nothing
is deleted by its name, and with equal ratios menus, footers and adverts would all stay.

The article is the smallest element around the content paths' text (and the headline).  What else lies in it without being nudged
further belongs to the article even if it is short: table cells, captions, single words, lists of linked titles.  Menus, that is lists
and repeated paths of links of one or two words, do not.

Inside a block white space becomes one space; blocks are joined in page order by one line feed.

Defined cases: null, empty or tag-free html gives the text that is there (an empty string for none); unclosed tags,
comments, quotes and cut-off pages are read as far as they go; very long and deep pages are read whole in time linear in their
length; equal ratios fall on the same side of the threshold; comments or sidebars longer than the article stay out unless nothing else has
text; an article without text gives an empty string though menus or footers have some; repeated rows each get a row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: A content path's ratio is at least this share of the page's mean ratio per character.
SHARE = 0.3
#: An article or main element with more than this share of the text on content paths is the article.
HOLDS = 0.6
#: Nudges of the ratio: of paths below an element that its tag, role or name marks as menu, footer, advert or the like,
MARKED = 0.45
#: below one that is marked as prose that is no article,
BESIDE = 0.12
#: below one that is not shown,
UNSEEN = 0.05
#: and of paths outside the page's article or main element.
OUTSIDE = 0.7
#: An article of fewer characters has no ratios to speak of; where only nudged text lies beside it, its element decides.
STUB = 100
#: How much text in the same part of the page as a headline (h1) gains.
HEADED = 12.0
#: Weights of the smoothing along the page, and between blocks whose parts of the tree differ.
KERNEL = (1.0, 2.0, 4.0, 2.0, 1.0)
APART = 0.25
#: A list, or a path of several blocks, with more of its text inside links than this is a list of links;
LINKS = 0.6
#: with fewer words than this to a block it is a menu.
TITLE = 2.5

MARKUP = re.compile(
    r"""<!--(?:.*?-->|.*)                                            # comment
      | <(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | <(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)>       # stray quotes
      | <[!?/][^>]*+>                                                 # declarations
      | <[a-zA-Z/!?][^>]*+\Z                                          # cut off inside a tag""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Marks that end a phrase; dots inside addresses and numbers do not.
PUNCTUATION = re.compile(r"""[.,;:!?…]+(?=[\s"'”’»)\]]|\Z)|[¡¿。，、！？；：]""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark math q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr label".split())
#: Elements whose markup is all part of one line of text.
PHRASES = frozenset("math svg".split())
#: No text of the page: titles, form controls, what stands in for media.
DROPPED = frozenset("head button select option object video audio canvas map desc metadata".split())
#: Tags of menus, footers and the like; a header is one outside articles.
TOLD = frozenset("nav footer menu dialog form fieldset".split())
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre td th dt dd figcaption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl".split())
#: Elements that belong to the part of the page around them.
WITHIN_PARTS = TEXT_BLOCKS | LISTS | frozenset("table thead tbody tfoot tr caption colgroup figure hgroup".split())
#: Elements that hold the page.
WHOLE = frozenset(("", "html", "body"))
MAIN = frozenset(("article", "main"))
RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}
#: What a start tag closes when it meets it open, up to the elements in the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "thead": (set(), set()), "tbody": ({"thead", "tbody"}, {"table"}), "body": ({"head"}, set()),
}
MAIN_ROLE = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Name parts of classes and ids that mark what is not the article,
NOT_ARTICLE = frozenset(
    """ad ads advert adverts advertisement advertising adsense adsbygoogle banner promo promos promotion promoted sponsor sponsored sponsors
    nav navbar navigation menu submenu topbar breadcrumb breadcrumbs footer masthead share sharing social pagination pager toolbar widget widgets
    search login copyright legal skip""".split()
)
#: and of these what reads like one.
PROSE = frozenset(
    """sidebar aside cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup
    related recommended recommendations comment comments commentlist disqus reply replies respond reviews disclaimer hidden""".split()
)
#: Of both, what says nothing about a paragraph or item inside an article.
OF_ELEMENTS = frozenset("legal copyright disclaimer login search skip reviews reply replies respond related social sharing share toolbar".split())
#: After one of these a name speaks of what the element has around or inside it.
SPEAKS_OF = frozenset("no has with without show".split())
#: A name that ends so is the part that holds the text.
HOLDERS = frozenset("content body text main article post entry wrapper container page layout".split())


@dataclass
class Element:
    tag: str
    path: int
    parent: "Element | None"
    dropped: bool = False  # no text of the page
    main: bool = False  # an article or main element, or inside one
    nudge: float = 1.0  # what tags, roles and names on the way say
    inline: bool = False
    phrase: bool = False
    weight: float = 0.0
    inside: bool = False
    children: list["Element"] = field(default_factory=list)

    def __post_init__(self) -> None:
        """``part`` is the part of the page that the element belongs to."""
        self.part = self.parent.part if self.parent is not None and (self.inline or self.tag in WITHIN_PARTS) else self


@dataclass
class Block:
    element: Element
    text: str
    linked: int
    tag: str
    path: int


def named(value: str, whole: bool, item: bool) -> float:
    """The nudge of a class or id; of text blocks only whole names count, not their parts, and fewer of those that are an article's items."""
    out = 1.0
    for name in value.split():
        parts = [p.lower() for p in NAME_PARTS.findall(name)]
        if not parts or parts[0] in SPEAKS_OF or parts[-1] in HOLDERS or whole and len(parts) > 1:
            continue
        out = min([out, *(BESIDE if p in PROSE else MARKED for p in parts if (p in PROSE or p in NOT_ARTICLE) and not (item and p in OF_ELEMENTS))])
    return out


def signs(tag: str, attrs: str, in_main: bool) -> tuple[float, str]:
    """(the nudge that an element's tag, role, names and style give, its first class)."""
    nudge, first = (BESIDE if tag == "aside" else MARKED if tag in TOLD or tag == "header" and not in_main else 1.0), ""
    if not attrs.strip(" /\n\t"):
        return nudge, first
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if name == "class" and value.split():
                first = value.split()[0]
            if tag not in MAIN:
                nudge = min(nudge, named(value, tag in TEXT_BLOCKS, in_main and tag in TEXT_BLOCKS))
        elif name == "role" and value.lower() in ROLES:
            nudge = min(nudge, BESIDE if value.lower() == "complementary" else MARKED)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            nudge = min(nudge, UNSEEN)
    if tag in WHOLE or re.search(MAIN_ROLE, attrs):
        return 1.0, first
    return nudge, first


def blocks_of(page: str) -> tuple[list[Element], list[Block]]:
    """The elements, parents first, and the page's blocks in order."""
    root = Element("", 0, None)
    paths: dict[tuple[int, str, str, float], int] = {}  # (path of the parent, tag, first class, nudge) -> path; long paths as strings would grow with the square of the depth
    here, blocks, everything = root, [], [root]
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                owner = here
                while owner.inline and owner.parent is not None:
                    owner = owner.parent
                blocks.append(Block(owner, text, linked, owner.tag, owner.path))
            parts.clear()
        linked = 0

    def text(a: int, b: int) -> None:
        nonlocal linked
        if a < b:
            s = html.unescape(page[a:b]) if page.find("&", a, b) >= 0 else page[a:b]
            parts.append(s)
            if links:
                linked += len(" ".join(s.split()))

    def close(to: Element) -> None:
        """Leave all elements up to and with ``to``."""
        nonlocal here, links
        if any(not e.inline for e in chain(here, to)):
            flush()
        for e in chain(here, to):
            links -= e.tag == "a"
            open_tags[e.tag] -= 1
        here = to.parent or root

    def chain(e: Element, to: Element):
        while True:
            yield e
            if e is to or e.parent is None:
                return
            e = e.parent

    size = len(page)
    for m in MARKUP.finditer(page):
        start, end = m.span()
        if start < at:
            continue
        text(at, start)
        at = end
        name = m["name"] or m["name2"]
        if not name:
            continue
        tag, attrs = name.lower(), (m["attrs"] or m["attrs2"] or "")
        if m["close"] or m["close2"]:
            e = here
            while open_tags[tag] > 0 and e.parent is not None and e.tag != tag:
                if e.tag in ("table", "article", "main", "body") and tag in INLINE | {"p"}:
                    break
                e = e.parent
            if e.parent is not None and e.tag == tag:
                close(e)
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag in INLINE or here.phrase:
                parts.append(" " if tag == "br" else "")
            else:
                flush()
            continue
        if tag in RAW:
            stop = RAW_ENDS[tag].search(page, end)
            at = stop.end() if stop else size
            continue
        inline = tag in INLINE or here.phrase
        if not inline:
            flush()
            e = here
            while e.parent is not None and e.inline:
                e = e.parent
            if e.tag == "p":  # a block ends an open paragraph
                close(e)
            if tag in CLOSES:
                ends, within = CLOSES[tag]
                e = here
                while e.parent is not None and e.tag not in within:
                    if e.tag in ends:
                        close(e)
                        break
                    e = e.parent
        own, first = signs(tag, attrs, here.main)
        nudge = min(here.nudge, own)
        path = here.path if inline and own == 1.0 else paths.setdefault((here.path, tag, first, nudge), len(paths) + 1)
        main = here.main or tag in MAIN or bool(re.search(MAIN_ROLE, attrs))
        child = Element(tag, path, here, here.dropped or tag in DROPPED, main, nudge, inline, here.phrase or tag in PHRASES)
        if not inline:
            here.children.append(child)
        elif own < 1.0 or child.dropped:
            flush()
        everything.append(child)
        if attrs.rstrip().endswith("/") and (tag not in INLINE or here.phrase):
            continue
        links += tag == "a"
        open_tags[tag] += 1
        here = child
    text(at, size)
    flush()
    return everything, blocks


def path_ratios(blocks: list[Block], factor: dict[int, float]) -> dict[int, float]:
    """Ratio of each tag path: text, punctuation and links fused, smoothed along the page, times the path's nudge."""
    return {p: r * factor[p] for p, r in smoothed(blocks).items()}


def smoothed(blocks: list[Block]) -> dict[int, float]:
    totals: dict[int, list[float]] = {}
    headed = {id(b.element.part) for b in blocks if b.tag == "h1"}
    for b in blocks:
        t = totals.setdefault(b.path, [0.0, 0.0, 0.0, 0.0, 0.0])
        t[0] += len(b.text)
        t[1] += len(PUNCTUATION.findall(b.text))
        t[2] += b.linked
        t[3] += 1
        t[4] += len(b.text) * (id(b.element.part) in headed)
    fused = {p: chars / n * (1.0 + marks / n) * (1.0 - min(1.0, linked / chars)) * (1.0 + HEADED * near / chars) * n / (n + 1) for p, (chars, marks, linked, n, near) in totals.items()}
    row, parts = [fused[b.path] for b in blocks], [b.element.part for b in blocks]
    half = len(KERNEL) // 2
    sums: dict[int, list[float]] = {}
    for i, b in enumerate(blocks):
        near = [(row[j], KERNEL[j - i + half] * (1.0 if parts[j] is parts[i] else APART)) for j in range(max(0, i - half), min(len(row), i + half + 1)) if blocks[j].element.nudge == b.element.nudge]
        s = sums.setdefault(b.path, [0.0, 0.0])
        s[0] += sum(v * w for v, w in near) / sum(w for _, w in near)
        s[1] += 1
    return {p: (a / n + fused[p]) / 2 for p, (a, n) in sums.items()}


def content_paths(blocks: list[Block], factor: dict[int, float]) -> set[int]:
    """The paths whose ratio reaches the threshold; nudged paths count less in the mean that sets it."""
    ratio = path_ratios(blocks, factor)
    weights = [len(b.text) * factor[b.path] ** 2 for b in blocks]
    mean = sum(ratio[b.path] * w for b, w in zip(blocks, weights, strict=True)) / sum(weights)
    return {p for p, r in ratio.items() if r >= SHARE * mean}


def weigh(everything: list[Element], blocks: list[Block]) -> float:
    """Gives each element the length of the blocks in it; returns that of the page."""
    for e in everything:
        e.weight = 0.0
    for b in blocks:
        b.element.weight += len(b.text)
    for e in reversed(everything[1:]):
        e.parent.weight += e.weight
    return everything[0].weight


def article_of(everything: list[Element], blocks: list[Block]) -> Element:
    """The article by the weights of the elements."""
    root = everything[0]
    for e in everything:
        if e.tag in MAIN and not e.dropped and e.weight > HOLDS * root.weight:
            return e
    headline = next((b.element for b in blocks if b.tag == "h1" and b.element.nudge == 1.0), None)
    above = set()
    while headline is not None:
        above.add(id(headline))
        headline = headline.parent
    holder = root
    while holder.tag not in TEXT_BLOCKS:
        best = next((c for c in holder.children if not c.dropped and c.weight >= root.weight and (not above or id(c) in above)), None)
        if best is None or best.tag in TEXT_BLOCKS:
            break
        holder = best
    return holder


def menus_of(blocks: list[Block]) -> set[int]:
    """Which blocks belong to lists or paths of short links; headings and single paragraphs never do."""
    groups: dict[object, list[Block]] = {}
    lists: dict[int, int | None] = {}

    def list_of(e: Element) -> int | None:
        """The outermost list around an element."""
        chain = []
        while e is not None and id(e) not in lists:
            chain.append(e)
            e = e.parent
        found = None if e is None else lists[id(e)]
        for c in reversed(chain):
            if found is None and c.tag in LISTS:
                found = id(c)
            lists[id(c)] = found
        return found

    for b in blocks:
        if b.tag not in HEADINGS:
            own = list_of(b.element)
            groups.setdefault(("path", b.path) if own is None else ("list", own), []).append(b)
    out = set()
    for (kind, _), group in groups.items():
        single = kind == "path" and len(group) == 1 and group[0].tag in TEXT_BLOCKS
        short = sum(len(b.text.split()) for b in group) < TITLE * len(group)
        if not single and short and sum(b.linked for b in group) > LINKS * sum(len(b.text) for b in group):
            out.update(map(id, group))
    return out


def main_text(page: str | None) -> str:
    """The page's main text, blocks joined by line feeds."""
    if not page:
        return ""
    everything, blocks = blocks_of(page)
    blocks = [b for b in blocks if not b.element.dropped]
    if not any(b.element.main for b in blocks) and any(e.tag in MAIN for e in everything):
        blocks = [b for b in blocks if b.element.nudge == 1.0]  # the article is there, and empty: no menu or footer stands in for it
    own = [b for b in blocks if b.element.nudge == 1.0]
    if own and all(b.element.main for b in own) and sum(len(b.text) for b in own) < STUB:
        blocks = own
    if not blocks:
        return ""
    factor = {b.path: b.element.nudge for b in blocks}
    content = content_paths(blocks, factor)
    weigh(everything, [b for b in blocks if b.path in content])
    article = article_of(everything, blocks)
    for e in everything:
        e.inside = e is article or e.parent is not None and e.parent.inside
    if article.tag in MAIN:
        outer = {b.path for b in blocks if not b.element.inside} - {b.path for b in blocks if b.element.inside}
        content = content_paths(blocks, {p: f * OUTSIDE if p in outer else f for p, f in factor.items()})
    menus = menus_of([b for b in blocks if b.path in content or b.element.inside])
    return "\n".join(b.text for b in blocks if (b.path in content or belongs(b, article)) and id(b) not in menus)


def belongs(b: Block, article: Element) -> bool:
    """Whether a block is a short part of the article: nothing on the way down to it says otherwise."""
    return b.element.inside and b.element.nudge >= article.nudge and (b.tag in TEXT_BLOCKS or article.tag not in WHOLE) and bool(article.weight)


def extract(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """(keys, text, n_chars): the main text of each page and its code points."""

    def factory():
        def f(values):
            texts = [main_text(v) for v in values]
            return [texts, [len(t) for t in texts]]

        return f

    return map_texts(pages, keys, F.col(html_col), factory, [("text", "string"), ("n_chars", "long")])


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
