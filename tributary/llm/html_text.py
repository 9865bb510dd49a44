r"""HTML extraction: blocks of a page, labelled in two passes.

A page is cut into blocks at its block-level tags. What the page's own markup rules out goes (menus,
headers, footers, sidebars, notices, adverts, forms, comments by tag, role, class or id). First pass: the
page's ``article`` or ``main``, where it has them, else link density, length and the share of stop words
decide a block; short blocks, and middling ones without stop words, stay open. Second pass: an open block
takes the label of the nearest decided one, of two as near the one behind if it is a heading, else the
good one; on a page where nothing is decided all open blocks are kept.

One scan of the pages and no shuffle: the cut is a function of one page, in Arrow batches of bounded
bytes. Work is linear in the page, however long or broken its markup.

Defined cases: null or empty html has an empty text; script, style and the like end at their own end
tag, comments at ``-->`` or with the page; unclosed elements end as in a browser where a block begins
(``p``, ``li``, ``td``, ``dt``), else with an enclosing end tag or the page; a ``br`` is white space;
character references without a semicolon are decoded too; repeated rows give equal rows, an empty table
none; input columns named ``text`` and ``n_chars`` are replaced, others pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.shared import bounded

#: Blocks of fewer code points stay open at first; those of more need no neighbour.
SHORT, LONG = 70, 200
#: Share of stop words among the words of running text.
STOP_SHARE = 0.2
#: Share of a block's text inside links from which it is a menu; inside marked content with so many links at least.
LINK_SHARE, MANY_LINKS = 0.5, 3

# the most common function words of four languages
STOP_WORDS = {
    "en": "the of and to a in is that it for was on are as with his they at be this from or had by but not what all were we when your can an which their if will how about out then them these so some her would into has",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la ou avec son aux d l cette ont ses mais comme on tout nous sa fait été aussi leur bien peut ces",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde",
}

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; none of it is text of the page.
RAW = frozenset("script style title textarea noscript iframe noembed noframes template xmp svg math".split())
#: A tag ends open elements of the second list, up to one of the third.
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "option": ("option", "select"),
}
OUTSIDE = frozenset("nav footer aside form button select menu dialog fieldset head search audio video canvas object".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of a class or id that tell what is not the article.
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr hidden login menu modal nav navbar navigation newsletter notice pager pagination popup "
    "promo promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
HEADER_NAMES = frozenset("header masthead topbar".split())
CONTENT_NAMES = frozenset("article content entry post story".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """Text between two block-level tags, and what the first pass looks at."""

    outside: bool
    inside: bool
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    links: int = 0


def named(attributes: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}


def marked(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is no part of the article, and whether it is the article."""
    known = named(attributes) if attributes else {}
    role = known.get("role", "").lower()
    names = set(NAME.findall(CAMEL.sub(" ", f"{known.get('class', '')} {known.get('id', '')}").lower())) if "class" in known or "id" in known else set()
    outside = tag in OUTSIDE or role in OUTSIDE_ROLES or "hidden" in known or known.get("aria-hidden", "").lower() == "true" or "display:none" in known.get("style", "").lower().replace(" ", "")
    if tag not in ("html", "body", "main"):
        outside = outside or not names.isdisjoint(OUTSIDE_NAMES)
        outside = outside or (not in_article and (tag == "header" or (not names.isdisjoint(HEADER_NAMES) and names.isdisjoint(CONTENT_NAMES))))
    return outside, tag in ("article", "main") or role == "main" or known.get("itemprop", "").lower() == "articlebody"


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # name, outside, inside
    open_names: Counter[str] = Counter()
    block: Block | None = None

    def pop() -> str:
        name = stack.pop()[0]
        open_names[name] -= 1
        return name

    def text(piece: str) -> None:
        nonlocal block
        if not piece or piece.isspace() and block is None:
            return
        if block is None:
            name = stack[-1] if stack else ("", False, False)
            block = Block(name[1], name[2], any(open_names[h] for h in HEADINGS))
            out.append(block)
        piece = html.unescape(piece) if "&" in piece else piece
        block.parts.append(piece)
        if open_names["a"]:
            block.linked.append(piece)

    at, end, last_close = 0, len(page), page.rfind(">")
    while at < end:
        begin = page.find("<", at)
        if begin < 0 or begin > last_close:
            # no tag is complete any more; what opens one is no text
            rest = page[at:] if begin < 0 else page[at:begin] + ("" if re.match(r"[a-zA-Z/!?]", page[begin + 1 : begin + 2]) else page[begin:])
            text(rest)
            break
        if begin > at:
            text(page[at:begin])
        if page.startswith("<!--", begin):
            close = page.find("-->", begin + 2 if page.startswith("<!-->", begin) else begin + 4)
            at = end if close < 0 else close + 3
            continue
        if page[begin + 1 : begin + 2] in ("!", "?"):
            close = page.find(">", begin)
            at = close + 1
            continue
        m = TAG.match(page, begin) or LOOSE_TAG.match(page, begin)
        if not m:
            if page.startswith("</", begin):  # an end tag without a name is a comment
                at = page.find(">", begin) + 1
            else:
                text("<")
                at = begin + 1
            continue
        at, closing, name, attributes = m.end(), m[1], m[2].lower(), m[3]
        if name in BLOCKS:
            block = None
        if closing:
            if open_names[name]:
                while pop() != name:
                    pass
            continue
        if name in RAW:
            m = RAW_END[name].search(page, at)
            at = m.end() if m else end
            continue
        if name == "br":
            text(" ")
        if name in BLOCKS and open_names["p"]:
            while pop() != "p":
                pass
        if name in ENDS:
            ended, within = (x.split() for x in ENDS[name])
            while any(open_names[x] for x in ended):
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ended or stack[k][0] in within), -1)
                if k < 0 or stack[k][0] in within:
                    break
                while len(stack) > k:
                    pop()
        if name in VOID:
            continue
        if name == "a" and open_names["a"]:  # links don't nest
            while pop() != "a":
                pass
        above = stack[-1] if stack else ("", False, False)
        if attributes or name in OUTSIDE or name in ("header", "article", "main"):
            outside, inside = marked(name, attributes, above[2])
        else:
            outside, inside = False, False
        stack.append((name, above[1] or outside, above[2] or (inside and not above[1])))
        open_names[name] += 1
        if name == "a" and block is not None:
            block.links += 1
        elif name == "a":
            text(" ")
            if block is None:
                block = Block(*stack[-1][1:], any(open_names[h] for h in HEADINGS))
                out.append(block)
            block.links += 1
    return out


def labels(blocks: list[Block], texts: list[str], stop_words: frozenset[str]) -> list[bool | None]:
    """First pass: True for the article, False for what is not, None for open."""
    whole = any(b.inside for b in blocks)
    out: list[bool | None] = []
    unsure: list[int] = []
    spoken = False
    for k, (b, t) in enumerate(zip(blocks, texts, strict=True)):
        share = len(" ".join("".join(b.linked).split())) / max(1, len(t))
        if whole and not b.inside:
            out.append(False)
        elif whole:
            out.append(not (share > LINK_SHARE and b.links >= MANY_LINKS))
        elif share > LINK_SHARE or t.startswith("©"):
            out.append(False)
        elif len(t) < SHORT:
            out.append(None)
        else:
            words = LETTERS.findall(t.lower())
            if sum(w in stop_words for w in words) >= STOP_SHARE * max(1, len(words)):
                spoken = True
                out.append(True)
            else:
                unsure.append(k)
                out.append(None)
    if not spoken:  # a language without a list: long texts without links are all there is to go by
        for k in unsure:
            out[k] = True if len(texts[k]) >= LONG else None
    return out


def inherited(found: list[bool | None], blocks: list[Block]) -> list[bool]:
    """Second pass: open blocks take the label of the nearest decided one."""
    n = len(found)
    behind: list[int | None] = [None] * n
    nearest = None
    for k in range(n - 1, -1, -1):
        nearest = k if found[k] is not None else nearest
        behind[k] = nearest
    out, before = [], None
    for k, own in enumerate(found):
        if own is not None:
            before = k
            out.append(own)
            continue
        a, b = before, behind[k]
        if a is None and b is None:
            out.append(True)
        elif a is None or b is None:
            out.append(bool(found[b if a is None else a]))
        elif k - a != b - k:
            out.append(bool(found[a if k - a < b - k else b]))
        else:
            out.append(bool(found[b]) if blocks[k].heading else bool(found[a] or found[b]))
    return out


def main_text(page: str | None, stop_words: frozenset[str]) -> str:
    if not page:
        return ""
    # what the markup rules out says nothing of its neighbours
    pairs = [(b, t) for b in blocks_of(page) if not b.outside and (t := " ".join("".join(b.parts).split()))]
    blocks, texts = [b for b, _ in pairs], [t for _, t in pairs]
    kept = inherited(labels(blocks, texts, stop_words), blocks)
    return "\n\n".join(t for t, good in zip(texts, kept, strict=True) if good)


def extracted(pages: DataFrame, source: str = "html", stop_words: dict[str, str] | None = None) -> DataFrame:
    """pages with ``text``, the main text of the column `source`, and ``n_chars``, its code points."""
    bounded(pages.sparkSession)
    known = frozenset(w for words in (stop_words or STOP_WORDS).values() for w in words.split())

    @F.pandas_udf("string")
    def main_texts(x: pd.Series) -> pd.Series:
        return x.map(lambda page: main_text(page, known))

    return pages.withColumn("text", main_texts(source)).withColumn("n_chars", F.length("text").cast("long"))


def op13(pages: DataFrame) -> DataFrame:
    return extracted(pages.select("page_id", "url", "html")).drop("html")
