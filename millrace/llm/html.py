"""HTML extraction: blocks, then two passes of rules over them.

Structure decides first what it can: menus, headers, footers, sidebars, forms, adverts, notices and comments are never
main text, and where a page marks its article the search stays inside it. Pass one classifies each block that is left
from its own figures: link density, length and stop-word density make it good, bad or undecided. Pass two gives an
undecided block the label of the nearest decided neighbour, the one before and the one after weighed by distance.

Inside a marked article the evidence for main text is stronger, so single links and short lines are undecided there and
only runs of linked entries, which are menus, are bad; an article without a decided block is main text.

Pages are independent: the operator is one pass of ``mapInArrow`` without a shuffle, and memory is bounded by a page.

Defined results: null or empty html gives an empty text; unclosed tags, cut entities and cut comments are read as
browsers read them; repeated pages give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements by their part in a page.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select button title head".split())
FURNITURE = frozenset("nav footer aside form dialog menu fieldset figure audio video datalist header search".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main nav ol option p pre search section summary table tbody td tfoot th thead tr ul aside".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark furniture.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|banner|breadcrumb|breadcrumbs|comment|comments|cookie|cookies|consent|copyright|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|pager|popup|promo|promoted|related|replies|reply|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|tags|toolbar|widget|skip|alert|search|login|signup|complementary|contentinfo|reactions)(?:$|[\s_-]|\d)",
    re.I,
)
#: Frequent function words of the languages served.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with you not but have they which der die das und ist in zu den mit von für auf ein eine nicht dem des sich als auch le la les de des et un une du que qui dans pour sur est pas au el los las y en por con se del al es una para lo como más".split()
)

TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(![^>]*|\?[^>]*)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I | re.S)
SPACES = re.compile(r"\s+")


@dataclass(frozen=True)
class BlockRules:
    max_link_density: float = 0.35
    long_words: int = 25
    stop_low: float = 0.05
    stop_high: float = 0.12
    short_words: int = 10
    menu_density: float = 0.8
    menu_run: int = 3


class _Block:
    __slots__ = ("text", "linked", "tag", "inside")

    def __init__(self, text: str, linked: int, tag: str, inside: bool):
        self.text, self.linked, self.tag, self.inside = text, linked, tag, inside


def _marked(attributes: str) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True
        elif MARKED.search(value):
            return True
    return False


def blocks_of(page: str) -> tuple[list[_Block], bool]:
    """The blocks outside furniture in page order, and whether the page marks its article."""
    found: list[_Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, whether it hides what it holds, whether it is the article
    outer: list[str] = [""]  # the blocks among them
    opened: dict[str, int] = {}
    hidden = articles = links = 0
    seen_article = False
    tag, at, n = "", 0, len(page)

    def flush() -> None:
        if parts:
            text = SPACES.sub(" ", html_entities.unescape("".join(parts))).strip()
            if text:
                found.append(_Block(text, len(SPACES.sub(" ", html_entities.unescape("".join(linked))).strip()), tag, articles > 0))
            parts.clear()
            linked.clear()

    def pop(k: int) -> None:
        nonlocal hidden, articles, links
        while len(stack) > k:
            name, hides, main = stack.pop()
            hidden -= hides
            articles -= main
            links -= name == "a"
            opened[name] -= 1
            if name in BLOCKS:
                outer.pop()

    while at < n:
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not hidden:
            parts.append(text)
            if links:
                linked.append(text)
        if not m:
            break
        at = m.end()
        name = m[4]
        if not name:
            continue
        name = name.lower()
        if name in ("br", "hr", "wbr"):
            if name == "hr":
                flush()
            elif name == "br" and not hidden:
                parts.append(" ")
            continue
        closing = m[3] == "/"
        if name in BLOCKS:
            flush()
        if closing:
            if opened.get(name):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        pop(k)
                        break
            tag = outer[-1]
            continue
        if name in VOID:
            continue
        if name in RAW and name not in ("head", "button", "select", "noscript", "object", "canvas", "svg", "math", "template"):
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if opened.get(name) and name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # a new one closes an open one of its kind
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if stack[k][0] in ("div", "ul", "ol", "table", "article", "section", "main", "blockquote", "body"):
                    break
        if opened.get("head") and (name in BLOCKS or name == "div"):  # the head ends where the body's content starts
            pop(next(k for k, s in enumerate(stack) if s[0] == "head"))
        main = name in ("article", "main")
        hides = name in RAW or (name in FURNITURE and not (name in ("header", "figure") and articles)) or (name not in ("html", "body") and bool(m[5]) and _marked(m[5]) and not main)
        if name == "header" and articles and m[5] and _marked(m[5]):
            hides = False
        seen_article = seen_article or (main and not hidden)
        stack.append((name, hides, main))
        opened[name] = opened.get(name, 0) + 1
        hidden += hides
        articles += main
        links += name == "a"
        if name in BLOCKS:
            tag = name
            outer.append(name)
    flush()
    return found, seen_article


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
GOOD, BAD, UNDECIDED = "good", "bad", "undecided"


def own_classes(blocks: list[_Block], marked: bool, rules: BlockRules) -> list[str]:
    """Pass one: what each block's own figures say; ``marked``: all of them stand in a marked article."""
    kinds = []
    linked = 0  # linked entries in a row up to here
    for b in blocks:
        words = b.text.split()
        density = b.linked / len(b.text)
        stops = sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in words) / len(words)
        linked = linked + 1 if density > rules.menu_density and b.tag != "p" and b.tag not in HEADINGS else 0
        if density > rules.max_link_density:
            kind = UNDECIDED if marked else BAD
        elif not marked and re.match(r"(?:©|\(c\)\s|copyright\b)", b.text, re.I):
            kind = BAD
        elif len(words) >= rules.long_words:
            kind = GOOD if stops >= rules.stop_low or len(words) >= 2 * rules.long_words else UNDECIDED
        else:
            kind = GOOD if len(words) >= rules.short_words and stops >= rules.stop_high else UNDECIDED
        kinds.append(kind)
        if linked == rules.menu_run:
            kinds[-linked:] = [BAD] * linked
        elif linked > rules.menu_run:
            kinds[-1] = BAD
    return kinds


def settled(kinds: list[str], tags: list[str], marked: bool) -> list[str]:
    """Pass two: undecided blocks get the label of the nearest decided neighbour.

    Beyond the ends of a page lies furniture; beyond those of a marked article nothing speaks for either label. Of two
    neighbours equally near the worse decides, but a heading belongs to what follows.
    """
    edge = (GOOD, 10**9) if marked else (BAD, 10**9)

    def nearest(order: list[str]) -> list[tuple[str, int]]:
        out, last, since = [], *edge
        for k in order:
            out.append((last, since))
            last, since = (k, 1) if k != UNDECIDED else (last, since + 1)
        return out

    out = []
    for k, tag, (left, dl), (right, dr) in zip(kinds, tags, nearest(kinds), nearest(kinds[::-1])[::-1], strict=True):
        if k == UNDECIDED:
            if tag in HEADINGS:
                k = right if right == GOOD else left if dl < dr else BAD
            else:
                k = left if left == right or dl < dr else right if dr < dl else BAD
        out.append(k)
    return out


def extract_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    """The main text: its blocks joined by an empty line."""
    blocks, marked = blocks_of(page or "")
    blocks = [b for b in blocks if b.inside or not marked]
    kinds = settled(own_classes(blocks, marked, rules), [b.tag for b in blocks], marked)
    return "\n\n".join(b.text for b, k in zip(blocks, kinds, strict=True) if k == GOOD)


def _run(batches: Iterator[pa.RecordBatch], rules: BlockRules) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract_text(h, rules) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, rules: BlockRules = BlockRules()) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    narrow = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    return narrow.mapInArrow(lambda it: _run(it, rules), "page_id bigint, url string, text string, n_chars bigint")
