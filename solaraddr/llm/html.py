"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import load

#: Frequent words of the languages at hand; fixed values.
STOP_WORDS = {
    "en": "the of and to a in is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no she my what up about out them some",
    "fr": "de la le et les des en un une du dans est que pour qui par sur au il pas plus ne se ce avec sont son aux ou elle a été mais nous vous je leur cette ces comme on y être fait tout",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei sie nach wird um am sind noch wie einem einen über so zum war haben nur oder",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta",
}
_STOP = frozenset(w for words in STOP_WORDS.values() for w in words.split())
#: Characters of a long block and of a surely good one, shares of links and of stop words, and blocks of links that make a menu.
LONG, SURE = 70, 200
LINKS, STOPS_LOW, STOPS_HIGH, MENU = 0.33, 0.08, 0.16, 3
#: Share of stop words in a page's long blocks from which it is taken to be in a language of the lists.
LISTED = 0.12

_BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
_DROP = frozenset("nav footer aside form head select button menu dialog header".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end where another of their kind follows.
_ENDS = frozenset("p li td th tr dt dd option".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(["article", "main"])
#: Elements that hold text: their class is evidence on their own block; that of others is on all they hold.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote td th dt dd figcaption caption pre".split())
# Words of a class, id or role that mark what is not the article, words that say nothing beside them, and words
# that make a header one of the article.
_AWAY = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related recommended search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget contentinfo complementary".split()
)
_NEUTRAL = frozenset(
    "article area bar block body bottom box button buttons col column component container content entry form global group heading inner item items left link links list main module outer page panel post posts reader region right root row section site slot text title top unit user wrap wrapper zone".split()
)
_OWN_HEADER = frozenset("article entry post content".split())
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*.?true|display\s*:\s*none", re.I)
_CUT = re.compile(r"[\s_\-:]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    linked: int
    inside: bool
    marked: bool
    heading: bool = False


def _names_it(attributes: str, inside: bool) -> bool:
    """Whether a class, id or role says that an element is no part of an article: by words of that kind and none that say something else."""
    for name in (n for found in _NAMES.findall(attributes) for n in "".join(found).split()):
        words = {w.lower() for w in _CUT.split(name) if w}
        away = words & _AWAY
        if "header" in away and (inside or words & _OWN_HEADER):
            away = away - {"header"}
        if away and words <= _AWAY | _NEUTRAL:
            return True
    return False


def _set_apart(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element's content is no part of an article, whatever its text."""
    if tag in _DROP and not (tag == "header" and inside):
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    return bool(_HIDDEN.search(attributes)) or tag not in _TEXT and _names_it(attributes, inside)


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, without the elements that are set apart by tag, class, id or role.

    Open elements are kept as a stack: an end tag closes what is open inside its element, so an element that is never closed ends
    with its parent, and one that its like follows (a list item, a cell, a paragraph) ends there. A slash at the end of a tag means nothing.
    """
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[str] = []
    # how many elements are open around the one set apart; -1: none is
    apart, links, mains, marked, heading, at, end = -1, 0, 0, False, False, 0, len(page)

    def flush() -> None:
        if parts:
            texts = [(html.unescape(t), a) for t, a in parts]
            whole = " ".join("".join(t for t, _ in texts).split())
            if whole:
                out.append(Block(whole, sum(len("".join(t.split())) for t, a in texts if a), mains > 0, marked, heading))
            parts.clear()

    def close(to: int) -> None:
        nonlocal apart, mains
        if apart < 0:
            mains -= sum(t in _MAIN for t in stack[to:])
        del stack[to:]
        if len(stack) <= apart:
            apart = -1

    while at < end:
        m = _MARKUP.search(page, at)
        if apart < 0:
            piece = page[at : m.start() if m else end]
            if piece:
                parts.append((piece, links > 0))
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        closing, was = bool(m[1]), apart
        if tag in _RAW and not closing:
            ended = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = ended.end() if ended else end
            continue
        if tag in _BLOCK and apart < 0:
            flush()
            links, heading = 0, tag in _HEADINGS and not closing
            marked = tag in _TEXT and not closing and bool(m[3]) and _names_it(m[3], mains > 0)
        if closing:
            if tag in stack:
                close(len(stack) - 1 - stack[::-1].index(tag))
        elif tag not in _VOID:
            if tag in _MAIN and apart >= 0 and stack[apart] not in ("form", *_MAIN):
                close(apart)  # an element that was never closed ends where the article begins
            elif stack and (stack[-1] == tag and tag in _ENDS or stack[-1] == "p" and tag in _BLOCK):
                close(len(stack) - 1)
            if apart < 0 and _set_apart(tag, m[3], mains > 0):
                apart = len(stack)
            elif apart < 0 and tag in _MAIN:
                mains += 1
            stack.append(tag)
        if apart >= 0 or was >= 0:
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            parts.append((" ", links > 0))
    flush()
    return out


def _signed(b: Block) -> bool:
    """Whether a block outside of an article is short and has a copyright sign."""
    return not b.inside and len(b.text) < SURE and "©" in b.text


def _other_script(text: str) -> bool:
    """Whether most letters are none of the Latin script."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c > "\u024f" for c in letters) > len(letters)


def _in_listed_language(blocks: list[Block]) -> bool:
    words = [w for b in blocks if len(b.text) >= LONG and b.linked <= LINKS * len(b.text) for w in b.text.lower().split()]
    return sum(w in _STOP for w in words) >= LISTED * max(1, len(words))


def first_pass(blocks: list[Block]) -> list[int]:
    """Each block by its links, length and stop words: 1 good, 0 bad, -1 undecided. An article or main element is evidence for its blocks.

    Bad: blocks of links that follow each other like a menu, marked blocks without prose, and, outside of an article, blocks of links,
    shorter ones with a copyright sign, and long ones without stop words. Good: long blocks of an article, and long prose elsewhere. Stop
    words count only where the page is in a language of the lists, and not for a block in another script; else length and links decide.
    """
    listed = _in_listed_language(blocks)
    linked = [b.linked > LINKS * max(1, len(b.text)) and len(b.text) < LONG for b in blocks]
    runs, at = [0] * len(blocks), 0
    while at < len(blocks):
        end = at
        while end < len(blocks) and linked[end]:
            end += 1
        runs[at:end] = [end - at] * (end - at)
        at = max(end, at + 1)
    out = []
    for b, run in zip(blocks, runs, strict=True):
        length, words = len(b.text), b.text.lower().split()
        stops = sum(w in _STOP for w in words) / max(1, len(words))
        links = b.linked > LINKS * max(1, length)
        if run >= MENU or b.marked and (links or length < LONG or stops < STOPS_HIGH):
            out.append(0)
        elif b.inside:
            out.append(1 if length >= LONG and not links else -1)
        elif links or _signed(b):
            out.append(0)
        elif length < LONG:
            out.append(-1 if not b.linked else 0)
        elif not listed or _other_script(b.text):
            out.append(1 if length >= SURE else -1)
        else:
            out.append(1 if stops >= STOPS_HIGH and length >= SURE else -1 if stops >= STOPS_LOW else 0)
    return out


def labels_of(blocks: list[Block]) -> list[bool]:
    """The first pass's labels; undecided blocks take that of the nearest decided one, the good one of two, and good where no block is good.

    A heading begins a part of the page: it and undecided blocks after it do not look back over it, as long as a decided block
    follows. A bad block with a copyright sign says nothing of its neighbours.
    """
    first = first_pass(blocks)
    decided = [i for i, x in enumerate(first) if x > 0 or x == 0 and not _signed(blocks[i])]
    out, left, part, any_good = [], -1, 0, 1 in first
    for i, x in enumerate(first):
        while left + 1 < len(decided) and decided[left + 1] <= i:
            left += 1
        if blocks[i].heading:
            part = i
        if x < 0:
            before, after = decided[left : left + 1] if left >= 0 else [], decided[left + 1 : left + 2]
            near = after if after and before and before[0] < part else before + after
            least = min((abs(i - j) for j in near), default=0)
            x = max((first[j] for j in near if abs(i - j) == least), default=1) if any_good else 1
        out.append(bool(x))
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if any(b.inside for b in blocks):
        blocks = [b for b in blocks if b.inside]
    labels = labels_of(blocks)
    if blocks and blocks[0].inside and not any(labels):
        labels = [True] * len(blocks)  # an article is never emptied
    return "\n".join(b.text for b, good in zip(blocks, labels, strict=True) if good)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds `text`, the main text, to every row of `pages`; all other columns stay (one named text is replaced).

    The whole page is read. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go by their
    element, or by a class, id or role that says so and nothing else; so does what is hidden. If the page has an article or main
    element, only that counts. Of the blocks left, links, length and stop words decide the clear ones, on every page; unclear ones
    follow their nearest decided neighbour. In an article long blocks stay, so do single links, and no article is emptied.
    Character references are decoded, white space becomes one space, blocks are joined by a line feed. Null, empty or cut pages
    give what text they have (or ""); repeated rows give equal rows.
    """
    own = [c for c in pages.columns if c != "text"]

    def run(batches):
        for pdf in batches:
            yield pdf[own].assign(text=np.array([main_text(p) for p in pdf[html_col]], object) if len(pdf) else pd.Series([], dtype=object))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(own).schema)
    return pages.select(own).mapInPandas(run, f"{kinds}, text string")


def op9(spark, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
