"""Main text of web pages by two-pass block rules.

The page is read as a stream of tags and text. Block-level tags part the text into blocks; each block knows its length, its
share of link text, its share of stop words, whether it lies inside an article region (article or main elements, or what takes
their place), and whether it lies inside an element that is boilerplate by its kind, role, class or id (menus, page headers,
footers, sidebars, notices, adverts, forms, comments, hidden parts).

First pass, inside and outside regions alike: boilerplate and link-heavy blocks are bad; long blocks with enough stop words
are good; long blocks with almost none are bad, but undecided inside a region or if no block of the page has enough; the
rest (short blocks and headings) is undecided. If nothing is good, as on pages in a language without known stop words, length
and links decide: long blocks without many links are good, else those of medium length.

Second pass: an undecided block takes the label of the nearest decided block of the same region that is not boilerplate by
its element, a heading that of the next one; if the two sides are equally near and differ, its stop words decide. Only where a
region has no decided block at all does the region itself tell: an article's short blocks are good, others bad.

Defined results: null or empty html gives an empty text; broken markup is read as browsers do in the common cases (unclosed
paragraphs and list items end at the next block, an unclosed script, style or comment runs to the end; of other unread
elements that never close, only the tag goes); a quote opens a value only after an equals sign; the fallback of objects and
formulas count as text; pages of any length are read whole; rows are independent, so repeated rows, null ids and extra columns
change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

# Kinds of elements, and words of class, id and role that mark boilerplate.
#: What these hold is not read. Those of TO_THE_END hide everything that follows if they never close.
RAW = frozenset("script style noscript template title textarea svg iframe canvas noframes annotation annotation-xml".split())
TO_THE_END = frozenset("script style".split())
#: These can hold themselves.
NESTING = frozenset("svg template canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SELF_CLOSING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
BAD_KINDS = frozenset("nav footer aside form button select dialog menu head".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup signin login paywall nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "sidebar widget widgets footer masthead topbar toolbar comment comments respond replies disqus discussion share sharing social related recommended "
    "recommendations trending outbrain taboola".split()
)
HEADER_WORDS = frozenset("header heading-bar siteheader".split())
REGION_NAMES = frozenset("article-body article-content article-text articlebody post-content post-body entry-content story-body main-content content-main".split())
#: Frequent function words of English, French, German and Spanish; callers can pass others.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les mais ne nous on ou par pas pour que qui sa se son sur un une vous "
    "als auch auf aus bei das dass dem den der die ein eine er es für ich im ist mit nach nicht sich sie sind so und von war wie zu zum "
    "al como con del el ella ellos era esta este fue ha las lo los más muy no para pero por sin sobre su sus una y".split()
)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
SPACES = re.compile(r"\s+")
#: The least share of link text of a bad block, and the least lengths of long and medium blocks.
LINKS, LONG, MEDIUM = 0.5, 140, 70
#: Shares of stop words: of a good long block, of a good medium one, of ordinary prose at least, and what settles a tie.
DENSE_LONG, DENSE_MEDIUM, SPARSE, DENSE_TIE = 0.1, 0.2, 0.05, 0.15


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    bad: bool
    region: int


def _marks(kind: str, rest: str, inside_region: bool) -> tuple[bool, bool]:
    """(boilerplate, region) of an opening tag."""
    if kind in ("article", "main"):
        words = _names(rest) if rest else []
        return bool(_plain_words(words) & {"comment", "comments", "related", "ad", "ads"}), True
    bad = kind in BAD_KINDS or (kind == "header" and not inside_region)
    region = False
    if "=" in rest or "hidden" in rest:
        if HIDDEN.search(rest):
            bad = True
        if kind not in ("html", "body"):
            names = _names(rest)
            words = _plain_words(names)
            bad = bad or bool(words & BAD_WORDS) or (not inside_region and bool(words & HEADER_WORDS))
            region = not bad and any(n in REGION_NAMES for n in names)
            role = next((_value(m) for m in ATTRIBUTE.finditer(rest) if m[1].lower() == "role"), "").lower()
            bad = bad or role in BAD_ROLES
            region = region or role in ("main", "article")
    return bad, region


def _value(m: re.Match) -> str:
    return m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]


def _names(rest: str) -> list[str]:
    return [n for m in ATTRIBUTE.finditer(rest) if m[1].lower() in ("class", "id") for n in _value(m).lower().split()]


def _plain_words(names: list[str]) -> set[str]:
    """The words of class and id names; names that only tell what a page has or lacks are left out."""
    return {w for n in names if not re.match(r"(no|has|have|with|without|is)[-_]", n) for w in (n, *re.split(r"[-_]+", n))}


def _after(page: str, kind: str, at: int) -> int:
    """Where the unread element of that kind ends whose opening tag ends at `at`."""
    if kind not in _ends:
        _ends[kind] = re.compile(f"<(/?){kind}(?=[\\s/>]|\\Z)", re.I)
    depth, pos = 1, at
    while depth:
        tag = _ends[kind].search(page, pos)
        if not tag:
            return len(page) if kind in TO_THE_END else at
        pos = tag.end()
        depth += -1 if tag[1] else 1 if kind in NESTING else 0
    tail = page.find(">", pos)
    return tail + 1 if tail >= 0 else len(page)


_ends: dict[str, re.Pattern] = {}


def read_blocks(page: str) -> list[Block]:
    """The page's blocks in order, empty ones left out."""
    blocks: list[Block] = []
    parts: list[str] = []
    linked = [0]
    open_kinds: Counter[str] = Counter()
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # kind, inside boilerplate, number of the region
    regions = 0

    def end_block() -> None:
        text = SPACES.sub(" ", "".join(parts)).strip()
        if text:
            kind, bad, region = stack[-1]
            blocks.append(Block(text, linked[0], any(open_kinds[h] for h in HEADING), bad, region))
        parts.clear()
        linked[0] = 0

    def pop_to(kind: str) -> None:
        while True:
            top = stack.pop()[0]
            open_kinds[top] -= 1
            if top == kind:
                return

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        upto = m.start() if m else end
        if upto > at:
            text = html.unescape(page[at:upto])
            parts.append(text)
            if open_kinds["a"]:
                linked[0] += len(SPACES.sub(" ", text).strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        kind = m[2].lower()
        if m[1]:
            if kind in BLOCK:
                end_block()
            elif kind == "br":
                parts.append(" ")
            if open_kinds[kind]:
                pop_to(kind)
            continue
        if kind in RAW:
            if not m[3].endswith("/") or kind in ("script", "style", "title", "textarea"):
                at = _after(page, kind, at)
            continue
        if kind in BLOCK:
            end_block()
            if open_kinds["p"]:
                pop_to("p")
            if kind in HEADING:
                for other in HEADING:
                    if open_kinds[other]:
                        pop_to(other)
        elif kind == "br":
            parts.append(" ")
        elif kind == "a" and open_kinds["a"]:
            pop_to("a")
        if kind in VOID:
            continue
        if kind in SELF_CLOSING and open_kinds[kind]:
            depth = len(stack) - 1
            while stack[depth][0] != kind and stack[depth][0] not in SELF_CLOSING[kind]:
                depth -= 1
            if stack[depth][0] == kind:
                pop_to(kind)
        _, bad, region = stack[-1]
        own_bad, own_region = _marks(kind, m[3], region > 0)
        if own_region and not own_bad and bad and kind in ("article", "main") and not (open_kinds["aside"] or open_kinds["footer"]):
            bad = False  # an unclosed notice, advert or page-wide form before the article
        if own_region and not region:
            regions += 1
            region = regions
        stack.append((kind, bad or own_bad, region))
        open_kinds[kind] += 1
    end_block()
    return blocks


def first_pass(blocks: list[Block], density: list[float]) -> list[bool | None]:
    """Good, bad or undecided (None) by density, length and links alone."""

    def links(b: Block) -> bool:
        return b.bad or b.link_chars > LINKS * len(b.text)

    def dense(b: Block, share: float) -> bool:
        return not b.heading and ((len(b.text) >= LONG and share >= DENSE_LONG) or (len(b.text) >= MEDIUM and share >= DENSE_MEDIUM))

    out: list[bool | None] = [False if links(b) else True if dense(b, s) else None for b, s in zip(blocks, density)]
    if True in out:
        for k, b in enumerate(blocks):
            if out[k] is None and not b.heading and len(b.text) >= MEDIUM and density[k] < SPARSE and not b.region:
                out[k] = False
        return out
    for least in (LONG, MEDIUM):  # no stop words known here
        for k, b in enumerate(blocks):
            if out[k] is None and not b.heading and len(b.text) >= least:
                out[k] = True
        if True in out:
            break
    return out


def classify(blocks: list[Block], stop_words: frozenset[str] = STOP_WORDS) -> list[bool]:
    """Which blocks belong to the main text."""
    density = []
    for b in blocks:
        words = b.text.lower().split()
        density.append(sum(w.strip(".,;:!?()\"'*#$%&|") in stop_words for w in words) / len(words))
    good = first_pass(blocks, density)
    #: Neighbours count inside the same region; what boilerplate elements hold is no neighbour.
    before: list[tuple[int, bool] | None] = []
    last: dict[int, tuple[int, bool]] = {}
    for k, b in enumerate(blocks):
        before.append(last.get(b.region))
        if good[k] is not None and not b.bad:
            last[b.region] = (k, good[k])
    after: list[tuple[int, bool] | None] = []
    last = {}
    for k in range(len(blocks) - 1, -1, -1):
        after.append(last.get(blocks[k].region))
        if good[k] is not None and not blocks[k].bad:
            last[blocks[k].region] = (k, good[k])
    after.reverse()
    out = []
    for k, (b, g) in enumerate(zip(blocks, good)):
        if g is None:
            x, y = before[k], after[k]
            if not x and not y:
                g = b.region > 0
            elif b.heading and y:
                g = y[1]
            elif not x or not y:
                g = (x or y)[1]
            elif k - x[0] != y[0] - k:
                g = x[1] if k - x[0] < y[0] - k else y[1]
            else:
                g = x[1] if x[1] == y[1] else density[k] >= DENSE_TIE
        out.append(g)
    return out


def main_text(page: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    blocks = read_blocks(page or "")
    return "\n\n".join(b.text for b, g in zip(blocks, classify(blocks, stop_words)) if g)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = (), stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """Per row: the id column, the columns in `carry`, text and n_chars (code points)."""
    names = [f"_c{k}" for k in range(len(carry) + 1)]
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip((id_col, *carry), names)], F.col(f"`{html_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = [main_text(p, stop_words) for p in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long").toDF(id_col, *carry, "text", "n_chars")
