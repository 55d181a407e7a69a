"""Main text of HTML pages by two passes of block rules.

The page is cut into blocks at block-level tags. The first pass looks at each block alone: where it
stands (inside a menu, header, footer, sidebar, form, notice, advert or comment list: out), its
share of link text, its length and its density of stop words. Blocks that this leaves undecided, the
short ones above all, take the label of their nearest decided neighbours in the second pass.

The page's own markup is one more sign, weighed by these rules: an article element vouches for its blocks
if the first pass finds prose in it, and then links and shortness make none of them bad; one without prose beside
others with it, a teaser, is out, and where most prose stands outside of all articles they vouch for nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import prepare, table

#: Elements whose content is no text, and elements that begin and end a block.
SILENT = frozenset("script style noscript template svg math iframe object embed canvas audio video select option datalist button textarea head title".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold what is written: their short blocks need less to be taken for text.
WRITTEN = frozenset("p li dd dt td th pre blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Of RAW, the ones that "/>" does not close, and whose text is lost where the end tag is missing.
OPEN = frozenset("script style textarea title".split())
#: Words of class, id or role that mark boilerplate if a name ends in one, but for words that only say what kind of box it is.
BOXES = frozenset("""area articles bar block body bottom box button buttons card center col column container content desktop group holder icons inner item items left link links list main
mobile module outer panel posts reading right row section slot stories text top unit wrap wrapper zone""".split())
MARKS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs
sidebar aside footer header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share sharing social related recommended
comment comments reply replies disqus discussion login search pagination pager toolbar widget complementary contentinfo dialog legal copyright disclaimer""".split())
#: Of these, the ones that a part of an article may bear, and the ones that even an article element may not.
HEADS, NEVER = frozenset("header masthead banner".split()), frozenset("ad ads advert sponsored promo comment comments reply replies related recommended teaser".split())
#: Frequent function words of the languages at hand: their density tells prose from lists of names.
STOP_WORDS = frozenset("""the of and to in a is that it for on with as was be by this are from or an at not have but they his her you we which
der die das und ist in zu den mit von für auf nicht ein eine im dem des sich auch als an wie bei oder aus
le la les de des et en un une du que qui dans pour par sur est pas au avec plus ce ne se son
el los las de y en un una que por con para del se no es lo como más su al o""".split())
#: Lengths in characters, densities as shares.
SHORT, LONG, LINKS, STOPS_LOW, STOPS_HIGH = 70, 200, 0.33, 0.15, 0.25

#: A quote in a tag that is closed nowhere sensible does not hide what follows: the tag ends at the first ">".
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"<]*+"|'[^'<]*+'|"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""".replace("\n", ""), re.S)
#: Ends what an inline silent element may hide: its own end tag or any block-level tag.
HIDDEN = {t: re.compile(rf"</{t}\s*>|</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I) for t in SILENT - RAW - VOID - BLOCK}
NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


@dataclass
class Block:
    """A stretch of text between two block-level tags."""

    text: str
    linked: int
    inside: bool
    outside: bool
    heading: bool
    fixed: bool = False  #: outside for another reason than the marked elements around it
    cut: int = -1  #: the innermost marked element around it
    article: int = -1  #: the innermost article element around it
    written: bool = False  #: in a paragraph, a list, a cell or a heading
    label: str = ""


@dataclass
class Cut:
    """An element that a name mark or a form cuts: its place in the page and the next such element around it."""

    at: int
    around: int


def marked(attributes: str, marks: frozenset[str]) -> bool:
    """A class, id or role ends in one of the marks, words for boxes aside."""
    for m in NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split() if m[1].lower() != "itemprop" else ():
            parts = [p.lower() for p in PARTS.findall(name)]
            while len(parts) > 1 and parts[-1] in BOXES:
                parts.pop()
            if parts and parts[-1] in marks:
                return True
    return False


def blocks_of(page: str, released: frozenset[int] = frozenset()) -> tuple[list[Block], list[Cut]]:
    """The blocks of a page in order, with white space folded and empty ones left out, and the marked elements.

    A name mark or a form cuts what its element holds, unless the element is released.
    """
    out: list[Block] = []
    made: list[Cut] = []
    # tag, inside an article, outside the main text, innermost marked element, whether one cuts, innermost article, whether it is written
    stack: list[tuple[str, bool, bool, int, bool, int, bool]] = []
    ground = ("", False, False, -1, False, -1, False)
    open_tags: Counter[str] = Counter()
    endless: set[str] = set()
    text: list[str] = []
    linked, links, at, heading = 0, 0, 0, False

    def flush() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            _, inside, outside, cut, cuts, part, written = stack[-1] if stack else ground
            out.append(Block(joined, linked, inside, outside or cuts, heading, outside, cut, part, written))
        text.clear()
        linked = 0

    while True:
        m = TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            if links:
                linked += len(" ".join(html.unescape(piece).split()))
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = (tag or "").lower()
        if not tag:
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK or open_tags[tag]:
                if tag in BLOCK:
                    flush()
                    links = 0
                if open_tags[tag]:
                    if tag not in BLOCK:
                        flush()
                    while True:
                        last = stack.pop()[0]
                        open_tags[last] -= 1
                        if last == tag:
                            break
                heading = heading and not (len(tag) == 2 and tag[0] == "h")
            continue
        alone = attributes.rstrip().endswith("/")
        if tag in RAW and not (alone and tag not in OPEN):
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(tag)
                at = len(page) if tag in OPEN else at
            continue
        if tag in HIDDEN and not alone and tag not in endless:
            end = HIDDEN[tag].search(page, at)
            if end and end[0][2:].rstrip("> \t\n\r\f").lower() == tag and end[0][1] == "/":
                at = end.end()  # the text around it stays one block
                continue
            if not end:
                endless.add(tag)
        if tag in BLOCK or tag in SILENT:
            flush()
        if tag in BLOCK:
            links = 0
        if tag == "a":
            links += 1
        if tag in VOID or alone:
            continue
        _, inside, outside, cut, cuts, part, written = stack[-1] if stack else ground
        whole = tag in ("html", "body", "article", "main")
        named = bool(attributes) and marked(attributes, NEVER if whole else MARKS - HEADS if inside else MARKS)
        article = tag in ("article", "main") or bool(re.search(r"articleBody", attributes))
        if tag in BLOCK or tag in SILENT or named:
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
                open_tags["p"] -= 1
                _, inside, outside, cut, cuts, part, written = stack[-1] if stack else ground
            out_now = outside or (tag in OUTSIDE and tag != "form") or tag in SILENT or (named and tag in ("article", "main")) or (tag == "header" and not inside)
            if named and tag not in BLOCK:
                flush()
            if named and not whole or tag == "form":
                made.append(Cut(m.start(), cut))
                cut, cuts = len(made) - 1, cuts or m.start() not in released
            stack.append((tag, inside or article, out_now, cut, cuts, m.start() if tag == "article" else part, tag in WRITTEN if tag in BLOCK else written))
            open_tags[tag] += 1
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            heading = True
    flush()
    return out, made


def first_pass(b: Block) -> str:
    """good, bad, near (good if near good) or short, from the block alone. A long block with few stop words and few links tells nothing: a table, or another language."""
    if b.outside or b.linked > LINKS * len(b.text):
        return "bad"
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / len(words)
    if b.text[0] in "©&" or b.text.lower().startswith("copyright"):
        return "bad"
    if len(b.text) < SHORT:
        return "short"
    if stops >= STOPS_HIGH:
        return "good" if len(b.text) > LONG else "near"
    return "near" if stops >= STOPS_LOW else "short"


def vouched(blocks: list[Block]) -> list[Block]:
    """The blocks to go on with: those that an article with prose vouches for, else all.

    Of such blocks bad ones are undecided again unless the markup cuts them. Articles without prose, beside one with it, are teasers.
    """
    prose: Counter[int] = Counter()
    for b in blocks:
        if not b.outside:
            prose[b.article if b.inside else -2] += len(b.text) * (b.label in ("good", "near"))
    inside = [b for b in blocks if b.inside and not b.outside]
    told = sum(n for k, n in prose.items() if k != -2)
    if not inside or told < prose[-2]:
        return blocks
    kept = [b for b in blocks if b.inside and (b.article < 0 or not told or prose[b.article])]
    for b in kept:
        if not b.outside and b.label == "bad":
            b.label = "short"
    return kept


def second_pass(blocks: list[Block]) -> None:
    """Undecided blocks inherit from the nearest decided neighbours; headings from what follows; of two as near the good one counts.

    What the markup cuts is no neighbour. Where a page has nothing decided, nothing speaks against a block. A
    short block that stands in no paragraph, list, cell or heading needs good neighbours on both sides.
    """
    n, ends = len(blocks), []
    for order in (range(n), range(n - 1, -1, -1)):
        label, at, seen = "", -1, [("", n)] * n
        for i in order:
            seen[i] = (label, abs(i - at) if label else n)
            if blocks[i].label in ("good", "bad") and not blocks[i].outside:
                label, at = blocks[i].label, i
        ends.append(seen)
    for i, (b, before, after) in enumerate(zip(blocks, *ends, strict=True)):
        if b.label in ("good", "bad"):
            continue
        near = {before[0], after[0]} - {""}
        if b.label == "short" and not b.inside and not b.written:
            b.label = "good" if before[0] == after[0] == "good" else "bad"
        elif len(near) < 2:
            b.label = "bad" if near == {"bad"} and not b.inside else "good"
        elif b.inside or b.label == "near" or b.heading and after[0] == "good":
            b.label = "good"
        else:
            b.label = min(before, after, key=lambda x: (x[1], x[0] != "good"))[0]


def kept_text(blocks: list[Block], foreign: bool = False) -> str:
    """The good blocks, one space between them. With foreign, long blocks with few links need no stop words."""
    for b in blocks:
        b.label = first_pass(b)
        if foreign and len(b.text) > LONG and not b.outside and b.linked <= LINKS * len(b.text):
            b.label = "good"
    blocks = vouched(blocks)
    second_pass(blocks)
    return " ".join(b.text for b in blocks if b.label == "good")


def wrappers(blocks: list[Block], made: list[Cut]) -> frozenset[int]:
    """Places of the marked elements that hold an article or most of the prose that nothing else cuts."""
    prose = [b for b in blocks if not b.fixed and b.linked <= LINKS * len(b.text)]
    held, inside = [0] * len(made), [False] * len(made)
    for b in prose:
        if b.cut >= 0:
            held[b.cut] += len(b.text)
            inside[b.cut] |= b.inside
    for k in range(len(made) - 1, -1, -1):
        if made[k].around >= 0:
            held[made[k].around] += held[k]
            inside[made[k].around] |= inside[k]
    total = sum(len(b.text) for b in prose)
    around = {c.at for c, x in zip(made, inside, strict=True) if x}
    return frozenset(around or {c.at for c, n in zip(made, held, strict=True) if 2 * n > total})


def main_text(page: str | None) -> str:
    """The article's text: good blocks in page order, one space between them.

    Where that leaves nothing, the marked elements that wrap the content cut no more, and where the
    page's stop words fit no listed language its long blocks are judged by length and links.
    """
    blocks, made = blocks_of(page or "")
    text = kept_text(blocks)
    if text:
        return text
    released = wrappers(blocks, made)
    if released:
        blocks, _ = blocks_of(page or "", released)
        text = kept_text(blocks)
    return text or kept_text(blocks, foreign=True)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty page has an empty text. Where articles hold most of a page's prose, blocks outside them
    are not considered. Rows stay as they are, repeated ones and ones without id or url too; other
    columns are ignored, whatever their names. Empty in, empty out.
    """
    prepare(pages.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return plain.mapInArrow(each, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
