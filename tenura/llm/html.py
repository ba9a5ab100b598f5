"""Main text of web pages by block rules in two passes.

A page is cut at block tags. Each block has its words, its stop words, the share of its characters
inside links, and the containers around it. Pass one decides what is plain: blocks inside menus,
footers, adverts, forms, comments and the like, and link-dense blocks are bad; long blocks with many
stop words are good; long ones with links and hardly any are bad. Pass two lets every other block, mostly short
ones, inherit the label of the nearest block that was decided by its text. If the page marks its
article (article, main, or a content container), blocks outside are bad, and inside it a long block
without stop words (tables, code, shouting) is ambiguous rather than bad.

Text: character references decoded, white space inside a block one space, trimmed, blocks in page
order joined by one line feed; nothing is cut. Defined cases: null and empty pages give an empty text
and 0 characters; a page without any decided block is taken whole; unclosed tags end with their
container.
"""

from __future__ import annotations

import html
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.texts import clear_of, small_batches

LONG_WORDS = 10
STOPWORDS_HIGH, STOPWORDS_LOW = 0.2, 0.08
LINK_DENSITY = 0.5

# Common function words; fixed values.
STOPWORDS = frozenset(
    """
    a about after all an and are as at be been but by can for from had has have he her his if in into is it its
    not of on or our she so that the their them there they this to was we were which who will with you your
    aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für hat
    ich im ist mit nach nicht noch nur oder sich sie sind über um und uns von vor war was wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de du elle en est et il ils la le les leur mais ne nous ou par pas plus
    pour qu que qui sa se ses son sont sur un une vous
    al como con cuando del desde donde el ella ellos era eran esta este esto fue ha hay las lo los más me mi muy no
    para pero por porque se ser si sin sobre su sus también todo una uno unos y ya
    """.split()
)

BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary
    table tbody td tfoot th thead tr ul""".split()
)
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table td ul button select".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BOILERPLATE = frozenset("nav footer aside form header menu dialog button select noscript template svg math object audio video canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
HINTS = frozenset(
    """ad ads adv adsense cookies cookie consent gdpr notice notices masthead topbar toolbar login signin signup
    search reply replies respond disqus legal copyright disclaimer skip pager byline tags share sharing""".split()
)
HINT_STARTS = ("nav", "menu", "breadcrumb", "footer", "sidebar", "widget", "cookie", "banner", "advert", "sponsor", "promo",
               "newsletter", "subscri", "popup", "modal", "comment", "discussion", "social", "related", "recommend", "paginat")
CONTENT = frozenset("content article post entry main story".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)> | <(/?)([a-zA-Z][^\s/>]*)([^>]*+)> | <[!?][^>]*+>""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
TARGET = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
EDGES = string.punctuation + "«»“”„‘’…–—¿¡·•"


FIRM = frozenset("cookies cookie consent gdpr reply replies respond disqus".split())  # may hold most of a page's text
FIRM_STARTS = ("comment", "discussion", "cookie")

HEADER, BAD = 1, 2  # of a header only headings may stay


def traits(tag: str, attributes: str) -> tuple[int, int, bool, bool]:
    """How far a container is boilerplate, how far its names or its being a form hint so, whether these names
    are of comments or dialogs, and whether its names say that it holds the content.
    """
    bad, content, header = tag in BOILERPLATE and tag not in ("header", "form"), False, False
    hint, firm = tag == "form", False
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                bad |= value.lower() in ROLES
                content |= value.lower() == "main"
            elif name == "style":
                bad |= "display:none" in value.replace(" ", "").lower()
            elif name in ("hidden", "aria-hidden"):
                bad |= value.lower() != "false"
            else:
                words = {w.lower() for w in PARTS.findall(value)}
                header |= "header" in words and tag not in ("body", "html", "main", "article")
                said = any(w in HINTS or w.startswith(HINT_STARTS) for w in words - {"header"})
                if tag == "article":
                    said = any(w.startswith("comment") or w in ("reply", "ad", "advert") for w in words)
                hint |= said and tag not in ("body", "html", "main")
                firm |= said and any(w in FIRM or w.startswith(FIRM_STARTS) for w in words)
                content |= bool(words & CONTENT)
    return (BAD if bad else HEADER if tag == "header" else 0), (BAD if hint else HEADER if header else 0), firm, content


class Hint:
    """A container with a hint: how far it is boilerplate unless it holds most of the text."""

    __slots__ = ("level", "firm", "titled")

    def __init__(self, level: int, firm: bool) -> None:
        self.level, self.firm, self.titled = level, firm, False


class Block:
    __slots__ = ("text", "linked", "hard", "hints", "marks", "heading", "words", "density", "label")

    def __init__(self, text: str, linked: int, hard: int, hints: tuple[Hint, ...], marks: int, heading: bool) -> None:
        self.text, self.linked, self.hard, self.hints, self.marks, self.heading, self.label = text, linked, hard, hints, marks, heading, None
        words = text.lower().split()
        self.words = len(words)
        self.density = sum(map(is_stopword, words)) / len(words) if len(words) >= LONG_WORDS else 0.0

    @property
    def good(self) -> int:
        """Its characters, if it is good by its text."""
        return len(self.text) if self.density >= STOPWORDS_HIGH and self.linked <= LINK_DENSITY * len(self.text) else 0

    def bad(self, level: int) -> bool:
        """Whether it goes as part of boilerplate of that level; a title in a header of the content stays."""
        return level == BAD or (level == HEADER and not (self.heading and self.marks))


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, tuple[Hint, ...], int]] = []  # tag, how far inside boilerplate, hints and content marks around (bit k: rank k)
    text: list[str] = []
    linked = at = depth_links = link_depth = block_number = 0
    link_block = -1
    heading = first = False
    low = None

    def close() -> None:
        nonlocal linked
        if text:
            # tag boundaries inside a block do not part words, so the pieces are joined before decoding
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                hard, hints, marks = stack[-1][1:] if stack else (0, (), 0)
                out.append(Block(whole, linked, hard, hints, marks, heading))
                if first:
                    for hint in hints:
                        hint.titled = True
            text.clear()
        linked = 0

    while True:
        found = TOKEN.search(page, at)
        piece = page[at : found.start() if found else len(page)]
        if piece:
            text.append(piece)
            if depth_links:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        end, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not end:
            low = page.lower() if low is None else low
            stop = low.find(f"</{tag}", at) if len(low) == len(page) else re.compile(f"</{tag}", re.I).search(page, at)
            stop = stop if isinstance(stop, int) else (stop.start() if stop else -1)
            at = len(page) if stop < 0 else stop
            text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            close()
            heading = tag in HEADINGS and not end
            first = tag == "h1" and not end
            if end and link_block == block_number:  # the link was left open inside the block that ends
                depth_links = 0
            block_number += 1
        if tag == "a":  # an anchor without a target is no link; a link ends at the next anchor at the latest
            depth_links = 0 if end or not TARGET.search(attributes) else 1
            link_depth, link_block = len(stack), block_number
        if tag in CONTAINERS or tag in BOILERPLATE:
            if tag in BOILERPLATE and tag not in BLOCKS:
                close()
            if end:
                names = [entry[0] for entry in stack]
                if tag in names:
                    del stack[len(names) - 1 - names[::-1].index(tag) :]
                    if len(stack) < link_depth:  # the container of an open link ends
                        depth_links = 0
            elif not attributes.endswith("/"):
                bad, said, firm, content = traits(tag, attributes)
                _, hard, hints, marks = stack[-1] if stack else ("", 0, (), 0)
                if tag == "main":
                    hints = ()
                if said:
                    hints = (*hints, Hint(said, firm))
                rank = 0 if bad or said else 3 if tag == "article" else 2 if tag == "main" else 1 if content else 0
                stack.append((tag, max(bad, hard), hints, marks | (1 << rank if rank else 0)))
    close()
    return out


def is_stopword(word: str) -> bool:
    return word in STOPWORDS or word.strip(EDGES) in STOPWORDS


def without_boilerplate(blocks: list[Block], every: bool = False) -> list[Block]:
    """The blocks that are in no boilerplate. `every`: all hints are judged, by the text outside links."""
    open_to = [b for b in blocks if not b.bad(b.hard)]
    size = (lambda b: max(0, len(b.text) - b.linked)) if every else (lambda b: b.good)
    total = marked = 0
    held: dict[Hint, list[int]] = {}
    for b in open_to:
        n = size(b)
        own = n if b.marks else 0
        total, marked = total + n, marked + own
        for h in b.hints:
            of = held.setdefault(h, [0, 0])
            of[0], of[1] = of[0] + n, of[1] + own
    lost = {h for h, (n, own) in held.items() if 2 * n > total and 2 * (marked - own) <= n and (every or not h.firm or h.titled)}
    return [b for b in open_to if not b.bad(max((h.level for h in b.hints if h not in lost), default=0))]


def region_of(blocks: list[Block]) -> tuple[int, list[Block]]:
    """The strongest mark with no more good text outside its blocks than text inside, and its blocks; 0 and all if none is so."""
    total = sum(b.good for b in blocks)
    for rank in (3, 2, 1):
        inside = [b for b in blocks if b.marks >> rank & 1]
        if inside and sum(max(0, len(b.text) - b.linked) + b.good for b in inside) >= total:
            return rank, inside
    return 0, blocks


def classify(blocks: list[Block]) -> list[Block]:
    """The good blocks."""
    rank, inside = region_of(without_boilerplate(blocks) or without_boilerplate(blocks, every=True))
    for b in inside:
        if b.linked > LINK_DENSITY * len(b.text):
            # a sentence of a marked article that is one link goes with its neighbours
            b.label = None if rank and b.words >= LONG_WORDS and b.density >= STOPWORDS_HIGH else False
        elif b.words >= LONG_WORDS:
            if b.density >= STOPWORDS_HIGH:
                b.label = True
            elif b.density < STOPWORDS_LOW and b.linked and not rank:
                b.label = False
        elif not rank and b.text.startswith(("©", "Copyright")):
            b.label = False
    decided = [i for i, b in enumerate(inside) if b.label is not None]
    if not decided:
        return inside
    good, k = [], 0
    for i, b in enumerate(inside):
        if b.label is None:
            # at equal distance a heading goes with what follows, any other block with what precedes
            while k + 1 < len(decided) and abs(decided[k + 1] - i) < abs(decided[k] - i) + b.heading:
                k += 1
            if inside[decided[k]].label:
                good.append(b)
        elif b.label:
            good.append(b)
    return good or [b for b in inside if b.density >= STOPWORDS_HIGH]  # running text is never all lost


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in classify(blocks_of(page))) if page else ""


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """The rows of `pages` without `page`, with text and n_chars added (input columns of those names get `_input`)."""
    others = [c for c in pages.columns if c != page]
    names = clear_of(others, {"text", "n_chars"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [main_text(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*names, "text", "n_chars"],
            )

    rows = pages.select(F.col(page), *(F.col(c).alias(a) for c, a in zip(others, names)))
    return rows.mapInArrow(run, rows.select(*names, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)
