"""HTML extraction (1): two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides by length, link density and stop-word density and
leaves short and wordless blocks open. The second pass gives each open block the label of its nearest decided neighbours.
Names are priors: an article or main element makes the first pass milder and keeps neighbours to itself, and an element
that names itself as something that may be boilerplate counts as such where the page has an article. Only parts that no
text density can tell from an article, such as comments, adverts and menus, are left out by name. A page whose words are of none of
the stop-word languages is judged by length and link density alone.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their part in a page.
RAW = "script style noscript template svg math iframe object canvas audio video select textarea title"
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset label input".split())
MAIN = frozenset(("article", "main"))
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Closed by the next of their kind or never: not kept on the stack.
LOOSE = frozenset("p li dt dd option tr td th thead tbody tfoot h1 h2 h3 h4 h5 h6".split())
#: Names of parts that are left out. Only a whole name of a class, an id or a role says so, besides PLACES before and FORMS
#: after it: names such as has-sidebar or no-comments are those of the whole page. Inside an article ids count for div only,
#: as headings and sections have ids made of their titles.
KINDS = frozenset(
    "ad ads ad-box adbox ad-slot adslot ad-unit adunit ad-container ad-wrapper ad-banner advert adverts advertisement advertising adsbygoogle outbrain taboola sponsor sponsored "
    "promo promotion promo-box nav navbar navigation menu menubar main-menu breadcrumb breadcrumbs pagination pager sidebar left-sidebar right-sidebar footer toolbar skip-link "
    "share sharing share-bar share-buttons share-links social-share social-links social-icons social-media-links related-posts related-articles related-links related-stories recommended-posts "
    "comments comment-list commentlist comments-area comment-section disqus disqus-thread respond replies cookie-banner cookie-notice cookie-consent consent gdpr popup modal overlay "
    "newsletter newsletter-signup subscribe subscription signup searchform search-form complementary contentinfo dialog".split()
)
PLACES = frozenset("reader user site page main top bottom left right primary secondary global post entry article blog sub mobile desktop js".split())
FORMS = frozenset("box bar block area section list items links slot unit panel top bottom left right inner outer".split())
#: Names that count within compounds: of these, KINDS, PLACES, FORMS and COMPANY alone a name is made that says so.
SURE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies newsletter breadcrumb breadcrumbs widget related recommended".split())
COMPANY = frozenset("banner notice message law info policy settings preferences warning alert label form modal popup consent code zone space holder placeholder google dfp posts articles stories more read".split())
#: Roles of elements that are no text, wherever they stand.
ROLES = frozenset("alert alertdialog complementary contentinfo dialog menu menubar navigation search status toolbar".split())
LAYOUT = frozenset("no not has with without open closed free wrap wrapper layout page content story enabled by".split())
#: Names that may be boilerplate outside an article, and may be subjects.
WEAK = frozenset("widget related recommended discussion legal social search side foot alert notice notices banner reply respond masthead topbar copyright disclaimer skip login".split())
#: Names of page headers; inside an article they may hold its title.
HEADER = re.compile(r"(?:^|\s)(?:site-|main-|top-|global-|app-|blog-)?header(?:$|\s)")
#: Names of single reader comments, which may be article elements.
READER = re.compile(r"(?:^|\s)(?:comment|reply)(?:-(?:body|item|content|text|\d+))?(?:$|\s)")
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can could for from had has have he her his if in into is it its more not of on one or other our she so than that the their them there they this to was we were what when which who will with would you your "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer eines er es für hat ich ihr im in ist mit nach nicht nur oder sich sie sind so über um und von vor war wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour plus qu que qui sa se ses son sont sur un une vous y "
    "al como con cual de del desde donde el ella ellos en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también tiene un una y ya".split()
)
SHORT, LONG = 70, 200
#: Link density: most of a text, and of one in an article. Stop-word density: least of a text that may be one (in an
#: article: that is one), of a long text, of any.
LINKS_MOST, LINKS_MOST_MAIN, STOPS_LEAST, STOPS_LONG, STOPS_ANY = 0.33, 0.8, 0.15, 0.30, 0.32
#: A page with fewer stop words among those outside links is in another language.
STOPS_LANGUAGE = 0.05

_ATTRIBUTE = r"""[^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<(?P<raw>{RAW.replace(' ', '|')})\b{_ATTRIBUTE}(?:/>|>.*?(?:</(?P=raw)\s*>|$))"
    rf"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attr>{_ATTRIBUTE})>|<(?P<close2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?=[\s/>])[^<>]*>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.I | re.S,
)
_NAME = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"""\bhidden(?=[\s=>/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_LINK_START, _LINK_END = re.compile(r"<a(?=[\s>])", re.I), re.compile(r"</a(?=[\s>])", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    #: Signs within links, without spaces.
    linked: int = 0
    #: Number of the article or main element around it; 0: none.
    main: int = 0
    #: What names say: 0 nothing, 1 perhaps boilerplate, 2 left out.
    bad: int = 0
    heading: bool = False
    text: str = ""


def _is_kind(name: str) -> bool:
    if name in KINDS:
        return True
    parts = name.split("-")
    if not LAYOUT.isdisjoint(parts):
        return False
    known = [p for p in parts if p in SURE or p in KINDS]
    if known and all(p in SURE or p in KINDS or p in PLACES or p in FORMS or p in COMPANY or p.isdigit() for p in parts):
        return len(parts) > 1 or name not in WEAK
    while len(parts) > 1 and parts[0] in PLACES:
        parts = parts[1:]
    while len(parts) > 1 and (parts[-1] in FORMS or parts[-1].isdigit()):
        parts = parts[:-1]
    return "-".join(parts) in KINDS


def named_bad(tag: str, attr: str, in_main: bool) -> int:
    """0, 1 or 2: what the element's names say of its content, as in Block.bad."""
    if tag in BOILERPLATE or (tag == "header" and not in_main):
        return 2
    if tag in ("html", "body") or not attr:
        return 0
    named = []
    for m in _NAME.findall(attr):
        value = _CAMEL.sub("-", "".join(m[1:])).lower().replace("_", "-")
        kind = m[0].lower()
        named += [(kind, x) for x in (["-".join(value.split())] if kind == "aria-label" else value.split())]
    if tag in MAIN:
        return 2 * any(READER.search(x) for _, x in named)
    if _HIDDEN.search(attr) or any(kind == "role" and x in ROLES for kind, x in named):
        return 2
    if in_main:  # ids of one word may be made of a section's title
        return 2 * any(_is_kind(x) for kind, x in named if kind in ("class", "role") or (kind == "id" and (tag == "div" or (tag == "section" and "-" in x))))
    if any(_is_kind(x) or HEADER.search(x) for _, x in named):
        return 2
    return int(any(x in WEAK for _, x in named))


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks in order."""
    out, now, stack, links = [], Block(), [], 0  # stack: (tag, bad, main) of open elements
    ends, starts = [m.start() for m in _LINK_END.finditer(page)], [m.start() for m in _LINK_START.finditer(page)]
    opened: dict[str, int] = {}  # how many of each tag are on the stack
    mains = 0

    def flush(bad: int = 0, heading: bool = False) -> None:
        nonlocal now
        now.text = " ".join(html.unescape("".join(now.parts)).split())
        if now.text:
            out.append(now)
        around = stack[-1] if stack else ("", 0, 0)
        now = Block(bad=max(bad, around[1]), main=around[2], heading=heading)

    def push(tag: str, bad: int, main: int) -> None:
        stack.append((tag, bad, main))
        opened[tag] = opened.get(tag, 0) + 1

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    for m in _TOKEN.finditer(page):
        text, tag = m["text"] or m["cdata"], (m["tag"] or m["tag2"] or "").lower()
        close, attr = m["close"] or m["close2"], m["attr"] or ""
        if text:
            now.parts.append(text)
            if links:
                now.linked += len("".join(text.split()))
        elif tag == "a":
            links = 0
            if not close:  # a link that is closed before the next one begins holds blocks too; an unclosed one ends at a block
                end, following = bisect_left(ends, m.end()), bisect_left(starts, m.end())
                links = 2 if end < len(ends) and (following == len(starts) or ends[end] < starts[following]) else 1
        elif tag in ("br", "hr", "wbr", "img") and tag not in BLOCKS:
            now.parts.append(" ")
        elif tag in BLOCKS or (tag and attr and not close and tag not in VOID and named_bad(tag, attr, bool(stack and stack[-1][2])) == 2):
            bad, main = stack[-1][1:] if stack else (0, 0)
            links = 0 if links == 1 else links
            if close:
                if tag not in LOOSE and opened.get(tag):
                    while pop() != tag:
                        pass
                flush()
            else:
                own = named_bad(tag, attr, bool(main))
                if tag in MAIN and not own:
                    while not mains and stack and stack[-1][1] and not main:  # an unclosed advert doesn't swallow the first article
                        pop()
                    if not mains:  # what holds the first article is no boilerplate
                        stack[:] = [(t, 0 if b == 1 else b, x) for t, b, x in stack]
                    bad = stack[-1][1] if stack else 0
                    if not main:
                        mains += 1
                        main = mains
                if tag not in LOOSE and tag not in VOID and not attr.rstrip().endswith("/"):
                    push(tag, max(bad, own), main)
                flush(bad=own, heading=tag[0] == "h" and tag[1:].isdigit())
        elif close and opened.get(tag):
            while pop() != tag:
                pass
            flush()
    flush()
    return out


def link_density(b: Block) -> float:
    return b.linked / max(1, len(b.text) - b.text.count(" "))


def stop_words(b: Block) -> tuple[int, int]:
    """(stop words, words)."""
    words = _WORD.findall(b.text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def other_language(blocks: list[Block]) -> bool:
    """Whether the unlinked text of the page, long texts there are, has hardly a stop word."""
    rest = [b for b in blocks if b.bad != 2 and link_density(b) <= LINKS_MOST]
    stops, words = (sum(x) for x in zip(*map(stop_words, rest), strict=True)) if rest else (0, 0)
    return any(len(b.text) >= LONG for b in rest) and stops < STOPS_LANGUAGE * words


def first_pass(b: Block, other: bool = False) -> str:
    """good, bad or short (open) by link density, length and stop-word density; other: of a page in another language."""
    if link_density(b) > (LINKS_MOST_MAIN if b.main else LINKS_MOST):
        return "bad"
    if len(b.text) < SHORT:
        return "bad" if b.linked and not b.main else "short"
    if other:
        return "good"
    stops, words = stop_words(b)
    stops /= max(1, words)
    if stops >= STOPS_ANY or (stops >= STOPS_LONG and len(b.text) >= LONG):
        return "good"
    if b.main:
        return "good" if stops >= STOPS_LEAST else "short"
    return "short" if stops >= STOPS_LEAST else "bad"


def labels_of(blocks: list[Block]) -> list[str]:
    """good or bad for each block.

    An open block takes the label of its nearest decided neighbours, good where they tie; a heading that of what follows.
    In an article only neighbours in the same article speak, and without any the block is text. Blocks in elements that
    may be boilerplate are text if the first pass says so and no article of the page has a text. Where articles hold most of what
    the first pass calls good, blocks outside are none. Where no block is good, the open ones are: a short page has a main
    text too.
    """
    other = other_language(blocks)
    first = ["bad" if b.bad == 2 else first_pass(b, other) for b in blocks]
    has_article = any(b.main and x == "good" for b, x in zip(blocks, first, strict=True))
    first = ["bad" if b.bad == 1 and (has_article or x == "short") else x for b, x in zip(blocks, first, strict=True)]
    if "good" not in first:
        return ["good" if x == "short" else x for x in first]
    held = [sum(len(b.text) for b, x in zip(blocks, first, strict=True) if x == "good" and bool(b.main) == inside) for inside in (False, True)]
    if held[1] >= held[0]:
        first = ["bad" if not b.main else x for b, x in zip(blocks, first, strict=True)]

    def nearest(order: range) -> list[tuple[int, str] | None]:
        """For each block the decided one before it in order that may speak for it."""
        out: list[tuple[int, str] | None] = [None] * len(blocks)
        seen: tuple[int, str] | None = None
        seen_in: dict[int, tuple[int, str]] = {}
        for i in order:
            main = blocks[i].main
            out[i] = seen_in.get(main) if main else seen
            if first[i] != "short":
                seen = (i, first[i])
                if main and blocks[i].bad != 2:
                    seen_in[main] = seen
        return out

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    out = []
    for i, x in enumerate(first):
        if x == "short":
            left, right = before[i], after[i]
            if blocks[i].heading and right:
                x = right[1]
            elif left and right:
                near = i - left[0] - (right[0] - i)
                x = left[1] if near < 0 else right[1] if near > 0 else "good" if "good" in (left[1], right[1]) else "bad"
            elif left or right:
                x = (left or right)[1]
            else:
                x = "good" if blocks[i].main else "bad"
        out.append(x)
    return out


def main_text(page: str | None) -> str:
    """The good blocks, joined by one line end; empty for a null page."""
    blocks = blocks_of(page) if page else []
    return "\n".join(b.text for b, x in zip(blocks, labels_of(blocks), strict=True) if x == "good")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [main_text(h) for h in batch.column("html").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points of text).

    A null or empty page, or one without main text, has the empty text. Ids and urls pass as they are, null and repeated
    ones too. An empty table gives an empty table. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
