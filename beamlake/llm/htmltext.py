"""Main text of web pages by line-block distribution.

Markup, scripts and styles are stripped, and the page becomes lines, one per block element. Lines of elements of a kind that never
holds the article (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) are taken out first. A line's
weight is its number of characters. Weights are summed over sliding windows of WIDTH lines. A block of text lies around each surge,
a window whose sum exceeds the threshold, and reaches on either side to where the sums dive to 0: WIDTH lines without weight.

Where the page has article or main elements with text, their lines weigh, links or not, and all others weigh nothing; so an article
stays whole, whatever stands in its middle, and surges and dives decide between several. Elsewhere a line that is mostly links weighs
nothing: a single one inside a block is kept, as a sentence may be one, while a list of links, or a stray line beyond one, falls into a dive.

The threshold is SURGE characters, or half of the largest sum on pages that stay below it; lines that no dive parts from a
surge need not reach it themselves.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one newline. Ends
that HTML lets authors omit (of p, li and the like) are implied. An element of a kind that is dropped ends with its own end
tag; one without an end tag is no such element. A null or empty page gives an empty text. Rows that repeat are
extracted each for itself; other columns are not read. Work and memory are linear in a page's length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines of a window, and characters of a surge, as the method's author proposes.
WIDTH, SURGE = 3, 86

# Names of HTML elements, and which open elements a start tag ends where their end tag is omitted.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style title textarea xmp".split())
NEVER = frozenset("aside button canvas datalist dialog footer form head header iframe menu nav noscript object option select svg template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IMPLIED = {
    **{name: ("p",) for name in BLOCKS - {"dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "caption", "legend", "summary"}},
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"),
    "tbody": ("p", "td", "th", "tr", "thead", "tbody"), "tfoot": ("p", "td", "th", "tr", "thead", "tbody"), "option": ("option",),
}
OMITS = frozenset("p li dt dd td th tr tbody thead tfoot option".split())
# Words in class, id and role that mark what is not the article, and words that may stand beside them.
MARKS = frozenset(
    "ad ads adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices paywall "
    "popup promo promoted recommended related replies reply search share sharing sidebar skip social sponsor sponsored subscribe "
    "toolbar widget".split()
)
BESIDE = frozenset(
    "a area article articles aside bar block body bottom box btn button buttons center column container content div footer form global group header "
    "icon icons id inner item items js left link links list main media message mobile nav outer page panel policy popup post posts primary right row "
    "section secondary site slot stories text to top unit user wrap wrapper".split()
)
_KEEP = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*+)>"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+\Z",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"']+)))?")
_PART = re.compile(r"[a-z]+")


def attributes(rest: str) -> dict[str, str]:
    """Names, in lower case, and values; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def marked(token: str) -> bool:
    """Whether all words of a class, id or role mark boilerplate or may stand beside such a mark, and one does."""
    parts = _PART.findall(token.lower())
    return any(p in MARKS for p in parts) and all(p in MARKS or p in BESIDE for p in parts)


def _outside(name: str, rest: str) -> bool:
    """Whether an element is of a kind, or is marked as of a kind, that never holds the article."""
    if name in _KEEP or name in VOID:
        return False
    if name in NEVER:
        return True
    if not rest or rest.isspace():
        return False
    a = attributes(rest)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in "".join(a.get("style", "").lower().split()):
        return True
    return any(marked(token) for key in ("class", "id", "role") for token in a.get(key, "").split())


@dataclass(frozen=True)
class Line:
    text: str
    #: Mostly links; inside article or main.
    links: bool
    within: bool


class _Ends:
    """Where end tags are: the last of each name is looked up once, so that a search never fails at a page's length."""

    def __init__(self, page: str):
        self.page, self.low, self.last = page, None, {}

    def find(self, name: str, at: int) -> int:
        """The place of the next end tag of this name, or -1."""
        if self.low is None:  # lower() may change the number of characters; only ASCII matters here
            self.low = self.page.lower() if self.page.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), self.page)
        if name not in self.last:
            self.last[name] = self.low.rfind(f"</{name}")
        return self.low.find(f"</{name}", at) if self.last[name] >= at else -1

    def follows(self, name: str, at: int) -> bool:
        if name not in self.last:
            self.find(name, at)
        return self.last[name] >= at


def lines(page: str) -> list[Line]:
    """The block lines of a page, in page order, without those of elements that never hold the article."""
    out: list[Line] = []
    parts: list[str] = []
    ends, open_, count = _Ends(page), [], Counter()  # open elements: (name, is dropped, is article or main)
    links = within = outside = 0
    in_link = False

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not outside:
                out.append(Line(text, 2 * links > len(text), within > 0))
            parts.clear()
        links = 0

    def close(to: int) -> None:
        nonlocal within, outside
        flush()
        while len(open_) > to:
            name, dropped, article = open_.pop()
            count[name] -= 1
            within -= article
            outside -= dropped

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if in_link:
                links += len(text.strip())
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name == "a":
                in_link = False
            elif count[name]:  # each element is popped once
                k = len(open_) - 1
                while open_[k][0] != name:
                    k -= 1
                close(k)
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW:
            flush()
            to = ends.find(name, at)
            at = to if to >= 0 else len(page)
            continue
        rest = m["rest"] or m["rest2"] or ""
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                flush()
            continue
        for ended in IMPLIED.get(name, ()):
            if open_ and open_[-1][0] == ended:
                close(len(open_) - 1)
        if name in BLOCKS:
            flush()
        elif name == "a":
            in_link = True
        dropped = not rest.endswith("/") and _outside(name, rest) and (name in OMITS or ends.follows(name, at))
        if dropped:
            flush()
        if dropped or (name in BLOCKS and not rest.endswith("/")) or name == "option":
            article = name in ("article", "main")
            open_.append((name, dropped, article))
            count[name] += 1
            within += article
            outside += dropped
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def regions(weights: list[int], threshold: float) -> list[tuple[int, int]]:
    """[first, last) lines of each block: between dives, around at least one surge."""
    n, sums, total = len(weights), [], 0
    for i in range(n - 1, -1, -1):  # of the window that begins at each line
        total += weights[i] - (weights[i + WIDTH] if i + WIDTH < n else 0)
        sums.append(total)
    sums.reverse()
    out: list[tuple[int, int]] = []
    i = 0
    while i < n:
        if not weights[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j] > 0:
            j += 1
        last = j
        while not weights[last - 1]:
            last -= 1
        if max(sums[i:last]) > threshold:
            out.append((i, last))
        i = j
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = lines(page)
    inside = any(x.within and not x.links for x in found)
    weights = [len(x.text) if (x.within if inside else not x.links) else 0 for x in found]
    most = max((sum(weights[i : i + WIDTH]) for i in range(len(weights))), default=0)
    kept = [found[k] for a, b in regions(weights, min(SURGE, most / 2)) for k in range(a, b)]
    return "\n".join(x.text for x in kept if x.within or not inside)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                cols = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, schema)
