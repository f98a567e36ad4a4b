"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element, in page order. A line counts with its length
times a weight: 1 for plain text, less for text outside the article where a page marks one, inside menus,
headers, footers, sidebars, forms and the like (by element or role), under a class or id with such a word,
and for lines that are mostly links. Counted lengths are summed over sliding windows of lines. The text
surges at a line from which on a window passes the threshold and dives where a whole window of lines has
held no full line; between these points every full line is kept, however short.

Structure weighs, it has no veto: a reading of the page (which of the marks to believe) holds only if some
window of full lines sums to more than every window of the lines that it would set apart. If not, the next
reading is tried: first all marks, then without class words, then without the article, then none.

The markup is read in one pass: every search for the end of a tag, comment or element goes forward from
where the last one ended, and elements nest DEPTH deep at most (deeper ones count as their parent), so the
work is in proportion to the page, however broken.

Defined results: null, empty and text-less pages give the empty text; unclosed elements end with their
parent; a tag that the page's end cuts off is no text; a quote that is not closed within its tag ends with
the tag; repeated rows are extracted alike; no rows give no rows. Other columns are kept; those called text
or n_chars give way to the outputs.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices, whole

WINDOW, SURGE, LINK_SHARE, DEPTH = 3, 20, 0.6, 512
#: Weights of a line: under a class word, in an element set apart, mostly links, outside the article.
BY_WORD, BY_ELEMENT, BY_LINKS, OUTSIDE = 1 / 20, 1 / 200, 1 / 200, 1 / 1000

# Element names and the words of class, id and role that mark what is not the text.
RAW = frozenset("script style noscript template textarea select datalist optgroup option svg math iframe object canvas audio video title button".split())
TEXT_ONLY = frozenset("script style noscript textarea iframe title".split())
APART = frozenset("nav header footer aside form menu dialog head fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN_NAMES = frozenset("main articlebody article-body article-content main-content maincontent post-content post-body entry-content story-body".split())
APART_ROLES = frozenset("navigation complementary contentinfo banner search dialog alert".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "sidebar side-bar aside widget widgets cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay "
    "share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies footer header masthead toolbar pagination pager "
    "copyright legal complementary contentinfo search form tags".split()
)
STATES = frozenset("has no not with without is hide show".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}

PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)\s*>")
OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
NAME = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)?")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none")
SPACES = re.compile(r"\s+")


class Ahead:
    """Finds strings ahead of a position that only grows: each stretch of the page is searched once a string."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def find(self, what: str, at: int) -> int:
        """The next start of `what`, -1 if there is none."""
        last = self.known.get(what, -2)
        if last == -1 or last >= at:
            return last
        self.known[what] = found = self.page.find(what, at)
        return found

    def end_of(self, name: str, at: int) -> int:
        """The next start of the end tag of the element, in any case, -1 if there is none."""
        key = "</" + name
        last = self.known.get(key, -2)
        if last == -1 or last >= at:
            return last
        found = re.compile(key + r"(?=[\s/>])", re.I).search(self.page, at)
        self.known[key] = at = found.start() if found else -1
        return at


class Tag(NamedTuple):
    start: int
    end: int
    closing: bool
    name: str
    attributes: dict[str, str]
    closed: bool


def attributes(page: str, at: int, ahead: Ahead) -> tuple[dict[str, str], int, bool]:
    """The attributes from `at` on, the position behind the tag (that of the page's end if it is cut off), and whether it closes itself."""
    found: dict[str, str] = {}
    while True:
        m = NAME.match(page, at)
        at = m.end()
        if at >= len(page):
            return found, len(page), False
        if m[1] is None:
            return found, at + 1, page[at - 1] == "/"
        value, equals = "", EQUALS.match(page, at)
        if equals:
            at = equals.end()
            quote = page[at : at + 1]
            if quote in ("'", '"'):
                end, gt = ahead.find(quote, at + 1), ahead.find(">", at + 1)
                lt = ahead.find("<", at + 1)
                if end < 0 or 0 <= gt < lt < end:  # not closed, or only by a quote behind the next tag's begin
                    end = gt if gt >= 0 else len(page)
                    value, at = page[at + 1 : end], end
                else:
                    value, at = page[at + 1 : end], end + 1
            else:
                bare = BARE.match(page, at)
                value, at = bare[0], bare.end()
        found.setdefault(m[1].lower(), value.lower())


def tags(page: str) -> Iterator[Tag]:
    """The tags of a page in order. A comment, a declaration or an element whose content is no markup is a tag without a name."""
    ahead, at = Ahead(page), 0
    while True:
        at = ahead.find("<", at)
        if at < 0:
            return
        plain = PLAIN_TAG.match(page, at)
        if plain:
            tag = Tag(at, plain.end(), bool(plain[1]), plain[2].lower(), {}, False)
        else:
            m = OPEN.match(page, at)
            if not m:
                at += 1
                continue
            if m[2] is None:
                close = "-->" if m[0] == "<!--" else ">"
                end = ahead.find(close, m.end())
                end = len(page) if end < 0 else end + len(close)
                yield Tag(at, end, False, "", {}, False)
                at = end
                continue
            found, end, closed = attributes(page, m.end(), ahead)
            tag = Tag(at, end, bool(m[1]), m[2].lower(), found, closed)
        if tag.name in TEXT_ONLY and not tag.closing and not tag.closed:
            end = ahead.end_of(tag.name, tag.end)
            if end >= 0:  # else it is an element like others
                end = page.find(">", end)
                end = len(page) if end < 0 else end + 1
                yield Tag(at, end, False, "", {}, False)
                at = end
                continue
        yield tag
        at = tag.end


def marks(found: dict[str, str]) -> tuple[set[str], bool, bool, bool]:
    """The words by which an element's attributes set it apart from the text, whether its role does, whether it is hidden, and whether they mark the article."""
    if not found:
        return set(), False, False, False
    names = set(" ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop")).split())
    words = set(names)  # ids, roles and the like count whole: a heading's id has words of its text
    for token in found.get("class", "").split():
        parts = re.split(r"[_-]+", token)
        if parts[0] not in STATES:
            words.update(parts)
    hidden = found.get("hidden", "false") != "false" or found.get("aria-hidden") == "true" or bool(UNSEEN.search(found.get("style", "")))
    return words & APART_WORDS, found.get("role") in APART_ROLES, hidden, bool(names & MAIN_NAMES)


class Line(NamedTuple):
    text: str
    main: bool  # inside the article
    element: bool  # inside an element set apart
    word: bool  # under a word that sets apart
    links: bool  # mostly links


class State(NamedTuple):
    main: int = 0
    element: int = 0
    word: int = 0
    unseen: int = 0


def lines(page: str) -> list[Line]:
    """The blocks of the page, in order; text in inline parts that are set apart from their block is a line after it."""
    out: list[Line] = []
    stack: list[tuple[str, State, bool]] = []  # name, the state outside, whether it is set apart
    names: Counter[str] = Counter()
    own: list[str] = []
    beside: list[tuple[str, State]] = []
    now = base = State()
    links = linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if now.unseen:
            return
        if now.element > base.element or now.word > base.word:
            beside.append((piece, now))
            return
        own.append(piece)
        if links:
            linked += len(piece)

    def clean(pieces: list[str]) -> str:
        return SPACES.sub(" ", html.unescape("".join(pieces))).strip()

    def flush() -> None:
        nonlocal linked
        if own:
            text = clean(own)
            if text:
                out.append(Line(text, base.main > 0, base.element > 0, base.word > 0, linked / len(text) >= LINK_SHARE))
            own.clear()
            linked = 0
        if beside:
            text = clean([p for p, _ in beside])
            if text:
                out.append(Line(text, base.main > 0, any(s.element for _, s in beside), any(s.word for _, s in beside), False))
            beside.clear()

    def close(name: str) -> None:
        nonlocal now
        if not names[name]:
            return
        crossed = False
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                if crossed and name not in BLOCKS and not stack[k][2]:
                    del stack[k]  # misnested inline element: the blocks inside it stay open
                    names[name] -= 1
                    return
                now = stack[k][1]
                names.subtract(x[0] for x in stack[k:])
                del stack[k:]
                return
            crossed = crossed or stack[k][0] in BLOCKS
            if name == "p" and crossed:
                return

    at = 0
    for tag in tags(page):
        if tag.start > at:
            add(page[at : tag.start])
        at, name = tag.end, tag.name
        if not name:
            add(" ")
            continue
        if name == "br":
            add(" ")
        elif name == "a":
            links = 0 if tag.closing else 1
        block = name in BLOCKS
        if block:
            flush()
        if name in VOID:
            continue
        if tag.closing:
            close(name)
        elif not (now.unseen and tag.closed):  # svg and math close their parts so
            if name in CLOSES_P:
                close("p")
            if name == "option" and stack and stack[-1][0] == name:
                close(name)
            words, role, hidden, is_main = marks(tag.attributes)
            inside = now.main > 0
            if inside:
                words = words - {"header"}  # the article's own heading
            off = (role or name in APART) and not (name == "header" and inside)
            raw = name in RAW
            if raw:
                add(" ")
            if len(stack) < DEPTH and not (raw and tag.closed):
                stack.append((name, now, bool(words or off or hidden or raw)))
                names[name] += 1
                is_main = (name in ("article", "main") or is_main) and not off
                page_itself = name in ("body", "html")
                now = State(now.main + is_main, now.element + (off and not is_main), now.word + (bool(words) and not is_main and not page_itself), now.unseen + (hidden or raw))
        if block:
            base = now
    add(page[at:])
    flush()
    return out


def readings(found: list[Line]) -> Iterator[tuple[list[float], bool]]:
    """The weights of the lines under each reading of the page's marks, and whether it believes in a marked article."""
    marked = any(x.main for x in found)
    for article, element, word in ((True, True, True), (True, True, False), (True, False, False), (False, True, True), (False, True, False), (False, False, False)):
        if article and not marked:
            continue
        yield [
            (OUTSIDE if article and not x.main else 1) * (BY_ELEMENT if element and x.element else 1) * (BY_WORD if word and x.word else 1) * (BY_LINKS if x.links and not (article and x.main) else 1)
            for x in found
        ], article


def block_sums(lengths: list[float], window: int) -> list[float]:
    """The sum of each window of lines that begins at a line, and, for the first lines, of those cut off by the page's begin."""
    return [sum(lengths[max(0, i) : i + window]) for i in range(1 - window, len(lengths))]


def main_lines(found: list[Line], window: int = WINDOW) -> list[str]:
    """The lines of the text: those of full weight between surge and dive, under the first reading that holds."""
    for weights, article in readings(found):
        full = [float(len(x.text)) if w == 1 else 0.0 for x, w in zip(found, weights)]
        faint = [len(x.text) * w if w < 1 else 0.0 for x, w in zip(found, weights)]
        sums = block_sums(full, window)
        most = max(sums, default=0)
        if most > max(block_sums(faint, window), default=0):
            break
    else:
        return []
    surge = 1 if article or most < SURGE else SURGE
    kept, open_text, ahead = [], False, sums[window - 1 :]
    for i, x in enumerate(found):
        if not open_text and full[i] and ahead[i] >= surge:
            open_text = True
        elif open_text and not sums[i]:
            open_text = False
        if open_text and full[i]:
            kept.append(x.text)
    return kept


def main_text(page: str) -> str:
    return "\n\n".join(main_lines(lines(page)))


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """pages' other columns, text and n_chars. A projection over the scan: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page", "text", "n_chars"])

    rows = pages.select(whole(pages, (html_col.lower(), "text", "n_chars")).alias("page"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page {rows.schema['page'].dataType.simpleString()}, text string, n_chars long").select("page.*", "text", "n_chars")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: For pages that mark their article with one element, as those of the tables do, and name characters by the references below.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(regexp_replace(h, '<br ?/?>', ' ', 'g'), '</?(?:p|h[1-6]|li|ul|ol|div|section|blockquote|pre)(?: [^>]*)?>'),
  lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""
