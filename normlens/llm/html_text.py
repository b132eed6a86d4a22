"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. A line weighs its length, without links; linked sentences and
the page's title weigh in full. What an element names as boilerplate (menus, forms, adverts and the like) weighs nothing.
Weights are summed over sliding windows of lines: where the sum surges the main text begins, where it dives to nothing
the text ends, and what lies between is kept. The same windows decide on every page, inside articles too: a list of links
at an article's end is a dive. Around an ``article`` or ``main`` element lines weigh only where they surge by themselves.
A name or a form only makes its lines weigh nothing while they are the smaller part: what holds most of the page's
text is not skipped. Pages are independent: one Arrow pass, no shuffle, in time that grows with the page's length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from normlens.llm.common import row_batches

WINDOW = 3  # lines whose lengths are summed
SURGE = 80  # weight of a window at which the main text begins; half of the largest, on pages without such a window
SENTENCE = 40  # characters that a linked line needs, and a sentence's end, to weigh as much as another
TEXT_SCHEMA = "page_id long, url string, text string, n_chars long, n_lines long, n_kept long"

# Elements whose content is never text of the article. To the page's end, if the first six have no end tag.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "select")
TO_END = frozenset(RAW[:6])
BOILERPLATE = frozenset("nav footer aside form button dialog menu head audio video canvas fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role names that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner cookie cookies consent "
    "gdpr privacy notice notices notification alert popup modal overlay newsletter subscribe subscription paywall signup login signin "
    "menu menus nav navbar navigation navigate breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended "
    "recommendations trending share sharing social comment comments commentlist reply replies disqus respond responses reviews footer "
    "header masthead topbar toolbar pagination pager copyright legal disclaimer search searchbox contentinfo complementary dialog form "
    "skip".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies disqus respond responses reviews".split())
NEGATED = frozenset("with has no without not".split())
# Elements that are skipped only while they hold the smaller part of the page's text.
WRAPPERS = frozenset("form fieldset header".split())

OPENING = re.compile(r"<(?=[a-z/!?])", re.IGNORECASE)
NAME = re.compile(r"[a-z][a-z0-9:-]*", re.IGNORECASE)
STOP = re.compile(r">|=\s*([\"'])?")  # in a tag: its end, or a value with its quote
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
CAMEL = re.compile(r"([a-z0-9])([A-Z])")
NAME_PARTS = re.compile(r"[^a-z0-9]+")
SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u2019\u201d\u00bb)\]]*$")


def marks(attrs: str, tag: str = "div", article: bool = False) -> frozenset[str]:
    """Boilerplate words among an element's class, id and role names; "hidden" if it is not shown.

    What follows a negation does not count. The names of headings say what they are about, as do ids of sections
    by their parts; in the article only whole names count, and ids of sections not at all."""
    found: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attrs):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            found.add("hidden")
        elif name == "style":
            if "display:none" in value.replace(" ", "").lower():
                found.add("hidden")
        elif tag not in HEADINGS and not (name == "id" and tag == "section" and article):
            for one in value.split():
                parts = NAME_PARTS.split(CAMEL.sub(r"\1-\2", one).lower())
                if article or (name == "id" and tag == "section"):
                    parts = [one.lower()]
                for part in parts:
                    if part in NEGATED:
                        break
                    if part in MARKS:
                        found.add(part)
    return frozenset(found)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """The page from left to right: ("text", text, ""), ("open", name, attributes) and ("close", name, ""), names in lower case.

    Comments, declarations and the content of ``RAW`` elements are left out. Each search either finds something and
    goes on behind it, or fails and is not made again, so the time grows with the page's length whatever it holds."""
    at, quoted, unclosed = 0, True, set()
    while opening := OPENING.search(page, at):
        start = opening.start()
        if start > at:
            yield "text", page[at:start], ""
        close = page.startswith("</", start)
        name = NAME.match(page, start + 1 + close)
        if not name:
            before, after = next(m for m in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")) if page.startswith(m[0], start))
            end = page.find(after, start + len(before))
            at = end + len(after) if end >= 0 else len(page)
            continue
        end, pos = -1, name.end()
        while quoted and (stop := STOP.search(page, pos)):
            if stop[0] == ">":
                end = stop.start()
                break
            pos = page.find(stop[1], stop.end()) + 1 if stop[1] else stop.end()
            if not pos:
                break
        if end < 0:  # no end outside quotes: from here on quotes mean nothing
            quoted = False
            end = page.find(">", name.end())
        if end < 0:
            return
        at, tag, attrs = end + 1, name[0].lower(), page[name.end() : end]
        if close or tag not in RAW_END or tag in unclosed:
            yield "close" if close else "open", tag, attrs
        elif not (attrs.endswith("/") and tag in ("svg", "math")):
            found = RAW_END[tag].search(page, at)
            if found:
                end = page.find(">", found.end())
                at = end + 1 if end >= 0 else len(page)
            elif tag in TO_END:
                return
            else:
                unclosed.add(tag)
                yield "open", tag, attrs
    if at < len(page):
        yield "text", page[at:], ""


class Lines:
    """The page's lines: text, weight in the distribution, whether inside the article, and whether void.

    A void line stands for boilerplate, of any length, that lies outside the article: it has no weight and is never kept."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.weight: list[int] = []
        self.inside: list[bool] = []
        self.skips: list[int] = []  # of each line, the innermost skipping element, or -1
        self.kinds: list[str] = []  # of each skipping element
        self.around: list[int] = []  # of each skipping element, the one around it, or -1
        self.stack: list[tuple[str, int, bool]] = []  # name, innermost element that skips it, in the article
        self.places: dict[str, list[int]] = {}  # of each name, its places in the stack
        self.parts: list[str] = []
        self.linked = 0
        for kind, value, attrs in tokens(page):
            if kind == "text":
                self.add(value)
            elif kind == "open":
                self.open(value, attrs)
            else:
                self.close(value)
        self.flush()
        self.settle()

    def settle(self) -> None:
        """Makes skipped lines void, but not those of names and forms that hold most of the page's text.

        Comments hold it only where no other text surges, and what lies beside an article never does."""
        self.void = [False] * len(self.text)
        if not self.kinds:
            return
        held, beside = [0] * len(self.kinds), [False] * len(self.kinds)
        total = own = 0
        for text, inside, k in zip(self.text, self.inside, self.skips, strict=True):
            total += len(text)
            if k < 0:
                own += len(text)
            else:
                held[k] += len(text)
                beside[k] |= not inside
        for k in range(len(self.kinds) - 1, -1, -1):  # what lies inside came later
            if self.around[k] >= 0:
                held[self.around[k]] += held[k]
                beside[self.around[k]] |= beside[k]
        article = any(inside and k < 0 for inside, k in zip(self.inside, self.skips, strict=True))
        gone: list[bool] = []
        for k, kind in enumerate(self.kinds):
            small = 2 * held[k] <= total or (kind == "comments" and own >= SURGE) or (article and beside[k])
            gone.append(small or (self.around[k] >= 0 and gone[self.around[k]]))
        keep: list[int] = []
        for i, k in enumerate(self.skips):
            if k >= 0 and gone[k]:
                if (article and self.inside[i]) or (keep and self.void[keep[-1]]):
                    continue  # inside an article boilerplate parts nothing
                self.void[i], self.weight[i] = True, 0
            keep.append(i)
        self.text, self.weight, self.inside, self.void = ([column[i] for i in keep] for column in (self.text, self.weight, self.inside, self.void))

    def state(self) -> tuple[int, bool]:
        return self.stack[-1][1:] if self.stack else (-1, False)

    def hidden(self) -> bool:
        """Whether what follows is skipped whatever it holds."""
        k = self.state()[0]
        return k >= 0 and self.kinds[k] == "always"

    def skip(self, around: int, kind: str) -> int:
        if around >= 0 and self.kinds[around] == "always":
            return around
        self.kinds.append(kind)
        self.around.append(around)
        return len(self.kinds) - 1

    def add(self, raw: str) -> None:
        if self.hidden():
            if raw.strip() and not self.parts and not (self.skips and self.skips[-1] == self.state()[0]):
                self.line("", 0)
            return
        self.parts.append(raw)
        if any(name == "a" for name, _, _ in self.stack[-4:]):
            self.linked += len(raw.strip())

    def flush(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                says = self.places.get("h1") or (len(text) >= SENTENCE and SENTENCE_END.search(text))
                self.line(text, len(text) if says else max(0, len(text) - 2 * self.linked))
            self.parts.clear()
        self.linked = 0

    def line(self, text: str, weight: int) -> None:
        self.text.append(text)
        self.weight.append(weight)
        self.inside.append(self.state()[1])
        self.skips.append(self.state()[0])

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element with one of these names, or -1."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def cut(self, place: int) -> None:
        for name, _, _ in self.stack[place:]:
            self.places[name].pop()
        del self.stack[place:]

    def open(self, name: str, attrs: str) -> None:
        if name in BLOCKS:
            self.flush()
        if name in VOID or (attrs.endswith("/") and name not in BLOCKS):
            return
        if name in BLOCKS and name != "br":
            self.end_open("p", {"table", "td", "th", "article", "section", "main", "body", "div", "li", "blockquote"})
        if name == "li":
            self.end_open("li", {"ul", "ol", "menu", "dir"})
        elif name in ("td", "th"):
            self.end_open("td", {"table"})
            self.end_open("th", {"table"})
        elif name == "tr":
            self.end_open("tr", {"table"})
        skipped, article = self.state()
        if name not in ("html", "body"):
            found = marks(attrs, name, article) if attrs else frozenset()
            if name in ("article", "main"):
                if not found & (COMMENTS | {"hidden", "related", "recommended"}):
                    article = True  # below a skipped element it stays skipped
                else:
                    skipped = self.skip(skipped, "always" if "hidden" in found else "comments")
            elif "hidden" in found or name in RAW_END or (name in BOILERPLATE and name not in WRAPPERS):
                skipped = self.skip(skipped, "always")
            elif found or (name in WRAPPERS and not (name == "header" and article)):
                skipped = self.skip(skipped, "comments" if found & COMMENTS else "wrapper")
            elif article and name in ("p", "div", "ul") and self.places.get("header"):
                skipped = self.skip(skipped, "always")  # a header inside the article gives its headings only
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, skipped, article))

    def end_open(self, name: str, bounds: set[str]) -> None:
        """Ends an element that the next start tag closes without an end tag of its own."""
        place = self.last((name,))
        if place >= 0 and place >= self.last(bounds - {name}):
            self.cut(place)

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        place = self.last((name,))
        if place >= 0 and not (name in ("p", "b", "i", "em", "strong", "a", "span") and place < self.last(("article", "main", "body"))):
            self.cut(place)


def block_sums(weight: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The weight of each line and the ``window - 1`` after it."""
    total = np.concatenate([[0], np.cumsum(weight)])
    return total[np.minimum(np.arange(len(weight)) + window, len(weight))] - total[:-1]


def regions(weight: np.ndarray, surge: float = SURGE) -> list[tuple[int, int]]:
    """Runs of lines without a dive (a window of no weight) in which some window surges, from the first line with weight to the last."""
    block = block_sums(weight)
    runs = []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], block > 0, [False]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if block[a:b].max() >= surge:
            live = a + np.flatnonzero(weight[a:b])
            runs.append((int(live[0]), int(live[-1]) + 1))
    return runs


def main_text(page: str | None) -> tuple[str, int, int]:
    """The main text, the number of lines of the page (those that boilerplate stands for count once) and of lines kept.

    Null and empty pages give '', as do those of nothing but links."""
    lines = Lines(page or "")
    weight, inside = np.array(lines.weight, dtype=np.int64), np.array(lines.inside, dtype=bool)
    if inside.any():
        surges = np.zeros(len(weight), dtype=bool)
        for a, b in regions(np.where(inside, 0, weight)):
            surges[a:b] = True
        weight = np.where(inside | surges, weight, 0)
    runs = regions(weight, min(SURGE, block_sums(weight).max() / 2)) if weight.any() else []
    keep = [i for a, b in runs for i in range(a, b) if not lines.void[i] and (weight[i] > 0 or inside[i] or not inside.any())]
    return "\n".join(lines.text[i] for i in keep), len(lines.text), len(keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_kept for every row; null html is an empty page with text ''.

    Ids and urls are passed on as they are, null too; repeated rows give repeated results. Extra columns are not
    looked at; an empty table gives no rows. A page of any length is taken whole, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            got = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1),
                    pa.array([t for t, _, _ in got], pa.string()),
                    pa.array([len(t) for t, _, _ in got], pa.int64()),
                    pa.array([n for _, n, _ in got], pa.int64()),
                    pa.array([k for _, _, k in got], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars", "n_lines", "n_kept"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, TEXT_SCHEMA)
