"""Main text of web pages.

The events of the standard library's streaming parser make *lines*: runs of text between block boundaries, each
with the number of its characters and of the tags met on the way. Menus, adverts, forms, scripts and the like
are left out by their elements and by class names that say nothing else. What remains is chosen by text-to-tag ratios: the ratios of a page's
lines in order, weighed by what their elements say, are smoothed by a Gaussian, and lines above a threshold are
content. Lines belong to regions: each article (or main part), and the rest of the page. The regions that hold most
of the content, by characters, are the page's text: of an article all its lines, of the rest those from the first
to the last content line; lines of a doubtful class only where they are content themselves.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from lakescout.llm.common import arrow_schema, map_batches, rows_to_batch, slices

#: Elements that never hold main text.
SKIPPED = frozenset("head title script style noscript template nav header footer aside form button select option textarea input iframe object embed svg canvas video audio map dialog menu".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | SKIPPED
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ARTICLES = frozenset(("article", "main"))
#: Words of class, id and role that mark what isn't main text: as a whole name, or beside others of them or of COMMON.
HINTS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsors sponsored promo promos promotion sidebar aside cookie cookies consent notice notices notification notifications alert alerts popup modal overlay menu menus nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond reply replies reader readers discussion share shares sharing social related recommend recommended recommendations newsletter subscribe subscription signup login search footer header masthead toolbar pagination pager widget widgets skip contentinfo complementary disclaimer copyright".split())
COMMON = frozenset("area bar block bottom box button buttons body bottom card container content form group holder icons inner item items left link links list main outer page panel post posts right section side site slot stories story text thread title to top unit widget wrap wrapper".split())
#: A name that says what its element has, as "has-sidebar" or "page-with-comments", not what it is.
HAS = re.compile(r"(?:^|[-_])(?:has|with|without|no)[-_]")
PARTS = re.compile(r"[a-z]+")
#: What lines of an article, and of a doubtful class such as "related-work", weigh.
ARTICLE, DOUBTFUL = 3.0, 0.3
#: What may stand in a head; anything else that begins ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Open elements that the start of an element ends where HTML implies it, and the elements beyond which none is ended.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)), "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
IMPLIED |= {part: (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)) for part in ("thead", "tbody", "tfoot")}
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
P_WITHIN = ("button", "td", "th", "caption", "table", "object", "template")
RADIUS = 2
KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / 1.0) ** 2)
KERNEL /= KERNEL.sum()


@lru_cache(maxsize=4096)
def hinted(names: str) -> int:
    """2 for a class, id or role whose names mark what isn't main text, 1 where that is doubtful, else 0."""
    found = 0
    for name in names.lower().split():
        parts = PARTS.findall(name)
        if HINTS.isdisjoint(parts) or HAS.search(name):
            continue
        if all(part in HINTS or part in COMMON for part in parts):
            return 2
        found = 1
    return found


class Lines(HTMLParser):
    """Collects (text, tags, region, weight) of every line; the region is the number of the article it stands in, or 0.

    Blocks that a hint marks outside of articles are judged at the end: one that holds most of the text
    of a page without articles isn't left out.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, float, int]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.regions = 0
        #: The hint around each hint, by number; 0 is none.
        self.hints = [0]
        #: Open elements: name, whether what is inside is skipped, the region, the weight and the innermost hint.
        self.open: list[tuple[str, bool, int, float, int]] = [("", False, 0, 1.0, 0)]
        #: Where elements of each name are open, outermost first, and how many of some kinds are.
        self.at: dict[str, list[int]] = defaultdict(list)
        self.skipping = self.headings = 0

    def _break(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, max(1, self.tags), *self.open[-1][2:]))
            self.parts = []
        self.tags = 0

    def _push(self, *element) -> None:
        self.at[element[0]].append(len(self.open))
        self.open.append(element)
        self.skipping += element[0] in SKIPPED
        self.headings += element[0] in HEADINGS

    def _pop(self, to: int) -> None:
        for name, *_ in self.open[to:]:
            self.at[name].pop()
            self.skipping -= name in SKIPPED
            self.headings -= name in HEADINGS
        del self.open[to:]

    def _imply_end(self, ended, beyond) -> None:
        """End the outermost open element of those named that isn't outside of one it can't be ended from."""
        limit = max((self.at[name][-1] for name in beyond if self.at[name]), default=0)
        found = [places[i] for places in map(self.at.__getitem__, ended) if (i := bisect(places, limit)) < len(places)]
        if found:
            self._break()
            self._pop(min(found))

    def _imply_ends(self, tag: str) -> None:
        if tag not in IN_HEAD and self.open[-1][0] == "head":
            self._imply_end(("head",), ())
        if tag in ENDS_P:
            self._imply_end(("p",), P_WITHIN)
        if tag in IMPLIED:
            self._imply_end(*IMPLIED[tag])

    def handle_starttag(self, tag: str, attrs) -> None:
        self._imply_ends(tag)
        _, skipped, region, weight, hint = self.open[-1]
        self.tags += 1
        if tag in BLOCKS:
            self._break()
        elif tag in ("br", "wbr"):
            self.parts.append(" " if tag == "br" else "")
        if tag in VOID:
            return
        if tag in ARTICLES and not self.skipping:
            # An article isn't part of an advert or notice that was left open before it, but of comments if those hold it.
            if region == 0:
                skipped, weight, hint, self.regions = False, ARTICLE, 0, self.regions + 1
                region = self.regions
        elif tag == "header" and region:
            pass  # an article's own header may hold its heading
        elif tag in SKIPPED:
            skipped = True
        if attrs and not skipped and tag not in ("html", "body"):
            for name, value in attrs:
                if value and name in ("class", "id", "role") and (sure := hinted(value)):
                    if sure == 1:
                        weight = min(weight, DOUBTFUL)
                    elif region or tag not in BLOCKS:
                        skipped = True
                        break
                    else:
                        self.hints.append(hint)
                        hint = len(self.hints) - 1
                        break
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    skipped = True
        self._push(tag, skipped, region, weight, hint)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._break()
        if tag == "br":
            self.parts.append(" ")
        if self.at[tag]:
            self._pop(self.at[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.open[-1][1] and (self.headings or not self.at["header"]):
            self.parts.append(data)

    def finish(self) -> list[tuple[str, int, int, float]]:
        self.close()
        self._break()
        held = [0] * len(self.hints)
        for text, _, _, _, hint in self.lines:
            held[hint] += len(text)
        # A page with an article has its text there, however much an advert holds.
        total = float("inf") if any(region for _, _, region, _, _ in self.lines) else sum(held)
        for hint in range(len(held) - 1, 0, -1):  # inner ones have larger numbers
            held[self.hints[hint]] += held[hint]
        kept = [True]
        for hint in range(1, len(held)):
            kept.append(kept[self.hints[hint]] and 2 * held[hint] > total)
        return [(text, tags, region, weight) for text, tags, region, weight, hint in self.lines if kept[hint]]


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Ratios of lines in order under a Gaussian; beyond either end the last line's goes on."""
    return np.convolve(np.pad(ratios, RADIUS, mode="edge"), KERNEL, mode="valid")


def content(lines: list[tuple[str, int, int, float]]) -> np.ndarray:
    """Which lines are content: runs of lines whose smoothed weighed text-to-tag ratio is at least the ratios' standard
    deviation, or half their mean if that is less, without lines of links at either end that smoothing lifted."""
    ratios, tags = np.array([weight * len(text) / tags for text, tags, _, weight in lines]), np.array([tags for _, tags, _, _ in lines])
    smooth = smoothed(ratios)
    least = min(smooth.std(), smooth.mean() / 2)
    found, own = smooth >= least, (ratios >= least) | (tags == 1)
    # A line is inside of a run's ends if the run has lines of its own both before and after it, or it is one.
    run = np.cumsum(np.concatenate(([True], found[1:] != found[:-1])))
    at = np.arange(len(found))
    first, last = np.full(run[-1] + 1, len(found)), np.full(run[-1] + 1, -1)
    np.minimum.at(first, run[own], at[own])
    np.maximum.at(last, run[own], at[own])
    return found & (at >= first[run]) & (at <= last[run])


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order joined by line ends, each with single spaces. A null or empty
    page, and one without such text, give an empty string."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    found, mass = content(lines), defaultdict(float)
    for (text, _, region, weight), is_content in zip(lines, found, strict=True):
        mass[region] += weight * len(text) * is_content
    main = {region for region, held in mass.items() if held and 3 * held >= max(mass.values())}
    rest = [i for i, (_, _, region, _) in enumerate(lines) if found[i] and region == 0]
    kept = []
    for i, (text, _, region, weight) in enumerate(lines):
        if region in main and (region or rest[0] <= i <= rest[-1]) and (weight > DOUBTFUL or found[i]):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages: main text of the whole html and its code points.
    Null ids and urls stay null; repeated rows give equal rows."""
    ddl = "page_id long, url string, text string, n_chars long"
    schema = arrow_schema(ddl)

    def run(batches):
        for _, keys, urls, pages_html in slices(batches, "page_id", "url", "html"):
            texts = [main_text(h) for h in pages_html]
            yield rows_to_batch(schema, [keys, urls, texts, [len(t) for t in texts]])

    return map_batches(pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html"), run, ddl)
