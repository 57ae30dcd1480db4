"""Main text of HTML pages from the parser's event stream.

Events of the standard library's parser are read once. They fill lines: a block element begins a new one,
and text and tags count towards the line that is open. A line's ratio of text to tags, smoothed with a
Gaussian over its neighbours, says how much the region reads like prose; a threshold between the two clusters of
ratios selects the content lines, and short lines between or beside them join their region unless they are lists of
links. What the markup itself names as something else (navigation, header, footer, asides, forms, scripts, adverts,
notices, comments) never enters. An article or main element raises its lines' ratios and decides nothing by itself.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never main text.
ASIDE = frozenset("aside audio button canvas datalist dialog footer form head header iframe input label math menu nav noscript object script select style svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tokens of class or id that name boilerplate, and words that do so also as a part of a token, between hyphens.
NAMED = frozenset(
    "alert article-footer comment-list commentlist disclaimer discussion header main-menu main-nav menu modal nav nav-bar nav-menu navigation notice notices page-header related related-articles related-posts replies respond search "
    "site-footer site-header site-nav skip toolbar top-bar topbar widget".split()
)
PART = re.compile(
    r"(?:^|[_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|masthead|navbar|newsletter|pagination|popup|promo|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe)(?:$|[_-])", re.I
)
#: Roles that say the same.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Elements that close an open one of the same kind, as a parser for browsers does.
CLOSES = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
#: Elements whose start ends an open paragraph, and elements beyond which it doesn't reach.
ENDS_P = BLOCKS - frozenset("body br caption head html legend optgroup option tbody td tfoot th thead title tr".split())
SCOPE = frozenset("button caption html object table td template th".split())
SPACE = re.compile(r"\s+")
#: Spread of the smoothing in lines, and smoothed characters a tag that count as prose on any page.
SIGMA, PROSE = 1.0, 15.0
#: What an article or main element multiplies its lines' ratios by.
PRIOR = 2.0
#: Lines beside a content line that may join its region outside of articles, and the share of a region's letters
#: inside links from which its lines of links are a menu.
REACH, LINKS = 8, 0.65


def marked(names: str) -> bool:
    """Does a class or id name boilerplate?"""
    return any(n.lower() in NAMED or PART.search(n) for n in names.split())


def letters(text: str) -> int:
    return sum(map(str.isalnum, text))


class Lines(HTMLParser):
    """Lines as [text, number of tags, in an article or main element, letters inside links, links], in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = [[[], 0, 0, 0, 0]]
        self.open: list[tuple[str, bool, bool]] = []
        self.count: dict[str, int] = {}
        self.aside = self.main = 0

    def _line(self):
        if self.lines[-1][0] or self.lines[-1][1] > 8:
            self.lines.append([[], 0, self.main, 0, 0])

    def _close(self, upto: int):
        for tag, aside, main in self.open[upto:]:
            self.count[tag] -= 1
            self.aside -= aside
            self.main -= main
        del self.open[upto:]

    def _end_p(self):
        if not self.count.get("p"):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == "p":
                return self._close(i)
            if self.open[i][0] in SCOPE:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end_p()
        if not self.aside:
            if tag in BLOCKS:
                self._line()
            self.lines[-1][1] += 1
            self.lines[-1][4] += tag == "a"
        if tag in VOID:
            return
        if tag in CLOSES and self.open and self.open[-1][0] in CLOSES[tag]:
            self._close(len(self.open) - 1)
        aside = tag in ASIDE and not (tag == "header" and self.main)  # an article's own header is judged as text
        main = tag in ("article", "main")
        if not aside and attrs and not (main or tag == "body" or tag == "html"):
            for k, v in attrs:
                if v and (k in ("class", "id") and marked(v) or k == "role" and v.lower() in ROLES or k == "aria-hidden" and v == "true"):
                    aside = True
            aside |= any(k == "hidden" for k, _ in attrs)
        if main and self.count.get("article") and any(v and marked(v) for k, v in attrs if k in ("class", "id")):
            aside = True  # a reader's comment inside the article
        self.open.append((tag, aside, main))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.aside += aside
        self.main += main
        if self.main != self.lines[-1][2]:
            self._line()
            self.lines[-1][2] = max(self.main, self.lines[-1][2]) if self.lines[-1][0] else self.main

    def handle_startendtag(self, tag, attrs):
        if not self.aside:
            if tag in BLOCKS:
                self._line()
            self.lines[-1][1] += 1

    def handle_endtag(self, tag):
        if not self.aside:
            self.lines[-1][1] += 1
        if self.count.get(tag):  # an end without a beginning costs no search
            self._close(next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag))
        if tag in BLOCKS and not self.aside:
            self._line()
            self.lines[-1][2] = self.main

    def handle_data(self, data):
        if not self.aside:
            self.lines[-1][0].append(data)
            if self.count.get("a"):
                self.lines[-1][3] += letters(data)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbours; the edge repeats itself."""
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), weights / weights.sum(), "valid")


def threshold(values: np.ndarray) -> float:
    """Border between the two clusters of values: halfway between their means, moved until it rests."""
    at = values.mean()
    for _ in range(50):
        low, high = values[values <= at], values[values > at]
        if not len(low) or not len(high):
            break
        if abs((new := (low.mean() + high.mean()) / 2) - at) < 1e-9:
            break
        at = new
    return float(at)


def select(sizes: np.ndarray, tags: np.ndarray, inside: np.ndarray, linked: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Which lines are content, from their characters, tags, whether they lie in an article, the share of letters inside
    links, and links.

    Lines of links are a menu where the smoothed share around them is large, or if they hold several links and nothing
    else; a link in a short sentence between paragraphs is none. In an article, links between two other lines belong to
    it, as a list of references does.
    """
    raw = sizes / np.maximum(1, tags)
    ratio = smooth(np.where(inside, PRIOR * raw, raw))
    # Two clusters need a clear gap; a line that reads like prose by itself stays whatever stands around it.
    least = min(threshold(ratio), PROSE) if raw.max() > 4 * raw.min() else -1.0
    menu = (linked > 0.5) & ((smooth(linked) > LINKS) | (linked > 0.75) & (links >= 3))
    place = np.arange(len(sizes))
    border = np.cumsum(np.concatenate([[False], inside[1:] != inside[:-1]]))
    other = inside & ~menu
    enclosed = [np.zeros(len(sizes), bool) for _ in range(2)]
    for k, at in enumerate((np.maximum.accumulate(np.where(other, place, -1)), np.minimum.accumulate(np.where(other, place, len(sizes))[::-1])[::-1])):
        enclosed[k] = (at >= 0) & (at < len(sizes)) & (border[np.clip(at, 0, len(sizes) - 1)] == border)
    menu &= ~(inside & enclosed[0] & enclosed[1])
    content = (np.maximum(ratio, raw) > least) & ~(menu & (raw <= least))
    # Other short lines join the region of a content line within reach: headings, list items, captions. An article is
    # one region; a line across its border doesn't join.
    far = len(sizes) + REACH + 1
    before = np.maximum.accumulate(np.where(content, place, -far))
    after = np.minimum.accumulate(np.where(content, place, far + len(sizes))[::-1])[::-1]
    near = np.zeros(len(sizes), bool)
    for at in (before, after):
        seen = (at >= 0) & (at < len(sizes))
        near |= seen & (inside | (np.abs(place - at) <= REACH)) & (border[np.clip(at, 0, len(sizes) - 1)] == border)
    return content | (near & ~menu)


def main_text(html: str | None) -> str:
    """Content blocks in page order, joined by a space; white space inside a block is one space."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    texts = [SPACE.sub(" ", "".join(line[0])).strip() for line in parser.lines]
    found = [(t, tags, bool(main), link / max(1, letters(t)), links) for t, (_, tags, main, link, links) in zip(texts, parser.lines, strict=True) if t]
    if not found:
        return ""
    _, tags, inside, linked, links = zip(*found, strict=True)
    chosen = select(np.array([len(f[0]) for f in found], float), np.array(tags, float), np.array(inside), np.array(linked, float), np.array(links))
    return " ".join(f[0] for f, use in zip(found, chosen, strict=True) if use)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html), from the whole html.

    A null or empty html gives an empty text. Broken markup is read as it comes; nothing is cut off. Repeated
    rows come back as often; other columns are left aside; an empty table gives an empty one.
    """

    def run(batches):
        for x in batches:
            text = [main_text(h if isinstance(h, str) else None) for h in x.html]
            yield pd.DataFrame({"page_id": x.page_id.to_numpy(), "url": x.url.to_numpy(), "text": text, "n_chars": [len(t) for t in text]})

    source = pages.selectExpr("cast(cast(page_id as long) as string) page_id", "cast(url as string) url", "cast(html as string) html")  # as text: a null among numbers makes them floats
    out = source.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
