"""Operator 3: main text of web pages.

Events of the standard library's streaming parser become lines: blocks of text with the number of tags beside them.
A line's text-to-tag ratio counts only text outside links and menus. The ratios are smoothed by a Gaussian over the
lines beside it in the same section, so that a long article does not lift a short block that stands next to it; lines
that are the only one of their section are smoothed with those around it. Lines whose smoothed ratio reaches a share of
the page's typical ratio (the median over characters, so that many tiny lines do not set it; ratios end at ``FULL``, so
that one huge line does not either) are dense, and runs of them are clusters. Clusters admit the sections their lines stand in
and the smallest section around them, and article elements, but lines of links only just where their own section is
dense or the lines beside them are. So menus fall by their density, and so do short blocks before and after the article,
marked or not. A block without marks that is as dense as the article is kept.

Lists of elements, roles and class names only veto: scripts, forms, adverts, notices, sidebars, footers, comments and
the like have ratio zero, part clusters, and are never content.

Null and empty html give an empty text, and so do pages whose whole text is in links and menus. Pages that lack any structure are one line. Broken markup is read as
browsers do where the parser does; what it cannot read as markup is text. Repeated pages get equal texts.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .common import map_text

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VETOED = set("aside audio button canvas dialog footer form head header iframe noscript object script select style svg template textarea title video".split())
ROLES = set("alert banner complementary contentinfo dialog form search".split())
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|disqus|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|related|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|widget)(?:$|[\s_-])",
    re.I,
)
LINKS = set("a menu nav".split())
#: Elements that a cluster is completed to; the page itself, html and body are no section.
SECTIONS = set("article blockquote center details div fieldset main nav section table td".split())
#: Lines to each side in the Gaussian, its width, and the threshold as a share of the page's typical ratio.
RADIUS, SIGMA, THRESHOLD = 2, 1.0, 0.3
#: Characters a tag at which text is as dense as can be; beyond, one huge line would make all others sparse.
FULL = 100.0


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters inside links and menus
    section: int  # 0: the page
    vetoed: bool

    @property
    def link_only(self) -> bool:
        return self.linked >= len(self.text)


class Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, vetoed, section around it
        self.skip = 0  # open vetoed elements
        self.links = 0  # open links and menus
        self.section = 0
        self.parents = [0]  # of sections; 0: the page
        self.articles: set[int] = set()
        self.parts: list[str] = []
        self.noise = False
        self.linked = 0
        self.tags = 0
        self.lines: list[Line] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if self.noise:
            self.lines.append(Line("", self.tags, 0, self.section, True))
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.section, False))
        if text or self.noise:
            self.tags = 0
        self.parts, self.linked, self.noise = [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        own = dict(attrs)
        marked = tag not in ("html", "body") and bool(MARKS.search(" ".join(own.get(k) or "" for k in ("class", "id"))) or (own.get("role") or "").lower() in ROLES or "hidden" in own or (own.get("aria-hidden") or "").lower() == "true")
        veto = tag in VETOED or marked
        self.open.append((tag, veto, self.section))
        self.skip += veto
        self.links += tag in LINKS
        if tag in SECTIONS:
            self.parents.append(self.section)
            self.section = len(self.parents) - 1
        if tag == "article":
            self.articles.add(self.section)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self.end_line()
        self.tags += 1
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None or (tag not in BREAKS and any(t in BREAKS and t != "p" for t, *_ in self.open[at + 1 :])):
            return
        for t, veto, _ in self.open[at:]:
            self.skip -= veto
            self.links -= t in LINKS
            if veto and t in BREAKS:
                self.tags = 0  # its tags are not the next line's
        self.section = self.open[at][2]
        del self.open[at:]

    def handle_data(self, data):
        if self.skip:
            self.noise = self.noise or not data.isspace()
        else:
            self.parts.append(data)
            if self.links:
                self.linked += len(" ".join(data.split()))


def page_lines(html: str | None) -> tuple[list[Line], list[int], set[int]]:
    """Lines, the section around each section, and which sections are articles."""
    html = html or ""
    for text in (html, re.sub(r"<(?=!\[|\?)", "&lt;", html)):
        parser = Lines()
        try:
            parser.feed(text)
            parser.close()
        except AssertionError:  # the parser meets a marked section that it does not know
            continue
        parser.end_line()
        return parser.lines, parser.parents, parser.articles
    return [], [0], set()


def groups(lines: list[Line], parents: list[int]) -> np.ndarray:
    """The section in which each line is smoothed: the smallest around it that has another line."""
    held = np.zeros(len(parents), int)
    for x in lines:
        held[x.section] += not x.vetoed
    for k in range(len(parents) - 1, 0, -1):  # a section's number is over its parent's
        held[parents[k]] += held[k]
    found = []
    for x in lines:
        at = x.section
        while at and held[at] < 2:
            at = parents[at]
        found.append(at)
    return np.array(found)


def typical(ratio: np.ndarray, sizes: np.ndarray) -> float:
    """The ratio of the line in which the middle character stands, by ascending ratio."""
    order = np.argsort(ratio, kind="stable")
    order = order[ratio[order] > 0]
    weight = np.cumsum(sizes[order])
    return float(ratio[order[np.searchsorted(weight, weight[-1] / 2)]]) if len(order) else 0.0


def dense_lines(lines: list[Line], parents: list[int]) -> np.ndarray:
    """Which lines reach the threshold of the smoothed text-to-tag ratio; vetoed ones and those of links only never do."""
    sizes = np.array([0.0 if x.vetoed else max(0, len(x.text) - x.linked) for x in lines])
    ratio = np.minimum(FULL, sizes / np.array([1 + x.tags for x in lines]))  # one more: the tag that ends it
    group = groups(lines, parents)
    total, weight = ratio.copy(), np.ones(len(lines))
    same = np.ones(len(lines), bool)
    for step in range(1, min(RADIUS, len(lines) - 1) + 1):
        # Lines a step apart with no other group between them.
        same = same[: len(lines) - step] & (group[step - 1 : -1] == group[step:])
        share = np.exp(-0.5 * (step / SIGMA) ** 2) * same
        total[step:] += share * ratio[:-step]
        total[:-step] += share * ratio[step:]
        weight[step:] += share
        weight[:-step] += share
    return (ratio > 0) & (total / weight >= THRESHOLD * typical(ratio, sizes))


def around(sections: list[int], parents: list[int]) -> int:
    """The smallest section around all; a section's number is over its parent's."""
    a = sections[0]
    for b in sections[1:]:
        while a != b:
            a, b = (parents[a], b) if a > b else (a, parents[b])
    return a


def main_text(html: str | None) -> str:
    lines, parents, articles = page_lines(html)
    dense = dense_lines(lines, parents) if lines else np.zeros(0, bool)
    at = np.flatnonzero(dense)
    if not len(at):
        return ""
    first, last = at[0], at[-1]
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    holds = {lines[k].section for k in at}
    # A cluster is completed to the section around it; all clusters together, to the section around all.
    whole = {around([lines[k].section for k in run], parents) for run in [*runs, at]} - {0} | articles
    inside = [False]
    for k in range(1, len(parents)):
        inside.append(k in whole or inside[parents[k]])
    kept = []
    for k, x in enumerate(lines):
        if x.vetoed:
            continue
        completed = inside[x.section] or x.section in holds or first < k < last
        beside = first < k < last and dense[k - 1] and dense[k + 1]
        if dense[k] or beside or (x.section and x.section in holds) or (completed and not x.link_only):
            kept.append(x.text)
    return " ".join(kept)


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep``, text and n_chars (code points) for every row."""

    def make():
        def apply(pages):
            texts = [main_text(p) for p in pages]
            return [texts, [len(t) for t in texts]]

        return apply

    return map_text(df, html, make, {"text": "string", "n_chars": "bigint"}, list(keep))
