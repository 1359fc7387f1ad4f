"""Main text of web pages through a site style tree.

The DOMs of one host are merged into a style tree: elements that are reached by the same path of
tags and classes are one node. A node's presentation is important if its pages differ in the
elements it holds; its content is important if its pages differ in the texts and links it holds.
Both are entropies over the host's pages (Yi, Liu and Li 2003). The importance of a branch is the
discounted mean of its nodes' importances, and branches below a threshold are removed from every
page, as are elements whose tag or role says that they are no article. A class or id says so only
outside article and main elements; inside, the importance alone decides on such branches.

Pages are parsed inside tasks; what is shuffled are counts of hashes per style node, combined
within each task, and never whole DOMs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import id_text
from souk.session import settle

#: Weight of an element of a branch falls by this factor with each level below its head.
DISCOUNT = 0.9
#: Branches of less importance are removed. On hosts of fewer different pages the threshold falls with the
#: logarithm of their number, which is the largest entropy there is; one page alone tells nothing.
THRESHOLD = 0.2
LEAST_PAGES = 5
#: Style paths are kept to this depth; what lies deeper counts as its ancestor's own.
DEPTH = 24

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
NEVER = frozenset(
    "script style noscript template head nav header footer aside form button select option textarea input iframe "
    "object canvas svg math audio video dialog menu datalist".split()
)
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot "
    "tr td th caption figure figcaption address details summary hgroup center fieldset legend hr nav header footer "
    "aside form".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
#: Words of a class or id that mark what is no article, and words that may stand beside them in a class.
_MARKS = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|widget|related|recommend\w*|share|social|comments?|"
    r"respond|reply|replies|disqus|footer|masthead|site-header|page-header|newsletter|subscribe|signup|login|"
    r"search|pagination|pager|skip-link|toolbar|toc"
)
_BESIDE = (
    r"box|bar|area|list|wrap|wrapper|container|block|section|links?|icons?|buttons?|posts?|articles?|items?|inner|outer|"
    r"top|bottom|left|right|main|site|page|primary|secondary|header|form"
)
NOISE_CLASS = re.compile(rf"(?:(?:{_MARKS}|{_BESIDE})[_-]+)*(?:{_MARKS})(?:[_-]+(?:{_MARKS}|{_BESIDE}))*", re.IGNORECASE)
NOISE_ID = re.compile(_MARKS, re.IGNORECASE)
#: Ids of these are the addresses of what they hold, and say nothing about its part in the page.
ADDRESSED = frozenset("html body article main section h1 h2 h3 h4 h5 h6 p li dt dd".split())
#: A start tag of the first closes an open element of the second.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = frozenset("ul ol dl table select article section main div body html td th".split())
PARAGRAPH_ENDS = BLOCK - {"html", "body"}

_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+")


def _landmark(path: str) -> bool:
    """Whether a style path leads through an article or main element."""
    return any(step.split(".")[0] in ("article", "main") for step in path.split("/"))


def _marked(tag: str, given: dict) -> bool:
    """Whether a whole class name, or the whole id of a container, is made of words that mark no article."""
    if tag in ("html", "body", "article", "main"):
        return False
    if any(NOISE_CLASS.fullmatch(name) for name in given.get("class", "").split()):
        return True
    return tag not in ADDRESSED and bool(NOISE_ID.fullmatch(given.get("id", "").strip()))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


class Page(HTMLParser):
    """One pass over a page: blocks of text with their style path, and what each style node holds."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        # Open elements: tag, style path, whether inside something that is no article, children seen.
        self.open: list[list] = [["", "", False, []]]
        self.blocks: list[tuple[str, str]] = []
        self.held: Counter = Counter()
        self.shown: Counter = Counter()
        self.parts: list[str] = []
        self.at = ""
        self.feed(html)
        self.close()
        self._cut()
        while len(self.open) > 1:
            self._leave()

    def _cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text:
            self.blocks.append((self.at, text))
            self.held[self.at, _hash(text)] += 1

    def _leave(self) -> None:
        _, path, noise, children = self.open.pop()
        if path and not noise:
            self.shown[path, _hash(" ".join(children))] += 1

    def _close_to(self, depth: int) -> None:
        if any(e[0] in BLOCK for e in self.open[depth:]):
            self._cut()
        while len(self.open) > depth:
            self._leave()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag in CLOSES:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth][0] in CLOSES[tag]:
                    self._close_to(depth)
                elif self.open[depth][0] in SCOPES:
                    break
        if tag in PARAGRAPH_ENDS:
            # A block ends an open paragraph, with whatever inline elements were left open in it.
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth][0] == "p":
                    self._close_to(depth)
                    break
                if self.open[depth][0] in BLOCK:
                    break
        parent = self.open[-1]
        marks = _SPACE.sub(".", _NUMBER.sub("0", given.get("class", "").strip()))
        name = f"{tag}.{marks}" if marks else tag
        parent[3].append(name)
        if tag == "br":
            self.parts.append(" ")
        if tag == "a" and not parent[2] and "href" in given:
            self.held[parent[1], _hash("href " + given["href"])] += 1
        if tag in BLOCK:
            self._cut()
        if tag in VOID:
            return
        noise = (
            parent[2]
            or (tag in NEVER and not (tag == "header" and _landmark(parent[1])))
            or given.get("role", "").lower() in ROLES
            or "hidden" in given
            or given.get("aria-hidden", "").lower() == "true"
            or (_marked(tag, given) and not any(e[0] in ("article", "main") for e in self.open))
        )
        path = f"{parent[1]}/{name}" if len(self.open) <= DEPTH else parent[1]
        self.open.append([tag, path, noise, []])
        if tag in BLOCK:
            self.at = path

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                self._close_to(depth)
                self.at = next((e[1] for e in reversed(self.open) if e[0] in BLOCK), "")
                return
            if self.open[depth][0] in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data: str) -> None:
        if not self.open[-1][2]:
            if not self.parts:
                self.at = next((e[1] for e in reversed(self.open) if e[0] in BLOCK), "")
            self.parts.append(data)


def in_article(path: str) -> bool:
    """Whether a style path is plain running text of an article: an article or main element, then bare elements."""
    steps = path.split("/")
    for k in range(len(steps) - 1, -1, -1):
        if steps[k].split(".")[0] in ("article", "main"):
            return True
        if "." in steps[k]:
            return False
    return False


def main_text(page: Page, noise: frozenset[str] = frozenset()) -> str:
    """The blocks of a page that lie in no removed branch, joined by line breaks.

    A page that consists of removed branches only has no article, and an empty text.
    """

    def removed(path: str) -> bool:
        if in_article(path):
            return False
        steps = path.split("/")
        return any("/".join(steps[: k + 1]) in noise for k in range(1, len(steps)))

    kept = [text for path, text in page.blocks if not (noise and removed(path))]
    return "\n".join(kept)


def host_of(url: str = "url") -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host.alias("host")


def style_counts(pages: DataFrame) -> DataFrame:
    """(host, page, path, kind, item, n): what each style node of each different page holds.

    ``kind`` is 0 for the sequence of child elements and 1 for texts and links. ``page`` is a hash
    of everything the page shows, so copies of a page are one page.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for host, html in zip(rows["host"], rows["html"]):
                page = Page(html)
                key = _hash("\n".join(t for _, t in page.blocks))
                out += [(host, key, p, 0, item, n) for (p, item), n in page.shown.items()]
                out += [(host, key, p, 1, item, n) for (p, item), n in page.held.items()]
            yield pd.DataFrame(out, columns=["host", "page", "path", "kind", "item", "n"])

    slim = pages.select(host_of(), F.coalesce("html", F.lit("")).alias("html")).where("host <> '' and html <> ''")
    return slim.mapInPandas(count, "host string, page bigint, path string, kind int, item bigint, n bigint")


def noise_branches(pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, path): heads of style branches whose importance lies below the threshold of their host."""
    counts = settle(style_counts(pages).distinct(), "styles")
    different = counts.select("host", "page").distinct()
    sizes = settle(different.groupBy("host").agg(F.count("*").alias("m")), "hosts").where("m > 1")
    log = F.log("m")
    # Entropy over pages from sums alone: with n_i of n on page i it is log n - sum(n_i log n_i) / n.
    items = counts.groupBy("host", "path", "kind", "item").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.log("n")).alias("nlog"),
        F.count("*").alias("pages"),
    )
    even = F.log("n") - F.col("nlog") / F.col("n")
    nodes = items.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("elements"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("elog"),
        F.avg(F.when(F.col("kind") == 1, even)).alias("evenness"),
        F.max(F.when(F.col("kind") == 1, 1)).alias("holds"),
    )
    nodes = nodes.join(sizes, "host")
    # Presentation: entropy of the child sequences. Content: one less the mean evenness of what is held.
    shape = F.log("elements") - F.col("elog") / F.col("elements")
    content = 1 - F.col("evenness") / log
    own = F.when(F.col("holds").isNotNull(), content).otherwise(F.coalesce(shape / log, F.lit(0.0)))
    own = F.least(F.lit(1.0), F.greatest(F.lit(0.0), own))
    steps = F.split("path", "/")
    heads = F.transform(
        F.sequence(F.lit(2), F.size(steps)),
        lambda k: F.struct(F.array_join(F.slice(steps, 1, k), "/").alias("head"), (F.size(steps) - k).alias("below")),
    )
    weight = F.pow(F.lit(DISCOUNT), F.col("h.below")) * F.log1p(F.coalesce("elements", F.lit(1)))
    spread = nodes.where(F.size(steps) >= 2).select(
        "host", own.alias("own"), "elements", F.col("holds").isNotNull().alias("holds"), F.explode(heads).alias("h")
    )
    # Bare containers say little: a branch is judged by the content in it, if there is any.
    weight = weight * F.when(F.col("holds"), 1.0).otherwise(0.05)
    branches = spread.groupBy("host", F.col("h.head").alias("path")).agg(
        (F.sum(weight * F.col("own")) / F.sum(weight)).alias("importance")
    )
    # A host of many pages has the whole threshold.
    full = math.log(max(least_pages, 2))
    scale = F.least(F.lit(1.0), log / full)
    return branches.join(sizes, "host").where(F.col("importance") < threshold * scale).select("host", "path")


def main_texts(pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Texts of a page are its article blocks in page order, joined by line breaks. A NULL or empty
    page has an empty text, as has one of removed branches only; a page without host, or alone on its
    host, is judged by its elements alone. With fewer than ``least_pages`` different pages the
    threshold is lower. Broken markup is read as browsers do: what
    is left open ends with its parent or the page. Only page_id, url and html are read.
    """
    noise = noise_branches(pages, threshold, least_pages)
    noise = settle(noise.groupBy("host").agg(F.collect_set("path").alias("noise")), "noise")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [
                main_text(Page(html), frozenset(n if n is not None else ())) if html else ""
                for html, n in zip(rows["html"], rows["noise"])
            ]
            yield rows[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    slim = pages.select(id_text("page_id"), F.col("url").cast("string").alias("url"), host_of(), F.coalesce("html", F.lit("")).alias("html"))
    joined = slim.join(noise, "host", "left").select("page_id", "url", "html", "noise")
    texts = joined.mapInPandas(extract, "page_id string, url string, text string, n_chars bigint")
    return texts.withColumn("page_id", F.col("page_id").cast("bigint"))
