"""Operator 6: main text of web pages by consensus paths of their hosts."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unused
from .url_filter import host_of

#: A tag up to its end; quotes count after an equals sign only. Nothing in it is tried twice, so it takes linear time.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
#: Their content is text that is no markup.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li",
    "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that are never part of the article.
OUTSIDE = {
    "head", "nav", "menu", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "noframes", "noembed",
    "button", "select", "option", "input", "textarea", "label", "svg", "canvas", "object", "audio", "video", "map", "dialog", "title",
}
#: Words that mark what is not the article, where a class, id or role has none but these and neutral ones: `main-ad`, not `has-sidebar`.
BOILER = {
    "ad", "ads", "advert", "advertisement", "advertising", "adverts", "adbox", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "menubar", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notices", "paywall", "popup", "promo", "promoted", "promotion", "related", "replies",
    "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
NEUTRAL = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content",
    "desktop", "entry", "fixed", "floating", "form", "global", "group", "icon", "icons", "inner", "item", "items", "js", "link", "links",
    "list", "main", "message", "mobile", "module", "outer", "overlay", "page", "panel", "policy", "post", "posts", "primary", "region",
    "row", "secondary", "section", "site", "slot", "sticky", "text", "title", "top", "unit", "wp", "wrap", "wrapper", "zone",
}
#: A start tag in a key's list ends an open element of the key that is not beyond one of the barriers.
ENDS = {
    "p": (BLOCK - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"button", "table", "td", "th"}),
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "th": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "tr": ({"tr", "tbody", "tfoot"}, {"table"}),
    "option": ({"option", "optgroup"}, {"select"}),
}
STARTS: dict[str, list[str]] = {t: [k for k, (starts, _) in ENDS.items() if t in starts] for t in BLOCK | {"option", "optgroup"}}
#: Elements that may hold an article.
CONTAINER = {"article", "main", "section", "div", "td", "body", "center", "blockquote", "html"}
#: Blocks whose text makes a container likely to be the article.
TELLING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "dd", "td", "div", "section", "article", "main", "body"}


class Element:
    """An open element. path numbers its generalised path, block and container are the nearest such elements from itself up."""

    __slots__ = ("tag", "path", "outside", "parent", "at", "block", "container", "wall", "link")

    def __init__(self, tag: str, path: int, outside: bool, parent: Element | None, at: int):
        self.tag, self.path, self.outside, self.parent, self.at = tag, path, outside, parent, at
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.container = self if tag in CONTAINER else parent and parent.container
        #: The place of the nearest element that no inline end tag beyond it closes.
        self.wall = at if tag in ("td", "th", "table", "article", "body") else parent.wall if parent else -1
        #: Steps down from the nearest link; text within three of them is link text.
        self.link = 0 if tag == "a" else min(4, parent.link + 1) if parent else 4


class Blocks(list):
    """(innermost block element, text, characters of it in links) of a page's blocks, and the page's generalised paths.

    A path is a number; its step's name and the path above it are in steps, where those above come first. So a path
    costs the same memory at any depth.
    """

    def __init__(self):
        super().__init__()
        self.steps: list[tuple[str, int]] = [("", -1)]
        self.numbers: dict[tuple[int, str], int] = {}

    def step(self, up: int, name: str) -> int:
        found = self.numbers.get((up, name))
        if found is None:
            found = self.numbers[up, name] = len(self.steps)
            self.steps.append((name, up))
        return found

    def path(self, number: int) -> str:
        names = []
        while number > 0:
            name, number = self.steps[number]
            names.append(name)
        return "".join(f">{n}" for n in reversed(names))

    def number(self, path: str) -> int | None:
        """The number of a path written out, None if the page does not have it."""
        at: int | None = 0
        for name in path.split(">")[1:]:
            at = self.numbers.get((at, name))
            if at is None:
                return None
        return at

    def tag(self, number: int) -> str:
        return self.steps[number][0].partition(".")[0]

    def below(self, number: int) -> list[str]:
        """The texts of the blocks at the path and below it."""
        inside = [False] * len(self.steps)
        for k, (_, up) in enumerate(self.steps):
            inside[k] = k == number or (up >= 0 and inside[up])
        return [text for element, text, _ in self if inside[element.path]]


def general_name(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's step of a generalised path, and whether its class, id or role says it is no part of an article.

    A step is the tag and its sorted class names, with digits left out so that numbered classes agree.
    """
    if not attributes or attributes.isspace():
        return tag, False
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    classes = found.get("class", "").split()
    boiler = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if tag not in ("html", "body", "article", "main"):
        for x in (*classes, found.get("id", ""), found.get("role", "")):
            words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()) if w}
            boiler = boiler or (not BOILER.isdisjoint(words) and words <= BOILER | NEUTRAL)
    names = sorted({re.sub(r"[\d>.]+", "", x).strip("-_") for x in classes} - {""})
    return ".".join([tag, *names]), boiler


def blocks_of(page: str) -> Blocks:
    """The blocks of text of a page that are not boilerplate, in page order.

    A block is what stands between starts and ends of block elements; its white space is single spaces. Open
    paragraphs, list items and cells end where the next one starts, and an end tag without an open element is nothing.
    What follows a tag or comment that never ends is nothing either. Time is linear in the page, however deep it is.
    """
    out = Blocks()
    top = Element("", 0, False, None, 0)
    stack = [top]
    opened: dict[str, list[int]] = {}
    text: list[str] = []
    links = 0
    at = 0

    def ended() -> None:
        nonlocal links
        if text:
            whole = SPACE.sub(" ", "".join(text)).strip()
            if whole:
                out.append((stack[-1].block, whole, min(links, len(whole))))
            text.clear()
            links = 0

    def said(raw: str) -> None:
        nonlocal links
        if raw and not stack[-1].outside:
            plain = html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if stack[-1].link < 4:
                links += len(plain.strip())

    def last(tag: str) -> int:
        """The place of the innermost open element of that tag, 0 without any."""
        places = opened.get(tag)
        return places[-1] if places else 0

    def close(k: int) -> None:
        if stack[-1].block.at >= k:
            ended()
        while len(stack) > k:
            opened[stack.pop().tag].pop()

    while True:
        less = page.find("<", at)
        if less < 0:
            said(page[at:])
            break
        said(page[at:less])
        mark = TAG.match(page, less)
        if mark is None:
            if page.startswith("!--", less + 1):
                at = page.find("-->", less + 2) + 3
                if at == 2:
                    break
            elif page.startswith(("!", "?", "/"), less + 1):
                at = page.find(">", less) + 1
                if not at:
                    break
            elif page[less + 1 : less + 2].isalpha() and page[less + 1] < "\x7f":
                break
            else:
                said("<")
                at = less + 1
            continue
        at = mark.end()
        tag = mark[2].lower()
        if mark[1]:
            k = last(tag)
            if k and (tag in BLOCK or stack[-1].wall <= k):
                close(k)
            elif tag == "p":
                ended()
            continue
        for kind in STARTS.get(tag, ()):
            k = last(kind)
            if k and k > max(map(last, ("article", "main", "body", *ENDS[kind][1]))):
                close(k)
        if tag == "br":
            if not stack[-1].outside:
                text.append(" ")
            continue
        if tag in BLOCK:
            ended()
        if tag in VOID:
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            if not at:
                break
            continue
        if mark[3].endswith("/") and tag not in BLOCK:
            continue
        name, boiler = general_name(tag, mark[3])
        up = stack[-1]
        path = out.step(up.path, name) if tag in BLOCK else up.path
        opened.setdefault(tag, []).append(len(stack))
        stack.append(Element(tag, path, up.outside or boiler or tag in OUTSIDE, up, len(stack)))
    ended()
    return out


def elected(found: Blocks, most: float = 0.9) -> tuple[int, float]:
    """The number of the path of a page's article and the characters below it outside links.

    From the page down, the election goes on to a part as long as it holds at least that share of the text, then up
    to the container around it: an article that is split over siblings keeps them all. A headline or an article or main
    element that is around it, or beside it in a container, belongs to it too.
    """
    weight = [0.0] * len(found.steps)
    title = None
    for element, text, links in found:
        if element.tag in TELLING:
            weight[element.path] += len(text) - links
        if element.tag == "h1" and title is None and element.container is not None:
            title = element.container.path
    best: list[int | None] = [None] * len(weight)
    for k in range(len(weight) - 1, 0, -1):
        up = found.steps[k][1]
        weight[up] += weight[k]
        if best[up] is None or weight[k] >= weight[best[up]]:
            best[up] = k
    at = 0
    while best[at] is not None and weight[best[at]] > 0 and weight[best[at]] >= most * weight[at]:
        at = best[at]
    while at and found.tag(at) not in CONTAINER:
        at = found.steps[at][1]
    chosen, x = at, at
    while x > 0:
        if found.tag(x) in ("article", "main") or (x == title and found.tag(x) not in ("body", "html")):
            chosen = x
            if x != title:
                break
        x = found.steps[x][1]
    return chosen, weight[chosen]


def text_at(found: Blocks, paths: list[str]) -> str | None:
    """The blocks below the first of the paths that the page has, joined by line feeds; None if it has none of them."""
    for path in paths:
        number = found.number(path)
        kept = [] if number is None else found.below(number)
        if kept:
            return "\n".join(kept)
    return None


def vote(pages: DataFrame, host: str, html_col: str) -> DataFrame:
    """(host, path, votes, score) by the elected container of each page."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                paths, scores = [], []
                for page in part.column(1).to_pylist():
                    found = blocks_of(page or "")
                    number, score = elected(found)
                    paths.append(found.path(number))
                    scores.append(score)
                yield pa.record_batch([part.column(0), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    votes = pages.select(F.col(host).alias("host"), F.col(html_col).alias("html")).mapInArrow(best, "host string, path string, score double")
    return votes.where("path <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))


def winners(votes: DataFrame, least_share: float = 0.1) -> DataFrame:
    """(host, paths): the host's paths with at least that share of its votes, most votes first; at most 1 / share of them."""
    total = votes.groupBy("host").agg(F.sum("votes").alias("cast"))
    kept = votes.join(total, "host").where(F.col("votes") >= F.col("cast") * least_share)
    order = F.struct((-F.col("votes")).alias("v"), (-F.round("score", 3)).alias("s"), F.col("path").alias("path"))
    return kept.groupBy("host").agg(F.sort_array(F.collect_list(order)).alias("o")).select("host", F.transform("o", lambda x: x["path"]).alias("paths"))


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_share: float = 0.1) -> DataFrame:
    """pages without the html, with text and n_chars (code points).

    Every page elects the container of its article, whose generalised path votes for the page's host. The page's text is
    then taken anew from the host's winning paths, in the order of their votes, or from the container that it
    elected itself where it has none of them: a rare template thus loses its own vote only where the page also has a path
    that won. A null or empty html, or one without an article, gives the empty text. Pages without a
    host vote together, repeated pages vote each, and ties go to the longer text, then to the path's code points. Pages
    are parsed one by one, in time and memory linear in their length. Columns of the added names are replaced, all
    others stay; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "html_extract")
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    markup, host, paths = unused(pages, "markup", "host", "paths")
    rows = pages.select(*others, F.col(html_col).cast("string").alias(markup), host_of(pages[url_col]).alias(host))
    won = scratch.save(winners(vote(rows, host, markup), least_share), "winners")
    won = won.select(F.col("host").alias(host), F.col("paths").alias(paths))
    rows = rows.join(won, host, "left").select(*others, markup, paths)
    schema = rows.select(*others).schema.add("text", "string").add("n_chars", "long")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(others)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                texts = []
                for page, paths in zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist(), strict=True):
                    found = blocks_of(page or "")
                    text = text_at(found, paths or [])
                    texts.append(text if text is not None else "\n".join(found.below(elected(found)[0])))
                yield pa.record_batch([*part.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(extract, schema)
