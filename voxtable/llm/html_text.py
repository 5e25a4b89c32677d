"""Main text of web pages by consensus host paths (operator 2).

First pass: each page's containers are scored by the prose in them, and the page votes for the generalised
tag-class paths of its best ones; Spark sums the votes per host. Second pass: each page is extracted
anew from the container on its host's winning path; where a page lacks it, or holds little
there, from the page's own best container.

A path is the innermost STEPS elements down to the container, each with its sorted class and id words, digits
generalised. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out by tag, role, hidden state or class and id words, whatever their size. Only a wrapper of the article stays: a form or an
element known by role or words of layout (or that bears words of an article, too) which holds most of the page's text
and in it a top heading or an article's element. Headings within an article's header stay. Blocks are
joined by one newline; white space within a block, line breaks included, is one space; references are decoded.
Parsing takes time in proportion to the page.

Edge cases. Null html is empty and gives an empty text, as do pages without text. Unclosed and misnested tags close
with what contains them. A null url or one without a host shares the empty host. Ties of votes go to
the greater path, of containers to the innermost, then the first. Rows may repeat; empty tables give no rows; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spool, table
from .url_filters import host_of

STEPS, VOTES, LEAST_SHARE = 6, 3, 0.3
OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
TAG = re.compile(
    r"<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*))>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
GONE = set(
    "head script style title noscript template iframe noembed noframes svg canvas object audio video nav aside footer "
    "form button select textarea menu dialog".split()
)
CONTAINERS = set("html body div article main section td center".split())
BLOCKS = CONTAINERS | set(
    "html p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr th blockquote pre figure figcaption "
    "header address hr fieldset legend details summary hgroup search".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
WITH = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words that a wrapper of the whole layout may bear as well.
LAYOUT = set(
    "banner sidebar side nav navbar navigation menu breadcrumb breadcrumbs masthead footer share sharing social related overlay modal "
    "widget widgets toolbar pagination pager".split()
)
NOISE = LAYOUT | set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices notification comment comments commentlist disqus respond reply replies discussion "
    "recommended recommendations newsletter subscribe subscription signup login popup teaser teasers".split()
)
GOOD = set("article content post entry story main body text prose".split())
WHOLE = {"html", "body", "article", "main"}


class Node:
    """An element. soft: left out unless it wraps the article, which it can where ``wraps``; held: characters of text within;
    heart: holds a top heading or an article's element; mass: prose within; near: the innermost container around."""

    __slots__ = ("parent", "tag", "steps", "gone", "soft", "wraps", "good", "size", "links", "score", "depth", "held", "heart", "headed", "mass", "near")

    def __init__(self, parent: Node | None, tag: str, steps: tuple[str, ...], gone: bool, soft: bool, wraps: bool, good: bool):
        self.parent, self.tag, self.steps, self.gone, self.soft, self.wraps, self.good = parent, tag, steps, gone, soft, wraps, good
        self.size = self.links = self.score = self.held = self.mass = 0.0
        self.heart = tag == "h1" or (good and not soft)
        self.headed = (tag == "header" and soft) or (parent is not None and parent.headed)
        self.near = self if tag in CONTAINERS or parent is None else parent.near
        self.depth = parent.depth + 1 if parent else 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _element(parent: Node, tag: str, written: str) -> Node:
    found = _attributes(written) if written.strip(" /\n\t\r") else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    words = {w.lower() for n in names for w in WORD.findall(n)}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    gone = tag in GONE or bool(hidden)
    good = bool(words & GOOD) or tag in ("article", "main")
    noise = bool(words & NOISE) and tag not in WHOLE
    soft = found.get("role", "").lower() in ROLES or noise or tag == "header" or ("header" in words and not good and tag not in WHOLE)
    wraps = tag == "form" or not words & (NOISE - LAYOUT) or bool(words & GOOD)
    step = ".".join([tag, *sorted({re.sub(r"\d+", "#", n) for n in names})])
    return Node(parent, tag, (*parent.steps, step)[-STEPS:], gone and tag != "form", soft or tag == "form", wraps, good)


class Page:
    """Block texts of a page with the elements that they stand in."""

    def __init__(self, html: str):
        self.root = Node(None, "html", ("html",), False, False, False, False)
        self.nodes: list[Node] = [self.root]
        self.blocks: list[tuple[Node, str]] = []
        self._parse(html)
        self._judge()

    def _parse(self, html: str) -> None:
        stack, text, linked, in_link = [self.root], [], 0, 0
        counts: Counter[str] = Counter()  # open elements of each tag
        last, last_data = html.rfind(">"), html.rfind("]]>")  # what opens after these never closes
        muted: list | None = None  # [tag, open elements of that tag, where its text began] of an inline element left out

        def unmute() -> None:
            nonlocal muted
            if muted:
                del text[muted[2] :]
                muted = None

        def flush() -> None:
            nonlocal linked
            unmute()
            if text:
                joined = " ".join(unescape("".join(text)).split())
                if joined:
                    node = stack[-1]
                    self.blocks.append((node, joined))
                    node.size += len(joined)
                    node.links += min(linked, len(joined))
                text.clear()
            linked = 0

        def close(to: int) -> None:
            flush()
            counts.subtract(n.tag for n in stack[to:])
            del stack[to:]

        at = seen = 0
        while opened := OPEN.search(html, seen):
            begin = opened.start()
            m = None
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4) + 3
                end = end if end > 2 else len(html)
            elif begin <= last_data and html.startswith("<![CDATA[", begin):
                end = html.find("]]>", begin) + 3
            elif begin > last:
                break
            elif m := TAG.match(html, begin):
                end = m.end()
            else:
                seen = begin + 1
                continue
            if begin > at:
                text.append(html[at:begin])
                if in_link:
                    linked += begin - at
            at = seen = end
            if m is None:
                continue
            ending, tag, written = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag == "a":
                in_link = not ending
            if tag == "br" or tag in VOID:
                if tag == "hr":
                    flush()
                else:
                    text.append(" ")
                continue
            if muted and tag == muted[0]:
                muted[1] += -1 if ending else 1
                if not muted[1]:
                    unmute()
                continue
            if ending:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0) if counts[tag] > 0 else 0
                if k:
                    close(k)
                elif tag in BLOCKS:
                    flush()
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                at = seen = html.find(">", end.start()) + 1 or len(html) if end else len(html)
                continue
            if tag == "html":
                continue
            block = tag in BLOCKS or tag in GONE
            node = _element(stack[-1], tag, written) if block or "class" in written or "id" in written or "hidden" in written else None
            if not block:
                if node is not None and (node.gone or node.soft) and not muted and not written.endswith("/"):
                    muted = [tag, 1, len(text)]
                continue
            flush()
            if stack[-1].tag == "p" or (stack[-1].tag in HEADINGS and tag in HEADINGS):
                close(len(stack) - 1)
            if tag in CLOSES and any(counts[x] > 0 for x in WITH.get(tag, (tag,))):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in CLOSES[tag]:
                        break
                    if stack[k].tag in WITH.get(tag, (tag,)):
                        close(k)
                        break
            if node.parent is not stack[-1]:
                node = _element(stack[-1], tag, written)
            self.nodes.append(node)
            stack.append(node)
            counts[tag] += 1
        if at < len(html):
            text.append(html[at:])
        flush()

    def _judge(self) -> None:
        """Drop what is not prose, sum sizes upwards, score the containers. Parents come before their children in ``nodes``."""
        for node, text in self.blocks:
            node.held += len(text)
        for node in reversed(self.nodes[1:]):
            node.parent.held += node.held
            node.parent.heart = node.parent.heart or node.heart
        most = self.root.held / 2
        for node in self.nodes[1:]:
            p = node.parent
            in_article = p.good or p.tag in ("article", "main")
            # a soft element's own kind says nothing; what lies within it does
            if node.soft and not (node.wraps and node.heart and node.held > most) and not (in_article and node.tag == "header"):
                node.gone = True
            node.gone = node.gone or p.gone
        self.blocks = [(n, text) for n, text in self.blocks if not n.gone and (not n.headed or n.tag in HEADINGS)]
        for node, text in self.blocks:
            much = len(text) * (1 - (node.links / node.size if node.size else 0))
            node.mass += much
            node.near.score += much
        for node in reversed(self.nodes[1:]):
            node.parent.mass += node.mass
        for node in reversed(self.nodes):
            if node.near is not node or not node.score:
                continue
            if node.parent is not None and (up := node.parent.near).mass:
                # a wrapper that adds no text costs nothing
                up.score += node.score * max(0.6, node.mass / up.mass)
            node.score *= 2.0 if node.good else 1.0

    def containers(self) -> list[Node]:
        """Containers with prose, best first; of equal ones the innermost of a nest, else the first."""
        return sorted((n for n in self.nodes if n.score > 0 and not n.gone), key=lambda n: (-round(n.score, 6), -n.depth))

    def votes(self) -> list[tuple[str, float]]:
        """(path, weight) of the best containers, weights relative to the best."""
        best = self.containers()[:VOTES]
        return [(">".join(n.steps), n.score / best[0].score) for n in best]

    def text(self, path: str | None) -> str:
        ranked = self.containers()
        if not ranked:
            return "\n".join(t for _, t in self.blocks)
        own = self._within(ranked[0])
        if path:
            on_path = [n for n in ranked if ">".join(n.steps) == path]
            if on_path:
                # several of a kind are one text, unless each is an article of its own
                chosen = on_path[:1] if on_path[0].tag in ("article", "main") else on_path
                found = self._within(*chosen)
                if sum(map(len, found)) >= LEAST_SHARE * sum(map(len, own)):
                    own = found
        return "\n".join(own)

    def _within(self, *tops: Node) -> list[str]:
        inside: dict[int, bool] = {id(t): True for t in tops}

        def check(node: Node | None) -> bool:
            trail = []
            while node is not None and id(node) not in inside:
                trail.append(node)
                node = node.parent
            found = node is not None and inside[id(node)]
            for n in trail:
                inside[id(n)] = found
            return found

        return [t for n, t in self.blocks if check(n)]


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's path with the greatest sum of votes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums: dict[tuple[str, str], float] = {}
            for host, html in zip(frame["host"], frame["html"], strict=True):
                for path, weight in Page(html).votes():
                    sums[host, path] = sums.get((host, path), 0.0) + weight
            yield pd.DataFrame([(h, p, w) for (h, p), w in sums.items()], columns=["host", "path", "votes"])

    rows = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    votes = rows.mapInPandas(run, "host string, path string, votes double")
    # rounded, so that the order of addition decides nothing
    summed = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    return summed.groupBy("host").agg(F.max(F.struct("votes", "path"))["path"].alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, n_chars, path: the winning path of its host."""
    paths = spool(winning_paths(pages))
    rows = pages.select(
        F.col("page_id").cast("string").alias("id"), "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce("html", F.lit("")).alias("html")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [Page(html).text(path) for html, path in zip(frame["html"], frame["path"], strict=True)]
            yield pd.DataFrame({"id": frame["id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts], "path": frame["path"]})

    kind = pages.schema["page_id"].dataType
    made = rows.join(paths, "host", "left").select("id", "url", "html", "path").mapInPandas(
        run, "id string, url string, text string, n_chars long, path string"
    )
    return made.select(F.col("id").cast(kind).alias("page_id"), "url", "text", "n_chars", "path")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).drop("path")


QUERIES = {"op2_html_text": op2_html_text}
