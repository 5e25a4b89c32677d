"""URL filters with redirect equivalence (operator 7).

Rules (host, path prefix, verdict) decide first: a rule fits its host and all subdomains if the url's path
starts with the rule's; the longest fitting rule wins (host and path counted together; of equally long ones
the longer host, then allow). URLs joined by redirect or canonical-link edges form equivalence
classes, connected components found in Spark. A block decision of any member holds for all of its class,
except for members that an allow rule names themselves: an explicit allow goes before a propagated block.
URLs without a rule in a class without a block are allowed.

Edges of a page are its canonical link, its og:url and a meta refresh, references decoded and relative ones resolved
against the page's <base> or its own url; redirect() takes further edges as a table. For equivalence a URL is its host, path and query: scheme and fragment
do not count, and the host is lower-cased.

Edge cases. A null url or one without ``://`` has an empty host and path, no rule, no class and is allowed. Null
html has no edges. Rows may repeat; each row gets its verdict. Empty tables give no rows. Only page_id, url and html
are read; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spool, table
from .components import components

#: (host, path, verdict) of the registered query. Fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``, empty without one."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "(?s)^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(_rest(url), "(?s)^[^/?#]*", ""), "(?s)^[^?#]*", 0)


def identity_of(url: Column) -> Column:
    """A URL as a node: 16 bytes of the hash of host, path and query; null without a host."""
    query = F.regexp_extract(_rest(url), "(?s)^[^?#]*(\\?[^#]*)?", 1)
    whole = F.concat_ws("\n", host_of(url), path_of(url), query)
    return F.when(host_of(url) != "", F.unhex(F.md5(whole)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule, null where none fits."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "allow"))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in reversed(order):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
REFRESH = re.compile(r"\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?['\"]?\s*([^'\"]+)", re.I)


def tags_of(html: Column) -> Column:
    """The link, meta and base tags that may tell a page's other address."""
    tags = F.regexp_extract_all(html, F.lit("(?is)<(?:link|meta|base)\\b[^>]*>"), 0)
    return F.filter(tags, lambda t: t.rlike("(?is)^<base|canonical|og:url|refresh"))


def targets_of(url: str, tags: Iterable[str]) -> list[str]:
    """Absolute http(s) URLs that a page names as its other address, resolved against <base> or its own url."""
    base, found = None, []
    for tag in tags:
        own = {}
        for m in ATTRIBUTE.finditer(tag):
            own.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or "").strip())
        kind = tag[1:5].lower()
        if kind == "base":
            base = base or own.get("href")
        elif kind == "link" and "canonical" in own.get("rel", "").lower().split():
            found.append(own.get("href", ""))
        elif kind == "meta" and "og:url" in (own.get("property", "").lower(), own.get("name", "").lower()):
            found.append(own.get("content", ""))
        elif kind == "meta" and own.get("http-equiv", "").lower() == "refresh" and (m := REFRESH.match(own.get("content", ""))):
            found.append(m[1].strip())
    out = []
    for target in filter(None, found):
        try:
            whole = urljoin(urljoin(url, base or ""), target)
        except ValueError:  # no URL at all
            continue
        if re.match("https?://", whole, re.I):
            out.append(whole)
    return out


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) URLs from the pages' own heads."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(url, t) for url, tags in zip(frame["src"], frame["tags"], strict=True) for t in targets_of(url, tags)]
            yield pd.DataFrame(out, columns=["src", "dst"])

    tagged = pages.where("url is not null and html is not null").select(F.col("url").alias("src"), tags_of(F.col("html")).alias("tags"))
    return tagged.where(F.size("tags") > 0).mapInPandas(run, "src string, dst string").where("src <> dst")


def judge(
    pages: DataFrame, edges: DataFrame, rules: list[tuple[str, str, str]] = RULES
) -> DataFrame:
    """pages (page_id, url, ...) and edges (src, dst) of URLs -> page_id, host, path, rule, verdict,
    propagated; a row for each row of pages."""
    url = F.col("url")
    ruled = lambda df: df.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn(
        "found", rule_of(F.col("host"), F.col("path"), rules)
    )
    ends = edges.select(F.col("src").alias("url")).union(edges.select(F.col("dst").alias("url")))
    sides = edges.select(identity_of(F.col("src")).alias("a"), identity_of(F.col("dst")).alias("b")).where("a is not null and b is not null")
    classes = components(sides, "a", "b")
    judged = ruled(pages.select("page_id", "url")).withColumn("node", identity_of(url))
    # a block decision may come from a page or from a URL that is only linked to
    named = ruled(ends.union(pages.select("url"))).where("found.verdict = 'block'").select(identity_of(url).alias("node")).distinct()
    blocked = spool(
        classes.join(named, "node").select("component").distinct().join(classes, "component").select("node", F.lit(True).alias("blocked"))
    )
    return judged.join(blocked, "node", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        (F.col("found").isNull() & F.coalesce("blocked", F.lit(False))).alias("propagated"),
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, spool(page_edges(pages))).drop("propagated")


#: The same in SQL. Classes: all pairs that reach each other over the edges, by recursion.
_REST = "CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END"
_FITS = "WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}'"
_BY_LENGTH = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "allow"))
_RULE = " ".join(_FITS.format(h=h, p=p, v=h + p) for h, p, _ in _BY_LENGTH)
_VERDICT = " ".join(_FITS.format(h=h, p=p, v=v) for h, p, v in _BY_LENGTH)
_JUDGED = f"""SELECT *, CASE {_RULE} END AS rule, CASE {_VERDICT} END AS own FROM (
    SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
      regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path,
      regexp_extract(rest, '^[^?#]*(\\?[^#]*)?', 1) AS query
    FROM (SELECT *, {_REST} AS rest FROM ({{}})))"""
ORACLES = {
    "op7_url_filters": f"""WITH RECURSIVE edges AS (
  SELECT url AS src, regexp_extract(tag, '(?is)(?:href|content)\\s*=\\s*["'']?(?:\\s*[0-9.]+\\s*;\\s*url\\s*=\\s*)?[''"]?\\s*(https?://[^\\s"''>]+)', 1) AS dst
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL)
  WHERE regexp_matches(tag, '(?is)rel\\s*=\\s*["'']?canonical|og:url|http-equiv\\s*=\\s*["'']?refresh')),
urls AS (SELECT url, host || chr(10) || path || chr(10) || query AS node, own FROM (
  {_JUDGED.format("SELECT src AS url FROM edges WHERE dst <> '' UNION SELECT dst FROM edges WHERE dst <> '' UNION SELECT url FROM pages")}) WHERE host <> ''),
sides AS (SELECT a.node AS a, b.node AS b FROM edges JOIN urls a ON a.url = src JOIN urls b ON b.url = dst WHERE a.node <> b.node),
both_ways AS (SELECT a, b FROM sides UNION SELECT b, a FROM sides),
reach AS (SELECT DISTINCT node AS a, node AS b FROM urls WHERE own = 'block'
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT page_id, host, path, rule,
  coalesce(own, CASE WHEN host || chr(10) || path || chr(10) || query IN (SELECT b FROM reach) THEN 'block' ELSE 'allow' END) AS verdict
FROM ({_JUDGED.format("SELECT page_id, url FROM pages")})"""
}
QUERIES = {"op7_url_filters": op7_url_filters}
