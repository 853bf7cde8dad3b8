"""Block and allow rules for urls, carried to aliases.

A rule is a host and the beginning of a path. It fits its host and all
subdomains; of several that fit, the longest wins. Pages are aliases of one
another when redirect (meta refresh) and canonical-link edges connect their
urls; an edge also leads from a url to its plain form (no scheme, fragment or
``utm_`` parameter). All canonical links and refreshes of a page are read,
entities in them decoded as in attributes, and relative ones resolved against
the page's url or its first <base href>. Components of these edges are found by iterated joins.
Inside a component a page without a rule of its own is allowed if a rule
allows an alias, else blocked if a rule blocks an alias, else allowed: an
explicit allow takes precedence, and a page's own rule stands.

Defined results: a url that is null or has no ``://`` has an empty host and
path, no rule and no aliases, and is allowed; repeated rows get equal results;
null html has no edges; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import components, stored


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What an edge is read from: <link rel=canonical href=...> and <meta http-equiv=refresh content="0; url=...">.
# Quotes count behind "=" alone, so that ">" in a value ends no tag. Bounded, as a pattern recurses per repetition.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b.*?(?:</\1\s*>|\z)"
_TAG = r"""(?is)<(?:link|meta|base)\b(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+')?+){0,400}+>"""
_ATTRIBUTE = r"""(?s)[^\s=<>/"']+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)"""
_VALUE = r"""(?s)^[^=]*=\s*(?:"([^"]*)"|'([^']*)'|(.*))$"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_ENTITY = re.compile(r"&(?:#([0-9]+);?|#[xX]([0-9a-fA-F]+);?|([A-Za-z][A-Za-z0-9]*)(;|(?!=)))")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, NULL if none does."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def plain_form(url: Column) -> Column:
    """Host in lower case, path and query without ``utm_`` parameters; NULL without host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    return F.when(
        host_of(url) != "",
        F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")),
    )


def _attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute of that name, NULL if there is none."""
    named = lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name
    first = F.get(F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)), named), 0)
    return F.concat(*[F.regexp_extract(first, _VALUE, k) for k in (1, 2, 3)])


def _link(tag: Column) -> Column:
    """Where a tag leads as a canonical link or a refresh, NULL if it is neither."""
    word = lambda value: F.regexp_extract(value, r"^\s*([^\s\"'>]*)", 1)
    canonical = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = F.trim(F.lower(_attribute(tag, "http-equiv"))) == "refresh"
    turn = F.regexp_extract(_attribute(tag, "content"), r"""(?is)url\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    return F.when(tag.rlike(r"(?i)^<link") & canonical, word(_attribute(tag, "href"))).when(tag.rlike(r"(?i)^<meta") & refresh, turn)


def links_of(html: Column) -> tuple[Column, Column]:
    """Targets of all canonical links and refreshes of a page, and the first base of its relative links.

    Comments, scripts, styles and titles are no markup; ``rel`` is a list of
    words; values may hold any character.
    """
    tags = F.regexp_extract_all(F.regexp_replace(html, _HIDDEN, " "), F.lit(_TAG), F.lit(0))
    tags = F.when(html.rlike("(?i)canonical|refresh"), tags).otherwise(F.array().cast("array<string>"))
    bases = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<base")), lambda t: F.regexp_extract(_attribute(t, "href"), r"^\s*([^\s\"'>]*)", 1))
    found = F.filter(F.transform(tags, _link), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_distinct(found), F.coalesce(F.get(F.filter(bases, lambda x: F.coalesce(x, F.lit("")) != ""), 0), F.lit(""))


def _character(m: re.Match) -> str:
    if m[3]:
        return html5.get(m[3] + m[4], m[0])
    code = int(m[1]) if m[1] else int(m[2], 16)
    return chr(code) if 0 < code < 0xD800 or 0xDFFF < code < 0x110000 else "\ufffd"


def decoded(href: str | None) -> str | None:
    """An attribute's value with its entities decoded; names without ";" stay before "=", letters and digits."""
    return _ENTITY.sub(_character, href) if href else href


@F.pandas_udf(StringType())
def _decoded(hrefs: pd.Series) -> pd.Series:
    return hrefs.map(decoded, na_action="ignore")


def _without_dots(path: Column) -> Column:
    """A path that begins with "/" without its "." and ".." segments."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        F.slice(segments, 2, F.size(segments)),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    dir_end = F.element_at(segments, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(dir_end & (F.size(kept) > 0), "/").otherwise(""))


def _target(url: Column, href: Column) -> Column:
    """Absolute form of a link on a page; NULL for links that lead to no host."""
    site = F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit("://"), host_of(url))
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    own = F.regexp_extract(href, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (
        F.when(href == "", None)
        .when(href.rlike(_SCHEME + "//"), href)
        .when(href.rlike(_SCHEME), None)
        .when(host_of(url) == "", None)
        .when(href.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit(":"), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(url, r"(?s)^([^#]*)", 1), href))
        .when(href.startswith("?"), F.concat(site, path, href))
        .when(href.startswith("/"), F.concat(site, _without_dots(own), rest))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), rest))
    )


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, component (smallest plain url of the alias group) of every page."""
    url = F.col("url")
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    hrefs, base = links_of(F.col("html"))
    facts = stored(
        slim.select(
            "page_id",
            host_of(url).alias("host"),
            path_of(url).alias("path"),
            plain_form(url).alias("self"),
            url.alias("url"),
            hrefs.alias("hrefs"),
            base.alias("base"),
        )
        .withColumn("linked", F.col("self").isNotNull() & (F.size("hrefs") > 0))
        .withColumn("url", F.when(F.col("linked"), F.col("url")))  # kept for the pages that have links only
        .select("*", text.alias("rule"), verdict.alias("own"))
    )
    links = facts.where("linked").select(F.col("self").alias("a"), "url", "base", F.explode("hrefs").alias("href"))
    links = links.select("a", "url", _decoded("base").alias("base"), _decoded("href").alias("href"))
    # Stored, because the expressions below would otherwise repeat this one many times over.
    links = stored(links.select("a", "href", F.coalesce(_target(url, F.col("base")), url).alias("from")))
    edges = links.select("a", plain_form(_target(F.col("from"), F.col("href"))).alias("b")).where("b IS NOT NULL AND a <> b")
    groups = stored(components(edges))  # so that a join can split a hot url
    placed = stored(
        facts.join(groups, F.col("self") == F.col("node"), "left")
        .select("page_id", "host", "path", "rule", "own", F.coalesce("component", "self").alias("component"))
    )
    said = stored(
        placed.where("own IS NOT NULL AND component IS NOT NULL")
        .groupBy(F.col("component").alias("c"))
        .agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    )
    from_aliases = F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow")
    return placed.join(said, F.col("component") == F.col("c"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", from_aliases).alias("verdict"), "component"
    )


ORACLE = r"""
WITH p AS (SELECT page_id, url, html, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) AS m FROM pages),
f AS (SELECT page_id, translate(coalesce(m.h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(m.p, '') AS path, url,
             list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT starts_with(q, 'utm_')) AS q
      FROM p),
r(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
hit AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k FROM f, r
        WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
          AND starts_with(path, '/' || substr(rule, strpos(rule, '/') + 1))),
own AS (SELECT f.page_id, host, path, rule, verdict,
               CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END
                    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS component
        FROM f LEFT JOIN hit ON f.page_id = hit.page_id AND k = 1),
said AS (SELECT component, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked
         FROM own WHERE verdict IS NOT NULL AND component IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(own.verdict, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict, own.component
FROM own LEFT JOIN said ON own.component = said.component
"""
