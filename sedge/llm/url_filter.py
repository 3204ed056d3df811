"""URL filters that follow redirects and canonical links.

Rules judge a url by host and path.  Redirects (meta refresh) and canonical
links of the pages are edges between urls; within a connected component, the
urls that no rule judges take the component's verdict.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import materialize


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*(\?[^#]*)"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
COMMENT = r"(?s)<!--.*?(?:-->|$)"
BASE = r"(?is)<base\b[^>]*>"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else ''."""
    host = F.translate(F.regexp_extract(url, HOST, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; '' without ://."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def _key(url: Column) -> Column:
    """What aliases of scheme, fragment and host case have in common; null for a url without ://, which is no node."""
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), path, F.regexp_extract(url, QUERY, 1)))


def _without_dots(path: Column) -> Column:
    """A path that begins with / without its `.` and `..` segments (RFC 3986, 5.2.4)."""
    parts = F.split(F.substr(path, F.lit(2)), "/", -1)
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), tail), "/"))


def resolved(target: Column, base: Column) -> Column:
    """A reference in full (RFC 3986, 5.2), from a base with ://; other schemes stay as they are."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    own, query = path_of(base), F.regexp_extract(base, QUERY, 1)
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(own == "", F.lit("/")).otherwise(F.regexp_replace(own, r"[^/]*$", ""))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(root, _without_dots(path), rest))
        .when(target.startswith("#"), F.concat(root, own, query))
        .when(path == "", F.concat(root, own, rest))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest))
    )


def _rule(host: Column, path: Column, rules: list[Rule], value) -> Column:
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) urls of all redirects and canonical links of page heads.

    A head ends where the body begins, and comments in it don't count; a null
    html has none.  Targets are resolved against the page's first <base href>,
    else its url; pages whose url has no :// link nothing.
    """
    url, head = F.col(url_col), F.regexp_replace(F.split(F.col(html_col), r"(?i)<body\b", 2)[0], COMMENT, "")
    href = lambda tag: F.concat(*(F.regexp_extract(tag, HREF, i) for i in (1, 2, 3)))
    canonical = F.transform(F.regexp_extract_all(head, F.lit(CANONICAL), F.lit(0)), href)
    refresh = F.transform(F.regexp_extract_all(head, F.lit(REFRESH), F.lit(0)), lambda tag: F.regexp_extract(tag, TARGET, 1))
    plain = lambda c: F.trim(F.replace(c, F.lit("&amp;"), F.lit("&")))
    out = pages.where(F.contains(url, F.lit("://")))
    out = out.select(url.alias("source"), plain(href(F.regexp_extract(head, BASE, 0))).alias("base"), F.explode(F.transform(F.concat(canonical, refresh), plain)).alias("target"))
    out = out.where("target <> ''").withColumn("base", F.when(F.col("base") == "", F.col("source")).otherwise(resolved(F.col("base"), F.col("source"))))
    return out.select("source", resolved(F.col("target"), F.col("base")).alias("target"))


def filter_urls(pages: DataFrame, rules: list[Rule], links: DataFrame, url_col: str = "url") -> DataFrame:
    """Every row of `pages` with url_host, url_path, url_rule, url_verdict.

    A rule fits its host and all subdomains if the path starts with the
    rule's; of several, the longest (host and path together) wins, and its
    verdict stands.  A url without a rule takes the verdict of its component
    over `links` (source, target): allow if a url of the component is
    explicitly allowed, else block if one is blocked, else allow.  Urls that
    differ only in scheme, fragment or the host's case are the same node.
    Targets that are not in `pages` count.

    A null url, or one without ://, has empty host and path, no rule and no
    component: it is allowed.  Repeated rows are judged as often as they come,
    an empty table gives an empty result, and urls and pages of any length are
    read whole.  The list of rules is part of the query, so its
    length is fixed; an empty one allows everything.  Columns of `pages` with
    the names of the results are replaced.
    """
    url = F.col(url_col)
    links = materialize(links.select("source", "target"), "links")  # else each use of a target resolves it again
    edges = links.select(_key(F.col("source")).alias("u"), _key(F.col("target")).alias("v")).where("u <> v")
    classes = materialize(connected_components(edges), "aliases")
    host, path = F.regexp_extract("node", r"(?s)^([^/]*)", 1), F.regexp_extract("node", r"(?s)^[^/]*([^?]*)", 1)
    own = classes.withColumn("said", _rule(host, path, rules, lambda r: r.verdict))
    by_class = own.groupBy("component").agg(F.max(F.col("said") == "allow").alias("allow"), F.max(F.col("said") == "block").alias("block"))
    verdict = F.when(F.coalesce("allow", F.lit(False)), "allow").when(F.coalesce("block", F.lit(False)), "block").otherwise("allow")
    known = classes.join(by_class.select("component", verdict.alias("url_class")), "component").select(F.col("node").alias("url_key"), "url_class")
    pages = pages.drop("url_host", "url_path", "url_rule", "url_verdict", "url_said", "url_key", "url_class")
    out = pages.withColumns({"url_host": host_of(url), "url_path": path_of(url)})
    out = out.withColumn("url_rule", _rule(F.col("url_host"), F.col("url_path"), rules, lambda r: r.host + r.path))
    out = out.withColumn("url_said", _rule(F.col("url_host"), F.col("url_path"), rules, lambda r: r.verdict))
    out = out.withColumn("url_key", _key(url)).join(known, "url_key", "left")
    return out.withColumn("url_verdict", F.coalesce("url_said", "url_class", F.lit("allow"))).drop("url_key", "url_class", "url_said")


#: The rules of the registered query (fixed values of its contract).
PAGES_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
