"""URL filters with redirect equivalence: a block decision on a url holds for all urls that lead to the same page.

``rules`` (action allow or block, host, path) fit a url of their host or a subdomain of it whose path starts with the rule's; of
the rules that fit the longest wins (as ``host`` + ``path``; of equally long ones an allowing rule). ``links`` (src, dst) are
redirects and canonical links between urls; urls connected by links, in either direction and over any number of steps, are
aliases. A url with a rule of its own has that rule's verdict, so an explicit allow stands against what its aliases
have; a url without one is blocked if a rule blocks one of its aliases, and allowed otherwise. Aliases that are themselves linked to but
not among the pages count as well.

``page_links`` gives the links of pages: redirects (``<meta http-equiv=refresh>``) and canonical links found in the page's
source, and the redirect of every url to its ``plain_url``, the form without what sites commonly redirect away.

The host of a url is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the path is the rest up
to ``?``, ``#`` or the end. A null url, or one without ``://``, has an empty host and path, fits no rule, has no alias and is allowed. Each row of
the pages has one row in the result, repeated rows and null ids included; other columns are kept, except those whose names the result needs.

All work is done on distinct urls by joins on equal keys (suffixes of the host with beginnings of the path that some rule has), so a rule
table of any size fits, no row meets more rules than fit it, and a host or url with a third of all rows weighs as much as any other
until the last join, which is with one row a url and which Spark splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlib.llm.components import components
from cohortlib.llm.helpers import stage

# ---- fixed values: what plain_url leaves out -------------------------------------------------------
HOST_LABELS = ("www", "m")
PATH_ENDS = (".html", ".htm", "/")
TRACKING = r"^(utm_[^=]*|ref)(=|$)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://" + pattern, 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, r"([^/?#]*)"), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _part(url, r"[^/?#]*([^?#]*)")


def plain_url(url: Column) -> Column:
    """The url without scheme, fragment, leading host label, end of path and tracking parameters; null without ``://``."""
    host = F.regexp_replace(host_of(url), rf"^({'|'.join(HOST_LABELS)})\.(?=[^.]+\.)", "")
    path = F.regexp_replace(path_of(url), "(" + "|".join(e.replace(".", r"\.") for e in PATH_ENDS) + ")$", "")
    given = F.split(_part(url, r"[^?#]*\?([^#]*)"), "&")
    query = F.array_join(F.filter(given, lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    return F.when(url.contains("://"), F.concat(F.lit("http://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, in quotes or bare; empty without it."""
    return F.btrim(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), F.lit("\"'"))


def _absolute(base: Column, link: Column) -> Column:
    """A link as found in a page: whole, without scheme, or from the site's root. Others are not followed."""
    link = F.trim(F.regexp_replace(link, "&amp;", "&"))
    scheme = F.regexp_extract(base, r"^([^:/?#]+)://", 1)
    return (F.when(link.contains("://"), link)
            .when(link.startswith("//") & (scheme != ""), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/") & (scheme != ""), F.concat(F.regexp_extract(base, r"^([^/?#]+//[^/?#]*)", 1), link)))


def page_links(pages: DataFrame) -> DataFrame:
    """src, dst: the links of pages (url, html) to the urls they redirect to or name as canonical."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))
    canonical = F.transform(F.filter(tags, lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)")),
                            lambda t: _attribute(t, "href"))
    refresh = F.transform(F.filter(tags, lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh"),
                          lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)url\s*=\s*['"]?([^'"]*)""", 1))
    found = pages.where("url is not null and html is not null").select("url", F.explode(F.concat(canonical, refresh)).alias("link"))
    declared = found.select(F.col("url").alias("src"), _absolute(F.col("url"), F.col("link")).alias("dst"))
    urls = declared.select("dst").unionByName(pages.select(F.col("url").alias("dst"))).distinct()
    return declared.unionByName(urls.select(F.col("dst").alias("src"), plain_url(F.col("dst")).alias("dst"))).where("src <> dst")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule, action for each of the distinct ``urls`` that a rule fits."""
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("on"), F.coalesce("path", F.lit("")).alias("start"), "action")
    rules = rules.where("on is not null and action in ('allow', 'block')").groupBy("on", "start").agg(F.min("action").alias("action"))
    rules = stage(rules, "rules")
    lengths = stage(rules.select("on", F.length("start").alias("length")).distinct(), "rule_lengths")
    deepest = F.coalesce(rules.agg(F.max(F.size(F.split("on", r"\.")))).scalar(), F.lit(1))
    hosts = urls.select("url", path_of(F.col("url")).alias("path"), F.split(host_of(F.col("url")), r"\.").alias("labels"), deepest.alias("deepest"))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), "deepest")),
                           lambda n: F.array_join(F.slice("labels", F.size("labels") - n + 1, n), "."))
    on = hosts.select("url", "path", F.explode(suffixes).alias("on"))
    met = (on.join(lengths, "on").where(F.length("path") >= F.col("length"))
           .select("url", "on", F.col("path").substr(F.lit(1), F.col("length")).alias("start")).join(rules, ["on", "start"]))
    size = F.length("on") + F.length("start")
    best = F.max(F.struct(size.alias("size"), (F.col("action") == "allow").alias("allows"), F.concat("on", "start").alias("rule"), "action"))
    return met.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.action")


def judge(pages: DataFrame, rules: DataFrame, links: DataFrame) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits), aliases (whether the url has any) and verdict."""
    linked = stage(links.select("src", "dst").where("src <> dst").distinct(), "url_links")
    urls = pages.select("url").unionByName(linked.select(F.col("src").alias("url"))).unionByName(linked.select(F.col("dst").alias("url")))
    ruled = stage(fitting_rules(urls.where("url is not null").distinct(), rules), "ruled_urls")
    group = stage(components(linked, "src", "dst"), "url_groups")
    roots = group.select("root").distinct().select(F.col("root").alias("node"), "root")
    of = stage(group.unionByName(roots).withColumnRenamed("node", "url"), "url_roots")
    blocked = of.join(ruled.where("action = 'block'"), "url").select("root").distinct().withColumn("blocked", F.lit(True))
    decided = of.join(blocked, "root", "left").select("url", F.coalesce("blocked", F.lit(False)).alias("blocked"))
    decided = stage(decided.join(ruled, "url", "full"), "decided_urls")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "aliases", "verdict", "action", "blocked")]
    return pages.select(*kept).join(decided, "url", "left").select(
        *kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.col("blocked").isNotNull().alias("aliases"),
        F.coalesce("action", F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"))
