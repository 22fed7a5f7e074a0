"""URL filters that hold for all names of a page: block decisions spread over redirects and canonical links.

Built-in functions and joins only.  Names that servers redirect to one another
by custom are first drawn together under one plain form, so that only declared
links are left for the search of components.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, staged
from .components import components

#: (host, path, verdict), verdict ``allow`` or ``block``.
Rule = tuple[str, str, str]

#: Rules that are compiled into one expression at most; more of them are joined.
COMPILED_RULES = 100

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def url_scheme(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 3)


def url_query(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 4)


def plain_form(url: Column) -> Column:
    """What stays the same under redirects that servers do by custom, or null without a host.

    Left out are the scheme, ``www.`` and ``m.`` in front, the ports 80 and 443,
    ``index.html`` and slashes at the end of the path, ``utm_`` parameters and
    the fragment.
    """
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^(www\.|m\.)+", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_replace(F.regexp_replace(url_query(url), r"([?&])utm_[^&]*", "$1"), r"&+", "&")
    query = F.regexp_replace(F.regexp_replace(query, r"^\?&", "?"), r"[?&]$", "")
    return F.when(host != "", F.concat(host, path, query))


def resolved(link: Column, base: Column) -> Column:
    """A link as an absolute URL, seen from ``base``; null for empty links, fragments and other schemes than http."""
    link = F.regexp_replace(F.trim(link), "&amp;", "&")
    site = F.concat(url_scheme(base), F.lit("://"), url_host(base))
    folder = F.regexp_extract(url_path(base), r"(?s)^(.*/)", 1)
    whole = F.when(link.rlike(r"(?i)^https?://"), link).when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
    whole = whole.when(link.startswith("//"), F.concat(url_scheme(base), F.lit(":"), link)).when(link.startswith("/"), F.concat(site, link))
    whole = whole.when((link == "") | link.startswith("#"), None).when(link.startswith("?"), F.concat(site, url_path(base), link))
    return whole.otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))


def _attribute(tag: Column, name: str) -> Column:
    said = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.regexp_replace(said, "^[\"']|[\"']$", "")


def declared_links(html: Column, url: Column) -> Column:
    """Where a page says that it belongs: its canonical link, and what it refreshes to at once or later.

    Comments, scripts and styles are passed over.
    """
    shown = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    tags = F.regexp_extract_all(shown, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    canonical = lambda t: F.when(t.rlike("(?i)^<link") & F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"), _attribute(t, "href"))
    refresh = lambda t: F.when(t.rlike("(?i)^<meta") & (F.lower(_attribute(t, "http-equiv")) == "refresh"), F.regexp_extract(_attribute(t, "content"), r"(?is)url\s*=\s*[\"']?([^\"'>]*)", 1))
    found = F.transform(tags, lambda t: resolved(F.coalesce(canonical(t), refresh(t)), url))
    none = F.array().cast("array<string>")
    # Most pages name neither, and their markup isn't looked at further.
    return F.when(html.rlike("(?i)canonical|http-equiv"), F.filter(found, lambda x: x.isNotNull())).otherwise(none)


def _checked(rules: Sequence[Rule]) -> list[Rule]:
    if any(v not in ("allow", "block") for _, _, v in rules):
        raise ValueError("a rule's verdict is allow or block")
    return [(h.translate(str.maketrans(_UPPER, _LOWER)), p, v) for h, p, v in rules]


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does.

    Of rules of one length that with the longer host wins, then allow.
    """
    best = sorted(_checked(rules), key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2], r[0], r[1]))
    told = [(_fits(host, path, F.lit(h), F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in best]
    return reduce(lambda c, x: c.when(*x), told[1:], F.when(*told[0])) if told else F.lit(None).cast("struct<rule:string,verdict:string>")


def with_rules(urls: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """``urls`` (host, path and others) with rule and verdict, null where none fits.

    A table of rules (host, path, verdict) may be of any size: every host is
    looked up with all names above it, so a url meets only rules of its own hosts.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= COMPILED_RULES:
            return urls.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).select(*urls.columns, F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("verdict"))
        rules = urls.sparkSession.createDataFrame(_checked(rules), "host string, path string, verdict string")
    hosts = urls.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    listed = rules.select(F.translate("host", _UPPER, _LOWER).alias("above"), F.col("path").alias("rule_path"), F.col("verdict")).distinct()
    order = F.struct(F.length(F.concat("above", "rule_path")).alias("size"), F.length("above").alias("of_host"), (F.col("verdict") == "allow").alias("kind"), F.concat("above", "rule_path").alias("rule"), "verdict")
    met = hosts.withColumn("above", above).join(listed, "above").where(F.startswith("path", "rule_path"))
    best = met.groupBy("host", "path").agg(F.max(order).alias("best"))
    found = attach(urls, best, ["host", "path"], salt="path")
    return found.select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url, html).

    A url's own rule decides, so an explicit allow holds whatever its aliases
    are.  Without a rule a url is blocked if a block rule fits any url that it
    is joined with: by its plain form, by a page's canonical link or refresh, or
    by ``redirects`` (url, target), over any number of steps in either
    direction; otherwise it is allowed.  Allow rules of aliases don't spread.

    A null url, or one without ``://``, has empty host and path, no alias and no
    rule, and is allowed; null markup declares nothing.  Repeated rows come out
    each, other columns are left out, and an empty table has an empty result.
    """
    own = with_rules(pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")), rules)
    judged = staged(own.select("page_id", plain_form(F.col("url")).alias("plain"), "host", "path", "rule", "verdict"), "judged")

    declared = pages.where("url is not null").select("url", F.explode(declared_links(F.col("html"), F.col("url"))).alias("target"))
    if redirects is not None:
        declared = declared.unionByName(redirects.select("url", resolved(F.col("target"), F.col("url")).alias("target")))
    declared = staged(declared.select("url", "target").distinct(), "declared")
    links = declared.select(plain_form(F.col("url")).alias("a"), plain_form(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b").distinct()

    # Urls that are only named by others can carry a block rule too.
    ends = declared.select(F.col("url")).union(declared.select("target")).distinct()
    named = with_rules(ends.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")), rules)
    blocked = judged.where("verdict = 'block'").select("plain").union(named.where("verdict = 'block'").select(plain_form(F.col("url")))).where("plain is not null").distinct()
    blocked = staged(blocked, "blocked")

    labels = components(links)
    of_node = labels.withColumnRenamed("node", "plain")
    bad = blocked.join(of_node.hint("merge"), "plain").select("comp", F.lit(True).alias("bad")).distinct()
    spread = attach(of_node, bad, ["comp"], salt="plain").where("bad").select("plain")
    reach = blocked.union(spread).distinct().withColumn("alias_blocked", F.lit(True))

    open_ = judged.where("verdict is null")
    told = attach(open_, reach, ["plain"], salt="page_id")
    verdict = F.when(F.col("alias_blocked"), "block").otherwise("allow")
    ruled = judged.where("verdict is not null").select("page_id", "host", "path", "rule", "verdict")
    return told.select("page_id", "host", "path", "rule", verdict.alias("verdict")).unionByName(ruled)
