"""URL filters: rules by host and path, and decisions that pass to a page's aliases through redirects and canonical links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._tables import stored, unused

#: Bytes of rules that may be broadcast; more are joined by a shuffle.
SMALL_RULES = 8 << 20

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, _CAPITALS, _SMALL)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first "://", up to "/", "?", "#" or the end; empty if the url is null or has none."""
    return F.coalesce(lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def usual_form(url: Column) -> Column:
    """The address that sites redirect a url to, or name as canonical: https, no "www." or "m.", no fragment, no tracking parameters, no ".html" or "/" at the end. Null without "://"."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"^(utm_[^=]*|ref|fbclid|gclid)(=|\z)") & (p != "")), "&")
    site = F.regexp_replace(host_of(url), r"^(www|m)\.(?=[^.]*\.)", "")
    page = F.regexp_replace(path_of(url), r"(/index)?(\.html?|/)\z", "")
    return F.when(F.locate("://", url) > 0, F.concat(F.lit("https://"), site, page, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def url_key(url: Column) -> Column:
    """128 bits of a url, so that links and components carry no long texts."""
    return F.md5(url)


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(found, r"""^["']|["']\z""", "")


def page_links(pages: DataFrame, url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(source, target): redirect and canonical-link edges of crawled pages, as urls.

    Each url links to its usual form; with html_col also to what its `<link rel="canonical">` elements name and to what a `<meta http-equiv="refresh">` sends
    it to. Targets that hold no "://" are left out, and so are urls that are null or hold none.
    """
    url = F.col(url_col)
    found = [F.array(usual_form(url))]
    if html_col:
        tags = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?i)(<(?:link|meta)\s[^>]*>)"), F.lit(1))
        canonical = F.filter(tags, lambda t: t.rlike(r"(?i)^<link") & (F.lower(_attribute(t, "rel")) == "canonical"))
        refresh = F.filter(tags, lambda t: t.rlike(r"(?i)^<meta") & (F.lower(_attribute(t, "http-equiv")) == "refresh"))
        found += [F.transform(canonical, lambda t: _attribute(t, "href")), F.transform(refresh, lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), r"(?i)url\s*=\s*(.*)\z", 1)))]
    return pages.where(F.locate("://", url) > 0).select(url.alias("source"), F.explode(F.concat(*found)).alias("target")).where("locate('://', target) > 0 AND target <> source")


def longest_rules(places: DataFrame, rules: DataFrame, small: int = SMALL_RULES) -> DataFrame:
    """(host, path, rule, verdict) of those places that a rule fits.

    places: distinct (host, path). rules: host, path, verdict (allow or block). A rule fits its host and all subdomains, if the path starts with its own; the one
    whose host and path have most characters wins, then the longer host, and of two that are the same allow. Suffixes of a host
    that are longer than any rule's are never made, and a path is cut only at lengths that rules of that host have, so the rows
    joined are few for each place. Rules of up to `small` bytes, which are added up first, are broadcast.
    """
    known = rules.select(lower(F.coalesce("host", F.lit(""))).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host <> '' AND verdict IN ('allow', 'block')").groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))
    size, longest = known.agg(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + 40), F.max(F.length("rule_host"))).first()
    hint = F.broadcast if (size or 0) <= small else (lambda x: x)
    cuts = known.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("cuts"))
    # the last labels of each host, as far as a rule could reach
    host = F.col("host")
    tail = F.split(F.when(F.length(host) > (longest or 0), F.expr(f"right(host, {(longest or 0) + 1})")).otherwise(F.concat(F.lit("."), host)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(tail), F.lit(2))), lambda i: F.array_join(F.slice(tail, i, F.size(tail)), "."))
    hosts = places.select("host").distinct().select("host", F.explode(F.array_distinct(suffixes)).alias("rule_host")).join(hint(cuts), "rule_host")
    met = places.join(hosts, "host").select("host", "path", "rule_host", F.explode("cuts").alias("cut")).where("cut <= length(path)")
    met = met.select("host", "path", "rule_host", F.expr("left(path, cut)").alias("rule_path")).join(hint(known), ["rule_host", "rule_path"])
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule_host", "rule_path", "verdict"), F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))).alias("r"))
    return best.select("host", "path", F.concat("r.rule_host", "r.rule_path").alias("rule"), F.col("r.verdict").alias("verdict"))


def passed_on(ruled: DataFrame, links: DataFrame) -> DataFrame:
    """(key, verdict) of urls that have an alias with a rule.

    ruled: (key, verdict) of urls by their own rules. links: (source, target) urls. Aliases are the connected components over links, found without gathering any; a component in
    which any url is allowed by a rule is allowed, else one with a blocked url is blocked. One component may hold any share of all urls: it is met as sums
    of parts, and its decision as one row of a join.
    """
    reached = components(links.select(url_key(F.col("source")).alias("a"), url_key(F.col("target")).alias("b")))
    decided = reached.join(ruled.select(F.col("key").alias("node"), "verdict").distinct(), "node").groupBy("component").agg(F.min("verdict").alias("verdict"))
    return reached.join(decided, "component").select(F.col("node").alias("key"), "verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", html_col: str | None = "html", links: list[DataFrame] | None = None) -> DataFrame:
    """pages' rows without html_col, with host, path, rule (like "net/") and verdict (allow or block) of each url.

    A url's own rule decides, if one fits (see longest_rules()). Otherwise the url is an alias of those that redirect and
    canonical links connect it with: it is allowed if any of them is allowed by a rule, blocked if any is blocked by one and none allowed, and allowed if no rule
    reaches them. Links are those of page_links() and of `links`, tables of (source, target) urls such as a crawler's redirects; urls that only links name count as aliases too.

    A url that is null or has no "://" has an empty host and path, no rule and no alias, and is allowed. Repeated rows, null ids and very long urls are
    rows like others; columns of pages called host, path, rule or verdict are replaced; an empty table gives no rows, and without rules all is allowed. Only urls,
    128-bit keys and rules are shuffled, never html.
    """
    rest = [c for c in pages.columns if c not in {html_col, "host", "path", "rule", "verdict"}]
    key, passed = unused(pages.columns, "key"), unused(pages.columns, "passed")
    edges = reduce(DataFrame.unionByName, [page_links(pages, url_col, html_col), *[x.select("source", "target") for x in links or []]])
    # a target may be written in another way than the url of its page
    edges = stored(edges.unionByName(edges.select(F.col("target").alias("source"), usual_form(F.col("target")).alias("target"))).where("source <> target").distinct(), "links")
    urls = reduce(DataFrame.union, [pages.select(F.col(url_col).alias("url")), edges.select("source"), edges.select("target")]).where("url IS NOT NULL").distinct()
    urls = stored(urls.select(url_key(F.col("url")).alias(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")
    found = longest_rules(urls.select("host", "path").distinct(), rules)
    ruled = stored(urls.join(found, ["host", "path"]).select(key, "rule", "verdict"), "urls-ruled")
    aliases = passed_on(ruled.select(F.col(key).alias("key"), "verdict"), edges).select(F.col("key").alias(key), F.col("verdict").alias(passed))
    each = pages.select(*rest, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), url_key(F.col(url_col)).alias(key))
    judged = each.join(ruled, key, "left").join(aliases, key, "left")
    return judged.select(*rest, "host", "path", "rule", F.coalesce(F.col("verdict"), F.col(passed), F.lit("allow")).alias("verdict"))
