"""URL rules with redirect equivalence: aliases of a blocked page are blocked, unless a rule allows them. DataFrame expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://, and for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. rules: (verdict, host, path)."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r))
    fits = [(v, h + p, ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))) for v, h, p in ordered]
    first = lambda i: F.coalesce(*[F.when(f[2], F.lit(f[i])) for f in fits], F.lit(None).cast("string"))
    return first(1), first(0)


def loosely(url: Column) -> Column:
    """The address that common redirects lead to, as a guess: no scheme, www. or m. host, fragment, tracking parameters, index or .html ending, last slash."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_\w+|ref|fbclid|gclid)=")), "&")
    key = F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(url.contains("://"), key).otherwise(url)


def scheme_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)\A(.*?)://", 1), UPPER, LOWER)


def undotted(path: Column) -> Column:
    """path without its . and .. segments."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    left = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    ends = F.element_at(parts, -1).isin(".", "..") & (F.size(left) > 0)
    return F.when(path.rlike(r"(?s)/\.\.?(/|\z)"), F.concat(F.lit("/"), F.array_join(left, "/"), F.when(ends, "/").otherwise(""))).otherwise(path)


def exactly(url: Column) -> Column:
    """url with its scheme and host lower-cased, / for an empty path, no dot segments and no fragment: what names the same page by the standard alone."""
    path, query = path_of(url), F.regexp_extract(url, r"(?s)\A[^?#]*(\?[^#]*)", 1)
    key = F.concat(scheme_of(url), F.lit("://"), host_of(url), F.when(path == "", F.lit("/")).otherwise(undotted(path)), query)
    return F.when(url.contains("://"), key).otherwise(url)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value as it is written; empty where there is none."""
    found = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, found, k) for k in (1, 2, 3)])


def decoded(text: Column) -> Column:
    """text with numeric entities and those of markup decoded."""
    parts = F.split(text, "&#")
    hexa, rest = F.regexp_extract, F.regexp_replace

    def one(x: Column, i: Column) -> Column:
        code = F.coalesce(F.conv(F.nullif(hexa(x, r"(?s)\A[xX]([0-9A-Fa-f]{1,6});", 1), F.lit("")), 16, 10), F.nullif(hexa(x, r"(?s)\A([0-9]{1,7});", 1), F.lit(""))).cast("int")
        fine = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(fine, code).otherwise(F.lit(32))), 8, "0")), "UTF-32")
        return F.when(i == 0, x).when(fine, F.concat(char, rest(x, r"(?s)\A[xX]?[0-9A-Fa-f]+;", ""))).otherwise(F.concat(F.lit("&#"), x))

    out = F.when(text.contains("&#"), F.array_join(F.transform(parts, one), "")).otherwise(text)
    for name, char in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def resolved(link: Column, base: Column) -> Column:
    """The address that a link on a page of address base leads to; null if that is no address of a host, or the link is empty."""
    link = F.trim(F.regexp_replace(link, r"[\t\r\n]", ""))
    scheme, path = scheme_of(base), path_of(base)
    origin = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)\A(.*/)", 1))
    return (
        F.when((link == "") | link.startswith("#"), F.lit(None).cast("string"))
        .when(link.rlike(r"(?s)\A[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when(link.rlike(r"(?s)\A[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .otherwise(F.concat(origin, folder, link))
    )


def html_edges(pages: DataFrame, key=exactly) -> DataFrame:
    """(a, b): keys of addresses that a page's canonical link or meta refresh ties together.

    Links are resolved against the page's address, or its first base element; relative, rooted, dotted and query-only ones
    are. Attributes may be quoted either way or not at all, in any order. What stands in comments and scripts is no tag.
    """
    there = pages.where(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh"))
    html = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")
    tag = r"""(?is)<(?:link|meta|base)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
    tags = materialize(there.select("url", F.regexp_extract_all(html, F.lit(tag), F.lit(0)).alias("tags")), "tags")
    based = F.get(F.filter("tags", lambda t: t.rlike(r"""(?i)\A<base\b.*[\s"']href\s*=""")), 0)
    tags = tags.select("url", attribute(based, "href").alias("base"), F.explode("tags").alias("tag"))
    is_link = F.col("tag").rlike(r"(?i)\A<link\b") & F.array_contains(F.split(F.lower(attribute(F.col("tag"), "rel")), r"\s+"), "canonical")
    is_refresh = F.col("tag").rlike(r"(?i)\A<meta\b") & (F.trim(F.lower(attribute(F.col("tag"), "http-equiv"))) == "refresh")
    content = r"""(?is)\A[\s\d.]*[;,]?\s*url\s*=\s*(["']?)(.*?)\1\s*\z"""
    raw = F.when(is_link, attribute(F.col("tag"), "href")).when(is_refresh, F.regexp_extract(attribute(F.col("tag"), "content"), content, 2))
    # written in between: what follows uses each column many times
    raw = materialize(tags.select("url", "base", raw.alias("link")).where("link <> ''"), "links")
    raw = materialize(raw.select("url", decoded(F.col("base")).alias("base"), decoded(F.col("link")).alias("link")), "links")
    raw = materialize(raw.select("url", F.coalesce(resolved(F.col("base"), F.col("url")), F.col("url")).alias("base"), "link"), "links")
    to = materialize(raw.select("url", resolved(F.col("link"), F.col("base")).alias("to")).where("to is not null"), "links")
    return to.select(key(F.col("url")).alias("a"), key(F.col("to")).alias("b")).where("a <> b")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: list[DataFrame] = (), default: str = "allow", *, loose: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url, html; other columns play no part).

    A page that a rule fits gets the longest rule's verdict. Any other takes its alias component's: allow if a rule
    allows a member, else block if a rule blocks one, else default. Components join pages of one address and
    addresses tied by canonical links, meta refreshes and the redirects given (tables of urls from_url, to_url). Addresses
    are one if exactly() says so; with loose, if loosely() does, which guesses redirects that nobody has recorded.

    Null url: empty host and path, no rule, no aliases, default. Repeated rows are judged alike. An address with very many
    pages is aggregated before it meets others. Addresses and components grow with the pages, so they are merged, never broadcast.
    """
    name = loosely if loose else exactly
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path"), name(F.col("url")).alias("key"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    p = materialize(p.select("page_id", "host", "path", "key", rule.alias("rule"), said.alias("said")), "urls")
    pairs = [html_edges(pages.select("url", "html"), name)]
    pairs += [r.select(name(F.col("from_url")).alias("a"), name(F.col("to_url")).alias("b")) for r in redirects]
    groups = connected_components(reduce(DataFrame.unionByName, pairs))
    votes = p.where("key is not null").groupBy("key").agg(F.max((F.col("said") == "allow").cast("int")).alias("allowed"), F.max((F.col("said") == "block").cast("int")).alias("blocked"))
    votes = materialize(votes.join(groups.hint("merge"), F.col("key") == F.col("node"), "left").select("key", F.coalesce("component", "key").alias("component"), "allowed", "blocked"), "votes")
    whole = materialize(votes.groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked")), "components")
    spread = votes.select("key", "component").join(whole.hint("merge"), "component").select(F.col("key").alias("k"), F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").alias("alias_verdict"))
    out = p.join(spread.where("alias_verdict is not null").hint("merge"), F.col("key") == F.col("k"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "alias_verdict", F.lit(default)).alias("verdict"))
