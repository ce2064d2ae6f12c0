"""URL filters with redirect equivalence.

Pages name other addresses of themselves: `<link rel="canonical">` and meta-refresh
redirects. These links make classes of equivalent addresses (connected components), and a
rule that fits one address of a class decides for all of them. A page's own rule comes
first; within a class an allow rule beats every block rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import checkpoint
from firegrid.llm.components import connected_components

#: (host, path prefix, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*(?:"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b))[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["'][^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query: the address without scheme and fragment; null without `://`."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), query))


def _without_dots(path: Column) -> Column:
    """A path that begins with `/` without its segments `.` and `..`; a last one leaves its `/`."""
    parts = F.slice(F.split(path, "/", -1), 2, F.size(F.split(path, "/", -1)))
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    kept = F.aggregate(
        ended, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    )
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def _resolved(link: Column, url: Column) -> Column:
    """A link in a page as a full address: relative ones stand below the page's own; null for other schemes."""
    link = F.regexp_replace(link, "(?i)&amp;", "&")
    root = F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit("://"), host_of(url))
    own = path_of(url)
    path, query = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    folder = F.when(own == "", F.lit("/")).otherwise(F.regexp_extract(own, r"(?s)^(.*/)", 1))
    own_query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit(":"), link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.instr(url, "://") == 0, F.lit(None).cast("string"))
        .when(link.startswith("/"), F.concat(root, _without_dots(path), query))
        .when(path != "", F.concat(root, _without_dots(F.concat(folder, path)), query))
        .otherwise(F.concat(root, own, F.when(query != "", query).otherwise(own_query)))
    )


def _matched(rules, host: Column, path: Column) -> Column:
    """The longest fitting rule as struct(rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_pages(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, own_verdict, class_size for every row of `pages`.

    Pages whose address is in no class, null addresses and addresses without `://` have
    only their own rule, else `default`. Repeated rows each get a row; null html has no
    links; other columns are ignored. Rules are a short list held in the plan.
    """
    url, html = F.col("url"), F.col("html")
    links = F.concat(
        F.when(F.locate("canonical", F.lower(html)) > 0, F.regexp_extract_all(html, F.lit(_CANONICAL), 1)).otherwise(F.array().cast("array<string>")),
        F.when(F.locate("refresh", F.lower(html)) > 0, F.regexp_extract_all(html, F.lit(_REFRESH), 1)).otherwise(F.array().cast("array<string>")),
    )
    # A base element moves where relative links stand, itself relative to the page.
    own_base = F.when(F.locate("<base", F.lower(html)) > 0, F.regexp_extract(html, _BASE, 1))
    stand = F.when(F.coalesce(own_base, F.lit("")) != "", F.coalesce(_resolved(own_base, url), url)).otherwise(url)
    host, path = host_of(url), path_of(url)
    base = checkpoint(
        pages.select(
            "page_id", host.alias("host"), path.alias("path"), address_of(url).alias("address"),
            _matched(rules, host, path).alias("own"),
            F.transform(links, lambda x: address_of(_resolved(x, stand))).alias("links"),
        )
    )
    edges = base.filter("size(links) > 0").select(F.col("address").alias("u"), F.explode("links").alias("v"))
    plain = base.select("page_id", "host", "path", "own.rule", F.col("own.verdict").alias("own_verdict"), "address")
    if edges.isEmpty():
        judged = plain.withColumn("class_verdict", F.lit(None).cast("string")).withColumn("class_size", F.lit(1).cast("long"))
    else:
        members = checkpoint(connected_components(edges))
        address_host, address_path = host_of(F.concat(F.lit("x://"), "node")), path_of(F.concat(F.lit("x://"), "node"))
        verdicts = members.withColumn("verdict", _matched(rules, address_host, address_path)["verdict"]).groupBy("component").agg(
            F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"), F.count("*").alias("class_size")
        )
        by_address = members.join(verdicts, "component").select(
            F.col("node").alias("address"),
            F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("class_verdict"),
            "class_size",
        )
        judged = plain.join(by_address, "address", "left").withColumn("class_size", F.coalesce("class_size", F.lit(1).cast("long")))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("own_verdict", "class_verdict", F.lit(default)).alias("verdict"),
        "own_verdict", "class_size",
    )
