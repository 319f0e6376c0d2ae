"""URL block rules that follow redirects and canonical links.

Rules are (host, path, action): a rule fits its host and all subdomains if the path starts with the
rule's; the longest fitting rule is a url's own, and it always stands. A url without one takes the verdict
of its class of equivalent addresses (connected components over redirect and canonical-link edges): an
explicitly allowed member makes the class allowed, else a blocked member makes it blocked; else allow.

Addresses are compared as host (A-Z lower-cased), path and query: scheme and fragment name no other page.
Dot segments of relative targets are resolved; absolute targets and the pages' own urls stay as written.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and joins no
class; null or empty html has no links; repeated urls share a verdict, repeated rows are all returned; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]


def split_url(df: DataFrame, url: str) -> DataFrame:
    """df with __host, __path, __query ('' where absent)."""
    df = df.withColumn("__u", F.coalesce(F.col(url), F.lit("")))
    rest = F.when(F.expr("instr(__u, '://')") > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise("")
    df = df.withColumn("__r", rest)
    return df.withColumns({
        "__host": F.translate(F.regexp_extract("__r", "^[^/?#]*", 0), _UPPER, _LOWER),
        "__path": F.regexp_extract("__r", "^[^/?#]*([^?#]*)", 1),
        "__query": F.regexp_extract("__r", "^[^?#]*(\\?[^#]*)?", 1),
    }).drop("__u", "__r")


def own_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule string, action) of the longest fitting rule; allow goes before block among equals."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, a in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[2] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(a)).otherwise(action)
    return rule, action


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, f"(?is)\\b{name}\\s*=\\s*(\"[^\"]*|'[^']*|[^\\s\"'>]+)", 1)
    return F.regexp_replace(quoted, "^[\"']", "")


def link_targets(html: Column) -> Column:
    """The raw targets of all canonical links and all refresh redirects."""
    tags = lambda pattern: F.regexp_extract_all(html, F.lit(f"(?is)({pattern}[^>]*>)"), F.lit(1))
    canonical = F.transform(tags("<link\\b[^>]*\\brel\\s*=\\s*[\"']?canonical\\b"), lambda t: _attribute(t, "href"))
    refresh = F.transform(
        tags("<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b"),
        lambda t: F.regexp_extract(_attribute(t, "content"), "(?is)url\\s*=\\s*[\"']?([^\"']+)", 1),
    )
    found = F.transform(F.concat(canonical, refresh), lambda t: F.replace(F.trim(t), F.lit("&amp;"), F.lit("&")))
    return F.array_distinct(F.filter(found, lambda t: t != ""))


def _without_dots(path: Column) -> Column:
    """A path that starts with `/`, its `.` and `..` segments resolved."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", up(a)).otherwise(F.array_append(a, x)))
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(ended, "/"))


def _resolve(host: Column, path: Column, query: Column, target: Column) -> Column:
    """An absolute address of a target as found in a page."""
    own, rest = F.regexp_extract(target, "^[^?#]*", 0), F.regexp_extract(target, "^[^?#]*((?s).*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    here = F.concat(F.lit("http://"), host)
    return (
        F.when(target.startswith("#"), F.concat(here, path, query))
        .when(target.startswith("?"), F.concat(here, path, target))
        .when(own.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .otherwise(F.concat(here, _without_dots(F.when(target.startswith("/"), own).otherwise(F.concat(folder, own))), rest))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) addresses of the canonical and refresh links in pages."""
    found = pages.select(F.col(url).alias("url"), F.explode(link_targets(F.col(html))).alias("t"))
    found = split_url(written(found, "targets"), "url").where("__host <> ''")
    src = F.concat("__host", "__path", "__query")
    found = written(found.select(src.alias("src"), _resolve(F.col("__host"), F.col("__path"), F.col("__query"), F.col("t")).alias("abs")), "resolved")
    return split_url(found, "abs").where("__host <> ''").select("src", F.concat("__host", "__path", "__query").alias("dst"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, class_id): class_id is null for addresses without links.

    redirects: optional (src, dst) urls, as a crawler logs them.
    """
    edges = link_edges(pages, url, html)
    if redirects is not None:
        a = split_url(redirects.select(F.col("src").alias("s"), F.col("dst").alias("d")), "s")
        a = a.select(F.concat("__host", "__path", "__query").alias("src"), "__host", "d").where("__host <> ''").drop("__host")
        a = split_url(a, "d").where("__host <> ''").select("src", F.concat("__host", "__path", "__query").alias("dst"))
        edges = edges.union(a)
    edges = written(edges.where("src <> dst").distinct(), "links")
    urls = split_url(pages.select(F.col(key).alias("page_id"), F.col(url).alias("__url")), "__url")
    rule, action = own_rule(F.col("__host"), F.col("__path"), rules)
    urls = urls.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.concat("__host", "__path", "__query").alias("node"), rule.alias("rule"), action.alias("action"))
    if edges.isEmpty():
        return urls.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("class_id"))
    parts = connected_components(edges)
    split = split_url(parts.select("*", F.concat(F.lit("http://"), F.col("node")).alias("abs")), "abs")
    _, act = own_rule(F.col("__host"), F.col("__path"), rules)
    classes = split.groupBy("component").agg(F.max((act == "allow").cast("int")).alias("allowed"), F.max((act == "block").cast("int")).alias("blocked"))
    classes = written(classes.select("component", F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").alias("shared")), "verdicts")
    known = written(parts.join(classes, "component").select("node", F.col("component").alias("class_id"), "shared"), "known")
    out = urls.join(known, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "shared", F.lit("allow")).alias("verdict"), "class_id")
