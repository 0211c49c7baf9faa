"""URL filters with redirect equivalence.

Rules judge a url by host and path. Urls that redirect to, or name as canonical, one address are aliases: their
connected components pass a block on to members that no rule fits, unless a member is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rdlab.llm.common import components, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only track.
TRACKING = r"(?i)^(utm_[a-z]+|gclid|fbclid|ref)="


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for a null url or one without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """One spelling for urls that name one page: no scheme, www., fragment, tracking parameters, or final slash; null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.|:(80|443)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    address = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise(F.lit("")))
    return F.when(host != "", address)


def links_of(html: Column) -> Column:
    """array<string>: the absolute targets of a page's canonical links and refresh redirects."""
    canonical = F.regexp_extract_all(html, F.lit(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*>"""), F.lit(0))
    refresh = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh["']?[^>]*>"""), F.lit(0))
    targets = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)),
    )
    return F.filter(F.coalesce(targets, F.array().cast("array<string>")), lambda u: u.contains("://"))


def rule_verdicts(urls: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """(id_col, rule, action): the longest fitting rule of each row of urls (id_col, host, path); rows that none fits are left out.

    rules: (host, path, action). A rule fits its host and all subdomains where the path starts with the
    rule's. Among rules of one length the smaller text wins, allow before block. Each host looks up its own suffixes.
    """
    parts = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "action", F.concat("host", "path").alias("rule"))
    hits = urls.where("host <> ''").select(id_col, "path", F.explode(suffix).alias("suffix")).join(named, "suffix").where(F.col("path").startswith(F.col("start")))
    best = hits.groupBy(id_col).agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "action")).alias("best"))
    return best.select(id_col, "best.rule", "best.action")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict): one row for each row of pages.

    A fitting rule decides. Otherwise the row's component of aliases does: allow if a member is explicitly
    allowed, else block if a member is blocked, else allow. Edges come from spellings of one address, canonical links and refresh
    redirects in html, and `redirects` (source, target). Null urls or ones without :// have an empty host and
    path, no rule and no aliases: allow. Ids may be null or repeat; each row is judged by itself. An empty table gives no rows; other columns are not read.
    """
    html = F.col(html_col) if html_col else F.lit(None).cast("string")
    link = F.transform(links_of(html), address_of)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.concat(F.array(address_of(F.col(url_col))), link).alias("keys"))
    rows = written(rows.drop("url").withColumn("row", F.monotonically_increasing_id()), "urls")
    ruled = rule_verdicts(rows, rules, "row")
    rows = written(rows.join(ruled, "row", "left"), "ruled")

    keys = rows.select("row", F.explode("keys").alias("key")).where("key is not null")
    if redirects is not None:
        moved = redirects.select((-1 - F.monotonically_increasing_id()).alias("row"), F.array(address_of(F.col("source")), address_of(F.col("target"))).alias("keys"))
        keys = keys.union(written(moved, "moved").select("row", F.explode("keys").alias("key")).where("key is not null"))
    keys = keys.distinct()
    # written, so that the join with an address of very many rows is between plain tables and can be split
    first = written(keys.groupBy("key").agg(F.min("row").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b"), "addresses")
    edges = keys.join(first, "key").select(F.col("row").alias("a"), "b").where("a <> b")
    groups = written(components(edges, "aliases"), "groups")
    verdicts = rows.select("row", "action").join(groups, rows["row"] == groups["node"]).groupBy("component").agg(F.max(F.col("action") == "allow").alias("ok"), F.max(F.col("action") == "block").alias("bad"))
    passed = groups.join(verdicts.where("bad and not coalesce(ok, false)").select("component"), "component").select(F.col("node").alias("row"), F.lit("block").alias("passed"))
    out = rows.join(passed, "row", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", "passed", F.lit("allow")).alias("verdict"))
