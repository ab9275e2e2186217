"""URL rules with redirect equivalence: decisions reach the aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsward.functions.html import unescape
from newsward.llm.common import components
from newsward.session import stage

#: (verdict, host, path prefix)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Redirects and canonical links of a page, as patterns on whole tags.
LINK_TAG = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical[\"'\s/>])[^>]*>"
META_TAG = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh[\"'\s/>])[^>]*>"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH = r"(?is)\burl\s*=\s*['\"]?([^'\"\s>;]+)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """Host plus path of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for _, rule_host, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        out = F.when(fits, F.lit(rule_host + prefix)).otherwise(out)
    return out


def rule_verdict(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, rule_host, prefix in rules:
        out = F.when(rule == rule_host + prefix, F.lit(verdict)).otherwise(out)
    return out


def _absolute(link: Column, base: Column) -> Column:
    """A link made absolute by its page's url; null where that isn't possible."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?):", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    return (
        F.when(link.contains("://"), link)
        .when((site != "") & link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when((site != "") & link.startswith("/"), F.concat(site, link))
    )


def node(url: Column) -> Column:
    """A url without its fragment, which names a place within the same page."""
    return F.regexp_replace(url, r"(?s)#.*$", "")


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(src_url, dst_url)`` of every redirect (``meta refresh`` with a url) and canonical link."""
    marked = pages.where(F.col("html").rlike(r"(?i)canonical|refresh"))
    links = F.transform(
        F.regexp_extract_all("html", F.lit(LINK_TAG), F.lit(0)),
        lambda tag: F.concat(*[F.coalesce(F.regexp_extract(tag, HREF, i), F.lit("")) for i in (1, 2, 3)]),
    )
    refreshes = F.transform(
        F.regexp_extract_all("html", F.lit(META_TAG), F.lit(0)), lambda tag: F.regexp_extract(tag, REFRESH, 1)
    )
    found = marked.select("url", F.explode(F.concat(links, refreshes)).alias("link")).where("link <> ''")
    target = _absolute(F.trim(unescape(F.col("link"))), F.col("url"))
    edges = found.select(node(F.col("url")).alias("src_url"), node(target).alias("dst_url"))
    return edges.where("src_url is not null and dst_url is not null and src_url <> dst_url").distinct()


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages(page_id, url, html)``.

    A page that a rule fits has the rule's verdict. Any other takes part in the class of
    urls joined to it by redirects and canonical links, in either direction, urls that
    are no page included: it is allowed if a rule allows a url of the class, else
    blocked if a rule blocks one, else allowed. Null or malformed urls have an empty
    host and path and are allowed; repeated rows are judged alike.
    """
    edges = stage(alias_edges(pages))
    judged = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    judged = judged.withColumn("rule", rule(F.col("host"), F.col("path"), rules)).withColumn(
        "own", rule_verdict(F.col("rule"), rules)
    )
    key = lambda c: F.xxhash64(c)
    roots = components(edges.select(key("src_url").alias("src"), key("dst_url").alias("dst")))
    urls = edges.select(F.col("src_url").alias("url")).union(edges.select("dst_url")).distinct()
    own = rule_verdict(rule(host(F.col("url")), path(F.col("url")), rules), rules)
    votes = urls.select(key("url").alias("node"), own.alias("vote")).join(roots, "node")
    classes = votes.groupBy("root").agg(
        F.max(F.col("vote") == "allow").alias("some_allow"), F.max(F.col("vote") == "block").alias("some_block")
    )
    classes = roots.join(classes, "root").where("some_block and not coalesce(some_allow, false)").select("node", F.lit(True).alias("class_blocked"))
    joined = judged.withColumn("node", key(node(F.col("url")))).join(classes, "node", "left")
    other = F.when(F.col("class_blocked"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("own", other).alias("verdict"))
