"""Search links of requests and the articles behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsward.functions import html as H
from newsward.functions.text import clean_text
from newsward.operators.skew import near_keys, skew_join
from newsward.session import stage

# Links used per request, and the slice of the single-company route.
LINKS_PER_REQUEST = 9
SINGLE_SLICE = 20


def first_n(links: DataFrame, n: int, key: str = "request_id") -> DataFrame:
    """The first ``n`` links of each request by position.

    The rank filter is applied before the shuffle as well, so a request with very
    many links sends at most ``n`` rows per input partition.
    """
    order = [F.col("pos"), F.col("link")]
    ranked = links.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("rank") <= n).drop("rank")


def cap_links(links: DataFrame, key: str = "request_id") -> DataFrame:
    """Ten links or more are cut to nine, which is the same as the first nine."""
    return first_n(links, LINKS_PER_REQUEST, key)


def requests_with_links(requests: DataFrame, links: DataFrame) -> DataFrame:
    """Keep requests that found nothing, with null link columns.

    The links are the side that may hold very many rows of one request, so they are
    spread, and the requests without any are added from an anti join.
    """
    found = skew_join(links, requests, "request_id", "inner", ["pos", "link"])
    ids = links.select("request_id").distinct()
    empty = requests.join(ids, "request_id", "left_anti")
    both = found.unionByName(empty, allowMissingColumns=True)
    return both.select(*requests.columns, *[c for c in links.columns if c != "request_id"])


def article_text(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(link, text) once per distinct link that has a stored page.

    A link found by many requests is fetched and cleaned once; only its key is
    shuffled with the requests. Of pages stored again under a link, the smallest text counts.
    HTML never moves: a bit map of the wanted links filters the pages where they are read,
    and the texts of those that pass meet the links themselves.
    """
    wanted = links.select("link").distinct()
    stored = near_keys(pages.select("link", "html").where(F.col("html") != ""), wanted, "link")
    texts = stored.select("link", clean_text(H.html_text(F.col("html"))).alias("text"))
    once = texts.groupBy("link").agg(F.min("text").alias("text"))
    return once.join(wanted, "link", "left_semi")


def links_with_text(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Each link with its cleaned article text; a link without page drops out."""
    links = stage(links)
    return skew_join(links, article_text(links, pages), "link", "inner", ["request_id", "pos"])


def with_replies(
    articles: DataFrame,
    replies: DataFrame,
    key: str = "doc_id",
    salt_by: list[str] | None = None,
) -> DataFrame:
    """Attach precomputed classifier replies; articles without one keep a null reply.

    Of replies stored again under a key, the smallest counts. Where many rows may share a key, as with links, ``salt_by`` names what tells them apart.
    """
    stored = replies.groupBy(key).agg(F.min("reply").alias("reply"))
    if salt_by is None:
        return articles.join(stored, key, "left")
    return skew_join(articles, stored, key, "left", salt_by)
