"""The monitoring jobs: requests in, fact rows and one status per request out.

A job returns its records and statuses as DataFrames; ``run`` loads a datamart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsward.functions.text import compose_text
from newsward.operators.companies import fan_out_keywords, flag_known
from newsward.operators.filters import drop_pdf, filled, has_keys
from newsward.operators.links import article_text, cap_links
from newsward.operators.outcomes import coalesce_status
from newsward.operators.records import to_records
from newsward.operators.rules import rule_replies, tag_articles
from newsward.operators.skew import dimension_join, skew_join
from newsward.operators.summary import summarize
from newsward.session import stage
from newsward.sources.mart import JdbcMart, ParquetMart, load_datamart
from newsward.sources.news import flatten_news

# The texts of the statuses.
WEB_FIELDS_MISSING = "company_name, search_query, and company_id are required"
CSV_FIELDS_MISSING = "CSV must contain company_name, search_query, and company_id"
API_FIELDS_MISSING = "company_name and search_query are required"
API_ID_MISSING = "Company ID parameter is missing"
API_CSV_FIELDS_MISSING = "CSV must contain company_id, company_name, and keyword"
API_KEYS_MISSING = "Each dictionary must contain company_id, company_name, and keyword"
ID_NOT_FOUND = "Company ID not found"
NO_SOURCE = "No Source found"
SINGLE_DONE = "Company data added successfully"
SINGLE_FAILED = "Error occurred during data scraping"
BULK_DONE = "Data added successfully"
BULK_FAILED = "Error occurred"
API_NONE_FOUND = "No news articles found from the News API"
API_NONE_KEPT = "No valid data to add after processing"
API_BULK_NONE_FOUND = "No news found for the specified search query"
API_BULK_NONE_KEPT = "No news passed the ESG check"

# Takes rows with ``link`` and ``text`` and gives them a ``reply``; other columns stay.
Classifier = Callable[[DataFrame], DataFrame]


class InvalidRequests(ValueError):
    """A job that accepts only whole inputs met a bad row; nothing was written."""


@dataclass
class JobResult:
    """Records and statuses of a job.

    ``run`` loads the records and takes the statuses from the loaded rows, so that
    articles are extracted and classified once for both.
    """

    records: DataFrame
    status_of: Callable[[DataFrame], DataFrame]
    bridges: bool

    @property
    def statuses(self) -> DataFrame:
        return self.status_of(self.records)

    def run(self, mart: ParquetMart | JdbcMart, load_id: str) -> DataFrame:
        load = load_datamart(
            mart, self.records, ["request_id", "pos"], load_id=load_id, bridges=self.bridges
        )
        return self.status_of(load.details)


def precomputed(replies: DataFrame) -> Classifier:
    """A classifier that looks up stored replies by link; without one a row drops out."""
    stored = replies.select("link", "reply")

    def attach(articles: DataFrame) -> DataFrame:
        if "request_id" in articles.columns:
            return skew_join(articles, stored, "link", "inner", ["request_id", "pos"])
        return articles.join(stored, "link")

    return attach


def with_summary(articles: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Add ``summary``, made once per distinct text; '' for a text without sentences."""
    named = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = articles.where("text IS NOT NULL").select(named.alias("doc_id"), "text").dropDuplicates(["doc_id"])
    # Staged, so that Spark can split the join where many articles share a text.
    made = stage(summarize(texts, vectors, dim).withColumnRenamed("doc_id", "text_name"))
    joined = articles.withColumn("text_name", named).join(made, "text_name", "left").drop("text_name")
    return joined.withColumn("summary", F.coalesce("summary", F.lit("")))


def tagged(
    lexicon: DataFrame, countries: DataFrame, vectors: DataFrame | None = None, dim: int = 100
) -> Classifier:
    """A classifier that tags the texts by rules; with word ``vectors`` of ``dim``
    dimensions, it also summarises them."""

    def attach(articles: DataFrame) -> DataFrame:
        if vectors is not None:
            articles = with_summary(stage(articles), vectors, dim)
        return rule_replies(tag_articles(articles, lexicon, countries))

    return attach


def not_found_text() -> Column:
    return F.concat(F.lit("Company ID "), F.col("company_id"), F.lit(" not found"))


def _status_rule(
    requests: DataFrame,
    found: DataFrame,
    refusals: list[tuple[Column, str | Column]],
    texts: tuple[str, str, str],
    keep: list,
) -> Callable[[DataFrame], DataFrame]:
    """The status of each request: a refusal, or what its search gave."""
    none_found, done, failed = texts
    sources = found.select("request_id").distinct().withColumn("has_source", F.lit(True))

    def status_of(records: DataFrame) -> DataFrame:
        kept = records.groupBy("request_id").agg(F.count("*").alias("n_records"))
        # Both sides of the small join are of requests with links; the requests meet its result only.
        joined = requests.join(sources.join(kept, "request_id", "left"), "request_id", "left")
        status = coalesce_status(
            *refusals,
            (F.col("has_source").isNull(), none_found),
            (F.col("n_records") > 0, done),
            otherwise=failed,
        )
        return joined.select(*keep, status.alias("status"))

    return status_of


def _accepted(checked: DataFrame, refusals: list[tuple[Column, str | Column]]) -> DataFrame:
    refused = F.lit(False)
    for condition, _ in refusals:
        refused = refused | condition
    return checked.where(~refused).select("request_id", "company_id", "search_query")


def _web_job(
    requests: DataFrame,
    companies: DataFrame,
    links: DataFrame,
    pages: DataFrame,
    classifier: Classifier,
    refusals: list[tuple[Column, str | Column]],
    texts: tuple[str, str, str],
    keep: list,
    proc_ts: Column | None,
    flagged: bool = False,
) -> JobResult:
    """The cap comes first, so at most nine narrow rows per request go on. These are
    staged, as the text, the join and the statuses all start from them. Text is
    extracted and classified once per distinct link; pages never meet the requests.
    ``flagged`` requests have their ``is_known`` already."""
    checked = requests if flagged else flag_known(requests, companies)
    columns = [c for c in ("request_id", "pos", "link", "content_type") if c in links.columns]
    capped = cap_links(links.select(*columns))
    found = stage(_accepted(checked, refusals).join(capped, "request_id"))
    opened = drop_pdf(found)
    answered = skew_join(
        opened.select("request_id", "pos", "company_id", "search_query", "link"),
        classifier(article_text(opened, pages)).select("link", "reply"),
        "link", "inner", ["request_id", "pos"],
    )
    records = to_records(answered, "News", proc_ts, keep=("request_id", "pos"))
    return JobResult(records, _status_rule(checked, found, refusals, texts, keep), bridges=True)


KEPT = ["request_id", "company_id", "company_name", "search_query"]
WEB_FIELDS = ("company_name", "search_query", "company_id")


def monitor_single(
    requests: DataFrame,
    companies: DataFrame,
    links: DataFrame,
    pages: DataFrame,
    classifier: Classifier,
    proc_ts: Column | None = None,
) -> JobResult:
    """Requests that each stand alone. Their slice of 20 links changes nothing, as the
    cap of nine follows."""
    return _web_job(
        requests, companies, links, pages, classifier,
        [(~filled(*WEB_FIELDS), WEB_FIELDS_MISSING), (~F.col("is_known"), ID_NOT_FOUND)],
        (NO_SOURCE, SINGLE_DONE, SINGLE_FAILED), KEPT, proc_ts,
    )


def _refuse_bad_rows(bad: DataFrame) -> None:
    """Name the first bad row: in the order of ``row_no``, its place in the file, if the
    requests carry one, else of ``request_id``."""
    order = [name for name in ("row_no", "request_id") if name in bad.columns]
    first = bad.orderBy(*order, "reason").take(1)
    if first:
        raise InvalidRequests(first[0]["reason"])


def monitor_bulk(
    requests: DataFrame,
    companies: DataFrame,
    links: DataFrame,
    pages: DataFrame,
    classifier: Classifier,
    mode: str = "report",
    proc_ts: Column | None = None,
) -> JobResult:
    """Many requests. A bad row gets its own status (``report``) or fails the whole
    job before anything is read further or written (``fail``)."""
    if mode == "fail":
        checked = flag_known(requests, companies)
        reason = F.when(~filled(*WEB_FIELDS), CSV_FIELDS_MISSING).when(
            ~F.col("is_known"), not_found_text()
        )
        _refuse_bad_rows(checked.withColumn("reason", reason).where("reason IS NOT NULL"))
    elif mode != "report":
        raise ValueError(f"unknown mode: {mode}")
    return _web_job(
        requests, companies, links, pages, classifier,
        [(~filled(*WEB_FIELDS), WEB_FIELDS_MISSING), (~F.col("is_known"), not_found_text())],
        (NO_SOURCE, BULK_DONE, BULK_FAILED), KEPT, proc_ts,
    )


def keyword_requests(companies_asked: DataFrame, lexicon: DataFrame, on_unknown: str = "default") -> DataFrame:
    """The requests of a fan-out; their ids are ``<company_id>:<keyword position>``."""
    fanned = fan_out_keywords(companies_asked, lexicon, on_unknown)
    return fanned.withColumn("request_id", F.concat_ws(":", "company_id", "pos")).drop("pos")


def monitor_keywords(
    companies_asked: DataFrame,
    lexicon: DataFrame,
    companies: DataFrame,
    links: DataFrame,
    pages: DataFrame,
    classifier: Classifier,
    on_unknown: str = "default",
    proc_ts: Column | None = None,
) -> JobResult:
    """Each company with all keywords of its industry; fields are not checked.

    ``links`` carries the request ids of ``keyword_requests``. The companies are looked up before
    the fan-out, once each instead of once per keyword.
    """
    requests = keyword_requests(flag_known(companies_asked, companies), lexicon, on_unknown)
    keep = ["request_id", "company_id", "company_name", F.col("search_query").alias("Keyword")]
    return _web_job(
        requests, companies, links, pages, classifier,
        [(~F.col("is_known"), F.coalesce(not_found_text(), F.lit("Company ID None not found")))],
        (NO_SOURCE, BULK_DONE, BULK_FAILED), keep, proc_ts, flagged=True,
    )


def _api_job(
    requests: DataFrame,
    companies: DataFrame,
    envelopes: DataFrame,
    classifier: Classifier,
    refusals: list[tuple[Column, str | Column]],
    texts: tuple[str, str, str],
    proc_ts: Column | None,
) -> JobResult:
    """``envelopes`` has request_id beside the fields of a response. Its accepted articles
    are staged, as the texts and the statuses both start from them."""
    checked = flag_known(requests, companies)
    flat = flatten_news(envelopes, keep=("request_id",)).drop("source", "author")
    articles = stage(
        dimension_join(flat, _accepted(checked, refusals), "request_id", "inner", ["pos", "url"])
    )
    texted = articles.select(
        "request_id",
        "pos",
        "company_id",
        "search_query",
        F.col("url").alias("link"),
        F.col("publishedAt").alias("published_at"),
        compose_text(F.col("title"), F.col("description")).alias("text"),
    )
    records = to_records(classifier(texted), "NewsAPI", proc_ts, keep=("request_id", "pos"))
    return JobResult(records, _status_rule(checked, articles, refusals, texts, KEPT), bridges=False)


def monitor_news_api(
    requests: DataFrame,
    companies: DataFrame,
    envelopes: DataFrame,
    classifier: Classifier,
    proc_ts: Column | None = None,
) -> JobResult:
    """Requests that each stand alone, answered by stored news API responses."""
    return _api_job(
        requests, companies, envelopes, classifier,
        [
            (~filled("company_name", "search_query"), API_FIELDS_MISSING),
            (~filled("company_id"), API_ID_MISSING),
            (~F.col("is_known"), ID_NOT_FOUND),
        ],
        (API_NONE_FOUND, SINGLE_DONE, API_NONE_KEPT), proc_ts,
    )


def monitor_news_api_bulk(
    requests: DataFrame,
    companies: DataFrame,
    envelopes: DataFrame,
    classifier: Classifier,
    proc_ts: Column | None = None,
    source: str = "csv",
) -> JobResult:
    """Many requests. A row that lacks a field fails the whole job; a company that is
    not known gets its status. CSV rows need values; JSON objects need only the keys,
    which ``refuse_missing_keys`` checks on their text."""
    if source == "csv":
        bad = requests.where(~filled("company_id", "company_name", "search_query"))
        _refuse_bad_rows(bad.select(F.lit(API_CSV_FIELDS_MISSING).alias("reason")))
    return _api_job(
        requests, companies, envelopes, classifier,
        [(~F.col("is_known"), ID_NOT_FOUND)],
        (API_BULK_NONE_FOUND, SINGLE_DONE, API_BULK_NONE_KEPT), proc_ts,
    )


def refuse_missing_keys(request_objects: DataFrame) -> None:
    """Fail if a JSON request lacks one of the keys; null values are allowed."""
    present = has_keys(F.col("request"), ["company_id", "company_name", "keyword"])
    _refuse_bad_rows(request_objects.where(~present).select(F.lit(API_KEYS_MISSING).alias("reason")))


