"""One entry per operator: a Spark query and, where SQL can say it, its oracle."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from checks import sql as S
from checks.fixtures import fixture, read_table, run_sql, sql_of
from newsward import lexicons
from newsward.functions import html as H
from newsward.functions import messages as M
from newsward.functions import reply as R
from newsward.functions import text as T
from newsward.functions.once import compute_once
from newsward.operators import companies as C
from newsward.operators import datamart as D
from newsward.operators import filters as P
from newsward.operators import links as L
from newsward.operators import outcomes as O
from newsward.operators import records as X
from newsward.operators import boundaries, rules, summary
from newsward.operators.ids import with_ids
from newsward.plans import jobs
from newsward.session import scratch_path, spread
from newsward.sources import exports, news, pages, requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return query

    return register


def proc_ts() -> Column:
    """A fixed load time."""
    return F.lit("2024-06-01 12:00:00").cast("timestamp")


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select(F.col("url").alias("link"), "html", "page_id")


def projected(name: str, table: str, oracle: str | None, key: str, **columns) -> None:
    """Register a row-wise projection of a table or fixture."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = (
            fixture(spark, sf_dir, table[1:]) if table[0] == "@" else read_table(spark, sf_dir, table)
        )
        return source.select(key, *[make().alias(c) for c, make in columns.items()])

    check(name, oracle)(query)


# ---- sources ---------------------------------------------------------------------------


@check("requests_from_csv", f"""
SELECT CAST(request_id AS VARCHAR) AS request_id, company_id, company_name,
  nullif(search_query, '') AS search_query FROM {sql_of('requests')}""")
def requests_from_csv(spark, sf_dir):
    path = scratch_path(spark, "requests-csv")
    fixture(spark, sf_dir, "requests").write.options(header=True, emptyValue="").csv(path)
    return requests.read_requests_csv(spark, path)


@check("requests_from_json", f"""
SELECT company_id, company_name, search_query FROM {sql_of('requests')}""")
def requests_from_json(spark, sf_dir):
    path = scratch_path(spark, "requests-json")
    fixture(spark, sf_dir, "requests").write.json(path)
    fields = ["company_id", "company_name", "search_query"]
    return requests.read_requests_json(spark, path, fields, json_lines=True)


LEXICON_ROWS = ", ".join(
    f"({lexicons.quoted(industry)}, {pos}, {lexicons.quoted(keyword)})"
    for industry, words in sorted(lexicons.INDUSTRY_KEYWORDS.items()) for pos, keyword in enumerate(words)
)


@check("keyword_files", f"""
SELECT industry, CAST(pos AS INTEGER) AS pos, keyword FROM (VALUES {LEXICON_ROWS}) AS l(industry, pos, keyword)
UNION ALL
SELECT DISTINCT 'segment ' || lower(c_mktsegment), 0, c_mktsegment || ' news' FROM customer""")
def keyword_files(spark, sf_dir):
    """A file per industry, as the lists are kept, and one per market segment of the customers."""
    path = scratch_path(spark, "keyword-files")
    stems = F.create_map(*[F.lit(v) for stem, label in requests.FILE_LABELS.items() for v in (label, stem)])
    own = lexicons.keyword_table(spark).groupBy("industry").agg(F.sort_array(F.collect_list(F.struct("pos", "keyword"))).alias("rows"))
    lists = own.select(F.coalesce(stems[F.col("industry")], F.col("industry")).alias("stem"), F.col("rows.keyword").alias("words"))
    segments = read_table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    more = segments.select(F.concat(F.lit("segment "), F.lower("c_mktsegment")).alias("stem"), F.array(F.concat("c_mktsegment", F.lit(" news"))).alias("words"))
    filesystem = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in lists.union(more).collect():  # a file per industry
        out = filesystem.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{row['stem']}_keywords.json"))
        out.write(bytearray(json.dumps(row["words"]).encode()))
        out.close()
    return requests.read_lexicons(spark, path)


@check("requests_from_json_array", f"""
SELECT company_id, company_name, search_query FROM {sql_of('requests')}""")
def requests_from_json_array(spark, sf_dir):
    """One array per file, as clients send it; files of bounded size."""
    path = scratch_path(spark, "requests-array")
    asked = fixture(spark, sf_dir, "requests").select("company_id", "company_name", "search_query")
    lot = F.pmod(F.xxhash64(*asked.columns), F.lit(64))
    arrays = asked.groupBy(lot.alias("lot")).agg(F.to_json(F.collect_list(F.struct(*asked.columns)), {"ignoreNullFields": "false"}).alias("value"))
    arrays.select("lot", "value").write.partitionBy("lot").text(path)
    fields = ["company_id", "company_name", "search_query"]
    return requests.read_requests_json(spark, path, fields).select(*fields)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored responses as JSON text, two articles each."""
    flat = fixture(spark, sf_dir, "news")

    def article(number: int):
        title = F.col("title") if number == 0 else F.concat("title", F.lit(" again"))
        return F.struct(
            F.struct(F.lit(None).cast("string").alias("id"), F.col("source").alias("name")).alias("source"),
            title.alias("title"),
            F.col("description"),
            (F.col("url") if number == 0 else F.concat("url", F.lit("/2"))).alias("url"),
            F.col("published_at").alias("publishedAt"),
        )

    envelope = F.struct(
        "status",
        F.col("total_results").alias("totalResults"),
        F.array(article(0), article(1)).alias("articles"),
    )
    text = flat.select("doc_id", "request_id", F.to_json(envelope).alias("response"))
    parsed = compute_once(text, "parsed", news.parse_envelope(F.col("response")))
    return parsed.select("doc_id", "request_id", "parsed.*")


NEWS_ARTICLES = f"""
SELECT doc_id, request_id, pos, source, '' AS author, CASE pos WHEN 0 THEN title ELSE title || ' again' END AS title,
  description, CASE pos WHEN 0 THEN url ELSE url || '/2' END AS url, published_at AS "publishedAt"
FROM {sql_of('news')} AS n, (VALUES (0), (1)) AS v(pos)
WHERE status = 'ok' AND total_results > 0"""


@check("news_articles", NEWS_ARTICLES)
def news_articles(spark, sf_dir):
    return news.flatten_news(envelopes(spark, sf_dir), keep=("doc_id", "request_id"))


BLOCKS = """regexp_extract_all(html, '(?is)<div class="algo-sr">(.*?)</div>', 1)"""
SERP_LINKS = f"""
SELECT request_id, page_no, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place,
  regexp_extract(block, '(?i)href="([^"]*)"', 1) AS link,
  nullif(regexp_extract(block, '(?is)<a[^>]*>(.*?)</a>', 1), '') AS headline
FROM (SELECT page_id, request_id, page_no, unnest({BLOCKS}) AS block,
    generate_subscripts({BLOCKS}, 1) AS i FROM {sql_of('result_pages')} AS p) AS b
WHERE contains(block, '<a ')"""


@check("search_links", f"""
SELECT request_id, page_no, CAST(place AS INTEGER) AS pos, link, headline FROM ({SERP_LINKS}) AS s""")
def search_links(spark, sf_dir):
    found = fixture(spark, sf_dir, "result_pages").withColumn(
        "request_id", F.struct("request_id", "page_no")
    )
    links = pages.extract_search_links(found)
    return links.select("request_id.request_id", "request_id.page_no", "pos", "link", "headline")


@check("paged_search_links", f"""
WITH s AS ({SERP_LINKS}), gap AS (
  SELECT request_id, min(page_no) AS gap FROM {sql_of('result_pages')} AS p
  WHERE NOT contains(html, 'algo-sr') GROUP BY request_id)
SELECT s.request_id, page_no,
  CAST(row_number() OVER (PARTITION BY s.request_id ORDER BY page_no, place) - 1 AS INTEGER) AS pos, link, headline
FROM s LEFT JOIN gap ON gap.request_id = s.request_id
WHERE page_no <= 3 AND (gap IS NULL OR page_no < gap)""")
def paged_search_links(spark, sf_dir):
    return pages.extract_paged_links(fixture(spark, sf_dir, "result_pages"), page_limit=3)


@check("stored_pages", "SELECT url AS link, html FROM pages")
def read_stored_pages(spark, sf_dir):
    return pages.read_pages(spark, f"{sf_dir}/pages.parquet")


@check("report_table_rows", f"""
SELECT page_id, 0 AS table_no, 0 AS "index", trim(cells[1]) AS "Event Date", '/r/' || page_id || '.pdf' AS "Link_text",
  cells[3] AS "Location", cells[4] AS "Themes", cells[5] AS "Sectors", cells[6] AS "Regulator Name"
FROM (SELECT page_id, regexp_extract_all(html, '<td>(.*?)</td>', 1) AS cells FROM {sql_of('tables')} AS t) AS c
UNION ALL
SELECT page_id, 0, 1, 'short', NULL, NULL, NULL, NULL, NULL FROM {sql_of('tables')} AS t WHERE contains(html, 'short')""")
def report_table_rows(spark, sf_dir):
    return pages.extract_table_rows(spread(fixture(spark, sf_dir, "tables")))


@check("nested_table_rows", """
SELECT o_orderkey AS page_id, CAST(t AS INTEGER) AS table_no, CAST(i AS INTEGER) AS "index", replace(a, '#', k) AS "Event Date",
  replace(b, '#', k) AS "Link_text", c AS "Location", replace(d, '#', k) AS "Themes", e AS "Sectors", f AS "Regulator Name"
FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS k FROM orders) AS o, (VALUES
  (0, 0, 'D#', '/r/#.pdf', 'x', 'I#', 'second', 'T'), (0, 1, 'x', NULL, NULL, NULL, NULL, NULL), (0, 2, 'I#', '/i/#', NULL, NULL, NULL, NULL),
  (0, 3, 'second', NULL, NULL, NULL, NULL, NULL), (0, 4, 'last', NULL, NULL, NULL, NULL, NULL),
  (1, 0, 'I#', '/i/#', NULL, NULL, NULL, NULL), (1, 1, 'second', NULL, NULL, NULL, NULL, NULL)) AS r(t, i, a, b, c, d, e, f)""")
def nested_table_rows(spark, sf_dir):
    return pages.extract_table_rows(spread(fixture(spark, sf_dir, "nested_tables")))


@check("company_dimension", """
SELECT CAST(c_custkey AS BIGINT) AS company_key, c_name AS company_name FROM customer""")
def company_dimension(spark, sf_dir):
    dim = requests.read_dimension(spark, path=f"{sf_dir}/customer.parquet")
    return dim.select(F.col("c_custkey").alias("company_key"), F.col("c_name").alias("company_name"))


# ---- text ------------------------------------------------------------------------------

projected(
    "page_text", "pages", f"SELECT page_id, {S.html_text('html')} AS text FROM pages", "page_id",
    text=lambda: H.html_text(F.col("html")),
)
projected(
    "stripped_urls", "@url_texts",
    f"SELECT doc_id, {S.strip_urls('text')} AS text FROM {sql_of('url_texts')} AS t", "doc_id",
    text=lambda: T.strip_urls(F.col("text")),
)
projected(
    "collapsed_space", "documents",
    f"SELECT doc_id, {S.collapse_ws('text')} AS text FROM documents", "doc_id",
    text=lambda: T.collapse_ws(F.col("text")),
)
projected(
    "clean_text", "@url_texts",
    f"SELECT doc_id, {S.collapse_ws(S.strip_urls('text'))} AS text FROM {sql_of('url_texts')} AS t",
    "doc_id", text=lambda: T.clean_text(F.col("text")),
)
projected(
    "composed_text", "@news", f"""
SELECT doc_id, coalesce(title, 'None') || chr(10) || coalesce(description, 'None') AS text
FROM {sql_of('news')} AS n""", "doc_id",
    text=lambda: T.compose_text(F.col("title"), F.col("description")),
)
TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
projected(
    "page_title_keyword", "pages",
    f"SELECT page_id, {S.collapse_ws(S.unescape(TITLE))} AS keyword FROM pages", "page_id",
    keyword=lambda: H.page_title_keyword(F.col("html")),
)
H1 = f"regexp_extract_all({S.drop_hidden('html')}, '(?is)<h1[^>]*>(.*?)</h1>', 1)"
H1_TEXT = f"list_transform({H1}, lambda h: {S.strip_ws(S.fragment_text('h'))})"
projected(
    "page_headline", "pages", f"""
SELECT page_id, {H1_TEXT}[1] AS headline, array_to_string({H1_TEXT}, ' | ') AS headlines FROM pages""",
    "page_id",
    headline=lambda: H.headline(F.col("html")),
    headlines=lambda: F.array_join(H.headlines(F.col("html")), " | "),
)
CONTAINERS = "article|body|div|footer|header|html|li|main|nav|section|td|ul|ol|table"
OPENED = "regexp_replace(" + S.drop_hidden("html") + r", '(?i)<p([\s][^>]*)?>', chr(1), 'g')"
BODY = (
    rf"string_split(regexp_replace(s, '(?i)</p\s*>|<p\b|</(?:{CONTAINERS})\s*>', chr(2), 'g'), chr(2))[1]"
)
projected(
    "paragraph_text", "pages", f"""
SELECT page_id, array_to_string(list_transform(list_transform(string_split({OPENED}, chr(1))[2:],
  lambda s: {BODY}), lambda b: {S.strip_ws(S.fragment_text('b'))}), chr(10)) AS text FROM pages""",
    "page_id", text=lambda: H.paragraph_text(F.col("html")),
)


@check("page_anchors", f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, {S.unescape('href')} AS href FROM (
  SELECT page_id, unnest(regexp_extract_all({S.drop_hidden('html')}, '(?i)<a href="([^"]*)"', 1)) AS href,
    generate_subscripts(regexp_extract_all({S.drop_hidden('html')}, '(?i)<a href="([^"]*)"', 1), 1) AS i
  FROM pages) AS a""")
def page_anchors(spark, sf_dir):
    source = read_table(spark, sf_dir, "pages")
    return source.select("page_id", F.posexplode(H.anchors(F.col("html"))).alias("pos", "href"))


@check("search_phrases", f"""
SELECT request_id, concat_ws(' ', company_name, search_query, 'news') AS web,
  concat_ws(' ', company_name, search_query) AS plain, concat_ws(' ', search_query, company_name) AS api
FROM {sql_of('requests')} AS r""")
def search_phrases(spark, sf_dir):
    asked = fixture(spark, sf_dir, "requests")
    name, query = F.col("company_name"), F.col("search_query")
    return asked.select(
        "request_id", *[T.search_phrase(name, query, s).alias(s) for s in ("web", "plain", "api")]
    )


# ---- filters and limits ----------------------------------------------------------------

IS_PDF = "(lower(link) LIKE '%.pdf' OR contains(lower(coalesce(content_type, '')), 'pdf'))"


@check("pdf_links", f"SELECT request_id, pos, {IS_PDF} AS is_pdf FROM {sql_of('links')} AS l")
def pdf_links(spark, sf_dir):
    links = fixture(spark, sf_dir, "links")
    return links.select(
        "request_id", "pos", P.is_pdf(F.col("link"), F.col("content_type")).alias("is_pdf")
    )


@check("links_without_pdf", f"""
SELECT request_id, pos, link, content_type FROM {sql_of('links')} AS l WHERE pos <= 9 AND NOT {IS_PDF}""")
def links_without_pdf(spark, sf_dir):
    return P.drop_pdf(L.cap_links(fixture(spark, sf_dir, "links")))


REQUIRED = ["company_name", "search_query", "company_id"]
VALID = "coalesce(company_name, '') <> '' AND coalesce(search_query, '') <> '' AND coalesce(company_id, '') <> ''"


@check("required_fields", f"SELECT * FROM {sql_of('requests')} AS r WHERE {VALID}")
def required_fields(spark, sf_dir):
    return P.required_fields(fixture(spark, sf_dir, "requests"), REQUIRED)


@check("missing_fields", f"SELECT * FROM {sql_of('requests')} AS r WHERE NOT ({VALID})")
def missing_fields(spark, sf_dir):
    return P.missing_fields(fixture(spark, sf_dir, "requests"), REQUIRED)


@check("objects_with_keys", f"""
SELECT doc_id, contains(keys, 'categories') AND contains(keys, 'country') AS has_keys FROM (
  SELECT doc_id, json_keys({S.safe('reply')}) AS keys FROM {sql_of('replies')} AS r) AS k""")
def objects_with_keys(spark, sf_dir):
    replies = fixture(spark, sf_dir, "replies")
    return replies.select("doc_id", P.has_keys(F.col("reply"), ["categories", "country"]).alias("has_keys"))


SAFE_REPLIES = f"(SELECT doc_id, reply, {S.safe('reply')} AS js FROM {sql_of('replies')} AS r)"
for gate_mode in ("web", "api"):
    check(f"esg_gate_{gate_mode}", f"""
SELECT doc_id, reply FROM {SAFE_REPLIES} AS r WHERE {S.gate('js', gate_mode)}""")(
        lambda spark, sf_dir, mode=gate_mode: P.esg_replies(fixture(spark, sf_dir, "replies"), mode)
    )


@check("valid_replies", f"""
SELECT doc_id, reply FROM {SAFE_REPLIES} AS r WHERE js = reply""")
def valid_replies(spark, sf_dir):
    return P.valid_replies(fixture(spark, sf_dir, "replies"))


@check("bad_replies", f"""
SELECT doc_id, reply FROM {SAFE_REPLIES} AS r WHERE js <> reply""")
def bad_replies(spark, sf_dir):
    return P.bad_replies(fixture(spark, sf_dir, "replies"))


VERDICT = f"CASE WHEN js <> reply THEN 'malformed' WHEN {S.gate('js', 'web')} THEN 'accepted' ELSE 'gated' END"


@check("reply_verdicts", f"SELECT doc_id, {VERDICT} AS verdict FROM {SAFE_REPLIES} AS r")
def reply_verdicts(spark, sf_dir):
    return P.judged_replies(fixture(spark, sf_dir, "replies")).select("doc_id", "verdict")


@check("reply_counts", f"""
SELECT count(*) FILTER (verdict = 'accepted') AS accepted, count(*) FILTER (verdict = 'gated') AS gated,
  count(*) FILTER (verdict = 'malformed') AS malformed FROM (SELECT {VERDICT} AS verdict FROM {SAFE_REPLIES} AS r) AS v""")
def reply_counts(spark, sf_dir):
    """The numbers gathered while the judged replies are written."""
    counts = Observation("reply-counts")
    judged = P.judged_replies(fixture(spark, sf_dir, "replies"), counts=counts)
    judged.write.partitionBy("verdict").parquet(scratch_path(spark, "judged-replies"))
    row = [int(counts.get[name]) for name in P.VERDICTS]
    return spark.createDataFrame([row], ", ".join(f"{name} bigint" for name in P.VERDICTS))


@check("capped_links", f"SELECT * FROM {sql_of('links')} AS l WHERE pos <= 9")
def capped_links(spark, sf_dir):
    return L.cap_links(fixture(spark, sf_dir, "links"))


@check("first_links", f"SELECT * FROM {sql_of('links')} AS l WHERE pos <= 20")
def first_links(spark, sf_dir):
    return L.first_n(fixture(spark, sf_dir, "links"), L.SINGLE_SLICE)


# ---- joins -----------------------------------------------------------------------------

COMPANY_IDS = f"(SELECT company_id FROM {sql_of('companies')} AS c)"


@check("known_companies", f"""
SELECT * FROM {sql_of('requests')} AS r WHERE company_id IN {COMPANY_IDS}""")
def known_companies(spark, sf_dir):
    return C.known_companies(fixture(spark, sf_dir, "requests"), fixture(spark, sf_dir, "companies"))


@check("unknown_companies", f"""
SELECT * FROM {sql_of('requests')} AS r WHERE coalesce(company_id, '-') NOT IN {COMPANY_IDS}""")
def unknown_companies(spark, sf_dir):
    return C.unknown_companies(fixture(spark, sf_dir, "requests"), fixture(spark, sf_dir, "companies"))


FAN_OUT = f"""
SELECT company_id, company_name, c.industry, pos, keyword AS search_query
FROM {sql_of('companies')} AS c JOIN {sql_of('lexicon')} AS l
  ON l.industry = CASE WHEN c.industry IS NULL OR c.industry = 'Aerospace' THEN 'default' ELSE c.industry END"""


@check("keyword_fan_out", FAN_OUT)
def keyword_fan_out(spark, sf_dir):
    return C.fan_out_keywords(fixture(spark, sf_dir, "companies"), lexicons.keyword_table(spark))


@check("country_lookup", f"""
SELECT doc_id, r.country, c.id AS country_id FROM {sql_of('records')} AS r
LEFT JOIN {sql_of('countries')} AS c ON lower(c.country) = lower(r.country)""")
def country_lookup(spark, sf_dir):
    found = D.lookup_country(
        fixture(spark, sf_dir, "records"), fixture(spark, sf_dir, "countries"), ["doc_id"]
    )
    return found.select("doc_id", "country", "country_id")


projected(
    "category_theme", "@records",
    f"SELECT doc_id, {S.theme_id('category')} AS theme_id FROM {sql_of('records')} AS r", "doc_id",
    theme_id=lambda: D.theme_id(F.col("category")),
)


@check("reply_themes", f"""
SELECT doc_id, theme_id FROM (
  SELECT doc_id, {S.theme_id('category')} AS theme_id FROM (
    SELECT doc_id, unnest(CASE json_type(js, '$.categories') WHEN 'VARCHAR' THEN [json_extract_string(js, '$.categories')]
      WHEN 'ARRAY' THEN json_extract_string(js, '$.categories[*]') ELSE [] END) AS category
    FROM {SAFE_REPLIES} AS r) AS c) AS t
WHERE theme_id IS NOT NULL""")
def reply_themes(spark, sf_dir):
    parsed = fixture(spark, sf_dir, "replies").select("doc_id", R.parse_reply(F.col("reply")).alias("v"))
    return parsed.select("doc_id", F.explode(D.theme_ids(R.category_list(F.col("v")))).alias("theme_id"))


@check("requests_with_links", f"""
SELECT r.*, pos, link, content_type FROM {sql_of('requests')} AS r
LEFT JOIN {sql_of('links')} AS l ON l.request_id = r.request_id""")
def requests_with_links(spark, sf_dir):
    return L.requests_with_links(fixture(spark, sf_dir, "requests"), fixture(spark, sf_dir, "links"))


@check("links_with_text", f"""
SELECT request_id, pos, link, content_type, text FROM {sql_of('links')} AS l
JOIN (SELECT url, {S.collapse_ws(S.strip_urls(S.html_text('html')))} AS text FROM pages WHERE html <> '') AS p
  ON p.url = l.link WHERE pos <= 9""")
def links_with_text(spark, sf_dir):
    capped = L.cap_links(fixture(spark, sf_dir, "links"))
    return L.links_with_text(capped, stored_pages(spark, sf_dir))


@check("articles_with_replies", f"""
SELECT n.doc_id, n.url, r.reply FROM {sql_of('news')} AS n LEFT JOIN {sql_of('replies')} AS r ON r.doc_id = n.doc_id""")
def articles_with_replies(spark, sf_dir):
    articles = fixture(spark, sf_dir, "news").select("doc_id", "url")
    return L.with_replies(articles, fixture(spark, sf_dir, "replies"))


# ---- outcomes --------------------------------------------------------------------------

KEPT_LINKS = f"""
SELECT request_id, pos, l.link, js FROM {sql_of('links')} AS l JOIN (
  SELECT link, {S.safe('reply')} AS js FROM {sql_of('page_replies')} AS p) AS r ON r.link = l.link
WHERE pos <= 9 AND NOT {IS_PDF.replace("link", "l.link", 1)} AND {S.gate('js', 'web')}"""


def kept_links(spark, sf_dir):
    links = P.drop_pdf(L.cap_links(fixture(spark, sf_dir, "links")))
    replies = fixture(spark, sf_dir, "page_replies")
    return P.esg_replies(L.with_replies(links, replies, "link", ["request_id", "pos"]))


@check("request_outcome", f"""
SELECT r.*, coalesce(n, 0) AS n_records, CASE WHEN n > 0 THEN 'Data added successfully' ELSE 'Error occurred' END AS status
FROM {sql_of('requests')} AS r LEFT JOIN (
  SELECT request_id, count(*) AS n FROM ({KEPT_LINKS}) AS k GROUP BY request_id) AS c ON c.request_id = r.request_id""")
def request_outcome(spark, sf_dir):
    asked = fixture(spark, sf_dir, "requests")
    return O.request_outcome(asked, kept_links(spark, sf_dir), jobs.BULK_DONE, jobs.BULK_FAILED)


NEW_COUNTRIES = f"""
SELECT min(doc_id) AS first_seq, arg_min(country, doc_id) AS country FROM {sql_of('records')} AS r
WHERE lower(country) NOT IN (SELECT lower(country) FROM {sql_of('countries')} AS c) GROUP BY lower(country)"""


@check("new_countries", NEW_COUNTRIES)
def new_countries(spark, sf_dir):
    return D.new_countries(
        fixture(spark, sf_dir, "records"), fixture(spark, sf_dir, "countries"), "doc_id"
    )


@check("results_list", f"""
SELECT '{{"company_name":"' || company_name || '","status":"' || CASE WHEN {VALID} THEN 'Data added successfully'
  ELSE 'Error occurred' END || '"}}' AS result FROM {sql_of('requests')} AS r""")
def results_list(spark, sf_dir):
    asked = fixture(spark, sf_dir, "requests")
    status = F.when(P.filled(*REQUIRED), jobs.BULK_DONE).otherwise(jobs.BULK_FAILED)
    return O.results_list(asked.withColumn("status", status), ["company_name", "status"])


# ---- replies and records ---------------------------------------------------------------


@check("reply_fields", "SELECT doc_id, " + ", ".join(
    f"{S.field_text('js', f)} AS {f}" for f in ("sentiment", "summary", "country", "date")
) + f" FROM {SAFE_REPLIES} AS r WHERE js = reply")
def reply_fields(spark, sf_dir):
    parsed = fixture(spark, sf_dir, "replies").withColumn("v", R.parse_reply(F.col("reply")))
    return parsed.where(R.valid_reply(F.col("v"))).select(
        "doc_id", *[R.field_text(F.col("v"), f).alias(f) for f in ("sentiment", "summary", "country", "date")]
    )


@check("reply_json_fields", "SELECT doc_id, " + ", ".join(
    f"{S.field_json('js', f)} AS {f}" for f in ("categories", "incidents", "themes", "summary")
) + f" FROM {SAFE_REPLIES} AS r WHERE js = reply")
def reply_json_fields(spark, sf_dir):
    parsed = fixture(spark, sf_dir, "replies").withColumn("v", R.parse_reply(F.col("reply")))
    return parsed.where(R.valid_reply(F.col("v"))).select(
        "doc_id", *[R.field_json(F.col("v"), f).alias(f) for f in ("categories", "incidents", "themes", "summary")]
    )


projected(
    "country_titles", "@records",
    f"SELECT doc_id, {S.title_case('country')} AS country FROM {sql_of('records')} AS r", "doc_id",
    country=lambda: T.title_case(F.col("country")),
)
projected(
    "quotes_stripped", "@records",
    f"SELECT doc_id, {S.strip_quotes('category')} AS category FROM {sql_of('records')} AS r", "doc_id",
    category=lambda: T.strip_quotes(F.col("category")),
)
REPLY_DATE = S.field_text("js", "date")


@check("published_dates", f"""
SELECT doc_id, {S.published_date(REPLY_DATE)} AS published_date FROM {SAFE_REPLIES} AS r WHERE js = reply""")
def published_dates(spark, sf_dir):
    parsed = fixture(spark, sf_dir, "replies").withColumn("v", R.parse_reply(F.col("reply")))
    return parsed.where(R.valid_reply(F.col("v"))).select(
        "doc_id", T.published_date(R.field_text(F.col("v"), "date")).alias("published_date")
    )


def record_sql(source: str, provider: str, published: str, keys: str) -> str:
    """The twelve record columns over a source with company_id, search_query, link, js."""
    return f"""
SELECT {keys}, company_id, '{provider}' AS data_provider, {S.field_text('js', 'sentiment')} AS "Sentiment",
  {S.field_text('js', 'summary')} AS "Summary", {S.field_json('js', 'categories')} AS "Category",
  {S.field_json('js', 'incidents')} AS "Incident", {published} AS "Published_dt", link,
  search_query AS "Keywords_phrases", {S.field_json('js', 'themes')} AS "Themes",
  {S.field_text('js', 'country')} AS country, '2024-06-01 12:00:00' AS proc_ts FROM {source}"""


WEB_RECORDS = record_sql(
    f"""(SELECT k.*, company_id, search_query FROM ({KEPT_LINKS}) AS k JOIN {sql_of('requests')} AS r
  ON r.request_id = k.request_id WHERE {VALID} AND company_id IN {COMPANY_IDS}) AS w""",
    "News", REPLY_DATE, "request_id, pos",
)


def web_inputs(spark, sf_dir):
    return [fixture(spark, sf_dir, "companies"), fixture(spark, sf_dir, "links"), stored_pages(spark, sf_dir)]


def by_page_reply(spark, sf_dir):
    return jobs.precomputed(fixture(spark, sf_dir, "page_replies"))


@check("news_records", WEB_RECORDS)
def news_records(spark, sf_dir):
    asked = fixture(spark, sf_dir, "requests")
    return jobs.monitor_single(
        asked, *web_inputs(spark, sf_dir), by_page_reply(spark, sf_dir), proc_ts=proc_ts()
    ).records


@check("classifier_requests", """
SELECT conv_id, turn, '{"model":"gpt-4o-mini","seed":123,"messages":[{"role":"system","content":"Tag it."},{"role":"user","content":'
  || CAST(to_json(text) AS VARCHAR) || '}]}' AS request FROM conversations""")
def classifier_requests(spark, sf_dir):
    chosen = {k: M.PARAMETERS[k] for k in ("model", "seed")}
    request = M.classifier_request(F.col("text"), "Tag it.", chosen)
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", request.alias("request"))


# ---- rule-based tags -------------------------------------------------------------------

KEYWORDS = sorted(
    {" ".join("".join(c if c.isalnum() else " " for c in k.lower()).split())
     for words in lexicons.INDUSTRY_KEYWORDS.values() for k in words}
)
FOLDED = f"(SELECT doc_id, text, {S.fold('text')} AS f FROM {sql_of('articles')} AS a)"


@check("keyword_hits", f"""
SELECT doc_id, unnest({S.holding('f', KEYWORDS)}) AS keyword FROM {FOLDED} AS a""")
def keyword_hits(spark, sf_dir):
    return rules.match_keywords(fixture(spark, sf_dir, "articles"), lexicons.keyword_table(spark))


@check("keyword_hits_joined", f"""
SELECT DISTINCT doc_id, unnest({S.holding('f', KEYWORDS)}) AS keyword FROM {FOLDED} AS a""")
def keyword_hits_joined(spark, sf_dir):
    found = rules.join_hits(fixture(spark, sf_dir, "articles"), lexicons.keyword_table(spark), "keyword")
    return found.select("doc_id", F.col("term").alias("keyword")).distinct()


def counted(terms) -> str:
    return f"len({S.holding('f', sorted(terms))})"


E_N, S_N, G_N = (counted(lexicons.PILLAR_TERMS[p]) for p in ("Environmental", "Social", "Governance"))
CATEGORY = (
    f"CASE WHEN greatest({E_N}, {S_N}, {G_N}) = 0 THEN '' WHEN {E_N} >= {S_N} AND {E_N} >= {G_N} "
    f"THEN 'Environmental' WHEN {S_N} >= {G_N} THEN 'Social' ELSE 'Governance' END"
)
SCORE = f"({counted(lexicons.POLARITY_TERMS[1])} - {counted(lexicons.POLARITY_TERMS[-1])})"
TELLING = (
    f"array_to_string(list_filter({S.sentences('text')}, "
    f"lambda s: len({S.holding(S.fold('s'), lexicons.INCIDENT_TERMS)}) > 0), ' ')"
)
TAG_DATE = S.published_date(
    r"regexp_extract(text, '\b([0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})\b', 1)"
)
COUNTRY = f"""coalesce((SELECT arg_min(country, strpos(' ' || f || ' ', ' ' || {S.fold('country')} || ' ') * 1000 - length(country))
  FROM nation_names WHERE contains(' ' || f || ' ', ' ' || {S.fold('country')} || ' ')), '')"""
TAG_SQL = {
    "category": CATEGORY,
    "esg_check": f"CASE WHEN {CATEGORY} = '' THEN 'No' ELSE 'Yes' END",
    "themes": f"array_to_string(list_sort({S.holding('f', KEYWORDS)}), '; ')",
    "sentiment": f"CASE WHEN {SCORE} > 0 THEN 'Positive' WHEN {SCORE} < 0 THEN 'Negative' ELSE 'Neutral' END",
    "incidents": f"coalesce(nullif({TELLING}, ''), 'No incidents found')",
    "country": COUNTRY,
    "date": TAG_DATE,
}


def tags(spark, sf_dir):
    return rules.tag_articles(
        fixture(spark, sf_dir, "articles"), lexicons.keyword_table(spark), fixture(spark, sf_dir, "countries")
    )


def tag_query(column: str) -> Query:
    def query(spark, sf_dir):
        value = F.array_join(column, "; ") if column == "themes" else F.col(column)
        return tags(spark, sf_dir).select("doc_id", value.alias(column))

    return query


for tag_column, tag_sql in TAG_SQL.items():
    check(f"article_{tag_column}", f"""
WITH nation_names AS {sql_of('countries')} SELECT doc_id, {tag_sql} AS "{tag_column}" FROM {FOLDED} AS a""")(
        tag_query(tag_column)
    )


@check("article_country_by_name", f"""
WITH nation_names AS {sql_of('countries')} SELECT doc_id, {COUNTRY} AS country FROM {FOLDED} AS a""")
def article_country_by_name(spark, sf_dir):
    return rules.tag_countries(fixture(spark, sf_dir, "articles"), fixture(spark, sf_dir, "countries"))


@check("python_classifier", f"""
SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN NULL ELSE '{{"categories":"' || CASE WHEN contains(text, 'pollution')
  THEN 'Environmental' ELSE '' END || '"}}' END AS reply,
  CASE WHEN length(text) % 7 = 0 THEN 'ValueError: no answer' END AS error FROM {sql_of('articles')} AS a""")
def python_classifier(spark, sf_dir):
    def answer(texts: list[str]) -> list[str]:
        replies = []
        for text in texts:
            if len(text) % 7 == 0:
                raise ValueError("no answer")
            name = "Environmental" if "pollution" in text else ""
            replies.append('{"categories":"' + name + '"}')
        return replies

    return rules.classify(fixture(spark, sf_dir, "articles"), answer)


# ---- summaries -------------------------------------------------------------------------

SENTENCES = f"""(SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, sentence FROM (
  SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, {S.sentences('text')} AS parts FROM documents) AS d) AS s)"""
CLEAN = (
    "list_filter(string_split(lower(regexp_replace(sentence, '[^a-zA-Z]+', ' ', 'g')), ' '), "
    f"lambda w: w <> '' AND NOT list_contains({S.quoted_list(lexicons.STOP_WORDS)}, w))"
)
# Words of the conversations have a vector, chosen by a hash; other words have none.
NUMBER = {"spark": "CAST(conv(substr(md5(word), 1, 6), 16, 10) AS BIGINT)",
          "duckdb": "CAST('0x' || substr(md5(word), 1, 6) AS BIGINT)"}


def vocabulary_sql(words: str, engine: str) -> str:
    return f"""SELECT word, embedding FROM (SELECT word, {NUMBER[engine]} % (SELECT count(*) FROM embeddings) AS bucket
  FROM ({words}) AS w) AS b JOIN embeddings ON vec_id = bucket"""


def split_documents(spark, sf_dir):
    return summary.split_sentences(summary.by_document(read_table(spark, sf_dir, "documents")))


def vectors(spark, sf_dir):
    texts = read_table(spark, sf_dir, "conversations")
    text_words = texts.select(F.explode(summary.clean_words(F.col("text"))).alias("word")).distinct()
    text_words.createOrReplaceTempView("conversation_words")
    return run_sql(spark, sf_dir, vocabulary_sql("SELECT word FROM conversation_words", "spark"))


DIM = 64
VOCABULARY = vocabulary_sql(
    f"SELECT DISTINCT unnest({CLEAN}) AS word FROM (SELECT text AS sentence FROM conversations) AS c", "duckdb"
)
WORD_SUMS = f"""
vocabulary AS ({VOCABULARY}),
spelled AS (SELECT doc_id, pos, {CLEAN} AS ws FROM {SENTENCES} AS s),
dims AS (SELECT doc_id, pos, len(ws) AS n_words, unnest(range(1, {DIM + 1})) AS k FROM spelled),
placed AS (SELECT doc_id, pos, word, count(*) AS n FROM (
  SELECT doc_id, pos, unnest(ws) AS word FROM spelled) AS u GROUP BY ALL),
summed AS (SELECT doc_id, pos, k, sum(n * CAST(embedding[k] AS DOUBLE)) AS total
  FROM placed JOIN vocabulary ON vocabulary.word = placed.word, (SELECT unnest(range(1, {DIM + 1})) AS k) AS r
  GROUP BY ALL),
vectors AS (SELECT dims.doc_id, dims.pos, dims.n_words, dims.k, coalesce(total, 0) / (n_words + 0.001) AS x
  FROM dims LEFT JOIN summed ON summed.doc_id = dims.doc_id AND summed.pos = dims.pos AND summed.k = dims.k)"""


@check("sentences", f"SELECT * FROM {SENTENCES} AS s")
def document_sentences(spark, sf_dir):
    return split_documents(spark, sf_dir)


# Every text gets an opening that holds abbreviations, initials and a period after one
# that does end a sentence.
OPENING = "Dr. Smith of Acme Inc. said U.S. sales rose. J. Doe of Beta Corp. left. The rest stayed at Acme Inc. The end. "
ABBREVIATED = f"(SELECT doc_id, '{OPENING}' || text AS text FROM documents)"
TOKEN_ROWS = rf"""
tokens AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}.&’\x27-]*') AS ts FROM {ABBREVIATED} AS t),
apart AS (SELECT lower(regexp_replace(ts[i], '\.$', '')) AS word, ends_with(ts[i], '.') AS period,
  CASE WHEN i > 1 AND ends_with(ts[i - 1], '.') THEN lower(regexp_replace(ts[i - 1], '\.$', '')) END AS before
  FROM (SELECT ts, unnest(range(1, len(ts) + 1)) AS i FROM tokens) AS r),
whole AS (SELECT count(*) AS all_n, least(count(*) FILTER (period) / count(*), 0.999999) AS p FROM apart),
typed AS (SELECT word, count(*) FILTER (period) AS wp, count(*) FILTER (NOT period) AS wo, length(replace(word, '.', '')) AS letters FROM apart GROUP BY word),
scored AS (SELECT word, wp, wo, 2 * ((wp * ln(0.99::DOUBLE) + wo * ln(1 - 0.99::DOUBLE)) - (wp * ln(p) + wo * ln(1 - p)))
  * exp(-letters) * (length(word) - letters + 1) * power(letters::DOUBLE, -wo) AS score FROM typed, whole WHERE wp > 0),
known AS (SELECT word FROM scored WHERE score >= 0.3),
starts AS (SELECT word, count(*) AS s FROM apart WHERE before IS NOT NULL AND NOT regexp_matches(before, '^\p{{L}}$')
  AND before NOT IN (SELECT word FROM known) GROUP BY word),
rated AS (SELECT starts.word, s::DOUBLE AS s, (wp + wo)::DOUBLE AS n, (SELECT sum(s) FROM starts)::DOUBLE AS b, (SELECT all_n FROM whole)::DOUBLE AS t
  FROM starts JOIN typed ON typed.word = starts.word),
terms AS (SELECT word, s, n, [[s, b, n / t], [n - s, t - b, n / t], [s, b, s / b], [n - s, t - b, (n - s) / (t - b)]] AS parts, s / b > n / t AS more FROM rated),
sums AS (SELECT word, s, n, more, list_transform(parts, lambda q: CASE WHEN q[1] = 0 THEN 0 ELSE q[1] * ln(q[3]) END
  + CASE WHEN q[1] = q[2] THEN 0 ELSE (q[2] - q[1]) * ln(1 - q[3]) END) AS ls FROM terms),
openers AS (SELECT word, s, n, CASE WHEN more THEN 2 * (ls[3] + ls[4] - ls[1] - ls[2]) ELSE 0 END AS score FROM sums)"""


def abbreviated(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(OPENING), F.col("text")).alias("text"))


@check("abbreviation_scores", f"""
WITH {TOKEN_ROWS}
SELECT word, wp::BIGINT AS with_period, wo::BIGINT AS without, round(score, 6) + 0.0 AS score FROM scored""")
def abbreviation_scores(spark, sf_dir):
    counts = boundaries.token_counts(abbreviated(spark, sf_dir))
    return boundaries.abbreviation_scores(counts).withColumn("score", F.round("score", 6) + 0.0)


@check("starter_scores", f"""
WITH {TOKEN_ROWS}
SELECT word, s::BIGINT AS at_start, n::BIGINT AS n, round(score, 4) + 0.0 AS score FROM openers""")
def starter_scores(spark, sf_dir):
    learned = boundaries.learn(abbreviated(spark, sf_dir))
    counts = boundaries.token_counts(abbreviated(spark, sf_dir))
    return boundaries.starter_scores(counts, learned.abbreviations).withColumn("score", F.round("score", 4) + 0.0)


@check("learned_sentences", rf"""
WITH {TOKEN_ROWS},
marked AS (SELECT doc_id, string_split(regexp_replace({S.strip_ws('text')}, '([.!?])({S.WS})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM {ABBREVIATED} AS t),
pieces AS (SELECT doc_id, i, ps[i] AS piece, lower(regexp_extract(ps[i], '([\p{{L}}\p{{N}}][\p{{L}}\p{{N}}.&’\x27-]*?)\.$', 1)) AS last,
  regexp_extract(ps[i + 1], '^{S.WS}+[^\p{{L}}\p{{N}}\s]*(\p{{L}}[\p{{L}}\p{{N}}&’\x27-]*)', 1) AS following
  FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM marked) AS r),
ended AS (SELECT *, NOT (regexp_matches(last, '^\p{{L}}$') OR (last <> '' AND last IN (SELECT word FROM known)))
  OR (following[1] <> lower(following[1]) AND lower(following) IN (SELECT word FROM openers WHERE score >= 30)) AS ends FROM pieces),
numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM ended),
joined AS (SELECT doc_id, nth, {S.strip_ws("string_agg(piece, '' ORDER BY i)")} AS sentence FROM numbered GROUP BY doc_id, nth)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS INTEGER) AS pos, sentence FROM joined WHERE sentence <> ''""")
def learned_sentences(spark, sf_dir):
    documents = abbreviated(spark, sf_dir)
    return summary.split_sentences(spread(documents), boundaries.learn(documents))


@check("clean_sentences", f"""
SELECT doc_id, pos, array_to_string({CLEAN}, ' ') AS clean FROM {SENTENCES} AS s""")
def clean_sentences(spark, sf_dir):
    return split_documents(spark, sf_dir).select(
        "doc_id", "pos", summary.clean_sentence(F.col("sentence")).alias("clean")
    )


@check("sentence_vectors", f"""
WITH {WORD_SUMS}
SELECT doc_id, pos, CAST(n_words AS BIGINT) AS n_words, round(max(CASE WHEN k = 1 THEN x END), 6) + 0.0 AS first_x,
  round(sum(x), 5) + 0.0 AS sum_x, round(sum(x * x), 5) AS norm FROM vectors GROUP BY doc_id, pos, n_words""")
def sentence_vectors(spark, sf_dir):
    made = summary.sentence_vectors(split_documents(spark, sf_dir), vectors(spark, sf_dir), DIM)
    v = F.col("vector")
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    return made.select(
        "doc_id", "pos", "n_words",
        (F.round(v[0], 6) + 0.0).alias("first_x"),
        (F.round(total, 5) + 0.0).alias("sum_x"),
        F.round(summary.dot("vector", "vector", DIM), 5).alias("norm"),
    )


@check("sentence_similarity", f"""
WITH {WORD_SUMS},
norms AS (SELECT doc_id, pos, sqrt(sum(x * x)) AS norm FROM vectors GROUP BY doc_id, pos),
units AS (SELECT v.doc_id, v.pos, k, CASE WHEN norm > 0 THEN x / norm ELSE 0 END AS u
  FROM vectors AS v JOIN norms ON norms.doc_id = v.doc_id AND norms.pos = v.pos),
totals AS (SELECT doc_id, k, sum(u) AS t FROM units GROUP BY doc_id, k)
SELECT units.doc_id, units.pos, round(sum(u * t - u * u), 4) + 0.0 AS weight
FROM units JOIN totals ON totals.doc_id = units.doc_id AND totals.k = units.k GROUP BY units.doc_id, units.pos""")
def sentence_similarity(spark, sf_dir):
    made = summary.sentence_vectors(split_documents(spark, sf_dir), vectors(spark, sf_dir), DIM)
    weights = summary.similarity_weight(made, DIM, together=True)
    return weights.select("doc_id", "pos", (F.round("weight", 4) + 0.0).alias("weight"))


# The ranking as it is defined: a matrix of similarities, and rounds until little changes.
RANKED = f"""
{WORD_SUMS},
lists AS (SELECT doc_id, pos, list(x ORDER BY k) AS v FROM vectors GROUP BY doc_id, pos),
units AS (SELECT doc_id, pos, CASE WHEN list_dot_product(v, v) > 0 THEN list_transform(v, lambda q: q / sqrt(list_dot_product(v, v))) END AS u FROM lists),
sims AS MATERIALIZED (SELECT a.doc_id, a.pos AS i, b.pos AS j, list_dot_product(a.u, b.u) AS s
  FROM units a JOIN units b ON a.doc_id = b.doc_id AND a.pos <> b.pos WHERE a.u IS NOT NULL AND b.u IS NOT NULL),
weights AS (SELECT doc_id, i, sum(s) AS w FROM sims GROUP BY doc_id, i),
shares AS MATERIALIZED (SELECT sims.doc_id, sims.i, j, s / w AS p FROM sims JOIN weights ON weights.doc_id = sims.doc_id AND weights.i = sims.i WHERE abs(w) > 1e-9),
loose AS MATERIALIZED (SELECT units.doc_id, pos, count(*) OVER (PARTITION BY units.doc_id) AS n, abs(coalesce(w, 0)) <= 1e-9 AS alone
  FROM units LEFT JOIN weights ON weights.doc_id = units.doc_id AND weights.i = units.pos),
rounds AS (
  SELECT 0 AS round, doc_id, pos, 1.0::DOUBLE / n AS x, 1e9::DOUBLE AS change, n, alone FROM loose
  UNION ALL
  SELECT round + 1, doc_id, pos, y, sum(abs(y - x)) OVER (PARTITION BY doc_id), n, alone FROM (
    SELECT r.round, r.doc_id, r.pos, r.x, r.n, r.alone, 0.85 * (coalesce(g.got, 0) + lone / r.n) + 0.15 / r.n AS y
    FROM (SELECT *, sum(CASE WHEN alone THEN x ELSE 0 END) OVER (PARTITION BY doc_id) AS lone FROM rounds WHERE change >= n * 1e-6 AND round < 100) AS r
    LEFT JOIN (SELECT f.doc_id, shares.j, sum(f.x * shares.p) AS got FROM rounds AS f JOIN shares ON shares.doc_id = f.doc_id AND shares.i = f.pos
      WHERE f.change >= f.n * 1e-6 AND f.round < 100 GROUP BY f.doc_id, shares.j) AS g ON g.doc_id = r.doc_id AND g.j = r.pos) AS step),
ranked AS (SELECT doc_id, pos, round(CASE WHEN change < n * 1e-6 THEN x ELSE 1 / n END, 12) AS score FROM rounds QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY round DESC) = 1)"""


@check("sentence_rank", f"""
WITH RECURSIVE {RANKED}
SELECT doc_id, pos, round(score, 6) + 0.0 AS score FROM ranked""")
def sentence_rank(spark, sf_dir):
    made = summary.sentence_vectors(split_documents(spark, sf_dir), vectors(spark, sf_dir), DIM)
    return summary.sentence_rank(made, together=True).select("doc_id", "pos", (F.round("score", 6) + 0.0).alias("score"))


POSITIVE = f"vocabulary AS (SELECT word, list_transform(embedding, lambda q: abs(q)) AS embedding FROM ({VOCABULARY}) AS own)"


@check("sentence_rank_positive", f"""
WITH RECURSIVE {RANKED.replace(f"vocabulary AS ({VOCABULARY})", POSITIVE)}
SELECT doc_id, pos, round(score, 6) + 0.0 AS score FROM ranked""")
def sentence_rank_positive(spark, sf_dir):
    known = vectors(spark, sf_dir).withColumn("embedding", F.transform("embedding", F.abs))
    made = summary.sentence_vectors(split_documents(spark, sf_dir), known, DIM)
    return summary.sentence_rank(made, together=True).select("doc_id", "pos", (F.round("score", 6) + 0.0).alias("score"))


@check("sentence_rank_solved")
def sentence_rank_solved(spark, sf_dir):
    made = summary.sentence_vectors(split_documents(spark, sf_dir), vectors(spark, sf_dir), DIM)
    return summary.sentence_rank(made, "solve", together=True).select("doc_id", "pos", F.round("score", 6).alias("score"))


@check("article_summary", f"""
WITH RECURSIVE {RANKED},
best AS (SELECT ranked.doc_id, sentence, row_number() OVER (PARTITION BY ranked.doc_id ORDER BY score DESC, sentence DESC, ranked.pos DESC) AS place
  FROM ranked JOIN {SENTENCES} AS t ON t.doc_id = ranked.doc_id AND t.pos = ranked.pos)
SELECT doc_id, string_agg(' ' || sentence, '' ORDER BY place) AS summary FROM best WHERE place <= 5 GROUP BY doc_id""")
def article_summary(spark, sf_dir):
    return summary.summarize(read_table(spark, sf_dir, "documents"), vectors(spark, sf_dir), DIM)


LENGTH_SCORED = f"(SELECT doc_id, pos, sentence, CAST(len({CLEAN}) AS DOUBLE) AS score FROM {SENTENCES} AS s)"


def length_scored(spark, sf_dir):
    words = F.size(summary.clean_words(F.col("sentence"))).cast("double")
    return split_documents(spark, sf_dir).withColumn("score", words)


@check("top_sentences", f"""
SELECT doc_id, pos, sentence, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sentence DESC, pos DESC) AS rank
  FROM {LENGTH_SCORED} AS s) AS r WHERE rank <= 5""")
def top_sentences(spark, sf_dir):
    return summary.top_sentences(length_scored(spark, sf_dir))


@check("summary_text", f"""
SELECT doc_id, string_agg(' ' || sentence, '' ORDER BY rank) AS summary FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sentence DESC, pos DESC) AS rank
  FROM {LENGTH_SCORED} AS s) AS r WHERE rank <= 5 GROUP BY doc_id""")
def summary_text(spark, sf_dir):
    scores = length_scored(spark, sf_dir).select("doc_id", "pos", "score")
    return summary.summaries(split_documents(spark, sf_dir), scores)


# ---- datamart --------------------------------------------------------------------------

STORED = 1000  # detail ids in use before the load


@check("detail_ids", f"""
SELECT doc_id, category, country, {STORED} + row_number() OVER (ORDER BY doc_id) AS id FROM {sql_of('records')} AS r""")
def detail_ids(spark, sf_dir):
    return with_ids(fixture(spark, sf_dir, "records"), ["doc_id"], STORED)


CREATED = f"""
SELECT (SELECT max(id) FROM {sql_of('countries')} AS c) + row_number() OVER (ORDER BY first_seq) AS id,
  {S.title_case('country')} AS country FROM ({NEW_COUNTRIES}) AS n"""


@check("created_countries", CREATED)
def created_countries(spark, sf_dir):
    return D.get_or_create_countries(
        fixture(spark, sf_dir, "records"), fixture(spark, sf_dir, "countries"), "doc_id"
    )


def mart_records(spark, sf_dir):
    """Records with the category as it is stored, in JSON."""
    rows = fixture(spark, sf_dir, "records")
    return rows.withColumn("Category", R.json_string(F.col("category")))


def mart_load(spark, sf_dir):
    return D.build_load(
        mart_records(spark, sf_dir), fixture(spark, sf_dir, "countries"), ["doc_id"], STORED
    )


NUMBERED = f"(SELECT *, {STORED} + row_number() OVER (ORDER BY doc_id) AS id FROM {sql_of('records')} AS r)"
THEMES_SQL = f"""
SELECT id AS incident_id, {S.theme_id('category')} AS theme_id FROM {NUMBERED} AS n
WHERE {S.theme_id('category')} IS NOT NULL"""
COUNTRIES_SQL = f"""
SELECT n.id AS incident_id, e.id AS country_id FROM {NUMBERED} AS n JOIN (
  SELECT id, country FROM {sql_of('countries')} AS c UNION ALL {CREATED}) AS e ON lower(e.country) = lower(n.country)"""


@check("incident_themes", THEMES_SQL)
def incident_themes(spark, sf_dir):
    return mart_load(spark, sf_dir).incident_themes


@check("incident_countries", COUNTRIES_SQL)
def incident_countries(spark, sf_dir):
    return mart_load(spark, sf_dir).incident_countries


@check("datamart_load", f"""
SELECT 'details' AS table_name, id, CAST(doc_id AS VARCHAR) AS value FROM {NUMBERED} AS n
UNION ALL SELECT 'countries', id, country FROM ({CREATED}) AS c
UNION ALL SELECT 'themes', incident_id, CAST(theme_id AS VARCHAR) FROM ({THEMES_SQL}) AS t
UNION ALL SELECT 'incident countries', incident_id, CAST(country_id AS VARCHAR) FROM ({COUNTRIES_SQL}) AS i""")
def datamart_load(spark, sf_dir):
    load = mart_load(spark, sf_dir)

    def rows(name, table, id_column, value):
        return table.select(
            F.lit(name).alias("table_name"), F.col(id_column).alias("id"), F.col(value).cast("string").alias("value")
        )

    return (
        rows("details", load.details, "id", "doc_id")
        .unionByName(rows("countries", load.countries, "id", "country"))
        .unionByName(rows("themes", load.incident_themes, "incident_id", "theme_id"))
        .unionByName(rows("incident countries", load.incident_countries, "incident_id", "country_id"))
    )


@check("exported_csv", f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, category, nullif(country, '') AS country FROM {sql_of('records')} AS r""")
def exported_csv(spark, sf_dir):
    path = scratch_path(spark, "export")
    exports.export_csv(fixture(spark, sf_dir, "records"), path)
    back = spark.read.options(**exports.CSV).csv(path)
    return back.withColumn("country", F.nullif("country", F.lit("")))


@check("exported_links", f"""
SELECT company_name AS company, CAST(pos AS VARCHAR) AS pos, link FROM {sql_of('requests')} AS r
JOIN {sql_of('links')} AS l ON l.request_id = r.request_id""")
def exported_links(spark, sf_dir):
    path = scratch_path(spark, "links")
    joined = fixture(spark, sf_dir, "requests").join(fixture(spark, sf_dir, "links"), "request_id")
    exports.export_links_by_company(joined.select("company_name", "pos", "link"), path)
    return exports.read_links_by_company(spark, path, "company_name, pos, link").select("company", "pos", "link")


# ---- jobs ------------------------------------------------------------------------------

KEPT_COUNTS = "(SELECT request_id, count(*) AS n FROM ({}) AS k GROUP BY request_id)"


def status_sql(requests_sql: str, sources: str, kept: str, refusals: str, texts, columns: str) -> str:
    none_found, done, failed = (lexicons.quoted(t) for t in texts)
    return f"""
SELECT {columns}, CASE {refusals} WHEN s.request_id IS NULL THEN {none_found} WHEN n > 0 THEN {done}
  ELSE {failed} END AS status
FROM {requests_sql} AS r LEFT JOIN (SELECT DISTINCT request_id FROM {sources} AS l) AS s ON s.request_id = r.request_id
LEFT JOIN {KEPT_COUNTS.format(kept)} AS k ON k.request_id = r.request_id"""


UNKNOWN = f"WHEN coalesce(company_id, '-') NOT IN {COMPANY_IDS} THEN"
NOT_FOUND = "'Company ID ' || company_id || ' not found'"
MISSING_WEB = f"WHEN NOT ({VALID}) THEN '{jobs.WEB_FIELDS_MISSING}'"
REQUEST_COLUMNS = "r.request_id, company_id, company_name, search_query"
BULK_TEXTS = (jobs.NO_SOURCE, jobs.BULK_DONE, jobs.BULK_FAILED)


@check("monitor_single", status_sql(
    sql_of("requests"), sql_of("links"), KEPT_LINKS,
    f"{MISSING_WEB} {UNKNOWN} '{jobs.ID_NOT_FOUND}'",
    (jobs.NO_SOURCE, jobs.SINGLE_DONE, jobs.SINGLE_FAILED), REQUEST_COLUMNS))
def monitor_single(spark, sf_dir):
    return jobs.monitor_single(
        fixture(spark, sf_dir, "requests"), *web_inputs(spark, sf_dir), by_page_reply(spark, sf_dir)
    ).statuses


@check("monitor_bulk", status_sql(
    sql_of("requests"), sql_of("links"), KEPT_LINKS, f"{MISSING_WEB} {UNKNOWN} {NOT_FOUND}",
    BULK_TEXTS, REQUEST_COLUMNS))
def monitor_bulk(spark, sf_dir):
    return jobs.monitor_bulk(
        fixture(spark, sf_dir, "requests"), *web_inputs(spark, sf_dir), by_page_reply(spark, sf_dir)
    ).statuses


COMPLETE = f"""(SELECT request_id, company_name, coalesce(nullif(search_query, ''), 'Drought') AS search_query,
  CASE WHEN company_id IS NULL OR company_id NOT IN {COMPANY_IDS} THEN '2' ELSE company_id END AS company_id
  FROM {sql_of('requests')} AS q)"""


def complete_requests(spark, sf_dir):
    """Every request with its gaps filled, as a job that fails on bad rows wants them."""
    known = C.flag_known(fixture(spark, sf_dir, "requests"), fixture(spark, sf_dir, "companies"))
    return known.select(
        "request_id",
        "company_name",
        F.coalesce(F.nullif("search_query", F.lit("")), F.lit("Drought")).alias("search_query"),
        F.when(F.col("is_known"), F.col("company_id")).otherwise("2").alias("company_id"),
    )


@check("monitor_bulk_strict", status_sql(
    COMPLETE, sql_of("links"), KEPT_LINKS, "WHEN false THEN ''", BULK_TEXTS, REQUEST_COLUMNS))
def monitor_bulk_strict(spark, sf_dir):
    return jobs.monitor_bulk(
        complete_requests(spark, sf_dir), *web_inputs(spark, sf_dir), by_page_reply(spark, sf_dir), mode="fail"
    ).statuses


FANNED = f"(SELECT company_id || ':' || pos AS request_id, company_id, company_name, search_query FROM ({FAN_OUT}) AS f)"
# The links of a fixture request serve the keyword of the same number.
KEYWORD_LINKS = f"(SELECT * REPLACE ((request_id // 10 + 1) || ':' || request_id % 10 AS request_id) FROM {sql_of('links')} AS l)"


@check("monitor_keywords", status_sql(
    FANNED, KEYWORD_LINKS, KEPT_LINKS.replace(sql_of("links"), KEYWORD_LINKS),
    "WHEN false THEN ''", BULK_TEXTS, 'r.request_id, company_id, company_name, search_query AS "Keyword"'))
def monitor_keywords(spark, sf_dir):
    companies, links, stored = web_inputs(spark, sf_dir)
    number = F.concat_ws(":", F.floor(F.col("request_id") / 10) + 1, F.col("request_id") % 10)
    return jobs.monitor_keywords(
        companies, lexicons.keyword_table(spark), companies, links.withColumn("request_id", number), stored,
        by_page_reply(spark, sf_dir),
    ).statuses


API_SOURCES = f"({NEWS_ARTICLES})"
API_REPLIES = f"(SELECT link, {S.safe('reply')} AS js FROM {sql_of('news_replies')} AS p)"
API_KEPT = f"""
SELECT a.*, url AS link, js FROM {API_SOURCES} AS a JOIN {API_REPLIES} AS p ON p.link = a.url WHERE {S.gate('js', 'api')}"""


def by_news_reply(spark, sf_dir):
    return jobs.precomputed(fixture(spark, sf_dir, "news_replies"))


def numbered_envelopes(spark, sf_dir):
    return envelopes(spark, sf_dir).drop("doc_id")


@check("monitor_news_api", status_sql(
    sql_of("requests"), API_SOURCES, API_KEPT,
    f"WHEN coalesce(search_query, '') = '' THEN '{jobs.API_FIELDS_MISSING}' "
    f"WHEN coalesce(company_id, '') = '' THEN '{jobs.API_ID_MISSING}' {UNKNOWN} '{jobs.ID_NOT_FOUND}'",
    (jobs.API_NONE_FOUND, jobs.SINGLE_DONE, jobs.API_NONE_KEPT), REQUEST_COLUMNS))
def monitor_news_api(spark, sf_dir):
    return jobs.monitor_news_api(
        fixture(spark, sf_dir, "requests"), fixture(spark, sf_dir, "companies"),
        numbered_envelopes(spark, sf_dir), by_news_reply(spark, sf_dir),
    ).statuses


FILLED = f"""(SELECT request_id, company_name, coalesce(nullif(search_query, ''), 'Drought') AS search_query,
  coalesce(company_id, 'none') AS company_id FROM {sql_of('requests')} AS q)"""


@check("monitor_news_api_bulk", status_sql(
    FILLED, API_SOURCES, API_KEPT, f"{UNKNOWN} '{jobs.ID_NOT_FOUND}'",
    (jobs.API_BULK_NONE_FOUND, jobs.SINGLE_DONE, jobs.API_BULK_NONE_KEPT), REQUEST_COLUMNS))
def monitor_news_api_bulk(spark, sf_dir):
    asked = fixture(spark, sf_dir, "requests").select(
        "request_id",
        "company_name",
        F.coalesce(F.nullif("search_query", F.lit("")), F.lit("Drought")).alias("search_query"),
        F.coalesce("company_id", F.lit("none")).alias("company_id"),
    )
    return jobs.monitor_news_api_bulk(
        asked, fixture(spark, sf_dir, "companies"), numbered_envelopes(spark, sf_dir), by_news_reply(spark, sf_dir)
    ).statuses


@check("news_api_records", record_sql(
    f"""(SELECT k.*, company_id, search_query FROM ({API_KEPT}) AS k JOIN {sql_of('requests')} AS r
  ON r.request_id = k.request_id WHERE {VALID} AND company_id IN {COMPANY_IDS}) AS w""",
    "NewsAPI", '"publishedAt"', "request_id, pos"))
def news_api_records(spark, sf_dir):
    return jobs.monitor_news_api(
        fixture(spark, sf_dir, "requests"), fixture(spark, sf_dir, "companies"),
        numbered_envelopes(spark, sf_dir), by_news_reply(spark, sf_dir), proc_ts=proc_ts(),
    ).records


TAGGED_KEPT = f"""
SELECT request_id, pos, l.link FROM {sql_of('links')} AS l JOIN (
  SELECT url AS link, {S.fold(S.collapse_ws(S.strip_urls(S.html_text('html'))))} AS f FROM {sql_of('esg_pages')} AS e
) AS p ON p.link = l.link WHERE pos <= 9 AND NOT {IS_PDF.replace("link", "l.link", 1)} AND {CATEGORY} <> ''"""


@check("monitor_single_tagged", status_sql(
    sql_of("requests"), sql_of("links"), TAGGED_KEPT,
    f"{MISSING_WEB} {UNKNOWN} '{jobs.ID_NOT_FOUND}'",
    (jobs.NO_SOURCE, jobs.SINGLE_DONE, jobs.SINGLE_FAILED), REQUEST_COLUMNS))
def monitor_single_tagged(spark, sf_dir):
    """The web path with the rules in place of stored replies."""
    companies, links, _ = web_inputs(spark, sf_dir)
    stored = fixture(spark, sf_dir, "esg_pages").select(F.col("url").alias("link"), "html")
    classifier = jobs.tagged(lexicons.keyword_table(spark), fixture(spark, sf_dir, "countries"))
    return jobs.monitor_single(
        fixture(spark, sf_dir, "requests"), companies, links, stored, classifier
    ).statuses
