"""Test inputs, derived without randomness from the driver's tables.

Each text is SQL that Spark and DuckDB read alike, so one definition feeds both a
query and its oracle. Whole tables are used: no row is filtered away or cut short.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from newsward.lexicons import keyword_values
from newsward.session import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
# Tables of long texts; a small file of them is spread over all cores first.
TEXT_TABLES = {"documents", "pages", "conversations"}

KIND = (
    "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 "
    "WHEN 'signup' THEN 3 ELSE 4 END"
)


def reply_case(key: str) -> str:
    return f"""CASE {key} % 12
  WHEN 0 THEN '{{"categories":"Environmental","sentiment":"Positive","incidents":"No incidents found","themes":["Renewable Energy","Sustainable Supply Chain"],"summary":"s","country":"United States","date":"2021-03-23"}}'
  WHEN 1 THEN '{{"categories":"Social","themes":["Labor"],"country":"india","date":"23/03/2021"}}'
  WHEN 2 THEN '{{"categories":"Governance","themes":[],"country":"","date":"23-09-2001"}}'
  WHEN 3 THEN '{{"categories":["Environmental","Social"],"themes":"Water","country":"cote d''ivoire"}}'
  WHEN 4 THEN '{{"categories":null,"country":"chad"}}'
  WHEN 5 THEN '{{"categories":""}}'
  WHEN 6 THEN '{{"categories":[]}}'
  WHEN 7 THEN '{{"esg_check":"No"}}'
  WHEN 8 THEN 'not json'
  WHEN 9 THEN '[1]'
  WHEN 10 THEN '{{"categories":"''Social''","country":"guinea-bissau","date":"soon"}}'
  ELSE '{{"categories":"Other","summary":"été, \"x\""}}' END""".replace('\\"', "'' q ''")


FIXTURES = {
    "lexicon": keyword_values(),
    # The company dimension; one id in ten is spelled so that no request has it.
    "companies": """
SELECT CASE WHEN c_custkey % 10 = 0 THEN 'H' || CAST(c_custkey + 1 AS STRING)
    ELSE CAST(c_custkey + 1 AS STRING) END AS company_id, c_name AS company_name,
  CASE c_custkey % 11 WHEN 0 THEN 'Retail' WHEN 1 THEN 'Automotive' WHEN 2 THEN 'Consumer Goods'
    WHEN 3 THEN 'Healthcare' WHEN 4 THEN 'Hospitality' WHEN 5 THEN 'Real Estate' WHEN 6 THEN 'Telecom'
    WHEN 7 THEN 'Transport' WHEN 8 THEN 'Metals' WHEN 9 THEN 'Aerospace' END AS industry
FROM customer""",
    "countries": """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS country FROM nation""",
    "requests": f"""
SELECT DISTINCT user_id * 10 + {KIND} AS request_id,
  CASE WHEN user_id % 17 = 3 THEN CAST(NULL AS STRING) ELSE CAST(user_id + 1 AS STRING) END AS company_id,
  'Company ' || CAST(user_id AS STRING) AS company_name,
  CASE event_type WHEN 'click' THEN 'Fraud' WHEN 'error' THEN 'Pollution' WHEN 'purchase' THEN 'Human trafficking'
    WHEN 'signup' THEN CAST(NULL AS STRING) ELSE '' END AS search_query
FROM events""",
    # Some users' links go to their neighbour, which leaves requests without any.
    "links": f"""
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY event_id) AS BIGINT) AS pos,
  url || CASE WHEN event_id % 7 = 0 THEN '.PDF' WHEN event_id % 19 = 0 THEN '#gone' ELSE '' END AS link,
  CASE WHEN event_id % 11 = 0 THEN 'Application/PDF' WHEN event_id % 13 = 0 THEN CAST(NULL AS STRING)
    ELSE 'text/html' END AS content_type
FROM (SELECT event_id, event_id % (SELECT count(*) FROM pages) AS page_no,
    (CASE WHEN user_id % 5 = 4 THEN user_id - 1 ELSE user_id END) * 10 + {KIND} AS request_id
  FROM events) AS e JOIN pages ON page_id = page_no""",
    "news": """
SELECT doc_id, (doc_id % (SELECT max(user_id) + 1 FROM events)) * 10 + doc_id % 3 AS request_id, source,
  CASE WHEN source = 'src3' THEN 'error' ELSE 'ok' END AS status,
  CAST(CASE WHEN source = 'src4' THEN 0 ELSE 100 END AS BIGINT) AS total_results,
  CASE WHEN doc_id % 23 = 5 THEN CAST(NULL AS STRING) ELSE 'Report ' || CAST(doc_id AS STRING) END AS title,
  CASE WHEN doc_id % 9 = 0 THEN CAST(NULL AS STRING) ELSE text END AS description,
  'https://news.example.org/a/' || CAST(doc_id AS STRING) AS url,
  '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || 'T00:00:00Z' AS published_at
FROM documents""",
    "replies": f"""
SELECT doc_id, {reply_case('doc_id')} AS reply FROM documents""",
    "page_replies": f"""
SELECT url AS link, {reply_case('page_id')} AS reply FROM pages""",
    "news_replies": f"""
SELECT 'https://news.example.org/a/' || CAST(doc_id AS STRING) AS link, {reply_case('doc_id')} AS reply
FROM documents""",
    "records": """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Environmental' WHEN 1 THEN 'Social' WHEN 2 THEN 'Governance'
    WHEN 3 THEN 'Other' ELSE '"Social"' END AS category,
  CASE doc_id % 7 WHEN 0 THEN 'nation_3' WHEN 1 THEN 'NATION_4' WHEN 2 THEN 'guinea-bissau' WHEN 3 THEN 'Guinea-Bissau'
    WHEN 4 THEN '' WHEN 5 THEN 'cote d''ivoire' ELSE 'land ' || CAST(doc_id % 3 AS STRING) END AS country
FROM documents""",
    "result_pages": """
SELECT page_id, CAST(floor(page_id / 5) AS BIGINT) AS request_id, CAST(page_id % 5 + 1 AS BIGINT) AS page_no,
  CASE WHEN page_id % 10 = 6 THEN '<html><body>none</body></html>' ELSE
  '<html><a href="/top">top</a><div class="algo-sr"><h3><a href="' || url || '">Result ' || CAST(page_id AS STRING)
  || '</a></h3><a href="/cached">cached</a></div><div class="ad"><a href="/ad">ad</a></div>'
  || CASE WHEN page_id % 4 = 1 THEN '<div class="algo-sr">no link</div>' ELSE '' END
  || '<div class="algo-sr"><a href="https://two.example.org/' || CAST(page_id AS STRING)
  || '"></a></div></html>' END AS html
FROM pages""",
    "tables": """
SELECT o_orderkey AS page_id, '<table><tr><th>Event Date</th><th>Report</th></tr><tr><td> '
  || CAST(CAST(o_orderdate AS DATE) AS STRING) || ' </td><td><a href=" /r/' || CAST(o_orderkey AS STRING)
  || '.pdf ">Read</a></td><td>Asia</td><td>Water</td><td>' || o_orderpriority || '</td><td>' || o_orderstatus
  || '</td></tr>' || CASE WHEN o_orderkey % 6 = 0 THEN '<tr><td>short</td></tr>' ELSE '' END || '</table>' AS html
FROM orders""",
    "nested_tables": """
SELECT o_orderkey AS page_id, '<p>no</p><table><tr><th>h</th></tr><tr><td>D' || k || '</td><td><a href="/r/' || k
  || '.pdf">R</a></td><td>L<TABLE border=0><tr><td>x</td></tr><tr><td>I' || k || '<td><a href=/i/' || k
  || '>go</a><tr><td>second</table></td><td>T</td><td>S</td></tr><tr><td>last</td></table><ul><li>a<ul><li>b</ul></ul>' AS html
FROM (SELECT o_orderkey, CAST(o_orderkey AS STRING) AS k FROM orders) AS o""",
    "esg_pages": """
SELECT url, replace(html, '</article>', CASE page_id % 4
  WHEN 0 THEN '<p>Greenhouse gas EMISSIONS and pollution rise in NATION_3.</p>'
  WHEN 1 THEN '<p>Unsafe working conditions &amp; human trafficking.</p>'
  WHEN 2 THEN '<p>Corruption scandals; fraud.</p>' ELSE '' END || '</article>') AS html
FROM pages""",
    "url_texts": """
SELECT doc_id, 'See ' || url || ' and (http://x.example.org/a,b!c)~' || chr(10) || '  ' || text
  || ' https://t.example.org/a%20b' AS text
FROM (SELECT doc_id, text, doc_id % (SELECT count(*) FROM pages) AS page_no FROM documents) AS d
  JOIN pages ON page_id = page_no""",
    "articles": """
SELECT doc_id, text || ' ' || CASE doc_id % 6
  WHEN 0 THEN 'Report on 23/03/2021: Greenhouse gas EMISSIONS and pollution rise in NATION_3.'
  WHEN 1 THEN 'Unsafe working conditions, human trafficking. Filed 23-09-2001 in nation_4.'
  WHEN 2 THEN 'Corruption scandals; Legal non-compliance; pollution.'
  WHEN 3 THEN 'Prohibition of off-label products use.'
  WHEN 4 THEN 'pollutions fraudulent'
  ELSE '' END AS text
FROM documents""",
}


def sql_of(name: str) -> str:
    """A fixture as a subquery."""
    return f"({FIXTURES[name].strip()})"


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the parquet tables of ``sf_dir``."""
    for table in TABLES:
        if re.search(rf"\b{table}\b", sql):
            read_table(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(sql)


READ: dict[tuple[str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; its schema is looked up once per session."""
    key = (spark.sparkContext.applicationId, f"{sf_dir.rstrip('/')}/{table}.parquet")
    if key not in READ:
        df = spark.read.parquet(key[1])
        READ[key] = spread(df) if table in TEXT_TABLES else df
    return READ[key]


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, FIXTURES[name])
