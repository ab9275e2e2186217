import uuid

import pytest
from pyspark.sql import functions as F

from newsward.lexicons import INDUSTRY_KEYWORDS, keyword_table
from newsward.plans import jobs
from newsward.sources import mart as M
from newsward.streaming.requests import watch_requests

REQUESTS = "request_id bigint, company_id string, company_name string, search_query string"


def world(spark):
    companies = spark.createDataFrame([("1",), ("2",), ("3",)], "company_id string")
    links = spark.createDataFrame(
        [(1, 1, "esg"), (1, 2, "plain"), (2, 1, "plain"), (2, 2, "x.pdf"), (5, 1, "esg"), (6, 1, "gone")],
        "request_id bigint, pos bigint, link string",
    )
    pages = spark.createDataFrame(
        [("esg", "<p>Fraud and pollution in Chad</p>"), ("plain", "<p>Nothing</p>"), ("x.pdf", "<p>fraud</p>")],
        "link string, html string",
    )
    replies = spark.createDataFrame(
        [("esg", '{"categories":"Social","country":"chad"}'), ("plain", '{"esg_check":"No"}'), ("x.pdf", '{"categories":"Social"}')],
        "link string, reply string",
    )
    return companies, links, pages, jobs.precomputed(replies)


def requests_of(spark):
    rows = [(1, "1", "A", "q"), (2, "2", "B", "q"), (3, "3", "C", "q"), (4, "9", "D", "q"), (5, "1", "", "q"), (6, "1", "A", "r")]
    return spark.createDataFrame(rows, REQUESTS)


def statuses(df, column="status"):
    return {r["request_id"]: r[column] for r in df.collect()}


def test_single(spark):
    result = jobs.monitor_single(requests_of(spark), *world(spark))
    assert statuses(result.statuses) == {
        1: "Company data added successfully", 2: "Error occurred during data scraping", 3: "No Source found",
        4: "Company ID not found", 5: "company_name, search_query, and company_id are required",
        6: "Error occurred during data scraping",
    }
    assert [(r["request_id"], r["link"]) for r in result.records.collect()] == [(1, "esg")]


def test_bulk_report(spark):
    result = jobs.monitor_bulk(requests_of(spark), *world(spark))
    assert statuses(result.statuses) == {
        1: "Data added successfully", 2: "Error occurred", 3: "No Source found", 4: "Company ID 9 not found",
        5: "company_name, search_query, and company_id are required", 6: "Error occurred",
    }


def test_bulk_fail(spark):
    with pytest.raises(jobs.InvalidRequests, match="CSV must contain company_name"):
        jobs.monitor_bulk(requests_of(spark).where("request_id = 5"), *world(spark), mode="fail")
    with pytest.raises(jobs.InvalidRequests, match="Company ID 9 not found"):
        jobs.monitor_bulk(requests_of(spark).where("request_id <> 5"), *world(spark), mode="fail")
    good = jobs.monitor_bulk(requests_of(spark).where("request_id < 4"), *world(spark), mode="fail")
    assert good.statuses.count() == 3


def test_run_loads_and_reports(spark, tmp_path):
    mart = M.ParquetMart(spark, str(tmp_path / "mart"))
    done = jobs.monitor_bulk(requests_of(spark), *world(spark)).run(mart, "one")
    assert statuses(done)[1] == "Data added successfully"
    assert [(r["id"], r["link"], r["country"]) for r in mart.read(M.DETAILS).collect()] == [(1, "esg", "chad")]
    assert [tuple(r) for r in mart.read(M.COUNTRIES).collect()] == [(1, "Chad")]


def test_keywords(spark):
    companies, links, pages, classifier = world(spark)
    asked = spark.createDataFrame(
        [("1", "A", "Metals"), ("9", "D", "Retail")], "company_id string, company_name string, industry string"
    )
    links = links.withColumn("request_id", F.concat(F.lit("1:"), F.col("request_id")))
    result = jobs.monitor_keywords(asked, keyword_table(spark), companies, links, pages, classifier)
    rows = result.statuses.collect()
    assert len(rows) == len(INDUSTRY_KEYWORDS["Metals"]) + len(INDUSTRY_KEYWORDS["Retail"])
    done = [(r["request_id"], r["Keyword"]) for r in rows if r["status"] == "Data added successfully"]
    assert sorted(done) == [("1:1", "Decreased Water Levels"), ("1:5", "Aquatic Ecosystem Disturbances")]
    assert {r["status"] for r in rows if r["company_id"] == "9"} == {"Company ID 9 not found"}


def envelopes(spark):
    article = "named_struct('source', named_struct('id', CAST(NULL AS STRING), 'name', 'S'), 'author', 'a', 'title', 't', 'description', {}, 'url', '{}', 'publishedAt', '2024-01-01')"
    rows = [(1, "ok", 2, f"array({article.format('NULL', 'esg')}, {article.format(chr(39) + 'd' + chr(39), 'plain')})"),
            (2, "ok", 1, f"array({article.format('NULL', 'plain')})"), (3, "error", 1, f"array({article.format('NULL', 'esg')})")]
    sql = " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS request_id, '{s}' AS status, CAST({n} AS BIGINT) AS totalResults, {a} AS articles" for i, s, n, a in rows
    )
    return spark.sql(sql)


def test_news_api(spark):
    companies, _, _, classifier = world(spark)
    result = jobs.monitor_news_api(requests_of(spark), companies, envelopes(spark), classifier)
    assert statuses(result.statuses) == {
        1: "Company data added successfully", 2: "No valid data to add after processing",
        3: "No news articles found from the News API", 4: "Company ID not found",
        5: "company_name and search_query are required", 6: "No news articles found from the News API",
    }
    record = result.records.first()
    assert (record["data_provider"], record["Published_dt"], record["link"]) == ("NewsAPI", "2024-01-01", "esg")


def test_news_api_bulk(spark, tmp_path):
    companies, _, _, classifier = world(spark)
    whole = requests_of(spark).where("request_id <> 5")
    result = jobs.monitor_news_api_bulk(whole, companies, envelopes(spark), classifier)
    assert statuses(result.statuses) == {
        1: "Company data added successfully", 2: "No news passed the ESG check",
        3: "No news found for the specified search query", 4: "Company ID not found",
        6: "No news found for the specified search query",
    }
    with pytest.raises(jobs.InvalidRequests, match="CSV must contain company_id"):
        jobs.monitor_news_api_bulk(requests_of(spark), companies, envelopes(spark), classifier)
    mart = M.ParquetMart(spark, str(tmp_path / "mart"))
    result.run(mart, "api")
    assert mart.read(M.DETAILS).count() == 1 and mart.read(M.COUNTRIES).count() == 0


def test_missing_keys(spark):
    good = '{"company_id":null,"company_name":"a","keyword":"k"}'
    jobs.refuse_missing_keys(spark.createDataFrame([(good,)], "request string"))
    with pytest.raises(jobs.InvalidRequests, match="Each dictionary must contain"):
        jobs.refuse_missing_keys(spark.createDataFrame([(good,), ('{"company_id":1}',)], "request string"))


def test_rules_as_classifier(spark):
    companies, links, pages, _ = world(spark)
    countries = spark.createDataFrame([(1, "Chad")], "id bigint, country string")
    classifier = jobs.tagged(keyword_table(spark), countries)
    result = jobs.monitor_single(requests_of(spark), companies, links, pages, classifier)
    record = result.records.first()
    assert (record["link"], record["Category"], record["country"]) == ("esg", '"Environmental"', "Chad")
    assert record["Themes"] == '["fraud", "pollution"]'


def test_a_hot_link_and_request_change_nothing(spark):
    """A third of all links belong to one request, another third point to one page."""
    companies, _, pages, classifier = world(spark)
    rows = [(1, p, f"u{p}") for p in range(1, 301)] + [(r, 1, "esg") for r in range(2, 302)] + [(r, 2, f"v{r}") for r in range(2, 302)]
    links = spark.createDataFrame(rows, "request_id bigint, pos bigint, link string")
    asked = spark.range(1, 302).select(
        F.col("id").alias("request_id"), F.lit("1").alias("company_id"), F.lit("A").alias("company_name"), F.lit("q").alias("search_query")
    )
    result = jobs.monitor_bulk(asked, companies, links, pages, classifier)
    got = statuses(result.statuses)
    assert got.pop(1) == "Error occurred"
    assert set(got.values()) == {"Data added successfully"} and len(got) == 300
    assert result.records.count() == 300


def test_streaming(spark, tmp_path):
    companies, links, pages, classifier = world(spark)
    links = links.withColumn("request_id", F.col("request_id").cast("string"))
    mart = M.ParquetMart(spark, str(tmp_path / "mart"))
    inbox = tmp_path / "inbox"
    name = f"watch-{uuid.uuid4().hex}"

    def job(batch):
        return jobs.monitor_bulk(batch, companies, links, pages, classifier)

    def run():
        query = watch_requests(spark, str(inbox), job, mart, str(tmp_path / "status"), name)
        query.awaitTermination(120)
        assert query.exception() is None

    for number in (1, 5):
        row = '{"request_id":"%d","company_id":"1","company_name":"A","search_query":"q"}' % number
        inbox.mkdir(exist_ok=True)
        (inbox / f"{number}.json").write_text(row)
        run()
    run()
    assert sorted(r["id"] for r in mart.read(M.DETAILS).collect()) == [1, 2]
    assert spark.read.json(str(tmp_path / "status")).where("status = 'Data added successfully'").count() == 2


def test_each_article_is_classified_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def classifier(articles):
        def count(batches):
            for batch in batches:
                seen.add(len(batch))
                batch["reply"] = '{"categories":"Social","country":"chad"}'
                yield batch

        kept = articles.drop("text")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in articles.schema.fields)
        return articles.mapInPandas(count, f"{fields}, reply string").select(*kept.columns, "reply")

    companies = world(spark)[0]
    asked = spark.range(1, 4).select(
        F.col("id").alias("request_id"), F.col("id").cast("string").alias("company_id"), F.lit("A").alias("company_name"), F.lit("q").alias("search_query")
    )
    article = "named_struct('source', named_struct('id', null, 'name', 'n'), 'author', '', 'title', 't', 'description', 'd', 'url', 'u', 'publishedAt', '2024-01-02')"
    envelopes = asked.selectExpr("request_id", "'ok' AS status", "2L AS totalResults", f"array({article}, {article}) AS articles")
    job = jobs.monitor_news_api(asked, companies, envelopes, classifier)
    done = job.run(M.ParquetMart(spark, str(tmp_path / "mart")), "one")
    assert set(statuses(done).values()) == {jobs.SINGLE_DONE}
    assert seen.value == 6


def test_first_bad_row_is_named(spark):
    rows = [(k, str(90 + k), "A", "q") for k in (3, 1, 2)]
    asked = spark.createDataFrame(rows, REQUESTS)
    with pytest.raises(jobs.InvalidRequests, match="Company ID 91 not found"):
        jobs.monitor_bulk(asked, *world(spark), mode="fail")
    with pytest.raises(jobs.InvalidRequests, match="Company ID 93 not found"):
        jobs.monitor_bulk(asked.withColumn("row_no", -F.col("request_id")), *world(spark), mode="fail")


def test_rule_tags_with_summary(spark):
    words = spark.createDataFrame([("fraud", [1.0, 0.5]), ("pollution", [0.5, 1.0])], "word string, embedding array<double>")
    articles = spark.createDataFrame([("a", "Fraud in Chad. Pollution in Chad."), ("b", None)], "link string, text string")
    countries = spark.createDataFrame([("Chad",)], "country string")
    classify = jobs.tagged(keyword_table(spark), countries, words, 2)
    replies = {r["link"]: r["reply"] for r in classify(articles).collect()}
    assert "Fraud in Chad." in replies["a"]


def test_keyword_job_looks_companies_up_before_the_fan_out(spark, monkeypatch):
    asked = spark.createDataFrame([("1", "A", "Metals")], "company_id string, company_name string, industry string")
    seen = []

    def spy(rows, companies):
        seen.append(rows.columns)
        raise KeyError

    monkeypatch.setattr(jobs, "flag_known", spy)
    with pytest.raises(KeyError):
        jobs.monitor_keywords(asked, keyword_table(spark), asked, None, None, None)
    assert seen == [asked.columns]
