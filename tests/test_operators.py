import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from newsward.lexicons import INDUSTRY_KEYWORDS, keyword_table
from newsward.operators import companies as C
from newsward.operators import filters as P
from newsward.operators import links as L
from newsward.operators import skew
from newsward.operators.ids import with_ids


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def uneven(spark, rows=6000):
    """A third of all rows share one key."""
    return spark.range(rows).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key")
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_a_plain_join(spark, how):
    left = uneven(spark).union(spark.createDataFrame([(-1, None)], "row bigint, key string"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("other", 4)], "key string, v int")
    got = skew.skew_join(left, right, "key", how, ["row"], min_rows=1000, salts=8)
    wanted = left.join(right, "key", how)
    assert sorted(map(repr, got.select(*wanted.columns).collect())) == sorted(map(repr, wanted.collect()))


def test_skew_join_spreads_the_hot_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = uneven(spark)
        right = left.select("key").distinct().withColumn("v", F.lit(1))
        joined = skew.skew_join(left, right, "key", "inner", ["row"], min_rows=1000, salts=32)
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert joined.count() == 6000
        assert max(r["count"] for r in sizes) < 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_checked_broadcast(spark):
    df = spark.range(100)
    join = spark.range(1000).join
    assert "BroadcastHashJoin" in plan_of(join(skew.checked_broadcast(df, 100), "id"))
    assert skew.checked_broadcast(df, skew.BROADCAST_BYTES) is df


@pytest.mark.parametrize("partitions", [1, 7])
def test_ids_are_dense_and_ordered(spark, partitions):
    df = spark.range(1000).select((999 - F.col("id")).alias("k"), (F.col("id") % 3).alias("g")).repartition(partitions)
    rows = with_ids(df, ["g", "k"], 50).collect()
    ordered = sorted(rows, key=lambda r: r["id"])
    assert [r["id"] for r in ordered] == list(range(51, 1051))
    keys = [(r["g"], r["k"]) for r in ordered]
    assert keys == sorted(keys)


def test_ids_have_no_single_task_sort(spark):
    text = plan_of(with_ids(spark.range(1000), ["id"]))
    # The only single partition is the offsets table, one row per partition.
    assert text.count("SinglePartition") <= 1


def companies_and_requests(spark):
    dim = spark.createDataFrame([("1", "Retail"), (" 2", "Mining"), ("3", None)], "company_id string, industry string")
    asked = spark.createDataFrame([("1",), ("2 ",), ("4",), (None,)], "company_id string")
    return dim, asked


def test_known_and_unknown_companies_split_the_requests(spark):
    dim, asked = companies_and_requests(spark)
    assert {r[0] for r in C.known_companies(asked, dim).collect()} == {"1", "2 "}
    assert {r[0] for r in C.unknown_companies(asked, dim).collect()} == {"4", None}
    flags = {r["company_id"]: r["is_known"] for r in C.flag_known(asked, dim).collect()}
    assert flags == {"1": True, "2 ": True, "4": False, None: False}
    twice = dim.union(dim)
    assert C.flag_known(asked, twice).count() == 4


def test_keyword_fan_out(spark):
    dim, _ = companies_and_requests(spark)
    rows = C.fan_out_keywords(dim, keyword_table(spark)).collect()
    by_company = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        by_company.setdefault(r["company_id"], []).append(r["search_query"])
    assert by_company == {
        "1": INDUSTRY_KEYWORDS["Retail"], " 2": INDUSTRY_KEYWORDS["default"], "3": INDUSTRY_KEYWORDS["default"],
    }
    with pytest.raises(PySparkException, match="no keyword list for industry"):
        C.fan_out_keywords(dim, keyword_table(spark), on_unknown="fail").collect()


def links_of(spark, counts):
    rows = [(r, p, f"u{r}-{p}") for r, n in counts.items() for p in range(1, n + 1)]
    return spark.createDataFrame(rows, "request_id bigint, pos bigint, link string")


def test_cap(spark):
    capped = L.cap_links(links_of(spark, {1: 9, 2: 10, 3: 3, 4: 30}))
    counts = {r["request_id"]: (r["n"], r["last"]) for r in capped.groupBy("request_id").agg(
        F.count("*").alias("n"), F.max("pos").alias("last")).collect()}
    assert counts == {1: (9, 9), 2: (9, 9), 3: (3, 3), 4: (9, 9)}
    assert L.first_n(links_of(spark, {4: 30}), 20).count() == 20


def test_cap_prunes_before_the_shuffle(spark):
    plan = plan_of(L.cap_links(links_of(spark, {1: 30}).repartition(3)))
    assert plan.count("WindowGroupLimit") == 2


def test_pdf_rules(spark):
    rows = [("a.PDF", None), ("a", "Application/PDF"), ("a", None), ("a.pdf?x", "text/html"), ("b", "")]
    df = spark.createDataFrame(rows, "link string, content_type string")
    assert [r[0] for r in df.select(P.is_pdf(F.col("link"), F.col("content_type"))).collect()] == [True, True, False, False, False]
    assert P.drop_pdf(df).count() == 3
    assert P.drop_pdf(df.select("link")).count() == 4


def test_required_fields(spark):
    df = spark.createDataFrame([("1", "a"), ("0", "a"), ("", "a"), (None, "a"), ("1", None)], "x string, y string")
    assert P.required_fields(df, ["x", "y"]).count() == 2
    assert P.missing_fields(df, ["x", "y"]).count() == 3


def test_text_is_made_once_per_link(spark):
    links = spark.createDataFrame([(1, 1, "u"), (2, 1, "u"), (2, 2, "gone")], "request_id bigint, pos bigint, link string")
    pages = spark.createDataFrame([("u", "<p>see https://x.org now</p>"), ("v", "<p>b</p>"), ("gone", "")], "link string, html string")
    assert [tuple(r) for r in L.article_text(links, pages).collect()] == [("u", "see now")]
    assert L.links_with_text(links, pages).count() == 2


def test_large_dimensions_take_the_salted_way(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    dim, asked = companies_and_requests(spark)
    flags = {r["company_id"]: r["is_known"] for r in C.flag_known(asked, dim).collect()}
    assert flags == {"1": True, "2 ": True, "4": False, None: False}
    assert {r[0] for r in C.unknown_companies(asked, dim).collect()} == {"4", None}
    fanned = C.fan_out_keywords(dim, keyword_table(spark))
    assert fanned.count() == len(INDUSTRY_KEYWORDS["Retail"]) + 2 * len(INDUSTRY_KEYWORDS["default"])


def test_requests_without_links_stay(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "request_id bigint, company_name string")
    joined = L.requests_with_links(asked, links_of(spark, {1: 40, 3: 1}))
    assert joined.columns == ["request_id", "company_name", "pos", "link"]
    counts = {r["request_id"]: r["count"] for r in joined.groupBy("request_id").count().collect()}
    assert counts == {1: 40, 2: 1, 3: 1}
    assert joined.where("request_id = 2").first()["link"] is None


def test_replies_of_a_hot_link(spark):
    articles = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("link"))
    replies = spark.createDataFrame([("hot", "{}"), ("1", "x")], "link string, reply string")
    both = [L.with_replies(articles, replies, "link", salt) for salt in (None, ["id"])]
    first, second = (sorted(map(repr, df.select("id", "link", "reply").collect())) for df in both)
    assert first == second and len(first) == 300


def test_pages_stored_again_count_once(spark):
    from newsward.operators import links as L

    links = spark.createDataFrame([("r", "u", 1)], "request_id string, link string, pos int")
    pages = spark.createDataFrame([("u", "<p>b</p>"), ("u", "<p>a</p>"), ("u", "")], "link string, html string")
    assert [r["text"] for r in L.links_with_text(links, pages).collect()] == ["a"]
    replies = spark.createDataFrame([("u", "2"), ("u", "1")], "link string, reply string")
    assert [r["reply"] for r in L.with_replies(links, replies, "link").collect()] == ["1"]


def test_html_of_pages_never_moves(spark):
    import re

    links = spark.range(50).select("id", F.concat(F.lit("u"), "id").alias("link"))
    pages = spark.range(400).select(F.concat(F.lit("u"), "id").alias("link"), F.concat(F.lit("<p>a"), "id", F.lit("</p>")).alias("html"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = L.article_text(links, pages)
        plan = texts._jdf.queryExecution().explainString(texts.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = re.findall(r"(?:Exchange|Sort)\nInput \[\d+\]: \[([^\]]*)\]", plan)
        assert moved and not any("html" in columns for columns in moved)
        assert {r["link"]: r["text"] for r in texts.collect()} == {f"u{k}": f"a{k}" for k in range(50)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_keys_take_all_wanted_and_few_others(spark):
    keys = spark.createDataFrame([("a",), ("b",), (None,)], "link string")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "link string, n int")
    assert {r["n"] for r in skew.near_keys(rows, keys, "link").collect()} == {1, 2, 3}
    assert skew.near_keys(rows, keys.limit(0), "link").count() == 0
