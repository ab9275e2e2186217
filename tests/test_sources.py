import json

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from newsward.functions import tables
from newsward.lexicons import INDUSTRY_KEYWORDS, keyword_table
from newsward.operators.filters import required_fields
from newsward.sources import exports, news, pages, requests


def test_lexicon_counts(spark):
    counts = {r["industry"]: r["n"] for r in keyword_table(spark).groupBy("industry").agg(F.count("*").alias("n")).collect()}
    assert counts == {
        "Automotive": 39, "Consumer Goods": 40, "Healthcare": 39, "Hospitality": 50, "Metals": 51,
        "default": 49, "Real Estate": 46, "Retail": 49, "Telecom": 40, "Transport": 39,
    }
    words = [w for many in INDUSTRY_KEYWORDS.values() for w in many]
    assert (len(words), len(set(words)), len({w.lower() for w in words})) == (442, 119, 90)


def test_read_lexicons(spark, tmp_path):
    (tmp_path / "real_estate_keywords.json").write_text('["Flood", "Drought"]')
    (tmp_path / "Mining_keywords.json").write_text('["Dam\\u00e9"]')
    rows = requests.read_lexicons(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [("Mining", 0, "Damé"), ("Real Estate", 0, "Flood"), ("Real Estate", 1, "Drought")]


def test_requests_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes(b'\xef\xbb\xbfcompany_id,company_name,keyword\n0,"Acme, ""X"" Inc",Fraud\n2,,Flood\n')
    rows = requests.read_requests_csv(spark, str(path))
    assert [tuple(r) for r in rows.collect()] == [("0", 'Acme, "X" Inc', "Fraud"), ("2", None, "Flood")]
    assert rows.columns == ["company_id", "company_name", "search_query"]
    assert required_fields(rows, rows.columns).count() == 1


def test_requests_json(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"company_id": 1, "company_name": "A", "search_query": "q"}')
    (tmp_path / "many.json").write_text('[{"company_id": "2", "company_name": "B"},\n {"company_id": 3}]')
    rows = requests.read_requests_json(spark, str(tmp_path)).orderBy("company_id").collect()
    assert [tuple(r) for r in rows] == [("1", "A", "q", None), ("2", "B", None, None), ("3", None, None, None)]
    objects = [json.loads(r[0]) for r in requests.read_request_objects(spark, str(tmp_path)).collect()]
    assert len(objects) == 3 and {"company_id": 3} in objects


def test_flatten_news(spark, tmp_path):
    article = {"source": {"name": "S"}, "title": "t", "description": None, "url": "u", "publishedAt": "2024"}
    lines = [
        {"status": "ok", "totalResults": 2, "articles": [article, {**article, "author": "a", "url": "v"}]},
        {"status": "error", "totalResults": 2, "articles": [article]},
        {"status": "ok", "totalResults": 0, "articles": [article]},
    ]
    (tmp_path / "n.json").write_text("\n".join(map(json.dumps, lines)))
    rows = news.flatten_news(news.read_news(spark, str(tmp_path))).collect()
    assert sorted(map(tuple, rows)) == [
        (0, "S", "", "t", None, "u", "2024"), (1, "S", "a", "t", None, "v", "2024"),
    ]


SERP = (
    '<a href="/top">top</a><div class="dd algo-sr x"><div><h3><a href="u1">One <b>1</b></a></h3></div><a href="no"></a></div>'
    '<div class="algo-sr">none</div><p><a href="/after">after</a></p>'
    "<div class='algo-sr'><a href='u2'></a></div><div class=\"not-algo-sr2\"><a href='n'>n</a></div>"
)


def test_search_links(spark):
    df = spark.createDataFrame([(1, SERP), (2, "<p>none</p>")], "request_id bigint, html string")
    found = pages.extract_search_links(df)
    assert [tuple(r) for r in found.collect()] == [(1, 0, "u1", "One 1"), (1, 1, "u2", None)]
    stopped = pages.extract_search_links(df, on_missing="stop")
    assert [tuple(r) for r in stopped.collect()] == [(1, 0, "u1", "One 1")]


def test_paged_links_stop_at_the_first_empty_page(spark):
    block = '<div class="algo-sr"><a href="{}">x</a></div>'
    rows = [(1, 1, block.format("a") + block.format("b")), (1, 2, block.format("c")), (1, 3, "none"), (1, 4, block.format("z")),
            (2, 1, "none"), (2, 2, block.format("y")), (3, 4, block.format("far"))]
    df = spark.createDataFrame(rows, "request_id bigint, page_no bigint, html string")
    found = pages.extract_paged_links(df).orderBy("request_id", "pos").collect()
    assert [(r["request_id"], r["pos"], r["link"]) for r in found] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]


def test_report_tables(spark):
    table = (
        "<table><tr><th>h</th></tr><tr><td> d <b>e</b></td><td><a href=' /r.pdf '>R</a></td><td>l</td><td>t</td><td>s</td><td>r</td></tr>"
        "<tr><td>short</td></tr></table>"
    )
    df = spark.createDataFrame([(1, table + table)], "page_id bigint, html string")
    rows = pages.extract_table_rows(df).orderBy("table_no", "index").collect()
    full = ("de", "/r.pdf", "l", "t", "s", "r")
    assert [tuple(r) for r in rows] == [
        (1, n, i, *values) for n in (0, 1) for i, values in ((0, full), (1, ("short", None, None, None, None, None)))
    ]
    with pytest.raises(PySparkException, match="too few"):
        pages.extract_table_rows(df, on_short_row="fail").collect()


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>a\nb</p>")
    row = pages.read_pages(spark, str(tmp_path), format="text").first()
    assert row["html"] == "<p>a\nb</p>" and row["link"].endswith("a.html")


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("A/B", "u,1", 'say "x"\nnow')], "company_name string, link string, headline string")
    exports.export_csv(df, str(tmp_path / "csv"))
    exports.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.options(**exports.CSV, multiLine=True).csv(str(tmp_path / "csv"))
    assert [tuple(r) for r in back.collect()] == [("A/B", "u,1", 'say "x"\nnow')]
    exports.export_links_by_company(df, str(tmp_path / "links"))
    assert [p.name for p in (tmp_path / "links").iterdir() if p.is_dir()] == ["company=A%2FB"]


def test_request_ids_of_files(spark, tmp_path):
    from newsward.sources import news, pages

    one = '{"status": "ok", "totalResults": 1, "articles": [{"title": "t", "url": "u"}]%s}'
    (tmp_path / "news").mkdir()
    (tmp_path / "news" / "r 1.json").write_text(one % "")
    (tmp_path / "news" / "x.json").write_text(one % ', "request_id": "r2"')
    read = news.read_news(spark, str(tmp_path / "news"))
    assert sorted(r["request_id"] for r in news.flatten_news(read, keep=("request_id",)).collect()) == ["r 1", "r2"]
    (tmp_path / "found").mkdir()
    (tmp_path / "found" / "a-b-2.html").write_text("<p>x</p>")
    rows = pages.read_result_pages(spark, str(tmp_path / "found"), "text").collect()
    assert [tuple(r) for r in rows] == [("a-b", 2, "<p>x</p>")]


def test_tables_that_are_nested_unclosed_or_odd(spark):
    def found(html):
        df = spark.createDataFrame([(1, html)], "page_id bigint, html string")
        rows = pages.extract_table_rows(df).orderBy("table_no", "index").collect()
        return [(r["table_no"], r["index"], r["Event Date"], r["Link_text"], r["Location"]) for r in rows]

    assert found("<table><tr><td>h<tr><td>a<td>b") == [(0, 0, "a", None, "b")]
    assert found("</td></table><TABLE><tr></tr><tr><th>no</th><td>a</td></table></table><td>x</td>") == [(0, 0, "a", None, None)]
    inner = "<table><tr><td>1</td></tr><tr><td>2</td></tr></table>"
    nested = f"<table><tr><td>h</td></tr><tr><td>a</td><td>{inner}<a href=/x>y</a></td><td>b</td></tr></table>"
    assert found(nested) == [(0, 0, "a", "/x", "1"), (0, 1, "1", None, None), (0, 2, "2", None, None), (1, 0, "2", None, None)]
    assert found("<!-- <table> --><script>'<table><tr><td>1<tr><td>2'</script>") == []
    for nothing in (None, "", "<table>", "text", "<table></table>"):
        assert found(nothing) == []


def test_a_long_table_takes_time_in_proportion(spark):
    made = spark.range(1).select(F.lit(1).alias("page_id"), F.expr("'<table><tr><td>h' || repeat('<tr><td>a</td><td><a href=/l>x</a></td></tr>', 20000)").alias("html"))
    rows = pages.extract_table_rows(made)
    assert rows.where("`Event Date` = 'a' AND `Link_text` = '/l'").count() == 20000


def test_table_rows_of_a_page_in_one_python_pass():
    source = "<tr><td>out<table a='>'><tr><th>h<tr><td>&amp;lt; <b> &eacute;&#128;</b><TABLE><tr><tr><td>in</TABLE><td><a\thref=' /x&nope;&#0; '>go<tr><td/>"
    assert tables.table_rows(source) == [
        (0, 0, ["/x&nope;�"], ["&lt;é€in", "in"]),
        (0, 1, [], []),
        (0, 2, [], ["in"]),
        (0, 3, [], [""]),
        (1, 0, [], ["in"]),
    ]
    assert tables.table_rows("</table><td>x</td></tr><table") == []


def test_table_rows_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(tables, "BATCH_ROWS", 3)
    pages_ = pa.RecordBatch.from_pydict({"page_id": [7, None], "source": ["<table>" + "<tr><td>a" * 6, "<table><tr><tr><td>b"]})
    batches = list(tables.rows_of_batches(iter([pages_])))
    assert [b.num_rows for b in batches] == [3, 2, 1]
    assert pa.Table.from_batches(batches)["page_id"].to_pylist() == [7] * 5 + [None]


def test_export_of_many_small_companies_is_shared_by_tasks(spark, tmp_path):
    df = spark.range(40).selectExpr("concat('company ', id) AS company_name", "id AS pos", "'l' AS link")
    exports.export_links_by_company(df, str(tmp_path / "links"))
    tasks = {path.name.split("-")[1] for path in (tmp_path / "links").glob("*/part-*")}
    assert len(tasks) > 1 and spark.read.options(**exports.CSV).csv(str(tmp_path / "links")).count() == 40


def test_exported_links_are_listed_once(spark, tmp_path):
    rows = [(f"Company {k % 40}/x", k, f"l,{k}") for k in range(80)] + [(None, 80, None)]
    df = spark.createDataFrame(rows, "company_name string, pos bigint, link string")
    exports.export_links_by_company(df, str(tmp_path / "links"))
    spark.sparkContext.setJobGroup("listing", "")
    back = exports.read_links_by_company(spark, str(tmp_path / "links"), "company_name, pos, link")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("listing")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 1
    plain = spark.read.options(**exports.CSV).csv(str(tmp_path / "links")).select(back.columns)
    assert back.schema == plain.schema and sorted(map(str, back.collect())) == sorted(map(str, plain.collect()))
    assert {(r.company, r.pos) for r in back.collect()} == {(name, str(pos)) for name, pos, _ in rows}
