import datetime
import json

from newsward.lexicons import keyword_table
from newsward.operators import rules

TEXTS = [
    "Greenhouse-gas EMISSIONS and pollution rise in Guinea. Nothing else. It rose, in Guinea-Bissau (23/03/2021)!",
    "pollutions fraudulent", "", "Fraud. No date 31/02/2021 here", "Reduced cost and a award for progress",
]


def articles(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


def countries(spark):
    return spark.createDataFrame([(1, "Guinea-Bissau"), (2, "Guinea"), (3, "")], "id bigint, country string")


def test_match_keywords_finds_whole_words(spark):
    found = rules.match_keywords(articles(spark), keyword_table(spark))
    assert sorted(map(tuple, found.collect())) == [(0, "greenhouse gas emissions"), (0, "pollution"), (3, "fraud")]


def test_a_large_dictionary_is_joined(spark, monkeypatch):
    monkeypatch.setattr(rules, "DICTIONARY_LIMIT", 3)
    found = rules.match_keywords(articles(spark), keyword_table(spark))
    assert sorted(map(tuple, found.collect())) == [(0, "greenhouse gas emissions"), (0, "pollution"), (3, "fraud")]
    monkeypatch.setattr(rules, "DICTIONARY_LIMIT", 1)
    named = rules.tag_countries(articles(spark), countries(spark)).orderBy("doc_id").collect()
    assert [r["country"] for r in named] == ["Guinea", "", "", "", ""]


def test_overlapping_terms_are_all_found(spark):
    lexicon = spark.createDataFrame([("gas emissions",), ("greenhouse gas emissions",), ("greenhouse gas",)], "keyword string")
    found = rules.match_keywords(articles(spark), lexicon)
    assert {r["keyword"] for r in found.collect()} == {"gas emissions", "greenhouse gas emissions", "greenhouse gas"}


def test_tags(spark):
    rows = rules.tag_articles(articles(spark), keyword_table(spark), countries(spark)).orderBy("doc_id").collect()
    assert [r["category"] for r in rows] == ["Environmental", "", "", "Governance", ""]
    assert [r["esg_check"] for r in rows] == ["Yes", "No", "No", "Yes", "No"]
    assert [r["sentiment"] for r in rows] == ["Negative", "Neutral", "Neutral", "Negative", "Positive"]
    assert rows[0]["themes"] == ["greenhouse gas emissions", "pollution"]
    assert rows[0]["incidents"] == "Greenhouse-gas EMISSIONS and pollution rise in Guinea."
    assert rows[1]["incidents"] == "No incidents found"
    assert [r["country"] for r in rows] == ["Guinea", "", "", "", ""]
    assert [r["date"] for r in rows] == [datetime.date(2021, 3, 23), None, None, None, None]


def test_longest_country_name_wins(spark):
    df = spark.createDataFrame([(1, "In guinea bissau and Guinea")], "doc_id bigint, text string")
    assert rules.tag_countries(df, countries(spark)).first()["country"] == "Guinea-Bissau"


def test_rule_replies_are_read_back(spark):
    tags = rules.tag_articles(articles(spark), keyword_table(spark), countries(spark))
    replies = {r["doc_id"]: json.loads(r["reply"]) for r in rules.rule_replies(tags).collect()}
    assert replies[1] == {"esg_check": "No"}
    assert replies[0]["categories"] == "Environmental" and replies[0]["date"] == "2021-03-23"
    assert replies[3]["date"] == ""


def test_tagging_needs_no_shuffle(spark):
    df = rules.rule_replies(rules.tag_articles(articles(spark), keyword_table(spark), countries(spark)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_classify_marks_failing_rows(spark):
    def shout(texts):
        if "" in texts:
            raise ValueError("empty")
        return [t.upper() for t in texts]

    rows = {r["doc_id"]: (r["reply"], r["error"]) for r in rules.classify(articles(spark), shout).collect()}
    assert rows[1] == ("POLLUTIONS FRAUDULENT", None)
    assert rows[2] == (None, "ValueError: empty")


def test_tags_do_not_depend_on_the_dictionary_limit(spark, monkeypatch):
    rows = articles(spark).union(articles(spark))  # repeated ids
    def tags():
        return sorted(map(repr, rules.tag_articles(rows, keyword_table(spark), countries(spark)).collect()))
    def hits():
        return sorted(map(tuple, rules.match_keywords(rows, keyword_table(spark)).collect()))
    def named():
        return sorted(map(tuple, rules.tag_countries(rows, countries(spark)).collect()))
    small = tags(), hits(), named()
    monkeypatch.setattr(rules, "DICTIONARY_LIMIT", 1)
    assert (tags(), hits(), named()) == small


def test_only_whole_terms_leave_the_row(spark):
    terms = spark.createDataFrame([(f"t{k} end{k % 7}" if k % 2 else f"t{k}",) for k in range(20000)], "keyword string")
    texts = [" ".join(f"t{(d * 31 + k * 17) % 40000} end{k % 9} x{k}" for k in range(200)) for d in range(40)]
    articles = spark.createDataFrame([*enumerate(texts), (99, None), (98, "")], "doc_id bigint, text string")
    found = {(r["doc_id"], r["at"], r["term"]) for r in rules.join_hits(articles, terms, "keyword").collect()}
    known = {r["keyword"] for r in terms.collect()}
    want = set()
    for d, text in enumerate(texts):
        parts = text.split(" ")
        for n in (1, 2):
            want |= {(d, k, " ".join(parts[k : k + n])) for k in range(len(parts) - n + 1) if " ".join(parts[k : k + n]) in known}
    assert found == want
    places = rules.term_places(articles, rules.folded_terms(terms, "keyword")).count()
    assert len(want) <= places <= 1.1 * len(want)
    assert rules.join_hits(articles, terms.where("false"), "keyword").count() == 0


def test_one_bad_text_costs_few_calls(spark):
    calls = spark.sparkContext.accumulator(0)

    def picky(texts):
        calls.add(1)
        if any(t == "bad" for t in texts):
            raise ValueError("bad text")
        return [t.upper() for t in texts]

    rows = [(k, "bad" if k == 700 else f"t{k}") for k in range(1000)]
    made = rules.classify(spark.createDataFrame(rows, "doc_id int, text string").coalesce(1), picky).collect()
    assert [(r["doc_id"], r["reply"], r["error"]) for r in made if r["error"]] == [(700, None, "ValueError: bad text")]
    assert sum(r["reply"] == f"T{r['doc_id']}" for r in made) == 999
    assert calls.value <= 1 + 2 * 10
    sizes = rules.classify(spark.createDataFrame(rows[:9], "doc_id int, text string").coalesce(1), lambda ts: [str(len(ts))] * len(ts), batch_bytes=4)
    assert {r["reply"] for r in sizes.collect()} == {"2", "1"}
