import datetime
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsward.functions import text as T

URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
TEXTS = [
    "See https://a.b/c?d=1#top and http://x.org/a,b!c)~ end",
    "  many \t\n blanks  here \u001c\u0085 x ",
    "https://a.b/%20x\nhttp://é.org httpx://no https://",
    "", " ", "a", "a b", "a  b", "　a　　b　", "x ​ y",
]


def python_clean(text):
    return re.sub(r"\s+", " ", re.sub(URL, "", text)).strip()


def test_clean_text_equals_the_python_model(apply):
    assert apply(T.clean_text, TEXTS) == [python_clean(t) for t in TEXTS]
    assert apply(T.strip_urls, TEXTS) == [re.sub(URL, "", t) for t in TEXTS]
    assert apply(T.collapse_ws, TEXTS) == [re.sub(r"\s+", " ", t).strip() for t in TEXTS]
    assert apply(T.strip_ws, TEXTS) == [t.strip() for t in TEXTS]


def test_every_space_character(apply):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}{c}b{c}" for c in chars]
    assert apply(T.collapse_ws, texts) == [re.sub(r"\s+", " ", t).strip() for t in texts]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab .\t\n  https:/#%2~é", max_size=40), min_size=50, max_size=100))
def test_clean_text_on_random_texts(apply, texts):
    assert apply(T.clean_text, texts) == [python_clean(t) for t in texts]


def test_title_case_equals_python(apply):
    names = ["guinea-bissau", "cote d'ivoire", "x2y", "UNITED states", "são tomé", "", "a.b c", "trinidad & tobago"]
    assert apply(T.title_case, names) == [n.title() for n in names]


def test_quotes(apply):
    assert apply(T.strip_quotes, ['"Social"', "'Social'", "\"'S'\"", "'\"S\"'", ""]) == [
        t.strip('"').strip("'") for t in ['"Social"', "'Social'", "\"'S'\"", "'\"S\"'", ""]
    ]


def test_published_date(apply):
    day = datetime.date(2021, 3, 23)
    values = ["2021-03-23", "23/03/2021", "23-03-2021", "2021-03-23T10:00:00Z", "soon", "", None, "2021-02-31"]
    assert apply(T.published_date, values) == [day, day, day, day, None, None, None, None]


def test_compose_text(spark):
    df = spark.createDataFrame([("t", None), (None, "d"), ("t", "d")], "a string, b string")
    both = df.select(
        T.compose_text(F.col("a"), F.col("b")).alias("x"),
        T.compose_text(F.col("a"), F.col("b"), null_as_none=False).alias("y"),
    ).collect()
    assert [tuple(r) for r in both] == [("t\nNone", "t"), ("None\nd", "d"), ("t\nd", "t\nd")]


def test_search_phrase(spark):
    df = spark.createDataFrame([("Acme", "Fraud")], "c string, k string")
    styles = ["web", "plain", "api"]
    row = df.select(*[T.search_phrase(F.col("c"), F.col("k"), s) for s in styles]).first()
    assert tuple(row) == ("Acme Fraud news", "Acme Fraud", "Fraud Acme")


def test_sentences(apply):
    assert apply(T.sentences, ["  One. Two!\nThree?  Four", "", "a.b c", "...  x"]) == [
        ["One.", "Two!", "Three?", "Four"], [], ["a.b c"], ["...", "x"],
    ]
