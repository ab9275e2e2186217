import json

from pyspark.sql import functions as F

from newsward.functions import messages as M
from newsward.functions import reply as R
from newsward.operators import filters as P

REPLIES = [
    {"categories": "Environmental", "themes": ["Renewable Energy", "Sustainable Supply Chain"]},
    {"categories": ["Social", "x, \"y\": z"]}, {"categories": None}, {"categories": ""}, {"categories": []},
    {"categories": {}}, {"categories": 0}, {"categories": "[]"}, {"esg_check": "No"},
    {"categories": "été \\ \n\t😀"}, {"categories": {"a": [1, {"b": "c,d"}]}}, {"categories": ["ü"]},
]


def test_json_fields_equal_python(apply):
    texts = [json.dumps(r, ensure_ascii=False) for r in REPLIES]
    for name in ("categories", "themes"):
        wanted = [json.dumps(r.get(name, "")) for r in REPLIES]
        assert apply(lambda c: R.field_json(R.parse_reply(c), name), texts) == wanted
        plain = [json.dumps(r.get(name, ""), ensure_ascii=False) for r in REPLIES]
        assert apply(lambda c: R.field_json(R.parse_reply(c), name, ascii=False), texts) == plain


def test_json_string_equals_python(apply):
    texts = ["", 'a"b', "back\\slash", "é\n\t\r\b\f", "\u0001\u007f", "😀"]
    assert apply(R.json_string, texts) == [json.dumps(t) for t in texts]
    assert apply(lambda c: R.json_string(c, ascii=False), texts) == [
        json.dumps(t, ensure_ascii=False) for t in texts
    ]


def test_gates(apply):
    texts = [json.dumps(r) for r in REPLIES]
    assert apply(lambda c: R.esg_gate(R.parse_reply(c)), texts) == [r.get("categories", "") != "" for r in REPLIES]
    assert apply(lambda c: R.esg_gate(R.parse_reply(c), "api"), texts) == [bool(r.get("categories", "")) for r in REPLIES]
    assert apply(lambda c: R.esg_gate(R.parse_reply(c)), ["no json", "[1]", None, "3"]) == [False] * 4


def test_valid_and_bad_replies_split_the_input(spark):
    df = spark.createDataFrame([("{}",), ("x",), (None,), ("[1]",), ('{"a":1}',)], "reply string")
    assert P.valid_replies(df).count() == 2
    assert P.bad_replies(df).count() == 3


def test_fields_default_to_empty_text(apply):
    texts = ['{"country":"x"}', '{"country":null}', "{}"]
    assert apply(lambda c: R.field_text(R.parse_reply(c), "country"), texts) == ["x", None, ""]


def test_category_lists(apply):
    texts = ['"Social"', '["Environmental", "Other"]', "null", '""', "{}"]
    assert apply(R.category_list_of_json, texts) == [["Social"], ["Environmental", "Other"], [], [""], []]


def test_has_keys(apply):
    texts = ['{"a":null,"b":1}', '{"a":1}', "[1]", None]
    assert apply(lambda c: P.has_keys(c, ["a", "b"]), texts) == [True, False, False, False]


def test_classifier_request(apply):
    request = json.loads(apply(lambda c: M.classifier_request(c, "Tag it."), ['say "x"'])[0])
    assert request["messages"] == [
        {"role": "system", "content": "Tag it."}, {"role": "user", "content": 'say "x"'},
    ]
    assert (request["temperature"], request["presence_penalty"], request["seed"]) == (0.01, 0.5, 123)
    assert request["response_format"] == {"type": "json_object"}


def test_replies_are_judged_by_one_parse(spark):
    from pyspark.sql import Observation

    from newsward.operators import filters

    replies = ['{"categories": "Environmental"}', '{"categories": ""}', "no reply", None, '{"categories": "Social"}']
    rows = spark.createDataFrame(list(enumerate(replies)), "doc_id int, reply string")
    counts = Observation("test-replies")
    judged = filters.judged_replies(rows, counts=counts)
    found = {r["doc_id"]: r["verdict"] for r in judged.collect()}
    valid = {r["doc_id"] for r in filters.valid_replies(rows).collect()}
    gated = {r["doc_id"] for r in filters.esg_replies(rows).collect()}
    for doc_id, verdict in found.items():
        assert verdict == ("malformed" if doc_id not in valid else "accepted" if doc_id in gated else "gated")
    assert counts.get == {name: sum(v == name for v in found.values()) for name in filters.VERDICTS}
