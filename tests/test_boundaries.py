"""Learned sentence boundaries on texts where the plain rule fails."""

import pytest
from pyspark.sql import functions as F

from newsward.operators import boundaries, summary

TEXT = "Dr. Smith of Acme Inc. said U.S. sales rose. He left! Why? J. Doe of Acme Inc. The end."
FILLER = ["The sales of 2020 rose. He said so. The end.", "He left Acme Inc. today. The firm of Dr. Doe stayed. The sales fell.", "U.S. sales rose. The U.S. market fell. He left.", "Sales that rose or fell today stayed so as he left to the end"]
WANT = ["Dr. Smith of Acme Inc. said U.S. sales rose.", "He left!", "Why?", "J. Doe of Acme Inc.", "The end."]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k, FILLER[k % 4]) for k in range(300)] + [(1000, TEXT), (1001, None), (1002, ""), (1003, "  \n"), (1004, TEXT)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def learned(documents):
    return boundaries.learn(documents)


def split(documents, learned, doc_id):
    rows = summary.split_sentences(documents.where(F.col("doc_id") == doc_id), learned).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    return [r["sentence"] for r in rows]


def test_abbreviations_and_starters_are_learned(learned):
    words = {r["word"] for r in learned.abbreviations.collect()}
    assert {"dr", "inc", "u.s"} <= words
    assert not words & {"rose", "end", "fell", "left", "so", "stayed"}
    assert {"the", "he"} <= {r["word"] for r in learned.starters.collect()}


def test_sentences_by_learned_boundaries(documents, learned):
    assert split(documents, learned, 1000) == WANT
    for empty in (1001, 1002, 1003):
        assert split(documents, learned, empty) == []
    assert len(summary.split_sentences(documents.where("doc_id = 1000")).collect()) > len(WANT)


def test_joined_dictionary_gives_the_same_sentences(documents, learned, monkeypatch):
    in_row = summary.split_sentences(documents, learned).collect()
    monkeypatch.setattr(boundaries, "IN_ROW", 0)
    assert sorted(summary.split_sentences(documents, learned).collect()) == sorted(in_row)


def test_nothing_to_learn_from(spark, documents):
    none = boundaries.learn(documents.where("doc_id = 1001"))
    assert none.abbreviations.count() == none.starters.count() == 0
    assert split(documents, none, 1000) == [s for s in split(documents, none, 1000) if s]


def test_a_long_text_is_split_in_linear_time(spark, documents, learned):
    long_text = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("repeat('The U.S. sales rose. ', 20000)").alias("text"))
    assert summary.split_sentences(long_text, learned).count() == 20000


def test_counts_are_taken_from_the_texts_once(spark):
    counts = boundaries.token_counts(spark.createDataFrame([("Acme Inc. rose.",)], "text string"))
    assert "regexp_extract_all" not in counts._jdf.queryExecution().toString()
    assert {tuple(r) for r in counts.collect()} == {("acme", False, None, 1), ("inc", True, None, 1), ("rose", True, "inc", 1)}
