import numpy as np
import pytest
from pyspark.sql import functions as F

from newsward.lexicons import STOP_WORDS
from newsward.operators import summary

DIM = 3
WORDS = {"cats": [1.0, 0.2, 0.0], "dogs": [0.9, 0.3, 0.1], "rain": [0.0, 1.0, 0.5], "sun": [0.1, 0.0, 1.0]}
TEXT = "Cats and dogs. Rain on cats! Sun sun sun? The of and. Unknown words. Dogs rain cats. Sun rain"


def documents(spark):
    return spark.createDataFrame([(1, TEXT), (2, "Only cats."), (3, "")], "doc_id bigint, text string")


def vectors(spark):
    return spark.createDataFrame(list(WORDS.items()), "word string, embedding array<float>")


def brute_force(text):
    """Sentences, their vectors, and all pairs' cosines."""
    import re

    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    rows = []
    for s in sentences:
        words = [w for w in re.sub("[^a-zA-Z]", " ", s).lower().split() if w not in STOP_WORDS]
        total = sum((np.array(WORDS.get(w, [0.0] * DIM)) for w in words), np.zeros(DIM))
        rows.append(total / (len(words) + 0.001) if words else np.zeros(DIM))
    n = len(rows)
    matrix = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            size = np.linalg.norm(rows[i]) * np.linalg.norm(rows[j])
            if i != j and size > 0:
                matrix[i, j] = rows[i] @ rows[j] / size
    return sentences, np.array(rows), matrix


def power_rank(matrix, damping=0.85):
    n = len(matrix)
    weight = matrix.sum(axis=1)
    dangling = weight == 0
    x = np.full(n, 1 / n)
    for _ in range(1000):
        share = np.divide(x, weight, out=np.zeros(n), where=~dangling)
        x = damping * (share @ matrix + x[dangling].sum() / n) + (1 - damping) / n
    return x


def test_vectors_and_weights_equal_brute_force(spark):
    sentences, wanted, matrix = brute_force(TEXT)
    split = summary.split_sentences(documents(spark))
    made = summary.sentence_vectors(split, vectors(spark), DIM)
    rows = made.where("doc_id = 1").orderBy("pos").collect()
    assert np.allclose([r["vector"] for r in rows], wanted, atol=1e-6)
    assert [r["sentence"] for r in split.where("doc_id = 1").orderBy("pos").collect()] == sentences
    weights = summary.similarity_weight(made, DIM).where("doc_id = 1").orderBy("pos").collect()
    assert np.allclose([r["weight"] for r in weights], matrix.sum(axis=1), atol=1e-5)


def test_rank_equals_power_iteration(spark):
    _, _, matrix = brute_force(TEXT)
    made = summary.sentence_vectors(summary.split_sentences(documents(spark)), vectors(spark), DIM)
    rows = summary.sentence_rank(made).orderBy("doc_id", "pos").collect()
    scores = [r["score"] for r in rows if r["doc_id"] == 1]
    assert np.allclose(scores, power_rank(matrix), atol=1e-6)
    assert [r["score"] for r in rows if r["doc_id"] == 2] == [1.0]


def test_summary_takes_the_best_sentences(spark):
    sentences, _, matrix = brute_force(TEXT)
    best = sorted(zip(np.round(power_rank(matrix), 9), sentences), reverse=True)[:5]
    rows = {r["doc_id"]: r["summary"] for r in summary.summarize(documents(spark), vectors(spark), DIM).collect()}
    assert rows == {1: "".join(" " + s for _, s in best), 2: " Only cats."}


def test_a_large_dictionary_is_shuffled(spark, monkeypatch):
    from newsward.operators import skew

    monkeypatch.setattr(skew, "BROADCAST_BYTES", 200)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = summary.sentence_vectors(summary.split_sentences(documents(spark)), vectors(spark), DIM)
        assert "salt" in made._jdf.queryExecution().executedPlan().toString()
        rows = made.where("doc_id = 1").orderBy("pos").collect()
        assert np.allclose([r["vector"] for r in rows], brute_force(TEXT)[1], atol=1e-6)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    values = [r[0] for r in df.select(summary.cosine("a", "b", 2)).collect()]
    assert values == pytest.approx([2**-0.5, 0.0])


def test_clean_sentence(apply):
    texts = ["The Cats, and 2 cats' dogs!", "", "of the"]
    assert apply(summary.clean_sentence, texts) == ["cats cats dogs", "", ""]


def test_functions_reach_executors_without_the_package():
    """Workers started elsewhere must not need to import this package."""
    from pyspark import cloudpickle

    assert "newsward.operators.summary" in cloudpickle.list_registry_pickle_by_value()


def test_ranks_are_finite_for_negative_similarities():
    import numpy as np

    from newsward.operators.summary import rank_scores

    angle = np.arccos(-0.85)
    pair = np.array([[1.0, 0.0], [np.cos(angle), np.sin(angle)]])
    assert np.allclose(rank_scores(pair), 0.5)
    rng = np.random.default_rng(0)
    assert all(np.isfinite(rank_scores(rng.standard_normal((n, 3)))).all() for n in range(1, 60))


def test_rounds_end_where_the_matrix_says():
    """Beside the same rounds over the whole matrix of similarities."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 60):
        made = np.abs(rng.standard_normal((n, 6)))
        made[n // 2 :: 3] = 0
        norms = np.linalg.norm(made, axis=1)
        unit = np.divide(made, norms[:, None], out=np.zeros_like(made), where=norms[:, None] > 0)
        matrix = unit @ unit.T
        np.fill_diagonal(matrix, 0)
        sums = matrix.sum(1)
        x = np.full(n, 1 / n)
        for _ in range(100):
            y = 0.85 * (np.divide(x, sums, out=np.zeros(n), where=sums > 1e-9) @ matrix + x[sums <= 1e-9].sum() / n) + 0.15 / n
            change, x = np.abs(y - x).sum(), y
            if change < n * 1e-6:
                break
        assert np.allclose(summary.rank_by_rounds(made), x, atol=1e-12)
        assert np.allclose(summary.rank_by_rounds(made, 1e-15), summary.rank_scores(made), atol=1e-9)
    against = np.array([[1.0, 0.1], [-1.0, 0.1], [1.0, -0.1], [0.2, -1.0]])
    assert np.allclose(summary.rank_by_rounds(against, 1e-15, 3), 0.25)


def test_vectors_come_document_by_document_and_stay_in_place(spark, monkeypatch):
    rows = [(i % 7, i // 7, word) for i, word in enumerate(["Risk", "x", "risk of Risk.", ""] * 20)] + [(None, 0, "risk"), (3, 1, "again risk")]
    split = spark.createDataFrame(rows, "doc_id int, pos int, sentence string")
    words = spark.createDataFrame([("risk", [1.0, 2.0]), ("risk", [1.0, None])], "word string, embedding array<float>")
    monkeypatch.setattr(summary, "SENTENCES", 3)
    made = summary.sentence_vectors(split, words, 2, ["of"])
    assert made.where("doc_id = 3 AND pos = 1").select("n_words").first()[0] == sum(2 if w == "risk" else w not in ("", "of") for d, p, s in rows if (d, p) == (3, 1) for w in s.lower().strip(".").split())
    for operator in (lambda v, t: summary.similarity_weight(v, 2, together=t), lambda v, t: summary.sentence_rank(v, together=t)):
        here, moved = operator(made, True), operator(made, False)
        assert "MapInArrow over" in here._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, here.collect())) == sorted(map(str, moved.collect()))


def test_sentences_are_shuffled_once(spark):
    docs = documents(spark).selectExpr("doc_id", "text", "1 AS other")
    split = summary.split_sentences(summary.by_document(docs))
    for made, most in ((summary.sentence_rank(summary.sentence_vectors(split, vectors(spark), DIM), together=True), 1), (summary.summarize(docs, vectors(spark), DIM), 2)):
        plan = made._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [part for part in plan.split("\n\n") if "Exchange" in part.split("\n")[0] and ("text#" in part or "sentence#" in part)]
        assert 1 <= len(moved) <= most, moved


@pytest.mark.parametrize("piece, chars", [(1, 1), (2, 40), (3, 1 << 27)])
def test_vectors_by_pieces_and_many_lots(spark, monkeypatch, piece, chars):
    rows = [(i % 50, i // 100, f"risk {['sun', 'rain', 'x'][i % 3]} of") for i in range(400)] + [(None, None, "risk"), (None, 0, "rain"), (4, 9, None)]
    split = spark.createDataFrame(rows, "doc_id int, pos int, sentence string")
    known = {"risk": [1.0, 2.0], "sun": [0.5, 0.25], "rain": [3.0, -1.0]}
    words = spark.createDataFrame(list(known.items()), "word string, embedding array<float>")
    monkeypatch.setattr(summary, "PIECE", piece)
    monkeypatch.setattr(summary, "LOT_CHARS", chars)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {(r.doc_id, r.pos): (r.n_words, r.vector) for r in summary.sentence_vectors(split, words, 2, ["", "of"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for doc, pos, sentence in rows:
        if sentence is not None:
            n, total = want.get((doc, pos), (0, np.zeros(2)))
            own = [w for w in sentence.split() if w != "of"]
            want[doc, pos] = n + len(own), total + sum((np.array(known.get(w, [0.0, 0.0])) for w in own), np.zeros(2))
    assert got.keys() == want.keys()
    for key, (n, total) in want.items():
        assert got[key][0] == n and np.allclose(got[key][1], total / (n + 0.001))


def test_summaries_of_ties_and_repeated_ids(spark):
    """Equal texts tie, and their order is that of the sentences' bytes; documents that share an id are one."""
    texts = [(1, " ".join(f"Sun {c}." for c in "bdacfegéz")), (2, "Sun rain. Rain cats! Dogs."), (2, "Sun sun. Cats."), (3, ""), (None, "Sun.")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    split = summary.split_sentences(docs)
    scores = summary.sentence_rank(summary.sentence_vectors(split, vectors(spark), DIM), together=True)
    for k in (1, 3, 20):
        want = {r.doc_id: r.summary for r in summary.summaries(split, scores, k).collect()}
        assert {r.doc_id: r.summary for r in summary.summarize(docs, vectors(spark), DIM, k).collect()} == want
    assert set(want) == {1, 2} and want[2].count(".") == 4
    best = summary.sentence_rank(summary.sentence_vectors(split, vectors(spark), DIM, sentences=True), together=True, best=3)
    assert max(r["count"] for r in best.groupBy("doc_id").count().collect()) == 3
