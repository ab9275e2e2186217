"""The operators on small hard tables, beside their SQL or a brute-force version."""

import collections
import hashlib
import math
import os
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import rows_of
from newsward.llm import block_labels, collocations, common, cover_tree, embed_dup, extraction, html_blocks, lattice, manifest, mixing, near_dup, packing, quality, queries, quotient, scoring, substrings, toxicity, urls
from newsward.llm.common import components, running_total
from newsward.llm.words import LOWER, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CLASHES = {"seq": 1, "node": 2, "size": "x", "own_seq": 3, "score": 9.0, "row_no": 4, "root": 5, "class": 6, "doc_key": 7, "part": 8, "predicted": 1}


def lower(raw: bytes) -> bytes:
    return raw.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def story(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join("w%d" % x for x in rng.integers(0, 5000, n))


BASE = story(200, 1)
TEXTS = [
    None, "", "  \t\n", "one", "One two THREE", BASE, BASE, BASE.upper(), BASE.replace(" ", "  \n"),
    BASE + " tail", story(60, 2) + " " + " ".join(BASE.split()[50:110]), story(30000, 3), "la " * 300,
    " ".join(["same line of words here"] * 30), story(35, 4), story(35, 4), story(34, 5), story(34, 5), "élan ÀB  x", "x" * 5000,
]


def write(folder, name, table):
    pq.write_table(table, os.path.join(folder, f"{name}.parquet"))


@pytest.fixture(scope="module")
def hard(tmp_path_factory):
    """Tables with nulls, ties, copies, empty and long texts, and clashing columns."""
    folder = str(tmp_path_factory.mktemp("hard"))
    n = len(TEXTS)
    docs = {"doc_id": pa.array(range(3, 3 + n), pa.int64()), "text": pa.array(TEXTS, pa.string()), "lang": pa.array([None, "en"] * (n // 2), pa.string()), "source": pa.array([[None, "a", "b", "ä"][k % 4] for k in range(n)], pa.string()), "n_chars": pa.array([len(t or "") for t in TEXTS], pa.int64())}
    docs |= {k: pa.array([v] * n) for k, v in CLASHES.items()}
    write(folder, "documents", pa.table(docs))
    rng = np.random.default_rng(0)
    vectors = [v.tolist() for v in rng.standard_normal((60, 8)).astype(np.float32)]
    vectors += [vectors[0], vectors[0], [x * 1.01 + 0.01 for x in vectors[1]], None, [0.0] * 8, [math.nan] + [1.0] * 7, [None] + [1.0] * 7, []]
    labels = [k % 3 for k in range(60)] + [0, None, 1, 1, 1, 1, 1, 1]
    write(folder, "embeddings", pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32()), "node": pa.array([1] * len(vectors))}))
    page = '<html><head><link rel="canonical" href="%s"></head><body><article><p>x</p></article></body></html>'
    pages = [
        ("http://A.example.com/de/1", page % "http://b.org/x#y"), ("http://b.org/x", None), ("http://c.org/z", page % "/q"), (None, ""), ("nonsense", ""),
        ("http://b.org/x#frag", ""), ("https://net/de", ""), ("https://xnet/de", ""), ("http://d.example.net/en/5?x=1", page % "https://e.net/"), ("http://c.org/fr/", page % "http://c.org/z"),
        ("http://f.org/", '<meta http-equiv="refresh" content="0; url=http://g.net/">'), ("http://h.org/", '<meta http-equiv=refresh content="0;URL=http://f.org/">'), ("http://b.org/x", None),
    ]
    write(folder, "pages", pa.table({"page_id": pa.array(range(len(pages)), pa.int64()), "url": pa.array([p[0] for p in pages], pa.string()), "html": pa.array([p[1] for p in pages], pa.string()), "host": pa.array(["z"] * len(pages))}))
    write(folder, "labels", pa.table({"doc_id": pa.array([3, 4, None], pa.int64()), "quality": pa.array([1, 0, 1], pa.int32()), "toxic": pa.array([0, 1, None], pa.int32())}))
    return folder


@pytest.fixture(scope="module")
def empty(hard, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "embeddings", "pages", "labels"):
        write(folder, name, pq.read_table(f"{hard}/{name}.parquet").slice(0, 0))
    return folder


def compared(spark, folder, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = queries.QUERIES[name](spark, folder)
    answer = connection.execute(queries.ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(result.columns)
    assert rows_of(result.columns, result.collect()) == rows_of(columns, answer.fetchall())


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql_on_hard_tables(spark, hard, name):
    compared(spark, hard, name)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql_on_given_tables(spark, name):
    compared(spark, "/root/testdata/sf0.001", name)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_words_are_those_of_the_pattern():
    texts = [*TEXTS, "a" * 3_000_000 + " b"]
    hashes, starts, ends, first, data = words(pa.array(texts, pa.string()), LOWER)
    known = {}
    for k, text in enumerate(texts):
        want = WORD.findall(lower((text or "").encode()))
        own = range(first[k], first[k + 1])
        assert [data[starts[i] : ends[i]].tobytes() for i in own] == want
        for i, word in zip(own, want):
            assert known.setdefault(word, hashes[i]) == hashes[i]
    assert len(set(known.values())) == len(known)


def test_running_total_and_components(spark):
    rows = [(k % 7, k, k * 3 % 11) for k in range(500)]
    got = running_total(spark.createDataFrame(rows, "a int, b int, v int"), ["a", "b"], "v", "before").collect()
    total = 0
    for row in sorted(got, key=lambda r: (r.a, r.b)):
        assert row.before == total
        total += row.v
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 90, 90: 90, 95: 90}


def test_extraction(spark):
    model = block_labels.trained(pages=300, rounds=5)
    page = '<head><title>T</title><script>var a="</p><!--";</script></head><body><nav><ul><li><a href="/">Home</a><li><a>About</a></ul></nav><div class="ad">Buy now.</div><article><h1>A &amp; B</h1><p>First  line\n of <b>text</b>.<p>Second&nbsp;one &lt;here&gt;.</p></article><footer>&copy; us</footer>'
    rows = [(1, "u", page), (2, None, None), (2, "u", ""), (3, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' text", "1 n_chars")
    got = [tuple(r) for r in extraction.extract(df, model).orderBy("page_id", "n_chars").collect()]
    text = "A & B\nFirst line of text.\nSecond one <here>."
    assert [(g[0], g[2], g[3]) for g in got] == [(1, text, len(text)), (2, "", 0), (2, "", 0), (3, text, len(text))]


def test_labeller_on_layouts_it_has_not_seen():
    model = block_labels.trained(pages=500, rounds=6)
    xs, ys = block_labels.made_pages(100, 321)
    wrong = sum((a != (b > 0)).sum() for a, b in zip(block_labels.main_blocks(model, xs), ys))
    assert wrong <= 0.03 * sum(map(len, ys))


def test_lattice_sums_all_segmentations():
    pieces = [b" ", b" a", b"a", b"b", b"ab", b"ba", b" ab"]
    p = np.arange(1, len(pieces) + 1) / 28
    vocabulary = lattice.Vocabulary(pieces, np.log(p)[None, :])

    def brute(rest):
        return 1.0 if not rest else sum(p[k] * brute(rest[len(x) :]) for k, x in enumerate(pieces) if rest.startswith(x))

    texts = [b"a", b"ab", b"abba", b"bab", b"aaaaab", b"ab"]
    blob, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    got = lattice.log_marginals(vocabulary, blob, starts, sizes)[0]
    assert np.allclose(got, [math.log(brute(b" " + t)) for t in texts])
    # Each segmentation spells the word: expected bytes of its pieces are the word's.
    uses = lattice.expected_counts(vocabulary, 0, blob, starts, sizes)
    assert np.isclose((uses * [len(x) for x in pieces]).sum(), (sizes + 1).sum())


def test_scores_and_base(spark, hard):
    got = queries.QUERIES["op5_lattice_likelihood"](spark, hard).collect()
    tokens = {k + 3: [*map(lower, WORD.findall((t or "").encode())), None] for k, t in enumerate(TEXTS)}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = collections.Counter(w for i, own in tokens.items() if i not in held for w in own)
    n, v = sum(counts.values()), len(counts)
    assert {r.doc_id for r in got} == set(tokens)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_held_out_scores_beat_the_base(spark):
    got = queries.QUERIES["op5_lattice_likelihood"](spark, "/root/testdata/sf0.1").where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > got.b


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op8_kneser_ney_toxicity"](spark, folder).where("held_out")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    right = scored.join(labels, "doc_id").selectExpr("avg(int(predicted = toxic)) a", "min(score) low", "max(score) high").first()
    assert right.a > 0.99 and right.low >= 0 and right.high <= 1


def test_toxicity_without_labels_of_both_classes(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    labels = spark.read.parquet(f"{hard}/labels.parquet").where("toxic = 0")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(TEXTS) and all(r.predicted == 0 for r in got)


def test_packing_round_trip(spark, hard):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*TEXTS, "<|endoftext|> ​　 tab\t\t\r\n  it's 12345 日本語 🎉"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (None, "no id")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), 64).collect()
    want = collections.Counter()
    for doc, text in rows:
        want[doc, len(ids := reference.encode(text or "", add_special_tokens=False).ids + [0])] += 1
        for piece in [g for g in got if g.doc_id == doc and g.doc_tokens == len(ids)]:
            part = np.array(ids[piece.start : piece.start + piece.length], "<u4")
            assert zlib.crc32(part.tobytes()) == piece.ids_crc32
    for (doc, size), copies in want.items():
        assert sum(g.length for g in got if g.doc_id == doc and g.doc_tokens == size) == copies * size
    sequences = collections.defaultdict(list)
    for g in got:
        sequences[g.sequence_id].append((g.offset, g.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for number, parts in sequences.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end == 64 or number == len(sequences) - 1


def test_ids_are_those_of_the_named_file(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    given = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    rng = np.random.default_rng(2)
    parts = [" ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2003", "\x85", "\x1c", "a", "é", "Straße", "日本", "<|endoftext|>", "<|endoftext|", "it's", "'ll", "1", ".", "😀", "\x00", "   "]
    odd = ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 14))) for _ in range(5000)]
    monkeypatch.setattr(packing, "REMEMBERED", 20000)
    known = packing.Segments()
    for texts in (given, odd, [None, "", "x<|endoftext|>"]):
        ids, edges = packing.encoded(pa.array(texts, pa.string()), known)
        want = reference.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == [x.ids for x in want]
    assert ids.tolist()[-2:] == [87, 50256]


def test_remembered_segments_stay_small(monkeypatch):
    """Marks are cut from words, segments are held in Arrow, and those met once or long ones are given up."""
    data, offsets = packing.flat(pa.array(["one, two.\nThree: it's; x", "don't"]))
    assert packing.segment_starts(data, offsets).tolist()[:6] == [0, 3, 4, 8, 15, 16]
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    known = packing.Segments()
    for k in range(6):
        texts = ["the same words come again", " ".join("n%dx%d" % (k, x) for x in range(400)), "y" * 5000 + "%d" % k]
        ids, edges = packing.encoded(pa.array(texts), known)
        want = known.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == [x.ids for x in want]
    assert len(known.known) <= 1000 and known.known.nbytes < 50_000
    assert " same" in known.known.to_pylist()
    assert packing.remembered() is packing.remembered()


def test_packing_round_trip_on_given_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    pieces = collections.defaultdict(list)
    for row in packing.pack(docs).collect():
        pieces[row.doc_id].append(row)
    rows = docs.collect()
    for row, found in zip(rows, reference.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        ids, end = [*found.ids, 0], 0
        for piece in sorted(pieces[row.doc_id], key=lambda p: p.start):
            assert piece.start == end and piece.doc_tokens == len(ids)
            end += piece.length
            assert zlib.crc32(np.array(ids[piece.start : end], "<u4").tobytes()) == piece.ids_crc32
        assert end == len(ids)


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((2, 3), (3, 2)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
        points = np.column_stack([a.ravel() for a in axes])
        keys = packing.hilbert_keys(points, bits)
        assert sorted(keys) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_mixed_rows_hold_what_is_taken(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = collections.Counter()
    for row in out.collect():
        got[row.doc_id] += len(WORD.findall(row.text.encode()))
        assert row.n_chars == len(row.text) and row["size"] == "x"
    assert {k: v[0] for k, v in taken.items() if v[0]} == dict(got)
    assert all(t <= 2 * s for t, s in taken.values())


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rows = [(None, BASE), (4, BASE), (4, BASE), (4, story(50, 9)), (None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 node", "2 class")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == {(None, 4, False): 1, (4, 4, True): 3, (None, None, False): 1, (7, 7, True): 1}
    kept = near_dup.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(False, 4, BASE), (False, 4, story(50, 9)), (True, 0, ""), (False, 7, "")])


def test_large_component_is_found_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "NODE_LIMIT", 8)
    base = story(150, 21).split()
    rows = []
    for k in range(60):
        rng = np.random.default_rng(k)
        own = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 6)):
            own[at] = "x%d" % k
        rows.append((k, " ".join(own)))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(147)} for _, t in rows]
    label = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label))


def test_large_leaf_of_texts_that_share_boilerplate(spark):
    """5,000 short texts with one shingle in common and 600 near copies among them."""
    rng = np.random.default_rng(8)
    texts = [["all", "rights", "reserved", "here", *("w%d" % x for x in rng.integers(0, 3000, 12))] for _ in range(5000)]
    texts += [[*texts[k * 7][:-1], "z%d" % k] for k in range(600)]
    sets = [{tuple(t[i : i + 4]) for i in range(len(t) - 3)} for t in texts]
    held = collections.defaultdict(list)
    for k, own in enumerate(sets):
        for shingle in own - {("all", "rights", "reserved", "here")}:
            held[shingle].append(k)
    label = list(range(len(texts)))
    pairs = {(a, b) for ids in held.values() for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    for a, b in sorted(pairs):
        label[b] = min(label[b], label[a])
    assert len(pairs) >= 600
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label))


def test_components_joined_by_many_tasks(spark, monkeypatch):
    """A task holds few edges: trees of several tasks are joined by the rounds that follow."""
    monkeypatch.setattr(common, "EDGES_PER_TASK", 50)
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(-400, 400, (400, 2))] + [(k + 1000, k + 1001) for k in range(150)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "src long, dst long").repartition(12)
    assert sorted((r.node, r.root) for r in common.components(df).collect()) == sorted(label.items())
    nodes, roots = common.least_of(*np.array([e for e in edges if e[0] != e[1]]).T)
    assert dict(zip(nodes.tolist(), roots.tolist())) == label


def test_large_nodes_make_no_more_rows_on_lower_levels(spark, monkeypatch):
    """Sets that share many coordinates: each document has one place a level below a root's children."""
    monkeypatch.setattr(near_dup, "NODE_LIMIT", 8)
    rng = np.random.default_rng(12)
    sigs = np.tile(rng.integers(0, 1 << 32, near_dup.COORDINATES, dtype=np.uint64).astype("<u4"), (400, 1))
    own = rng.random(sigs.shape) < 0.3
    sigs[own] = rng.integers(0, 1 << 32, own.sum(), dtype=np.uint64)
    sets = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sigs)], "node long, sig binary")
    sketches = sets.select("node", F.arrow_udf(near_dup._sketches, "binary")("sig").alias("sketch"))
    leaves, _ = near_dup.tree_nodes(sets, sketches)
    roots = near_dup.counted(sets.mapInArrow(near_dup._roots, "path bigint, node bigint")).count()
    assert 0 < leaves.count() <= roots


def test_links_to_pivots_grow_with_rows_only():
    rng = np.random.default_rng(3)
    linked = rng.random((3000, 8)) < np.array([0.9, 0.9, 0.8, 0.7, 0.7, 0.02, 0.02, 0])
    row, pivot = np.nonzero(linked)
    keep = near_dup.spanning(row, pivot - 8)
    assert keep.sum() <= 3000 + 64 < len(row)
    for a, b in ((row, pivot - 8), (row[:40], pivot[:40] - 8)):
        kept = near_dup.spanning(a, b)
        whole, fewer = common.least_of(a, b), common.least_of(a[kept], b[kept])
        assert all((x == y).all() for x, y in zip(whole, fewer))


def test_vector_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((300, 32))
    near = np.concatenate([centers + rng.standard_normal(centers.shape) * s for s in (0, 0.1, 0.15, 0.2, 0.25)])
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(near)], "vec_id long, embedding array<double>, label int")
    unit = near / np.linalg.norm(near, axis=1)[:, None]
    want = (unit @ unit.T >= 0.93).sum() - len(near)
    got = sum(r.n_links for r in embed_dup.near_duplicates(df).collect())
    assert 0.99 * want <= got <= want


def test_cover_tree_search_prunes_and_keeps_ties(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "TREE_ROWS", 100)
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.standard_normal((400, 6)), np.ones((50, 6))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    codes = np.floor(256 * vectors).astype(np.int64)
    want = set()
    for q in range(0, 450, 50):
        scores = codes @ codes[q]
        best = sorted((-scores[v], v) for v in range(450) if v != q)[:5]
        want |= {(q, k + 1, v, -s) for k, (s, v) in enumerate(best)}
    assert {tuple(r) for r in cover_tree.top_products(df).collect()} == want


def test_dual_tree_search_prunes_clusters_and_takes_each_vector_once():
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((40, 16)) * 10
    points = np.floor(256 * (centers[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16)) * 0.1))
    ids = np.arange(4000)
    order, root = cover_tree.cover_tree(points)
    stack = [root]
    while stack:  # every row lies in its ball, and children hold each row once
        node = stack.pop()
        away = np.sqrt(((points[order[node.low : node.high]] - node.center) ** 2).sum(1))
        assert away.max() <= node.radius * (1 + 1e-9) + 1e-9
        if node.children:
            assert [c.low for c in node.children] + [node.high] == [node.low] + [c.high for c in node.children]
            stack += node.children
    queries = ids[ids % 50 == 0]
    for count in (4000, 3):  # fewer vectors than the best asked for, too
        best, tree = cover_tree.Best(len(queries), 5), cover_tree.cover_tree(points[queries], cover_tree.QUERY_LEAF_ROWS)
        cover_tree.dual_search(points[queries], queries, points[:count], ids[:count], 5, best, tree)
        for row, place in enumerate(tree[0]):
            scores = points[:count] @ points[queries[place]]
            want = sorted((-s, v) for v, s in enumerate(scores) if v != queries[place])[:5]
            assert [(-s, v) for s, v in zip(best.scores[row], best.ids[row]) if s > -np.inf] == want
        if count == 4000:
            assert best.products < 0.25 * len(queries) * 4000


def test_repeated_passages_with_null_and_repeated_ids(spark):
    rows = [(None, story(20, 1) + " " + BASE), (None, BASE + " end"), (1, story(40, 8)), (1, story(40, 8)), (1, story(50, 7)), (2, None)]
    got = substrings.remove_recurring(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 seq"))
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got.collect()) == [(0, 201, 200), (0, 220, 200), (1, 40, 40), (1, 40, 40), (1, 50, 0), (2, 0, 0)]


def test_common_phrase_in_new_texts_is_dealt_to_shards(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_LIMIT", 4)
    phrase, passage = story(12, 30), story(38, 31)
    texts = [f"{story(40, 100 + k)} {phrase} {story(40, 200 + k)}" for k in range(40)]
    texts += [f"{passage} {phrase} {story(9, 300 + k)}" for k in range(3)] + [texts[0] + " end"]
    rows = list(enumerate(texts))
    count = collections.Counter(tuple(t.split()[i : i + 35]) for t in texts for i in range(len(t.split()) - 34))
    want = {}
    for k, text in rows:
        own = text.split()
        gone = {j for i in range(len(own) - 34) if count[tuple(own[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[k] = len(gone)
    got = substrings.remove_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == want and sum(want.values()) > 200


def test_pipeline_stages(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, hard)
        assert docs.columns == columns, name
    assert corpus_pipeline.run(spark, hard).count() > 0


def test_pipeline_stages_bound_the_batches_of_their_callers_job(spark):
    """300 texts of 100 KB are written in batches of 8 MB at most, not in one of 30 MB."""
    docs = spark.range(300, numPartitions=1).selectExpr("id doc_id", "repeat('ab cd efg ', 10000) text")
    before = spark.conf.get(common.BATCH_SETTING)
    for name, stage in corpus_pipeline.STAGES[-1:]:
        try:
            spark.conf.unset(common.BATCH_SETTING)
            stage(spark, docs.limit(2), "")
            sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
            assert max(r.n for r in sizes) <= 9 << 20 and len(sizes) >= 3
        finally:
            spark.conf.set(common.BATCH_SETTING, before)


def test_pipeline_drops_toxic_and_near_copies(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    left = [labels[r.doc_id] for r in clean.select("doc_id").collect() if r.doc_id in labels]
    assert sum(left) <= 0.1 * sum(labels.values()) and len(left) - sum(left) >= 0.99 * (len(labels) - sum(labels.values()))
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    once = corpus_pipeline.drop_near_duplicates(spark, clean, folder)
    assert once.count() == near_dup.near_duplicates(clean, 5).where("kept").count()


@pytest.mark.parametrize("n, width", [(2, 1), (2, 17), (3, 9), (3, 21), (4, 16), (4, 31), (2, 32), (4, 32)])
def test_quotient_filters_lose_nothing_and_merge(n, width):
    rng = np.random.default_rng(n * width)
    most = (1 << width) - 1
    ids = np.minimum(rng.zipf(1.3, (5000, n)), most).astype(np.uint64)
    ids[:3] = most
    shard_bits, parts, want = 3, collections.defaultdict(list), collections.Counter(map(tuple, ids.tolist()))
    want.update({tuple(ids[0].tolist()): 999})
    for low in range(0, 5000, 700):
        own = [ids[low : low + 700, k] for k in range(n)]
        left, right = quotient.permuted(*quotient.packed(own, width), n, width)
        assert (quotient.unpacked(*quotient.restored(left, right, n, width), n, width) == ids[low : low + 700]).all()
        counts = np.ones(len(left), np.int64)
        counts[0] += 999 if low == 0 else 0
        entries = quotient.counted(left, right, counts, n, width)
        shards = quotient.shard_of(entries[0], n, width, shard_bits)
        assert (np.diff(shards) >= 0).all()
        for shard in np.unique(shards):
            mine = tuple(e[shards == shard] for e in entries)
            raw = quotient.encoded(mine, n, width, shard_bits)
            back = quotient.decoded(raw, n, width, shard_bits)
            assert all((a == b).all() for a, b in zip(back, mine))
            parts[int(shard)].append(back)
    got = collections.Counter()
    for own in parts.values():
        left, right, counts = quotient.merged(own, n, width)
        got.update(dict(zip(map(tuple, quotient.unpacked(*quotient.restored(left, right, n, width), n, width).tolist()), counts.tolist())))
    assert got == want


def phrases_by_hand(rows, least, longest, contained, top):
    """Collocations as the contract says them, one phrase at a time."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", lower((text or "").encode())):
            own = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(own)
            f.update((lang, *own[i : i + m]) for m in range(1, longest + 1) for i in range(len(own) - m + 1))
    out = collections.defaultdict(list)
    often = {g: a for g, a in f.items() if a >= least}
    for (lang, *g), a in often.items():
        if len(g) < 2:
            continue
        cuts = [(2000000 * a // (f[lang, *g[:k]] + f[lang, *g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        around = [b for (other, *h), b in often.items() if other == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
        if not any(100 * b >= contained * a for b in around):
            out[lang].append((-score, -a, b" ".join(g), f[lang, *g[:k]], f[lang, *g[k:]]))
    return {(lang, rank, g.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for rank, (s, a, g, l, r) in enumerate(sorted(own)[:top], 1)}


def test_collocations_beside_counting_by_hand(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vocabulary = ["New", "york", "City", "of", "the", "élan", "ß", "a\u00a0b", "x", "Y"]
    rows = [(lang, " ".join(vocabulary[int(x)] + [" ", ", ", ".\n", "\t", " "][int(x) % 5] for x in rng.integers(0, 10, 60))) for lang in ("en", "de", None) for _ in range(40)]
    rows += [("en", "New york city of the " * 50), ("und", None), ("und", ""), (None, " \t\n"), ("fr", "seul")]
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 id", "2 word", "3 ids", "4 a", "5 block")
    monkeypatch.setattr(collocations, "BUFFER", 500)
    for least, top in ((5, 2000), (12, 7)):
        got = {tuple(r) for r in collocations.collocations(df, least, top=top).collect()}
        assert got == phrases_by_hand(rows, least, 4, 80, top) and len(got) >= 20


@pytest.mark.parametrize("n, width", [(2, 20), (4, 20)])
def test_merging_filters_keeps_no_copies(n, width):
    rng = np.random.default_rng(2)
    size = 200_000
    bits = quotient.half_bits(n, width)
    parts = [quotient.counted(*(rng.integers(0, 1 << b, size).astype(np.uint64) for b in bits), np.ones(size, np.int64), n, width) for _ in range(4)]
    own = sum(a.nbytes for part in parts for a in part)
    # The parts belong to the filters that are merged, so they count as well.
    tracemalloc.start()
    parts = [tuple(a.copy() for a in part) for part in parts]
    merged = quotient.merged(parts, n, width)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts == [] and merged[2].sum() == 4 * size
    assert peak < 2.5 * own


def test_texts_are_numbered_without_lists_of_a_blocks_words(spark):
    rows = [("en", " ".join(f"w{k % 40} rare{j}{k}." for k in range(200))) for j in range(6)] + [("de", "w1 nur hier"), ("de", "")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    blocks = collocations.tokens(docs).withColumn("block", F.monotonically_increasing_id()).localCheckpoint()
    words = collocations.vocabulary(blocks, 5)
    known = {(r.lang, r.word): r.id for r in words.collect()}
    made = collocations.numbered_texts(blocks, words)
    assert "collect_list" not in made._jdf.queryExecution().executedPlan().toString()
    got = collections.Counter(tuple(np.frombuffer(r.ids, np.uint32).tolist()) for r in made.collect())
    want = collections.Counter()
    for r in blocks.collect():
        table = [0, *(known.get(x, 0) for x in zip(r.langs, r.words))]
        want[tuple(table[c] for c in np.frombuffer(r.codes, np.int32))] += 1
    assert got == want and sum(want.values()) >= 2 and any(any(x) for x in want)


def merkle_by_hand(rows):
    """Leaves, subroots, root and proofs, level by level."""
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def enc(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def rise(nodes):
        sides = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for k, place in enumerate(at):
                low = place // 3 * 3
                sides[k].append((nodes[low:place], nodes[place + 1 : low + 3]))
            nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
            at = [place // 3 for place in at]
        return nodes[0], sides

    by_source = collections.defaultdict(list)
    for row in rows:
        by_source[row[1]].append((row[0], h(*map(enc, row)), row))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: rise([leaf for _, leaf, _ in sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in order}
    root, crown = rise([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (doc, leaf, row), sides in zip(sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), trees[s][1]):
            path = sides + crown[k]
            text = row[4].replace("\n", "") if doc is not None and row[4] is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else row[4]
            node = h(*map(enc, (*row[:4], text)))
            for left, right in path:
                node = h(*left, node, *right)
            out.append((doc, leaf, trees[s][0], root, h(*(x for left, right in path for x in left + right)), node, node == root))
    return collections.Counter(out)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_over_many_blocks(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    rows = [(k, None if k % 11 == 0 else "hot" if k % 3 else f"s{k % 29}", [None, "en"][k % 2], k, f"a\nb{k}" if k % 5 else None) for k in range(200)]
    rows += [(7, "hot", "en", 1, "again\n"), (7, "hot", "en", 1, "again\n"), (None, "hot", None, None, "x\n"), (None, "hot", None, None, "x\n"), (9, "", "en", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 grp", "2 pos", "3 node", "4 leaf", "5 path")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    made = manifest.manifest(df, tampered).withColumn("proof", manifest.proof_digest(F.col("path")))
    got = made.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()
    assert collections.Counter(map(tuple, got)) == merkle_by_hand(rows)


def test_line_rules_on_odd_texts(spark):
    prose = "This is a plain line of prose that ends as it should."
    good = "\n".join(f"This{k} line{k} has{k} its own{k} words{k} and ends{k} as{k} it should{k}." for k in range(12))
    texts = [None, "", " \n\t", good, good + "\nHome | About | Contact | Help", good.upper(), "\n".join([prose] * 12), "Home\n" * 200, good.replace(".", ""),
             good + "\nAll rights reserved.\nBUY NOW!! BUY NOW!! BUY NOW!!", "la " * 100000, " ".join(f"w{k}" for k in range(300000)) + ".", good.replace(" ", "*** ")]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 w", "2 s", "3 lines", "4 mask", "5 t")
    got = {r.doc_id: r for r in quality.clean(df).select("doc_id", "quality.*").collect()}
    assert [k for k, r in got.items() if r.kept] == [3, 4, 9, 11]
    assert got[4].cleaned == good and got[9].cleaned == good and got[4].removed.navigation == 1 and got[9].removed.boilerplate == 1 and got[9].removed.shouting == 1
    assert got[5].removed.shouting == 12 and got[8].removed.punctuation == 12 and got[12].removed.symbols == 12 and got[6].n_dup_lines == 11
    assert got[10].n_repeat_words == got[10].n_words == 100000 and got[10].base_failed
    assert got[11].n_words == 300000 and got[11].n_repeat_words == 0
    assert quality.clean(df).columns == [*df.columns, "quality"]
