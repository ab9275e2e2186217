"""One registered query per operator, with an SQL oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsward.llm import block_labels, collocations, cover_tree, embed_dup, extraction, lattice, manifest, mixing, near_dup, packing, quality, scoring, substrings, toxicity, urls
from newsward.llm.common import crc_of_id, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle.strip()
        return function

    return register


RULES_SQL = "(VALUES " + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES) + ") AS r(verdict, rule_host, prefix)"


def _judged(source: str) -> str:
    """Host, path, rule and verdict of the column url of ``source``."""
    return rf"""
    SELECT u.*, r.rule_host || r.prefix AS rule, r.verdict AS own FROM (
      SELECT *, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM {source}) u
    LEFT JOIN {RULES_SQL} ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, prefix)
    QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY len(rule_host) + len(prefix) DESC NULLS LAST) = 1"""


@query(
    "op7_redirect_equivalence",
    rf"""
WITH RECURSIVE p AS (SELECT page_id, url, row_number() OVER () AS row_no FROM pages),
tags AS (
  SELECT url, unnest(list_concat(
    list_transform(regexp_extract_all(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical["''\s/>][^>]*>?', 0, 'is'), lambda t: regexp_extract(t, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is')),
    list_transform(regexp_extract_all(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh["''\s/>][^>]*>?', 0, 'is'), lambda t: regexp_extract(t, '\burl\s*=\s*[''"]?([^''"\s>;]+)', 1, 'is'))
  )) AS link FROM pages),
edges AS (
  SELECT DISTINCT regexp_replace(url, '#.*$', '', 's') AS src, regexp_replace(CASE
      WHEN contains(link, '://') THEN link
      WHEN starts_with(link, '//') THEN regexp_extract(url, '^(.*?):', 1, 's') || ':' || link
      WHEN starts_with(link, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || link END, '#.*$', '', 's') AS dst
  FROM tags WHERE link <> ''),
linked AS (SELECT src, dst FROM edges WHERE dst IS NOT NULL UNION SELECT dst, src FROM edges WHERE dst IS NOT NULL),
reach AS (SELECT src, dst FROM linked UNION SELECT reach.src, linked.dst FROM reach JOIN linked ON reach.dst = linked.src),
nodes AS (SELECT dst AS url, row_number() OVER () AS row_no FROM (SELECT DISTINCT dst FROM reach)),
voted AS ({_judged('nodes')}),
classes AS (SELECT src, bool_or(own = 'allow') AS some_allow, bool_or(own = 'block') AS some_block
  FROM reach JOIN voted ON voted.url = reach.dst GROUP BY src)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN some_block AND NOT coalesce(some_allow, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM ({_judged('p')}) j LEFT JOIN classes ON classes.src = regexp_replace(j.url, '#.*$', '', 's')
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query(
    "op9_fair_queue",
    rf"""
WITH sizes AS (SELECT doc_id, source, {WORDS} AS size FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
placed AS (SELECT *, CAST([5000, 2000, 1000][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS BIGINT) AS w,
  row_number() OVER (ORDER BY source IS NULL, source) AS place FROM per_source),
filled AS (SELECT *, 2.0::DOUBLE * source_size AS "limit",
  coalesce(sum(source_size) OVER win, 0) AS size_before, coalesce(sum(w) OVER win, 0) AS weight_before,
  sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_weight
  FROM placed WINDOW win AS (ORDER BY source_size::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rates AS (SELECT *, (1.5::DOUBLE * all_size::DOUBLE - 2.0::DOUBLE * size_before::DOUBLE) / (all_weight - weight_before)::DOUBLE AS rate FROM filled),
opened AS (SELECT arg_min(rate, (source_size::DOUBLE / w, place)) AS rate FROM rates WHERE rate * w <= "limit"),
goals AS (SELECT source, source_size, least("limit", coalesce(opened.rate * w, "limit")) AS target FROM rates, opened),
lined AS (SELECT row_number() OVER () AS r, doc_id, size, sizes.source, source_size, target, sum(size) OVER (PARTITION BY sizes.source
  ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, '-') || ':' || size) ROWS UNBOUNDED PRECEDING) AS through
  FROM sizes JOIN goals ON sizes.source IS NOT DISTINCT FROM goals.source),
items AS (SELECT *, (through + epoch * source_size)::DOUBLE / target AS finish FROM lined, range(0, 2) e(epoch) WHERE target > 0 AND size > 0),
queue AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, source IS NULL, source, through + epoch * source_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM items),
served AS (SELECT r, sum(least(size, greatest((SELECT round(1.5::DOUBLE * sum(size)::DOUBLE) FROM sizes)::BIGINT - before, 0))) AS taken FROM queue GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM lined LEFT JOIN served USING (r)
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_hilbert_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_kneser_ney_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = F.coalesce(crc_of_id() % toxicity.FOLDS == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


@query("op5_lattice_likelihood")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = lattice.existing_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return scoring.score_texts(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), vocabulary, group="lang")


@query(
    "op3_chosen_path",
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN hash(array_to_string(ws, ' ')) ELSE hash(ws[i], ws[i+1], ws[i+2], ws[i+3]) END AS h
  FROM w, range(1, 1 + greatest(1, len(ws) - 3)) r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low.y, w.doc_id)) AS component_id,
  w.doc_id <= coalesce(low.y, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = w.doc_id
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "op6_repeated_phrases",
    r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, md5(array_to_string(ws[i:i+34], ' ')) AS h FROM w, range(1, len(ws) - 33) t(i) WHERE len(ws) >= 35),
rep AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + j AS k FROM rep, range(0, 35) t(j)),
kept AS (SELECT w.r, k, ws[k] AS word FROM w, range(1, len(ws) + 1) t(k) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = w.r AND gone.k = t.k)),
joined AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS words FROM kept GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM w LEFT JOIN joined USING (r)
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_recurring(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "op2_cover_tree",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.c::DOUBLE[], v.c::DOUBLE[])::BIGINT AS score
  FROM v q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.c) = len(v.c))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_products(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query(
    "op4_sorted_projections",
    """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.r AS x, b.r AS y FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x),
low AS (SELECT reach.x, min(v.vec_id) AS low FROM reach JOIN v ON v.r = reach.y GROUP BY reach.x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(vec_id, low), vec_id) AS component_id, coalesce(vec_id = coalesce(least(vec_id, low), vec_id), false) AS kept
FROM v LEFT JOIN n ON n.x = v.r LEFT JOIN low ON low.x = v.r
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dup.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query("op1_block_labels")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"), block_labels.trained())


def _line_sql() -> str:
    """The rules of a line as DuckDB says them; the marks and phrases are the operator's parameters."""
    def count(characters) -> str:
        return f"len(regexp_extract_all(x, '[{''.join(characters)}]'))"

    after = quality.AFTER_MARK.replace("'", "''")
    marks = ", ".join(f"'{m}'" for m in quality.MARKS)
    return f"""(regexp_matches(lower(x), '{"|".join(quality.BOILERPLATE)}')
      OR 24 * {count(quality.SEPARATORS)} >= greatest(len(x), 48)
      OR (len(x) < {quality.SHORT} AND right(rtrim(x, '{after}'), 1) NOT IN ({marks}))
      OR 10 * {count(quality.SYMBOLS)} > len(x)
      OR (len(x) >= {quality.SHORT} AND (12 * {count('!')} > len(x) OR (NOT regexp_matches(x, '[aeiou]') AND regexp_matches(x, '[AEIOU]'))))
      OR NOT regexp_matches(x, '[{"".join(quality.MARKS)}]'))"""


@query(
    "op12_line_first_rules",
    rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
lines AS (SELECT r, unnest(list_distinct(lines)) AS x FROM w),
stay AS (SELECT r, sum(len(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM lines WHERE NOT {_line_sql()} GROUP BY r),
windows AS (SELECT r, i, ws[i] AS a, ws[i+1] AS b, ws[i+2] AS c FROM w, range(1, len(ws) - 1) t(i) WHERE len(ws) >= 3),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(0, 3) t(j) GROUP BY r),
m AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(stay.chars, 0) AS chars
  FROM w LEFT JOIN covered ON covered.r = w.r LEFT JOIN stay ON stay.r = w.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (word_chars - chars) <= {quality.MOST_LOST} * word_chars AS kept
FROM m
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.clean(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[f"quality.{name}" for name in names])


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR END"


def _crc_sql(value: str) -> str:
    """crc32 of an ASCII string, bit by bit."""
    bit = "list_reduce([xor(a, b)]::BIGINT[] || range(8), lambda s, i: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)"
    return f"xor(4294967295, list_reduce([4294967295]::BIGINT[] || list_transform(string_split({value}, ''), lambda x: ascii(x)::BIGINT), lambda a, b: {bit}))"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if name == "text" else name) for name in manifest.FIELDS) + ")"


@query(
    "op13_merkle_manifest",
    rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf_sql('text')} AS leaf,
    CASE WHEN crc32_even THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS changed
  FROM (SELECT *, coalesce({_crc_sql('doc_id::VARCHAR')} % 2 = 0, false) AS crc32_even FROM documents)),
leaves AS (SELECT r, dense_rank() OVER (ORDER BY source IS NOT NULL, source) AS grp,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS node FROM d),
up AS (SELECT 0 AS level, grp, pos, n, node FROM leaves
  UNION ALL SELECT level + 1, grp, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, grp, pos // 3, n),
subs AS (SELECT grp, node FROM up WHERE n = 1),
crown AS (SELECT 0 AS level, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, node FROM subs
  UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 3, n),
tree AS (SELECT level, grp, pos, n, node FROM up UNION ALL SELECT 1000 + level, 0, pos, n, node FROM crown),
sides AS (SELECT t.level, t.grp, t.pos, coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos < t.pos), '') AS lefts,
    coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos > t.pos), '') AS rights
  FROM tree t JOIN tree o ON o.level = t.level AND o.grp = t.grp AND o.pos // 3 = t.pos // 3 WHERE t.n > 1 GROUP BY ALL),
steps AS (SELECT r, l.grp, 0 AS level, l.grp AS tree_grp, l.pos, d.changed AS node, '' AS proof FROM leaves l JOIN d USING (r)
  UNION ALL SELECT s.r, s.grp, CASE WHEN e.level IS NULL THEN 1000 ELSE s.level + 1 END, CASE WHEN e.level IS NULL THEN 0 ELSE s.tree_grp END,
    CASE WHEN e.level IS NULL THEN s.grp - 1 ELSE s.pos // 3 END,
    CASE WHEN e.level IS NULL THEN s.node ELSE sha256(e.lefts || s.node || e.rights) END, s.proof || coalesce(e.lefts || e.rights, '')
  FROM steps s LEFT JOIN sides e ON e.level = s.level AND e.grp = s.tree_grp AND e.pos = s.pos WHERE e.level IS NOT NULL OR s.level < 1000),
ends AS (SELECT r, node, proof FROM steps QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1)
SELECT d.doc_id, d.leaf, subs.node AS subroot, (SELECT node FROM crown WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
  ends.node AS folded_root, ends.node = (SELECT node FROM crown WHERE n = 1) AS verified
FROM d JOIN leaves USING (r) JOIN subs USING (grp) JOIN ends USING (r)
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*manifest.FIELDS)
    tampered = F.when(crc_of_id() % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = manifest.manifest(docs, tampered)
    return rows.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


@query(
    "op11_quotient_collocations",
    r"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^\x20\x09]+') AS ws FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
grams AS MATERIALIZED (SELECT lang, ws[i:i+m-1] AS g, count(*) AS f FROM p, range(1, 5) s(m), range(1, len(ws) + 1) t(i) WHERE i + m - 1 <= len(ws) GROUP BY lang, g HAVING count(*) >= 30),
halves AS (SELECT lang, g, f AS a, k, g[1:k] AS x, g[k+1:len(g)] AS y FROM grams, range(1, 4) t(k) WHERE k < len(g)),
cuts AS (SELECT h.*, gx.f AS l, gy.f AS r, ((2000000::HUGEINT * a) // (gx.f::HUGEINT + gy.f))::BIGINT AS score
  FROM halves h JOIN grams gx ON gx.lang = h.lang AND gx.g = h.x JOIN grams gy ON gy.lang = h.lang AND gy.g = h.y),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
around AS (SELECT lang, g[i:i+m-1] AS g, max(f) AS f FROM grams, range(2, 4) s(m), range(1, 4) t(i) WHERE m < len(g) AND i + m - 1 <= len(g) GROUP BY ALL),
stay AS (SELECT best.* FROM best LEFT JOIN around USING (lang, g) WHERE NOT coalesce(100::HUGEINT * around.f >= 80::HUGEINT * a, false))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM stay JOIN totals USING (lang) QUALIFY rank <= 2000
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("lang", "text"))
