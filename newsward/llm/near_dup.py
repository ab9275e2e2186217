"""Near-duplicate documents by a chosen-path set similarity join.

Minhash signatures stand for shingle sets. Independent trees branch the documents by
chosen signature coordinates until nodes are small, small nodes are compared
exhaustively on sketches, and what looks similar is confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsward.llm.common import Batches, column, components, in_slices, key_filter, runs, text_key, written
from newsward.llm.words import LOWER, WORD, grams, mix, words
from newsward.session import stage

SIMILARITY = 80  # percent
COORDINATES = 64
TREES = 16
DEPTH = 5
NODE_LIMIT = 512
# Each document of a larger node is compared with this many of its documents first.
PIVOTS = 8
# Sketches that agree in this share with a pivot's stand for copies of it: they branch no further there.
ALIKE = 0.8
# Sketches that agree in this share are candidates: 3.6 standard deviations below 0.8.
LOOSE = 0.62
SEED = 11
_MULTIPLIERS = np.random.default_rng(SEED).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(text: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; shorter texts are one shingle."""
    hashes, _, _, first, _ = words(text, LOWER)
    out = []
    for low, high in zip(first[:-1], first[1:]):
        own = hashes[low:high]
        out.append(np.unique(grams(own, min(size, len(own)))) if len(own) else own)
    return out


def set_key(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the set under each of ``COORDINATES`` hash functions."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            out = np.minimum(out, (shingles[at : at + 4096, None] * _MULTIPLIERS).min(0))
    return (out >> np.uint64(32)).astype("<u4")


def signed(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, doc_key, n_shingles, node, sig``; ``node`` names the set, 0 shingles have none."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), size)
        counts = [len(s) for s in sets]
        nodes = [set_key(s) if len(s) else None for s in sets]
        sigs = [signature(s).tobytes() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary())],
            names=["doc_id", "doc_key", "n_shingles", "node", "sig"],
        )

    schema = "doc_id bigint, doc_key bigint, n_shingles bigint, node bigint, sig binary"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_key()).mapInArrow(in_slices(work, "text"), schema)


def _lots(paths: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(paths[:, None] * np.uint64(COORDINATES) + np.arange(COORDINATES, dtype=np.uint64))


def chosen(paths: np.ndarray) -> np.ndarray:
    """Which coordinates each root branches by: every one with the chance
    1 / (similarity * COORDINATES), as in the chosen-path tree, at least one."""
    lots = _lots(paths)
    mark = lots < np.uint64(int(2**64 / (SIMILARITY / 100 * COORDINATES)))
    mark[np.arange(len(paths)), lots.argmin(1)] = True
    return mark


def _stepped(paths: np.ndarray, coordinate: np.ndarray, values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(paths ^ mix(values.astype(np.uint64) * np.uint64(COORDINATES) + coordinate.astype(np.uint64)))


def children(paths: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child paths of documents with these root paths and signatures."""
    row, coordinate = np.nonzero(chosen(paths))
    return row, _stepped(paths[row], coordinate, sigs[row, coordinate])


def child(paths: np.ndarray, sigs: np.ndarray) -> np.ndarray:
    """The one child of a large node that each document goes to, so that no level has more
    rows than the one above. A document's 24 or so paths through the trees, not children of
    children, make up for the pairs that a level parts."""
    coordinate = _lots(paths).argmin(1)
    return _stepped(paths, coordinate, sigs[np.arange(len(paths)), coordinate])


def _matrix(batch: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    data = b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist())
    return np.frombuffer(data, kind).reshape(batch.num_rows, -1)


def _descend(batches: Batches) -> Batches:
    """The nodes of each document on the levels below its own: one row a document, whatever its node's size."""
    for batch in batches:
        if batch.num_rows:
            path, sigs = column(batch, "path").view(np.uint64), _matrix(batch, "sig", "<u4")
            below = np.empty((len(path), DEPTH - 1), np.int64)
            for level in range(DEPTH - 1):
                path = child(path, sigs)
                below[:, level] = path.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(path) + 1) * (DEPTH - 1), pa.int32()), pa.array(below.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "node")), lists], names=["node", "below"])


def _roots(batches: Batches) -> Batches:
    trees = mix(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(SEED))
    for batch in batches:
        node, sigs = column(batch, "node"), _matrix(batch, "sig", "<u4") if batch.num_rows else None
        for tree in trees if batch.num_rows else ():
            row, child = children(np.full(len(node), tree), sigs)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(node[row])], names=["path", "node"])


def counted(rows: DataFrame) -> DataFrame:
    """Rows of nodes with more than one document, with the node's count.

    The counts are written first: a join of plain shuffles is one that Spark splits where
    a node is very large, which it does not where one side is summed on the same key.
    """
    counts = rows.groupBy("path").agg(F.count("*").alias("members")).where("members > 1")
    return rows.join(written(counts, "counts"), "path")


def _lot() -> Column:
    """A number from 0 to 1 for a document of a node, the same in every run."""
    return F.pmod(F.xxhash64("path", "node", F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)


def spanning(row: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Which links from ascending rows to pivots keep all components: the first of each row,
    and one for each two pivots that a row links, its first and another."""
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    first = to[np.flatnonzero(new)][np.cumsum(new) - 1]
    _, once = np.unique(np.stack([first, to]), axis=1, return_index=True)
    new[once] = True
    return new


def _beside_pivots(batches: Batches) -> Batches:
    need = np.array([LOOSE, ALIKE]) * COORDINATES
    for batch in batches:
        node, own = column(batch, "node"), batch.column(batch.schema.get_field_index("sketch"))
        sketch = np.frombuffer(b"".join(own.to_pylist()), np.uint8).reshape(batch.num_rows, COORDINATES)
        lists = batch.column(batch.schema.get_field_index("pivots"))
        counts = np.diff(lists.offsets.to_numpy())
        pivots = lists.flatten()
        pivot_node = pivots.field("node").to_numpy()
        pivot_sketch = np.frombuffer(b"".join(pivots.field("sketch").to_pylist()), np.uint8).reshape(len(pivots), COORDINATES)
        row = np.repeat(np.arange(batch.num_rows), counts)
        same = np.empty(len(row), np.int64)
        for low in range(0, len(row), 1 << 16):
            part = slice(low, low + (1 << 16))
            same[part] = (sketch[row[part]] == pivot_sketch[part]).sum(1)
        other = pivot_node != node[row]
        linked = other & (same >= need[0])
        # A document leaves for a pivot of smaller number only, so that of pivots alike one stays.
        leaves = np.zeros(batch.num_rows, bool)
        is_pivot = np.zeros(batch.num_rows, bool)
        is_pivot[row[~other]] = True
        leaves[row[(same >= need[1]) & other & (~is_pivot[row] | (pivot_node < node[row]))]] = True
        row, to = row[linked], pivot_node[linked]
        needed = spanning(row, to)
        many = np.bincount(row[needed], minlength=batch.num_rows)
        links = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.array(to[needed]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array(~leaves), links], names=["path", "node", "stays", "links"])


def eased(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """``path, node, stays, links`` of the documents of large nodes, beside some pivots of
    their node, about ``PIVOTS`` each.

    ``links`` are pivots that look similar, as many as join all that do. A copy of a pivot is in its loose component now, and
    that is compared whole later; it needs no place further down this tree, where the pivot stands for it.
    """
    lots = large.where(_lot() < F.lit(PIVOTS) / F.col("members")).join(sketches, "node")
    pivots = written(lots.groupBy("path").agg(F.collect_list(F.struct("node", "sketch")).alias("pivots")), "pivots")
    beside = large.select("path", "node").join(sketches, "node").join(pivots, "path", "left")
    rows = beside.select("path", "node", "sketch", F.coalesce("pivots", F.array().cast("array<struct<node:bigint,sketch:binary>>")).alias("pivots"))
    return stage(rows.mapInArrow(_beside_pivots, "path bigint, node bigint, stays boolean, links array<bigint>"))


def tree_nodes(sets: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``path, node, members`` of the leaves of all trees, and edges ``src, dst`` found on the way.

    A node is large that would be compared in more than two parts. It first loses the copies
    of its pivots; what stays large then branches on, level by level, until it is small or
    ``DEPTH`` levels down.
    """
    most = 2 * NODE_LIMIT
    level = stage(counted(sets.select("node", "sig").mapInArrow(_roots, "path bigint, node bigint")))
    leaves = level.where(F.col("members") <= most)
    edges = level.select(F.col("node").alias("src"), F.col("node").alias("dst")).where("false")
    large = level.where(F.col("members") > most)
    if not large.take(1):
        return leaves, edges
    told = eased(large, sketches)
    edges = told.select(F.col("node").alias("src"), F.explode("links").alias("dst"))
    level = written(counted(told.where("stays").select("path", "node")), "level")
    leaves = leaves.union(level.where(F.col("members") <= most))
    large = level.where(F.col("members") > most).join(sets.select("node", "sig"), "node").select("path", "node", "sig")
    large = written(large.mapInArrow(_descend, "node bigint, below array<bigint>"), "below")
    for depth in range(DEPTH - 1):
        if not large.take(1):
            return leaves, edges
        level = written(counted(large.select(F.col("below")[depth].alias("path"), "node", "below")), "level")
        leaves = leaves.union(level.where(F.col("members") <= most).select("path", "node", "members"))
        large = level.where(F.col("members") > most)
    return leaves.union(large.select("path", "node", "members")), edges


def groups(leaves: DataFrame) -> DataFrame:
    """``group_key, node``: a leaf is a group. One that is still large is dealt to parts and
    every two parts are a group, so that all its documents are compared, over many tasks."""
    parts = F.ceil(F.col("members") / NODE_LIMIT)
    own = F.pmod(F.xxhash64("node"), parts)
    dealt = leaves.select("path", "node", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("other"))
    key = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(key.alias("group_key"), "node")


def least_label(links: np.ndarray) -> np.ndarray:
    """Components of a small graph: the first row reachable from each row."""
    label = np.arange(len(links))
    links = links | np.eye(len(links), dtype=bool)
    while True:
        new = np.where(links, label[None, :], len(label)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare_sketches(batches: Batches) -> Batches:
    for table in runs(batches, "group_key"):
        key, node = column(table, "group_key"), column(table, "node")
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(key), -1)
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, sizes = np.append(0, cuts), np.diff(np.concatenate([[0], cuts, [len(key)]]))
        need = LOOSE * sketch.shape[1]
        src, dst = [], []
        for size in np.unique(sizes):
            if size < 2:
                continue
            at = starts[sizes == size]
            if size <= 8:  # all groups of a size at once
                for i in range(size):
                    for j in range(i + 1, size):
                        alike = (sketch[at + i] == sketch[at + j]).sum(1) >= need
                        src.append(node[at[alike] + i])
                        dst.append(node[at[alike] + j])
                continue
            for start in at:
                own = sketch[start : start + size]
                links = np.zeros((size, size), bool)
                for i in range(size):
                    links[i] = (own == own[i]).sum(1) >= need
                label = least_label(links)
                moved = np.flatnonzero(label != np.arange(size))
                src.append(node[start + moved])
                dst.append(node[start + label[moved]])
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])


def confirm(sets: list[np.ndarray]) -> np.ndarray:
    """Exact links between full sets: intersections of all pairs as matrix products over
    slices of the shingles that more than one set holds."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(count), sizes)
    shingles, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(often > 1) - 1
    keep = often[place] > 1
    owner, place = owner[keep], shared[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((count, count))
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        a, b = np.searchsorted(place, [low, low + 4096])
        part = np.zeros((count, min(4096, int(place[-1]) + 1 - low)), np.float32)
        part[owner[a:b], place[a:b] - low] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    return 100 * common >= SIMILARITY * union


def _confirm_groups(batches: Batches) -> Batches:
    for table in runs(batches, "group_key"):
        key, node = column(table, "group_key"), column(table, "node")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        src, dst = [], []
        for low, high in zip(cuts[:-1], cuts[1:]):
            if high - low > 1:
                sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].slice(low, high - low).to_pylist()]
                label = least_label(confirm(sets))
                moved = np.flatnonzero(label != np.arange(high - low))
                src.append(node[low + moved])
                dst.append(node[low + label[moved]])
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])


def _by_group(rows: DataFrame, compare) -> DataFrame:
    dealt = rows.repartition("group_key").sortWithinPartitions("group_key", "node")
    return dealt.mapInArrow(compare, "src bigint, dst bigint").distinct()


def full_sets(docs: DataFrame, rows: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``root, node, shingles`` of the sets in loose components, once each."""
    holders = rows.where("node is not null").groupBy("node").agg(F.min("doc_key").alias("doc_key")).join(members, "node")
    holders = written(holders, "holders")
    passes = key_filter(holders.select("doc_key"), "doc_key")
    texts = docs.select(text_key(), "text").where(passes(F.col("doc_key"))).join(holders, "doc_key")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), size)
        node = column(batch, "node")
        # Two texts may share a key by chance.
        right = np.array([len(s) > 0 and set_key(s) == n for s, n in zip(sets, node)], bool)
        arrays = [batch.column(3), batch.column(2), pa.array([s.tobytes() for s in sets], pa.binary())]
        return pa.RecordBatch.from_arrays([a.filter(pa.array(right)) for a in arrays], names=["root", "node", "shingles"])

    schema = "root bigint, node bigint, shingles binary"
    return texts.select("doc_key", "text", "node", "root").mapInArrow(in_slices(work, "text"), schema).dropDuplicates(["node"])


def confirmed_edges(sets: DataFrame, members: DataFrame) -> DataFrame:
    """True links within loose components, as edges that keep their components.

    A component is compared exhaustively. A large one is dealt to chunks: each chunk is
    compared with itself and with chunk 0; what is then outside the largest part is
    compared with every chunk, so each pair not yet joined is looked at.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("members"))
    chunks = F.ceil(F.col("members") / NODE_LIMIT)
    own = F.pmod(F.xxhash64("node", F.lit(SEED)), chunks)
    placed = written(sets.join(sizes, "root").withColumn("chunks", chunks).withColumn("chunk", own), "sets")
    to = F.when(F.col("chunk") == 0, F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    first = placed.select("root", "node", "shingles", F.explode(to).alias("part"))
    first = first.select(F.xxhash64("root", "part").alias("group_key"), "node", "shingles")
    edges = stage(_by_group(first, _confirm_groups))
    large = placed.where("chunks > 1")
    if not large.select("node").take(1):
        return edges
    parts = components(edges)
    labelled = large.select("root", "node", "chunk", "chunks").join(parts.withColumnRenamed("root", "component"), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    most = labelled.groupBy("root", "component").agg(F.count("*").alias("n")).groupBy("root").agg(F.max(F.struct("n", "component")).alias("top"))
    rest = labelled.join(most, "root").where("component <> top.component").select("node")
    rest = stage(rest)
    if not rest.take(1):
        return edges
    odd = large.join(rest, "node").withColumn("lot", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / NODE_LIMIT)))
    lots = odd.groupBy("root").agg(F.collect_set("lot").alias("lots"))  # at most one per chunk
    sent = odd.select("root", "node", "shingles", "lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("part"))
    base = large.join(lots, "root").select("root", "node", "shingles", F.explode("lots").alias("lot"), F.col("chunk").alias("part"))
    both = base.union(sent.select("root", "node", "shingles", "lot", "part")).select(
        F.xxhash64("root", "part", "lot").alias("group_key"), "node", "shingles"
    )
    return edges.union(_by_group(both, _confirm_groups))


def classes_of(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, doc_key, n_shingles, class`` for every row; rows of no text have no class."""
    rows = written(signed(docs, size), "signed")
    sets = stage(rows.where("node is not null").groupBy("node").agg(F.first("sig").alias("sig")))
    sketch = F.arrow_udf(_sketches, "binary")
    sketches = sets.select("node", sketch("sig").alias("sketch"))
    leaves, edges = tree_nodes(sets, sketches)
    loose = components(_by_group(groups(leaves).join(sketches, "node"), _compare_sketches).union(edges))
    members = stage(loose.select("node", "root"))
    edges = confirmed_edges(full_sets(docs, rows, members, size), members)
    links = components(edges).withColumnRenamed("root", "linked")
    named = rows.select("doc_id", "doc_key", "n_shingles", "node")
    # Rows of no text join nothing, or they would meet in one task.
    joined = named.where("node is not null").join(links, "node", "left").select("doc_id", "doc_key", "n_shingles", F.coalesce("linked", "node").alias("class"))
    return joined.union(named.where("node is null").select("doc_id", "doc_key", "n_shingles", F.col("node").alias("class")))


def near_duplicates(docs: DataFrame, size: int = 4) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Texts whose sets of ``size``-word shingles have a Jaccard similarity of 0.8 or more
    are linked; a component is named by its smallest doc_id, whose row is kept. Null and
    empty texts have no shingles and are alone; equal sets are one from the start, so
    copies are never compared. Rows of one doc_id with other texts are judged each by
    its text. A null doc_id names a component only if no other id does, and is not kept.
    """
    named = written(classes_of(docs, size), "classes")
    classed = named.where("class is not null")
    # Written first, so that the join is one of plain shuffles and Spark splits a large class.
    least = written(classed.groupBy("class").agg(F.min("doc_id").alias("least_id")), "least")
    out = classed.join(least, "class").select("doc_id", "n_shingles", F.coalesce("least_id", "doc_id").alias("component_id"))
    out = out.union(named.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return out.select("doc_id", "n_shingles", "component_id", kept)


def one_of_each(docs: DataFrame, size: int = 5) -> DataFrame:
    """The rows of ``docs`` with one of each class of near-duplicates, the smallest
    doc_id; rows without text all stay."""
    named = classes_of(docs, size).where("class is not null")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_key")
    chosen = written(named.groupBy("class").agg(F.min(first).alias("first")).select(F.col("first.doc_key").alias("doc_key")).distinct(), "chosen")
    passes = key_filter(chosen, "doc_key")
    keyed = docs.select(F.struct(*docs.columns).alias("own_row"), text_key())
    has_words = F.coalesce(F.col("own_row.text").rlike(WORD), F.lit(False))
    # Only rows that stay are shuffled; of rows equal in id and text one is enough.
    held = keyed.where(has_words & passes(F.col("doc_key"))).groupBy("doc_key").agg(F.first("own_row").alias("own_row"))
    held = held.join(chosen, "doc_key", "left_semi")
    return keyed.where(~has_words).union(held.select("own_row", "doc_key")).select("own_row.*")


def _sketches(sigs: pa.Array) -> pa.Array:
    data = np.frombuffer(b"".join(sigs.to_pylist()), "<u4").reshape(len(sigs), -1)
    # Eight mixed bits of each coordinate tell two values apart all but once in 256.
    return pa.array([x.tobytes() for x in (mix(data.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)], pa.binary())
