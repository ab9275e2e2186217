"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsward.llm.common import Batches, column, components, running_total, runs, written
from newsward.llm.near_dup import least_label
from newsward.llm.vectors import matrix, usable

from newsward.session import stage

COSINE = 0.93
# Sign hashes per pass, in order of significance.
HASHES = 63
# Neighbours are compared in blocks of this many rows of the sorted order; blocks overlap
# by half, so each vector is compared with half a block to either side at least.
BLOCK = 512
# Wanted chance that a pair right at the threshold is missed by all passes.
MISS = 1e-3
# Vectors of one component are compared for the count of links in chunks of this size.
CHUNK = 512
SEED = 7


def passes_for(rows: int) -> int:
    """How many passes reach the wanted recall over ``rows`` vectors of one label.

    A pair at the threshold agrees in a sign hash with chance p = 1 - angle / pi. It
    meets in a block for sure if it agrees in the first log2(rows / half a block)
    hashes, which is the worst case of an even spread.
    """
    agree = 1 - math.acos(COSINE) / math.pi
    depth = max(0.0, math.log2(max(rows, 1) / (BLOCK / 2)))
    meets = agree**depth
    return 1 if meets >= 1 else math.ceil(math.log(MISS) / math.log1p(-meets))


def planes(number: int, dims: int) -> np.ndarray:
    return np.random.default_rng([SEED, number]).standard_normal((dims, HASHES))


def _keys(unit: np.ndarray, number: int) -> np.ndarray:
    bits = unit @ planes(number, unit.shape[1]) > 0
    return bits @ (1 << np.arange(HASHES - 1, -1, -1, dtype=np.int64))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows have a cosine of ``COSINE`` or more, in double precision."""
    return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]) >= COSINE


def _stars(node: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["src", "dst"])


def _compare_blocks(batches: Batches) -> Batches:
    for table in runs(batches, "block"):
        block, node, label = column(table, "block"), column(table, "node"), column(table, "label")
        vectors = matrix(table["embedding"])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        for low, high in zip(cuts[:-1], cuts[1:]):
            own = slice(low, high)
            links = linked(vectors[own], vectors[own]) & (label[own, None] == label[None, own])
            yield _stars(node[own], least_label(links))


def candidate_edges(distinct: DataFrame) -> DataFrame:
    """Verified links of the passes over ``distinct(node, label, embedding)``, as edges
    that join what each block holds together.

    Each pass orders the vectors by label and then by concatenated sign hashes of its own
    random projections. The order is cut into overlapping blocks; in each, all pairs are
    verified by their cosine.
    """
    largest = distinct.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    count = passes_for(largest)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            unit = _unit(matrix(batch.column(2)))
            for number in range(count):
                arrays = [pa.array(np.full(len(unit), number)), batch.column(1), pa.array(_keys(unit, number)), batch.column(0)]
                yield pa.RecordBatch.from_arrays(arrays, names=["pass", "label", "sort_key", "node"])

    keys = distinct.select("node", "label", "embedding").mapInArrow(run, "pass bigint, label bigint, sort_key bigint, node bigint")
    # Passes follow each other in one order; a block that holds the end of one and the
    # start of the next compares a few pairs more.
    placed = running_total(keys.withColumn("one", F.lit(1)), ["pass", "label", "sort_key", "node"], "one", "place")
    half = F.floor(F.col("place") / (BLOCK // 2))
    placed = placed.select("node", F.explode(F.array(half, half + 1)).alias("block"))
    rows = placed.join(distinct, "node").repartition("block").sortWithinPartitions("block")
    return rows.select("block", "node", "label", "embedding").mapInArrow(_compare_blocks, "src bigint, dst bigint").distinct()


def _count_links(batches: Batches) -> Batches:
    """Links of each vector of one chunk with those of another chunk of its component."""
    for table in runs(batches, "pair"):
        pair, side, node, copies = (column(table, n) for n in ("pair", "side", "node", "copies"))
        vectors = matrix(table["embedding"])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(pair)) + 1, [len(pair)]])
        for low, high in zip(cuts[:-1], cuts[1:]):
            left, right = (np.flatnonzero(side[low:high] == s) + low for s in (0, 1))
            if len(left) and len(right):
                links = linked(vectors[left], vectors[right])
                total = links @ copies[right]
                yield pa.RecordBatch.from_arrays([pa.array(node[left]), pa.array(total.astype(np.int64))], names=["node", "links"])


def link_counts(members: DataFrame) -> DataFrame:
    """``node, links``: how many vectors of its component each vector links with, copies
    and itself included. ``members(node, root, copies, embedding)``.

    A component is dealt to chunks and each chunk is held against each; only counts
    leave a task, never pairs.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("members"))
    placed = members.join(sizes, "root").withColumn("chunks", F.ceil(F.col("members") / CHUNK))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    left = placed.select("root", "node", "copies", "embedding", F.col("chunk").alias("a"), others.alias("b"), F.lit(0).alias("side"))
    right = placed.select("root", "node", "copies", "embedding", others.alias("a"), F.col("chunk").alias("b"), F.lit(1).alias("side"))
    both = left.union(right).withColumn("pair", F.xxhash64("root", "a", "b")).withColumn("side", F.col("side").cast("bigint"))
    dealt = both.select("pair", "side", "node", "copies", "embedding").repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(_count_links, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``rows(vec_id, embedding, label)``.

    Vectors of equal, non-null labels link at a cosine of 0.93 or more. Null, empty and
    zero vectors, those with null or non-finite components and those without a label
    link with nothing. Equal vectors of a label link and are compared as one. Vectors of
    different lengths are never compared. A null vec_id is a row of its own that names
    no component unless alone. Repeated ids are separate rows.
    """
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = usable(rows).where(F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0))
    node = F.xxhash64("label", F.transform("embedding", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    named = written(good.withColumn("node", node), "vectors")
    whole = named.groupBy("node").agg(F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    whole = written(whole, "distinct")
    widths = [row["width"] for row in whole.select(F.size("embedding").alias("width")).distinct().collect()]
    edges = None
    for width in widths:
        found = candidate_edges(whole.where(F.size("embedding") == width).select("node", "label", "embedding"))
        edges = found if edges is None else edges.union(found)
    if edges is None:
        edges = named.sparkSession.createDataFrame([], "src bigint, dst bigint")
    parts = stage(components(edges))
    counts = link_counts(parts.join(whole, "node").select("node", "root", "copies", "embedding"))
    ids = named.groupBy("node").agg(F.count("*").alias("copies"))
    summary = ids.join(parts, "node", "left").join(counts, "node", "left").select(
        "node", F.coalesce("root", "node").alias("class"), (F.coalesce("links", "copies") - 1).alias("n_links")
    )
    summary = stage(summary)
    linked_rows = named.select("vec_id", "node").join(summary, "node")
    least = linked_rows.groupBy("class").agg(F.min("vec_id").alias("least_id"))
    linked_rows = linked_rows.join(least, "class").select("vec_id", "n_links", F.coalesce("least_id", "vec_id").alias("component_id"))
    is_good = F.coalesce(_good(), F.lit(False))
    alone = rows.where(~is_good).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked_rows.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _good():
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine & F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)
