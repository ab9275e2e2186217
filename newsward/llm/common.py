"""Staging, running totals and connected components shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsward.session import scratch_path, stage

# monotonically_increasing_id() keeps the row number in its low 33 bits.
ROW_BITS = 33
Batches = Iterator[pa.RecordBatch]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Bytes of an Arrow batch while a table is written, and of text worked on at a time.
BATCH_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
ROW_GROUP_BYTES = 32 << 20


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the Arrow batches of a job by bytes, as rows may hold long texts."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session's later jobs too, as a result is computed when its
    caller writes it; a smaller bound stays, and one given with a unit."""
    own = spark.conf.get(BATCH_SETTING).rstrip("bB")
    if own.lstrip("-").isdigit() and not 0 < int(own) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a large intermediate table once to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        # A writer holds a row group in memory until it is full.
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def text_key() -> Column:
    """Names a document by its id and text, so that null and repeated ids do no harm."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("doc_key")


def running_total(df: DataFrame, order_by: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before this one in the order of ``order_by``.

    Rows are range-partitioned, sorted and staged; each partition sums its own rows and
    takes the total of the partitions before it from a table of one row per partition,
    so a value of ``order_by`` with many rows spreads over partitions if a later column
    tells its rows apart.
    """
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    staged = stage(ranged.withColumn("row_mark", F.monotonically_increasing_id()))
    part = F.shiftright("row_mark", ROW_BITS)
    sums = staged.groupBy(part.alias("row_part")).agg(F.sum(value).alias("part_sum"))
    before = Window.orderBy("row_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("row_part", F.coalesce(F.sum("part_sum").over(before), F.lit(0)).alias("part_before"))

    def cumulate(batches: Batches) -> Batches:
        total = 0
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(sizes) + total
            yield batch.append_column("own_before", pa.array(sums - sizes, pa.int64()))
            total = int(sums[-1]) if len(sums) else total

    schema = T.StructType([*staged.schema.fields, T.StructField("own_before", T.LongType())])
    own = staged.mapInArrow(cumulate, schema).withColumn("row_part", part)
    joined = own.join(F.broadcast(offsets), "row_part")  # one row per partition
    return joined.withColumn(name, F.col("own_before") + F.col("part_before")).drop(
        "own_before", "part_before", "row_part", "row_mark"
    )


# Edges that one task joins before the rounds of all tasks: 8 MB.
EDGES_PER_TASK = 1 << 19


def least_of(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of these edges, ascending, and the smallest node each one reaches."""
    nodes, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    src, dst = place[: len(src)], place[len(src) :]
    label = np.arange(len(nodes))
    while True:
        a, b = label[src], label[dst]
        if (a == b).all():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            new = label[label]
            if (new == label).all():
                break
            label = new


def _joined(batches: Batches) -> Batches:
    held = [(column(batch, "src"), column(batch, "dst")) for batch in batches if batch.num_rows]
    if held:
        node, root = least_of(*map(np.concatenate, zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(src, dst)``, long integers: a row ``(node, root)``
    for every node that has an edge, root being the smallest node reachable.

    Each task first joins its own edges, at most some ``EDGES_PER_TASK``, to trees of depth
    one. Where they took several tasks, alternating large-star and small-star steps follow:
    every step keeps the components and joins nodes to the smallest neighbour known, until
    each node hangs on its root. A node with very many edges is summed before the shuffle
    and its join can be split.
    """
    edges = stage(edges.where("src <> dst").select("src", "dst").distinct())
    tasks = -(-edges.count() // EDGES_PER_TASK)
    own = stage(edges.coalesce(max(1, tasks)).mapInArrow(_joined, "node bigint, root bigint"))
    if tasks <= 1:
        return own
    edges = own.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst"))
    state = None
    while True:
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        down = down.where("src <> dst").distinct()
        low = down.groupBy("src").agg(F.min("dst").alias("low"))
        small = down.join(low, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        step = small.union(low.select("src", F.col("low").alias("dst"))).distinct()
        edges = stage(step)
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        if row == state or row[0] == 0:
            break
        state = row
    roots = edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return roots.union(edges.select("dst", "dst").distinct())


# The largest filter that is sent to all tasks: 2**27 bits, 16 MB.
FILTER_BITS = 27


def key_filter(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that passes every value of the long column ``key`` and few others.

    One hash bit per key in a bit map of bounded size. With more keys than the bound
    serves well it passes more rows, and the join that follows stays right.
    """
    count = keys.count()
    bits = min(FILTER_BITS, max(16, (8 * count).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    words = keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask")
    )
    table = words.toArrow()  # at most 2**21 rows of two numbers
    masks = np.zeros(1 << (bits - 6), np.int64)
    masks[table["word"].to_numpy()] = table["mask"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(masks)

    def test(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    passes = F.arrow_udf(test, "boolean")
    return lambda value: passes(F.pmod(F.xxhash64(value), F.lit(1 << bits)))


def runs(batches: Batches, key: str) -> Iterator[pa.RecordBatch]:
    """Cut a sorted partition into tables that each hold whole runs of ``key``.

    A run that crosses Arrow batches is put together; a table holds many short runs.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        first = int(np.searchsorted(keys, keys[-1], "left"))
        if rest and rest[-1].column(batch.schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        if first > 0:
            yield pa.Table.from_batches([*rest, batch.slice(0, first)])
            rest = []
        rest.append(batch.slice(first))
    if rest:
        yield pa.Table.from_batches(rest)


def column(batch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy()


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def give_back() -> None:
    """Return freed memory to the machine: a worker lives on beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def in_slices(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str, most_bytes: int = SLICE_BYTES):
    """A mapInArrow function that hands ``work`` about a MB of text at a time and gives
    memory back after each batch, as a worker serves many stages."""
    from newsward.llm.words import slices

    def run(batches: Batches) -> Batches:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for low, high in slices(batch.column(at), most_bytes):
                out = work(batch.slice(low, high - low))
                if out is not None and out.num_rows:
                    yield out
            del batch
            give_back()

    return run
