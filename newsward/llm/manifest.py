"""Merkle manifest of a dataset: a digest per row, per source and of all, with proofs.

Nodes of a level are kept by aligned blocks, each as one string of 64 hex digits per node.
Parents are hashes of fixed-width substrings of that string, the siblings in a proof are what
stands beside a node in its substring. The roots of blocks are the nodes of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsward.llm.common import ROW_BITS, written

ARITY = 3
LEVELS = 6  # levels inside a block
BLOCK = ARITY**LEVELS
HEX = 64
RUN = HEX * ARITY
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE, SIBLINGS = "node", "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, ``:`` and the value; so fields can't run together."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(columns[name]) for name in FIELDS]), 256)


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Add ``place``, the number of rows before each in ``order``.

    Rows are range-partitioned, sorted and written; a row's number within its partition is
    then known, and a table of one row per partition adds the rows of the ones before it.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(ranged.withColumn("row_mark", F.monotonically_increasing_id()), name)
    part = F.shiftright("row_mark", ROW_BITS)
    counts = kept.groupBy(part.alias("row_part")).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("row_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("row_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"))
    within = F.col("row_mark").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    placed = kept.withColumn("row_part", part).join(F.broadcast(offsets), "row_part")
    return placed.withColumn("place", F.col("rows_before") + within).drop("row_part", "rows_before", "row_mark")


def blocks_of(nodes: DataFrame) -> DataFrame:
    """``grp, block, n, items, levels`` of ``nodes(grp, pos, n, node, item)``.

    ``n`` counts the nodes of the group. A group of one block is folded until one node is
    left; in a larger one every block rises the same ``LEVELS`` levels, to one node each.
    """
    row = F.struct("pos", NODE, "item")
    blocks = nodes.groupBy("grp", F.expr(f"pos div {BLOCK}").alias("block"), "n").agg(F.sort_array(F.collect_list(row)).alias("items"))

    def parents(level: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
        return F.array_join(F.transform(starts, lambda k: F.sha2(F.substring(level, k * RUN + 1, F.lit(RUN)), 256)), "")

    def rise(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        done = (F.col("n") <= BLOCK) & (F.length(top) == HEX)
        return F.when(done, levels).otherwise(F.concat(levels, F.array(parents(top))))

    string = F.array_join(F.transform("items", lambda x: x[NODE]), "")
    return blocks.withColumn("levels", F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(string), rise))


def roots_of(blocks: DataFrame) -> DataFrame:
    """The blocks' roots as nodes of the next round."""
    count = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n")
    return blocks.select("grp", F.col("block").alias("pos"), count, F.element_at("levels", -1).alias(NODE), F.lit(None).cast("string").alias("item"))


def climb(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """Written tables of blocks, from the nodes up to one block per group of at most ``most`` nodes."""
    tables = []
    while True:
        tables.append(written(blocks_of(nodes), f"{name}-{len(tables)}"))
        if most <= BLOCK:
            return tables
        nodes, most = roots_of(tables[-1]), -(-most // BLOCK)


def descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``grp, pos, node, item, path`` of every node, from ``above(grp, block, path)`` of its block's root.

    A path holds, level by level from the node up, what stands to the left and to the right
    of it in its run. Runs are cut from a level once, not once for each node.
    """
    def cut(level: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
        return F.transform(starts, lambda k: F.substring(level, k * RUN + 1, F.lit(RUN)))

    below = F.slice("levels", 1, F.size("levels") - 1)
    runs = blocks.select("grp", "block", F.explode(F.array(F.struct("items", F.transform(below, cut).alias("runs")))).alias("b"))
    joined = runs.join(above, ["grp", "block"])
    powers = F.array(*[F.lit(ARITY**k) for k in range(LEVELS + 1)])

    def flanks(place: Column):
        def flank(level_runs: Column, k: Column) -> Column:
            at = F.floor(place / F.element_at(powers, k + 1)).cast("int")
            run = F.element_at(level_runs, F.floor(at / ARITY).cast("int") + 1)
            own = (at % ARITY) * HEX
            return F.struct(F.substring(run, F.lit(1), own).alias("left"), F.substring(run, own + HEX + 1, F.lit(RUN)).alias("right"))

        return flank

    def with_path(item: Column, place: Column) -> Column:
        own = F.transform(F.col("b.runs"), flanks(place)).cast(SIBLINGS)
        return F.struct(item["pos"].alias("pos"), item[NODE].alias(NODE), item["item"].alias("item"), F.concat(own, F.col("path")).alias("path"))

    return joined.select("grp", F.explode(F.transform("b.items", with_path)).alias("x")).select("grp", "x.*")


def paths(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """The paths of a climb's first nodes, given ``top(grp, path)`` of each group's root."""
    above = top.select("grp", F.lit(0).cast("bigint").alias("block"), "path")
    for blocks in reversed(tables[1:]):
        above = descend(blocks, above).select("grp", F.col("pos").alias("block"), "path")
    return descend(tables[0], above)


def folded(node: Column, path: Column) -> Column:
    """The root that ``node`` and its siblings lead to."""
    return F.aggregate(path, node, lambda at, p: F.sha2(F.concat(p["left"], at, p["right"]), 256))


def digests(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """``doc_id, source, leaf, changed_leaf`` of every row; ``changed_text`` is what a copy
    to be checked holds as text, the row's own if not given."""
    own = docs.select(F.struct(*[F.col(c) for c in FIELDS]).alias("r"), (F.lit(None) if changed_text is None else changed_text).alias("t"))
    columns = {name: F.col(f"r.{name}") for name in FIELDS}
    first = leaf(columns)
    second = first if changed_text is None else F.when(F.col("t").eqNullSafe(F.col("r.text")), F.lit(None)).otherwise(leaf({**columns, "text": F.col("t")}))
    return own.select("r.doc_id", F.col("r.source").cast("string").alias("source"), first.alias("leaf"), second.alias("changed_leaf"))


def manifest(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, path, folded_root, verified`` for every row of ``docs``.

    ``docs`` needs the columns of ``FIELDS`` and may have others. Leaves of a source ascend
    by doc_id, null first; equal ids by their leaf, so repeated rows have neighbouring places. Null
    sources form a source of their own, the first. A source of one row has its leaf as subroot, a single
    source its subroot as root. No rows give no root. ``path`` lists the siblings level by level;
    ``folded_root`` comes from the changed text's leaf and that path.

    A block has at most ``BLOCK`` nodes, whatever the source's share; only digests are
    shuffled, and each round of blocks is written before the next reads it.
    """
    ids = ["doc_id", "source", "leaf", "changed_leaf"]
    leaves = written(digests(docs, changed_text), "leaves")
    placed = numbered(leaves, [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf")], "leaves-placed")
    starts = placed.groupBy("source").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    sources = numbered(starts, [F.asc("start")], "sources").withColumnRenamed("place", "grp")
    biggest, count = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    of = placed.alias("p").join(sources.alias("s"), F.expr("p.source <=> s.source"))
    item = F.struct("p.doc_id", "p.source", F.col("p.changed_leaf").alias("changed_leaf")).alias("item")
    nodes = of.select("s.grp", (F.col("p.place") - F.col("s.start")).alias("pos"), "s.n", F.col("p.leaf").alias(NODE), item)
    trees = climb(nodes, biggest, "source-tree")
    subroots = roots_of(trees[-1]).select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("pos"), F.lit(count).cast("bigint").alias("n"), NODE, F.lit(None).cast("string").alias("item"))
    crown = climb(subroots, count, "crown")
    last = roots_of(crown[-1]).select("grp", NODE)
    root = last.first()  # the one root
    top = last.select("grp", F.expr(f"cast(array() as {SIBLINGS})").alias("path"))
    of_sources = written(paths(crown, top).select(F.col("pos").alias("grp"), F.col(NODE).alias("subroot"), "path"), "subroots")
    rows = paths(trees, of_sources.select("grp", "path")).join(of_sources.select("grp", "subroot"), "grp").withColumn("root", F.lit(root[NODE] if root else None))
    changed = F.coalesce("item.changed_leaf", NODE)
    done = rows.select("item.doc_id", "item.source", F.col(NODE).alias("leaf"), "subroot", "root", "path", folded(changed, F.col("path")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings of a path, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)
