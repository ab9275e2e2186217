"""Exact top-k inner products by a dual-tree search over cover trees."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsward.llm.common import Batches, column, runs
from newsward.llm.vectors import usable

TOP = 5
QUERY_STEP = 50
# Vectors per tree; trees are pairs of one query tree and one index tree at a time.
TREE_ROWS = 4096
LEAF_ROWS = 64
# Few queries make a small ball, which is what can be pruned against.
QUERY_LEAF_ROWS = 8
SHRINK = 0.7


@dataclass
class Node:
    """A ball: rows ``low`` to ``high`` of the tree's order lie within ``radius`` of ``center``."""

    low: int
    high: int
    center: np.ndarray
    radius: float
    length: float
    children: list["Node"] = field(default_factory=list)


def cover_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, Node]:
    """The tree's row order and its root.

    A node's rows are covered by centers that lie further than ``SHRINK`` times the
    radius apart and within it of their rows; each center's rows are a child. A node
    that does not split (all its rows alike) or is small is a leaf.
    """
    order = np.arange(len(points))

    def build(low: int, high: int, center: np.ndarray) -> Node:
        own = points[order[low:high]]
        radius = float(np.sqrt(((own - center) ** 2).sum(1).max()))
        node = Node(low, high, center, radius * (1 + 1e-9), float(np.sqrt((center**2).sum())))
        if high - low <= leaf_rows or radius == 0:
            return node
        reach = SHRINK * radius
        nearest = np.full(len(own), np.inf)
        child = np.zeros(len(own), np.int64)
        centers = 0
        # Farthest-first centers: separated by more than `reach`, covering within it.
        while centers < 64:
            at = 0 if centers == 0 else int(nearest.argmax())
            if centers and nearest[at] <= reach:
                break
            away = np.sqrt(((own - own[at]) ** 2).sum(1))
            closer = away < nearest
            child[closer] = centers
            nearest[closer] = away[closer]
            centers += 1
        if centers < 2:
            return node
        arranged = np.argsort(child, kind="stable")
        order[low:high] = order[low:high][arranged]
        edges = np.searchsorted(child[arranged], np.arange(centers + 1))
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                middle = points[order[low + a : low + b]].mean(0)
                node.children.append(build(low + a, low + b, middle))
        return node

    root = build(0, len(points), points.mean(0))
    return order, root


class Balls:
    """The nodes of a tree as arrays, the root first; a node's children follow one another."""

    def __init__(self, root: Node):
        nodes, at = [root], 0
        first, many = [], []
        while at < len(nodes):
            first.append(len(nodes))
            many.append(len(nodes[at].children))
            nodes += nodes[at].children
            at += 1
        self.first, self.many = np.array(first), np.array(many)
        self.low, self.high = (np.array([getattr(n, name) for n in nodes]) for name in ("low", "high"))
        self.centers = np.array([n.center for n in nodes])
        self.radius, self.length = (np.array([getattr(n, name) for n in nodes]) for name in ("radius", "length"))

    def least(self, values: np.ndarray) -> np.ndarray:
        """The smallest of each node's rows."""
        out = np.full(len(self.low), np.inf)
        for k in range(len(out) - 1, -1, -1):
            children = slice(self.first[k], self.first[k] + self.many[k])
            out[k] = out[children].min() if self.many[k] else values[self.low[k] : self.high[k]].min()
        return out


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    sizes = high - low
    return np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Best:
    """The best ``k`` of each query so far: scores down, ties by smaller id."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.products = 0

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some queries (rows) with some vectors (columns); -inf takes no part."""
        self.products += scores.size
        k = self.scores.shape[1]
        # Only what reaches a query's kth score can enter; mostly that is nothing.
        row, place = np.nonzero((scores >= self.scores[rows, -1][:, None]) & (scores > -np.inf))
        if len(row) == 0:
            return
        touched, own = np.unique(row, return_inverse=True)
        at = rows[touched]
        query = np.concatenate([own, np.repeat(np.arange(len(touched)), k)])
        values = np.concatenate([scores[row, place], self.scores[at].ravel()])
        names = np.concatenate([ids[place], self.ids[at].ravel()])
        order = np.lexsort((names, -values, query))
        counts = np.bincount(query)
        nth = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        chosen = order[nth < k]
        self.scores[at] = values[chosen].reshape(-1, k)
        self.ids[at] = names[chosen].reshape(-1, k)


def dual_search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, best: Best, tree) -> None:
    """Improve ``best`` (in the order of the query tree) by all of ``points``.

    Pairs of a query ball and an index ball are visited level by level; no inner product between them
    exceeds <q, r> + |q| R_r + |r| R_q + R_q R_r. A pair is pruned when that is below the
    worst kth score of the ball's queries; equal scores are still looked at, as a
    smaller id wins a tie. Each query leaf first looks at the most promising index leaf, which raises its
    kth scores; then the other pairs of leaves follow, the most promising first.
    """
    query_order, query_root = tree
    order, root = cover_tree(points)
    sorted_points, sorted_ids = points[order], ids[order]
    sorted_queries, own_ids = queries[query_order], query_ids[query_order]
    q, r = Balls(query_root), Balls(root)

    # The bound of every pair of balls; a tree's rows bound how many there are.
    bounds = q.centers @ r.centers.T + np.outer(q.length, r.radius) + np.outer(q.radius, r.length + r.radius)

    def alive(a: np.ndarray, most: np.ndarray) -> np.ndarray:
        return most * (1 + 1e-12) + 1e-6 >= q.least(best.scores[:, -1])[a]

    def visit(a: np.ndarray, b: np.ndarray) -> None:
        """All products of these pairs of leaves, an index leaf at a time."""
        if len(b) == 0:
            return
        by_leaf = np.argsort(b, kind="stable")
        a, b = a[by_leaf], b[by_leaf]
        cuts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
        for low, high in zip(cuts[:-1], cuts[1:]):
            rows = _ranges(q.low[a[low:high]], q.high[a[low:high]])
            part = slice(r.low[b[low]], r.high[b[low]])
            scores = sorted_queries[rows] @ sorted_points[part].T
            scores[own_ids[rows][:, None] == sorted_ids[None, part]] = -np.inf
            best.offer(rows, scores, sorted_ids[part])

    query_leaves, index_leaves = np.flatnonzero(q.many == 0), np.flatnonzero(r.many == 0)
    first = index_leaves[(q.centers[query_leaves] @ r.centers[index_leaves].T).argmax(1)]
    visit(query_leaves, first)
    bounds[query_leaves, first] = -np.inf  # seen
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    pairs = []
    while len(a):
        most = bounds[a, b]
        keep = alive(a, most)
        a, b, most = a[keep], b[keep], most[keep]
        done = (q.many[a] == 0) & (r.many[b] == 0)
        pairs.append((a[done], b[done], most[done]))
        a, b = a[~done], b[~done]
        # The ball that widens the bound more is opened.
        index = (r.many[b] > 0) & ((q.many[a] == 0) | (r.radius[b] * q.length[a] >= q.radius[a] * r.length[b]))
        many = np.where(index, r.many[b], q.many[a])
        child = _ranges(np.where(index, r.first[b], q.first[a]), np.where(index, r.first[b], q.first[a]) + many)
        index, a, b = np.repeat(index, many), np.repeat(a, many), np.repeat(b, many)
        a, b = np.where(index, a, child), np.where(index, child, b)
    a, b, most = (np.concatenate(parts) for parts in zip(*pairs))
    new = most > -np.inf
    a, b, most = a[new], b[new], most[new]
    order = np.lexsort((-most, a))
    a, b, most = a[order], b[order], most[order]
    counts = np.bincount(a, minlength=len(q.low))
    nth = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
    low = 0
    while low < counts.max(initial=0):
        high = max(4, 4 * low)
        now = (nth >= low) & (nth < high)
        now &= alive(a, most)
        visit(a[now], b[now])
        low = high


def quantised(rows: DataFrame) -> DataFrame:
    """``vec_id, width, codes``: components as floor(256 x) of the double x."""
    double = usable(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))

    def codes(vectors: pa.Array) -> pa.Array:
        flat = np.floor(256 * vectors.flatten().to_numpy(zero_copy_only=False))
        ends = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
        return pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())

    return double.select("vec_id", F.size("embedding").cast("bigint").alias("width"), F.arrow_udf(codes, "binary")("embedding").alias("codes"))


def _packed(rows: DataFrame, count: int) -> DataFrame:
    """Rows of a width gathered into trees of about ``TREE_ROWS`` rows, one row a tree."""
    import pyspark.sql.types  # noqa: F401

    parts = max(1, -(-count // TREE_ROWS))
    dealt = rows.withColumn("tree", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(parts)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        arrays = [table["width"].slice(0, 1), table["tree"].slice(0, 1), pa.array([column(table, "vec_id").tobytes()]), pa.array([b"".join(table["codes"].to_pylist())], pa.large_binary()).cast(pa.binary())]
        return pa.Table.from_arrays(arrays, names=["width", "tree", "ids", "codes"])

    return dealt.groupBy("width", "tree").applyInArrow(pack, "width bigint, tree bigint, ids binary, codes binary")


def top_products(rows: DataFrame, k: int = TOP, step: int = QUERY_STEP) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vec_id divisible by ``step`` the ``k``
    largest integer inner products with all other rows' vectors.

    Vectors that are null, empty or hold null or non-finite components, or have a null
    id, take no part; vectors of other lengths are no candidates. Ties go to the smaller
    vec_id. Repeated query ids are one query for each different vector, and the rows of
    the query's own id are no candidates. Integers up to 2**53 are exact in doubles.
    """
    from newsward.llm.common import written

    vectors = written(quantised(rows).where(F.col("vec_id").isNotNull()), "codes")
    asked = vectors.where(F.col("vec_id") % step == 0)
    counts = vectors.agg(F.count("*"), F.sum(F.expr(f"int(vec_id % {step} = 0)"))).first()
    index_trees = _packed(vectors, counts[0])
    query_trees = _packed(asked.distinct(), counts[1] or 0).select("width", F.col("tree").alias("query_tree"), F.col("ids").alias("query_ids"), F.col("codes").alias("query_codes"))
    # Blocks of queries against blocks of vectors: every pair of trees of a width.
    pairs = written(index_trees, "index").join(written(query_trees, "queries"), "width")

    def search(batches: Batches) -> Batches:
        last, best, tree, asked_ids = None, None, None, None
        for table in runs(batches, "query_tree"):
            for row in table.to_pylist():
                key = (row["width"], row["query_tree"])
                if key != last:
                    if best is not None:
                        yield found(best, tree, asked_ids)
                    queries = np.frombuffer(row["query_codes"]).reshape(-1, row["width"])
                    asked_ids = np.frombuffer(row["query_ids"], np.int64)
                    last, tree, best = key, cover_tree(queries, QUERY_LEAF_ROWS), Best(len(queries), k)
                points, ids = np.frombuffer(row["codes"]).reshape(-1, row["width"]), np.frombuffer(row["ids"], np.int64)
                dual_search(queries, asked_ids, points, ids, k, best, tree)
        if best is not None:
            yield found(best, tree, asked_ids)

    def found(best: Best, tree, asked_ids: np.ndarray) -> pa.RecordBatch:
        good = np.isfinite(best.scores)
        query = np.broadcast_to(np.arange(len(good))[:, None], good.shape)[good]
        number = tree[0][query]
        return pa.RecordBatch.from_arrays(
            [pa.array(asked_ids[number]), pa.array(number), pa.array(best.ids[good]), pa.array(best.scores[good].astype(np.int64))],
            names=["query_id", "number", "vec_id", "score"],
        )

    cores = max(1, -(-int(counts[0]) // TREE_ROWS))
    dealt = pairs.repartition(min(cores, 4096), "tree").sortWithinPartitions("width", "query_tree")
    schema = "query_id bigint, number bigint, vec_id bigint, score bigint"
    best = dealt.select("width", "query_tree", "query_ids", "query_codes", "tree", "ids", "codes").mapInArrow(search, schema)
    order = Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
