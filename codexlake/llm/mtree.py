"""Exact top-k by inner product over M-trees: paged metric nodes and best-first search.

Inner products become distances by one added component: with M the largest norm
of a tree, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0), |q' - x'|^2 is
|q|^2 + M^2 - 2 q.x. A node page holds entries with their distance to the node's
own routing object and their covering radius, so many entries are ruled out
before their distance is computed. Scores are integers and computed exactly;
bounds are rounded outwards.

The top page is distributed: vectors go to the shard of their nearest pivot (of a
bounded sample), crowded shards are dealt into parts of about ``SHARD`` rows, and
each part gets a tree. A query first searches a tree of its own shard. The k-th
score found there is its floor, and it is sent to the other trees of only those
shards whose pivot and covering radius leave room for a score that high. A block
of queries goes down a tree together: a page is taken once, for the queries whose
bound reaches it.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, tidy, unit_hash
from .vectors import matrix, usable

#: Entries of a page; rows of a tree; queries that go down a tree together; most pivots, and sampled rows for each.
PAGE, SHARD, BLOCK, PIVOTS, SAMPLE = 128, 8_192, 8_192, 256, 16
_SLACK = 1e-6
#: Scores below this are exact as doubles, and below the next one as 64-bit integers.
_DOUBLE, _LONG = 2.0**52, 2.0**62


class Node:
    """A page. Leaves hold row numbers, inner nodes children and their covering radii."""

    __slots__ = ("points", "to_parent", "radius", "children", "rows")

    def __init__(self, points, to_parent, radius=None, children=None, rows=None):
        self.points, self.to_parent = points, to_parent
        self.radius, self.children, self.rows = radius, children, rows


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def useful_copies(ids: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Rows that a search for k can return, of rows sorted by vector (``group``) and id.

    A search leaves out one id, so of equal vectors k rows of an id and 2 k rows in all are enough.
    """
    def nth(key_changes):
        begin = np.flatnonzero(key_changes)
        return np.arange(len(key_changes)) - np.repeat(begin, np.diff(np.r_[begin, len(key_changes)]))

    if not len(ids):
        return np.empty(0, np.int64)
    new = np.r_[True, group[1:] != group[:-1]]
    rows = np.flatnonzero(nth(new | np.r_[True, ids[1:] != ids[:-1]]) < k)
    kept = group[rows]
    return rows[nth(np.r_[True, kept[1:] != kept[:-1]]) < 2 * k]


class MTree:
    """Bulk-loaded over integer vectors, for searches of at most ``k``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, page: int = PAGE):
        order = np.lexsort((ids, *vectors.T))
        ids, vectors = ids[order], vectors[order]
        group = np.cumsum(np.r_[False, (vectors[1:] != vectors[:-1]).any(1)]) if len(ids) else np.empty(0, np.int64)
        rows = useful_copies(ids, group, k)
        self.ids, self.vectors = ids[rows], vectors[rows]
        x = self.vectors.astype(float)
        norms = (x * x).sum(1)
        self.most = float(norms.max(initial=0.0))
        self.x = np.c_[x, np.sqrt(np.maximum(self.most - norms, 0.0))]
        self.page = page
        self.root = self._build(np.arange(len(x)), self.x.mean(0) if len(x) else None)
        self.x = None

    def _build(self, rows: np.ndarray, routing) -> Node:
        points = self.x[rows]
        if len(rows) <= self.page:
            return Node(points, np.linalg.norm(points - routing, axis=1) if len(rows) else np.empty(0), rows=rows)
        k = min(self.page, -(-len(rows) // self.page) + 1)
        near = distances(points, points[np.linspace(0, len(rows) - 1, k).astype(int)]).argmin(1)
        parts = [rows[near == j] for j in range(k) if (near == j).any()]
        if len(parts) == 1:  # equal points: any even split will do
            parts = np.array_split(rows, k)
        centres = np.stack([self.x[p].mean(0) for p in parts])
        radius = np.array([np.linalg.norm(self.x[p] - c, axis=1).max() for p, c in zip(parts, centres)])
        children = [self._build(p, c) for p, c in zip(parts, centres)]
        return Node(centres, np.linalg.norm(centres - routing, axis=1), radius, children)

    def scores(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products of integer vectors, as numbers that compare exactly."""
        largest = float(np.sqrt((queries.astype(float) ** 2).sum(1).max(initial=0.0) * self.most))
        if largest < _DOUBLE:
            return queries.astype(float) @ self.vectors[rows].astype(float).T
        if largest < _LONG:
            return queries @ self.vectors[rows].T
        return queries.astype(object) @ self.vectors[rows].astype(object).T

    def search(self, queries: np.ndarray, owns: np.ndarray, k: int, floors: np.ndarray | None = None):
        """For each query its k best (score, id), ties to the smaller id, without its own id; none below its floor."""
        best: list[list[tuple]] = [[] for _ in owns]
        if not len(self.ids):
            return best
        q = np.c_[queries.astype(float), np.zeros(len(queries))]
        base = (q * q).sum(1) + self.most
        worst = np.full(len(q), -np.inf) if floors is None else floors.astype(float).copy()

        def ceiling(who, apart):
            apart = np.maximum(apart, 0.0)
            return (base[who][:, None] - apart * apart) / 2 + (_SLACK * base[who] + _SLACK)[:, None]

        pages = [(-np.inf, 0, self.root, np.arange(len(q)), None, None)]
        count = 0
        while pages:
            _, _, node, who, apart, tops = heapq.heappop(pages)
            at = np.arange(len(node.points))
            if tops is not None:
                live = tops >= worst[who]
                who, apart = who[live], apart[live]
                reach = node.radius if node.children else 0.0
                may = ceiling(who, np.abs(apart[:, None] - node.to_parent) - reach) >= worst[who][:, None]
                who, at = who[may.any(1)], at[may.any(0)]
            if not len(who) or not len(at):
                continue
            if node.children:
                d = distances(q[who], node.points[at])
                bounds = ceiling(who, d - node.radius[at])
                for column, i in enumerate(at.tolist()):
                    some = np.flatnonzero(bounds[:, column] >= worst[who])
                    if len(some):
                        count += 1
                        top = bounds[some, column]
                        heapq.heappush(pages, (-top.max(), count, node.children[i], who[some], d[some, column], top))
                continue
            rows = node.rows[at]
            scores, ids = self.scores(queries[who], rows), self.ids[rows]
            hits = (scores >= worst[who][:, None]) & (ids != owns[who][:, None])
            for i in np.flatnonzero(hits.any(1)).tolist():
                own = best[who[i]]
                columns = np.flatnonzero(hits[i])
                own += zip((-scores[i, columns]).tolist(), ids[columns].tolist())
                own.sort()
                del own[k:]
                if len(own) == k:
                    worst[who[i]] = max(worst[who[i]], -own[-1][0])
        return [[(int(-s), i) for s, i in own] for own in best]


def _assign(rows: DataFrame, sent) -> DataFrame:
    """Adds the shard of each vector's nearest pivot and the distance to it."""
    names = ["vec_id", "v", "size", "shard", "apart"]

    def run(batches):
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            shard, apart = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                first, pivots = sent.value[size]
                d = distances(matrix(batch.column(1).take(pa.array(own))).astype(float), pivots)
                shard[own] = first + d.argmin(1)
                apart[own] = d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(apart)], names)

    return rows.mapInArrow(tidy(run), "vec_id long, v array<long>, size int, shard int, apart double")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best partners of each query by integer inner product.

    Components become ``floor(scale * x)``. Queries are the rows whose id is
    divisible by ``every``; rows with the query's id are its own and left out.
    Ties go to the smaller id; fewer rows give fewer partners. Vectors that are
    null, empty or hold null or non-finite components take no part, nor do null
    ids; vectors of different lengths are not compared. A repeated id counts as a
    candidate each time but as one query, with the least of its vectors. Components and scores
    beyond 64 bits count as the nearest 64-bit number. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    rows = checkpointed(rows.select("vec_id", whole.alias("v"), F.size("v").alias("size")))
    totals = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    pivots, first = {}, 0
    for size, n in sorted(totals.items()):
        wanted = min(PIVOTS, -(-n // SHARD))
        found = np.zeros((1, size))
        if wanted > 1:
            share = min(1.0, SAMPLE * wanted / n)
            some = rows.where((F.col("size") == size) & (unit_hash("vec_id", seed=3) < share)).limit(2 * SAMPLE * wanted)
            some = some.toArrow().sort_by("vec_id")["v"]
            if len(some):
                found = np.unique(matrix(some).astype(float)[:: max(1, len(some) // wanted)], axis=0)
        pivots[size] = first, found
        first += len(found)
    sent = spark.sparkContext.broadcast(pivots)
    placed = checkpointed(_assign(rows, sent))
    page = placed.groupBy("shard").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()
    radius, parts = np.full(first, -np.inf), np.zeros(first, np.int64)
    for r in page:
        radius[r["shard"]], parts[r["shard"]] = r["radius"], -(-r["n"] // SHARD)
    crowded = spark.createDataFrame([(i, n) for i, n in enumerate(parts.tolist())], "shard int, parts int")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part")
    dealt = placed.join(F.broadcast(crowded), "shard").select("shard", part, "vec_id", "v")

    def build(key, group):
        tree = MTree(group["vec_id"].to_numpy(), matrix(group["v"]).astype(np.int64), k)
        blob = pa.array([pickle.dumps(tree, protocol=5)], pa.binary())
        return pa.table([pa.array([x.as_py()], pa.int32()) for x in key] + [blob], ["shard", "part", "tree"])

    trees = dealt.groupBy("shard", "part").applyInArrow(build, "shard int, part int, tree binary")
    trees = checkpointed(trees)
    queries = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("size", "v", "shard")).alias("q"))
    queries = checkpointed(queries.select("vec_id", "q.size", "q.v", "q.shard"))
    blocks = max(1, -(-queries.count() // BLOCK))
    block = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int").alias("block")

    def search(left, right):
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            tree = pickle.loads(left["tree"][0].as_py())
            owns, floors = right["vec_id"].to_numpy(), right["floor"].to_numpy(zero_copy_only=False).astype(float)
            found = tree.search(matrix(right["v"]).astype(np.int64), owns, k, np.where(np.isnan(floors), -np.inf, floors))
            for own, items in zip(owns.tolist(), found):
                for score, vec in items:
                    for c, v in zip(out, (own, vec, min(max(score, -(2**63)), 2**63 - 1))):
                        c.append(v)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    def searched(asked: DataFrame) -> DataFrame:
        """Results of queries (vec_id, v, shard, part, floor) in the trees that they are sent to."""
        keys = ["shard", "part", "block"]
        copies = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asked.select("vec_id", "v", "shard", "part", block, "floor").groupBy(*keys)
        return copies.groupBy(*keys).cogroup(right).applyInArrow(search, "query_id long, vec_id long, score long")

    home = queries.select("vec_id", "v", "shard", F.lit(0).alias("part"), F.lit(None).cast("double").alias("floor"))
    at_home = checkpointed(searched(home))
    reached = F.when(F.count("*") >= k, F.min("score").cast("double"))
    floors = at_home.groupBy(F.col("query_id").alias("vec_id")).agg(reached.alias("floor"))
    bounds = spark.sparkContext.broadcast((pivots, radius, parts))

    def route(batches):
        """The trees that may hold a score of a query's floor or more, but for the one searched at home."""
        pivots, radius, parts = bounds.value
        first_part = np.cumsum(parts) - parts
        shard_of = np.repeat(np.arange(len(parts)), parts)
        for whole in batches:
            step = max(1, 20_000 // max(1, len(shard_of)))  # rows sent at a time, not all of a batch's
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                floor = np.nan_to_num(batch.column(4).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                sizes, own = batch.column(1).to_numpy(), batch.column(3).to_numpy()
                sends = np.zeros((len(sizes), len(parts)), bool)
                for size in np.unique(sizes).tolist():
                    some = np.flatnonzero(sizes == size)
                    begin, centres = pivots[size]
                    far = radius[begin : begin + len(centres)]
                    q = matrix(batch.column(2).take(pa.array(some))).astype(float)
                    norm = np.linalg.norm(q, axis=1)[:, None]
                    reach = np.maximum(far, 0)
                    top = q @ centres.T + norm * reach
                    top += _SLACK * (1 + norm * (norm + reach + np.linalg.norm(centres, axis=1)))
                    sends[some, begin : begin + len(centres)] = (top >= floor[some][:, None]) & (far >= 0)
                to_tree = sends[:, shard_of]
                to_tree[np.arange(len(own)), first_part[own]] = False
                row, tree = np.nonzero(to_tree)
                taken = pa.array(row)
                shard = shard_of[tree]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(taken), batch.column(2).take(taken), pa.array(shard.astype(np.int32)),
                     pa.array((tree - first_part[shard]).astype(np.int32)), batch.column(4).take(taken)],
                    ["vec_id", "v", "shard", "part", "floor"],
                )

    routed = queries.select("vec_id", "size", "v", "shard").join(floors, "vec_id", "left")
    routed = routed.mapInArrow(tidy(route), "vec_id long, v array<long>, shard int, part int, floor double")
    found = at_home.union(searched(routed))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
