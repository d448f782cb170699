"""Nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: each node splits it at the median of a random direction. Every row gets its leaf
in each tree. A query walks all trees through one priority queue, nearest cells first (squared distance to the planes it has
crossed), until the leaves seen cover the asked share of the rows; the rows of those leaves are reranked exactly. Rows and
queries meet in blocks of equal size, whatever the leaves hold, and a block yields a query's best rows only.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; equal scores go to the smaller id; fewer rows than asked for give all; an empty table gives an empty table. Rows that
repeat an id are candidates each, except for the query of that id. Other columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlake.llm.store import stored

#: Rows that the trees are fitted on, and how far they split: both bound what every task is sent.
SAMPLE, LEAF = 20_000, 100
TREES = 6
#: Share of all rows that a query's leaves shall cover, and rows at least (small tables are searched whole).
COVER, LEAST = 0.7, 4_000
ROWS_BLOCK, QUERIES_BLOCK = 8_192, 2_048
SEED = 11


def clean(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    fit = rows.filter("vec_id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x)"
                      " AND abs(x) < double('infinity')) AND exists(vector, x -> x != 0)")
    common = fit.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return fit.filter(F.size("vector") == (common[0] if common else 0))


class Forest:
    """Trees as arrays: planes, thresholds and children; a negative child -1 - j is leaf j of its tree."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            planes, cuts, children, leaves = [], [], [], 0
            todo = [(np.arange(len(sample)), None, 0)]
            root = None
            while todo:
                rows, parent, side = todo.pop()
                name, at = None, None
                if len(rows) > leaf:
                    plane = rng.standard_normal(sample.shape[1])
                    plane /= np.linalg.norm(plane)
                    at = sample[rows] @ plane
                    cut = float(np.median(at))
                    if (at <= cut).any() and (at > cut).any():
                        name = len(planes)
                        planes.append(plane)
                        cuts.append(cut)
                        children.append([0, 0])
                        todo += [(rows[at > cut], name, 1), (rows[at <= cut], name, 0)]
                if name is None:
                    name, leaves = -1 - leaves, leaves + 1
                if parent is None:
                    root = name
                else:
                    children[parent][side] = name
            dims = sample.shape[1]
            self.trees.append((root, np.array(planes).reshape(-1, dims), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), leaves))
        self.first = np.concatenate([[0], np.cumsum([t[4] for t in self.trees])]).astype(np.int64)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """Leaf numbers, counted over all trees: one column a tree."""
        out = np.empty((len(rows), len(self.trees)), np.int32)
        for t, (root, planes, cuts, children, _) in enumerate(self.trees):
            todo = [(root, np.arange(len(rows)))]
            while todo:
                node, some = todo.pop()
                if node < 0:
                    out[some, t] = self.first[t] - 1 - node
                elif len(some):
                    right = rows[some] @ planes[node] > cuts[node]
                    todo += [(int(children[node, 0]), some[~right]), (int(children[node, 1]), some[right])]
        return out

    def search(self, query: np.ndarray, share: np.ndarray, cover: float) -> np.ndarray:
        """Bits of the leaves to visit. share: part of all rows in each leaf."""
        bits = np.zeros(self.first[-1], bool)
        heap = [(0.0, t, tree[0]) for t, tree in enumerate(self.trees)]
        away = [tree[1] @ query - tree[2] for tree in self.trees]
        open_ = np.ones(len(self.trees))  # share of the rows not yet covered, by tree
        while heap and 1 - open_.prod() < cover:
            far, t, node = heapq.heappop(heap)
            if node < 0:
                number = self.first[t] - 1 - node
                bits[number] = True
                open_[t] = max(0.0, open_[t] - share[number])
                continue
            distance = float(away[t][node])
            left, right = self.trees[t][3][node]
            heapq.heappush(heap, (far + max(distance, 0.0) ** 2, t, int(left)))
            heapq.heappush(heap, (far + max(-distance, 0.0) ** 2, t, int(right)))
        return bits


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(rows: DataFrame, count: int, sample: int = SAMPLE) -> Forest:
    """On the rows whose hashed id falls under the sample's share, at most ``sample`` of them."""
    share = min(1_000_000, -(-sample * 1_000_000 // max(1, count)))
    some = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share).limit(sample).select("vector").toArrow()
    column = some.column(0).combine_chunks()
    return Forest(_matrix(column if isinstance(column, pa.Array) else column.chunk(0)))


def _best(query_ids, queries, bits, ids, rows, leaves, k) -> tuple[list, list, list]:
    scores = queries @ rows.T
    allowed = np.zeros(scores.shape, bool)
    for t in range(leaves.shape[1]):
        allowed |= bits[:, leaves[:, t]]
    allowed &= query_ids[:, None] != ids[None, :]
    scores[~allowed] = -np.inf
    out_q, out_v, out_s = [], [], []
    edge = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    for i, low in enumerate(edge):
        near = np.flatnonzero((scores[i] >= low - 1e-9 * max(1.0, abs(low))) & allowed[i]) if np.isfinite(low) else np.flatnonzero(allowed[i])
        exact = (rows[near] * queries[i]).sum(1)  # the same order of additions for every row
        order = np.lexsort((ids[near], -exact))[:k]
        out_q += [int(query_ids[i])] * len(order)
        out_v += ids[near][order].tolist()
        out_s += exact[order].tolist()
    return out_q, out_v, out_s


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding",
               cover: float = COVER, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = stored(clean(vectors, key, vector), "forest-rows")
    count = rows.count()
    if not count:
        return spark.createDataFrame([], schema)
    forest = spark.sparkContext.broadcast(fit(rows, count))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = forest.value.leaves(_matrix(batch.column("vector")))
                width = found.shape[1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(
                    pa.array(np.arange(0, found.size + 1, width, dtype=np.int32)), pa.array(found.ravel()))],
                    names=["vec_id", "vector", "leaves"])

    placed = stored(rows.mapInArrow(assign, "vec_id long, vector array<double>, leaves array<int>"), "forest-leaves")
    filled = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()  # a row a leaf
    share = np.zeros(forest.value.first[-1])
    for leaf, n in filled:
        share[leaf] = n / count
    shares = spark.sparkContext.broadcast(share)
    asked = max(cover, min(1.0, least / count))
    row_blocks, query_blocks = -(-count // ROWS_BLOCK), -(-count // (QUERIES_BLOCK * every))

    def pack_rows(table: pa.Table) -> pa.Table:
        t = table.combine_chunks().to_batches()[0]
        return pa.table({"row_block": t.column("block").slice(0, 1), "ids": pa.array([t.column("vec_id").to_numpy().tobytes()], pa.binary()),
                         "rows": pa.array([_matrix(t.column("vector")).tobytes()], pa.binary()),
                         "leaves": pa.array([_matrix(t.column("leaves")).tobytes()], pa.binary())})

    def pack_queries(table: pa.Table) -> pa.Table:
        t = table.combine_chunks().to_batches()[0]
        queries = _matrix(t.column("vector"))
        whole = 2.0 if asked >= 1 else asked  # above one: every leaf
        bits = np.stack([forest.value.search(q, shares.value, whole) for q in queries])
        return pa.table({"query_block": t.column("block").slice(0, 1),
                         "query_ids": pa.array([t.column("vec_id").to_numpy().tobytes()], pa.binary()),
                         "queries": pa.array([queries.tobytes()], pa.binary()),
                         "bits": pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary())})

    def best(table: pa.Table) -> pa.Table:
        q, v, s = [], [], []
        for r in table.to_pylist():
            ids, query_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["query_ids"], np.int64)
            data, queries = np.frombuffer(r["rows"]).reshape(len(ids), -1), np.frombuffer(r["queries"]).reshape(len(query_ids), -1)
            bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8).reshape(len(query_ids), -1), axis=1, count=int(forest.value.first[-1])).astype(bool)
            for low in range(0, len(query_ids), 256):
                found = _best(query_ids[low:low + 256], queries[low:low + 256], bits[low:low + 256], ids, data,
                              np.frombuffer(r["leaves"], np.int32).reshape(len(ids), -1), k)
                q, v, s = q + found[0], v + found[1], s + found[2]
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    def blocked(df: DataFrame, blocks: int) -> DataFrame:
        return df.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int"))

    packed = blocked(placed, row_blocks).groupBy("block").applyInArrow(
        pack_rows, "row_block int, ids binary, rows binary, leaves binary")
    asking = stored(blocked(placed.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select("vec_id", "vector"),
                            query_blocks).groupBy("block").applyInArrow(
        pack_queries, "query_block int, query_ids binary, queries binary, bits binary"), "forest-queries")
    met = asking.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))).join(packed, "row_block")
    found = met.groupBy("row_block", "query_block").applyInArrow(best, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
