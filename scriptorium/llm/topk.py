"""Exact top-k inner-product search by ball trees."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Vectors of a shard, queries that one task has in its memory for a shard, and vectors of a leaf, about.
SHARD, BLOCK, LEAF = 16384, 131_072, 64
#: Most regions that vectors are dealt into; their centres are all that is sent around.
REGIONS = 4096
#: Regions of a query, by falling bounds, that have been searched after each wave; the last wave has all that are left.
WAVES = (1, 8)


class BallTree:
    """Integer vectors in balls: halves along the direction to the farthest point, down to leaves."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self._most = int(np.unique(ids, return_counts=True)[1].max(initial=1))  # rows of one id
        self.nodes: list[tuple] = []  # (centre, radius, low child, high child) or (centre, radius, members)
        self._grow(np.arange(len(ids)), leaf)

    def _grow(self, members: np.ndarray, leaf: int) -> int:
        points = self.rows[members]
        centre = points.mean(axis=0)
        away = np.sqrt(((points - centre) ** 2).sum(axis=1))
        at, radius = len(self.nodes), float(away.max())
        self.nodes.append((centre, radius, members))
        if len(members) > leaf and radius > 0:
            a = points[away.argmax()]
            b = points[((points - a) ** 2).sum(axis=1).argmax()]
            side = points @ (b - a)
            half = np.argsort(side, kind="stable")
            cut_at = len(half) // 2
            low = self._grow(np.sort(members[half[:cut_at]]), leaf)
            high = self._grow(np.sort(members[half[cut_at:]]), leaf)
            self.nodes[at] = (centre, radius, low, high)
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of queries, up to k (scores, ids) of this tree, best first, ties to smaller ids.

        All queries of a block go down together: nodes are opened by their highest upper bound, centre . query +
        radius * |query|, and a query leaves a branch whose bound is below its k-th score so far or its
        floor, the k-th score that another shard has. Missing places have score -inf.
        """
        n = len(queries)
        norms = np.sqrt((queries**2).sum(axis=1))
        scores, ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        slack = 1e-9 * (1 + norms) * (1 + float(np.abs(self.rows).max(initial=0)) * max(1, self.rows.shape[1]))
        bounds = lambda node, who: queries[who] @ self.nodes[node][0] + self.nodes[node][1] * norms[who] + slack[who]
        everyone = np.arange(n)
        queue = [(-np.inf, 0, everyone, bounds(0, everyone))]
        while queue:
            _, at, who, high = heapq.heappop(queue)
            who = who[high >= np.maximum(floors[who], scores[who, k - 1])]
            if not len(who):
                continue
            node = self.nodes[at]
            if len(node) == 4:
                for child in node[2:]:
                    up = bounds(child, who)
                    heapq.heappush(queue, (-float(up.max()), child, who, up))
                continue
            members = node[2]
            if node[1] == 0 and len(members) > k + 1:  # equal vectors: those with the smallest ids
                members = members[np.argsort(self.ids[members], kind="stable")[: k + 1 + self._most]]
            new = queries[who] @ self.rows[members].T
            new[own[who][:, None] == self.ids[members][None, :]] = -np.inf
            better = (new >= np.maximum(floors[who], scores[who, k - 1])[:, None]).any(axis=1)
            who, new = who[better], new[better]
            all_scores = np.concatenate([scores[who], new], axis=1)
            all_ids = np.concatenate([ids[who], np.broadcast_to(self.ids[members], new.shape)], axis=1)
            best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[who], ids[who] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
        return scores, ids


def _matrix(vectors: list, width: int | None = None) -> np.ndarray:
    """Ragged integer vectors as float64 rows, padded with zeros; exact while inner products stay below 2**53."""
    width = width or max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v[:width]
    return out


_HITS = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, shard: int = SHARD, block: int = BLOCK, waves: tuple[int, ...] = WAVES) -> DataFrame:
    """The k highest integer inner products of each query with all other rows, ties to the smaller vec_id.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible by `every`; rows with the
    query's own vec_id are no candidates of it. Vectors are dealt into regions, each around one of at most REGIONS rows,
    and a region into as many shards as its rows fill, so that equal vectors aren't one task's. A shard's ball tree is
    built once and stored. A query goes to regions by falling upper bounds, centre . query + radius * |query|, in waves:
    after each wave the k-th score that it has over all shards is its floor, and regions whose bound is below it are left
    out for good. Within a shard, branch and bound starts from that floor. At most k rows of a query leave a shard.

    Null vectors or ones with a null or non-finite component, and null ids, take no part. Vectors of different length
    are compared as if padded with zeros; long ones count whole. Rows that repeat are candidates each; a query id with
    several vectors is one query that has them all. An empty table gives no rows. Columns other than vec_id and embedding
    are ignored, whatever their names.
    """
    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    centres, width = _centres(rows, shard)
    placed = cut(rows.mapInArrow(_nearest(centres), "vec_id long, v array<double>, region int, away double"))
    regions = placed.groupBy("region").agg(F.count("*").alias("n"), F.max("away").alias("radius")).orderBy("region").collect()
    if not regions:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = {r["region"]: -(-r["n"] // shard) for r in regions}
    many = F.element_at(F.create_map(*[F.lit(x) for p in parts.items() for x in p]), F.col("region"))
    trees = placed.select("region", F.pmod(F.xxhash64("vec_id"), many).cast("int").alias("part"), "vec_id", "v").groupBy("region", "part")
    trees = cut(trees.applyInPandas(_grown(width), "region int, part int, tree binary"))
    asks = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v").dropDuplicates()
    asked = asks.count()
    best = None
    for low, high in zip((0, *waves), (*waves, len(regions))):
        high = min(high, len(regions))
        if low >= high:
            break
        floors = asks.withColumn("floor", F.lit(float("-inf")))
        if best is not None:
            last = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("_floor"))
            floors = asks.join(last, "vec_id", "left").select("vec_id", "v", F.coalesce("_floor", F.lit(float("-inf"))).alias("floor"))
        chosen = floors.mapInArrow(_chosen(centres, [(r["region"], r["radius"], parts[r["region"]]) for r in regions], low, high), "region int, part int, vec_id long, v array<double>, floor double")
        hits = _search(trees, chosen, max(1, -(-asked // block)), k)
        hits = hits if best is None else hits.unionByName(best.select("query_id", "vec_id", "score"))
        by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = cut(hits.withColumn("rank", F.row_number().over(by_score).cast("int")).where(F.col("rank") <= k))
    return best.select("query_id", "rank", "vec_id", "score")


def _centres(rows: DataFrame, shard: int) -> tuple[np.ndarray, int]:
    """Rows that regions lie around, chosen by hash: as many as shards would be, REGIONS at most; and the longest vector's length."""
    total = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    most = min(REGIONS, -(-total["n"] // shard))
    if most <= 1:
        return np.zeros((1, total["width"] or 0)), total["width"] or 0
    found = rows.select("v", F.xxhash64(F.lit(3), "vec_id", "v").alias("h")).orderBy("h").limit(most).collect()
    return np.unique(_matrix([r["v"] for r in found], total["width"]), axis=0), total["width"]


def _nearest(centres: np.ndarray):
    """Adds the region of each vector, that of its nearest centre, and how far it is from that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (centres**2).sum(axis=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column(1).to_pylist(), centres.shape[1])
                region = (squares[None, :] - 2 * (x @ centres.T)).argmin(axis=1)
                away = np.sqrt(((x - centres[region]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(region.astype(np.int32)), pa.array(away)], ["vec_id", "v", "region", "away"])

    return run


def _grown(width: int):
    """The ball tree of a shard, as bytes."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(rows["vec_id"].to_numpy(), _matrix(rows["v"].tolist(), width))
        return pd.DataFrame({"region": [key[0]], "part": [key[1]], "tree": [pickle.dumps(tree, protocol=5)]}).astype({"region": "int32", "part": "int32"})

    return run


def _chosen(centres: np.ndarray, regions: list[tuple[int, float, int]], low: int, high: int):
    """The shards that a query goes to in a wave: those of its regions at places low to high by falling bounds, where the bound reaches its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, radius, parts = (np.array(x) for x in zip(*regions))
        middle = centres[number]
        reach = 1 + float(np.abs(middle).max(initial=0)) * max(1, middle.shape[1])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = _matrix(part.column(1).to_pylist(), centres.shape[1])
                size = np.sqrt((x**2).sum(axis=1))[:, None]
                bound = x @ middle.T + size * radius[None, :]
                bound += 1e-9 * (1 + size) * (reach + radius[None, :])
                order = np.argsort(-bound, axis=1, kind="stable")[:, low:high]
                able = np.take_along_axis(bound, order, 1) >= part.column(2).to_numpy()[:, None]
                row, place = np.nonzero(able)
                region = order[row, place]
                times = parts[region]
                row, region = np.repeat(row, times), np.repeat(region, times)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                kept = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(number[region].astype(np.int32)), pa.array(nth.astype(np.int32)), *kept.columns], ["region", "part", "vec_id", "v", "floor"])

    return run


def _search(trees: DataFrame, asks: DataFrame, blocks: int, k: int) -> DataFrame:
    """Hits of queries in the shards that they go to. A shard's tree comes first in its partition, and queries pass by in batches; a tree is sent to a block of queries only if there are any."""
    asks = asks.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    if blocks > 1:
        asks = cut(asks)
        trees = trees.join(asks.select("region", "part", "block").distinct(), ["region", "part"])
    else:
        trees = trees.withColumn("block", F.lit(0))
    both = trees.withColumns({"vec_id": F.lit(None).cast("long"), "v": F.lit(None).cast("array<double>"), "floor": F.lit(None).cast("double")})
    both = both.unionByName(asks.withColumn("tree", F.lit(None).cast("binary")))
    place = ["region", "part", "block"]
    both = both.repartition(*place).sortWithinPartitions(*place, F.col("tree").isNull()).select("tree", "vec_id", "v", "floor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            edges = np.flatnonzero(batch.column(0).is_valid().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if a in edges:
                    tree, a = pickle.loads(batch.column(0)[a].as_py()), a + 1
                for at in range(a, b, 1024):
                    part = batch.slice(at, min(1024, b - at))
                    own = part.column(1).to_numpy()
                    scores, ids = tree.search(_matrix(part.column(2).to_pylist(), tree.rows.shape[1]), own, k, part.column(3).to_numpy())
                    row, nth = np.nonzero(scores > -np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids[row, nth]), pa.array(scores[row, nth].astype(np.int64))], ["query_id", "vec_id", "score"])

    return both.mapInArrow(run, _HITS)
