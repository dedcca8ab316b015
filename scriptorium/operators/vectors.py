"""Vector search and the upkeep of stored vectors."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import hash_values, slugify
from ..shared import cut

#: Rows of a stored chunk.
CHUNK_ROWS = 512


def dot(a: Column, b: Column) -> Column:
    """Inner product of float arrays, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def top_k(vectors: DataFrame, query, k: int, identity: str = "id", embedding: str = "embedding") -> DataFrame:
    """The k rows with the highest inner product with one query vector, ties by id. A bounded heap a task, no sort of the table."""
    scored = vectors.select(identity, dot(F.col(embedding), literal_vector(query)).alias("score"))
    return scored.orderBy(F.desc("score"), identity).limit(k)


def top_k_many(vectors: DataFrame, queries: dict[str, list[float]], k: int, identity: str = "id", embedding: str = "embedding") -> DataFrame:
    """top_k() for a block of queries: one matrix product for each Arrow batch, k rows of each query leave a task."""
    names, matrix = list(queries), np.array(list(queries.values()), float)
    kind = vectors.schema[identity].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            scores = np.vstack(pdf[embedding].to_numpy()).astype(float) @ matrix.T
            order = np.lexsort((np.broadcast_to(pdf[identity].to_numpy()[:, None], scores.shape), -scores), axis=0)[:k]
            for j, name in enumerate(names):
                yield pd.DataFrame({"query": name, identity: pdf[identity].to_numpy()[order[:, j]], "score": scores[order[:, j], j]})

    hits = vectors.select(identity, embedding).mapInPandas(run, f"query string, {identity} {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), identity))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def adaptive_k(cap: int, rows: int) -> int:
    """How many semantic hits to ask for."""
    return min(max(cap * 20, 500), max(rows, 500))


def brainstorm_k(papers: int) -> tuple[int, int]:
    """(semantic, lexical) hits that a brainstorm over so many papers (1 to 20) asks for: 6 a paper within 24 and 120, 8 a paper within 40 and 160."""
    n = min(max(int(papers), 1), 20)
    return min(max(6 * n, 24), 120), min(max(8 * n, 40), 160)


def check_shape(vectors: DataFrame, dimensions: int, embedding: str = "embedding") -> DataFrame:
    """One row: number of vectors, those of another size, those with a value that is no finite number."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.size(embedding), F.lit(-1)) != dimensions).alias("wrong_size"), F.count_if(F.coalesce(bad, F.lit(True))).alias("not_finite"))


def reuse_split(current: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """current (id, fingerprint) with `reused`: whether stored (id, fingerprint, model) has the same of this model. Pending rows are those to embed."""
    same = stored.where(F.col("model") == model).select("id", "fingerprint").distinct().withColumn("reused", F.lit(True))
    return current.join(same, ["id", "fingerprint"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def numbered(rows: DataFrame, order: str, key: str | None = None, into: str = "_i") -> DataFrame:
    """Rows numbered from 0 in order, within each key if one is given.

    Rows are dealt out by ranges of key and order and numbered within these; the ranges' counts give what comes
    before. So a key that holds a third of all rows is many tasks' work, and so is a table without keys.
    """
    keys = [key] if key else []
    dealt = cut(rows.repartitionByRange(*keys, order).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    before = counts.select(*[F.col(k).alias("_k") for k in keys], F.col("_p").alias("_q"), (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(order)) - 1
    same = [F.col("_p") == F.col("_q"), *[F.col(k).eqNullSafe(F.col("_k")) for k in keys]]  # null is a key too
    return dealt.withColumn("_l", local).join(before, same).withColumn(into, F.col("_before") + F.col("_l")).select(*rows.columns, into)


def chunk_rows(rows: DataFrame, key: str, order: str, size: int = CHUNK_ROWS) -> DataFrame:
    """Adds part (from 1) and offset of each row's chunk: up to `size` rows of a key in order; offsets count over all keys in order."""
    per_key = rows.groupBy(key).agg(F.count("*").alias("_n"))
    first = per_key.select(key, (F.sum("_n").over(Window.orderBy(key)) - F.col("_n")).alias("_first"))
    placed = numbered(rows, order, key).join(first, key)
    return placed.withColumn("part", (F.floor(F.col("_i") / size) + 1).cast("int")).withColumn("offset", (F.col("_first") + F.floor(F.col("_i") / size) * size).cast("long")).drop("_first")


def chunk_manifest(rows: DataFrame, key: str, order: str, identity: str, fingerprint: str, dimensions: int, prefix: str = "vectors", size: int = CHUNK_ROWS) -> DataFrame:
    """One row for each chunk: key, part, offset, count, dimensions, file, bytes and a digest over its ids and fingerprints in order."""
    placed = chunk_rows(rows, key, order, size)
    members = F.array_sort(F.collect_list(F.struct(F.col("_i"), F.col(identity).cast("string").alias("id"), F.col(fingerprint).alias("fp"))))  # bounded by size
    chunks = placed.groupBy(F.col(key).alias("key"), "part", "offset").agg(F.count("*").alias("count"), members.alias("m"))
    text = lambda c: F.col(c).cast("string")
    parts = F.concat(F.array(text("key"), text("part"), text("offset"), text("count"), F.lit(str(dimensions))), F.transform("m", lambda x: x["id"]), F.transform("m", lambda x: x["fp"]))
    file = F.concat(F.lit(prefix + "."), slugify(text("key"), "chunk"), F.lit("."), F.lpad(text("part"), 3, "0"), F.lit(".f32.bin"))
    return chunks.select("key", "part", "offset", "count", F.lit(dimensions).alias("dimensions"), file.alias("file"), (F.col("count") * dimensions * 4).alias("bytes"), hash_values(parts).alias("fingerprint"))


def chunk_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(file, action): write those that are new or differ in any field, keep equal ones, delete those that are gone."""
    fields = ["key", "part", "offset", "count", "dimensions", "bytes", "fingerprint"]
    a, b = current.select("file", F.struct(*fields).alias("a")), previous.select("file", F.struct(*fields).alias("b"))
    both = a.join(b, "file", "full_outer")
    return both.select("file", F.when(F.col("a").isNull(), "delete").when(F.col("a").eqNullSafe(F.col("b")), "keep").otherwise("write").alias("action"))


def batches(rows: DataFrame, order: str, size: int, partition: str | None = None) -> DataFrame:
    """Adds batch (from 0): groups of `size` rows in order, within a partition column if one is given."""
    return numbered(rows, order, partition).withColumn("batch", F.floor(F.col("_i") / size).cast("long")).drop("_i")


#: Rows that regions are drawn from, and chunks that are read first.
SAMPLE, FIRST_CHUNKS = 256, 8


def write_chunks(vectors: DataFrame, path: str, identity: str = "id", embedding: str = "embedding", size: int = CHUNK_ROWS, regions: int = SAMPLE) -> None:
    """Store vectors as float32 matrices of up to `size` rows, with bounds of each: its centre, its radius around it and its longest vector.

    Rows are dealt to the nearest of `regions` vectors (those of least hash, a bounded sample), so that a chunk's rows are
    close together; every row is stored. Vectors that are null, or have null or non-finite components, are left out.
    """
    good = vectors.where(F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = good.select(F.col(identity).alias("id"), F.col(embedding).cast("array<float>").alias("v"))
    pivots = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(regions).collect()], float)  # at most `regions`
    kind = rows.schema["id"].dataType.simpleString()

    def near(batches):
        for pdf in batches:
            yield pdf.assign(region=_nearest(np.vstack(pdf["v"].to_numpy()).astype(float), pivots) if len(pdf) else np.zeros(0, "int32"))

    placed = numbered(rows.mapInPandas(near, f"id {kind}, v array<float>, region int"), "id", "region").withColumn("chunk", F.floor(F.col("_i") / size).cast("long"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        own = np.vstack(pdf["v"].to_numpy()).astype("<f4")
        centre = own.astype(float).mean(axis=0)
        radius, longest = np.linalg.norm(own - centre, axis=1).max(), np.linalg.norm(own.astype(float), axis=1).max()
        return pd.DataFrame({"region": pdf["region"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "rows": len(pdf), "ids": [pdf["id"].tolist()], "matrix": [own.tobytes()], "centre": [centre.tolist()], "radius": radius, "longest": longest})

    packed = placed.groupBy("region", "chunk").applyInPandas(pack, f"region int, chunk long, rows int, ids array<{kind}>, matrix binary, centre array<double>, radius double, longest double")
    packed.write.mode("overwrite").partitionBy("region").parquet(path)


def _nearest(own: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivot of each row, by squares and products."""
    return ((pivots**2).sum(axis=1) - 2 * own @ pivots.T).argmin(axis=1).astype("int32")


def top_k_chunked(spark, path: str, query, k: int) -> tuple[DataFrame, int, int]:
    """(id, score, rank) of top_k() from stored chunks, and how many chunks were read of how many.

    No row of a chunk can score more than the query with its centre plus its radius, or than its longest vector allows.
    Chunks of the highest bounds are scored first; then only those whose bound isn't below the k-th score.
    """
    q = np.asarray(query, float)
    stored = spark.read.parquet(path)
    length, slack = float(np.linalg.norm(q)), 1e-9 * (1 + float(np.linalg.norm(q)))
    bound = F.least(dot(F.col("centre"), literal_vector(q)) + length * F.col("radius"), length * F.col("longest")) + F.lit(slack) * (1 + F.col("longest"))
    bounds = cut(stored.select("region", "chunk", bound.alias("bound")))
    kind = stored.schema["ids"].dataType.elementType.simpleString()

    def score(batches):
        for pdf in batches:
            for ids, matrix in zip(pdf["ids"], pdf["matrix"]):
                scores = np.frombuffer(matrix, "<f4").reshape(len(ids), -1).astype(float) @ q
                best = np.lexsort((np.asarray(ids), -scores))[:k]
                yield pd.DataFrame({"id": np.asarray(ids)[best], "score": scores[best]})

    first = bounds.orderBy(F.desc("bound"), "region", "chunk").limit(FIRST_CHUNKS).collect()
    chosen = reduce(or_, [(F.col("region") == c["region"]) & (F.col("chunk") == c["chunk"]) for c in first], F.lit(False))  # named in the filter: other files aren't read
    scored = lambda chunks: chunks.select("ids", "matrix").mapInPandas(score, f"id {kind}, score double")
    hits = cut(scored(stored.where(chosen)))
    head = hits.orderBy(F.desc("score"), "id").limit(k).select("score").collect()
    floor = head[-1]["score"] if len(head) == k else float("-inf")
    more = cut(bounds.where((F.col("bound") >= floor) & ~chosen).select("region", "chunk"))
    rest = scored(stored.join(more, ["region", "chunk"], "left_semi"))
    best = hits.unionByName(rest).orderBy(F.desc("score"), "id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank), len(first) + more.count(), bounds.count()
