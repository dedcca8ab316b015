"""Stored tables: the queue snapshot, shards, chunks of vectors and their manifest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import shard_key
from ..operators.queue import normalize_entry
from ..schemas import ENTRY
from .json_docs import exists, read_json_docs, write_text


def read_queue(spark: SparkSession, path: str, now: str) -> DataFrame:
    """The queue of a snapshot, normalised; no snapshot: an empty queue."""
    if exists(spark, path) and path.endswith(".json"):
        return normalize_entry(read_json_docs(spark, path, ENTRY), now)
    return normalize_entry(spark.read.schema(ENTRY).parquet(path) if exists(spark, path) else spark.createDataFrame([], ENTRY), now)


def write_queue(entries: DataFrame, path: str, now: str) -> None:
    """Every row is normalised again; a snapshot is a folder of its own, so a reader never sees half of one."""
    normalize_entry(entries, now).write.mode("overwrite").parquet(path)


def write_shards(papers: DataFrame, path: str) -> None:
    """The catalogue by shard; abstracts stay in the same table, as scans read only the columns asked for."""
    keyed = papers.withColumn("shard_key", shard_key(F.col("venue"), F.col("year")))
    keyed.repartition("shard_key", F.pmod(F.xxhash64("id"), F.lit(32))).write.mode("overwrite").partitionBy("shard_key").parquet(path)


def write_shard_pair(papers: DataFrame, folders: list[str]) -> None:
    """Shards of details (all but abstracts) and of abstracts (id, abstract), below each of the folders: shards and abstracts."""
    keyed = papers.withColumn("shard_key", shard_key(F.col("venue"), F.col("year"))).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(32)))
    for folder in folders:
        for name, rows in (("shards", keyed.drop("abstract")), ("abstracts", keyed.select("id", F.coalesce("abstract", F.lit("")).alias("abstract"), "shard_key", "_part"))):
            rows.repartition("shard_key", "_part").drop("_part").write.mode("overwrite").partitionBy("shard_key").parquet(f"{folder}/{name}")


def read_shard(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One shard: other partitions aren't read."""
    return spark.read.parquet(path).where(F.col("shard_key") == key)


def write_changed_chunks(rows: DataFrame, delta: DataFrame, path: str) -> None:
    """Rows (file, ...) of chunks to write replace those files' partitions; equal ones stay untouched. Chunks that are gone are listed by gone_chunks()."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.join(delta.where("action = 'write'").select("file"), "file", "left_semi").write.mode("overwrite").partitionBy("file").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def gone_chunks(delta: DataFrame) -> DataFrame:
    return delta.where("action = 'delete'").select("file")


def delete_gone_chunks(delta: DataFrame, path: str) -> list[str]:
    """Delete the partitions of chunks that no manifest has any more; their files' names."""
    spark = delta.sparkSession
    jvm, gone = spark.sparkContext._jvm, []
    for row in gone_chunks(delta).toLocalIterator():
        place = jvm.org.apache.hadoop.fs.Path(path, f"file={row['file']}")
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True):
            gone.append(row["file"])
    return sorted(gone)


def manifest_header(chunks: DataFrame, model: str, generated: str | None, chunk_rows: int = 512) -> DataFrame:
    """One row about a store of chunks: format, model, rows, dimensions, rows of a chunk, chunks, bytes."""
    told = [F.lit("chunked-v1").alias("format"), F.lit(model).alias("model"), F.lit("feature-extraction").alias("task"), F.lit(generated).cast("string").alias("catalogGeneratedAt"), F.lit(True).alias("normalized"), F.lit(chunk_rows).alias("chunkRows")]
    counts = chunks.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("count"), F.max("dimensions").alias("dimensions"), F.count("*").alias("chunks"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
    return counts.select(*told, "count", "dimensions", "chunks", "bytes")


def remove_legacy(spark: SparkSession, paths: list[str]) -> None:
    """Delete what an older store left; what isn't there is no error."""
    jvm = spark.sparkContext._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_float32(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """(file, row, embedding) of raw little-endian float32 matrices; a file whose size is no whole number of rows raises."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                if len(content) % (4 * dimensions):
                    raise ValueError(f"{name}: {len(content)} bytes aren't rows of {dimensions} float32")
                matrix = np.frombuffer(content, "<f4").reshape(-1, dimensions)
                yield pd.DataFrame({"file": name, "row": np.arange(len(matrix)), "embedding": list(matrix)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, embedding array<float>")


def to_float32(rows: DataFrame, file: str, order: str, embedding: str = "embedding") -> DataFrame:
    """(file, content): the vectors of each chunk as raw little-endian float32, in order. A chunk is bounded by its manifest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = np.vstack(pdf.sort_values(order)[embedding].to_numpy()).astype("<f4")
        return pd.DataFrame({"file": [pdf[file].iloc[0]], "content": [matrix.tobytes()]})

    return rows.groupBy(file).applyInPandas(run, "file string, content binary")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of NPZ files with arrays ids and embeddings."""
    import io

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    yield pd.DataFrame({"id": data["ids"].astype(str), "embedding": list(data["embeddings"].astype("f4"))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id string, embedding array<float>")


def read_monolith(spark: SparkSession, path: str, ids: DataFrame, dimensions: int) -> DataFrame:
    """(id, embedding) of one raw float32 matrix whose rows are named by ids (row, id)."""
    return read_float32(spark, path, dimensions).join(ids, "row").select("id", "embedding")


#: Bytes of a matrix that is written as one NPZ file, at most: the format is one array, which one process holds.
NPZ_BYTES = 1 << 30


def write_npz(rows: DataFrame, path: str, meta_path: str, model: str, order: str = "pos", most: int = NPZ_BYTES) -> None:
    """One NPZ file of embeddings and ids in order, and a JSON document about it with ids and titles. rows: id, title, embedding and the order.

    ValueError for a larger matrix than `most` bytes; chunks are the form for those.
    """
    import io
    import json

    spark = rows.sparkSession
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.min(F.size("embedding")).alias("least")).first()
    n, d = shape["n"], max(0, shape["d"] or 0)
    if 4 * n * d > most:
        raise ValueError(f"{n} rows of {d} float32 are more than {most} bytes")
    if n and shape["least"] != d:
        raise ValueError("vectors of different dimensions")
    matrix, ids, titles = np.zeros((n, d), "<f4"), [], []
    for i, row in enumerate(rows.select("id", "title", "embedding").orderBy(order).toLocalIterator()):
        matrix[i] = row["embedding"]
        ids.append(str(row["id"]))
        titles.append(row["title"])
    out = io.BytesIO()
    np.savez_compressed(out, embeddings=matrix, ids=np.array(ids, dtype=str))
    write_text(spark, path, [out.getvalue()])
    meta = {"model": model, "count": n, "dimensions": d, "normalized": True, "ids": ids, "titles": titles}
    write_text(spark, meta_path, [json.dumps(meta, ensure_ascii=False, indent=2), "\n"])


def manifest_ids(chunks: DataFrame) -> DataFrame:
    """(pos, id, fingerprint) of a manifest whose header lacks them: those of its chunks (offset, ids, fingerprints), numbered from each chunk's offset."""
    pairs = chunks.select("offset", F.posexplode(F.arrays_zip("ids", "fingerprints")).alias("i", "x"))
    return pairs.select((F.col("offset") + F.col("i")).alias("pos"), F.col("x.ids").alias("id"), F.col("x.fingerprints").alias("fingerprint"))


class VersionedCache:
    """Tables kept in memory by the version of the snapshot that they come from; versions that aren't current are let go.

    The version is asked for first; where it can't be told, the last known one serves.
    """

    def __init__(self, version, most: int = 1):
        self.version, self.most, self.kept, self.last = version, most, {}, None

    def current(self) -> str:
        try:
            self.last = self.version()
        except Exception:
            if self.last is None:
                raise
        return self.last

    def get(self, name: str, build) -> DataFrame:
        """The table of a name at the current version; build(version) makes it once."""
        version = self.current()
        for key in [k for k in self.kept if k[1] != version]:
            self.kept.pop(key).unpersist()
        if (name, version) not in self.kept:
            self.kept[(name, version)] = build(version).persist()
        return self.kept[(name, version)]


