"""Versioned snapshots: a pointer names the folders that make up the current one, and only what changed is written anew."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut
from .json_docs import exists, write_text

#: Parts of a snapshot, by a hash of the key.
PARTS = 64


def _pointer(spark: SparkSession, path: str) -> dict:
    """The current manifest: version and, of each part, the folder that has it, its rows and a digest."""
    place = f"{path}/CURRENT"
    if not exists(spark, place):
        return {"version": 0, "parts": {}}
    return json.loads(spark.read.text(place, wholetext=True).first()["value"])


def version(spark: SparkSession, path: str) -> int:
    return _pointer(spark, path)["version"]


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def swap(spark: SparkSession, path: str, manifest: dict) -> None:
    """Make a manifest the current one: a file that is moved into its place whole."""
    write_text(spark, f"{path}/CURRENT", [json.dumps(manifest)])


def write_snapshot(rows: DataFrame, path: str, key: str, parts: int = PARTS) -> tuple[int, int]:
    """Write rows as the next version of a snapshot; the version, and how many parts were written.

    Rows are parted by a hash of their key. Parts whose rows are the same as before, by a digest that their order doesn't
    matter to, keep their folder; the others are written to a new one. Readers see nothing of it until the pointer is
    swapped, the last thing done; if writing fails before, the old version stays and another run starts over. Rows of a null
    key are a part's like any other; no rows make an empty version. One writer at a time.
    """
    spark = rows.sparkSession
    old = _pointer(spark, path)
    placed = cut(rows.withColumn("_part", _part(F.col(key), parts)))
    nulls = [F.col(c).isNull() for c in rows.columns]  # a hash passes over nulls
    digest = lambda i: F.sum(F.xxhash64(F.lit(i), *nulls, *rows.columns).cast("decimal(38,0)")).cast("string")
    now = {str(r["_part"]): [r["n"], f"{r['a']}:{r['b']}"] for r in placed.groupBy("_part").agg(F.count("*").alias("n"), digest(1).alias("a"), digest(2).alias("b")).collect()}  # at most `parts`
    shape = rows.schema.json()
    same = old.get("shape") == shape and old.get("of") == parts
    changed = [p for p, told in now.items() if not same or old["parts"].get(p, [None])[1:] != told]
    folder = f"data-{uuid.uuid4().hex}"
    if changed:
        placed.where(F.col("_part").isin(*map(int, changed))).repartition("_part").write.partitionBy("_part").parquet(f"{path}/{folder}")
    manifest = {"version": old["version"] + 1, "of": parts, "shape": shape, "parts": {p: [folder if p in changed else old["parts"][p][0], *told] for p, told in now.items()}}
    swap(spark, path, manifest)
    return manifest["version"], len(changed)


def read_snapshot(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of the current version. None yet: no rows of the schema."""
    from pyspark.sql.types import StructType

    now = _pointer(spark, path)
    shape = StructType.fromJson(json.loads(now["shape"])) if "shape" in now else schema
    if shape is None:
        raise ValueError(f"{path} has no snapshot, and no schema was given")
    places = [f"{path}/{told[0]}/_part={p}" for p, told in now["parts"].items()]
    return spark.read.schema(shape).parquet(*places) if places else spark.createDataFrame([], shape)


def drop_old(spark: SparkSession, path: str) -> list[str]:
    """Delete folders that the current version doesn't name: those of passed versions, which no reader may still be at, and of failed writes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    system, named = place.getFileSystem(conf), {told[0] for told in _pointer(spark, path)["parts"].values()}
    gone = sorted(f.getPath().getName() for f in system.listStatus(place) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in named)
    for name in gone:
        system.delete(jvm.org.apache.hadoop.fs.Path(path, name), True)
    return gone
