"""JSON documents: arrays or objects that wrap one, missing files, and JSON inside a script."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..shared import shared_folder

#: Names under which an object may hold its rows.
WRAPPERS = ("papers", "records")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that the path belongs to."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_json_docs(spark: SparkSession, path: str, schema: StructType, missing_ok: bool = False) -> DataFrame:
    """Rows of JSON documents: a bare array, or an object with papers or records. A missing path is an empty table if missing_ok."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return rows_of(spark.read.text(path, wholetext=True), "value", schema)


def rows_of(texts: DataFrame, column: str, schema: StructType) -> DataFrame:
    """Rows of JSON texts of either shape."""
    array = ArrayType(schema)
    wrapped = StructType().add(WRAPPERS[0], array).add(WRAPPERS[1], array)
    text = F.trim(F.col(column))
    rows = F.when(text.startswith("["), F.from_json(text, array)).otherwise(F.coalesce(*[F.from_json(text, wrapped)[w] for w in WRAPPERS]))
    return texts.select(F.inline(rows))


def read_embedded_json(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    """The array that a script assigns to a name."""
    text = spark.read.text(path, wholetext=True)
    found = F.regexp_extract("value", rf"(?s){name}[^=]*=\s*(\[.*\])", 1)
    return text.select(F.inline(F.from_json(found, ArrayType(schema))))


def read_trace(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """A document of one row, or null where there is none."""
    return spark.read.schema(schema).json(path, multiLine=True) if exists(spark, path) else None


def workflow_runs(answers: DataFrame, column: str = "value") -> DataFrame:
    """Runs in answers of a CI service: id, name, status, conclusion, url, started, updated; an answer without a list has none."""
    item = "array<struct<id:bigint,name:string,status:string,conclusion:string,html_url:string,created_at:string,updated_at:string>>"
    runs = F.from_json(F.get_json_object(column, "$.workflow_runs"), item)
    return answers.select(F.inline(runs)).withColumnsRenamed({"html_url": "url", "created_at": "started", "updated_at": "updated"})


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; the old output goes once the new one is complete."""
    df.write.mode("overwrite").json(path)


def write_text(spark: SparkSession, path: str, parts: Iterable[str | bytes], folder: str | None = None, drop: int = 0, tail: str = "") -> None:
    """One file: texts, then the part files of a folder in order without their last `drop` bytes, then a tail. Written beside its place and moved there when it is complete.

    Part files are copied by the file system's streams, block by block; the driver never holds one.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    system = target.getFileSystem(conf)
    out = system.create(beside, True)
    try:
        for part in parts:
            out.write(part if isinstance(part, bytes) else part.encode())
        if folder:
            place = jvm.org.apache.hadoop.fs.Path(folder)
            files = sorted((f for f in place.getFileSystem(conf).listStatus(place) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getPath().getName())
            for f in files:
                source = f.getPath().getFileSystem(conf).open(f.getPath())
                try:
                    own = jvm.org.apache.commons.io.input.BoundedInputStream(source, f.getLen() - (drop if f is files[-1] else 0))
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, 1 << 16, False)
                finally:
                    source.close()
        out.write(tail.encode())
    finally:
        out.close()
    system.delete(target, False)
    if not system.rename(beside, target):
        raise OSError(f"{path} can't be written")


def _write_rows(df: DataFrame, path: str, head: str, tail: str) -> None:
    """Rows as an indented JSON array between two texts: tasks write parts, which are joined in order."""
    spark = df.sparkSession
    parts = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    lines = F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(F.concat(F.lit("  "), F.replace(lines, F.lit("\n"), F.lit("\n  "))).alias("value")).write.option("lineSep", ",\n").text(parts)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parts)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        some = any(f.getLen() for f in system.listStatus(place) if f.getPath().getName().startswith("part-"))
        write_text(spark, path, [head, "[\n" if some else "[]"], parts, 2, ("\n]" if some else "") + tail)
    finally:
        system.delete(place, True)


def write_pretty(df: DataFrame, path: str) -> None:
    """One indented JSON array, in the order of df."""
    _write_rows(df, path, "", "\n")


def write_module(df: DataFrame, path: str, name: str, kind: str, source: str) -> None:
    """A script that exports the rows under a name, as a list of a kind that it imports."""
    _write_rows(df, path, f"import type {{ {kind} }} from '{source}'\n\nexport const {name} = ", f" satisfies {kind}[]\n")


def mirror(spark: SparkSession, source: str, target: str, ignored: tuple[str, ...] = ()) -> list[str]:
    """Make target hold what source holds: extras are deleted, files copied; ignored names are neither copied nor kept. The names that went, as paths below target."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    gone: list[str] = []

    def sync(a, b, below: str) -> None:
        here, there = a.getFileSystem(conf), b.getFileSystem(conf)
        there.mkdirs(b)
        entries = {x.getPath().getName(): x for x in here.listStatus(a)}
        for x in there.listStatus(b):
            name = x.getPath().getName()
            if name not in entries or name in ignored or entries[name].isDirectory() != x.isDirectory():
                there.delete(x.getPath(), True)
                gone.append(below + name)
        for name, x in entries.items():
            if name in ignored:
                continue
            if x.isDirectory():
                sync(x.getPath(), path(b, name), f"{below}{name}/")
            else:
                jvm.org.apache.hadoop.fs.FileUtil.copy(here, x.getPath(), there, path(b, name), False, True, conf)

    sync(path(source), path(target), "")
    return sorted(gone)
