"""Calls to outside services, each made once: answers are kept in a journal before anything else is done with them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..shared import cut, shared_folder
from .json_docs import exists

#: Columns of a journal: a digest of the request, the answer (null is one too), and what went wrong if there is none.
SHAPE = "digest string, answer string, error string, status int"
#: Requests for each call at a time that are made before their answers are written.
WAVE = 64


class CallsFailed(RuntimeError):
    """Some calls gave no answer. Those that did are in the journal, so that another run asks for the rest only."""

    def __init__(self, failed: int, example: str, status: int | None):
        super().__init__(f"{failed} calls failed, as: {example}")
        self.failed, self.status = failed, status


def retry(call: Callable, attempts: int = 3, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """call() again after delay, 2 delay and so on; the last error is raised."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if n == attempts:
                raise
            sleep(delay * n)


def _asked(requests: DataFrame, call: Callable[[dict], str | None], tasks: int, threads: int, attempts: int, delay: float) -> DataFrame:
    """Journal rows of requests: each is called for in one of `threads` threads of a task."""

    def one(row: dict) -> tuple[str | None, str | None, int | None]:
        try:
            return retry(lambda: call(row), attempts, delay), None, None
        except Exception as e:  # the others' answers are kept
            return None, f"{type(e).__name__}: {e}"[:500], getattr(e, "status", None)

    def run(batches):
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                found = list(pool.map(one, pdf.drop(columns="digest").to_dict("records")))
                yield pd.DataFrame({"digest": pdf["digest"], "answer": [f[0] for f in found], "error": [f[1] for f in found], "status": pd.array([f[2] for f in found], "Int32")})

    return requests.repartition(tasks).mapInPandas(run, SHAPE)


def answered(spark, journal: str) -> DataFrame:
    """(digest, answer) of the journal's requests that have an answer."""
    rows = spark.read.schema(SHAPE).parquet(journal) if exists(spark, journal) else spark.createDataFrame([], SHAPE)
    return rows.where("error IS NULL").groupBy("digest").agg(F.min("answer").alias("answer"))


def map_limit(rows: DataFrame, call: Callable[[dict], str | None], limit: int, into: str = "answer", request: list[str] | None = None, journal: str | None = None, attempts: int = 3, delay: float = 1.0) -> DataFrame:
    """rows, in their order, with what call() gives for each; at most `limit` calls at a time, those of a task in as many threads as its share.

    request: the columns that a call depends on, all by default. Rows of equal requests share one call. Calls are made here and
    now, and their answers appended to the journal, a folder of the caller or one of this call's own, before rows and
    answers are joined: whatever is done with the result, sorted, counted or computed again, calls nobody. Requests
    that the journal has answers for aren't made, so a run after a failure only asks for what is missing. They are made
    in waves, each a job that commits its answers, so a lost executor costs no more than its tasks of one wave.

    A call is tried `attempts` times, with growing delays; if some never succeed, CallsFailed is raised after all others have
    been written. No rows: no calls.
    """
    spark = rows.sparkSession
    asked = request if request is not None else rows.columns
    journal = journal or f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}"
    text = F.to_json(F.struct(*asked), {"ignoreNullFields": "false"}) if asked else F.lit("")
    placed = cut(rows.withColumns({"_at": F.monotonically_increasing_id(), "_digest": F.sha2(text, 256)}))
    first = placed.select(F.col("_digest").alias("digest"), *asked).dropDuplicates(["digest"])
    missing = cut(first.join(answered(spark, journal), "digest", "left_anti"))
    count = missing.count()
    tasks = max(1, min(limit, spark.sparkContext.defaultParallelism))
    waves = -(-count // (limit * WAVE))
    for wave in range(waves):
        own = missing.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave)
        _asked(own, call, tasks, max(1, limit // tasks), attempts, delay).write.mode("append").parquet(journal)
    have = answered(spark, journal).withColumnsRenamed({"digest": "_digest", "answer": into})
    if count:
        open_ = missing.join(have, missing["digest"] == have["_digest"], "left_anti").select("digest")
        failed = spark.read.schema(SHAPE).parquet(journal).where("error IS NOT NULL").join(open_, "digest").groupBy().agg(F.count_distinct("digest").alias("n"), F.max("error").alias("error"), F.max("status").alias("status")).first()
        if failed["n"]:
            raise CallsFailed(failed["n"], failed["error"], failed["status"])
    shape = StructType([*rows.schema.fields, StructField(into, StringType())])
    return placed.join(have, "_digest").orderBy("_at").select(*shape.names)
