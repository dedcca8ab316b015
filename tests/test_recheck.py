"""The stream of re-checks against the same rule over a table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import queue
from scriptorium.streaming import recheck

SHAPE = "id string, status string, title string, reason string, checked timestamp, ts timestamp"
DAY = dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


FIRST = [
    ("a", "candidate", "A", None, at(0), at(1)), ("b", "accepted", "B", None, at(0), at(1)), ("c", "officially-published", "C", None, None, at(1)), ("d", "ignored", "D", None, None, at(2)),
    ("e", "candidate", "Bibtex @x", None, at(2), at(2)), ("f", "candidate", "F", None, at(1), at(3)), ("g", "accepted", "G", "Local high-confidence extraction", at(3), at(3)), (None, "candidate", "N", None, at(3), at(3)),
]
SECOND = [
    ("a", "candidate", "A", None, at(15), at(16)), ("f", "ignored", "F", None, at(0), at(2)),  # f's row is late, its status lower and its check older
    ("d", "candidate", "D", None, at(16), at(16)), ("h", "candidate", "H", None, at(16), at(17)), ("b", "candidate", "B", None, at(0), at(16)), ("a", "candidate", "A", None, at(15), at(16)),
]
THIRD = [("z", "candidate", "Z", None, at(40), at(46))]


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    recheck.use_rocksdb(spark)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_recheck_stream(spark, tmp_path, rocksdb):
    """Late rows, a restart from the checkpoint, checks that put a timer off, and timers that fire: the last change of each entry is what the table's rule says."""
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"

    def run(rows):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(src)
        stream = recheck.recheck_stream(spark.readStream.schema(SHAPE).parquet(src), late="12 hours")
        query = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()

    def states(rows, now):
        """Highest status, newest title and reason, newest check."""
        df = spark.createDataFrame(rows, SHAPE).where("id IS NOT NULL")
        last = df.groupBy("id").agg(F.max_by("title", "ts").alias("title"), F.max_by("reason", "ts").alias("reason"), F.max("checked").alias("checked"))
        joined = queue.status_lattice(df, "id").join(last, "id")
        due = queue.is_recheck_due(F.col("status"), F.col("title"), F.col("reason"), F.col("checked"), F.lit(now))
        return {(r["id"], r["status"], r["due"]) for r in joined.select("id", "status", due.alias("due")).collect()}

    def streamed():
        return {(r["id"], r["status"], r["due"]) for r in recheck.latest(spark.read.parquet(out)).collect()}

    run(FIRST)
    assert streamed() == states(FIRST, at(-9))  # the watermark stands 12 hours before the newest row
    assert {x[0] for x in streamed() if x[2]} == {"d", "e", "g"}
    run(SECOND)  # a new query on the old checkpoint
    assert streamed() == states(FIRST + SECOND, at(5))
    run(THIRD)
    assert streamed() == states(FIRST + SECOND + THIRD, at(34))
    fired = spark.read.parquet(out).where("due AND id IN ('a', 'f', 'h')").select("id", "status", F.unix_millis("at").alias("at")).collect()
    wait = 18 * 3_600_000 + 1
    assert {(r["id"], r["status"], r["at"]) for r in fired} == {(i, "candidate", int(at(h).timestamp() * 1000) + wait) for i, h in (("a", 15), ("f", 1))}
