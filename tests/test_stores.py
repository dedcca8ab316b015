"""Automaton, vector chunks, snapshots and single-document sinks."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import automaton, text
from scriptorium.operators import vectors
from scriptorium.sources import json_docs, snapshots


def test_automaton(spark):
    """The same terms in the same order as looking for each."""
    terms = ["ab", "b", "", "abc", "日本", "b", "xyz", "c a", "."]
    rows = spark.createDataFrame([("abcab",), ("",), (None,), ("日本語 b",), ("c a.b",), ("none",)], "x string")
    each = F.filter(F.lit(terms), lambda t: F.contains(F.col("x"), t))
    for r in rows.select("x", automaton.contained_many(F.col("x"), terms).alias("a"), each.alias("b")).collect():
        assert r["a"] == r["b"], r["x"]
    assert rows.select(automaton.contained_many(F.col("x"), ["q"] * 3).alias("a")).where(F.size("a") > 0).count() == 0


def test_time_of_large_dictionaries(spark):
    """5,000 terms take about the time of 50, and contained() goes that way by itself."""
    body = " ".join(f"word{i % 700}" for i in range(3000))
    rows = spark.range(400).select(F.concat(F.lit(body), F.col("id").cast("string")).alias("x")).repartition(4).cache()
    rows.count()

    def took(n):
        found = rows.select(F.size(text.contained(F.col("x"), [f"word{7 * i} " for i in range(n)])).alias("n"))
        began = time.perf_counter()
        assert {r["n"] for r in found.distinct().collect()} == {min(n, 100)}
        return time.perf_counter() - began

    took(65)
    few, many = min(took(65) for _ in range(2)), min(took(5000) for _ in range(2))
    rows.unpersist()
    assert many < 3 * few + 1


@pytest.mark.parametrize(("size", "regions"), [(16, 128), (64, 3), (512, 256)])
def test_chunked_top_k(spark, tmp_path, size, regions):
    """The rows of a full scan; of clustered vectors most chunks aren't read."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 12)) * 4
    own = [(i, (centres[i % 20] + rng.normal(size=12) * 0.2).astype("f4").tolist()) for i in range(1500)] + [(5000, own_copy) for own_copy in [centres[0].astype("f4").tolist()]] + [(5001, None), (5002, [float("nan")] * 12)]
    df = spark.createDataFrame(own, "id long, embedding array<float>").repartition(3)
    vectors.write_chunks(df, f"{tmp_path}/c", size=size, regions=regions)
    assert spark.read.parquet(f"{tmp_path}/c").agg(F.sum("rows")).first()[0] == 1501
    for q, k in ((centres[3], 10), (rng.normal(size=12), 1), (-centres[7], 40)):
        want = [(r["id"], round(r["score"], 6)) for r in vectors.top_k(df.where("id < 5001"), q.tolist(), k).collect()]
        found, read, of = vectors.top_k_chunked(spark, f"{tmp_path}/c", q, k)
        assert [(r["id"], round(r["score"], 6)) for r in found.orderBy("rank").collect()] == want
        assert read <= of and (size != 16 or k == 40 or read <= of / 2)


ROWS = [(i, f"t{i}", [f"k{i % 3}"]) for i in range(300)]
SHAPE = "id long, title string, keys array<string>"


def test_snapshots(spark, tmp_path, monkeypatch):
    """Only parts that changed are written; a failure before the swap leaves the old version to read."""
    path = f"{tmp_path}/s"
    assert snapshots.read_snapshot(spark, path, spark.createDataFrame([], SHAPE).schema).count() == 0 and snapshots.version(spark, path) == 0
    assert snapshots.write_snapshot(spark.createDataFrame(ROWS, SHAPE), path, "id", 16) == (1, 16)
    assert snapshots.write_snapshot(spark.createDataFrame(ROWS[::-1], SHAPE).repartition(3), path, "id", 16) == (2, 0)
    changed = [(i, "new" if i == 7 else t, k) for i, t, k in ROWS if i != 9]
    monkeypatch.setattr(snapshots, "swap", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        snapshots.write_snapshot(spark.createDataFrame(changed, SHAPE), path, "id", 16)
    monkeypatch.undo()
    have = lambda: sorted(tuple(r) for r in snapshots.read_snapshot(spark, path).collect())
    assert have() == ROWS and snapshots.version(spark, path) == 2
    number, written = snapshots.write_snapshot(spark.createDataFrame(changed, SHAPE), path, "id", 16)
    assert number == 3 and 1 <= written <= 2 and have() == changed
    assert len(snapshots.drop_old(spark, path)) == 1 and have() == changed  # what the failed write left
    more = spark.createDataFrame(changed + [(None, None, None)], SHAPE)
    assert snapshots.write_snapshot(more, path, "id", 16)[1] == 1 and len(have_all := snapshots.read_snapshot(spark, path).collect()) == 300 and any(r["id"] is None for r in have_all)
    assert snapshots.write_snapshot(more.limit(0), path, "id", 16)[0] == 5 and snapshots.read_snapshot(spark, path).count() == 0


def test_documents_by_tasks(spark, tmp_path):
    """The bytes of an indented array, in the order of the rows, whatever the partitions."""
    rows = [(i, None if i % 4 == 0 else f"line\nof, {i}", ["a", "b"] if i % 3 else []) for i in range(23)]
    df = spark.createDataFrame(rows, "id long, note string, keys array<string>").repartitionByRange(5, "id").sortWithinPartitions("id")
    json_docs.write_pretty(df, f"{tmp_path}/a.json")
    said = (tmp_path / "a.json").read_text()
    assert json.loads(said) == [{"id": i, "note": n, "keys": k} for i, n, k in rows]
    assert said.startswith('[\n  {\n    "id" : 0,') and said.endswith("\n  }\n]\n")
    json_docs.write_pretty(df.limit(0), f"{tmp_path}/a.json")
    assert (tmp_path / "a.json").read_text() == "[]\n"
    json_docs.write_module(df.where("id = 1"), f"{tmp_path}/m.ts", "rows", "Row", "./row")
    assert (tmp_path / "m.ts").read_text().startswith("import type { Row } from './row'\n\nexport const rows = [\n  {") and (tmp_path / "m.ts").read_text().endswith("\n] satisfies Row[]\n")
