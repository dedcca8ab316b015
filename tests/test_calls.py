"""Calls are made once: under sorts, counts, retries, reruns and failures."""

import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import outside
from scriptorium.sources.journal import CallsFailed, map_limit


def counting(folder, fails=lambda r, n: False):
    """A call that leaves a file each time, and how often each request was made."""
    folder.mkdir()

    def call(row):
        made = len(list(folder.glob(f"{row['x']}-*")))
        (folder / f"{row['x']}-{uuid.uuid4().hex}").touch()
        if fails(row, made):
            raise ValueError(f"no answer for {row['x']}")
        return None if row["x"] == 13 else f"answer {row['x']}"

    def made():
        out = {}
        for f in folder.iterdir():
            out[int(f.name.split("-")[0])] = out.get(int(f.name.split("-")[0]), 0) + 1
        return out

    return call, made


def test_once(spark, tmp_path):
    """n requests, n calls, however the result is used; null is an answer too."""
    call, made = counting(tmp_path / "calls")
    rows = spark.range(40, numPartitions=3).withColumnRenamed("id", "x")
    out = map_limit(rows, call, 7)
    assert [(r["x"], r["answer"]) for r in out.collect()] == [(i, None if i == 13 else f"answer {i}") for i in range(40)]
    out.orderBy(F.desc("answer")).count()
    out.unionByName(out).groupBy("answer").count().collect()
    assert made() == {i: 1 for i in range(40)}


def test_rerun(spark, tmp_path):
    """With a journal of its own a second run calls for new requests only; equal requests share a call, nulls included."""
    call, made = counting(tmp_path / "calls")
    rows = spark.createDataFrame([(i % 5, None if i % 2 else i) for i in range(20)], "x long, note long")
    first = map_limit(rows, call, 3, request=["x"], journal=f"{tmp_path}/journal")
    assert first.count() == 20 and made() == {i: 1 for i in range(5)}
    again = map_limit(rows.unionByName(spark.createDataFrame([(7, 7)], "x long, note long")), call, 3, request=["x"], journal=f"{tmp_path}/journal")
    assert [r["answer"] for r in again.collect()] == [f"answer {i % 5}" for i in range(20)] + ["answer 7"]
    assert made() == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 7: 1}


def test_failures(spark, tmp_path, monkeypatch):
    """A failing call is tried again by itself; the others' answers are kept, and the next run asks for what is missing."""
    call, made = counting(tmp_path / "calls", lambda r, n: r["x"] == 3 and n < 2 or r["x"] == 4 and n < 5)
    rows = spark.range(8).withColumnRenamed("id", "x")
    with pytest.raises(CallsFailed, match="1 calls failed, as: ValueError: no answer for 4"):
        map_limit(rows, call, 2, journal=f"{tmp_path}/journal", delay=0.01)
    assert made() == {**{i: 1 for i in range(8)}, 3: 3, 4: 3}
    out = map_limit(rows, call, 2, journal=f"{tmp_path}/journal", delay=0.01)
    assert [r["answer"] for r in out.collect()] == [f"answer {i}" for i in range(8)]
    assert made() == {**{i: 1 for i in range(8)}, 3: 3, 4: 6}


def test_waves(spark, tmp_path, monkeypatch):
    from scriptorium.sources import journal

    monkeypatch.setattr(journal, "WAVE", 2)
    call, made = counting(tmp_path / "calls")
    assert map_limit(spark.range(30).withColumnRenamed("id", "x"), call, 3, journal=f"{tmp_path}/journal").count() == 30
    assert made() == {i: 1 for i in range(30)}
    assert len({f.name.split("-")[2] for f in Path(tmp_path / "journal").glob("part-*")}) >= 4  # several jobs, each committed
    assert map_limit(spark.range(0).withColumnRenamed("id", "x"), call, 3).count() == 0


def test_sources_call_once(spark, tmp_path):
    """Guides, README files and pages are asked for once, too."""
    seen = tmp_path / "seen"
    seen.mkdir()

    def ask(prompt):
        (seen / uuid.uuid4().hex).touch()
        return json.dumps({"titleZh": "t"})

    papers = spark.createDataFrame([("A",), ("B",), ("C",)], "title string")
    out = outside.generate_guides(papers, papers.where("title = 'C'"), ask, {}, journal=f"{tmp_path}/guides")
    assert out.orderBy("title").count() == 2 and out.where("problem IS NOT NULL").count() == 2
    assert len(list(seen.iterdir())) == 2
    pages = outside.cached_pages(spark, spark.createDataFrame([("p", "u1"), ("q", "u2")], "name string, url string"), f"{tmp_path}/pages", lambda url: ask(url) and f"<p>{url}")
    assert sorted(r["html"] for r in pages.collect()) == ["<p>u1", "<p>u2"]
    assert len(list(seen.iterdir())) == 4


def test_guide_problems(spark):
    good = {"titleZh": "t", "hookZh": "h", "primaryCategory": "c", "categories": [], "keywords": [], "introZh": dict.fromkeys(outside.INTRO_KEYS, "x")}
    texts = [json.dumps(good), json.dumps(good | {"introZh": {**good["introZh"], outside.INTRO_KEYS[0]: ""}}), json.dumps(good | {"introZh": "x"}), json.dumps({k: v for k, v in good.items() if k != "hookZh"}), json.dumps(good | {"keywords": None}), "[1]", "no", None, "{}"]
    found = [r["p"] for r in spark.createDataFrame([(t,) for t in texts], "g string").select(outside.guide_problem(F.col("g")).alias("p")).collect()]
    assert found[0] is None and found[1] == f"introZh is missing keys: {outside.INTRO_KEYS[0]}" and found[2].count(",") == len(outside.INTRO_KEYS) - 1
    assert found[3:6] == ["missing keys: hookZh", "missing keys: keywords", "no JSON object"] and found[6:8] == ["no JSON object"] * 2 and found[8].startswith("missing keys: titleZh, hookZh")
