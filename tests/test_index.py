"""Searches of a stored index against scans of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import index, search

WORDS = [a + b + c for a in ("gra", "lo", "me", "vi", "ro") for b in ("ph", "tin", "ral", "sua") for c in ("s", "ing", "le", "tion", "x")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        title = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 7)))
        abstract = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 40))) + (" rare needle word" if i in (5, 1700) else "") + (" Gaussian Splatting" if i % 211 == 0 else "")
        keywords = [rng.choice(WORDS) for _ in range(rng.randrange(3))] + (["deep needle"] if i == 2222 else [])
        rows.append((i, "Needle in Graphs" if i in (40, 2900) else "A Nedle in Graph" if i == 77 else title if i % 97 else None, ["Nadel"] if i == 8 else None, keywords, abstract, ["robotics-embodied"] if i % 400 == 3 else ["x"]))
    papers = spark.createDataFrame(rows, "pos int, title string, aliases array<string>, keywords array<string>, abstract string, categories array<string>")
    prepared = search.prepare(papers, other_titles=["aliases"], keywords="keywords", blob=["keywords", "aliases", "abstract"], categories="categories")
    path = f"{tmp_path_factory.mktemp('index')}/i"
    index.build_index(prepared, path, rows=64, buckets=16)
    return prepared, path


@pytest.mark.parametrize(("text", "limit"), [("rare needle", 1), ("needle in graph", 7), ("Needle in Graphs", 7), ("nadel", 3), ("deep needle word", 60), ("graphs lotingle", 1), ("graphs lotingle", 60), ("zzzz qqqq", 5), ("ro", 7), ("3DGS", 1), ("robot visuation", 30), ("grapsh lotinge merals vixx rophing and more words than a piece has", 7)])
def test_same_rows(spark, stored, text, limit):
    prepared, path = stored
    query = search.expand(text)
    if text == "3DGS":
        query.acronyms = [("3dgs", "gaussian splatting")]
    want = [(r["pos"], round(r["score"], 6), r["exact"], r["signals"]) for r in search.lexical_search(prepared, query, limit).collect()]
    hits, read = index.indexed_search(spark, path, query, limit, buckets=16)
    assert [(r["pos"], round(r["score"], 6), r["exact"], r["signals"]) for r in hits.collect()] == want
    assert hits.columns == search.lexical_search(prepared, query, limit).columns and read.blocks <= read.of == 47
    if text in ("Needle in Graphs", "nadel"):
        assert read.exact and read.blocks <= 2
    if text in ("rare needle", "3DGS") and limit == 1:
        assert read.blocks <= 16


def test_reads_less(spark, stored):
    """Bytes of the files that the filter leaves, and postings of a few buckets only."""
    prepared, path = stored
    few = index._postings(spark, path, ["gnee"], 16)
    assert len(few.inputFiles()) and few.select("bucket").distinct().count() <= 1
    assert {r["bucket"] for r in few.select("bucket").distinct().collect()} <= {r["b"] for r in spark.range(1).select(index._bucket(F.lit("gnee"), 16).alias("b")).collect()}
    plan = few._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan


def test_empty_index(spark, tmp_path):
    papers = spark.createDataFrame([], "pos int, title string, abstract string")
    index.build_index(search.prepare(papers, blob=["abstract"]), f"{tmp_path}/e")
    hits, read = index.indexed_search(spark, f"{tmp_path}/e", search.expand("graph"), 5)
    assert hits.count() == 0 and read.blocks == 0


def test_disk_of_the_build(spark, tmp_path):
    """Papers are shuffled and stored once, and no pair of a term and a row is shuffled: both stay within a few times the texts. A search gives the rows of a scan."""
    rng = random.Random(5)
    papers = spark.createDataFrame([(i, "Title %d" % i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(400))) for i in range(600)], "pos int, title string, abstract string").repartition(4).cache()
    made = lambda x: search.prepare(x, blob=["abstract"])
    size, store, bus = papers.agg(F.sum(F.length("abstract"))).first()[0], spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    written = lambda: (bus.waitUntilEmpty(30_000), sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size())))[1]
    before, path = written(), f"{tmp_path}/d"
    args = {"prepare": made} if "prepare" in index.build_index.__annotations__ else {}
    index.build_index(papers if args else made(papers), path, rows=64, buckets=16, **args)
    stored = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert written() - before < 5 * size and stored < 3 * size
    hits, read = index.indexed_search(spark, path, search.expand("title 77"), 9, buckets=16, **args)
    want = search.lexical_search(made(papers), search.expand("title 77"), 9)
    assert read.of == 10 and [(r["pos"], r["score"]) for r in hits.collect()] == [(r["pos"], r["score"]) for r in want.collect()]
