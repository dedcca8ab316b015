"""A paged service as a stream: each row once, over restarts, joined with a table."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from scriptorium.sources import paged


def test_streamed_pages(spark, tmp_path):
    size, asked = tmp_path / "size", tmp_path / "asked"
    asked.write_text("")

    def fetch(url):
        at = {k: int(v) for k, v in (x.split("=") for x in url.split("?")[1].split("&")) if k in ("limit", "offset")}
        with Path(asked).open("a") as f:
            f.write(f"{at['limit']} {at['offset']}\n")
        return json.dumps({"notes": [{"n": i} for i in range(at["offset"], min(at["offset"] + at["limit"], int(Path(size).read_text())))]})

    spark.dataSource.register(paged.paged_source("streamed_notes", fetch))
    names = spark.range(100).select("id", F.concat(F.lit("name "), "id").alias("name"))

    def run(n):
        size.write_text(str(n))
        notes = spark.readStream.format("streamed_notes").options(url="https://api.example.org/notes?v=1", limit=10).load()
        rows = notes.select("pos", F.get_json_object("value", "$.n").cast("long").alias("id")).join(names, "id")
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("pos", "id", "name").collect())

    want = lambda n: [(i, i, f"name {i}") for i in range(n)]
    assert run(23) == want(23)
    assert run(23) == want(23)  # nothing new
    before = len(asked.read_text().splitlines())
    assert run(61) == want(61)
    pages = [x for x in asked.read_text().splitlines()[before:] if not x.startswith("1 ")]
    assert pages and min(int(x.split()[1]) for x in pages) == 23  # rows that came before aren't asked for again


def test_offsets():
    for n in (0, 1, 2, 3, 7, 8, 100, 1023):
        calls = []

        def fetch(url, n=n, calls=calls):
            calls.append(url)
            offset = int(url.split("offset=")[1])
            return json.dumps({"notes": [1] if offset < n else []})

        stream = paged.PagedStream({"url": "https://x.org"}, fetch)
        assert stream.latestOffset() == {"rows": n} == stream.latestOffset() and len(calls) < 40
        assert [(p.first, p.stop) for p in stream.partitions({"rows": 0}, {"rows": 7})] == [(0, 7)]
