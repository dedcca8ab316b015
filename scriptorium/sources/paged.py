"""A paged REST source: lanes of pages, each a partition, retried with linear backoff. The transport is a parameter, so tests need no network."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .journal import map_limit, retry


def over_http(url: str) -> str:
    from urllib.request import urlopen

    with urlopen(url, timeout=20) as answer:  # noqa: S310
        return answer.read().decode()


class Lane(InputPartition):
    def __init__(self, first: int):
        self.first = first


class PagedReader(DataSourceReader):
    """Pages at offset 0, limit, 2 limit, up to max_pages, ended by the first short page. Lane i of `lanes` reads every lanes-th page from i on; each stops at its first short one."""

    def __init__(self, options: dict, fetch: Callable[[str], str]):
        self.url, self.rows = options["url"], options.get("rows", "notes")
        self.limit, self.pages, self.lanes = (int(options.get(k, n)) for k, n in (("limit", 500), ("max_pages", 20), ("lanes", 1)))
        self.fetch = fetch

    def partitions(self) -> list[Lane]:
        return [Lane(i) for i in range(min(self.lanes, self.pages))]

    def read(self, partition: Lane) -> Iterator[tuple]:
        joint = "&" if "?" in self.url else "?"
        for page in range(partition.first, self.pages, self.lanes):
            offset = page * self.limit
            text = retry(lambda: self.fetch(f"{self.url}{joint}limit={self.limit}&offset={offset}"))
            found = json.loads(text).get(self.rows) or []
            for i, row in enumerate(found):
                yield offset + i, json.dumps(row)
            if len(found) < self.limit:
                return


class Span(InputPartition):
    def __init__(self, first: int, stop: int):
        self.first, self.stop = first, stop


class PagedStream(DataSourceStreamReader):
    """Rows of a service that only grows, by number: a batch is what came since the last one, a page each task. How many there are is found by asking for single rows, doubling and halving."""

    def __init__(self, options: dict, fetch: Callable[[str], str]):
        self.url, self.rows, self.limit = options["url"], options.get("rows", "notes"), int(options.get("limit", 500))
        self.fetch, self.seen = fetch, 0

    def _found(self, offset: int, limit: int) -> list:
        joint = "&" if "?" in self.url else "?"
        return json.loads(retry(lambda: self.fetch(f"{self.url}{joint}limit={limit}&offset={offset}"))).get(self.rows) or []

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        low, step = self.seen, 1
        while self._found(low + step - 1, 1):  # rows up to low + step are there
            low, step = low + step, step * 2
        high = low + step - 1  # and of those up to this one perhaps
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self._found(middle - 1, 1) else (low, middle - 1)
        self.seen = low
        return {"rows": low}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(at, min(at + self.limit, end["rows"])) for at in range(start["rows"], end["rows"], self.limit)]

    def read(self, partition: Span) -> Iterator[tuple]:
        found = self._found(partition.first, partition.stop - partition.first)
        if len(found) != partition.stop - partition.first:
            raise ValueError(f"rows {partition.first} to {partition.stop} are gone")
        for i, row in enumerate(found):
            yield partition.first + i, json.dumps(row)


def paged_source(name: str = "paged_rest", fetch: Callable[[str], str] = over_http) -> type[DataSource]:
    """A data source to register: spark.dataSource.register(paged_source()); options url, rows, limit, and for tables max_pages, lanes.

    Read as a stream, it goes on where the checkpoint of the query ends, so each row comes once, whatever restarts.
    """

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "pos long, value string"

        def reader(self, schema) -> PagedReader:
            return PagedReader(self.options, fetch)

        def streamReader(self, schema) -> PagedStream:
            return PagedStream(self.options, fetch)

    return PagedSource


def stored_pages(rows, order: str, limit: int) -> Callable[[str], str]:
    """The transport of a service that serves a table's rows as notes, in order: pages of `limit` are written to the shared folder and read from there."""
    from pyspark.sql import functions as F

    from ..operators.vectors import numbered
    from ..shared import shared_folder

    folder = f"{shared_folder(rows.sparkSession)}/pages-{uuid.uuid4().hex}"
    placed = numbered(rows, order, into="_n").withColumn("page", F.floor(F.col("_n") / limit))
    note = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    placed.select("page", "_n", note.alias("value")).repartition("page").sortWithinPartitions("page", "_n").drop("_n").write.partitionBy("page").text(folder)

    def fetch(url: str) -> str:
        from urllib.parse import parse_qs, urlparse

        from pyarrow import fs

        asked = {k: int(v[0]) for k, v in parse_qs(urlparse(url).query).items() if k in ("limit", "offset")}
        system, path = fs.FileSystem.from_uri(folder)
        lines: list[str] = []
        for page in range(asked["offset"] // limit, (asked["offset"] + asked["limit"] - 1) // limit + 1):
            place = fs.FileSelector(f"{path}/page={page}", allow_not_found=True)
            for file in (f for f in system.get_file_info(place) if f.base_name.startswith("part-")):
                with system.open_input_stream(file.path) as stream:
                    lines += stream.read().decode().splitlines()
        first = asked["offset"] % limit
        return json.dumps({"notes": [json.loads(x) for x in lines[first : first + asked["limit"]]]})

    return fetch


def search_items(answers, platform: str, plan):
    """(platform, stage, url, title, author, snippet, publishDate, query, queryLabel) of JSON search answers of several shapes; hits without url or title go."""
    from pyspark.sql import functions as F

    from ..functions.text import blank

    item = "array<struct<link:string,url:string,title:string,name:string,author:string,site_name:string,content:string,snippet:string,description:string,summary:string,publish_date:string,publish_time:string,date:string>>"
    lists = [F.from_json(F.get_json_object("value", f"$.{p}"), item) for p in ("search_result", "data", "data.search_result", "result.search_result", "results", "items")]
    none = F.array().cast(item)
    first = lambda *names: F.coalesce(*[blank(F.col(f"x.{n}")) for n in names], F.lit(""))
    rows = answers.select("*", F.explode(F.concat(*[F.coalesce(x, none) for x in lists])).alias("x"))
    return rows.select(
        F.lit(platform).alias("platform"), F.lit(plan["stage"]).alias("stage"), first("link", "url").alias("url"), first("title", "name").alias("title"), first("author", "site_name").alias("author"),
        first("content", "snippet", "description", "summary").alias("snippet"), first("publish_date", "publish_time", "date").alias("publishDate"), F.lit(plan["query"]).alias("query"), F.lit(plan["label"]).alias("queryLabel"),
    ).where("url <> '' AND title <> ''")


# Names of search engines and what they are called in a request.
ENGINES = {"web-search-pro": "search_pro", "search_pro": "search_pro", "web-search-std": "search_std", "search_std": "search_std", "search_pro_sogou": "search_pro_sogou", "sogou": "search_pro_sogou", "search_pro_quark": "search_pro_quark", "quark": "search_pro_quark"}


def search_request(query: str, engine: str | None = None, domain: str | None = None, recency: str | None = None, size: str | None = None, count: int | None = None) -> dict:
    """The body of a web search: an engine by any of its names, defaults, and no fields without a value."""
    body = {
        "search_query": query, "search_engine": ENGINES.get((engine or "").strip().lower(), "search_pro"), "search_intent": False, "search_domain_filter": domain,
        "search_recency_filter": recency or "oneMonth", "content_size": size or "medium", "count": count,
    }
    return {k: v for k, v in body.items() if v is not None and v != ""}


def search_web(plans, post: Callable[[str, dict], str], limit: int = 4, journal: str | None = None):
    """Search plans with the raw JSON answer to each, in column value, for search_items(): at most `limit` calls at a time, each asked once. post(endpoint, body) is the transport."""
    ask = lambda r: post("web_search", search_request(r["query"], r.get("searchEngine"), r.get("domainFilter"), r.get("recencyFilter"), r.get("contentSize")))
    asked = [c for c in ("query", "searchEngine", "domainFilter", "recencyFilter", "contentSize") if c in plans.columns]
    return map_limit(plans, ask, limit, "value", asked, journal)


def read_pages(rows, post: Callable[[str, dict], str], limit: int = 4, url: str = "url", journal: str | None = None):
    """Rows with a page reader's raw JSON answer for their address, in column value, for reader_payload(); an address is read once."""
    return map_limit(rows, lambda r: post("reader", {"url": r[url]}) if r[url] else None, limit, "value", [url], journal)
