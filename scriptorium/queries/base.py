"""The registry of queries, and pieces of SQL that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: run(lambda t: table(spark, sf_dir, t))
        if sql:
            ORACLES[name] = sql
        return run

    return add


def papers(t) -> DataFrame:
    """documents as papers: the first line is the title, the source the venue."""
    d = t("documents")
    return d.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.get(F.split("text", "\n"), 0).alias("title"), F.col("source").alias("venue"), "lang",
        (2026 - F.pmod("doc_id", F.lit(3))).cast("int").alias("year"), F.col("text").alias("abstract"),
    )


PAPERS = "papers AS (SELECT doc_id AS id, doc_id AS pos, string_split(text, chr(10))[1] AS title, source AS venue, lang, CAST(2026 - doc_id % 3 AS INTEGER) AS year, text AS abstract FROM documents)"


def q(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return q(pattern.replace(r"\p{IsHan}", r"\p{Han}"))


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {re2(pattern)}, {q(to)}, 'g')"


def squeeze(x: str) -> str:
    return f"trim({sub(x, chr(92) + 's+', ' ')})"


def norm(x: str) -> str:
    return squeeze(sub(f"lower(coalesce({x}, ''))", r"[^\p{L}\p{N}\s-]+", " "))


def norm_search(x: str) -> str:
    return norm(sub(f"coalesce({x}, '')", "['’`]"))


def tokens(x: str) -> str:
    return f"list_filter(string_split({norm_search(x)}, ' '), lambda t: t <> '')"


def slug(x: str, fallback: str = "paper", size: int = 80) -> str:
    return f"coalesce(nullif(left({sub(sub(norm(x), '[^a-z0-9]+', '-'), '^-+|-+$')}, {size}), ''), {q(fallback)})"


def items(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def contained(x: str, values: list[str]) -> str:
    return f"list_filter({items(values)}, lambda h: contains({x}, h))"


def distinct_in_order(x: str) -> str:
    """A list's values, each once, in order: SQL lists have no such function."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
