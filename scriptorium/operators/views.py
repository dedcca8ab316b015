"""Monitoring views and the related-work plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.display import humanize_key
from ..functions.text import blank
from ..functions.venues import platform_label


def top_counts(values: DataFrame, column: str, limit: int) -> DataFrame:
    """The most frequent values, trimmed, ties by value."""
    value = F.trim(F.col(column))
    return values.where(value != "").groupBy(value.alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(limit)


def platform_breakdown(entries: DataFrame, platforms: Column, evidence_platforms: Column) -> DataFrame:
    """Entries by platform label; entries without platforms count by those of their evidence."""
    use = F.when(F.size(F.coalesce(platforms, F.array().cast("array<string>"))) > 0, platforms).otherwise(evidence_platforms)
    rows = entries.select(F.explode(use).alias("p")).where(F.coalesce(F.col("p"), F.lit("")) != "")
    return rows.groupBy(platform_label(F.col("p")).alias("platform")).agg(F.count("*").alias("count"))


def stage_breakdown(queries: DataFrame, stage: str, raw: Column, kept: Column, rejected: Column) -> DataFrame:
    return queries.groupBy(F.coalesce(blank(F.col(stage)), F.lit("unknown")).alias("stage")).agg(F.count("*").alias("queries"), F.sum(F.coalesce(raw, F.lit(0))).alias("raw"), F.sum(F.coalesce(kept, F.lit(0))).alias("kept"), F.sum(F.coalesce(rejected, F.lit(0))).alias("rejected"))


def latest(rows: DataFrame, ts: str, identity: str, limit: int) -> DataFrame:
    """The newest rows, ties by id: a bounded heap a task."""
    return rows.orderBy(F.desc(ts), identity).limit(limit)


def timeline(parts: list[tuple[str, DataFrame, int]], limit: int = 10) -> DataFrame:
    """The newest items (id, title, ts) of several kinds, each with a limit of its own."""
    out = None
    for kind, rows, most in parts:
        head = latest(rows.select("id", "title", "ts"), "ts", "id", most).withColumn("kind", F.lit(kind))
        out = head if out is None else out.unionByName(head)
    return out.orderBy(F.desc("ts"), "kind", "id").limit(limit)


def latest_evidence(entries: DataFrame, limit: int = 6) -> DataFrame:
    """The newest evidence of shown entries: id, platform, title, snippet and time, with the entry's where evidence has none."""
    e = entries.select("id", F.col("title").alias("paperTitle"), "updatedAt", "discoveredAt", F.posexplode("evidence").alias("i", "e"))
    title = F.coalesce(blank(F.col("e.title")), blank(F.col("e.readerTitle")), F.concat(platform_label(F.col("e.platform")), F.lit(" signal")))
    ts = F.coalesce(blank(F.col("e.publishDate")), blank(F.col("updatedAt")), blank(F.col("discoveredAt")), F.lit(""))
    rows = e.select(F.concat_ws(":", "id", "i").alias("id"), title.alias("title"), "paperTitle", platform_label(F.coalesce("e.platform", F.lit("web"))).alias("platform"), F.coalesce(blank(F.col("e.readerExcerpt")), blank(F.col("e.snippet")), F.lit("No summary snippet yet.")).alias("snippet"), ts.alias("timestamp"))
    return rows.orderBy(F.desc("timestamp"), "id").limit(limit)


def related_plan(papers: DataFrame, background: str, idea: str, constraints: str, pos: str = "pos") -> DataFrame:
    """One row that plans work around related papers: their commonest keywords, venues and categories stand in fixed sentences.

    papers: a short ranked list (title, venue, primaryCategory, keywords) in order of pos.
    """
    n = lambda rows, column, limit: F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), F.col("value")))), lambda x: x["value"])
    counted = lambda values, limit: top_counts(values, "v", limit).agg(n(None, "v", limit).alias("v"))
    keywords = counted(papers.select(F.explode(F.slice("keywords", 1, 6)).alias("v")), 8).withColumnRenamed("v", "keywords")
    venues = counted(papers.select(F.col("venue").alias("v")), 4).withColumnRenamed("v", "venues")
    categories = counted(papers.select(humanize_key(F.col("primaryCategory")).alias("v")), 5).withColumnRenamed("v", "categories")
    anchors = papers.orderBy(pos).limit(3).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "title"))), lambda x: x["title"]).alias("anchors"))
    one = lambda df: df.withColumn("_k", F.lit(1))  # noqa: E731  each side is one row
    row = one(keywords).join(one(venues), "_k").join(one(categories), "_k").join(one(anchors), "_k").drop("_k")
    joined = lambda c, sep, other, most=99: F.coalesce(blank(F.array_join(F.slice(c, 1, most), sep)), F.lit(other))
    query = "\n".join(x.strip() for x in (background, idea, constraints) if x.strip())
    return row.select(
        F.lit(query).alias("query"),
        F.concat(F.lit("Closest literature cluster: "), joined("anchors", " | ", "No close papers yet.")).alias("cluster"),
        F.concat(F.lit("Recurring neighborhoods: "), joined("categories", ", ", "mixed topics"), F.lit(".")).alias("neighborhoods"),
        F.concat(F.lit("Benchmark against papers from "), joined("venues", ", ", "the same venue cluster"), F.lit(" with one matched baseline and one stronger reference.")).alias("evaluation"),
        F.concat(F.lit("Add 2-3 ablations around "), joined("keywords", ", ", "the core mechanism", 3), F.lit(" to show what actually matters.")).alias("ablations"),
        F.slice(F.concat("categories", "keywords"), 1, 8).alias("signals"),
    )


def ranks(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
