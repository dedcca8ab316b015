"""Whole runs over the queue: discovery, reconciliation with the official list, and the refresh of all artefacts.

Each step of a run writes its table to the run's folder. A run that is started again with its folder takes up what is
complete there, and its journal of calls, so nothing is searched, read or asked twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import blank, json_block, normalize_text
from ..functions.venues import has_venue_year, platform_of, venue_rule
from ..operators import catalog, queue
from ..schemas import ENTRY, EVIDENCE
from ..sources import outside, paged, snapshots
from ..sources.journal import map_limit
from ..sources.json_docs import exists, write_text
from . import search_plans
from .pipeline import Budget, Step, run_steps


class Run:
    """A folder of step tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.journal = spark, folder, f"{folder}/journal"

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The step's table: what an earlier start completed, else what build() gives, written."""
        path = f"{self.folder}/{name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def _hits(answers: DataFrame, phase: str) -> DataFrame:
    """Search answers as scored evidence: pos, plan columns, hit columns, relevance and priority."""
    plan = {"stage": F.col("stage"), "query": F.col("query"), "label": F.col("label")}
    items = paged.search_items(answers.select("stage", "query", "label", "value"), "", plan)
    items = items.withColumn("platform", platform_of(F.col("url"))).withColumn("phase", F.lit(phase))
    body = queue.scoring_text(F.col("title"), F.col("snippet"), F.col("url"), F.col("query"))
    scored = items.withColumn("relevance", queue.evidence_score(body, F.col("stage"), F.col("url")))
    return scored.withColumn("priority", queue.evidence_priority(F.col("relevance.score"), F.col("stage"), F.col("url"), F.concat_ws(" ", "title", "snippet")))


def _placed(rows: DataFrame, *order: Column) -> DataFrame:
    """pos of a short list: results of a budgeted number of searches."""
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long"))


def _as_entries(candidates: DataFrame, now: str) -> DataFrame:
    """Candidates as queue entries: columns of ENTRY that they lack are null."""
    own = {"enrichmentStatus": F.lit("provisional"), "metadataSource": F.lit("local-fallback"), "discoveredAt": F.lit(now), "updatedAt": F.lit(now), "lastCheckedAt": F.lit(now), "canonicalUrl": F.col("primaryUrl")}
    columns = {c: F.col(c) for c in candidates.columns} | {c: v for c, v in own.items() if c not in candidates.columns}
    return candidates.select("pos", *[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY])


def discover(spark: SparkSession, folder: str, store: str, official: DataFrame, post: Callable[[str, dict], str], now: str, queries: int = 16, follow_ups: int = 4, readers: int = 20, least_readers: int = 4, candidates: int = 24, plans: DataFrame | None = None, refine: Callable[[DataFrame], DataFrame] | None = None, batch: int = 4, batches: int = 4, budget: Budget | None = None) -> dict:
    """A discovery run: search plans, scored hits, follow-up plans from hits, page reading, candidates, refinement, upsert, trace. The trace's counters.

    post(endpoint, body) answers searches and page reads. The queue is the snapshot under `store`; it changes by one swap at
    the end. What is not wanted is kept with its reason (rejected). refine(batch) may give cleaned rows of provisional
    candidates; failed batches stay provisional for the next run.
    """
    run = Run(spark, folder)
    picked = run.table("plans", lambda: search_plans.select_plans(plans if plans is not None else search_plans.static_plans(spark), max(1, queries - follow_ups)))
    first = run.table("hits", lambda: _hits(paged.search_web(picked, post, journal=run.journal), "initial"))

    def more_plans() -> DataFrame:
        seeds = _placed(first.where(queue.is_follow_up_seed(F.col("relevance"), F.col("url"))), F.desc("priority"), F.col("url"), F.col("title"))
        asked = search_plans.follow_up_plans(seeds.select("pos", "url", F.concat_ws(" ", "title", "snippet").alias("text")))
        fresh = queue.without_existing(catalog.dedupe_first(asked, ["query"], "pos"), picked, ["query"])
        chosen = queue.round_robin(fresh, "platform", "pos", follow_ups, ["web", "github", "x"])
        return chosen.select(F.lit("follow-up").alias("stage"), F.concat(F.lit("follow-up-"), "pick").alias("label"), "query", "platform", "intent", "parentUrl")

    later = run.table("follow_up_plans", more_plans)
    second = run.table("follow_up_hits", lambda: _hits(paged.search_web(later, post, journal=run.journal), "follow-up"))
    every = _placed(first.unionByName(second), F.desc("priority"), F.col("url"), F.col("title"), F.col("queryLabel"))

    def read() -> DataFrame:
        once = catalog.dedupe_first(every, ["url"], "pos")
        chosen = once.where("relevance.keep").orderBy(F.desc("priority"), "pos").limit(readers)
        if chosen.count() < least_readers:
            chosen = queue.backfill(chosen, once.where("NOT relevance.keep AND NOT relevance.strong_reject"), "url", [F.desc("priority"), F.col("pos")], least_readers).drop("tier")
        pages = paged.read_pages(chosen, post, journal=run.journal).withColumn("_p", queue.reader_payload(F.col("value")))
        return pages.select(*once.columns, F.col("_p.title").alias("readerTitle"), F.col("_p.excerpt").alias("readerExcerpt"))

    evidence = run.table("evidence", read)

    def staged() -> DataFrame:
        strong = queue.strong_candidates(evidence.select("*", F.col("relevance.score").alias("score")), candidates)
        own = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVIDENCE])
        held = evidence.groupBy(F.col("url").alias("primaryUrl")).agg(F.sort_array(F.collect_list(own)).alias("evidence"))  # a url is there once
        known = official.select(normalize_text(F.col("title")).alias("_k")).where("_k <> ''").distinct().withColumn("_official", F.lit(True))
        rows = strong.drop("platform").join(held, "primaryUrl", "left").withColumn("_k", normalize_text(F.col("title"))).join(known, "_k", "left")
        return rows.withColumn("reject", queue.reject_reason(F.col("title"), F.col("primaryUrl"), F.coalesce("_official", F.lit(False)))).drop("_k", "_official")

    judged = run.table("candidates", staged)
    accepted = run.table("accepted", lambda: _as_entries(_placed(judged.where("reject IS NULL").drop("reject"), F.desc("confidence"), F.col("title")), now))
    cleaned, errors = queue.refine(accepted, refine, batch, batches, budget) if refine else ([], [])
    for part in cleaned:
        accepted = accepted.unionByName(_as_entries(part.withColumn("pos", F.col("pos") + 1_000_000), now))
    stored = snapshots.read_snapshot(spark, store, ENTRY)
    before = _placed(stored, *queue.store_order(), F.col("id")).select("pos", *ENTRY.names)
    merged = run.table("queue", lambda: queue.upsert_queue(before, accepted, now).select(*ENTRY.names))
    version, written = snapshots.write_snapshot(merged, store, "id")

    count = lambda df, test="true": df.where(test).count()
    had, has, given = count(stored), count(merged), count(accepted)
    by_stage = {r["stage"]: r["n"] for r in every.groupBy("stage").agg(F.count("*").alias("n")).collect()}  # a row each stage
    trace = {
        "searchQueriesRun": count(picked) + count(later), "followUpSearchPlans": count(later), "rawSearchEvidenceCollected": count(every), "rejectedSearchEvidence": count(every, "NOT relevance.keep"), "readerEnrichedEvidence": count(evidence, "readerExcerpt <> ''"),
        "fallbackCandidates": count(judged), "rejectedCandidates": count(judged, "reject IS NOT NULL"), "extractionBatchesRun": len(cleaned) + len(errors), "added": has - had, "updated": given - (has - had), "searchStageBreakdown": by_stage, "errors": errors, "version": version, "partsWritten": written,
    }
    write_text(spark, f"{folder}/trace.json", [json.dumps(trace, ensure_ascii=False, indent=2), "\n"])
    return trace


def acceptance_query(title: Column, authors: Column) -> Column:
    """What is searched for to learn whether a paper has been accepted."""
    first = F.coalesce(F.concat(F.lit(' "'), blank(F.get(authors, 0)), F.lit('"')), F.lit(""))
    return F.concat(F.lit('"'), title, F.lit('"'), first, F.lit(' accepted OR "paper accepted" OR ACL OR AAAI OR CVPR OR ICCV OR ICLR OR ICML OR NeurIPS OR EMNLP 2026'))


_VERDICT = "struct<accepted:boolean,acceptedVenue:string,acceptedYear:int,confidence:double,reason:string,acceptanceEvidence:struct<url:string,title:string,venue:string,snippet:string>>"


def reconcile(spark: SparkSession, folder: str, store: str, official: DataFrame, post: Callable[[str, dict], str], now: str, limit: int = 24, force: bool = False, hits: int = 6, pages: int = 4) -> dict:
    """A reconciliation run: entries that the official list has are published; those due for a re-check are searched for, their pages read and a model asked; what it finds is merged and written as the next snapshot.

    An entry whose answer can't be read keeps its status. A status never falls.
    """
    run = Run(spark, folder)
    stored = snapshots.read_snapshot(spark, store, ENTRY)
    promoted = run.table("promoted", lambda: catalog.promote_official(stored, official).select(*ENTRY.names))
    time = lambda c: F.try_to_timestamp(F.col(c))
    due = promoted.where(queue.is_recheck_due(F.col("status"), F.col("title"), F.col("reason"), time("lastCheckedAt"), F.try_to_timestamp(F.lit(now)), force=force))
    checked = run.table("due", lambda: due.orderBy(*queue.queue_order(), "id").limit(limit).withColumn("query", acceptance_query(F.col("title"), F.col("authors"))))

    def found() -> DataFrame:
        answers = paged.search_web(checked.select("id", "query"), post, journal=run.journal)
        plan = {"stage": F.col("id"), "query": F.col("query"), "label": F.lit("recheck")}
        items = paged.search_items(answers.select("id", "query", "value"), "", plan).withColumnRenamed("stage", "id")
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(has_venue_year(F.concat_ws(" ", "title", "snippet"))), "url"))
        few = items.withColumn("_n", rank).where(F.col("_n") <= min(hits, pages))
        seen = paged.read_pages(few, post, journal=run.journal).withColumn("_p", queue.reader_payload(F.col("value")))
        rows = seen.select("id", F.col("_n").alias("pos"), platform_of(F.col("url")).alias("platform"), "url", "title", "author", "snippet", F.col("_p.title").alias("readerTitle"), F.col("_p.excerpt").alias("readerExcerpt"), "publishDate", "query")
        return rows

    evidence = run.table("evidence", found)

    def asked() -> DataFrame:
        own = F.sort_array(F.collect_list(F.struct("pos", F.struct("platform", "url", "title", "snippet", "readerTitle", "readerExcerpt").alias("e"))))  # at most `pages` each
        texts = checked.join(evidence.groupBy("id").agg(F.to_json(F.transform(own, lambda x: x["e"])).alias("_e")), "id", "left")
        told = F.to_json(F.struct("title", "authors", F.col("status").alias("currentStatus"), F.col("acceptedVenue").alias("currentAcceptedVenue")))
        prompt = F.concat(F.lit("Does the evidence show that this paper has been accepted by a main conference of 2026? Use nothing else. Answer in JSON with accepted, acceptedVenue, acceptedYear, confidence, reason and acceptanceEvidence (url, title, venue, snippet).\nPaper: "), told, F.lit("\nEvidence: "), F.coalesce("_e", F.lit("[]")))
        ask = lambda r: outside.message_text(outside.chat(post, {"messages": [{"role": "user", "content": r["prompt"]}]}))
        return map_limit(texts.select("id", prompt.alias("prompt")), ask, 2, "answer", ["prompt"], run.journal).select("id", F.from_json(json_block(F.col("answer")), _VERDICT).alias("v"))

    verdicts = run.table("verdicts", asked)

    def merged() -> DataFrame:
        v = F.col("v")
        venue = F.coalesce(blank(v["acceptedVenue"]), venue_rule(F.concat_ws(" ", v["reason"], v["acceptanceEvidence"]["title"]))["venue"])
        best = evidence.groupBy("id").agg(F.min_by(F.struct("url", "title", "readerExcerpt", "snippet"), "pos").alias("_b"), F.sort_array(F.collect_list(F.struct("pos", F.struct(*[f.name for f in EVIDENCE]).alias("e")))).alias("_all"))
        rows = promoted.join(checked.select("id", F.lit(True).alias("_due")), "id", "left").join(verdicts, "id", "left").join(best, "id", "left")
        yes = F.coalesce(v["accepted"] & venue.isNotNull(), F.lit(False))
        first = lambda *xs: F.coalesce(*[blank(x) for x in xs], F.lit(""))
        shown = F.struct(F.coalesce(v["confidence"], F.lit(0.0)).alias("confidence"), first(v["acceptanceEvidence"]["url"], F.col("_b.url")).alias("url"), first(v["acceptanceEvidence"]["title"], F.col("_b.title")).alias("title"), venue.alias("venue"), first(v["acceptanceEvidence"]["snippet"], F.col("_b.readerExcerpt"), F.col("_b.snippet")).alias("snippet"))
        new = {
            "status": F.when(yes & (F.col("status") != "officially-published"), "accepted").otherwise(F.col("status")), "acceptedVenue": F.when(yes, venue).otherwise(F.col("acceptedVenue")),
            "acceptedYear": F.when(yes, F.coalesce(F.when(v["acceptedYear"] > 0, v["acceptedYear"]), F.lit(2026))).otherwise(F.col("acceptedYear")), "reason": F.coalesce(blank(v["reason"]), F.col("reason")),
            "confidence": F.greatest(F.coalesce(v["confidence"], F.lit(0.0)), F.coalesce("confidence", F.lit(0.0))), "acceptanceEvidence": F.when(yes, shown).otherwise(F.col("acceptanceEvidence")),
            "evidence": F.concat(F.coalesce("evidence", F.expr(queue._NO_EVIDENCE)), F.coalesce(F.transform("_all", lambda x: x["e"]), F.expr(queue._NO_EVIDENCE))),
            "lastCheckedAt": F.when(F.col("_due") & v.isNotNull(), now).otherwise(F.col("lastCheckedAt")), "updatedAt": F.when(F.col("_due") & v.isNotNull(), now).otherwise(F.col("updatedAt")),
        }
        kept = rows.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col(f.name) for f in ENTRY], "_due")
        return queue.normalize_entry(kept.where("_due").drop("_due"), now).select(*ENTRY.names).unionByName(kept.where("_due IS NULL").drop("_due"))

    out = run.table("queue", merged)
    version, written = snapshots.write_snapshot(out, store, "id")
    status = lambda df, s: df.where(F.col("status") == s).count()
    return {"entries": out.count(), "published": status(out, "officially-published") - status(stored, "officially-published"), "promoted": status(out, "accepted") - status(promoted, "accepted"), "checked": checked.count(), "version": version, "partsWritten": written}


def refresh(steps: dict[str, Callable[[], object]], with_discovery: bool = False, budget: Budget | None = None) -> list[tuple[str, str, float]]:
    """The refresh of all artefacts: steps by name, each after those it needs; the first failure ends it. (name, state, seconds) of each.

    Fixed values: the order of steps. Discovery and reconciliation come first where they are wanted.
    """
    order = ["ingest", "shards", "sync-data", "embeddings", "sync-vectors", "validate"]
    if with_discovery:
        order = ["discover", "reconcile", *order]
    if missing := [n for n in order if n not in steps]:
        raise ValueError(f"no step for {', '.join(missing)}")
    return run_steps([Step(n, steps[n], order[i - 1 : i] if i else []) for i, n in enumerate(order)], budget)
