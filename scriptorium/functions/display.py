"""How rows are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import CHAT_SOURCE, STATUS_RANK, WAITING


def timestamp_or_epoch(value: Column) -> Column:
    """Text to a timestamp; missing and broken values are the epoch."""
    return F.coalesce(F.try_to_timestamp(value), F.timestamp_seconds(F.lit(0)))


def relative_time(ts: Column, now: Column) -> Column:
    """How long before now, in minutes up to 59, hours up to 47, else days; halves round up."""
    half_up = lambda x: F.floor(x + 0.5).cast("long")
    minutes = half_up((F.unix_micros(now) - F.unix_micros(ts)) / 60_000_000.0)
    hours = half_up(minutes / 60.0)
    days = half_up(hours / 24.0)
    side = lambda x: F.when(x >= 0, " ago").otherwise(" later")
    text = lambda x, unit: F.concat(F.abs(x).cast("string"), unit, side(x))
    shown = F.when(F.abs(minutes) < 1, "Just now").when(F.abs(minutes) < 60, text(minutes, F.lit(" min"))).when(F.abs(hours) < 48, text(hours, F.lit(" hr")))
    return F.when(ts.isNull(), "Unknown time").otherwise(shown.otherwise(text(days, F.when(F.abs(days) == 1, " day").otherwise(" days"))))


def status_rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def status_of_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STATUS_RANK]), rank)


def status_label(status: Column) -> Column:
    return F.when(status == "officially-published", "Officially published").when(status == "accepted", "Accepted signal").otherwise("Candidate signal")


def status_tone(status: Column) -> Column:
    return F.when(status == "officially-published", "muted").when(status == "accepted", "good").otherwise("active")


def run_tone(status: Column, conclusion: Column) -> Column:
    return F.when(status == "in_progress", "active").when(conclusion == "success", "good").when(conclusion.isin("failure", "cancelled"), "bad").otherwise("muted")


def run_label(status: Column, conclusion: Column) -> Column:
    named = F.when(status == "in_progress", "Running").when(conclusion == "success", "Healthy").when(conclusion == "failure", "Failed").when(conclusion == "cancelled", "Cancelled")
    return F.when(status.isNull(), "No workflow run yet.").otherwise(named.otherwise(status))


def enrichment_status(source: Column, *texts: Column) -> Column:
    """Provisional while a text waits for enrichment and unless a chat model wrote it."""
    waits = F.concat_ws(" ", *texts).rlike(f"(?i){WAITING}")
    return F.when(waits, "provisional").when(F.trim(source) == CHAT_SOURCE, "cleaned").otherwise("provisional")


def affinity_label(lexical: Column, semantic: Column, rank: Column) -> Column:
    """L and whole points, a cosine with 4 decimals, or H and a rank score."""
    four = lambda x: F.format_string("%.4f", x)
    return F.when(lexical.isNotNull(), F.concat(F.lit("L"), F.floor(lexical + 0.5).cast("string"))).when(semantic.isNotNull(), four(semantic)).when(rank.isNotNull(), F.concat(F.lit("H"), four(rank))).otherwise("1.0000")


def lexical_affinity(score: Column) -> Column:
    return F.format_string("%.4f", F.least(score / 100.0, F.lit(0.9999)))


def bibtex(authors: Column, identity: Column, title: Column, venue: Column, year: Column, url: Column) -> Column:
    last = F.lower(F.element_at(F.split(F.get(authors, 0), " "), -1))
    key = F.concat(F.coalesce(last, F.lit("paper")), year.cast("string"), F.left(identity, F.lit(8)))
    return F.format_string("@inproceedings{%s,\n  title={%s},\n  author={%s},\n  booktitle={%s},\n  year={%s},\n  url={%s}\n}", key, title, F.array_join(authors, " and "), venue, year.cast("string"), url)


def display_summary(summary: Column, reason: Column, snippet: Column, excerpt: Column) -> Column:
    text = F.trim(F.coalesce(F.nullif(summary, F.lit("")), reason, F.lit("")))
    other = F.coalesce(F.nullif(snippet, F.lit("")), F.nullif(excerpt, F.lit("")), F.lit("No summary yet."))
    return F.when(text == "", other).otherwise(F.trim(F.regexp_replace(text, r"(?i)(?:;\s*)?waiting for Zhipu enrichment\.?$", "")))


def humanize_key(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("-"), F.lit(" ")))
