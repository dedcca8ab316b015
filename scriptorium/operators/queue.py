"""The discovery queue: evidence, candidates, merging, selection and re-checks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.display import enrichment_status, status_of_rank, status_rank
from ..functions.text import blank, let, longer_text, normalize_text, rx, squeeze, stable_id, unique_strings
from ..functions.titles import best_title, clean_narrative, clean_title, title_quality
from ..functions.venues import has_venue_year, is_high_signal, is_personal_homepage, valid_url, venue_rule
from ..shared import apart, cut
from ..values import CHAT_SOURCE, EVIDENCE_TERMS, REJECT_TERMS, STAGE_BONUS, STAGE_ORDER, STAGE_WEIGHTS
from .graph import connected_components
from .ordered import running
from .vectors import numbered


def scoring_text(*values: Column) -> Column:
    """Lower case, squeezed, with punctuation. NFKC is applied at ingest."""
    return squeeze(F.lower(F.concat_ws(" ", *values)))


def _of(column: Column, weights: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, weight in weights.items():
        out = F.when(column == name, weight).otherwise(out)
    return out


def evidence_score(text: Column, stage: Column, url: Column, terms: dict[str, dict[str, int]] = EVIDENCE_TERMS, reject: list[str] = REJECT_TERMS) -> Column:
    """(score, keep, strong_reject, signals): weighted terms in a text, its stage and its address. Term tables are literals in the plan."""
    return let(text, lambda body: _evidence_score(body, stage, url, terms, reject))


def _evidence_score(text: Column, stage: Column, url: Column, terms: dict[str, dict[str, int]], reject: list[str]) -> Column:
    rows = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"), F.lit(f"{group}:{t}").alias("s")) for group, words in terms.items() for t, w in words.items()])
    hits = F.filter(rows, lambda r: F.contains(text, r["t"]))
    return let(hits, lambda found: _relevance(found, text, stage, url, reject))


def _relevance(hits: Column, text: Column, stage: Column, url: Column, reject: list[str]) -> Column:
    bad = F.exists(F.array(*[F.lit(t) for t in reject]), lambda t: F.contains(text, t))
    high = is_high_signal(url)
    stage = F.coalesce(stage, F.lit(""))
    score = _of(stage, STAGE_WEIGHTS) + F.aggregate(hits, F.lit(0), lambda s, r: s + r["w"]) + F.when(bad, -5).otherwise(0) + F.when(high, 2).otherwise(0) + _of(stage, STAGE_BONUS)
    marks = F.filter(F.array(F.when(bad, "reject:non-paper-page"), F.when(high, "source:high-signal-url"), F.when(stage == "model-plan", "source:model-planned-query"), F.when(stage == "follow-up", "source:evidence-follow-up")), lambda x: x.isNotNull())
    keep = ~bad & ((score >= 3) | ((score >= 1) & (high | (stage == "follow-up"))))
    return F.struct(score.alias("score"), keep.alias("keep"), bad.alias("strong_reject"), F.concat(F.transform(hits, lambda r: r["s"]), marks).alias("signals"))


def is_follow_up_seed(relevance: Column, url: Column) -> Column:
    return (F.coalesce(url, F.lit("")) != "") & ~relevance["strong_reject"] & ((relevance["score"] >= 2) | is_high_signal(url))


def evidence_priority(score: Column, stage: Column, url: Column, text: Column) -> Column:
    """Score with the stage again, more for code sites and venue-years, less for listings."""
    part = lambda test, n: F.when(test, n).otherwise(0)
    return (
        score + _of(stage, STAGE_WEIGHTS) + part(url.rlike(r"(?i)github\.com|github\.io"), 4) + part(has_venue_year(text), 8)
        + part(url.rlike(r"(?i)arxiv\.org/list/"), -8) + part(scoring_text(text).rlike(rx(r"\bawesome\b|curated list|reading list|survey list|leaderboard")), -8)
    )


# Shapes of broken titles.
BROKEN_TITLE = [r"(?i)^github\s+-", r"(?i)\bgithub topics\b", r"(?i)\brepository files navigation\b", r"(?i)\bgo to file\b", r"(?i)\btable of contents\b", r"(?i)\bpersonal homepage\b", r"(?i)\bcall for papers\b", r"(?i)^bibtex\s+@", r"(?i)\b(?:title|author|booktitle)\s*=\s*\{", r"(?i)\s##\s*", r"(?i)\b(?:abstract|installation|quickstart)\b", r"(?i)\b[A-Z][A-Za-z-]+ [A-Z][A-Za-z-]+,\s+[A-Z][A-Za-z-]+ [A-Z][A-Za-z-]+", r"(?i)github\.io|github\.com|https?://", r"(?i)\b(research interests?|selected research)$"]


def is_broken_title(title: Column) -> Column:
    out = ~F.length(title).between(4, 300)
    for pattern in BROKEN_TITLE:
        out = out | title.rlike(rx(pattern))
    return out


def reject_reason(title: Column, url: Column, official: Column | None = None) -> Column:
    """Why a candidate is turned away, or null; the first reason counts. official: whether the official list has it."""
    text, address = squeeze(F.coalesce(title, F.lit(""))), valid_url(url)
    out = F.when((text == "") | (address == ""), "missing-title-or-primary-url").when(is_broken_title(text), "broken-title-shape")
    out = out.when(address.rlike(r"(?i)github\.com/topics/") | is_personal_homepage(address) | text.rlike(rx(r"(?i)\b(research interests?|selected research)\b")), "generic-homepage-or-topic")
    out = out.when(normalize_text(text) == "", "missing-title-key")
    return out if official is None else out.when(official, "already-in-official-catalog")


def round_robin(rows: DataFrame, group: str, pos: str, limit: int, order: list[str] = STAGE_ORDER) -> DataFrame:
    """Turns over the groups in their order, one row each, up to limit; then rows of other groups by position.

    Only the first `limit` rows of a group can be picked, which the ranking filter applies before the shuffle.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(pos))
    place = _of(F.col(group), {g: i + 1 for i, g in enumerate(order)})
    picked = rows.withColumn("turn", turn).where(F.col("turn") <= limit).withColumn("_p", place).withColumn("_known", F.col("_p") > 0)
    keys = [F.desc("_known"), F.when(F.col("_known"), F.col("turn")), F.col("_p"), F.col(pos)]
    return picked.orderBy(*keys).limit(limit).withColumn("pick", F.row_number().over(Window.orderBy(*keys))).drop("_p", "_known")


def without_existing(plans: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return plans.join(existing.select(*keys).distinct(), keys, "left_anti")


def backfill(accepted: DataFrame, rejected: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """Accepted rows first, then rejected ones, each key once, up to limit."""
    both = accepted.withColumn("tier", F.lit(0)).unionByName(rejected.withColumn("tier", F.lit(1)))
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("tier", *order))).where("_n = 1").drop("_n")
    return first.orderBy("tier", *order).limit(limit)


def merge_evidence(rows: DataFrame, owner: str, pos: str, last_wins: bool = False) -> DataFrame:
    """Evidence of an owner by platform and url: longest texts and last dates and queries; or whole last rows.

    All are aggregates over (length, position), so partial results combine in any order.
    """
    rows = rows.where(F.coalesce(F.col("url"), F.lit("")) != "").withColumn("platform", F.coalesce("platform", F.lit("web")))
    if last_wins:
        rest = [c for c in rows.columns if c not in (owner, "platform", "url", pos)]
        return rows.groupBy(owner, "platform", "url").agg(F.max_by(F.struct(*rest), F.col(pos)).alias("_r"), F.min(pos).alias(pos)).select(owner, "platform", "url", pos, *[F.col(f"_r.{c}").alias(c) for c in rest])
    texts = [c for c in ("title", "author", "snippet", "readerTitle", "readerExcerpt") if c in rows.columns]
    lasts = [c for c in ("publishDate", "query") if c in rows.columns]
    text = lambda c: blank(F.trim(F.col(c)))
    longest = [F.min_by(text(c), F.when(text(c).isNotNull(), F.struct(-F.length(text(c)), F.col(pos)))).alias(c) for c in texts]
    last = [F.coalesce(F.max_by(blank(F.col(c)), F.when(blank(F.col(c)).isNotNull(), F.col(pos))), F.lit("")).alias(c) for c in lasts]
    return rows.groupBy(owner, "platform", "url").agg(*longest, *last, F.min(pos).alias(pos))


def status_lattice(rows: DataFrame, key: str, status: str = "status") -> DataFrame:
    """The highest status that a key has had: a maximum, so order and repeats don't matter."""
    return rows.groupBy(key).agg(status_of_rank(F.max(status_rank(F.col(status)))).alias(status))


def is_legacy(title: Column, reason: Column) -> Column:
    empty = F.lit("")
    return F.coalesce(reason, empty).rlike("(?i)local high-confidence extraction") | F.coalesce(title, empty).rlike(r"(?i)^bibtex\s+@") | F.coalesce(title, empty).rlike(r"\s##\s*$")


def is_recheck_due(status: Column, title: Column, reason: Column, checked: Column, now: Column, hours: int = 18, force: bool = False) -> Column:
    """Published rows never; legacy ones always; accepted ones when forced; others after so many hours, or without a time that can be read."""
    stale = checked.isNull() | (F.unix_micros(now) - F.unix_micros(checked) > hours * 3_600_000_000)
    other = F.lit(True) if force else (status != "accepted") & stale
    return F.when(status == "officially-published", False).when(is_legacy(title, reason), True).otherwise(other)


def queue_order() -> list[Column]:
    """Accepted first, then confidence, recency and title."""
    time = F.coalesce(blank(F.col("updatedAt")), F.col("discoveredAt"), F.lit(""))
    return [F.desc(F.col("status") == "accepted"), F.coalesce(F.col("confidence"), F.lit(0.0)).desc(), time.desc(), F.coalesce("title", F.lit(""))]


def store_order() -> list[Column]:
    return [F.coalesce(blank(F.col("updatedAt")), F.col("discoveredAt"), F.lit("")).desc(), F.col("title")]


_NO_EVIDENCE = "cast(array() as array<struct<platform:string,url:string,title:string,author:string,snippet:string,readerTitle:string,readerExcerpt:string,publishDate:string,query:string>>)"


def merged_evidence(evidence: Column) -> Column:
    """An entry's evidence with one item for each platform and address, in order: longest texts, last dates and queries. Items without an address go."""
    none = F.lit(None).cast("string")
    named = lambda e: F.concat(F.coalesce(e["platform"], F.lit("web")), F.lit(":"), e["url"])

    def merge(own: Column) -> Column:
        of = lambda name: F.transform(own, lambda e: e[name])
        longest = lambda name: F.aggregate(of(name), none, longer_text).alias(name)
        last = lambda name: F.coalesce(F.get(F.filter(F.reverse(of(name)), lambda x: F.coalesce(x, F.lit("")) != ""), 0), F.lit("")).alias(name)
        return F.struct(F.coalesce(F.get(of("platform"), 0), F.lit("web")).alias("platform"), F.get(of("url"), 0).alias("url"), *[longest(n) for n in ("title", "author", "snippet", "readerTitle", "readerExcerpt")], last("publishDate"), last("query"))

    some = F.filter(evidence, lambda e: F.coalesce(e["url"], F.lit("")) != "")
    return let(some, lambda s: F.transform(F.array_distinct(F.transform(s, named)), lambda k: let(F.filter(s, lambda e: named(e) == k), merge)))


def normalize_entry(rows: DataFrame, now: str) -> DataFrame:
    """Queue rows with defaults, merged evidence, a clean title and narrative, an inferred venue and status, and an enrichment status."""
    raw = F.trim(F.coalesce("title", F.lit("")))
    none = F.array().cast("array<string>")
    given = F.coalesce(F.col("evidence"), F.expr(_NO_EVIDENCE))
    of = lambda name: F.transform(F.col("_evidence"), lambda e: e[name])
    direct = F.concat(F.flatten(F.transform("_evidence", lambda e: F.array(e["readerTitle"], e["title"]))), F.array(raw))
    texts = F.concat(F.array(raw, F.col("reason"), F.col("summary")), F.flatten(F.transform("_evidence", lambda e: F.array(e["readerTitle"], e["title"], e["snippet"], e["readerExcerpt"]))))
    rule = venue_rule(F.concat_ws(" ", "acceptedVenue", "reason", "summary"))
    rows = rows.withColumn("_evidence", merged_evidence(given)).withColumn("_title", F.coalesce(best_title(direct, texts), raw)).withColumn("_rule", rule)
    venue = F.coalesce(blank(F.col("acceptedVenue")), F.col("_rule.venue"))
    told = {f"_{c}": clean_narrative(F.col(c), raw, F.col("_title"), venue) for c in ("summary", "reason")}
    rows = rows.withColumns(told)
    state = enrichment_status(F.col("metadataSource"), F.col("_title"), F.col("_summary"), F.col("_reason"))
    lists = {c: unique_strings(F.coalesce(F.col(c), none)) for c in ("authors", "keywords", "titleAliases", "aliases")}
    new = {
        "id": F.coalesce(blank(F.col("id")), stable_id(F.col("_title"))), "title": F.col("_title"), "summary": F.col("_summary"), "reason": F.col("_reason"),
        **{c: blank(F.trim(F.col(c))) for c in ("titleZh", "abstract", "hookZh")},
        "primaryUrl": F.coalesce(blank(F.col("primaryUrl")), blank(F.col("canonicalUrl")), F.get(of("url"), 0), F.lit("")),
        "canonicalUrl": F.coalesce("canonicalUrl", F.lit("")), "pdfUrl": F.coalesce("pdfUrl", F.lit("")),
        "sourceId": F.coalesce(blank(F.col("sourceId")), blank(F.col("id")), stable_id(F.col("_title"))), "year": F.coalesce("year", F.lit(2026)),
        "status": F.when(status_rank(F.col("status")).isNotNull(), F.col("status")).when(venue.isNotNull(), "accepted").otherwise("candidate"),
        "confidence": F.coalesce("confidence", F.lit(0.0)), "acceptedVenue": venue, "acceptedYear": F.when(F.col("acceptedYear") > 0, F.col("acceptedYear")).otherwise(F.col("_rule.year")),
        "discoveredAt": F.coalesce(blank(F.col("discoveredAt")), F.lit(now)), "updatedAt": F.coalesce(blank(F.col("updatedAt")), F.lit(now)), "lastCheckedAt": F.coalesce("lastCheckedAt", F.lit("")),
        "enrichmentStatus": state, "metadataSource": F.coalesce(blank(F.trim(F.col("metadataSource"))), F.when(state == "provisional", "legacy-repaired").otherwise("unknown")),
        **lists, "platforms": unique_strings(F.concat(F.coalesce("platforms", none), F.transform(given, lambda e: e["platform"]))), "evidence": F.col("_evidence"), "evidenceCount": F.size("_evidence"),
    }
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns if c not in ("_evidence", "_title", "_rule", "_summary", "_reason")])


def upsert_match(rows: DataFrame) -> DataFrame:
    """(pos, target): the row that each candidate is merged into, by id, else title key, else primary, else canonical address.

    rows: pos (stored rows before candidates), stored, id, title_key, primary_url, canonical_url and urls (of evidence,
    which are looked up but never looked for). Later candidates see earlier merges: a key leads to the last row before
    that has it (an id to the first one), and from there to that row's own target. So each candidate has one parent,
    found by running values along its keys, and targets are the roots of the forest; no group of rows is replayed in
    one place. A candidate that matches nothing is its own target.
    """
    known = F.array(*[F.struct(F.lit(i).alias("prio"), F.concat(F.lit(mark), blank(F.col(c))).alias("k")) for i, (mark, c) in enumerate((("i:", "id"), ("t:", "title_key"), ("u:", "primary_url"), ("u:", "canonical_url")))])
    others = F.transform(F.coalesce("urls", F.array().cast("array<string>")), lambda u: F.struct(F.lit(9).alias("prio"), F.concat(F.lit("u:"), blank(u)).alias("k")))
    rows = cut(rows)
    marks = rows.select("pos", "stored", F.explode(F.concat(known, others)).alias("m")).where("m.k IS NOT NULL")
    marks = marks.groupBy("pos", F.col("m.k").alias("k")).agg(F.min("m.prio").alias("prio"), F.first("stored").alias("stored"))
    seen = running(marks, "k", "pos", last={"before": F.col("pos")}, most={"_first": -F.col("pos")})
    by = F.when(F.col("prio") == 0, -F.col("_first")).otherwise(F.col("before"))
    parents = seen.where(~F.col("stored") & (F.col("prio") < 9) & F.col("before").isNotNull()).groupBy("pos").agg(F.min_by(by, "prio").alias("parent"))
    roots = connected_components(parents.select(F.col("pos").alias("a"), F.col("parent").alias("b"))).withColumnsRenamed({"node": "pos"})
    return rows.where("NOT stored").select("pos").join(roots, "pos", "left").select("pos", F.coalesce("root", "pos").alias("target"))


def merge_entries(rows: DataFrame, target: str, pos: str, now: str | None = None) -> DataFrame:
    """One row for each target: its rows (in any subset of an entry's columns) folded in order of pos, and normalised if `now` is given.

    Status is the highest, confidence the greatest, acceptance evidence the surest (the earlier of equals); lists are joined
    in order and evidence is merged by platform and address; the first id and time of discovery stay, of addresses, times
    and sources the last that are there count. A title is the better one and other texts are the longer ones, unless the row
    before was provisional or legacy and the new row isn't: then what the new row has replaces all before it. A venue is
    replaced if there was none, or by a row that is surer than all before by more than 0.05 or has surer acceptance evidence.

    All of it is aggregates over positions: flags of each row come from running values, texts count from the last row that
    replaced them. So a target that many rows have is no single task's work.
    """
    out = _merged(rows, rows.select(target, pos), [target, pos], target, pos)
    return normalize_entry(out, now) if now else out


def _merged(rows: DataFrame, places: DataFrame, key: list[str], target: str, pos: str) -> DataFrame:
    """What merge_entries() folds; places has target and pos of each row's key.

    What depends on other rows is told from short columns, whose expressions over texts are evaluated once; texts are joined with it and aggregated, and are moved by nothing else.
    """
    columns = [c for c in rows.columns if c not in (target, pos, *key)]
    has = lambda c: c in columns
    of = lambda c, kind="string": F.col(c) if has(c) else F.lit(None).cast(kind)
    placed = lambda x: x if key == [target, pos] else x.join(places, key).drop(*key)
    sure = F.coalesce(of("confidence", "double"), F.lit(0.0))
    proof = F.coalesce(F.col("acceptanceEvidence.confidence"), F.lit(0.0)) if has("acceptanceEvidence") else F.lit(0.0)
    rule = venue_rule(F.concat_ws(" ", of("acceptedVenue"), of("reason"), of("summary")))
    stale = (F.coalesce(of("enrichmentStatus"), F.lit("")) == "provisional") | (F.coalesce(of("metadataSource"), F.lit("")) == "local-fallback") | is_legacy(of("title"), of("reason"))
    fine = (F.coalesce(of("metadataSource"), F.lit("")) == CHAT_SOURCE) | ~is_legacy(of("title"), of("reason"))
    texts = [c for c in ("title", "titleZh", "summary", "abstract", "reason", "hookZh") if has(c)]
    text = lambda c: blank(F.trim(F.col(c)))
    short = rows.withColumn("_rule", rule).select(
        *key, F.coalesce(blank(of("acceptedVenue")), F.col("_rule.venue")).alias("_venue"), F.coalesce(of("acceptedYear", "int"), F.col("_rule.year")).alias("_year"), blank(clean_title(of("title"))).alias("_clean"),
        stale.alias("_stale_"), fine.alias("_fine"), sure.alias("_sure_"), proof.alias("_proof_"), *[text(c).isNotNull().alias(f"_t_{c}") for c in texts],
    )
    short = running(cut(placed(cut(short))), target, pos, {"_stale": F.col("_stale_")}, {"_sure": F.col("_sure_"), "_proof": F.col("_proof_"), "_had": F.when(F.col("_venue").isNotNull(), 1)})
    short = short.withColumn("_fresh", F.coalesce("_stale", F.lit(False)) & F.col("_fine")).withColumn("_trust", F.col("_had").isNull() | (F.col("_sure_") > F.col("_sure") + 0.05) | (F.col("_proof_") > F.col("_proof")))
    short = cut(short.select(target, pos, "_venue", "_year", "_clean", "_fresh", "_trust", *[f"_t_{c}" for c in texts]))
    resets = short.groupBy(target).agg(F.count("*").alias("_rows"), *[F.max(F.when(F.col("_fresh") & F.col(f"_t_{c}"), F.col(pos))).alias(f"_r_{c}") for c in texts])
    short = short.join(apart(resets, target) if dict(places.dtypes)[target] == "bigint" else resets, target).drop("_fresh", "_rows", *[f"_t_{c}" for c in texts])
    work = rows.join(short if key == [target, pos] else places.join(short, [target, pos]), key)
    since = lambda c: F.col(f"_r_{c}").isNull() | (F.col(pos) >= F.col(f"_r_{c}"))
    there = lambda c: F.when(text(c).isNotNull() & since(c), F.struct(F.length(text(c)), -F.col(pos)))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(pos)))
    last_text = lambda c: F.max_by(blank(F.col(c)), F.when(blank(F.col(c)).isNotNull(), F.col(pos)))
    first_text = lambda c: F.min_by(blank(F.col(c)), F.when(blank(F.col(c)).isNotNull(), F.col(pos)))
    lists = [c for c in ("keywords", "titleAliases", "aliases", "authors", "platforms") if has(c)]
    made = {c: F.max_by(text(c), there(c)) for c in texts if c != "title"}
    if has("title"):
        among = since("title") & F.col("_clean").isNotNull()
        best = F.max_by("_clean", F.when(among, F.struct(title_quality(F.col("_clean")), F.col(pos))))
        raw = F.max_by(text("title"), F.when(text("title").isNotNull() & since("title"), F.col(pos)))
        made["title"] = F.when(F.count_if(since("title") & text("title").isNotNull()) > 1, F.coalesce(best, raw)).otherwise(raw)
    made |= {c: first_text(c) for c in ("id", "discoveredAt") if has(c)}
    made |= {c: F.coalesce(last_text(c), F.lit("")) for c in ("canonicalUrl", "primaryUrl", "pdfUrl", "updatedAt", "lastCheckedAt") if has(c)}
    value = {"acceptedVenue": "_venue", "acceptedYear": "_year"}
    made |= {c: F.coalesce(F.max_by(v, F.when(F.col("_trust") & F.col(v).isNotNull(), F.col(pos))), F.min_by(v, F.when(F.col(v).isNotNull(), F.col(pos)))) for c, v in value.items() if has(c)}
    if has("status"):
        made["status"] = F.coalesce(status_of_rank(F.max(status_rank(F.col("status")))), first_text("status"))
    if has("confidence"):
        made["confidence"] = F.max(sure)
    if has("acceptanceEvidence"):
        made["acceptanceEvidence"] = F.max_by("acceptanceEvidence", F.when(F.col("acceptanceEvidence").isNotNull(), F.struct(proof, -F.col(pos))))
    made |= {c: last(c) for c in columns if c not in made and c not in (*lists, "evidence", "evidenceCount")}
    out = work.groupBy(target).agg(*[x.alias(c) for c, x in made.items()])
    if lists:
        out = out.join(_joined_lists(placed(rows.select(*key, *lists)), target, pos, lists), target, "left")
    if has("evidence"):
        out = out.join(_joined_evidence(placed(rows.select(*key, "evidence")), target, pos), target, "left").withColumn("evidence", F.coalesce("evidence", F.expr(_NO_EVIDENCE)))
    if has("evidenceCount"):
        out = out.withColumn("evidenceCount", F.size("evidence") if has("evidence") else F.lit(None).cast("int"))
    none = F.array().cast("array<string>")
    return out.select(target, *[(F.coalesce(F.col(c), none) if c in lists else F.col(c)).cast(dict(rows.dtypes)[c]).alias(c) for c in columns])


def _joined_lists(rows: DataFrame, target: str, pos: str, names: list[str]) -> DataFrame:
    """Values of list columns, trimmed, each once, in the order in which rows have them; counted apart, so that equal values of many rows are one."""
    none = F.array().cast("array<string>")
    tagged = lambda n: F.transform(F.coalesce(F.col(n), none), lambda x, i: F.struct(F.lit(n).alias("n"), F.trim(x).alias("v"), i.alias("i")))
    own = lambda n: F.transform(F.filter("_all", lambda x: x["n"] == n), lambda x: x["v"])
    every = F.concat(*map(tagged, names))
    values = rows.select(target, pos, F.explode(every).alias("x")).where("coalesce(x.v, '') <> ''")
    first = values.groupBy(target, F.col("x.n").alias("n"), F.col("x.v").alias("v")).agg(F.min(F.struct(F.col(pos).alias("p"), F.col("x.i").alias("i"))).alias("at"))
    kept = first.groupBy(target).agg(F.array_sort(F.collect_list(F.struct("at", "n", "v"))).alias("_all"))
    return kept.select(target, *[own(n).alias(n) for n in names])


def _joined_evidence(rows: DataFrame, target: str, pos: str) -> DataFrame:
    """Evidence of all rows of a target, merged by platform and address, in the order in which they first appear."""
    items = rows.select(target, F.col(pos).alias("_row"), F.posexplode("evidence").alias("_i", "e")).select(target, F.struct("_row", "_i").alias("_at"), "e.*")
    merged = merge_evidence(items, target, "_at")
    fields = ("platform", "url", "title", "author", "snippet", "readerTitle", "readerExcerpt", "publishDate", "query")
    ordered = F.array_sort(F.collect_list(F.struct("_at", F.struct(*fields).alias("e"))))
    return merged.groupBy(target).agg(F.transform(ordered, lambda x: x["e"]).alias("evidence"))


def upsert_queue(stored: DataFrame, candidates: DataFrame, now: str) -> DataFrame:
    """The queue after candidates: each is matched, merged into its target and normalised; rows keep their order. Both tables are entries with pos, within each table."""
    both = stored.withColumn("_stored", F.lit(True)).unionByName(candidates.withColumn("_stored", F.lit(False)))
    both = cut(both.withColumn("_id", F.monotonically_increasing_id()))
    places = cut(numbered(both.select("_id", "_stored", F.struct(~F.col("_stored"), F.col("pos")).alias("_o")), "_o", into="_pos").select("_id", "_stored", "_pos"))  # only numbers are sorted and joined, not texts
    told = both.select("_id", "id", normalize_text(F.col("title")).alias("title_key"), F.col("primaryUrl").alias("primary_url"), F.col("canonicalUrl").alias("canonical_url"), F.transform("evidence", lambda e: e["url"]).alias("urls"))
    keys = told.join(places.select("_id", F.col("_pos").alias("pos"), F.col("_stored").alias("stored")), "_id").drop("_id")
    target = upsert_match(keys).withColumnsRenamed({"pos": "_pos", "target": "_target"})
    places = cut(places.join(target, "_pos", "left").select("_id", "_pos", F.coalesce("_target", "_pos").alias("_target")))
    merged = _merged(both.drop("_stored", "pos"), places, ["_id"], "_target", "_pos").orderBy("_target")  # sorted before texts are normalised, as a sort's sample evaluates what is below it
    return normalize_entry(merged, now).drop("_target")


def evidence_backfill(papers: DataFrame, candidates: DataFrame, key: str = "id") -> DataFrame:
    """Refined papers with their own evidence, else that of the candidate of their id (the first of its id), else none."""
    have = candidates.groupBy(key).agg(F.first("evidence", ignorenulls=True).alias("_have"))
    return papers.join(have, key, "left").withColumn("evidence", F.coalesce("evidence", "_have", F.expr(_NO_EVIDENCE))).select(*papers.columns)


def compact_evidence(value: Column, size: int) -> Column:
    """A squeezed text of at most size characters, dots at its end if it was longer."""
    text = squeeze(F.coalesce(value, F.lit("")))
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.left(text, F.lit(size - 3))), F.lit("..."))).otherwise(text)


_PAGE = "title:string,page_title:string,name:string,content:string,text:string,markdown:string,summary:string"
#: A page reader's answer in all its shapes.
_ANSWER = f"struct<{_PAGE},reader_result:struct<{_PAGE}>,webpage_content:struct<{_PAGE}>,data:struct<{_PAGE},reader_result:struct<{_PAGE}>>,result:struct<{_PAGE}>>"


def reader_payload(json: Column) -> Column:
    """(title, excerpt) of a page reader's answer, whatever shape it has; parsed once."""

    def pick(x: Column) -> Column:
        roots = [x["reader_result"], x["webpage_content"], x["data"]["reader_result"], x["data"], x["result"], x]
        first = lambda *names: F.coalesce(*[blank(r[n]) for n in names for r in roots], F.lit(""))
        excerpt = F.regexp_replace(first("content", "text", "markdown", "summary"), r"\s+", " ")
        return F.struct(F.trim(first("title", "page_title", "name")).alias("title"), F.trim(F.left(excerpt, F.lit(2200))).alias("excerpt"))

    return let(F.from_json(json, _ANSWER), pick)


def provisional_batches(entries: DataFrame, size: int, most: int) -> Iterator[DataFrame]:
    """Batches of provisional rows by queue order, for refinement by an outside model: at most `most` batches of `size`."""
    head = entries.where("enrichmentStatus = 'provisional' AND status <> 'officially-published'").orderBy(*queue_order()).limit(size * most)
    placed = cut(head.withColumn("_b", F.floor((F.row_number().over(Window.orderBy(*queue_order())) - 1) / size)))  # at most size * most rows, sorted once
    for b in range(most):
        yield placed.where(F.col("_b") == b).drop("_b")


def refine(entries: DataFrame, ask, size: int, most: int, budget=None) -> tuple[list[DataFrame], list[str]]:
    """What ask(batch) gives for batches of provisional rows, and the errors of those that failed; a failed batch stays provisional and so is asked again in the next run.

    A batch is a DataFrame of at most `size` rows; its answer is written at once, so that what goes wrong in it is its own. Ends early when the budget has expired or an error says that the limit of calls is reached (status 429).
    """
    done, errors = [], []
    for batch in provisional_batches(entries, size, most):
        if budget and budget.expired():
            break
        try:
            done.append(cut(ask(batch)))
        except Exception as error:  # the next run's work
            errors.append(str(error))
            if getattr(error, "status", None) == 429:
                break
    return done, errors


def strong_candidates(evidence: DataFrame, limit: int) -> DataFrame:
    """Queue candidates from evidence (pos, url, platform, title, snippet, readerTitle, readerExcerpt, score, priority) that names an accepted paper.

    The venue must stand in the texts with a year and a word of acceptance, of no other track, at a source that counts;
    the best row of each title stays, up to limit by priority. Confidence is score / 36 within 0.78 and 0.96.
    """
    from ..functions.titles import title_from_evidence
    from ..functions.venues import is_strong_source, other_track, platform_of, repository, venue_in_evidence

    body = F.concat_ws(" ", blank(F.col("title")), blank(F.col("readerTitle")), blank(F.col("snippet")), blank(F.col("readerExcerpt")))
    rows = evidence.withColumn("_body", body).withColumn("acceptedVenue", venue_in_evidence(F.col("_body"))).where(F.col("acceptedVenue").isNotNull() & ~other_track(F.col("_body")) & is_strong_source(F.col("url")))
    sources = F.filter(F.array(*[blank(F.col(c)) for c in ("readerTitle", "title", "snippet", "readerExcerpt")]), lambda x: x.isNotNull())
    title = title_from_evidence(sources, F.get(F.split("acceptedVenue", " "), 0), repository(F.col("url"))["name"])
    # a generator, so that the long expression is evaluated once and not again in each test of it
    rows = rows.select("*", F.explode(F.filter(F.array(title), lambda t: t.isNotNull() & ~is_broken_title(t))).alias("_t")).withColumn("_k", normalize_text(F.col("_t"))).where("_k <> ''")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("priority"), "pos"))).where("_n = 1")
    return first.orderBy(F.desc("priority"), "pos").limit(limit).select(
        stable_id(F.col("_t")).alias("id"), F.col("_t").alias("title"), F.lit("accepted").alias("status"), F.least(F.greatest(F.coalesce("score", F.lit(12)) / 36.0, F.lit(0.78)), F.lit(0.96)).alias("confidence"),
        "acceptedVenue", F.lit(2026).alias("acceptedYear"), F.col("url").alias("primaryUrl"), F.coalesce(blank(F.col("platform")), platform_of(F.col("url"))).alias("platform"),
    )


def toggled(selection: set[str], value: str) -> set[str]:
    """A selection with a value put in or taken out."""
    return selection ^ {value}


def toggled_values(selection: Column, value: Column) -> Column:
    """A selection's array with a value put at its end or taken out."""
    return F.when(F.array_contains(selection, value), F.array_remove(selection, value)).otherwise(F.concat(selection, F.array(value)))
