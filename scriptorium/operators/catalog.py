"""The catalogue: classification, canonical rows, deduplication, enrichment, shards, facets and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.display import status_rank
from ..functions.text import blank, clean_list, contained, content_value, let, normalize_keywords, normalize_text, parse_authors, slugify, split_keywords, stable_id, unique_strings
from ..functions.venues import venue_short, venue_year_key
from ..values import CATEGORY_HINTS, DEFAULT_CATEGORY, FOCUS_HINTS, INTRO_KEYS, RELEVANT_TERMS, UNCLASSIFIED
from .vectors import numbered


def classify(text: Column, hints: dict[str, list[str]] = CATEGORY_HINTS, focus: list[str] = FOCUS_HINTS, default: str = DEFAULT_CATEGORY, most: int = 4) -> Column:
    """(focus_score, primary, categories, matched) of a text: categories by the number of hints it contains, ties in the order of definition.

    Hints are substrings on purpose. The hint lists are literals in the plan, so nothing is joined.
    """
    return let(normalize_text(text), lambda body: _classify(body, hints, focus, default, most))


def _classify(body: Column, hints: dict[str, list[str]], focus: list[str], default: str, most: int) -> Column:
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(key).alias("key"), contained(body, [h.lower() for h in words]).alias("matched")) for i, (key, words) in enumerate(hints.items())])
    ranked = F.array_sort(F.transform(F.filter(rows, lambda r: F.size(r["matched"]) > 0), lambda r: F.struct((-F.size(r["matched"])).alias("n"), r["ord"].alias("ord"), r["key"].alias("key"), r["matched"].alias("matched"))))
    return let(ranked, lambda found: _chosen_categories(found, body, focus, default, most))


def _chosen_categories(ranked: Column, body: Column, focus: list[str], default: str, most: int) -> Column:
    keys = F.transform(ranked, lambda r: r["key"])
    return F.struct(
        F.size(contained(body, focus)).alias("focus_score"),
        F.coalesce(F.get(keys, 0), F.lit(default)).alias("primary"),
        F.slice(keys, 1, most).alias("categories"),
        F.map_from_entries(F.transform(ranked, lambda r: F.struct(r["key"], r["matched"]))).alias("matched"),
    )


def is_relevant_title(title: Column, focus: list[str] = FOCUS_HINTS, terms: list[str] = RELEVANT_TERMS) -> Column:
    return let(normalize_text(title), lambda body: (F.size(contained(body, focus)) > 0) | (F.size(contained(body, terms)) > 0))


def canonical(records: DataFrame, hints: dict[str, list[str]] = CATEGORY_HINTS) -> DataFrame:
    """Canonical catalogue rows: classified afresh (incoming categories are not used), defaults set, keywords joined with track, categories and source.

    Expects id, title, venue, year, track, keywords, authors, openreviewUrl, pdfUrl, tldr, abstract, source, sourceId, sourceType.
    """
    words = F.coalesce(F.col("keywords"), F.array().cast("array<string>"))
    found = classify(F.concat_ws(" ", "title", "abstract", "tldr", F.array_join(words, " "), "track"), hints)
    rows = records.withColumn("_c", found)
    categories = F.when(F.size("_c.categories") > 0, F.col("_c.categories")).otherwise(F.array(F.col("_c.primary")))
    authors = F.filter(F.transform(F.coalesce(F.col("authors"), F.array().cast("array<string>")), F.trim), lambda x: x != "")
    return rows.select(
        F.coalesce(blank(F.col("id")), F.concat_ws("-", "source", slugify(F.col("title")))).alias("id"), "title", "venue", F.coalesce("year", F.lit(2026)).alias("year"), blank(F.col("track")).alias("track"),
        F.col("_c.primary").alias("primaryCategory"), categories.alias("categories"), normalize_keywords(F.concat(words, F.array("track"), categories, F.array("source"))).alias("keywords"),
        F.when(F.size(authors) > 0, authors).otherwise(F.array(F.lit("Unknown authors"))).alias("authors"), "openreviewUrl", blank(F.col("pdfUrl")).alias("pdfUrl"),
        F.coalesce("tldr", F.lit("")).alias("tldr"), F.coalesce("abstract", F.lit("")).alias("abstract"), "source", "sourceId", F.coalesce("sourceType", F.lit("official")).alias("sourceType"),
    )


def _chosen(rows: DataFrame, keys: list[str], pos: str, best) -> DataFrame:
    """One row of each key by an aggregate, which is combined before the shuffle, so that a common key is no single task's window."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(best(F.struct(*rest), F.col(pos)).alias("_r"))
    return picked.select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns])


def dedupe_first(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first row of each key."""
    return _chosen(rows, keys, pos, F.min_by)


def dedupe_last(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The last row of each key, with the position at which the key was first seen."""
    first = rows.groupBy(*keys).agg(F.min(pos).alias("_first"))
    last = _chosen(rows, keys, pos, F.max_by)
    same = [last[k].eqNullSafe(first[k]) for k in keys]
    return last.join(first, same).select(*[F.col("_first").alias(pos) if c == pos else last[c] for c in rows.columns])


def suffix_ids(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Ids that repeat get -2, -3 and so on in order of position; an id that many rows have is counted by many tasks."""
    counted = numbered(rows, pos, key, "_n")
    return counted.withColumn(key, F.when(F.col("_n") == 0, F.col(key)).otherwise(F.concat_ws("-", key, F.col("_n") + 1))).drop("_n")


def dedupe_records(records: DataFrame, pos: str = "pos") -> DataFrame:
    """Catalogue rows by venue and normalised title, first wins; then ids made unique."""
    keyed = records.withColumn("_k", F.concat_ws(":", "venue", normalize_text(F.col("title"))))
    return suffix_ids(dedupe_first(keyed, ["_k"], pos).drop("_k"), "id", pos)


def with_fallback(current: DataFrame, snapshot: DataFrame, source: str, strict: bool = False) -> DataFrame:
    """Current rows, and those of the snapshot from sources that gave none this time; strict: an empty result raises."""
    out = current.unionByName(snapshot.join(current.select(source).distinct(), source, "left_anti").select(*current.columns))
    if strict and not out.head(1):
        raise ValueError("neither the current rows nor the snapshot have any")
    return out


def enrich_with_guides(papers: DataFrame, guides: DataFrame, carry: list[str], pos: str = "pos") -> DataFrame:
    """Left join by id, else by normalised title, else by address; of guides with one key the last counts.

    One join for each key, each an equi-join of a side with one row a key; Catalyst broadcasts the small ones.
    papers and guides have id, title, url; guides also pos and the columns to carry.
    """
    out = papers.withColumn("_title", normalize_text(F.col("title")))
    sides = {"id": F.col("id").cast("string"), "_title": normalize_text(F.col("title")), "url": F.col("url")}
    for i, (key, value) in enumerate(sides.items()):
        side = guides.select(value.alias("_k"), F.col(pos), *carry).where(F.col("_k").isNotNull() & (F.col("_k") != ""))
        side = side.groupBy("_k").agg(F.max_by(F.struct(F.lit(True).alias("hit"), *carry), F.col(pos)).alias(f"_g{i}"))
        out = out.join(side, F.col(key).cast("string") == F.col("_k"), "left").drop("_k")
    guide = F.coalesce("_g0", "_g1", "_g2")
    return out.withColumn("_g", guide).select(*[papers[c] for c in papers.columns], *[F.col(f"_g.{c}").alias(c) for c in carry], F.when(F.col("_g.hit"), "ready").otherwise("pending").alias("guideStatus"))


def without_official(rows: DataFrame, official: DataFrame, title: str = "title") -> DataFrame:
    """Rows whose title key no official row has."""
    keys = official.select(normalize_text(F.col(title)).alias("_k")).where("_k <> ''").distinct()
    return rows.withColumn("_k", normalize_text(F.col(title))).join(keys, "_k", "left_anti").drop("_k")


def promote_official(rows: DataFrame, official: DataFrame) -> DataFrame:
    """Queue rows that the official list has by title: published, with its venue and year and confidence 1; the first official row counts."""
    first = official.withColumn("_k", normalize_text(F.col("title"))).where("_k <> ''").groupBy("_k").agg(F.min_by(F.struct("venue", "year"), F.col("pos")).alias("_o"))
    out = rows.withColumn("_k", normalize_text(F.col("title"))).join(first, "_k", "left")
    hit = F.col("_o").isNotNull()
    new = {"status": F.lit("officially-published"), "acceptedVenue": F.col("_o.venue"), "acceptedYear": F.col("_o.year"), "confidence": F.lit(1.0)}
    return out.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])


def unofficial_papers(entries: DataFrame, official: DataFrame) -> DataFrame:
    """Catalogue rows of queue entries that are candidates or accepted, cleaned, and not on the official list.

    entries: columns of schemas.ENTRY; evidence may be null. The first address of primary, canonical and evidence counts.
    """
    live = entries.where((status_rank(F.col("status")) >= 1) & (F.col("status") != "officially-published") & ~F.col("enrichmentStatus").eqNullSafe("provisional"))
    rows = without_official(live, official)
    none = F.array().cast("array<string>")
    words = F.coalesce("keywords", none)
    found = classify(F.concat_ws(" ", blank(F.col("title")), blank(F.col("summary")), blank(F.col("abstract")), blank(F.col("reason")), F.array_join(words, " "), blank(F.col("acceptedVenue"))))
    accepted = F.col("status") == "accepted"
    places = unique_strings(F.concat(F.coalesce("platforms", none), F.coalesce(F.transform("evidence", lambda e: e["platform"]), none)))
    rows = rows.withColumn("_c", found).withColumn("_p", places)
    missing = lambda c, *other: F.coalesce(blank(F.col(c)), *other)
    return rows.select(
        F.coalesce("id", stable_id(F.col("title"))).alias("id"), "title", F.when(accepted & blank(F.col("acceptedVenue")).isNotNull(), F.col("acceptedVenue")).otherwise(UNCLASSIFIED).alias("venue"),
        F.coalesce(F.when(accepted, F.col("acceptedYear")), F.col("year"), F.lit(2026)).alias("year"), F.when(accepted, "Accepted signal pending official venue page").otherwise("Social/web discovery queue").alias("track"),
        F.col("_c.primary").alias("primaryCategory"), F.when(F.size("_c.categories") > 0, F.col("_c.categories")).otherwise(F.array(F.col("_c.primary"))).alias("categories"),
        F.slice(unique_strings(F.concat(words, F.array(blank(F.col("acceptedVenue"))), F.col("_p"), F.array(F.lit("unofficial")))), 1, 16).alias("keywords"),
        F.when(F.size(F.coalesce("authors", none)) > 0, F.col("authors")).otherwise(F.array(F.lit("Unknown authors"))).alias("authors"),
        missing("primaryUrl", blank(F.col("canonicalUrl")), F.get(F.transform("evidence", lambda e: e["url"]), 0)).alias("openreviewUrl"),
        missing("summary", F.col("reason"), F.lit("")).alias("tldr"), missing("abstract", blank(F.col("summary")), blank(F.col("reason")), F.lit("Discovered from social or personal-page signals; a full abstract is not available yet.")).alias("abstract"),
        F.when(accepted, "accepted").otherwise("candidate").alias("acceptanceStatus"), F.lit("unofficial").alias("sourceType"), F.col("_p").alias("platforms"), F.coalesce("evidenceCount", F.size("evidence"), F.lit(0)).alias("evidenceCount"),
    )


def catalog_order(venue: str = "venue", title: str = "title") -> list[Column]:
    """Venue, then title, as readers order words: by the root collation of Unicode and not by code point."""
    return [F.collate(F.col(c), "UNICODE") for c in (venue, title)]


def shard_key(venue: Column, year: Column) -> Column:
    return F.concat_ws("-", year.cast("string"), slugify(venue, "venue"))


def shard_manifest(papers: DataFrame, pos: str = "pos") -> DataFrame:
    """key, venue, year, count of each shard; labels are those of its first row."""
    rows = papers.groupBy(shard_key(F.col("venue"), F.col("year")).alias("key")).agg(F.min_by("venue", pos).alias("venue"), F.min_by("year", pos).alias("year"), F.count("*").alias("count"))
    return rows.withColumn("path", F.concat(F.lit("shards/"), "key", F.lit(".json")))


def facet_venue_year(papers: DataFrame) -> DataFrame:
    return papers.groupBy(venue_short(F.col("venue")).alias("venue"), "year").agg(F.count("*").alias("count"))


def facet(papers: DataFrame, column: str) -> DataFrame:
    return papers.groupBy(column).agg(F.count("*").alias("count"))


def facet_filter(papers: DataFrame, venue_years: list[str], categories: list[str], category: str = "primaryCategory") -> DataFrame:
    """Rows of any chosen venue-year and any chosen category; none chosen: all pass."""
    if venue_years:
        papers = papers.where(venue_year_key(F.col("venue"), F.col("year")).isin(*venue_years))
    return papers.where(F.col(category).isin(*categories)) if categories else papers


def paginate(ranked: DataFrame, order: list[Column], cap: int, page: int, per_page: int) -> DataFrame:
    """A page of the first `cap` rows in order, with rank and the number of pages; page sizes are 1 to 50, 10 if 0."""
    size = min(max(per_page or 10, 1), 50)
    head = ranked.orderBy(*order).limit(max(cap, 1))  # a top-k, not a full sort
    w = Window.orderBy(*order)
    paged = head.withColumn("rank", F.row_number().over(w)).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy()) / size)).cast("int"))
    return paged.where(F.col("rank").between((page - 1) * size + 1, page * size))


def validate(records: DataFrame, categories: list[str] = [*CATEGORY_HINTS], require_guides: bool = False, strict: bool = False) -> DataFrame:  # noqa: B006
    """(id, title, problem): one row for every rule that a record breaks; no rows: all are valid. Rows with an id that was seen count as duplicates."""
    known = F.array(*[F.lit(c) for c in categories])
    say = lambda test, text: F.when(test, text if isinstance(text, Column) else F.lit(text))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    url_ok = lambda c: F.col(c).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://?[^\s/]\S*$")
    tests = [say(F.coalesce(F.col(c), F.lit("")) == "", f"missing string field {c}") for c in ("id", "title", "venue", "primaryCategory", "openreviewUrl", "abstract")]
    tests += [say(F.col("_n") > 1, F.concat(F.lit("duplicate id "), "id"))]
    tests += [say(~F.array_contains(known, F.coalesce("primaryCategory", F.lit(""))), F.concat(F.lit("invalid primaryCategory "), F.coalesce("primaryCategory", F.lit("undefined"))))]
    tests += [say(empty(c), f"{c} must be a non-empty array") for c in ("categories", "authors", "keywords")]
    tests += [say((F.coalesce(F.col(c), F.lit("")) != "") & ~url_ok(c), f"{c} is not a valid URL") for c in ("openreviewUrl", "pdfUrl")]
    if "introZh" in records.columns:
        tests += [say(F.col("introZh").isNotNull() & (F.coalesce(F.col(f"introZh.{k}"), F.lit("")) == ""), f"missing introZh.{k}") for k in INTRO_KEYS]
        tests += [say(F.col("introZh").isNull(), "introZh is required")] if require_guides else []
    if strict:
        tests += [say(F.to_json(F.struct(*[F.col(c) for c in records.columns])).rlike("待生成|TODO"), "contains placeholder text")]
    wrong = F.transform(F.filter(F.coalesce("categories", F.array().cast("array<string>")), lambda c: ~F.array_contains(known, c)), lambda c: F.concat(F.lit("invalid category "), c))
    rows = records.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("title")))
    return rows.select("id", "title", F.explode(F.concat(F.filter(F.array(*tests), lambda x: x.isNotNull()), wrong)).alias("problem"))


def from_notes(notes: DataFrame) -> DataFrame:
    """Catalogue candidates of review-site notes (forum, content as JSON): fields are values or hold one, the year stands in the venue."""
    at = lambda k: F.trim(F.coalesce(content_value(F.col("content"), k), F.lit("")))
    listed = F.from_json(content_value(F.col("content"), "keywords"), "array<string>")
    words = F.coalesce(clean_list(listed), split_keywords(at("keywords")))
    names = F.from_json(content_value(F.col("content"), "authors"), "array<string>")
    authors = F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0, clean_list(names)).otherwise(parse_authors(at("_bibtex"), at("authors")))
    rows = notes.select("forum", at("title").alias("title"), at("venue").alias("venue"), at("abstract").alias("abstract"), F.coalesce(blank(at("TLDR")), at("tldr")).alias("tldr"), words.alias("keywords"), at("primary_area").alias("track"), at("pdf").alias("pdf"), authors.alias("authors"))
    rows = rows.withColumn("_c", classify(F.concat_ws(" ", "title", "abstract", "tldr", F.array_join("keywords", " "), "track")))
    categories = F.when(F.size("_c.categories") > 0, F.col("_c.categories")).otherwise(F.array(F.col("_c.primary")))
    return rows.select(
        F.coalesce(blank(slugify(F.col("title"), "")), F.col("forum")).alias("id"), "title", "venue", F.coalesce(blank(F.regexp_extract("venue", r"(?<![0-9A-Za-z_])(20[0-9]{2})(?![0-9A-Za-z_])", 1)).cast("int"), F.lit(2026)).alias("year"), "authors", "keywords", "track", "tldr", "abstract",
        F.concat(F.lit("https://openreview.net/forum?id="), "forum").alias("openreviewUrl"), F.when(F.col("pdf") != "", F.when(F.col("pdf").startswith("/"), F.concat(F.lit("https://openreview.net"), "pdf")).otherwise(F.col("pdf"))).alias("pdfUrl"),
        F.col("_c.primary").alias("primaryCategory"), categories.alias("categories"), (F.col("_c.focus_score") + F.size("_c.categories")).alias("relevanceScore"),
    )


def with_generated(candidates: DataFrame, generated: DataFrame, categories: list[str] = [*CATEGORY_HINTS]) -> DataFrame:  # noqa: B006
    """Candidates with generated guides (id, primaryCategory, categories, keywords, hook): known categories only, the primary one first; at most 12 keywords, generated ones first."""
    g = generated.select("id", F.col("primaryCategory").alias("_p"), F.col("categories").alias("_c"), F.col("keywords").alias("_k"), "hook")
    rows = candidates.join(g, "id")
    known = F.array(*[F.lit(c) for c in categories])
    none = F.array().cast("array<string>")
    primary = F.when(F.array_contains(known, F.coalesce("_p", F.lit(""))), F.col("_p")).otherwise(F.col("primaryCategory"))
    listed = F.array_distinct(F.filter(F.concat(F.array(primary), F.coalesce("_c", "categories", none)), lambda c: F.array_contains(known, c)))
    new = {"primaryCategory": primary, "categories": F.when(F.size(listed) > 0, listed).otherwise(F.array(primary)), "keywords": F.slice(unique_strings(F.concat(F.coalesce("_k", none), F.coalesce("keywords", none))), 1, 12)}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in candidates.columns], "hook")
