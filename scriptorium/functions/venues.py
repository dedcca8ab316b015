"""Venues, platforms and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import EVIDENCE_CONTEXT, EVIDENCE_OTHER_TRACKS, EVIDENCE_VENUES, HIGH_SIGNAL_URL, OTHER_TRACKS, VENUE_YEAR, VENUES
from .text import let, normalize_text, rx, squeeze


def venue_rule(text: Column) -> Column:
    """(venue, year) of the first rule that a text meets; null for none and for other tracks.

    Rules are those of the normalised text. As normalising only turns characters that aren't letters or digits into spaces, words
    stand in the lower-case text if and only if they stand there, and most texts are told by plain substrings.
    """
    return let(F.lower(F.coalesce(text, F.lit(""))), _venue_rule)


def _venue_rule(low: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, venue in reversed(VENUES):
        stem = word[:-2] if word.endswith("?") else word
        # VENUE-26 and VENUE 2026 have a boundary after the venue, so of the forms with a year only VENUE26 adds something
        found = F.contains(low, F.lit(stem)) & low.rlike(rf"{stem}(?<![a-z0-9]{stem}){word[len(stem) :]}(?:26)?(?![a-z0-9])")
        out = F.when(found, F.lit(venue)).otherwise(out)
    other = F.lit(False)
    for first in dict.fromkeys(t.split(" ")[0] for t in OTHER_TRACKS.split("|")):
        other = other | F.contains(low, F.lit(first))
    other = other & normalize_text(low).rlike(rx(rf"\b(?:{OTHER_TRACKS})\b"))
    return let(out, lambda venue: F.when(venue.isNotNull() & ~other, F.struct(venue.alias("venue"), F.lit(VENUE_YEAR).alias("year"))))


def venue_in_evidence(text: Column) -> Column:
    """VENUE 2026, with Main where that track is named; null without a venue-year and a word of acceptance."""
    low = squeeze(F.lower(F.coalesce(text, F.lit(""))))
    venue = F.upper(F.regexp_extract(low, rx(rf"\b({EVIDENCE_VENUES})[-\s']*(2026|26)\b"), 1))
    main = F.when(text.rlike(rx(r"(?i)\bmain(?:\s+conference|\s+track)?\b")), F.lit(f" {VENUE_YEAR} Main")).otherwise(F.lit(f" {VENUE_YEAR}"))
    return F.when((venue != "") & text.rlike(f"(?i)({EVIDENCE_CONTEXT})"), F.concat(venue, main))


def venue_year(text: Column) -> Column:
    venue = F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), rx(rf"(?i)\b({EVIDENCE_VENUES})[-\s]?(2026|26)\b"), 1))
    return F.when(venue != "", F.concat(venue, F.lit(f" {VENUE_YEAR}"))).otherwise("")


def has_venue_year(text: Column) -> Column:
    return text.rlike(rx(rf"(?i)\b(?:{EVIDENCE_VENUES})[-\s]?(?:2026|26)\b"))


def other_track(text: Column) -> Column:
    return text.rlike(rx(rf"(?i)\b(?:{EVIDENCE_OTHER_TRACKS})\b"))


def venue_short(venue: Column) -> Column:
    first = F.get(F.split(F.trim(venue), r"\s+"), 0)
    return F.when(F.lower(venue).contains("unclassified"), "Unclassified").otherwise(F.coalesce(F.nullif(first, F.lit("")), F.trim(venue)))


def venue_year_key(venue: Column, year: Column) -> Column:
    return F.concat(venue_short(venue), F.lit(":"), year.cast("string"))


def venue_badge(venue: Column, year: Column) -> Column:
    return F.concat(venue_short(venue), F.lit("-"), year.cast("string"))


def platform_of(url: Column, official: bool = False) -> Column:
    """Where a page stands; `official` names official sites instead of preprint ones."""
    last = F.when(url.rlike(r"(?i)openreview\.net|aaai\.org|thecvf\.com"), "official") if official else F.when(url.rlike(r"(?i)arxiv\.org"), "arxiv")
    return F.when(url.rlike(r"(?i)x\.com|twitter\.com"), "x").when(url.rlike(r"(?i)xiaohongshu\.com"), "xiaohongshu").otherwise(last.otherwise("web"))


def platform_of_query(query: Column) -> Column:
    out = F.when(query.rlike("(?i)xiaohongshu|小红书"), "xiaohongshu").when(query.rlike(rx(r"(?i)\bx\b|twitter")), "x").when(query.rlike("(?i)github"), "github")
    return out.when(query.rlike("(?i)arxiv"), "arxiv").when(query.rlike("(?i)openreview"), "openreview").when(query.rlike("(?i)project page|homepage|site:"), "homepage").otherwise("web")


def platform_label(platform: Column) -> Column:
    key = F.lower(F.trim(platform))
    return F.when(key == "x", "X").when(key == "xiaohongshu", "Xiaohongshu").when(key == "web", "Web / Homepage").when(key == "arxiv", "arXiv").otherwise(platform)


def valid_url(value: Column) -> Column:
    """The trimmed address if it is one of the web, else empty."""
    url = F.trim(F.coalesce(value, F.lit("")))
    return F.when(url.rlike("(?i)^https?://"), url).otherwise("")


def repository(url: Column) -> Column:
    """(owner, name) of a code repository's address, else null."""
    pattern = r"(?i)^https?://github\.com/([^/\s?#]+)/([^/\s?#]+)"
    name = F.regexp_extract(url, pattern, 2)
    return F.when((name != "") & (F.lower(name) != "topics"), F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.regexp_replace(name, r"(?i)\.git$", "").alias("name")))


def is_personal_homepage(url: Column) -> Column:
    repo = repository(url)
    return F.coalesce(F.lower(repo["name"]) == F.concat(F.lower(repo["owner"]), F.lit(".github.io")), F.lit(False))


def is_high_signal(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike(f"(?i){HIGH_SIGNAL_URL}")


def is_strong_source(url: Column) -> Column:
    bad = url.rlike(r"(?i)arxiv\.org/list/") | url.rlike(r"(?i)github\.com/[^/\s?#]+/?$")
    return ~bad & url.rlike(r"(?i)github\.com/[^/\s?#]+/[^/\s?#]+|github\.io|openreview\.net|arxiv\.org/abs|x\.com|twitter\.com")


def domain_filter(value: Column) -> Column:
    """A bare host name in lower case, or null."""
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(squeeze(F.coalesce(value, F.lit(""))), "(?i)^https?://", ""), r"(?i)^www\.", ""), "/.*$", ""))
    return F.when((host != "") & ~host.rlike("[^a-z0-9.-]"), host)


def one_of(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(squeeze(F.coalesce(value, F.lit(""))).isin(*allowed), squeeze(value)).otherwise(default)
