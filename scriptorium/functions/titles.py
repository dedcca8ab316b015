"""Titles in evidence: candidates, cleaning, quality and choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import DIRTY_TITLE, EVIDENCE_VENUES, PICTOGRAPH, TITLE_BAD_START, WAITING
from .text import blank, let, rx, squeeze, unique_strings

_V = f"(?:{EVIDENCE_VENUES})"
_NAME = r"[A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){0,2}"

# Rewrites of a title candidate, in order.
REWRITES = [
    (r"(?i)^GitHub\s+-\s+[^:]+:\s*", ""),
    (rf"(?i)\[[^\]]*\b{_V}[^\]]*\]\s*", ""),
    (rf"(?i)\({_V}[-\s']*(?:2026|26)(?:\s+Main(?:\s+Conference)?)?\)\s*", " "),
    (r"(?i)^(?:the\s+)?(?:official\s+)?(?:code|repository|repo|implementation|project page)\s+(?:for|of)?\s*(?:our\s+)?(?:paper)?\s*:?\s*", ""),
    (r"(?i)^this is the code repository for our paper\s*:?\s*", ""),
    (rf"(?i)^code of\s+{_V}[-\s']*(?:2026|26)\s+accepted paper\s*:?\s*", ""),
    (r"(?i)\s*[-|·]\s*GitHub\s*$", ""),
    (r"\s*##.*$", ""),
    (r"(?i)\s+\b(?:Abstract|Overview|Installation|Quickstart|Citation|News|Highlights)\b.*$", ""),
    (r"(?i)\s+(?:This is the (?:code )?repository|This is the repo|If you find our work useful|Please consider giving us|The paper has been accepted|This work has been accepted)\b.*$", ""),
    (r"(?i)\s+(?:We introduce|We propose|We present|We release|Accepted by|Accepted to)\b.*$", ""),
    (r"\s+[πβ][^\x{00}-\x{7F}\S]*.*$", ""),
    (rf"\s+{PICTOGRAPH}.*$", ""),
    (r"(?i)^this is the official implementation for\s*", ""),
    (rf"\s+{_NAME},\s+{_NAME}.*$", ""),
    (rf"(?i)\s+\b{_V}[-\s']*(?:2026|26)\b.*$", ""),
    (r"[。；;，,]+$", ""),
]
# A sign without which there is nothing to rewrite, what is rewritten, and to what.
SOURCE_NOISE = [("![", r"!\[[^\]]*\]\([^)]*\)", " "), ("](", r"\[([^\]]+)\]\([^)]*\)", "$1"), ("<", "<[^>]+>", " "), ("&", "(?i)&nbsp;", " "), ("&", "(?i)&amp;", "&")]
# Where titles stand in a text; the first group is the title.
TITLE_PATTERNS = [
    r"(?i)title\s*=\s*[{\"]([^}\"]{8,240})[}\"]", r"标题为\s*([^。；;\n]{8,240})", r"(?:^|\s)([A-Z][A-Za-z0-9+_.-]{1,48}:\s*[^#\n]{8,240})",
    r"(?i)(?:paper|work|repository|repo|project page)(?:\s+(?:for|of|called|named))?\s*[:：]\s*([^#\n]{8,240})", r"(?m)^#{1,3}\s*([^#\n]{8,240})", r"(?i)GitHub\s+-\s+[^:]+:\s*([^·\n]{8,240})",
]


def strip_source_noise(value: Column) -> Column:
    """Images, Markdown links to their text, tags, two entities, quotes and heading marks. NFKC is applied at ingest."""
    out = F.coalesce(value, F.lit(""))
    for sign, pattern, to in SOURCE_NOISE:
        out = let(out, lambda x: F.when(F.contains(x, F.lit(sign)), F.regexp_replace(x, pattern, to)).otherwise(x))  # noqa: B023 (called at once)
    return squeeze(F.regexp_replace(F.regexp_replace(out, "^[\"'`]+|[\"'`]+$", ""), r"^[#>\s]+", ""))


def clean_title(value: Column) -> Column:
    """A candidate after all rewrites; empty if what is left is no title."""
    out = strip_source_noise(value)
    for pattern, to in REWRITES:
        out = F.regexp_replace(out, rx(pattern), to)
    bad = lambda x: ~F.length(x).between(8, 220) | ~x.rlike("[a-zA-Z]") | x.rlike(rx(TITLE_BAD_START)) | x.rlike(rx(r"(?i)\b(?:for|via|with|and|of|the|from|to)$"))
    return let(squeeze(out), lambda x: F.when(bad(x), "").otherwise(x))


def is_dirty_title(value: Column) -> Column:
    def dirty(text: Column) -> Column:
        out = (text == "") | (F.length(text) > 260)
        for pattern in DIRTY_TITLE:
            out = out | text.rlike(rx(pattern))
        return out

    return let(F.trim(F.coalesce(value, F.lit(""))), dirty)


def title_quality(value: Column) -> Column:
    """Length up to 180, less for dirty shapes, outer quotes and a loose end, more for an end mark."""
    text = F.trim(F.coalesce(value, F.lit("")))
    part = lambda test, points: F.when(test, points).otherwise(0)
    return (
        F.least(F.length(text), F.lit(180))
        + part(is_dirty_title(text) | text.rlike("(?i)github|official repo|official code"), -60)
        + part(text.rlike("^[`\"“”‘’']|[`\"“”‘’']$"), -20)
        + part(text.rlike("(?i)for$|via$|with$|and$|of$|the$"), -80)
        + part(text.rlike("[.:?]$"), 6)
    )


def title_candidates(value: Column) -> Column:
    """Clean titles that stand in a text, each once, in the order of the patterns."""
    found = let(strip_source_noise(value), lambda text: F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(rx(p)), F.lit(1)) for p in TITLE_PATTERNS])))
    return unique_strings(F.transform(found, clean_title))


def best_title(direct: Column, texts: Column) -> Column:
    """Of clean direct titles and of candidates in texts (arrays), the first of those with the best quality; null if all are dirty."""
    use = lambda values: F.filter(values, lambda x: (F.trim(F.coalesce(x, F.lit(""))) != "") & ~x.rlike(f"(?i){WAITING}"))
    every = F.concat(F.transform(use(direct), clean_title), F.flatten(F.transform(use(texts), title_candidates)))
    clean = F.filter(unique_strings(every), lambda x: ~is_dirty_title(x))
    ranked = F.array_sort(F.transform(clean, lambda x, i: F.struct((-title_quality(x)).alias("q"), i.alias("i"), x.alias("t"))))
    return F.get(ranked, 0)["t"]


def pick_title(left: Column, right: Column) -> Column:
    """The better of two titles after cleaning, the right one of equals."""
    a, b = blank(clean_title(left)), blank(clean_title(right))
    return F.when(a.isNull() | b.isNull(), F.coalesce(b, a)).when(title_quality(b) >= title_quality(a), b).otherwise(a)


# Rewrites of a title from discovery evidence, in order, and openings that no title has.
EVIDENCE_REWRITES = [
    ("^[\"'`“”‘’]+|[\"'`“”‘’]+$", ""), (r"(?i)\s*[-|]\s*GitHub$", ""), (r"(?i)\s*·\s*GitHub$", ""), (r"\s*##.*$", ""), (r"(?i)\s*\bbibtex\b.*$", ""),
    (r"(?i)\s*\((?:accepted|to appear|main conference|findings)[^)]+\)\s*$", ""), (r"\s*[·|].*$", ""),
]
EVIDENCE_BAD_START = r"(?i)^(?:github|gitlab|arxiv|readme|yaml|json|python|pytorch)\b"
# Words that describe a page rather than its paper.
DESCRIPTORS = [
    (r"^[\])\"'‘’“”`]+", ""), (r"(?i)^(?:official\s+)?(?:code|repository|repo|implementation|project page|paper|benchmark release)\s+(?:for|of)?\s*", ""), (r"(?i)^this is the repo of\s+", ""),
    (r"(?i)^the project page of\s+", ""), (r"(?i)^of\s*:\s*", ""), (r"(?i)^accepted (?:to|by)\s+", ""),
]
QUOTED = [r"(?i)paper\s+[\"“”'‘’`]([^\"“”'‘’`]{8,220})[\"“”'‘’`]", r"(?i)[\"“”'‘’`]([^\"“”'‘’`]{8,220}:[^\"“”'‘’`]{8,220})[\"“”'‘’`]"]
# Where a view finds a title, and what it strips from one.
VIEW_PATTERNS = [
    r"(?i)(?:accepted paper\s*:\s*|implementation of (?:Google'?s|Google)\s+)([A-Z][A-Za-z0-9+_.-]{2,100}(?::\s*[^.\n]{6,220})?)",
    r"\b([A-Z][A-Za-z0-9+_.-]{1,60}\s*\([^)]{6,180}\))", r"\b([A-Z][A-Za-z0-9+_.-]{1,60}:\s*[^.\n]{8,220})",
]
VIEW_REWRITES = [
    (r"(?i)^GitHub\s+-\s+[^:]+:\s*", ""), (rf"(?i)^\[?{_V}\s*2026\]?\s*", ""), (rf"(?i)^{_V}\s*2026\s+accepted paper\s*:\s*", ""), (rf"(?i)^code of\s+{_V}\s*2026\s+accepted paper\s*:\s*", ""),
    (r"(?i)^(?:the\s+)?(?:official\s+)?(?:code|repository|repo|implementation)\s+(?:for|of)?\s*", ""), (r"(?i)^this is the official implementation for\s*", ""), (r"(?i)^this is the code repository for our paper\s*:?\s*", ""),
    (r"(?i)^[A-Za-z0-9_-]+:\s*This is the official PyTorch implementation of\s*", ""), (r"\s*##.*$", ""),
    (r"(?i)\s+(?:This is the code repository|This is the official implementation|If you find our work useful|Please consider giving us|Abstract|As large language models|Accepted by|Accepted to)\b.*$", ""),
    (r"(?i)\s+(?:we introduce|we propose|we present|we release)\b.*$", ""), (rf"(?i)\s+\b{_V}\s*2026\b.*$", ""), (r"(?i)(?:;\s*)?waiting for Zhipu enrichment\.?$", ""), (r"\|.*$", ""),
]
REPAIR_PATTERNS = [r"(?i)title=\{([^}]{8,220})\}", r"(?i)accepted paper\s*:\s*([^\n]{8,220})", r"(?i)implementation of\s+\"([^\"\n]{8,220})\"", r"(?i)implementation of\s+([A-Z][^.\n]{8,220})", r"([A-Z][A-Za-z0-9+_.-]{1,48}:\s*[^#\n]{8,220})"]


def _rewrite(value: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        value = F.regexp_replace(value, rx(pattern), to)
    return squeeze(value)


def clean_evidence_title(value: Column) -> Column:
    """A discovery-side title after its rewrites; null if what is left is no title."""
    return let(_rewrite(squeeze(F.coalesce(value, F.lit(""))), EVIDENCE_REWRITES), _if_title)


def _if_title(out: Column) -> Column:
    bad = ~F.length(out).between(8, 220) | out.rlike(r"(?i)go to file|repository files navigation|github topics|https?://") | out.rlike(rx(TITLE_BAD_START)) | out.rlike(rx(EVIDENCE_BAD_START)) | ~out.rlike("[a-zA-Z]")
    return F.when(~bad, out)


def title_from_evidence(sources: Column, venue: Column, repository_name: Column) -> Column:
    """The first title of an evidence row: quoted in any of its texts, else after a venue and year, else a text without these, else the repository's name."""
    first = lambda make: F.get(F.filter(F.transform(sources, make), lambda x: x.isNotNull()), 0)
    quoted = first(lambda s: F.coalesce(*[clean_evidence_title(F.regexp_extract(s, p, 1)) for p in QUOTED]))
    head = F.concat(F.lit(r"(?i)\[?"), venue, F.lit(r"[-\s']*(?:2026|26)(?:\s+Main(?:\s+Conference)?)?\]?"))
    after = lambda s: F.call_function("regexp_extract", s, F.concat(head, F.lit(r"\s*[:-]?\s*(?!\(?\s*(?:accepted|main|conference|findings|poster|oral)\b)([^·|\n]{8,220})")), F.lit(1))
    anchored = first(lambda s: clean_evidence_title(_rewrite(after(s), DESCRIPTORS)))
    words = r"(?i)\b(?:official|code|repository|repo|implementation|project page|paper|accepted|accepted by|accepted to|for)\b"
    bare = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(?i)^GitHub\s+-\s+[^:]+:\s*", ""), head, F.lit("")), rx(words), " "), "[·|].*$", "")
    return F.coalesce(quoted, anchored, first(lambda s: clean_evidence_title(bare(s))), clean_evidence_title(F.regexp_replace(repository_name, "[-_]+", " ")))


def view_title(value: Column) -> Column:
    """A title as a view shows it; empty if it shows none."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    found = F.coalesce(*[blank(F.trim(F.regexp_extract(raw, rx(p), 1))) for p in VIEW_PATTERNS], raw)
    return let(_rewrite(found, VIEW_REWRITES), _if_shown)


def _if_shown(out: Column) -> Column:
    bad = ~F.length(out).between(4, 220) | out.rlike(r"(?i)^(?:GitHub|This is|Discovery evidence found|从项目页|该项目明确|没有提供)") | out.rlike(r"(?i)waiting for Zhipu enrichment|repository files navigation|go to file|table of contents")
    bad = bad | ~out.rlike(r"[A-Za-z]|[\x{4e00}-\x{9fff}]") | ((F.length(out) < 12) & ~out.rlike(r"^[A-Z][A-Za-z0-9+_.-]{2,40}$"))
    return F.when(bad, "").otherwise(out)


def repair_title(evidence_texts: Column, title: Column) -> Column:
    """The first clean title in an entry's evidence texts, else in its own title; null if there is none."""
    found = lambda s: F.coalesce(*[blank(clean_title(F.regexp_extract(s, p, 1))) for p in REPAIR_PATTERNS])
    every = F.filter(F.transform(F.concat(evidence_texts, F.array(title)), lambda s: F.when(~F.coalesce(s, F.lit("")).rlike(f"(?i){WAITING}"), found(squeeze(F.coalesce(s, F.lit("")))))), lambda x: x.isNotNull())
    return F.get(every, 0)


def clean_narrative(value: Column, raw_title: Column, title: Column, venue: Column) -> Column:
    """A summary or reason with the raw title replaced by the clean one; a fixed sentence where its shape is that of no narrative."""
    text = blank(F.trim(value))
    fallback = F.when(title != "", F.concat(F.lit("Discovery evidence found an explicit "), F.coalesce(blank(venue), F.lit("a 2026 top venue")), F.lit(" paper signal for "), title, F.lit("; waiting for Zhipu enrichment.")))
    changed = F.when((title != "") & (raw_title != "") & (title != raw_title) & F.contains(text, raw_title), F.replace(text, raw_title, title)).otherwise(text)
    return F.when(text.isNull(), None).when(is_dirty_title(changed), fallback).otherwise(changed)
