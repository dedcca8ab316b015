"""Text expressions: columns in, columns out. Unicode NFKC is applied once, at ingest (functions.unicode.nfkc); these stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import STOP_WORDS


#: A word boundary that counts ASCII letters, digits and _ only; Java's own also counts accented letters.
_BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def rx(pattern: str) -> str:
    """A pattern with ASCII word boundaries."""
    return pattern.replace(r"\b", _BOUNDARY)


def let(value: Column, make) -> Column:
    """make(x) with x evaluated once. An expression that a lambda or several branches use is otherwise evaluated for each."""
    return F.get(F.transform(F.array(value), make), 0)


def blank(value: Column) -> Column:
    """Null for null and for the empty text, both of which count as missing."""
    return F.nullif(value, F.lit(""))


def squeeze(value: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(value, r"\s{2,}|[^\S ]", " "))  # a single space stays as it is


def normalize_text(value: Column) -> Column:
    """Lower case, other characters than letters, digits, white space and hyphens to spaces, squeezed; null as empty."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}\s-]+", " "))


def normalize_search(value: Column) -> Column:
    """normalize_text() after apostrophes are taken out."""
    return normalize_text(F.regexp_replace(F.coalesce(value, F.lit("")), "['’`]", ""))


def tokenize(value: Column) -> Column:
    return F.filter(F.split(normalize_search(value), " "), lambda t: t != "")


def slugify(value: Column, fallback: str = "paper", size: int = 80) -> Column:
    slug = F.regexp_replace(F.regexp_replace(normalize_text(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(blank(F.left(slug, F.lit(size))), F.lit(fallback))


def content_value(json: Column, key: str) -> Column:
    """$.key.value if there is one, else $.key."""
    return F.coalesce(F.get_json_object(json, f"$.{key}.value"), F.get_json_object(json, f"$.{key}"))


def clean_list(values: Column) -> Column:
    """Trimmed, without empty ones."""
    return F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")


def split_keywords(value: Column) -> Column:
    """Parts between ; , and | or, without any of these, the whole text; no text: no keywords."""
    whole = F.trim(F.coalesce(value, F.lit("")))
    parts = clean_list(F.split(whole, "[;,|]"))
    return F.when(whole == "", F.array().cast("array<string>")).when(F.size(parts) > 1, parts).otherwise(F.array(whole))


def normalize_keywords(values: Column, most: int = 14) -> Column:
    """An array's parts in order, each once, at most `most`."""
    parts = F.flatten(F.transform(F.filter(values, lambda x: x.isNotNull() & (x != "")), lambda x: F.split(x, "[;,|]")))
    return F.slice(F.array_distinct(clean_list(parts)), 1, most)


def unique_strings(values: Column) -> Column:
    """Trimmed, without null and empty ones, each once, in order."""
    return F.array_distinct(clean_list(F.filter(values, lambda x: x.isNotNull())))


def parse_authors(bibtex: Column, authors: Column) -> Column:
    """The names in a BibTeX author field, else those of a list in text, else unknown."""
    field = F.regexp_extract(F.coalesce(bibtex, F.lit("")), r"(?i)author\s*=\s*\{([^}]+)\}", 1)
    text = F.trim(F.coalesce(authors, F.lit("")))
    listed = F.when(text.rlike("[;,]"), clean_list(F.split(text, "[;,]"))).otherwise(F.array(text))
    return F.when(field != "", clean_list(F.split(field, r"(?i)\s+and\s+"))).when(text == "", F.array(F.lit("Unknown authors"))).otherwise(listed)


def fingerprint(value: Column) -> Column:
    return F.sha1(value)


def hash_values(values: Column) -> Column:
    """SHA-1 over values that each end in a line feed."""
    return F.sha1(F.array_join(F.transform(values, lambda x: F.concat(x.cast("string"), F.lit("\n"))), ""))


def stable_id(title: Column) -> Column:
    return F.concat(F.lit("unofficial-"), F.left(F.sha1(F.coalesce(blank(normalize_text(title)), F.lit("paper"))), F.lit(12)))


def longer_text(left: Column, right: Column) -> Column:
    """The longer of two texts, the left one of equals; an empty one gives way."""
    a, b = blank(F.trim(left)), blank(F.trim(right))
    return F.when(a.isNull(), b).when(b.isNull(), a).when(F.length(b) > F.length(a), b).otherwise(a)


def truncate(value: Column, size: int, mark: str = "...") -> Column:
    """A squeezed text cut to size, with a mark where it was longer."""
    text = squeeze(F.coalesce(value, F.lit("")))
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.left(text, F.lit(size))), F.lit(mark))).otherwise(text)


#: Terms up to which each is looked for by itself, in the JVM; more go through one automaton, with the same result.
FEW_TERMS = 64


def contained(text: Column, terms: list[str]) -> Column:
    """Those terms, in their order, that a text contains. The list stands in the plan: no join."""
    if len(terms) > FEW_TERMS:
        from .automaton import contained_many

        return contained_many(text, terms)
    return let(text, lambda body: F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(body, t)))


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the first rule whose needle a text contains."""

    def pick(body: Column) -> Column:
        out = F.lit(default)
        for needle, label in reversed(rules):
            out = F.when(F.contains(body, F.lit(needle)), F.lit(label)).otherwise(out)
        return out

    return let(text, pick)


def is_stop_word(token: Column) -> Column:
    return token.isin(*STOP_WORDS)


def json_block(value: Column) -> Column:
    """The JSON in a text: the whole, a fenced block, or an object at its end; null if none of these is JSON."""
    return let(F.trim(F.coalesce(value, F.lit(""))), _json_block)


def _json_block(text: Column) -> Column:
    ok = lambda x: F.when(F.get_json_object(x, "$").isNotNull(), x)
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    return F.coalesce(ok(text), ok(blank(fenced)), ok(blank(F.regexp_extract(text, r"(?s)\{.*\}$", 0))))


def sentences(value: Column, least: int = 31) -> Column:
    """Sentences of `least` or more characters."""
    return F.filter(F.split(squeeze(F.coalesce(value, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.length(s) >= least)


def find_sentence(value: Column, needles: list[str]) -> Column:
    """The first sentence that has any of the needles."""
    has = lambda s: F.size(contained(F.lower(s), needles)) > 0
    return F.get(F.filter(sentences(value), has), 0)


def clamp(value: Column, low: int, high: int, missing: int) -> Column:
    """An integer within bounds; null, not a number and 0 count as missing."""
    number = F.expr("CAST(NULL AS DOUBLE)") if value is None else value.try_cast("double")
    use = F.when(number.isNull() | F.isnan(number) | (number == 0), F.lit(float(missing))).otherwise(number)
    return F.least(F.greatest(F.when(use < 0, F.ceil(use)).otherwise(F.floor(use)), F.lit(low)), F.lit(high)).cast("int")


def semantic_text(*fields: Column) -> Column:
    """What is embedded: the fields that aren't missing, squeezed."""
    return squeeze(F.concat_ws(" ", *[blank(f) for f in fields]))
