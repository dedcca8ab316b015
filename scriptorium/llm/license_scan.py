"""License scans: canonical digests of whole texts and of whole notice lines."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .license_texts import LONG_TEXTS, NOTICES, TEXTS

#: Spellings that count as one.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "v": "version", "https": "http", "noncommercial": "nc", "organisation": "organization", "favour": "favor"}
#: Lines that state whose copyright it is; a line of a licence that merely begins with the word stays, however its text is wrapped.
_COPYRIGHT = r"^[ \t]*(?:(?:copyright:?[ \t]*)?(?:\(c\)|©)|copyright:?[ \t]+(?:[0-9\[<{]|by[ \t]))[^\n]*$|^[ \t]*all rights reserved[.!]?[ \t]*$"


def canonical_text(text: str) -> str:
    """What canonical() does, for known texts."""
    out = re.sub("(?m)" + _COPYRIGHT, " ", text.lower())
    out = f" {re.sub('[^a-z0-9]+', '  ', out)} "
    for a, b in SPELLINGS.items():
        out = out.replace(f" {a} ", f" {b} ")
    return out.replace("  ", " ").strip(" ")


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines; runs of other characters than a-z and 0-9 are one space; one spelling for each word."""
    out = F.regexp_replace(F.lower(text), "(?md)" + _COPYRIGHT, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, "[^a-z0-9]+", "  "), F.lit(" "))  # each word has spaces of its own
    for a, b in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def digests(notices: dict[str, list[str]] = NOTICES, texts: dict[str, tuple[list[str], str]] = TEXTS, known: dict[str, list[str]] = LONG_TEXTS) -> list[tuple[str, str]]:
    """(digest, licence) of the known texts, without repeats: notices, short licences under each of their titles and without, and the digests of long ones."""
    found = {digest(t): name for name, lines in notices.items() for t in lines}
    found |= {digest(f"{title}\n\n{body}"): name for name, (titles, body) in texts.items() for title in ["", *titles]}
    found |= {d: name for name, values in known.items() for d in values}
    return sorted(found.items())


def _hint(notices: dict[str, list[str]]) -> tuple[str, str]:
    """Patterns of the first and the last word of any line whose canonical form is a notice's; all spellings of a word count."""
    back: dict[str, list[str]] = {}
    for a, b in SPELLINGS.items():
        back.setdefault(b, []).append(a)
    forms = [canonical_text(t).split() for lines in notices.values() for t in lines]
    either = lambda words: "|".join(sorted({x for w in words for x in [w, *back.get(w, [])]}))
    return f"^[^a-z0-9]*(?:{either(f[0] for f in forms if f)})(?:[^a-z0-9]|$)", f"(?:^|[^a-z0-9])(?:{either(f[-1] for f in forms if f)})[^a-z0-9]*$"


def scan_licenses(docs: DataFrame, notices: dict[str, list[str]] = NOTICES, texts: dict[str, tuple[list[str], str]] = TEXTS) -> DataFrame:
    """One row per document: the licence that its entire text is, and those that its entire lines state.

    A whole text's canonical form is digested and joined with the known licences' digests (a fixed table of the module or
    the caller, broadcast). A line's is looked up among the notices' digests; only lines that begin and end like a notice
    are digested, which leaves out none that is one. Null and empty texts have the digest of nothing and no licence. Long
    texts and lines count whole. Two licences of one digest: the last of the table. Rows that repeat are returned each; an
    empty table gives no rows. Of columns of docs, doc_id and text are read, whatever others are named.
    Columns: doc_id, text_digest, license (null if the whole text is none), notices (sorted names of the lines'
    licences, repeats dropped), n_notices (lines that are one).
    """
    spark = docs.sparkSession
    shape = T.StructType([T.StructField("text_digest", T.StringType()), T.StructField("license", T.StringType())])
    lookup = F.broadcast(spark.createDataFrame(digests(notices, texts), shape))
    lines, none = digests(notices, {}, {}), F.array().cast("array<string>")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    stated = none
    if lines:
        first, last = _hint(notices)
        names = F.create_map(*[F.lit(y) for x in lines for y in x])
        able = F.filter(F.split(F.lower("text"), "\n"), lambda x: x.rlike(first) & x.rlike(last))
        stated = F.filter(F.transform(able, lambda x: F.element_at(names, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    rows = rows.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("text_digest"), stated.alias("_stated"))
    out = rows.join(lookup, "text_digest", "left")
    return out.select("doc_id", "text_digest", "license", F.array_join(F.array_sort(F.array_distinct("_stated")), ",").alias("notices"), F.size("_stated").cast("long").alias("n_notices"))
