"""What the corpus operators share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import apart, cut, cuts, drop_cuts, shared_folder, table

__all__ = ["SPACE", "apart", "cut", "cuts", "drop_cuts", "shared_folder", "table", "word_count"]

#: ASCII white space, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"


def word_count(text):
    """Number of maximal runs of characters other than ASCII white space; null counts 0."""
    marks = F.regexp_replace(text, f"[{SPACE}]*[^{SPACE}]+", "x")
    return F.coalesce(F.length(F.rtrim(marks, F.lit(" \t\n\x0b\x0c\r"))), F.lit(0)).cast("long")
