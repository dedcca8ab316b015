"""What Spark has no expression for, in Arrow batches; run once, when rows are taken in."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode normalisation form KC; null stays null."""
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def decode_numeric(values: pd.Series) -> pd.Series:
    """Numeric character references; named ones are functions.html.decode_named()'s."""
    import re

    def one(m: re.Match) -> str:
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return values.map(lambda x: None if x is None else re.sub(r"&#(?:(\d+)|x([0-9a-fA-F]+));", one, x))


@F.pandas_udf(StringType())
def decode_all(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else html.unescape(x))
