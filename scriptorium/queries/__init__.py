"""All queries of the library by name, and the SQL that checks them."""

from . import records, text
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "records", "text"]
