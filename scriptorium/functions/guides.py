"""Rules that fill a short guide from a title and an abstract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import GUIDE_FAMILIES, GUIDE_RESULTS, GUIDE_TOPICS, LIMITATION_WORDS
from .text import blank, find_sentence, first_match, rx

DEFAULT_TOPIC = "大模型能力"


def topic(text: Column) -> Column:
    """The label of the first topic rule that a text meets."""
    return first_match(F.lower(text), GUIDE_TOPICS, DEFAULT_TOPIC)


def family(text: Column) -> Column:
    return first_match(F.lower(text), [(word, name) for name, words in GUIDE_FAMILIES for word in words], "paper")


def result_signal(abstract: Column) -> Column:
    """What kind of result an abstract claims; null for none."""
    return first_match(F.lower(F.coalesce(abstract, F.lit(""))), [(word, name) for name, words in GUIDE_RESULTS for word in words], None)


def method_name(title: Column) -> Column:
    """What stands before a colon, up to 80 characters, else the first name in capitals."""
    head = F.trim(F.get(F.split(title, ":"), 0))
    return F.when((head != "") & (F.length(head) <= 80), head).otherwise(blank(F.regexp_extract(title, rx(r"\b[A-Z][A-Z0-9-]{2,}\b"), 0)))


def data_scale(abstract: Column) -> Column:
    """A number with what it counts; null for none."""
    things = "models?|tasks?|benchmarks?|datasets?|trajectories|templates|environments|samples|examples|questions|videos|images|agents?"
    return blank(F.regexp_extract(abstract, rx(rf"(?:\b\d+(?:\.\d+)?\s*(?:k|K|m|M|b|B)?\b|\b\d+\+?\b)\s+(?:{things})"), 0))


def limitation(abstract: Column) -> Column:
    return find_sentence(abstract, LIMITATION_WORDS)
