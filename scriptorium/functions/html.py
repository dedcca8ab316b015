"""Page expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import ENTITIES
from .text import blank, let, squeeze


def decode_named(value: Column) -> Column:
    """Fixed named references, in order: &amp; before &lt; and so on."""
    for name, text in ENTITIES:
        value = F.replace(value, F.lit(name), F.lit(text))
    return value


def clean_html(value: Column) -> Column:
    """Tags to spaces, references decoded, squeezed."""
    return squeeze(decode_named(F.regexp_replace(F.coalesce(value, F.lit("")), "<[^>]*>", " ")))


def strip_markup(value: Column) -> Column:
    """Line breaks, tags and Markdown links to their text; entities stay."""
    out = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?i)<br\s*/?>", " ")
    out = F.regexp_replace(F.regexp_replace(out, "<[^>]*>", " "), r"\[([^\]]{2,220})\]\([^)]+\)", "$1")
    return squeeze(out)


def element(value: Column, tag: str) -> Column:
    """Clean content of the first element of a name; empty if there is none."""
    return clean_html(F.regexp_extract(value, f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1))


def meta_content(value: Column, name: str) -> Column:
    """Content of the first meta element with a name."""
    tag = F.regexp_extract(value, f'(?i)<meta\\b[^>]*\\bname="{name}"[^>]*>', 0)
    return decode_named(F.regexp_extract(tag, r'(?i)\bcontent="([^"]*)"', 1))


def links(value: Column) -> Column:
    """(href, title) of list links in order."""
    pattern = F.lit(r'<li><a href="[^"]+"[^>]*>[^<]*</a></li>')
    return F.transform(F.regexp_extract_all(value, pattern, F.lit(0)), lambda x: F.struct(decode_named(F.regexp_extract(x, 'href="([^"]+)"', 1)).alias("href"), clean_html(F.regexp_extract(x, "(?s)>([^<]*)</a>", 1)).alias("title")))


def page_title(value: Column) -> Column:
    """The heading, else the title."""
    return F.coalesce(blank(element(value, "h1")), blank(element(value, "title")))


def distinct_values(value: Column, pattern: str, most: int = 40) -> Column:
    """Decoded first groups of a pattern, each once, in order."""
    found = F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(1)), decode_named)
    return F.slice(F.array_distinct(F.filter(found, lambda x: x != "")), 1, most)


def page_detail(value: Column, fallback: Column, most: int = 40) -> Column:
    """(title, abstract, authors, track) of a paper's page: the first name that it states, its heading or the fallback; the abstract's first paragraph; other names, each once, up to `most`."""
    names = F.transform(F.regexp_extract_all(value, F.lit(r'"name"\s*:\s*"([^"]+)"'), F.lit(1)), decode_named)
    title = F.coalesce(blank(F.get(names, 0)), blank(element(value, "h1")), fallback)
    abstract = clean_html(F.regexp_extract(value, r'(?is)id="abstractText".*?<p>(.*?)</p>', 1))
    authors = lambda t: F.slice(F.array_distinct(F.filter(names, lambda n: (n != "") & (n != t) & ~F.contains(n, F.lit("CVPR")))), 1, most)
    track = clean_html(F.regexp_extract(value, r"(?i)<title>CVPR\s+([^<]+?)\s+", 1))
    return let(title, lambda t: F.struct(t.alias("title"), abstract.alias("abstract"), authors(t).alias("authors"), track.alias("track")))


def issue_urls(value: Column, base: str, series: str, title: str) -> Column:
    """Addresses of a journal's issues whose series and title begin as given, each once, by number."""
    pattern = rf'(?s)<a class="title" href="{_escaped(base)}(\d+)">(.*?)</a>.*?<div class="series">(.*?)</div>'
    part = lambda i: F.regexp_extract_all(value, F.lit(pattern), F.lit(i))
    rows = F.arrays_zip(part(1).alias("id"), part(2).alias("title"), part(3).alias("series"))
    fits = lambda x: clean_html(x["series"]).startswith(series) & clean_html(x["title"]).startswith(title)
    numbers = F.array_sort(F.array_distinct(F.transform(F.filter(rows, fits), lambda x: x["id"].cast("long"))))
    return F.transform(numbers, lambda n: F.concat(F.lit(base), n.cast("string")))


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/:-_" else "\\" + c for c in text)
