"""Sources that answer over a network: chat, README files, pages with a cache, encoders. Transports are parameters; nothing is called in tests."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions.html import strip_markup
from ..functions.text import json_block
from ..functions.venues import is_personal_homepage, repository
from ..values import INTRO_KEYS
from .json_docs import exists
from .journal import map_limit, retry


class HttpError(Exception):
    """An answer that isn't one; status as the server gave it."""

    def __init__(self, status: int, details: str = ""):
        super().__init__(f"{status} {details[:500]}".strip())
        self.status = status


def chat(post: Callable[[str, dict], str], body: dict, attempts: int = 3, delay: float = 1.0, limited_delay: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The answer of a chat model, asked again after delay, 2 delay and so on, or the longer delay where it is rate-limited (429)."""
    for n in range(1, attempts + 1):
        try:
            return json.loads(post("chat/completions", {"temperature": 0.1, **body}))
        except Exception as error:
            if n == attempts:
                raise
            sleep((limited_delay if getattr(error, "status", None) == 429 else delay) * n)
    raise ValueError("attempts must be at least 1")


def message_text(answer: dict) -> str:
    """The text of a chat answer, of a plain message or of one in parts."""
    content = ((answer.get("choices") or [{}])[0].get("message") or {}).get("content") or ""
    return content if isinstance(content, str) else "".join(p.get("text", "") for p in content if isinstance(p, dict))


def tool(post: Callable[[str, dict], str], name: str, body: dict, attempts: int = 3, delay: float = 0.7, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The answer of a named tool."""
    return json.loads(retry(lambda: post("tools", {"tool": name, **body}), attempts, delay, sleep))


def readme_places(owner: str, name: str) -> list[str]:
    """Where a repository's README may be, in the order in which they are tried."""
    raw = f"https://raw.githubusercontent.com/{owner}/{name}"
    return [f"https://api.github.com/repos/{owner}/{name}/readme", f"{raw}/HEAD/README.md", f"{raw}/main/README.md", f"{raw}/master/README.md"]


def first_readme(owner: str, name: str, fetch: Callable[[str], str]) -> str | None:
    """The first README that has any text; the last error if none was read, null if all are empty."""
    error = None
    for place in readme_places(owner, name):
        try:
            text = fetch(place)
        except Exception as e:  # the next place is tried
            error = e
            continue
        if text.strip():
            return text
    if error:
        raise error
    return None


def readmes(rows: DataFrame, fetch: Callable[[str], str], limit: int = 4, url: str = "url", journal: str | None = None) -> DataFrame:
    """rows with readmeTitle and readmeExcerpt (3000 characters) of the repository that their address names; nulls for others and for personal homepages."""
    repo = repository(F.col(url))
    asked = rows.withColumns({"_owner": F.when(~is_personal_homepage(F.col(url)), repo["owner"]), "_name": repo["name"]})

    def call(r: dict) -> str | None:
        try:
            return first_readme(r["_owner"], r["_name"], fetch) if r["_owner"] and r["_name"] else None
        except Exception:  # a repository that can't be read has no README
            return None

    found = map_limit(asked, call, limit, "_text", ["_owner", "_name"], journal).withColumn("_excerpt", F.trim(F.left(strip_markup(F.col("_text")), F.lit(3000))))
    some = F.col("_excerpt") != ""
    return found.select(*rows.columns, F.when(some, F.concat("_owner", F.lit("/"), "_name", F.lit(" README"))).alias("readmeTitle"), F.when(some, F.col("_excerpt")).alias("readmeExcerpt"))


def cached_pages(spark: SparkSession, wanted: DataFrame, path: str, fetch: Callable[[str], str], limit: int = 8, use_cache: bool = True) -> DataFrame:
    """(name, url, html) of the wanted pages (name, url): from the cache table, and fetched and put there where they are missing."""
    shape = "name string, url string, html string"
    old = spark.read.schema(shape).parquet(path) if use_cache and exists(spark, path) else spark.createDataFrame([], shape)
    missing = wanted.join(old, "name", "left_anti").select("name", "url")
    map_limit(missing, lambda r: fetch(r["url"]), limit, "html", ["url"], f"{path}-journal" if use_cache else None).write.mode("append" if use_cache else "overwrite").parquet(path)
    return spark.read.schema(shape).parquet(path).join(wanted.select("name"), "name", "left_semi")


def embed(rows: DataFrame, encode: Callable[[list[str]], list[np.ndarray]], text: str = "semantic_text", into: str = "embedding", batch: int = 32) -> DataFrame:
    """rows with the unit-length mean of their text's token vectors. encode: texts to (tokens, dimensions) arrays; it is made where it runs.

    A text without tokens has the zero vector. ValueError if dimensions differ.
    """

    def run(batches):
        for pdf in batches:
            pooled = []
            for at in range(0, len(pdf), batch):
                for tokens in encode(pdf[text].iloc[at : at + batch].fillna("").tolist()):
                    if tokens.ndim != 2:
                        raise ValueError(f"expected rows of token vectors, got {tokens.ndim} dimensions")
                    mean = tokens.mean(axis=0) if len(tokens) else np.zeros(tokens.shape[1])
                    pooled.append((mean / max(float(np.linalg.norm(mean)), 1e-12)).astype("f4"))
            if len({len(v) for v in pooled}) > 1:
                raise ValueError("vectors of different dimensions")
            yield pdf.assign(**{into: pooled})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(into, ArrayType(FloatType()))]))


# What a generated guide must have.
GUIDE_FIELDS = ["titleZh", "hookZh", "primaryCategory", "categories", "keywords", "introZh"]


def guide_prompt(paper: dict, categories: dict[str, str]) -> str:
    """What a model is asked for a paper's guide."""
    fields = [("Title", "title"), ("Venue", "venue"), ("Authors", "authors"), ("Keywords", "keywords"), ("TL;DR", "tldr"), ("Abstract", "abstract"), ("Current category guess", "primaryCategory")]
    value = lambda v: ", ".join(map(str, v)) if hasattr(v, "__iter__") and not isinstance(v, str) else "" if v is None else str(v)
    lines = ["Write a guide to this paper as strict JSON. Use only what is given here; leave out numbers and claims that aren't.", f"Fields: {', '.join(GUIDE_FIELDS)}; introZh has {', '.join(INTRO_KEYS)}.", "Categories to choose from:"]
    return "\n".join([*lines, *(f"- {k}: {v}" for k, v in categories.items()), "Paper:", *(f"{name}: {value(paper.get(key))}" for name, key in fields)])


def guide_problem(guide: Column) -> Column:
    """What a generated guide, a JSON text, lacks, or null."""
    root = F.from_json(guide, "map<string,string>")
    intro = F.from_json(F.get_json_object(guide, "$.introZh"), "map<string,string>")
    lacking = lambda names, have: F.array_join(F.filter(F.array(*map(F.lit, names)), lambda k: ~F.coalesce(have(k), F.lit(False))), ", ")
    fields = lacking(GUIDE_FIELDS, lambda k: root[k].isNotNull())
    intros = lacking(INTRO_KEYS, lambda k: intro[k] != "")
    return F.when(root.isNull() | ~F.trim(guide).startswith("{"), "no JSON object").when(fields != "", F.concat(F.lit("missing keys: "), fields)).when(intros != "", F.concat(F.lit("introZh is missing keys: "), intros))


def generate_guides(candidates: DataFrame, existing: DataFrame, ask: Callable[[str], str], categories: dict[str, str], limit: int = 2, force: bool = False, journal: str | None = None) -> DataFrame:
    """(title, guide, problem) of the candidates whose title has no guide yet (or all, by force): the model's answer as JSON, and what it lacks.

    Answers may stand in a fence or after other text. Rows with a problem are to be asked again in another run, as only titles of kept guides are passed over.
    """
    todo = candidates if force else candidates.join(existing.select("title"), "title", "left_anti")
    asked = map_limit(todo, lambda r: ask(guide_prompt(r, categories)), limit, "_answer", journal=journal).select("title", json_block(F.col("_answer")).alias("guide"))
    return asked.withColumn("problem", guide_problem(F.col("guide")))
