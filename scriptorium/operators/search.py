"""Lexical search: additive scores, query expansion, acronyms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import blank, contained, is_stop_word, let, normalize_search, tokenize
from ..values import DICTIONARY
from .fuzzy import WEIGHTS, field_list, fuzzy_score


@dataclass
class Query:
    """A search request, expanded on the driver: it is one short text."""

    text: str
    norm: str
    tokens: list[str]
    labels: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    acronyms: list[tuple[str, str]] = field(default_factory=list)


def _norm(text: str) -> str:
    import re
    import unicodedata

    kept = "".join(c if c.isalpha() or c.isnumeric() or c == "-" or c.isspace() else " " for c in unicodedata.normalize("NFKC", re.sub("['’`]", "", text).lower()))
    return " ".join(kept.split())


def expand(text: str, dictionary: list[tuple] = DICTIONARY) -> Query:
    """Tokens are terms too; each dictionary entry with an alias in the text adds its label, terms and categories."""
    norm = _norm(text)
    tokens = [t for t in norm.split(" ") if t]
    hits = [e for e in dictionary if any(_norm(a) in norm for a in e[1])]
    unique = lambda xs: list(dict.fromkeys(xs))
    return Query(text.strip(), norm, tokens, [e[0] for e in hits], unique(tokens + [_norm(t) for e in hits for t in e[3]]), unique(c for e in hits for c in e[2]))


def dictionary_matches(text: Column, dictionary: list[tuple] = DICTIONARY) -> Column:
    """(labels, terms, categories) of the entries with an alias in a text, for a column of queries."""
    return let(normalize_search(text), lambda body: _dictionary_matches(body, dictionary))


def _dictionary_matches(body: Column, dictionary: list[tuple]) -> Column:
    hit = lambda e: F.size(contained(body, [_norm(a) for a in e[1]])) > 0
    none = F.array().cast("array<string>")
    part = lambda values: F.array_distinct(F.flatten(F.array(*[F.when(hit(e), F.array(*[F.lit(v) for v in values(e)])).otherwise(none) for e in dictionary])))
    return F.struct(part(lambda e: [e[0]]).alias("labels"), F.array_distinct(F.concat(F.filter(F.split(body, " "), lambda t: t != ""), part(lambda e: [_norm(t) for t in e[3]]))).alias("terms"), part(lambda e: e[2]).alias("categories"))


def prepare(papers: DataFrame, title: str = "title", other_titles: list[str] = (), keywords: str | None = None, blob: list[str] = (), categories: str | None = None, fields: dict[str, float] | None = None) -> DataFrame:  # type: ignore[assignment]
    """Search columns beside the rows; cache or store these when many queries follow.

    other_titles and blob may name strings and arrays of strings. fields: those that are matched approximately, with their
    weights; by default all that papers have of the seven usual ones. What papers lack counts as empty.
    """
    kinds, none = dict(papers.dtypes), F.array().cast("array<string>")
    values = lambda c: F.coalesce(F.col(c), none) if kinds[c].startswith("array") else F.array(F.col(c))
    titles = F.concat(none, *[values(c) for c in other_titles])
    return papers.withColumns({
        "_title": normalize_search(F.col(title)),
        "_titles": F.transform(titles, normalize_search),
        "_keywords": F.transform(F.coalesce(F.col(keywords), none), normalize_search) if keywords else none,
        "_categories": F.coalesce(F.col(categories), none) if categories else none,
        "_blob": normalize_search(F.concat_ws(" ", *[F.filter(values(c), lambda x: x != "") for c in [title, *blob]])),
        "_fields": field_list(fields or {title if c == "title" else keywords if c == "keywords" and keywords else c: w for c, w in WEIGHTS.items()}, kinds),
    })


def lexical_scores(prepared: DataFrame, query: Query, base: Column | None = None) -> DataFrame:
    """score (0: no hit), exact and signals of each prepared row; fixed weights. base: a fuzzy score of 0 to 100."""
    q = F.lit(query.norm)
    points = lambda test, n: F.when(test, n).otherwise(0)
    long_ = lambda words: [w for w in words if len(w) > 1]
    found = contained(F.col("_blob"), long_(query.tokens))
    in_title = F.exists(found, lambda t: F.contains(F.col("_title"), t))
    exact = (F.col("_title") == q) | F.array_contains("_titles", q)
    key_hits = F.size(F.filter("_keywords", lambda k: F.contains(q, k) | F.contains(k, q)))
    phrases = F.array(*[F.struct(F.lit(a.upper()).alias("a"), F.lit(p).alias("p")) for a, p in query.acronyms]) if query.acronyms else F.array().cast("array<struct<a:string,p:string>>")
    spelled = F.filter(phrases, lambda x: F.contains(F.col("_blob"), x["p"]))
    spelled_titles = F.size(F.filter(spelled, lambda x: F.contains(F.col("_title"), x["p"])))
    cats = F.size(F.array_intersect("_categories", F.array(*[F.lit(c) for c in query.categories]).cast("array<string>")))
    terms = F.size(contained(F.col("_blob"), long_(query.terms))) if long_(query.terms) else F.lit(0)
    score = (
        (base if base is not None else F.lit(0.0)) + points(exact, 240) + points(F.contains(F.col("_title"), q), 70) + points(F.contains(F.col("_blob"), q), 42)
        + F.size(found) * 14 + points(in_title, 28) + key_hits * 18 + F.size(spelled) * 92 + spelled_titles * 72 + cats * 24 + terms * 8
    )
    signals = F.filter(F.array(
        F.when(exact, "exact title"), F.when(F.contains(F.col("_title"), q), "title contains query"), F.when(F.contains(F.col("_blob"), q), "exact phrase"),
        F.when(in_title, "title token"), F.when(key_hits > 0, "keyword"),
    ), lambda s: s.isNotNull())
    signals = F.concat(signals, F.slice(F.transform(spelled, lambda x: F.concat_ws(" -> ", x["a"], x["p"])), 1, 3), F.when(cats > 0, F.array(F.lit("semantic category"))).otherwise(F.array().cast("array<string>")))
    labels = F.array(*[F.lit(x) for x in query.labels]).cast("array<string>")
    signals = F.array_distinct(F.concat(signals, F.when((terms > 0) | (cats > 0), labels).otherwise(F.array().cast("array<string>"))))
    rows = prepared.withColumns({"score": score.cast("double"), "exact": exact, "signals": signals})
    return rows.drop("_title", "_titles", "_keywords", "_categories", "_blob", "_fields")


def fuzzy_base(query: Query) -> Column:
    """0 to 100 for a prepared row: its fields' approximate match with the query, as typed."""
    return fuzzy_score(F.col("_fields"), query.text) * 100.0


def exact_collapse(scored: DataFrame) -> DataFrame:
    """Only exact hits, if there is any: rows whose flag equals the greatest flag, an equi-join with one row."""
    most = scored.agg(F.max("exact").alias("_any"))
    return scored.join(F.broadcast(most), F.col("exact") == F.col("_any")).drop("_any")


def lexical_hits(prepared: DataFrame, query: Query) -> DataFrame:
    """All rows with a score, the fuzzy base included, without an order: for filters that follow. Only exact hits if there are any."""
    scored = lexical_scores(prepared, query, fuzzy_base(query))
    any_exact = prepared.select(F.max((F.col("_title") == F.lit(query.norm)) | F.array_contains("_titles", F.lit(query.norm))).alias("_any"))
    return scored.where("score > 0").join(F.broadcast(any_exact), F.col("exact") == F.col("_any")).drop("_any")


def lexical_search(prepared: DataFrame, query: Query, limit: int, pos: str = "pos") -> DataFrame:
    """The best rows by score, the fuzzy base included, then position; only exact hits if there are any.

    One pass and one bounded heap a task: exact hits come first in its order, so the head tells whether there is one.
    A filter on the score would be pushed to the scan and score each row twice; zeros go from the head instead.
    """
    head = lexical_scores(prepared, query, fuzzy_base(query)).orderBy(F.desc("exact"), F.desc("score"), pos).limit(max(1, limit))
    any_exact = F.max("exact").over(Window.partitionBy())
    return head.withColumn("_any", any_exact).where((F.col("score") > 0) & (F.col("exact") == F.col("_any"))).drop("_any").orderBy(F.desc("score"), pos)


def acronym_of(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-z0-9]+", "")


def phrase_acronym(tokens: Column) -> Column:
    """First characters of the words that say something; a digit prefix is kept whole with the letter after it."""
    head = lambda t: F.coalesce(F.nullif(F.regexp_extract(acronym_of(t), "^[0-9]+[a-z]?", 0), F.lit("")), F.left(acronym_of(t), F.lit(1)))
    return F.array_join(F.transform(F.filter(tokens, lambda t: ~is_stop_word(t)), head), "")


def _indexable(acronym: Column) -> Column:
    return F.length(acronym).between(2, 12) & acronym.rlike("[a-z]") & ~is_stop_word(acronym)


def _useful(tokens: Column) -> Column:
    return (F.size(tokens) >= 2) & F.exists(tokens, lambda t: (F.length(t) > 2) & ~is_stop_word(t))


def acronym_index(titles: DataFrame, title: str = "title", texts: str | None = None, longest: int = 5) -> DataFrame:
    """(acronym, phrase, weight): runs of 2 to 5 title words count 1, pairs with one in brackets 4; weights add up over the corpus.

    Grams are exploded and summed: combined before the shuffle, so a phrase that many titles have is no hot group.
    """
    words = F.filter(tokenize(F.col(title)), lambda t: F.length(t) > 1)
    none = F.array().cast("array<array<string>>")
    runs = F.concat(*[F.when(F.size("_w") >= n, _grams(n)).otherwise(none) for n in range(2, longest + 1)])
    grams = titles.select(words.alias("_w")).select(F.explode(runs).alias("t")).select(phrase_acronym(F.col("t")).alias("acronym"), F.col("t"), F.lit(1).alias("weight"))
    grams = grams.where(_indexable(F.col("acronym")) & _useful(F.col("t"))).select("acronym", F.array_join("t", " ").alias("phrase"), "weight")
    out = grams.unionByName(_bracketed(titles, title))
    if texts:
        out = out.unionByName(_bracketed(titles, texts))
    return out.groupBy("acronym", "phrase").agg(F.sum("weight").alias("weight"))


def _grams(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.slice(F.col("_w"), i, n))


# A phrase with its acronym in brackets, and the other way round.
LONG_SHORT = r"([A-Za-z0-9][A-Za-z0-9+\-/ ]{4,96}?)\s*\(([A-Za-z0-9][A-Za-z0-9-]{1,14})\)"
SHORT_LONG = r"([A-Za-z0-9][A-Za-z0-9-]{1,14})\s*\(([A-Za-z0-9][A-Za-z0-9+\-/ ]{4,96}?)\)"


def _bracketed(rows: DataFrame, column: str) -> DataFrame:
    text = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s+", " ")
    pairs = lambda p, short, long_: F.zip_with(F.regexp_extract_all(text, F.lit(p), F.lit(short)), F.regexp_extract_all(text, F.lit(p), F.lit(long_)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    found = rows.where(F.contains(F.col(column), F.lit("("))).select(F.explode(F.concat(pairs(LONG_SHORT, 2, 1), pairs(SHORT_LONG, 1, 2))).alias("x"))
    words = F.filter(F.split(normalize_search(F.array_join(_last_words(F.col("x.b")), " ")), " "), lambda t: t != "")
    made = found.select(acronym_of(F.col("x.a")).alias("acronym"), words.alias("t")).withColumn("g", phrase_acronym(F.col("t")))
    close = (F.col("g") == F.col("acronym")) | F.contains("g", "acronym") | F.contains("acronym", "g")
    return made.where(_indexable(F.col("acronym")) & _useful(F.col("t")) & close).select("acronym", F.array_join("t", " ").alias("phrase"), F.lit(4).alias("weight"))


def _last_words(text: Column, most: int = 6) -> Column:
    words = F.split(F.trim(text), r"\s+")
    return F.slice(words, F.greatest(F.lit(1), F.size(words) - (most - 1)), F.lit(most))


def acronym_expand(index: DataFrame, query: str, most: int = 8) -> DataFrame:
    """(acronym, phrase, rank): the heaviest phrases of each acronym among a query's tokens."""
    asked = [a for a in dict.fromkeys("".join(c for c in t if c.isascii() and c.isalnum()) for t in _norm(query).split()) if 2 <= len(a) <= 12 and any(c.isalpha() for c in a)]
    rank = F.row_number().over(Window.partitionBy("acronym").orderBy(F.desc("weight"), "phrase"))
    return index.where(F.col("acronym").isin(*asked)).withColumn("rank", rank).where(F.col("rank") <= most)


def text_rank(papers: DataFrame, query: str, fields: list[str], limit: int, title: str = "title", pos: str = "pos") -> DataFrame:
    """A plain ranking: 160 for the phrase, 16 a token, 40 for the phrase in the title."""
    q = expand(query, [])
    body = normalize_search(F.concat_ws(" ", *[blank(F.col(c)) for c in fields]))
    score = F.when(F.contains(body, F.lit(q.norm)), 160).otherwise(0) + F.size(contained(body, [t for t in q.tokens if len(t) > 1])) * 16 + F.when(F.contains(normalize_search(F.col(title)), F.lit(q.norm)), 40).otherwise(0)
    return papers.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), pos).limit(max(1, limit))
