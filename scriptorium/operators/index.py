"""A stored search index: postings and score bounds of blocks, so that a search reads few blocks and gives the rows of a full scan."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut
from .fuzzy import LEAST_SCORE, PIECE, THRESHOLD, WEIGHTS, pieces
from .search import Query, lexical_search

#: Rows of a block, buckets of postings, blocks that are read first, and blocks that are named one by one in a filter.
ROWS, BUCKETS, FIRST, NAMED = 512, 64, 8, 4096
#: What a match can add to a lexical score.
EXACT, TITLE, PHRASE, TOKEN, TITLE_TOKEN, KEYWORD, ACRONYM, ACRONYM_TITLE, CATEGORY, TERM, BASE = 240, 70, 42, 14, 28, 18, 92, 72, 24, 8, 100
GRAM = 3


@dataclass
class Read:
    """What a search read: blocks of all blocks, and whether postings told that there are exact hits."""

    blocks: int
    of: int
    exact: bool


#: Characters whose runs are sorted together.
TOGETHER = 1 << 21


def _grams(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Postings (term, _block, rows) of all runs of three characters of texts (_n, text). Rows are places in the block; a term may have several postings there."""
    for batch in batches:
        at, texts = batch.column("_n").to_numpy(zero_copy_only=False), batch.column("text")
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i in range(len(at) + 1):
            if first < i and (i == len(at) or at[i] // rows != at[first] // rows or held + sizes[i] > TOGETHER):
                yield _gram_postings(at[first:i], texts.slice(first, i - first).to_pylist(), sizes[first:i], rows)
                first, held = i, 0
            held += sizes[i] if i < len(at) else 0


def _gram_postings(at: np.ndarray, texts: list[str], sizes: np.ndarray, rows: int) -> pa.RecordBatch:
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(at)), sizes)
    key = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]  # a code point has 21 bits
    own = row[:-2] == row[2:]
    key, row = key[own], row[:-2][own]
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])  # a row has a run once
    key, row = key[new], row[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    each = key[start]
    text = np.stack([np.full(len(each), ord("g")), each >> 42, each >> 21 & 0x1FFFFF, each & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)), pa.int32()), pa.array((at[row] % rows).astype(np.int16)))
    return pa.RecordBatch.from_arrays([pa.array([text[i : i + 4] for i in range(0, len(text), 4)], pa.string()), pa.array(np.full(len(each), at[0] // rows), pa.int64()), lists], ["term", "_block", "rows"])


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(papers: DataFrame, path: str, pos: str = "pos", rows: int = ROWS, buckets: int = BUCKETS, total: float = sum(WEIGHTS.values()), prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Store rows in order of position, with postings of their terms and what each block of `rows` of them can score, under path.

    Papers are prepared rows. With `prepare`, which makes such of papers and must be given to searches too, the papers alone are
    moved and stored, as search columns hold each text twice more. They are moved once, and a row's number is its place in its file.

    Terms are all runs of three characters of the texts that a search looks into, whole keywords, categories and titles. A posting
    is a term in a block with the rows that have it, so a frequent term is many short rows; tasks make them of the rows that they
    read, so that single pairs of term and row aren't shuffled. `share` of a block is the greatest
    sum of its rows' exponents in an approximate match: with it the best that such a match can give is known.
    """
    spark, part = papers.sparkSession, F.shiftright("_at", 33).cast("int")  # monotonically_increasing_id() has the task above its 33 bits of place
    papers.repartitionByRange(pos).sortWithinPartitions(pos).withColumn("_at", F.monotonically_increasing_id()).withColumn("_p", part).write.mode("overwrite").parquet(f"{path}/rows")
    counts = spark.read.parquet(f"{path}/rows").groupBy("_p").agg(F.count("*").alias("count")).collect()  # one row a task
    places, before = [], 0
    for r in sorted(counts):
        places.append((r["_p"], before, r["count"], rows))
        before += r["count"]
    spark.createDataFrame(places, "_p int, before long, count long, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/places")
    placed = _prepared(_numbered(spark, path), prepare)
    words = lambda x: F.greatest(F.size(F.filter(F.split(x, " +"), lambda w: w != "")), F.lit(1))
    share = F.aggregate("_fields", F.lit(0.0), lambda s, f: s + f["w"] / total * F.floor(1000 / F.sqrt(words(f["x"])) + 0.5) / 1000)
    placed.groupBy("_block").agg(F.max(share).alias("share"), F.max(F.size("_keywords")).alias("keywords")).write.mode("overwrite").parquet(f"{path}/blocks")
    text = F.concat_ws("\n", "_blob", "_title", "_titles", "_keywords")
    grams = placed.select("_n", text.alias("text")).mapInArrow(lambda batches: _grams(batches, rows), "term string, _block long, rows array<smallint>")
    tagged = lambda tag, x: F.transform(F.array_distinct(x), lambda t: F.concat(F.lit(tag), t))
    terms = F.concat(tagged("k", F.col("_keywords")), tagged("c", F.col("_categories")), tagged("x", F.concat(F.array("_title"), F.col("_titles"))))
    whole = placed.select("_block", F.array((F.col("_n") % rows).cast("smallint")).alias("rows"), F.explode(terms).alias("term")).where("term IS NOT NULL")
    postings = grams.unionByName(whole).withColumn("bucket", _bucket(F.col("term"), buckets))
    postings.repartition("bucket", F.pmod("_block", F.lit(16))).sortWithinPartitions("bucket", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows with their number and block."""
    places = F.broadcast(spark.read.parquet(f"{path}/places").select("_p", "before", F.col("rows").alias("_each")))
    rows = spark.read.parquet(f"{path}/rows")
    placed = rows.join(places, "_p").withColumn("_n", F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.withColumn("_block", F.floor(F.col("_n") / F.col("_each")).cast("long")).select(*[c for c in rows.columns if c not in ("_at", "_p")], "_p", "_n", "_block")


def _prepared(rows: DataFrame, prepare: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    return prepare(rows) if prepare else rows


def _needles(query: Query) -> tuple[list[tuple[str, list[str], float]], float]:
    """(kind, terms, gain) of what can be looked up, all of whose terms a row must have; and what all rest may add to any row."""
    grams = lambda x: [f"g{x[i : i + GRAM]}" for i in range(len(x) - GRAM + 1)]
    out, rest = [], 0.0
    tokens = [t for t in query.tokens if len(t) > 1]
    needs = [(query.norm, TITLE + PHRASE), *((t, TOKEN + TITLE_TOKEN) for t in tokens), *((t, TERM) for t in query.terms if len(t) > 1), *((p, ACRONYM + ACRONYM_TITLE) for _, p in query.acronyms)]
    for text, gain in needs:
        if len(text) < GRAM:
            rest += gain
        else:
            out.append(("text", list(dict.fromkeys(grams(text))), gain))
    parts = {query.norm[i:j] for i in range(len(query.norm) + 1) for j in range(i, len(query.norm) + 1)}
    out += [("keyword", [f"k{p}"], KEYWORD) for p in sorted(parts)]
    out += [("category", [f"c{c}"], CATEGORY) for c in query.categories]
    return out, rest


def _least(query: Query) -> float:
    """The least score of an approximate match of a text that doesn't have the query as it stands: one edit in its longest piece."""
    found = pieces(query.text.strip().lower())
    return (max(LEAST_SCORE, 1 / min(PIECE, max(map(len, found)))) + LEAST_SCORE * (len(found) - 1)) / len(found)


def _postings(spark: SparkSession, path: str, terms: list[str], buckets: int) -> DataFrame:
    """Postings of some terms: only their buckets are read."""
    own = {r["b"] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), buckets).alias("b")).distinct().collect()}
    return spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(*sorted(own)) & F.col("term").isin(*terms))


def _rows(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """Rows of some blocks: a few are named in the filter with the tasks that wrote them, so that other files aren't read; many are joined."""
    some = [r["_block"] for r in blocks.select("_block").limit(NAMED + 1).collect()]
    stored = _numbered(spark, path)
    if len(some) > NAMED:
        return stored.join(F.broadcast(blocks.select("_block")), "_block", "left_semi").select(*stored.columns)
    files = {p["_p"] for p in spark.read.parquet(f"{path}/places").collect() if any(p["before"] < (b + 1) * p["rows"] and b * p["rows"] < p["before"] + p["count"] for b in some)}
    return stored.where(F.col("_p").isin(*sorted(files)) & F.col("_block").isin(*some))


def indexed_search(spark: SparkSession, path: str, query: Query, limit: int, pos: str = "pos", buckets: int = BUCKETS, prepare: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, Read]:
    """lexical_search() of the stored rows, and what it read. prepare: what build_index() was given.

    Postings give for each row the most that its score can be, and blocks take the greatest of their rows'. The few most
    promising blocks are scored first; then only those whose bound isn't below the limit-th score so far. If any
    title is the query, only blocks with such a title are read. A query of under three characters scans all blocks.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    every = blocks.count()
    if not every:
        return _hits(_numbered(spark, path), query, limit, pos, prepare), Read(0, 0, False)
    if len(query.norm) < GRAM:
        return _hits(_numbered(spark, path), query, limit, pos, prepare), Read(every, every, False)
    exact = cut(_postings(spark, path, [f"x{query.norm}"], buckets).select("_block").distinct())
    if exact.head(1):
        return _hits(_rows(spark, path, exact), query, limit, pos, prepare), Read(exact.count(), every, True)
    needles, rest = _needles(query)
    wanted = [(n, t, len(terms), float(gain), kind) for n, (kind, terms, gain) in enumerate(needles) for t in terms]
    asked = F.broadcast(spark.createDataFrame(wanted, "needle int, term string, need int, gain double, kind string"))  # as long as the query
    found = _postings(spark, path, sorted({w[1] for w in wanted}), buckets).join(asked, "term").select("_block", "needle", "need", "gain", "kind", F.explode("rows").alias("row"))
    whole = found.groupBy("_block", "row", "needle", "need", "gain", "kind").agg(F.count("*").alias("c")).where("c = need")
    phrase = F.max(F.when(F.col("needle") == 0, 1).otherwise(0)) if needles and needles[0][0] == "text" else F.lit(0)
    gains = whole.groupBy("_block", "row").agg(F.sum("gain").alias("gain"), phrase.alias("phrase")).groupBy("_block", "phrase").agg(F.max("gain").alias("gain"))
    near = BASE * (1 - F.pow(F.lit(_least(query)), F.col("share")))
    base = F.when(F.coalesce("phrase", F.lit(0)) == 1, BASE + KEYWORD * F.col("keywords")).otherwise(near if 1 / len(query.text.strip()) <= THRESHOLD or len(pieces(query.text.strip())) > 1 else F.lit(0.0))
    none = blocks.select("_block", F.lit(0).alias("phrase"), F.lit(0.0).alias("gain"))  # a block's rows without any needle
    bound = gains.unionByName(none).join(blocks, "_block").groupBy("_block").agg(F.max(F.col("gain") + base + rest + 1e-6).alias("bound"))
    bound = cut(bound)
    first = cut(bound.orderBy(F.desc("bound"), "_block").limit(FIRST))
    head = _hits(_rows(spark, path, first), query, limit, pos, prepare).select("score").collect()  # at most `limit` numbers
    floor = min(r["score"] for r in head) if len(head) >= max(1, limit) else -math.inf
    more = cut(bound.where(F.col("bound") >= floor))
    return _hits(_rows(spark, path, more), query, limit, pos, prepare), Read(more.count(), every, False)


def _hits(rows: DataFrame, query: Query, limit: int, pos: str, prepare: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    return lexical_search(_prepared(rows, prepare), query, limit, pos).drop("_p", "_block", "_n")
