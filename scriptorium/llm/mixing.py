"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, word_count

#: Rows of a source that one task orders, about, and words of a range of finish times.
BUCKET_ROWS, RANGE_WORDS = 20_000, 20_000_000
#: Largest table of sources that is broadcast, in bytes.
BROADCAST_BYTES = 8 << 20


def fair_targets(sizes: list[int], weights: list[float], budget: float, epochs: int = 3) -> list[float]:
    """Shares of budget by weight, none above epochs times its size; the excess goes to the others by weight."""
    target, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = float(budget)
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if level * weights[i] > epochs * sizes[i]]
        if not full:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in full:
            target[i] = float(epochs * sizes[i])
        left -= sum(epochs * sizes[i] for i in full)
        open_ = [i for i in open_ if level * weights[i] <= epochs * sizes[i]]
    return target


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A document's place in the shuffled order: 32 hexadecimal digits of a hash that SQL has too."""
    empty = F.lit("")
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), empty), F.md5(F.coalesce(text, empty))))


def _served(docs: DataFrame, weights: tuple[float, ...], epochs: int, seed: int, *extra: Column) -> tuple[DataFrame, int, float]:
    """Rows (_rid, _o, doc_id, size, source_size, target, start, *extra), where _o numbers sources and start counts the words of a source that stand before a document in its shuffled order; the budget in words; and a virtual time at which the queue has served it.

    At time t a source has served t times its target but for the document that it is at, so the sources that aren't out of copies
    have served the budget's rest by 1 + their longest documents / their targets.

    The sources (not their documents) come to the driver: their number is a parameter of the mix. A source's words are
    summed in ranges of the shuffled order, so no task holds a source.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("_source"), word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("_r"), *extra)
    names = [c for c in rows.columns if c not in ("doc_id", "_source", "size", "_r")]
    rows = cut(rows.withColumn("_rid", F.monotonically_increasing_id()))
    totals = sorted(rows.groupBy("_source").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.max("size").alias("most")).collect(), key=lambda x: (x["_source"] is None, (x["_source"] or "").encode()))
    sizes = [x["n"] for x in totals]
    target = fair_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], sum(sizes), epochs)
    open_ = [i for i in range(len(sizes)) if 0 < target[i] < epochs * sizes[i]]
    horizon = 1 + sum(totals[i]["most"] for i in open_) / max(1.0, sum(target[i] for i in open_))
    shape = T.StructType([T.StructField("_s", T.StringType()), T.StructField("_o", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    sources = spark.createDataFrame([(x["_source"], i, sizes[i], target[i]) for i, x in enumerate(totals)], shape)
    if sum(40 + len(x["_source"] or "") for x in totals) <= BROADCAST_BYTES:
        sources = F.broadcast(sources)
    rows = rows.join(sources, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_source")

    parts = max(64, -(-max([x["rows"] for x in totals], default=0) // BUCKET_ROWS))
    rows = rows.withColumn("_b", F.floor(F.conv(F.left("_r", F.lit(8)), 16, 10).cast("long") * parts / F.lit(2.0**32)).cast("int"))
    sums = rows.groupBy("_o", "_b").agg(F.sum("size").alias("w"))
    before = sums.select("_o", "_b", (F.sum("w").over(Window.partitionBy("_o").orderBy("_b")) - F.col("w")).alias("_before"))
    local = Window.partitionBy("_o", "_b").orderBy("_r", "doc_id", "size", "_rid").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.sum("size").over(local)).join(before, ["_o", "_b"])
    served = rows.select("_rid", "_o", "doc_id", "size", "source_size", "target", (F.col("_before") + F.col("_local") - F.col("size")).alias("start"), *names)
    return cut(served), sum(sizes), horizon


def _copies(served: DataFrame, epochs: int, horizon: float) -> DataFrame:
    """Adds a row for each copy of a document: copy (from 0) and finish, its virtual time: words of its source up to its end over the source's target.

    Copies that only start after the horizon are beyond what the budget can reach and aren't made.
    """
    copies = served.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    begin = F.col("copy") * F.col("source_size") + F.col("start")
    return copies.where(begin <= F.lit(horizon) * F.col("target")).withColumn("finish", (begin + F.col("size")).cast("double") / F.col("target"))


def _truncated(copies: DataFrame, budget: int, horizon: float) -> DataFrame:
    """Copies in the global order of finish times, ties by source, with `taken`: their words as far as the budget reaches. The one at which it ends is taken in part.

    The order is cut into ranges of equal virtual time, which hold about equally many words, as the queue serves at a
    constant rate; the last one also has what ends after the horizon, a document of a source at most. Each range is
    sorted by one task; the words of earlier ranges come from their sums.
    """
    parts = max(64, -(-budget // RANGE_WORDS))
    rows = copies.withColumn("_range", F.floor(F.least(F.col("finish"), F.lit(horizon)) * parts).cast("int"))
    sums = rows.groupBy("_range").agg(F.sum("size").alias("w"))
    before = sums.select("_range", (F.sum("w").over(Window.orderBy("_range")) - F.col("w")).alias("_before"))
    local = Window.partitionBy("_range").orderBy("finish", "_o", "copy").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.sum("size").over(local)).join(before, "_range")
    room = F.lit(budget) - F.col("_before") - F.col("_local") + F.col("size")
    return rows.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("long")).drop("_range", "_local", "_before")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row per document: what a mix of all sources takes of it.

    Sources by code point, null last, get the weights in turn and share a budget of all words (fair_targets). Documents of
    a source are shuffled by a hash and queue up in that order, up to `epochs` times. All sources' copies are sorted by
    virtual finish time and truncated where their words reach the budget, so a source's taken words are within a document
    or so of its target.

    Null text or text without words: size 0, taken 0. Long texts count whole. Ties in the shuffled order go by id and
    size, ties of finish times by source. Rows that repeat count each. An empty table gives no rows, one without words
    targets and taken of 0. Columns of docs other than doc_id, text and source are ignored, whatever their names.
    Columns: doc_id, size, source_size, target, taken.
    """
    served, budget, horizon = _served(docs, weights, epochs, seed)
    taken = _truncated(_copies(served, epochs, horizon), budget, horizon).groupBy("_rid").agg(F.sum("taken").alias("taken"))
    rows = served.select("_rid", "doc_id", "size", "source_size", "target").join(taken, "_rid", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: whole documents, once for each copy, sorted by finish time and truncated at the budget.

    The copy at which the budget ends is in if at least half of it is taken. What is taken is decided on hashes of rows;
    texts move for the join that keeps them and for the sort. Rows that repeat in all columns are taken as often as all of
    them are. Null and empty texts, having no words, are left out; long texts count whole; ties are those of mix_sources();
    an empty table gives no rows. Columns: those of docs, whatever their names.
    """
    nulls = [F.col(c).isNull() for c in docs.columns]  # a hash passes over nulls
    hashes = F.struct(*[F.xxhash64(F.lit(i), *nulls, *docs.columns).alias(f"h{i}") for i in (1, 2)])
    served, budget, horizon = _served(docs, weights, epochs, seed, hashes.alias("_key"))
    taken = _truncated(_copies(served, epochs, horizon), budget, horizon).where("2 * taken >= size and taken > 0")
    taken = taken.groupBy("_key").agg(F.collect_list("finish").alias("at"))
    many = served.groupBy("_key").agg(F.count("*").alias("n"))
    decided = cut(taken.join(many, "_key").select(F.col("_key.h1").alias("h1"), F.col("_key.h2").alias("h2"), "at", "n"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), hashes.alias("key")).select("row", "key.h1", "key.h2")
    kept = rows.join(decided.hint("shuffle_hash"), ["h1", "h2"])
    once = kept.where("n = 1").unionByName(kept.where("n > 1").dropDuplicates(["h1", "h2"]))
    copies = once.select("row", "h1", F.explode("at").alias("finish"))
    return copies.repartitionByRange("finish", "h1").sortWithinPartitions("finish", "h1").select("row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    return mix_sources(docs)
