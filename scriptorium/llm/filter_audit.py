"""How filters interact: what each removes in every order, with duplicates found by partition refinement."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, apart, cut

#: Code points of a text's first block, and how much longer each further one is: ten blocks hold any text.
FIRST, GROWTH = 256, 8
#: Classes of surviving texts up to which they are broadcast, as pairs of longs.
BROADCAST_ROWS = 250_000
#: Filters by letter; E, the duplicates, needs all texts.
LETTERS = "ABCDE"


def _bounds() -> list[tuple[int, int]]:
    """(first, size) of the blocks."""
    out, at, size = [], 0, FIRST
    while at < 1 << 31:
        out.append((at, min(size, (1 << 31) - 1)))
        at, size = at + size, size * GROWTH
    return out


BOUNDS = _bounds()


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: under 50 words, under 65 % of words distinct, over 5 % capitals, symbols."""
    trimmed = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    counts = F.transform(F.array(F.split(trimmed, f"[{SPACE}]+")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))  # split once
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")

    def bits(c: Column) -> Column:
        words, distinct = F.when(trimmed == "", 0).otherwise(c["n"]), F.when(trimmed == "", 0).otherwise(c["distinct"])
        tests = [words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
        return sum((F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)), F.lit(0))

    return F.get(F.transform(counts, bits), F.lit(0))


def _block_hashes(text: Column) -> list[Column]:
    """A hash of each block that a text reaches; further ones are null."""
    return [F.when(F.length(text) > first, F.xxhash64(F.substring(text, first + 1, size))) for first, size in BOUNDS]


def _class_of(length: Column, hashes: list[Column]) -> Column:
    """The class of texts of a length and the hashes of their first blocks; blocks that a text doesn't reach change nothing."""
    return F.xxhash64(length.cast("long"), *hashes)


def repeated_classes(rows: DataFrame) -> DataFrame:
    """(cls, least): classes of rows (doc_id, length, hashes) that are still of several rows after refinement, with their least doc_id.

    Classes are split by length, then by one block's hash after the other; rows that are alone in theirs leave at once, and
    those whose last block has been looked at are done.
    """
    live, done = rows.select("doc_id", "length", "hashes", _class_of(F.col("length"), []).alias("cls")), None
    for k in range(len(BOUNDS) + 1):
        covered = BOUNDS[k][0] if k < len(BOUNDS) else 1 << 31
        several = apart(live.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls"), "cls")
        live = cut(live.join(several, "cls", "left_semi").select("doc_id", "length", "hashes", "cls"))
        ended = live.where(F.col("length") <= covered).groupBy("cls").agg(F.min("doc_id").alias("least"))
        done = ended if done is None else done.unionByName(ended)
        live = live.where(F.col("length") > covered)
        if not live.head(1):
            break
        live = live.withColumn("cls", _class_of(F.col("length"), [F.col("hashes")[i] for i in range(k + 1)]))
    return done.where("least IS NOT NULL").groupBy("cls").agg(F.min("least").alias("least"))


def later_copies(docs: DataFrame, rows: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, part, failed): rows of docs whose whole text a smaller doc_id has too, with what else they fail.

    Texts of repeated_classes() are held against that of their class's least id. Those that differ, by a collision of
    hashes, are compared again among themselves, so the result is exact.

    docs: (doc_id, part, text), text not null. A null doc_id is never smaller or larger. Rows that repeat are marked each.
    """
    rows = rows if rows is not None else cut(_described(docs))
    classes = cut(repeated_classes(rows))
    classes = F.broadcast(classes) if classes.count() <= broadcast_rows else classes.hint("shuffle_hash")
    texts = docs.withColumn("cls", _class_of(F.length("text"), _block_hashes(F.col("text"))))
    left = cut(texts.join(classes, "cls").select("cls", "least", "doc_id", "part", "text"))
    marked = None
    while True:
        first = left.where("doc_id = least").select("cls", F.col("text").alias("_first")).dropDuplicates(["cls"])
        same = F.col("text") == F.col("_first")
        seen = cut(left.join(apart(first, "cls"), "cls").select("cls", "doc_id", "part", "text", "least", same.alias("same")))
        found = seen.where("same AND doc_id > least").select("doc_id", "part", failures(F.col("text")).alias("failed"))
        marked = found if marked is None else marked.unionByName(found)
        differing = seen.where("NOT same").drop("least", "same")
        if not differing.head(1):
            return marked
        least = apart(differing.groupBy("cls").agg(F.min("doc_id").alias("least")).where("least IS NOT NULL"), "cls")
        left = cut(differing.join(least, "cls").select("cls", "least", "doc_id", "part", "text"))


def _described(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "part", failures(F.col("text")).alias("failed"), F.length("text").alias("length"), F.array(*_block_hashes(F.col("text"))).alias("hashes"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents of a part by the set of filters that they fail, and how many of them labels call good or toxic.

    Duplicates are marked first: a marked row leaves its cell for the one with E. Only ids meet the labels.
    """
    rows = cut(_described(docs))
    marked = cut(later_copies(docs, rows))
    at = lambda df, failed, w: df.select("doc_id", "part", failed.alias("failed"), F.lit(w).cast("long").alias("w"))
    cells = at(rows, F.col("failed"), 1).unionByName(at(marked, F.col("failed"), -1)).unionByName(at(marked, F.col("failed") + 16, 1))
    yes = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(c)
    known = apart(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(yes("quality"), yes("toxic")).where("quality + toxic > 0"), "doc_id")
    zero = F.lit(0).cast("long")
    plain = cells.groupBy("part", "failed").agg(F.sum("w").alias("n")).withColumns({"good": zero, "toxic": zero})
    told = cells.join(known, "doc_id").groupBy("part", "failed").agg(F.sum(F.col("w") * F.col("quality")).alias("good"), F.sum(F.col("w") * F.col("toxic")).alias("toxic")).withColumn("n", zero)
    return plain.unionByName(told).groupBy("part", "failed").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: what the step keeps and removes, and what it loses.

    A filter applied in some order removes what fails it and has failed none before, so counts of the sets of filters that documents fail
    give all orders. shapley: how many a filter removes in all 120 orders together; a document that fails m filters falls to
    each of them in 120 / m orders.

    Null texts are empty ones, a null source is the part of the empty string. Long texts count whole. Of equal texts those of
    the least doc_id pass E; rows that repeat share it, and rows without an id are never duplicates. A document is good or
    toxic if any of its labels says so. No documents: no rows. Other columns are ignored, whatever their names.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = mask_counts(texts, labels).groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    orders = parts.select("part", "cells", F.explode(F.lit(["".join(p) for p in permutations(LETTERS)])).alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    bit = lambda at: F.expr(f"shiftleft(1, ascii(substring(filter_order, {at}, 1)) - 65)")
    steps = steps.withColumns({"own": bit("step"), "before": sum((F.when(F.col("step") > k, bit(k)).otherwise(0) for k in range(1, len(LETTERS))), F.lit(0))})
    has = lambda c, mask: c["failed"].bitwiseAND(F.col(mask)) != 0
    here = lambda c: has(c, "own") & ~has(c, "before")

    def total(test, value="n") -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(test(c), c[value] if isinstance(value, str) else value(c)).otherwise(0))

    return steps.select(
        "part", "filter_order", "step", total(lambda c: ~has(c, "own") & ~has(c, "before")).alias("kept"), total(here).alias("removed"), total(lambda c: has(c, "own") & has(c, "before")).alias("redundant"), total(lambda c: c["failed"] == F.col("own")).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"), total(lambda c: has(c, "own"), lambda c: c["n"] * (F.lit(120) / F.bit_count(c["failed"])).cast("long")).alias("shapley"),
    )
