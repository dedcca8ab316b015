"""Hybrid ranking by reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vectors import numbered

#: The constant of reciprocal ranks.
K = 60
#: Weights of a lexical rank by how the row was found.
EXACT, STRONG, HIGH, PLAIN, HIGH_SCORE = 3.2, 2.6, 2.0, 1.35, 80


def reciprocal_rank(*order: Column, k: int = K) -> Column:
    """1 / (k + rank). Ranks are over hit lists, which searches have cut to their limits."""
    return 1.0 / (F.row_number().over(Window.orderBy(*order)) + F.lit(float(k)))


def lexical_weight(exact: Column, signals: Column, score: Column) -> Column:
    strong = F.exists(signals, lambda s: F.contains(s, F.lit("->")) | (s == "exact phrase") | (s == "title contains query"))
    return F.when(exact, EXACT).when(strong, STRONG).when(score >= HIGH_SCORE, HIGH).otherwise(PLAIN)


def fuse(semantic: DataFrame, lexical: DataFrame, catalogue: DataFrame, model: str = "vectors", k: int = K, pos: str = "pos") -> DataFrame:
    """Ranked union of semantic (id, score) and lexical (id, score, exact, signals, pos) hits that the catalogue (id, pos) has.

    Ranks count hits that the catalogue lacks too. Order: rank score, lexical score, semantic score, position.
    Both lists are short: searches have cut them to their limits. fuse_all() takes any.
    """
    return _fused(semantic, lexical, catalogue, model, pos, lambda rows, order, _: reciprocal_rank(*order, k=k)).withColumn("rank", F.row_number().over(Window.orderBy(*_order(pos))))


def fuse_all(semantic: DataFrame, lexical: DataFrame, catalogue: DataFrame, model: str = "vectors", k: int = K, pos: str = "pos") -> DataFrame:
    """fuse() of hit lists of any length, without rank: rows are numbered by many tasks, and what is wanted is the head by fused_order()."""
    lexical = numbered(lexical.withColumn("_o", F.struct((-F.col("score")).alias("s"), F.col(pos).alias("p"))), "_o", into="_n").drop("_o")
    semantic = numbered(semantic.withColumn("_o", F.struct((-F.col("score")).alias("s"), F.col("id").alias("p"))), "_o", into="_n").drop("_o")
    return _fused(semantic, lexical, catalogue, model, pos, lambda rows, order, n: 1.0 / (n + F.lit(k + 1.0)))


def fused_order(pos: str = "pos") -> list[Column]:
    return _order(pos)


def _order(pos: str) -> list[Column]:
    return [F.desc("rankScore"), F.coalesce("lexicalScore", F.lit(0.0)).desc(), F.coalesce("semanticScore", F.lit(0.0)).desc(), F.col(pos)]


def _fused(semantic: DataFrame, lexical: DataFrame, catalogue: DataFrame, model: str, pos: str, rank) -> DataFrame:
    n = F.col("_n")
    sem = semantic.select("id", F.col("score").alias("semanticScore"), rank(semantic, (F.desc("score"), F.col("id")), n).alias("_s"))
    ranked = lexical.withColumn("_l", rank(lexical, (F.desc("score"), F.col(pos)), n) * lexical_weight(F.col("exact"), F.col("signals"), F.col("score")))
    lex = ranked.select("id", F.col("score").alias("lexicalScore"), "exact", "signals", "_l")
    both = sem.join(lex, "id", "full_outer").join(catalogue.select("id", pos), "id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    none = F.array().cast("array<string>")
    return both.select(
        "id", pos, (zero("_s") + zero("_l")).alias("rankScore"), "semanticScore", "lexicalScore", F.coalesce("exact", F.lit(False)).alias("exactTitleMatch"),
        F.array_distinct(F.concat(F.when(F.col("semanticScore").isNotNull(), F.array(F.lit(model))).otherwise(none), F.coalesce("signals", none))).alias("matchedSignals"),
    )
