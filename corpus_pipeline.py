"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage reads what its predecessor kept, written as Parquet, and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import langid, mixing, packing, secret_scan, simhash
from scriptorium.llm.common import cut, cuts, drop_cuts, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: null texts, texts without a letter, and those far from every centroid for their length.

    Texts count whole; rows that repeat are judged each; no documents give none.
    """
    return langid.identify(docs.select(*COLUMNS)).where(~F.col("rejected")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one document stays, once: that of the least id (none last) and, among rows of that id, of least hash.

    What stays is decided on ids and hashes; the texts are dealt out once, by the join that keeps them. Null texts and texts
    without words are one component; unlike texts that share an id, or have none, all stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0)).alias("id")).alias("_k")
    rows = docs.select(*COLUMNS, key, F.xxhash64(*COLUMNS).alias("_h"))
    keep = simhash.representatives(rows, "_h").select(key, "_h", F.col("n").alias("_n"))
    kept = rows.join(keep.hint("shuffle_hash"), ["_k", "_h"])
    return kept.where("_n = 1").select(*COLUMNS).unionByName(kept.where("_n > 1").select(*COLUMNS).distinct())


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are redacted, opaque strings where the owners of their value over the whole corpus show them live.

    Documents without any stay as they are, null and empty ones and rows that repeat too.
    """
    return secret_scan.redact_secrets(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole documents, once for each copy, sorted by finish time and cut where the order reaches the budget.

    Null texts and texts without words are no part of a mix. Rows that repeat count each; a null source is one of its own.
    """
    return mixing.mix_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens; null and empty texts are one end id, rows that repeat are packed each."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [("language ID", language), ("SimHash near-dedup", near_dedup), ("secret scans", secrets), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder; what it leaves there besides, and its input, then goes."""
    docs, before = table(spark, sf_dir, "documents"), cuts()
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        drop_cuts(spark, before, but_last=True)
    return docs


ORACLE_SQL = None
