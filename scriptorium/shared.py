"""Session helpers: the shared folder, tables cut from their lineage, and session defaults."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables that this process has cut, for drop_cuts().
_CUTS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    _CUTS.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """df as it is, but with long keys that the planner takes for new ones.

    An aggregate that is joined on its own keys shares the join's stage, whose partitions can't be split then. With an
    exchange between the two, a key that many rows of the other side have is dealt out by a skew join.
    """
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})


def cuts() -> int:
    """How many tables this process has cut and not deleted: a mark for drop_cuts()."""
    return len(_CUTS)


def drop_cuts(spark: SparkSession, since: int = 0, but_last: bool = False) -> None:
    """Delete the tables that this process has cut since a mark, but the last one if so told: for a session that is done with them."""
    jvm, kept = spark.sparkContext._jvm, _CUTS[-1:] if but_last and len(_CUTS) > since else []
    gone = _CUTS[since : len(_CUTS) - len(kept)]
    _CUTS[since:] = kept
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
