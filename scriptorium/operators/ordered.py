"""Values that run along an order within keys, without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import cut


def running(rows: DataFrame, key: str, pos: str, last: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """rows with values from those of their key that stand before them: of the one just before (last), and maxima over all (most).

    Rows are dealt out by ranges of key and position. What crosses from one range to the next is one row a range and key,
    so a key that holds a third of all rows is many tasks' work. A key's first row has nulls; keys and positions aren't null,
    and positions of a key differ.
    """
    last, most = last or {}, most or {}
    dealt = cut(rows.withColumns({**{f"_v_{n}": F.struct(c.alias("v")) for n, c in last.items()}, **{f"_v_{n}": c for n, c in most.items()}}).repartitionByRange(key, pos).withColumn("_p", F.spark_partition_id()))
    ends = dealt.groupBy(key, "_p").agg(*[F.max_by(f"_v_{n}", pos).alias(f"_e_{n}") for n in last], *[F.max(f"_v_{n}").alias(f"_e_{n}") for n in most])
    over = Window.partitionBy(key).orderBy("_p")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(key, "_p", *[F.lag(f"_e_{n}").over(over).alias(f"_b_{n}") for n in last], *[F.max(f"_e_{n}").over(earlier).alias(f"_b_{n}") for n in most])
    local = Window.partitionBy(key, "_p").orderBy(pos)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.withColumns({**{f"_l_{n}": F.lag(f"_v_{n}").over(local) for n in last}, **{f"_l_{n}": F.max(f"_v_{n}").over(before) for n in most}}).join(ends, [key, "_p"])
    return seen.select(*rows.columns, *[F.coalesce(f"_l_{n}", f"_b_{n}")["v"].alias(n) for n in last], *[F.greatest(f"_l_{n}", f"_b_{n}").alias(n) for n in most])
