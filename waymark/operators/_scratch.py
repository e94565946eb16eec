"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's folder (``spark.checkpoint.dir``); a temporary one
    only where none is set, as in local tests."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(found or Path(tempfile.mkdtemp(prefix="waymark-")).as_uri())
    return df.checkpoint()


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with a dense number from 0 in a total order, without bringing all rows together: rows
    are range-partitioned, counted by partition and numbered within it. Equal rows of the order
    get numbers next to each other."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    named = df.select("*", *(k.alias(f"__o{i}") for i, k in enumerate(keys)))
    by = [f"__o{i}" for i in range(len(keys))]
    ranged = checkpoint(named.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*by)) - 1
    out = ranged.withColumn("__place", place).join(F.broadcast(before.select("__part", "__before")), "__part")
    return out.withColumn(name, (F.col("__before") + F.col("__place")).cast("long")).drop("__part", "__before", "__place", *by)
