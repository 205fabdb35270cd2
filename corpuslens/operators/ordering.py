"""Positions in a total order, and first-row rules, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import stage


def positioned(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with each row's position in the order, from 1: a range shuffle, counts of its parts, and ranks inside them.

    End the order with a unique column, so that ties can be dealt to several parts.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", inside).join(first, "__part").withColumn(name, F.col("__own") + F.col("__first")).drop("__part", "__own", "__first")


def keep_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key that comes last."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last")).select(*key, "__last.*")
