"""Clusters of similar records: fully identical, or variants of a shared stem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.components import connected_components


def clusters(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(row, cluster_id) of rows in clusters of two or more; pairs link classes, members puts rows into them."""
    linked = connected_components(pairs, "i", "j").select(F.col("node").alias("class_id"), F.col("component"))
    rows = members.join(linked, "class_id", "left").select("row", F.coalesce("component", "class_id").alias("cluster_id"))
    several = rows.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(several, "cluster_id").select("row", "cluster_id")


def classified(clustered: DataFrame, records: DataFrame, row: str, fields: list[str]) -> DataFrame:
    """(cluster_id, records, identical): identical if all members agree in every raw field, null being a value."""
    own = records.select(F.col(row).alias("row"), F.struct(*fields).alias("fields"))
    joined = clustered.join(own, "row")
    same: Column = F.min("fields") == F.max("fields")
    return joined.groupBy("cluster_id").agg(F.count("*").alias("records"), F.coalesce(same, F.lit(False)).alias("identical"))


def cluster_totals(classes: DataFrame) -> DataFrame:
    return classes.agg(
        F.count("*").alias("clusters"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records_in_clusters"),
        F.count_if("identical").alias("identical_clusters"),
        F.coalesce(F.sum(F.when(F.col("identical"), F.col("records"))), F.lit(0)).alias("identical_records"),
        F.count_if(~F.col("identical")).alias("variant_clusters"),
    )
