"""Gapless ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window partition holds on average at most.
RUN = 20_000


def ranked(df: DataFrame, group: list[str], by: list[str], total: int, name: str = "rank", collapse: bool = True) -> DataFrame:
    """df with its rows numbered from 0 inside each group, in the order of a hash of `by`, then of `by`.

    Rows that are equal in all columns become one with a count before they meet
    (unless collapse is False, for rows too wide for that) and rows again with
    the numbers that follow each other, so that a row repeated without end needs
    no task of its own. Rows of a group are spread over salts by the hash;
    counts of the salts give each its first rank, and no window holds more than
    one salt's rows.
    """
    salts = max(1, -(-total // RUN))
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("__n")) if collapse else df.withColumn("__n", F.lit(1).cast("long"))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    key = [*group, "__salt"]
    before = Window.partitionBy(*group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy(*key).agg(F.sum("__n").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    earlier = Window.partitionBy(*key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inside = salted.withColumn("__own", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    same = [inside[k].eqNullSafe(first[k]) for k in key]
    placed = inside.join(first, same).select(*(inside[c] for c in df.columns), "__n", (F.col("__own") + F.col("__first")).alias(name))
    if not collapse:
        return placed.drop("__n")
    runs = placed.withColumn("__run", F.explode(F.sequence(F.lit(0), F.expr(f"(__n - 1) div {RUN}"))))
    each = runs.withColumn("__k", F.explode(F.expr(f"sequence(__run * {RUN}, least(__run * {RUN} + {RUN - 1}, __n - 1))")))
    return each.select(*df.columns, (F.col(name) + F.col("__k")).alias(name))
