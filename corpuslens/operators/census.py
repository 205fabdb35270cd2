"""Measures over catalogues: copy families, cohorts, concentration, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import wald
from corpuslens.operators.ordering import positioned


def families(items: DataFrame, key: str = "modified") -> DataFrame:
    """(family, members, broken) of copies: items (created, modified, broken) modified before they were created share their source's stamp."""
    copies = items.where(F.col("modified") < F.col("created"))
    return copies.groupBy(F.col(key).alias("family")).agg(F.count("*").alias("members"), F.count_if("broken").alias("broken"))


def collapsed_rates(items: DataFrame, families: DataFrame) -> DataFrame:
    """Broken shares by item and with each family as one item, broken if most of its members are; shares are null over nothing."""
    own = items.agg(F.count("*").alias("items"), F.count_if("broken").alias("broken_items"), F.count_if(F.col("modified") < F.col("created")).alias("copies"), F.count_if(F.col("broken") & ~F.coalesce(F.col("modified") < F.col("created"), F.lit(False))).alias("broken_originals"))
    of = families.agg(F.count("*").alias("families"), F.count_if(2 * F.col("broken") > F.col("members")).alias("broken_families"))
    one = own.select("*", F.lit(1).alias("__k")).join(of.select("*", F.lit(1).alias("__k")), "__k")
    population = F.col("items") - F.col("copies") + F.col("families")
    return one.select(
        "items", "broken_items", "copies", "families", "broken_families",
        F.try_divide("broken_items", "items").alias("raw_rate"),
        F.try_divide(F.col("broken_originals") + F.col("broken_families"), population).alias("collapsed_rate"),
        F.try_divide("copies", "items").alias("copy_share"),
    )


def cohorts(items: DataFrame, group: str, year: str, years: list[int]) -> DataFrame:
    """(group, n_<year>, broken_<year>) for the years given."""
    return items.groupBy(group).agg(*(x for y in years for x in (F.count_if(F.col(year) == y).alias(f"n_{y}"), F.count_if((F.col(year) == y) & F.col("broken")).alias(f"broken_{y}"))))


def family_halves(items: DataFrame, least: int = 20, tie: str = "id") -> DataFrame:
    """(family, half_size, older_broken, newer_broken, outcome) of families (family, created, broken) of `least` members or more; the middle one of an odd number is left out."""
    several = items.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # places in one total order, less each family's first: a family of any size is spread over tasks
    placed = positioned(items.select("family", "created", "broken", F.col(tie).alias("tie")).join(several, "family"), [F.col("family").asc(), F.col("created").asc(), F.col("tie").asc()], "place")
    first = placed.groupBy("family").agg(F.min("place").alias("first"))
    rows = placed.join(first, "family").withColumn("at", F.col("place") - F.col("first") + 1)
    half = F.expr("n div 2")
    rates = rows.groupBy("family", half.alias("half_size")).agg(F.count_if(F.col("broken") & (F.col("at") <= half)).alias("older_broken"), F.count_if(F.col("broken") & (F.col("at") > F.col("n") - half)).alias("newer_broken"))
    outcome = F.when(F.col("older_broken") > F.col("newer_broken"), "older").when(F.col("older_broken") < F.col("newer_broken"), "newer").otherwise("tie")
    return rates.withColumn("outcome", outcome)


def sign_test(halves: DataFrame) -> DataFrame:
    """older, newer, ties and z of older against newer."""
    counts = halves.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("older", "newer", "tie")))
    n = F.col("older") + F.col("newer")
    return counts.select("older", "newer", "tie", F.when(n > 0, (F.col("older") - n / F.lit(2.0)) / F.sqrt(n / F.lit(4.0))).alias("z"))


def pinned_year_rates(items: DataFrame, year: str, least: int = 20, tie: str = "created") -> DataFrame:
    """(family, pinned_year, members, broken) of each family's most frequent year, ties to the year that comes first."""
    years = items.groupBy("family", F.col(year).alias("y")).agg(F.count("*").alias("members"), F.count_if("broken").alias("broken"), F.min(tie).alias("first"))
    best = years.groupBy("family").agg(F.max_by(F.struct("y", "members", "broken"), F.struct(F.col("members"), -F.unix_micros(F.col("first").cast("timestamp")))).alias("b"))
    return best.select("family", F.col("b.y").alias("pinned_year"), "b.members", "b.broken").where(F.col("members") >= least)


def top_shares(df: DataFrame, value: str, tie: str, ks: list[int], parts: list[int] = [100, 10]) -> DataFrame:
    """(k, share) of the total in the k largest values, for ks and for n div each of parts; k below 1 is left out, k above n takes all."""
    ranked = positioned(df.select(F.coalesce(F.col(value), F.lit(0)).alias("v"), F.col(tie).alias("t")), [F.desc("v"), F.col("t").asc()])
    n, total = df.agg(F.count("*"), F.sum(value)).first()
    wanted = sorted({k for k in [*ks, *(n // p for p in parts)] if k >= 1})
    sums = ranked.agg(*(F.sum(F.when(F.col("position") <= k, F.col("v"))).alias(f"k{k}") for k in wanted) or [F.lit(0)])
    rows = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.try_divide(F.col(f"k{k}"), F.lit(total)).cast("double").alias("share")) for k in wanted))
    return sums.select(F.inline(rows))


def upper_median(df: DataFrame, value: str, tie: str) -> DataFrame:
    """The value at place n div 2, from 0, of the values that aren't zero."""
    some = df.where((F.col(value).isNotNull()) & (F.col(value) != 0)).select(F.col(value).alias("v"), F.col(tie).alias("t"))
    n = some.count()
    return positioned(some, [F.col("v").asc(), F.col("t").asc()]).where(F.col("position") == n // 2 + 1).select(F.col("v").alias("upper_median"))


def publisher_concentration(latest: DataFrame, publisher: Column, top: int = 10) -> DataFrame:
    """publishers, singletons and the share of all names that the largest publishers hold."""
    counts = latest.groupBy(publisher.alias("publisher")).agg(F.count("*").alias("n"))
    largest = counts.orderBy(F.desc("n"), "publisher").limit(top).agg(F.sum("n").alias("top_names"))
    whole = counts.agg(F.count("*").alias("publishers"), F.count_if(F.col("n") == 1).alias("singletons"), F.sum("n").alias("names"))
    return whole.withColumn("__k", F.lit(1)).join(largest.withColumn("__k", F.lit(1)), "__k").select("publishers", "singletons", "names", F.try_divide("top_names", "names").alias("top_share"))


def duplicate_share(df: DataFrame, key: Column) -> DataFrame:
    """records, duplicated (those in groups of two or more; an empty key is a key) and their share."""
    groups = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicated")).withColumn("share", F.try_divide("duplicated", "records"))


def latest(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The last version of each name."""
    rest = [c for c in df.columns if c != name]
    return df.groupBy(name).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__v")).select(name, "__v.*")


def dead_only(df: DataFrame, key: list[str], dead: Column, alive: Column) -> DataFrame:
    """Keys with a dead row and no live one."""
    return df.where(dead).select(*key).distinct().join(df.where(alive).select(*key).distinct(), key, "left_anti")


def dead_rates(df: DataFrame, status: str, by: list[Column] | None = None) -> DataFrame:
    """n, resolved, dead, unresolved, dead_pct and half-width ci of each group; what is unresolved counts in neither side, groups without resolved rows are left out."""
    known = F.col(status).isin("alive", "dead")
    counts = df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(known).alias("resolved"), F.count_if(F.col(status) == "dead").alias("dead"), F.count_if(~F.coalesce(known, F.lit(False))).alias("unresolved"))
    p = F.col("dead") / F.col("resolved")
    return counts.where("resolved > 0").withColumns({"dead_pct": p * 100, "ci": wald(p, F.col("resolved"))})


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of a small table of cohorts, ties at their mean rank."""

    def mean_rank(c: str) -> Column:
        return F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / F.lit(2.0)

    return df.select(mean_rank(x).alias("rx"), mean_rank(y).alias("ry")).agg(F.corr("rx", "ry").alias("rho"))


def upserted(history: DataFrame, row: DataFrame, date: str = "date") -> DataFrame:
    """history without row's date, then row. Write it beside history and swap."""
    return history.join(row.select(date), date, "left_anti").select(*history.columns).unionByName(row)


def drift(history: DataFrame, order: str, value: str) -> DataFrame:
    """Each census with its change against the one before; a history has a row for each day."""
    return history.withColumn("change", F.col(value) - F.lag(value).over(Window.orderBy(order)))


def repo_rollup(mentions: DataFrame) -> DataFrame:
    """(slug_lc, slug, first_date, papers, is_ml) of mentions (arxiv_id, slug, date, is_ml)."""
    return mentions.groupBy(F.lower("slug").alias("slug_lc")).agg(F.min_by("slug", F.struct("date", "arxiv_id", "slug")).alias("slug"), F.min("date").alias("first_date"), F.count_distinct("arxiv_id").alias("papers"), F.bool_or("is_ml").alias("is_ml"))
