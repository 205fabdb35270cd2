"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Targets: sources in order of code points, null last, weigh 1, 2, 3, repeating;
shares of all words are capped at three times a source's own, the excess going
to the others by weight. The level of that water rises step by step, each a sum
over the sources that the cap leaves.

Rates: each source asks that the sum of rate * words equals its target. Of all
rates between 0 and 3 those of least relative entropy from 1 are
exp(lambda * words), cut at 3: documents at the cap leave the dual, whose
multiplier Newton steps solve inside a bracket. Documents enter only through
counts of (source, words), an exact and much smaller statistic, which every step
sums up in Spark; only the state, a row for each source, is broadcast, and only
below a bound on its rows.

Copies: over the sizes of a source, longest first, running sums of rates are
rounded, which gives each size its number of copies; what this leaves in words is
evened out by single copies of the shortest documents. Documents of a size share
their copies by rank of a hash, so a rerun takes the same.

Null texts and texts without words have size 0 and are never taken; a source
without words has target 0. Null sources are one source. Repeated rows and rows
of equal ids are rows of their own; of equal rows any takes any of their copies.
Texts of any length count whole. An empty table gives no rows. Extra columns
pass through the mix whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.ranks import ranked
from corpuslens.operators.ordering import positioned
from corpuslens.session import stage

#: Copies of a document at most.
CAP = 3
#: Steps after which an unsettled dual is an error.
STEPS = 100
#: Sources up to which the state is broadcast; beyond that it is joined by a shuffle.
SMALL = 10_000
#: Words by which a source may miss its target before rounding, relative to it.
TOLERANCE = 1e-7
BLANK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of runs outside ASCII white space."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(bare, BLANK, "")).cast("long")


def targets(hist: DataFrame, weights: int = 3, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size, n)."""
    sums = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weighed = positioned(sums, [F.col("source").asc_nulls_last()], "at")
    weighed = stage(weighed.select("source", "source_size", ((F.col("at") - 1) % weights + 1).cast("double").alias("w")), "mix-weights")
    total, most = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(1.0))).first()
    water, seen = total / most, None
    while water != seen:  # each step lets more sources reach the cap and the rest share what those leave
        seen = water
        over = F.col("source_size") * cap < F.lit(water) * F.col("w")
        taken, rest = weighed.agg(F.coalesce(F.sum(F.when(over, F.col("source_size") * cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        water = max(water, (total - taken) / rest) if rest else water
    return weighed.select("source", "source_size", F.least(F.col("source_size") * cap, F.lit(water) * F.col("w")).cast("double").alias("target"))


def rate(tilt: Column, size: Column, scale: Column, cap: int = CAP) -> Column:
    """exp(tilt * size / scale), cut at cap."""
    return F.when(tilt * size >= F.lit(math.log(cap)) * scale, F.lit(float(cap))).otherwise(F.exp(F.greatest(tilt * size / scale, F.lit(-700.0))))


def balanced(hist: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, tilt, scale) by Newton steps on the dual; each step is one aggregation over hist."""
    scales = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    state = goals.join(scales, goals["source"].eqNullSafe(scales["source"])).select(goals["source"], "target", F.greatest("mean", F.lit(1e-9)).alias("scale"), F.when(F.col("target") >= cap * F.col("source_size") * (1 - TOLERANCE), 2e3).otherwise(0.0).alias("tilt"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"))
    state = stage(state, "mix-state")  # a source that takes all it may has no inner solution
    sent = F.broadcast if state.count() <= SMALL else lambda df: df.hint("merge")
    for _ in range(STEPS):
        x = F.col("size") / F.col("scale")
        r = rate(F.col("tilt"), F.col("size"), F.col("scale"), cap)
        sums = (
            hist.join(sent(state.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source")
            .agg(F.sum(F.col("n") * r * F.col("size")).alias("got"), F.sum(F.when(r < cap, F.col("n") * r * x * F.col("size")).otherwise(0.0)).alias("slope"))
            .withColumnRenamed("source", "s")
        )
        lo = F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(F.col("got") > F.col("target"), F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") + F.try_divide(F.col("target") - F.col("got"), F.col("slope"))
        done = F.abs(F.col("got") - F.col("target")) <= TOLERANCE * F.greatest("target", F.lit(1.0))
        # outside the bracket, double the distance from 0 while a side is unknown, then halve the bracket
        middle = F.when(F.col("hi") >= 1e4, 2 * F.greatest("lo", F.lit(0.5))).when(F.col("lo") <= -1e4, 2 * F.least("hi", F.lit(-0.5))).otherwise((F.col("lo") + F.col("hi")) / 2)
        after = (
            state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumns({"lo": lo, "hi": hi, "done": F.coalesce(done, F.lit(True)) | (F.col("hi") - F.col("lo") <= 1e-12 * F.abs("tilt"))})
            .withColumn("next", F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise(middle))
            .select("source", "target", "scale", F.when(F.col("done"), F.col("tilt")).otherwise(F.greatest(F.least("next", F.lit(2e3)), F.lit(-2e3))).alias("tilt"), "lo", "hi", "done")
        )
        state = stage(after, "mix-state")
        if state.where("not done and abs(tilt) < 2e3").isEmpty():  # at 2e3 all but the shortest texts are at a bound
            return state.select("source", "tilt", "scale")
        state = state.drop("done")
    raise RuntimeError(f"the dual did not settle in {STEPS} steps")


def copies_by_size(hist: DataFrame, goals: DataFrame, tilts: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, size, n, many): copies of all documents of a source and size together."""
    both = goals.join(tilts.withColumnRenamed("source", "s"), goals["source"].eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "source_size", "target", "tilt", "scale")
    # sizes of a source meet in a window: as many as its texts have different numbers of words
    rows = hist.join(both, F.col("source").eqNullSafe(F.col("s"))).where("size > 0")
    longest = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    run = F.round(F.sum(F.col("n") * rate(F.col("tilt"), F.col("size"), F.col("scale"), cap)).over(longest), 6)
    rows = rows.withColumn("run", F.floor(run + 0.5)).withColumn("many", F.col("run") - F.coalesce(F.lag("run").over(Window.partitionBy("source").orderBy(F.desc("size"))), F.lit(0)))
    rows = rows.withColumn("many", F.greatest(F.lit(0), F.least(F.col("many"), F.col("n") * cap)))
    source = Window.partitionBy("source")
    short = source.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.floor(F.col("target") - F.sum(F.col("many") * F.col("size")).over(source) + 0.5)
    rows = rows.withColumn("gap", gap).withColumn("room", F.least(F.col("n"), F.when(F.col("gap") > 0, F.col("n") * cap - F.col("many")).otherwise(F.col("many"))))
    before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(short), F.lit(0))
    move = F.least(F.col("room"), F.floor(F.greatest(F.lit(0), F.abs("gap") - before) / F.col("size")))
    return rows.select("source", "size", "n", (F.col("many") + F.signum("gap").cast("long") * move).cast("long").alias("many"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, copies) of every row; key is a hash of its id, text and source."""
    sized = stage(docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col, source_col).alias("key"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size")), "mix-sizes")
    hist = stage(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist")
    goals = stage(targets(hist, cap=cap), "mix-goals")
    many = copies_by_size(hist, goals, balanced(hist, goals, cap), cap)
    shares = stage(
        hist.alias("h")
        .join(many.alias("m"), F.col("h.source").eqNullSafe(F.col("m.source")) & (F.col("h.size") == F.col("m.size")), "left")
        .join(goals.alias("g"), F.col("h.source").eqNullSafe(F.col("g.source")))
        .select(F.col("h.source").alias("s"), F.col("h.size").alias("z"), F.col("h.n").alias("n"), F.coalesce("many", F.lit(0)).alias("many"), "source_size", "target"),
        "mix-shares",
    )
    total = hist.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rank = ranked(sized, ["source", "size"], ["key", "doc_id"], total, "place")
    base = F.floor(F.col("many") / F.col("n"))
    # the counts grow with the data and are never broadcast, however small their file is
    return rank.join(shares.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).select(
        "doc_id", "key", "source", "size", "source_size", "target", (base + (F.col("place") < F.col("many") - base * F.col("n")).cast("int")).cast("int").alias("copies")
    )


def row_key(id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col))


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """Rows of docs as often as the mix takes them, all columns as they are."""
    own = mixed(docs, id_col, text_col, source_col, **how).groupBy(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key")).agg(F.sum("copies").alias("copies"), F.count("*").alias("many")).where("copies > 0")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), row_key(id_col, text_col, source_col).alias("key"))
    own = stage(own, "mix-own")
    met = rows.join(own, (F.col("key") == F.col("own_key")) & F.col("id").eqNullSafe(F.col("own_id")))
    one = met.where("many = 1").select("row", "copies")
    # rows equal in id, text and source share their copies by rank
    place = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.xxhash64("row"))) - 1
    more = met.where("many > 1").withColumn("place", place).select("row", F.expr("copies div many + if(place < copies % many, 1, 0)").alias("copies")).where("copies > 0")
    each = one if own.where("many > 1").isEmpty() else one.unionByName(more)
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op2_entropy_mix(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of all documents."""
    rows = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
