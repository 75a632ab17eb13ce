"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

The mix gives each document a rate r, the expected number of its copies.  Among all rates with
0 <= r <= `most` and, for each source, sum(r * size) equal to the source's target, entropy
balancing takes those nearest to 1 in relative entropy.  Their form is known, r = min(most,
exp(lambda * size / mean size)), and lambda, one for each source, is the root of a monotone
function: the gradient of the convex dual.  Newton steps, kept inside a bracket, find it; each
step is one aggregation over a (source, size, count) table that all documents were folded into
beforehand, so that a hot source costs no more than a small one.

Rates become copies by systematic rounding: within buckets of a source of some thousand documents,
ordered by size, a copy more is given wherever the running sum of fractions passes a whole number.
Each bucket starts its sum where its words come nearest to what its rates ask for.  Buckets and
order come from hashes of doc_id, so reruns agree.

Defined cases: a null text has size 0, and documents of size 0 have rate 1; a source may be null;
a source without words has target 0; equal rows may get different numbers of copies; if no
document has a word all targets are 0; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspend.llm.common import WORD, text_name, text_or_empty, unused, written

#: No document is repeated more often, and no target is above this many times its source.
MOST = 3
WEIGHTS = (1, 2, 3)
STEPS, CLOSE, BUCKET, STARTS = 60, 1e-9, 4096, 32


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", text_name().alias("name"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n, target: shares by weight, stopped at `most` times the source's size.

    Sharing the excess by weight until nothing is above its stop ends at one level L with
    target = min(stop, weight * L).  Sources in the order of stop / weight are stopped one after
    the other, so L follows from running sums.  The windows run in one task, over a row a source.
    """
    by_name, by_stop = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn))
    sources = sources.withColumn("stop", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("stop") / F.col("weight"))
    everything = Window.partitionBy()
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the level if exactly the sources before this one were stopped; the first that is not stopped at it decides
    sources = sources.withColumn("level", level).withColumn("free", F.col("ratio") > F.col("level"))
    final = F.min(F.when(F.col("free"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.when(F.col("ratio") <= F.coalesce(final, F.lit(float("inf"))), F.col("stop").cast("double")).otherwise(F.col("weight") * final)
    return sources.select("source", "source_size", "n", target.alias("target"))


def solved(histogram: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """lambda and mean size of each source; lambda is null where every rate is `most`."""
    means = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("c")) / F.sum("c")).alias("mean"))
    goals = goals.join(means, goals.source.eqNullSafe(means.source)).select(goals.source, "source_size", "target", "mean")
    free = (F.col("target") < most * F.col("source_size")) & (F.col("target") > 0)
    state = goals.where(free).select(
        "source", "mean", "target", F.log(F.col("target") / F.col("source_size")).alias("l"), F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("off")
    )
    state = written(state, "dual")
    x = F.col("size") / F.col("mean")
    raw = F.exp(F.least(F.col("l") * x, F.lit(50.0)))
    mass = F.col("c") * F.col("size")
    for _ in range(STEPS):
        worst = state.agg(F.max(F.abs(F.col("off")) / F.col("target")), F.count("*"), F.count("off")).first()
        if not worst[1] or worst[1] == worst[2] and worst[0] < CLOSE:
            break
        s = state.withColumnRenamed("source", "of")
        rows = histogram.join(s, F.col("source").eqNullSafe(F.col("of")))
        totals = rows.groupBy("of", "mean", "target", "l", "lo", "hi").agg(
            (F.sum(mass * F.least(raw, F.lit(float(most)))) - F.first("target")).alias("off"),
            F.sum(F.when(raw < most, mass * x * raw).otherwise(0.0)).alias("slope"),
        )
        at = F.col("l")
        lo, hi = F.when(F.col("off") < 0, at).otherwise(F.col("lo")), F.when(F.col("off") > 0, at).otherwise(F.col("hi"))
        totals = totals.withColumns({"lo": lo, "hi": hi})
        reach = F.greatest(F.lit(1.0), F.abs(at))  # a step at most doubles where a side of the bracket is open
        newton = at - F.col("off") / F.when(F.col("slope") > 0, F.col("slope"))
        low, high = F.coalesce("lo", at - reach), F.coalesce("hi", at + reach)
        inside = F.when((newton > low) & (newton < high), newton)
        middle = F.when(F.col("off") < 0, F.when(F.col("hi").isNull(), high)).otherwise(F.when(F.col("lo").isNull(), low))
        step = F.coalesce(inside, middle, (low + high) / 2)
        done = F.abs(F.col("off")) < CLOSE * F.col("target")
        state = written(totals.select(F.col("of").alias("source"), "mean", "target", F.when(done, at).otherwise(step).alias("l"), "lo", "hi", "off"), "dual")
    # sums of doubles depend on the order of rows in their last bits: rounded, so that reruns agree
    s = state.select(F.col("source").alias("of"), F.round("l", 9).alias("lambda"))
    return goals.join(s, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "mean", "lambda")


def _planned(docs: DataFrame, weights, most: int) -> DataFrame:
    """The plan with the source and the name of the text of each row."""
    sizes = written(sized(docs), "sizes")
    goals = written(targets(sizes, weights, most), "targets")
    histogram = written(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("c")), "histogram")
    dual = solved(histogram, goals, most).withColumnRenamed("source", "of")
    known = goals.join(dual, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    known = written(known, "rates").withColumnRenamed("source", "of")
    rows = sizes.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    tilted = F.least(F.exp(F.least(F.col("lambda") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(most)))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") == 0, 0.0).otherwise(F.coalesce(tilted, F.lit(float(most))))
    rows = rows.withColumn("rate", rate)
    lost = F.when(F.col("doc_id").isNull(), F.col("name"))  # spreads rows without an id; a null leaves the hash as it is
    bucket = F.pmod(F.xxhash64("doc_id", lost, F.lit("bucket")), F.ceil(F.col("n") / BUCKET))
    rows = rows.withColumn("bucket", bucket).withColumn("part", F.col("rate") - F.floor("rate"))
    mine = Window.partitionBy("source", "bucket").orderBy("size", F.xxhash64("doc_id", lost, F.lit("order")), "doc_id", "name")
    rows = rows.withColumn("sum", F.sum("part").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.coalesce(F.lag("sum").over(mine), F.lit(0.0)))
    names = ["doc_id", "source", "name", "bucket", "size", "source_size", "target", "rate", "part", "sum", "before"]
    rows = written(rows.select(*names), "rounding")
    # of STARTS evenly spaced starts, each bucket takes the one whose words come nearest to its share
    extra = lambda start: F.floor(F.col("sum") + start) - F.floor(F.col("before") + start)
    starts = [(k + 0.5) / STARTS for k in range(STARTS)]
    miss = [F.round(F.abs(F.sum(F.col("size") * (extra(F.lit(u)) - F.col("part")))), 3) for u in starts]
    choice = F.array_min(F.array(*(F.struct(m.alias("miss"), F.lit(u).alias("start")) for m, u in zip(miss, starts))))
    chosen = rows.groupBy(F.col("source").alias("of"), F.col("bucket").alias("b")).agg(choice["start"].alias("start"))
    rows = rows.join(chosen, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("b")))
    copies = F.least((F.floor("rate") + extra(F.col("start"))).cast("long"), F.lit(most).cast("long"))
    rows = rows.withColumn("copies", copies)
    return rows.select("doc_id", "source", "name", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate, copies for every row of docs."""
    return _planned(docs, weights, most).drop("source", "name")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """docs with each row as often as the mix takes it; all columns stay.

    Rows go by doc_id, source and text; each of several rows that are equal in these has the
    copies of one row of the plan.
    """
    i, src, name, copies, text, turn, mine, copy = unused(docs, "id", "of_source", "name", "copies", "text_name", "turn", "mine", "copy")
    planned = _planned(docs, weights, most).groupBy(F.col("doc_id").alias(i), F.col("source").alias(src), F.col("name").alias(name))
    plans = written(planned.agg(F.sort_array(F.collect_list("copies")).alias(copies)), "copies")
    named = docs.select(*docs.columns, text_name().alias(text))
    same = named.doc_id.eqNullSafe(F.col(i)) & named.source.eqNullSafe(F.col(src)) & (F.col(text) == F.col(name))
    joined = named.join(plans.where(F.array_max(copies) > 0), same)
    of = F.col(copies)[0]
    if not plans.where(F.size(copies) > 1).isEmpty():
        once, more = joined.where(F.size(copies) == 1), joined.where(F.size(copies) > 1)
        nth = F.row_number().over(Window.partitionBy(i, src, text).orderBy(F.lit(1)))
        joined = once.withColumn(turn, F.lit(1)).unionByName(more.withColumn(turn, nth))
        of = F.element_at(copies, F.col(turn))
    joined = joined.withColumn(mine, of).where(F.col(mine) > 0)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(mine))).alias(copy)).drop(copy)
