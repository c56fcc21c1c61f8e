"""Mixing sources to target weights by capped water-filling (DataFrame operations only).

Sources are ranked by code point (null last) and weigh 5, 2, 1, repeating. Their targets share all
words by weight, no target exceeding ``max_epochs`` times its source: the excess goes to the others
by weight. With t_i = min(cap_i, level * w_i), the level follows from prefix sums over sources in
order of cap_i / w_i, which equals clamping and resharing until nothing is above.

A document of a source with rate r = target / size is taken floor(r) times; a seeded sample of the
source is taken once more. The sample is cut where its words reach the fractional rest: documents
above 1 % of their source (at most 100) are settled first, in the order of a seeded hash. One is taken
if it fits into the large documents' proportional share of the rest, or if the rest can't be reached
without it by all that come after it and is missed by less with it than without. The others follow in
the order of the hash until the rest is full.
The hash is cut into buckets whose sums locate the edge, so only the edge bucket (one of 2 **
``BUCKET_BITS``) is sorted and no source is ever gathered in one task. The realised words miss the target
by at most half a document: one of at most 1 % of its source where the small ones can fill the rest.

Nulls: a null text has 0 words; null is a source of its own; null ids hash as one value. Equal
(source, id, size) rows get equal repetitions. Empty input gives an empty result. Other columns
are carried along whatever their names; ``mix`` replaces an input column named like a result column,
``repeated`` returns the input's columns untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

WEIGHTS = (5, 2, 1)
#: Salts spread the join with the few source rows when the planner can't broadcast them.
SALTS = 32
BUCKET_BITS = 16


def _hash(doc_id: Column, seed: int) -> Column:
    """32 bits of md5; the same in any SQL engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """One row per source: source, source_size, target. The windows run over sources, not documents."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = per.select("*", ((F.row_number().over(by_name) - 1) % len(weights)).alias("_turn"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    capped = ranked.select(
        "source", "source_size", table[F.col("_turn")].alias("_w"), (F.col("source_size") * float(max_epochs)).alias("_cap")
    ).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    levels = capped.withColumn("_level", level)
    # the first feasible level is the highest one
    best = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)
    return levels.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(best, F.lit(0.0)) * F.col("_w")).alias("target"))


def _joined(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (with _h) and the source rows; a hot source is spread over salts."""
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "_psource")
    left = docs.withColumn("_salt", (F.col("_h") % SALTS).cast("int"))
    return left.join(salted, left["source"].eqNullSafe(salted["_psource"]) & (left["_salt"] == salted["_salt"])).drop(salted["_salt"]).drop("_psource", "_salt")


def plan_mix(sized: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (doc_id, source, size): the plan per source, the documents at its edges that are taken once more, the sizes."""
    docs = written(sized.select("doc_id", "source", "size").withColumn("_h", _hash(F.col("doc_id"), seed)), "mix-sizes")
    targets = written(
        source_targets(docs, weights, max_epochs)
        .withColumn("_reps", F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0))
        .withColumn("_quota", F.greatest(F.lit(0.0), F.col("target") - F.col("_reps") * F.col("source_size"))),
        "mix-targets",
    )
    rows = _joined(docs, targets)
    large = rows.where(F.col("size") * 100 > F.col("source_size"))
    # at most 100 rows of a source can be that large: a fold settles them in hash order
    grouped = large.groupBy("source", "doc_id", "size", "_h", "source_size", "_quota").agg(F.sum("size").alias("_sum"))
    listed = grouped.groupBy("source", "source_size", "_quota").agg(
        F.sort_array(F.collect_list(F.struct("_h", "doc_id", "size", "_sum"))).alias("_list"), F.sum("_sum").alias("_all")
    )
    most = F.col("_quota") * F.col("_all") / F.col("source_size")
    kind = "struct<used:bigint,left:bigint,took:array<struct<_h:bigint,doc_id:bigint,size:bigint,_sum:bigint>>>"
    none = F.struct(F.lit(0).cast("long").alias("used"), F.col("source_size").alias("left"), F.array().alias("took")).cast(kind)

    def settle(acc: Column, x: Column) -> Column:
        used, left = acc["used"] + x["_sum"], acc["left"] - x["_sum"]  # with x; all that comes after x
        short = F.col("_quota") - (acc["used"] + left)
        take = (used <= most) | (short > 0) & (used - F.col("_quota") < short)
        return F.struct(
            F.when(take, used).otherwise(acc["used"]).alias("used"), left.alias("left"), F.when(take, F.concat(acc["took"], F.array(x))).otherwise(acc["took"]).alias("took")
        ).cast(kind)

    listed = listed.withColumn("_took", F.aggregate("_list", none, settle)["took"])
    first = listed.select("source", F.explode("_took").alias("_d")).select("source", "_d.*")
    first = written(first.select("source", "doc_id", "size", "_sum"), "mix-large")
    used = first.groupBy("source").agg(F.sum("_sum").alias("_used")).withColumnRenamed("source", "_usource")
    left = (
        targets.join(used, targets["source"].eqNullSafe(used["_usource"]), "left")
        .withColumn("_rest", F.col("_quota") - F.coalesce("_used", F.lit(0)))
        .select("source", "source_size", "target", "_reps", "_rest")
    )
    small = rows.where(F.col("size") * 100 <= F.col("source_size")).drop("_quota", "target", "_reps", "source_size")
    sums = small.groupBy("source", F.shiftright("_h", 32 - BUCKET_BITS).alias("_b")).agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.withColumn("_cum", F.sum("_sum").over(upto)).withColumnRenamed("source", "_bsource")
    edges = (
        left.join(running, left["source"].eqNullSafe(running["_bsource"]) & (running["_cum"] > left["_rest"]), "left")
        .groupBy("source", "source_size", "target", "_reps", "_rest")
        .agg(F.min(F.struct("_b", (F.col("_cum") - F.col("_sum")).alias("_below"))).alias("_edge"))
    )
    plan = written(
        edges.select(
            "source", "source_size", "target", "_reps",
            F.coalesce(F.col("_edge._b"), F.lit(1 << BUCKET_BITS)).cast("long").alias("_b0"),
            (F.col("_rest") - F.coalesce(F.col("_edge._below"), F.lit(0))).alias("_over"),
        ),
        "mix-plan",
    )
    at_edge = _joined(small, plan.select("source", "_b0", "_over")).where(F.shiftright("_h", 32 - BUCKET_BITS) == F.col("_b0"))
    last = at_edge.groupBy("source", "doc_id", "size", "_h", "_over").agg(F.sum("size").alias("_sum"))
    one_by_one = Window.partitionBy("source").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("_run", F.sum("_sum").over(one_by_one) - F.col("_sum") / 2).where(F.col("_run") <= F.col("_over"))
    more = written(first.drop("_sum").unionByName(last.select("source", "doc_id", "size")), "mix-edge")
    return plan, more, docs


def apply_mix(docs: DataFrame, plan: DataFrame, more: DataFrame, seed: int = 7) -> DataFrame:
    """docs (with ``size``) plus source_size, target and reps; texts are not shuffled while plan and edge rows stay small."""
    rows = _joined(docs.withColumn("_h", _hash(F.col("doc_id"), seed)), plan)
    extra = more.select(F.col("doc_id").alias("_eid"), F.col("source").alias("_esource"), F.col("size").alias("_esize"), F.lit(1).alias("_more"))
    hit = rows.join(
        extra, rows["doc_id"].eqNullSafe(extra["_eid"]) & rows["source"].eqNullSafe(extra["_esource"]) & (rows["size"] == extra["_esize"]), "left"
    )
    inside = (F.col("size") * 100 <= F.col("source_size")) & (F.shiftright("_h", 32 - BUCKET_BITS) < F.col("_b0"))
    once_more = F.when(inside | F.col("_more").isNotNull(), 1).otherwise(0)
    reps = F.when(F.col("size") > 0, F.col("_reps") + once_more).otherwise(0).cast("int")
    return hit.withColumn("reps", reps).drop("_h", "_reps", "_b0", "_over", "_eid", "_esource", "_esize", "_more")


RESULTS = ("size", "source_size", "target", "reps")


def _mixed(docs: DataFrame, seed: int, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """row (the document's own columns) and the results."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    plan, more, _ = plan_mix(packed, seed, weights, max_epochs)
    return apply_mix(packed, plan, more, seed)


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """The documents with size, source_size, target and reps (how often the mix takes each)."""
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in RESULTS]
    return _mixed(docs, seed, weights, max_epochs).select(*own, *RESULTS)


def repeated(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """The documents, with their own columns only, each as often as the mix takes it."""
    taken = _mixed(docs, seed, weights, max_epochs).where("reps > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("reps"))))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
