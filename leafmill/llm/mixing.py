"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources share SHARE of all words by weight; a source's target stops at CEILING times its
words and the excess is shared again.  That is one water level, found by a window over the sources in
the order in which they fill up.  Within a source every document has target / size expected
copies: the whole part is certain, the rest is an inclusion probability p.  Documents are ranked by
their random odds (u / (1 - u), u a hash of the id and the text) divided by the inclusion odds
p / (1 - p), and the first ones are taken until the source's words are reached.  With ``importance``
a document's copies are in proportion to it, none above CEILING, and what a full document can't take goes to the others of its source.

No source is sorted in one task: ranks are cut into BINS by value, small sums by (source, bin) find
the bin in which the target is met, and only that bin is ranked row by row.  What a document that
doesn't fit leaves open is filled in further passes from the rest of the order, until nothing that is left fits: a source
misses its target by less than the smallest document left.

Cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, the last;
repeated rows are separate documents that rank alike but for a row number; a source without words has
target 0; ties of rank go by id and row number; an importance that is null or negative is 0 and such rows are never taken; very
long texts are counted whole, and one longer than what its source has open is passed over; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CEILING = 1.5, 2.0
BINS = 4096
SEED = 4


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """sizes: (source, source_size), one row a source.  Adds target."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    full = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level that would hold if exactly the sources before this one were full
    level = (share * F.sum("source_size").over(every) - ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(full.rowsBetween(0, Window.unboundedFollowing))
    return (
        sizes.withColumn("w", weight)
        .withColumn("level", level)
        .withColumn("fits", F.col("level") * F.col("w") <= ceiling * F.col("source_size"))
        .withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("w"), F.col("level")))).over(every)["level"])
        .select("source", "source_size", F.least(F.coalesce(F.col("final") * F.col("w"), ceiling * F.col("source_size")), ceiling * F.col("source_size")).cast("double").alias("target"))
    )


def _reshared(sized: DataFrame, goal: DataFrame, scratch: Scratch) -> DataFrame:
    """goal with the rate at which copies, none above CEILING, sum to a source's target: what a document can't take is shared
    among the others by importance.

    Documents fill up in descending importance; one is full if the rate that holds beside it and all before it fills it.  Sums by
    (source, bin of importance) tell the bin in which that ends, and only that bin's distinct importances are looked at one by one."""
    some = sized.where(F.col("importance") > 0)
    lo, hi = some.agg(F.min("importance"), F.max("importance")).first()
    if lo is None:
        return goal
    bin_ = F.floor((F.col("importance") - lo) / (hi - lo) * BINS).cast("int") if hi > lo else F.lit(0)
    same = F.col("source").eqNullSafe(F.col("s"))
    told = goal.withColumnRenamed("source", "s").select("s", "target", "mass")

    def last_full(sums: DataFrame, *order: Column) -> DataFrame:
        """sums (source, words, of_mass, least, target, mass, words0, mass0) with the sums before each row and whether it is full."""
        upto = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        both = sums.withColumns({"all_words": F.col("words0") + F.sum("words").over(upto), "all_mass": F.col("mass0") + F.sum("of_mass").over(upto)})
        left, open_ = F.col("target") - CEILING * F.col("all_words"), F.col("mass") - F.col("all_mass")
        full = F.when(open_ <= F.col("mass") * 1e-12, left >= -1e-9 * F.col("target")).otherwise(left * F.col("least") >= CEILING * (1 - 1e-12) * open_)
        # what comes after the first that isn't full isn't either
        return both.withColumn("full", F.min(full).over(upto))

    binned = some.groupBy("source", bin_.alias("bin")).agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("importance")).alias("of_mass"), F.min("importance").alias("least"))
    binned = binned.join(told, same).drop("s").withColumns({"words0": F.lit(0), "mass0": F.lit(0.0)})
    bins = scratch.keep(last_full(binned, F.desc("bin")), "bins")
    edge = bins.where("NOT full").groupBy("source").agg(F.max("bin").alias("edge"))
    before = bins.where("full").groupBy(F.col("source").alias("s")).agg(F.max("all_words").alias("words0"), F.max("all_mass").alias("mass0"), F.min("least").alias("least0"))
    at = edge.join(before, same, "left").select("source", "edge", F.coalesce("words0", F.lit(0)).alias("words0"), F.coalesce("mass0", F.lit(0.0)).alias("mass0"))
    at = at.join(told, same).drop("s").withColumnRenamed("source", "s")
    each = some.withColumn("bin", bin_).join(at, same & (F.col("bin") == F.col("edge"))).groupBy("source", F.col("importance").alias("least"))
    each = each.agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("importance")).alias("of_mass"), *(F.first(c).alias(c) for c in ("words0", "mass0", "target", "mass")))
    ends = last_full(each, F.desc("least")).groupBy("source").agg(F.max(F.when(F.col("full"), F.struct("all_words", "all_mass"))).alias("e"), F.first("words0").alias("words0"), F.first("mass0").alias("mass0"))
    ends = ends.select(F.col("source").alias("s"), F.coalesce("e.all_words", "words0").alias("full_words"), F.coalesce("e.all_mass", "mass0").alias("full_mass"))
    # where all are full the rate is what fills the least important of them
    whole = before.join(edge, F.col("s").eqNullSafe(F.col("source")), "left_anti").select(F.col("s").alias("s2"), "least0")
    rated = goal.join(ends, same, "left").drop("s").join(whole, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    rest = F.col("mass") - F.col("full_mass")
    rate = F.when(F.col("least0").isNotNull(), CEILING / F.col("least0")).when(rest > 0, (F.col("target") - CEILING * F.col("full_words")) / rest).otherwise(F.col("rate"))
    return scratch.keep(rated.withColumn("rate", rate).drop("full_words", "full_mass", "least0"), "rated")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", importance: Column | str | None = None, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """(row, doc_id, source, digest, size, source_size, target, copies) for each row of docs; row numbers them, digest is a hash of the text."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.md5(F.coalesce(F.col(text), F.lit("")))), 11).cast("double") + 0.5) / float(1 << 53)
    weight = F.greatest(F.coalesce((F.col(importance) if isinstance(importance, str) else importance).cast("double"), F.lit(0.0)), F.lit(0.0)) if importance is not None else F.lit(1.0)
    sized = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("digest"), words(F.col(text)).alias("size"), uniform.alias("u"), weight.alias("importance")
    )
    sized = scratch.keep(sized, "sized")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("importance")).alias("mass"))
    goal = targets(by_source.select("source", "source_size")).join(by_source.select(F.col("source").alias("s"), "mass"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # the rate is the number of copies for an importance of 1
    goal = scratch.keep(goal.withColumn("rate", F.when(F.col("mass") > 0, F.col("target") / F.col("mass")).otherwise(0.0)), "goal")
    if importance is not None:
        goal = _reshared(sized, goal, scratch)

    spread = (
        sized.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("ratio", F.least(F.col("rate") * F.col("importance"), F.lit(CEILING)))
        .withColumn("whole", F.floor(F.col("ratio") + 1e-9))
        .withColumn("p", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
    )
    # q / (1 + q) for q = (u / (1 - u)) / (p / (1 - p)): in (0, 1) and in the order of q
    up = F.col("u") * (1 - F.col("p"))
    place = F.when(F.col("p") > 0, up / (up + (1 - F.col("u")) * F.col("p")))
    spread = scratch.keep(spread.withColumn("place", place).select("row", "doc_id", "source", "digest", "size", "source_size", "target", "whole", "place", F.floor(place * BINS).cast("int").alias("bin")), "spread")
    scratch.drop("sized")

    need = spread.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("need"))
    open_, taken = spread.where(F.col("place").isNotNull() & (F.col("size") > 0)).select("row", "doc_id", "source", "size", "place", "bin"), None
    i = 0
    while True:
        need = need.where(F.col("need") >= 1)
        bins = open_.groupBy("source", "bin").agg(F.sum("size").alias("words"))
        bins = bins.join(need.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        upto = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("before", F.sum("words").over(upto) - F.col("words")).where(F.col("before") < F.col("need"))
        bins = bins.withColumn("all", F.col("before") + F.col("words") <= F.col("need"))
        bins = bins.select(F.col("source").alias("s"), F.col("bin").alias("b"), "need", "before", "all")
        near = open_.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b")
        whole = near.where("all").select("row", "source", "size")
        edge = near.where("not all").withColumn("sum", F.col("before") + F.sum("size").over(Window.partitionBy("source", "bin").orderBy("place", "doc_id", "row")))
        fits = edge.where(F.col("sum") <= F.col("need")).select("row", "source", "size")
        got = scratch.keep(whole.unionByName(fits), f"got{i}")
        taken = got if taken is None else taken.unionByName(got)
        sums = got.groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("got"))
        need = scratch.keep(need.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").select("source", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need")), f"need{i}")
        left = need.where(F.col("need") >= 1).select(F.col("source").alias("s"), F.col("need").alias("room"))
        open_ = scratch.keep(open_.join(got.select("row"), "row", "left_anti").join(left, F.col("source").eqNullSafe(F.col("s"))).where(F.col("size") <= F.col("room")).drop("s", "room"), f"open{i}")
        # the first of what is left fits, so each pass takes something from each source that is open
        if open_.isEmpty():
            break
        i += 1
    copies = spread.join(taken.select("row", F.lit(1).alias("one")), "row", "left")
    return copies.select("row", "doc_id", "source", "digest", "size", "source_size", "target", (F.col("whole") + F.coalesce("one", F.lit(0))).cast("bigint").alias("copies"))


def repeated(docs: DataFrame, mixed: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Each row of docs as often as the mix takes it; texts without words are left out.  Rows equal in id, source and text share
    their copies: each gets the whole part of the mean, and the first ones (by a hash of the row) one more."""
    names = (
        mixed.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("digest").alias("__digest"))
        .agg(F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(0)).alias("__copies"), F.count(F.lit(1)).alias("__rows"))
        .where(F.col("__copies") > 0)
    )
    same = F.col(key).eqNullSafe(F.col("__id")) & F.col(source).eqNullSafe(F.col("__source")) & (F.xxhash64(text) == F.col("__digest"))
    alone = docs.join(names.where(F.col("__rows") == 1), same)
    place = F.row_number().over(Window.partitionBy("__id", "__source", "__digest").orderBy(F.xxhash64(*docs.columns)))
    several = docs.join(names.where(F.col("__rows") > 1), same).withColumn("__place", place)
    several = several.withColumn("__copies", F.expr("__copies div __rows + int(__place <= __copies % __rows)")).drop("__place")
    taken = alone.unionByName(several).where(F.col("__copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return taken.select(*docs.columns)
