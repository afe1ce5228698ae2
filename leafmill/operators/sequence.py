"""Logic along an order: as-of, carry-forward, gap clusters, slices, range assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _line(by: list[str], order: list[str | Column]):
    return Window.partitionBy(*by).orderBy(*order)


def before(value: Column, by: list[str], order: list, inclusive: bool = False) -> Column:
    """The last non-null value before this row (or up to it)."""
    return F.last(value, ignorenulls=True).over(_line(by, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))


def after(value: Column, by: list[str], order: list) -> Column:
    """The first non-null value after this row: the last one before it in the opposite order, whose frame only grows."""
    backwards = [(F.col(o) if isinstance(o, str) else o).desc() for o in order]
    return F.last(value, ignorenulls=True).over(_line(by, backwards).rowsBetween(Window.unboundedPreceding, -1))


def run_id(starts: Column, by: list[str], order: list) -> Column:
    """Running count of the rows at which a new group starts."""
    return F.sum(F.when(starts, 1).otherwise(0)).over(_line(by, order).rowsBetween(Window.unboundedPreceding, 0))


def gap_clusters(df: DataFrame, by: list[str], position: str, gap: float, name: str = "cluster") -> DataFrame:
    """Numbers groups of positions in which neighbours are at most ``gap`` apart."""
    far = F.col(position) - F.lag(position).over(_line(by, [position])) > gap
    return df.withColumn(name, run_id(F.coalesce(far, F.lit(False)), by, [position]))


def running_rows(df: DataFrame, page: str, centre: str, within: float, mean: bool) -> DataFrame:
    """Numbers rows of a page's words in order of their centres: a word joins while it is within ``within`` of the running mean
    of the row (or of its first word).  One fold over the page's ordered words keeps the open row and where rows start; a word's row is the number of
    starts up to it."""
    others = [c for c in df.columns if c not in (page, centre)]
    words = df.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(centre, *others))).alias("__words"))
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(state: Column, word: Column) -> Column:
        at = word[centre].cast("double")
        new = (state["n"] == 0) | (F.abs(at - state["total"] / state["n"]) >= within)
        total, n = (state["total"] + at, state["n"] + 1) if mean else (state["total"], state["n"])
        starts = F.when(new, F.concat(state["starts"], F.array(state["i"]))).otherwise(state["starts"])
        return F.struct(starts.alias("starts"), F.when(new, at).otherwise(total).alias("total"), F.when(new, F.lit(1)).otherwise(n).alias("n"), (state["i"] + 1).alias("i"))

    starts = F.aggregate("__words", start, step, lambda s: s["starts"])
    # each row's number as often as it has words
    ends = lambda i: F.coalesce(F.get("__starts", i + 1), F.size("__words"))
    numbers = F.flatten(F.transform("__starts", lambda s, i: F.array_repeat(i, ends(i) - s)))
    placed = words.withColumn("__starts", starts).select(page, F.explode(F.arrays_zip(F.col("__words").alias("w"), numbers.alias("row"))).alias("__x"))
    return placed.select(*(F.col(page) if c == page else F.col("__x.w")[c].alias(c) for c in df.columns), F.col("__x.row").alias("row"))


def islands(df: DataFrame, by: list[str], position: str) -> DataFrame:
    """Maximal runs of consecutive integers: (by, start, end, length)."""
    anchor = F.col(position) - F.row_number().over(_line(by, [position]))
    runs = df.select(*by, position).distinct().withColumn("__anchor", anchor)
    return runs.groupBy(*by, "__anchor").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count(F.lit(1)).alias("length")).drop("__anchor")


def ranges(starts: DataFrame, start: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``end``: one before the next start, null for the last."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(start) if by else Window.orderBy(start)
    return starts.withColumn("end", F.lead(start).over(w) - 1)


def placed(df: DataFrame, order: list[str], keep, name: str = "id") -> DataFrame:
    """df with each row's place, from 1, in an order of columns of any kind: sorted runs of ranges of the order are written with the rows' numbers in
    their run, and runs start where those before them end, so no task sorts all rows.  ``keep(df, name)`` writes a table and reads it again."""
    runs = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "runs")
    run, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    # a row a partition
    sizes = sorted((r["run"], r["n"]) for r in runs.groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = [(r, sum(n for _, n in sizes[:i])) for i, (r, _) in enumerate(sizes)]
    first = df.sparkSession.createDataFrame(before, "__run bigint, __first bigint")
    return runs.join(F.broadcast(first), run == F.col("__run")).select(*df.columns, (F.col("__first") + within + 1).alias(name))


#: Intervals that may be sent to every task; stretches that many intervals are cut into.
FEW_INTERVALS = 10_000
STRETCHES = 256


def assign(rows: DataFrame, at: str, intervals: DataFrame, start: str, payload: list[str], by: list[str] | None = None) -> DataFrame:
    """Each row with the payload of the greatest start not above it (null before the first).

    Few intervals without a key are broadcast and met by range.  Else the union of both sides is carried forward in one sort
    for each key; without a key, for each stretch between quantiles of the starts, with the last interval of the stretches before
    it as what a stretch begins with.  So no range join is made and no task holds all rows."""
    by = by or []
    marks = intervals.select(*by, F.col(start).alias("__at"), F.struct(*payload).alias("__payload"))
    columns = [*rows.columns, *(F.col("__payload")[p].alias(p) for p in payload)]
    if by:
        return _carried(rows.withColumn("__at", F.col(at)), marks, by).select(*columns)
    if marks.limit(FEW_INTERVALS + 1).count() <= FEW_INTERVALS:
        spans = marks.withColumn("__next", F.lead("__at").over(Window.orderBy("__at")))
        inside = (F.col(at) >= F.col("__at")) & (F.col("__next").isNull() | (F.col(at) < F.col("__next")))
        return rows.join(F.broadcast(spans), inside, "left").select(*columns)
    edges = sorted(set(marks.select(F.percentile_approx("__at", [i / STRETCHES for i in range(1, STRETCHES)])).first()[0]))
    stretch = lambda x: F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x))
    ends = marks.groupBy(stretch(F.col("__at")).alias("__stretch")).agg(F.max_by("__payload", "__at").alias("__last"))
    # one row a stretch: the last interval of those before it
    grid = rows.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("__stretch")).join(ends, "__stretch", "left")
    first = grid.withColumn("__first", F.last("__last", ignorenulls=True).over(Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))).drop("__last")
    placed = rows.withColumn("__at", F.col(at)).withColumn("__stretch", F.coalesce(stretch(F.col(at)), F.lit(0)))
    found = _carried(placed, marks.withColumn("__stretch", stretch(F.col("__at"))), ["__stretch"]).join(F.broadcast(first), "__stretch", "left")
    known = F.coalesce("__payload", F.when(F.col("__at").isNotNull(), F.col("__first")))
    return found.withColumn("__payload", known).select(*columns)


def _carried(rows: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
    """rows with the __payload of the last mark up to their __at."""
    both = rows.withColumn("__kind", F.lit(1)).unionByName(marks.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__payload", F.last("__payload", ignorenulls=True).over(w)).where(F.col("__kind") == 1)


def spread_cuts(df: DataFrame, by: list[str], order: list, cut: str) -> DataFrame:
    """Cuts of a group made strictly increasing: one that falls on or before its predecessor moves one behind it."""
    i = F.row_number().over(_line(by, order))
    lead = F.max(F.col(cut) - F.col("__i")).over(_line(by, ["__i"]).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__i", i).withColumn(cut, (F.col("__i") + lead).cast(df.schema[cut].dataType)).drop("__i")


def ordered_text(df: DataFrame, by: list[str], order: str, text: str, joiner: str, name: str = "text") -> DataFrame:
    """Joined text of each group in order."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(pieces, lambda x: x["t"]), joiner).alias(name), F.count(F.lit(1)).alias("n_pieces"))


def infer_labels(pages: DataFrame, anchors: DataFrame, section: str = "section", page: str = "page", number: str = "number", window: int = 8, reach: int = 3) -> DataFrame:
    """Printed numbers of pages from anchors whose offset (number - page) others within ``window`` pages support.

    Sections with at most three anchors keep all.  A page takes its own anchor; between anchors of equal offset it
    is interpolated, of different offset it has none; outside it is extrapolated if the section has one offset or the
    anchor is within ``reach`` pages.  Numbers below 1 are none.  Adds ``inferred``."""
    a = anchors.select(section, page, number).distinct().withColumn("offset", F.col(number) - F.col(page))
    same = Window.partitionBy(section, "offset").orderBy(page)
    a = a.withColumn("back", F.col(page) - F.lag(page).over(same)).withColumn("fore", F.lead(page).over(same) - F.col(page))
    a = a.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(section)))
    kept = a.where((F.col("n") <= 3) | (F.least(F.coalesce("back", F.lit(1 << 30)), F.coalesce("fore", F.lit(1 << 30))) <= window))
    kept = first_anchor(kept, section, page, number)
    spread = kept.groupBy(section).agg(F.count_distinct("offset").alias("offsets"))
    both = pages.join(kept.select(section, page, number, "offset"), [section, page], "left").join(spread, section, "left")
    anchor = F.when(F.col(number).isNotNull(), F.struct(F.col(page).alias("p"), F.col("offset").alias("o")))
    both = both.withColumn("__b", before(anchor, [section], [page])).withColumn("__a", after(anchor, [section], [page]))
    one = F.coalesce("__b", "__a")
    near = F.abs(one["p"] - F.col(page)) <= reach
    n = (
        F.when(F.col(number).isNotNull(), F.col(number))
        .when(F.col("__b").isNotNull() & F.col("__a").isNotNull(), F.when(F.col("__b")["o"] == F.col("__a")["o"], F.col(page) + F.col("__b")["o"]))
        .when(one.isNotNull() & ((F.col("offsets") == 1) | near), F.col(page) + one["o"])
    )
    return both.withColumn("inferred", F.when(n >= 1, n)).select(*pages.columns, "inferred")


def first_anchor(kept: DataFrame, section: str, page: str, number: str) -> DataFrame:
    """One anchor a page: the smallest number."""
    w = Window.partitionBy(section, page).orderBy(number)
    return kept.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
