"""Predicates, similarities and geometry of the lookups, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NM_PER_KGM, NM_PER_LBFT = 9.80665, 1.35582


def like_any(column: Column, terms: list[str]) -> Column:
    """Whether any non-empty term is in the column, whatever the case; null is no."""
    low = F.lower(column)
    found = F.lit(False)
    for term in filter(None, terms):
        found = found | low.contains(term.lower())
    return F.coalesce(found, F.lit(False))


def trigrams(column: Column) -> Column:
    """The set of trigrams: each word in lower case, two blanks before, one behind."""
    words = F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: _grams(w))))


def ordered_trigrams(column: Column) -> Column:
    return F.flatten(F.transform(F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: w != ""), lambda w: _grams(w)))


def _grams(word: Column) -> Column:
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.char_length(word) + 1), lambda i: F.substring(padded, i, F.lit(3)))


def set_similarity(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def trigram_join(df: DataFrame, column: str, terms: list[str], above: float) -> DataFrame:
    """Rows and terms with similarity above a bound, met through the trigrams that they share and then measured.
    Each side's set is counted once; a row costs its trigrams, not the number of terms."""
    spark = df.sparkSession
    # one row a term and trigram: a list of literals, so its size is known
    wanted = F.broadcast(spark.createDataFrame([(x,) for x in terms], "term string").select("term", trigrams(F.col("term")).alias("b")).select("term", F.size("b").alias("nb"), F.explode("b").alias("gram")))
    grams = df.select(column, trigrams(F.col(column)).alias("a")).select(column, F.size("a").alias("na"), F.explode("a").alias("gram"))
    shared = grams.join(wanted, "gram").groupBy(column, "term", "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    s = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return shared.where(s > above).select(column, "term", F.round(s, 6).alias("similarity"))


def word_lookup(df: DataFrame, column: str, terms: list[str], above: float) -> DataFrame:
    """(column, term, similarity) of rows and terms whose word similarity is above a bound (0 at least), met through shared trigrams: no run can
    be more similar than the share of the term's trigrams that the whole text has, so rows that share too few are not measured."""
    spark = df.sparkSession
    # a list of literals, so its size is known
    wanted = F.broadcast(spark.createDataFrame([(x,) for x in terms], "term string").select("term", trigrams(F.col("term")).alias("q")).select("term", F.size("q").alias("nq"), F.explode("q").alias("gram")))
    met = df.select(column).distinct().select(column, F.explode(trigrams(F.col(column))).alias("gram")).join(wanted, "gram").groupBy(column, "term", "nq").agg(F.count(F.lit(1)).alias("shared"))
    measured = met.where(F.col("shared") > F.lit(above) * F.col("nq")).select(column, "term", word_similarity(F.col("term"), F.col(column)).alias("similarity"))
    return measured.where(F.col("similarity") > above).withColumn("similarity", F.round("similarity", 6))


def word_similarity(term: Column, text: Column) -> Column:
    """The greatest |Q and E| / |Q or E| over all runs E of the text's trigrams in order, Q the term's set.

    Only runs that start and end at trigrams of Q can be greatest.  From each start one pass goes on with running counts: a trigram
    is new to the run if it last stood before the start."""

    def over(pair: Column) -> Column:
        q, seq = pair["q"], pair["s"]
        # 1-based places; the place where a trigram stood last, 0 if nowhere
        marked = F.transform(seq, lambda g, i: F.struct(F.array_contains(q, g).alias("own"), F.when(i == 0, 0).otherwise(_last(seq, g, i)).alias("last")))
        starts = F.filter(F.transform(marked, lambda x, i: F.when(x["own"], i + 1)), lambda i: i.isNotNull())

        def best_from(a: Column) -> Column:
            zero = F.struct(F.lit(0).alias("both"), F.size(q).alias("any"), F.lit(0.0).alias("best"))

            def step(s: Column, x: Column) -> Column:
                new = (x["last"] < a).cast("int")
                both, all_ = s["both"] + F.when(x["own"], new).otherwise(0), s["any"] + F.when(x["own"], 0).otherwise(new)
                return F.struct(both.alias("both"), all_.alias("any"), F.when(x["own"], F.greatest(s["best"], both / all_)).otherwise(s["best"]).alias("best"))

            return F.aggregate(F.slice(marked, a, F.size(seq)), zero, step, lambda s: s["best"])

        return F.coalesce(F.array_max(F.transform(starts, best_from)), F.lit(0.0))

    return F.element_at(F.transform(F.array(F.struct(trigrams(term).alias("q"), ordered_trigrams(text).alias("s"))), over), 1)


def _last(seq: Column, gram: Column, i: Column) -> Column:
    """The place of a trigram's last occurrence among the first i."""
    back = F.array_position(F.reverse(F.slice(seq, F.lit(1), i)), gram).cast("int")
    return F.when(back == 0, 0).otherwise(i - back + 1)


def torque_excess(nm: Column, kgm: Column, lbft: Column) -> tuple[Column, Column]:
    """By how much the worse of the two conversions is beyond its tolerance, and whether either is."""
    a = F.abs(nm / NM_PER_KGM - kgm) - F.greatest(F.lit(0.06), 0.03 * kgm)
    b = F.abs(nm / NM_PER_LBFT - lbft) - F.greatest(F.lit(1.0), 0.03 * lbft)
    bad = (F.abs(nm / NM_PER_KGM - kgm) > F.greatest(F.lit(0.06), 0.03 * kgm)) | (F.abs(nm / NM_PER_LBFT - lbft) > F.greatest(F.lit(1.0), 0.03 * lbft))
    return F.greatest(a, b), bad


def table_bounds(rules: list[float]) -> list[float]:
    """Column bounds from vertical rules; with four rules the divider of the last span is put at 0.345 from its right."""
    if len(rules) == 4:
        return [*rules[:3], rules[3] - round(0.345 * (rules[3] - rules[2])), rules[3]]
    return list(rules)


def cell(x: Column, bounds: list[float]) -> Column:
    """The index of the column that holds x, null outside."""
    out = F.when(x < bounds[0], F.lit(None).cast("int"))
    for i, edge in enumerate(bounds[1:]):
        out = out.when(x < edge, i)
    return out


def in_box(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column, pad: float = 40) -> Column:
    return x.between(x0 - pad, x1 + pad) & y.between(y0 - pad, y1 + pad)


def rectangle_distance(ax0, ax1, ay0, ay1, bx0, bx1, by0, by1) -> Column:
    dx = F.greatest(bx0 - ax1, ax0 - bx1, F.lit(0))
    dy = F.greatest(by0 - ay1, ay0 - by1, F.lit(0))
    return F.sqrt(dx * dx + dy * dy)


def padded(lo: Column, hi: Column, pad: float, most: float) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), lo - pad), F.least(F.lit(most), hi + pad)


def repaired_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))
