"""Profiles of a feature table."""

import math
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from vectormart.fixed_values import FEATURES
from vectormart.session import measured

BRACKET_SLICES = 1000


def row_count(df):
    return df.agg(F.count("*").alias("n"))


def coverage_profile(df):
    """Rows, distinct artists and albums, mean length, tempo range and date range.

    Rows are first thinned to one per (artist, album), so the distinct counts work on
    those few rows instead of on copies of the whole table.
    """
    thinned = df.groupBy("artist", "album").agg(
        F.count("*").alias("n"), F.sum("duration_sec").alias("seconds"), F.count("duration_sec").alias("timed"),
        F.min("bpm").alias("low"), F.max("bpm").alias("high"), F.min("date").alias("first"), F.max("date").alias("last"),
    )
    return thinned.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tracks"),
        F.count_distinct("artist").alias("artists"),
        F.count_distinct("album").alias("albums"),
        (F.sum("seconds") / 60.0 / F.nullif(F.sum("timed"), F.lit(0))).alias("avg_minutes"),
        F.min("low").alias("min_bpm"),
        F.max("high").alias("max_bpm"),
        F.min("first").alias("min_date"),
        F.max("last").alias("max_date"),
    )


def format_counts(df, column="codec"):
    return df.groupBy(column).agg(F.count("*").alias("n"))


def null_profile(df, columns=None):
    """Missing values per column: one pass, one output row per column."""
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("missing")) for i, c in enumerate(columns)
    ])
    return counted.select("_rows", F.inline(rows)).select(
        "column_name", "missing", (100.0 * F.col("missing") / F.nullif("_rows", F.lit(0))).alias("missing_pct")
    )


def top_values(df, n, *columns):
    """The n most frequent values of one or several columns; equal counts by value."""
    return (
        df.groupBy(*columns).agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), *[F.col(c).asc_nulls_last() for c in columns])
        .limit(n)
    )


def model_row_counts(models):
    """Rows of each named table of a chain: ``{name: table}``."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("model"), "n") for name, df in models.items()]
    return reduce(lambda a, b: a.unionAll(b), counts)


def feature_quantiles(df, probabilities=(0.1, 0.5, 0.9), features=FEATURES, accuracy=10_000):
    """Exact interpolated quantiles of every feature without gathering a feature in one task.

    1. One aggregate with a mergeable rank sketch per feature brackets each quantile between two values, once
       narrowly and twice more widely.
    2. One aggregate counts the rows below and inside each bracket; a bracket that the wanted ranks are not in gives
       way to the next wider one, and the widest holds all rows.
    3. Only rows inside a bracket, some in a thousand, are counted per distinct value and per slice of the bracket;
       the slices that hold the wanted ranks are walked in order.

    Each pass reads the features once and keeps rows as wide as they are.  A feature without any value has no rows.
    """
    brackets = _brackets(df, probabilities, features, accuracy)
    settled, level = {}, 0
    while brackets:
        counted = df.agg(*[F.struct(F.count_if(F.col(f) < low).alias("below"), F.count_if(F.col(f).between(low, high)).alias("inside"))
                           for (f, _), (_, edges) in brackets.items() for low, high in [map(F.lit, edges[level])]]).first()
        for ((f, p), (n, edges)), counts in zip(list(brackets.items()), counted):
            position = p * (n - 1)
            ranks = math.floor(position), math.ceil(position)
            if counts["below"] <= ranks[0] and ranks[1] < counts["below"] + counts["inside"]:
                settled[f, p] = (*edges[level], counts["below"], *ranks, position - ranks[0])
                del brackets[f, p]
        level += 1
    if not settled:
        return df.sparkSession.createDataFrame([], "feature string, p double, quantile double")
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(p).alias("p"), F.col(f).cast("double").alias("value"), _slice(F.col(f), F.lit(low), F.lit(high)).alias("slice"),
                 F.col(f).between(low, high).alias("held")) for (f, p), (low, high, *_) in settled.items()])
    inside = measured(df.select(F.inline(F.filter(rows, lambda r: r["held"]))).groupBy("feature", "p", "value", "slice").agg(F.count("*").alias("copies")))
    found = _walk(inside, settled)
    return found.select("feature", "p", (F.col("at_low") + (F.col("at_high") - F.col("at_low")) * F.col("fraction")).alias("quantile"))


def _brackets(df, probabilities, features, accuracy):
    """{(feature, p): (rows with a value, brackets from the narrowest to the widest)}."""
    kept = min(65_535, max(8, accuracy // 2))
    margins = [4.6 / kept ** 0.9, 37 / kept ** 0.9]
    ranks = [min(1.0, max(0.0, p + sign * m)) for p in probabilities for m in margins for sign in (-1, 1)] + [0.0, 1.0]
    wanted = F.array(*map(F.lit, ranks))
    sketches = df.agg(*[F.struct(F.count(f).alias("n"), F.count_if(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))).alias("numbers"),
                                 F.kll_sketch_agg_double(F.col(f).cast("double"), F.lit(kept)).alias("sketch")).alias(f) for f in features])
    # NaN stands above all numbers and is in no sketch; an empty sketch cannot be asked.
    row = sketches.select(*[F.struct(F.col(f)["n"].alias("n"), F.when(F.col(f)["numbers"] > 0, F.kll_sketch_get_quantile_double(
        F.col(f)["sketch"], wanted)).alias("edges")).alias(f) for f in features]).first()
    out = {}
    for f in features:
        n, edges = row[f]["n"], row[f]["edges"] or [math.nan] * len(ranks)
        for i, p in enumerate(probabilities):
            if n:
                own = edges[4 * i:4 * i + 4]
                out[f, float(p)] = n, [tuple(own[:2]), tuple(own[2:]), (edges[-2], math.nan)]
    return out


def _slice(value, low, high):
    """Number of the equal slice of a bracket that holds a value; never falls as values grow."""
    width = high - low
    share = F.when((width > 0) & (width < float("inf")), (value - low) / width).otherwise(0.0)
    return F.least(F.floor(share * BRACKET_SLICES), F.lit(BRACKET_SLICES - 1)).cast("int")


def _walk(inside, settled):
    """Values at the wanted ranks: first find the slices that hold them, then order only those.

    Slices are at most ``BRACKET_SLICES`` per feature and probability, so their counts fit on the driver.
    """
    counts = {}
    for f, p, place, rows in inside.groupBy("feature", "p", "slice").agg(F.sum("copies")).orderBy("slice").collect():
        counts.setdefault((f, p), []).append((place, rows))
    chosen = []
    for (f, p), (_, _, start, low, high, fraction) in settled.items():
        for place, rows in counts[f, p]:
            if start <= low < start + rows or start <= high < start + rows:
                chosen.append((f, p, place, start, low, high, fraction))
            start += rows
    kept = inside.sparkSession.createDataFrame(
        chosen, "feature string, p double, slice int, start long, rank_low long, rank_high long, fraction double")
    over_values = Window.partitionBy("feature", "p", "slice").orderBy("value")
    upto = F.col("start") + F.sum("copies").over(over_values)
    walked = inside.join(F.broadcast(kept), ["feature", "p", "slice"]).withColumn("first", upto - F.col("copies")).withColumn("end", upto)

    def at(rank):
        return F.max(F.when((F.col("first") <= F.col(rank)) & (F.col(rank) < F.col("end")), F.col("value")))

    return walked.groupBy("feature", "p", "fraction").agg(at("rank_low").alias("at_low"), at("rank_high").alias("at_high"))
