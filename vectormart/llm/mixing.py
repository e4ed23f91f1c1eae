"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell of source, language and topic.  Cell weights are raked: scaled in turn so
that the sums by source, by language and by topic meet their targets, until nothing moves.  No cell gets more
than its own tokens: full cells stay at that bound and the others are raked to what is left.  A document
is then drawn with the probability that its cell's weight asks for.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectormart.session import written

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
SHARE = 0.5
STEADY, ROUNDS, ROUNDS_PER_STEP = 1e-6, 60, 4
SEED = "mix"


def topic_of(text):
    """A coarse topic from the look of a text: contacts, table, list, prose, or none for an empty text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.when(F.length(text) == 0, "none").when(F.contains(text, F.lit("@")), "contacts").when(
        F.contains(text, F.lit(" | ")), "table").when(F.length(text) < 60 * lines, "list").otherwise("prose")


def token_count(text):
    """Number of words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def cells_of(rows, dimensions=DIMENSIONS):
    """(dimensions ..., tokens): one row per cell that has tokens.  Partial sums come before the shuffle."""
    return rows.groupBy(*dimensions).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")


def tempered(cells, dimension, power):
    """(dimension, target): shares in proportion to the tokens to a power; below 1 it lifts the small ones."""
    sums = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("mass"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("mass").alias("all")))).select(dimension, (F.col("mass") / F.col("all")).alias("target"))


def within_reach(cells, dimension, goal, share):
    """(dimension, target): ``goal`` with values that have too few tokens set to all they have; the others share the rest."""
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return goal
    sums = cells.groupBy(dimension).agg((F.sum("tokens") / F.lit(share * total)).alias("most"))
    sums = written(goal.join(sums, dimension), "targets")
    lift = 1.0
    while True:
        full = F.col("target") * lift >= F.col("most")
        taken, free = sums.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("target")))).first()
        # The lift only grows, by at least one more full value a turn.
        if not free or (1 - taken) / free <= lift * (1 + 1e-12):
            break
        lift = (1 - taken) / free
    return sums.select(dimension, F.least(F.col("target") * lift, F.col("most")).alias("target"))


def rake(cells, targets, steady=STEADY, rounds=ROUNDS, share=None):
    """Cells with a weight each, summing to 1, whose sums along every dimension meet its targets.

    ``targets`` maps a dimension to a table (dimension, target).  A value without target gets no
    weight; targets are scaled to sum to 1 over the values that occur.  Rounds end when no factor is
    further than ``steady`` from 1, or after ``rounds`` (targets that contradict each other never settle).
    With ``share`` no cell gets more than its tokens, where 1 stands for that share of all tokens.
    A task holds the cells of one value of a dimension: rows per combination of the others, not per document.
    """
    names = cells.columns
    for dimension, goal in targets.items():
        there = goal.join(cells.select(dimension).distinct(), dimension).agg(F.sum("target").alias("all"))
        goal = goal.crossJoin(F.broadcast(there)).select(dimension, (F.col("target") / F.col("all")).alias(f"target_{dimension}"))
        cells = cells.join(goal, dimension, "left").fillna(0.0, [f"target_{dimension}"])

    def factor(dimension):
        over = Window.partitionBy(dimension)
        full = F.col("weight") >= F.col("most")
        held = F.sum(F.when(full, F.col("most")).otherwise(0.0)).over(over)
        free = F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(over)
        goal = F.col(f"target_{dimension}")
        return F.when((free > 0) & (goal > held), (goal - held) / free).when(
            held + free > 0, F.least(goal / (held + free), F.lit(1.0))).otherwise(0.0)

    if share is None:
        cells = cells.withColumn("most", F.lit(float("inf")))
    else:
        total = cells.agg(F.sum("tokens").alias("all"))
        cells = cells.crossJoin(F.broadcast(total)).withColumn("most", F.col("tokens") / (F.lit(share) * F.col("all"))).drop("all")
    cells = written(cells.withColumn("weight", F.col("tokens").cast("double") / F.sum("tokens").over(Window.partitionBy(list(targets)[0]))), "cells")
    for _ in range(0, rounds, ROUNDS_PER_STEP):
        for dimension in list(targets) * ROUNDS_PER_STEP:
            # A full cell keeps its own factors, as it may have room again; far above the bound they do not matter.
            cells = cells.withColumn("weight", F.least(F.col("weight") * factor(dimension), F.col("most") * 1e9))
        cells = written(cells.withColumn("off", F.when(F.col("weight") > 0, F.abs(factor(next(iter(targets))) - 1))), "raked")
        off = cells.agg(F.max("off")).first()[0]
        cells = cells.drop("off")
        if off is None or off <= steady:
            break
    return cells.select(*names, F.least("weight", "most").alias("weight"))


def margins(cells, targets):
    """(dimension, value, target, reached) of raked cells: which targets are out of reach."""
    out = None
    for dimension, goal in targets.items():
        sums = cells.groupBy(dimension).agg(F.sum("weight").alias("reached"))
        part = goal.join(sums, dimension, "left").select(
            F.lit(dimension).alias("dimension"), F.col(dimension).alias("value"), "target", F.coalesce("reached", F.lit(0.0)).alias("reached"))
        out = part if out is None else out.unionAll(part)
    return out


def uniform(key, seed=SEED):
    """A number from 0 to 1 that depends on the key and the seed only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** 13))


def probabilities(cells, share=SHARE):
    """Cells with the probability of a document: what draws ``share`` of all tokens, at most 1."""
    total = cells.agg(F.sum("tokens").alias("all"))
    return cells.crossJoin(F.broadcast(total)).withColumn(
        "probability", F.least(F.lit(share) * F.col("all") * F.col("weight") / F.col("tokens"), F.lit(1.0))).drop("all")


def featured(docs):
    """The inner columns of the mix; missing sources and languages form a value of their own, ''."""
    return docs.select(
        "*", F.coalesce(F.col("source"), F.lit("")).alias("mix_source"), F.coalesce(F.col("lang"), F.lit("")).alias("mix_lang"),
        topic_of(F.col("text")).alias("mix_topic"))


INNER = {"source": "mix_source", "lang": "mix_lang", "topic": "mix_topic"}


def calibrated(rows, share=SHARE, powers=None):
    """Raked cells of (source, lang, topic, n_tokens) rows, with weight and probability."""
    cells = written(cells_of(rows), "counts")
    targets = {d: within_reach(cells, d, tempered(cells, d, (powers or POWERS)[d]), share) for d in DIMENSIONS}
    return written(probabilities(rake(cells, targets, share=share), share), "probabilities")


def mixed(docs, share=SHARE):
    """One row per document: its cell, tokens, probability and whether it is drawn.

    Documents without tokens (null, empty, white space) have no cell, probability 0, and are not drawn.
    Rows that repeat an id share its draw.  An empty table gives no rows.
    """
    rows = featured(docs).select("doc_id", *[F.col(v).alias(k) for k, v in INNER.items()], token_count(F.col("text")).alias("n_tokens"))
    rows = written(rows, "features")
    cells = calibrated(rows, share).select(*DIMENSIONS, "weight", "probability")
    joined = rows.join(cells, list(DIMENSIONS), "left")
    probability = F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    return joined.select("doc_id", *DIMENSIONS, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("cell_weight"),
                         probability.alias("probability"), (uniform(F.col("doc_id")) < probability).alias("drawn"))


def mix(docs, share=SHARE):
    """The drawn rows of ``docs``, with the columns they had."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", "row.source", "row.lang", "row.text")
    rows = featured(inner).withColumn("n_tokens", token_count(F.col("text")))
    counts = rows.select(*[F.col(v).alias(k) for k, v in INNER.items()], "n_tokens")
    cells = calibrated(counts, share).select(*[F.col(k).alias(v) for k, v in INNER.items()], "probability")
    drawn = rows.join(cells, list(INNER.values())).filter((F.col("n_tokens") > 0) & (uniform(F.col("row.doc_id")) < F.col("probability")))
    return drawn.select("row.*")
