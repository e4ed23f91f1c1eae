"""Exact de-duplication by sorting the content.

Splitters that Spark samples range-partition the rows by the start of the normalised text, its hash
and the id (so splitters stay small, and a group that is larger than a range is split by id).  The
sort inside a range spills as needed and puts equal texts side by side; each row is compared
in full with the one before it.  Runs at the two ends of a range may go on in the next one, so those
runs, a few per range, are compared in full across ranges.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectormart.session import written

START = 32


def normalised(text):
    """Runs of space, tab, line feed, vertical tab, form feed and carriage return become one space; null is empty."""
    # A single space stays as it is, so most texts match nowhere.
    pattern = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text, F.lit("")), pattern, " ")


def exact_groups(docs, id="doc_id", text="text", carry=()):
    """Per row of ``docs``: the carried columns, keep_id, group_size, kept and text_sha256.

    Texts are equal when their normalised forms are.  Of each group one row stays, the one with the
    smallest id; among rows that repeat that id, one of them.  Null texts count as empty and form one
    group; null ids come after all others, and keep_id is null if no row of the group has an id.
    An empty table gives no rows.
    """
    carry = list(dict.fromkeys([id, *carry]))
    row = F.struct(*[F.col(c) for c in dict.fromkeys([*carry, text])]).alias("row")
    keyed = docs.select(row, normalised(F.col(text)).alias("normal")).select(
        "row", F.substring("normal", 1, START).alias("start"), F.xxhash64("normal").alias("hash"), F.col(f"row.{id}").alias("id"))
    ranged = keyed.repartitionByRange("start", "hash", F.col("id").asc_nulls_last())
    # The text travels once more, to the task of its range, where windows can walk it.
    placed = ranged.withColumn("range", F.spark_partition_id()).repartition("range").withColumn("normal", normalised(F.col(f"row.{text}")))
    order = Window.partitionBy("range").orderBy("start", "hash", "normal", F.col("id").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    key = F.struct("start", "hash")
    before = F.lag("normal").over(order)
    walked = placed.withColumns({
        "first": before.isNull() | (before != F.col("normal")), "low": F.first(key).over(whole), "high": F.last(key).over(whole)})
    runs = walked.withColumn("run", F.sum(F.col("first").cast("long")).over(order)).select(
        "range", "run", "first", "id", *[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(carry)],
        F.sha2("normal", 256).alias("sha"),
        F.when(F.col("first") & ((key == F.col("low")) | (key == F.col("high"))), F.col("normal")).alias("edge"))
    own = Window.partitionBy("range", "run")
    # Written once: what follows reads it twice and must see the same ranges.
    sized = written(runs.withColumns({"least": F.min("id").over(own), "size": F.count("*").over(own)}), "runs")
    edges = sized.filter("edge is not null").select("range", "run", "edge", "least", "size")
    across = Window.partitionBy("edge")
    merged = edges.select(
        "range", "run", F.min("least").over(across).alias("all_least"), F.sum("size").over(across).alias("all_size"),
        F.min("range").over(across).alias("first_range"))
    out = sized.drop("edge").join(merged, ["range", "run"], "left")
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)],
        F.coalesce("all_least", "least").alias("keep_id"), F.coalesce("all_size", "size").alias("group_size"),
        (F.col("first") & (F.col("range") == F.coalesce("first_range", "range"))).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs, id="doc_id", text="text"):
    """The rows of ``docs`` that stay, with the columns they had."""
    inner = docs.select(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(docs.columns)])
    names = {c: f"v{i}" for i, c in enumerate(docs.columns)}
    groups = exact_groups(inner, names[id], names[text], inner.columns)
    return groups.filter("kept").select(*[F.col(v).alias(c) for c, v in names.items()])


GROUPS_SQL = r"""select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id = min(doc_id) over g as kept, sha256(normal) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as normal from documents)
window g as (partition by normal)"""
