"""Stable slices of a sorted table."""

from pyspark.sql import functions as F

from vectormart.session import work_folder

# Up to here each task can keep the head of the table in memory and the rows that
# cross the network are few; longer slices count positions instead.
HEAD_ROWS = 100_000
_LOW_BITS = 33


def limit_rows(df, n, *order):
    """The first n rows in a stated order."""
    return slice_rows(df, 0, n, *order)


def slice_rows(df, start, limit, *order):
    """Rows ``[start, start + limit)`` of the sorted table, in order; a limit of 0 means all the rest.

    ``order`` must identify a row, else equal rows may change places between runs.
    """
    ordering = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    start = max(0, start)
    if limit and start + limit <= HEAD_ROWS:
        return df.orderBy(*ordering).offset(start).limit(limit)
    if not limit and not start:
        return df.orderBy(*ordering)
    indexed = row_index(df, *ordering)
    kept = F.col("row_index") >= start
    if limit:
        kept = kept & (F.col("row_index") < start + limit)
    return indexed.filter(kept).orderBy("row_index").drop("row_index")


def row_index(df, *ordering):
    """Add the 0-based position in the sorted table without a single-task pass.

    The table is range-sorted and written once, so both steps below see the same
    rows: count the rows of each sorted part, then add the counts of the parts
    before it.  Only one number per part travels through the driver.
    """
    spark = df.sparkSession
    path = work_folder(spark, "sorted")
    marked = df.orderBy(*ordering).withColumn("_mark", F.monotonically_increasing_id())
    marked.write.parquet(path)
    part = F.shiftright("_mark", _LOW_BITS)
    stored = spark.read.schema(marked.schema).parquet(path).withColumn("_part", part)
    before, offsets = 0, []
    for row in stored.groupBy("_part").count().orderBy("_part").toLocalIterator():
        offsets.append((row["_part"], before))
        before += row["count"]
    starts = spark.createDataFrame(offsets, "_part bigint, _before bigint")
    inside = F.col("_mark").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    return (
        stored.join(F.broadcast(starts), "_part")
        .withColumn("row_index", F.col("_before") + inside)
        .drop("_mark", "_part", "_before")
    )


def pages(df, page_rows, *order):
    """Number every row with the page it falls on, for readers that go page by page."""
    ordering = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    indexed = row_index(df, *ordering)
    return indexed.withColumn("page", F.floor(F.col("row_index") / F.lit(page_rows)).cast("bigint"))
