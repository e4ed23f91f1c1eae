"""Incremental runs as Structured Streaming jobs.

Both jobs take what is new and stop (``availableNow``).  Their checkpoint remembers what was done, so a second run adds
only what arrived since, and a failed run resumes.
"""

from pyspark import StorageLevel

from vectormart.functions.documents import parse_documents
from vectormart.operators.staging import flatten_features
from vectormart.session import path_exists, written
from vectormart.sources.readers import accepted, file_provenance, file_texts, rejected
from vectormart.sources.small_files import LISTED, folder_address, listed

# Spark reads small files some thirty to a task; so many of those tasks are joined, so that outputs are not as small.
TASKS_JOINED = 16
# A batch looks its files up again in as many tasks, by default up to 10,000 of some files each.
LOOKUP_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _finish(query):
    query.awaitTermination()
    return query


def stream_ingest(spark, folder, out, checkpoint, files_per_batch=None, rejects=None, pattern="*.json"):
    """Flatten feature documents that arrived since the last run; what cannot be read goes to a dataset of its own.

    Accepted rows go to ``out``, and path, length and reason of the others to ``rejects`` (by default ``out`` with ``-rejects``).
    Both come from one parse.  A batch overwrites a folder of its own, named after the checkpoint and its number, so
    one that is delivered again leaves each document once in either dataset.

    What streams are tables of paths, noted below the checkpoint by ``_note_arrivals``: Spark's own stream of files keeps
    all their names on the driver.  Folders that tasks cannot list by themselves are left to it, and so is a checkpoint that
    it began.
    """
    rejects = rejects or out.rstrip("/") + "-rejects"
    notes = checkpoint.rstrip("/") + "/arrivals"
    begun = path_exists(spark, checkpoint.rstrip("/") + "/sources/0") and not path_exists(spark, notes)
    address = None if begun else folder_address(spark, folder)
    reader = spark.readStream
    if files_per_batch:
        # A table of paths holds as many as a batch may.
        reader = reader.option("maxFilesPerTrigger", 1 if address else files_per_batch)
    if address:
        _note_arrivals(spark, address, pattern, notes, files_per_batch)
        arriving = reader.schema(LISTED).parquet(notes)
    else:
        arriving = file_provenance(reader.option("pathGlobFilter", pattern).text(folder, wholetext=True))

    def joined(texts):
        tasks = max(2 * texts.sparkSession.sparkContext.defaultParallelism, -(-texts.rdd.getNumPartitions() // TASKS_JOINED))
        return texts.coalesce(tasks)

    def write(batch, number):
        place = f"run={batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}/batch={number}"
        texts = file_texts(batch, address) if address else joined(batch)
        # A lost block is parsed again from its files.
        parsed = parse_documents(texts).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            flatten_features(accepted(parsed)).write.mode("overwrite").parquet(f"{out.rstrip('/')}/{place}")
            rejected(parsed).write.mode("overwrite").parquet(f"{rejects}/{place}")
        finally:
            parsed.unpersist()

    before = spark.conf.get(LOOKUP_TASKS)
    spark.conf.set(LOOKUP_TASKS, str(4 * spark.sparkContext.defaultParallelism))
    try:
        return _finish(
            arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(LOOKUP_TASKS, before)


def _note_arrivals(spark, address, pattern, notes, files_per_batch):
    """Note the files of a folder that no run noted yet, in order of their change if batches are bounded.

    A table that was cut off while it was written names some files; the others are found again by the next run.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(notes)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    noted = spark.read.schema(LISTED).parquet(notes).select("path")
    new = written(listed(spark, address, pattern).join(noted, "path", "left_anti"), "arriving")
    if not new.isEmpty():
        if files_per_batch:
            new = new.repartition(1).sortWithinPartitions("changed", "path")
        new.write.mode("append").option("maxRecordsPerFile", files_per_batch or 0).parquet(notes)


def stream_upsert(points, collection, checkpoint, seq=None, key=None, name="upsert"):
    """Upsert streamed points as the writer ``name``, whose batches are numbered by the checkpoint.

    A batch that is delivered again changes nothing, whatever other writers wrote in between.  A stream that starts
    over with a new checkpoint needs a new name.
    """

    def write(batch, number):
        collection.upsert(batch, seq=seq, key=key, batch=number, writer=name)

    return _finish(
        points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
