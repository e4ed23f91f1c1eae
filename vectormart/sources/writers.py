"""Writing datasets, manifests, reports and statistics."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from vectormart.functions.text import relative_path
from vectormart.operators.lookup import resolved_entries
from vectormart.operators.paging import limit_rows
from vectormart.session import written


def _counted(df):
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def write_parts(df, folder, chunk_rows=5000, mode="overwrite"):
    """Parquet parts of at most ``chunk_rows`` rows; returns the number of rows written.

    Overwriting replaces all old parts.  Without any row no data is written.
    """
    counted, seen = _counted(df)
    counted.write.mode(mode).option("maxRecordsPerFile", max(1, chunk_rows)).parquet(folder)
    return seen.get["rows"]


def write_single(df, folder):
    """One folder that reads as one table: parallel parts, each as large as its task's rows."""
    df.write.mode("overwrite").parquet(folder)


def write_sample(df, folder, rows=500, order=("file_hash",)):
    """The first rows in a stated order."""
    limit_rows(df, rows, *order).write.mode("overwrite").parquet(folder)


def write_manifest(manifest, root, absolute, relative):
    """Two text lists of the sorted paths: absolute, and relative to the root."""
    base = root if ":" in root else "file:" + root
    # Written once in order; both lists read it in that order.
    paths = written(manifest.select("path").distinct().orderBy("path"), "paths").orderBy("path")
    paths.write.mode("overwrite").text(absolute)
    paths.select(relative_path(F.col("path"), base).alias("value")).write.mode("overwrite").text(relative)


def write_csv(df, folder):
    """CSV with a header; text is quoted where needed, so commas inside names survive."""
    df.write.mode("overwrite").csv(folder, header=True, escape='"', emptyValue="")


def stats_json(stats):
    """Statistics rows (feature, mean, std) as one JSON text with sorted keys."""
    entries = F.array_sort(F.collect_list(F.struct("feature", F.struct("mean", "std").alias("stat"))))
    return stats.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def write_stats(stats, path):
    """Store the statistics as one JSON text; the table has one row per feature."""
    stats_json(stats).coalesce(1).write.mode("overwrite").text(path)


def save_cache(cache, path, marker):
    """The cache as lines of JSON with its retry marks, as ``scan_lookup_cache(lines=True)`` reads it."""
    cache_json(cache, marker).write.mode("overwrite").text(path)


def cache_json(cache, marker):
    """Cache rows as JSON objects, one per line, retry marks included."""
    value = F.when(F.col("status") == "retry", F.lit(marker)).otherwise(F.col("artwork_url"))
    return cache.select(F.to_json(F.create_map("cache_key", value)).alias("value"))


def write_cache(cache, folder):
    """The flat cache table without entries to be tried again."""
    resolved_entries(cache).write.mode("overwrite").parquet(folder)
