"""File worklists: what is listed, what is left to do, how a run went."""

from pyspark.sql import functions as F

from vectormart import fixed_values as V
from vectormart.functions.text import file_ext, output_name, top_dir


def audio_files(listing, path="path"):
    """Distinct files of a supported type; protected files never qualify."""
    ext = file_ext(F.col(path))
    return (
        listing.withColumn("ext", ext)
        .filter(F.col("ext").isin(*V.AUDIO_EXTENSIONS) & ~F.col("ext").isin(*V.PROTECTED_EXTENSIONS))
        .dropDuplicates([path])
    )


def path_distinct(listing, path="path"):
    return listing.select(path).distinct()


def top_dirs(listing, rel_path="rel_path"):
    """Distinct first folders of relative paths."""
    return (
        listing.select(top_dir(F.col(rel_path)).alias("artist_dir")).filter("artist_dir is not null").distinct()
    )


def resume_pending(files, outputs, rel_path="rel_path"):
    """Files whose output does not exist yet or is empty.

    ``outputs`` lists (name, length) of what is already there.
    """
    done = outputs.filter(F.col("length") > 0).select(F.col("name").alias("output_name"))
    return files.withColumn("output_name", output_name(F.col(rel_path))).join(done, "output_name", "left_anti")


def run_summary(results, status="status"):
    """Counts of finished, skipped and failed files; dry runs count as neither."""
    s = F.col(status)
    ok, skip, dry = F.count_if(s == "ok"), F.count_if(s == "skip"), F.count_if(s == "dry-run")
    return results.agg(ok.alias("ok"), skip.alias("skip"), (F.count("*") - ok - skip - dry).alias("fail"))
