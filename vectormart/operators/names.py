"""Matching folder names against wanted names, and selecting the files below them."""

from pyspark.sql import functions as F

from vectormart.functions.text import blank_to_null, name_key, strip
from vectormart.session import measured


def artist_keys(artist_map, lenient=False):
    """Distinct keys of both name columns of the rows that carry an identifier."""
    named = artist_map.filter(F.coalesce(strip(F.col("mbid")), F.lit("")) != "")
    return key_union(named.select("artist_raw"), named.select("canonical_name"), lenient)


def key_union(left, right, lenient=False):
    """Distinct non-empty keys of two one-column name tables."""
    names = left.toDF("name").union(right.toDF("name")).filter(F.col("name").isNotNull()).distinct()
    return names.select(name_key(F.col("name"), lenient).alias("name_key")).filter("name_key <> ''").distinct()


def key_intersect(dir_keys, targets):
    """Keys present in both one-column tables, sorted."""
    return dir_keys.toDF("name_key").intersect(targets.toDF("name_key")).orderBy("name_key")


def first_by_key(dirs, lenient=False):
    """One row per key: the first folder name and the last path, in path order."""
    keyed = dirs.withColumn("name_key", name_key(F.col("artist_dir"), lenient))
    return keyed.groupBy("name_key").agg(
        F.min_by("artist_dir", "path").alias("artist_dir"), F.max("path").alias("path")
    )


def prefix_filter(df, prefix, key="name_key"):
    """Rows whose key starts with a prefix, whatever its case."""
    return df.filter(F.startswith(F.col(key), F.lit(prefix.lower())))


def match_artists(dirs, targets=None, lenient=False, prefix=None):
    """Folders whose key is wanted; without targets every folder is."""
    keyed = first_by_key(dirs, lenient)
    if targets is not None:
        keyed = keyed.join(targets.select("name_key"), "name_key", "left_semi")
    return prefix_filter(keyed, prefix) if prefix else keyed


def files_per_dir(manifest, directory="dir_path"):
    return manifest.groupBy(directory).agg(F.count("*").alias("files_in_dir"))


def match_report(dirs, targets, manifest, lenient=False, prefix=None):
    """Audit of the match with file counts; unmatched folders only when a prefix is given."""
    keyed = first_by_key(dirs, lenient)
    wanted = targets.select("name_key").distinct().withColumn("_wanted", F.lit(True))
    matched = F.coalesce(F.col("_wanted"), F.lit(False))
    if prefix:
        matched = matched & F.startswith(F.col("name_key"), F.lit(prefix.lower()))
    report = keyed.join(wanted, "name_key", "left").withColumn("matched", matched)
    if not prefix:
        report = report.filter("matched")
    counts = files_per_dir(manifest).withColumnRenamed("dir_path", "path")
    return report.join(counts, "path", "left").select(
        "artist_dir",
        F.col("name_key").alias("normalized_key"),
        "matched",
        F.when(F.col("matched"), F.col("name_key")).otherwise(F.lit("")).alias("matched_key"),
        F.coalesce("files_in_dir", F.lit(0)).cast("bigint").alias("files_in_dir"),
    )


def select_files(manifest, matched):
    """Distinct files below the matched folders, sorted by path."""
    dirs = measured(matched.select(F.col("path").alias("dir_path")))
    return manifest.join(dirs, "dir_path", "left_semi").select("path").distinct().orderBy("path")


def selection_summary(dirs, matched, files):
    """Number of folders, of matched keys and of selected files, in one row."""
    counted = (
        dirs.select(F.lit("artist_dirs_total").alias("what"))
        .unionAll(matched.select(F.lit("artists_matched")))
        .unionAll(files.select(F.lit("files_selected")))
    )
    names = ("artist_dirs_total", "artists_matched", "files_selected")
    return counted.agg(*[F.count_if(F.col("what") == n).alias(n) for n in names])


def non_blank(df, *columns):
    """Rows in which none of the columns is NULL or empty."""
    for c in columns:
        df = df.filter(blank_to_null(F.col(c)).isNotNull())
    return df
