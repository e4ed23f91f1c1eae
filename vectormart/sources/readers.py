"""Reading feature documents, listings and lookup files."""

import re

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from vectormart.fixed_values import FLAT_COLUMNS
from vectormart.functions.documents import parse_documents
from vectormart.functions.text import relative_path, top_dir
from vectormart.operators.worklist import audio_files
from vectormart.session import written
from vectormart.sources.listing import Listing
from vectormart.sources.small_files import PACKED, contents, folder_address, listed

FLAT_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in FLAT_COLUMNS)
ARTIST_MAP_SCHEMA = "artist_raw string, canonical_name string, mbid string"


def file_provenance(df):
    """Source path and its last change as UTC text such as 2024-01-31T09:30:00.123456Z.

    Like ISO notation, the fraction is left out when it is zero.  Spark gives the path
    as a percent-encoded URI; it is decoded, so that it names the file as listings do.
    """
    uri = F.col("_metadata.file_path")
    path = F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri)
    return df.select("*", path.alias("json_path"), _utc_text(F.col("_metadata.file_modification_time")).alias("extracted_at"))


def _utc_text(time):
    text = F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("Z"))


def file_texts(files, address):
    """Listed files as ``file_provenance`` shows them: (value, json_path, extracted_at).

    They are read in tasks.  Packed ones go through Spark's reader, which holds their paths on the driver.
    """
    packed = F.lower("path").rlike(PACKED)
    texts = contents(files.filter(~packed), address).select(
        "value", F.col("path").alias("json_path"), _utc_text(F.timestamp_millis("changed")).alias("extracted_at"))
    paths = _literal(files.filter(packed).collect())
    return texts.unionByName(file_provenance(files.sparkSession.read.text(paths, wholetext=True))) if paths else texts


def scan_feature_json(spark, folder, limit=None):
    """One document per ``*.json`` file: (json_path, extracted_at, value, doc).

    ``limit`` keeps the first files by path.  Bad files have a NULL ``doc``; see
    ``accepted`` and ``rejected``.  The folder is listed at once and its listing written, so that all steps see the same files.
    """
    address = folder_address(spark, folder)
    if address:
        files = written(listed(spark, address, "*.json"), "files")
        return parse_documents(file_texts(files if limit is None else first_listed(files, limit), address))
    # A name filter lists the folder once; a path pattern would become one path per file.
    paths = folder if limit is None else first_files(spark, folder, "*.json", limit)
    if not paths:
        return parse_documents(file_provenance(spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).limit(0)))
    return parse_documents(file_provenance(spark.read.option("pathGlobFilter", "*.json").text(paths, wholetext=True)))


def first_listed(files, limit):
    """The first ``limit`` listed files by path, of those that are not empty."""
    return files.filter("length > 0").orderBy("path").limit(limit)


def first_files(spark, folder, pattern, limit):
    """The first ``limit`` file paths in order, written so that no character counts as a pattern; nothing is opened for it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return _literal(files.orderBy("path").limit(limit).collect())


def _literal(rows):
    return [re.sub(r"([\\*?\[\]{}])", r"\\\1", r["path"]) for r in rows]


def scan_feature_lines(spark, path):
    """One document per text line, which lets Spark split large files between tasks."""
    return parse_documents(file_provenance(spark.read.text(path)))


def accepted(scanned):
    return scanned.filter("doc is not null")


def rejected(scanned):
    """Paths of documents that could not be parsed, their length and why, for the log."""
    reason = F.when(F.trim("value") == "", "empty").otherwise("no JSON")
    return scanned.filter("doc is null").select("json_path", F.length("value").alias("characters"), reason.alias("reason"))


def scan_features_parquet(spark, folder, schema=FLAT_SCHEMA):
    """Every part of a feature dataset, with a stated schema instead of an inferred one."""
    return spark.read.schema(schema).parquet(folder)


def listing(spark, root):
    """Recursive listing of all files, empty ones too: path, length, mtime.  Folders are shared out; contents are never read."""
    spark.dataSource.register(Listing)
    return spark.read.format("listing").load(root if ":" in root else "file:" + root)


def scan_file_manifest(spark, root):
    """Audio files below a root: path, relative path, first folder, type, size, time."""
    return manifest_of(listing(spark, root), root)


def manifest_of(files, root):
    """Manifest of any table that has a ``path`` column, for example a store's inventory."""
    base = root if ":" in root else "file:" + root
    with_rel = audio_files(files).withColumn("rel_path", relative_path(F.col("path"), base))
    return with_rel.withColumn("artist_dir", top_dir(F.col("rel_path"))).withColumn(
        "dir_path", F.concat(F.lit(base.rstrip("/") + "/"), F.col("artist_dir"))
    )


def scan_artist_map(spark, path, line_breaks=False):
    """Resolved artist names as text columns.

    ``line_breaks`` allows them inside quoted names; such files cannot be split.
    """
    return spark.read.csv(path, header=True, schema=ARTIST_MAP_SCHEMA, enforceSchema=False, multiLine=line_breaks,
                          escape='"')


def scan_lookup_cache(spark, path, lines=False):
    """Raw (cache_key, value) entries of a JSON map file; a missing file is an empty cache.

    With ``lines`` every text line is a map of its own, which Spark can split.
    """
    try:
        return cache_map(spark.read.text(path, wholetext=not lines), "value")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "cache_key string, value string")
        raise


def cache_map(df, column):
    """Explode a JSON map of text values into (cache_key, value) rows."""
    entries = F.from_json(F.col(column), "map<string,string>")
    return df.select(F.explode(entries).alias("cache_key", "value"))


def scan_frozen_stats(spark, path):
    """Stored statistics as (feature, mean, std); no path means none, a missing file is an error."""
    if not path:
        return None
    return stats_map(spark.read.text(path, wholetext=True), "value")


def stats_map(df, column):
    stored = F.from_json(F.col(column), "map<string,struct<mean:double,std:double>>")
    return df.select(F.explode(stored).alias("feature", "stat")).select("feature", "stat.mean", "stat.std")
