"""Keyed vector collections in hash buckets of the id.

The points of a collection lie in one partitioned Parquet dataset, a partition for each bucket.  An upsert reads the buckets
that its ids fall into, lays its points over theirs, and overwrites those partitions and no others; so a reader scans
one dataset and merges nothing.  Work is proportional to the touched buckets: a few points touch few.

Every bucket also holds a mark for every named writer, the number of the last batch of it that the bucket has taken.  Points
and marks of a bucket are replaced together, so a batch that is delivered again is dropped bucket by bucket, whatever was
written in between, and one that was broken off half way is finished by a repetition.  Writers take turns; two that
overwrite one bucket at the same time would lose points of one of them.
"""

import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vectormart import fixed_values as V
from vectormart.functions.text import blank_to_null
from vectormart.functions.vectors import norm, point_id, valid_vector, vector_raw
from vectormart.operators.catalog import payload_filter, point_lookups
from vectormart.operators.knn import exact_knn, with_payload
from vectormart.operators.mart import frozen_zscore
from vectormart.session import path_exists, written

ABOUT = "dim int, metric string, buckets int, columns string"
# Payload fields that results must have.
AUDIO_PAYLOAD = ("file_hash", "artist", "album", "title", "date", "genre", "key_key", "key_scale",
                 "features_version", "vector_profile")
TEXT_PAYLOAD = ("file_hash", "artist", "album", "title", "date", "genre", "key_key", "key_scale", "doc")


def audio_points(mart, kind="z", frozen=None):
    """Points of the 12-dimension collection: the stored z vector, one scored with
    stored statistics, or the raw features."""
    if kind == "raw":
        vectors = mart.withColumn("vector", vector_raw())
    elif frozen is not None:
        vectors = frozen_zscore(mart, frozen)
    else:
        vectors = mart.withColumn("vector", F.col("vector_z"))
    return vectors.select(point_id(F.col("file_hash")).alias("id"), "vector", *AUDIO_PAYLOAD)


def text_points(tracks, vectors):
    """Points of the text collection: described tracks with the vectors of their texts."""
    payload = tracks.withColumn("date", F.coalesce("date", F.lit(""))).select(*TEXT_PAYLOAD)
    return payload.join(vectors.select("file_hash", "vector"), "file_hash").select(
        point_id(F.col("file_hash")).alias("id"), "vector", *TEXT_PAYLOAD
    )


def valid_points(points, dim, key=None):
    """Points with a whole vector of the right length and a non-empty key."""
    kept = points.filter(valid_vector(F.col("vector"), dim) & F.col("id").isNotNull())
    return kept if key is None else kept.filter(blank_to_null(F.col(key)).isNotNull())


def last_per_id(points, seq=None):
    """One row per id, the last by ``seq``; partial aggregation thins a repeated id before the shuffle."""
    names = [c for c in points.columns if c not in ("id", seq)]
    row = F.struct(*names)
    pick = F.max_by(row, F.col(seq)) if seq else F.max(row)
    return points.groupBy("id").agg(pick.alias("r")).select("id", *[F.col("r")[n].alias(n) for n in names])


def lay_over(old, new):
    """Old rows without those that new rows replace, and the new rows."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


class Collection:
    """One collection; ``path`` is a folder on storage that all executors share."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path.rstrip("/")

    def _about(self):
        """Dimension, metric, buckets and columns, or None if there is no collection."""
        if not path_exists(self.spark, self.path + "/about"):
            return None
        return self.spark.read.schema(ABOUT).parquet(self.path + "/about").first()

    def _present(self):
        about = self._about()
        if about is None:
            raise ValueError(f"no collection at {self.path}")
        return about

    def init(self, dim, metric, payload, id_type="decimal(20,0)", buckets=16):
        """Create the collection unless it exists; ``payload`` is a DDL list of columns.

        Choose ``buckets`` so that one of them is a good file or a few: about as many as the collection has GB.
        """
        if self._about() is not None:
            return False
        self.recreate(dim, metric, payload, id_type, buckets)
        return True

    def recreate(self, dim, metric, payload, id_type="decimal(20,0)", buckets=16):
        """Start again from an empty collection."""
        if metric not in ("cosine", "dot"):
            raise ValueError(f"unknown metric {metric}")
        columns = f"id {id_type}, vector array<double>, {payload}, norm double, _writer string, _number bigint, bucket int"
        schema = StructType.fromDDL(columns)
        self._rows(0, schema).write.mode("overwrite").partitionBy("bucket").parquet(self.path + "/points")
        self._rows(1, StructType.fromDDL(ABOUT), (dim, metric, buckets, schema.json())).write.mode("overwrite").parquet(self.path + "/about")

    def _rows(self, n, schema, values=None):
        """n equal rows of a schema, built inside Spark."""
        return self.spark.range(0, n, 1, 1).select(
            *[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(schema, values or [None] * len(schema))])

    def _stored(self, about):
        """Points and marks; a mark has no id."""
        schema = StructType.fromJson(json.loads(about["columns"]))
        return self.spark.read.schema(schema).parquet(self.path + "/points")

    def _replace(self, rows, spread=True):
        """Overwrite the buckets of ``rows`` and no others; a large bucket is written by several tasks."""
        (rows.hint("rebalance", F.col("bucket")) if spread else rows).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path + "/points")

    def upsert(self, points, seq=None, key=None, batch=None, writer=None):
        """Insert points or replace those of the same id; returns the number of ids written.

        Points without a valid vector or key are skipped; of several for one id the last by ``seq`` counts.  ``writer`` names who writes and
        ``batch`` is its growing number: a bucket that has taken this batch or a later one of the writer is left alone.  A
        ``batch`` without a writer is a name of its own that is written once; its mark stays for good, so use numbers for many.
        """
        about = self._present()
        if batch is not None and writer is None:
            writer, batch = batch, 0
        good = last_per_id(valid_points(points, about["dim"], key), seq)
        vector = F.col("vector").cast("array<double>")
        new = good.withColumn("vector", vector).withColumn("norm", norm(F.col("vector"))).withColumn("bucket", self._bucket(about))
        new = written(new, "upsert")
        # One row for each bucket at most.
        touched = {r["bucket"]: r["count"] for r in new.groupBy("bucket").count().collect()}
        stored = self._stored(about)
        if writer is not None and touched:
            taken = stored.filter(F.col("id").isNull() & (F.col("_writer") == writer) & (F.col("_number") >= batch) & F.col("bucket").isin(*touched))
            for r in taken.select("bucket").distinct().collect():
                del touched[r["bucket"]]
        if not touched:
            return 0
        new = new.filter(F.col("bucket").isin(*touched))
        old = stored.filter(F.col("bucket").isin(*touched))
        rows = lay_over(old.filter("id is not null"), new.withColumns({"_writer": F.lit(None).cast("string"), "_number": F.lit(None).cast("bigint")}))
        others = old.filter(F.col("id").isNull() & ~F.col("_writer").eqNullSafe(F.lit(writer)))
        rows = rows.unionByName(others)
        if writer is not None:
            marks = self._rows(1, stored.schema, [writer if c == "_writer" else batch if c == "_number" else None for c in stored.columns])
            rows = rows.unionByName(marks.withColumn("bucket", F.explode(F.array(*[F.lit(b) for b in sorted(touched)]))))
        self._replace(rows)
        return sum(touched.values())

    def _bucket(self, about):
        return F.pmod(F.xxhash64("id"), F.lit(about["buckets"])).cast("int")

    def read(self):
        """The current points."""
        return self._stored(self._present()).filter("id is not null").drop("_writer", "_number", "bucket")

    def compact(self):
        """Write every bucket anew, so that its files are few and large; points and marks stay."""
        self._replace(self._stored(self._present()))

    def info(self):
        """Dimension, metric and number of points."""
        about = self._present()
        return self.read().agg(F.count("*").alias("points")).select(
            F.lit(about["dim"]).alias("dim"), F.lit(about["metric"]).alias("metric"), "points")

    def similar(self, keys, k, key="file_hash", **wanted):
        """(query_id, rank, id, score, file_hash, artist, title, album, genre, key) of the k points most like each key's.

        ``keys`` is a table with the keys in its column ``key``; ``wanted`` are payload values that hits must have, checked before
        the search.  A key that is not stored has no hits; like any point, the key's own is its own best hit.
        """
        about, points = self._present(), self.read()
        seeds = point_lookups(points, key, keys.select(key).distinct())
        queries = seeds.select(F.col(key).alias("query_id"), "vector")
        hits = exact_knn(payload_filter(points, **wanted), queries, k, about["dim"], metric=about["metric"])
        placed = with_payload(hits, points.drop("vector", "norm"))
        tone = F.concat_ws("-", F.coalesce("key_key", F.lit("")), F.coalesce("key_scale", F.lit("")))
        return placed.select("query_id", "rank", "id", "score", "file_hash", "artist", "title", "album", "genre", tone.alias("key"))


def collection_upsert(old, new, dim, seq=None):
    """Upsert as a plain table operation: ``new`` valid points laid over ``old``."""
    return lay_over(old, last_per_id(valid_points(new, dim), seq))


