"""Data-quality checks: each returns the failing rows, so an empty result passes."""

from pyspark.sql import functions as F

from vectormart.functions.vectors import has_dim


def check_not_null(df, column):
    return df.filter(F.col(column).isNull())


def check_unique(df, column):
    """Keys that occur more than once, with their count; NULL keys are not compared."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")
    )


def check_dim(df, vector, dim):
    """Rows whose vector is missing or has another length."""
    return df.filter(~has_dim(F.col(vector), dim))


def check_point_ids(df, key, point_id):
    """Identifiers shared by several keys, which would replace each other in a collection."""
    return df.groupBy(point_id).agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key")
    ).filter("first_key <> last_key")
