"""Feature statistics and standard scores."""

from pyspark.sql import functions as F

from vectormart import fixed_values as V
from vectormart.functions.vectors import frozen_z, live_z, vector_raw

ID_COLUMNS = ("file_hash", "artist", "album", "title", "date", "genre", "key_key", "key_scale", "key_strength",
              "features_version")


def feature_stats(df, features=V.FEATURES):
    """Mean and sample deviation of every feature, one row, one pass over the data."""
    return df.agg(*[
        stat for f in features
        for stat in (F.avg(f).alias(f + "_mean"), F.stddev_samp(f).alias(f + "_std"))
    ])


def stats_table(stats_row, features=V.FEATURES):
    """The one-row statistics as a table of (feature, mean, std), NULL stored as 0.0."""
    entries = F.array(*[
        F.struct(
            F.lit(f).alias("feature"),
            F.coalesce(F.col(f + "_mean"), F.lit(0.0)).alias("mean"),
            F.coalesce(F.col(f + "_std"), F.lit(0.0)).alias("std"),
        )
        for f in features
    ])
    return stats_row.select(F.inline(entries))


def with_stats(df, stats_row, features=V.FEATURES):
    """Put the one-row statistics beside every row.

    The row is a scalar subquery, computed once and inlined: neither side is shuffled.
    """
    names = [f + s for f in features for s in ("_mean", "_std")]
    one = stats_row.select(F.struct(*names).alias("s")).scalar()
    return df.withColumn("_stats", one).select(
        *[F.col(c) for c in df.columns], *[F.col("_stats")[n].alias(n) for n in names]
    )


def z_columns(features=V.FEATURES):
    """Standard scores of a row that carries its statistics."""
    return [live_z(F.col(f), F.col(f + "_mean"), F.col(f + "_std")).alias(f + "_z") for f in features]


def vector_columns(features=V.FEATURES, profile=V.VECTOR_PROFILE):
    return [
        vector_raw().alias("vector_raw"),
        F.array(*[F.col(f + "_z") for f in features]).alias("vector_z"),
        F.lit(profile).alias("vector_profile"),
        F.lit(len(features)).alias("vector_dim"),
    ]


def audio_mart(unique, profile=V.VECTOR_PROFILE, stats_row=None):
    """The vector mart: 37 columns per unique track.

    ``unique`` is read twice (statistics, then scores); hand in a written table, or
    the statistics themselves, when its plan is expensive.
    """
    numeric = [f for f in V.FEATURES]
    for name, kind in (("features_version", "string"),):
        if name not in unique.columns:
            unique = unique.withColumn(name, F.lit(None).cast(kind))
    base = unique.select(
        *[F.col(c) for c in ID_COLUMNS if c != "key_strength"],
        *[F.col(f).try_cast("double").alias(f) for f in numeric],
    )
    if stats_row is None:
        stats_row = feature_stats(base)
    scored = with_stats(base, stats_row).select("*", *z_columns())
    raw = [f for f in V.FEATURES if f != "key_strength"]
    return scored.select(
        *ID_COLUMNS, *raw, *[f + "_z" for f in V.FEATURES], *vector_columns(profile=profile)
    )


def frozen_zscore(df, frozen, features=V.FEATURES):
    """Vectors scored with stored statistics, given as rows of (feature, mean, std).

    A feature missing from the table counts as mean 0 and std 0, which divides by one.
    """
    zero = F.lit(0.0)
    row = frozen.agg(*[
        F.coalesce(F.max(F.when(F.col("feature") == f, F.col(stat))), zero).alias(f"{f}_{stat}")
        for f in features for stat in ("mean", "std")
    ])
    vector = F.array(*[frozen_z(F.col(f), F.col(f + "_mean"), F.col(f + "_std")) for f in features])
    return with_stats(df, row, features).select(*df.columns, vector.alias("vector"))
