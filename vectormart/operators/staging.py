"""From nested documents to typed, filtered, de-duplicated rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vectormart import fixed_values as V
from vectormart.functions import documents as D
from vectormart.functions.numbers import cast_double, cast_whole, json_double, lenient_int


def flatten_features(docs, doc="doc", path="json_path", extracted_at="extracted_at"):
    """One flat row of 58 columns per parsed feature document.

    ``docs`` holds the document, its path and its time of extraction.  A single
    projection: no shuffle, no Python.
    """
    def part(where):
        return F.col(f"{doc}.{where}")

    tags = part(V.TAGS_PATH)
    made = {
        "genre_csv": D.list_to_csv(tags, "genre"),
        "key_key": F.col("_key.key"),
        "key_scale": F.col("_key.scale"),
        "key_strength": json_double(F.col("_key.strength")),
        "features_version": F.lit(V.FEATURES_VERSION),
        "json_path": F.col(path),
        "extracted_at": F.col(extracted_at),
    }
    for name in V.STRING_TAGS:
        made[name] = D.first_string(tags, name)
    for name in V.NUMBER_TAGS:
        made[name] = lenient_int(D.json_path(tags, name))
    types = dict(V.FLAT_COLUMNS)
    for name, where in V.DOCUMENT_PATHS.items():
        made[name] = json_double(part(where)) if types[name] == "double" else part(where)
    row = [
        (made[name] if name in made else F.lit(None)).try_cast(kind).alias(name) for name, kind in V.FLAT_COLUMNS
    ]
    return docs.withColumn("_key", D.first_block(part)).select(*row)


def staging_cast(flat):
    """Typed staging row: bad values become NULL, whole numbers round half to even.

    Accepts text or numeric input columns; adds ``duration_min``.
    """
    given = dict(flat.dtypes)
    out = []
    for name, kind in V.FLAT_COLUMNS:
        if name == "source_path" or name not in given:
            continue
        column = F.col(name)
        if name in V.STAGED_WHOLE:
            column = cast_whole(column, given[name], V.STAGED_WHOLE[name])
        elif kind == "double":
            column = cast_double(column, given[name])
        elif kind in ("boolean", "string"):
            column = column.try_cast(kind)
        out.append(column.alias(name))
    staged = flat.select(*out)
    if "duration_sec" in given:
        staged = staged.withColumn("duration_min", duration_min(F.col("duration_sec")))
    return staged


def duration_min(seconds):
    return seconds / F.lit(60.0)


def exclude_genres(df, genre="genre", excluded=V.EXCLUDED_GENRES):
    """Drop the spoken-word genres; rows without a genre stay."""
    return df.filter(~F.coalesce(F.col(genre), F.lit("")).isin(*excluded))


def require_key(df, key="file_hash"):
    """Rows whose key is present and not empty."""
    return df.filter(F.col(key).isNotNull() & (F.col(key) != ""))


def dedup_latest(df, key="file_hash", duration="duration_sec", path="json_path"):
    """One row per key: the longest, then the first path; keeps ``rn``.

    ``rn = 1`` lets Spark cut each key to one row before the shuffle, so a key that
    holds a third of all rows still sends one row per input partition.
    """
    best = Window.partitionBy(key).orderBy(
        F.coalesce(F.col(duration), F.lit(0.0)).desc(), F.col(path).asc_nulls_last()
    )
    return (
        df.filter(F.col(key).isNotNull())
        .withColumn("rn", F.row_number().over(best))
        .filter(F.col("rn") == 1)
    )
