"""Lists, lookups and cards over the mart."""

from pyspark.sql import functions as F

from vectormart import fixed_values as V
from vectormart.functions.labels import or_default
from vectormart.functions.text import blank_to_null, strip, year_of
from vectormart.session import measured

LIST_COLUMNS = ("file_hash", "artist", "album", "title", "date", "genre", "key_key", "key_scale", "bpm",
                "danceability", "loudness_integrated")


def track_list(mart):
    """The catalog columns ordered by artist, title and key."""
    return mart.select(*LIST_COLUMNS).orderBy(
        F.col("artist").asc_nulls_last(), F.col("title").asc_nulls_last(), F.col("file_hash").asc_nulls_last()
    )


def point_lookup(df, key, value):
    """One row by its key; the predicate reaches the Parquet scan."""
    return df.filter(F.col(key) == value).limit(1)


def point_lookups(df, key, wanted):
    """Rows of many keys at once, given as a table with the key column."""
    return df.join(measured(wanted.select(key).distinct()), key, "left_semi")


def payload_filter(df, **equals):
    """Rows whose payload equals every given value; a value of None sets no condition."""
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def artists(tracks):
    return tracks.select("artist").filter(blank_to_null(F.col("artist")).isNotNull()).distinct().orderBy("artist")


def albums_of(tracks, artist):
    of = tracks.filter(F.col("artist") == artist)
    return of.select("album").filter(blank_to_null(F.col("album")).isNotNull()).distinct().orderBy("album")


def tracks_of(tracks, artist, album):
    """Labelled tracks of an album; an equal label resolves to its first track."""
    label = or_default(F.col("title"), V.UNKNOWN_LABEL)
    of = tracks.filter((F.col("artist") == artist) & (F.col("album") == album))
    return of.groupBy(label.alias("label")).agg(F.min("file_hash").alias("file_hash")).orderBy("label")


def cascade_choices(tracks):
    """Every choice of the artist, album and track cascade in one table.

    ``tracks_of`` answers one chosen album; this resolves all of them together.
    """
    named = tracks.filter(
        blank_to_null(F.col("artist")).isNotNull() & blank_to_null(F.col("album")).isNotNull()
    )
    label = or_default(F.col("title"), V.UNKNOWN_LABEL)
    return named.groupBy("artist", "album", label.alias("label")).agg(F.min("file_hash").alias("file_hash"))


def random_track(df, seed=None):
    """One uniformly random row."""
    return df.orderBy(F.rand(seed)).limit(1)


def key_text(t=F.col):
    both = strip(F.concat(F.coalesce(t("key_key"), F.lit("")), F.lit(" "), F.coalesce(t("key_scale"), F.lit(""))))
    return F.coalesce(blank_to_null(both), F.lit(V.DASH))


def track_card(df):
    """Display columns of each row; carries artwork and score through when present."""
    extra = [c for c in ("query_id", "rank", "role", "artwork_url", "score") if c in df.columns]
    return df.select(
        *extra, "file_hash", "title", "artist", "album",
        year_of(F.col("date"), V.DASH).alias("year"),
        or_default(F.col("genre"), V.DASH).alias("genre"),
        key_text().alias("key"),
    )


WHOLE_FROM = float(1 << 52)


def one_decimal(value):
    """Number with one decimal, rounded from its exact binary value; a dash when missing.

    Ten times the number is held as a sum and its rounding error, so that 0.25 goes to
    the even 0.2 while 13.45, which is stored a little below that, goes to 13.4.  From
    2^52 on a double has no fraction and is printed as it is; infinity is "inf".
    """
    size = F.when(F.abs(value) < WHOLE_FROM, F.abs(value))
    eight, two = size * 8.0, size * 2.0
    tenfold = eight + two
    rest = tenfold - eight
    error = (eight - (tenfold - rest)) + (two - rest)
    whole = F.floor(tenfold)
    above = tenfold - whole - 0.5
    up = (above > 0) | ((above == 0) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2)) == 1))))
    tenths = whole + F.when(up, 1).otherwise(0)
    text = F.concat(F.when(value < 0, "-").otherwise(""), F.format_string("%.1f", tenths / 10.0))
    endless = F.abs(value) == float("inf")
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(V.DASH))
        .when(endless, F.when(value < 0, "-inf").otherwise("inf"))
        .when(F.abs(value) >= WHOLE_FROM, F.format_string("%.1f", value))
        .otherwise(text)
    )


def feature_inspector(df):
    """Five shown features per track as (file_hash, position, feature, display) rows."""
    # Shown features and their headings.
    shown = (
        ("BPM", one_decimal(F.col("bpm"))),
        ("Danceability", one_decimal(F.col("danceability"))),
        ("Loudness (LUFS)", one_decimal(F.col("loudness_integrated"))),
        ("Key", or_default(F.col("key_key"), V.DASH)),
        ("Scale", or_default(F.col("key_scale"), V.DASH)),
    )
    rows = F.array(*[F.struct(F.lit(name).alias("feature"), text.alias("display")) for name, text in shown])
    return df.select("file_hash", F.posexplode(rows).alias("position", "cell")).select(
        "file_hash", "position", "cell.feature", "cell.display"
    )
