"""Words for numbers, and the sentence set that describes a track."""

from pyspark.sql import functions as F

from vectormart import fixed_values as V
from vectormart.functions.text import blank_to_null, strip, year_of


def bucket_label(value, buckets):
    """Label of the first bucket whose upper bound lies above the value; NULL and NaN have none."""
    label = F.when(value.isNull() | F.isnan(value), F.lit(None).cast("string"))
    for bound, name in buckets:
        if bound is None:
            return label.otherwise(F.lit(name))
        label = label.when(value < F.lit(float(bound)), F.lit(name))
    return label


def tempo_label(bpm):
    return bucket_label(bpm, V.TEMPO_BUCKETS)


def energy_label(loudness):
    return bucket_label(loudness, V.ENERGY_BUCKETS)


def groove_label(danceability):
    return bucket_label(danceability, V.GROOVE_BUCKETS)


def dynamics_label(loudness_range):
    return bucket_label(loudness_range, V.DYNAMICS_BUCKETS)


def key_phrase(key, scale):
    """Key with the mood of its scale; empty without a key."""
    phrase = F.when(F.coalesce(key, F.lit("")) == "", F.lit(""))
    for name, mood in V.SCALE_MOODS:
        phrase = phrase.when(F.lower(scale) == name, F.concat(key, F.lit(f" {name}, {mood}")))
    return phrase.otherwise(strip(F.concat(key, F.lit(" "), F.coalesce(scale, F.lit("")))))


def or_default(value, default):
    return F.coalesce(blank_to_null(value), F.lit(default))


def track_document(t=F.col):
    """Describe a track in sentences; a missing number drops its sentence.

    ``t`` maps a column name to a column, so the inputs may live inside a struct.
    """

    def sentence(head, label, tail="."):
        return F.concat(F.lit(head), label, tail if not isinstance(tail, str) else F.lit(tail))

    whole_bpm = F.bround(t("bpm"), 0).try_cast("bigint").cast("string")
    opening = F.concat(
        or_default(t("title"), V.UNKNOWN_TITLE), F.lit(" by "),
        or_default(t("artist"), V.UNKNOWN_ARTIST), F.lit(", from the album "),
        or_default(t("album"), V.UNKNOWN_ALBUM), F.lit(" ("),
        year_of(t("date"), V.UNKNOWN_YEAR), F.lit(")."),
    )
    numbers = [
        sentence("Tempo: ", tempo_label(t("bpm")), F.concat(F.lit(" at "), whole_bpm, F.lit(" BPM."))),
        sentence("Energy: ", energy_label(t("loudness_integrated"))),
        sentence("Groove: ", groove_label(t("danceability"))),
        sentence("Dynamics: ", dynamics_label(t("loudness_range"))),
    ]
    # One space separates the slots, and the slot of a missing number stays empty.
    slots = [F.coalesce(n, F.lit("")) for n in numbers]
    head = F.concat_ws(
        " ", opening,
        F.concat(F.lit("Genre: "), or_default(t("genre"), V.UNKNOWN_GENRE), F.lit(".")),
        F.concat(F.lit("Key: "), key_phrase(t("key_key"), t("key_scale")), F.lit(".")),
    )
    return strip(F.concat_ws(" ", head, *slots))
