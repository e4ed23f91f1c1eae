"""Lenient number parsing and the rounding rules of the typed staging row."""

from pyspark.sql import functions as F

from vectormart.functions.text import strip

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INTEGER = r"^[+-]?\d+$"


def to_double(text):
    """Text to double; anything that is not a plain decimal number becomes NULL."""
    trimmed = strip(text)
    return F.when(F.rlike(trimmed, F.lit(_NUMBER)), trimmed.try_cast("double"))


def lenient_int(text):
    """Whole number from text such as "03/12", " 7 " or "3.0"; NULL otherwise."""
    head = strip(F.split(text, "/", 2)[0])
    whole = F.when(F.rlike(head, F.lit(_INTEGER)), head.try_cast("bigint"))
    return F.coalesce(whole, to_double(text).try_cast("bigint"))


def cast_whole(value, data_type, kind="bigint"):
    """Typed whole number; NULL when it does not fit.

    Halves go to the even neighbour for numbers and away from zero for text.
    """
    number = F.round(to_double(value)) if data_type == "string" else F.rint(value.cast("double"))
    return number.try_cast(kind)


def json_double(text):
    """Double from the text of a JSON value; a type suffix, which Java accepts, is no number."""
    return F.when(~F.right(text, F.lit(1)).isin("d", "D", "f", "F"), text.try_cast("double"))


def cast_double(value, data_type):
    return to_double(value) if data_type == "string" else value.try_cast("double")


def rounded(value, digits):
    """Score as shown to a user; ties go away from zero."""
    return F.round(value, digits)
