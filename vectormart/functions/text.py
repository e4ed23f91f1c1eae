"""String expressions.  All run inside the JVM except the accent folding helper."""

import functools

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vectormart.fixed_values import WHITESPACE, WHITESPACE_CLASS


def strip(text) -> Column:
    """Remove white space of any alphabet from both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def strip_item(item) -> Column:
    """``strip`` for a lambda variable: most words show no white space at either end."""
    def is_space(edge):
        return F.contains(F.lit(WHITESPACE), edge)

    one = F.lit(1)
    return F.when(is_space(F.left(item, one)) | is_space(F.right(item, one)), strip(item)).otherwise(item)


def blank_to_null(text) -> Column:
    return F.nullif(text, F.lit(""))


def collapse_ws(text) -> Column:
    """Strip, and turn each inner run of white space into one space."""
    return F.trim(F.regexp_replace(text, WHITESPACE_CLASS + "+", " "))


def strip_feat(text) -> Column:
    """Cut a trailing guest credit such as " feat. X", " featuring X" or " ft. X"."""
    # Fixed value: the words that open a guest credit.
    return F.regexp_replace(text, rf"(?i){WHITESPACE_CLASS}+(feat\.?|featuring|ft\.){WHITESPACE_CLASS}+.*$", "")


def strict_key(name) -> Column:
    """Matching key that keeps accents and punctuation."""
    return F.lower(collapse_ws(strip_feat(name)))


@functools.cache
def _accents():
    """A pattern of all characters that combine with the one before them, derived from the character tables."""
    import sys
    import unicodedata

    points = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    starts = [c for c in points if not unicodedata.combining(chr(c - 1))]
    ends = [c for c in points if not unicodedata.combining(chr(c + 1))]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]+"


def ascii_fold(text) -> Column:
    """Decompose letters, drop their accents, lower-case; NULL becomes empty."""

    @F.arrow_udf("string")
    def drop_accents(texts: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        foreign = pc.invert(pc.string_is_ascii(texts))
        if not pc.any(foreign, min_count=0).as_py():
            return texts
        letters = pc.utf8_normalize(texts.filter(foreign), form="NFKD")
        return pc.replace_with_mask(texts, foreign, pc.replace_substring_regex(letters, _accents(), ""))

    return F.lower(drop_accents(F.coalesce(text, F.lit(""))))


def lenient_key(name) -> Column:
    """Matching key of letters a-z and digits only; "&" and "+" read as "and"."""
    folded = F.regexp_replace(ascii_fold(name), "[&+]", " and ")
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def name_key(name, lenient=False) -> Column:
    return lenient_key(name) if lenient else strict_key(name)


def file_ext(path) -> Column:
    """Lower-case extension of the last path part, empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def short_hash(path) -> Column:
    return F.substring(F.sha1(path), 1, 8)


def output_name(path) -> Column:
    """Name of the document extracted from a file: stem, short hash, ".json"."""
    base = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")
    return F.concat(stem, F.lit("-"), short_hash(path), F.lit(".json"))


def relative_path(path, root) -> Column:
    """The part of a path below a root folder."""
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(top)), F.substr(path, F.lit(len(top) + 1))).otherwise(path)


def top_dir(rel_path) -> Column:
    """First folder of a relative path; NULL for a file that lies in the root itself."""
    return F.when(F.contains(rel_path, F.lit("/")), F.split(rel_path, "/", 2)[0])


def year_of(date, default=None) -> Column:
    year = blank_to_null(F.split(F.coalesce(date, F.lit("")), "-", 2)[0])
    return year if default is None else F.coalesce(year, F.lit(default))


def cache_key(artist, album) -> Column:
    """Normalised artist and album, joined by a bar."""
    return F.concat(strip(F.lower(artist)), F.lit("|"), strip(F.lower(album)))


def clean_album(album) -> Column:
    """Cut disc numbers, live notes and edition notes from an album name."""
    ws = WHITESPACE_CLASS + "*"
    # The four cuts, applied in this order.
    cuts = (
        rf"(?i){ws}[\(\[]disc{ws}\d+[\)\]]",
        rf"(?i){ws}[\(\[](live|.*?live.*?)[\)\]]$",
        rf"(?i){ws}-{ws}(EP|Single|Remaster(ed)?|Deluxe.*|Expanded.*|Anniversary.*)$",
        rf"(?i){ws}[\(\[](Remaster(ed)?|Deluxe.*|Expanded.*|Anniversary.*)[\)\]]",
    )
    for cut in cuts:
        album = F.regexp_replace(album, cut, "")
    return strip(album)


def search_term(artist, album) -> Column:
    """Percent-encoded "artist album" with the slash kept."""
    term = F.url_encode(F.concat(artist, F.lit(" "), clean_album(album)))
    for found, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        term = F.replace(term, F.lit(found), F.lit(wanted))
    return term


def key_label(key, scale) -> Column:
    return F.concat(F.coalesce(key, F.lit("")), F.lit("-"), F.coalesce(scale, F.lit("")))
