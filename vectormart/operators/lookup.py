"""Maintenance of the artwork lookup cache.

A cache row is (cache_key, artist, album, artwork_url, status) with status ``hit``,
``miss`` or ``retry``.
"""

from pyspark.sql import functions as F

from vectormart import fixed_values as V
from vectormart.functions.text import blank_to_null, cache_key
from vectormart.operators.names import non_blank

RESPONSE_SCHEMA = "results array<struct<wrapperType:string,artworkUrl100:string>>"


def distinct_pairs(tracks):
    """Distinct, sorted (artist, album) pairs with both parts present."""
    return non_blank(tracks, "artist", "album").select("artist", "album").distinct().orderBy("artist", "album")


def keyed_pairs(pairs):
    return pairs.withColumn("cache_key", cache_key(F.col("artist"), F.col("album")))


def cache_entries(entries):
    """Raw (cache_key, value) entries as cache rows; the key is cut at its first bar."""
    url = F.when(F.col("value") != V.RETRY_MARKER, blank_to_null(F.col("value")))
    status = F.when(F.col("value").isNull(), "miss").when(F.col("value") == V.RETRY_MARKER, "retry")
    cut = F.split("cache_key", r"\|", 2)
    return entries.select(
        "cache_key", cut[0].alias("artist"), F.try_element_at(cut, F.lit(2)).alias("album"),
        url.alias("artwork_url"), status.otherwise(F.when(F.col("value") == "", "miss").otherwise("hit")).alias("status"),
    )


def resolved_entries(cache):
    """The flat table that is stored: everything but entries to be tried again."""
    return cache.filter("status <> 'retry'").select("cache_key", "artist", "album", "artwork_url")


def lookup_pending(pairs, cache):
    """Pairs that are not cached or marked for another try; cached misses stay settled."""
    settled = cache.filter("status <> 'retry'").select("cache_key")
    return keyed_pairs(pairs).join(settled, "cache_key", "left_anti")


def parse_art_response(response):
    """Artwork address of the first collection result that has one, in the wanted size."""
    results = F.from_json(response, RESPONSE_SCHEMA)["results"]
    found = F.filter(
        results,
        lambda r: (r["wrapperType"] == "collection") & (F.coalesce(r["artworkUrl100"], F.lit("")) != ""),
    )
    url = F.try_element_at(found, F.lit(1))["artworkUrl100"]
    return F.replace(url, F.lit(V.ART_SIZE_FOUND), F.lit(V.ART_SIZE_WANTED))


def cache_status(url, failed):
    """``retry`` after an error, ``hit`` with an address, ``miss`` without."""
    return F.when(failed, "retry").when(blank_to_null(url).isNotNull(), "hit").otherwise("miss")


def responses_to_cache(responses, http_ok=200):
    """Cache rows from fetched responses (artist, album, http_status, body).

    A missing or non-OK status is an error, whatever its body holds.
    """
    failed = F.coalesce(F.col("http_status") != http_ok, F.lit(True))
    url = F.when(~failed, parse_art_response(F.col("body")))
    return keyed_pairs(responses).select(
        "cache_key", "artist", "album", url.alias("artwork_url"), cache_status(url, failed).alias("status")
    )


def merge_cache(cache, fresh):
    """Replace cached rows by fresh ones of the same key.

    Fresh rows are few beside the cache, so the cache is filtered in place when their
    keys are small enough to broadcast, and joined on the key otherwise.
    """
    latest = fresh.groupBy("cache_key").agg(
        F.max_by(F.struct("artist", "album", "artwork_url", "status"), F.struct("artist", "album")).alias("r")
    ).select("cache_key", "r.*")
    kept = cache.join(latest.select("cache_key"), "cache_key", "left_anti")
    return kept.unionByName(latest)


def cache_stats(cache, pairs):
    """Hits, misses, retries, resolved, hit share, and keys that were never looked up."""
    h, m, r = (F.count_if(F.col("status") == s) for s in ("hit", "miss", "retry"))
    keys = keyed_pairs(pairs).select("cache_key").distinct()
    known = cache.select("cache_key", "status").withColumn("wanted", F.lit(0))
    missing = (
        keys.join(cache.select("cache_key"), "cache_key", "left_anti")
        .select("cache_key", F.lit(None).cast("string").alias("status"), F.lit(1).alias("wanted"))
    )
    counted = known.unionAll(missing).agg(
        h.alias("hits"), m.alias("misses"), r.alias("retries"),
        F.count_if(F.col("wanted") == 1).alias("not_looked_up"),
    )
    resolved = F.col("hits") + F.col("misses")
    return counted.select(
        "hits", "misses", "retries", resolved.alias("resolved"),
        (100.0 * F.col("hits") / F.nullif(resolved, F.lit(0))).alias("hit_pct"), "not_looked_up",
    )


def attach_artwork(df, cache):
    """Add the cached artwork address of each row's artist and album, NULL without one.

    Only hits are joined.  Spark broadcasts them when their measured size allows it;
    otherwise both sides meet on the key and AQE splits an album that is hot.
    """
    art = cache.filter("status = 'hit'").select(F.col("cache_key").alias("_art_key"), "artwork_url")
    key = cache_key(F.coalesce("artist", F.lit("")), F.coalesce("album", F.lit("")))
    return df.withColumn("_key", key).join(art, F.col("_key") == F.col("_art_key"), "left").drop("_key", "_art_key")
