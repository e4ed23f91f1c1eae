"""Checks of aggregates and profiles."""

from pyspark.sql import functions as F

from checks.base import CTE_CACHE, CTE_STATS, query, r6, sql6, tracks_sql
from checks.matching import MATCH, PAIRS
from checks.sinks import supplier_match
from vectormart.fixed_values import FEATURES
from vectormart.operators import lookup as L
from vectormart.operators import mart as M
from vectormart.operators import names as N
from vectormart.operators import profile as P
from vectormart.operators import staging as S
from vectormart.operators import worklist as W
from vectormart.session import written


@query("feature_stats", tracks_sql("select " + ", ".join(
    f"{sql6(f + end, 9)} as {f}{end}" for f in FEATURES for end in ("_mean", "_std")) + " from stats", CTE_STATS))
def feature_stats(t):
    stats = M.feature_stats(t.tracks)
    return stats.select(*[r6(F.col(c), 9).alias(c) for c in stats.columns])


@query("distinct_pairs", tracks_sql("select distinct artist, album from tracks"))
def distinct_pairs(t):
    return L.distinct_pairs(t.tracks)


@query("row_count", "select count(*) as n from lineitem")
def row_count(t):
    return P.row_count(t.lineitem)


@query("cache_stats", tracks_sql("""
select count(*) filter (status = 'hit') as hits, count(*) filter (status = 'miss') as misses,
  count(*) filter (status = 'retry') as retries, count(*) filter (status <> 'retry') as resolved,
  round(100.0 * count(*) filter (status = 'hit') / count(*) filter (status <> 'retry'), 6) as hit_pct,
  (select count(distinct cache_key) from pairs where cache_key not in (select cache_key from cache)) as not_looked_up
from cache""", CTE_CACHE, PAIRS))
def cache_stats(t):
    return L.cache_stats(t.cache, L.distinct_pairs(t.tracks)).withColumn("hit_pct", r6(F.col("hit_pct")))


@query("run_summary", """
select count(*) filter (o_orderstatus = 'F') as ok,
  count(*) filter (o_orderstatus = 'O' and o_orderpriority <> '1-URGENT') as skip,
  count(*) filter (o_orderstatus = 'P' and o_orderpriority <> '1-URGENT') as fail
from orders""")
def run_summary(t):
    s, urgent = F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"
    status = F.when(s == "F", "ok").when(urgent, "dry-run").when(s == "O", "skip").otherwise("fail(1)")
    return W.run_summary(t.orders.select(status.alias("status")))


@query("selection_summary", f"""with {MATCH},
hit as (select path from dirs where lower(artist_dir) in (select k from targets))
select (select count(*) from dirs) as artist_dirs_total, (select count(*) from hit) as artists_matched,
  (select count(distinct concat(l_orderkey, '-', l_linenumber)) from lineitem join supplier on l_suppkey = s_suppkey
   where concat('/lib/', s_name) in (select path from hit)) as files_selected""")
def selection_summary(t):
    dirs, targets, _ = supplier_match(t)
    files = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(
        "concat('/lib/', s_name) as dir_path", "concat(l_orderkey, '-', l_linenumber) as path")
    matched = N.match_artists(dirs, targets)
    return N.selection_summary(dirs, matched, N.select_files(files, matched))


@query("files_per_dir", "select cast(o_custkey as varchar) as dir_path, count(*) as files_in_dir from orders group by 1")
def files_per_dir(t):
    return N.files_per_dir(t.orders.select(F.col("o_custkey").cast("string").alias("dir_path")))


@query("coverage_profile", tracks_sql(f"""
select count(*) as tracks, count(distinct artist) as artists, count(distinct album) as albums,
  {sql6("avg(duration_sec / 60.0)")} as avg_minutes, min(bpm) as min_bpm, max(bpm) as max_bpm,
  min(date) as min_date, max(date) as max_date from tracks"""))
def coverage_profile(t):
    return P.coverage_profile(t.tracks).withColumn("avg_minutes", r6(F.col("avg_minutes")))


@query("format_counts", "select p_type as codec, count(*) as n from part group by 1")
def format_counts(t):
    return P.format_counts(t.part.withColumnRenamed("p_type", "codec"))


NULLABLE = ("title", "date", "genre", "key_key", "bpm")


@query("null_profile", tracks_sql(" union all ".join(
    f"select '{c}' as column_name, count(*) - count({c}) as missing, "
    f"{sql6(f'100.0 * (count(*) - count({c})) / count(*)')} as missing_pct from tracks" for c in NULLABLE)))
def null_profile(t):
    return P.null_profile(t.tracks, NULLABLE).withColumn("missing_pct", r6(F.col("missing_pct")))


@query("top_values", tracks_sql("""
(select 'genre' as what, genre as value, count(*) as n from tracks group by 2 order by n desc, value nulls last limit 5)
union all
(select 'key', concat(coalesce(key_key, '?'), ' ', key_scale), count(*) as n from tracks group by key_key, key_scale
 order by n desc, key_key nulls last, key_scale limit 5)"""))
def top_values(t):
    genres = P.top_values(t.tracks, 5, "genre").select(F.lit("genre").alias("what"), F.col("genre").alias("value"), "n")
    keys = P.top_values(t.tracks, 5, "key_key", "key_scale").select(
        F.lit("key"), F.concat_ws(" ", F.coalesce("key_key", F.lit("?")), "key_scale"), "n")
    return genres.unionAll(keys)


@query("feature_quantiles", tracks_sql(" union all ".join(
    f"select '{f}' as feature, cast({p} as double) as p, {sql6(f'quantile_cont({f}, {p})')} as quantile from tracks"
    for f in FEATURES for p in (0.1, 0.5, 0.9))))
def feature_quantiles(t):
    stored = written(t.tracks.select(*FEATURES))  # quantiles are taken of a stored mart
    return P.feature_quantiles(stored).withColumn("quantile", r6(F.col("quantile")))


@query("price_quantiles", " union all ".join(
    f"select '{c}' as feature, cast({p} as double) as p, {sql6(f'quantile_cont({c}, {p})')} as quantile from lineitem"
    for c in ("l_quantity", "l_extendedprice") for p in (0.0, 0.1, 0.333, 0.5, 0.9, 1.0)))
def price_quantiles(t):
    """The same on a larger table with heavy repeats and both extremes."""
    found = P.feature_quantiles(t.lineitem, (0.0, 0.1, 0.333, 0.5, 0.9, 1.0), ("l_quantity", "l_extendedprice"), 1000)
    return found.withColumn("quantile", r6(F.col("quantile")))


COPIES_SQL = """copies as (select t.*, c.nr as copy_nr from tracks t cross join
  (select 0 as nr union all select 1 union all select 2) c)"""


@query("model_row_counts", tracks_sql("""
select 'flat' as model, count(*) as n from copies
union all select 'staged', count(*) from copies where coalesce(genre, '') not in ('Comedy', 'Books & Spoken')
union all select 'unique', count(distinct file_hash) from copies
  where coalesce(genre, '') not in ('Comedy', 'Books & Spoken')
union all select 'mart', count(distinct file_hash) from copies
  where coalesce(genre, '') not in ('Comedy', 'Books & Spoken')""", COPIES_SQL))
def model_row_counts(t):
    flat = t.copies
    staged = S.exclude_genres(flat)
    unique = S.dedup_latest(staged, duration="track_seconds")
    return P.model_row_counts({"flat": flat, "staged": staged, "unique": unique, "mart": M.audio_mart(unique)})
