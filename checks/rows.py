"""Checks of projections, filters and data-quality rules."""

from pyspark.sql import functions as F

from checks.base import CTE_CACHE, CTE_MART, CTE_STATS, FLAT, FLAT_SQL, flat_shown, query, r6, sql6, tracks_sql
from vectormart.fixed_values import FEATURES
from vectormart.functions import documents as D
from vectormart.functions.numbers import lenient_int
from vectormart.operators import catalog, quality
from vectormart.operators import lookup as L
from vectormart.operators import mart as M
from vectormart.operators import staging as S
from vectormart.session import work_folder
from vectormart.sources import readers

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def long_vector(df, vector, digits=6):
    return df.select("file_hash", F.posexplode(vector).alias("position", "value")).select(
        "file_hash", "position", r6(F.col("value"), digits).alias("value"))


@query("json_path_get", """
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, cast(null as varchar) as below, -1 as missing
from events""")
def json_path_get(t):
    doc = F.try_parse_json("props")
    return t.events.withColumn("doc", doc).select(
        "event_id", D.json_path(F.col("doc"), "k", "bigint").alias("k"),
        D.json_path(F.col("doc"), "k.inner").alias("below"),
        F.coalesce(D.json_path(F.col("doc"), "other", "int"), F.lit(-1)).alias("missing"))


@query("first_string", f"""
select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WS})),
  lambda x: x <> '')[1] as first_line, nullif(trim(text, {WS}), '') as whole from documents""")
def first_string(t):
    lines = F.to_json(F.struct(F.split("text", "\n").alias("lines"), F.col("text").alias("whole")))
    docs = t.documents.select("doc_id", F.try_parse_json(lines).alias("doc"))
    return docs.select("doc_id", D.first_string(F.col("doc"), "lines").alias("first_line"),
                       D.first_string(F.col("doc"), "whole").alias("whole"))


@query("list_to_csv", f"""
with words as (select doc_id, trim(w, {WS}) as w, i from (
    select doc_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as i
    from documents) u),
firsts as (select doc_id, w, min(i) as i from words where w <> '' group by doc_id, w)
select d.doc_id, md5(string_agg(w, ', ' order by i)) as words_md5, count(w) as words
from documents d left join firsts f on f.doc_id = d.doc_id group by d.doc_id""")
def list_to_csv(t):
    joined = t.documents.select("doc_id", D.join_distinct(F.split("text", " ")).alias("csv"))
    words = F.coalesce(F.size(F.split("csv", ", ")), F.lit(0)).cast("bigint")
    return joined.select("doc_id", F.md5("csv").alias("words_md5"), words.alias("words"))


@query("lenient_int", """
select o_orderkey, cast(substr(o_orderpriority, 1, 1) as bigint) as part_of, o_orderkey as padded,
  cast(trunc(o_totalprice) as bigint) as decimal_text, cast(null as bigint) as letters from orders""")
def lenient_ints(t):
    c = F.col
    return t.orders.select(
        "o_orderkey", lenient_int(F.replace(c("o_orderpriority"), F.lit("-"), F.lit("/"))).alias("part_of"),
        lenient_int(F.concat(F.lit(" "), c("o_orderkey").cast("string"), F.lit("\t"))).alias("padded"),
        lenient_int(c("o_totalprice").cast("string")).alias("decimal_text"),
        lenient_int(c("o_orderstatus")).alias("letters"))


@query("first_block", tracks_sql("""
select file_hash, case when key_key is not null then key_key when hfc > 25 then '' else 'B' end as key,
  case when key_key is not null then null when hfc > 25 then key_scale else 'minor' end as scale,
  case when key_key is not null then null when hfc > 25 then round(key_strength, 6) end as strength from tracks"""))
def first_block(t):
    c, none = F.col, F.lit(None)

    def block(key, scale, strength):
        return F.struct(key.cast("string").alias("key"), scale.cast("string").alias("scale"),
                        strength.cast("double").alias("strength"))

    high = c("hfc") > 25
    blocks = (
        block(F.coalesce("key_key", F.lit("")), F.lit(""), none),
        block(F.lit(""), F.when(high, c("key_scale")), F.when(high, c("key_strength"))),
        block(F.lit("B"), F.lit("minor"), none),
    )
    best = t.tracks.select("file_hash", *[b.alias(f"b{i}") for i, b in enumerate(blocks)])
    found = best.withColumn("f", D.first_usable([c("b0"), c("b1"), c("b2")]))
    blank_scale = F.nullif(c("f.scale"), F.lit(""))
    return found.select("file_hash", "f.key", blank_scale.alias("scale"), r6(c("f.strength")).alias("strength"))


@query("flatten_features", tracks_sql(f"select {FLAT_SQL}, 58 as n_columns from tracks"))
def flatten_features(t):
    docs = D.parse_documents(t.documents_text())
    flat = S.flatten_features(docs.withColumn("json_path", F.lit("a.json")).withColumn("extracted_at", F.lit("")))
    return flat_shown(flat, F.lit(len(flat.columns)).alias("n_columns"))


@query("provenance_cols", tracks_sql(
    "select count(*) as n, count(*) as stamped, true as located, 'essentia_music_v1' as features_version from tracks"))
def provenance_cols(t):
    folder = work_folder(t.spark, "documents")
    t.documents_text().write.text(folder)
    flat = S.flatten_features(readers.accepted(readers.scan_feature_lines(t.spark, folder)))
    stamp = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{6})?Z$"
    return flat.agg(
        F.count("*").alias("n"), F.count_if(F.rlike("extracted_at", F.lit(stamp))).alias("stamped"),
        F.min(F.contains("json_path", F.lit(folder))).alias("located"), F.max("features_version").alias("features_version"))


@query("staging_cast", """
with flat as (select event_id, case event_type when 'error' then 'x' when 'view' then '' else cast(value as varchar) end
  as v, case event_type when 'click' then 'true' when 'view' then 'f' when 'error' then 'maybe' end as b from events)
select cast(event_id as varchar) as file_hash, try_cast(v as double) as duration_sec,
  try_cast(v as bigint) as sample_rate, try_cast(v as integer) as tracknumber, try_cast(b as boolean) as lossless,
  round(try_cast(v as double) / 60.0, 9) as duration_min from flat""")
def staging_cast(t):
    text = F.when(F.col("event_type") == "error", "x").when(F.col("event_type") == "view", "").otherwise(
        F.col("value").cast("string"))
    flag = F.when(F.col("event_type") == "click", "true").when(F.col("event_type") == "view", "f").when(
        F.col("event_type") == "error", "maybe")
    flat = t.events.select(
        F.col("event_id").cast("string").alias("file_hash"), text.alias("duration_sec"), text.alias("sample_rate"),
        text.alias("tracknumber"), flag.alias("lossless"))
    return S.staging_cast(flat).withColumn("duration_min", r6(F.col("duration_min"), 9))


@query("staging_cast_numbers", """
select cast(event_id as varchar) as file_hash, value as duration_sec, cast(value as bigint) as sample_rate,
  try_cast(value * 1e8 as integer) as tracknumber, round(value / 60.0, 9) as duration_min from events""")
def staging_cast_numbers(t):
    flat = t.events.select(F.col("event_id").cast("string").alias("file_hash"), F.col("value").alias("duration_sec"),
                           F.col("value").alias("sample_rate"), (F.col("value") * 1e8).alias("tracknumber"))
    return S.staging_cast(flat).withColumn("duration_min", r6(F.col("duration_min"), 9))


@query("duration_min", tracks_sql("select file_hash, round(duration_sec / 60.0, 9) as duration_min from tracks"))
def duration_min(t):
    return t.tracks.select("file_hash", r6(S.duration_min(F.col("duration_sec")), 9).alias("duration_min"))


def exploded(names, digits=6):
    return " union all ".join(
        f"select file_hash, cast({i} as int) as position, {sql6(n, digits)} as value from mart"
        for i, n in enumerate(names))


@query("vector_raw", tracks_sql(" union all ".join(
    f"select file_hash, cast({i} as int) as position, {f} as value from tracks" for i, f in enumerate(FEATURES))))
def vector_raw(t):
    from vectormart.functions.vectors import vector_raw as raw

    return t.tracks.select("file_hash", F.posexplode(raw()).alias("position", "value"))


@query("vector_z", tracks_sql(exploded([f + "_z" for f in FEATURES]), CTE_MART))
def vector_z(t):
    return long_vector(t.mart, "vector_z")


@query("vector_profile", tracks_sql("select file_hash, 'audio_v1' as vector_profile, 12 as vector_dim from tracks"))
def vector_profile(t):
    return t.mart.select("file_hash", "vector_profile", "vector_dim")


Z = [f + "_z" for f in FEATURES]


@query("audio_mart", tracks_sql(f"""
select file_hash, artist, album, title, date, genre, key_key, key_scale, key_strength,
  cast(null as varchar) as features_version, {", ".join(FLAT)},
  {", ".join(f"{sql6(z)} as {z}" for z in Z)},
  {sql6("list_sum([" + ", ".join(FEATURES) + "])")} as raw_sum, {sql6("list_sum(vector_z)", 5)} as z_sum,
  'audio_v1' as vector_profile, 12 as vector_dim, 37 as n_columns from mart""", CTE_MART))
def audio_mart(t):
    mart = t.mart

    def total(v, digits):
        return r6(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), digits)

    return mart.select(
        *M.ID_COLUMNS, *FLAT, *[r6(F.col(z)).alias(z) for z in Z], total("vector_raw", 6).alias("raw_sum"),
        total("vector_z", 5).alias("z_sum"), "vector_profile", "vector_dim", F.lit(len(mart.columns)).alias("n_columns"))


@query("stats_cross_join", tracks_sql(
    "select file_hash, " + ", ".join(f"{sql6(f + s, 9)} as {f}{s}" for f in FEATURES for s in ("_mean", "_std"))
    + " from mart2", CTE_MART + ", mart2 as (select t.file_hash, s.* from tracks t cross join stats s)"))
def stats_cross_join(t):
    joined = M.with_stats(t.tracks, M.feature_stats(t.tracks))
    return joined.select("file_hash", *[r6(F.col(f + s), 9).alias(f + s) for f in FEATURES for s in ("_mean", "_std")])


@query("frozen_zscore", tracks_sql(exploded([
    f"coalesce(({f} - {f}_mean) / nullif({f}_std, 0), {f} - {f}_mean)" for f in FEATURES
]), CTE_STATS + ", mart as (select t.*, s.* from tracks t cross join stats s)"))
def frozen_zscore(t):
    frozen = M.stats_table(M.feature_stats(t.tracks))
    return long_vector(M.frozen_zscore(t.tracks, frozen), "vector")


@query("track_card", tracks_sql("""
select t.file_hash, title, t.artist, t.album, coalesce(string_split(date, '-')[1], '\u2014') as year,
  coalesce(genre, '\u2014') as genre, trim(concat(coalesce(key_key, ''), ' ', key_scale)) as key, artwork_url
from tracks t left join (select * from cache where status = 'hit') c
  on cache_key = concat(lower(trim(t.artist)), '|', lower(trim(t.album)))""", CTE_CACHE))
def track_card(t):
    return catalog.track_card(L.attach_artwork(t.tracks, t.cache))


ONE = "printf('%.1f', {})"


@query("feature_inspector", tracks_sql(f"""
select file_hash, 0 as position, 'BPM' as feature, {ONE.format("bpm")} as display from tracks
union all select file_hash, 1, 'Danceability', {ONE.format("danceability")} from tracks
union all select file_hash, 2, 'Loudness (LUFS)', {ONE.format("loudness_integrated")} from tracks
union all select file_hash, 3, 'Key', coalesce(key_key, '\u2014') from tracks
union all select file_hash, 4, 'Scale', coalesce(key_scale, '\u2014') from tracks"""))
def feature_inspector(t):
    return catalog.feature_inspector(t.tracks)


@query("exclude_genres", tracks_sql(
    "select file_hash, genre from tracks where coalesce(genre, '') not in ('Comedy', 'Books & Spoken')"))
def exclude_genres(t):
    return S.exclude_genres(t.tracks).select("file_hash", "genre")


@query("require_key", tracks_sql("select file_hash, key_key from tracks where key_key is not null and key_key <> ''"))
def require_key(t):
    return S.require_key(t.tracks, "key_key").select("file_hash", "key_key")


@query("non_blank_pairs", tracks_sql(
    "select file_hash, title, genre from tracks where title is not null and title <> '' and genre is not null "
    "and genre <> ''"))
def non_blank_pairs(t):
    from vectormart.operators.names import non_blank

    return non_blank(t.tracks, "title", "genre").select("file_hash", "title", "genre")


@query("point_lookup", "select p_partkey, p_name, p_brand from part where p_partkey = 77")
def point_lookup(t):
    return catalog.point_lookup(t.part, "p_partkey", 77).select("p_partkey", "p_name", "p_brand")


@query("point_lookups", "select p_partkey, p_name from part where p_partkey in (select l_suppkey from lineitem)")
def point_lookups(t):
    wanted = t.lineitem.select(F.col("l_suppkey").alias("p_partkey")).distinct()
    return catalog.point_lookups(t.part, "p_partkey", wanted).select("p_partkey", "p_name")


@query("payload_filter", tracks_sql(
    "select file_hash from tracks where genre = 'PROMO' and key_scale = 'minor'"))
def payload_filter(t):
    return catalog.payload_filter(t.tracks, genre="PROMO", key_key=None, key_scale="minor").select("file_hash")


@query("prefix_filter", "select lower(p_name) as name_key, p_partkey from part where lower(p_name) like 'sm%'")
def prefix_filter(t):
    from vectormart.functions.text import strict_key
    from vectormart.operators.names import prefix_filter as prefixed

    return prefixed(t.part.select(strict_key(F.col("p_name")).alias("name_key"), "p_partkey"), "SM")


@query("cascade_select", tracks_sql("""
select 1 as step, artist as label, cast(null as varchar) as file_hash from (select distinct artist from tracks) a
union all select 2, album, null from (select distinct album from tracks where artist = 'Brand#1') b
union all select 3, coalesce(title, 'Unknown'), min(file_hash) from tracks
  where artist = 'Brand#1' and album = 'PROMO' group by 2"""))
def cascade_select(t):
    tracks, none = t.tracks, F.lit(None).cast("string").alias("file_hash")
    return (
        catalog.artists(tracks).select(F.lit(1).alias("step"), F.col("artist").alias("label"), none)
        .unionAll(catalog.albums_of(tracks, "Brand#1").select(F.lit(2), "album", none))
        .unionAll(catalog.tracks_of(tracks, "Brand#1", "PROMO").select(F.lit(3), "label", "file_hash"))
    )


@query("cascade_choices", tracks_sql("""
select artist, album, coalesce(title, 'Unknown') as label, min(file_hash) as file_hash from tracks group by 1, 2, 3"""))
def cascade_choices(t):
    return catalog.cascade_choices(t.tracks)


@query("check_not_null", tracks_sql("select file_hash, genre from tracks where genre is null"))
def check_not_null(t):
    return quality.check_not_null(t.tracks, "genre").select("file_hash", "genre")


@query("check_unique", "select md5(text) as k, count(*) as n from documents group by 1 having count(*) > 1")
def check_unique(t):
    return quality.check_unique(t.documents.select(F.md5("text").alias("k")), "k")


@query("check_point_ids", """
select substr(md5(c_mktsegment), 1, 16) as pid, min(c_name) as first_key, max(c_name) as last_key
from customer group by 1 having min(c_name) <> max(c_name)""")
def check_point_ids(t):
    shared = t.customer.select(F.substring(F.md5("c_mktsegment"), 1, 16).alias("pid"), "c_name")
    return quality.check_point_ids(shared, "c_name", "pid")


