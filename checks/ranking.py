"""Checks of windows, sorting, limits and slices."""

from pyspark.sql import functions as F

from checks import vectors as E
from checks.base import query, r6, sql6, tracks_sql
from vectormart.functions import vectors as X
from vectormart.operators import catalog, paging
from vectormart.operators import knn as K
from vectormart.operators import retrieval as R
from vectormart.operators import staging as S


@query("dedup_latest", """
with d as (select md5(text) as file_hash, cast(n_chars as double) as duration_sec,
    concat(source, '/', doc_id) as json_path, lang from documents)
select file_hash, duration_sec, json_path, lang, cast(rn as int) as rn from (select *, row_number() over (
  partition by file_hash order by coalesce(duration_sec, 0) desc, json_path) as rn from d) x where rn = 1""")
def dedup_latest(t):
    docs = t.documents.select(F.md5("text").alias("file_hash"), F.col("n_chars").cast("double").alias("duration_sec"),
                              F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("json_path"), "lang")
    return S.dedup_latest(docs)


@query("dedup_copies", tracks_sql("""
select file_hash, 0 as copy_nr, duration_sec as track_seconds from tracks"""))
def dedup_copies(t):
    return S.dedup_latest(t.copies, duration="track_seconds").select("file_hash", "copy_nr", "track_seconds")


@query("neighbor_rank", E.top_sql(12))
def neighbor_rank(t):
    """Ranks of given scores: every embedding is a hit of every seed, scored by likeness."""
    seeds = E.queries(t).select("query_id", F.col("vector").cast("array<double>").alias("a"))
    score = X.score(F.col("a"), F.col("embedding").cast("array<double>"))
    hits = t.embeddings.crossJoin(F.broadcast(seeds)).select("query_id", F.col("vec_id").alias("id"), score.alias("score"))
    return E.shown(K.rank_hits(hits, 12))


@query("context_number", """
select conv_id, turn, role, cast(line as int) as line from (select conv_id, turn, role,
  row_number() over (partition by conv_id order by turn) as line from conversations) x where line <= 8""")
def context_number(t):
    return R.context_number(t.conversations.select("conv_id", "turn", "role"), 8, [F.col("turn").asc()], "conv_id")


@query("track_list", tracks_sql("""
select file_hash, artist, album, title, date, genre, key_key, key_scale, bpm, danceability, loudness_integrated
from tracks"""))
def track_list(t):
    return catalog.track_list(t.tracks)


@query("slice_rows", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 250 offset 1000")
def slice_rows(t):
    return paging.slice_rows(t.orders.select("o_orderkey", "o_totalprice"), 1000, 250, "o_orderkey")


@query("slice_rest", "select l_orderkey, l_linenumber from lineitem order by l_orderkey, l_linenumber, l_partkey, "
                     "l_extendedprice offset 2000")
def slice_rest(t):
    """A limit of zero keeps all rows after the start; positions are counted, not gathered."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return paging.slice_rows(rows, 2000, 0, *rows.columns).select("l_orderkey", "l_linenumber")


@query("paged_read", """
select o_orderkey, cast(floor((row_number() over (order by o_orderkey) - 1) / 1000) as bigint) as page from orders""")
def paged_read(t):
    return paging.pages(t.orders.select("o_orderkey"), 1000, "o_orderkey").select("o_orderkey", "page")


@query("row_index", "select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as row_index "
                    "from orders")
def row_index(t):
    return paging.row_index(t.orders.select("o_orderkey", "o_totalprice"), F.col("o_totalprice").desc(),
                            F.col("o_orderkey").asc()).select("o_orderkey", "row_index")


@query("limit_rows", "select p_partkey, p_name from part order by p_partkey limit 100")
def limit_rows(t):
    return paging.limit_rows(t.part.select("p_partkey", "p_name"), 100, "p_partkey")


@query("random_track", tracks_sql("""select count(*) as known, count(distinct file_hash) as different, true as repeatable, true as varied
from (select file_hash from tracks order by file_hash limit 6)"""))
def random_track(t):
    """Six draws without replacement are six tracks of the table; a seed repeats its draw, and seeds differ."""
    rest, drawn = t.tracks.select("file_hash"), []
    for seed in range(6):
        drawn.append(catalog.random_track(rest, seed=seed).first()["file_hash"])
        rest = rest.filter(F.col("file_hash") != drawn[-1])
    keys = t.tracks.select("file_hash")
    again = catalog.random_track(keys, seed=0).first()["file_hash"] == drawn[0]
    others = len({catalog.random_track(keys, seed=s).first()["file_hash"] for s in range(4)}) > 1
    known = t.tracks.filter(F.col("file_hash").isin(drawn))
    return known.agg(F.count("*").alias("known"), F.count_distinct("file_hash").alias("different"),
                     F.lit(again).alias("repeatable"), F.lit(others).alias("varied"))


@query("resort_hits", f"""with {E.SCORED}, back as (select query_id, id, score, row_number() over (
  partition by query_id order by round(score, 4) desc, id) as rank from ranked where rank <= 25)
select query_id, id, {sql6("score", 4)} as score, cast(rank as int) as rank from back where rank <= 5""")
def resort_hits(t):
    hits = E.knn(t, 25).withColumn("score", F.round("score", 4))
    return R.resort_hits(hits, keep=5).select("query_id", "id", r6(F.col("score"), 4).alias("score"), "rank")


HERO = f"""with {E.SCORED},
art as (select vec_id as id, case when label in (1, 4, 7) then concat('https://art.example/', vec_id) end as url
  from embeddings),
hits as (select r.query_id, r.id, r.rank, url from ranked r join art using (id) where r.rank <= 12),
led as (select *, row_number() over (partition by query_id order by (url is not null) desc, rank) as lead from hits)"""


def art_hits(t):
    art = t.embeddings.select(
        F.col("vec_id").alias("id"), F.when(F.col("label").isin(1, 4, 7), F.concat(
            F.lit("https://art.example/"), F.col("vec_id").cast("string"))).alias("artwork_url"))
    return E.knn(t, 12).join(art, "id")


@query("pick_hero", HERO + """ select query_id, id, rank, case when lead = 1 then 'hero' else 'supporting' end as role
from led""")
def pick_hero(t):
    return R.pick_hero(art_hits(t)).select("query_id", "id", "rank", "role")
