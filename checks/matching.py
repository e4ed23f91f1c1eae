"""Checks of joins, set operations and the name matching of folders."""

from pyspark.sql import functions as F

from checks.base import CTE_CACHE, query, tracks_sql
from checks.sinks import supplier_match
from checks.sources import CTE_FILES, file_list
from vectormart.operators import lookup as L
from vectormart.operators import names as N
from vectormart.operators import worklist as W

MATCH = """dirs as (select replace(s_name, 'Supplier', 'Name') as artist_dir, concat('/lib/', s_name) as path
  from supplier),
targets as (select distinct lower(replace(c_name, 'Customer', 'Name')) as k from customer where c_acctbal > 0)"""


@query("match_artists", f"with {MATCH} select k as name_key, artist_dir, path from dirs join targets "
                        "on k = lower(artist_dir)")
def match_artists(t):
    dirs, targets, _ = supplier_match(t)
    return N.match_artists(dirs, targets).select("name_key", "artist_dir", "path")


@query("match_artists_lenient", """
with dirs as (select replace(s_name, '#', '_&_') as artist_dir, s_name as path from supplier),
targets as (select distinct replace(lower(replace(c_name, 'Customer', 'Supplier')), '#', ' and ') as k from customer)
select k as name_key, artist_dir, path from dirs join targets on k = replace(lower(artist_dir), '_&_', ' and ')""")
def match_artists_lenient(t):
    dirs = t.supplier.selectExpr("replace(s_name, '#', '_&_') as artist_dir", "s_name as path")
    wanted = t.customer.selectExpr("replace(replace(c_name, 'Customer', 'SUPPLIER'), '#', ' + ') as name")
    return N.match_artists(dirs, N.key_union(wanted, wanted, lenient=True), lenient=True).select(
        "name_key", "artist_dir", "path")


@query("match_report", f"""with {MATCH},
files as (select concat('/lib/', s_name) as path, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey
          group by 1)
select artist_dir, lower(artist_dir) as normalized_key, k is not null and lower(artist_dir) like 'name#0%' as matched,
  case when k is not null and lower(artist_dir) like 'name#0%' then lower(artist_dir) else '' end as matched_key,
  cast(coalesce(n, 0) as bigint) as files_in_dir
from dirs left join targets on k = lower(artist_dir) left join files using (path)""")
def match_report(t):
    return N.match_report(*supplier_match(t), prefix="NAME#0")


@query("select_files", f"""with {MATCH}
select distinct concat('/lib/', s_name, '/', l_orderkey, '-', l_linenumber, '.mp3') as path
from lineitem join supplier on l_suppkey = s_suppkey
where lower(replace(s_name, 'Supplier', 'Name')) in (select k from targets)""")
def select_files(t):
    dirs, targets, _ = supplier_match(t)
    files = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(
        "concat('/lib/', s_name) as dir_path",
        "concat('/lib/', s_name, '/', l_orderkey, '-', l_linenumber, '.mp3') as path")
    return N.select_files(files, N.match_artists(dirs, targets))


OUT_NAME = ("concat(regexp_replace(string_split(p, '/')[-1], '(.)\\.[^.]+$', '\\1'), '-', "
            "substr(sha1(p), 1, 8), '.json')")


@query("resume_pending", f"""
with files as (select distinct concat('lib/', o_orderpriority, '/track ', o_orderkey, '.mp3') as p, o_orderkey
  from orders),
done as (select distinct l_orderkey from lineitem where l_returnflag = 'R')
select p as rel_path, {OUT_NAME} as output_name from files where o_orderkey not in (select l_orderkey from done)""")
def resume_pending(t):
    files = t.orders.selectExpr("concat('lib/', o_orderpriority, '/track ', o_orderkey, '.mp3') as rel_path",
                                "o_orderkey")
    from vectormart.functions.text import output_name

    written = t.lineitem.join(files, F.col("l_orderkey") == F.col("o_orderkey")).select(
        output_name(F.col("rel_path")).alias("name"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("length"))
    return W.resume_pending(files.select("rel_path"), written).select("rel_path", "output_name")


PAIRS = "pairs as (select distinct artist, album, concat(lower(artist), '|', lower(album)) as cache_key from tracks)"


@query("lookup_pending", tracks_sql("""select cache_key, artist, album from pairs
where cache_key not in (select cache_key from cache where status <> 'retry')""", CTE_CACHE, PAIRS))
def lookup_pending(t):
    return L.lookup_pending(L.distinct_pairs(t.tracks), t.cache)


@query("attach_artwork", tracks_sql("""
select file_hash, artwork_url from tracks t left join (select cache_key, artwork_url from cache where status = 'hit') c
  on cache_key = concat(lower(t.artist), '|', lower(t.album))""", CTE_CACHE))
def attach_artwork(t):
    return L.attach_artwork(t.tracks, t.cache).select("file_hash", "artwork_url")


@query("cache_entries", tracks_sql("select cache_key, artist, album, artwork_url, status from cache", CTE_CACHE))
def cache_entries(t):
    return t.cache


@query("cache_merge", tracks_sql("""
select p.cache_key, p.artist, p.album,
  case when c.status in ('hit', 'miss') then c.artwork_url
       when length(p.album) % 2 = 0 then concat('https://art.example/', p.album, '/600x600bb.jpg') end as artwork_url,
  case when c.status in ('hit', 'miss') then c.status when length(p.album) % 2 = 0 then 'hit' else 'miss' end as status
from (select cache_key, lower(artist) as la, lower(album) as lb, min(artist) as artist0, min(album) as album0
      from pairs group by 1, 2, 3) g
join (select * from pairs) p using (cache_key)
left join cache c on c.cache_key = p.cache_key
where c.status is null or c.status = 'retry'
union all select cache_key, artist, album, artwork_url, status from cache where status <> 'retry'""",
                                 CTE_CACHE, PAIRS))
def cache_merge(t):
    """Answers for every pending pair are merged into the cache."""
    from vectormart.plans.jobs import refresh_cache

    found = F.concat(F.lit("https://art.example/"), F.col("album"), F.lit("/100x100bb.jpg"))
    body = F.to_json(F.struct(F.array(F.struct(
        F.lit("collection").alias("wrapperType"),
        F.when(F.length("album") % 2 == 0, found).otherwise("").alias("artworkUrl100"))).alias("results")))
    responses = L.distinct_pairs(t.tracks).select("artist", "album", F.lit(200).alias("http_status"),
                                                  body.alias("body"))
    return refresh_cache(t.tracks, t.cache, responses)


@query("key_intersect", "select cast(s_nationkey as varchar) as name_key from supplier intersect "
                        "select cast(c_nationkey as varchar) from customer where c_acctbal > 5000")
def key_intersect(t):
    return N.key_intersect(t.supplier.select(F.col("s_nationkey").cast("string")),
                           t.customer.filter("c_acctbal > 5000").select(F.col("c_nationkey").cast("string")))


@query("key_union", "select lower(s_name) as name_key from supplier union select lower(c_mktsegment) from customer")
def key_union(t):
    return N.key_union(t.supplier.select("s_name"), t.customer.select("c_mktsegment"))


@query("path_distinct", f"with {CTE_FILES} select path from files")
def path_distinct(t):
    return W.path_distinct(file_list(t))


@query("first_by_key", """
select concat('name ', s_nationkey) as name_key,
  arg_min(case when s_acctbal > 0 then concat('NAME ', s_nationkey) else concat('Name  ', s_nationkey, ' feat. ', s_name)
    end, s_name) as artist_dir, max(s_name) as path
from supplier group by s_nationkey""")
def first_by_key(t):
    dirs = t.supplier.selectExpr(
        "case when s_acctbal > 0 then concat('NAME ', s_nationkey) else concat('Name  ', s_nationkey, ' feat. ', s_name)"
        " end as artist_dir", "s_name as path")
    return N.first_by_key(dirs).select("name_key", "artist_dir", "path")


