"""Checks of writers and collections: what was written is read back."""

from pyspark.sql import functions as F

from checks.base import CTE_CACHE, query, r6, sql6, tracks_sql
from checks.sources import CTE_MANIFEST, STATS, manifest
from vectormart import fixed_values as V
from vectormart.operators import names as N
from vectormart.operators.collection import Collection, collection_upsert
from vectormart.operators.mart import feature_stats, stats_table
from vectormart.operators.retrieval import eval_neighbors
from vectormart.session import work_folder
from vectormart.sources import readers, writers
from checks import vectors as E

PAYLOAD = "label int"


def points(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"),
                               "label")


@query("write_parts", "select * from lineitem")
def write_parts(t):
    folder = work_folder(t.spark, "parts")
    writers.write_parts(t.lineitem, folder, 5000)
    return t.spark.read.parquet(folder)


@query("write_single", "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part")
def write_single(t):
    folder = work_folder(t.spark, "single")
    writers.write_single(t.part, folder)
    return t.spark.read.parquet(folder)


@query("write_sample", "select p_partkey, p_name from part order by p_partkey limit 500")
def write_sample(t):
    folder = work_folder(t.spark, "sample")
    writers.write_sample(t.part.select("p_partkey", "p_name"), folder, 500, ("p_partkey",))
    return t.spark.read.parquet(folder)


@query("write_manifest", f"""with {CTE_MANIFEST}
select 'absolute' as kind, path as line from manifest union all select 'relative', rel_path from manifest""")
def write_manifest(t):
    absolute, relative = work_folder(t.spark, "list"), work_folder(t.spark, "list")
    writers.write_manifest(manifest(t).withColumn("path", F.concat(F.lit("file:"), F.col("path"))), "file:/lib",
                           absolute, relative)

    def lines(folder, kind):
        return t.spark.read.text(folder).select(F.lit(kind).alias("kind"), F.col("value").alias("line"))

    return lines(absolute, "absolute").withColumn("line", F.substr("line", F.lit(6))).unionAll(
        lines(relative, "relative"))


@query("write_match_report", """
with dirs as (select replace(s_name, 'Supplier', 'Name') as artist_dir, concat('/lib/', s_name) as path from supplier),
targets as (select distinct lower(replace(c_name, 'Customer', 'Name')) as k from customer where c_acctbal > 0),
files as (select concat('/lib/', s_name) as path, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey
          group by 1)
select artist_dir, lower(artist_dir) as normalized_key, true as matched, lower(artist_dir) as matched_key,
  cast(coalesce(n, 0) as bigint) as files_in_dir
from dirs join targets on k = lower(artist_dir) left join files using (path)""")
def write_match_report(t):
    folder = work_folder(t.spark, "report")
    writers.write_csv(N.match_report(*supplier_match(t)), folder)
    return t.spark.read.csv(folder, header=True, schema="artist_dir string, normalized_key string, matched boolean, "
                            "matched_key string, files_in_dir bigint", escape='"')


def supplier_match(t):
    """Suppliers as folders, solvent customers as targets, line items as files."""
    dirs = t.supplier.selectExpr("replace(s_name, 'Supplier', 'Name') as artist_dir", "concat('/lib/', s_name) as path")
    wanted = t.customer.filter("c_acctbal > 0").selectExpr("replace(c_name, 'Customer', 'Name') as name")
    targets = N.key_union(wanted, wanted)
    files = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(
        "concat('/lib/', s_name) as dir_path")
    return dirs, targets, files


@query("write_eval", E.EVAL_SQL)
def write_eval(t):
    folder = work_folder(t.spark, "eval")
    writers.write_csv(eval_neighbors(*E.eval_tables(t), 5, E.DIM, vector_col="vector"), folder)
    return t.spark.read.csv(folder, header=True, escape='"', emptyValue="", nullValue="\u0000", schema=(
        "seed_label string, seed_file_hash string, seed_artist string, seed_title string, seed_album string, "
        "seed_genre string, seed_key string, rank int, score double, neighbor_file_hash string, "
        "neighbor_artist string, neighbor_title string, neighbor_album string, neighbor_genre string, "
        "neighbor_key string, is_self boolean"))


@query("write_stats", STATS)
def write_stats(t):
    folder = work_folder(t.spark, "stats")
    writers.write_stats(stats_table(feature_stats(t.tracks)), folder)
    stored = F.from_json("value", "map<string,struct<mean:double,std:double>>")
    return t.spark.read.text(folder).select(F.explode(stored).alias("feature", "s")).select(
        "feature", r6(F.col("s.mean"), 9).alias("mean"), r6(F.col("s.std"), 9).alias("std"))


@query("write_cache", tracks_sql(
    "select cache_key, artist, album, artwork_url from cache where status <> 'retry'", CTE_CACHE))
def write_cache(t):
    folder = work_folder(t.spark, "cache")
    writers.write_cache(t.cache, folder)
    return t.spark.read.parquet(folder)


def described(collection):
    return collection.info().select("dim", "metric", "points")


@query("collection_init", """select 64 as dim, 'cosine' as metric, count(*) as points
from embeddings where label < 5""")
def collection_init(t):
    """A second creation changes nothing, and vectors of another length are refused."""
    c = Collection(t.spark, work_folder(t.spark, "collection"))
    c.init(E.DIM, "cosine", PAYLOAD, "bigint")
    c.init(3, "dot", PAYLOAD, "bigint")
    short = F.when(F.col("label") < 5, F.col("vector")).otherwise(F.slice("vector", 1, 10))
    c.upsert(points(t).withColumn("vector", short))
    return described(c)


@query("collection_recreate", "select 64 as dim, 'dot' as metric, count(*) as points from embeddings where label >= 5")
def collection_recreate(t):
    c = Collection(t.spark, work_folder(t.spark, "collection"))
    c.init(E.DIM, "cosine", PAYLOAD, "bigint")
    c.upsert(points(t))
    c.recreate(E.DIM, "dot", PAYLOAD, "bigint")
    c.upsert(points(t).filter("label >= 5"))
    return described(c)


def changed(t):
    """Every point again under twice its id and with another label, so half replace and half add."""
    return points(t).withColumn("id", F.col("id") * 2).withColumn("label", F.col("label") + 100)


UPSERTED = f"""
with fresh as (select vec_id * 2 as id, label + 100 as label, embedding from embeddings),
merged as (select vec_id as id, label, embedding from embeddings where vec_id not in (select id from fresh)
  union all select id, label, embedding from fresh)
select id, label, {sql6("list_sum(list_transform(embedding, lambda x: cast(x as double)))")} as total from merged"""


def summed(points_read):
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return points_read.select("id", "label", r6(total).alias("total"))


@query("collection_upsert", UPSERTED)
def upsert(t):
    c = Collection(t.spark, work_folder(t.spark, "collection"))
    c.init(E.DIM, "cosine", PAYLOAD, "bigint")
    c.upsert(points(t))
    c.upsert(changed(t))
    c.upsert(changed(t))
    return summed(c.read())


@query("collection_upsert_table", UPSERTED)
def upsert_table(t):
    return summed(collection_upsert(points(t), changed(t), E.DIM))


@query("collection_compact", UPSERTED)
def compact(t):
    c = Collection(t.spark, work_folder(t.spark, "collection"))
    c.init(E.DIM, "cosine", PAYLOAD, "bigint")
    c.upsert(points(t))
    c.upsert(changed(t))
    c.compact()
    return summed(c.read())


@query("collection_info", "select 64 as dim, 'cosine' as metric, count(*) as points from embeddings")
def collection_info(t):
    c = Collection(t.spark, work_folder(t.spark, "collection"))
    c.init(E.DIM, "cosine", PAYLOAD, "bigint")
    c.upsert(points(t))
    return described(c)


@query("save_cache", tracks_sql("select cache_key, value from entries", CTE_CACHE))
def save_cache(t):
    """The cache with its retry marks, saved and loaded again."""
    folder = work_folder(t.spark, "cache")
    writers.save_cache(t.cache, folder, V.RETRY_MARKER)
    return readers.scan_lookup_cache(t.spark, folder, lines=True)
