"""Checks of the incremental jobs; each runs again with new input, and once more without."""

from pyspark.sql import functions as F

from checks import vectors as E
from checks.base import FLAT_SQL, flat_shown, query, sql6, tracks_sql
from checks.sinks import PAYLOAD, changed, points, summed
from checks.sources import write_files
from vectormart.operators.collection import Collection
from vectormart.session import work_folder
from vectormart.streaming import jobs

BROKEN = "substr(file_hash, 1, 1) = '7'"


@query("stream_ingest", tracks_sql(f"""select {FLAT_SQL}, cast(null as varchar) as reason, cast(null as bigint) as documents
  from tracks where not {BROKEN} union all by name select 'no JSON' as reason, count(*) as documents from tracks where {BROKEN}"""))
def stream_ingest(t):
    """Documents arrive in two lots, some of them cut off; a third run finds nothing new."""
    files = t.document_files(".txt").withColumn("file_hash", F.substring_index("name", ".", 1)).withColumn(
        "content", F.when(F.expr(BROKEN), F.left("content", F.lit(40))).otherwise(F.col("content")))
    source, out, marks = (work_folder(t.spark, n) for n in ("arriving", "ingested", "marks"))
    for lot in ("file_hash < '8'", "file_hash >= '8'", None):
        if lot:
            write_files(files.filter(lot).select("name", "content"), source)
        jobs.stream_ingest(t.spark, source, out, marks, rejects=out + "-refused", pattern="*.txt")
    flat = flat_shown(t.spark.read.parquet(out), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("documents"))
    refused = t.spark.read.parquet(out + "-refused").groupBy("reason").agg(F.count("*").alias("documents"))
    return flat.unionByName(refused, allowMissingColumns=True)


@query("stream_upsert", f"""with one as (select vec_id as id, label, embedding from embeddings where label < 8
  union all select vec_id, label + 100, embedding from embeddings where label >= 8)
select id, label, {sql6("list_sum(list_transform(embedding, lambda x: cast(x as double)))")} as total from one""")
def stream_upsert(t):
    """A second run brings new and changed points, another writer changes some, and the first batch is delivered once more."""
    collection = Collection(t.spark, work_folder(t.spark, "collection"))
    collection.init(E.DIM, "cosine", PAYLOAD, "bigint")
    source, marks = work_folder(t.spark, "arriving"), work_folder(t.spark, "marks")
    early = points(t).filter("label < 5").withColumn("label", F.col("label") + 50)
    for lot in (early, points(t)):
        lot.write.mode("append").parquet(source)
        arriving = t.spark.readStream.schema(lot.schema).parquet(source)
        jobs.stream_upsert(arriving, collection, marks, name="library")
    relabelled = points(t).filter("label >= 8").withColumn("label", F.col("label") + 100)
    collection.upsert(relabelled, writer="editor", batch=0)
    collection.compact()
    collection.upsert(early, writer="library", batch=0)
    return summed(collection.read())


@query("collection_replay", f"""with fresh as (select vec_id * 2 as id, label + 100 as label, embedding from embeddings),
merged as (select vec_id as id, label, embedding from embeddings union all
  select id, label, embedding from fresh where id not in (select vec_id from embeddings))
select id, label, {sql6("list_sum(list_transform(embedding, lambda x: cast(x as double)))")} as total from merged""")
def collection_replay(t):
    """Two writers take turns; a batch of the first one that is delivered again changes nothing."""
    c = Collection(t.spark, work_folder(t.spark, "collection"))
    c.init(E.DIM, "cosine", PAYLOAD, "bigint")
    c.upsert(changed(t), writer="first", batch=1)
    c.upsert(points(t), writer="second", batch=1)
    c.compact()
    c.upsert(changed(t), writer="first", batch=1)
    c.upsert(changed(t), writer="first", batch=0)
    return summed(c.read())


@query("collection_search", f"""with {E.CTE_EVAL},
scored as (select s.file_hash as query_id, c.*, list_cosine_similarity(q.vector, c.vector) as score
  from eval_seeds s join corpus q on q.file_hash = s.file_hash cross join corpus c where c.key_key = 'C'),
r as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as int) as rank from scored)
select query_id, rank, cast(vec_id as bigint) as id, {sql6("score")} as score, file_hash, artist, title, album, genre,
  concat(coalesce(key_key, ''), '-', key_scale) as key from r where rank <= 10""")
def collection_search(t):
    """A stored collection searched by key, among points of one key only."""
    corpus, wanted = E.eval_tables(t)
    c = Collection(t.spark, work_folder(t.spark, "collection"))
    c.init(E.DIM, "cosine", "file_hash string, artist string, album string, title string, genre string, key_key string, key_scale string", "bigint")
    numbered = t.embeddings.select(F.md5(F.col("vec_id").cast("string")).alias("file_hash"), F.col("vec_id").alias("id"))
    c.upsert(corpus.join(numbered, "file_hash"), key="file_hash")
    return c.similar(wanted, 10, key_key="C").withColumn("score", F.round("score", 6) + F.lit(0.0))
