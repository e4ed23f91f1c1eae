"""Tables and SQL shared by the vector checks.

The corpus is every embedding.  The queries are the first vector of each label, so
their number follows the data but stays small beside it.
"""

from pyspark.sql import functions as F

from checks.base import query, r6, sql6
from vectormart.functions.numbers import rounded
from vectormart.functions import vectors as X
from vectormart.operators import approximate as A
from vectormart.operators import knn as K
from vectormart.operators import quality
from vectormart.operators.catalog import point_lookups
from vectormart.session import work_folder

DIM = 64
SEEDS = "seeds as (select min(vec_id) as query_id from embeddings group by label)"
SCORED = f"""{SEEDS},
q as (select query_id, embedding as qv, label as seed_label from seeds join embeddings on vec_id = query_id),
scored as (select query_id, seed_label, vec_id as id, label,
  list_cosine_similarity(cast(qv as double[]), cast(embedding as double[])) as score,
  list_dot_product(cast(qv as double[]), cast(embedding as double[])) as dot
  from q cross join embeddings),
ranked as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, id) as int) as rank
  from scored)"""


def seeds(t):
    """Id, vector and label of each label's first embedding."""
    first = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    return point_lookups(t.embeddings, "vec_id", first)


def queries(t):
    return seeds(t).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


def knn(t, k, **args):
    return K.exact_knn(t.embeddings, queries(t), k, DIM, id_col="vec_id", vector_col="embedding", **args)


def shown(hits, *more):
    return hits.select("query_id", "id", r6(F.col("score")).alias("score"), "rank", *more)


TOP = "select query_id, id, {score} as score, rank from ranked where rank <= {k}"


def top_sql(k):
    return f"with {SCORED} " + TOP.format(score=sql6("score"), k=k)


# Embeddings under text keys, with part names as their metadata.
CTE_EVAL = f"""
corpus as (select md5(cast(vec_id as varchar)) as file_hash, coalesce(p_brand, 'no brand') as artist,
    coalesce(p_name, concat('part ', vec_id)) as title, coalesce(p_type, 'no type') as album,
    cast(label as varchar) as genre, case when label < 8 then 'C' end as key_key, 'major' as key_scale,
    cast(embedding as double[]) as vector, vec_id
  from embeddings left join part on p_partkey = vec_id),
eval_seeds as (select md5(cast(min(vec_id) as varchar)) as file_hash, concat('label ', label) as label
  from embeddings group by label)"""
EVAL_SQL = f"""with {CTE_EVAL},
pairs as (select s.label, a.file_hash as sh, a.artist as sa, a.title as st, a.album as sb, a.genre as sg,
    concat(coalesce(a.key_key, ''), '-', a.key_scale) as sk, b.*,
    list_cosine_similarity(a.vector, b.vector) as score
  from eval_seeds s join corpus a on a.file_hash = s.file_hash cross join corpus b),
r as (select *, cast(row_number() over (partition by sh order by round(score, 9) desc, file_hash) as int) as rank
  from pairs)
select label as seed_label, sh as seed_file_hash, sa as seed_artist, st as seed_title, sb as seed_album,
  sg as seed_genre, sk as seed_key, rank, {sql6("score")} as score, file_hash as neighbor_file_hash,
  artist as neighbor_artist, title as neighbor_title, album as neighbor_album, genre as neighbor_genre,
  concat(coalesce(key_key, ''), '-', key_scale) as neighbor_key, sh = file_hash as is_self
from r where rank <= 5"""


def eval_tables(t):
    corpus = t.embeddings.join(t.part, F.col("p_partkey") == F.col("vec_id"), "left").select(
        F.md5(F.col("vec_id").cast("string")).alias("file_hash"), F.coalesce("p_brand", F.lit("no brand")).alias("artist"),
        F.coalesce("p_name", F.concat(F.lit("part "), F.col("vec_id").cast("string"))).alias("title"),
        F.coalesce("p_type", F.lit("no type")).alias("album"),
        F.col("label").cast("string").alias("genre"), F.when(F.col("label") < 8, "C").alias("key_key"),
        F.lit("major").alias("key_scale"), F.col("embedding").alias("vector"))
    wanted = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select(
        F.md5(F.col("vec_id").cast("string")).alias("file_hash"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("label"))
    return corpus, wanted


def paired(t):
    """Every embedding beside the first embedding of its label."""
    q = seeds(t).select(F.col("label"), F.col("vec_id").alias("query_id"),
                        F.col("embedding").cast("array<double>").alias("a"))
    return t.embeddings.withColumn("b", F.col("embedding").cast("array<double>")).join(q, "label")


@query("cosine_score", f"with {SCORED} select query_id, id, {sql6('score')} as score from scored "
                       "where seed_label = label")
def cosine_score(t):
    return paired(t).select("query_id", F.col("vec_id").alias("id"),
                            r6(X.score(F.col("a"), F.col("b"))).alias("score"))


@query("dot_score", f"with {SCORED} select query_id, id, {sql6('dot')} as score from scored where seed_label = label")
def dot_score(t):
    return paired(t).select("query_id", F.col("vec_id").alias("id"),
                            r6(X.score(F.col("a"), F.col("b"), "dot")).alias("score"))


@query("score_round", f"with {SCORED} select query_id, id, {sql6('score', 4)} as score4, {sql6('score')} as score6 "
                      "from scored where seed_label = label")
def score_round(t):
    s = X.score(F.col("a"), F.col("b"))
    return paired(t).select("query_id", F.col("vec_id").alias("id"),
                            *[(rounded(s, n) + F.lit(0.0)).alias(f"score{n}") for n in (4, 6)])


@query("knn_one", f"""with c as (select list(m order by i) as qv from (select i, avg(cast(x as double)) as m from (
    select unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) u group by i) g),
s as (select vec_id as id, list_cosine_similarity(qv, cast(embedding as double[])) as score from c cross join embeddings)
select id, {sql6("score")} as score,
  cast(row_number() over (order by round(score, 9) desc, id) as int) as rank from s qualify rank <= 10""")
def knn_one(t):
    """The rows nearest to the mean of all vectors."""
    mean = t.embeddings.agg(*[F.avg(F.col("embedding")[i]) for i in range(DIM)]).first()
    hits = K.knn_one(t.embeddings, list(mean), 10, id_col="vec_id", vector_col="embedding")
    return hits.select("id", r6(F.col("score")).alias("score"), "rank")


def injected(t):
    """Embeddings with faults by label: a missing, a NaN or an infinite element, a short or an absent vector."""
    v, label = F.col("embedding").cast("array<double>"), F.col("label")
    head = F.slice(v, 1, DIM - 1)

    def ending(x):
        return F.concat(head, F.array(x))

    bad = (
        F.when(label == 0, ending(F.lit(None).cast("double"))).when(label == 1, ending(F.lit(float("nan"))))
        .when(label == 2, ending(F.lit(float("inf")))).when(label == 3, head)
        .when(label == 4, F.lit(None).cast("array<double>")).otherwise(v)
    )
    return t.embeddings.select("vec_id", "label", bad.alias("vector"))


@query("valid_vector", "select vec_id, label >= 5 as valid from embeddings")
def valid_vector(t):
    return injected(t).select("vec_id", X.valid_vector(F.col("vector"), DIM).alias("valid"))


@query("check_dim", "select vec_id, cast(case label when 3 then 63 end as int) as n from embeddings "
                    "where label in (3, 4)")
def check_dim(t):
    return quality.check_dim(injected(t), "vector", DIM).select("vec_id", F.size("vector").alias("n"))


@query("knn_cross", top_sql(20))
def knn_cross(t):
    return shown(knn(t, 20))


@query("knn_cells", top_sql(20))
def knn_cells(t):
    """The same search with a query bound that the seeds exceed, so that there are several blocks."""
    return shown(knn(t, 20, max_query_bytes=8 * DIM * 4))


@query("knn_by_id", top_sql(10))
def knn_by_id(t):
    return shown(knn(t, 10))


@query("topk_similar", f"""with {SCORED}, same as (select *, cast(row_number() over (partition by query_id
  order by round(score, 9) desc, id) as int) as r from scored where label = seed_label)
select query_id, id, {sql6("score")} as score, r as rank from same where r <= 8""")
def topk_similar(t):
    """Ranking alone: scores of every pair of a label, then the best per query."""
    hits = paired(t).select("query_id", F.col("vec_id").alias("id"),
                            X.score(F.col("a"), F.col("b")).alias("score"))
    return shown(K.rank_hits(hits, 8))


@query("knn_dot", f"""with {SCORED}, d as (select *, cast(row_number() over (partition by query_id
  order by round(dot, 9) desc, id) as int) as r from scored)
select query_id, id, {sql6("dot")} as score, r as rank from d where r <= 10""")
def knn_dot(t):
    return shown(knn(t, 10, metric="dot"))


def by_cell(t, centres=None):
    """The corpus stored by cell: around given centres, or about the square root of its rows as cells."""
    cells = max(2, int(t.embeddings.count() ** 0.5))
    folder = work_folder(t.spark, "cells")
    A.build_cells(t.embeddings, folder, DIM, cells, id_col="vec_id", vector_col="embedding", centres=centres)
    return folder


def approximate(t, k, probes, centres=None, **more):
    return A.approx_knn(t.spark, by_cell(t, centres), queries(t), k, DIM, probes, id_col="vec_id", vector_col="embedding", **more)


def label_centres(t):
    """The first embedding of every label as the centre of a cell."""
    return seeds(t).select(F.col("label").alias("cell"), F.col("embedding").alias("centre"))


@query("approx_knn", f"""with {SCORED},
near as (select seed_label as query_label, label as cell from (select r.seed_label, r.label, row_number() over (
    partition by r.query_id order by round(r.score, 9) desc, r.label) as n from scored r join seeds s on r.id = s.query_id) x where n <= 4),
own as (select id, label as cell from (select s.id, q.seed_label as label, row_number() over (
    partition by s.id order by round(s.score, 9) desc, q.seed_label) as n
  from scored s join q on q.query_id = s.query_id) y where n = 1),
visited as (select s.query_id, s.id, s.score, cast(row_number() over (partition by s.query_id order by round(s.score, 9) desc, s.id) as int) as rank
  from scored s join own o on o.id = s.id join near n on n.query_label = s.seed_label and n.cell = o.cell)
select query_id, id, {sql6("score")} as score, rank from visited where rank <= 10""")
def approx_knn(t):
    """Each query visits four of the cells around the first embedding of every label."""
    return shown(approximate(t, 10, 4, label_centres(t), shortlist=30))


@query("approx_knn_all_cells", top_sql(10))
def approx_knn_all_cells(t):
    """Visiting every cell must give the exact result."""
    return shown(approximate(t, 10, t.embeddings.count(), shortlist=30))


@query("approx_recall", "select count(distinct label) as queries, true as useful from embeddings")
def approx_recall(t):
    """Recall against the exact search is at least 0.9.  These vectors lie in all directions alike, which no cells
    can help with: three in four of them are visited."""
    most = int(t.embeddings.count() ** 0.5) * 3 // 4
    per_query = A.recall(approximate(t, 10, most), knn(t, 10))
    return per_query.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("useful"))


@query("knn_blocks", f"""with scored as (select a.vec_id as query_id, b.vec_id as id,
  list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as score
  from embeddings a join embeddings b on a.vec_id <> b.vec_id),
ranked as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, id) as int) as rank from scored)
""" + TOP.format(score=sql6("score"), k=5))
def knn_blocks(t):
    """Every embedding as a query, in four blocks that each go over growing shares of the corpus."""
    everyone = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return shown(K.exact_knn(t.embeddings, everyone, 5, DIM, id_col="vec_id", vector_col="embedding", exclude_self=True,
                             max_query_bytes=2 * DIM * everyone.count(), most_hits=1))
