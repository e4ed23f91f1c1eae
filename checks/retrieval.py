"""Checks of similarity search and retrieval jobs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import vectors as E
from checks.base import CTE_MART, query, r6, sql6, tracks_sql
from checks.text import DOC
from vectormart import fixed_values as V
from vectormart.functions import vectors as X
from vectormart.functions.labels import track_document
from vectormart.functions.text import cache_key
from vectormart.operators import knn as K
from vectormart.operators import retrieval as R
from vectormart.operators.catalog import point_lookups
from vectormart.plans import jobs
from vectormart.session import measured, work_folder


@query("knn_filtered", f"""with {E.SCORED}, f as (select *, cast(row_number() over (partition by query_id
  order by round(score, 9) desc, id) as int) as r from scored where label = 3)
select query_id, id, {sql6("score")} as score, r as rank from f where r <= 10""")
def knn_filtered(t):
    from vectormart.operators.catalog import payload_filter

    hits = K.exact_knn(payload_filter(t.embeddings, label=3), E.queries(t), 10, E.DIM, id_col="vec_id",
                       vector_col="embedding")
    return E.shown(hits)


CENTRES = """centres as (select label as query_id, list(m order by i) as qv from (
  select label, i, avg(cast(x as double)) as m from (select label, unnest(embedding) as x,
    generate_subscripts(embedding, 1) as i from embeddings) u group by label, i) g group by label)"""


@query("knn_by_vector", f"""with {CENTRES}, s as (select query_id, vec_id as id,
  list_cosine_similarity(qv, cast(embedding as double[])) as score from centres cross join embeddings),
r as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, id) as int) as rank from s)
select query_id, id, {sql6("score")} as score, rank from r where rank <= 8""")
def knn_by_vector(t):
    """Query vectors that are no corpus row: the mean vector of every label."""
    parts = [F.avg(F.col("embedding")[i]).alias(f"m{i}") for i in range(E.DIM)]
    centres = t.embeddings.groupBy(F.col("label").alias("query_id")).agg(*parts).select(
        "query_id", F.array(*[f"m{i}" for i in range(E.DIM)]).alias("vector"))
    return E.shown(K.exact_knn(t.embeddings, centres, 8, E.DIM, id_col="vec_id", vector_col="embedding"))


OTHERS = "id <> query_id and label <> seed_label"


@query("similar_tracks", f"""with {E.SCORED}, kept as (select *, cast(row_number() over (partition by query_id
  order by rank) as int) as r from ranked where rank <= 16 and {OTHERS})
select query_id, id, {sql6("score")} as score, r as rank from kept where r <= 5""")
def similar_tracks(t):
    hits = R.similar_tracks(t.embeddings, E.seeds(t), 5, E.DIM, id_col="vec_id", vector_col="embedding", group="label")
    return E.shown(hits)


@query("similar_tracks_exact", f"""with {E.SCORED}, kept as (select *, cast(row_number() over (partition by query_id
  order by rank) as int) as r from ranked where {OTHERS})
select query_id, id, {sql6("score")} as score, r as rank from kept where r <= 5""")
def similar_tracks_exact(t):
    hits = R.similar_tracks(t.embeddings, E.seeds(t), 5, E.DIM, id_col="vec_id", vector_col="embedding", group="label",
                            mode="exact")
    return E.shown(hits)


def placed(t, k):
    """Ranked hits with the labels of both sides."""
    labels = t.embeddings.select("vec_id", F.col("label").alias("album"))
    own = E.queries(t).select("query_id", F.col("label").alias("seed_album"))
    return K.with_payload(E.knn(t, k), labels, "vec_id").join(own, "query_id")


@query("overfetch_filter", f"""with {E.SCORED}, kept as (select *, cast(row_number() over (partition by query_id
  order by rank) as int) as r from ranked where rank <= 10 and {OTHERS})
select query_id, id, {sql6("score")} as score, r as rank from kept where r <= 3""")
def overfetch_filter(t):
    return E.shown(R.overfetch_filter(placed(t, 20), 3))


@query("exclude_self_album", f"""with {E.SCORED} select query_id, id, {sql6("score")} as score, rank from ranked
where rank <= 20 and id <> query_id and (seed_label = 9 or label <> seed_label)""")
def exclude_self_album(t):
    """Seeds of label 9 carry no album, so only the seed itself is dropped for them."""
    hits = placed(t, 20).withColumn("seed_album", F.nullif("seed_album", F.lit(9)))
    return E.shown(R.exclude_self_album(hits))


@query("eval_neighbors", E.EVAL_SQL)
def eval_neighbors(t):
    return R.eval_neighbors(*E.eval_tables(t), 5, E.DIM, vector_col="vector")


@query("eval_join", E.EVAL_SQL.replace("rank <= 5", "rank <= 7"))
def eval_join(t):
    corpus, wanted = E.eval_tables(t)
    queries = point_lookups(corpus, "file_hash", wanted).select(F.col("file_hash").alias("query_id"), "vector")
    hits = K.exact_knn(corpus, queries, 7, E.DIM, id_col="file_hash")
    return R.eval_join(hits, corpus, wanted)


ALIKE = ("select min(file_hash) as file_hash from tracks group by artist")


@query("most_alike", tracks_sql(f"""
select query_id, id, {sql6("score")} as score, cast(rank as int) as rank from (
  select a.file_hash as query_id, b.file_hash as id, list_cosine_similarity(a.vector_z, b.vector_z) as score,
    row_number() over (partition by a.file_hash order by
      round(list_cosine_similarity(a.vector_z, b.vector_z), 9) desc, b.file_hash) as rank
  from mart a cross join mart b where a.file_hash in ({ALIKE})) x where rank <= 10""", CTE_MART))
def most_alike(t):
    """Ten tracks most like the first track of every artist, from lineitem to neighbours."""
    first = t.tracks.groupBy("artist").agg(F.min("file_hash").alias("file_hash")).select("file_hash")
    return E.shown(jobs.most_alike(t.tracks, 10, first))


# The draws in SQL: before each one the weights of what remains are made anew.
DRAWS = f"""with recursive {E.SCORED},
pool as (select query_id, list({{'r': rank, 's': score, 'id': id}} order by rank) as rest from ranked
  where rank <= 25 group by query_id),
draws as (
  select query_id, 0 as turn, rest, cast(null as bigint) as id, cast(null as double) as score, cast(null as int) as rank
  from pool
  union all
  select query_id, turn + 1, list_filter(rest, lambda x: x.r <> hit.r), hit.id, hit.s, hit.r from (
    select query_id, turn, rest, rest[len(list_filter(runs, lambda c: c < point)) + 1] as hit from (
      select *, cast(concat('0x', substr(md5(concat('3|', query_id, '|', turn)), 1, 13)) as ubigint)
          / cast(16 as double) ** 13 * list_sum(weights) as point,
        list_transform(weights, lambda w, i: list_sum(weights[1:i])) as runs from (
        select *, list_transform(rest, lambda x: x.s - list_min(list_transform(rest, lambda y: y.s)) + 0.01) as weights
        from draws where turn < 5 and len(rest) > 0) w) p) d)"""


@query("weighted_sample", DRAWS + f""" select query_id, id, {sql6("score")} as score, rank from draws where turn > 0""")
def weighted_sample(t):
    return E.shown(R.weighted_sample(E.knn(t, 25), 5, seed=3))


@query("diversified_retrieve", DRAWS + f""" select query_id, id, {sql6("score")} as score,
  cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from draws where turn > 0""")
def diversified_retrieve(t):
    return E.shown(R.diversified_retrieve(t.embeddings, E.queries(t), 5, E.DIM, seed=3, id_col="vec_id",
                                          vector_col="embedding"))


def letter_counter():
    """A deterministic stand-in for an embedding model: 16 counts per text."""

    def embed(texts):
        vectors = []
        for text in texts:
            vector = [0.0] * 16
            for ch in text:
                vector[ord(ch) % 16] += 1.0
            vectors.append(vector)
        return vectors

    return embed


@query("embed_documents", """
select doc_id, cast(length(text) as double) as total from documents where length(trim(text)) > 0""")
def embed_documents(t):
    vectors = R.embed_documents(t.documents, letter_counter(), 16, key="doc_id", text="text")
    return vectors.select("doc_id", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).alias("total"))


def choosy(texts):
    """A model that refuses texts with an at sign and sometimes gives too short a vector."""
    if any("@" in text for text in texts):
        raise ValueError("refused")
    return [[float(len(text))] if len(text) % 10 == 3 else [float(len(text)), 1.0] for text in texts]


@query("embed_failures", """select doc_id, case when contains(text, '@') or length(text) % 10 = 3 then null else cast(length(text) as double) end as n,
  case when contains(text, '@') then 'refused' when length(text) % 10 = 3 then '1 numbers instead of 2' end as error
from documents where text is not null""")
def embed_failures(t):
    """What a failing model makes of every text: a vector or the reason why there is none."""
    attempts = R.embed_attempts(t.documents, choosy, 2, key="doc_id", text="text")
    return attempts.select("doc_id", F.col("vector")[0].alias("n"), "error")


@query("hashed_text_vectors", tracks_sql("select file_hash, 768 as dim, 1.0::double as length from tracks"))
def hashed_text_vectors(t):
    """The default text embedding of every track's sentences: unit vectors of 768 elements."""
    vectors = R.hashed_text_vectors(t.tracks.select("file_hash", track_document().alias("doc")))
    return vectors.select("file_hash", F.size("vector").alias("dim"), r6(X.norm(F.col("vector"))).alias("length"))


# Hits for contexts: the longest documents of every source.
CTE_CONTEXT = """hits as (select source as query_id, lang as artist, concat('t', doc_id) as title,
    substr(md5(text), 1, 6) as album, text as doc, cast(row_number() over (partition by source
      order by n_chars desc, doc_id) as int) as rank from documents),
ctx as (select query_id, string_agg(concat(rank, '. ', artist, ' — ', title, ' (', album, ')' || chr(10) || '   ',
  doc), chr(10) order by rank) as context from hits where rank <= 8 group by query_id)"""


def document_hits(t):
    docs = t.documents.select(
        F.col("source").alias("query_id"), F.col("lang").alias("artist"),
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"),
        F.substring(F.md5("text"), 1, 6).alias("album"), F.col("text").alias("doc"),
        F.col("n_chars").alias("score"), F.col("doc_id").alias("id"))
    return K.rank_hits(docs, 8)


@query("rag_context", f"with {CTE_CONTEXT} select query_id, md5(context) as context_md5 from ctx")
def rag_context(t):
    return R.rag_context(document_hits(t)).select("query_id", F.md5("context").alias("context_md5"))


@query("rag_context_budget", f"""with {CTE_CONTEXT}, texts as (select query_id, rank,
  concat(rank, '. ', artist, ' — ', title, ' (', album, ')' || chr(10) || '   ', doc) as line from hits where rank <= 5),
fit as (select *, sum(length(line) + 1) over (partition by query_id order by rank) - 1 as upto from texts)
select query_id, md5(string_agg(line, chr(10) order by rank)) as context_md5, count(*) as lines from fit
where upto <= 60000 or rank = 1 group by query_id""")
def rag_context_budget(t):
    """Every document of a source is a hit; a block takes the first five of them that fit."""
    by_length = Window.partitionBy("query_id").orderBy(F.col("n_chars").desc(), F.col("doc_id").asc())
    hits = t.documents.select(
        F.col("source").alias("query_id"), F.col("lang").alias("artist"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"),
        F.substring(F.md5("text"), 1, 6).alias("album"), F.col("text").alias("doc"), "n_chars", "doc_id")
    blocks = R.rag_context(hits.withColumn("rank", F.row_number().over(by_length)), k=5, budget=60_000)
    lines = F.size(F.regexp_extract_all("context", F.lit(r"(?m)^(\d+\. [a-z]+ — t\d+ \([0-9a-f]{6}\))$"), 1)).cast("long")
    return blocks.select("query_id", F.md5("context").alias("context_md5"), lines.alias("lines"))


RAG = """concat('Request: "', query_id, '?"', chr(10), chr(10), 'Candidates, best first:', chr(10), context, chr(10), chr(10),
  'Reply with a recommendation of at most five sentences. Every track in it has to be one of the numbered candidates; give its number.')"""


@query("rag_prompt", f"with {CTE_CONTEXT} select query_id, md5({RAG}) as prompt_md5, length({RAG}) as n from ctx")
def rag_prompt(t):
    prompts = R.rag_prompt(R.rag_context(document_hits(t)).withColumn("question", F.concat("query_id", F.lit("?"))))
    return prompts.select("query_id", F.md5("prompt").alias("prompt_md5"),
                          F.length("prompt").cast("bigint").alias("n"))


LINE = """concat(r.rank, '. ', b.artist, ' — ', b.title, ' (', b.album, ') [genre: ', b.genre, ', key: ',
  trim(concat(coalesce(b.key_key, ''), ' ', b.key_scale)), ', score: ', r.score, ']')"""


@query("similarity_prompt", f"""with {E.CTE_EVAL},
ctx as (select a.file_hash as query_id, a.artist, a.title, a.album, string_agg({LINE}, chr(10) order by r.rank) as c
  from (select s.file_hash as q, b.file_hash as id, cast(round(list_cosine_similarity(a.vector, b.vector), 4) as double)
      as score, row_number() over (partition by s.file_hash order by
        round(list_cosine_similarity(a.vector, b.vector), 9) desc, b.file_hash) as rank
    from eval_seeds s join corpus a on a.file_hash = s.file_hash cross join corpus b) r
  join corpus b on b.file_hash = r.id join corpus a on a.file_hash = r.q where r.rank <= 5 group by 1, 2, 3, 4)
select query_id, md5(concat('Seed track: ', artist, ' — ', title, ' (', album, ')', chr(10), chr(10),
  'Numbered neighbours in feature space:', chr(10), c, chr(10), chr(10), 'Write one paragraph on which of these neighbours ',
  'a listener of the seed track should hear first, and why, citing numbers.')) as prompt_md5 from ctx""")
def similarity_prompt(t):
    corpus, wanted = E.eval_tables(t)
    seeds = measured(point_lookups(corpus, "file_hash", wanted))
    queries = seeds.select(F.col("file_hash").alias("query_id"), "vector")
    hits = K.with_payload(K.exact_knn(corpus, queries, 5, E.DIM, id_col="file_hash"), corpus.drop("vector"),
                          "file_hash")
    contexts = R.rag_context(hits, R.neighbor_line()).join(
        seeds.select(F.col("file_hash").alias("query_id"), R.seed_text().alias("seed_text")), "query_id")
    return R.similarity_prompt(contexts).select("query_id", F.md5("prompt").alias("prompt_md5"))


@query("batch_generate", f"with {CTE_CONTEXT} select query_id, concat('echo ', length({RAG})) as answer, "
                         "cast(null as varchar) as error from ctx")
def batch_generate(t):
    prompts = R.rag_prompt(R.rag_context(document_hits(t)).withColumn("question", F.concat("query_id", F.lit("?"))))
    return R.batch_generate(prompts, lambda prompt: f"echo {len(prompt)}")


CARDS = f"""with {E.CTE_EVAL},
r as (select s.file_hash as query_id, b.*, list_cosine_similarity(a.vector, b.vector) as score,
    row_number() over (partition by s.file_hash order by
      round(list_cosine_similarity(a.vector, b.vector), 9) desc, b.file_hash) as rank
  from eval_seeds s join corpus a on a.file_hash = s.file_hash cross join corpus b),
art as (select *, case when substr(md5(lower(artist)), 1, 1) < '5' then concat('https://art.example/', lower(artist))
  end as url from r where rank <= 10),
led as (select *, row_number() over (partition by query_id order by (url is not null) desc, rank) as lead from art),
put as (select *, case when lead = 1 then 'hero' else 'supporting' end as role from led),
kept as (select *, row_number() over (partition by query_id, role order by rank) as place from put)
select query_id, cast(rank as int) as rank, role, url as artwork_url, {sql6("score")} as score, file_hash, title, artist,
  album, '1970' as year, genre, trim(concat(coalesce(key_key, ''), ' ', key_scale)) as key
from kept where role = 'hero' or place <= 5"""


@query("answer_cards", CARDS)
def answer_cards(t):
    corpus, wanted = E.eval_tables(t)
    queries = point_lookups(corpus, "file_hash", wanted).select(F.col("file_hash").alias("query_id"), "vector")
    hits = K.with_payload(K.exact_knn(corpus, queries, 10, E.DIM, id_col="file_hash"), corpus.drop("vector"),
                          "file_hash")
    cards = R.answer_cards(hits.withColumnRenamed("id", "file_hash").withColumn("date", F.lit("1970-01-01")), art_cache(corpus))
    return cards.withColumn("score", r6(F.col("score")))


def art_cache(corpus):
    hit = F.substring(F.md5(F.lower("artist")), 1, 1) < "5"
    return corpus.select("artist", "album").distinct().select(
        cache_key(F.col("artist"), F.col("album")).alias("cache_key"),
        F.when(hit, F.concat(F.lit("https://art.example/"), F.lower("artist"))).alias("artwork_url"),
        F.when(hit, "hit").otherwise("miss").alias("status"))


@query("more_like", f"""with {E.CTE_EVAL},
r as (select s.file_hash as query_id, a.artist as seed_artist, a.title as seed_title, a.album as seed_album, b.*,
    list_cosine_similarity(a.vector, b.vector) as score, row_number() over (partition by s.file_hash order by
      round(list_cosine_similarity(a.vector, b.vector), 9) desc, b.file_hash) as nth
  from eval_seeds s join corpus a on a.file_hash = s.file_hash cross join corpus b),
near as (select *, row_number() over (partition by query_id order by nth) as rank from r
  where nth <= 16 and file_hash <> query_id and album <> seed_album),
art as (select *, case when substr(md5(lower(artist)), 1, 1) < '5' then concat('https://art.example/', lower(artist))
  end as url from near where rank <= 5),
led as (select *, row_number() over (partition by query_id order by (url is not null) desc, rank) as lead from art)
select query_id, cast(rank as int) as rank, case when lead = 1 then 'hero' else 'supporting' end as role, url as artwork_url,
  {sql6("score")} as score, file_hash, title, artist, album, '1970' as year, genre,
  trim(concat(coalesce(key_key, ''), ' ', key_scale)) as key,
  concat('Seed track: ', seed_artist, ' — ', seed_title, ' (', seed_album, ')') as answer from led""")
def more_like(t):
    """Seeds, neighbours without seed and album, prompts, answers and scored cards in one job."""
    corpus, wanted = E.eval_tables(t)
    dated = corpus.withColumn("date", F.lit("1970-01-01"))
    _, cards = jobs.more_like(dated, wanted.select("file_hash"), lambda prompt: prompt.split("\n")[0], art_cache(corpus), 5, E.DIM)
    return cards.withColumn("score", r6(F.col("score")))


@query("describe_tracks", tracks_sql(f"select file_hash, md5({DOC}) as doc_md5 from mart", CTE_MART))
def describe_tracks(t):
    return jobs.describe(t.mart).select("file_hash", F.md5("doc").alias("doc_md5"))


@query("audio_points", tracks_sql("""select cast(cast(concat('0x', substr(file_hash, 1, 16)) as ubigint) as varchar) as
  id, file_hash, artist, genre, 'audio_v1' as vector_profile from tracks"""))
def audio_points(t):
    from vectormart.operators.collection import audio_points as points

    made = points(t.mart).filter(X.valid_vector(F.col("vector"), V.VECTOR_DIM))
    return made.select(F.col("id").cast("string").alias("id"), "file_hash", "artist", "genre", "vector_profile")


@query("text_collection", tracks_sql(f"""select cast(cast(concat('0x', substr(file_hash, 1, 16)) as ubigint) as varchar)
  as id, file_hash, title, coalesce(date, '') as date, md5({DOC}) as doc_md5, cast(length({DOC}) as double) as total
from tracks"""))
def text_collection(t):
    """Every track described, embedded and stored under its point id."""
    collection = jobs.load_text_collection(t.tracks, work_folder(t.spark, "collection"), letter_counter(), 16)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return collection.read().select(F.col("id").cast("string").alias("id"), "file_hash", "title", "date",
                                    F.md5("doc").alias("doc_md5"), total.alias("total"))


@query("audio_collection", tracks_sql(f"""select cast(cast(concat('0x', substr(file_hash, 1, 16)) as ubigint) as varchar)
  as id, file_hash, genre, vector_profile, {sql6("sqrt(list_sum(list_transform(vector_z, lambda x: x * x)))")} as norm
from (select *, 'audio_v1' as vector_profile from mart) m""", CTE_MART))
def audio_collection(t):
    """Every track of the mart stored with its standardised vector."""
    collection = jobs.load_audio_collection(t.mart, work_folder(t.spark, "collection"))
    return collection.read().select(F.col("id").cast("string").alias("id"), "file_hash", "genre", "vector_profile",
                                    r6(F.col("norm")).alias("norm"))
