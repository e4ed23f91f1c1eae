"""Whole jobs built from the operators."""

from pyspark.sql import functions as F

from vectormart import fixed_values as V
from vectormart.functions.labels import track_document
from vectormart.operators import lookup as L
from vectormart.operators import retrieval as R
from vectormart.operators.catalog import point_lookups
from vectormart.operators.collection import AUDIO_PAYLOAD, TEXT_PAYLOAD, Collection, audio_points, text_points
from vectormart.operators.mart import audio_mart, feature_stats
from vectormart.operators.staging import dedup_latest, exclude_genres, flatten_features, staging_cast
from vectormart.session import written
from vectormart.sources.readers import accepted
from vectormart.sources.writers import write_parts


def flatten_job(scanned, folder, chunk_rows=5000):
    """Documents to flat Parquet parts."""
    return write_parts(flatten_features(accepted(scanned)), folder, chunk_rows)


def unique_features(flat):
    """Typed, filtered, de-duplicated rows of a flat dataset."""
    return dedup_latest(exclude_genres(staging_cast(flat)))


def mart_job(flat, unique_folder, mart_folder, profile=V.VECTOR_PROFILE):
    """Flat dataset to the stored mart.

    The de-duplicated rows are written first: the only wide shuffle then runs once, and
    the statistics read twelve columns of the result.
    """
    spark = flat.sparkSession
    unique_features(flat).write.mode("overwrite").parquet(unique_folder)
    unique = spark.read.parquet(unique_folder)
    audio_mart(unique, profile, feature_stats(unique)).write.mode("overwrite").parquet(mart_folder)
    return spark.read.parquet(mart_folder)


def load_audio_collection(mart, path, metric="cosine", kind="z", frozen=None):
    """Create the collection if needed and upsert every track of the mart."""
    collection = Collection(mart.sparkSession, path)
    collection.init(V.VECTOR_DIM, metric, ", ".join(f"{c} string" for c in AUDIO_PAYLOAD))
    collection.upsert(audio_points(mart, kind, frozen), key="file_hash")
    return collection


def load_text_collection(mart, path, embed, dim=V.TEXT_DIM, failures=None):
    """Describe every track, embed the texts and upsert them; keys and errors of failed texts go to the folder ``failures``.

    The attempts are written once, because embedding is the expensive step.
    """
    tracks = describe(mart)
    attempts = written(R.embed_attempts(tracks, embed, dim), "vectors")
    if failures:
        attempts.filter("error is not null").select("file_hash", "error").write.mode("overwrite").parquet(failures)
    collection = Collection(mart.sparkSession, path)
    collection.init(dim, "cosine", ", ".join(f"{c} string" for c in TEXT_PAYLOAD))
    collection.upsert(text_points(tracks, attempts.filter("error is null")), key="file_hash")
    return collection


def describe(mart):
    """Tracks with the sentence set that is embedded."""
    return mart.withColumn("doc", track_document())


def ask(corpus, questions, embed, generate, cache, k, dim, seed=0, diversified=True):
    """Questions (query_id, question) to answers and cards.

    One batch: embed the questions, search for all of them in one pass, build contexts
    and prompts, generate, and lay out the cards.
    """
    vectors = R.embed_documents(questions, embed, dim, key="query_id", text="question")
    if diversified:
        hits = R.diversified_retrieve(corpus, vectors, k, dim, seed)
    else:
        hits = R.exact_knn(corpus, vectors, k, dim)
    placed = R.with_payload(hits, corpus)
    contexts = R.rag_context(placed).join(questions, "query_id")
    # Written, so that each prompt is answered once however the answers are used.
    answers = written(R.batch_generate(R.rag_prompt(contexts), generate), "answers")
    return answers, R.answer_cards(placed, cache, answers)


def more_like(corpus, seeds, generate, cache, k, dim, mode="overfetch"):
    """Tracks like each seed (file_hash) with an answer about them: answers (query_id, answer, error) and cards.

    Neighbours leave out the seed and its album; the prompt lists them with their scores, and cards carry scores too.
    """
    wanted = written(point_lookups(corpus, "file_hash", seeds), "seeds")
    hits = R.similar_tracks(corpus, wanted, k, dim, id_col="file_hash", mode=mode)
    placed = written(R.with_payload(hits, corpus.drop("vector"), "file_hash").withColumn("file_hash", F.col("id")), "placed")
    named = wanted.select(F.col("file_hash").alias("query_id"), R.seed_text().alias("seed_text"))
    prompts = R.similarity_prompt(R.rag_context(placed, R.neighbor_line()).join(named, "query_id"))
    answers = written(R.batch_generate(prompts, generate), "answers")
    return answers, R.answer_cards(placed, cache, answers)


def refresh_cache(tracks, cache, responses):
    """One refresh of the artwork cache from fetched responses of pending pairs."""
    pending = L.lookup_pending(L.distinct_pairs(tracks), cache)
    fetched = responses.join(pending.select("artist", "album"), ["artist", "album"], "left_semi")
    return L.merge_cache(cache, L.responses_to_cache(fetched))


def most_alike(tracks, k, seeds):
    """The flagship query: the k nearest tracks of each seed by standardised features.

    Keys and vectors are written once; the seeds' vectors and the search then read two
    columns instead of computing the mart again.
    """
    vectors = written(audio_mart(tracks).select("file_hash", "vector_z"), "vectors")
    queries = point_lookups(vectors, "file_hash", seeds).select(
        F.col("file_hash").alias("query_id"), F.col("vector_z").alias("vector"))
    return R.exact_knn(vectors, queries, k, V.VECTOR_DIM, id_col="file_hash", vector_col="vector_z")
