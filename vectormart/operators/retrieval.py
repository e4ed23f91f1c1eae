"""From hits to answers: exclusion, sampling, contexts, prompts and cards.

Every per-query group below has been cut to a fixed number of hits first, so nothing
here gathers an unbounded group.
"""

import re

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectormart import fixed_values as V
from vectormart.functions.labels import or_default
from vectormart.functions.text import blank_to_null, key_label
from vectormart.operators.catalog import point_lookups, track_card
from vectormart.operators.knn import exact_knn, rank_hits, with_payload
from vectormart.operators.lookup import attach_artwork
from vectormart.session import measured


def exclude_self_album(hits, seed="query_id", hit="id", seed_album="seed_album", album="album"):
    """Drop the seed itself and rows of the seed's album; a NULL seed album drops nothing."""
    own_album = F.col(seed_album).isNotNull() & F.col(album).eqNullSafe(F.col(seed_album))
    return hits.filter((F.col(hit) != F.col(seed)) & ~own_album)


def overfetch_filter(hits, k, **columns):
    """Exclude from ``3k + 1`` ranked hits, then keep the best k; fewer may remain."""
    fetched = hits.filter(F.col("rank") <= V.FETCH_FACTOR_AUDIO * k + 1)
    return rank_hits(exclude_self_album(fetched, **columns).drop("rank"), k)


def similar_tracks(corpus, seeds, k, dim, *, id_col="id", vector_col="vector", group="album", mode="overfetch",
                   metric="cosine"):
    """Tracks like each seed, without the seed and its album.

    ``overfetch`` reads 3k + 1 hits and drops afterwards, so it may return fewer than
    k; ``exact`` drops inside the search and always finds k if they exist.  Without a
    ``group`` only the seed itself is left out.
    """
    album = [F.col(group)] if group else []
    queries = seeds.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("vector"), *album)
    args = dict(id_col=id_col, vector_col=vector_col, query_vector="vector", metric=metric)
    if mode == "exact":
        return exact_knn(corpus, queries, k, dim, exclude_self=True, exclude_group=group, **args)
    fetched = exact_knn(corpus, queries, V.FETCH_FACTOR_AUDIO * k + 1, dim, **args)
    if not group:
        return rank_hits(fetched.filter("id != query_id").drop("rank"), k).select("query_id", "id", "score", "rank")
    albums = corpus.select(id_col, F.col(group).alias("album"))
    placed = with_payload(fetched, albums, id_col)
    placed = placed.join(measured(queries.select("query_id", F.col(group).alias("seed_album"))), "query_id")
    return overfetch_filter(placed, k).select("query_id", "id", "score", "rank")


def resort_hits(hits, order_by=("score",), keep=None):
    """Hits back in score order per query, numbered from 1; optionally only the first few."""
    ranked = hits.drop("rank").withColumn(
        "rank",
        F.row_number().over(
            Window.partitionBy("query_id").orderBy(*[F.col(c).desc() for c in order_by], F.col("id").asc())
        ),
    )
    return ranked.filter(F.col("rank") <= keep) if keep else ranked


def weighted_sample(hits, k, seed=0):
    """Draw k hits per query without replacement, favouring high scores.

    Before each draw a candidate weighs its score minus the lowest remaining score plus
    0.01, so the weights shift from draw to draw.  Draws depend only on the seed, the
    query and the draw number: a task that runs again repeats them.  The pool of a
    query is all hits it was given; searches bound it by their k.
    """
    columns = ["query_id", "rank", "score", "id"]
    floor = V.SAMPLE_FLOOR

    def draw(pool: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        import numpy as np

        pool = pool.sort_values("rank")
        scores, query = pool["score"].to_numpy(float), pool["query_id"].iloc[0]
        left = np.ones(len(scores), bool)
        for turn in range(min(k, len(scores))):
            digits = hashlib.md5(f"{seed}|{query}|{turn}".encode("utf-8")).hexdigest()[:13]
            mass = np.cumsum(np.where(left, scores - scores[left].min() + floor, 0.0))
            reached = left & (mass >= int(digits, 16) / float(16 ** 13) * mass[-1])
            left[np.argmax(reached)] = False
        return pool[~left]

    pool = hits.select(*columns)
    return pool.groupBy("query_id").applyInPandas(draw, pool.schema)


def fetch_size(k, limit=V.FETCH_LIMIT_TEXT):
    """Five times k, held at ``limit``, and never below k."""
    return max(k, min(V.FETCH_FACTOR_TEXT * k, limit))


def diversified_retrieve(corpus, queries, k, dim, seed=0, **args):
    """Fetch ``fetch_size(k)`` hits per query, sample k by weight, back in score order."""
    fetched = exact_knn(corpus, queries, fetch_size(k), dim, **args)
    return resort_hits(weighted_sample(fetched, k, seed))


def embed_attempts(docs, embed, dim, key="file_hash", text="doc", batch=50):
    """Vector of every text, or why there is none: (key, vector, error).

    ``embed`` takes a list of texts and returns a list of vectors.  A batch that raises is halved until the texts that
    it fails on stand alone, so a bad text costs a few calls and loses only itself.  A vector of another length is an
    error too.  Rows without a key or text are not embedded and not listed.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("vector", T.ArrayType(T.DoubleType())),
                           T.StructField("error", T.StringType())])

    def run(frames):
        def attempt(texts):
            try:
                vectors = list(embed(texts))
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                return [([float(x) for x in v], None) if len(v) == dim else (None, f"{len(v)} numbers instead of {dim}") for v in vectors]
            except Exception as problem:
                if len(texts) == 1:
                    return [(None, str(problem) or type(problem).__name__)]
                half = len(texts) // 2
                return attempt(texts[:half]) + attempt(texts[half:])

        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                done = attempt(part[text].tolist())
                yield pd.DataFrame({key: part[key].to_numpy(), "vector": pd.Series([d[0] for d in done], dtype=object),
                                    "error": pd.Series([d[1] for d in done], dtype=object)})

    present = docs.filter(blank_to_null(F.col(key).cast("string")).isNotNull() & F.col(text).isNotNull())
    return present.select(key, text).mapInPandas(run, schema)


def embed_documents(docs, embed, dim, key="file_hash", text="doc", batch=50):
    """Vector of every text: (key, vector).  Texts that fail are left out; ``embed_attempts`` tells why."""
    return embed_attempts(docs, embed, dim, key, text, batch).filter("error is null").drop("error")


def hashed_text_vectors(docs, dim=V.TEXT_DIM, key="file_hash", text="doc"):
    """Default embedding without a model: hashed, weighted and normalised words (MLlib)."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
    from pyspark.ml.functions import vector_to_array

    present = docs.select(key, text).filter(F.col(text).isNotNull())
    words = Tokenizer(inputCol=text, outputCol="words").transform(present)
    counts = HashingTF(numFeatures=dim, inputCol="words", outputCol="counts").transform(words)
    weighted = IDF(inputCol="counts", outputCol="weighted").fit(counts).transform(counts)
    unit = Normalizer(inputCol="weighted", outputCol="unit").transform(weighted)
    return unit.select(key, vector_to_array("unit").alias("vector"))


MISSING = {"artist": V.UNKNOWN_ARTIST, "title": V.UNKNOWN_TITLE, "album": V.UNKNOWN_ALBUM}


def context_line(t=F.col):
    """"artist — title (album)" with the track's sentences on an indented next line."""
    def shown(name):
        return F.coalesce(t(name), F.lit(MISSING[name]))

    return F.concat(
        shown("artist"), F.lit(f" {V.DASH} "), shown("title"), F.lit(" ("), shown("album"), F.lit(")\n   "),
        F.coalesce(t("doc"), F.lit("")),
    )


def neighbor_line(t=F.col):
    """"artist — title (album) [genre: ..., key: ..., score: ...]"."""
    def shown(name):
        return F.coalesce(t(name), F.lit(MISSING[name]))

    key = F.trim(F.concat_ws(" ", F.coalesce(t("key_key"), F.lit("")), F.coalesce(t("key_scale"), F.lit(""))))
    return F.concat(
        shown("artist"), F.lit(f" {V.DASH} "), shown("title"), F.lit(" ("), shown("album"), F.lit(") [genre: "),
        or_default(t("genre"), V.DASH), F.lit(", key: "), key, F.lit(", score: "),
        F.round(t("score"), 4).cast("string"), F.lit("]"),
    )


def context_number(hits, k, order, query="query_id"):
    """Number the first k lines of each query from 1."""
    in_order = Window.partitionBy(query).orderBy(*order)
    return hits.withColumn("line", F.row_number().over(in_order)).filter(F.col("line") <= k)


def rag_context(hits, line=None, query="query_id", rank="rank", k=V.FETCH_LIMIT_TEXT, budget=None):
    """One numbered text block per query from its best ``k`` ranked hits, best first.

    ``budget`` bounds the characters of a block: it ends before the first line that does not fit, but never
    before the second line.  Hits are cut before they are gathered, however many a query has.
    """
    in_order = Window.partitionBy(query).orderBy(F.col(rank).asc(), F.col("text").asc())
    numbered = hits.select(query, rank, F.concat(F.col(rank).cast("string"), F.lit(". "),
                                                 context_line() if line is None else line).alias("text"))
    kept = numbered.withColumn("_line", F.row_number().over(in_order)).filter(F.col("_line") <= k)
    if budget is not None:
        # A line that does not fit is longer than what is left, and so is the sum up to any later line.
        kept = kept.withColumn("_upto", F.sum(F.length("text") + 1).over(in_order) - 1).filter((F.col("_upto") <= budget) | (F.col("_line") == 1))
    lines = F.array_sort(F.collect_list(F.struct("_line", "text")))
    return kept.groupBy(query).agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("context"))


RAG_TEMPLATE = """Request: "{question}"

Candidates, best first:
{context}

Reply with a recommendation of at most five sentences. Every track in it has to be one of the numbered candidates; \
give its number."""
SIMILARITY_TEMPLATE = """Seed track: {seed}

Numbered neighbours in feature space:
{context}

Write one paragraph on which of these neighbours a listener of the seed track should hear first, and why, citing numbers."""


def filled(template, **columns):
    """A text with columns in place of the names in braces."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[columns[part] if i % 2 else F.lit(part) for i, part in enumerate(parts) if part])


def rag_prompt(contexts, question="question", template=RAG_TEMPLATE):
    """The prompt for a question and the numbered tracks found for it; ``template`` names {question} and {context}."""
    return contexts.withColumn("prompt", filled(template, question=F.col(question), context=F.col("context")))


def similarity_prompt(contexts, seed="seed_text", template=SIMILARITY_TEMPLATE):
    """The prompt for a seed and its numbered neighbours; ``template`` names {seed} and {context}."""
    return contexts.withColumn("prompt", filled(template, seed=F.col(seed), context=F.col("context")))


def seed_text(t=F.col):
    def shown(name):
        return F.coalesce(t(name), F.lit(MISSING[name]))

    return F.concat(shown("artist"), F.lit(f" {V.DASH} "), shown("title"), F.lit(" ("), shown("album"), F.lit(")"))


def batch_generate(prompts, generate, key="query_id", prompt="prompt"):
    """Answer of a user-supplied callable per prompt: (key, answer, error)."""
    kind = prompts.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("answer", T.StringType()),
                           T.StructField("error", T.StringType())])

    def run(frames):
        def attempt(text):
            try:
                return generate(text), None
            except Exception as problem:
                return None, str(problem)

        for frame in frames:
            done = [attempt(p) for p in frame[prompt]]
            yield pd.DataFrame({key: frame[key], "answer": pd.Series([d[0] for d in done], dtype=object),
                                "error": pd.Series([d[1] for d in done], dtype=object)})

    return prompts.select(key, prompt).mapInPandas(run, schema)


def pick_hero(hits):
    """Role of each hit: the first with artwork is the hero, else the first of all."""
    has_art = blank_to_null(F.col("artwork_url")).isNotNull()
    lead = Window.partitionBy("query_id").orderBy(has_art.desc(), F.col("rank").asc())
    named = hits.withColumn("_lead", F.row_number().over(lead))
    return named.withColumn("role", F.when(F.col("_lead") == 1, "hero").otherwise("supporting")).drop("_lead")


def answer_cards(hits, cache, answers=None, supporting=V.SUPPORTING_CARDS):
    """Hero and up to ``supporting`` more cards per query, in rank order, with the answer."""
    roles = pick_hero(attach_artwork(hits, cache))
    kept_order = Window.partitionBy("query_id", "role").orderBy("rank")
    cards = track_card(roles.withColumn("place", F.row_number().over(kept_order)).filter(
        (F.col("role") == "hero") | (F.col("place") <= supporting)
    ))
    return cards.join(answers.select("query_id", "answer"), "query_id", "left") if answers is not None else cards


def eval_join(hits, corpus, seeds):
    """Seed metadata beside each neighbour's: the 16 columns of the review table."""
    names = ("artist", "title", "album", "genre")

    def meta(prefix):
        return [F.coalesce(c, F.lit("")).alias(prefix + c) for c in names] + [
            key_label(F.col("key_key"), F.col("key_scale")).alias(prefix + "key")]

    seed = corpus.join(measured(seeds), "file_hash").select(
        F.col("file_hash").alias("query_id"), F.col("label").alias("seed_label"), *meta("seed_"))
    near = corpus.select("file_hash", *meta("neighbor_"))
    return with_payload(hits, near, "file_hash").join(measured(seed), "query_id").select(
        "seed_label", F.col("query_id").alias("seed_file_hash"), "seed_artist", "seed_title", "seed_album",
        "seed_genre", "seed_key", "rank", F.round("score", 6).alias("score"),
        F.col("id").alias("neighbor_file_hash"), "neighbor_artist", "neighbor_title", "neighbor_album",
        "neighbor_genre", "neighbor_key", (F.col("id") == F.col("query_id")).alias("is_self"),
    )


def eval_neighbors(corpus, seeds, k, dim, vector_col="vector_z", metric="cosine"):
    """Review table of many seeds (file_hash, label); a seed without a vector is skipped."""
    queries = point_lookups(corpus, "file_hash", seeds).select(
        F.col("file_hash").alias("query_id"), F.col(vector_col).alias("vector"))
    hits = exact_knn(corpus, queries, k, dim, id_col="file_hash", vector_col=vector_col, metric=metric)
    return eval_join(hits, corpus, seeds)
