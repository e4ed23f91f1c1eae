import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectormart.operators import approximate, knn, retrieval
from vectormart.operators.collection import Collection, collection_upsert
from vectormart.session import work_folder
from vectormart.streaming import jobs as streams

DIM = 6


def table(spark, rows, kind="bigint", extra=""):
    return spark.createDataFrame(rows, f"id {kind}, vector array<double>{extra}")


def brute(corpus, queries, k, metric="cosine"):
    def unit(v):
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n and metric == "cosine" else v

    out = []
    for q, qv in queries:
        scored = []
        for i, v in corpus:
            if v is None or len(v) != DIM or any(x is None or not math.isfinite(x) for x in v):
                continue
            scored.append((-round(sum(a * b for a, b in zip(unit(v), unit(qv))), 9), i))
        out += [(q, i, n + 1) for n, (_, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(hits):
    return sorted((r["query_id"], r["id"], r["rank"]) for r in hits.collect())


@pytest.fixture(scope="module")
def rows():
    """Random vectors of which a third are copies of one, and some that are not whole."""
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.normal(size=DIM)] for _ in range(400)]
    copy = vectors[0]
    out = [(i, copy if i % 3 == 0 else v) for i, v in enumerate(vectors)]
    return out + [(900, [0.0] * DIM), (901, None), (902, [1.0] * (DIM - 1)), (903, [math.nan] + [1.0] * (DIM - 1)),
                  (904, [None] + [1.0] * (DIM - 1)), (905, [math.inf] + [1.0] * (DIM - 1))]


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("bound", [knn.MAX_QUERY_BYTES, 8 * DIM * 3])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_exact_search(spark, rows, metric, bound, k):
    queries = [(i, v) for i, v in rows[:12]]
    hits = knn.exact_knn(table(spark, rows).repartition(5), table(spark, queries), k, DIM, query_id="id",
                         metric=metric, max_query_bytes=bound)
    assert found(hits) == brute(rows, queries, k, metric)


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_single_query(spark, rows, metric):
    for q in (rows[1], rows[3], (900, [0.0] * DIM)):
        hits = knn.knn_one(table(spark, rows), q[1], 7, metric=metric).withColumn("query_id", F.lit(q[0]))
        assert found(hits) == brute(rows, [q], 7, metric)


def test_text_ids_and_exclusions(spark):
    rows = [(f"k{i}", [float(i % 5), 1.0, 0.0, 0.0, 0.0, 0.0], "x" if i < 4 else None) for i in range(10)]
    corpus = table(spark, rows, "string", ", album string")
    queries = corpus.filter("id in ('k1', 'k7')").withColumnRenamed("id", "query_id")
    got = knn.exact_knn(corpus, queries, 50, DIM, exclude_self=True, exclude_group="album").collect()
    by = {q: {r["id"] for r in got if r["query_id"] == q} for q in ("k1", "k7")}
    assert by["k1"] == {f"k{i}" for i in range(4, 10)}
    assert by["k7"] == {f"k{i}" for i in range(10)} - {"k7"}


def test_degenerate_searches(spark, rows):
    corpus = table(spark, rows)
    assert knn.exact_knn(corpus, table(spark, rows[:2]), 0, DIM, query_id="id").count() == 0
    assert knn.exact_knn(corpus, table(spark, []), 5, DIM, query_id="id").count() == 0
    assert knn.exact_knn(table(spark, []), table(spark, rows[:2]), 5, DIM, query_id="id").count() == 0
    zero = knn.exact_knn(corpus, table(spark, [(900, [0.0] * DIM)]), 3, DIM, query_id="id").collect()
    assert [r["score"] for r in zero] == [0.0] * 3 and [r["id"] for r in zero] == [0, 1, 2]


def test_exact_mode_holds_every_overfetch_hit(spark, rows):
    corpus = table(spark, [(i, v, f"al{i % 4}") for i, v in rows], extra=", album string")
    seeds = corpus.filter("id < 5")
    over = retrieval.similar_tracks(corpus, seeds, 4, DIM).select("query_id", "id")
    exact = retrieval.similar_tracks(corpus, seeds, 4, DIM, mode="exact")
    assert exact.groupBy("query_id").count().filter("count = 4").count() == 5
    assert over.join(exact, ["query_id", "id"], "left_anti").count() == 0


def test_approximate_search(spark, rows):
    corpus, queries = table(spark, rows), table(spark, rows[1:9])
    folder = work_folder(spark, "cells")
    approximate.build_cells(corpus, folder, DIM, 8)
    assert spark.read.parquet(folder + "/points").count() == len(rows)
    exact = knn.exact_knn(corpus, queries, 5, DIM, query_id="id")
    everything = approximate.approx_knn(spark, folder, queries, 5, DIM, 8, query_id="id")
    assert found(everything) == found(exact)
    some = approximate.approx_knn(spark, folder, queries, 5, DIM, 2, query_id="id")
    assert approximate.recall(some, exact).agg(F.avg("recall")).first()[0] > 0.5


def hits_table(spark, scores, queries=1):
    rows = [(q, i + 1, float(s), 100 + i) for q in range(queries) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "query_id int, rank int, score double, id int")


def test_weighted_sample(spark):
    scores = [0.9, 0.8, 0.5, 0.5, 0.2]
    a = retrieval.weighted_sample(hits_table(spark, scores, 3), 3, seed=1)
    b = retrieval.weighted_sample(hits_table(spark, scores, 3).repartition(7), 3, seed=1)
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).filter(
        "n = 3 and d = 3").count() == 3
    assert retrieval.weighted_sample(hits_table(spark, scores[:2]), 5).count() == 2


def test_weighted_sample_frequencies(spark):
    """First draw: weights are score - lowest + 0.01; over many queries shares follow them."""
    scores = [0.9, 0.6, 0.3]
    picked = retrieval.weighted_sample(hits_table(spark, scores, 4000), 1, seed=9)
    counts = {r["id"]: r["count"] / 4000 for r in picked.groupBy("id").count().collect()}
    weights = [s - 0.3 + 0.01 for s in scores]
    for i, w in enumerate(weights):
        assert counts.get(100 + i, 0) == pytest.approx(w / sum(weights), abs=0.03)
    # Two draws leave out the weakest most often, and the second draw's weights are new.
    both = retrieval.weighted_sample(hits_table(spark, scores, 4000), 2, seed=9)
    share = {r["id"]: r["count"] / 4000 for r in both.groupBy("id").count().collect()}
    total = sum(weights)
    p_without_0 = weights[1] / total * (0.01 / (0.01 + 0.61)) + weights[2] / total * (0.01 / (0.01 + 0.31))
    assert share[100] == pytest.approx(1 - p_without_0, abs=0.03)


def test_heroes(spark):
    cases = {0: ["u", None, "v"], 1: [None, None, "v"], 2: [None, None], 3: ["", "v"]}
    rows = [(q, n + 1, u) for q, urls in cases.items() for n, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "query_id int, rank int, artwork_url string")
    heroes = retrieval.pick_hero(df).filter("role = 'hero'")
    assert sorted((r["query_id"], r["rank"]) for r in heroes.collect()) == [(0, 1), (1, 3), (2, 1), (3, 2)]


def test_embedding_skips_only_what_fails(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError("bad text")
        return [[float(len(t)), 1.0] if t != "short" else [1.0] for t in texts]

    docs = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "yy"), ("d", "short"), ("", "z"), ("e", None)],
                                 "file_hash string, doc string")
    got = retrieval.embed_documents(docs.coalesce(1), embed, 2).collect()
    assert sorted((r["file_hash"], r["vector"]) for r in got) == [("a", [1.0, 1.0]), ("c", [2.0, 1.0])]


def test_generation_reports_errors(spark):
    def generate(prompt):
        if prompt == "no":
            raise RuntimeError("down")
        return prompt.upper()

    df = spark.createDataFrame([(1, "yes"), (2, "no")], "query_id int, prompt string")
    got = retrieval.batch_generate(df, generate).orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [(1, "YES", None), (2, None, "down")]


def test_whole_question_job(spark):
    from vectormart.functions.text import cache_key
    from vectormart.plans import jobs

    def embed(texts):
        return [[float(t.count(c)) + 0.1 for c in "abcdef"] for t in texts]

    corpus = spark.createDataFrame(
        [(i, [float(x) + 0.1 for x in np.eye(DIM)[i % DIM]], f"h{i}", f"Ar{i}", f"Al{i}", f"T{i}", "1999", "Rock",
          "C", "minor", f"doc {i}") for i in range(30)],
        "id int, vector array<double>, file_hash string, artist string, album string, title string, date string, "
        "genre string, key_key string, key_scale string, doc string")
    questions = spark.createDataFrame([(1, "aaa"), (2, "ddd")], "query_id int, question string")
    cache = corpus.select(cache_key(F.col("artist"), F.col("album")).alias("cache_key"),
                          F.lit("https://u").alias("artwork_url"), F.lit("hit").alias("status"))
    answers, cards = jobs.ask(corpus, questions, embed, lambda p: p.split('"')[1], cache, 3, DIM, diversified=False)
    assert sorted((r["query_id"], r["answer"]) for r in answers.collect()) == [(1, "aaa"), (2, "ddd")]
    rows = cards.collect()
    assert len(rows) == 6 and {r["answer"] for r in rows if r["query_id"] == 2} == {"ddd"}
    assert {r["file_hash"] for r in rows if r["query_id"] == 1} == {"h0", "h6", "h12"}
    _, sampled = jobs.ask(corpus, questions, embed, lambda p: p, cache, 3, DIM, seed=4)
    assert sampled.count() == 6


def point_rows(ids, label, scale=1.0):
    return [(i, [scale * (i + 1)] * DIM, label) for i in ids]


def test_collection_life(spark):
    c = Collection(spark, work_folder(spark, "c"))
    with pytest.raises(ValueError):
        c.read()
    assert c.init(DIM, "cosine", "label string", "bigint") and not c.init(9, "dot", "label string", "bigint")
    assert c.read().count() == 0

    def points(ids, label):
        return table(spark, point_rows(ids, label), extra=", label string")

    assert c.upsert(points(range(5), "a")) == 5
    before = sorted(map(tuple, c.read().select("id", "label", "norm").collect()))
    c.upsert(points(range(5), "a"))
    assert sorted(map(tuple, c.read().select("id", "label", "norm").collect())) == before
    c.upsert(points([3, 7], "b"))
    c.upsert(points([3], "c"), batch="x")
    assert c.upsert(points([3], "d"), batch="x") == 0
    want = {0: "a", 1: "a", 2: "a", 3: "c", 4: "a", 7: "b"}
    assert {r["id"]: r["label"] for r in c.read().collect()} == want
    c.compact()
    assert {r["id"]: r["label"] for r in c.read().collect()} == want
    assert c.upsert(points([3], "d"), batch="x") == 0
    bad = table(spark, [(8, [1.0], "z"), (9, None, "z"), (None, [1.0] * DIM, "z"), (10, [math.nan] * DIM, "z")],
                extra=", label string")
    assert c.upsert(bad) == 0
    assert tuple(c.info().first()) == (DIM, "cosine", 6)
    c.recreate(DIM, "dot", "label string", "bigint")
    assert tuple(c.info().first()) == (DIM, "dot", 0)
    with pytest.raises(ValueError):
        c.recreate(DIM, "hamming", "label string", "bigint")


def test_replayed_batch_changes_nothing(spark):
    """Writers s1 and s2 write one id in turn; s1's batch comes again after a rewrite, and after half of it was lost."""
    c = Collection(spark, work_folder(spark, "c"))
    c.init(DIM, "cosine", "label string", "bigint", buckets=3)

    def points(ids, label):
        return table(spark, point_rows(ids, label), extra=", label string")

    assert c.upsert(points(range(9), "a"), writer="s1", batch=4) == 9
    assert c.upsert(points([1, 20], "b"), writer="s2", batch=0) == 2
    c.compact()
    assert c.upsert(points(range(9), "old"), writer="s1", batch=4) == 0 and c.upsert(points([1], "old"), writer="s1", batch=3) == 0
    assert {r["id"]: r["label"] for r in c.read().collect()} == {**dict.fromkeys(range(9), "a"), 1: "b", 20: "b"}
    assert c.upsert(points([1], "c"), writer="s1", batch=5) == 1
    # A bucket that has not taken a batch takes it when it is repeated; the others do not.
    written = c.upsert(points(range(9), "d"), writer="s1", batch=5)
    assert 0 < written < 9
    labels = {r["id"]: r["label"] for r in c.read().collect()}
    assert labels[1] == "c" and sum(x == "d" for x in labels.values()) == written
    assert c.upsert(points([], "e"), writer="s1", batch=6) == 0 and c.read().count() == 10


def test_search_of_a_collection(spark):
    c = Collection(spark, work_folder(spark, "c"))
    c.init(2, "cosine", "file_hash string, artist string, album string, title string, genre string, key_key string, key_scale string", "bigint")
    rows = [(i, [1.0, i / 4], f"h{i}", "A", "B", f"t{i}", "Rock" if i % 2 else "Folk", None, "minor") for i in range(8)]
    c.upsert(spark.createDataFrame(rows, "id long, vector array<double>, file_hash string, artist string, album string, title string, "
                                   "genre string, key_key string, key_scale string"))
    keys = spark.createDataFrame([("h0",), ("h7",), ("absent",)], "file_hash string")
    got = sorted((r["query_id"], r["rank"], r["id"], r["key"]) for r in c.similar(keys, 2, genre="Rock", key_key=None).collect())
    assert got == [("h0", 1, 1, "-minor"), ("h0", 2, 3, "-minor"), ("h7", 1, 7, "-minor"), ("h7", 2, 5, "-minor")]


def test_later_row_of_a_batch_wins(spark):
    old = table(spark, point_rows([1], "a"), extra=", label string")
    new = spark.createDataFrame([(1, [1.0] * DIM, "x", 1), (1, [2.0] * DIM, "y", 2), (2, [1.0] * DIM, "z", 0)],
                                "id bigint, vector array<double>, label string, seq int")
    got = collection_upsert(old, new, DIM, seq="seq")
    assert {r["id"]: r["label"] for r in got.collect()} == {1: "y", 2: "z"}


def test_streaming_twice(spark, tmp_path):
    from tests.test_jobs import document, write

    folder, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    write(folder, "a.json", document("k1"))
    write(folder, "b.json", "{broken")
    streams.stream_ingest(spark, folder, out, marks)
    streams.stream_ingest(spark, folder, out, marks)
    assert [r["file_hash"] for r in spark.read.parquet(out).collect()] == ["k1"]
    refused = spark.read.parquet(out + "-rejects")
    assert [(r["json_path"][-6:], r["reason"]) for r in refused.collect()] == [("b.json", "no JSON")]
    write(folder, "c.json", document("k2"))
    streams.stream_ingest(spark, folder, out, marks, files_per_batch=1)
    assert sorted(r["file_hash"] for r in spark.read.parquet(out).collect()) == ["k1", "k2"]


def test_similar_tracks_without_a_group(spark):
    corpus = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(6)], "id int, vector array<double>")
    for mode in ("overfetch", "exact"):
        hits = retrieval.similar_tracks(corpus, corpus.filter("id = 0"), 2, 2, group=None, mode=mode)
        assert [(r["id"], r["rank"]) for r in hits.orderBy("rank").collect()] == [(1, 1), (2, 2)]
