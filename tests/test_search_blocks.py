"""Query blocks with bounds, and the inverted file, against the plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_search import DIM, brute, found, rows, table  # noqa: F401
from vectormart.operators import approximate, knn
from vectormart.session import work_folder


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("growth, bytes_", [(6, 8 * DIM * 100), (64, 8 * DIM * 9)])
def test_growing_shares_change_nothing(spark, rows, metric, growth, bytes_, monkeypatch):  # noqa: F811
    monkeypatch.setattr(knn, "GROWTH", growth)
    queries = rows[:14]
    corpus = table(spark, rows).repartition(6)
    shares = knn.corpus_shares(corpus, len(queries), 3, DIM, 0)
    assert len(shares) > 1 and shares == sorted(shares) and shares[-1] == 1 << 30
    hits = knn.exact_knn(corpus, table(spark, queries), 3, DIM, query_id="id", metric=metric, max_query_bytes=bytes_, most_hits=0)
    assert found(hits) == brute(rows, queries, 3, metric)


def test_one_query_id_in_many_blocks(spark, rows):  # noqa: F811
    """Queries that share an id are one query with the best rows of all of them."""
    queries = [(1, rows[k][1]) for k in range(1, 8)]
    hits = knn.exact_knn(table(spark, rows), table(spark, queries), 4, DIM, query_id="id", max_query_bytes=8 * DIM * 2)
    assert sorted(r["rank"] for r in hits.collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_given_centres(spark, rows, metric, monkeypatch):  # noqa: F811
    monkeypatch.setattr(approximate, "CENTRE_BYTES", 8 * DIM * 2)
    monkeypatch.setattr(approximate, "LIST_ROWS", 16)
    corpus, queries = table(spark, rows, extra="").withColumn("cell", F.lit("own")), table(spark, rows[1:9])
    centres = spark.createDataFrame([(7, [1.0] + [0.0] * 5), (3, [0.0, 1.0] + [0.0] * 4), (5, [-1.0] * 6)], "cell int, centre array<double>")
    folder = work_folder(spark, "cells")
    approximate.build_cells(corpus, folder, DIM, centres=centres)
    lists = spark.read.parquet(folder + "/lists")
    assert lists.agg(F.sum(F.size("ids"))).first()[0] == 401 and lists.agg(F.max(F.size("ids"))).first()[0] <= 24
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:400]}
    m = {r.cell: np.array(r.centre) / np.linalg.norm(r.centre) for r in centres.collect()}
    for r in lists.collect():
        for i in r.ids:
            want = -1 if i == 900 else min(m, key=lambda c: (-round(float(unit[i] @ m[c]), 9), c))
            assert r.cell == want
    every = approximate.approx_knn(spark, folder, queries, 5, DIM, 3, query_id="id", metric=metric, shortlist=100)
    assert found(every) == brute(rows, rows[1:9], 5, metric)


def test_empty_index_and_queries(spark, rows):  # noqa: F811
    folder = work_folder(spark, "cells")
    centres = spark.createDataFrame([(0, [1.0] * DIM)], "cell int, centre array<double>")
    approximate.build_cells(table(spark, [(1, None), (2, [0.0] * DIM)]), folder, DIM, centres=centres)
    hits = approximate.approx_knn(spark, folder, table(spark, rows[:2]), 5, DIM, 3, query_id="id")
    assert sorted((r.query_id, r.id, r.score) for r in hits.collect()) == [(0, 2, 0.0), (1, 2, 0.0)]
    assert approximate.approx_knn(spark, folder, table(spark, []), 5, DIM, 3, query_id="id").collect() == []
    with pytest.raises(ValueError):
        approximate.build_cells(table(spark, []), folder, DIM)


def test_ranks_are_among_all_rows(spark):
    """Every embedding is a hit of every seed, those of other labels too."""
    from checks import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    got = QUERIES["neighbor_rank"](spark, sf_dir)
    stored = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    unit = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(r.embedding) for r in stored}
    label = {r.vec_id: r.label for r in stored}
    seeds = {label[i]: i for i in sorted(label, reverse=True)}.values()
    want = [(q, i, n + 1) for q in seeds for n, i in enumerate(sorted(unit, key=lambda i: (-round(float(unit[i] @ unit[q]), 9), i))[:12])]
    assert found(got) == sorted(want) and any(label[q] != label[i] for q, i, _ in want)


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_codes_lose_no_row_of_a_visited_cell(spark, metric, monkeypatch):
    """Codes of two words put true neighbours far behind the short list; their bounds bring them back."""
    monkeypatch.setattr(approximate, "WORDS", 2)
    monkeypatch.setattr(approximate, "LIST_ROWS", 100)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=DIM)]) for i in range(1500)] + [(2000, [0.0] * DIM)]
    folder = work_folder(spark, "cells")
    centres = spark.createDataFrame([(c, rows[c][1]) for c in range(4)], "cell int, centre array<double>")
    approximate.build_cells(table(spark, rows), folder, DIM, centres=centres)
    hits = approximate.approx_knn(spark, folder, table(spark, rows[:9]), 5, DIM, 4, query_id="id", metric=metric, shortlist=1)
    assert found(hits) == brute(rows, rows[:9], 5, metric)
