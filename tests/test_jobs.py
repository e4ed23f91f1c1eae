import json
import math
import os

import pytest
from pyspark.sql import functions as F

from vectormart import fixed_values as V
from vectormart.operators import lookup, mart, names, paging, profile, staging, worklist
from vectormart.plans import jobs
from vectormart.session import work_folder
from vectormart.sources import readers, writers


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def document(key, bpm=100.0, **tags):
    return json.dumps({
        "metadata": {"tags": tags, "audio_properties": {"length": 60.0, "md5_encoded": key}},
        "rhythm": {"bpm": bpm}, "lowlevel": {"mfcc": {"mean": [1.0] * 13}},
    }, indent=1)


def test_documents_to_mart(spark, tmp_path):
    folder = str(tmp_path / "docs")
    write(folder, "b.json", document("k2", 120.0, artist="B", album="Y", title=["T"], tracknumber="03/12"))
    write(folder, "a.json", document("k1", 100.0, artist=["A"], album="X", genre="Comedy"))
    write(folder, "c.json", document("k1", 90.0, artist="C", album="Z"))
    write(folder, "bad.json", "{broken")
    write(folder, "skipped.txt", document("k9"))
    scanned = readers.scan_feature_json(spark, folder)
    assert [r["json_path"][-8:] for r in readers.rejected(scanned).collect()] == "bad.json".split("|")
    flat = staging.flatten_features(readers.accepted(scanned))
    assert [f.name for f in flat.schema] == [n for n, _ in V.FLAT_COLUMNS]
    assert readers.accepted(readers.scan_feature_json(spark, folder, limit=2)).count() == 2
    out = str(tmp_path / "flat")
    assert jobs.flatten_job(scanned, out, 2) == 3
    stored = readers.scan_features_parquet(spark, out)
    got = jobs.mart_job(stored, str(tmp_path / "unique"), str(tmp_path / "mart"))
    rows = {r["file_hash"]: r for r in got.collect()}
    assert sorted(rows) == ["k1", "k2"] and rows["k1"]["artist"] == "C" and len(got.columns) == 37
    assert rows["k2"]["bpm_z"] == pytest.approx(1 / math.sqrt(2)) and rows["k1"]["danceability_z"] is None
    unique = spark.read.parquet(str(tmp_path / "unique"))
    assert len(unique.columns) == 59
    assert unique.filter("file_hash = 'k2'").first()["tracknumber"] == 3
    stamp = unique.first()["extracted_at"]
    assert stamp.endswith("Z") and "T" in stamp


def test_file_listing(spark, tmp_path):
    root = str(tmp_path / "lib")
    for name in ("B/x.mp3", "A/b/y.FLAC", "A/z.m4p", "A/n.txt", "top.wav"):
        write(root, name, "x")
    write(root, "B/empty.mp3", "")
    manifest = readers.scan_file_manifest(spark, root)
    got = sorted((r["rel_path"], r["artist_dir"], r["ext"], r["length"]) for r in manifest.collect())
    assert got == [("A/b/y.FLAC", "A", "flac", 1), ("B/empty.mp3", "B", "mp3", 0), ("B/x.mp3", "B", "mp3", 1), ("top.wav", None, "wav", 1)]
    with pytest.raises(Exception):
        readers.scan_file_manifest(spark, str(tmp_path / "missing")).count()


def test_cache_file(spark, tmp_path):
    assert readers.scan_lookup_cache(spark, str(tmp_path / "none.json")).count() == 0
    path = write(str(tmp_path), "cache.json", json.dumps({"a|x": "https://u", "b|y": None, "c|z|w": "RETRY"}, indent=2))
    cache = lookup.cache_entries(readers.scan_lookup_cache(spark, path))
    got = {r["cache_key"]: (r["artist"], r["album"], r["artwork_url"], r["status"]) for r in cache.collect()}
    assert got == {"a|x": ("a", "x", "https://u", "hit"), "b|y": ("b", "y", None, "miss"),
                   "c|z|w": ("c", "z|w", None, "retry")}
    pairs = spark.createDataFrame([("A", "X"), ("B", "Y"), ("C", "Z|W"), ("D", "Q")], "artist string, album string")
    pending = lookup.lookup_pending(pairs, cache)
    assert sorted(r["artist"] for r in pending.collect()) == ["C", "D"]
    stats = lookup.cache_stats(cache, pairs).first()
    assert tuple(stats) == (1, 1, 1, 2, 50.0, 1)
    text = [json.loads(r[0]) for r in writers.cache_json(cache, V.RETRY_MARKER).collect()]
    assert {"c|z|w": "RETRY"} in text


def test_responses(spark):
    body = '{"results":[{"wrapperType":"collection","artworkUrl100":"https://a/100x100bb.jpg"}]}'
    rows = [("A", "X", 200, body), ("B", "Y", 200, "{}"), ("C", "Z", 429, body), ("D", "Q", None, None)]
    fresh = lookup.responses_to_cache(spark.createDataFrame(rows, "artist string, album string, http_status int, body string"))
    assert {r["artist"]: r["status"] for r in fresh.collect()} == {"A": "hit", "B": "miss", "C": "retry", "D": "retry"}
    assert fresh.filter("artist = 'C'").first()["artwork_url"] is None


def test_stats_files(spark, tmp_path):
    with pytest.raises(Exception):
        readers.scan_frozen_stats(spark, str(tmp_path / "none")).count()
    assert readers.scan_frozen_stats(spark, None) is None
    df = spark.createDataFrame([tuple([float(i)] * 11 + [5.0]) for i in range(4)],
                               ", ".join(f"{f} double" for f in V.FEATURES))
    writers.write_stats(mart.stats_table(mart.feature_stats(df)), str(tmp_path / "stats"))
    frozen = readers.scan_frozen_stats(spark, str(tmp_path / "stats"))
    vector = mart.frozen_zscore(df, frozen).orderBy("bpm").first()["vector"]
    assert vector[0] == pytest.approx(-1.5 / math.sqrt(5 / 3)) and vector[-1] == 0.0
    lone = mart.stats_table(mart.feature_stats(df.limit(1))).collect()
    assert all(r["std"] == 0.0 for r in lone)


def test_dedup(spark):
    rows = [("a", 1.0, "p2", 1), ("a", 3.0, "p9", 2), ("a", 3.0, "p1", 3), ("b", None, "q2", 4), ("b", 0.0, "q1", 5),
            (None, 9.0, "r", 6)]
    df = spark.createDataFrame(rows, "file_hash string, duration_sec double, json_path string, n int")
    once = staging.dedup_latest(df)
    assert sorted((r["file_hash"], r["n"], r["rn"]) for r in once.collect()) == [("a", 3, 1), ("b", 5, 1)]
    assert staging.dedup_latest(once.drop("rn")).count() == 2


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(30000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as file_hash",
                                       "cast(id as double) as duration_sec", "cast(id as string) as json_path")
    out = staging.dedup_latest(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert out.count() == 20001
    assert out.filter("file_hash = 'hot'").first()["duration_sec"] == 29997.0


def test_match_report_collisions(spark):
    dirs = spark.createDataFrame([("Björk", "/m/1"), ("bjork", "/m/2"), ("Other, Inc", "/m/3")],
                                 "artist_dir string, path string")
    targets = names.key_union(*[spark.createDataFrame([(n,)], "n string") for n in ("BJÖRK", "None")], lenient=True)
    files = spark.createDataFrame([("/m/2", "/m/2/a.mp3"), ("/m/2", "/m/2/b.mp3"), ("/m/1", "/m/1/c.mp3")],
                                  "dir_path string, path string")
    report = names.match_report(dirs, targets, files, lenient=True).collect()
    assert [tuple(r) for r in report] == [("Björk", "bjork", True, "bjork", 2)]
    wide = names.match_report(dirs, targets, files, lenient=True, prefix="O").collect()
    assert sorted(tuple(r) for r in wide) == [("Björk", "bjork", False, "", 2), ("Other, Inc", "other inc", False, "", 0)]
    matched = names.match_artists(dirs, targets, lenient=True)
    assert [r["path"] for r in names.select_files(files, matched).collect()] == ["/m/2/a.mp3", "/m/2/b.mp3"]
    assert names.match_artists(dirs).count() == 3


def test_run_summary(spark):
    rows = [("ok",), ("ok",), ("skip",), ("fail(1)",), ("error(X)",), ("dry-run",)]
    assert tuple(worklist.run_summary(spark.createDataFrame(rows, "status string")).first()) == (2, 1, 2)


@pytest.mark.parametrize("head", [0, 10 ** 6])
def test_slices(spark, monkeypatch, head):
    monkeypatch.setattr(paging, "HEAD_ROWS", head)
    df = spark.range(0, 997, 1, 7).select((F.col("id") * 389 % 997).alias("k"))
    for start, limit in ((0, 0), (0, 5), (100, 50), (990, 0), (990, 50), (5000, 3), (-2, 3)):
        want = list(range(997))[max(0, start):][: limit or None]
        assert [r["k"] for r in paging.slice_rows(df, start, limit, "k").collect()] == want


def test_row_index_with_one_huge_key(spark):
    df = spark.range(0, 3000, 1, 6).selectExpr("if(id % 3 = 0, 0, id) as k", "id")
    got = paging.row_index(df, F.col("k").asc(), F.col("id").asc()).collect()
    want = sorted((0 if i % 3 == 0 else i, i) for i in range(3000))
    assert sorted((r["row_index"], r["k"], r["id"]) for r in got) == [(n, k, i) for n, (k, i) in enumerate(want)]


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    import numpy as np

    rng = np.random.default_rng(5)
    hot = np.concatenate([np.full(1000, 0.5), rng.normal(size=2001)])
    few = np.array([1.0, 2.0, 4.0] + [np.nan] * 0)
    for values in (hot, few, np.array([7.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "a double")
        got = {r["p"]: r["quantile"] for r in profile.feature_quantiles(df, (0.0, 0.1, 0.5, 0.9, 1.0), ("a",), accuracy).collect()}
        for p, q in got.items():
            assert q == pytest.approx(float(np.quantile(values, p)), abs=1e-12)
        assert len(got) == 5


def test_quantiles_with_nan_nulls_and_wide_brackets(spark, monkeypatch):
    import numpy as np

    values = [float(v) for v in range(30)] + [math.nan] * 10 + [None] * 5
    df = spark.createDataFrame([(v, None) for v in values], "a double, none double")
    got = {r["p"]: r["quantile"] for r in profile.feature_quantiles(df, (0.0, 0.5, 0.9), ("a", "none")).collect()}
    assert got[0.0] == 0.0 and got[0.5] == 19.5 and math.isnan(got[0.9])
    # Brackets that miss the wanted ranks give way to wider ones.
    real = profile._brackets

    def wrong(*args):
        return {key: (n, [(1e6, 2e6), (-2e6, -1e6), edges[2]]) for key, (n, edges) in real(*args).items()}

    monkeypatch.setattr(profile, "_brackets", wrong)
    numbers = np.random.default_rng(2).normal(size=501)
    df = spark.createDataFrame([(float(v),) for v in numbers], "a double")
    for r in profile.feature_quantiles(df, (0.25, 0.9), ("a",)).collect():
        assert r["quantile"] == pytest.approx(float(np.quantile(numbers, r["p"])), abs=1e-12)
    assert profile.feature_quantiles(df.limit(0), (0.5,), ("a",)).collect() == []


def test_parts(spark, tmp_path):
    folder = str(tmp_path / "parts")
    assert writers.write_parts(spark.range(25), folder, 10) == 25
    assert writers.write_parts(spark.range(3), folder, 10) == 3
    assert spark.read.parquet(folder).count() == 3
    assert writers.write_parts(spark.range(0), folder, 10) == 0
    assert spark.read.parquet(folder).count() == 0
    single = str(tmp_path / "single")
    for rows in (40, 3):
        writers.write_single(spark.range(0, rows, 1, 4), single)
        assert spark.read.parquet(single).count() == rows
        assert len([f for f in os.listdir(single) if f.startswith("part-")]) > 1


def test_documents_are_parsed_once(spark, tmp_path):
    from vectormart.operators.staging import flatten_features
    from vectormart.sources import readers

    folder = tmp_path / "a +b%"
    folder.mkdir()
    (folder / "x 0.json").write_text('{"rhythm": {"bpm": 120.5}}')
    (folder / "y.json").write_text("no json")
    scanned = readers.scan_feature_json(spark, str(folder))
    flat = flatten_features(readers.accepted(scanned))
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1
    assert [r["json_path"] for r in flat.collect()] == [f"file:{folder}/x 0.json"]
    assert readers.rejected(scanned).count() == 1


def test_shared_folder(spark):
    assert work_folder(spark) != work_folder(spark)
    assert work_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_document_files_are_written_without_a_process_each(spark, tmp_path):
    """One file per row under its own name, and nothing beside them; written again, they are the same files."""
    from checks.sources import write_files

    root = str(tmp_path / "files")
    rows = spark.createDataFrame([(f"{i % 3}/{i}.txt", "x\u00e9" * i) for i in range(300)], "name string, content string")
    for _ in range(2):
        write_files(rows, root)
    found = {os.path.relpath(os.path.join(top, f), root) for top, _, files in os.walk(root) for f in files}
    assert found == {f"{i % 3}/{i}.txt" for i in range(300)}
    with open(f"{root}/1/7.txt", encoding="utf-8") as f:
        assert f.read() == "x\u00e9" * 7


def test_ingest_joins_tasks_of_small_files(spark, tmp_path):
    from vectormart.streaming import jobs as streams

    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    for i in range(40):
        write(source, f"{i}.json", document(f"k{i}"))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        streams.stream_ingest(spark, source, out, marks)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert spark.read.parquet(out).count() == 40
    assert len(spark.read.parquet(out).inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
