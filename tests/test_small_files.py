"""Folders of many small files are listed and read in tasks."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from checks.base import Tables
from tests.test_jobs import document, write
from vectormart.sources import readers, small_files
from vectormart.sources.small_files import BATCH_BYTES, folder_address, listed
from vectormart.streaming import jobs as streams


@pytest.fixture
def odd_folder(tmp_path):
    folder = str(tmp_path / "a +b%")
    for name in ("x 0.json", "y.json", "z%20.json", "Ü.json", "skipped.txt", ".hidden.json", "_hidden.json", "_k=v.json", "sub/inside.json", "w.json._COPYING_"):
        write(folder, name, document(name))
    write(folder, "empty.json", "")
    write(folder, "blank.json", " \n")
    write(folder, "large.json", "[" + "1, " * BATCH_BYTES + "1]")
    os.symlink(f"{folder}/nothing", f"{folder}/link.json")
    with open(f"{folder}/bytes.json", "wb") as f:
        f.write(b"\xef\xbb\xbf{\"a\": \"\xff\"}\r\n")
    os.utime(f"{folder}/y.json", ns=(0, 1_700_000_000_000_000_000))
    os.utime(f"{folder}/x 0.json", ns=(0, 1_700_000_000_123_999_999))
    return folder


def shown(texts):
    return sorted(texts.select(F.hex("value"), "json_path", "extracted_at").collect())


def test_tasks_read_what_spark_reads(spark, odd_folder):
    spark_reads = readers.file_provenance(spark.read.option("pathGlobFilter", "*.json").text(odd_folder, wholetext=True))
    found = readers.scan_feature_json(spark, odd_folder)
    assert shown(found) == shown(spark_reads) and found.count() == 8
    assert [f.name for f in found.schema] == ["value", "json_path", "extracted_at", "doc"]
    for limit in (0, 1, 3, 100):
        first = sorted(shown(spark_reads), key=lambda r: r["json_path"])[:limit]
        assert sorted(shown(readers.scan_feature_json(spark, odd_folder, limit)), key=lambda r: r["json_path"]) == first


def test_names_match_as_in_spark(spark, tmp_path):
    folder = str(tmp_path / "in")
    for name in ("a.json", "b.JSON", "ab.txt", "a^.json", "[a].json", "ajson", "a\nb.json"):
        write(folder, name, "{}")
    for pattern in ("*", "*.json", "?.json", "*.{json,txt}", "[^a].json", r"\[a\].json", "[a-b]*"):
        names = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
        assert sorted(listed(spark, folder_address(spark, folder), pattern).select("path").collect()) == sorted(names.collect()), pattern


def test_packed_files_and_key_value_folders(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(folder, "day=1/a.json", document("k1"))
    os.makedirs(f"{folder}/day=2")
    with gzip.open(f"{folder}/day=2/b.json.gz", "wt") as f:
        f.write(document("k2"))
    address = folder_address(spark, folder)
    texts = readers.file_texts(listed(spark, address, "*"), address)
    assert shown(texts) == shown(readers.file_provenance(spark.read.text(folder, wholetext=True)))


def test_what_only_spark_reads_is_left_to_it(spark, odd_folder):
    assert folder_address(spark, odd_folder) == f"file:{odd_folder}"
    for other in (f"{odd_folder}/*", f"{odd_folder}/y.json", f"{odd_folder}-missing", [odd_folder]):
        assert folder_address(spark, other) is None
    assert readers.scan_feature_json(spark, f"{odd_folder}/y.json").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.scan_feature_json(spark, f"{odd_folder}-missing")


def test_a_scan_leaves_no_names_on_the_driver(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(20):
        write(folder, f"{i}.json", document(f"k{i}"))
    for limit in (None, 10):
        scanned = readers.scan_feature_json(spark, folder, limit)
        assert not [f for f in scanned.inputFiles() if f.endswith(".json")]
        assert scanned.count() == (limit or 20)


def test_tasks_grow_with_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(small_files, "FILES_A_TASK", 1)
    folder = str(tmp_path / "in")
    least = 2 * spark.sparkContext.defaultParallelism
    for count in (2, least + 5):
        for i in range(count):
            write(folder, f"{i}.json", document(f"k{i}"))
        assert readers.scan_feature_json(spark, folder).rdd.getNumPartitions() == count


def test_documents_are_joined_without_a_broadcast(spark, tmp_path):
    spark.range(5).selectExpr(
        "id as p_partkey", "'n' as p_name", "'b' as p_brand", "'t' as p_type", "1 as p_size", "2.0D as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(10).selectExpr(
        "id % 4 as l_partkey", "1.0D as l_quantity", "1.0D as l_extendedprice", "0.1D as l_discount", "0.1D as l_tax").write.parquet(f"{tmp_path}/lineitem.parquet")
    files = Tables(spark, str(tmp_path)).document_files(".json")
    assert files.count() == 4
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan

def batches(out):
    return sorted(int(name.removeprefix("batch=")) for run in os.listdir(out) for name in os.listdir(f"{out}/{run}"))


def test_a_stream_leaves_no_names_in_its_log(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    for i in range(20):
        write(source, f"{i}.json", document(f"k{i}"))
    streams.stream_ingest(spark, source, out, marks)
    log = "".join(r["value"] for r in spark.read.text(f"{marks}/sources/0").collect())
    assert "arrivals" in log and ".json" not in log
    for name in ("empty.json", "broken.json"):
        write(source, name, "{" * (name == "broken.json"))
    for _ in range(2):
        streams.stream_ingest(spark, source, out, marks)
    assert batches(out) == [0, 1]
    assert sorted(r["file_hash"] for r in spark.read.parquet(out).collect()) == sorted(f"k{i}" for i in range(20))
    assert [r["json_path"] for r in spark.read.parquet(out + "-rejects").collect()] == [f"file:{source}/broken.json"]


def test_batches_of_a_stream_are_bounded_and_in_order(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    for i in range(7):
        os.utime(write(source, f"{i}.json", document(f"k{i}")), (1_700_000_000 - i, 1_700_000_000 - i))
    streams.stream_ingest(spark, source, out, marks, files_per_batch=3)
    rows = spark.read.parquet(out).groupBy("batch").agg(F.sort_array(F.collect_list("file_hash")).alias("keys")).orderBy("batch")
    assert [r["keys"] for r in rows.collect()] == [["k4", "k5", "k6"], ["k1", "k2", "k3"], ["k0"]]


def test_a_checkpoint_that_spark_began_goes_on(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("a +b%", "out", "marks"))
    write(source, "x 0.json", document("k0"))
    spark.readStream.option("pathGlobFilter", "*.json").text(source, wholetext=True).writeStream.foreachBatch(
        lambda batch, number: None).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    write(source, "y.json", document("k1"))
    for _ in range(2):
        streams.stream_ingest(spark, source, out, marks)
    assert [(r["file_hash"], r["batch"]) for r in spark.read.parquet(out).collect()] == [("k1", 1)]


def test_a_batch_that_failed_is_done_again(spark, tmp_path, monkeypatch):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    write(source, "a.json", document("k0"))
    with monkeypatch.context() as patched:
        patched.setattr(streams, "flatten_features", None)
        with pytest.raises(Exception):
            streams.stream_ingest(spark, source, out, marks)
    write(source, "b.json", document("k1"))
    streams.stream_ingest(spark, source, out, marks)
    assert sorted((r["file_hash"], r["batch"]) for r in spark.read.parquet(out).collect()) == [("k0", 0), ("k1", 1)]
