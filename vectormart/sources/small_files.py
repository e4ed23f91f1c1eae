"""Folders of many small files: tasks list them and read them, so that the driver never holds their names."""

import re

from pyspark.sql import functions as F

from vectormart.session import path_exists

# Files of one task at most, unless there are fewer tasks than two a core; and bytes of text that go to Spark at once.
FILES_A_TASK = 4_000
BATCH_BYTES = 4 << 20
# Path, bytes and time of the last change in milliseconds.
LISTED = "path string, length long, changed long"
# Names that Spark unpacks by their ending.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"


def folder_address(spark, folder):
    """Full address of one folder that tasks can list by themselves; None for patterns, files and stores that only Spark knows."""
    if not isinstance(folder, str) or re.search(r"[\\*?\[\]{}]", folder):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    # The log of a streaming sink names the files that count; Spark reads it.
    if not system.exists(path) or not system.getFileStatus(path).isDirectory() or path_exists(spark, f"{folder}/_spark_metadata"):
        return None
    address = system.makeQualified(path).toString()
    try:
        _opener(address)()
    except (ImportError, OSError, ValueError, NotImplementedError):
        return None
    return address


def _opener(address):
    """A function for the tasks that gives Arrow's file system of an address and the folder's name there."""

    def opened():
        from urllib.parse import quote

        from pyarrow.fs import FileSystem, LocalFileSystem

        if address.startswith("file:"):
            return LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
        return FileSystem.from_uri(quote(address, safe=":/@"))

    return opened


def listed(spark, address, pattern):
    """Files of a folder whose names match, as Spark's readers see them: no hidden ones, and sub-folders only if named key=value.

    One task walks through the folder, whose entries have no other order to share them out by; a local folder is never
    held as a whole, not even there.
    """
    matching = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().toString()
    name = F.substring_index("path", "/", -1)
    found = spark.range(0, 1, 1, 1).mapInArrow(_listing(address, _opener(address)), LISTED)
    return found.filter(name.rlike(rf"(?s)\A(?:{matching})\z"))


def _listing(address, opener):
    def run(batches):
        import os
        from itertools import batched

        import pyarrow as pa
        from pyarrow.fs import FileSelector, FileType, LocalFileSystem

        files, top = opener()

        def local(folder):
            with os.scandir(folder) as entries:
                for entry in entries:
                    try:
                        seen = entry.stat()
                    except FileNotFoundError:  # gone, or a link to nothing
                        continue
                    name = os.fsencode(entry.name).decode("utf-8", "replace")
                    yield name, entry.is_dir(), seen.st_size, seen.st_mtime_ns

        def stored(folder):
            for info in files.get_file_info(FileSelector(folder)):
                yield info.base_name, info.type == FileType.Directory, info.size, info.mtime_ns or 0

        def below(folder, path):
            for name, is_folder, length, changed in (local if isinstance(files, LocalFileSystem) else stored)(folder):
                if name[0] == "." or name[0] == "_" and "=" not in name or name.endswith("._COPYING_"):
                    continue
                if not is_folder:
                    yield f"{path}/{name}", length, changed // 1_000_000
                elif "=" in name:
                    yield from below(f"{folder}/{name}", f"{path}/{name}")

        for batch in batches:
            for rows in batched(below(top, address.rstrip("/")), 10_000):
                paths, lengths, times = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(times, pa.int64())],
                                                 names=["path", "length", "changed"])

    return run


def contents(files, address):
    """Whole texts of listed files, read in the tasks: (path, changed, value).  Empty files give no row, as with Spark's readers."""
    whole = files.filter("length > 0")
    count = whole.count()
    tasks = max(2 * files.sparkSession.sparkContext.defaultParallelism, -(-count // FILES_A_TASK))
    dealt = whole.select("path", "changed").repartition(max(1, min(count, tasks)), "path")
    texts = dealt.mapInArrow(_reading(address, _opener(address), BATCH_BYTES), "path string, changed long, value binary")
    # Bytes that are no UTF-8 stay as they are, as with Spark's readers.
    return texts.withColumn("value", F.col("value").cast("string"))


def _reading(address, opener, most):
    def run(batches):
        import pyarrow as pa

        files, top = opener()
        start = len(address.rstrip("/"))

        def packed(rows):
            paths, times, texts = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(times, pa.int64()), pa.array(texts, pa.binary())],
                                              names=["path", "changed", "value"])

        for batch in batches:
            rows, held = [], 0
            for path, changed in zip(batch.column("path").to_pylist(), batch.column("changed").to_pylist()):
                with files.open_input_stream(top.rstrip("/") + path[start:], compression=None) as f:
                    text = f.read()
                rows.append((path, changed, text))
                held += len(text)
                if held >= most:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    return run
