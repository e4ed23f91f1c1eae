"""Token files: patched frame-of-reference blocks.

Documents are encoded in ascending order of their id.  A file row is a *segment*: the ids of
whole documents, about ``SEGMENT`` of them, cut into blocks of ``BLOCK`` ids.  Of each block the
minimum is subtracted; the width is the bits that the 90th percentile of the rest needs; all
values are packed at that width, and what sticks out goes to an exception list (place and high
bits).  The segment keeps for each block the minimum, width, number of exceptions and the byte
where it starts, so any block can be read alone.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vectormart.llm.words import Encoder, steps, token_ids

BLOCK, SEGMENT = 256, 1 << 16
PERCENTILE = 0.9
# Words whose ids a worker remembers from one slice of text to the next, and for a few seconds to the next task: some 200 MB.
WORDS_KEPT = 1_000_000

FILE = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("segment", T.IntegerType()),
    T.StructField("start_in_part", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_lengths", T.ArrayType(T.LongType())),
    T.StructField("minima", T.ArrayType(T.LongType())),
    T.StructField("widths", T.ArrayType(T.IntegerType())),
    T.StructField("exceptions", T.ArrayType(T.IntegerType())),
    T.StructField("block_starts", T.ArrayType(T.LongType())),
    T.StructField("payload", T.BinaryType()),
])
FILE_ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("start_in_part", pa.int64()), ("n", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("minima", pa.list_(pa.int64())),
    ("widths", pa.list_(pa.int32())), ("exceptions", pa.list_(pa.int32())), ("block_starts", pa.list_(pa.int64())),
    ("payload", pa.binary())])


def bit_length(values):
    """Bits that each value needs; 0 for 0."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(ids):
    """(minima, widths, exception counts, block starts, payload) of a run of unsigned 32-bit ids."""
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        none = np.zeros(0, np.int64)
        return none, none, none, none, b""
    values = np.full(blocks * BLOCK, ids[-1], np.uint32)
    values[:len(ids)] = ids
    values = values.reshape(blocks, BLOCK)
    minima = values.min(axis=1)
    values = values - minima[:, None]
    at = int(BLOCK * PERCENTILE) - 1
    widths = bit_length(np.partition(values, at, axis=1)[:, at])
    high = (values.astype(np.uint64) >> widths[:, None].astype(np.uint64)).astype(np.uint32)
    row, place = np.nonzero(high)
    counts = np.bincount(row, minlength=blocks)
    sizes = BLOCK // 8 * widths + 5 * counts
    starts = np.cumsum(sizes) - sizes
    payload = np.zeros(int(sizes.sum()), np.uint8)
    for width in np.unique(widths[widths > 0]):
        of = np.flatnonzero(widths == width)
        bits = np.unpackbits(values[of].view(np.uint8).reshape(len(of), BLOCK, 4), axis=2, bitorder="little")
        packed = np.packbits(bits[:, :, :width].reshape(len(of), -1), axis=1, bitorder="little")
        payload[starts[of][:, None] + np.arange(packed.shape[1])] = packed
    if len(row):
        listed = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = (starts + BLOCK // 8 * widths)[row]
        payload[first + listed] = place
        payload[(first + counts[row] + 4 * listed)[:, None] + np.arange(4)] = high[row, place].view(np.uint8).reshape(-1, 4)
    return minima.astype(np.int64), widths, counts, starts, payload.tobytes()


def unpack(n, minima, widths, counts, starts, payload):
    """The ids of a segment."""
    blocks = len(minima)
    payload = np.frombuffer(payload, np.uint8)
    values = np.zeros((blocks, BLOCK), np.uint32)
    for width in np.unique(widths[widths > 0]):
        of = np.flatnonzero(widths == width)
        packed = payload[starts[of][:, None] + np.arange(BLOCK // 8 * width)]
        bits = np.zeros((len(of), BLOCK, 32), np.uint8)
        bits[:, :, :width] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(of), BLOCK, width)
        values[of] = np.packbits(bits, axis=2, bitorder="little").reshape(len(of), BLOCK * 4).view(np.uint32)
    row = np.repeat(np.arange(blocks), counts)
    if len(row):
        listed = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = (starts + BLOCK // 8 * widths)[row]
        place = payload[first + listed]
        high = np.ascontiguousarray(payload[(first + counts[row] + 4 * listed)[:, None] + np.arange(4)]).view(np.uint32)[:, 0]
        values[row, place] |= high << widths[row].astype(np.uint32)
    return (values + minima.astype(np.uint32)[:, None]).reshape(-1)[:n]


def write_token_files(docs, path, tokenizer, end_id):
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and write the token files to ``path``.

    A null text is empty and holds only the end id.  Rows without an id come first, rows with
    the same id stand in the order of a hash of their texts.
    """

    def run(batches):
        part, segment, start = None, 0, 0
        kept, names, lengths, held = [], [], [], 0

        def row():
            ids = np.concatenate(kept) if kept else np.zeros(0, np.uint32)
            minima, widths, counts, starts, payload = pack(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([x], kind) for x, kind in zip(
                    [part, segment, start, len(ids), names, lengths, minima, widths, counts, starts, payload],
                    FILE_ARROW.types)], schema=FILE_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            for first, last in steps(batch.column("text")):
                ids, places = token_ids(batch.column("text").slice(first, last - first), tokenizer, WORDS_KEPT)
                doc_ids = batch.column("doc_id").slice(first, last - first).to_pylist()
                sizes = np.diff(places)
                ended = np.insert(ids, places[1:], end_id)
                ends = np.cumsum(sizes + 1)
                begin = 0
                while begin < len(doc_ids):
                    before = int(ends[begin - 1]) if begin else 0
                    # Whole documents up to the first that fills the segment.
                    until = min(int(np.searchsorted(ends, before + SEGMENT - held)) + 1, len(doc_ids))
                    kept.append(ended[before:int(ends[until - 1])])
                    names += doc_ids[begin:until]
                    lengths += (sizes[begin:until] + 1).tolist()
                    held += len(kept[-1])
                    begin = until
                    if held >= SEGMENT:
                        yield row()
                        segment, start = segment + 1, start + held
                        kept, names, lengths, held = [], [], [], 0
        if names:
            yield row()
        Encoder.forget_soon()

    placed = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("h"))
    placed = placed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    numbered = placed.select("doc_id", "text", F.spark_partition_id().alias("part"))
    numbered.mapInArrow(run, FILE).write.parquet(path)


def read_token_files(spark, path):
    """One row per document: (doc_id, start, n_tokens, ids).  Every segment is read on its own."""
    return opened(spark, path, "ids array<long>", pa.list_(pa.int64()), lambda ids: ids.astype(np.int64))


def token_file_digests(spark, path):
    """One row per document: (doc_id, start, n_tokens, ids_crc32), from the token files."""
    return opened(spark, path, "ids_crc32 long", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def opened(spark, path, column, kind, value):
    files = spark.read.schema(FILE).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n").alias("ids_in_part"))
    # One row per range of documents, not per document.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("ids_in_part").over(order), F.lit(0)).alias("base"))
    out = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                     (column.split()[0], kind)])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["n"], *(np.array(row[c], np.int64) for c in ("minima", "widths", "exceptions", "block_starts")), row["payload"])
                lengths = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(lengths), row["part"], np.int32)), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start_in_part"] + ends - lengths), pa.array(lengths),
                    pa.array([value(ids[e - n:e]) for e, n in zip(ends, lengths)], kind)], schema=out)

    docs = files.mapInArrow(run, f"part int, doc_id long, start long, n_tokens long, {column}")
    return docs.join(bases, "part").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", column.split()[0])
