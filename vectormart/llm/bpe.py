"""Byte-level BPE by a table of distinct words.

Documents are dealt into blocks of bounded size.  Every block lists its distinct words; the
lists meet by word, each distinct word of the whole table is encoded once, and its ids go back
to the blocks that hold it, where they take the word's places.  Texts are shuffled once, words
once per block in which they occur.  A word that is in every block is one entry per block, so no
word is hot.  Word lists travel packed: one row per block and bucket of words, not per word.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from vectormart.llm.words import Encoder, cut, distinct, flat, gathered, leanly, steps

BLOCK_BYTES = 16 << 20


def byte_of_letter():
    """The byte that each letter of a byte-level vocabulary stands for."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces:
    """The fixed vocabulary as tables by id: bytes of the piece, and the id in decimal with a comma."""

    loaded = {}

    def __init__(self, path):
        tokenizer = Encoder.of(path).tokenizer
        letters, special = byte_of_letter(), tokenizer.get_added_tokens_decoder()
        names = sorted((i, name) for name, i in tokenizer.get_vocab(with_added_tokens=True).items())
        table = [b""] * (names[-1][0] + 1)
        for i, name in names:
            table[i] = name.encode("utf-8") if i in special else bytes(letters[c] for c in name)
        self.pieces = pa.array(table, pa.large_binary())
        self.numbers = pa.array([b"%d," % i for i in range(len(table))], pa.large_binary())

    @classmethod
    def of(cls, path):
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]


def joined(table, ids, places):
    """Bytes of table[id] one after another, and the place of each text's first byte in them."""
    taken = table.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[:len(ids) + 1]
    data = taken.buffers()[2]
    return memoryview(data) if data is not None else memoryview(b""), ends[places]


def split_words(texts):
    """Distinct words of a column of texts in byte order, and codes and first places by slice."""
    found, slices = [], []
    for first, last in steps(texts):
        words, firsts = cut(*flat(texts.slice(first, last - first)))
        vocabulary, codes = distinct(words)
        found.append(vocabulary.cast(pa.large_binary()))
        slices.append((first, last, codes, firsts))
    every = pa.chunked_array(found, pa.large_binary()).combine_chunks().dictionary_encode()
    vocabulary, codes = every.dictionary, every.indices.to_numpy(zero_copy_only=False)
    order = pc.sort_indices(vocabulary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at, out = 0, []
    for part, (first, last, own, firsts) in zip(found, slices):
        out.append((first, last, place[codes[at:at + len(part)]][own], firsts))
        at += len(part)
    return vocabulary.take(pa.array(order)), out


def buckets_of(vocabulary, buckets):
    """A bucket for every word, from its first and last bytes and its length."""
    offsets = np.frombuffer(vocabulary.buffers()[1], np.int64)[vocabulary.offset:vocabulary.offset + len(vocabulary) + 1]
    data = np.frombuffer(vocabulary.buffers()[2], np.uint8)
    sizes = np.diff(offsets)
    hashes = sizes.astype(np.uint64)
    for i in range(24):
        near = np.minimum(i, sizes - 1)
        hashes = (hashes * np.uint64(1099511628211)) ^ data[offsets[:-1] + near]
        hashes = (hashes * np.uint64(1099511628211)) ^ data[offsets[1:] - 1 - near]
    return ((hashes ^ (hashes >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)


def by_bucket(vocabulary, buckets):
    """(bucket, places of its words in the vocabulary)."""
    if not len(vocabulary):
        return []
    bucket = buckets_of(vocabulary, buckets)
    order = np.argsort(bucket, kind="stable")
    return [(int(bucket[g[0]]), g) for g in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)]


def table_of(rows, schema):
    return pa.table([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(schema.types)], schema=schema)


def zipped(raw):
    return pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def unzipped(value, raw):
    return pa.decompress(value, raw, "zstd")


def deflated(values):
    """Packed integers, in as many bytes each as the largest needs, with the size before packing."""
    top = int(values.max()) if len(values) else 0
    raw = values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()
    return zipped(raw), len(raw)


def inflated(value, raw, count):
    """The integers of ``deflated``; their number tells how many bytes each takes."""
    if not count:
        return np.zeros(0, np.int64)
    return np.frombuffer(unzipped(value, raw), f"<u{raw // count}").astype(np.int64)


def encode_by_distinct_words(docs, tokenizer, finish, schema, names):
    """Encode (doc_id, text) rows and give ids of each slice of documents to ``finish``.

    ``finish(doc_ids, ids, places)`` returns an Arrow table of the stated schema; the ids of row i are
    ``ids[places[i]:places[i + 1]]``.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(blocks, "block")
    lists = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("sizes", pa.binary()),
                       ("words", pa.binary()), ("raw_sizes", pa.int64()), ("raw_words", pa.int64())])

    def listed(key, table):
        """The distinct words of one block, by bucket."""
        vocabulary, _ = split_words(table.column("text").combine_chunks())
        rows = []
        for bucket, places in by_bucket(vocabulary, blocks):
            data, offsets = flat_binary(vocabulary.take(pa.array(places)))
            sizes, raw_sizes = deflated(np.diff(offsets))
            rows.append((key[0].as_py(), bucket, len(places), sizes, zipped(data.tobytes()), raw_sizes, len(data)))
        return table_of(rows, lists)

    coded = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("lengths", pa.binary()),
                       ("ids", pa.binary()), ("raw_lengths", pa.int64()), ("raw_ids", pa.int64()), ("n_ids", pa.int64())])

    def encoded(key, table):
        """All lists of one bucket of words: encode each distinct word once and answer every list."""
        asked = []
        for row in table.to_pylist():
            sizes = inflated(row["sizes"], row["raw_sizes"], row["n"])
            data = np.frombuffer(unzipped(row["words"], row["raw_words"]), np.uint8)
            asked.append((row["block"], binary_of(data, sizes)))
        every = pa.chunked_array([words for _, words in asked]).combine_chunks().dictionary_encode()
        codes = every.indices.to_numpy(zero_copy_only=False)
        encoder = Encoder.of(tokenizer)
        lengths, ids = encoder.encode(every.dictionary)
        encoder.kept = {}  # no other bucket asks for these words
        rows, at = [], 0
        for block, words in asked:
            own = codes[at:at + len(words)]
            at += len(words)
            taken, _ = gathered(own, lengths, ids)
            (counts, raw_counts), (packed, raw_ids) = deflated(lengths[own]), deflated(taken)
            rows.append((block, key[0].as_py(), len(own), counts, packed, raw_counts, raw_ids, len(taken)))
        return table_of(rows, coded)

    def placed(key, table, answers):
        """One block: the ids of its distinct words take the places of the words."""
        texts = table.column("text").combine_chunks()
        vocabulary, slices = split_words(texts)
        lengths, firsts = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        values, at = [], 0
        groups = dict(by_bucket(vocabulary, blocks))
        for row in answers.to_pylist():
            own = groups[row["bucket"]]
            counts = inflated(row["lengths"], row["raw_lengths"], row["n"])
            lengths[own], firsts[own] = counts, at + np.cumsum(counts) - counts
            values.append(inflated(row["ids"], row["raw_ids"], row["n_ids"]))
            at += len(values[-1])
        values = np.concatenate(values) if values else np.zeros(0, np.int64)
        out = []
        for first, last, codes, begins in slices:
            taken = lengths[codes]
            ends = np.cumsum(taken)
            ids = values[np.repeat(firsts[codes] - (ends - taken), taken) + np.arange(int(ends[-1]) if len(ends) else 0)]
            out.append(finish(table.column("doc_id").slice(first, last - first), ids, np.append(0, ends)[begins]))
        return pa.concat_tables(out)

    words = dealt.groupBy("block").applyInArrow(
        lambda key, table: leanly(listed, key, table),
        "block long, bucket long, n long, sizes binary, words binary, raw_sizes long, raw_words long")
    answers = words.groupBy("bucket").applyInArrow(
        lambda key, table: leanly(encoded, key, table),
        "block long, bucket long, n long, lengths binary, ids binary, raw_lengths long, raw_ids long, n_ids long")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda key, table, answers: leanly(placed, key, table, answers), schema).select(*names)


def flat_binary(array):
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def binary_of(data, sizes):
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs, tokenizer):
    """(doc_id, ids): token ids of every text; a null text is empty, repeated rows stay repeated."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def finish(doc_ids, ids, places):
        lists = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.table([doc_ids, lists], schema=out)

    return encode_by_distinct_words(docs, tokenizer, finish, "doc_id long, ids array<int>", ("doc_id", "ids"))


def digests(docs, tokenizer):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text; decoding joins ids to their pieces."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def finish(doc_ids, ids, places):
        tables = Pieces.of(tokenizer)
        numbers, ends = joined(tables.numbers, ids, places)
        pieces, stops = joined(tables.pieces, ids, places)
        in_decimal = [hashlib.sha256(numbers[a:max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
        decoded = [hashlib.sha256(decoded_bytes(pieces[a:b])).hexdigest() for a, b in zip(stops[:-1], stops[1:])]
        return pa.table([doc_ids, pa.array(np.diff(places)), pa.array(in_decimal), pa.array(decoded)], schema=out)

    return encode_by_distinct_words(
        docs, tokenizer, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))


def encoded_and_decoded(docs, tokenizer):
    """(doc_id, n_tokens, ids, decoded_sha256): the ids of every text, and a digest of what they decode to."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])

    def finish(doc_ids, ids, places):
        pieces, stops = joined(Pieces.of(tokenizer).pieces, ids, places)
        decoded = [hashlib.sha256(decoded_bytes(pieces[a:b])).hexdigest() for a, b in zip(stops[:-1], stops[1:])]
        lists = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.table([doc_ids, pa.array(np.diff(places)), lists, pa.array(decoded)], schema=out)

    return encode_by_distinct_words(
        docs, tokenizer, finish, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string",
        ("doc_id", "n_tokens", "ids", "decoded_sha256"))


def decoded_bytes(pieces):
    """UTF-8 of the decoded text: bytes that are no UTF-8 become replacement characters."""
    return str(pieces, "utf-8", "replace").encode("utf-8")


def decode(encoded, tokenizer):
    """(doc_id, text) from (doc_id, ids): every id is replaced by its piece."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        table = Pieces.of(tokenizer).pieces
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
            pieces, stops = joined(table, ids, offsets - offsets[0])
            texts = [str(pieces[a:b], "utf-8", "replace") for a, b in zip(stops[:-1], stops[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=out)

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
