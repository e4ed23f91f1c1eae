"""Substring de-duplication by sliding runs of sentences.

Texts are cut into sentences, every run of several consecutive sentences is hashed, runs with the same hash
meet over the whole table, and all sentences that a run other than the first of its hash covers are removed.

A sentence ends at . ! ? or a line break, and behind the word of the least hash of any ``WINDOW`` words in a row (the
last of equals).  So no sentence is longer than ``WINDOW`` words, and whether a cut is made depends on the
``WINDOW`` - 1 words on either side only: a passage is cut in the same places wherever it was pasted, but for
so many words at its ends.  A run starts at any sentence and takes at least ``RUN`` sentences and ``RUN_WORDS``
words, and at most 26.  The first cut that both hosts share is at most 13 words into a passage and the last 6
words are in doubt, so that any 45 shared words hold a whole run.

Runs travel once, packed by slice of texts and bucket of hashes; the task of a bucket tells which are not the first.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from vectormart.llm.words import SPACE, binary, distinct, flat, steps

WINDOW, RUN, RUN_WORDS = 7, 3, 20
BUCKET_BYTES = 16 << 20  # of text, for each bucket of hashes
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
END = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def scrambled(values):
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def sentences(texts):
    """(data, offsets, starts, firsts, words, prefix): first byte of every sentence, number of the first sentence of
    every text, words before each sentence, and the rolling hash of all words before it."""
    import xxhash

    data, offsets = flat(texts)
    space = SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    edges = offsets[offsets < len(data)]
    begins[edges] = ~space[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return data, offsets, none, np.zeros(len(offsets), np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint64)
    gaps = np.append(np.flatnonzero(space), len(data))
    text_end = offsets[np.searchsorted(offsets, starts, side="right")]
    ends = np.minimum(gaps[np.searchsorted(gaps, starts)], text_end)
    marks = np.empty(2 * len(starts), np.int64)
    marks[0::2], marks[1::2] = starts, ends
    lowered = data + np.where((data >= 0x41) & (data <= 0x5A), 32, 0).astype(np.uint8)
    words = binary(lowered, marks).take(pa.array(np.arange(0, len(marks), 2)))
    vocabulary, codes = distinct(words)
    hashes = scrambled(np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary.to_pylist()], np.uint64))[codes]

    lines = np.append(0, np.cumsum((data == 10) | (data == 13)))
    following = np.append(starts[1:], len(data))
    last = END[data[ends - 1]] | (lines[following] > lines[ends]) | (np.append(text_end[1:], -1) != text_end)
    if len(starts) >= WINDOW:
        # Windows that reach into the next text pick nothing.
        windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[:, ::-1]
        picked = np.arange(len(windows)) + WINDOW - 1 - windows.argmin(axis=1)
        last[picked[text_end[:len(windows)] == text_end[WINDOW - 1:]]] = True
    first_words = np.append(0, np.flatnonzero(last)[:-1] + 1)
    powers = np.cumprod(np.append(np.uint64(1), np.full(len(starts) - 1, BASE)), dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(hashes * powers, dtype=np.uint64))
    sentence_starts = starts[first_words]
    return (data, offsets, sentence_starts, np.searchsorted(sentence_starts, offsets),
            np.append(first_words, len(starts)), sums[np.append(first_words, len(starts))])


def runs_of(texts):
    """(text, first, last, hash) of every run; sentences are numbered within their text."""
    _, _, starts, firsts, words, sums = sentences(texts)
    n = len(starts)
    text = np.repeat(np.arange(len(texts)), np.diff(firsts))
    first = np.arange(n)
    last = np.maximum(np.searchsorted(words, words[:-1] + RUN_WORDS), first + RUN)  # one behind the run
    whole = last <= firsts[1:][text]
    text, first, last = text[whole], first[whole], last[whole]
    inverse = np.cumprod(np.append(np.uint64(1), np.full(max(0, int(words[-1]) - 1), BASE_INVERSE)), dtype=np.uint64)
    hashes = scrambled(scrambled((sums[last] - sums[first]) * inverse[words[first]]) + (words[last] - words[first]).astype(np.uint64))
    return text, first - firsts[text], last - firsts[text], hashes.view(np.int64)


def cut_out(texts, counts, first, last):
    """(sentences, removed sentences, removed words, spans, kept text), arrays with an item per text of a slice.

    Text i has ``counts[i]`` covered runs, the next ones of ``first`` and ``last``; spans are start:end in code points.
    """
    data, offsets, starts, firsts, words, _ = sentences(texts)
    change = np.zeros(len(starts) + 1, np.int64)
    at = np.repeat(firsts[:-1], counts)
    np.add.at(change, at + first, 1)
    np.add.at(change, at + last, -1)
    gone = np.cumsum(change)[:-1] > 0
    total = lambda values: np.diff(np.append(0, np.cumsum(values))[firsts])
    # A removed stretch goes on up to the next sentence that stays, or the end of its text.
    text = np.repeat(np.arange(len(texts)), np.diff(firsts))
    new = np.append(True, text[1:] != text[:-1]) if len(text) else np.zeros(0, bool)
    begin = np.flatnonzero(gone & (new | ~np.append(False, gone)[:-1]))
    end = np.flatnonzero(gone & np.append((new | ~gone)[1:], True))
    low, high = starts[begin], np.minimum(np.append(starts, len(data))[end + 1], offsets[text[end] + 1])
    edges = np.zeros(len(data) + 1, np.int8)
    edges[low] += 1
    edges[high] -= 1
    keep = np.cumsum(edges[:-1], dtype=np.int8) == 0
    places = np.append(0, np.cumsum(keep))[offsets]
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    spans = [[] for _ in range(len(texts))]
    for of, a, b in zip(text[begin].tolist(), (points[low] - points[offsets[text[begin]]]).tolist(), (points[high] - points[offsets[text[begin]]]).tolist()):
        spans[of].append(f"{a}:{b}")
    return (np.diff(firsts), total(gone), total(np.diff(words) * gone), pa.array([",".join(s) for s in spans], pa.string()),
            binary(data[keep], places[:-1]).cast(pa.string()))


def packed(hashes, ids, marks, first, last):
    """Runs of some documents as bytes; ids lie in order and mostly repeat, so their steps pack well."""
    columns = (hashes, np.diff(ids, prepend=0), marks, first.astype(np.int32), (last - first).astype(np.uint8))
    return pa.Codec("zstd", compression_level=3).compress(b"".join(c.tobytes() for c in columns), asbytes=True)


def unpacked(value, n):
    raw, at, out = pa.decompress(value, 25 * n, "zstd"), 0, []
    for kind in (np.int64, np.int64, np.int32, np.int32, np.uint8):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    hashes, steps_of_ids, marks, first, length = out
    return hashes, np.cumsum(steps_of_ids), marks, first, first + length


def least_of(hashes, *place):
    """Whether a run is the first of its hash, from its hash and its place (has an id, id, mark, first).

    Rows that repeat id and text are one document, so runs of one place are first together.
    """
    least = np.ones(len(hashes), bool)
    order = np.argsort(hashes, kind="stable")
    same = np.append(hashes[order][1:] == hashes[order][:-1], False)[:len(order)]
    some = order[same | np.roll(same, 1)]
    if len(some):
        order = some[np.lexsort([c[some] for c in (*reversed(place), hashes)])]
        new = np.append(True, hashes[order][1:] != hashes[order][:-1])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        least[order] = np.logical_and.reduce([c[order] == c[lead] for c in place])
    return least


OUT = "row {row}, sentences long, removed_sentences long, removed_words long, spans string, kept_text string"


def without_repeats(docs, id="doc_id", text="text"):
    """Per row of ``docs``: row (all its columns), sentences, removed_sentences, removed_words, spans, kept_text.

    The first run of a hash is the one in the smallest id (null ids first; then by a hash of the text, then by
    place).  So repeats inside one text go as well.  Rows that repeat id and text are one document.  Null texts
    have no sentences and stay null; texts shorter than a run are never cut; white space before the first
    sentence stays.  Every row stays, though its text may become empty.
    """
    place = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id}`").cast("long").alias("id"),
                        F.hash(F.col(f"`{text}`")).alias("mark"))
    told = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.hash(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    size = told.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))

    def listed(batches):
        """The runs of a slice, by bucket of their hash.  The first of a hash in the slice goes to the bucket of its hash; all
        others are repeats wherever the first one is, so they go to any bucket and no hash is hot."""
        for batch in batches:
            for begin, stop in steps(batch.column("text")):
                part = batch.slice(begin, stop - begin)
                of, first, last, hashes = runs_of(part.column("text"))
                none = part.column("id").is_null().to_numpy(zero_copy_only=False)[of]
                ids = part.column("id").fill_null(0).to_numpy(zero_copy_only=False)[of]
                marks = part.column("mark").to_numpy(zero_copy_only=False)[of]
                least = least_of(hashes, ~none, ids, marks, first)
                key = scrambled(np.where(least, hashes, hashes + of).view(np.uint64))
                # Rows of a bucket that are sure repeats, or have no id, lie apart from the others.
                group = (key % np.uint64(buckets)).astype(np.int64) * 4 + none * 2 + ~least
                order = np.argsort(group, kind="stable")
                edges = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
                rows = []
                for a, b in zip(edges[:-1], edges[1:]):
                    at = order[a:b]
                    kind = int(group[at[0]])
                    rows.append((kind // 4, bool(kind & 2), bool(kind & 1), b - a, packed(hashes[at], ids[at], marks[at], first[at], last[at])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[i] for row in rows], kind) for i, kind in enumerate((pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary()))],
                    names=["bucket", "none", "sure", "n", "packed"])

    def repeated(key, table):
        """(id, mark, first, last) of the runs of one bucket that are not the first of their hash."""
        parts = [(row["none"], row["sure"], *unpacked(row["packed"], row["n"])) for row in table.select(["none", "sure", "n", "packed"]).to_pylist()]
        none, sure = (np.concatenate([np.full(len(p[2]), p[i]) for p in parts]) for i in (0, 1))
        hashes, ids, marks, first, last = (np.concatenate([p[i] for p in parts]) for i in range(2, 7))
        again, open_ = sure.copy(), np.flatnonzero(~sure)
        least = least_of(*(x[open_] for x in (hashes, ~none, ids, marks, first)))
        again[open_] = ~least
        return pa.table({"id": pa.array(ids[again], mask=none[again]), "mark": marks[again], "first": first[again], "last": last[again].astype(np.int32)})

    runs = told.mapInArrow(listed, "bucket long, none boolean, sure boolean, n long, packed binary")
    again = runs.groupBy("bucket").applyInArrow(repeated, "id long, mark int, first int, last int")
    covered = again.groupBy("id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("covered"))

    row = docs.schema.simpleString()

    def kept(batches):
        for batch in batches:
            texts = batch.column("row").field(text)
            for begin, stop in steps(texts):
                part, own = batch.slice(begin, stop - begin), texts.slice(begin, stop - begin)
                lists = part.column("covered")
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                first, last = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
                n, gone, words, spans, kept_text = cut_out(own, counts, first, last)
                whole = pc.if_else(own.is_null(), pa.scalar(None, pa.string()), kept_text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(n), pa.array(gone), pa.array(words), spans, whole],
                    names=["row", "sentences", "removed_sentences", "removed_words", "spans", "kept_text"])

    met = place.alias("p").join(covered.alias("c"), F.col("p.id").eqNullSafe(F.col("c.id")) & F.col("p.mark").eqNullSafe(F.col("c.mark")), "left")
    return met.select("p.row", "c.covered").mapInArrow(kept, OUT.format(row=row))


def span_dedup(docs, id="doc_id", text="text"):
    """``docs`` with repeated passages cut out of the text."""
    found = without_repeats(docs, id, text)
    return found.select(*[F.col("kept_text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def repeats(docs):
    """(doc_id, sentences, removed_sentences, removed_words, spans, changed, text) of every document."""
    found = without_repeats(docs.select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "sentences", "removed_sentences", "removed_words", "spans",
                        (F.col("removed_sentences") > 0).alias("changed"), F.col("kept_text").alias("text"))
