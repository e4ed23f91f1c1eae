"""Removal of every byte that lies in a string of ``width`` bytes which also starts anywhere else.

This is suffix sorting with common-prefix values, by induction from a sparse sample, as far as strings of ``width``
bytes need it.  Which of two suffixes comes first does not matter here, only whether they agree over ``width`` bytes.

*Sample.*  The name of a place is the hash of the next few bytes.  Every window of ``width`` bytes is spoken for by its
place of least name (the first of equals), its *anchor*: like the sampled suffixes of induced sorting, anchors are local
minima of names, and which one speaks for a window depends on the bytes of the window only.  So equal windows have equal
anchors at equal offsets.  All windows of one anchor form one *segment* (some 70 bytes of text give one).

*Naming.*  Segments meet over the whole table by the name of their core, the bytes that all their windows share,
and of their union, all bytes of their windows.  A core that stands once holds no repeat; a union that stands twice is
repeated throughout.  Only segments whose core is repeated in different unions, the ends of repeats, need sorting,
one for every union.

*Induction.*  Their suffix tuples are shuffled by core and put in order by Spark's external sort, which
spills to disk; tuples then stream through a task, which computes the common prefix of neighbours at the anchor and
induces order and common prefixes of the suffixes one byte further left from (byte, rank of the suffix behind it), step by step.
A window is repeated if its suffix shares ``width`` bytes with a neighbour.

*Recursion.*  A core with more than ``MOST`` different unions is never gathered.  The offsets of its windows are
cut into ``FANOUT`` parts, each with a longer core of its own, and all is done again, down to single windows, whose core and union are one
and need no sorting.  So no task holds more than ``MOST`` tuples of a core, whatever the table holds.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vectormart.llm.words import flat, steps
from vectormart.session import work_folder, written

WIDTH, MOST, FANOUT, TUPLES = 200, 1000, 4, 1 << 13
WIDEST = 256
# Some fifteen numbers of eight bytes are held for every byte of a step.
STEP_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
RANDOM = np.random.default_rng(13).integers(0, 1 << 64, 256, dtype=np.uint64)
PLACE_BITS = np.uint64(31)
PLACES = (np.uint64(1) << PLACE_BITS) - np.uint64(1)


def scrambled(values):
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Hashes:
    """Hashes of all substrings of some bytes, from sums of powers modulo 2^64."""

    powers = inverse = np.ones(1, np.uint64)

    def __init__(self, data):
        n = len(data) + 1
        if len(Hashes.powers) < n:
            Hashes.powers, Hashes.inverse = (
                np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)), dtype=np.uint64)
                for base in (BASE, pow(BASE, -1, 1 << 64)))
        self.sums = np.append(np.uint64(0), np.cumsum(RANDOM[data] * Hashes.powers[:len(data)], dtype=np.uint64))

    def of(self, starts, ends, salt=0):
        return scrambled((self.sums[ends] - self.sums[starts]) * Hashes.inverse[starts] + scrambled(np.atleast_1d(salt).astype(np.uint64) + np.uint64(1)))


def gram_of(width):
    return max(1, width // 8)


def least_of(values, width):
    """Least of every ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onwards = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onwards[:n - width + 1], upto[width - 1:n])


def packed_place(first, before, more):
    """First window, bytes from there to the anchor, and windows after the first, as one number."""
    return first << 16 | before << 8 | more


def unpacked_place(place):
    return place >> 16, place >> 8 & 255, place & 255


def segments(data, offsets, width):
    """(text, place, core, union) of all segments; places are packed and count from the beginning of their text."""
    gram = gram_of(width)
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none
    hashes = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    names = hashes.of(at, at + gram)
    least = least_of(names & ~PLACES | at.astype(np.uint64), width - gram + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    window = np.flatnonzero(text[:len(least)] == text[width - 1:])
    if not len(window):
        return none, none, none, none
    anchor = (least[window] & PLACES).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(window) != 1)
    heads = np.flatnonzero(new)
    first, last, anchor = window[heads], window[np.append(heads[1:], len(window)) - 1], anchor[heads]
    before = anchor - first
    text = text[first]
    union = hashes.of(first, last + width, before)
    return text, packed_place(first - offsets[text], before, last - first), names[anchor].view(np.int64), union.view(np.int64)


def parts_of(data, starts, ends):
    """A binary array of data[starts[i]:ends[i]]."""
    sizes = ends - starts
    total = np.cumsum(sizes)
    taken = np.repeat(starts - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)
    bounds = np.append(0, total).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[taken]))]).cast(pa.binary())


def bytes_of(column):
    """Bytes and offsets of a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def square(data, offsets, columns, backwards=False):
    """Rows of bytes in a matrix, and their lengths; places beyond a row are zero."""
    sizes = np.diff(offsets)
    at = np.arange(columns)
    inside = at[None, :] < sizes[:, None]
    source = (offsets[1:, None] - 1 - at[None, :]) if backwards else (offsets[:-1, None] + at[None, :])
    out = np.zeros(inside.shape, np.uint8)
    out[inside] = data[source[inside]]
    return out, sizes


def induced(cores, left, right, width):
    """(tuple, least offset, greatest offset) of stretches of repeated windows of suffix tuples in order of core and right bytes.

    ``left`` and ``right`` are (data, offsets) of the bytes before and from the anchors on.
    """
    before, lefts = square(*left, int(np.diff(left[1]).max(initial=0)), backwards=True)
    after, rights = square(*right, int(np.diff(right[1]).max(initial=0)))
    m = len(cores)
    agree = np.zeros((m, after.shape[1] + 1), bool)
    agree[1:, :-1] = (after[1:] == after[:-1]) & (np.arange(after.shape[1]) < np.minimum(rights[1:], rights[:-1])[:, None])
    common = agree.argmin(axis=1)
    common[1:][cores[1:] != cores[:-1]] = 0
    repeated = np.zeros((m, before.shape[1] + 2), np.int8)
    active = np.arange(m)
    for offset in range(before.shape[1] + 1):
        reach = np.maximum(common, np.append(common[1:], 0))
        repeated[active[reach >= width], offset] = 1
        # A suffix goes on while it has a byte on the left, agrees with a neighbour and can still reach the width.
        on = np.flatnonzero((lefts[active] > offset) & (reach > 0) & (reach - offset + lefts[active] >= width))
        if not len(on):
            break
        kind = np.cumsum(common == 0)[on] * 256 + before[active[on], offset]
        order = np.argsort(kind, kind="stable")
        on, kind = on[order], kind[order]
        same = kind[1:] == kind[:-1]
        bounds = np.empty(2 * int(same.sum()), np.int64)
        bounds[0::2], bounds[1::2] = on[:-1][same] + 1, on[1:][same] + 1
        then = np.zeros(len(on), np.int64)
        if len(bounds):
            then[1:][same] = 1 + np.minimum.reduceat(np.append(common, 0), bounds)[0::2]
        active, common = active[on], then
    change = np.diff(np.concatenate([np.zeros((m, 1), np.int8), repeated], axis=1), axis=1)
    of, low = np.nonzero(change == 1)
    _, high = np.nonzero(change == -1)
    return of, low, high - 1


def texts_in(batches):
    """(part, data, offsets) of the packed texts of batches, in steps of bounded size."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        sizes = batch.column("n_bytes").to_numpy()
        step = (np.cumsum(sizes) - sizes) // STEP_BYTES
        firsts = np.flatnonzero(np.append(True, np.diff(step) != 0)) if len(sizes) else []
        for first, last in zip(firsts, np.append(firsts[1:], len(sizes))):
            part = batch.slice(int(first), int(last - first))
            data = np.frombuffer(b"".join(map(unpack, part.column("packed").to_pylist())), np.uint8)
            yield part, data, np.append(0, np.cumsum(part.column("n_bytes").to_numpy()))


def packed_texts(docs, id, text):
    """(uid, id, n_bytes, packed) in files by uid, so that rows come to the texts, and the name of the table, to be dropped by the caller.

    Uids are numbers of rows, written once; a repeated task reads its rows of a table in the same order.
    """
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for first, last in steps(batch.column("text")):
                part = batch.slice(first, last - first)
                data, offsets = flat(part.column("text"))
                whole = data.tobytes()
                packed = pa.array([pack(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("id"), pa.array(np.diff(offsets)), packed],
                                                 names=["uid", "id", "n_bytes", "packed"])

    read = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    packed = read.mapInArrow(run, f"uid long, id {kind}, n_bytes long, packed binary")
    path = work_folder(spark, "texts")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed.repartition(buckets, "uid").write.bucketBy(buckets, "uid").option("path", path).option("compression", "none").saveAsTable(table)
    return spark.table(table), table


def segment_rows(texts, width):
    """(uid, place, core, union) of all segments of all texts."""

    def run(batches):
        for part, data, offsets in texts_in(batches):
            of, place, core, union = segments(data, offsets, width)
            yield pa.RecordBatch.from_arrays([part.column("uid").take(pa.array(of)), pa.array(place), pa.array(core), pa.array(union)],
                                             names=["uid", "place", "core", "union"])

    return texts.select("uid", "n_bytes", "packed").mapInArrow(run, "uid long, place long, core long, union long")


def classed(rows):
    """What is repeated throughout, (uid, place), and one row of every union whose core is repeated otherwise too.

    Aggregates are written, so that both sides of a join come straight from a shuffle and a hot core can be split.
    """
    context = [c for c in rows.columns if c not in ("uid", "place", "core", "union")]
    cores = rows.groupBy("core").agg(F.min("union").alias("low"), F.max("union").alias("high"), F.count("*").alias("times"))
    cores = written(cores.filter("times > 1").select("core", (F.col("low") != F.col("high")).alias("mixed")), "cores")
    met = rows.join(cores, "core").select("uid", "place", *[F.when(F.col("mixed"), F.col(c)).alias(c) for c in ("core", "union", *context)])
    met = written(met, "met")
    mixed = met.filter("core is not null")
    classes = mixed.groupBy("core", "union").agg(
        F.count("*").alias("times"), F.min(F.struct("uid", "place")).alias("one"), *[F.first(c).alias(c) for c in context])
    classes = written(classes, "classes")
    often = written(classes.filter("times > 1").select("core", "union"), "often")
    again = mixed.join(often, ["core", "union"], "left_semi")
    repeated = met.filter("core is null").select("uid", "place").unionAll(again.select("uid", "place"))
    return repeated, classes.select("core", "union", "one.uid", "one.place", *context)


TUPLE = "core long, uid long, place long, low int, high int, left binary, right binary"


def tuples_of(rows, texts, width):
    """Suffix tuples of the (core, uid, place) rows: the bytes before and from their anchor on that their windows cover."""
    lists = rows.groupBy("uid").agg(F.collect_list(F.struct("core", "place")).alias("wanted"))
    top = width - gram_of(width) + 1

    def run(batches):
        for part, data, offsets in texts_in(batches):
            wanted = part.column("wanted")
            of = np.repeat(np.arange(len(part)), np.diff(wanted.offsets.to_numpy()))
            core, place = wanted.flatten().flatten()
            first, before, more = unpacked_place(place.to_numpy())
            start = offsets[of] + first
            n = len(of)
            yield pa.RecordBatch.from_arrays(
                [core, part.column("uid").take(pa.array(of)), place, pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, top, np.int32)),
                 parts_of(data, start, start + before), parts_of(data, start + before, start + more + width)],
                names=["core", "uid", "place", "low", "high", "left", "right"])

    met = texts.join(lists, "uid").select("uid", "n_bytes", "packed", "wanted")
    return met.mapInArrow(run, TUPLE)


def in_parts(tuples, width, fanout):
    """Tuples cut to the parts of their range of offsets, each with the core and union of that part."""

    def run(batches):
        for batch in batches:
            left, lefts = bytes_of(batch.column("left"))
            right, rights = bytes_of(batch.column("right"))
            before, after = np.diff(lefts), np.diff(rights)
            first, _, more = unpacked_place(batch.column("place").to_numpy())
            anchor, least, most = first + before, before - more, before
            low, high = (batch.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
            # Left and right bytes of a tuple side by side, so that cores and unions are parts of one text.
            both = parts_of(np.concatenate([left, right]), np.stack([lefts[:-1], len(left) + rights[:-1]], 1).ravel(),
                            np.stack([lefts[1:], len(left) + rights[1:]], 1).ravel())
            data, offsets = bytes_of(both)
            at = offsets[1::2]
            hashes = Hashes(data)
            step = -(-(high - low) // fanout)
            for k in range(fanout):
                x = low + k * step
                y = np.minimum(x + step, high)
                a, b = np.maximum(least, x), np.minimum(most, y - 1)
                on = np.flatnonzero((x < y) & (a <= b))
                if not len(on):
                    continue
                x, y, a, b, t = (v[on] for v in (x, y, a, b, at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.of(t - x, t + width + 1 - y, x).view(np.int64)), pa.array(hashes.of(t - b, t + width - a, b).view(np.int64)),
                     batch.column("uid").take(pa.array(on)), pa.array(packed_place(anchor[on] - b, b, b - a)), pa.array(x.astype(np.int32)),
                     pa.array(y.astype(np.int32)), parts_of(data, t - b, t), parts_of(data, t, t + width - a)],
                    names=["core", "union", "uid", "place", "low", "high", "left", "right"])

    return tuples.mapInArrow(run, "core long, union long, " + TUPLE.split(", ", 1)[1])


def sorted_out(tuples, width, at_once):
    """(uid, place) of the repeated windows of suffix tuples, at most some thousands of one core."""

    def solve(table):
        of, low, high = induced(table.column("core").to_numpy(), *[bytes_of(table.column(c).combine_chunks()) for c in ("left", "right")], width)
        first, before, _ = unpacked_place(table.column("place").to_numpy()[of])
        uid = table.column("uid").to_numpy()[of]
        return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(packed_place(first + before - high, 0, high - low))], names=["uid", "place"])

    def run(batches):
        held = None
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            held = batch if held is None else pa.concat_tables([held, batch])
            if len(held) >= at_once:
                core = held.column("core").to_numpy()
                cut = int(np.flatnonzero(core == core[-1])[0])
                if cut:
                    yield solve(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and len(held):
            yield solve(held)

    placed = tuples.select("core", "uid", "place", "left", "right").repartition("core").sortWithinPartitions("core", "right")
    return placed.mapInArrow(run, "uid long, place long")


def repeated_places(texts, width=WIDTH, most=MOST, fanout=FANOUT, at_once=TUPLES):
    """(uid, place): packed stretches of windows that also stand anywhere else."""
    repeated, rows = classed(segment_rows(texts, width))
    found, tuples = [repeated], None
    while True:
        # Cores are counted before their rows are gathered; those with many unions go on in parts.
        crowded = written(rows.groupBy("core").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("core"), "crowded")
        some = crowded.head(1)
        few = rows.join(crowded, "core", "left_anti") if some else rows
        found.append(sorted_out(few if tuples else tuples_of(few, texts, width), width, at_once))
        if not some:
            break
        many = rows.join(crowded, "core", "left_semi")
        many = many if tuples else tuples_of(many, texts, width)
        tuples = True
        repeated, rows = classed(written(in_parts(many, width, fanout), "parts"))
        found.append(repeated)
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionAll(more)
    return all_


SPANS = "array<struct<start:bigint,end:bigint>>"


def without_repeats(docs, id="doc_id", text="text", width=WIDTH, most=MOST, fanout=FANOUT, at_once=TUPLES):
    """One row per row of ``docs``: id, n_bytes, n_removed, spans (maximal removed stretches of bytes), kept (binary).

    Matches do not cross rows.  Rows that are repeated, share an id or have none are documents of their own and repeat each other.  A
    null text is empty; a text below ``width`` bytes keeps everything.  Kept bytes may break a character and are no
    text.  A text above the step size is worked on alone and whole.  An empty table gives no rows; other columns are not read.
    """
    if not 1 < width <= WIDEST:
        raise ValueError(f"width must lie between 2 and {WIDEST}")
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    texts, table = packed_texts(docs, id, text)
    try:
        places = repeated_places(texts, width, most, fanout, at_once)
        lists = written(places.groupBy("uid").agg(F.collect_list("place").alias("places")), "places")
    finally:
        # The files stay and are read below; only the name goes.
        spark.sql(f"DROP TABLE IF EXISTS {table}")

    def run(batches):
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for part, data, offsets in texts_in(batches):
            lists = part.column("places")
            each = np.diff(lists.offsets.to_numpy())
            first, _, more = unpacked_place(lists.flatten().to_numpy())
            start = np.repeat(offsets[:-1], each) + first
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, start, 1)
            np.add.at(depth, start + more + width, -1)
            gone = np.cumsum(depth)[:-1] > 0
            edges = np.zeros(len(data) + 1, np.int8)
            edges[:-1] = gone
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            closes = gone & (edges[1:] == 0)
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            opens[inner] = gone[inner]
            closes[inner - 1] = gone[inner - 1]
            starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            of = np.searchsorted(offsets, starts, side="right") - 1
            sums = np.append(0, np.cumsum(gone))
            removed = sums[offsets[1:]] - sums[offsets[:-1]]
            kept = np.append(0, np.cumsum(np.diff(offsets) - removed)).astype(np.int64)
            kept = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(kept), pa.py_buffer(data[~gone].tobytes())]).cast(pa.binary())
            spans = pa.StructArray.from_arrays([pa.array(starts - offsets[of]), pa.array(ends - offsets[of])], ["start", "end"])
            bounds = pa.array(np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("n_bytes"), pa.array(removed), pa.ListArray.from_arrays(bounds, spans).cast(span_type), kept],
                names=["id", "n_bytes", "n_removed", "spans", "kept"])

    met = texts.join(lists, "uid", "left").select("id", "n_bytes", "packed", F.coalesce("places", F.array().cast("array<bigint>")).alias("places"))
    out = met.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, spans {SPANS}, kept binary")
    return out.withColumnRenamed("id", id)


def suffix_digests(docs):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    found = without_repeats(docs)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
