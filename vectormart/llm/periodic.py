"""Periodic runs of words, found by an online sparse dynamic programme over diagonals.

A *run* is a stretch of consecutive words with smallest period q (words q apart are identical) that holds at
least ``LEAST`` words and two periods, and that no neighbouring word extends.  Walking through the words in
order, every earlier occurrence of what stands here increments the match length of the diagonal of its lag;
a diagonal that is not incremented ends, and gives a run at once if it is long enough.

The table is sparse in two ways.  A run matches itself over at least ``LEAST // 2`` words in a row, so
occurrence lists are kept of windows of so many words, and single words start no diagonals.  And where the last
occurrences of a window are chained at one lag d inside one stretch, only the nearest of them counts: lags 2d,
3d ... end where that stretch ends and give no smallest period.  So a text that says one thing over and
over costs no more than its length.

Words are walked through in steps of at most ``PAIRS`` occurrences; the diagonals that are still open are carried
from one step to the next, so memory does not grow with the number of occurrences.  No row meets another one.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from vectormart.llm.words import SPACE, binary, flat, steps

LEAST = 12
PAIRS = 1 << 20


def words_of(column):
    """(words of all texts, number of the first word of every text and one more); white space is x20 and x09-x0D."""
    data, offsets = flat(column)
    if not len(data):
        return binary(data, np.zeros(0, np.int64)).view(pa.string()), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = ~space[edges]
    ends[edges - 1] = ~space[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    marks = np.empty(2 * len(starts), np.int64)
    marks[0::2], marks[1::2] = starts, stops
    words = binary(data, marks).take(pa.array(np.arange(0, len(marks), 2)))
    return words.view(pa.string()), np.searchsorted(starts, offsets)


def named(codes, width):
    """For every place but the last ones a number that is equal for equal windows of ``width`` codes, and for no others."""
    if width == 1 or len(codes) < width:
        return codes[:max(0, len(codes) - width + 1)].astype(np.int64)
    head, tail = width - width // 2, width // 2
    left = ranked(codes, head)
    right = left if head == tail else ranked(codes, tail)
    n = len(codes) - width + 1
    return left[:n] * (int(right.max()) + 1) + right[head:head + n]


def ranked(codes, width):
    return np.unique(named(codes, width), return_inverse=True)[1] if width > 1 else codes.astype(np.int64)


def occurrences(codes, firsts, width):
    """(place, rank, group's first rank, chain's first rank, places by rank) of all windows that occurred before in their text.

    Ranks number the windows by name, then by text, then by place.
    """
    name = named(codes, width)
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    whole = np.flatnonzero(text[:len(name)] == text[len(codes) - len(name):])
    order = whole[np.argsort(name[whole], kind="stable")]
    again = np.zeros(len(order), bool)
    again[1:] = (name[order[1:]] == name[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    rank = np.flatnonzero(again)
    if not len(rank):
        return rank, rank, rank, rank, order
    group = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))[rank]
    place = order[rank]
    before = order[rank - 1]
    lag = place - before
    by_lag = np.lexsort((place, lag))
    new = np.ones(len(rank), bool)
    new[1:] = (np.diff(lag[by_lag]) != 0) | (np.diff(place[by_lag]) != 1)
    stretch = np.empty(len(rank), np.int64)
    stretch[by_lag] = place[by_lag][np.maximum.accumulate(np.where(new, np.arange(len(rank)), 0))]
    chain = np.maximum.accumulate(np.where(before >= stretch, 0, rank - 1))
    by_place = np.argsort(place)
    return tuple(x[by_place] for x in (place, rank, group, chain)) + (order,)


def diagonals(codes, firsts, width):
    """(lag, first, last) of maximal stretches of windows that equal the windows ``lag`` before, step by step."""
    place, rank, group, chain, order = occurrences(codes, firsts, width)
    count = 1 + chain - group
    ends = np.cumsum(count)
    open_lag = open_first = np.zeros(0, np.int64)
    at, last_place = 0, -1
    while at < len(place):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        here = slice(at, upto)
        n, total = count[here], int(count[here].sum())
        nth = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(place[here], n)
        earlier = np.where(nth == 0, np.repeat(rank[here] - 1, n), np.repeat(group[here] - 1, n) + nth)
        lag = i - order[earlier]
        by_lag = np.lexsort((i, lag))
        lag, i = lag[by_lag], i[by_lag]
        new = np.ones(total, bool)
        new[1:] = (np.diff(lag) != 0) | (np.diff(i) != 1)
        heads = np.flatnonzero(new)
        lags, first, last = lag[heads], i[heads], i[np.append(heads[1:], total) - 1]
        goes_on = np.zeros(len(open_lag), bool)
        if len(open_lag) and place[at] == last_place + 1:
            known = np.minimum(np.searchsorted(open_lag, lags), len(open_lag) - 1)
            joined = (first == place[at]) & (open_lag[known] == lags)
            first[joined] = open_first[known[joined]]
            goes_on[known[joined]] = True
        yield open_lag[~goes_on], open_first[~goes_on], np.full(int((~goes_on).sum()), last_place)
        last_place = place[upto - 1]
        still = last == last_place
        yield lags[~still], first[~still], last[~still]
        open_lag, open_first = lags[still], first[still]
        at = upto
    yield open_lag, open_first, np.full(len(open_lag), last_place)


def runs_of(codes, firsts, least=LEAST):
    """(text, start, length, period) of all runs, by text, start and period; starts are numbered over all texts."""
    width = max(1, least // 2)
    text_of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    found = [np.zeros((3, 0), np.int64)]
    for lag, first, last in diagonals(codes, firsts, width):
        matched = last - first + width
        enough = matched >= np.maximum(least - lag, lag)
        if enough.any():
            lag, start, end = lag[enough], (first - lag)[enough], (last + width)[enough]
            of = text_of[start]
            # Parts of a diagonal whose inner lags were left out touch words that match on; they are no runs.
            left = start > firsts[of]
            left[left] = codes[start[left] - 1] == codes[start[left] - 1 + lag[left]]
            right = end < firsts[of + 1]
            right[right] = codes[end[right]] == codes[end[right] - lag[right]]
            whole = ~(left | right)
            found.append(np.stack([start[whole], end[whole], lag[whole]]))
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    return text_of[start], start, end - start, period


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def word_runs(docs, id="doc_id", text="text", least=LEAST, places=None):
    """(id, n_words, runs, collapsed) of every row: its runs by start and period, and its words without repeats.

    A word is left out of ``collapsed`` if any run holds it after its first period; the rest is joined by single
    spaces.  ``places(ids, counts)`` may name, for every word place of all texts, the word that stands there (by number
    over all texts); by default every word stands where it was written.

    Every row gives one row, repeated rows and rows without an id too.  A null text has no words, no runs and a null
    ``collapsed``; an empty or blank one an empty string.  Runs that begin alike are told apart by their
    period.  A text above the step size is worked on alone and whole.  An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for first, last in steps(batch.column("text")):
                part = batch.slice(first, last - first)
                words, firsts = words_of(part.column("text"))
                counts = np.diff(firsts)
                coded = words.dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                stands = None if places is None else places(part.column("id"), counts)
                if stands is not None:
                    codes = codes[stands]
                of, start, length, period = runs_of(codes, firsts, least)
                depth = np.zeros(len(codes) + 1, np.int64)
                np.add.at(depth, start + period, 1)
                np.add.at(depth, start + length, -1)
                kept = np.flatnonzero(np.cumsum(depth)[:-1] == 0)
                said = words.take(pa.array(kept if stands is None else stands[kept]))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, firsts).astype(np.int32)), said)
                texts = pc.binary_join(lists, " ")
                null = part.column("text").is_null()
                if null.true_count:
                    texts = pc.if_else(null, pa.scalar(None, texts.type), texts)
                each = pa.StructArray.from_arrays([pa.array(start - firsts[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                ends = pa.array(np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(counts), pa.ListArray.from_arrays(ends, each).cast(run_type), texts],
                    names=[id, "n_words", "runs", "collapsed"])

    read = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return read.mapInArrow(run, f"`{id}` {kind}, n_words long, runs array<{RUN}>, collapsed string")


def looped(ids, counts):
    """Where every word comes from, if one document in ten goes round in a loop: by the checksum of its id, from a place
    on its words repeat a part of it.  A document without an id stays as it is."""
    ends = np.cumsum(counts)
    stands = np.arange(int(ends[-1]) if len(ends) else 0)
    for id, n, end in zip(ids.to_pylist(), counts.tolist(), ends.tolist()):
        if id is None or not n:
            continue
        h = zlib.crc32(str(id).encode())
        if h % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        stands[end - n + a:end] = end - n + a + np.arange(n - a) % p
    return stands


def run_digests(docs):
    """One row per document: doc_id, n_runs, the longest run (start, length, period, exponent_milli; ties: smallest start,
    then period; null without runs), runs_sha256 of all runs and collapsed_sha256, after one document in ten was looped."""
    found = word_runs(docs, places=looped)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("best.length * 1000 div -best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"))
