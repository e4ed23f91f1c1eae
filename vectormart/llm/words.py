"""Whole columns of text as flat bytes: cutting into words and encoding each distinct word once.

Used inside Arrow functions.  A *word* is a run of white space with what follows it up to the
next white space.  It begins where an ASCII white-space character follows a character that is
surely none, and there every byte-level tokenizer of the usual pattern begins a new piece as
well, so the ids of a text are the ids of its words one after another.  Where it is doubtful
whether a character is white space nothing is cut: words get longer, ids stay right.  Punctuation after a letter is a
word of its own for the same reason (an apostrophe is not, as it may begin a contraction).
"""

import ctypes
import os
import threading
from array import array
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# Printable ASCII; letters of the Latin-1 block (lead byte C3) are added in ``cut``.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK = SOLID & ~LETTER
MARK[[*range(0x30, 0x3A), 0x27]] = False
MARK[[0x3C, 0x3E, 0x7C]] = False  # < > | may belong to a special token, which must stay whole
STEP_BYTES = 4 << 20
SMALL_STEP_BYTES = 1 << 20  # where many arrays of numbers stand beside the text


def give_back():
    """Hand memory that Arrow and the allocator keep for later back to the system: a waiting worker stands beside the executor's other work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """``run``, a function over Arrow batches, after whose last batch the worker gives back what it keeps."""

    @wraps(run)
    def leaving(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return leaving


def leanly(function, *given):
    """``function(*given)``, after which the worker gives back what it keeps."""
    try:
        return function(*given)
    finally:
        give_back()


def flat(column):
    """Bytes and offsets of a text column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def binary(data, starts):
    """A binary array over parts of ``data``; part i ends where part i + 1 begins."""
    wide = len(data) > 2 ** 31 - 2
    ends = np.append(starts, len(data)).astype(np.int64 if wide else np.int32)
    kind = pa.large_binary() if wide else pa.binary()
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def cut(data, offsets):
    """Words of all texts, and for each text the number of the first word (one more at the end)."""
    begins = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        solid, letter = SOLID[data], LETTER[data]
        latin = (data[1:] >= 0x80) & (data[:-1] == 0xC3)
        solid[1:] |= latin
        letter[1:] |= latin & (data[1:] != 0x97) & (data[1:] != 0xB7)  # the signs for times and divided by
        begins[1:-1] = SPACE[data[1:]] & solid[:-1] | MARK[data[1:]] & letter[:-1]
    begins[offsets] = True
    starts = np.flatnonzero(begins[:-1])
    return binary(data, starts), np.searchsorted(starts, offsets)


def distinct(words):
    """Distinct words and the code of every word among them."""
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def gathered(codes, lengths, values):
    """Concatenate the value lists of all codes; also the end of each list."""
    firsts = np.cumsum(lengths) - lengths
    taken = lengths[codes]
    ends = np.cumsum(taken)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(firsts[codes] - (ends - taken), taken) + np.arange(total)
    return values[at], ends


class Encoder:
    """One tokenizer per worker, with the ids of words it met before (a bounded memory)."""

    loaded = {}
    leaving = None
    KEPT = 300_000

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kept = {}

    @classmethod
    def of(cls, path):
        cls.stay()
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    @classmethod
    def forget_soon(cls, seconds=5):
        """Forget all words unless a task asks for some before that: the next one of a run needs them, a waiting worker does not."""
        cls.stay()
        cls.leaving = threading.Timer(seconds, cls.forget)
        cls.leaving.daemon = True
        cls.leaving.start()

    @classmethod
    def stay(cls):
        if cls.leaving:
            cls.leaving.cancel()
            cls.leaving = None

    @classmethod
    def forget(cls):
        for one in list(cls.loaded.values()):
            one.kept = {}
        give_back()

    def encode(self, words, most=None):
        """(number of ids of each word, all ids), for distinct words given as bytes; ``most`` words are remembered."""
        keys = words.to_pylist()
        kept = self.kept  # ``forget`` may take it from the next call, not from this one
        new = [w for w in keys if w not in kept]
        if new:
            if len(kept) + len(new) > (most or self.KEPT):
                kept = self.kept = {}
                new = keys
            for at in range(0, len(new), 20_000):
                part = new[at:at + 20_000]
                found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False)
                for word, one in zip(part, found):
                    kept[word] = array("I", one.ids).tobytes()
        ids = [kept[w] for w in keys]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return lengths, np.frombuffer(b"".join(ids), np.uint32)


def steps(column, most=None):
    """Slices of a column of about ``most`` bytes (``STEP_BYTES``); a longer text makes a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // (most or STEP_BYTES)
    firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(sizes) else np.zeros(0, int)
    for first, last in zip(firsts, np.append(firsts[1:], len(sizes))):
        yield int(first), int(last)


def token_ids(column, path, most=None):
    """Ids of all texts of a slice, and for each text the place of its first id (one more at the end)."""
    words, firsts = cut(*flat(column))
    if not len(words):
        return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
    vocabulary, codes = distinct(words)
    ids, ends = gathered(codes, *Encoder.of(path).encode(vocabulary, most))
    return ids, np.append(0, ends)[firsts]
