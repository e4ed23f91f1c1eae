"""Removal of repeated byte strings against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vectormart.llm import suffix_dedup
from vectormart.llm.words import flat


def plain(texts, width):
    """(bytes, removed spans, kept bytes) of every text, from a count of all windows."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = [True] * width
        spans, kept = [], bytes(x for x, g in zip(b, gone) if not g)
        for i, g in enumerate(gone):
            if g and (not i or not gone[i - 1]):
                spans.append((i, i))
            if g:
                spans[-1] = (spans[-1][0], i + 1)
        out.append((len(b), spans, kept))
    return out


def awkward(width, seed=2, n=150):
    rng = random.Random(seed)
    said = ["".join(rng.choice("abcdef é\n") for _ in range(rng.randint(width // 2, 3 * width))) for _ in range(12)]
    texts = [None, "", "a", "x" * (width - 1), "x" * width, "x" * (3 * width + 1), "ab" * 2 * width, said[0], said[0], "\0" * width + "\0b", "日本語" * width]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.4:
                s = rng.choice(said)
                a = rng.randrange(len(s))
                parts.append(s[a:a + rng.randint(1, 2 * width)])
            elif kind < 0.5:
                parts.append(rng.choice(["ab", "a", "abc"]) * rng.randint(1, width))
            else:
                parts.append("".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, width))))
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("width, most, fanout, at_once", [(16, 1000, 4, 1 << 15), (16, 2, 4, 4), (16, 1, 2, 1), (24, 3, 3, 8), (2, 2, 4, 4)])
def test_removed_equals_plain_count(spark, width, most, fanout, at_once):
    texts = awkward(width)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(4)
    want = plain(texts, width)
    got = suffix_dedup.without_repeats(docs, width=width, most=most, fanout=fanout, at_once=at_once).collect()
    assert len(got) == len(texts)
    for r in got:
        size, spans, kept = want[r.doc_id]
        assert (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) == (size, spans, kept), r.doc_id
        assert r.n_removed == size - len(kept)


def test_digests(spark):
    rng = random.Random(9)
    line = "All of this page may be used under the terms that are given at the end of it, and under no other ones. " * 3
    texts = [None, "", line, *[f"{rng.random()} {line[k:]} {rng.random()}" for k in range(60)],
             *["".join(rng.choice("abc") for _ in range(900)) for _ in range(5)], "tail " + "z" * 700, "z" * 450]
    table = [*enumerate(texts), (None, texts[-1]), (4, texts[4]), (4, "other text under one id")]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in table], "doc_id long, text string, left string, n_bytes int").repartition(3)
    want = [(i, n, n - len(k), len(s), hashlib.sha256(k).hexdigest()) for (i, _), (n, s, k) in zip(table, plain([t for _, t in table], 200))]
    assert sorted(map(tuple, suffix_dedup.suffix_digests(docs).collect()), key=str) == sorted(want, key=str)
    assert suffix_dedup.suffix_digests(docs.limit(0)).collect() == []


def test_long_text(spark):
    rng = np.random.default_rng(1)
    long = rng.integers(97, 123, 5_000_000).astype(np.uint8).tobytes().decode()  # more than one step
    docs = spark.createDataFrame([(1, long + long[2_000_000:2_000_300]), (2, long[4_999_900:] + "!" + long[7:206])], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix_dedup.without_repeats(docs).collect()}
    assert got[1] == [(2_000_000, 2_000_300), (5_000_000, 5_000_300)] and got[2] == []


def test_segments_hold_all_windows():
    texts = [t or "" for t in awkward(16)]
    data, offsets = flat(pa.array(texts))
    of, place, _, _ = suffix_dedup.segments(data, offsets, 16)
    first, before, more = suffix_dedup.unpacked_place(place)
    windows = sorted((t, p) for t, a, n in zip(of.tolist(), first.tolist(), more.tolist()) for p in range(a, a + n + 1))
    assert windows == [(t, p) for t, x in enumerate(texts) for p in range(len(x.encode()) - 15)]
