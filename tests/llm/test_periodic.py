"""Periodic runs of words against a plain search over all lags."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from vectormart.llm import periodic


def plain_runs(words, least=12):
    """All maximal stretches of every lag that are long enough; of equal stretches the smallest lag."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - first + q >= max(least, 2 * q):
                best.setdefault((first - q, i), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def words_after(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if i is None else zlib.crc32(str(i).encode())
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def plain_row(i, text):
    words = words_after(i, text)
    runs = plain_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (i, len(runs), *top, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def awkward():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a " * 12, "a " * 11, "na " * 3000, "a b\x0bc\r" * 400, "one two three four five six " * 2, "é ü " * 30 + "é",
             ("x y z w v u t s r q p o n m l " * 9 + "! ") * 6, "a a a b " * 40 + "c " + "a a a b " * 40, " ".join("ab"[bin(k).count("1") % 2] for k in range(300))]
    for _ in range(220):
        words, kinds = [], rng.choice([1, 2, 2, 3, 5, 40])
        while len(words) < rng.randint(1, 130):
            part = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 20))]
            words += part * rng.choice([1, 1, 2, 3, 7])
        texts.append(rng.choice([" ", "\n ", "\t"]).join(words))
    return texts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("pairs", [1 << 20, 1, 7])
def test_runs_equal_plain_search(spark, monkeypatch, pairs):
    for text in awkward():
        words = (text or "").split()
        monkeypatch.setattr(periodic, "PAIRS", max(pairs, len(words) // 4))
        codes = np.array([hash(w) % (1 << 30) for w in words], np.int64)
        codes = np.unique(codes, return_inverse=True)[1]
        _, start, length, period = periodic.runs_of(codes, np.array([0, len(words)]))
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == plain_runs(words), text


def test_digests(spark, monkeypatch):
    texts = awkward()
    table = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[6]), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in table], "doc_id long, text string, runs string, n_words int").repartition(3)
    want = sorted((plain_row(i, t) for i, t in table), key=str)
    assert rows(periodic.run_digests(docs)) == want
    assert rows(periodic.run_digests(docs.limit(0))) == []


def test_long_texts_and_nulls(spark):
    long = " ".join(f"w{k % 70_000}" for k in range(1_100_000))  # more than one step of bytes
    docs = spark.createDataFrame([(1, long), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.word_runs(docs).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 1_100_000, 70_000)] and got[1].collapsed == " ".join(f"w{k}" for k in range(70_000))
    assert got[2].collapsed is None and got[2].runs == [] and got[3].collapsed == ""
