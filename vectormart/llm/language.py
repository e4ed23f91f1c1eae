"""Language identification by unigram pieces, summed over all segmentations.

A fixed public vocabulary gives the pieces.  Training counts, per language, how often each piece occurs
inside the words of labelled documents; the shares are its probabilities.  A word scores the sum over all
ways to cut it into pieces of the product of their probabilities (forward algorithm); a text scores the
product over its words.  Words are runs of letters in lower case with a space in front.

The model has at most one row per piece and language: that is the bound under which it is collected.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from vectormart.llm.words import SMALL_STEP_BYTES, binary, distinct, flat, give_back, lean, steps

UNDECIDED = "und"
FLOOR = 1e-9  # probability of a byte that no piece of the model covers
SMOOTHING = 0.05
RESCALE = 16  # bytes after which sums are rescaled, so that long words do not fall below the smallest double
HASH_BITS = 20


class Vocabulary:
    """Pieces made of letters, found by a hash of their bytes."""

    loaded = {}

    def __init__(self, path):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i).replace("▁", " ") for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i)]
        pieces = sorted({n.encode("utf-8") for n in names if n.lstrip(" ").isalpha() and n.rfind(" ") <= 0})
        self.longest = max(map(len, pieces))
        hashes = np.array([self.hash_of(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.size = hashes[order], len(pieces)
        if len(np.unique(self.hashes)) != self.size:
            raise ValueError("two pieces of the vocabulary share a hash")
        self.seen = np.zeros(1 << HASH_BITS, bool)
        self.seen[(self.hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)] = True

    @staticmethod
    def hash_of(piece):
        value = 0
        for byte in piece:
            value = (value * 0x9E3779B97F4A7C15 + byte + 1) % (1 << 64)
        return value

    @classmethod
    def of(cls, path):
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def find(self, data, ends):
        """(place, length, piece) of every piece that lies inside a word; ``ends`` is the end of each byte's word."""
        hashes, at, out = np.zeros(len(data), np.uint64), np.arange(len(data)), []
        for length in range(1, self.longest + 1):
            at = at[at + length <= ends[at]]
            hashes = hashes[:0] if not len(at) else hashes
            if not len(at):
                break
            hashes[at] = hashes[at] * np.uint64(0x9E3779B97F4A7C15) + data[at + length - 1] + np.uint64(1)
            maybe = at[self.seen[(hashes[at] >> np.uint64(64 - HASH_BITS)).astype(np.int64)]]
            piece = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), self.size - 1)
            hit = self.hashes[piece] == hashes[maybe]
            out.append((maybe[hit], np.full(int(hit.sum()), length), piece[hit]))
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def letter_words(texts):
    """Words of all texts (each begins with a space) and the number of the first word of every text."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    spaced = pc.replace_substring_regex(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), lowered, pa.scalar("", pa.large_string())), r"[^\pL]+", " ")
    data, offsets = flat(spaced)
    starts = np.flatnonzero(data == 32)
    lengths = np.diff(np.append(starts, len(data)))
    kept = lengths > 1
    words = binary(data, starts)
    firsts = np.append(0, np.cumsum(kept))[np.searchsorted(starts, offsets)]
    return words.filter(pa.array(kept)), firsts


def laid_out(vocabulary):
    """Bytes of distinct words, the end of each byte's word, and each word's start."""
    offsets = np.frombuffer(vocabulary.buffers()[1], np.int32 if vocabulary.type == pa.binary() else np.int64)
    offsets = offsets[vocabulary.offset:vocabulary.offset + len(vocabulary) + 1].astype(np.int64)
    data = np.frombuffer(vocabulary.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    return data, np.repeat(offsets[1:], np.diff(offsets)), offsets


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs, pieces):
    """(languages, log probabilities): learned from all rows of ``docs`` (text, lang) whose lang is not null."""

    def run(batches):
        table = Vocabulary.of(pieces)
        for batch in batches:
            for first, last in steps(batch.column("text"), SMALL_STEP_BYTES):
                part = batch.slice(first, last - first)
                words, firsts = letter_words(part.column("text"))
                if not len(words):
                    continue
                vocabulary, codes = distinct(words)
                names = part.column("lang").dictionary_encode()
                lang = np.repeat(names.indices.to_numpy(zero_copy_only=False), np.diff(firsts))
                data, ends, offsets = laid_out(vocabulary)
                place, _, piece = table.find(data, ends)
                word = np.searchsorted(offsets, place, side="right") - 1
                for i, name in enumerate(names.dictionary.to_pylist()):
                    times = np.bincount(codes[lang == i], minlength=len(vocabulary))
                    counts = np.bincount(piece, weights=times[word], minlength=table.size)
                    there = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(there), pa.string()), pa.array(there, pa.int64()), pa.array(counts[there].astype(np.int64))],
                        names=["lang", "piece", "n"])

    rows = docs.filter("lang is not null and text is not null").select("text", "lang")
    counts = rows.mapInArrow(lean(run), "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((Vocabulary.of(pieces).size, len(languages)), SMOOTHING)
    for i, name in enumerate(languages):
        own = counts[counts["lang"] == name]
        table[own["piece"].to_numpy(np.int64), i] += own["n"].to_numpy(np.float64)
    return languages, table / table.sum(axis=0) if languages else table


def word_scores(vocabulary, table, probabilities):
    """Log of the sum over all segmentations, per distinct word and language."""
    # Words by falling length: those that reach a byte are the first of them, and sums lie byte by byte.
    given = pc.binary_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    by_size = np.argsort(-given, kind="stable")
    data, ends, offsets = laid_out(vocabulary.take(pa.array(by_size)))
    sizes = np.diff(offsets)
    longest = int(sizes[0])
    reaching = np.searchsorted(-sizes, -np.arange(longest + 1), side="right")
    base = np.append(0, np.cumsum(reaching))
    place, length, piece = table.find(data, ends)
    word = np.repeat(np.arange(len(sizes)), sizes)[place]
    inside = place - offsets[word]
    # Pieces come by length; sorted by their byte in the word, those of one byte and length lie together.
    order = np.argsort(inside.astype(np.min_scalar_type(longest)), kind="stable")
    word, piece = word[order], piece[order]
    together = (inside * (table.longest + 1) + length)[order]
    edges = np.append(np.flatnonzero(np.diff(together, prepend=-1)), len(together))
    first_edge = np.searchsorted(together[edges[:-1]], np.arange(longest + 1) * (table.longest + 1))
    steps_of = together[edges[:-1]] % (table.longest + 1)
    slots = np.zeros((int(base[-1]), probabilities.shape[1]))
    slots[:len(sizes)] = 1.0
    scale = np.zeros((len(sizes), probabilities.shape[1]))
    for k in range(longest):
        here = slots[base[k]:base[k + 1]]
        if k and k % RESCALE == 0:
            # All that follows is linear in the sums from here to the longest piece ahead.
            ahead = [slots[base[j]:base[j + 1]] for j in range(k, min(k + table.longest, longest) + 1)]
            most = here.copy()
            for level in ahead:
                most[:len(level)] = np.maximum(most[:len(level)], level)
            for level in ahead:
                level /= most[:len(level)]
            scale[:len(here)] += np.log(most)
        # A byte may also stand alone at the floor, so that every word has a segmentation.
        slots[base[k + 1]:base[k + 2]] += here[:reaching[k + 1]] * FLOOR
        for edge in range(first_edge[k], first_edge[k + 1]):
            of = slice(edges[edge], edges[edge + 1])
            slots[base[k + steps_of[edge]] + word[of]] += here[word[of]] * probabilities[piece[of]]
    out = np.empty_like(scale)
    out[by_size] = np.log(slots[base[sizes] + np.arange(len(sizes))]) + scale
    return out


def identified(spark, model, pieces):
    """A function of a text column: struct (lang_pred, score), the likeliest language of a whole text and its posterior.

    Languages have equal priors; the first in alphabetical order wins a tie.  A text that is null or has
    no letter, or any text if nothing was learned, gives ``und`` and score 0.  Only the text goes to Python.
    """
    shared = spark.sparkContext.broadcast(model)

    def of_slice(texts, names, table):
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        words, firsts = letter_words(texts)
        if len(words) and names:
            vocabulary, codes = distinct(words)
            scores = word_scores(vocabulary, Vocabulary.of(pieces), table)
            some = np.diff(firsts) > 0
            sums = np.zeros((len(texts), len(names)))
            sums[some] = np.add.reduceat(scores[codes], firsts[:-1][some], axis=0)
            rest = np.exp(sums - sums.max(axis=1, keepdims=True))
            best = np.where(some, sums.argmax(axis=1), -1)
            score = np.where(some, 1 / rest.sum(axis=1), 0.0)
        return pa.array([names[b] if b >= 0 else UNDECIDED for b in best], pa.string()), pa.array(score)

    @F.arrow_udf("lang_pred string, score double")
    def found(texts: pa.Array) -> pa.Array:
        names, table = shared.value
        parts = [pa.StructArray.from_arrays(of_slice(texts.slice(first, last - first), names, table), names=["lang_pred", "score"])
                 for first, last in steps(texts, SMALL_STEP_BYTES)]
        give_back()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    return found


def identify(docs, model, pieces, id="doc_id", text="text"):
    """(id column, lang_pred, score) of every row, as ``identified`` states it."""
    found = identified(docs.sparkSession, model, pieces)
    rows = docs.select(F.col(f"`{id}`"), found(F.col(f"`{text}`")).alias("found of text"))
    return rows.select(F.col(f"`{id}`"), "`found of text`.lang_pred", "`found of text`.score")


def predictions(docs, pieces):
    """(doc_id, held_out, lang_pred, score) of every document, learned from those not held out."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), pieces)
    return identify(docs, model, pieces).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def recognised(docs, pieces, least=0.5):
    """The rows of ``docs`` whose language is recognised with a score of at least ``least``, with the columns they had."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), pieces)
    found = identified(docs.sparkSession, model, pieces)(F.col("text"))
    return docs.filter((found["lang_pred"] != UNDECIDED) & (found["score"] >= least))
