"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Every paragraph hashes to a wide vector of ``LANES`` bits.  A fingerprint is the number of paragraphs
and, lane by lane, the sum of the vectors modulo 2^32, which no text reaches.  Sums know no order, so texts with the
same paragraphs in any order agree; a paragraph is added or taken away by adding or subtracting its
vector.  Read as plus or minus one, the lanes are a random projection of the paragraph counts, so
the cosine of two fingerprints estimates how much of their paragraphs two texts share.

A paragraph is a line, cut further behind sentence ends, with the separator it ends in.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectormart.session import written

LANES, POWER = 128, 32
PARAGRAPH_END = r"(?<=\n)|(?<=[.!?]\x20)"

# Bits of a paragraph's hash are added eight to a long, a byte apart, over so many paragraphs that no byte
# and no signed long runs over; then two to a long, 32 bits apart: no text has the 2^31 paragraphs that would.
BYTES, PAIRS, CHUNK = 0x0101010101010101, 0x000000FF000000FF, 127


def bound(value, of):
    """``of(value)`` with ``value`` computed once, however often ``of`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), of), 1)


def paragraphs(text):
    """Paragraphs of a text, in order; none for an empty text or null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END, -1), "")


def bit_sums(hashes):
    """Sums of the bits of an array of hashes: 32 longs, bit i in the lower and bit i + 32 in the upper half of long i."""
    shifted = F.call_function
    shifts, bytes_up = F.expr("sequence(0, 7)"), F.expr("sequence(0, 24, 8)")
    chunks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(hashes) - 1) / CHUNK).cast("int"), F.lit(0)))

    def in_bytes(part):
        return F.transform(shifts, lambda s: F.aggregate(
            part, F.lit(0).cast("long"), lambda sum_, h: sum_ + shifted("shiftrightunsigned", h, s).bitwiseAND(F.lit(BYTES))))

    def in_pairs(eight):
        return F.flatten(F.transform(bytes_up, lambda up: F.transform(
            eight, lambda w: shifted("shiftrightunsigned", w, up).bitwiseAND(F.lit(PAIRS)))))

    def of_chunk(chunk):
        return bound(bound(F.slice(hashes, chunk * CHUNK + 1, F.lit(CHUNK)), in_bytes), in_pairs)

    zero = F.expr("transform(sequence(0, 31), i -> 0L)")
    return F.aggregate(chunks, zero, lambda sums, chunk: F.zip_with(sums, of_chunk(chunk), lambda x, y: x + y))


def lane_sums(parts):
    """[number of paragraphs, lane sums modulo 2^32 ...] of an array of paragraphs."""

    def summed(hashes):
        words = F.concat(bound(hashes["a"], bit_sums), bound(hashes["b"], bit_sums))
        return bound(words, lambda w: F.concat(
            F.array(F.size(hashes["a"]).cast("long")),
            F.transform(w, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))), F.transform(w, lambda x: F.call_function("shiftrightunsigned", x, F.lit(32)))))

    return bound(bound(parts, lambda p: F.struct(F.transform(p, lambda x: F.xxhash64(x)).alias("a"),
                                                 F.transform(p, lambda x: F.xxhash64(x, F.lit(1))).alias("b"))), summed)


def fingerprint(text):
    return lane_sums(paragraphs(text))


def inserted(print_, parts):
    """Fingerprint after an array of paragraphs was added."""
    return changed(print_, lane_sums(parts), 1)


def deleted(print_, parts):
    """Fingerprint after an array of paragraphs, all of them present, was taken away."""
    return changed(print_, lane_sums(parts), -1)


def changed(print_, other, sign):
    sums = F.zip_with(print_, other, lambda a, b: a + F.lit(sign) * b)
    return F.transform(sums, lambda x, i: F.when(i == 0, x).otherwise(F.pmod(x, F.lit(1 << POWER))))


def as_hex(print_):
    """The number of paragraphs and each lane in 8 hex digits."""
    return F.lower(F.array_join(F.transform(print_, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a, b):
    """Estimated cosine of two texts' paragraph counts, 0 to 1; equal fingerprints 1, an empty text and another 0."""
    count = lambda x: F.element_at(x, 1)
    signed = lambda x: F.transform(F.slice(x, 2, LANES), lambda lane: (2 * lane - count(x)).cast("double"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(signed(a), signed(b), lambda x, y: x * y))
    square = lambda x: total(F.transform(signed(x), lambda v: v * v))
    size = F.sqrt(square(a) * square(b))
    return F.when(a == b, 1.0).when((count(a) == 0) | (count(b) == 0) | (size == 0), 0.0).otherwise(
        F.least(F.greatest(dot / size, F.lit(0.0)), F.lit(1.0)))


def followers(rows):
    """(doc_id, hash, next_id, next_hash, take) of distinct (doc_id, hash, take) rows: who comes next by doc_id.

    Ranges of ids are walked on their own; the first row of a range follows the last of the one
    before it, and the first of all follows the last.  Only the heads of ranges meet in one task.
    """
    ranged = rows.repartitionByRange("doc_id", "hash").withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    order = Window.partitionBy("range").orderBy("doc_id", "hash")
    here = F.struct("doc_id", "hash")
    walked = ranged.withColumns({"follower": F.lead(here).over(order), "head": F.row_number().over(order) == 1})
    heads = walked.filter("head").select("range", here.alias("own"))
    line = Window.orderBy("range")
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("range", F.coalesce(F.lead("own").over(line), F.first("own").over(every)).alias("next_head"))
    joined = walked.join(heads, "range").withColumn("follower", F.coalesce("follower", "next_head"))
    return joined.select("doc_id", "hash", "take", F.col("follower.doc_id").alias("next_id"), F.col("follower.hash").alias("next_hash"))


def fingerprints_beside_edits(docs):
    """Fingerprint of every text, of its edited text, and how like they are, as the registered query states it.

    Null texts are empty.  Rows with equal ids stand in the order of a hash of their texts; rows that
    repeat id and text each give a row, and count as one when the next document is sought.  A single
    document follows itself.  Rows without an id come first.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    sizes = texts.select("doc_id", "hash", F.floor(F.length("text") / 2).cast("int").alias("take"))
    pairs = written(followers(sizes.distinct()), "followers")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    # Each text goes to the document before it, cut to what that one takes.
    asked = pairs.select(F.col("next_id").alias("for_id"), F.col("next_hash").alias("for_hash"),
                         F.col("doc_id").alias("to_id"), F.col("hash").alias("to_hash"), "take")
    sent = texts.join(asked, same("doc_id", "for_id") & (F.col("hash") == F.col("for_hash")))
    sent = sent.select("to_id", "to_hash", F.expr("left(text, take)").alias("head"), fingerprint(F.col("text")).alias("next_print"))
    sent = sent.groupBy("to_id", "to_hash").agg(F.first("head").alias("head"), F.first("next_print").alias("next_print"))
    met = texts.join(sent, same("doc_id", "to_id") & (F.col("hash") == F.col("to_hash")))
    # Where a paragraph ends depends on what stands before, so the paragraphs of the kept half but its last
    # are paragraphs of both texts: they are summed once, and what differs is inserted.
    halves = met.select(
        "doc_id", "text", "next_print", "head", F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))").alias("half"))
    halves = halves.select("*", paragraphs(F.col("text")).alias("parts"), paragraphs(F.col("half")).alias("half_parts"))
    halves = halves.withColumn("shared", F.greatest(F.size("half_parts") - 1, F.lit(0)))
    changes = halves.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "next_print", F.sha2(F.concat("half", "head"), 256).alias("edited_sha256"),
        lane_sums(F.slice("parts", F.lit(1), F.col("shared"))).alias("common"),
        lane_sums(F.slice("parts", F.col("shared") + 1, F.size("parts"))).alias("gone"),
        fingerprint(F.concat(F.coalesce(F.get("half_parts", F.col("shared")), F.lit("")), "head")).alias("come"))
    prints = changes.select("doc_id", "n_chars", "next_print", "edited_sha256", changed(F.col("common"), F.col("gone"), 1).alias("print"),
                            changed(F.col("common"), F.col("come"), 1).alias("edited_print"))
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("print")).alias("fingerprint"),
        as_hex(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"))
