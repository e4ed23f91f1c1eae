"""Near-duplicates of word shingles by tensored minhash banding, with every link confirmed on full sets.

Two collections of ``COLLECTION`` small hashes, each of ``ROWS`` minhashes, are made for every distinct set
of shingles.  A table key joins one hash of the first collection with one of the second, so
2 x 9 x 2 = 36 minhashes give 81 keys of 4 minhashes each.  A pair of similarity s is missed with
probability 1 - (1 - (1 - s^2)^9)^2: 0.00002 at 0.85 and 0.0002 at 0.8.

Texts with equal sets are one *class*, named by its smallest id, before anything else; only classes that
share a key with another one go on.  Within a key classes are compared with one member, its centre.
Pairs whose 36 minhashes agree so rarely that a link is out of question (probability below 0.000001) and pairs
whose sizes rule a link out are dropped; all others are compared on their full sets.  Classes that are found
to hang together are merged, the keys that still hold more than one group are compared with another
centre, and so on until two rounds in a row find no link.  So a group of n near copies costs about n
comparisons per round and no list of all its pairs.

Centres alone leave pairs out, so an exact pass follows over all classes of keys that still hold more than one
group, by prefixes of their full sets.  Shingles are ordered by the number of these classes that hold them.  Let
p shingles of a come before the first one, in this order, that a and b share.  A link needs
S x (|a| + |b|) / (100 + S) shared shingles, so p (100 + S) <= 100 |a| - S |b|, and the same holds for b.  So a class
sends only its rarest n (100 - S) / 100 + 1 shingles, and classes meet in those alone.  What a whole family
shares stands last in the order and brings nobody together.  Pairs of different groups that meet, in blocks of about
``BLOCK``, and that sizes, places and minhashes do not rule out, are compared on the full sets, unless they were before.
"""

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vectormart.llm.words import SMALL_STEP_BYTES, SPACE, binary, distinct, flat, lean, steps
from vectormart.session import work_folder, written

COLLECTION, ROWS = 9, 2
MINHASHES = 2 * COLLECTION * ROWS
QUIET_ROUNDS, UNLIKELY = 2, 1e-6
PAIRS_AT_ONCE = 64
BLOCK, PLACES = 64, 128
CELL = ["key", "p", "q"]
MISSING_ID = -(1 << 63)


def mixed(values):
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def shingle_sets(texts, width):
    """Distinct shingle hashes of all texts, one after another, and where each text's begin.

    A-Z are lowered and words split at ASCII white space.  A text of fewer words is one shingle; a
    text without words has none.
    """
    import xxhash

    data, offsets = flat(texts)
    data = data + np.where((data >= 0x41) & (data <= 0x5A), 32, 0).astype(np.uint8)
    space = SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    edges = offsets[(offsets < len(data))]
    begins[edges] = ~space[edges]
    starts = np.flatnonzero(begins)
    firsts = np.searchsorted(starts, offsets)
    # The space behind a word is cut off by hashing up to the end of its run of letters.
    stop = space.copy()
    stop_at = np.append(np.flatnonzero(stop), len(data))
    ends = np.minimum(stop_at[np.searchsorted(stop_at, starts)], offsets[np.searchsorted(offsets, starts, side="right")]) if len(starts) else starts
    marks = np.empty(2 * len(starts), np.int64)
    marks[0::2], marks[1::2] = starts, ends
    words = binary(data, marks).take(pa.array(np.arange(0, len(marks), 2)))
    vocabulary, codes = distinct(words)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary.to_pylist()], np.uint64)
    hashes = mixed(hashes)[codes] if len(codes) else np.zeros(0, np.uint64)
    counts = np.diff(firsts)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) - firsts[:-1][text] if len(hashes) else np.zeros(0, np.int64)
    whole = np.minimum(counts, width)[text]
    begins = np.flatnonzero((place + whole <= counts[text]) & ((counts[text] >= width) | (place == 0)))
    values = np.zeros(len(begins), np.uint64)
    for i in range(width):
        inside = i < whole[begins]
        at = np.minimum(begins + i, len(hashes) - 1) if len(hashes) else begins
        values = np.where(inside, mixed(values * np.uint64(0x9E3779B97F4A7C15) + hashes[at] + np.uint64(i + 1)), values) if len(begins) else values
    owner = text[begins]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def full_sets(texts, width):
    """The shingle set of every text of a list; a slice of the texts is cut at a time."""
    column, sets = pa.array(texts, pa.large_binary()), []
    for first, last in steps(column, SMALL_STEP_BYTES):
        values, places = shingle_sets(column.slice(first, last - first), width)
        sets += [values[i:j] for i, j in zip(places[:-1], places[1:])]
    return sets


def per_text(function, values, places, empty):
    """``function.reduceat`` over every text's values; texts without any get ``empty``."""
    out = np.full(len(places) - 1, empty, np.uint64)
    some = np.flatnonzero(np.diff(places))
    if len(some):
        out[some] = function.reduceat(values, places[:-1][some])
    return out


def signatures(docs, width, id="doc_id", text="text"):
    """(id, n, s1, s2, mins): set size, a 128-bit name of the set, the minhashes of both collections."""
    multipliers = mixed(np.arange(1, MINHASHES + 1, dtype=np.uint64)) | np.uint64(1)
    additions = mixed(multipliers)

    def run(batches):
        for batch in batches:
            for first, last in steps(batch.column("text"), SMALL_STEP_BYTES):
                part = batch.slice(first, last - first)
                values, places = shingle_sets(part.column("text"), width)
                mins = np.zeros((MINHASHES, len(part)), np.uint32)
                for i in range(MINHASHES):
                    least = per_text(np.minimum, values * multipliers[i] + additions[i], places, 0)
                    mins[i] = mixed(least) >> np.uint64(32)
                names = [per_text(np.add, mixed(values + np.uint64(salt)), places, 0).view(np.int64) for salt in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(places)), *map(pa.array, names), rows_of(mins.view(np.int32))],
                    names=["id", "n", "s1", "s2", "mins"])

    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(MISSING_ID)).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(run), "id long, n long, s1 long, s2 long, mins array<int>")


def rows_of(columns):
    """A list per text from one array of values per position."""
    height, width = columns.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(width + 1, dtype=np.int32) * height), pa.array(np.ascontiguousarray(columns.T).reshape(-1)))


def least_agreement(similarity):
    """The fewest equal minhashes at which a link of that similarity is not yet out of question."""
    share, total = similarity / 100, 0.0
    for equal in range(MINHASHES + 1):
        total += comb(MINHASHES, equal) * share ** equal * (1 - share) ** (MINHASHES - equal)
        if total > UNLIKELY:
            return equal
    return MINHASHES


def packed_texts(docs, members, id="doc_id", text="text"):
    """(rep, packed): the texts that name a class in ``members`` (rep), packed before they move, one per rep.

    A packed text is a fraction of its set of 64-bit shingle hashes, which do not compress.
    """

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor().compress
        for batch in batches:
            for first, last in steps(batch.column("text")):
                part = batch.slice(first, last - first)
                texts = [pack((t or "").encode("utf-8")) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(texts, pa.binary())], names=["rep", "packed"])

    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(MISSING_ID)).alias("rep"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(run), "rep long, packed binary").join(members, "rep", "left_semi").dropDuplicates(["rep"])


def bucketed(df, label, column):
    """``df`` in files by ``column``, so that joins on it leave it in place, and the name of its table, to be dropped by the caller."""
    spark = df.sparkSession
    path = work_folder(spark, label)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).saveAsTable(table)
    return spark.table(table), table


def confirmed(pairs, width, similarity):
    """(a, b): the pairs (rep, own, centre, other) of packed texts whose full sets are alike enough."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for first in range(0, len(batch), PAIRS_AT_ONCE):
                part = batch.slice(first, PAIRS_AT_ONCE).to_pydict()
                centres = dict(zip(part["centre"], part["other"]))
                place = {centre: len(part["own"]) + i for i, centre in enumerate(centres)}
                sets = full_sets([unpack(t) for t in [*part["own"], *centres.values()]], width)
                linked = []
                for i, centre in enumerate(part["centre"]):
                    own, other = sets[i], sets[place[centre]]
                    common = np.intersect1d(own, other, assume_unique=True).size
                    linked.append(100 * common >= similarity * (own.size + other.size - common))
                found = [(r, c) for r, c, yes in zip(part["rep"], part["centre"], linked) if yes]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return pairs.select("rep", "own", "centre", "other").mapInArrow(lean(run), "a long, b long")


def open_sets(buckets, texts, width):
    """(rep, group, shingles) of every class that a key with several groups holds.

    Two classes of a key have been compared in the first round, so only keys of three or more are open here.
    """

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for first in range(0, len(batch), PAIRS_AT_ONCE):
                part = batch.slice(first, PAIRS_AT_ONCE)
                found = full_sets([unpack(t) for t in part.column("packed").to_pylist()], width)
                places = np.append(0, np.cumsum([len(x) for x in found]))
                sets = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("group"), sets], names=["rep", "group", "shingles"])

    keys = buckets.groupBy("key").agg(F.count("*").alias("m"), F.min("group").alias("low"), F.max("group").alias("high"))
    classes = buckets.join(keys.filter("m > 2 and low != high"), "key", "left_semi").select("rep", "group").distinct()
    return classes.join(texts, "rep").select("rep", "group", "packed").mapInArrow(lean(run), "rep long, group long, shingles array<long>")


def prefixes(sets, similarity):
    """(key, rep, group, n, place): the rarest shingles of every class, as many as a link leaves unshared and one more.

    ``place`` is the number of rarer shingles of the class.  Shingles of a single class count as places but are not given.
    """
    each = sets.select("rep", F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")
    common = each.join(often, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("common"))
    ranked = sets.select("rep", "group", F.size("shingles").cast("long").alias("n")).join(common, "rep")
    alone = (F.col("n") - F.size("common")).cast("int")
    wanted = F.floor(F.col("n") * (100 - similarity) / 100).cast("int") + 1 - alone
    first = F.slice("common", F.lit(1), F.greatest(wanted, F.lit(0)))
    given = ranked.select("rep", "group", "n", alone.alias("alone"), F.posexplode(first).alias("at", "held"))
    return given.select(F.col("held.key").alias("key"), "rep", "group", "n", (F.col("alone") + F.col("at")).cast("long").alias("place"))


def in_cells(given, sketches, similarity):
    """(key, p, q, classes): the classes that meet in a shingle of their prefixes, by twos of blocks; block p meets block q."""
    # The smallest set at a shingle tells which places are too late for any link there.
    least = given.groupBy("key").agg(F.min("n").alias("least"), F.min("group").alias("low"), F.max("group").alias("high"))
    met = given.join(least.filter("low != high").select("key", "least"), "key")
    met = met.filter(F.col("place") * (100 + similarity) <= 100 * F.col("n") - similarity * F.col("least")).drop("least")
    met = written(met, "met")
    counts = met.groupBy("key").agg(F.count("*").alias("m"), F.min("group").alias("low"), F.max("group").alias("high"))
    counts = counts.filter("low != high").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = met.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(BLOCK)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "rep", "group", "n", "own", "place")
    return rows.join(sketches.select("rep", "mins"), "rep").groupBy(*CELL).agg(
        F.collect_list(F.struct("rep", "group", "n", "own", "place", "mins")).alias("classes"))


def fitting(cells, similarity):
    """(key, p, q, x, y): pairs that are of different groups and whose sizes, places and minhashes allow a link, each once."""
    least = least_agreement(similarity)

    def run(batches):
        for batch in batches:
            lists = batch.column("classes")
            offsets = lists.offsets.to_numpy()
            rep, group, n, own, place, mins = lists.values.flatten()
            rep, group, n, own, place = (x.to_numpy() for x in (rep, group, n, own, place))
            mins = mins.flatten().to_numpy().reshape(-1, MINHASHES)
            late = place * (100 + similarity) - 100 * n
            found = []
            for i, (key, p, q) in enumerate(zip(*[batch.column(c).to_pylist() for c in CELL])):
                here = slice(offsets[i], offsets[i + 1])
                one, two = np.flatnonzero(own[here] == p) + offsets[i], np.flatnonzero(own[here] == q) + offsets[i]
                fits = (group[one][:, None] != group[two])
                fits &= (late[one][:, None] <= -similarity * n[two]) & (late[two] <= -similarity * n[one][:, None])
                if p == q:
                    fits &= one[:, None] < two
                a, b = np.nonzero(fits)
                a, b = one[a], two[b]
                good = (mins[a] == mins[b]).sum(axis=1) >= least
                a, b = rep[a[good]], rep[b[good]]
                found.append((np.full(len(a), key), np.full(len(a), p), np.full(len(a), q), np.minimum(a, b), np.maximum(a, b)))
            kinds = (np.int64, np.int32, np.int32, np.int64, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(kind)) if found else pa.array([], pa.from_numpy_dtype(kind)) for x, kind in zip(zip(*found) if found else kinds, kinds)], names=[*CELL, "x", "y"])

    pairs = cells.mapInArrow(lean(run), "key long, p int, q int, x long, y long")
    # A pair that meets in several shingles is compared at one of them.
    return pairs.groupBy("x", "y").agg(F.min(F.struct(*CELL)).alias("cell")).select("cell.*", "x", "y")


def confirmed_in_cells(pairs, texts, width, similarity):
    """(a, b): the pairs (key, p, q, x, y) whose full sets are alike enough.  A text goes once to a cell, however many pairs it has there."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            found = []
            for i in range(len(batch)):
                cell = batch.slice(i, 1).to_pydict()
                place = {t["rep"]: k for k, t in enumerate(cell["texts"][0])}
                sets = full_sets([unpack(t["packed"]) for t in cell["texts"][0]], width)
                for pair in cell["pairs"][0]:
                    x, y = sets[place[pair["x"]]], sets[place[pair["y"]]]
                    common = np.intersect1d(x, y, assume_unique=True).size
                    if 100 * common >= similarity * (x.size + y.size - common):
                        found.append((pair["x"], pair["y"]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    held = pairs.select(*CELL, F.explode(F.array("x", "y")).alias("rep")).distinct().join(texts, "rep")
    held = held.groupBy(*CELL).agg(F.collect_list(F.struct("rep", "packed")).alias("texts"))
    asked = pairs.groupBy(*CELL).agg(F.collect_list(F.struct("x", "y")).alias("pairs"))
    return held.join(asked, CELL).select("texts", "pairs").mapInArrow(lean(run), "a long, b long")


def merged(groups, links):
    """(rep, group) after joining groups that a link (a, b) connects, and (group, name) of those that took part.

    A group is named by its smallest rep.
    """
    edges = links.join(groups.withColumnsRenamed({"rep": "a", "group": "x"}), "a").join(
        groups.withColumnsRenamed({"rep": "b", "group": "y"}), "b").filter("x != y")
    edges = edges.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e"))
    edges = written(edges.select("e.x", "e.y").distinct(), "edges")
    # Only groups that have an edge take part; every step hands the smallest name on and shortens the way to it.
    names = edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("name"))
    names = written(names, "names")
    # A name only ever falls, so the steps end; shortened ways keep them few.
    while True:
        near = edges.join(names.withColumnsRenamed({"x": "y", "name": "other"}), "y").groupBy("x").agg(F.min("other").alias("other"))
        lower = names.join(near, "x").select("x", F.least("name", "other").alias("new"), F.col("name").alias("old"))
        further = names.select(F.col("x").alias("new"), F.col("name").alias("beyond"))
        lower = written(lower.join(further, "new", "left").select(
            "x", F.coalesce(F.least("new", "beyond"), "new").alias("name"), "old"), "names")
        still = lower.filter("name != old").limit(1).count()
        names = lower.select("x", "name")
        if not still:
            break
    names = names.withColumnsRenamed({"x": "group"})
    renamed = groups.join(names, "group", "left")
    return written(renamed.select("rep", F.coalesce("name", "group").alias("group")), "groups"), names


def table_keys(named):
    """(rep, key): the keys of every class.

    A class makes 81 rows, which are counted where they are made, so classes are dealt into many tasks first: a few
    files of classes would be a few tasks with tables of millions of keys each.
    """
    small = [[F.col("mins")[i * ROWS + r] for r in range(ROWS)] for i in range(2 * COLLECTION)]
    # The last bits of a key name its place among the keys of a class.
    keys = F.array(*[
        F.xxhash64(F.lit(i * COLLECTION + j), *small[i], *small[COLLECTION + j]).bitwiseAND(F.lit(-PLACES)).bitwiseOR(F.lit(i * COLLECTION + j))
        for i in range(COLLECTION) for j in range(COLLECTION)])
    dealt = named.select("rep", "mins").repartition(int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rep")
    return dealt.select("rep", F.explode(keys).alias("key"))


def near_groups(docs, width, similarity, id="doc_id", text="text"):
    """(id, n_shingles, component_id) per row of ``docs``; ``similarity`` is a whole percentage.

    Two rows are linked if 100 x common shingles >= similarity x all shingles.  Rows without words (null,
    empty, white space) are linked with nothing and are their own component.  Rows that repeat an id are
    one document to the links; rows without an id share a component name, null, if linked or wordless.
    """
    spark = docs.sparkSession
    marks = written(signatures(docs, width, id, text), "signatures")
    classes = marks.filter("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("mins").alias("mins"))
    named = written(classes, "classes")
    keyed = table_keys(named)
    # Partial aggregation thins a key that many classes share; AQE may split its rows in the join.
    shared = keyed.groupBy("key").agg(F.count("*").alias("classes")).filter("classes > 1").select("key")
    buckets = written(keyed.join(shared, "key").withColumn("group", F.col("rep")), "buckets")
    members = written(buckets.select("rep").distinct(), "members")
    # A member's row may be repeated where an id is; the first one speaks for it.
    sketches = written(named.join(members, "rep", "left_semi").select("rep", "n", "mins").dropDuplicates(["rep"]), "sketches")
    texts, table = bucketed(packed_texts(docs, members, id, text), "texts", "rep")
    groups = written(members.withColumn("group", F.col("rep")), "groups")

    turn, quiet, settled = 0, 0, None
    while quiet < QUIET_ROUNDS:
        side, opposite = (F.min, F.max) if turn % 2 == 0 else (F.max, F.min)
        pick = F.struct("group", F.xxhash64("rep", F.lit(turn)).alias("draw"), "rep")
        centres = buckets.groupBy("key").agg(side(pick).alias("pick"), opposite("group").alias("far"))
        centres = centres.filter("pick.group != far").select("key", F.col("pick.rep").alias("centre"), F.col("pick.group").alias("central"))
        # Keys whose classes hang together already are done for good.
        open_ = written(buckets.join(centres, "key").select("key", "rep", "group", "centre", "central"), "open")
        pairs = open_.filter("group != central").select("rep", "centre").distinct()
        close = pairs.join(sketches, "rep").join(sketches.withColumnsRenamed({"rep": "centre", "n": "m", "mins": "others"}), "centre")
        agree = F.size(F.filter(F.zip_with("mins", "others", lambda x, y: x == y), lambda same: same))
        fits = (100 * F.least("n", "m") >= similarity * F.greatest("n", "m")) & (agree >= least_agreement(similarity))
        ordered = [F.least("rep", "centre").alias("x"), F.greatest("rep", "centre").alias("y")]
        pairs = close.filter(fits).select("rep", "centre", *ordered)
        # A pair that was compared in an earlier round keeps its answer.
        pairs = written(pairs if settled is None else pairs.join(settled, ["x", "y"], "left_anti"), "pairs")
        now_settled = pairs.select("x", "y")
        settled = now_settled if settled is None else written(settled.unionAll(now_settled), "settled")
        # The table of texts lies in buckets and stays there; pairs come to it, and centres, which may have many pairs, are taken out.
        one = pairs.drop("x", "y").join(texts, "rep").withColumnRenamed("packed", "own")
        centred = written(pairs.select(F.col("centre").alias("rep")).distinct().join(texts, "rep"), "centres")
        two = one.join(centred.withColumnsRenamed({"rep": "centre", "packed": "other"}), "centre")
        links = written(confirmed(two, width, similarity), "links")
        buckets = open_.select("key", "rep", "group")
        if links.head(1):
            groups, names = merged(groups, links)
            # Only rows of renamed groups change; a round without links leaves the table as it is.
            buckets = written(buckets.join(names, "group", "left").select("key", "rep", F.coalesce("name", "group").alias("group")), "buckets")
            quiet = 0
        elif not open_.head(1):
            break
        else:
            quiet += 1
        turn += 1

    given = written(prefixes(written(open_sets(buckets, texts, width), "sets"), similarity), "prefixes")
    rest = fitting(in_cells(given, sketches, similarity), similarity)
    rest = written(rest if settled is None else rest.join(settled, ["x", "y"], "left_anti"), "rest")
    links = written(confirmed_in_cells(rest, texts, width, similarity), "links")
    if links.head(1):
        groups, _ = merged(groups, links)

    spark.sql(f"DROP TABLE {table}")
    component = groups.select("rep", "group")
    by_class = named.select("s1", "s2", "rep").join(component, "rep", "left").select(
        "s1", "s2", F.coalesce("group", "rep").alias("component"))
    out = marks.select("id", "n", "s1", "s2").join(by_class, ["s1", "s2"], "left")
    real = lambda c: F.when(c != MISSING_ID, c)
    return out.select(real(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                      real(F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))).alias("component_id"))


def near_duplicates(docs):
    """The registered query: three-word shingles, 85 per cent; kept is the row whose id names the component."""
    found = near_groups(docs, 3, 85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs, width=5, similarity=80):
    """The rows of ``docs`` that name their component, with the columns they had; of rows that repeat an id one stays."""
    found = near_groups(docs, width, similarity).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.select(F.col("doc_id").alias("kept_id")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stay = packed.join(kept, F.col("row.doc_id").cast("long").eqNullSafe(F.col("kept_id")), "left_semi")
    return stay.select("row.*")
