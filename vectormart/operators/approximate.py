"""Approximate nearest neighbours: an inverted file of quantised vectors, re-ranked on whole ones.

A one-off job gives every row to the nearest of some centres and writes inverted lists: rows of at most ``LIST_ROWS``
ids of one cell with one byte for each few dimensions, the number of the nearest code word of the difference from the
centre.  Beside these short codes stand fine ones, a byte for each dimension of what the code words leave, and how far
either kind is off.  A large cell is simply many such rows.

A search looks up the nearest centres of every query by itself, brings queries and lists together by a join on the cell,
adds up code words to approximate scores, keeps a short list per query, and scores that exactly on the stored vectors.  The
k-th score of the short list is a floor: all other rows of visited cells that the errors of their codes let reach it are
scored exactly as well.  So only neighbours in cells that a query does not visit are missed; ``recall`` measures that.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from vectormart.functions.vectors import norm, score, valid_vector
from vectormart.operators.knn import blocks_of, exact_knn, rank_hits
from vectormart.session import measured, written

LIST_ROWS = 4096
CENTRE_BYTES = 64 << 20
# Code words are fitted to a bounded sample, the first rows by a hash of their ids.
TRAINED_ON = 32_768
WORDS = 256
NO_DIRECTION = -1
QUERIES_AT_ONCE = 256
LISTED = {"length": "lengths", "code": "codes", "fine": "fines", "step": "steps", "far": "fars", "close": "closes"}


def build_cells(corpus, folder, dim, cells=None, id_col="id", vector_col="vector", iterations=5, seed=0, centres=None,
                parts=None):
    """Store a corpus for approximate search: ``points``, ``lists``, ``centres`` and ``words`` below ``folder``.

    ``centres`` (cell, centre) may be given; else ``cells`` of them are found by k-means.  ``parts`` is the number of
    bytes of a code, by default one for four dimensions.  Rows without a direction go to cell -1, which every search visits, and
    rows without a whole vector are stored but not listed.
    """
    spark = corpus.sparkSession
    if centres is None and not (cells and cells >= 1):
        raise ValueError("give centres, or how many cells to find")
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = corpus.withColumn("_length", F.when(valid_vector(vector, dim), norm(vector)))
    unit = F.transform(vector, lambda x: x / F.nullif(F.col("_length"), F.lit(0.0)))
    directed = rows.filter("_length > 0").withColumn("_unit", unit)
    if centres is None:
        model = KMeans(k=cells, featuresCol="_vector", maxIter=iterations, seed=seed).fit(directed.select(array_to_vector("_unit").alias("_vector")))
        centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    centres = centres.select(F.col("cell").cast("int").alias("cell"), F.col("centre").cast("array<double>").alias("centre"))
    centres.write.mode("overwrite").parquet(folder + "/centres")
    centres = spark.read.parquet(folder + "/centres")

    placed = written(_nearest_cells(directed.select(F.col(f"`{id_col}`").alias("id"), F.col("_unit").alias("unit"), F.col("_length").alias("length")),
                                    centres, dim), "placed")
    words = _code_words(placed, dim, parts or max(1, dim // 4), iterations, seed)
    spark.createDataFrame([(i, w.ravel().tolist()) for i, w in enumerate(words)], "part int, words array<double>").write.mode("overwrite").parquet(folder + "/words")
    idle = rows.filter("_length = 0").select(F.col(f"`{id_col}`").alias("id"), F.lit(0.0).alias("length"), F.lit(NO_DIRECTION).alias("cell"),
                                             F.lit(bytes(len(words))).alias("code"), F.lit(bytes(dim)).alias("fine"),
                                             *[F.lit(0.0).alias(c) for c in ("step", "far", "close")])
    coded = _coded(placed, words).unionByName(idle)
    # Rows of a cell come in lists of bounded length: salts spread a large cell over many lists and tasks.
    counts = written(coded.groupBy("cell").agg(F.count("*").alias("n")), "counts")
    salted = coded.join(counts, "cell").withColumn("list", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") * 2 / LIST_ROWS)).cast("int"))
    lists = salted.groupBy("cell", "list").agg(F.collect_list(F.struct("id", *LISTED)).alias("row"))
    lists.select("cell", F.col("row.id").alias("ids"), *[F.col(f"row.{c}").alias(LISTED[c]) for c in LISTED]).write.mode(
        "overwrite").parquet(folder + "/lists")
    rows.drop("_length").write.mode("overwrite").parquet(folder + "/points")


def _nearest_cells(rows, centres, dim):
    """Rows (id, unit, length) with the cell of the greatest cosine, the smallest of equals, and what is left of the vector.

    Centres are handed out in tables of bounded size; each pass keeps the best so far, and no row is shuffled.
    """
    kind = rows.schema["id"].dataType.simpleString()
    columns = f"id {kind}, unit array<double>, length double, cell int, rest array<double>, place double"
    rows = rows.select("id", "unit", "length", F.lit(NO_DIRECTION).alias("cell"), F.col("unit").alias("rest"), F.lit(float("-inf")).alias("place"))
    for block in blocks_of(centres.orderBy("cell"), max(1, CENTRE_BYTES // (8 * dim))):
        m = np.array(block.column("centre").to_pylist(), float).reshape(-1, dim)
        lengths = np.sqrt((m * m).sum(axis=1))
        m = m / np.where(lengths == 0, 1.0, lengths)[:, None]
        order = np.argsort(block.column("cell").to_numpy(), kind="stable")
        shared = rows.sparkSession.sparkContext.broadcast((block.column("cell").to_numpy()[order], m[order]))
        rows = rows.mapInArrow(_placing(shared, dim), columns)
    return rows.drop("place", "unit")


def _placing(shared, dim):
    def run(batches):
        cells, m = shared.value
        for batch in batches:
            unit = batch.column("unit").flatten().to_numpy().reshape(-1, dim)
            cell, place = batch.column("cell").to_numpy().copy(), batch.column("place").to_numpy().copy()
            rest = batch.column("rest").flatten().to_numpy().reshape(-1, dim).copy()
            step = max(1, (8 << 20) // max(1, len(cells)))
            for at in range(0, len(unit), step):
                here = slice(at, at + step)
                scores = np.round(unit[here] @ m.T, 9)
                best = scores.argmax(axis=1)
                top = scores[np.arange(len(best)), best]
                better = np.flatnonzero(top > place[here]) + at
                cell[better], place[better] = cells[best[better - at]], top[better - at]
                rest[better] = unit[better] - m[best[better - at]]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(rest.ravel()), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("unit"), batch.column("length"), pa.array(cell), lists, pa.array(place)],
                names=["id", "unit", "length", "cell", "rest", "place"])

    return run


def _bounds_of(dim, parts):
    return np.linspace(0, dim, parts + 1).round().astype(int)


def _code_words(placed, dim, parts, iterations, seed):
    """Code words of every part of the vectors, by k-means on a bounded sample; at most ``WORDS`` each."""
    sample = placed.orderBy(F.xxhash64("id"), "id").select("rest").limit(TRAINED_ON).toArrow().column("rest").combine_chunks()
    rows = sample.flatten().to_numpy().reshape(-1, dim) if len(sample) else np.zeros((1, dim))
    rng = np.random.default_rng(seed)
    bounds, out = _bounds_of(dim, parts), []
    for low, high in zip(bounds[:-1], bounds[1:]):
        part = np.unique(rows[:, low:high], axis=0)
        words = part[rng.permutation(len(part))[:WORDS]]
        for _ in range(iterations if len(part) > WORDS else 0):
            own = _nearest_words(part, words)
            sums = np.zeros_like(words)
            np.add.at(sums, own, part)
            counts = np.bincount(own, minlength=len(words))
            words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
        out.append(words)
    return out


def _nearest_words(part, words):
    return ((words * words).sum(axis=1)[None, :] - 2 * part @ words.T).argmin(axis=1)


def _coded(placed, words):
    """(id, length, cell, code, fine, step, far, close) of placed rows.

    ``fine`` are whole multiples of ``step`` for what the code words leave, of length ``far``; ``close`` is what both leave.
    """
    kind = placed.schema["id"].dataType.simpleString()
    shared = placed.sparkSession.sparkContext.broadcast(words)

    def bytes_of(codes):
        return pa.Array.from_buffers(pa.binary(), len(codes), [
            None, pa.py_buffer(np.arange(0, codes.size + 1, codes.shape[1]).astype(np.int32)), pa.py_buffer(codes.tobytes())])

    def run(batches):
        words = shared.value
        edges = np.cumsum([0, *[w.shape[1] for w in words]])
        for batch in batches:
            rest = batch.column("rest").flatten().to_numpy().reshape(-1, edges[-1])
            codes = np.stack([_nearest_words(rest[:, a:b], w) for w, a, b in zip(words, edges[:-1], edges[1:])], axis=1).astype(np.uint8)
            left = rest - np.concatenate([w[c] for w, c in zip(words, codes.T)], axis=1)
            step = np.abs(left).max(axis=1) / 127
            fine = np.rint(left / np.where(step == 0, 1.0, step)[:, None]).astype(np.int8)
            far, close = (np.sqrt((m * m).sum(axis=1)) for m in (left, left - fine * step[:, None]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("length"), batch.column("cell"), bytes_of(codes), bytes_of(fine), pa.array(step), pa.array(far), pa.array(close)],
                names=["id", "length", "cell", "code", "fine", "step", "far", "close"])

    return placed.mapInArrow(run, f"id {kind}, length double, cell int, code binary, fine binary, step double, far double, close double")


def approx_knn(spark, folder, queries, k, dim, probes=8, id_col="id", vector_col="vector", query_id="query_id",
               query_vector="vector", metric="cosine", shortlist=20):
    """(query_id, id, score, rank): the k best rows of each query among its ``probes`` nearest cells.

    ``shortlist x k`` rows of a query are scored exactly first, those of the best approximate scores, and then all rows
    that may still reach the k-th of their scores.
    """
    centres, lists = spark.read.parquet(folder + "/centres"), spark.read.parquet(folder + "/lists")
    asked = queries.select(F.col(f"`{query_id}`").alias("query_id"), F.col(f"`{query_vector}`").cast("array<double>").alias("vector"))
    asked = asked.filter(valid_vector(F.col("vector"), dim))
    near = exact_knn(centres, asked, probes, dim, id_col="cell", vector_col="centre").select("query_id", F.col("id").alias("cell"), F.col("score").alias("base"))
    everywhere = asked.select("query_id", F.lit(NO_DIRECTION).alias("cell"), F.lit(0.0).alias("base")).distinct()
    visits = near.unionByName(everywhere).join(asked, "query_id")
    # Queries of one cell come in groups of bounded size: a popular cell has many groups.
    groups = -(-asked.count() // QUERIES_AT_ONCE) or 1
    query_kind = queries.schema[query_id].dataType.simpleString()

    def met(visits, *asked):
        salted = visits.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
        grouped = salted.groupBy("cell", "salt").agg(F.collect_list(F.struct("query_id", "base", "vector", *asked)).alias("asked"))
        return measured(grouped.drop("salt")).join(lists, "cell")

    points = spark.read.parquet(folder + "/points").select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("stored"))

    def scored(pairs):
        return pairs.join(points, "id").join(asked, "query_id").select("query_id", "id", score(F.col("vector"), F.col("stored"), metric).alias("score"))

    found = _approximate_hits(met(visits), folder, dim, metric, shortlist * k, query_kind)
    best = measured(rank_hits(found, shortlist * k, [F.desc("score"), F.asc("id")]).select("query_id", "id"))
    first = measured(scored(best))
    # A query with fewer than k scores has no floor, and all its rows are in the short list.
    floors = measured(rank_hits(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor")))
    reach = _rows_in_reach(met(visits.join(floors, "query_id"), "floor"), folder, dim, metric, k, query_kind)
    more = measured(reach.join(best, ["query_id", "id"], "left_anti"))
    return rank_hits(first.unionByName(scored(more)), k)


def _words_of(spark, folder, dim):
    """The broadcast code words of an index, one matrix for each part."""
    rows = spark.read.parquet(folder + "/words").orderBy("part").collect()
    widths = np.diff(_bounds_of(dim, len(rows)))
    return spark.sparkContext.broadcast([np.array(r["words"], float).reshape(-1, w) for r, w in zip(rows, widths)])


def _coarse(batch, i, words):
    """(query ids, unit queries, their lengths, other columns asked), ids and cosines by code words of one list and those who ask."""
    edges = np.cumsum([0, *[w.shape[1] for w in words]])
    asked, ids = batch.column("asked")[i].values, batch.column("ids")[i].values
    q_ids, base, vectors, *others = asked.flatten()
    codes = np.frombuffer(b"".join(batch.column("codes")[i].as_py()), np.uint8).reshape(len(ids), -1)
    q = vectors.flatten().to_numpy().reshape(len(q_ids), -1)
    norms = np.sqrt((q * q).sum(axis=1))
    q = q / np.where(norms == 0, 1.0, norms)[:, None]
    scores = np.repeat(base.to_numpy()[:, None], len(ids), axis=1)
    if batch.column("cell")[i].as_py() != NO_DIRECTION:
        for part, (w, a, b) in enumerate(zip(words, edges[:-1], edges[1:])):
            scores += (q[:, a:b] @ w.T)[:, codes[:, part]]
    return (q_ids, q, norms, others), ids, scores


def _approximate_hits(met, folder, dim, metric, keep, query_kind):
    """The best ``keep`` approximate scores of every query in every list it meets."""
    shared = _words_of(met.sparkSession, folder, dim)
    id_kind = met.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                (q_ids, _, norms, _), ids, scores = _coarse(batch, i, shared.value)
                if metric != "cosine":
                    scores *= norms[:, None] * batch.column("lengths")[i].values.to_numpy()[None, :]
                n = min(keep, len(ids))
                # Equal scores at the edge of a list are all kept, so that the smallest ids come first later.
                edge = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
                r, c = np.nonzero(scores >= edge[:, None])
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(r)), ids.take(pa.array(c)), pa.array(scores[r, c])], names=["query_id", "id", "score"])

    return met.select("cell", "asked", "ids", "lengths", "codes").mapInArrow(run, f"query_id {query_kind}, id {id_kind}, score double")


def _rows_in_reach(met, folder, dim, metric, k, query_kind):
    """(query_id, id) of all rows whose score may reach the floor of the query and the k-th of their own list.

    What a code leaves adds at most its length to a cosine.  Fine codes are only read up where the short ones do not decide.
    """
    shared = _words_of(met.sparkSession, folder, dim)
    id_kind = met.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                (q_ids, q, norms, (floors,)), ids, scores = _coarse(batch, i, shared.value)
                lengths, steps, fars, closes = (batch.column(c)[i].values.to_numpy() for c in ("lengths", "steps", "fars", "closes"))
                size = np.ones_like(scores) if metric == "cosine" else norms[:, None] * lengths[None, :]
                # Rounded ranks and the order of sums take part of the room.
                floor = floors.to_numpy()[:, None] - 1e-8
                room = 1e-7 * size
                rows = np.flatnonzero(((scores + fars) * size + room >= floor).any(axis=0))
                if not len(rows):
                    continue
                fines = np.frombuffer(b"".join(batch.column("fines")[i].as_py()), np.int8).reshape(len(ids), -1)
                size, room = size[:, rows], room[:, rows]
                scores = scores[:, rows] + q @ (fines[rows] * steps[rows, None]).T
                if len(rows) > k:
                    least = (scores - closes[rows]) * size - room
                    floor = np.maximum(floor, -np.partition(-least, k - 1, axis=1)[:, k - 1:k] - 1e-8)
                r, c = np.nonzero((scores + closes[rows]) * size + room >= floor)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(r)), ids.take(pa.array(rows[c]))], names=["query_id", "id"])

    columns = ["cell", "asked", "ids", "lengths", "codes", "fines", "steps", "fars", "closes"]
    return met.select(columns).mapInArrow(run, f"query_id {query_kind}, id {id_kind}")


def recall(found, exact):
    """Share of the exact hits that the approximate search found, per query."""
    kept = exact.select("query_id", "id").join(
        found.select("query_id", "id").withColumn("found", F.lit(1)), ["query_id", "id"], "left")
    return kept.groupBy("query_id").agg(F.avg(F.coalesce("found", F.lit(0))).alias("recall"))
