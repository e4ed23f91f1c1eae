"""Exact nearest neighbours of many queries at once.

Queries are taken in blocks of bounded size.  A block is broadcast, the corpus streams past it in Arrow batches where it
lies, and each task keeps its best ``k`` per query; the corpus is never shuffled and no pair table exists.  Where
tasks would hand on too many hits together, a block goes over growing shares of the corpus, told apart by a hash of the id:
the k-th score found so far is a lower bound for every query, and tasks of the next share hand on only what reaches
it.  So a shuffle holds about ``GROWTH x k`` hits a query, however many tasks there are.  Hits of a block are
merged and written before the next one starts, and its broadcast is released.

Scores that agree to nine decimals count as equal and are ordered by id.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectormart.session import measured, work_folder, written

RANK_DECIMALS = 9
# Bytes of a query block, hits that may be shuffled at once, and growth of the shares of the corpus beyond that.
MAX_QUERY_BYTES = 64 << 20
MOST_HITS = 20_000_000
GROWTH = 64


def _block_search(k, dim, metric, out_names, decimals=RANK_DECIMALS):
    """Build the search kernel as plain closures, so executors need no package."""

    def unit(m):
        if metric != "cosine":
            return m
        length = np.sqrt((m * m).sum(axis=1))
        # A vector without length has no direction and scores zero with everything.
        length[length == 0] = 1.0
        return m / length[:, None]

    def matrix(column):
        """Rows of a list column that are whole finite vectors, and their matrix."""
        import pyarrow.compute as pc

        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        good = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(good)
        flat = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False)
        m = np.asarray(flat, dtype=np.float64).reshape(-1, dim)
        finite = np.isfinite(m).all(axis=1)
        if not finite.all():
            rows, m = rows[finite], m[finite]
        return rows, unit(m)

    def codes(values, known):
        import pyarrow.compute as pc

        found = pc.fill_null(pc.index_in(values, value_set=known.cast(values.type)), -1)
        return np.asarray(found.to_numpy(zero_copy_only=False))

    def best(table):
        """Keep the first k rows of each query by rounded score, then id."""
        table = table.sort_by([("q", "ascending"), ("place", "descending"), ("id", "ascending")])
        q = table.column("q").to_numpy()
        nth = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        return table.filter(pa.array(nth < k))

    def search(batches, q_ids, q_vectors, q_groups, skip_self, bound):
        """Yield the best k rows per query of all batches as (query, id, score, place); places below the bound do not count."""
        n_queries = len(q_ids)
        floor = bound.copy()
        kept = None
        groups = None if q_groups is None else q_groups.unique().drop_null()
        group_code = None if q_groups is None else codes(q_groups, groups)
        for ids, vectors, album in batches:
            rows, m = matrix(vectors)
            if not len(rows):
                continue
            ids = ids.take(pa.array(rows))
            # Rows are taken in steps that bound the score matrix.
            step = max(1, (8 << 20) // max(1, n_queries))
            row_group = None if groups is None else codes(album.take(pa.array(rows)), groups)
            for at in range(0, len(rows), step):
                part_ids = ids.slice(at, step)
                exact = m[at:at + step] @ q_vectors.T
                scores = np.round(exact, decimals)
                if skip_self:
                    own = codes(part_ids, q_ids)
                    mine = np.flatnonzero(own >= 0)
                    scores[mine, own[mine]] = -np.inf
                if groups is not None:
                    c = row_group[at:at + step]
                    scores[(c[:, None] == group_code[None, :]) & (c[:, None] >= 0)] = -np.inf
                if len(scores) > k:
                    floor = np.maximum(floor, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
                r, q = np.nonzero((scores >= floor[None, :]) & (scores > -np.inf))
                if not len(r):
                    continue
                found = pa.table({"q": pa.array(q.astype(np.int64)), "place": pa.array(scores[r, q]),
                                  "score": pa.array(exact[r, q]), "id": part_ids.take(pa.array(r))})
                kept = best(found if kept is None else pa.concat_tables([kept, found]))
                counts = np.bincount(kept.column("q").to_numpy(), minlength=n_queries)
                full = np.flatnonzero(counts >= k)
                last = np.cumsum(counts) - 1
                floor[full] = np.maximum(floor[full], kept.column("place").to_numpy()[last[full]])
        if kept is not None:
            kept = kept.combine_chunks()
            owner = q_ids.take(kept.column("q").combine_chunks())
            columns = [owner, kept.column("id"), kept.column("score"), kept.column("place")]
            yield from pa.table(columns, names=out_names).to_batches()

    return matrix, search


def exact_knn(corpus, queries, k, dim, *, id_col="id", vector_col="vector", query_id="query_id",
              query_vector="vector", metric="cosine", exclude_self=False, exclude_group=None,
              max_query_bytes=MAX_QUERY_BYTES, most_hits=MOST_HITS):
    """The k best corpus rows of every query: (query_id, id, score, rank).

    ``exclude_self`` skips the row whose id equals the query's id.  ``exclude_group``
    names a column of both tables; rows that share the query's value are skipped, and
    a query without a value skips nothing.  Vectors of another length or with a
    missing or infinite element take no part.  The search runs at once; its hits are written.
    """
    if k <= 0:
        return _empty_hits(corpus, queries, id_col, query_id)
    wanted = [F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector")]
    stored = [F.col(id_col).alias("id"), F.col(vector_col).alias("vector")]
    if exclude_group:
        wanted.append(F.col(exclude_group).alias("grp"))
        stored.append(F.col(exclude_group).alias("grp"))
    queries, corpus = queries.select(*wanted), corpus.select(*stored)
    hit_type = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("id", corpus.schema["id"].dataType),
        T.StructField("score", T.DoubleType()),
        T.StructField("place", T.DoubleType()),
    ])
    shares = None
    found = []
    for block in blocks_of(queries, max(1, max_query_bytes // (8 * dim))):
        shares = shares or corpus_shares(corpus, block.num_rows, k, dim, most_hits)
        found.append(_search_block(corpus, block, k, dim, metric, exclude_self, hit_type, shares))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionAll(more)
    # Queries of one id may stand in several blocks; they are one query.
    return hits.drop("place") if len(found) == 1 else best_places(hits, k).drop("place")


def best_places(hits, k):
    return rank_hits(hits, k, [F.desc("place"), F.asc("id")])


def blocks_of(df, rows):
    """Arrow tables of at most ``rows`` rows each; only one of them is on the driver at a time."""
    first = df.limit(rows + 1).toArrow()
    if first.num_rows <= rows:
        yield first
        return
    path = work_folder(df.sparkSession, "blocks")
    df.repartition(-(-df.count() // rows)).write.option("maxRecordsPerFile", rows).parquet(path)
    for file in df.sparkSession.read.schema(df.schema).parquet(path).inputFiles():
        yield df.sparkSession.read.schema(df.schema).parquet(file).toArrow()


def corpus_shares(corpus, n_queries, k, dim, most_hits):
    """Ends of growing shares of the corpus, in parts of 2^30; the last is the whole.

    One share is enough as long as all tasks together may hand on few enough hits.  Tasks and rows are guessed from the
    planned bytes; a wrong guess costs time only.
    """
    whole = 1 << 30
    size = int(str(corpus._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = 1 + size // (128 << 20)
    if tasks * n_queries * k <= most_hits:
        return [whole]
    shares = [whole]
    while shares[0] > 1 and shares[0] / whole * size / (4 * dim) > GROWTH * k:
        shares.insert(0, max(1, shares[0] // GROWTH))
    return shares


def _search_block(corpus, block, k, dim, metric, exclude_self, hit_type, shares):
    """The written best k hits of one block of queries, found share by share."""
    matrix, search = _block_search(k, dim, metric, hit_type.names)
    rows, q_matrix = matrix(block.column("vector"))
    taken = block.take(pa.array(rows))
    q_ids = taken.column("query_id").combine_chunks() if len(rows) else block.column("query_id").slice(0, 0).combine_chunks()
    groups = taken.column("grp").combine_chunks() if "grp" in block.column_names else None
    context = corpus.sparkSession.sparkContext
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    best, bound, last = None, np.full(len(rows), -np.inf), 0
    for share in shares:
        shared = context.broadcast((q_ids, q_matrix, groups, bound))
        part = corpus if len(shares) == 1 else corpus.filter((place >= last) & (place < share))
        hits = part.mapInArrow(_searching(search, shared, exclude_self), hit_type)
        if best is not None:
            hits = hits.unionAll(best.select(hit_type.names))
        best = written(best_places(hits, k), "hits")
        if share != shares[-1]:
            bound = _bounds(best, k, q_ids)
        last = share
        shared.destroy()
    return best


def _searching(search, shared, exclude_self):
    def run(batches):
        q_ids, vectors, q_groups, bound = shared.value
        parts = ((b.column("id"), b.column("vector"), b.column("grp") if q_groups is not None else None) for b in batches)
        yield from search(parts, q_ids, vectors, q_groups, exclude_self, bound)

    return run


def _bounds(best, k, q_ids):
    """The k-th place of every query of a block that has k hits, and no bound for the others."""
    import pyarrow.compute as pc

    known = best.filter(F.col("rank") == k).select("query_id", "place").toArrow()
    if not known.num_rows:
        return np.full(len(q_ids), -np.inf)
    at = pc.index_in(q_ids, value_set=known.column("query_id").combine_chunks().cast(q_ids.type))
    return pc.fill_null(known.column("place").combine_chunks().take(at), -np.inf).to_numpy(zero_copy_only=False)


def knn_one(corpus, vector, k, **columns):
    """The k best rows for one query vector given as numbers: (id, score, rank).

    Measured against expressions over the array elements, the block search is the faster
    plan for a single query too.
    """
    query = [float(x) for x in vector]
    asked = corpus.sparkSession.range(1).select(F.col("id").alias("query_id"), F.lit(query).alias("vector"))
    return exact_knn(corpus, asked, k, len(query), **columns).drop("query_id")


def rank_hits(hits, k, order=None):
    """Rank hits per query by score, then id, and keep the first k."""
    order = order or [F.round("score", RANK_DECIMALS).desc(), F.col("id").asc()]
    best = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _empty_hits(corpus, queries, id_col, query_id):
    none = corpus.select(F.col(id_col).alias("id")).limit(0)
    kind = queries.schema[query_id].dataType
    return none.select(F.lit(None).cast(kind).alias("query_id"), "id", F.lit(0.0).alias("score"),
                       F.lit(0).alias("rank"))


def with_payload(hits, corpus, id_col="id", prefix=""):
    """Put corpus columns beside each hit.

    The hits, at most k per query, are written first: the search runs once, and the size
    of the hit list decides whether the corpus is scanned in place or joined by id.
    """
    payload = corpus.select(
        F.col(id_col).alias("id"),
        *[F.col(c).alias(prefix + c) for c in corpus.columns if c != id_col],
    )
    return measured(hits).join(payload, "id")
