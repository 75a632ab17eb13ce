"""Exact nearest neighbours by Euclidean distance, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspend.scratch import written
from docspend.search.text import similar_text
from docspend.shipping import ship

ROWS, QUERIES = 4096, 512
#: Pairs of a row and a query that are measured exactly at a time.
PAIRS = 1 << 16


def bad_dims(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.where(F.coalesce(F.size("embedding"), F.lit(0)) != dim)


def _blocks(df: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows (id, embedding) as blocks: ids, and one matrix of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                matrix = np.array(part.column("embedding").to_pylist(), "<f8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())],
                    [f"{prefix}_ids", f"{prefix}_data"]
                )

    rows = df.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, f"{prefix}_ids array<long>, {prefix}_data binary")


#: Bytes of query vectors up to which all of them go to every task; more are dealt in groups.
BROADCAST = 64 << 20


def _meeting(k: int, exclude_self: bool, higher_first: bool):
    """The k best of each block of rows (r_ids, r_data) for each query of a block (q_ids, q_data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at in range(batch.num_rows):  # one pair at a time, as each holds two matrices
                ids, data, qids, qdata = (batch.column(c)[at].as_py() for c in ("r_ids", "r_data", "q_ids", "q_data"))
                x, q = np.frombuffer(data).reshape(len(ids), -1), np.frombuffer(qdata).reshape(len(qids), -1)
                ids = np.array(ids)
                x2, q2 = (x * x).sum(axis=1), (q * q).sum(axis=1)
                near = q @ x.T
                near *= -2
                near += x2
                near += q2[:, None]
                slack = 1e-6 + 1e-12 * (x2.max() + q2)  # distances are rounded to 6 places
                out = []
                for i, row in enumerate(near):
                    if exclude_self:
                        row[ids == qids[i]] = np.inf
                    limit = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
                    limit = limit if np.isinf(limit) else (np.sqrt(max(limit, 0)) + 1e-6) ** 2 + slack[i]
                    some = np.flatnonzero((row <= limit) & np.isfinite(row))
                    d = np.round(np.sqrt(((x[some] - q[i]) ** 2).sum(axis=1)), 6)
                    best = np.lexsort((-ids[some] if higher_first else ids[some], d))[:k]
                    out.append((np.full(len(best), qids[i]), ids[some][best], d[best]))
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "id", "distance"])

    return run


def _running(asked, k: int, exclude_self: bool, higher_first: bool):
    """The k best of a task's rows (id, embedding) for each of the queries asked (a broadcast of ids and their matrix).

    What a task holds does not grow with its rows: a block of rows, the distances of a block of
    queries from it, and the k best so far, whose last distance leaves out almost all that follows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        qids, q = asked.value
        sign = -1 if higher_first else 1
        best = [tuple(np.empty(0, t) for t in ("i8", "f8", "i8")) for _ in range(0, len(qids), QUERIES)]  # query's place, distance, id
        last = np.full(len(qids), np.inf)  # distance of the k-th
        q2 = (q * q).sum(axis=1)
        for ids, x in _slices(batches, ROWS):
            x2 = (x * x).sum(axis=1)
            for b, at in enumerate(range(0, len(qids), QUERIES)):
                part = slice(at, at + QUERIES)
                near = q[part] @ x.T
                near *= -2
                near += x2
                near += q2[part, None]
                if exclude_self:
                    near[qids[part, None] == ids] = np.inf
                slack = 1e-6 + 1e-12 * (x2.max() + q2[part])  # distances are rounded to 6 places
                limit = last[part]
                if np.isinf(limit).any() and len(ids) > k:
                    kth = np.partition(near, k - 1, axis=1)[:, k - 1]
                    limit = np.minimum(limit, np.sqrt(np.maximum(kth, 0)))
                row, some = np.nonzero((near <= ((limit + 1e-6) ** 2 + slack)[:, None]) & np.isfinite(near))
                for begin in range(0, len(row), PAIRS):
                    r, c = row[begin : begin + PAIRS], some[begin : begin + PAIRS]
                    d = np.round(np.sqrt(((x[c] - q[part][r]) ** 2).sum(axis=1)), 6)
                    r, d, i = (np.concatenate(y) for y in zip(best[b], (r, d, ids[c])))
                    order = np.lexsort((sign * i, d, r))
                    r, d, i = r[order], d[order], i[order]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    best[b] = tuple(y[place < k] for y in (r, d, i))
                    full = place == k - 1
                    last[at + r[full]] = d[full]
        for b, (r, d, i) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(qids[b * QUERIES + r]), pa.array(i), pa.array(d)], ["query_id", "id", "distance"])

    return run


def _slices(batches: Iterator[pa.RecordBatch], size: int):
    """Ids and matrices of at most so many rows."""
    import numpy as np

    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield np.array(part.column("id")), _matrix(part.column("embedding"))


def _matrix(vectors: pa.Array):
    """Vectors of one length as a matrix; a number that is missing is not a number."""
    import numpy as np

    if not len(vectors):
        return np.empty((0, 0))
    if vectors.null_count or len(set(np.diff(np.asarray(vectors.offsets)))) > 1:
        raise ValueError("a vector is missing or has another length")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _best(found: DataFrame, k: int, higher_first: bool) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", F.desc("id") if higher_first else "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


#: Pivots at most, and blocks of rows at most: their places and bounds go to every task (some 10 MB).
PIVOTS, BLOCKS = 256, 250_000


class Pruned:
    """Vectors (id, embedding) in blocks around pivots, written once, for exact searches that meet few of them.

    Every vector belongs to its nearest pivot; those of a pivot are cut into blocks by their distance
    from it.  A query's distance to the pivot then bounds its distance to the block from below (the
    triangle inequality).  The nearest blocks give a first k-th distance; only blocks that may hold a
    nearer row are met after that, so the result is that of meeting all.  The pivots are the vectors
    with the smallest hashes of their ids; they decide how many blocks are met, never the result.
    visited: after a search, the share of (block, query) pairs that met.
    """

    def __init__(self, vectors: DataFrame, rows: int = ROWS, pivots: int = PIVOTS):
        import numpy as np

        self.spark = vectors.sparkSession
        ship(self.spark)
        data = vectors.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
        n = data.count()
        rows = max(rows, -(-n // BLOCKS))
        chosen = data.orderBy(F.xxhash64("id"), "id").limit(min(pivots, -(-n // rows) if n else 1)).collect()
        self.pivots = pivot = np.array([r.embedding for r in chosen], "<f8")
        self.visited = None

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = np.nan_to_num(_distances(_matrix(batch.column("embedding")), pivot), nan=np.inf)
                p = near.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(p), pa.array(near[np.arange(len(p)), p])], ["id", "embedding", "p", "d"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            block = TaskContext.get().partitionId() << 33
            held = None
            for batch in batches:
                rest = pa.Table.from_batches([batch])
                held = rest if held is None else pa.concat_tables([held, rest]).combine_chunks()
                while len(held):
                    of = np.asarray(held.column("p").combine_chunks())
                    end = int(np.searchsorted(of, of[0], "right"))  # rows are sorted by pivot
                    if end == len(held) and end < rows:
                        break  # the pivot may go on in the next batch
                    yield _block(held.slice(0, min(end, rows)), block)
                    held, block = held.slice(min(end, rows)), block + 1
            if held is not None and len(held):
                yield _block(held, block)

        placed = data.mapInArrow(assign, "id long, embedding array<double>, p long, d double")
        dealt = placed.repartitionByRange("p", "d").sortWithinPartitions("p", "d")
        self.blocks = written(dealt.mapInArrow(cut, "block long, p long, lo double, hi double, n long, r_ids array<long>, r_data binary"), "vectors")
        self.bounds = [np.array(x) for x in zip(*((r.block, r.p, r.lo, r.hi, r.n) for r in self.blocks.select("block", "p", "lo", "hi", "n").collect()))]

    def knn(self, queries: DataFrame, k: int, exclude_self: bool = True, higher_first: bool = False) -> DataFrame:
        """query_id, id, distance, place: as `knn` gives them.

        The nearest blocks of a query, dealt to them, give its limit.  Then the queries go to all tasks as
        one matrix with their limits (BROADCAST bytes at a time), and a task meets its blocks one after the
        other, so neither pairs of blocks and queries nor their finds are shuffled.
        """
        asked = written(queries.select(F.col("id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")), "queries")
        first = written(self._route(asked, k), "first")
        limit = _best(self._met(first, k, exclude_self, higher_first), k, higher_first).groupBy("query_id").agg(F.when(F.count("*") == k, F.max("distance")).otherwise(float("inf")).alias("limit"))
        n, size = asked.agg(F.count("*"), F.sum(F.size("embedding") * 8 + 16 * k)).first()
        parts = max(1, -(-(size or 0) // BROADCAST))
        again = written(asked.join(limit, "query_id", "left").select("*", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")), "limits")
        found = None
        for part in range(parts):
            near = written(self._searched(again.where(F.col("part") == part), k, exclude_self, higher_first), "near")
            found = near if found is None else found.unionByName(near)
        pairs = n * (len(self.bounds[0]) if self.bounds else 0)
        self.visited = found.agg(F.sum("met")).first()[0] / pairs if pairs else 0.0
        return _best(found.where("query_id IS NOT NULL").drop("met"), k, higher_first)

    def _searched(self, asked: DataFrame, k: int, exclude_self: bool, higher_first: bool) -> DataFrame:
        """query_id, id, distance: a task's k best for each of asked; and a row a task with met, the number of its pairs of a block and a query."""
        spark, schema = self.spark, "query_id long, id long, distance double, met long"
        table = asked.select("query_id", "embedding", F.coalesce("limit", F.lit(float("inf"))).alias("limit")).toArrow().combine_chunks()
        if not table.num_rows:
            return spark.createDataFrame([], schema)
        column = lambda name: table.column(name).combine_chunks()
        sent = spark.sparkContext.broadcast((column("query_id").to_numpy(), _matrix(column("embedding")), column("limit").to_numpy()))
        # what comes out is k rows a query and task, so there are only as many tasks as run at a time, twice over
        dealt = self.blocks.repartition(2 * spark.sparkContext.defaultParallelism, "block")
        return dealt.mapInArrow(_narrowing(sent, self.pivots, k, exclude_self, higher_first), schema)

    def _route(self, asked: DataFrame, k: int) -> DataFrame:
        """block, query_id, embedding: the nearest blocks with more than k rows."""
        import numpy as np

        pivot, bounds = self.pivots, self.bounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 32):
                    batch = whole.slice(at, 32)
                    if not bounds:
                        continue
                    block, p, lo, hi, n = bounds
                    away = _distances(_matrix(batch.column("embedding")), pivot)[:, p]
                    least = np.maximum(np.maximum(away - hi, lo - away), 0)
                    order = np.argsort(least, axis=1, kind="stable")
                    enough = np.cumsum(n[order], axis=1) - n[order] <= k  # one row may be the query itself
                    near = np.zeros(least.shape, bool)
                    np.put_along_axis(near, order, enough, axis=1)
                    row, to = np.nonzero(near)
                    at_row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(block[to]), batch.column("query_id").take(at_row), batch.column("embedding").take(at_row)], ["block", "query_id", "embedding"])

        return asked.mapInArrow(run, "block long, query_id long, embedding array<double>")

    def _met(self, routed: DataFrame, k: int, exclude_self: bool, higher_first: bool) -> DataFrame:
        """The queries of a block meet it in groups of QUERIES at most on average."""
        groups = routed.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).alias("groups"))
        dealt = routed.join(groups, "block").withColumn("group", F.expr("pmod(xxhash64(query_id), groups)"))
        together = dealt.groupBy("block", "group").agg(F.collect_list(F.struct("query_id", "embedding")).alias("q"))
        pairs = together.join(self.blocks.select("block", "r_ids", "r_data"), "block").select("r_ids", "r_data", F.col("q.query_id").alias("q_ids"), F.col("q.embedding").alias("q_rows"))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    data = np.array(one.column("q_rows")[0].as_py(), "<f8").tobytes()
                    yield pa.RecordBatch.from_arrays([one.column("r_ids"), one.column("r_data"), one.column("q_ids"), pa.array([data], pa.binary())], ["r_ids", "r_data", "q_ids", "q_data"])

        meet = _meeting(k, exclude_self, higher_first)
        return pairs.mapInArrow(lambda batches: meet(packed(batches)), "query_id long, id long, distance double")


def _narrowing(asked, pivots, k: int, exclude_self: bool, higher_first: bool):
    """The k best of a task's blocks for each of the queries asked (a broadcast of ids, their matrix, and limits of the k-th distance).

    A query meets a block only if the triangle inequality leaves open that it holds a row within the
    query's limit, which shrinks to the k-th distance found; a task holds one block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        qids, q, limits = asked.value
        sign, met, last = -1 if higher_first else 1, 0, limits.copy()
        best_d, best_i = np.full((len(qids), k), np.inf), np.zeros((len(qids), k), "i8")
        q2 = (q * q).sum(axis=1)
        for batch in batches:
            for at in range(batch.num_rows):
                of, lo, hi = (batch.column(c)[at].as_py() for c in ("p", "lo", "hi"))
                ids = batch.column("r_ids")[at].values.to_numpy()
                x = np.frombuffer(batch.column("r_data")[at].as_buffer()).reshape(len(ids), -1)
                p2 = pivots[of] @ pivots[of]
                away = np.sqrt(np.maximum(q2 + p2 - 2 * (q @ pivots[of]), 0))
                # distances from products may be wrong by the root of their rounding; the limits are rounded to 6 places
                least = np.maximum(away - hi, lo - away) - 1e-9 * away - 3e-7 * np.sqrt(q2 + p2)
                close = np.flatnonzero(~(least > last + 2e-6))
                met += len(close)
                x2 = (x * x).sum(axis=1)
                for begin in range(0, len(close), QUERIES):
                    some = close[begin : begin + QUERIES]
                    near = q[some] @ x.T
                    near *= -2
                    near += x2
                    near += q2[some, None]
                    if exclude_self:
                        near[qids[some, None] == ids] = np.inf
                    limit, slack = last[some], 1e-6 + 1e-12 * (np.nanmax(x2, initial=0) + q2[some])
                    if np.isinf(limit).any() and len(ids) > k:
                        limit = np.minimum(limit, np.sqrt(np.maximum(np.partition(near, k - 1, axis=1)[:, k - 1], 0)))
                    row, place = np.nonzero((near <= ((limit + 1e-6) ** 2 + slack)[:, None]) & np.isfinite(near))
                    for part in range(0, len(row), PAIRS):
                        r, c = row[part : part + PAIRS], place[part : part + PAIRS]
                        d = np.round(np.sqrt(((x[c] - q[some[r]]) ** 2).sum(axis=1)), 6)
                        kept = d <= last[some[r]]
                        r, d, i = r[kept], d[kept], ids[c[kept]]
                        rows = np.unique(r)
                        r = np.concatenate((np.repeat(rows, k), r))
                        d, i = np.concatenate((best_d[some[rows]].ravel(), d)), np.concatenate((best_i[some[rows]].ravel(), i))
                        order = np.lexsort((sign * i, d, r))
                        r, d, i = r[order], d[order], i[order]
                        turn = np.arange(len(r)) - np.searchsorted(r, r)
                        top = turn < k
                        best_d[some[rows]], best_i[some[rows]] = d[top].reshape(-1, k), i[top].reshape(-1, k)
                        last[some[rows]] = np.minimum(last[some[rows]], best_d[some[rows], -1])
        r, c = np.nonzero(np.isfinite(best_d))
        for columns in (([None], [None], [None], [met]), (qids[r], best_i[r, c], best_d[r, c], [None] * len(r))):
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["query_id", "id", "distance", "met"])

    return run


def _distances(x, y):
    """Distances of all rows of x from all rows of y."""
    import numpy as np

    square = (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)
    return np.sqrt(np.maximum(square, 0))


def _block(rows: pa.Table, number: int) -> pa.RecordBatch:
    import numpy as np

    d = np.asarray(rows.column("d").combine_chunks())
    matrix = _matrix(rows.column("embedding").combine_chunks())
    # the distances come from products: the bounds leave room for their rounding
    lo, hi = d.min() * (1 - 1e-9) - 1e-7, d.max() * (1 + 1e-9) + 1e-7
    columns = [pa.array([number]), pa.array([rows.column("p")[0].as_py()]), pa.array([lo]), pa.array([hi]), pa.array([len(rows)]), pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "p", "lo", "hi", "n", "r_ids", "r_data"])


def knn(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, higher_first: bool = False) -> DataFrame:
    """query_id, id, distance, place: the k nearest of vectors (id, embedding) for each query.

    A block of queries meets a block of rows in one matrix product, by |x|^2 - 2xq + |q|^2; what
    lies within rounding of the k-th is measured again exactly, and a block keeps its k best for
    each query.  Equal distances are ordered by id, the lower first or the higher_first.
    """
    ship(vectors.sparkSession)

    size = queries.agg(F.sum(F.size("embedding") * 8)).first()[0] or 0
    if size <= BROADCAST:
        doubles = lambda df: df.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
        table = doubles(queries).toArrow().combine_chunks()
        if not table.num_rows:
            return _best(doubles(vectors).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("distance")).limit(0), k, higher_first)
        column = lambda name: table.column(name).combine_chunks()
        asked = vectors.sparkSession.sparkContext.broadcast((column("id").to_numpy(), _matrix(column("embedding"))))
        found = doubles(vectors).repartition("id").mapInArrow(_running(asked, k, exclude_self, higher_first), "query_id long, id long, distance double")
        return _best(found, k, higher_first)
    rows, asked = _blocks(vectors, ROWS, "r"), _blocks(queries, QUERIES, "q")
    # every block of queries goes to each of the groups of row blocks
    groups = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    pairs = rows.withColumn("group", F.pmod(F.xxhash64("r_ids"), F.lit(groups)).cast("int")).join(asked.select("*", deal), "group").drop("group")
    found = pairs.mapInArrow(_meeting(k, exclude_self, higher_first), "query_id long, id long, distance double")
    return _best(found, k, higher_first)


def similar(df: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id, place, by: the k rows nearest to each of queries (rows of df), then the higher id.

    A query without a vector, or without another vector to meet, is answered by its text.
    """
    mine = vectors.join(queries.select("id"), "id", "left_semi")
    by_vector = knn(vectors, mine, k, higher_first=True).select("query_id", "id", "place", F.lit("vector").alias("by"))
    left = queries.join(by_vector.select(F.col("query_id").alias("id")), "id", "left_anti")
    return by_vector.unionByName(similar_text(df, left, k).select("query_id", "id", "place", F.lit("text").alias("by")))


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, size: int, page: int = 1, order: list[Column] | None = None) -> DataFrame:
    """id, place, total: a page of text hits in their order, then the nearest vectors that are not among them, `size` in all.

    text_hits: all hits, id and the columns of order (place without one); vector_hits: id, distance
    of the 2 * size nearest.  total is the number of text hits, or of merged rows if there are more.
    Only `size` rows of either kind are ranked.
    """
    order = order or [F.col("place")]
    text = text_hits.orderBy(*order).offset(max(page - 1, 0) * size).limit(size)
    text = text.select("id", F.lit(0).alias("source"), F.row_number().over(Window.orderBy(*order)).cast("double").alias("rank"))
    extra = vector_hits.join(text.select("id"), "id", "left_anti").orderBy("distance", "id").limit(size)
    both = text.unionByName(extra.select("id", F.lit(1).alias("source"), F.col("distance").alias("rank")))
    top = both.orderBy("source", "rank", "id").limit(size)
    merged = top.select("id", F.row_number().over(Window.orderBy("source", "rank", "id")).alias("place"))
    return merged.withColumn("total", F.greatest(text_hits.agg(F.count("*")).scalar(), F.count("*").over(Window.partitionBy())))
