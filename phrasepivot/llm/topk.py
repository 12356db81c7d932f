"""Exact top-k inner products by no-random-access aggregation of sorted lists.

A block of vectors has a sorted list for every dimension.  All lists are read in sequence
and to the same depth, from the end that gives a query most.  What a row has not been met
with gives it no more than the last entry read, and no less than the list's last, which
bounds its score from above and below.  What is read to a depth is the same for all queries,
so their bounds are products of the queries with it.
The k best lower bounds, or scores that earlier blocks have resolved, are the bar;
a row whose upper bound is under it drops out.  Reading stops when no more than k
rows can qualify, and these rows' scores are resolved.  No row is looked up before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasepivot.llm.common import Staged, ship_package, tidy

#: Vectors in a block, components in it where vectors are long, and bytes of the queries that are broadcast at once.
BLOCK, CELLS, CHUNK_BYTES = 4096, 1 << 18, 16 << 20
#: Shares of the lists after which the bounds are looked at.
DEPTHS = (1 / 16, 0.3, 0.6, 0.7, 0.8, 0.88, 0.94, 1.0)
#: Bounds that are worked out in one go: of queries with all rows, of single rows.
LOOK, PAIRS = 1 << 21, 1 << 13


def _groups(at: np.ndarray) -> np.ndarray:
    """Places within runs of equal numbers, which are sorted."""
    return np.arange(len(at)) - np.searchsorted(at, at)


def _ranked(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query at, best first, ties to the smaller id."""
    order = np.lexsort((ids, -scores, at))
    order = order[_groups(at[order]) < k]
    return at[order], ids[order], scores[order]


class SortedLists:
    """For each dimension the rows of a block from the smallest component to the largest.

    entries and resolved: how many entries of the lists have been read so far, and scores resolved, of all queries."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.row_ids, (self.n, self.d) = x, ids, x.shape
        columns = np.ascontiguousarray(x.T)
        self.order = np.argsort(columns, axis=1, kind="stable")
        self.values = np.take_along_axis(columns, self.order, axis=1)
        self.largest = np.abs(self.values[:, [0, -1]].astype(np.float64)).max(axis=1)
        self.by_id = np.argsort(ids, kind="stable")
        self.tables: dict[tuple, np.ndarray] = {}
        self.entries = self.resolved = 0

    def _told(self, to: int, best: bool, kind: type) -> np.ndarray:
        """What the first entries of each list, to in number, tell of a row: in the first d columns the lists are read from
        their largest entries, in the others from their smallest.  What is unread counts as the last entry read (best) or as
        the list's last."""
        if (to, best, kind) not in self.tables:
            n, d, v = self.n, self.d, self.values
            told = np.empty((2 * d, n), kind)
            told[:d], told[d:] = v[:, n - to if best else 0, None], v[:, to - 1 if best else n - 1, None]
            np.put_along_axis(told[:d], self.order[:, n - to :], v[:, n - to :].astype(kind), axis=1)
            np.put_along_axis(told[d:], self.order[:, :to], v[:, :to].astype(kind), axis=1)
            self.tables[to, best, kind] = np.ascontiguousarray(told.T)
        return self.tables[to, best, kind]

    def _own(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the rows that have the query's id."""
        ids = self.row_ids[self.by_id]
        first = np.searchsorted(ids, own)
        many = np.searchsorted(ids, own, "right") - first
        at = np.repeat(np.arange(len(own)), many)
        return at, self.by_id[first[at] + _groups(at)]

    def _left(self, queries: np.ndarray, own: np.ndarray, k: int, held: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the rows that may be among a query's k best: no more than k, or all is read.

        held: the k best scores of earlier blocks, -inf where there are fewer."""
        n, m = self.n, len(queries)
        q = queries.astype(kind)
        both = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
        slack = 1e-9 * (np.abs(queries.astype(np.float64)) @ self.largest)  # of the bounds' own rounding
        used, lacking = (queries != 0).sum(axis=1), np.isneginf(held.min(axis=1))
        bar = np.maximum(held.min(axis=1), np.finfo(np.float32).min)
        first = np.concatenate([self.values[:, -1], self.values[:, 0]]).astype(kind)
        go = np.flatnonzero(both @ first >= bar - slack)  # queries of which most rows are left
        at, row, high = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)  # rows left of the other queries
        out, before = [], 0

        def bounds(best: bool) -> np.ndarray:
            told = self._told(to, best, kind)
            parts = [np.einsum("pd,pd->p", both[at[a : a + PAIRS]], told[row[a : a + PAIRS]]) for a in range(0, len(at), PAIRS)]
            return np.concatenate(parts or [np.zeros(0, kind)])

        for depth in DEPTHS:
            to = n if depth >= 1 else -int(-depth * n // 1)
            reading = np.zeros(m, bool)
            reading[go], reading[at] = True, True
            self.entries += int((to - before) * used[reading].sum())
            before = to
            high = bounds(True)
            if len(go):
                most, mine = both[go] @ self._told(to, True, kind).T, self._own(own[go])
                most[mine] = -np.inf
                if lacking[go].any() or depth >= 1:  # what is read of this block has to make the bar
                    least = both[go] @ self._told(to, False, kind).T if depth < 1 else most.copy()
                    least[mine] = -np.inf
                    sure = np.concatenate([held[go], np.partition(least, n - k, axis=1)[:, n - k :] if n > k else least], axis=1)
                    bar[go] = np.maximum(bar[go], np.partition(sure, sure.shape[1] - k, axis=1)[:, sure.shape[1] - k])
                may = most >= (bar - slack)[go, None].astype(kind)
                few = (may.sum(axis=1) <= n // 8) | (depth >= 1)
                new, rows = np.nonzero(may & few[:, None])
                at, row, high = np.r_[at, go[new]], np.r_[row, rows], np.r_[high, most[new, rows]]
                go = go[~few]
            low = bounds(False)
            above = low > bar[at]
            if above.any():
                some = np.isfinite(held)
                sure, _, score = _ranked(np.r_[np.nonzero(some)[0], at[above]], np.zeros(int(some.sum() + above.sum()), np.int64), np.r_[held[some], low[above]], k)
                last = np.flatnonzero(_groups(sure) == k - 1)
                bar[sure[last]] = np.maximum(bar[sure[last]], score[last])
            keep = high >= (bar - slack)[at].astype(kind)
            at, row = at[keep], row[keep]
            done = (np.bincount(at, minlength=m)[at] <= k) | (depth >= 1)
            out.append((at[done], row[done]))
            at, row = at[~done], row[~done]
            if not len(at) and not len(go):
                break
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of the k best of this block and of best, ties to the smaller id, sorted by place; rows
        that have the query's id take no part."""
        if not len(queries):
            return best
        at, ids, scores = best
        held = np.full((len(queries), k), -np.inf)
        held[at, _groups(at)] = scores
        # bounds are whole numbers; where all sums are below 2**24 single precision holds them
        kind = np.float32 if np.abs(queries.astype(np.float64)).max(axis=0) @ self.largest < 2**24 else np.float64
        found, many = [], max(1, LOOK // self.n)
        for a in range(0, len(queries), many):
            q, row = self._left(queries[a : a + many], own[a : a + many], k, held[a : a + many], kind)
            self.resolved += len(q)
            exact = [np.einsum("pd,pd->p", self.x[row[i : i + PAIRS]], queries[a + q[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)]
            earlier = slice(*np.searchsorted(at, [a, a + many]))
            found.append(_ranked(np.r_[at[earlier], a + q], np.r_[ids[earlier], self.row_ids[row]], np.r_[scores[earlier], *exact], k))
        return tuple(np.concatenate(x) for x in zip(*found))

    def top(self, query: np.ndarray, k: int, own: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of this block and of best for one query."""
        at = np.zeros(len(best[0]), np.int64)
        return self.search(query[None], np.array([own]), k, _ranked(at, *best, k))[1:]


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as long; null unless every component is finite and the result fits a long."""
    grown = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 2.0**62 / scale))
    return F.when(vector.isNotNull() & F.coalesce(whole, F.lit(False)), F.transform(grown, lambda x: x.cast("long")))


def _matrix(column, dims: int) -> np.ndarray:
    """Lists of an Arrow column as rows, padded with zeros to dims."""
    sizes = np.diff(np.asarray(column.offsets))
    x = np.zeros((len(sizes), dims), np.int64)
    x[np.arange(dims) < sizes[:, None]] = np.asarray(column.flatten())
    return x


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k rows of vectors of highest integer inner product.

    Components are floor(scale * x); ties go to the smaller id.  Queries go out in chunks of CHUNK_BYTES; the
    vectors stay where they are, and a task makes its rows into blocks with sorted lists, a small one first.  It
    keeps the k best of each query over its blocks, so a later block is read no deeper than it could still better
    these; tasks' k best are ranked.

    Rows with a null id, a null vector, a null or non-finite component, or one of which scale times is 2**62 or
    more, take no part; a score must fit a long.  Rows with the query's own id are
    no candidates; other repeated rows are candidates of their own, repeated
    queries of one id count once.  Shorter vectors count as padded with zeros.
    Fewer than k candidates: all.  Empty tables give an empty result; other
    columns are not read."""
    spark = vectors.sparkSession
    ship_package(spark)

    def ready(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vec_col), scale).alias("x")).where("id is not null and x is not null")

    rows = Staged(spark, ready(vectors), "vectors").df
    spread = -(-rows.count() // BLOCK)
    if rows.rdd.getNumPartitions() < min(spread, spark.sparkContext.defaultParallelism):  # small files, but much work for each row
        rows = rows.repartition(min(spread, 2 * spark.sparkContext.defaultParallelism))
    asked = Staged(spark, ready(queries).groupBy("id").agg(F.min("x").alias("x")), "queries").df
    size = rows.agg(F.max(F.size("x")).alias("d")).first()
    many = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    dims = max(size.d or 0, many.d or 0, 1)
    chunks = max(1, -(-many.n * dims * 8 // CHUNK_BYTES))
    found = []
    for c in range(chunks):
        chunk = asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c).toPandas()  # about CHUNK_BYTES
        x = np.zeros((len(chunk), dims), np.int64)
        for i, values in enumerate(chunk["x"]):
            x[i, : len(values)] = values
        sent = spark.sparkContext.broadcast((chunk["id"].to_numpy(np.int64), x))
        found.append(Staged(spark, rows.mapInArrow(tidy(_searching(sent, k, dims)), "query_id long, vec_id long, score long"), "near").df)
        sent.unpersist()
    near = found[0]
    for df in found[1:]:
        near = near.unionByName(df)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searching(sent, k: int, dims: int):
    """Of batches of (id, x): the k best of each query among all of them."""

    def run(batches):
        import pyarrow as pa

        asks, queries = sent.value
        best = (np.zeros(0, np.int64),) * 3
        ids, parts, held = [], [], 0
        # a small block first, as the k best so far are the bar of the next
        most = min(BLOCK, max(64, CELLS // dims))
        size = max(1, most // 8)

        for b in batches:
            i, x, a = np.asarray(b.column(0)).astype(np.int64), _matrix(b.column(1), dims), 0
            while a < len(i):
                z = min(len(i), a + size - held)
                ids.append(i[a:z])
                parts.append(x[a:z])
                held, a = held + z - a, z
                if held == size:
                    best = SortedLists(np.concatenate(parts), np.concatenate(ids)).search(queries, asks, k, best)
                    ids, parts, held, size = [], [], 0, min(most, 2 * size)
        if held:
            best = SortedLists(np.concatenate(parts), np.concatenate(ids)).search(queries, asks, k, best)
        at, *found = best
        yield pa.RecordBatch.from_arrays([pa.array(asks[at]), *map(pa.array, found)], ["query_id", "vec_id", "score"])

    return run
