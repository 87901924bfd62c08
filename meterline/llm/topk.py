"""Exact top-k inner products by no-random-access aggregation over sorted lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

K = 5
BLOCK_ROWS = 4_096  # candidates whose sorted lists a task holds
QUERY_ROWS = 16_384  # queries that a task answers
TOGETHER = 256  # queries that read on in the lists together
READS = (0.05, 0.1, 0.2, 0.25, 0.2, 0.2)  # share of each list that is read in turn, to its end
EXACT = 2.0**52  # doubles add integers up to here without loss


class SortedLists:
    """One list a dimension of a block's values, in descending order; read from the end for negative weights.

    How far a list has been read is the same for all queries of one round, so many queries read on together: what the round's entries add, and what
    those not read could, are products of the queries' weights with one matrix each.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        order = np.argsort(-values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, order, axis=0)
        self.place = np.empty(values.shape, np.int32)  # of each candidate in each list
        np.put_along_axis(self.place, order, np.arange(len(values), dtype=np.int32)[:, None], axis=0)

    def search(self, queries: np.ndarray, k: int, floors: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, int]:
        """For each query (row) whether each candidate may be among its ``k`` best and reach its floor, and the number of entries read.

        Each round reads on in every list whose weight isn't 0, from where the last one stopped. A value that was not read
        lies between its list's last entry and the last one read, which gives every candidate a lower and an upper bound. A candidate
        whose upper bound is below the floor or the k-th greatest lower bound is out. A query stops reading when no more than ``k``
        are left, or when the lists are at their ends. ``skip`` is each query's candidate that takes no part (-1: none).
        """
        n = len(self.values)
        alive = np.ones((len(queries), n), bool)
        alive[np.flatnonzero(skip >= 0), skip[skip >= 0]] = False
        # Lists of positive weights are read from the top, those of negative ones from the end.
        weights = np.concatenate((np.maximum(queries, 0), np.minimum(queries, 0)), axis=1)
        worst = np.concatenate((self.sorted[-1], self.sorted[0]))  # what the list's last entry would give
        used = np.count_nonzero(queries, axis=1)
        sums = np.zeros((len(queries), n))  # of what was read
        going, read, done = np.arange(len(queries)), 0, 0
        for share in READS:
            to = min(n, done + math.ceil(share * n))
            top = (self.place >= done) & (self.place < to), (self.place >= n - to) & (self.place < n - done)
            own = weights[going]
            sums += own @ np.concatenate([np.where(t, self.values, 0) for t in top], axis=1).T
            read, done = read + (to - done) * int(used[going].sum()), to
            high = low = sums
            if done < n:
                missing = np.concatenate((self.place >= done, self.place < n - done), axis=1).T.astype(np.float64)
                last = np.concatenate((self.sorted[done - 1], self.sorted[n - done]))
                high, low = sums + (own * last) @ missing, sums + (own * worst) @ missing
            left, bar = alive[going], floors[going]
            if n > k:
                bar = np.maximum(bar, np.partition(np.where(left, low, -np.inf), n - k, axis=1)[:, n - k])
            left &= high >= bar[:, None]
            alive[going] = left
            more = np.count_nonzero(left, axis=1) > k
            going, sums = going[more], sums[more]
            if done == n or not len(going):
                break
        return alive, read


def block_top(
    values: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query those of a block's candidates that may be among its ``k`` best: positions of queries and candidates, whole scores, entries read.

    ``own`` is each query's position among the candidates (-1: not there), which isn't its candidate; ``floors`` are scores that
    ``k`` candidates elsewhere are known to have.
    """
    lists, q, c, read = SortedLists(values), [], [], 0
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    for begin in range(0, len(queries), TOGETHER):
        some = slice(begin, begin + TOGETHER)
        alive, entries = lists.search(queries[some], k, floors[some], own[some])
        read += entries
        for i, left in enumerate(alive, begin):
            found = np.flatnonzero(left)
            scores = values[found] @ queries[i]
            found = np.sort(found[np.lexsort((found, -scores))[:k]])  # of equal ones the first, which have the smaller ids
            q.append(np.full(len(found), i))
            c.append(found)
    q, c = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (q, c))
    return q, c, (values[c] * queries[q]).sum(axis=1), read


def _matrix(column: pa.ChunkedArray, width: int, exact: bool) -> np.ndarray:
    """Vectors as rows of ``width``; shorter ones are filled with zeros."""
    lengths = column.combine_chunks().value_lengths().to_numpy()
    flat = column.combine_chunks().flatten().to_numpy()
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out if exact else np.array([[int(x) for x in row] for row in out], object)


def _answer(k: int, exact: bool):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        names = "query_row", "query_id", "vec_id", "score"
        if not candidates.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        candidates = candidates.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        ids, rows = candidates["vec_id"].to_numpy(), candidates["row"].to_numpy()
        query_ids, query_rows = queries["vec_id"].to_numpy(), queries["row"].to_numpy()
        columns = candidates["vector"], queries["vector"]
        width = max(1, *(int(c.combine_chunks().value_lengths().to_numpy().max()) for c in columns))
        values, wanted = (_matrix(c, width, exact) for c in columns)
        at = dict(zip(rows.tolist(), range(len(rows)), strict=True))
        own = np.array([at.get(r, -1) for r in query_rows.tolist()])
        if exact:
            floors = queries["floor"].to_numpy().astype(np.float64)
            q, c, score, _ = block_top(values, own, wanted, k, np.where(np.isnan(floors), -np.inf, floors))
        else:  # integers beyond a double's: all lists are read to the end
            q, c, score = _whole(values, own, wanted, k)
        found = query_rows[q], query_ids[q], ids[c], score
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, found, strict=True)})

    return run


def _whole(values: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    limit, rows = 2**63 - 1, []
    for q, (skip, vector) in enumerate(zip(own.tolist(), queries, strict=True)):
        products = [(-sum(a * b for a, b in zip(row, vector, strict=True)), c) for c, row in enumerate(values) if c != skip]
        rows += [(q, c, max(-limit, min(limit, -s))) for s, c in sorted(products)[:k]]
    return tuple([r[i] for r in rows] for i in range(3))


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(256 * x) of each component, for vectors without null or non-finite components.

    Every row counts, also repeated ones and those that share an id. Rows with a
    null id, and vectors null or with a null or non-finite component, take no part.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.where("vec_id is not null and embedding is not null")
        .where(sound)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: _floor(v * 256.0)).alias("vector"))
    )


def _floor(v):
    """Floor as a double: numbers of 2 ** 53 and more have no fraction."""
    return F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)


def top_k(vectors: DataFrame, is_query, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` candidates of greatest inner product for each query, among all rows of ``vectors`` (vec_id, embedding).

    ``is_query`` is a condition on vec_id. Candidates and queries are dealt by hash into blocks of bounded size. First each query is
    answered in one block of candidates; the k-th score found there is a floor for the others, so that their lists need not be read far.
    Then each pair of blocks is one task's: it sorts the candidates' values by dimension and reads these lists in turn, only
    as far as the bounds require. The blocks' winners meet in one window by query.

    A query's candidates are all rows but its own: other rows of its id are candidates, and several query rows of one id have an answer each.
    Vectors of different lengths are filled up with zeros. Ties go to the smaller vec_id. Scores beyond a long are cut to its limits.
    Returns query_id, rank (from 1), vec_id, score; fewer rows for a query if there are fewer candidates.
    """
    sound = staged(quantized(vectors).withColumn("row", F.monotonically_increasing_id()), "topk")
    queries = sound.where(is_query)
    size = F.aggregate("vector", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    n, largest, width = sound.agg(F.count("*"), F.max(size), F.max(F.size("vector"))).first()
    exact = not n or largest * largest * max(1, width) * 2 < EXACT
    blocks, query_blocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(queries.count() / query_rows))
    dealt = lambda blocks, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    kind = "query_row long, query_id long, vec_id long, score long"
    columns = ["row", "vec_id", "vector"]

    def answered(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(_answer(k, exact), kind)

    # Columns of their own: the two sides of a cogroup must not share any.
    queries = queries.select(*[F.col(c).alias(c) for c in columns])
    asked = queries.withColumn("floor", F.lit(None).cast("double"))
    if exact and blocks > 1:
        # A block holds few of the queries that begin there, so these are one group.
        first = answered(
            sound.select(*columns, dealt(blocks, 1).alias("b"), F.lit(0).alias("q")),
            asked.select(*columns, "floor", dealt(blocks, 3).alias("b"), F.lit(0).alias("q")),
        )
        floors = first.groupBy("query_row").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
        floors = floors.where(F.size("scores") >= k).select("query_row", F.col("scores")[k - 1].cast("double").alias("floor"))
        floors = staged(floors, "topk-floors")
        asked = queries.join(floors, queries["row"] == floors["query_row"], "left").select(*columns, "floor")
    found = answered(
        sound.select(*columns, dealt(blocks, 1).alias("b"), every(query_blocks).alias("q")),
        asked.select(*columns, "floor", every(blocks).alias("b"), dealt(query_blocks, 2).alias("q")),
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
