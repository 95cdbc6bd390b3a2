"""Exact top-k inner products with vector-approximation files.

Two files are written. The exact file has one row per vector. The approximation
file has, for each block of rows, one cell number (a byte) per component: equal
cells over the block's range of that component, so that the middle of a row's
cells is off by at most half a cell and one product of query and cells bounds
the score from both sides.

1. Seeds: each query meets the first blocks of cells; the k-th best lower bound
   there is a score that the k-th result cannot be under.
2. Scan: each block of queries meets each block of cells, on a block number and
   never row by row. A row stays if its upper bound reaches the seed's and the
   block's own k-th best lower bound. Exact vectors are neither read nor sent.
3. Fetch: the exact vectors of each query's candidates are read in the order of
   their upper bounds: first ``2 * k``, then those whose bound reaches the k-th
   exact score of the first. No bound that is left can change the result.

Of equal vectors only the first k + 1 identifiers can be in any result, so only
those are written: copies of one vector in any number do not grow the candidates.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part. Only vectors of the same length meet. Identifiers are
cast to long; rows whose cast is null take no part. Rows with the query's own id
are no candidates; repeated ids are candidates each, and a repeated query row
counts once. Fewer than k candidates give all of them. Scores outside 64 bits
stop at the limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import sized_broadcast
from .common import materialise

K = 20
SCALE = 64
CELL_BITS = 6
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
SEED_BLOCKS = 16    # blocks that give a query its first threshold; any number gives the same result
_LIMIT = 2 ** 63 - 1


def quantised(vec):
    """floor(SCALE * x) per component, x as double."""
    return F.transform(vec.cast("array<double>"),
                       lambda x: F.floor(F.lit(float(SCALE)) * x).cast("double"))


def usable(vec):
    """Neither null nor empty, and every component a finite number."""
    bad = F.exists(vec.cast("array<double>"),
                   lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad, F.lit(False))


def first_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of the rows (id, v) of one vector, those that can be among the k best of
    some query: k rows of each of the k + 1 smallest ids."""
    same = Window.partitionBy("v", "id").orderBy("id")
    ids = Window.partitionBy("v").orderBy("id")
    return (rows.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k)
            .withColumn("place", F.dense_rank().over(ids)).filter(F.col("place") <= k + 1)
            .select("id", "v"))


def _blocks(batches: Iterator[pa.RecordBatch], rows: int):
    """Columns (v, others...) -> (dim, values, others) of at most ``rows`` rows."""
    held: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        col = batch.column(0)
        others = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
        dims = np.asarray(pc.list_value_length(col))
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            values = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            parts = held.setdefault(dim, [])
            start = 0
            while start < len(at):
                room = rows - sum(len(p[0]) for p in parts)
                some = slice(start, start + room)
                parts.append([values[some]] + [o[at[some]] for o in others])
                start += room
                if sum(len(p[0]) for p in parts) == rows:
                    yield (dim, *(np.concatenate(c) for c in zip(*parts)))
                    parts.clear()
    for dim, parts in held.items():
        if parts:
            yield (dim, *(np.concatenate(c) for c in zip(*parts)))


class Cells:
    """Cell numbers of a block's rows and the bounds they give."""

    def __init__(self, low: np.ndarray, width: np.ndarray, cells: np.ndarray):
        self.low, self.width, self.cells = low, width, cells

    @classmethod
    def of(cls, values: np.ndarray, bits: int = CELL_BITS) -> "Cells":
        low = values.min(axis=0)
        width = np.maximum(np.ceil((values.max(axis=0) - low + 1) / (1 << bits)), 1.0)
        cells = np.minimum((values - low) // width, (1 << bits) - 1).astype(np.uint8)
        return cls(low, width, cells)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of the middle of every row's cells, how far off it can be) per
        query. The values are whole numbers: a cell's ends are width - 1 apart."""
        middle = self.low + self.cells * self.width + (self.width - 1) / 2
        reach = np.abs(queries) @ ((self.width - 1) / 2)
        most = np.abs(middle).max() * np.abs(queries).max() * len(self.low)
        if most < 2 ** 22:                  # halves that float32 holds exactly
            return queries.astype(np.float32) @ middle.astype(np.float32).T, reach
        # what rounding can add is far below one score unit in the exact range
        return queries @ middle.T, reach + 1.0 + most * len(self.low) * 2.0 ** -50


def _write_cells(block_rows: int):
    def run(batches):
        for dim, values, rows, ids in _blocks(batches, block_rows):
            file = Cells.of(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32())] + [pa.array([a.tobytes()], pa.binary()) for a in (
                    rows, ids, file.low, file.width, file.cells)],
                ["dim", "rows", "ids", "low", "width", "cells"])
    return run


def _write_queries(query_rows: int):
    def run(batches):
        for dim, values, numbers, ids, least in _blocks(batches, query_rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32())] + [pa.array([a.tobytes()], pa.binary()) for a in (
                    numbers, ids, least, values)], ["dim", "q_numbers", "q_ids", "q_least", "q_vals"])
    return run


def _scan(k: int, seeds: bool):
    """Meetings of a block of cells and a block of queries. With ``seeds`` the k
    best lower bounds (query, row, lower); else the rows that may be results
    (query, row, upper)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, ids, low, width, cells, numbers, q_ids, least, vals in zip(
                    *(c.to_pylist() for c in batch.columns)):
                rows, ids, numbers, q_ids = (np.frombuffer(a, np.int64)
                                             for a in (rows, ids, numbers, q_ids))
                file = Cells(np.frombuffer(low), np.frombuffer(width),
                             np.frombuffer(cells, np.uint8).reshape(-1, dim))
                middle, reach = file.bounds(np.frombuffer(vals).reshape(-1, dim))
                for q in np.flatnonzero(np.isin(q_ids, ids)):
                    middle[q, ids == q_ids[q]] = -np.inf
                at = min(k, len(ids))
                # the k-th best middle less its reach is the k-th best lower bound
                kth = np.partition(middle, len(ids) - at, axis=1)[:, len(ids) - at]
                if seeds:
                    low_end = kth
                else:
                    # a block without k rows says nothing of the k-th
                    known = kth - reach if at == k else np.full(len(q_ids), -np.inf)
                    low_end = np.maximum(known, np.frombuffer(least)) - reach
                q, r = np.nonzero((middle >= low_end[:, None]) & (middle > -np.inf))
                bound = middle[q, r] + (-reach[q] if seeds else reach[q])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[q]), pa.array(rows[r]), pa.array(bound, pa.float64())],
                    ["q", "row", "bound"])
    return run


def met(asked: DataFrame, cells: DataFrame, numbers: DataFrame, query_rows: int) -> DataFrame:
    """Each block of ``asked`` (v, q, id, least) beside each block of cells in
    ``numbers`` (dim, block) with vectors of its length."""
    packed = asked.select("v", "q", "id", "least").mapInArrow(
        _write_queries(query_rows),
        "dim int, q_numbers binary, q_ids binary, q_least binary, q_vals binary")
    visits = packed.join(sized_broadcast(numbers, size=16 * numbers.count()), "dim").drop("dim")
    return cells.hint("merge").join(visits, "block").select(
        "dim", "rows", "ids", "low", "width", "cells", "q_numbers", "q_ids", "q_least", "q_vals")


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products row by row; beyond double's exact range in whole
    numbers."""
    if np.abs(left).max() * np.abs(right).max() * left.shape[1] < 2 ** 53:
        return np.einsum("ij,ij->i", left, right).astype(np.int64)
    return np.array([max(-_LIMIT - 1, min(_LIMIT, sum(int(a) * int(b) for a, b in zip(x, y))))
                     for x, y in zip(left, right)], np.int64)


def fetch(wanted: DataFrame, exact: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, query_id, id, score) of the pairs (q, row): the exact vectors of these
    rows and no others meet their queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = np.asarray(pc.list_value_length(batch.column(3)))
            score = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                left, right = (batch.column(c).take(pa.array(at)).flatten()
                               .to_numpy(zero_copy_only=False).reshape(-1, dim) for c in (3, 4))
                score[at] = exact_scores(left, right)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)],
                                             ["q", "query_id", "id", "score"])

    pairs = (wanted.select("q", "row").join(exact, "row")
             .join(asked.select("q", F.col("id").alias("query_id"), F.col("v").alias("q_v")), "q"))
    return pairs.select("q", "query_id", "id", "q_v", "v").mapInArrow(
        run, "q long, query_id long, id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id",
          vec_col: str = "embedding", k: int = K, block_rows: int = BLOCK_ROWS,
          query_rows: int = QUERY_ROWS, seed_blocks: int = SEED_BLOCKS) -> DataFrame:
    """(query_id, rank, id, score): each query's k best rows of ``vectors``."""
    def rows_of(df):
        return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
                .filter(usable(F.col("v")) & F.col("id").isNotNull())
                .withColumn("v", quantised(F.col("v"))))

    exact = materialise(first_copies(rows_of(vectors), k)
                        .withColumn("row", F.monotonically_increasing_id()), "topk-exact")
    cells = materialise(
        exact.select("v", "row", "id").mapInArrow(
            _write_cells(block_rows),
            "dim int, rows binary, ids binary, low binary, width binary, cells binary")
        .withColumn("block", F.monotonically_increasing_id()), "topk-cells")
    asked = materialise(rows_of(queries).dropDuplicates()
                        .withColumn("q", F.monotonically_increasing_id()), "topk-queries")

    numbers = cells.select("dim", "block")
    early = Window.partitionBy("dim").orderBy("block")
    seeds = (numbers.withColumn("n", F.row_number().over(early))
             .filter(F.col("n") <= seed_blocks).select("dim", "block"))
    unknown = F.lit(float("-inf"))
    low = Window.partitionBy("q").orderBy(F.col("bound").desc())
    least = (met(asked.withColumn("least", unknown), cells, seeds, query_rows)
             .mapInArrow(_scan(k, True), "q long, row long, bound double")
             .withColumn("n", F.row_number().over(low)).filter(F.col("n") == k)
             .select("q", F.col("bound").alias("least")))
    known = asked.join(least, "q", "left").withColumn("least", F.coalesce("least", unknown))

    high = Window.partitionBy("q").orderBy(F.col("bound").desc(), "row")
    bounded = materialise(
        met(known, cells, numbers, query_rows)
        .mapInArrow(_scan(k, False), "q long, row long, bound double")
        .withColumn("place", F.row_number().over(high)), "topk-bounds")
    first = materialise(fetch(bounded.filter(F.col("place") <= 2 * k), exact, asked), "topk-first")
    best = Window.partitionBy("q").orderBy(F.col("score").desc())
    certain = (first.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k)
               .select("q", F.col("score").alias("kth")))
    rest = (bounded.filter(F.col("place") > 2 * k).join(certain, "q")
            .filter(F.col("bound") >= F.col("kth")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return (first.unionByName(fetch(rest, exact, asked))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))
