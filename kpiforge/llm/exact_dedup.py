"""Exact dedup by content sort.

Texts are normalised, range-partitioned by sampled splitters on their leading
bytes (then digest, then identifier), sorted externally inside each partition,
and every row is compared in full with its neighbour. A group of copies of any
size is cut by the identifier part of the key, so no task has to hold it; runs
that cross a border of partitions or Arrow batches are stitched afterwards from
one row per border run (at most two per batch).

Defined results: a null text counts as empty and a null identifier sorts last,
so it stays only if its whole group has none. Of repeated rows with one
identifier exactly one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_RUN, added, materialise, without

RESULT = ("keep_id", "group_size", "kept", "text_sha256")
# Bytes of text in a splitter: the driver's sample of splitters stays small
# however long texts are; the digest orders texts that share these bytes.
SPLITTER_CHARS = 64
_NORM, _EDGE, _PART, _RUN, _HEAD = "__norm", "__edge", "__part", "__run", "__head"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _mark_runs(id_col: str):
    """Arrow iterator over one sorted partition: rows with their run's first
    identifier and length inside the batch. Nothing of a batch is held: runs
    that go on in the next batch are stitched like those that go on in the
    next partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        for at, rows in enumerate(b for b in batches if b.num_rows):
            n = rows.num_rows
            text = rows.column(rows.schema.get_field_index(_NORM))
            new = np.ones(n, bool)
            new[1:] = ~pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, n))
            runs = np.repeat(np.arange(len(starts)), sizes)
            border = new & ((runs == 0) | (runs == len(starts) - 1))
            names = [c for c in rows.schema.names if c != _NORM]
            edge = text.take(pa.array(np.arange(n), mask=~border))
            ids = rows.column(rows.schema.get_field_index(id_col))
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index(c)) for c in names]
                + [ids.take(pa.array(np.repeat(starts, sizes))), pa.array(np.repeat(sizes, sizes)),
                   pa.array(new), pa.array(np.full(n, part + at)), pa.array(runs), edge],
                names + ["keep_id", "group_size", _HEAD, _PART, _RUN, _EDGE])

    return run


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: list[str] | None = None) -> DataFrame:
    """All rows of ``df`` (with the columns ``carry``, default all) with
    ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (of the
    normalised text)."""
    id_type = df.schema[id_col].dataType
    rows = without(df, {*RESULT, _NORM, _EDGE, _PART, _RUN, _HEAD} - {id_col, text_col})
    carried = [c for c in rows.columns if carry is None or c in carry or c == id_col]
    rows = (rows.withColumn(_NORM, normalised(F.col(text_col)))
            .withColumn("text_sha256", F.sha2(F.col(_NORM).cast("binary"), 256))
            .select(*carried, _NORM, "text_sha256"))
    key = [F.substring(_NORM, 1, SPLITTER_CHARS), F.col("text_sha256"),
           F.col(id_col).asc_nulls_last()]
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    schema = added(ordered.drop(_NORM), ("keep_id", id_type), ("group_size", T.LongType()),
                   (_HEAD, T.BooleanType()), (_PART, T.LongType()), (_RUN, T.LongType()),
                   (_EDGE, T.StringType()))
    # later steps read these rows twice; the sort must not run twice
    runs = materialise(ordered.mapInArrow(_mark_runs(id_col), schema), "exact-runs")
    border = runs.filter(F.col(_EDGE).isNotNull()).select(_PART, _RUN, _EDGE, "keep_id",
                                                          "group_size")
    whole = (border.groupBy(_EDGE)
             .agg(F.min("keep_id").alias("__keep"), F.sum("group_size").alias("__size"),
                  F.min(_PART).alias("__first"), F.count("*").alias("__n"))
             .filter("__n > 1").drop("__n"))
    # at most two small rows per Arrow batch; written, so that their size is
    # known when the join below is planned
    stitch = materialise(border.select(_PART, _RUN, _EDGE).join(whole, _EDGE).drop(_EDGE),
                         "exact-stitch")
    out = runs.drop(_EDGE).join(stitch, [_PART, _RUN], "left")
    return (out.withColumn("keep_id", F.coalesce("__keep", "keep_id"))
            .withColumn("group_size", F.coalesce("__size", "group_size"))
            .withColumn("kept", F.col(_HEAD)
                        & (F.col("__first").isNull() | (F.col("__first") == F.col(_PART))))
            .select(*carried, *RESULT))
