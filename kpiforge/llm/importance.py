"""Importance resampling towards a target distribution, drawn by a parallel
sort with regular sampling.

1. Every text becomes the array of its features' hash buckets (runs of words,
   crc32 modulo ``buckets``), written once. Bucket counts of documents and of
   target texts are arrays of a fixed length, summed over tasks.
2. A bucket's gain is the scaled log ratio of its smoothed shares in target and
   documents; a document's weight is the sum of its features' gains, its score
   the weight plus seeded Gumbel noise, so the highest scores are a sample
   without replacement.
3. The draw: each partition sorts its scores (a run) and gives regular samples
   of it; the sorted samples give regular splitters, splitters cut all runs into
   segments, segments of one range are exchanged and merged in one task, and
   prefix counts of the ranges turn places in a range into ranks. Only ranges
   that can hold a drawn document are exchanged. The run and place of a row end
   the sort key, so equal scores and repeated rows of any number are cut too.

Sizes outside the data: ``buckets`` gains (sent to the tasks), about
``2 * SAMPLES`` samples for each shuffle partition and one count for each range
(on the driver). The data themselves never pass the driver.

Defined results: a null or empty text has no features and weight 0. A document
without identifier has no noise: its score and rank are null and it does not
count as a candidate. Repeated rows are candidates each and tie in an order of
their own. Documents under ``least_words`` words get a score but no rank. An
empty target leaves all shares to the smoothing; an empty table gives an empty
result. Only identifier and text are read, so no other column can clash.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise, text_slices

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
# Regular samples for each range of the parallel sort.
SAMPLES = 32
MEMO_WORDS = 150_000
MEMO_BYTES = 64

# Words are runs of digits, lower-cased letters and everything beyond ASCII.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
               for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


class Bucketer(dict):
    """Word -> bucket; short words are remembered, bounded."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        at = crc32(word) % self.buckets
        if len(word) <= MEMO_BYTES:
            self[word] = at
        return at

    def of(self, words: list[bytes], shortest: int, longest: int) -> np.ndarray:
        """Buckets of all runs of ``shortest`` to ``longest`` words."""
        if len(self) > MEMO_WORDS:
            self.clear()
        out = []
        for n in range(shortest, longest + 1):
            count = max(0, len(words) - n + 1)
            runs = (map(self.__getitem__, words) if n == 1 else
                    (crc32(b" ".join(words[i:i + n])) % self.buckets for i in range(count)))
            out.append(np.fromiter(runs, np.uint32, count))
        return np.concatenate(out)


def features(df: DataFrame, id_col: str | None, text_col: str, shortest: int, longest: int,
             buckets: int) -> DataFrame:
    """(id, n_words, n_features, buckets as packed numbers) of every row."""
    kind = np.min_scalar_type(buckets - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucketer = Bucketer(buckets)
        for part in text_slices(batches, "text"):
            n_words, found = [], []
            for text in part.column(1).to_pylist():
                words = words_of(text)
                n_words.append(len(words))
                found.append(bucketer.of(words, shortest, longest).astype(kind))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words, pa.int64()),
                 pa.array([len(f) for f in found], pa.int64()),
                 pa.array([f.tobytes() for f in found], pa.binary())],
                ["id", "n_words", "n_features", "at"])

    ident = F.lit(0) if id_col is None else F.col(id_col)
    src = df.select(ident.alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType),
                           T.StructField("n_words", T.LongType()),
                           T.StructField("n_features", T.LongType()),
                           T.StructField("at", T.BinaryType())])
    return src.mapInArrow(run, schema)


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: a fixed array per task, summed by Spark."""
    kind = np.min_scalar_type(buckets - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_py(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])],
                                         ["bucket", "n"])

    rows = (found.select("at").mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio of the smoothed shares) of each bucket."""
    all_own, all_wanted, n = float(own.sum()), float(wanted.sum()), len(own)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_own + n) / ((s + 1.0) * (all_wanted + n))))
                     for s, t in zip(own.tolist(), wanted.tolist())], np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): gains summed by array look-ups."""
    kind = np.min_scalar_type(len(gain) - 1)
    shipped = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shipped.value
        for batch in batches:
            total = [int(gain[np.frombuffer(p.as_py(), kind)].sum()) for p in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total, pa.int64())],
                                             ["id", "n_words", "n_features", "weight"])

    schema = T.StructType([*found.schema.fields[:3], T.StructField("weight", T.LongType())])
    return found.mapInArrow(run, schema)


def noise(id_col: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from the identifier's seeded sha256."""
    key = F.concat(F.lit(f"{seed}:"), id_col.cast("string"))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _segments(splitters: list[tuple]):
    """Rows (id, score, row) -> with the number of splitters before them."""
    low = np.array([-s[0] for s in splitters], np.int64)
    keys = [(-s[0], *s[1:]) for s in splitters]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = -batch.column(1).to_numpy(zero_copy_only=False)
            first = np.searchsorted(low, score, "left")
            last = np.searchsorted(low, score, "right")
            for i in np.flatnonzero(first != last):   # the score of a splitter: the whole key
                key = (int(score[i]), batch.column(0)[i].as_py(), batch.column(2)[i].as_py())
                first[i] = bisect_left(keys, key, int(first[i]), int(last[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int64())],
                                             [*batch.schema.names, "range"])
    return run


def ranked(runs: DataFrame, wanted: int, ranges: int, n: int) -> DataFrame:
    """(row, rank) of the first ``wanted`` of ``n`` rows (id, score, row) that
    are sorted within their runs: by score from the highest, then by id, then
    by run and place (both in ``row``, as Spark numbers rows)."""
    step = max(1, n // (ranges * SAMPLES))
    place = F.col("row").bitwiseAND((1 << 33) - 1)
    start = F.pmod(F.xxhash64(F.shiftright("row", 33)), F.lit(step))
    order = [F.col("score").desc(), F.col("id"), F.col("row")]
    samples = runs.filter(F.pmod(place + start, F.lit(step)) == 0).orderBy(*order).collect()
    splitters = [(r["score"], r["id"], r["row"]) for r in samples[SAMPLES - 1::SAMPLES]]
    schema = T.StructType([*runs.schema.fields, T.StructField("range", T.LongType())])
    cut = runs.mapInArrow(_segments(splitters), schema)
    sizes = {r["range"]: r["n"] for r in cut.groupBy("range").agg(F.count("*").alias("n")).collect()}
    offsets, before = [], 0
    for k in sorted(sizes):
        if before >= wanted:
            break
        offsets.append((k, before))
        before += sizes[k]
    shift = runs.sparkSession.createDataFrame(offsets, "range long, before long")
    # one row for each range: a bound set by the number of partitions
    met = cut.join(F.broadcast(shift), "range")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return (met.withColumn("rank", F.col("before") + place.cast("long"))
            .filter(F.col("rank") <= wanted).select("row", "rank"))


def importance_resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id",
                        text_col: str = "text", target_text: str = "text", shortest: int = 1,
                        longest: int = 1, buckets: int = BUCKETS, seed: int = SEED,
                        least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``df``; the drawn
    ``percent`` of the candidates have ranks 1, 2, 3, ..."""
    spark = df.sparkSession
    found = materialise(features(df, id_col, text_col, shortest, longest, buckets), "features")
    gain = gains(bucket_counts(found, buckets),
                 bucket_counts(features(target, None, target_text, shortest, longest, buckets), buckets))
    scored = (weights(found, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
              .withColumn("open", (F.col("n_words") >= least_words) & F.col("score").isNotNull()))
    runs = materialise(
        scored.sortWithinPartitions(F.col("open").desc(), F.col("score").desc(), "id")
        .withColumn("row", F.monotonically_increasing_id()).drop("n_words"), "score-runs")
    open_ = runs.filter("open")
    n = open_.count()
    out = runs.select("row", F.col("id").alias(id_col), "n_features", "weight", "score")
    wanted = percent * n // 100
    if not wanted:
        return out.drop("row").withColumn("rank", F.lit(None).cast("long"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = materialise(ranked(open_.select("id", "score", "row"), wanted, ranges, n), "drawn")
    return out.join(drawn, "row", "left").drop("row")
