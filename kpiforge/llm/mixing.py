"""Mix sources to target weights by fitting each source's word budget exactly.

1. Sizes are counted per (source, exact length) - one pre-aggregated table.
2. Each source's target is its weight's share of all words, stopped at
   ``max_copies`` times its size; the excess is reshared by weight until no
   target is above its stop.
3. A target is whole copies of the source plus a remaining budget. Per source,
   the remaining budget is fitted on the length counts alone: every length
   first gives its proportional share of documents, then a bounded-knapsack
   (subset-sum) fit over the counts that are left comes as close to the budget
   as any subset with that start can (ties: below it), whatever the lengths.
4. The number of documents that a length gives is turned into a threshold on a
   seeded hash of the identifier: within a (source, length) group the documents
   with the smallest (hash, identifier) are taken. The threshold is found from
   counts of about sqrt(n) hash ranges and a ranking of the one range it falls
   into, so no group, however large, is ranked in one task.

The decision for a row is a join with one row per (source, length); a hot pair
is split by the adaptive skew join.

Defined results: a null text has size 0 and null is a source of its own, last
in order. Documents of size 0 and sources without words get target 0 and 0
taken words. Repeated rows with one identifier, size and source share one hash:
they are taken or left together. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import SPACE_RUN, materialise, without

WEIGHTS = (1.0, 2.0, 3.0)
MAX_COPIES = 3
# The dynamic program's table has this many sums at most (a bit each); a larger
# rest is filled greedily first and, if that is not exact, fitted by halves.
DP_SUMS = 1 << 17


def word_count(text: Column) -> Column:
    """Number of runs without white space; null counts 0."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "))
    spaces = F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(flat == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Rows (source, ...) with ``rank`` from 0 in code point order, null last.
    Counts per partition of a range sort give the offsets: no single task sees
    all sources."""
    ordered = sources.orderBy(F.col("source").asc_nulls_last())
    numbered = materialise(ordered.withColumn("__id", F.monotonically_increasing_id())
                           .withColumn("__p", F.shiftright("__id", 33)), "mix-sources")
    parts = {r["__p"]: r["n"] for r in numbered.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    offset, at = {}, 0
    for p in sorted(parts):
        offset[p], at = at, at + parts[p]
    pairs = numbered.sparkSession.createDataFrame(list(offset.items()) or [(0, 0)],
                                                  "__p long, __o long")
    # one row per partition of the sort: a proven bound
    return (numbered.join(F.broadcast(pairs), "__p")
            .withColumn("rank", F.col("__o") + F.col("__id").bitwiseAND((1 << 33) - 1))
            .drop("__id", "__p", "__o"))


def with_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS,
                 max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) -> plus ``target``. Each round fixes every source
    whose share is above its stop; only sums come to the driver."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    table = ranked_sources(sources).withColumn("w", weight)
    table = table.withColumn("stop", F.col("source_size").cast("double") * max_copies)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # share per unit of weight; a source is stopped where w * level > stop
    level = 0.0
    while True:
        stopped = F.col("stop") < F.col("w") * level
        row = table.agg(F.sum(F.when(stopped, F.col("stop")).otherwise(0.0)).alias("fixed"),
                        F.sum(F.when(stopped, 0.0).otherwise(F.col("w"))).alias("free"),
                        F.count_if(stopped).alias("n")).first()
        if not row["free"]:
            break
        grown = (total - row["fixed"]) / row["free"]
        if grown <= level:
            break
        level = grown
    return (table.withColumn("target", F.least(F.col("stop"), F.col("w") * F.lit(level)))
            .select("source", "source_size", "target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their sizes sum as
    close to ``budget`` as any subset with the proportional start can."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    start = np.array([int(c) * budget // total if total else 0 for c in counts], np.int64)
    rest = budget - int((lengths * start).sum())
    left = counts - start
    if rest <= DP_SUMS:
        return start + _by_table(lengths, left, rest)
    # greedy from the longest down until the rest fits the table: best if exact
    more, open_ = np.zeros_like(start), rest
    for i in np.argsort(-lengths, kind="stable"):
        if open_ <= DP_SUMS:
            break
        length = int(lengths[i])
        n = min(int(left[i]), (open_ - DP_SUMS + length - 1) // length, open_ // length)
        more[i] = n
        open_ -= n * length
    if open_ <= DP_SUMS:
        more += _by_table(lengths, left - more, open_)
    if int((lengths * more).sum()) != rest:
        more = _by_halves(lengths, left, rest)
    return start + more


def _items(lengths: np.ndarray, left: np.ndarray, rest: int) -> list[tuple[int, int]]:
    """(index, number): each length's documents in powers of two. Sums above
    twice the rest are further away than no document at all."""
    items = []
    for i in np.argsort(lengths, kind="stable"):
        n, size = min(int(left[i]), 2 * rest // int(lengths[i])), 1
        while n > 0:
            items.append((int(i), min(size, n)))
            n -= items[-1][1]
            size *= 2
    return items


def _by_table(lengths: np.ndarray, left: np.ndarray, rest: int) -> np.ndarray:
    """Bounded knapsack: bit s of a row says that sum s can be reached with the
    items so far."""
    take = np.zeros_like(left)
    if rest <= 0:
        return take
    full = (1 << (2 * rest + 1)) - 1
    rows, items, reach = [1], [], 1
    for i, k in _items(lengths, left, rest):
        grown = (reach | reach << (k * int(lengths[i]))) & full
        if grown != reach:
            items.append((i, k))
            rows.append(grown)
            reach = grown
        if reach >> rest & 1:
            break
    at = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    if above:
        over = (above & -above).bit_length()
        at = rest + over if over < rest - at else at
    for (i, k), before in zip(reversed(items), reversed(rows[:-1])):
        if not before >> at & 1:
            take[i] += k
            at -= k * int(lengths[i])
    return take


def _by_halves(lengths: np.ndarray, left: np.ndarray, rest: int) -> np.ndarray:
    """The same for any rest. From a greedy choice, items are documents to add
    or to put back; they are dealt into two halves, each with the sorted sums
    it reaches, and the best pair of sums is looked up. Ends with all items or
    at a sum that nothing can beat."""
    take, gap = np.zeros_like(left), rest
    for i in np.argsort(-lengths, kind="stable"):
        take[i] = min(int(left[i]), gap // int(lengths[i]))
        gap -= int(take[i] * lengths[i])
    some = (left > 0) & (lengths <= 2 * rest)
    step = int(np.gcd.reduce(lengths[some])) if some.any() else 1
    below = rest % step
    least = min(below, step - below)
    add = _items(lengths, left - take, rest)
    back = [(i, -n) for i, n in _items(lengths, take, rest)]
    common = min(len(add), len(back))
    items = [x for pair in zip(add, back) for x in pair] + add[common:] + back[common:]
    sums = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
    made: list[list] = [[], []]
    looked, best = 0, (gap, False, 0, 0)
    for k, (i, n) in enumerate(items):
        half = 0 if len(sums[0]) <= len(sums[1]) else 1
        new = np.setdiff1d(sums[half] + n * int(lengths[i]), sums[half], assume_unique=True)
        made[half].append((i, n, np.sort(new)))
        sums[half] = np.union1d(sums[half], new)
        size = len(sums[0]) + len(sums[1])
        if size < 2 * looked and k + 1 < len(items):
            continue
        looked, (a, b) = size, sums
        above = np.searchsorted(b, gap - a, "right")
        for at in (above - 1, above):
            ok = (at >= 0) & (at < len(b))
            if ok.any():
                x, y = a[ok], b[at[ok]]
                j = int(np.argmin(np.abs(x + y - gap)))
                total = int(x[j] + y[j])
                best = min(best, (abs(total - gap), total > gap, int(x[j]), int(y[j])))
        if best[0] == least and not (best[1] and below == least):
            break
    for half, at in enumerate(best[2:]):
        # a sum first reached with an item is reached without it before
        for i, n, new in reversed(made[half]):
            j = int(np.searchsorted(new, at))
            if j < len(new) and new[j] == at:
                take[i] += n
                at -= n * int(lengths[i])
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    source_size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    copies, take = 0, np.zeros(len(pdf), np.int64)
    if source_size > 0:
        budget = int(round(target))
        copies = budget // source_size
        some = lengths > 0
        take[some] = fit_budget(lengths[some], counts[some], budget - copies * source_size)
    return pdf.assign(copies=copies, take=take)


def _join(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on equal names where null meets null; the names come from ``a``."""
    other = b.withColumnsRenamed({n: f"__r_{n}" for n in names})
    # columns that both have besides are the same by construction
    other = other.drop(*[c for c in b.columns if c in a.columns and c not in names])
    on = [F.col(n).eqNullSafe(F.col(f"__r_{n}")) for n in names]
    return a.join(other, on, how).drop(*[f"__r_{n}" for n in names])


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights: Sequence[float] = WEIGHTS,
                max_copies: int = MAX_COPIES, seed: int = 17,
                carry: Sequence[str] | None = None) -> DataFrame:
    """``df`` (its columns ``carry``, default all) with ``size``, ``source_size``, ``target`` and ``taken`` (words
    the mix takes; ``taken / size`` is the document's number of copies)."""
    result = ("size", "source_size", "target", "taken")
    rows = without(df, set(result) - {id_col, text_col, source_col})
    carried = [c for c in rows.columns if carry is None or c in carry]
    # texts are looked at once: what is returned is written with the sizes, its
    # columns in one so that no name can clash
    sized = materialise(rows.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("whole"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
        F.col(id_col).alias("id")), "mix-rows")
    small = sized.drop("whole")
    key = ["source", "size"]
    counts = small.groupBy(*key).agg(F.count("*").alias("n"))
    per = with_targets(small.groupBy("source").agg(F.sum("size").alias("source_size")),
                       weights, max_copies)
    hist = _join(counts, per, ["source"])
    schema = T.StructType(list(hist.schema.fields) + [T.StructField("copies", T.LongType()),
                                                      T.StructField("take", T.LongType())])
    fitted = materialise(hist.groupBy("source").applyInPandas(_fit_source, schema), "mix-fitted")

    # threshold per (source, size) that gives some but not all of its rows
    some = fitted.filter("take > 0 and take < n").select(*key, "n", "take")
    unit = (F.col("h").cast("double") / F.lit(2.0 ** 64)) + 0.5
    ranges = F.ceil(F.sqrt(F.col("n").cast("double")))
    inside = (_join(small, some, key)
              .select(*key, "h", "id", "take", F.least(F.floor(unit * ranges), ranges - 1).alias("b")))
    upto = Window.partitionBy(*key).orderBy("b")
    cut = (inside.groupBy(*key, "b", "take").agg(F.count("*").alias("c"))
           .withColumn("cum", F.sum("c").over(upto))
           .filter("cum >= take and cum - c < take")
           .select(*key, "b", (F.col("take") - (F.col("cum") - F.col("c"))).alias("need")))
    by_hash = Window.partitionBy(*key).orderBy("h", F.col("id").asc_nulls_first())
    edge = (_join(inside, cut, [*key, "b"])
            .withColumn("r", F.row_number().over(by_hash)).filter("r = need")
            .select(*key, F.col("h").alias("h_max"), F.col("id").alias("id_max")))
    edge = materialise(edge, "mix-thresholds")
    plan = (_join(fitted, edge, key, "left")
            .select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("n"),
                    "source_size", "target", "copies", "take", "h_max", "id_max"))
    below = (F.col("h") < F.col("h_max")) | ((F.col("h") == F.col("h_max")) & F.coalesce(
        F.col("id") <= F.col("id_max"), F.col("id").isNull()))
    more = (F.when(F.col("take") >= F.col("n"), F.lit(1))
            .when(F.col("take") <= 0, F.lit(0))
            .otherwise(F.coalesce(below.cast("int"), F.lit(0))))
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source"))
                        & (F.col("size") == F.col("p_size")))
    return joined.select(*[F.col(f"whole.`{c}`") for c in carried], "size", "source_size", "target",
                         (F.col("size") * (F.col("copies") + more)).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as the mix takes it."""
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    whole = F.struct(*[F.col(f"`{c}`") for c in mixed.columns]).alias("whole")
    return (mixed.select(whole, copies.alias("copies")).filter("copies > 0")
            .select("whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*"))
