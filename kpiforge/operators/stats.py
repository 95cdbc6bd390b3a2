"""Whole-column statistics that stay distributed at any size.

Spark's exact ``percentile``/``median``/``mode`` aggregates keep a value->count
map per group; over a whole column (one global group) the final merge lands in
a single task holding every distinct value. The functions here never do that:

* ``exact_quantiles`` is a distributed selection. A bounded-size sketch
  (``percentile_approx``) brackets each wanted rank, exact ``count_if`` passes
  confirm the bracket (or find the rank on one of its ends), and only the
  values inside a bracket of at most ``final_limit`` rows are counted exactly.
  Brackets exclude their ends once those are known not to hold the rank, so a
  hot value holding a third of all rows is cut off in one round. Each pass is
  one scan with map-side partial aggregation.
* ``column_modes`` keeps bounded counters per task (Misra-Gries) and recounts
  only the values that may be the mode.

Results are small Python values (``Decimal`` for decimal columns, exact);
callers fold them into plans as literals.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import checkpoint_dir
from ..sources.tables import sized_broadcast

SKETCH_ACCURACY = 20000
# (value, count) pairs per wanted rank that the last step may bring to the driver
FINAL_LIMIT = 4_096


def _num(v):
    """Decimals stay exact; every other numeric becomes a float."""
    if v is None or isinstance(v, (Decimal, float)):
        return v
    return float(v)


def _as_type(v: float, kind: T.DataType):
    """A sketch's number as a value of the column."""
    if isinstance(kind, T.DecimalType):
        return Decimal(v).quantize(Decimal(1).scaleb(-kind.scale))
    return round(v) if isinstance(kind, T.IntegralType) else v


def interpolate(lo, hi, frac: float):
    """Linear interpolation between neighbouring order statistics
    (pandas ``quantile`` default, SQL ``percentile_cont``). Exact for
    decimals: ``frac`` is a multiple of p, a short binary fraction."""
    if frac == 0.0:
        return lo
    if isinstance(lo, Decimal):
        return lo + (hi - lo) * Decimal(frac)
    return lo + (hi - lo) * frac


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    lo = math.floor(h)
    frac = h - lo
    hi = min(lo + 1, n - 1) if frac > 0 else lo
    return lo, hi, frac


class _Target:
    """One (column, rank) to find; keeps the current bracket of values
    (open or closed at either end) and the number of rows below it."""

    def __init__(self, col: str, rank: int):
        self.col, self.rank = col, rank
        self.a = self.b = None      # bracket ends (None = unbounded)
        self.a_open = self.b_open = False
        self.below = 0              # rows with a value below the bracket
        self.inside = None          # rows inside the bracket
        self.value = None
        self.done = False

    def cond(self) -> Column:
        c = F.col(self.col)
        cond = c.isNotNull()
        if self.a is not None:
            cond = cond & ((c > F.lit(self.a)) if self.a_open else (c >= F.lit(self.a)))
        if self.b is not None:
            cond = cond & ((c < F.lit(self.b)) if self.b_open else (c <= F.lit(self.b)))
        return cond


def _first_brackets(df: DataFrame, targets: Mapping[str, Sequence[float]], accuracy: int,
                    eps: float) -> dict[str, tuple[int, list]]:
    """Column -> (non-null rows, sketch values below and above every p)."""
    first = []
    for i, (c, ps) in enumerate(targets.items()):
        probs = [x for p in ps for x in (max(0.0, p - eps), min(1.0, p + eps))]
        # one sketch per column serves all of its probabilities
        first += [F.count(F.col(c)).alias(f"n{i}"),
                  F.percentile_approx(F.col(c), probs, accuracy).alias(f"s{i}")]
    row = df.agg(*first).first()
    return {c: (int(row[f"n{i}"]), list(row[f"s{i}"] or [])) for i, c in enumerate(targets)}


def exact_quantiles(df: DataFrame, targets: Mapping[str, Sequence[float]],
                    accuracy: int = SKETCH_ACCURACY, final_limit: int = FINAL_LIMIT,
                    brackets: Mapping[str, tuple[int, Sequence[float]]] | None = None,
                    ) -> dict[str, dict[float, float | None]]:
    """Exact linear-interpolation quantiles of several columns, distributed.

    ``targets`` maps column -> probabilities. Returns column -> {p: value}
    (None for a column without non-null values). ``brackets`` (of the same rows,
    from kept sketches: ``partials.sketched_ranks``) saves the first pass;
    whatever they hold, the counts that follow make the result exact.
    """
    cols = list(targets)
    if not cols:
        return {}
    eps = 4.0 / accuracy
    for p in (p for ps in targets.values() for p in ps):
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"probability out of range: {p}")
    # Pass 1: non-null counts and a first sketch bracket around every p.
    if brackets is None:
        begin = _first_brackets(df, targets, accuracy, eps)
    else:
        begin = {c: (n, [_as_type(v, df.schema[c].dataType) for v in vs]) for c, (n, vs) in brackets.items()}

    # (column, rank) -> target; probabilities needing the same rank share it
    wanted: dict[tuple[str, int], _Target] = {}
    plan: dict[str, dict[float, tuple[int, int, float]]] = {}
    proposals: dict[int, tuple] = {}
    for c in cols:
        n, sketched = begin[c]
        plan[c] = {}
        for j, p in enumerate(targets[c]):
            if n == 0:
                continue
            lo, hi, frac = _ranks(n, p)
            plan[c][p] = (lo, hi, frac)
            for r in (lo, hi):
                if (c, r) not in wanted:
                    t = wanted[(c, r)] = _Target(c, r)
                    t.inside = n
                    proposals[id(t)] = tuple(sketched[2 * j:2 * j + 2])
    tlist = list(wanted.values())

    before = None
    while True:
        active = [t for t in tlist if not t.done]
        if not active:
            break
        # every round must narrow some bracket
        state = [(t.inside, t.below) for t in active]
        if state == before:
            raise RuntimeError("exact quantile selection did not converge")
        before = state
        if any(id(t) not in proposals for t in active):
            # Sketch again inside the current brackets, at the relative rank.
            sk = []
            for i, t in enumerate(active):
                if t.inside <= 0:
                    raise RuntimeError("quantile bracket lost its rows")
                rel = (t.rank - t.below) / max(t.inside - 1, 1)
                probs = [max(0.0, rel - eps), min(1.0, rel + eps)]
                sk.append(F.percentile_approx(F.when(t.cond(), F.col(t.col)), probs, accuracy)
                          .alias(f"s{i}"))
            srow = df.agg(*sk).first()
            proposals = {id(t): tuple(srow[f"s{i}"]) for i, t in enumerate(active)}
        # Exact counts confirm (or move) each bracket.
        cnt = []
        for i, t in enumerate(active):
            a, b = proposals[id(t)]
            c = F.col(t.col)
            base = t.cond()
            cnt += [F.count_if(base & (c < F.lit(a))).alias(f"lta{i}"),
                    F.count_if(base & (c <= F.lit(a))).alias(f"lea{i}"),
                    F.count_if(base & (c < F.lit(b))).alias(f"ltb{i}"),
                    F.count_if(base & (c <= F.lit(b))).alias(f"leb{i}")]
        crow = df.agg(*cnt).first()
        for i, t in enumerate(active):
            a, b = proposals[id(t)]
            lta, lea = int(crow[f"lta{i}"]), int(crow[f"lea{i}"])
            ltb, leb = int(crow[f"ltb{i}"]), int(crow[f"leb{i}"])
            r = t.rank - t.below           # rank inside the current bracket
            if lta <= r < lea:             # the rank holds the sketch value a
                t.value, t.done = a, True
            elif ltb <= r < leb:           # ... or b
                t.value, t.done = b, True
            elif lea <= r < ltb:           # strictly between: (a, b)
                t.a, t.a_open, t.b, t.b_open = a, True, b, True
                t.below, t.inside = t.below + lea, ltb - lea
            elif r < lta:                  # below a: keep the lower end, cut at a
                t.b, t.b_open, t.inside = a, True, lta
            else:                          # above b: cut at b, keep the upper end
                t.a, t.a_open = b, True
                t.below, t.inside = t.below + leb, t.inside - leb
            if not t.done and t.inside <= final_limit:
                t.done = True  # few enough rows (hence values) for the exact pass
        proposals = {}
    # Final exact pass: distinct values with their counts inside each bracket
    # (at most ``final_limit`` rows per target reach the driver).
    pending = [t for t in tlist if t.value is None]
    by_type: dict[str, list[int]] = {}
    for i, t in enumerate(pending):
        by_type.setdefault(df.schema[t.col].dataType.simpleString(), []).append(i)
    rows: dict[int, list[tuple[object, int]]] = {}
    for idx in by_type.values():
        # one scan per value type: each row contributes (target, value) for
        # every bracket it falls in
        tagged = F.array(*[F.when(pending[i].cond(), F.struct(
            F.lit(i).alias("t"), F.col(pending[i].col).alias("v"))) for i in idx])
        anyb = None
        for i in idx:
            anyb = pending[i].cond() if anyb is None else anyb | pending[i].cond()
        u = (df.where(anyb)
             .select(F.explode(F.filter(tagged, lambda x: x.isNotNull())).alias("p"))
             .groupBy("p.t", "p.v").count())
        for r in u.collect():
            rows.setdefault(r["t"], []).append((r["v"], int(r["count"])))
    for i, t in enumerate(pending):
        need, seen = t.rank - t.below, 0
        for v, k in sorted(rows.get(i, []), key=lambda vk: vk[0]):
            seen += k
            if seen > need:
                t.value = v
                break
        if t.value is None:
            raise RuntimeError("rank not found in the final bracket")

    out: dict[str, dict[float, float | None]] = {}
    for c in cols:
        out[c] = {}
        for p in targets[c]:
            if p not in plan[c]:
                out[c][p] = None
                continue
            lo, hi, frac = plan[c][p]
            out[c][p] = interpolate(_num(wanted[(c, lo)].value),
                                    _num(wanted[(c, hi)].value), frac)
    return out


def approx_quantiles(df: DataFrame, targets: Mapping[str, Sequence[float]],
                     accuracy: int = 100_000) -> dict[str, dict[float, float | None]]:
    """One-pass quantiles from bounded sketches (rank error <= n / accuracy),
    for when a few extra scans of a very large column are not worth exactness.
    Returns actual column values (no interpolation)."""
    cols = list(targets)
    if not cols:
        return {}
    row = df.agg(*[F.percentile_approx(F.col(c), list(targets[c]), accuracy).alias(f"q{i}")
                   for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        vals = row[f"q{i}"]
        out[c] = {p: (None if vals is None else _num(vals[j]))
                  for j, p in enumerate(targets[c])}
    return out


def quantiles(df: DataFrame, targets: Mapping[str, Sequence[float]],
              method: str = "exact") -> dict[str, dict[float, float | None]]:
    if method == "exact":
        return exact_quantiles(df, targets)
    if method == "approx":
        return approx_quantiles(df, targets)
    raise ValueError(f"unknown quantile method {method!r}")


def exact_medians(df: DataFrame, cols: Iterable[str], **kw) -> dict[str, float | None]:
    q = exact_quantiles(df, {c: [0.5] for c in cols}, **kw)
    return {c: q[c][0.5] for c in q}


# Values that one task keeps per column; a value held by more than a
# (COUNTERS + 1)-th of the rows is always among them.
COUNTERS = 4096


def merge_counters(held: dict, more: Iterable[tuple[object, int]], counters: int) -> int:
    """Misra-Gries: add ``more`` to the counters and, above their number, take
    the first count that has no place off all of them. Returns that count: how
    far every count may since be too low."""
    for v, n in more:
        held[v] = held.get(v, 0) + n
    if len(held) <= counters:
        return 0
    off = sorted(held.values(), reverse=True)[counters]
    for v in [v for v, n in held.items() if n <= off]:
        del held[v]
    for v in held:
        held[v] -= off
    return off


def heavy_hitters(df: DataFrame, cols: Sequence[str], counters: int = COUNTERS) -> DataFrame:
    """(c, v, n): per task and column its counters (null ``v``: how far the
    task's counts may be too low). Columns of one type; nulls are not counted."""
    kind = df.schema[cols[0]].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, off = [{} for _ in cols], [0] * len(cols)
        for batch in batches:
            for i, col in enumerate(batch.columns):
                some = pc.value_counts(col.drop_null())
                off[i] += merge_counters(held[i], zip(some.field(0).to_pylist(), some.field(1).to_pylist()),
                                         counters)
        for i, c in enumerate(cols):
            v, n = [None, *held[i]], [off[i], *held[i].values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(v)), pa.array(v, to_arrow_type(kind)), pa.array(n, pa.int64())], ["c", "v", "n"])

    schema = T.StructType([T.StructField("c", T.StringType()), T.StructField("v", kind),
                           T.StructField("n", T.LongType())])
    return df.select(*cols).mapInArrow(run, schema)


def _pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(c, v) of every non-null value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols])).alias("p")
    return df.select(pairs).select("p.c", "p.v").where(F.col("v").isNotNull())


def _most(counts: DataFrame) -> dict[str, tuple[object, int]]:
    """(c, v, n) -> column: (its most frequent value, the smallest on a tie; n)."""
    best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b"))
    return {r["c"]: (r["b"]["v"], -r["b"]["n"]) for r in best.collect()}


def column_modes(df: DataFrame, cols: Iterable[str], counters: int = COUNTERS) -> dict[str, object]:
    """Most frequent non-null value per column; ties -> smallest value
    (pandas ``mode()[0]``).

    One scan per value type keeps a bounded Misra-Gries summary per task and
    column; only these meet. If no task ran out of counters the sums are the
    counts. Else the values that may be the mode are counted exactly in a second
    scan, and the winner stands if it has more rows than any value that is in no
    summary can have: the shuffles then hold a few values, however many a column
    has. Only a column without such a frequent value is counted in full, with
    partial aggregation."""
    cols = list(cols)
    by_type: dict[str, list[str]] = {}
    for c in cols:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out: dict[str, object] = {c: None for c in cols}
    for group in by_type.values():
        checkpoint_dir(df.sparkSession)
        told = heavy_hitters(df, group, counters).groupBy("c", "v").agg(F.sum("n").alias("n")).checkpoint()
        off = {r["c"]: r["n"] for r in told.where("v is null").collect()}
        first = _most(told.where("v is not null"))
        out |= {c: v for c, (v, _) in first.items() if not off[c]}
        # counts may be too low by ``off``: these may still beat the first
        open_ = {c: first.get(c, (None, 0))[1] - low for c, low in off.items() if low}
        sure = [c for c, least in open_.items() if least > 0]
        if sure:
            least = F.coalesce(*[F.when(F.col("c") == c, F.lit(open_[c])) for c in sure])
            # fewer than rows / (first - off) values a column
            maybe = told.where(F.col("v").isNotNull() & (F.col("n") >= least)).select("c", "v")
            maybe = sized_broadcast(maybe, size=64 * maybe.count())
            exact = _pairs(df, sure).join(maybe, ["c", "v"]).groupBy("c", "v").agg(F.count("*").alias("n"))
            for c, (v, n) in _most(exact).items():
                if n > off[c]:
                    out[c] = v
                    open_.pop(c)
        if open_:
            counts = _pairs(df, list(open_)).groupBy("c", "v").agg(F.count("*").alias("n"))
            out |= {c: v for c, (v, _) in _most(counts).items()}
    return out


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column -> null_count for every column, one aggregate pass (lazy)."""
    cols = list(cols or df.columns)
    agg = df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in cols])
    return agg.unpivot([], cols, "column", "null_count")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Only the columns that have nulls (the reference's missing-value report)."""
    return null_counts(df, cols).where(F.col("null_count") > 0)
