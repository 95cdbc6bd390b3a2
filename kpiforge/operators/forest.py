"""Random regression forest of many rows and few values.

Trees grow level by level, every tree at once: one pass over the training rows
adds up, for each open node, the rows and labels of every value of every
column; the sums of all tasks meet by tree and node, where the best split is
looked up. Nothing is sampled but the bootstrap itself: a row counts
Poisson(1) times in a tree, as in Spark ML.

What keeps a pass cheap:

* A row is a few joint codes. Columns with few values share one code (their
  values' product bounded by ``JOINT_CELLS``), so a row is added once per joint
  code and not once per feature; sums per column follow from those of the codes.
  A one-hot feature is one value of its column.
* The node of a row is found by looking its codes up in tables of the tree:
  each holds, per code, the nodes that are still possible, and their
  intersection is the node. Only levels below the sixth are walked step by step.
* Bootstrap counts are drawn anew in each pass, from (seed, tree, part, block).
  Rows come in a fixed order (``blocks``), so a model depends neither on
  cores nor on the order of tasks.

Splits, stopping and importances are Spark ML's: the largest drop of the
variance wins (the first feature and value if tied), a node without any drop is
a leaf, ``x <= threshold`` goes left. Spark sums a feature's values one by one,
so exact ties between features fall there to rounding. The result is a
``RandomForestRegressionModel``, read from files in Spark's own format. The
variance of leaves at the full depth is not measured: their impurity is NaN.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch_path
from .stats import exact_quantiles

JOINT_CELLS = 512
BLOCK_ROWS = 1 << 16
# Nodes of one tree whose sums meet in one place.
CHUNK = 16
# Sums that a task holds at a time.
TASK_BYTES = 256 << 20
# A column with more values is cut at quantiles found without listing them.
LISTED_VALUES = 1 << 16
# Levels found by lookup: their nodes are the bits of a word.
LOOKUP_DEPTH = 6


# --------------------------------------------------------------------------
# Codes
# --------------------------------------------------------------------------

def edges_of(counts: Sequence[tuple[float, int]], max_bins: int) -> list[float]:
    """Thresholds between the (value, rows) of a column: between all neighbours
    if there are at most ``max_bins`` values, else near equal shares of rows."""
    between = [(a + b) / 2 for (a, _), (b, _) in zip(counts, counts[1:])]
    if len(between) < max_bins:
        return between
    stride = sum(n for _, n in counts) / max_bins
    edges, target, total = [], stride, counts[0][1]
    for mid, (_, n) in zip(between, counts[1:]):
        if abs(total - target) < abs(total + n - target):
            edges.append(mid)
            target += stride
        total += n
    return edges


def bin_edges(rows: DataFrame, cols: Sequence[str], max_bins: int) -> dict[str, list[float]]:
    """Thresholds of numeric columns, from the counts of all rows' values."""
    if not cols:
        return {}
    distinct = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    listed = [c for c in cols if distinct[c] <= LISTED_VALUES]
    counts = {c: [] for c in listed}
    if listed:
        found = None
        for c in listed:
            one = (rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
                   .select(F.lit(c).alias("c"), "v", "n"))
            found = one if found is None else found.unionByName(one)
        for c, v, n in found.collect():
            counts[c].append((v, n))
    out = {c: edges_of(sorted(v), max_bins) for c, v in counts.items()}
    many = [c for c in cols if c not in counts]
    if many:
        shares = [k / max_bins for k in range(1, max_bins)]
        cuts = exact_quantiles(rows, {c: shares for c in many})
        out |= {c: sorted(set(cuts[c].values())) for c in many}
    return out


@dataclass
class Layout:
    """Columns' values (``sizes``; the first ``numeric`` ones are ordered) and
    how columns share joint codes."""
    sizes: list[int]
    numeric: int
    groups: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        cells = []
        for c in sorted(range(len(self.sizes)), key=lambda c: -self.sizes[c]):
            g = next((g for g, n in enumerate(cells) if n * self.sizes[c] <= JOINT_CELLS), None)
            if g is None:
                self.groups.append([c])
                cells.append(self.sizes[c])
            else:
                self.groups[g].append(c)
                cells[g] *= self.sizes[c]
        self.cells = cells
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(int)
        self.group_of = {c: g for g, cols in enumerate(self.groups) for c in cols}
        self.dtype = np.dtype("<u2") if max(cells, default=1) <= 1 << 16 else np.dtype("<u4")
        # Candidate splits in the order of the features: column, values that go
        # right, feature, and which of its thresholds.
        self.splits, feature = [], 0
        for c, n in enumerate(self.sizes):
            if c < self.numeric:
                self.splits += [(c, b + 1, n - 1, feature, b) for b in range(n - 1)]
                feature += 1
            else:       # the last value is that of no level
                self.splits += [(c, v, v, feature + v, 0) for v in range(n - 1)]
                feature += n - 1
        self.features = feature

    @property
    def bins(self) -> int:
        return int(self.starts[-1])

    def join(self, columns: Sequence[np.ndarray]) -> list[np.ndarray]:
        out = []
        for cols in self.groups:
            code = np.zeros(len(columns[cols[0]]), np.int64)
            for c in cols:
                code = code * self.sizes[c] + columns[c]
            out.append(code.astype(self.dtype))
        return out

    def values(self, c: int) -> np.ndarray:
        """The value of column ``c`` in each code of its group."""
        g = self.group_of[c]
        cols = self.groups[g]
        stride = math.prod(self.sizes[d] for d in cols[cols.index(c) + 1:])
        return np.arange(self.cells[g]) // stride % self.sizes[c]

    def per_column(self, sums: list[np.ndarray], nodes: int) -> np.ndarray:
        """Sums per node and column value, from those per node and joint code."""
        out = np.empty((nodes, self.bins), complex)
        for cols, s in zip(self.groups, sums):
            cube = s.reshape(-1, *[self.sizes[c] for c in cols])[:nodes]
            for i, c in enumerate(cols):
                others = tuple(j + 1 for j in range(len(cols)) if j != i)
                out[:, self.starts[c]:self.starts[c + 1]] = cube.sum(axis=others)
        return out


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    v = batch.column(name)
    x = v.to_numpy(zero_copy_only=False)
    if v.null_count or np.isnan(x).any():
        raise ValueError(f"null or NaN in {name}")
    return x


def columns_of(batch: pa.RecordBatch, numeric: Sequence[str], levels: Sequence[str],
               edges: Sequence[Sequence[float]]) -> list[np.ndarray]:
    """The values' numbers of each column: how many thresholds lie below, or the level."""
    return ([np.searchsorted(np.array(e, float), _numbers(batch, n), side="left") for e, n in zip(edges, numeric)]
            + [_numbers(batch, n).astype(np.int64) for n in levels])


def blocks(train: DataFrame, row_id: str, label: str, layout: Layout, edges: Sequence[Sequence[float]],
           numeric: Sequence[str], levels: Sequence[str], parts: int, centre: float, scale: float) -> DataFrame:
    """(part, block, codes, labels): the rows dealt by the hash of their id and
    sorted, as joint codes and scaled labels of ``BLOCK_ROWS`` rows each."""
    names = [f"g{g}" for g in range(len(layout.groups))]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = layout.join(columns_of(b, numeric, levels, edges))
            y = (_numbers(b, label) - centre) / scale
            yield pa.RecordBatch.from_arrays(
                [b.column(row_id), *[pa.array(j.astype(np.int32)) for j in codes], pa.array(y)], ["id", *names, "y"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def cut(table: pa.Table) -> pa.RecordBatch:
            codes = np.stack([table.column(n).to_numpy().astype(layout.dtype) for n in names])
            y = table.column("y").to_numpy().astype("<f8")
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                "codes": pa.array([codes.tobytes()], pa.binary()), "labels": pa.array([y.tobytes()], pa.binary())})

        for b in batches:
            held.append(b)
            rows += b.num_rows
            while rows >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                yield cut(table.slice(0, BLOCK_ROWS))
                block, rows = block + 1, rows - BLOCK_ROWS
                held = table.slice(BLOCK_ROWS).to_batches()
        if rows:
            yield cut(pa.Table.from_batches(held))

    kind = train.schema[row_id].dataType.simpleString()
    coded = train.select(row_id, *numeric, *levels, label).mapInArrow(
        encode, ", ".join([f"id {kind}", *[f"{n} int" for n in names], "y double"]))
    dealt = coded.repartition(parts, "id").sortWithinPartitions("id", *names, "y")
    return dealt.select(*names, "y").mapInArrow(pack, "part int, block int, codes binary, labels binary")


# --------------------------------------------------------------------------
# Bootstrap
# --------------------------------------------------------------------------

_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
_LOW = np.searchsorted(_CDF, np.arange(1 << 16) / (1 << 16), side="right")
_HIGH = np.searchsorted(_CDF, np.arange(1, (1 << 16) + 1) / (1 << 16), side="left")
_OPEN = 255
_COUNT = np.where(_LOW == _HIGH, _LOW, _OPEN).astype(np.uint8)


def bootstrap(seed: int, tree: int, part: int, block: int, rows: int) -> np.ndarray:
    """How often each row of a block counts in a tree: Poisson(1), by the inverse
    of its distribution. 16 random bits decide for nearly all rows; where
    they do not, 53 more are drawn."""
    draw = np.random.Generator(np.random.SFC64([seed & (1 << 64) - 1, tree, part, block]))
    u = np.frombuffer(draw.bytes(2 * rows), "<u2")
    out = _COUNT.take(u.astype(np.intp))
    at = np.flatnonzero(out == _OPEN)
    out[at] = np.searchsorted(_CDF, (u[at] + draw.random(len(at))) / (1 << 16), side="right")
    return out


# --------------------------------------------------------------------------
# Trees
# --------------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes in the order of their making; a node without children has -1."""
    col: list[int] = field(default_factory=list)
    lo: list[int] = field(default_factory=list)
    hi: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    split: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)
    total: list[float] = field(default_factory=list)
    squares: list[float] = field(default_factory=list)

    def add(self, rows: float = math.nan, total: float = math.nan) -> int:
        for name, v in (("col", 0), ("lo", 0), ("hi", -1), ("left", -1), ("right", -1), ("split", -1),
                        ("gain", -1.0), ("rows", rows), ("total", total), ("squares", math.nan)):
            getattr(self, name).append(v)
        return len(self.col) - 1

    def shape(self) -> dict[str, np.ndarray]:
        return {n: np.array(getattr(self, n), np.int64) for n in ("col", "lo", "hi", "left", "right")}


class Places:
    """Where the rows of one tree are among its ``wanted`` nodes; rows elsewhere
    are at ``len(wanted)``."""

    def __init__(self, layout: Layout, shape: Mapping[str, np.ndarray], wanted: Sequence[int], depth: int):
        self.layout, self.shape, self.steps = layout, shape, max(0, depth - LOOKUP_DEPTH)
        place = np.full(len(shape["col"]), len(wanted), np.intp)
        place[np.asarray(wanted)] = np.arange(len(wanted))
        self.place = place
        front, masks, every = [], {}, (1 << 64) - 1

        def walk(node: int, level: int) -> int:
            if level == LOOKUP_DEPTH or shape["left"][node] < 0:
                front.append(node)
                return 1 << len(front) - 1
            left, right = walk(shape["left"][node], level + 1), walk(shape["right"][node], level + 1)
            c, lo, hi = (int(shape[n][node]) for n in ("col", "lo", "hi"))
            m = masks.setdefault(c, np.full(layout.sizes[c], every, np.uint64))
            m[lo:hi + 1] &= np.uint64(every ^ left)
            m[:lo] &= np.uint64(every ^ right)
            m[hi + 1:] &= np.uint64(every ^ right)
            return left | right

        walk(0, 0)
        self.front = np.array(front, np.intp)
        kind = next(np.dtype(f"u{b}") for b in (1, 2, 4, 8) if len(front) <= 8 * b)
        self.tables = {}
        for c, m in masks.items():
            g, t = layout.group_of[c], m[layout.values(c)]
            self.tables[g] = self.tables[g] & t if g in self.tables else t
        some = np.uint64((1 << len(front)) - 1)
        self.tables = {g: (t & some).astype(kind) for g, t in self.tables.items()}

    def of(self, codes: np.ndarray, columns: np.ndarray | None) -> np.ndarray:
        rows = codes.shape[1]
        if not self.tables:
            return np.full(rows, self.place[self.front[0]], np.intp)
        possible = None
        for g, t in self.tables.items():
            hit = t.take(codes[g].astype(np.intp))
            possible = hit if possible is None else np.bitwise_and(possible, hit, out=possible)
        # the only bit that is left, from the exponent of its value
        at = (possible.astype(np.float64).view(np.int64) >> 52) - 1023
        if not self.steps:
            return self.place[self.front].take(at)
        s, node, row = self.shape, self.front.take(at), np.arange(rows)
        inner = s["left"] >= 0
        left = np.where(inner, s["left"], np.arange(len(inner)))
        right = np.where(inner, s["right"], np.arange(len(inner)))
        for _ in range(self.steps):
            value = columns[s["col"].take(node), row]
            goes = (value >= s["lo"].take(node)) & (value <= s["hi"].take(node))
            node = np.where(goes, right.take(node), left.take(node))
        return self.place.take(node)


def _add_up(layout: Layout, targets: Sequence[tuple[int, int, Mapping, Sequence[int]]], depth: int, seed: int):
    """Task: per target (tree, first chunk, shape, nodes) the sums of its nodes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {}
        for b in batches:
            for r in b.to_pylist():
                codes = np.frombuffer(r["codes"], layout.dtype).reshape(len(layout.groups), -1)
                columns = None
                if depth > LOOKUP_DEPTH:
                    columns = np.stack([layout.values(c).astype(layout.dtype).take(codes[layout.group_of[c]])
                                        for c in range(len(layout.sizes))])
                parts.setdefault(r["part"], []).append((r["block"], codes, columns, np.frombuffer(r["labels"], "<f8")))
        for tree, first, shape, nodes in targets:
            places, n = Places(layout, shape, nodes, depth), len(nodes)
            for part, rows in parts.items():
                sums = [np.zeros((n + 1) * cells, complex) for cells in layout.cells]
                squares = np.zeros(n + 1)
                for block, codes, columns, y in rows:
                    at = places.of(codes, columns)
                    times = bootstrap(seed, tree, part, block, len(y))
                    v = np.empty(len(y), complex)
                    v.real = times
                    np.multiply(times, y, out=v.imag)
                    np.add.at(squares, at, v.imag * y)
                    for s, cells, code in zip(sums, layout.cells, codes):
                        i = at * cells
                        i += code
                        np.add.at(s, i, v)
                table = layout.per_column(sums, n)
                for k in range(0, n, CHUNK):
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([tree], pa.int32()), "chunk": pa.array([first + k // CHUNK], pa.int32()),
                        "part": pa.array([part], pa.int32()),
                        "sums": pa.array([table[k:k + CHUNK].tobytes()], pa.binary()),
                        "squares": pa.array([squares[k:min(k + CHUNK, n)].tobytes()], pa.binary())})
    return run


def best_splits(layout: Layout, table: np.ndarray, squares: np.ndarray) -> pd.DataFrame:
    """Per node: its rows, labels and squares, and the split that lowers the
    variance most, -1 if none does."""
    first = table[:, :layout.sizes[0]].sum(axis=1)
    rows, total = first.real, first.imag
    right = []
    for c, n in enumerate(layout.sizes):
        t = table[:, layout.starts[c]:layout.starts[c + 1]]
        right.append(np.cumsum(t[:, :0:-1], axis=1)[:, ::-1] if c < layout.numeric else t[:, :n - 1])
    right = np.concatenate(right, axis=1)
    r, rs = right.real, right.imag
    l, ls = rows[:, None] - r, total[:, None] - rs  # noqa: E741
    ok = (l >= 1) & (r >= 1)
    with np.errstate(all="ignore"):
        gain = np.where(ok, l * r / np.square(rows)[:, None] * np.square(ls / l - rs / r), -1.0)
        variance = squares / rows - np.square(total / rows)
        pure = ~(variance > 1e-13 * squares / rows)
    out = pd.DataFrame({"rows": rows, "total": total, "squares": squares})
    if not right.shape[1]:
        return out.assign(gain=-1.0, split=-1, right_rows=0.0, right_total=0.0)
    # the first of those that are equal but for rounding
    split = np.argmax(gain >= gain.max(axis=1, keepdims=True) * (1 - 1e-9), axis=1)
    i = np.arange(len(rows))
    best = gain[i, split]
    stop = pure | ~(best > 1e-13 * squares / np.maximum(rows, 1))
    return out.assign(gain=np.where(stop, -1.0, best), split=np.where(stop, -1, split),
                      right_rows=r[i, split], right_total=rs[i, split])


def _meet(layout: Layout):
    def run(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        table = squares = None
        for f in found.sort_values("part").itertuples():
            s, q = np.frombuffer(f.sums, complex).reshape(-1, layout.bins), np.frombuffer(f.squares)
            table, squares = (s.copy(), q.copy()) if table is None else (table + s, squares + q)
        out = best_splits(layout, table, squares)
        return out.assign(tree=key[0], chunk=key[1], node=range(len(out)))[_FOUND_NAMES]
    return run


_FOUND = ("tree int, chunk int, node int, rows double, total double, squares double, gain double, split int, "
          "right_rows double, right_total double")
_FOUND_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def grow(rows: DataFrame, layout: Layout, num_trees: int, max_depth: int, seed: int,
         node_memory_mb: int = 1024) -> list[Tree]:
    """Trees of the ``blocks``, one pass a level unless the sums of its nodes
    exceed ``node_memory_mb``."""
    trees = [Tree() for _ in range(num_trees)]
    open_nodes = [(t, tree.add()) for t, tree in enumerate(trees)]
    a_pass = max(1, (node_memory_mb << 20) // (16 * layout.bins))
    a_task = max(1, TASK_BYTES // (16 * sum(layout.cells)))
    for depth in range(max(1, max_depth)):
        children = []
        for at in range(0, len(open_nodes), a_pass):
            by_tree = {}
            for t, node in open_nodes[at:at + a_pass]:
                by_tree.setdefault(t, []).append(node)
            targets, known = [], {}
            for t, nodes in by_tree.items():
                shape, first = trees[t].shape(), 0
                for k in range(0, len(nodes), a_task):
                    some = nodes[k:k + a_task]
                    targets.append((t, first, shape, some))
                    for j in range(0, len(some), CHUNK):
                        known[t, first] = some[j:j + CHUNK]
                        first += 1
            found = (rows.mapInArrow(_add_up(layout, targets, depth, seed),
                                     "tree int, chunk int, part int, sums binary, squares binary")
                     .groupBy("tree", "chunk").applyInPandas(_meet(layout), _FOUND).collect())
            for f in sorted(found, key=lambda f: (f.tree, f.chunk, f.node)):
                tree, node = trees[f.tree], known[f.tree, f.chunk][f.node]
                tree.rows[node], tree.total[node], tree.squares[node] = f.rows, f.total, f.squares
                if f.split < 0 or depth >= max_depth:
                    continue
                tree.col[node], tree.lo[node], tree.hi[node] = layout.splits[f.split][:3]
                tree.split[node], tree.gain[node] = f.split, f.gain
                tree.left[node] = tree.add(f.rows - f.right_rows, f.total - f.right_total)
                tree.right[node] = tree.add(f.right_rows, f.right_total)
                children += [(f.tree, tree.left[node]), (f.tree, tree.right[node])]
        open_nodes = sorted(children)
        if not open_nodes:
            break
    return trees


# --------------------------------------------------------------------------
# The model
# --------------------------------------------------------------------------

def _value(rows: float, total: float, centre: float, scale: float) -> float:
    """A node's mean label; 0, as in Spark ML, if the bootstrap has no row at all."""
    return centre + scale * (total / rows) if rows else 0.0


def predict(rows: DataFrame, keep: Sequence[str], numeric: Sequence[str], levels: Sequence[str], layout: Layout,
            edges: Sequence[Sequence[float]], trees: Sequence[Tree], centre: float, scale: float) -> DataFrame:
    """``keep`` and ``prediction`` of the rows, as ``to_model``'s model has it:
    the same nodes, found by lookup."""
    grown = []
    for tree in trees:
        depths = [0] * len(tree.col)
        for i, (a, b) in enumerate(zip(tree.left, tree.right)):     # children follow their parents
            if a >= 0:
                depths[a] = depths[b] = depths[i] + 1
        leaves = [i for i, a in enumerate(tree.left) if a < 0]
        grown.append((tree.shape(), leaves, max(depths),
                      np.array([_value(tree.rows[i], tree.total[i], centre, scale) for i in leaves])))
    deep = any(depth > LOOKUP_DEPTH for _, _, depth, _ in grown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = None
        for b in batches:
            places = places or [Places(layout, shape, leaves, depth) for shape, leaves, depth, _ in grown]
            columns = columns_of(b, numeric, levels, edges)
            codes = np.stack(layout.join(columns)) if layout.groups else np.empty((0, b.num_rows), layout.dtype)
            columns = np.stack(columns) if deep else None
            out = np.zeros(b.num_rows)
            for p, (_, _, _, values) in zip(places, grown):
                out += values.take(p.of(codes, columns))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out / len(grown))],
                                             [*keep, "prediction"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, *numeric, *levels).mapInArrow(run, f"{kinds}, prediction double")



_NODES = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, "
          "rawCount bigint, gain double, leftChild int, rightChild int, "
          "split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")


def to_model(spark: SparkSession, trees: Sequence[Tree], layout: Layout, edges: Sequence[Sequence[float]],
             centre: float, scale: float, params: Mapping[str, object]) -> RandomForestRegressionModel:
    """The trees as a Spark ML model, through files in its format."""
    nodes = []
    for t, tree in enumerate(trees):
        for i, (n, s, q) in enumerate(zip(tree.rows, tree.total, tree.squares)):
            value = _value(n, s, centre, scale)
            variance = (max(0.0, q / n - (s / n) ** 2) * scale ** 2 if q == q else q) if n else 0.0
            split = (-1, [], -1)
            if tree.left[i] >= 0:
                c, _, _, feature, b = layout.splits[tree.split[i]]
                split = (feature, [edges[c][b] if c < layout.numeric else 0.5], -1)
            nodes.append((t, (i, value, variance, [n, n * value, n * (variance + value ** 2)], int(n),
                              tree.gain[i] * scale ** 2 if tree.left[i] >= 0 else -1.0,
                              tree.left[i], tree.right[i], split)))
    path = scratch_path(spark, f"forest-{uuid.uuid4().hex}")

    def about(kind: str, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": 0,
                           "sparkVersion": spark.version, "uid": f"{kind}_{uuid.uuid4().hex[:12]}", **more})
    forest = about("RandomForestRegressionModel", paramMap=dict(params), defaultParamMap={},
                   numFeatures=layout.features, numTrees=len(trees))
    one = about("DecisionTreeRegressionModel", paramMap={k: v for k, v in params.items() if k in (
        "featuresCol", "labelCol", "predictionCol", "maxDepth", "maxBins", "seed", "impurity")}, defaultParamMap={})
    spark.createDataFrame([(forest,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(t, one, 1.0) for t in range(len(trees))], "_1 int, _2 string, _3 double") \
        .coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, _NODES).coalesce(1).write.parquet(f"{path}/data")
    model = RandomForestRegressionModel.load(path)
    drop_scratch(spark, path)
    return model
