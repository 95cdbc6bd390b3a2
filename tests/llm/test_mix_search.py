"""Mixing and exact search, and the pipeline, against brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

from kpiforge.llm import mixing, queries, topk

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(rows):
    """(source, size) rows -> source: (size, target), by repeated capping."""
    sizes = collections.Counter()
    for s, n in rows:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {s: (sizes[s], {**capped, **share}[s]) for s in order}
        capped |= {s: 3 * sizes[s] for s in over}


def check_mix(df):
    got = mixing.mix_sources(df).collect()
    assert len(got) == df.count()
    rows = [(r.source, len(WORDS.findall(r.text or ""))) for r in got]
    want, taken, longest = brute_targets(rows), collections.Counter(), collections.Counter()
    for r, (s, n) in zip(got, rows):
        assert r["size"] == n and r.source_size == want[s][0]
        assert r.target == pytest.approx(want[s][1], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        taken[s] += r.taken
    again = mixing.mix_sources(df.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    return want, taken


def test_mix_query_tables(docs):
    want, taken = check_mix(docs)
    for s, (_, target) in want.items():
        assert abs(taken[s] - target) <= 0.01 * target, s


def test_mix_edges(edge, empty):
    check_mix(edge.filter("doc_id is null or doc_id <> 8"))
    assert mixing.mix_sources(edge).count() == edge.count()
    own = lambda df: sorted(map(str, df.select("doc_id", "h", "id", "whole", "copies", "`odd name`").collect()))
    assert own(mixing.mix_sources(edge)) == own(edge)
    assert mixing.mix_sources(empty).count() == 0


def test_mix_hot_length(spark):
    """A third of the rows share source and length; the cut goes through them."""
    rows = [(i, "w " * (7 if i % 3 == 0 else i % 40), "a" if i % 3 == 0 else f"s{i % 5}") for i in range(2000)]
    want, taken = check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for s, (_, target) in want.items():
        assert abs(taken[s] - target) <= 7


def test_budget_is_the_best_subset():
    rnd = random.Random(8)
    for _ in range(60):
        lengths = np.array(sorted(rnd.sample(range(1, 40), 4)))
        counts = np.array([rnd.randint(1, 4) for _ in lengths])
        total = int((lengths * counts).sum())
        budget = rnd.randint(0, total)
        take = mixing.fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((take * lengths).sum())
        # the best that any subset holding the proportional start can reach
        start = counts * budget // total
        best = min((abs(s - budget), s) for s in (sum(n * l for n, l in zip(c, lengths)) for c in itertools.product(
            *(range(a, b + 1) for a, b in zip(start, counts)))))[1]
        assert got == best


def test_budget_above_the_table():
    """Lengths and rests beyond DP_SUMS are fitted exactly too."""
    fit = lambda ls, cs, b: int((mixing.fit_budget(np.array(ls), np.array(cs), b) * ls).sum())
    assert fit([240_000, 260_000, 300_000], [1, 1, 1], 500_000) == 500_000
    rnd = random.Random(9)
    for _ in range(40):
        step = rnd.choice((1, 7, 1000))
        lengths = np.array(sorted(rnd.sample(range(mixing.DP_SUMS // step, 9 * mixing.DP_SUMS // step), 5))) * step
        counts = np.array([rnd.randint(1, 3) for _ in lengths])
        total = int((lengths * counts).sum())
        budget = rnd.randint(0, total)
        start = counts * budget // total
        take = mixing.fit_budget(lengths, counts, budget)
        assert (take >= start).all() and (take <= counts).all()
        best = min((abs(s - budget), s) for s in (int((np.array(c) * lengths).sum()) for c in itertools.product(
            *(range(a, b + 1) for a, b in zip(start, counts)))))[1]
        assert int((take * lengths).sum()) == best
    # many lengths: no sum is out of reach
    many = np.array(rnd.sample(range(200_000, 900_000), 300))
    for budget in (10_000_001, 77_777_777):
        assert fit(many, np.ones(300, int), budget) == budget


def test_repeated_rows_of_the_mix(docs):
    mixed = mixing.mix_sources(docs)
    words = sum(r.taken for r in mixed.collect())
    again = mixing.repeated(mixed)
    assert sum(r["size"] for r in again.collect()) == words


# -- top-k -------------------------------------------------------------------

def brute_top(rows, asked, k=20):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in rows
          if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all()]
    out = {}
    for q, v in {(i, tuple(v)) for i, v in ok if asked(i)}:
        scored = sorted((-int(np.dot(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out[q] = [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(x for rows in out.values() for x in rows)


def check_top(df, **options):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = topk.top_k(df, df.filter("vec_id % 20 = 0"), **options)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, lambda i: i % 20 == 0)


def test_topk_blocks(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.normal(size=8)]) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(400, 600)]  # a hot vector: ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    check_top(df, block_rows=64, query_rows=7)


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, [None, 1.0]), (100, []),
            (120, [1.0, 2.0, 3.0]), (140, [-1.0, 0.25]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0]),
            (3, [-0.01, 1e6]), (140, [-1.0, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check_top(df)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_reads_few_exact_vectors(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rnd.normal(size=16)]) for i in range(3000)]
    rows += [(i, rows[1][1]) for i in range(3000, 4000)]      # a quarter are copies of one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fetched, fetch = [], topk.fetch

    def counted(wanted, *files):
        fetched.append(wanted.count())
        return fetch(wanted, *files)
    monkeypatch.setattr(topk, "fetch", counted)
    check_top(df, block_rows=512, seed_blocks=2)
    assert 200 * 20 <= sum(fetched) < 0.05 * 200 * len(rows)


def test_topk_copies_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.5])] * 30 + [(20, [1.0, 0.5])] * 3 + [(i, [1.0, 0.5]) for i in range(1, 60)]
    rows += [(7, [1.0, 0.5])] * 25 + [(i, [-1.0, 2.0 ** 18]) for i in range(60, 70)]
    check_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=16)


def test_bounds_hold():
    rnd = np.random.default_rng(5)
    values, asked = rnd.integers(-50, 50, (300, 16)).astype(float), rnd.integers(-50, 50, (20, 16)).astype(float)
    for scale in (1.0, 2.0 ** 20):
        middle, reach = topk.Cells.of(values * scale, bits=3).bounds(asked * scale)
        exact = (asked * scale) @ (values * scale).T
        assert (middle - reach[:, None] <= exact).all() and (exact <= middle + reach[:, None]).all()


# -- pipeline ----------------------------------------------------------------

def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline as c
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "mixing",
                                        "bpe_encoding"]
    counts = [docs.count()]
    for k, (name, stage) in enumerate(c.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == before.columns
        if name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in before.collect()]
            assert docs.count() == len(set(texts))
        if name == "minhash_near_dedup":
            from test_dedup import brute_near
            want = brute_near([(r.doc_id, r.text) for r in before.collect()], per=5)
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, root) in want.items() if i == root}
        if name == "mixing":
            mixed = collections.Counter(r.doc_id for r in docs.collect())
            assert max(mixed.values()) <= 3 and set(mixed) <= {r.doc_id for r in before.collect()}
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 < counts[5] == counts[4]
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in docs.collect())


def test_pipeline_edges(spark, sf, edge, empty, tmp_path):
    import corpus_pipeline as c
    for name, start in (("edge", edge), ("empty", empty)):
        docs = start
        for k, (stage_name, stage) in enumerate(c.STAGES):
            stage(spark, docs, sf).write.parquet(str(tmp_path / f"{name}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{k}"))
            if k < 4:
                assert docs.columns == start.columns
        assert (docs.count() == 0) == (name == "empty")


def test_all_queries_are_registered():
    import __spark_entry__ as e
    names = set(e.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert set(e.oracle_sql()) <= names
