"""Exact, near and substring dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kpiforge.llm import exact_dedup, graph, minhash, queries, suffix_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def rows_of(df, *cols):
    return collections.Counter(tuple(r) for r in df.select(*cols).collect())


# -- exact -------------------------------------------------------------------

def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    return groups


def test_exact_edges(edge):
    got = exact_dedup.exact_dedup(edge)
    assert got.columns[:5] == edge.columns[:5] and "odd name" in got.columns
    assert got.count() == edge.count()
    groups = brute_exact([(r[0], r[1]) for r in edge.collect()])
    for r in got.collect():
        ids = groups[SPACE.sub(" ", r["text"] or "")]
        known = [i for i in ids if i is not None]
        assert r["keep_id"] == (min(known) if known else None)
        assert r["group_size"] == len(ids)
        assert r["text_sha256"] == hashlib.sha256(SPACE.sub(" ", r["text"] or "").encode()).hexdigest()
    assert got.filter("kept").count() == len(groups)  # repeated rows: one stays


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_hot_group_crosses_partitions(spark):
    rows = [(i, "hot text" if i % 3 else f"text {i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.exact_dedup(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = brute_exact(rows)
    assert len(got) == 3000
    for r in got:
        ids = groups[r["text"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(ids), r["doc_id"] == min(ids))


def test_exact_holds_no_batch(monkeypatch):
    """An open run goes out batch by batch; nothing waits for its end."""
    monkeypatch.setattr(exact_dedup, "TaskContext", type("T", (), {
        "get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 3})())}))
    pulled, seen = [], 0

    def source():
        for k in range(6):
            pulled.append(k)
            yield pa.RecordBatch.from_pydict({"doc_id": [2 * k, 2 * k + 1], "__norm": ["hot", "hot"]})

    for out in exact_dedup._mark_runs("doc_id")(source()):
        seen += out.num_rows
        assert out.num_rows == 2 and 2 * len(pulled) == seen
    assert seen == 12


def test_exact_runs_cross_batches(spark):
    rows = [(i, "hot text" if i % 3 else f"text {i % 50}") for i in range(600)] + [(None, "hot text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = exact_dedup.exact_dedup(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    groups = brute_exact(rows)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r["text"]]
        first = min(i for i in ids if i is not None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (first, len(ids), r["doc_id"] == first)


# -- near --------------------------------------------------------------------

def brute_near(rows, per=4, percent=80):
    sets = {i: minhash.shingle_set(minhash.words_of(t), per) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_matches_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_near(rows)
    for r in minhash.near_dedup(docs).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("chunk", [3, 512])
def test_near_group_without_a_hub(spark, chunk):
    """Many variants of one text, few pairs similar enough: buckets where the
    hub resolves little, cut into small chunks; no link may be lost."""
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(500)}"
        rows.append((i * 7 % 151, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(df, chunk=chunk).collect()}
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < 150


def test_near_edges(edge, empty):
    got = {r.doc_id: r for r in minhash.near_dedup(edge.filter("doc_id is not null")).collect()}
    for i in (1, 2, 3):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[5].n_shingles == 1 and got[4].n_shingles == 1
    assert got[7].component_id == 6 and got[9].component_id == 8
    assert minhash.near_dedup(edge).count() == edge.count()
    assert minhash.near_dedup(empty).count() == 0
    assert minhash.keep_one_of_each(edge).columns == edge.columns


def test_near_decides_rows_not_ids(edge):
    """A copy without an identifier goes alone; other rows without one stay."""
    left = collections.Counter(r.text for r in minhash.keep_one_of_each(edge).collect())
    rows = edge.collect()
    no_words = [r.text for r in rows if not minhash.words_of(r.text)]
    first = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        if r.text not in no_words:
            first.setdefault(tuple(minhash.words_of(r.text)), r.text)
    assert left == collections.Counter(no_words) + collections.Counter(first.values())
    assert left["a row without an identifier"] == 1
    assert left == collections.Counter(r.text for r in minhash.keep_one_of_each(edge.repartition(5)).collect())


def test_near_links_texts_not_identifiers(spark):
    """One identifier on two texts: near copies of both are linked. Near copies
    without an identifier are linked too, and go."""
    a = [f"a{k}" for k in range(40)]
    b = [f"b{k}" for k in range(40)]
    c = [f"c{k}" for k in range(40)]
    rows = [(1, a), (1, b), (2, a[:-1]), (3, b[:-1]), (None, c), (None, c[:-1]), (None, a[1:]), (None, ["alone"] * 9)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.text: r for r in minhash.near_dedup(df).join(df, "doc_id").collect()}
    assert {got[" ".join(w)].component_id for w in (a, b, a[:-1], b[:-1])} == {1}
    left = collections.Counter(r.text.split()[0] for r in minhash.keep_one_of_each(df).collect())
    assert left == {"a0": 1, "b0": 1, "c0": 1, "alone": 1}


def test_near_hubs_and_chunks_of_few_shingles(docs):
    want = {r.doc_id: tuple(r) for r in minhash.near_dedup(docs).collect()}
    got = {r.doc_id: tuple(r) for r in minhash.near_dedup(docs, chunk=2, chunk_shingles=200).collect()}
    assert got == want


def test_permutations_are_bijections():
    sample = np.random.default_rng(1).integers(0, 2 ** 32, 200_000, dtype=np.uint32)
    sample = np.unique(sample)
    for key in (0, 1):
        assert len(np.unique(minhash.permute(sample.copy(), key))) == len(sample)


def test_signature_estimates_similarity():
    rnd = random.Random(2)
    signer = minhash.Signer(1, 512, 1)
    a = [str(rnd.random()).encode() for _ in range(1000)]
    b = a[:900] + [str(rnd.random()).encode() for _ in range(100)]
    x, y = (signer.bands_of(signer.hashes(w)) for w in (a, b))
    assert abs((x == y).mean() - 900 / 1100) < 0.08


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 450: 400, 500: 400}


# -- substrings --------------------------------------------------------------

def brute_substrings(rows):
    least = {}
    for i, t in rows:
        t, i = (t or "").encode(), suffix_dedup.NO_ID if i is None else i
        for k in range(len(t) - 49):
            least[t[k:k + 50]] = min(i, least.get(t[k:k + 50], i))
    out = collections.Counter()
    for i, t in rows:
        t, n = (t or "").encode(), suffix_dedup.NO_ID if i is None else i
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if least[t[k:k + 50]] < n:
                gone[k:k + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def check_substrings(df, **options):
    got = suffix_dedup.substring_dedup(df, **options)
    found = rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    want = brute_substrings([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert found == want
    for r in got.collect():
        assert sum(e - b for b, e in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_substrings_match_brute_force(docs):
    check_substrings(docs)


def test_substrings_small_blocks_and_hot_anchors(docs):
    check_substrings(docs.limit(120), block_bytes=20_000, bucket_bytes=60_000, hot=2)


def test_substrings_edges(edge, empty):
    check_substrings(edge)
    assert suffix_dedup.substring_dedup(empty).count() == 0


def test_substrings_of_repetitive_text(spark):
    rows = [(1, "ab" * 200), (2, "b" + "ab" * 40 + "c"), (3, "x" * 49), (4, "x" * 50), (5, "x" * 51),
            (6, "é" * 60), (0, "é" * 26)]
    check_substrings(spark.createDataFrame(rows, "doc_id long, text string"))


def test_substrings_of_extreme_identifiers(spark):
    """The largest identifier is one like all others; rows without one come last."""
    text = "".join(chr(97 + k * k % 26) + str(k) for k in range(60))
    ids = [2 ** 63 - 1, None, -2 ** 63, 5]
    df = spark.createDataFrame([(i, f"{k}{k} {text}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.substring_dedup(df).collect()}
    assert got[-2 ** 63] == 0 and set(got) == set(ids)
    assert all(got[i] >= len(text) for i in ids if i != -2 ** 63)
    one = spark.createDataFrame([(2 ** 63 - 1, text), (None, text)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.substring_dedup(one).collect()}
    assert got == {2 ** 63 - 1: 0, None: len(text)}
    assert not spark.catalog.listTables()


def test_blocks_stop_growing():
    assert suffix_dedup.plan(10 ** 14)[0] == suffix_dedup.MOST_BLOCK_BYTES
    assert suffix_dedup.plan(10 ** 9)[0] == suffix_dedup.BLOCK_BYTES


def test_suffix_sort_orders_suffixes():
    rnd = random.Random(5)
    buf = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(2000)) + b"a" * 300, np.uint8)
    p = suffix_dedup.PrefixHashes(buf)
    pos = np.arange(0, len(buf) - 50, 3)
    size = np.full(len(pos), len(pos))
    order = suffix_dedup.suffix_sort(p, pos, np.zeros(len(pos), np.int64), size)
    text = buf.tobytes()
    got = [text[x:x + 50] for x in pos[order]]
    assert got == sorted(got)


def test_collision_falls_back_to_bytes(monkeypatch):
    """With hashes that see one byte only, answers still come out right."""
    class Weak(suffix_dedup.PrefixHashes):
        def of(self, at, length):
            return super().of(np.asarray(at), 1) + np.zeros_like(np.asarray(at) + length).astype(np.uint64)
    monkeypatch.setattr(suffix_dedup, "PrefixHashes", Weak)
    rnd = random.Random(6)
    segs = [bytes(rnd.choice(b"ab") for _ in range(50)) for _ in range(40)] * 2
    masks = suffix_dedup.resolve(np.frombuffer(b"".join(segs), np.uint8), np.full(80, 50),
                                 np.zeros(80, np.int64), np.arange(80), False)
    assert masks.tolist() == [0] * 40 + [1] * 40


# -- registered queries ------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf, name):
    from oracle_check import compare, duck
    r = compare(spark, duck(sf), name, queries.QUERIES[name], queries.ORACLE[name], sf)
    assert r["ok"], r
