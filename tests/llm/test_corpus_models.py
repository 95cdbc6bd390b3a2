"""Importance resampling, spelling variants and language-model scores against
brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from kpiforge.llm import importance, quality, queries, suffix_tree_lm, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# -- importance resampling ---------------------------------------------------


def brute_draw(rows, target, buckets=10_000, longest=1, percent=10, least=20):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def feats(text):
        w = words.findall((text or "").translate(LOWER))
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets
                for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    own = [(i, *feats(t)) for i, t in rows]
    s = collections.Counter(x for _, f, _ in own for x in f)
    t = collections.Counter(x for text in target for x in feats(text)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
            for b in range(buckets)]
    out = []
    for i, f, n in own:
        weight, score = sum(gain[x] for x in f), None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))
        out.append((i, len(f), weight, score, n >= least))
    ranked = sorted((x for x in out if x[4] and x[3] is not None), key=lambda x: (-x[3], x[0]))
    return out, [(x[3], x[0]) for x in ranked[:percent * len(ranked) // 100]]


def check_draw(df, target, **kw):
    got = importance.importance_resample(df, target, **kw).collect()
    want, drawn = brute_draw([(r.doc_id, r.text) for r in df.collect()],
                             [r.text for r in target.collect()],
                             **{k: v for k, v in kw.items() if k in ("buckets", "longest", "percent")})
    key = lambda r: tuple((x is not None, x) for x in r[:4])
    assert sorted(map(key, got)) == sorted(map(key, want))
    ranks = sorted((r["rank"], r.score, r.doc_id) for r in got if r["rank"] is not None)
    assert [(s, i) for _, s, i in ranks] == drawn
    assert [r for r, _, _ in ranks] == list(range(1, len(drawn) + 1))


def test_draw_of_the_tables(spark, sf, docs):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    check_draw(docs, target)
    check_draw(docs, target, buckets=100, longest=3, percent=37)


def test_draw_edges(edge, empty, docs):
    check_draw(edge, docs, percent=100)
    check_draw(edge, empty, percent=100)
    assert importance.importance_resample(empty, docs).count() == 0


def test_draw_among_repeated_rows(spark):
    """A third of the rows tie in score and identifier: splitters cut them."""
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(7 if i % 3 else i, text if i % 3 else f"{text} {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = importance.importance_resample(df, df.limit(5), percent=60).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, 1801)) and len(got) == 3000
    last = min(r.score for r in got if r["rank"] is not None)
    assert all(r["rank"] is not None for r in got if r.score > last)


# -- spelling variants -------------------------------------------------------

def brute_words(rows):
    out = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(words):
    by_part = collections.defaultdict(set)     # words that share a half, for speed
    for w in words:
        for part in {w[:2], w[-2:]}:
            for n in (-1, 0, 1):
                by_part[part, len(w) + n].add(w)
    near = {w: {v for part in {w[:2], w[-2:]} for v in by_part[part, len(w)] if one_edit(w, v)} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def test_variants_of_the_tables(docs):
    got = variants.spelling_variants(docs).collect()
    assert {tuple(r) for r in got} == brute_groups(brute_words([(r.doc_id, r.text) for r in docs.collect()]))


@pytest.mark.parametrize("nodes,least_cut,longest", [(1, 1000, 8), (1 << 18, 0, 8), (1 << 18, 1, 3), (64, 2, 5)])
def test_no_pair_is_lost_for_any_dictionary(spark, nodes, least_cut, longest):
    """Words of few letters, close to each other, with every size of trie."""
    rnd = random.Random(longest * 7 + least_cut)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(5, 9))): rnd.randint(3, 400) for _ in range(900)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = variants.group_words(df, nodes=nodes, least_cut=least_cut, longest=longest).collect()
    assert {tuple(r) for r in got} == brute_groups(words)


def test_variants_follow_long_chains(spark):
    words = {"aaaaa" + "bcdefghijklmnop"[:k]: 3 * 2 ** k for k in range(1, 15)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: r for r in variants.group_words(df).collect()}
    top = max(words, key=words.get)
    assert {r.root for r in got.values()} == {top} and got[top].form is None


def test_variants_edges(spark, edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert {tuple(r) for r in variants.spelling_variants(edge).collect()} == brute_groups(brute_words(rows))
    assert variants.spelling_variants(empty).count() == 0
    odd = [(1, "Ünïts ünïts ÜNÏTS x×y÷z ſtrange Ȁbcdef"), (2, "z" * 200_000), (None, "ünïts ünïts ünïts")]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    assert {tuple(r) for r in variants.spelling_variants(df).collect()} == brute_groups(brute_words(odd))


# -- language-model scores ---------------------------------------------------

class BruteTree:
    """The tree's definition on dictionaries of word tuples."""

    def __init__(self, texts, depth, floor):
        self.count = collections.Counter(w for t in texts for w in t)
        self.n, self.v = sum(self.count.values()), len(self.count)
        grams = [collections.Counter(tuple(t[i:i + k + 1]) for t in texts for i in range(len(t) - k))
                 for k in range(depth + 1)]
        numbered = {(w,) for w, n in self.count.items() if n >= floor or w == b" "}
        kept = [{g: grams[0][g] for g in numbered}]
        for k in range(1, depth + 1):
            kept.append({g: n for g, n in grams[k].items()
                         if n >= floor and g[:-1] in kept[k - 1] and g[1:] in kept[k - 1]})
        self.kept, self.next = kept, collections.defaultdict(dict)
        for level in kept[1:]:
            for g, n in level.items():
                self.next[g[:-1]][g[-1]] = n
        self.states = set()
        for s, told in self.next.items():
            c = kept[len(s) - 1][s]
            above = {w: self.listed(s[1:], w) for w in told}
            gain = sum(n * math.log(n / c / above[w]) for w, n in told.items())
            other = c - sum(told.values())
            if other:
                gain += other * math.log(other / c / (1 - sum(above.values())))
            if 2 * gain > len(told) + 3 * math.sqrt(2 * len(told)):
                self.states |= {s[i:] for i in range(len(s))}

    def root(self, w):
        return (self.count[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def listed(self, s, w):
        return (self.next[s][w] - 0.5) / self.kept[len(s) - 1][s] if s else self.root(w)

    def prob(self, s, w):
        if not s:
            return self.root(w)
        told, c = self.next[s], self.kept[len(s) - 1][s]
        if w in told:
            return self.listed(s, w)
        left = 1 - sum((n - 0.5) / c for n in told.values())
        return self.prob(s[1:], w) * left / (1 - sum(self.listed(s[1:], v) for v in told))

    def score(self, text, depth):
        out = 0.0
        for i, w in enumerate(text):
            s = max((tuple(text[i - k:i]) for k in range(min(i, depth) + 1)
                     if not k or tuple(text[i - k:i]) in self.states), key=len)
            out += math.log10(self.prob(s, w))
        return out


def tokens(text):
    return (text or "").encode().lower().split() + [b" "]


def check_scores(df, depth=3, share_bits=18):
    got = suffix_tree_lm.lm_scores(df, depth=depth, share_bits=share_bits).collect()
    rows = df.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10
    train = [tokens(r.text) for r in rows if fold(r.doc_id)]
    n = sum(map(len, train))
    tree = BruteTree(train, depth, max(4, -(-n >> share_bits)))
    want = sorted((str(r.doc_id), fold(r.doc_id) == 0, len(t), sum(tree.count[w] > 0 for w in t),
                   round(sum(math.log10(tree.root(w)) for w in t) if n else 0.0, 6) + 0.0,
                   round(tree.score(t, depth) if n else 0.0, 6) + 0.0)
                  for r in rows for t in [tokens(r.text)])
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6) + 0.0,
                   round(r.score, 6) + 0.0) for r in got)
    for a, b in zip(have, want):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-5, rel=1e-9)
    assert {r.train_tokens for r in got} <= {n}
    return got, tree


@pytest.mark.parametrize("depth,share_bits", [(3, 18), (2, 9), (1, 12)])
def test_scores_of_the_tables(docs, depth, share_bits):
    """Few shares make most words unnumbered; the rest of the tree is unchanged."""
    got, tree = check_scores(docs, depth, share_bits)
    held = [r for r in got if r.held_out]
    assert tree.states
    if share_bits == 18:
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def check_default_scores(df):
    """The registered query's tree lists every run of four occurrences."""
    rows = df.select("doc_id", "text").collect()
    train = [tokens(r.text) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10]
    tree = BruteTree(train, 3, 4)
    got = {r.doc_id: r for r in suffix_tree_lm.lm_scores(df).collect()}
    for text, ids in itertools.groupby(sorted(rows, key=lambda r: (r.text or "", r.doc_id)), lambda r: r.text):
        words = tokens(text)
        base, score = sum(math.log10(tree.root(w)) for w in words), tree.score(words, 3)
        for r in ids:
            assert got[r.doc_id].base_score == pytest.approx(base, abs=1e-5, rel=1e-9)
            assert got[r.doc_id].score == pytest.approx(score, abs=1e-5, rel=1e-9)
    return tree


def test_large_corpora_keep_runs_of_four(spark):
    """Beyond 2**20 tokens a share of 1 / 2**18 is more than four occurrences."""
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10]
    rows = [(i, "again " * 60_000) for i in ids[:20]]
    rows += [(i, f"one two three four {k}") for k, i in enumerate(ids[20:24])]
    rows += [(i, "one two three four") for i in range(100) if i not in ids]
    tree = check_default_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert tree.n > 1 << 20 and tree.kept[3][(b"one", b"two", b"three", b"four")] == 4


def test_runs_that_are_not_sent_to_the_tasks(docs, monkeypatch):
    """Few words and runs are sent; the others meet the texts in buckets, and full slots spare nothing."""
    monkeypatch.setattr(suffix_tree_lm, "SHIP_BITS", 6)
    monkeypatch.setattr(suffix_tree_lm, "SLOT_BITS", 16)
    monkeypatch.setattr(suffix_tree_lm, "BUCKET_TOKENS", 300)
    check_default_scores(docs)


def test_distributions_sum_to_one(docs):
    train = [tokens(r.text) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 10]
    tree = BruteTree(train, 3, 4)
    unseen = tree.root(b"never seen")
    for s in sorted(tree.states)[:40]:
        back = tree.prob(s, b"never seen") / unseen
        known = sum(tree.prob(s, w) for w in tree.count)
        assert known + back * unseen == pytest.approx(1, abs=1e-9)


def test_blocks_do_not_change_scores(docs, monkeypatch):
    whole = {r.doc_id: r for r in suffix_tree_lm.lm_scores(docs).collect()}
    monkeypatch.setattr(suffix_tree_lm, "BLOCK_TOKENS", 17)
    monkeypatch.setattr(suffix_tree_lm, "HELD_RUNS", 300)
    monkeypatch.setattr(suffix_tree_lm, "IDS_BYTES", 999)
    for r in suffix_tree_lm.lm_scores(docs).collect():
        assert r.score == pytest.approx(whole[r.doc_id].score, rel=1e-12)


def test_scores_edges(spark, edge, empty):
    check_scores(edge)
    assert suffix_tree_lm.lm_scores(empty).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = suffix_tree_lm.lm_scores(spark.createDataFrame([(held, "no training text")], "doc_id long, text string"))
    assert [(r.held_out, r.n_known, r.train_tokens, r.score) for r in got.collect()] == [(True, 0, 0, 0.0)]


def test_scores_keep_no_tables_that_nothing_reads(spark, docs):
    """Before the result is asked for, only what it is derived from lies on the disk."""
    import glob

    from kpiforge.llm import common
    from kpiforge.session import checkpoint_dir
    found = lambda: set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file://')}/llm/lm-*"))
    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", found()
    kept = spark.conf.get(name, None)
    scored = suffix_tree_lm.lm_scores(docs)
    left = sorted(path.split("/")[-1].rsplit("-", 1)[0] for path in found() - before)
    assert left == ["lm-texts", "lm-weights", "lm-words"]
    assert spark.conf.get(name, None) == kept
    with common.shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
    assert scored.count() == docs.count()


def test_words_of_texts():
    import pyarrow as pa
    texts = ["", None, " a  B\x0b\x0cc\r\n", "\u00c9 x\u00a0y", "one", "\t", "d\x1ce \x85"]
    words, sizes = suffix_tree_lm.words_of(pa.array(["left out", *texts], pa.string()).slice(1))
    want = [tokens(t)[:-1] for t in texts]
    assert words.to_pylist() == [w for t in want for w in t]
    assert sizes.tolist() == [len(t) for t in want]


def test_packed_words_and_numbers():
    import numpy as np
    numbers = np.array([9 << 60, 5, 7 << 50], np.uint64)
    keys = np.array([5, 6, 9 << 60, 7 << 50, 5, 1 << 63], np.uint64)
    told = suffix_tree_lm.named(keys, numbers, np.argsort(numbers))
    assert suffix_tree_lm.keys_named(*told, len(keys), numbers).tolist() == keys.tolist()
    some = np.array([3, 1 << 30, 0], np.int32)
    assert suffix_tree_lm.from_planes(suffix_tree_lm.planes(some), 3, np.int32).tolist() == some.tolist()


def test_new_queries_return_their_columns(spark, sf):
    assert queries.op11_importance(spark, sf).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert queries.op12_variants(spark, sf).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert queries.op13_lm_scores(spark, sf).columns == [
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


# -- quality classifier ------------------------------------------------------

M64 = (1 << 64) - 1
ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def plain_features(text):
    """Kinds of hashed n-grams, as whole numbers."""
    import xxhash
    own, shapes = [], []
    for w in (text or "").encode().split():
        word, kinds = w.decode(), []
        for ch in word:
            kind = "9" if ch.isdigit() else ("X" if ch.isupper() else "x") if ch.isalpha() else ch
            if kinds[-1:] != [kind]:
                kinds.append(kind)
        own.append(xxhash.xxh64_intdigest(word.lower().encode(), 1))
        shapes.append(0x9E3779B97F4A7C15 if own[-2:-1] == own[-1:] else
                      xxhash.xxh64_intdigest("".join(kinds).encode(), 2))
    out = []
    for kind, (seq, n) in enumerate(((own, 1), (own, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        grams = []
        for i in range(len(seq) - n + 1):
            h = kind + 1
            for j in range(n):
                h = (h ^ seq[i + j]) * ODD[j] & M64
                h ^= h >> 29
            grams.append((h * ODD[2] & M64) >> 46)
        if grams:
            out.append(grams)
    return out


def plain_ftrl(rows, epochs=4, alpha=2.0, beta=0.1, l1=1e-4, l2=1e-4):
    """Follow the regularised leader on dictionaries, one coordinate at a time."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for values, label in rows:
            x = [*sorted(values.items()), ("bias", 1.0)]
            w = [weight(i) for i, _ in x]
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(a * v for a, (_, v) in zip(w, x))))))
            for (i, v), a in zip(x, w):
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * a
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_quality_equals_plain_learning_and_scoring(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = []
    for r in sorted(quality.training_sample(docs, labels, 60).collect(), key=lambda r: r.order):
        values = collections.defaultdict(float)
        for grams in plain_features(r.text):
            for g in grams:
                values[g] += 1.0 / len(grams)
        rows.append(({i: float(np.float32(v)) for i, v in values.items()}, r.quality))
    w = plain_ftrl(rows)
    scored = quality.quality_scores(docs, labels, 60).collect()
    assert len(scored) == docs.count() and len({r.predicted for r in scored}) == 2
    for r in scored:
        s = w["bias"] + sum(sum(w.get(g, 0.0) for g in grams) / len(grams) for grams in plain_features(r.text))
        assert r.score == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-4)
        assert r.predicted == int(r.score >= 0.5)
