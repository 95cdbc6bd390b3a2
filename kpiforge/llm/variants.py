"""Spelling variants: words one edit apart, by a variable-length gram index.

1. Words are counted map-side and summed (``seeded_words`` also misspells some,
   by a rule on document and word).
2. The gram dictionary is a trie pruned by frequency: a gram is extended while
   more than ``cut`` grams of the words share it. Only those inner nodes are
   sent to the tasks: the cut is the number of grams over ``NODES``, so at most
   ``NODES`` of them exist per gram length.
3. A word, between two end marks, is decomposed into the grams that start at
   its places - each the shortest one that is no inner node, or of the longest
   length allowed - without those that an earlier gram covers.
4. One edit leaves untouched all of a word's grams but those it hits and those
   right of it that a new gram may cover. ``affected`` is the most that one edit
   can change. Two words one edit apart therefore share, at places shifted by
   at most one, all but that many grams, and the rarest gram they share is
   among the first ``affected + 1`` grams of either word. Only these go into the
   index, under gram, place and length.
5. Lists of the same key are merged by a join and every pair that meets is
   verified with its edit distance.

Why no pair is lost: words of lengths L and L + 1 meet in class L, where grams
have at most (L + 2) // 2 characters. An edit cannot reach both the gram at the
first place and the one that ends at the last mark then, so at least one gram
stays; every other claim above holds for any set of inner nodes.

Pairs are made by the join and filtered in it, never listed per group; a hot
list is split by the adaptive skew join. Chains of forms are followed by
doubling, as each form has at least ``ratio`` times the occurrences of its word.

Defined results: null and empty texts have no words. Rows without identifier
have no seed: their words count as they are. Repeated rows count again. An empty
table gives an empty result. Only identifier and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_slices
from .tally import HELD_WORDS, tally

LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2
SEED_MODULUS = 97
SHORTEST_GRAM, LONGEST_GRAM = 2, 8
# Inner nodes of the gram trie per gram length, at most; a gram is extended
# only while at least LEAST_CUT grams share it.
NODES = 1 << 18
LEAST_CUT = 32
START, STOP = "^", "$"

# One byte per code point: letters up to U+00FF, A-Z lowered, all else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32
                 for c in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters, A-Z lowered, in Latin-1."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def seeded(runs: dict[bytes, int], ident: str | None, plain: bool, total: dict[bytes, int],
           least_length: int = LEAST_LENGTH) -> None:
    """Add the runs of one document, after its seeded deletions, to ``total``.
    ``plain`` runs are ASCII: their bytes are their UTF-8."""
    begin, get = crc32(f"{ident}:".encode()), total.get
    for run, n in runs.items():
        if len(run) < least_length:
            continue
        if ident is not None:
            h = crc32(run if plain or run.isascii() else run.decode("latin-1").encode(), begin)
            if not h % SEED_MODULUS:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < least_length:
                    continue
        total[run] = get(run, 0) + n


def seeded_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of all texts with their occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def sums() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for part in text_slices(batches, "text"):
            for ident, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seeded(Counter(runs_of(text)), ident, text is None or text.isascii(), total, least_length)
                if len(total) >= HELD_WORDS:
                    yield sums()
                    total.clear()
        if total:
            yield sums()

    return (df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))


def marked(word: str) -> str:
    return f"{START}{word}{STOP}"


class GramTrie:
    """Inner nodes of the gram dictionary and what follows from them."""

    def __init__(self, counts: dict[str, int], longest: int = LONGEST_GRAM):
        self.counts, self.longest = counts, longest
        self.inner = {g for g in counts if len(g) < longest and not g.endswith(STOP)}
        # what may follow an edit inside a gram, without the gram's last character
        self.tails = {g[i:] for g in self.inner for i in range(1, len(g))}

    def grams(self, text: str, longest: int) -> list[tuple[int, int]]:
        """(start, end) of the grams of a marked word that no earlier one covers."""
        out, covered, n, inner = [], 0, len(text), self.inner
        for start in range(n - SHORTEST_GRAM + 1):
            end, most = start + SHORTEST_GRAM, min(start + longest, n)
            while end < most and text[start:end] in inner:
                end += 1
            if end > covered:
                out.append((start, end))
                covered = end
        return out

    def affected(self, text: str, grams: list[tuple[int, int]], longest: int) -> int:
        """The most grams that one edit can take away. Inserting before a place
        changes no more than replacing the character before it."""
        tails, hit = self.tails, [0] * len(text)
        for start, end in grams:
            for i in range(start, end):
                hit[i] += 1
            for i in range(max(0, end - longest), start):
                # hidden by a new gram that reaches over the edit
                if text[i + 1:end - 1] in tails:
                    hit[i] += 1
        hit.pop()              # the last mark stays
        return max(hit)

    def keys(self, text: str, longest: int) -> list[tuple[str, int]]:
        """(gram, start) of the grams that go into the index: the rarest ones,
        as many as an edit can change and one more, at all their places."""
        grams = self.grams(text, longest)
        places: dict[str, list[int]] = {}
        for start, end in grams:
            places.setdefault(text[start:end], []).append(start)
        shared = max(1, len(places) - self.affected(text, grams, longest))
        get = self.counts.get
        ordered = sorted(places, key=lambda g: (get(g, 0), g))
        return [(g, p) for g in ordered[:len(places) - shared + 1] for p in places[g]]


def gram_trie(words: DataFrame, longest: int = LONGEST_GRAM, nodes: int = NODES,
              least_cut: int = LEAST_CUT) -> Broadcast:
    """Grams that more than the cut of all grams share, sent to the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists():
            for batch in batches:
                for word in batch.column(0).to_pylist():
                    text = marked(word).encode("latin-1")
                    yield Counter(text[i:i + q] for q in range(SHORTEST_GRAM, longest + 1)
                                  for i in range(len(text) - q + 1))
        for batch in tally(lists(), pa.binary(), "gram"):
            grams = [g.decode("latin-1") for g in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), batch.column(1)],
                                             ["gram", "n"])

    total = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    cut = max(least_cut, -(-total // nodes))
    # shorter than ``nodes`` for each length: total / cut
    heavy = (words.select("word").mapInArrow(run, "gram string, n long")
             .groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > cut)).collect()
    trie = GramTrie({r["gram"]: r["n"] for r in heavy}, longest)
    return words.sparkSession.sparkContext.broadcast(trie)


SAME, LONGER = 0, 1


def _index(trie: Broadcast):
    """(word, n) -> index entries (key, side, word, n). Side 0 asks, side 1 is
    found. Words of a class's own length ask for each other and for the words
    that are one character longer, at the gram's place and one after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trie.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                key, side, row = [], [], []
                for i, word in enumerate(part.column(0).to_pylist()):
                    text, n = marked(word), len(word)
                    for gram, p in tree.keys(text, min(tree.longest, (n + 2) // 2)):
                        for kind, place, s in ((SAME, p, 0), (SAME, p, 1), (LONGER, p, 0), (LONGER, p + 1, 0)):
                            key.append(f"{n},{kind},{place},{gram}")
                            side.append(s)
                            row.append(i)
                    for gram, p in tree.keys(text, min(tree.longest, (n + 1) // 2)):
                        key.append(f"{n - 1},{LONGER},{p},{gram}")
                        side.append(1)
                        row.append(i)
                rows = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.string()), pa.array(side, pa.int8()),
                     part.column(0).take(rows), part.column(1).take(rows)], ["key", "side", "word", "n"])
    return run


def near_words(words: DataFrame, trie: Broadcast) -> DataFrame:
    """(a, a_n, b, b_n): every pair of different words one edit apart, once."""
    index = materialise(
        words.select("word", "n").mapInArrow(_index(trie), "key string, side byte, word string, n long")
        .withColumn("key", F.xxhash64("key")), "gram-index")
    ask = index.filter("side = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    found = index.filter("side = 1").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    la, lb = F.char_length("a"), F.char_length("b")
    order = ((la == lb) & (F.col("a") < F.col("b"))) | (la + 1 == lb)
    met = ask.join(found.hint("merge"), "key").filter(order & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def follow(links: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last, by doubling."""
    now = links.select("word", F.col("form").alias("root"))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialise(now.join(step, "root", "left")
                          .select("word", F.coalesce("next", "root").alias("root"),
                                  F.col("next").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def group_words(words: DataFrame, ratio: int = RATIO, longest: int = LONGEST_GRAM,
                nodes: int = NODES, least_cut: int = LEAST_CUT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n) rows, each word once."""
    words = materialise(words.select("word", "n"), "words")
    pairs = materialise(near_words(words, gram_trie(words, longest, nodes, least_cut)), "near-words")
    both = (pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
            .unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"),
                                      F.col("a_n").alias("near_n"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    formed = F.col("best.k") * -1 >= ratio * F.col("n")
    told = materialise(
        words.join(best, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                F.when(formed, F.col("best.near")).alias("form"),
                F.when(formed, -F.col("best.k")).alias("form_n")), "forms")
    roots = follow(told.filter("form is not null").select("word", "form"))
    return (told.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """Words of all texts with their forms and roots."""
    return group_words(seeded_words(df, id_col, text_col), **options)
