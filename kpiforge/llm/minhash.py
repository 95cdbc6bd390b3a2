"""Near-duplicate documents: circulant MinHash, banding, exact verification.

A document's set holds the distinct ``words_per``-word shingles of its
lower-cased words. Two permutations of the 32-bit numbers make all signature
coordinates: shingles go through the first once, and coordinate k is the
minimum of the second over the values shifted (circularly, mod 2**32) by k.
Signatures are cut into bands; documents that share a band are candidates.

1. Equal word sequences form one class, numbered for the later steps: links are
   between classes, so rows may repeat an identifier or have none. Its smallest
   identifier stands for it.
2. In every band bucket all members are compared with one of them (hub), on
   whole shingle sets. Members stream by their hub, whose text goes once to each
   chunk of them. Links give first components.
3. What is left are pairs in one bucket, neither of them its hub, in different
   components. Buckets that hold such pairs are cut into chunks, by members and
   by shingles, members of the bucket's largest component apart from the rest,
   and every chunk of the rest meets every chunk once. No pair is lost, no list
   of pairs is made, and a bucket of any size is spread over tasks. A pair is
   compared in the first band that it shares.
4. Components of all links; the smallest identifier of a component's classes
   names it.

With 32 bands of 5 a pair at the similarity 0.8 is missed with probability
(1 - 0.8**5)**32 = 3e-6, one at 0.85 with 2e-8.

Defined results: texts that are null or without words have an empty set, are
linked with nothing and are their own component. A text with fewer words than a
shingle has one element, its whole sequence. Rows without an identifier are
linked like all others and take their component's identifier (null if none of it
has one). Ties between equal documents go to the smallest identifier; one row of
each component is kept, also where rows repeat an identifier or have none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, text_slices, without
from .graph import components

WORDS_PER_SHINGLE = 4
PERCENT = 80
BANDS, ROWS = 32, 5
# Texts of two chunks meet in one task; larger chunks copy fewer texts.
CHUNK_MEMBERS = 512
CHUNK_SHINGLES = 1 << 18
MEMO_WORDS = 150_000
_STEP = 2048
_ODD = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                                    0xA0761D6478BD642F))


def permute(x: np.ndarray, key: int) -> np.ndarray:
    """A bijection of the 32-bit numbers (xor shifts and odd multipliers)."""
    first, second = ((0x7FEB352D, 0x846CA68B), (0x85EBCA6B, 0xC2B2AE35))[key]
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(15)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], per: int = WORDS_PER_SHINGLE) -> set:
    """The whole set, as the words themselves."""
    if not words:
        return set()
    if len(words) < per:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(per))))


def similar(a: set, b: set, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not a or not b:
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


class Signer:
    """Signatures of word lists; remembers word hashes (bounded)."""

    def __init__(self, per: int, bands: int, rows: int):
        self.per, self.bands, self.rows = per, bands, rows
        self.shift = np.arange(1, bands * rows + 1, dtype=np.uint32)[:, None]
        self.memo: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """64-bit hashes of the distinct shingles."""
        memo = self.memo
        missing = set(words).difference(memo)
        if len(memo) + len(missing) > MEMO_WORDS:
            memo.clear()
            missing = set(words)
        for w in missing:
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - self.per + 1)
        k = min(self.per, len(words))
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i:i + n]) * _ODD[i % 4]
            out ^= out >> np.uint64(31)
        return np.unique(out)

    def bands_of(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit key per band."""
        sigma = permute((hashes >> np.uint64(32)).astype(np.uint32), 0)
        low = np.full(len(self.shift), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(sigma), _STEP):
            grid = permute(sigma[None, at:at + _STEP] + self.shift, 1)
            np.minimum(low, grid.min(axis=1), out=low)
        rows = low.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * _ODD[3]
        for i in range(self.rows):
            key = (key ^ rows[:, i]) * _ODD[i % 4]
            key ^= key >> np.uint64(29)
        return key.astype(np.int64)


def digest(text: Column) -> Column:
    """Of the text as it is (null as empty), as ``signatures`` makes it: with
    the identifier, what tells rows apart."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def signatures(df: DataFrame, id_col: str, text_col: str, per: int, bands: int,
               rows: int) -> DataFrame:
    """(id, digest of the text, class, n_shingles, bands) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(per, bands, rows)
        for part in text_slices(batches, "text"):
            own, cls, n, keys = [], [], [], []
            for text in part.column(1).to_pylist():
                own.append(hashlib.sha256((text or "").encode()).digest())
                words = words_of(text)
                if not words:
                    cls.append(None), n.append(0), keys.append(None)
                    continue
                h = signer.hashes(words)
                cls.append(hashlib.sha256(b" ".join(words)).digest())
                n.append(len(h))
                keys.append(signer.bands_of(h))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(own, pa.binary()), pa.array(cls, pa.binary()),
                 pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "digest", "class", "n", "bands"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType),
                           T.StructField("digest", T.BinaryType()),
                           T.StructField("class", T.BinaryType()), T.StructField("n", T.LongType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])
    return src.mapInArrow(run, schema)


def _different_texts(df: DataFrame, text_col: str) -> DataFrame:
    """(digest, text), every text once per task: copies of one text, however
    many, are not sent to one place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in text_slices(batches, "text"):
            own = [hashlib.sha256((t or "").encode()).digest() for t in part.column(0).to_pylist()]
            new = []
            for d in own:
                new.append(d not in seen)
                seen.add(d)
            mask = pa.array(new, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.binary()).filter(mask), part.column(0).filter(mask)], ["digest", "text"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "digest binary, text string")


def _verify_hubs(per: int, percent: int):
    """(hub, chunk, node, text) rows, each hub's chunks together and the hub
    itself first -> linked (u, v)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_set: set = set()
        for part in text_slices(batches, "text"):
            u, v = [], []
            for hub, node, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3)):
                own = shingle_set(words_of(text.as_py()), per)
                if node == hub:
                    hub_set = own
                elif similar(hub_set, own, percent):
                    u.append(hub)
                    v.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    return run


def _verify_chunks(per: int, percent: int):
    """One meeting of two chunks of a bucket -> links between components."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["node", "label", "chunk", "text", "bands", "band"]).to_pylist()
        sets = [shingle_set(words_of(r["text"]), per) for r in rows]
        size = np.array([len(s) for s in sets])
        keys = np.array([r["bands"] for r in rows], np.int64)
        chunk = np.array([r["chunk"] for r in rows])
        left, right, band = table["i"][0].as_py(), table["j"][0].as_py(), rows[0]["band"]
        parent: dict = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out_u, out_v = [], []
        for a in np.flatnonzero(chunk == left):
            # not smaller than allowed, and not compared in an earlier band
            ok = (chunk == right) & (100 * np.minimum(size, size[a]) >= percent * np.maximum(size, size[a]))
            if left == right:
                ok[:a + 1] = False
            b = np.flatnonzero(ok)
            earlier = int(np.argmax(keys[a] == band))
            b = b[~(keys[b, :earlier] == keys[a, :earlier]).any(axis=1)]
            for k in b:
                u, v = root(rows[a]["label"]), root(rows[k]["label"])
                if u != v and similar(sets[a], sets[k], percent):
                    parent[max(u, v)] = min(u, v)
                    out_u.append(rows[a]["node"])
                    out_v.append(rows[k]["node"])
        return pa.table({"u": pa.array(out_u, pa.int64()), "v": pa.array(out_v, pa.int64())})
    return run


def _decided(df: DataFrame, id_col: str, text_col: str, words_per: int = WORDS_PER_SHINGLE,
             percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
             chunk: int = CHUNK_MEMBERS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """(id, digest, n, component, kept) of every row of ``df``."""
    signed = materialise(signatures(df, id_col, text_col, words_per, bands, rows)
                         .withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes = materialise(
        signed.filter(F.col("class").isNotNull()).groupBy("class")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "digest")).alias("first"),
             F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select("node", "n", F.explode("bands").alias("band"))
    buckets = (members.groupBy("band").agg(F.count("*").alias("c"),
                                           F.min(F.struct("node", "n")).alias("hub"))
               .filter("c > 1").select("band", F.col("hub.node").alias("hub"),
                                       F.col("hub.n").alias("hub_n")))
    met = materialise(members.join(buckets, "band"), "buckets")
    # the text of the row that stands for a class, once per class
    wanted = (classes.select("node", F.col("first.digest").alias("digest"))
              .join(met.select("node").distinct(), "node", "left_semi"))
    texts = materialise(_different_texts(df, text_col).join(wanted, "digest")
                        .dropDuplicates(["digest"]).select("node", "text"), "bucket-texts")

    # 2. every member against its bucket's hub
    pairs = materialise(
        met.filter("node <> hub")
        .filter(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
        .select("hub", "node").distinct(), "hub-pairs")
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))
    dealt = pairs.join(sizes, "hub").select(
        "hub", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), "node")
    own = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"),
                       F.col("hub").alias("node"))
    order = ["hub", "chunk", F.col("node") != F.col("hub")]
    shown = (dealt.unionByName(own).join(texts, "node").select("hub", "chunk", "node", "text")
             .repartition("hub", "chunk").sortWithinPartitions(*order))
    links = materialise(shown.mapInArrow(_verify_hubs(words_per, percent), "u long, v long"), "links")
    first = materialise(components(links), "components")

    # 3. pairs of a bucket without its hub, in different components
    rest = (met.filter("node <> hub").join(first, "node", "left")
            .select("band", "node", "n", F.coalesce("label", "node").alias("label")))
    per_label = rest.groupBy("band", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    parts = lambda c, s: F.greatest(F.ceil(c / chunk), F.ceil(s / chunk_shingles))
    open_ = (per_label.groupBy("band")
             .agg(F.max(F.struct("c", "label", "s")).alias("most"), F.sum("c").alias("c"),
                  F.sum("s").alias("s"), F.count("*").alias("labels"))
             .filter("labels > 1")
             .select("band", F.col("most.label").alias("major"),
                     parts(F.col("c") - F.col("most.c"), F.col("s") - F.col("most.s")).alias("minors"),
                     parts(F.col("most.c"), F.col("most.s")).alias("majors")))
    is_minor = F.col("label") != F.col("major")
    spread = F.xxhash64("node", "band")
    at = F.when(is_minor, F.pmod(spread, F.col("minors"))).otherwise(
        F.col("minors") + F.pmod(spread, F.col("majors")))
    meet = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    lower = F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.col("chunk"), F.col("minors") - 1)),
                        lambda i: meet(i, F.col("chunk")))
    last = F.col("minors") + F.col("majors") - 1
    upper = F.when(is_minor & (F.col("chunk") < last), F.transform(
        F.sequence(F.col("chunk") + 1, last), lambda j: meet(F.col("chunk"), j)))
    none = F.array().cast("array<struct<i:bigint,j:bigint>>")
    placed = (rest.join(open_, "band").withColumn("chunk", at)
              .withColumn("meet", F.explode(F.concat(lower, F.coalesce(upper, none))))
              .select("band", "node", "label", "chunk", "meet.i", "meet.j"))
    more = (placed.join(texts, "node").join(classes.select("node", "bands"), "node")
            .groupBy("band", "i", "j").applyInArrow(_verify_chunks(words_per, percent), "u long, v long"))
    known = first.select(F.col("node").alias("u"), F.col("label").alias("v"))
    final = components(known.unionByName(materialise(more, "links")))

    label = materialise(classes.select("class", "node", "first").join(final, "node", "left")
                        .select("class", "first", F.coalesce("label", "node").alias("label")), "labels")
    stands = label.groupBy("label").agg(F.min("first").alias("best"))
    told = label.join(stands, "label").select("class", F.col("best.id").alias("component"),
                                              F.col("best.row").alias("best"))
    out = signed.select("id", "digest", "class", "n", "row").join(told, "class", "left")
    alone = F.col("class").isNull()
    return out.select("id", "digest", "n",
                      F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"),
                      (alone | (F.col("row") == F.col("best"))).alias("kept"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``df``."""
    return _decided(df, id_col, text_col, **options).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"), "kept")


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     **options) -> DataFrame:
    """The rows of ``df`` that stay: one of each component. Rows are told apart
    by identifier and text; of those that agree in both, one stays."""
    stay = materialise(
        _decided(df, id_col, text_col, **options).groupBy("id", "digest")
        .agg(F.bool_or("kept").alias("kept"), F.bool_and("kept").alias("all")).filter("kept")
        .select(F.col("id").alias("stay_id"), F.col("digest").alias("stay_digest"), "all"), "stay")
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"),
                      F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"))

    def rows(wanted: DataFrame) -> DataFrame:
        return whole.join(wanted, (F.col("digest") == F.col("stay_digest"))
                          & F.col("id").eqNullSafe(F.col("stay_id")), "left_semi")

    out = rows(stay.filter("all")).select("whole.*")
    some = stay.filter("not all")
    if some.isEmpty():
        return out
    return out.union(rows(some).dropDuplicates(["digest", "id"]).select("whole.*"))
