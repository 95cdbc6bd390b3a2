"""Language-model scores from a probabilistic suffix tree over words.

Tokens are a text's words (A-Z lowered) and one end. A state of the tree is a
context of up to ``depth`` words; a token is scored by the longest state that
is a suffix of what stands before it.

1. Words of the training texts are counted; ``N`` tokens, ``V`` different ones.
   The root's distribution is the smoothed one: (c + 0.1) / (N + 0.1 (V + 1)).
2. Words with at least N / 2**SHIP_BITS occurrences (so at most 2**SHIP_BITS of
   them) get numbers and every text is written once as its number sequence, the
   keys of its other words aside; these meet their counts bucket by bucket.
3. Every run of up to ``depth`` + 1 words with at least ``LEAST_FLOOR`` training
   occurrences is listed, whatever the size of the corpus. Level by level, runs
   whose shorter runs may be listed are counted in SLOT_BITS slots by their key;
   a run whose slot stays below the floor is below it, too. The others are then
   counted by their keys, each count in one bucket of keys. The slots spare
   rows and decide nothing.
4. A context keeps its own next-word distribution: counts less a discount, the
   rest spread as its suffix has it (so each sums to one). It becomes a state if
   the likelihood ratio of its counts against its suffix's distribution is
   beyond chance (mean and three deviations of the chi-square law), and then
   all its suffixes are states too. Counts, distributions and states are tables
   that joins and groups derive from each other.
5. A text's score is the root's score of all tokens and a sum over its runs: a
   state adds the log weight that it leaves to its suffix, and a listed run
   after a state the log ratio of its probability to its suffix's instead.
   Weights of runs with at least N / 2**SHIP_BITS occurrences go to the tasks;
   all others meet the texts that hold them bucket by bucket.

A run's key is 64 bits of a polynomial over its words' xxhash64. Two of k runs
share one with a chance of k * k / 2**65 (under 1e-4 for 50 million runs), and
their counts would then be added. Words are counted as they are; those without
a number are met by their xxhash64 in a bucket of their crc32, so two of k words
share a place with a chance of k * k / 2**70 (less with more than 32 buckets).

What a step shuffles and sends to the tasks is dropped with its end, and tables
that no later step reads are deleted: the disk holds the texts, one step and its
results.

Defined results: a null or empty text has one token, its end. A row without
identifier is neither learnt from nor held out. Repeated rows are learnt and
scored each. Without training texts every token has probability 1 at the root.
An empty table gives an empty result. Only identifier and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, shuffles_dropped, text_slices

DEPTH = 3
SHIP_BITS = 20
LEAST_FLOOR = 4
PSEUDO = 0.1
DISCOUNT = 0.5
FOLDS, HELD_OUT = 10, 0
END = b" "          # no word holds a space
BLOCK_TOKENS = 1 << 18
HELD_RUNS = 1 << 18
HELD_BYTES = 1 << 25                    # of words that a task counts at a time
SENT_KEYS = 1 << 21                     # of rare runs that a task packs at a time
SENT_TEXTS = 1 << 16
IDS_BYTES = 1 << 20
SLOT_BITS = 28
RANGE_BITS = 5                          # slots are added up in 2**RANGE_BITS ranges
BUCKET_TOKENS = 1 << 23
MAP_BITS = 15                           # bits of one of Spark's bitmaps
CHECK_BITS = 16
HASH_SEED = 42                          # of Spark's xxhash64
STEP = np.uint64(0x9E3779B97F4A7C15)    # a run's key: its context's * STEP + its last word's


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, how many each has)."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = found.flatten(), np.zeros(len(found) + 1, np.int64)
    np.cumsum(pc.list_value_length(found).to_numpy(), out=offsets[1:])
    there = pc.not_equal(pc.binary_length(words), 0)
    before = np.zeros(len(words) + 1, np.int64)
    np.cumsum(there.to_numpy(zero_copy_only=False), out=before[1:])
    return words.filter(there).cast(pa.binary()), np.diff(before[offsets])


def word_keys(words: Iterable[bytes]) -> np.ndarray:
    """What Spark's xxhash64 gives, unsigned."""
    return np.fromiter((xxhash.xxh64_intdigest(w, HASH_SEED) for w in words), np.uint64)


def steps(length: int) -> tuple[np.uint64, np.uint64]:
    """What a first word is multiplied by in a run's key, and what undoes it."""
    by = pow(int(STEP), length - 1, 1 << 64)
    return np.uint64(by), np.uint64(pow(by, -1, 1 << 64))


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys' slots are set (a slot for each bit of ``bitmap``)."""
    at = slots(keys, (len(bitmap) * 8).bit_length() - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def walk(words: np.ndarray, starts: np.ndarray, most: int):
    """Blocks of the word keys of whole texts (``starts``: is it a text's first
    token) -> (from, to, per length 2.. ``most`` the runs that end at each
    token: is there one, its key, its context's, its suffix's). A block sees as
    many tokens before it as a run may hold."""
    for at in range(0, len(words), BLOCK_TOKENS):
        low, to = max(0, at - most + 1), min(len(words), at + BLOCK_TOKENS)
        last, first = words[low:to], starts[low:to]
        key, there, cut, runs = last, np.ones(to - low, bool), slice(at - low, None), []
        for _ in range(2, most + 1):
            context, before = np.zeros_like(key), np.zeros_like(there)
            context[1:], before[1:] = key[:-1], there[:-1]
            there, suffix, key = before & ~first, key, context * STEP + last
            runs.append((there[cut], key[cut], context[cut], suffix[cut]))
        yield at, to, runs


def flattened(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of all rows, first-token marks, offsets) of packed sequences."""
    parts = [np.frombuffer(x.as_py(), np.int32) for x in column]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    starts = np.zeros(len(ids), bool)
    starts[offsets[:-1]] = True          # every row has its end at least
    return ids, starts, offsets


def hashed(batch: pa.RecordBatch, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word keys of all rows, first-token marks, offsets) of the columns
    ``ids`` and ``rare``; ``numbers``: the numbered words' keys."""
    ids, starts, offsets = flattened(batch.column("ids"))
    words = numbers[np.maximum(ids, 0)]
    words[ids < 0] = joined(batch.column("rare"), np.uint64)
    return words, starts, offsets


def joined(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def cells_of(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary cells of ``values``, cut at ``offsets``."""
    ends = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1,
                                 [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


class Counted:
    """Word counts of the training texts: ``table`` (word, n), sums, and the
    numbered words."""

    def __init__(self, training: DataFrame, share_bits: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, ends = [], 0, 0

            def out():
                found = pc.value_counts(pa.chunked_array(held, pa.binary()))
                return pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([found.field("values"), pa.array([END], pa.binary())]),
                     pa.concat_arrays([found.field("counts"), pa.array([ends], pa.int64())])], ["word", "n"])

            for part in text_slices(batches, "text"):
                words, _ = words_of(part.column(0))
                held.append(words)
                size += words.nbytes
                ends += part.num_rows
                if size > HELD_BYTES:
                    yield out()
                    held, size, ends = [], 0, 0
            if ends:
                yield out()

        self.table = materialise(training.select("text").mapInArrow(run, "word binary, n long")
                                 .groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
        self.tokens, self.different = (x or 0 for x in self.table.agg(F.sum("n"), F.count("*")).first())
        self.floor = max(LEAST_FLOOR, -(-self.tokens >> share_bits) if share_bits is not None else 0)
        self.shipped = max(LEAST_FLOOR, -(-self.tokens >> SHIP_BITS))
        # at most 2**SHIP_BITS words, and the end
        rows = (self.table.filter((F.col("n") >= self.shipped) | (F.col("word") == END))
                .orderBy(F.col("n").desc(), "word").toArrow())
        known = rows.num_rows > 0
        self.words = rows.column("word").combine_chunks() if known else pa.array([END], pa.binary())
        self.counts = rows.column("n").to_numpy() if known else np.zeros(1, np.int64)
        self.keys = word_keys(self.words.to_pylist())
        self.slot_bits = min(SLOT_BITS, max(16, self.tokens.bit_length() + 2))
        self.bucket_bits = min(CHECK_BITS, max(5, (self.tokens // BUCKET_TOKENS).bit_length()))

    def root(self, counts):
        return (counts + PSEUDO) / (self.tokens + PSEUDO * (self.different + 1))


def numbered(texts: DataFrame, counted: Counted) -> DataFrame:
    """(row, id, trains, held_out, n_tokens, ids, rare and checks: keys and
    crc32 bits of other words, known and base: of the numbered words). Another
    word stands as -1 in ``ids``."""
    shipped = texts.sparkSession.sparkContext.broadcast(
        (counted.words, np.log10(counted.root(counted.counts)), counted.counts > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, base_of, seen = shipped.value
        end = pc.index(numbers, pa.scalar(END, pa.binary())).as_py()
        for part in text_slices(batches, "text"):
            words, sizes = words_of(part.column(4))
            coded = words.dictionary_encode()
            different, at = coded.dictionary, coded.indices.to_numpy()
            number = pc.fill_null(pc.index_in(different, value_set=numbers), -1).to_numpy()
            other = np.flatnonzero(number < 0)
            odd = different.take(pa.array(other)).to_pylist()
            keys, checks = np.zeros(len(number), np.uint64), np.zeros(len(number), np.uint16)
            keys[other] = word_keys(odd)
            checks[other] = np.fromiter((zlib.crc32(w) >> 32 - CHECK_BITS for w in odd), np.uint16, len(odd))
            offsets = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(sizes + 1, out=offsets[1:])
            ids = np.full(offsets[-1], end, np.int32)
            inside = np.ones(len(ids), bool)
            inside[offsets[1:] - 1] = False
            ids[inside] = number[at]
            rare = at[number[at] < 0]
            text = np.repeat(np.arange(len(sizes)), sizes + 1)
            rare_ends = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(np.bincount(text[ids < 0], minlength=len(sizes)), out=rare_ends[1:])
            text, own = text[ids >= 0], ids[ids >= 0]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:4], pa.array(sizes + 1, pa.int64()), cells_of(ids, offsets),
                 cells_of(keys[rare], rare_ends), cells_of(checks[rare], rare_ends),
                 pa.array(np.bincount(text, seen[own], len(sizes)).astype(np.int64)),
                 pa.array(np.bincount(text, base_of[own], len(sizes)))], schema.names)

    schema = T.StructType([*texts.schema.fields[:4], T.StructField("n_tokens", T.LongType()),
                           *[T.StructField(c, T.BinaryType()) for c in ("ids", "rare", "checks")],
                           T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType())])
    out = materialise(texts.mapInArrow(run, schema), "lm-texts", compression="zstd")
    shipped.destroy()
    return out


def bitmap_of(keyed: DataFrame, bits: int) -> np.ndarray:
    """A bit for each slot, set where ``keyed`` has a key."""
    slot = F.shiftrightunsigned("key", 64 - bits)
    rows = (keyed.groupBy(F.shiftright(slot, MAP_BITS).alias("part"))
            .agg(F.bitmap_construct_agg(slot.bitwiseAND((1 << MAP_BITS) - 1)).alias("bits")).collect())
    out = np.zeros(1 << bits - 3, np.uint8)
    size = 1 << MAP_BITS - 3
    for r in rows:
        out[r["part"] * size:(r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def unpacked(told: bytes, size: int, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(pa.decompress(told, size * np.dtype(kind).itemsize, codec="zstd"), kind)


def planes(values: np.ndarray) -> bytes:
    """Compressed whole numbers, byte by byte: small ones leave planes of zeros."""
    return packed(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T))


def from_planes(told: bytes, size: int, kind=np.uint64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(unpacked(told, size * width, np.uint8).reshape(width, size).T).view(kind).ravel()


def named(keys: np.ndarray, numbers: np.ndarray, order: np.ndarray) -> tuple[bytes, bytes]:
    """Word keys as numbers from 1 and the keys of words without one, which
    stand as 0 (``order`` sorts ``numbers``, the numbered words' keys)."""
    at = order[np.minimum(np.searchsorted(numbers, keys, sorter=order), len(order) - 1)]
    there = numbers[at] == keys
    return planes(np.where(there, at + 1, 0).astype(np.uint32)), keys[~there].tobytes()


def keys_named(told: bytes, odd: bytes, size: int, numbers: np.ndarray) -> np.ndarray:
    at = from_planes(told, size, np.uint32).astype(np.int64)
    keys = numbers[np.maximum(at - 1, 0)]
    keys[at == 0] = np.frombuffer(odd, np.uint64)
    return keys


def cut_points(keys: np.ndarray, bits: int, of: int = 64) -> list[int]:
    """Where each of 2**bits buckets, by the first of ``of`` bits, begins and
    ends in sorted keys."""
    edges = np.arange(1, 1 << bits, dtype=keys.dtype) << keys.dtype.type(of - bits)
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


def count_slots(coded: DataFrame, counted: Counted, bitmap: np.ndarray, length: int) -> np.ndarray:
    """Slots that reach the floor with all training runs of ``length`` words
    whose shorter runs are marked in ``bitmap``."""
    bits, floor, numbers = counted.slot_bits, counted.floor, counted.keys
    range_bits = bits - RANGE_BITS
    small = np.uint8 if floor < 256 else np.int32
    shipped = coded.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        held, held_n, size = [], [], 0

        def merged():
            found, back = np.unique(np.concatenate(held), return_inverse=True)
            return found, np.minimum(np.bincount(back, np.concatenate(held_n)), floor).astype(small)

        def out(found, n):
            ends = cut_points(found, RANGE_BITS, bits)
            some = [(b, x, y) for b, (x, y) in enumerate(zip(ends, ends[1:])) if y > x]
            steps = [np.diff(found[x:y], prepend=np.int32(b << range_bits)) for b, x, y in some]
            widths = [4 if s.max() > 0xFFFF else 2 if s.max() > 0xFF else 1 for s in steps]
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _, _ in some], pa.int32()), pa.array(widths, pa.int32()),
                 pa.array([s.astype(f"u{w}").tobytes() for s, w in zip(steps, widths)], pa.binary()),
                 pa.array([n[x:y].tobytes() for _, x, y in some], pa.binary())],
                ["bucket", "width", "steps", "n"])

        for whole in batches:
            for batch in text_slices([whole], "ids", IDS_BYTES):
                words, starts, _ = hashed(batch, numbers)
                for _, _, runs in walk(words, starts, length):
                    there, key, context, suffix = runs[-1]
                    ok = np.flatnonzero(there)
                    ok = ok[marked(known, context[ok])]
                    ok = ok[marked(known, suffix[ok])]
                    found, n = np.unique(slots(key[ok], bits).astype(np.int32), return_counts=True)
                    held.append(found)
                    held_n.append(np.minimum(n, floor).astype(small))
                    size += len(found)
                    if size > 8 * HELD_RUNS:     # 8 bytes each at most
                        found, n = merged()
                        if len(found) > 4 * HELD_RUNS:
                            yield out(found, n)
                            held, held_n, size = [], [], 0
                        else:
                            held, held_n, size = [found], [n], len(found)
        if size:
            yield out(*merged())

    def add(told: pa.Table) -> pa.Table:
        total = np.zeros(1 << range_bits, np.int64)
        for width, steps, n in zip(*(told.column(c).to_pylist() for c in ("width", "steps", "n"))):
            total[np.cumsum(np.frombuffer(steps, f"u{width}"), dtype=np.int64)] += np.frombuffer(n, small)
        bits = np.packbits(total >= floor, bitorder="little")
        return pa.table({"bucket": pa.array(told.column("bucket").to_pylist()[:1], pa.int32()),
                         "bits": pa.array([bits.tobytes()], pa.binary())})

    rows = (coded.filter("trains").select("ids", "rare")
            .mapInArrow(run, "bucket int, width int, steps binary, n binary")
            .groupBy("bucket").applyInArrow(add, "bucket int, bits binary").collect())
    shipped.destroy()
    out = np.zeros(1 << bits - 3, np.uint8)
    size = 1 << range_bits - 3
    for r in rows:
        out[r["bucket"] * size:(r["bucket"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def count_runs(coded: DataFrame, counted: Counted, bitmap: np.ndarray, depth: int) -> DataFrame:
    """(length, key, context, suffix, n) of all training runs of 2 to depth + 1
    words that reach the floor; the others' keys need not be in ``bitmap``."""
    floor, bucket_bits = counted.floor, counted.bucket_bits
    shipped = coded.sparkSession.sparkContext.broadcast(bitmap)
    words_shipped = coded.sparkSession.sparkContext.broadcast((counted.keys, np.argsort(counted.keys)))

    def merged(parts):
        key, context, suffix, n = (np.concatenate(x) for x in zip(*parts))
        key, at, back = np.unique(key, return_index=True, return_inverse=True)
        return key, context[at], suffix[at], np.bincount(back, n).astype(np.int64)

    def out(length, parts):
        key, context, suffix, n = merged(parts)
        first, last = (key - suffix) * steps(length)[1], key - context * STEP
        ends = cut_points(key, bucket_bits)
        told = []
        for b, (x, y) in enumerate(zip(ends, ends[1:])):
            if y > x:       # equal contexts, and so first words, stand together
                by = x + np.argsort(context[x:y])
                told.append((b, length, y - x, planes(np.diff(context[by], prepend=np.uint64(0))),
                             *(named(first[by], *words_shipped.value) if length > 2 else (None, None)),
                             *named(last[by], *words_shipped.value), planes(n[by].astype(np.int32))))
        kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*told), kinds)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = shipped.value, words_shipped.value[0]
        held = {m: [] for m in range(2, depth + 2)}
        for whole in batches:
            for batch in text_slices([whole], "ids", IDS_BYTES):
                words, starts, _ = hashed(batch, numbers)
                for _, _, runs in walk(words, starts, depth + 1):
                    for m, (there, key, context, suffix) in enumerate(runs, 2):
                        ok = np.flatnonzero(there)
                        for k in (key, context, suffix):
                            ok = ok[marked(known, k[ok])]
                        if len(ok):
                            held[m].append(merged([(key[ok], context[ok], suffix[ok], np.ones(len(ok), np.int64))]))
                for m, parts in held.items():
                    if sum(len(p[0]) for p in parts) > 2 * HELD_RUNS:
                        parts[:] = [merged(parts)]
                        if len(parts[0][0]) > HELD_RUNS:
                            yield out(m, parts)
                            parts.clear()
        for m, parts in held.items():
            if parts:
                yield out(m, parts)

    def add(told: pa.Table) -> pa.Table:
        parts = {}
        for r in told.to_pylist():
            numbers, size = words_shipped.value[0], r["size"]
            context = np.cumsum(from_planes(r["context"], size), dtype=np.uint64)
            first = keys_named(r["first"], r["odd_first"], size, numbers) if r["first"] else context
            last = keys_named(r["last"], r["odd_last"], size, numbers)
            key = context * STEP + last
            parts.setdefault(r["length"], []).append(
                (key, context, key - first * steps(r["length"])[0], from_planes(r["n"], size, np.int32)))
        tables = [pa.table([np.zeros(0, np.int64)] * 5, ["length", "key", "context", "suffix", "n"])]
        for m, some in parts.items():
            *keys, n = merged(some)
            listed = n >= floor
            tables.append(pa.table([np.full(int(listed.sum()), m), *(k[listed].view(np.int64) for k in keys),
                                    n[listed]], ["length", "key", "context", "suffix", "n"]))
        return pa.concat_tables(tables)

    columns = ["bucket", "length", "size", "context", "first", "odd_first", "last", "odd_last", "n"]
    fields = ", ".join([f"{c} int" for c in columns[:3]] + [f"{c} binary" for c in columns[3:]])
    out = materialise(coded.filter("trains").select("ids", "rare").mapInArrow(run, fields)
                      .groupBy("bucket").applyInArrow(add, "length long, key long, context long, suffix long, n long"),
                      "lm-runs")
    shipped.destroy()
    words_shipped.destroy()
    return out


def suffix_tree(coded: DataFrame, counted: Counted, depth: int = DEPTH) -> DataFrame:
    """(key, n, weight) of the runs that add to a text's score, the parts that
    a run has as a state and after one as rows of their own."""
    words = (counted.table.filter(F.col("n") >= counted.floor)
             .groupBy(F.xxhash64("word").alias("key")).agg(F.sum("n").alias("n")))
    bitmap = bitmap_of(words, counted.slot_bits)
    for length in range(2, depth + 2):
        bitmap |= count_slots(coded, counted, bitmap, length)
    runs = count_runs(coded, counted, bitmap, depth)

    # a context's and a suffix's row are there: they are as frequent as the run
    counts = words.unionByName(runs.select("key", "n"))
    owned = (runs.join(counts.select(F.col("key").alias("context"), F.col("n").alias("before")), "context")
             .withColumn("own", (F.col("n") - DISCOUNT) / F.col("before")))
    chances = (words.select(F.col("key").alias("suffix"), counted.root(F.col("n")).alias("above"),
                            F.lit(None).cast("long").alias("shorter"))
               .unionByName(owned.select(F.col("key").alias("suffix"), F.col("own").alias("above"),
                                         F.col("context").alias("shorter"))))
    cells = materialise(owned.join(chances, "suffix"), "lm-cells")

    # likelihood ratio against the suffix, what is not listed as one more cell
    other = F.greatest(F.col("before") - F.col("known"), F.lit(0))
    upper = F.greatest(1 - F.col("all_above"), F.lit(1e-12))
    gain = F.col("gain") + F.when(other > 0, other * F.log(other / F.col("before") / upper)).otherwise(0.0)
    contexts = (cells.groupBy("context")
                .agg(F.max("length").alias("length"), F.max("shorter").alias("shorter"),
                     F.max("before").alias("before"), F.sum("n").alias("known"),
                     F.sum("own").alias("all_own"), F.sum("above").alias("all_above"), F.count("*").alias("cells"),
                     F.sum(F.col("n") * F.log(F.col("n") / F.col("before") / F.col("above"))).alias("gain"))
                .select("context", "length", "shorter", "before",
                        F.log10(F.greatest(1 - F.col("all_own"), F.lit(1e-12)) / upper).alias("back"),
                        (2 * gain > F.col("cells") + 3 * F.sqrt(2 * F.col("cells"))).alias("state")))
    contexts = materialise(contexts, "lm-contexts")

    # suffixes of states are states
    levels, told = [], contexts.filter(F.lit(False)).select("context")
    for length in range(depth + 1, 1, -1):
        level = (contexts.filter(F.col("length") == length)
                 .join(told.withColumn("told", F.lit(True)), "context", "left")
                 .filter(F.col("state") | F.col("told").isNotNull()))
        levels.append(level.select("context", "before", "back"))
        told = level.select(F.col("shorter").alias("context")).distinct()
    states = levels[0]
    for level in levels[1:]:
        states = states.unionByName(level)
    ratio = F.log10(F.col("own") / F.col("above"))
    weights = (states.select(F.col("context").alias("key"), F.col("before").alias("n"), F.col("back").alias("weight"))
               .unionByName(cells.join(states.select("context", "back"), "context")
                            .select("key", "n", (ratio - F.col("back")).alias("weight"))))
    weights = materialise(weights, "lm-weights")
    for done in (runs, cells, contexts):
        discard(done)
    return weights


def looked_up(keys: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Weights of ``wanted`` keys, 0 where there is none (``keys``: sorted)."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, weights[at], 0.0)


def sorted_weights(told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(told.column("key").to_numpy().astype(np.int64).view(np.uint64), return_inverse=True)
    return keys, np.bincount(at, told.column("weight").to_numpy(), len(keys))


def text_parts(coded: DataFrame, counted: Counted, weights: DataFrame, depth: int) -> DataFrame:
    """(row, more_base, more_known, gain): what a text's words without a number
    add to its root score and known words, and what its runs add."""
    numbers, bucket_bits = counted.keys, counted.bucket_bits
    frequent = F.col("n") >= counted.shipped      # at most 2**SHIP_BITS of each length
    rest = weights.filter(~frequent)
    near = weights.filter(frequent).select("key", "weight").toArrow()
    shipped = coded.sparkSession.sparkContext.broadcast(
        (*sorted_weights(near), bitmap_of(rest, counted.slot_bits)))
    most = counted.tokens + PSEUDO * (counted.different + 1)
    columns = {"bucket": pa.int64(), "batch": pa.int64(), "texts": pa.int32(), "word": pa.bool_(),
               "size": pa.int32(), "keys": pa.binary(), "times": pa.binary(), "told": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_keys, near_weights, far = shipped.value
        near_bits = np.zeros(1 << 20, np.uint8)
        at = slots(near_keys, 23)
        np.bitwise_or.at(near_bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        rows, gains, met, size = [], [], {False: [], True: []}, 0

        def out():
            row, gain = np.concatenate(rows), np.concatenate(gains)
            batch = int(row[0])
            told = [(batch & (1 << bucket_bits) - 1, batch, len(row), None, 0, None, row.tobytes(), gain.tobytes())]
            for word, parts in met.items():
                text, key, bucket = (np.concatenate(x) for x in zip(*parts))
                by = np.lexsort((key, bucket)) if word else np.argsort(key)
                text, key, bucket = text[by], key[by], bucket[by]
                ends = np.searchsorted(bucket, np.arange((1 << bucket_bits) + 1))
                for b, (x, y) in enumerate(zip(ends, ends[1:])):
                    if y > x:
                        first = np.flatnonzero(np.diff(key[x:y], prepend=~key[x:x + 1]))
                        told.append((b, batch, len(row), word, len(first),
                                     planes(np.diff(key[x:y][first], prepend=np.uint64(0))),
                                     packed(np.diff(first, append=y - x).astype(np.int32)), text[x:y].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*told), columns.values())],
                                              list(columns))

        for whole in batches:
            for batch in text_slices([whole], "ids", IDS_BYTES):
                if rows and (size > SENT_KEYS or sum(map(len, rows)) + batch.num_rows > SENT_TEXTS):
                    yield out()
                    rows, gains, met, size = [], [], {False: [], True: []}, 0
                before = sum(map(len, rows))
                words, starts, offsets = hashed(batch, numbers)
                texts = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                gain = np.zeros(batch.num_rows)

                def meets(word, text, key, bucket):
                    met[word].append(((text + before).astype(np.int32), key, bucket.astype(np.uint16)))
                    return len(key)

                for at, to, runs in walk(words, starts, depth + 1):
                    text = texts[at:to]
                    for there, key in [(np.ones(to - at, bool), words[at:to]), *(r[:2] for r in runs)]:
                        ok = np.flatnonzero(there)
                        now = ok[marked(near_bits, key[ok])]
                        gain += np.bincount(text[now], looked_up(near_keys, near_weights, key[now]), len(gain))
                        now = ok[marked(far, key[ok])]
                        size += meets(False, text[now], key[now], slots(key[now], bucket_bits))
                rare = joined(batch.column("rare"), np.uint64)
                counts = pc.binary_length(batch.column("rare")).to_numpy() // 8
                size += meets(True, np.repeat(np.arange(batch.num_rows), counts), rare,
                              joined(batch.column("checks"), np.uint16) >> np.uint16(CHECK_BITS - bucket_bits))
                rows.append(batch.column("row").to_numpy().astype(np.int64))
                gains.append(gain)
        if rows:
            yield out()

    def meet(told: pa.Table, here: pa.Table) -> pa.Table:
        values = {word: sorted_weights(here.filter(pc.equal(here.column("word"), word))) for word in (False, True)}
        out = {}
        for r in told.select(["batch", "texts", "word", "size", "keys", "times", "told"]).to_pylist():
            sums = out.setdefault(r["batch"], [None, *np.zeros((3, r["texts"]))])
            if r["word"] is None:
                sums[0] = r["times"]
                sums[3] += np.frombuffer(r["told"])
                continue
            key = np.cumsum(from_planes(r["keys"], r["size"]), dtype=np.uint64)
            times = unpacked(r["times"], r["size"], np.int32)
            found = looked_up(*values[r["word"]], key)
            add = lambda x: np.bincount(np.frombuffer(r["told"], np.int32), np.repeat(x, times), r["texts"])  # noqa: E731, B023
            if r["word"]:
                sums[1] += add(np.log10((found + PSEUDO) / most))
                sums[2] += add(found > 0)
            else:
                sums[3] += add(found)
        return pa.table([pa.array(list(out), pa.int64()), pa.array([x[0] for x in out.values()], pa.binary()),
                         *[pa.array([packed(x[k]) for x in out.values()], pa.binary()) for k in (1, 2, 3)]],
                        ["batch", "rows", *sums_of])

    def add_up(told: pa.Table) -> pa.Table:
        row = np.frombuffer(next(x for x in told.column("rows").to_pylist() if x is not None), np.int64)
        base, known, gain = (sum(unpacked(x, len(row), np.float64) for x in told.column(c).to_pylist())
                             for c in sums_of)
        return pa.table([row, base, np.rint(known).astype(np.int64), gain], ["row", *sums_of])

    sums_of = ["more_base", "more_known", "gain"]
    sent = coded.select("row", "ids", "rare", "checks").mapInArrow(
        run, "bucket long, batch long, texts int, word boolean, size int, keys binary, times binary, told binary")
    dealt = (rest.select(F.shiftrightunsigned("key", 64 - bucket_bits).alias("bucket"), F.lit(False).alias("word"),
                         "key", "weight")
             .unionByName(counted.table.filter(F.col("n") < counted.shipped)
                          .select(F.shiftright(F.crc32("word"), 32 - bucket_bits).alias("bucket"),
                                  F.lit(True).alias("word"), F.xxhash64("word").alias("key"),
                                  F.col("n").cast("double").alias("weight"))))
    return (sent.groupBy("bucket").cogroup(dealt.groupBy("bucket"))
            .applyInArrow(meet, "batch long, rows binary, more_base binary, more_known binary, gain binary")
            .groupBy("batch").applyInArrow(add_up, "row long, more_base double, more_known long, gain double"))


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
              share_bits: int | None = None, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every row of ``df``: log10 probabilities of the whole text. Every run with
    ``LEAST_FLOOR`` training occurrences counts; ``share_bits`` asks for a
    coarser tree, of runs with at least 1 / 2**share_bits of all tokens."""
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % folds
    texts = (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
             .select(F.monotonically_increasing_id().alias("row"), "id",
                     F.coalesce(fold != held_out, F.lit(False)).alias("trains"),
                     F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "text"))
    with shuffles_dropped(df.sparkSession):
        counted = Counted(texts.filter("trains"), share_bits)
        coded = numbered(texts, counted)
        others = text_parts(coded, counted, suffix_tree(coded, counted, depth), depth)
    base = F.col("base") + F.col("more_base")
    return (coded.select("row", "id", "held_out", "n_tokens", "known", "base").join(others, "row")
            .select(F.col("id").alias(id_col), "held_out", "n_tokens",
                    (F.col("known") + F.col("more_known")).alias("n_known"),
                    F.lit(counted.tokens).cast("long").alias("train_tokens"),
                    base.alias("base_score"), (base + F.col("gain")).alias("score")))
