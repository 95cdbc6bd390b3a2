"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that
is a token itself with one probe and one comparison. Tier two: a miss is merged
pair by pair, lowest rank first (leftmost on ties), with a heap over the linked
list of its bytes, so a pre-token of n bytes costs O(n log n).

The tables are built once on the driver (size fixed by the vocabulary) and sent
to the executors as one broadcast variable. Encoding is row-wise: no shuffle.

Defined results: a null text encodes to an empty list; decoding a null list
gives empty bytes; ids outside the vocabulary raise an error.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import added, append, text_slices, without

# Pre-tokens remembered per Python worker and generation (results do not depend
# on it).
MEMO_WORDS = 150_000
ENCODE_BYTES = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank from a rank file (base64 token and rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace.

    Keys fall into buckets; from the fullest down, each bucket takes the first
    displacement that sends all its keys to free slots. One-key buckets store
    their slot itself (as a negative number).
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = m = max(1, n)
        self.seed = 0
        while not self._place(keys, n, m):
            self.seed += 1

    def _place(self, keys: list[bytes], n: int, m: int) -> bool:
        by: list[list[tuple[int, int, int]]] = [[] for _ in range(m)]
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k, self.seed)
            by[h % m].append(((h >> 8) % n, 1 + (h >> 32) % max(1, n - 1), i))
        self.shift = [0] * m
        self.slot_key = [-1] * n
        free = None
        for b in sorted(range(m), key=lambda b: -len(by[b])):
            members = by[b]
            if not members:
                break
            if len(members) == 1:
                if free is None:
                    free = [s for s in range(n) if self.slot_key[s] < 0]
                slot = free.pop()
                self.slot_key[slot] = members[0][2]
                self.shift[b] = -1 - slot
                continue
            for d in range(16 * n):
                slots = [(base + d * step) % n for base, step, _ in members]
                if len(set(slots)) == len(slots) and all(self.slot_key[s] < 0 for s in slots):
                    break
            else:
                return False
            self.shift[b] = d
            for s, (_, _, i) in zip(slots, members):
                self.slot_key[s] = i
        return True

    def find(self, key: bytes) -> int:
        """Index of the only key that can equal ``key`` (the caller compares)."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        d = self.shift[h % self.buckets]
        if d < 0:
            return self.slot_key[-1 - d]
        n = self.n
        return self.slot_key[((h >> 8) % n + d * (1 + (h >> 32) % max(1, n - 1))) % n]


class Encoder:
    """Vocabulary tables and the encoding of single pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = list(ranks)
        self.ids = [ranks[t] for t in self.tokens]
        self.hash = PerfectHash(self.tokens)
        self.table = [b""] * (max(self.ids, default=-1) + 1)
        for t, i in ranks.items():
            self.table[i] = t
        self.worker = None  # made on first use in each Python worker

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        if not word:
            return ()
        i = self.hash.find(word)
        if i >= 0 and self.tokens[i] == word:
            return (self.ids[i],)
        return self.merge(word)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Merge the lowest-ranked neighbouring pair until none is a token.

        A heap entry packs (rank, start, end) into one number; it is stale when
        the parts at its start no longer reach from there to its end."""
        n, get = len(word), self.ranks.get
        bits = n.bit_length()
        low, both = (1 << bits) - 1, 2 * bits
        end = list(range(1, n + 1))        # end of the part that starts here, 0 if none does
        before = list(range(-1, n))        # start of the part that ends at this place
        heap = []
        for i in range(n - 1):
            r = get(word[i:i + 2])
            if r is not None:
                heap.append(r << both | i << bits | i + 2)
        heapify(heap)
        while heap:
            entry = heappop(heap)
            stop, i = entry & low, entry >> bits & low
            mid = end[i]
            if not mid or mid >= stop or end[mid] != stop:
                continue
            end[i], end[mid], before[stop] = stop, 0, i
            if stop < n:
                last = end[stop]
                r = get(word[i:last])
                if r is not None:
                    heappush(heap, r << both | i << bits | last)
            if i:
                first = before[i]
                r = get(word[first:stop])
                if r is not None:
                    heappush(heap, r << both | first << bits | stop)
        ranks, out, i = self.ranks, [], 0
        while i < n:
            out.append(ranks[word[i:end[i]]])
            i = end[i]
        return tuple(out)


class _Memo(dict):
    """Pre-token -> its ids as int32 bytes; a miss is encoded and kept. Words of
    the older generation are taken over when met again."""

    def __init__(self, enc: Encoder, older: dict):
        self.enc, self.older = enc, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("i", self.enc.encode_word(word.encode())).tobytes()
        self[word] = ids
        return ids


class _Worker:
    """Per Python worker: compiled pattern, remembered pre-tokens, and the
    vocabulary's bytes end to end for decoding."""

    def __init__(self, enc: Encoder):
        self.enc, self.words = enc, regex.compile(enc.pattern)
        self.memo = _Memo(enc, {})
        self.lens = np.array([len(t) for t in enc.table], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(enc.table), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS:
            self.memo = _Memo(self.enc, dict(self.memo))
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.words.findall(text))), np.int32)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids end to end, length of each id's bytes)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lens) or not self.lens[ids].all()):
            raise ValueError("token id outside the vocabulary")
        lens = self.lens[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(lens) - lens), lens)
        at += np.arange(len(at))
        return self.bytes[at], lens


def _worker(encoder: Broadcast) -> _Worker:
    enc = encoder.value
    if enc.worker is None:
        enc.worker = _Worker(enc)
    return enc.worker


def make_encoder(df: DataFrame, ranks: dict[bytes, int], pattern: str) -> Broadcast:
    """Tables of one vocabulary, shipped once to every executor."""
    return df.sparkSession.sparkContext.broadcast(Encoder(ranks, pattern))


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def encode_bpe(df: DataFrame, encoder: Broadcast, text_col: str = "text",
               out_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with the token ids of every text (array<int>). With
    ``decoded_col`` also the bytes that those ids decode to, in the same pass."""
    more = [(out_col, T.ArrayType(T.IntegerType()))]
    more += [(decoded_col, T.BinaryType())] if decoded_col else []
    rows = without(df, {n for n, _ in more} - {text_col})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _worker(encoder)
        for part in text_slices(batches, text_col, ENCODE_BYTES):
            texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
            ids = list_array([work.encode(t or "") for t in texts], pa.int32())
            back = {decoded_col: _decoded(work, ids)} if decoded_col else {}
            yield append(part, **{out_col: ids}, **back)

    return rows.mapInArrow(run, added(rows, *more))


def _decoded(work: _Worker, ids: pa.ListArray) -> pa.Array:
    flat = ids.flatten()
    if flat.null_count:
        raise ValueError("token id outside the vocabulary")
    found, lens = work.decode(flat.to_numpy(zero_copy_only=False))
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [
        None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(found)])


def decode_bpe(df: DataFrame, encoder: Broadcast, ids_col: str = "token_ids",
               out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes its token ids stand for."""
    rows = without(df, {out_col} - {ids_col})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _worker(encoder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(part.schema.get_field_index(ids_col))
                yield append(part, **{out_col: _decoded(work, ids)})

    return rows.mapInArrow(run, added(rows, (out_col, T.BinaryType())))
