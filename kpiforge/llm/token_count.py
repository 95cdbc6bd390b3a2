"""Token counts with overlap resynchronisation for huge documents.

A text of at most ``chunk_chars`` characters is cut once into special tokens and
pre-tokens, as the library cuts it, and counted from a bounded memory of
pre-tokens; the library counts those not met before. The cut is made by a
pattern of the same meaning; characters that the two do not put into the same
class (compared once, character by character) send a text to the library as a
whole. A longer one
is cut into chunks that overlap, the chunks are dealt out over the cluster and
encoded with offsets, and neighbouring chunks are spliced at a proven common
boundary.

Why a boundary is proven: the byte-level splitting pattern has no look-behind
and no special token overlaps itself, so how a text is cut from position p on
depends on nothing before p once a pre-token (or special token) starts at p.
If both encodings of an overlap start a pre-token at p they agree from there.
The left chunk's cut is true up to ``MARGIN`` characters before its end: a
pre-token that ends earlier was not shortened by the end (the pattern looks one
character ahead, a special token is shorter than the margin). By induction from
the first chunk, counting each chunk from its left splice to its right splice
counts exactly the tokens of the whole text. Where an overlap has no common
boundary (one run without a cut), the texts concerned are encoded again with
overlaps and chunks four times as wide, at last as one chunk.

Defined results: a null text counts 0 tokens and 0 bytes. Repeated texts of
any number are encoded once when huge. No identifier is needed.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, append, free_name, materialise, text_slices, without

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 9
# Pre-tokens remembered per Python worker and generation, and the longest kept.
MEMO_WORDS = 150_000
MEMO_CHARS = 64
# Code points whose class is compared; all others go to the library.
COMPARED = (range(0x0, 0xD800), range(0xE000, 0x10000), range(0x1F000, 0x1FB00))


def _ranges(codes: Iterable[int]) -> str:
    """A character set's inside for code points in order."""
    spans: list[list[int]] = []
    for c in codes:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def pre_token_pattern() -> str:
    """The byte-level pre-tokens of the library, with letters, digits and white
    space written out."""
    kinds = []
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        of = regex.compile(kind).match
        kinds.append(_ranges(c for codes in COMPARED for c in codes if of(chr(c))))
    letter, digit, space = kinds
    return (f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+"
            f"|[{space}]+(?![^{space}])|[{space}]+")


def odd_characters(tokenizer, pattern: str) -> str:
    """A character set (for a pattern) of code points that the library's cut and
    ours may treat differently: each is tried next to a letter, a digit, a sign
    and white space, before and after it."""
    cut = re.compile(pattern)
    odd = set()
    for codes in COMPARED:
        for at in range(codes.start, codes.stop, 4096):
            some = range(at, min(at + 4096, codes.stop))
            block = [f"a{c}a 1{c}1 {c}{c} !{c}! \t{c}\n" for c in map(chr, some)]
            text, size = "".join(block), len(block[0])
            own = {m.end() for m in cut.finditer(text)}
            theirs = {span[1] for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
            odd |= {some[(e - 1) // size] for e in own ^ theirs}
    return f"[^{_ranges(c for codes in COMPARED for c in codes if c not in odd)}]"


class _Memo(dict):
    """Pre-token -> its number of tokens; a miss is asked of the library. Words
    of the older generation are taken over when met again."""

    def __init__(self, tokenizer, older: dict):
        self.tokenizer, self.older = tokenizer, older

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = len(self.tokenizer.encode(word, add_special_tokens=False))
        if len(word) <= MEMO_CHARS:
            self[word] = n
        return n


class _Counter:
    """Counts texts in one Python worker."""

    def __init__(self, tokenizer, special: list[str], pattern: str, odd: str):
        self.tokenizer, self.memo = tokenizer, _Memo(tokenizer, {})
        self.cut, self.odd = re.compile(pattern), re.compile(odd)
        # cheap to look for: beyond the Latin letters
        self.far = re.compile("[^\x00-\u024f]" if not self.odd.search("".join(map(chr, range(0x250)))) else "")
        longest = sorted(special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest))) if special else None

    def count(self, text: str) -> int:
        if self.far.search(text) and self.odd.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        if len(self.memo) > MEMO_WORDS:
            self.memo = _Memo(self.tokenizer, dict(self.memo))
        parts = self.special.split(text) if self.special else [text]
        get, cut = self.memo.__getitem__, self.cut.findall
        return len(parts) - 1 + sum(sum(map(get, cut(part))) for part in parts if part)


class TokenizerFile:
    """A byte-level BPE tokenizer file; the library object is made once per
    Python worker, with the library's own threads off."""

    def __init__(self, text: str):
        spec = json.loads(text)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) \
                or pre.get("add_prefix_space") or (spec.get("post_processor") or {}).get("type"):
            raise ValueError("splicing is proven for plain byte-level tokenizers only")
        self.text, self._made, self._counter = text, None, None
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = pre_token_pattern()
        self.odd = odd_characters(self.get(), self.pattern)
        self.margin = 2 + max([0, *(len(t["content"]) for t in spec["added_tokens"])])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take their surroundings cannot be spliced")

    def __getstate__(self):
        return self.__dict__ | {"_made": None, "_counter": None}

    def counter(self) -> _Counter:
        if self._counter is None:
            self._counter = _Counter(self.get(), self.special, self.pattern, self.odd)
        return self._counter

    def get(self):
        if self._made is None:
            import os
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            made = Tokenizer.from_str(self.text)
            made.no_truncation()
            made.no_padding()
            self._made = made
        return self._made


def read_tokenizer(df: DataFrame, path: str) -> Broadcast:
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(TokenizerFile(f.read()))


def _count_small(tokenizer: Broadcast, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer.value.counter().count
        for part in text_slices(batches, text_col, 1 << 20):
            texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
            yield append(part, n_tokens=pa.array([count(t) if t else 0 for t in texts], pa.int64()))
    return run


def _cut(chunk: int, overlap: int):
    """(key, text) -> chunk rows; the text is sliced as it streams by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                last = max(0, (len(text) - 1) // chunk)
                for i in range(last + 1):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([i], pa.int64()), pa.array([i == last]),
                         pa.array([i * chunk], pa.int64()),
                         pa.array([text[i * chunk:] if i == last else
                                   text[i * chunk:i * chunk + chunk + overlap]])],
                        ["key", "i", "is_last", "start", "part"])
    return run


def _encode_chunks(tokenizer: Broadcast, chunk: int, overlap: int):
    """Chunk rows -> tokens per chunk, and in both overlaps the positions of
    pre-token starts with the number of the chunk's tokens before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, margin = tokenizer.value.get(), tokenizer.value.margin
        for batch in text_slices(batches, "part", 1 << 18):
            rows = batch.to_pydict()
            out = []
            for i, is_last, start, text in zip(rows["i"], rows["is_last"], rows["start"], rows["part"]):
                enc = tok.encode(text, add_special_tokens=False)
                n, at, words = len(enc), enc.token_to_chars, enc.token_to_word
                # only tokens of the two overlaps are looked at one by one
                head, tail = [], []
                k = 0
                while i > 0 and k < n and at(k)[0] < overlap:
                    head.append(k)
                    k += 1
                k = n if is_last else bisect_left(range(n), chunk, key=lambda x: at(x)[0])
                while k < n and at(k)[0] < len(text) - margin:
                    tail.append(k)
                    k += 1
                head, tail = ([(at(k)[0] + start, k) for k in part
                               if k == 0 or words(k) is None or words(k) != words(k - 1)]
                              for part in (head, tail))
                out.append((n, *([x[j] for x in part] for part in (head, tail) for j in (0, 1))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2),
                 pa.array([o[0] for o in out], pa.int64())]
                + [pa.array([o[k] for o in out], pa.list_(pa.int64())) for k in (1, 2, 3, 4)],
                ["key", "i", "is_last", "n", "head_pos", "head_n", "tail_pos", "tail_n"])
    return run


def _splice(texts: DataFrame, tokenizer: Broadcast, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) per text; null where an overlap has no common boundary."""
    chunks = texts.mapInArrow(_cut(chunk, overlap),
                              "key string, i long, is_last boolean, start long, part string")
    coded = materialise(
        chunks.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(
            _encode_chunks(tokenizer, chunk, overlap),
            "key string, i long, is_last boolean, n long, head_pos array<long>, "
            "head_n array<long>, tail_pos array<long>, tail_n array<long>"), "token-chunks")
    right = coded.select("key", (F.col("i") - 1).alias("i"), F.col("head_pos").alias("r_pos"),
                         F.col("head_n").alias("r_n"))
    at = lambda pos, n: F.try_element_at(
        n, F.array_position(pos, F.col("p")).cast("int"))
    met = (coded.join(right, ["key", "i"], "left")
           .withColumn("p", F.array_min(F.array_intersect("tail_pos", "r_pos"))))
    # a chunk counts up to its right splice; the next one starts there
    part = (F.when(F.col("is_last"), F.col("n"))
            .when(F.col("p").isNotNull(),
                  at(F.col("tail_pos"), F.col("tail_n")) - at(F.col("r_pos"), F.col("r_n"))))
    return (met.select("key", part.alias("part")).groupBy("key")
            .agg(F.when(F.count("part") == F.count("*"), F.sum("part")).alias("n_tokens")))


def count_tokens(df: DataFrame, tokenizer: Broadcast, text_col: str = "text",
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text."""
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("overlap must be shorter than a chunk")
    rows = without(df, {"n_bytes", "n_tokens"} - {text_col})
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = rows.withColumn("n_bytes", F.octet_length(text).cast("long"))
    is_huge = F.length(text) > chunk_chars
    small = sized.filter(~is_huge)
    small = small.mapInArrow(_count_small(tokenizer, text_col),
                             added(small, ("n_tokens", T.LongType())))
    key = free_name(sized, "key")
    huge = sized.filter(is_huge).withColumn(key, F.sha2(text.cast("binary"), 256))
    texts = materialise(huge.select(F.col(key).alias("key"), F.col(text_col).alias("text")).groupBy("key")
                        .agg(F.first("text").alias("text")), "token-texts")
    done, chunk, overlap = None, chunk_chars, overlap_chars
    while True:
        counts = materialise(_splice(texts, tokenizer, chunk, overlap), "token-counts")
        good = counts.filter("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        failed = counts.filter("n_tokens is null").select("key")
        if failed.isEmpty():
            break
        texts = materialise(texts.join(failed, "key", "left_semi"), "token-texts")
        overlap, chunk = overlap * 4, chunk * 4
    huge = huge.join(done.withColumnRenamed("key", key), key)
    columns = [F.col(f"`{c}`") for c in rows.columns] + [F.col("n_bytes"), F.col("n_tokens")]
    return small.select(*columns).unionByName(huge.select(*columns))
