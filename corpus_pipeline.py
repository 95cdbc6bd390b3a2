"""Training-corpus pipeline over ``documents``: five stages, each writing Parquet.

Every stage works on all rows its predecessor kept. All but the last return the
columns of ``documents``; the last returns the encoded corpus.

1. quality classifier: documents predicted 0 go;
2. exact dedup: one document of each group of equal texts stays;
3. MinHash near-dedup: one document of each component stays;
4. mixing: each document as often as its source's target takes it;
5. byte-level BPE: token ids, checked by decoding them back.

Defined results: null texts are empty texts (they score by the classifier's
bias, are exact copies of each other, have no shingles, no words to mix and so
end with stage 4); empty tables give empty tables with the stage's columns;
extra columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm import bpe, exact_dedup, minhash, mixing, quality
from kpiforge.llm.common import table
from kpiforge.llm.queries import RANKS_FILE, vocabulary
from kpiforge.session import checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with extra columns under names that no operator uses."""
    own = ("doc_id", "text", "source")
    return docs.select(*[F.col(f"`{c}`").alias(c if c in own else f"extra{k}")
                         for k, c in enumerate(docs.columns)])


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows with the columns of ``docs``."""
    own = ("doc_id", "text", "source")
    return rows.select(*[F.col(c if c in own else f"extra{k}").alias(c)
                         for k, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.quality_scores(_aside(docs), table(spark, sf_dir, "labels"))
    return _back(scored.filter("predicted = 1"), docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the smallest doc_id."""
    return _back(exact_dedup.exact_dedup(_aside(docs)).filter("kept"), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: shingles of five words,
    similarity 0.8 or more."""
    return minhash.keep_one_of_each(docs, words_per=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return _back(mixing.repeated(mixing.mix_sources(_aside(docs))), docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the token ids, their number, and whether they decode to
    the text's bytes."""
    import public_tokenizers
    encoder = bpe.make_encoder(docs, bpe.read_ranks(vocabulary(RANKS_FILE)), public_tokenizers.PATTERN)
    back = bpe.encode_bpe(docs.select("doc_id", "source", "text"), encoder, decoded_col="decoded")
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return back.select("doc_id", "source", "token_ids",
                       F.size("token_ids").cast("long").alias("n_tokens"),
                       whole.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage), ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage), ("mixing", mixing_stage), ("bpe_encoding", encoding_stage)]

# Models, permutations and fitted budgets have no SQL form; the stages are
# tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/llm/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
