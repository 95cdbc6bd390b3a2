"""Registered queries of the corpus operators and their DuckDB SQL.

Each query applies its operator with production parameters to its whole table
and derives the contract's columns. Operators without SQL (models, tokenizers,
fitted budgets) are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, exact_dedup, importance, licences, minhash, mixing, quality, suffix_dedup,
               suffix_tree_lm, token_count, topk, url_filter, variants)
from .common import table

RANKS_FILE = "byte_bpe_50k.tiktoken"
TOKENIZER_FILE = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    slim = exact_dedup.exact_dedup(docs, carry=["doc_id"])
    return slim.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf, "documents"))


def op4_licences(spark: SparkSession, sf: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                        "labels", "score")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def round_trip(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, token_ids and the bytes they decode to."""
    import public_tokenizers
    ranks = bpe.read_ranks(ranks_path or vocabulary(RANKS_FILE))
    encoder = bpe.make_encoder(docs, ranks, public_tokenizers.PATTERN)
    return bpe.encode_bpe(docs.select("doc_id", "text"), encoder, decoded_col="decoded").drop("text")


def op5_bpe(spark: SparkSession, sf: str) -> DataFrame:
    coded = round_trip(table(spark, sf, "documents"))
    return coded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")).cast("binary"), 256)
        .alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counts = token_count.count_tokens(docs, token_count.read_tokenizer(docs, vocabulary(TOKENIZER_FILE)))
    return counts.select("doc_id", "n_bytes", "n_tokens",
                         (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf, "documents").select("doc_id", "text", "source"), carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_substrings(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffix_dedup.substring_dedup(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans",
                      F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = quality.quality_scores(docs, table(spark, sf, "labels"))
    return scored.select("doc_id", F.coalesce(quality.fold_of("doc_id") == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    best = topk.top_k(rows, rows.filter(F.col("vec_id") % 20 == 0))
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op11_importance(spark: SparkSession, sf: str) -> DataFrame:
    return importance.importance_resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf, "documents"))


def op13_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_tree_lm.lm_scores(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_exact_dedup, op3_minhash, op4_licences, op5_bpe, op6_token_counts,
    op7_mixing, op8_substrings, op9_quality, op10_topk, op11_importance, op12_variants,
    op13_lm_scores)}

# The table of the unsigned crc32, and the checksum of a text's UTF-8 bytes.
CRC_TABLE = """
crc_rows(i, c, k) AS (
  SELECT i, CAST(i AS BIGINT), 0 FROM range(256) AS r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1
  FROM crc_rows WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crc FROM crc_rows WHERE k = 8)"""


def crc_sql(text: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen({text})), "
            f"lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))), "
            "lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)")


LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op11_importance": rf"""
WITH RECURSIVE {CRC_TABLE},
t AS (SELECT doc_id, FALSE AS wanted, text FROM documents
      UNION ALL SELECT NULL, TRUE, text FROM benchmark),
w AS (SELECT doc_id, wanted, unnest(regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
      FROM t),
f AS (SELECT doc_id, wanted, word, count(*) AS n FROM w GROUP BY ALL),
b AS (SELECT word, {crc_sql('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM f), crc_table),
c AS (SELECT i AS bucket, coalesce(sum(n) FILTER (NOT wanted), 0) AS s,
             coalesce(sum(n) FILTER (wanted), 0) AS t
      FROM range(10000) AS r(i) LEFT JOIN (SELECT * FROM f JOIN b USING (word)) ON bucket = i GROUP BY i),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((sum(s) OVER ())::DOUBLE + 10000)
        / ((CAST(s AS DOUBLE) + 1) * ((sum(t) OVER ())::DOUBLE + 10000)))) AS BIGINT) AS gain FROM c),
d AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
      FROM f JOIN b USING (word) JOIN g USING (bucket) WHERE NOT wanted GROUP BY doc_id),
a AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8)
          AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT *, n_features >= 20 AS open,
        row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k,
        count(*) FILTER (n_features >= 20) OVER () AS n FROM a)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND k <= 10 * n // 100 THEN k END AS rank FROM r""",
    "op12_variants": rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all({LOWER_SQL}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
        FROM documents) WHERE length(run) >= 5 GROUP BY doc_id, run),
h AS (SELECT run, n, {crc_sql("(doc_id || ':' || run)")} AS h FROM r, crc_table),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                  ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 5
      GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM x),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b
    ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON w.word = v.less
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON w.word = v.less),
best AS (SELECT word, count(*) AS n_near, min({{'k': -near_n, 'near': encode(near)}}) AS best
         FROM near GROUP BY word),
told AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near,
           CASE WHEN -best.k >= 2 * n THEN decode(best.near) END AS form,
           CASE WHEN -best.k >= 2 * n THEN -best.k END AS form_n FROM w LEFT JOIN best USING (word)),
walk(word, top) AS (SELECT word, word FROM told
  UNION ALL SELECT walk.word, told.form FROM walk JOIN told ON told.word = walk.top WHERE told.form IS NOT NULL),
root AS (SELECT walk.word, walk.top AS root FROM walk JOIN told ON told.word = walk.top WHERE told.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM told JOIN root USING (word)""",
    "op2_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)""",
    "op3_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ')
    ELSE array_to_string(ws[i:i + 3], ' ') END AS sh
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i)
  WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.c),
k AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id,
       doc_id = component_id AS kept
FROM k LEFT JOIN n USING (doc_id)""",
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS z
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.z, c.z) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM k WHERE r <= 20""",
}
