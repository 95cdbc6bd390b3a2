"""Flat order-line CSV source with encoding detection.

Spark's UTF-8 decoder never fails on bad bytes; it substitutes U+FFFD. So
the file is read as UTF-8 first and, if any text value carries U+FFFD, read
again as ISO-8859-1 (which decodes every byte; the cp1252 retry some tools do
is not offered by Spark's CSV reader and could never be reached after it).

Quoted fields follow RFC 4180 (``""`` inside quotes). ``multi_line=True``
allows newlines inside quoted fields. Spark's own reader then makes each file a
single split; ``read_records`` reads such files in as many splits as any text
file, in two passes over the lines:

1. every split counts its quotes; whether a split begins inside a quoted field
   is the parity of all quotes of its file before it (one number per split);
2. every split walks its lines from that state. A line that is a whole record is
   one at once. Pieces of records that span lines meet by the place where their
   record starts, which a split whose first lines go on a record of an earlier
   one knows from the same prefix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

ENCODINGS = ("UTF-8", "ISO-8859-1")
REPLACEMENT = "�"
# Text the common CSV readers treat as missing (fixed values).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")
# Known numeric measures of an order-line export (snake_case names); other
# columns, identifiers included, stay text.
NUMERIC_COLUMNS = {"sales": DoubleType(), "quantity": DoubleType(),
                   "discount": DoubleType(), "profit": DoubleType()}


def snake(name: str) -> str:
    """'Sub-Category' -> 'sub_category', 'Order ID' -> 'order_id'."""
    return re.sub(r"[^0-9a-zA-Z]+", "_", name.strip()).strip("_").lower()


def _reader(spark: SparkSession, encoding: str, multi_line: bool):
    return (spark.read.option("header", True).option("encoding", encoding)
            .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
            .option("mode", "FAILFAST"))


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, line) -> per split: its quotes, and the last record start
    if it begins outside quotes or inside (-1: none)."""
    found: dict[tuple, list[int]] = {}
    for batch in batches:
        for file, start, line in zip(*(c.to_pylist() for c in batch.columns)):
            seen = found.setdefault((file, start), [0, 0, -1, -1])
            seen[2 + seen[0] % 2] = seen[1]    # a start where the quotes so far are closed
            seen[0] += line.count(b'"')
            seen[1] += 1
    keys = list(found)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
         *[pa.array([found[k][i] for k in keys], pa.int64()) for i in (0, 2, 3)]],
        ["file", "start", "quotes", "outside", "inside"])


def _pieces(states: Broadcast):
    """Lines -> (file, start and number of the record's first line, number of
    this line, is it the whole record, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out: list[tuple] = []
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (file, start):
                    now, number = (file, start), 0
                    open_, record = states.value[now]
                quotes = line.count(b'"') % 2
                if not open_:
                    record = (start, number)
                out.append((file, *record, start, number, not open_ and not quotes, line))
                open_ ^= quotes
                number += 1
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["file", "at", "record", "start", "number", "whole", "line"])
    return run


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, record, bytes): the records of CSV files with quoted newlines;
    ``at`` and ``record`` are the split and line where a record starts."""
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line")))
    splits = lines.mapInArrow(_quotes, "file string, start long, quotes long, outside long, inside long")
    # a few numbers for each split
    states, file = {}, None
    for r in splits.orderBy("file", "start").collect():
        if r["file"] != file:
            file, open_, last = r["file"], 0, (0, 0)
        states[file, r["start"]] = (open_, last)
        newest = r["inside"] if open_ else r["outside"]
        last = (r["start"], newest) if newest >= 0 else last
        open_ = (open_ + r["quotes"]) % 2
    shipped = spark.sparkContext.broadcast(states)
    pieces = lines.mapInArrow(_pieces(shipped), "file string, at long, record long, start long, number long, "
                              "whole boolean, line binary")
    key = ["file", "at", "record"]
    whole = pieces.filter("whole").select(*key, "line")
    parts = F.array_sort(F.collect_list(F.struct("start", "number", "line")))
    joined = F.aggregate(parts, F.lit(None).cast("binary"), lambda acc, p: F.when(
        acc.isNull(), p["line"]).otherwise(F.concat(acc, F.lit(b"\n"), p["line"])))
    spanning = pieces.filter(~F.col("whole")).groupBy(*key).agg(joined.alias("line"))
    return whole.unionByName(spanning)


def _read_split(spark, path, encoding, schema) -> DataFrame:
    """Records parsed one by one; the first of each file is its header, empty
    lines are none."""
    records = read_records(spark, path).filter(~((F.col("at") == 0) & (F.col("record") == 0)))
    if encoding.upper() == "UTF-8":
        text = F.make_valid_utf8(F.col("line").cast("string"))   # U+FFFD for bad bytes
    else:
        text = F.decode("line", encoding)
    lines = records.select(F.regexp_replace(text, r"\r$", "").alias("line")).filter(F.length("line") > 0)
    parsed = F.from_csv("line", schema, {"quote": '"', "escape": '"', "mode": "FAILFAST"})
    return lines.select(parsed.alias("r")).select("r.*")


def _read(spark, path, encoding, multi_line) -> DataFrame:
    header = _reader(spark, encoding, multi_line).csv(path).columns
    schema = StructType([StructField(c, StringType(), True) for c in header])
    if multi_line:
        raw = _read_split(spark, path, encoding, schema.toDDL())
    else:
        raw = _reader(spark, encoding, multi_line).schema(schema).csv(path)
    out = []
    for name in header:
        c = F.col(f"`{name}`")
        c = F.when(F.trim(c).isin(list(NA_TOKENS)), F.lit(None)).otherwise(c)
        typ = NUMERIC_COLUMNS.get(snake(name))
        if typ is not None:
            # a malformed number is an error, not a null (in any ANSI mode)
            c = F.when(c.isNull() | c.try_cast(typ).isNotNull(), c.try_cast(typ)).otherwise(
                F.raise_error(F.concat(F.lit(f"not a number in {name}: "), c)).cast(typ))
        out.append(c.alias(snake(name)))
    return raw.select(*out)


def has_replacement_chars(df: DataFrame) -> bool:
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not text:
        return False
    cond = None
    for c in text:
        hit = F.col(c).contains(REPLACEMENT)
        cond = hit if cond is None else cond | hit
    return df.where(cond).limit(1).count() > 0


def infer_numeric(df: DataFrame, keep_text: tuple[str, ...] = ()) -> DataFrame:
    """Type text columns whose every non-null value is a number (bigint if
    all are integers, else double), like a CSV reader's type inference; one
    aggregate pass over the candidate columns. Columns in ``keep_text``
    (identifiers) and date-like text stay strings."""
    cands = [f.name for f in df.schema.fields
             if isinstance(f.dataType, StringType) and f.name not in keep_text]
    if not cands:
        return df
    aggs = []
    for i, c in enumerate(cands):
        col = F.col(c)
        aggs += [F.count(col).alias(f"n{i}"), F.count(col.try_cast("double")).alias(f"d{i}"),
                 F.count(col.try_cast("bigint")).alias(f"l{i}")]
    r = df.agg(*aggs).first()
    types = {}
    for i, c in enumerate(cands):
        n = r[f"n{i}"]
        if n and r[f"l{i}"] == n:
            types[c] = "bigint"
        elif n and r[f"d{i}"] == n:
            types[c] = "double"
    if not types:
        return df
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c)
                       for c in df.columns])


def read_sales_csv(spark: SparkSession, path: str, multi_line: bool = False,
                   encodings=ENCODINGS, infer_types: bool = True,
                   keep_text: tuple[str, ...] = ("row_id", "order_id", "customer_id",
                                                 "product_id", "order_date", "ship_date")
                   ) -> DataFrame:
    """Order-line CSV -> DataFrame with snake_case columns, known measures
    typed, other all-numeric columns typed by inference (identifiers and
    dates excepted), NA tokens and NaN as null; dates stay text for
    ``prepare``."""
    errors = []
    for enc in encodings:
        try:
            df = _read(spark, path, enc, multi_line)
        except Exception as e:  # a reader error: try the next encoding
            errors.append(f"{enc}: {type(e).__name__}")
            continue
        if enc.upper().replace("-", "") == "UTF8" and has_replacement_chars(df):
            errors.append(f"{enc}: undecodable bytes")
            continue
        return infer_numeric(df, keep_text) if infer_types else df
    raise ValueError(f"could not read {path} with any encoding ({'; '.join(errors)})")
