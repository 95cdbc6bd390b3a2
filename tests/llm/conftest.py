import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              # clashing names: results must replace them
              "KEPT string, group_size string, token_ids string, size string, score string, "
              "n_tokens string, labels string, `odd name` string, __norm string, "
              # names that operators use inside
              "key string, whole string, h string, id string, copies string, url_key string, "
              "node string, row string, bucket string, `range` string")
CLASH = ("x",) * 7 + ("kept as it is", "y") + tuple(f"own {k}" for k in range(10))


def doc(i, text, source="s"):
    return (i, text, "en", source, None if text is None else len(text), *CLASH)


LONG = "lorem ipsum dolor sit amet, " * 12_000
EDGE_ROWS = [
    doc(1, None, None), doc(2, ""), doc(3, " \t\n\x0b\x0c\r "), doc(4, "a"), doc(5, "one two three"),
    doc(6, LONG), doc(7, LONG), doc(8, "the same words stand here twice in two rows of the table"),
    doc(8, "the same words stand here twice in two rows of the table"),
    doc(9, "the  same words\tstand here twice in two rows of the table", None),
    doc(None, "a row without an identifier"), doc(None, "the same words stand here twice in two rows of the table"),
    doc(10, "Ünï çödé \U0001F600 <|endoftext|> 0123"), doc(11, "Released under the MIT License."),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    return spark.createDataFrame(EDGE_ROWS, DOC_SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
