import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"word{k % 977} and{k}" for k in range(9000))
#: Empty, null, blank, very long, repeated, wide and tied texts.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and then some more words follow it here", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "  \t\n ", "en", "b"),
    (5, LONG, "en", "a"),
    (6, LONG + " tail", "de", "a"),
    (7, "The quick brown fox jumps over the lazy dog and then some more words follow it here", "en", "b"),
    (8, "Ünïcode ﬁ 漢字 <|endoftext|> ’quoted’ it's I'LL 1234 ½ ²³ a@b.co 10.0.0.1 4539578763621486 +1 (743) 555-3824", "fr", "b"),
    (9, "x\x1cy\x85z\xa0w " + "spam " * 40, "en", "b"),
    (10, "a" * 30000, "en", None),
    (None, "no name here but a text all the same", "en", "a"),
    (12, "same same same same same same same same same\nsame same same same same same same same same\n", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of all odd sorts, with columns whose names clash with those that operators make."""
    rows = [(*t, len(t[1] or ""), "x", 7, "y") for t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, size int, taken string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter(F.lit(False))


@pytest.fixture(scope="session")
def docs(spark, small):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
