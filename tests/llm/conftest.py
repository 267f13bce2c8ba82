import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

EMAIL, CARD = "joe.d@mail.example.com", "4111 1111 1111 1111"
PROSE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf into the deep dark forest of the north where nobody lives"


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, source): nulls, empty and very long texts, ties, copies, other alphabets."""
    base = [
        (1, PROSE, "a"),
        (2, PROSE.upper(), "a"),
        (3, PROSE + " again", "b"),
        (4, None, None),
        (5, "", "b"),
        (6, "É" + PROSE, "a"),
        (7, "é" + PROSE, "é"),
        (8, " ".join(f"w{i}" for i in range(20_000)), "a"),
        (9, "x" * 50_000, None),
        (10, "Released under the MIT License.\nAll rights reserved.", "c"),
        (11, f"write {EMAIL} or pay {CARD} 10.0.0.1 call +1 (555) 555-1234", "c"),
        (12, "one two three", "b"),
        (13, "One, two: three!", "b"),
        (14, "   \t\r\n", "b"),
        (15, "😀 emoji 😀 joe@x.io 😀", "c"),
        (16, "\n\n\n", "c"),
    ]
    return base


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(3).cache()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")
