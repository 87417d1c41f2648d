import pytest
from pyspark.sql import functions as F

from marketloom.llm.shipping import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def build(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "web", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


LONG = " ".join(f"word{i % 977} of" for i in range(40_000))
EDGES = [(None, "no number here at all"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, LONG), (6, "same row twice, same row twice"),
         (6, "same row twice, same row twice"), (7, "Ünïcödé 漢字 😀 text"), (8, "a" * 30_000), (9, LONG), (10, "same number, one text"), (10, "same number, other text")]


@pytest.fixture(scope="session")
def edges(documents):
    """Nulls, empty and very long texts, repeated rows and numbers, and columns with clashing names."""
    clash = ["score", "token_ids", "_fp", "fp", "group", "size", "doc", "crc", "place", "key", "n", "_text", "_gone"]
    return documents(EDGES).withColumns({c: F.lit("kept") for c in clash})


@pytest.fixture(scope="session")
def nothing(documents):
    return documents(EDGES).limit(0)
