import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empties, repeated rows and ids, and columns that clash with outputs."""
    from pyspark.sql import functions as F

    base = " ".join(f"word{i % 37}x{i % 11}" for i in range(120))
    near = base.replace("word5x5", "changed", 1)
    other = " ".join(f"other{i * 7 % 53}" for i in range(90))
    rows = [
        (1, base), (2, base), (3, near), (4, other), (5, None), (6, ""), (7, "one two"), (8, "one two"), (9, "!!! ???"), (None, other + " tail"), (10, "x" * 5000 + " y"),
        (11, "été naïve Ünï 123"), (1, base), (12, " ".join(["same"] * 60)), (13, "Released under the MIT License.\nmore"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = {c: F.lit("own") for c in ("score", "n_words", "item_ids", "hit_spans", "media", "grade", "p_toxic", "license_id", "lang", "source")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
