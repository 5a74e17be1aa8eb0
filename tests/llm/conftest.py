import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def passage(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty, blank and long texts, copies, near copies, shared passages, repeated rows and ids."""
    long = passage(1, 30_000)
    shared = passage(2, 70)
    base = passage(3, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (0, base, "en", "a", 1), (1, near, "en", "b", 1), (2, base.upper(), "en", "a", 1), (3, base, "de", None, 1), (4, base, "de", None, 1), (4, base, "de", None, 1),
        (5, f"{passage(4, 90)} {shared} {passage(5, 20)}", "en", "a", None), (6, f"{passage(6, 55)} {shared}\n{passage(7, 35)}", "en", "c", 2), (7, None, None, None, None), (8, "", "en", "a", 0),
        (9, " \n\t ", "en", "b", 4), (10, long, "fr", "a", 9), (11, passage(8, 100), "fr", "", 1), (None, passage(9, 60), "en", "a", 1), (12, "two words", "en", "a", 1), (12, "two words!", "en", "a", 1),
        (13, "éàü " * 200 + "é", "fr", "b", 1), (14, "x" * 3000, "en", "b", 1), (15, passage(10, 400) + shared, "en", "b", 1),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_docs(docs):
    """Extra columns named as inner ones."""
    from pyspark.sql import functions as F

    return docs.select("*", F.lit(1).alias("digest"), F.lit("x").alias("node"), F.lit(2.5).alias("size"), F.lit(None).cast("string").alias("start"), F.lit(1).alias("key"), F.lit("p").alias("pattern"))


