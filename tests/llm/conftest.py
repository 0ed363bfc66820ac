import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus(seed=1, n=60):
    """Documents of two languages with copies, shared passages, junk, nulls, repeated rows and one very long text."""
    rng = random.Random(seed)
    en = ["".join(rng.choice(("th", "er", "on", "an", "re")) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    de = ["".join(rng.choice(("sch", "ung", "ei", "ü", "ch")) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    passage = words(rng, 60, en)
    rows = []
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en"
        text = words(rng, rng.randint(1, 120), de if lang == "de" else en)
        if i % 7 == 3:
            text += " " + passage + " " + words(rng, 5, en)
        if i % 11 == 5 and rows:
            text = rows[i // 2][1]
        rows.append((i, text, lang, f"s{i % 4}" if i % 9 else None, len(text or "")))
    long = words(rng, 20_000, en)
    rows += [(n, long, "en", "s1", len(long)), (n + 1, None, "en", "s2", None), (n + 2, "", "en", "s0", 0), (n + 3, " \t\n ", None, None, 4), (n + 4, "***  %%%\n\n12", "en", "s1", 12), (None, passage, "en", "s1", 1), (n + 5, "one", "en", "s3", 3)]
    rows += [rows[4], (n + 6, rows[10][1], "en", "s2", 1), (n + 7, (rows[10][1] or "") + " extra", "en", "s2", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture
def docs(spark, rows):
    """With a further column whose name an operator might use."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"u": F.lit(1), "t": F.lit("x"), "fp": F.lit(2), "bucket": F.lit(3), "component_id": F.lit(4), "size": F.lit(5)})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
