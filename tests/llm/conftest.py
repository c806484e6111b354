import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, here as clashing extra columns of their input.
EXTRA = ("size", "key", "range", "shard", "fp", "kind", "component_id", "score", "target", "epochs", "bag", "k_row", "words", "anchor", "digest", "piece", "c_take", "row_number", "positive", "image")


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(("ka", "lo", "mi", "ner", "tus", "po", "ri")) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with a hot source, copies, near copies, nulls, empty, blank and long texts, and repeated rows."""
    rng = random.Random(7)
    out = []
    for i in range(160):
        out.append((i, prose(rng, rng.randint(3, 120)), "en", "hot" if i % 3 == 0 else f"s{i % 5}", None))
    copy = out[10][1]
    out += [(200 + i, copy, "en", "hot", 1) for i in range(30)]
    out += [(300 + i, copy + f" end{i}", "en", "s1", 1) for i in range(5)]
    out += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, " \t\n", "en", "s2", 3), (403, "one", "en", None, 3), (404, "One", "en", "s2", 3)]
    out += [(405, prose(rng, 6000), "en", "s3", None), (406, "", None, "empty", 0)]
    out += [out[5], out[5], (None, "null id one two three four", "en", "s1", 1), (None, None, "en", "s1", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def wide(docs):
    """The documents with extra columns whose names clash."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(c) for c in EXTRA])
