import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import SCHEMA, prose  # noqa: E402


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents: prose of three languages, copies, near copies, odd and long texts, nulls."""
    rng = random.Random(7)
    texts = [(prose(rng, lang, rng.randint(25, 220)), lang) for lang in ("en", "en", "de", "fr") for _ in range(40)]
    texts += [(texts[3][0], "en")] * 9 + [(texts[5][0] + " and more of it", "en"), ("x " + texts[5][0], "en"), (texts[60][0].upper(), "en")]
    texts += [(None, "en"), ("", "en"), (" \n\t ", None), ("12 34", "de"), ("one", "en"), ("one", "fr"), ("\x1c é ü 日本語 <|endoftext|>", None)]
    texts.append((" ".join(prose(rng, "en", 40) for _ in range(250)), "en"))
    texts.append(("z" * 70_000, "en"))
    return [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows, and columns with names that operators use."""
    rows = [(None, None, None, None, None, 1, 2), (None, "one two", "en", None, None, 3, 4), (7, "one two", "en", "s", 7, 5, 6), (7, "one two", "en", "s", 7, 5, 6), (8, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA + ", shard int, salt int")
