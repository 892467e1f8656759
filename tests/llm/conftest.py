import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int, stem: str = "") -> str:
    return " ".join(stem + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, one word, repeated rows, repeated ids, a long word, a long text, letters of other planes."""
    rng = random.Random(1)
    passage = sentence(rng, 60)
    long = sentence(rng, 30_000)
    rows = [
        (1, "plain words of a text that goes on for some time", "en", "b", 5),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \t\n\x0b\x0c\r ", "en", "a", 7),
        (5, "one", "en", "a", 3),
        (6, f"{sentence(rng, 20)} {passage} {sentence(rng, 20)}", "de", "a", 1),
        (7, f"{sentence(rng, 9)}\n{passage}\t{sentence(rng, 5)}", "de", None, 1),
        (8, long, "en", "b", len(long)),
        (8, long, "en", "b", len(long)),
        (9, "x" * 200_000, "en", "ä", 200_000),
        (10, "été naïve 𝒳𝒴 日本語   end", "fr", "é", 20),
        (None, "no id but words enough to be a text", "en", "a", 1),
        (11, "a a a a a a a a " * 40, "en", "b", 1),
        (12, "PLAIN Words of a text that goes on for some time", "en", "b", 5),
        (13, f"{passage} {passage}", "es", "c", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns that are named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["fp", "rep", "component_id", "k", "c", "h", "size", "draws", "target", "lang_pred", "score", "accepted", "n_tokens", "ids", "kept", "node", "label", "key"]
    return odd.withColumns({n: F.lit(f"own {n}") for n in names})
