import random

import pytest

SYLLABLES = ["ta", "ko", "mi", "ren", "sul", "va", "pe", "dor", "li", "no"]


def prose(seed: int, n: int) -> str:
    """n seeded words, in lines."""
    rng = random.Random(seed)
    words = ["".join(rng.choices(SYLLABLES, k=rng.choice([1, 2, 2, 3]))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


#: Texts that no operator may trip over: null, empty, blanks, one letter, not ASCII, broken surrogates' neighbours, very long, one long word.
HARD = [None, "", " \t\n\x0b\x0c\r ", "x", "ÉÈ ñandú über 東京 \U0001f600 İi", "\x00\x01 nul", "a" * 5000, prose(1, 20_000), "\n" * 3000, "no letters? 123 !!!".replace("no letters", "42")]

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Hard texts, repeated rows, ties, null ids and nulls in every column, and columns whose names operators use."""
    rows = [(i, t, "en" if i % 2 else None, None, None if t is None else len(t)) for i, t in enumerate(HARD)]
    rows += [(100, prose(2, 60), "en", "s", 1), (100, prose(2, 60), "en", "s", 1), (101, prose(2, 60), "de", "s", 1), (102, prose(2, 60) + " end", None, "s", None), (None, prose(3, 40), "en", "s", 2), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, FIELDS)
    for name in ("score", "x", "row", "n", "spans", "own_spans", "component", "component_id", "lang_pred", "ids", "hash"):
        df = df.selectExpr("*", f"'clash' as {name}")
    return df.cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], FIELDS)
