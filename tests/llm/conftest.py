import random

import pytest

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnoprstu", k=2 + i % 7)) for i in range(400)]


def prose(seed: int, n: int) -> str:
    """n pseudo-random words in lines of ten."""
    rng = random.Random(seed)
    return "\n".join(" ".join(rng.choices(WORDS, k=min(10, n - k))) for k in range(0, n, 10))


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents frame from (doc_id, text, source) rows, with extra columns of awkward names."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, row long, doc string, _fp long, kept boolean, key long"
        full = [(i, t, None, s, None if t is None else len(t), 7, "x", None, None, 1) for i, t, s in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in each column, empty and very long texts, ties and repeated rows."""
    long = prose(9, 30_000)
    one = prose(1, 120)
    near = one.replace("\n", " ", 3)
    return [
        (1, one, "a"), (1, one, "a"), (2, near, "b"), (2, prose(2, 90), None), (None, one, "a"), (None, None, None),
        (3, None, "a"), (4, "", "b"), (5, " \n\t ", "c"), (6, "word", "a"), (7, long, "a"), (8, long + " end", None),
        (9, prose(3, 200) + "\n" + prose(1, 60), "c"), (10, "x" * 5000, "c"), (11, "é ß 日本 🙂\u00a0 \x0b'll", "a"),
    ]
