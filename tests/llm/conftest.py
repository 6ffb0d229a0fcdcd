import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node long, _doc string, score double"


def prose(seed: int, n: int, size: int = 400) -> str:
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("abcdefghijklmnoprstuvé") for _ in range(pick.randint(2, 8))) for _ in range(size)]
    return " ".join(pick.choice(vocabulary) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Null, empty and very long texts, near and exact copies, repeated rows, null ids, and columns with clashing names."""
    long = "\n".join(prose(k, 60) for k in range(120))
    near = prose(7, 200).split(" ")
    near[50] = "changed"
    texts = [None, "", " \t\n", "one", "two words", prose(1, 4), prose(2, 9), prose(3, 10), prose(7, 200), " ".join(near), prose(7, 200), long, long.replace("a", "o"), "é" * 3000, "word " * 500, "### $$$ %%% *** " * 40]
    texts += [f"{prose(20 + k, 30)}\n{prose(5, 25)}\n{prose(40 + k, 30)}" for k in range(12)]
    rows = [(k, t, None if k % 7 == 3 else "en", None if k % 5 == 2 else f"s{k % 2}", len(t or ""), True, 1, "x", 0.5) for k, t in enumerate(texts)]
    return [*rows, rows[8], rows[8], (None, prose(9, 50), "en", "s0", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
