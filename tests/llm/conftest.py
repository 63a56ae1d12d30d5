import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so") for b in ("ta", "ve", "xi", "yo", "zu", "ba")]


def prose(seed, n):
    dice = random.Random(seed)
    return " ".join(dice.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, source, id): copies, near copies, null and blank texts, a shared passage, a long text."""
    base, shared = prose(1, 300), prose(99, 120)
    near = base.split()
    near[150] = "changed"
    texts = [base, base, " ".join(near), None, "", " \n\t ", "one two three", prose(2, 90) + "\n" + shared, prose(3, 200) + " " + shared + " é" + prose(4, 30), prose(5, 20_000), "x\n" * 400, "Released under the MIT License.\n" + prose(6, 60), "THE *** " * 80]
    return [(i, t, None if i == 6 else f"s{i % 2}", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id string").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
