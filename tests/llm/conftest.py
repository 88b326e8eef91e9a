import os
import random

import pytest

#: Python workers import the package from here, whatever the working folder is.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH", "")]
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, u long"


def corpus(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Small texts with copies, near copies, shared passages, nulls, blanks, repeats and a long text."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["été", "naïve,", "日本", "The", "ARE", "ét"]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base, passage = prose(80), prose(45)
    rows: list[tuple[int | None, str | None]] = [
        (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "ONE two Three"), (5, "one two three"), (6, base), (7, base), (7, base),
        (8, base.upper()), (9, passage), (10, prose(12) + "\n" + passage + "\x0b" + prose(9)), (11, passage + " " + passage),
        (12, prose(3000)), (None, prose(40)), (13, "x y " * 60), (14, "nospace" * 900), (15, base + " end"), (16, prose(19)), (17, passage[:-3]),
    ]
    for i in range(30):  # near copies of one text: more than a small node holds
        words = prose(1).split() + base.split()
        words[rng.randrange(len(words))] = f"changed{i}"
        rows.append((100 + 3 * i, " ".join(words)))
    rows += [(300 + i, prose(rng.randrange(5, 120)) + rng.choice(["", "\n", " | # %"])) for i in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The corpus with columns whose names operators use inside as well."""
    rows = [(d, t, "en", [None, "a", "b", "Ä"][(d or 0) % 4], len(t or ""), "x", 1) for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
