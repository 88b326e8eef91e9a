"""Queries and their SQL twins on rows that the given tables hold only when they are large."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture
def both(spark, tmp_path):
    """Sorted rows of a query and of its twin over small tables."""

    def run(name, tables, **columns):
        db = duckdb.connect()
        for table, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            db.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        found = entry.queries()[name](spark, str(tmp_path))
        twin = db.execute(entry.oracle_sql()[name])
        order = [d[0] for d in twin.description]
        return sorted(map(tuple, found.select(*order).collect()), key=str), sorted(twin.fetchall(), key=str)

    return run


LINES = [
    "It was to render to them the last of it and so on, as far as they could see, and nothing else was said there at all.",
    "In a long line of more than one hundred characters the term mapping is told, and all else is left for later on.",
    "Short line", "Name: 한국어 이름이 여기 있다", "page 3: 한국어", "-* Seoul: 서울 특별시",
    "The word is kept. It is translated as such! Then 。 no more？ Yes", "번역어 고정 문장. Then another one. See A => B here. Last",
    "Überrender to them is a word of its own. Terminologyé too. Glossary　is one",
]


@pytest.mark.parametrize("name", ["memory_lines", "sanitized_memory"])
def test_memory_rules(both, name):
    texts = [(1, "\n".join(["Title", *LINES])), (2, "\n".join(f"{x} " * 3 for x in LINES)), (3, "\n".join(x.upper() for x in LINES))]
    found, twin = both(name, {"documents": ("doc_id long, text string", texts)})
    assert found == twin and len(found) > 20


def test_untranslated_words(both):
    answers = [
        "these are words", "Short of it", "The Great Hall", "“Hello there friend”", "“hello there good friend of mine—yes indeed”", "AB-1", "",
        "한국어 with words", "한국어 With", "naïve cafés élan vital more words here", "\"Great Hall\"", "\"some plain words\"", None, "one two three four five six seven", "SAME again", "abc de fgh",
    ]
    rows = [(1, 2 * i + k, "user" if k == 0 else "assistant", x) for i, a in enumerate(answers) for k, x in enumerate(("Same  again" if i == 14 else "q", a))]
    found, twin = both("untranslated_into_korean", {"conversations": ("conv_id long, turn long, role string, text string", rows)})
    assert found == twin and {r[2] for r in found} == {True, False}
