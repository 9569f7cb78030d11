import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, d string, t string"


def rows():
    """Nulls, empty and long texts, ties, repeated rows; columns whose names the operators use inside."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards brew strong potions in the old tower"
    near = base.replace("lazy", "tired")
    texts = [
        (3, base), (1, base), (2, near), (4, None), (5, ""), (6, " \t\n"), (7, "A Shared Line Of Text\nown line number seven\n  a shared line of text\r"),
        (8, "x\na shared line of text\ny"), (8, "x\na shared line of text\ny"), (9, ("word%d " * 9) % tuple(range(9)) * 400),
        (10, "é" * 30 + " ünïcode ZEILE\n" + "É" * 12 + "\n" + "é" * 12), (None, "a document without id\na shared line of text"),
        (None, None), (11, "日本語 テキスト\n日本語 テキスト"), (12, "a  b   c \n  d"), (13, "...!!! 123 ###"), (14, "z" * 500), (15, base + "\n" + base),
    ]
    return [(i, t, "en" if i and i % 2 else None, "src", len(t or ""), "9", "x", "y") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
