import pytest

from samples import prose


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (1, base, "a", 1), (2, base, "a", 1), (3, " ".join(near), None, 2), (4, prose(2, 120), "b", None),
        (5, None, None, None), (6, "", "", 0), (6, "", "", 0), (7, "one two", "c", 3), (8, "one two", "c", 3),
        (9, prose(3, 6000), "d", 4), (None, prose(4, 80), "e", 5), (10, "x " * 500, "f", 6),
        (4, prose(2, 120), "b", None), (11, prose(5, 40) + "\n" + base[:400], "g", 7),
        (12, "ñandú Ünïcode " + prose(6, 60), "h", 8), (13, " \t\n\r\x0b\x0c ", "i", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, n long")


@pytest.fixture(scope="session")
def nothing(tricky):
    return tricky.limit(0)
