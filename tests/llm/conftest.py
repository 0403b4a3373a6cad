import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, spans string, row long"


def lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, source) with nulls, empty, blank and long texts, copies, near copies and a repeated id."""
    rng = random.Random(5)
    words = [a + b for a in ("ba", "Dé", "ko", "mi", "İß", "zu") for b in ("na", "RO", "lé", "s.", "t,", "x")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(1, 80)), f"s{rng.randint(0, 4)}") for i in range(60)]
    base = text(300)
    rows += [(100 + i, base, "hot") for i in range(12)]
    rows += [(200 + i, base + " " + text(1), None) for i in range(6)]
    rows += [(300, None, "s1"), (301, "", "s1"), (302, " \n\t ", "s2"), (303, text(20000), "s3"), (304, "one", "s3"), (305, "one two", "s3")]
    rows += [(5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (6, text(12), "s0"), (None, text(9), "s0"), (None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "xx", s, len(t or ""), "clash", "clash", 7) for i, t, s in corpus]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
