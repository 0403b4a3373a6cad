import hashlib
import re
from collections import Counter

import pytest

from brickfield.llm import decontam

from .conftest import lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def expected(rows, items, width=10):
    windows = {}
    for i, text in items:
        w = WORD.findall(lower(text))
        k = min(width, len(w))
        for at in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[at : at + k]), set()).add("" if i is None else str(i))
    out = Counter()
    for i, text, *_ in rows:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for win, names in windows.items():
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at : at + len(win)]) == win:
                    hit |= set(range(at, at + len(win)))
                    found |= names
        out[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.fixture(scope="module")
def items(corpus):
    long = next(t for i, t, _ in corpus if i == 100)
    cut = lambda a, b: " ".join(long.split()[a:b])
    return [(1, cut(3, 30)), (2, cut(20, 32)), (10, cut(50, 54)), (3, "İßna"), (4, None), (5, "..."), (None, cut(90, 101)), (1, cut(200, 213).upper()), (7, "unseen words here")]


def test_matches_brute_force(spark, docs, corpus, items):
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, window int")
    got = Counter(tuple(r) for r in decontam.leak_digest(docs, bench).collect())
    assert got == expected(corpus, items)


def test_removals(spark, docs, corpus, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = {k[0] for k in expected(corpus, items) if not k[-1]}
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    dirty = {k[0] for k in expected(corpus, items) if k[-1]}
    assert {r["doc_id"] for r in kept.collect()} == clean | ({None, 5, 6} & clean)
    spans = decontam.decontaminate(docs, bench.where("item_id <> 3"), remove="spans")
    assert spans.count() == docs.count() and spans.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in spans.collect()}
    assert texts[304] == "one" and len(texts[100]) < 300 * 5 and dirty


def test_empty_tables(spark, docs, no_docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.leak_digest(no_docs, bench).count() == 0
    none = decontam.leak_digest(docs, bench.limit(0))
    assert none.count() == docs.count() and none.where("contaminated").count() == 0


def test_without_broadcast(spark, docs, corpus, items, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 0)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in decontam.leak_digest(docs, bench).collect()) == expected(corpus, items)
