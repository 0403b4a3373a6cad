import math
import re
import zlib

import numpy as np
import pytest

from brickfield.llm import quality
from brickfield.llm.queries import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.quality_scores(docs, labels).toPandas()
    assert len(rows) == docs.count() and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]).all()
    held = rows[rows["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() > 0.95


def test_held_out_labels_teach_nothing(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = (quality.quality_scores(docs, x).toPandas().sort_values("doc_id")["score"].to_numpy() for x in (labels, flipped))
    assert np.allclose(a, b)


def test_keeps_and_drops(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = quality.keep_good(docs, labels)
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == good


@pytest.mark.parametrize("rows, want", [([], 1.0), ([(1, 1, 0), (2, 1, 0)], 1.0), ([(1, None, 0)], 1.0), ([(1, 0, 0), (2, 0, 0)], 0.0)])
def test_labels_of_one_kind(spark, docs, rows, want):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    scored = quality.quality_scores(docs, labels).collect()
    assert len(scored) == docs.count() and {r["score"] for r in scored} == {want}


def test_strange_rows(spark, docs, no_docs, corpus):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(docs, labels).count() == len(corpus)
    assert quality.quality_scores(no_docs, labels).count() == 0
    assert quality.keep_good(no_docs, labels).count() == 0


def test_pooled_means_do_not_fall():
    rng = np.random.default_rng(1)
    w, t = rng.integers(1, 9, 50).astype(float), rng.random(50)
    levels = quality.pool(w, t)
    assert (np.diff(levels) >= -1e-12).all() and np.isclose((levels * w).sum(), t.sum())


def plain_statistics(text):
    """The statistics of a text by plain loops over its characters and words."""
    data, words, lines = text.encode(), re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
    words = [w.encode() for w in words]
    n, size = max(len(words), 1), max(len(data), 1)
    kinds = ["A-Z", "a-z", "0-9", " \t\n\r\v\f", ".,;:?", r"!#$%&*|<>{}\[\]\\^_~=+@/"]
    share = [len(re.findall(f"[{k}]", text)) / size for k in kinds] + [sum(b > 127 for b in data) / size]
    loud = [len(w) > 2 and re.search(rb"[A-Z]", w) is not None and not re.search(rb"[a-z]", w) for w in words]
    marked = [w[-1:] in (b"!", b"#", b"$", b"%", b"&", b"*", b"|") for w in words]
    again = [a == b for a, b in zip(words, words[1:])]
    odd = [a or b or (i > 0 and again[i - 1]) for i, (a, b) in enumerate(zip(loud, marked))]
    return [
        math.log1p(len(data)), *share, math.log1p(len(words)), sum(map(len, words)) / n, sum(len(w) > 12 for w in words) / n, len(set(words)) / n,
        max((words.count(w) for w in set(words)), default=0) / n, sum(again) / n, sum(len(w) < 4 for w in words) / n, sum(loud) / n, sum(marked) / n,
        words.count(b"|") / n, math.log1p(len(lines)), math.log1p(size / len(lines)), len(set(lines)) / len(lines), sum(x.count(" | ") > 2 for x in lines) / len(lines),
        max((sum(odd[i : i + 50]) / 50 for i in range(0, len(odd), 50)), default=0),
    ]


def plain_scores(docs, labels):
    """Scores of docs (doc_id, text) by labels (doc_id, quality), all at once on one machine."""
    x = np.array([plain_statistics(t or "") for _, t in docs])
    fold = [None if i is None else zlib.crc32(str(i).encode()) % 5 for i, _ in docs]
    of = {}
    for i, q in labels:
        if i is not None and q is not None:
            of.setdefault(i, []).append(q)
    taught = [(k, q) for k, (i, _) in enumerate(docs) if fold[k] not in (None, 0) for q in of.get(i, [])]
    rows, y = np.array([k for k, _ in taught]), np.array([float(q) for _, q in taught])
    mean, deviation = x[rows].mean(axis=0), x[rows].std(axis=0)
    rng = np.random.default_rng(11)
    directions, phases = rng.normal(size=(x.shape[1], 256)) / 4.0, rng.uniform(0, 2 * np.pi, 256)
    z = np.clip((x - mean) / np.where(deviation > 1e-9, deviation, 1.0), -8, 8)
    features = np.hstack([np.sqrt(2 / 256) * np.cos(z @ directions + phases), np.ones((len(x), 1))])
    fit = np.array([fold[k] != 1 for k in rows])
    a = features[rows[fit]]
    raw = features @ np.linalg.solve(a.T @ a + 1e-4 * fit.sum() * np.eye(257), a.T @ y[fit])
    bins = {}
    for k, q in zip(rows[~fit], y[~fit]):
        bins.setdefault(min(max(int((raw[k] + 0.5) * 128), 0), 255), []).append((raw[k], q))
    knots = [np.mean([r for r, _ in bins[b]]) for b in sorted(bins)]
    weight, total = [len(bins[b]) for b in sorted(bins)], [sum(q for _, q in bins[b]) for b in sorted(bins)]
    # The isotonic fit by its definition: the largest of the least means of runs that begin at or before and end at or after a bin.
    level = [max(min(sum(total[i : j + 1]) / sum(weight[i : j + 1]) for j in range(k, len(knots))) for i in range(k + 1)) for k in range(len(knots))]
    knots = [min(-0.5, knots[0] - 1), *knots, max(1.5, knots[-1] + 1)]
    level = np.array([level[0], *level, level[-1]])
    level = np.clip(0.999 * level + 0.001 * (np.clip(knots, -0.5, 1.5) + 0.5) / 2, 0, 1)
    return np.interp(raw, knots, level)


def test_statistics_match_plain_loops(corpus):
    texts = [t or "" for _, t, _ in corpus] + ["AB, ABC| ABC| ab\n | | | |\n\n#9 ÀÉÎ DÉF go! GO! 1234567890123", "\t", "x" * 3000]
    for t in texts[:60:7] + [t for t in texts[60:] if len(t) < 40000]:
        assert np.allclose(quality.statistics(t.encode()), plain_statistics(t), rtol=1e-12), t


def test_scores_match_one_machine(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    long = "Word " * 30000 + "| | | |\n" * 2000
    more = spark.createDataFrame([(None, "no id"), (10**9, None), (10**9 + 1, ""), (3, "a text under a known id"), (10**9 + 2, long)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(more)
    labels = labels.select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (7, None), (8, 0)], "doc_id long, quality int"))
    rows = [tuple(r) for r in docs.collect()]
    want = sorted(zip([-1 if i is None else i for i, _ in rows], plain_scores(rows, [tuple(r) for r in labels.collect()])))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in quality.quality_scores(docs, labels).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-5)


def test_bounded_labels(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    n, some = quality.teaching(labels).count(), quality.teaching(labels, 1000)
    assert n == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(5000)) and 850 < some.count() < 1150
    assert {r["doc_id"] for r in some.collect()} == {r["doc_id"] for r in quality.teaching(labels.repartition(3), 1000).collect()}
