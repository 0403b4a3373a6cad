"""Each operator that passes columns through, with every name of a helper in its module as a column of the caller's."""

import inspect
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brickfield.llm import common, decontam, mixing, pii, quality, simhash, spans


#: Names that helpers have had besides those that stand in the modules now.
FORMER = {"_n", "_copy", "_full", "_part", "_id", "_row", "_hit", "_t", "_s", "hash", "n", "copy"}


def clashing(docs, *modules, but=()):
    """docs with a column of constant text for each name that stands in quotes in the modules, and those names."""
    words = FORMER | {w for m in (*modules, common) for w in re.findall(r"[\"']([A-Za-z_]\w*)[\"']", inspect.getsource(m))}
    words = sorted({w for w in words if w.lower() not in {c.lower() for c in docs.columns} and w not in (common.UPPER, common.LOWER)} - set(but))
    return docs.select("*", *[F.lit(f"own {w}").alias(w) for w in words]), words


def own_kept(rows, words):
    return all(r[w] == f"own {w}" for r in rows for w in words)


@pytest.fixture(scope="module")
def benchmark(spark, corpus):
    return spark.createDataFrame([("i", " ".join(corpus[60][1].split()[:12]))], "item_id string, text string")


def test_mixing(docs):
    own = ["source_size", "target", "taken", "size"]
    df, words = clashing(docs.drop("size"), mixing, but=own)
    assert len(words) > 20 and {"left", "part", "cut", "whole", "alike", "_size", "_n", "_copy"} <= set(words)
    mixed = mixing.mix_sources(df)
    rows = mixed.collect()
    assert own_kept(rows, words) and Counter((r["doc_id"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs).collect())
    again = mixing.repeat_rows(mixed).collect()
    assert own_kept(again, words) and len(again) > len(rows) // 2


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_decontamination(docs, benchmark, remove):
    df, words = clashing(docs, decontam)
    assert {"_id", "_row", "_hit"} <= set(words)
    rows, plain = decontam.decontaminate(df, benchmark, remove=remove).collect(), decontam.decontaminate(docs, benchmark, remove=remove).collect()
    assert own_kept(rows, words) and Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in plain)
    assert (len(rows) < docs.count()) == (remove == "documents")


def test_simhash(docs):
    df, words = clashing(docs, simhash)
    assert {"_id", "_row"} <= set(words)
    rows = simhash.keep_one(df).collect()
    assert own_kept(rows, words) and Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in simhash.keep_one(docs).collect())


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    df, words = clashing(docs, quality)
    assert {"_id", "x", "y", "fold"} <= set(words)
    rows = quality.keep_good(df, labels).collect()
    assert own_kept(rows, words) and Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in quality.keep_good(docs, labels).collect())


def test_pii(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now"), (2, None), (3, "")], "doc_id long, text string")
    own = ["base", "added", *[f"n_{k}" for k in pii.BASE]]
    df, words = clashing(docs, pii, spans)
    df = df.select("*", *[F.lit(f"own {w}").alias(w) for w in own if w not in words])
    words += [w for w in own if w not in words]
    assert {"_t", "_s"} <= set(words)
    rows = pii.redact(df).collect()
    assert own_kept(rows, words) and {r["text"] for r in rows} == {"mail <email> now", None, ""} and rows[0].asDict().keys() == dict.fromkeys(df.columns).keys()
    found = pii.find_pii(df, prefix="pii_").collect()
    assert own_kept(found, words) and {r["pii_n_email"] for r in found} == {0, 1}
    assert {r["n_email"] for r in pii.find_pii(df).collect()} == {0, 1}


def test_one_defined_row_of_repeats_stays(spark):
    """Of rows equal in doc_id and text one stays, the same however the table is partitioned."""
    rows = [(1, "a b c d e", s) for s in "qwertz"] + [(2, "a b c d e", "x"), (None, "z z z", "m"), (None, "z z z", "l"), (3, "other words here", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = [(None, "l"), (1, "e"), (3, "k")]
    for n in (1, 3, 7):
        kept = simhash.keep_one(df.repartition(n))
        assert sorted(((r["doc_id"], r["source"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
