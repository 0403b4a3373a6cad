import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brickfield.functions.scratch import scratch_dir
from brickfield.llm import decontam, quality, simhash
from brickfield.llm.common import materialize
from brickfield.llm.queries import table, vocabulary

from .conftest import lower
from .test_decontam import WORD as LEAK_WORD
from .test_mixing import expected as mix
from .test_quality import plain_scores
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, materialize(stage(spark, kept, SF), f"test-{name}")
        assert kept.columns == columns
        ids = {r["doc_id"] for r in kept.collect()}
        if name == "quality":
            assert ids == {r["doc_id"] for r in quality.quality_scores(before, table(spark, SF, "labels")).where("predicted = 1").collect()}
        if name == "near_duplicates":
            assert ids == {r["component_id"] for r in simhash.simhash_digest(before).collect()}
        if name == "decontamination":
            assert ids == {r["doc_id"] for r in decontam.leak_digest(before, table(spark, SF, "benchmark")).where("NOT contaminated").collect()}
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in kept.collect())
    assert sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)


def stage_folders(spark):
    """The folders of documents that stages have left."""
    names = os.listdir(scratch_dir(spark).removeprefix("file://"))
    return sorted(n for n in names if any(n.startswith(f"corpus-{stage}-") for stage, _ in corpus_pipeline.STAGES[:-1]))


def one_machine(tables, tokenizer):
    """The rows of the whole pipeline by plain loops, each stage on what the one before it kept."""
    docs = [(i, t, s) for i, t, s in tables["documents"]]
    good = plain_scores([(i, t) for i, t, _ in docs], tables["labels"])
    docs = [d for d, score in zip(docs, good) if score >= 0.3]
    prints = [plain_fingerprint(t) for _, t, _ in docs]
    group = plain_components(list(range(len(docs))), prints)
    least = {}
    for k, g in enumerate(group):
        least[g] = min(least.get(g, k), k, key=lambda j: (docs[j][0], docs[j][2]))
    docs = [docs[k] for k in sorted(least.values())]
    windows = set()
    for _, text in tables["benchmark"]:
        w = LEAK_WORD.findall(lower(text))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if w else 0)}
    widths = {len(w) for w in windows}

    def leaks(text):
        w = LEAK_WORD.findall(lower(text))
        return any(tuple(w[i : i + n]) in windows for n in widths for i in range(len(w) - n + 1))

    docs = [d for d in docs if not leaks(d[1])]
    text_of, rows = {i: t for i, t, _ in docs}, []
    for (i, size, source_size, target, taken), n in mix(docs).items():
        assert n == 1
        full, part = divmod(taken, size) if size else (int(target >= source_size), 0)
        ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text_of[i] or "")]
        rows += [(i, text_of[i] or "")] * full + [(i, re.sub(r"^[\x20\x09-\x0D]+", "", text_of[i][: ends[part - 1]]))] * (part > 0)
    return rows


@pytest.mark.parametrize("repeated", [False, True])
def test_whole_pipeline_on_one_machine(spark, tmp_path, repeated):
    """Also with rows that stand twice, some of them from two sources."""
    from tokenizers import Tokenizer

    SF = str(tmp_path) if repeated else "/root/testdata/sf0.001"
    if repeated:
        for n in ("documents", "labels", "benchmark"):
            rows = table(spark, "/root/testdata/sf0.001", n)
            if n == "documents":
                rows = rows.unionByName(rows.where("doc_id % 7 = 0")).unionByName(rows.where("doc_id % 11 = 0").withColumn("source", F.concat(F.lit("a"), "source")))
            rows.write.parquet(f"{SF}/{n}.parquet")

    tokenizer = Tokenizer.from_file(vocabulary())
    columns = {"documents": ("doc_id", "text", "source"), "labels": ("doc_id", "quality"), "benchmark": ("item_id", "text")}
    tables = {n: [tuple(r) for r in table(spark, SF, n).select(*c).collect()] for n, c in columns.items()}
    want = Counter()
    for i, text in one_machine(tables, tokenizer):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        want[(i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))] += 1
    left = stage_folders(spark)
    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want and len(got) > 100
    assert stage_folders(spark) == left  # no stage's documents stay
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
