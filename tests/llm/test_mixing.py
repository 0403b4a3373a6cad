import hashlib
import re
from collections import Counter, defaultdict

from brickfield.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        if not free:
            return held
        rest, w = total - sum(held.values()), sum(weight[s] for s in free)
        over = {s: cap * sizes[s] for s in free if weight[s] * rest / w > cap * sizes[s]}
        if not over:
            return held | {s: weight[s] * rest / w for s in free}
        held |= over


def expected(rows, seed=7):
    by = defaultdict(list)
    for i, text, source in rows:
        key = int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:15], 16)
        by[source].append((key, i is not None, i or 0, len(WORD.findall(text or "")), i))
    sizes = {s: sum(r[3] for r in g) for s, g in by.items()}
    goal, out = targets(sizes), Counter()
    for s, g in by.items():
        whole = int(goal[s] // sizes[s]) if sizes[s] else 0
        part, at = int(goal[s]) - whole * sizes[s], 0
        for _, _, _, n, i in sorted(g, key=lambda r: r[:4]):
            out[(i, n, sizes[s], goal[s], whole * n + max(0, min(n, part - at)))] += 1
            at += n
    return out


def test_matches_plain_mix(docs, corpus):
    rows = mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert Counter(map(tuple, rows)) == expected(corpus)


def test_rows_repeat_as_taken(docs):
    mixed = mixing.mix_sources(docs)
    taken = {r["source"]: r["t"] for r in mixed.groupBy("source").agg({"taken": "sum"}).toDF("source", "t").collect()}
    repeated = mixing.repeat_rows(mixed)
    words = Counter()
    for r in repeated.collect():
        words[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert words == Counter(taken)


def test_any_partitioning_agrees(docs):
    a, b = (Counter(map(tuple, mixing.mix_sources(docs.repartition(n)).select("doc_id", "taken").collect())) for n in (1, 7))
    assert a == b


def test_all_clamped_and_empty(spark, no_docs):
    assert mixing.mix_sources(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(blank).collect()} == {(1, 0), (2, 0)}
    two = spark.createDataFrame([(1, "a b c", "a"), (2, "d", "b")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["target"], r["taken"]) for r in mixing.mix_sources(two, share=5.0).collect()} == {(1, 6.0, 6), (2, 2.0, 2)}


def test_a_prefix_keeps_the_caller_s_columns(docs, corpus):
    mixed = mixing.mix_sources(docs, prefix="_mix_")
    rows = mixed.collect()
    assert {(r["size"], r["spans"], r["row"]) for r in rows} == {("clash", "clash", 7)}
    assert Counter((r["doc_id"], r["_mix_size"], r["_mix_source_size"], r["_mix_target"], r["_mix_taken"]) for r in rows) == expected(corpus)
    assert {(r["size"], r["row"]) for r in mixing.repeat_rows(mixed, "_mix_").collect()} == {("clash", 7)}


def test_the_cut_among_rows_that_are_alike(spark):
    """One source of a hundred equal rows, some of which the last repetition takes."""
    rows = [(1, "a b c", "s")] * 100 + [(2, "d e", "t")] * 3 + [(3, "f", "t")]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), weights=(1, 1), share=1.1)
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixed.collect()) == plain_mix(rows, (1, 1), 1.1)


def plain_mix(rows, weights, share):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text))
    goal, out = targets(sizes, weights, share), Counter()
    for s in sizes:
        whole, at = int(goal[s] // sizes[s]), 0
        part = int(goal[s]) - whole * sizes[s]
        key = lambda r: int(hashlib.md5(f"7:{r[0]}".encode()).hexdigest()[:15], 16)
        for i, text, _ in sorted((r for r in rows if r[2] == s), key=key):
            n = len(WORD.findall(text))
            out[(i, n, sizes[s], goal[s], whole * n + max(0, min(n, part - at)))] += 1
            at += n
    return out
