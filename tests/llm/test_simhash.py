from collections import Counter

import numpy as np
import xxhash

from brickfield.llm import simhash

from .conftest import lower


def plain_fingerprint(text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in lower(text)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, reach=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= reach:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [least[find(i)] for i in range(len(ids))]


def test_matches_brute_force(docs, corpus):
    ids, prints = [r[0] for r in corpus], [plain_fingerprint(r[1]) for r in corpus]
    want = Counter(zip(ids, (f"{p:016x}" for p in prints), plain_components(ids, prints)))
    assert Counter(tuple(r) for r in simhash.simhash_digest(docs).collect()) == want


def test_one_of_each_stays(docs, corpus):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = [plain_fingerprint(r[1]) for r in corpus]
    groups = plain_components(list(range(len(corpus))), prints)
    assert kept.count() == len(set(groups))
    assert 100 in {r["doc_id"] for r in kept.collect()} and 101 not in {r["doc_id"] for r in kept.collect()}


def test_empty(no_docs):
    assert simhash.simhash_digest(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0


def clustered(n, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    out = set()
    for c in centers:
        for _ in range(n):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            out.add(x)
    return sorted(out)


def test_index_finds_all_within_reach():
    prints = clustered(150)
    rank = lambda g: int("".join(map(str, np.bitwise_xor.accumulate([int(c) for c in f"{g:064b}"]))), 2)
    members = np.array(sorted(prints, key=rank), dtype=np.uint64)
    for reach in (0, 1, 2, 3):
        q, m = simhash.GrayIndex(members).within(members, reach)
        want = {(i, j) for i, a in enumerate(members.tolist()) for j, b in enumerate(members.tolist()) if (a ^ b).bit_count() <= reach}
        assert set(zip(q.tolist(), m.tolist())) == want


def test_large_shards_are_dealt_again(spark, monkeypatch):
    prints = clustered(200, seed=4)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = plain_components(list(range(len(prints))), prints)
    for most in (4, 100000):
        monkeypatch.setattr(simhash, "MOST_IN_SHARD", most)
        roots = {r["u"]: r["v"] for r in simhash.components(simhash.links(rows, 2)).collect()}
        got = [roots.get(p, p) for p in signed]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_long_chain(spark):
    edges = spark.range(1, 300).selectExpr("id AS u", "id - 1 AS v")
    assert {r["v"] for r in simhash.components(edges).collect()} == {0}


def test_extra_columns_stay_as_they_are(docs):
    assert {(r["size"], r["spans"], r["row"]) for r in simhash.keep_one(docs).collect()} == {("clash", "clash", 7)}
    assert simhash.simhash_digest(docs).columns == ["doc_id", "fingerprint", "component_id"]
