import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from brickfield.llm import codes
from brickfield.llm.oracles import ORACLE_SQL


def vectors():
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) + rng.gauss(0, 0.1) for _ in range(16)], i % 3) for i in range(300)]
    rows += [(1000 + i, rows[5][1], None) for i in range(200)]
    rows += [(2000 + i, [rng.choice([0.0, 0.5]) for _ in range(16)], 7) for i in range(60)]  # many ties
    rows += [(3000, None, 1), (3001, [None] + [0.0] * 15, 1), (3002, [float("nan")] * 16, 1), (3003, [float("inf")] * 16, None)]
    return rows + [rows[0], rows[40], rows[40]]


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    good = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v, _ in good), default=0)
    width = -(-longest // parts) * parts
    size = width // parts
    order = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    pad = lambda v: v + [0] * (width - len(v))
    cut = lambda v: [tuple(pad(v)[p * size : (p + 1) * size]) for p in range(parts)]
    books = [[list(cut(v)[p]) for _, v, _ in order] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))
    cuts = [cut(v) for _, v, _ in good]
    for _ in range(rounds):
        members = {}
        for c in cuts:
            for p, x in enumerate(c):
                members.setdefault((p, near(p, x)[1]), []).append(x)
        for (p, e), xs in members.items():
            books[p][e] = [sum(col) // len(xs) for col in zip(*xs)]
    said = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for (i, _, label), c in zip(good, cuts):
        found = [near(p, x) for p, x in enumerate(c)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        sums[label] = sums.get(label, 0) + out[-1][2]
    return sorted(((i, c, e, sums[label], said) for i, c, e, label in out), key=repr)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, "clash") for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string")


@pytest.mark.parametrize("together, leaf", [(1 << 13, 2), (7, 1)])
def test_matches_brute_force(spark, monkeypatch, together, leaf):
    monkeypatch.setattr(codes, "TOGETHER", together)
    monkeypatch.setattr(codes, "LEAF", leaf)
    rows = vectors()
    got = sorted((tuple(r) for r in codes.code_digest(frame(spark, rows).repartition(5)).collect()), key=repr)
    assert got == brute(rows)


def test_matches_sql(spark, tmp_path):
    rows = [r for r in vectors()[:-3]]
    df = frame(spark, rows, "float").repartition(3)
    df.drop("code").write.parquet(f"{tmp_path}/v")
    sql = ORACLE_SQL["op12_codes"].replace("FROM embeddings", f"FROM '{tmp_path}/v/*.parquet'")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = duckdb.connect().execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, codes.code_digest(df).select(names).collect())) == sorted(want) and len(want) == 560


def test_few_short_and_none(spark):
    few = [(5, [0.1, -0.2, 0.3], 1), (2, [], 1), (None, [1.0] * 9, None)]
    assert sorted((tuple(r) for r in codes.code_digest(frame(spark, few)).collect()), key=repr) == brute(few)
    empty = [(1, [], 1), (2, [], 2)]
    assert sorted((tuple(r) for r in codes.code_digest(frame(spark, empty)).collect()), key=repr) == brute(empty)
    assert codes.code_digest(frame(spark, [])).count() == 0
    assert codes.code_digest(frame(spark, [(1, None, 2)])).count() == 0


def test_ties_go_to_the_lowest_entry():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 16, 40):
        entries = rng.integers(-2, 3, (n, 4))
        queries = rng.integers(-3, 4, (500, 4))
        far = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
        best, least = codes.KDTree(entries).nearest(queries)
        assert (best == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_decode(spark):
    rows = vectors()[:100]
    found, books = codes.compress(frame(spark, rows), entries=64, rounds=3)
    whole = {i: [math.floor(4096 * x) for x in v] for i, v, _ in rows}
    for r in codes.decode(found, books, 4096).collect():
        assert sum((math.floor(4096 * x) - y) ** 2 for x, y in zip(r["vector"], whole[r["vec_id"]])) == r["error"]
