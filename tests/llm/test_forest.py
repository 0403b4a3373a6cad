import duckdb
import numpy as np
import pytest

from brickfield.llm import forest
from brickfield.llm.oracles import ORACLE_SQL


def brute(rows, least=0.9):
    good = [(k, i, np.array(v, dtype=float)) for k, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for *_, v in good), default=0)
    m = np.array([np.pad(v, (0, width - len(v))) for *_, v in good]).reshape(len(good), width)
    u = m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m
    near = u @ u.T >= least if len(u) else np.zeros((0, 0), dtype=bool)
    np.fill_diagonal(near, False)
    root = np.arange(len(good))
    for a, b in zip(*np.nonzero(near)):
        x, y = root[a], root[b]
        root[root == max(x, y)] = min(x, y)
    ids = np.array([i for _, i, _ in good])
    out = {k: (i, 0, i, True) for k, (i, _) in enumerate(rows)}
    for a, (k, i, _) in enumerate(good):
        c = int(ids[root == root[a]].min())
        out[k] = (i, int(near[a].sum()), c, bool(i == c))
    return sorted(out.values(), key=repr)


def groups(n=900, width=24, seed=3):
    """Vectors around centres at cosines from 0.8 to 1, copies, chains, and vectors of no use."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    rows = []
    for g in range(n // 9):
        centre = unit(rng.standard_normal(width))
        for _ in range(9):
            rows.append(unit(centre + rng.uniform(0.05, 0.55) * unit(rng.standard_normal(width))) * rng.uniform(0.1, 9))
    hot = unit(rng.standard_normal(width))
    rows += [hot] * 40 + [hot + 0.02 * unit(rng.standard_normal(width)) for _ in range(150)]
    out = [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(len(rows)) + 10, rows)]
    return out


ODD = [(1, None), (2, [0.0] * 24), (3, [None] + [1.0] * 23), (4, [float("nan")] * 24), (5, [float("inf")] + [0.0] * 23), (6, []), (None, [1.0] * 24), (7, [1.0, 2.0]), (8, [-0.0, 3.0] + [0.0] * 22), (9, [0.0, 3.0])]


def links(spark, rows, kind="double", **sizes):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], f"vec_id long, embedding array<{kind}>, leaf int, key string").repartition(4)
    return sorted((tuple(r) for r in forest.link_vectors(df, **sizes).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"LEAF": 16, "FEW": 8, "PACK": 50, "ROWS": 20}, {"SAMPLE": 100, "FEW": 10, "LEAF": 20, "BIG": 100, "PACK": 40}])
def test_links_within_recall(spark, monkeypatch, sizes):
    """None below the least cosine, and nearly all above it, in leaves, packs and leaves dealt anew."""
    for name, value in sizes.items():
        monkeypatch.setattr(forest, name, value)
    rows = groups() + ODD
    rows += [rows[4], rows[4], rows[30]]
    got, want = links(spark, rows), brute(rows)
    assert len(got) == len(want) and [r[0] for r in got] == [r[0] for r in want]
    made, there = sum(r[1] for r in got), sum(r[1] for r in want)
    print(sizes, "recall", made / there)
    assert 0.97 * there <= made <= there
    assert sum(a[1] > b[1] for a, b in zip(sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1])), sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1])))) == 0
    assert sum(a != b for a, b in zip(got, want)) <= 0.1 * len(want)


def test_small_leaves_alone_are_exact(spark):
    """All in one leaf: no link is lost."""
    rows = groups(180) + ODD
    assert links(spark, rows) == brute(rows)


def test_matches_sql(spark, tmp_path):
    rows = [r for r in groups(180) if r[1]] + [(1, None), (2, [0.0] * 24), (5, [float("inf")] + [0.0] * 23)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    df.write.parquet(f"{tmp_path}/v")
    names = ["vec_id", "n_links", "component_id", "kept"]
    sql = ORACLE_SQL["op13_forest"].replace("FROM embeddings", f"FROM '{tmp_path}/v/*.parquet'")
    want = duckdb.connect().execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, forest.link_vectors(df).select(names).collect())) == sorted(want)


def test_dense_group_of_many_packs(spark, monkeypatch):
    """Vectors that are all near each other can't be split: every pair is compared, in packs."""
    for name, value in {"BIG": 60, "PACK": 32, "LEAF": 16, "FEW": 8}.items():
        monkeypatch.setattr(forest, name, value)
    rng = np.random.default_rng(1)
    hot = rng.standard_normal(16)
    rows = [(i, [float(x) for x in hot + 0.03 * rng.standard_normal(16)]) for i in range(300)]
    assert links(spark, rows) == [(i, 299, 0, i == 0) for i in sorted(range(300), key=lambda i: repr((i, 299, 0, i == 0)))]


def test_none(spark):
    assert links(spark, []) == []
    assert links(spark, ODD[:5]) == brute(ODD[:5])
    with pytest.raises(ValueError):
        links(spark, [], least=0.0)
