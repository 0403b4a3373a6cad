from brickfield.functions.geometry import Box
from brickfield.operators import locate as L
from brickfield.plans.queries import QUERIES


def test_masked_serves_rare_places(spark):
    """Volume 0 has one good place of 125, volume 1 has two, volume 2 none."""
    at = [(z, y, x) for z in range(6) for y in range(6) for x in range(6)]
    held = {0: [(4, 3, 1)], 1: [(0, 0, 0), (4, 4, 4)], 2: []}
    full = {k: {(z + a, y + b, x + c) for z, y, x in v for a in (0, 1) for b in (0, 1) for c in (0, 1)} for k, v in held.items()}
    voxels = spark.createDataFrame([(k, *p, int(p in full[k])) for k in held for p in at], "volume long, z long, y long, x long, m int")
    requests = spark.createDataFrame([(i, i, i % 3) for i in range(300)], "request long, seed long, volume long").repartition(3)
    rows = L.masked(requests, L.integral(voxels, ["volume"], "m"), ["volume"], (2, 2, 2), Box((0, 0, 0), (6, 6, 6)), 1.0).collect()
    assert sorted(r["request"] for r in rows) == list(range(300))
    found = {k: [(r["b_z"], r["b_y"], r["b_x"]) for r in rows if r["request"] % 3 == k] for k in held}
    assert set(found[0]) == set(held[0]) and set(found[2]) == {(None, None, None)}
    assert min(found[1].count(p) for p in held[1]) >= 30 and set(found[1]) == set(held[1])
    assert {r["attempt"] for r in rows if r["request"] % 3 == 2} == {None} and {r["attempt"] for r in rows if r["request"] % 3 == 0} <= {0, 1, 2, 3, 4}


def test_masked_all_keeps_the_early_attempts(spark):
    d = "/root/testdata/sf0.001"
    every = set(map(tuple, QUERIES["random_location_masked_all"](spark, d).collect()))
    early = set(map(tuple, QUERIES["random_location_masked"](spark, d).collect()))
    assert len(every) == 1500 and {r for r in every if r[1] is not None and r[1] < 4} == early
