import random
from collections import Counter

import pytest

from brickfield.llm import chat

ROWS = "conv_id long, turn long, role string, text string, place long"


@pytest.fixture(scope="module")
def logged():
    rng = random.Random(2)
    talks = [[(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "<|im_end|>x"])) for _ in range(rng.randint(1, 7))] for _ in range(12)]
    logs = [t[: rng.randint(1, len(t))] for t in talks for _ in range(4)] + talks + [talks[0]] * 3 + [[("user", "x" * 40000)], [("user", str(i)) for i in range(2500)]]
    return [(i if i != 5 else None, t) for i, t in enumerate(logs)]


def frame(spark, logged, step=3, start=-1):
    rows = [(i, start + step * k if k or start < 0 else None, r, t, 9) for i, talk in logged for k, (r, t) in enumerate(talk)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, ROWS)


def expected(logged, part=1000):
    said = {i: [(r or "user", t or "") for r, t in talk] for i, talk in logged}
    out = Counter()
    for i, talk in said.items():
        order = lambda x: (x is None, x or 0)
        longer = any(len(o) > len(talk) and o[: len(talk)] == talk for o in said.values())
        earlier = any(o == talk and order(j) < order(i) for j, o in said.items())
        if not (longer or earlier):
            for p in range(0, len(talk), part):
                text = "".join(f"<|im_start|>{r}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in talk[p : p + part])
                out[(i, len(talk), p // part, text)] += 1
    return out


@pytest.mark.parametrize("start", [-1, 0])
def test_matches_brute_force(spark, logged, start):
    got = Counter(map(tuple, chat.render(frame(spark, logged, start=start)).collect()))
    assert got == expected(logged)


def test_conversation_over_many_ranges(spark, logged):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = chat.place_turns(frame(spark, logged))
        assert placed.where("conv_id = 64").select("_p").distinct().count() > 1
        assert Counter(map(tuple, chat.render(frame(spark, logged)).collect())) == expected(logged)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_turns_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 0), (1, 0, "user", "a", 0), (2, 0, "user", "a", 0)], ROWS)
    assert [(r["conv_id"], r["n_turns"]) for r in chat.render(df).collect()] == [(1, 2)]
    assert chat.render(df.limit(0)).count() == 0


def test_turns_alike_over_parts(spark, monkeypatch):
    """A turn that stands 25 times among others, in parts of ten turns."""
    monkeypatch.setattr(chat, "PART", 10)
    said = [(1, 0, "user", "first", 0), *[(1, 1, "user", "same <|", 0)] * 25, *[(1, 2, "assistant", t, 0) for t in "cab"], (2, 0, "user", "first", 0)]
    rows = {r["part"]: r["text"] for r in chat.render(spark.createDataFrame(said, ROWS).repartition(3)).collect()}
    turns = [t for p in range(3) for t in rows[p].split("<|im_start|>")[1:]]
    assert sorted(rows) == [0, 1, 2] and [rows[p].count("<|im_start|>") for p in range(3)] == [10, 10, 9]
    assert turns[0] == "user\nfirst<|im_end|>\n" and turns[1:26] == ["user\nsame < |<|im_end|>\n"] * 25
    assert sorted(turns[26:]) == [f"assistant\n{t}<|im_end|>\n" for t in "abc"]
