"""Native span finding: positions of regular-expression matches, in code points, from built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Characters kept on both sides of a match for context rules.
AROUND = 40
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,hit:string,score:double>>"


#: Places that walk() passes before it begins a new list.
PIECE = 128


def no_spans() -> Column:
    return F.array().cast(SPAN)


def walk(n: Column, first: Column, move: Callable[[Column, Column], Column], keep: Callable[[Column, Column], Column], item: Callable[[Column, Column], Column], kind: str) -> Column:
    """item(state, i), of type kind, for the i of 0 .. n - 1 for which keep(state, i) holds, where move(state, i) gives the state after i.

    A list is copied whenever it grows, so PIECE places share one: a first pass notes the state before each piece, and
    the pieces' lists are joined. The time is linear in n but for one state a piece.
    """
    piece = lambda i: F.sequence(i, F.least(i + PIECE, n) - 1)
    note = lambda i, state: F.struct(i.alias("i"), state.alias("state"))

    def pass_piece(so_far: Column, i: Column) -> Column:
        after = F.aggregate(piece(i), so_far["state"], move)
        return F.struct(after.alias("state"), F.array_append(so_far["notes"], note(i, so_far["state"])).alias("notes"))

    none = F.slice(F.array(note(F.lit(0), first)), 1, 0)
    notes = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(PIECE)), F.struct(first.alias("state"), none.alias("notes")), pass_piece, lambda x: x["notes"])
    notes = F.when(n <= PIECE, F.array(note(F.lit(0), first))).otherwise(notes)

    def step(so_far: Column, i: Column) -> Column:
        state, found = so_far["state"], so_far["found"]
        return F.struct(move(state, i).alias("state"), F.when(keep(state, i), F.array_append(found, item(state, i))).otherwise(found).alias("found"))

    start = lambda x: F.struct(x["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("found"))
    return F.flatten(F.transform(notes, lambda x: F.aggregate(piece(x["i"]), start(x), step, lambda y: y["found"])))


def with_spans(df: DataFrame, out: str, text: str, pattern: str, rank: int, kind: str, keep: Callable[[Column, Column, Column], Column], score: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Adds column `out`: spans of the leftmost non-overlapping matches of pattern for which keep holds.

    keep and score get the match, the text up to AROUND characters before it and the same after it. The pieces between
    matches give the positions, and texts without a match are read only once. Null text has no spans.
    """
    hits, gaps = f"{out}_hits", f"{out}_gaps"
    df = df.withColumn(hits, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split(text, pattern, -1)))
    hit, gap = (lambda i: F.get(F.col(hits), i)), (lambda i: F.get(F.col(gaps), i))
    around = lambda i: (hit(i), F.right(gap(i), F.lit(AROUND)), F.left(gap(i + 1), F.lit(AROUND)))
    start = lambda at, i: at + F.length(gap(i))
    end = lambda at, i: start(at, i) + F.length(hit(i))

    def span(at: Column, i: Column) -> Column:
        points = score(*around(i)) if score else F.lit(1.0)
        return F.struct(start(at, i).alias("start"), F.lit(rank).alias("rank"), end(at, i).alias("end"), F.lit(kind).alias("kind"), hit(i).alias("hit"), points.alias("score"))

    spans = walk(F.size(hits), F.lit(0), end, lambda at, i: keep(*around(i)), span, SPAN.removeprefix("array<").removesuffix(">"))
    return df.withColumn(out, F.when(F.size(hits) > 0, spans).otherwise(no_spans())).drop(hits, gaps)


def listing(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column) -> Column:
    return F.size(spans).cast("long")
