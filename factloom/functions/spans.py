"""Exact regex spans and interval folds with built-in functions only.

Spark has no function that returns the positions of all matches. The matches are
therefore wrapped in two control characters, the text is split there, and one
fold adds up the lengths of the pieces. Lengths count code points, so offsets
stay right with characters beyond the BMP. Everything is local to the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, STAND_IN = "\u0001", "\u0002", "\u0003"
SPAN = "struct<start:int,end:int,raw:string>"


def guarded(text: Column) -> Column:
    """Same length text in which the two marker characters cannot occur."""
    return F.translate(text, OPEN + CLOSE, STAND_IN * 2)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,raw>> of all matches of a Java pattern.

    ``group`` > 0 reports only that group; such a pattern must have the form
    ``(before)(wanted)(after)`` with group 2 the wanted part.
    """
    marked_as = f"{OPEN}$0{CLOSE}" if group == 0 else f"$1{OPEN}$2{CLOSE}$3"
    pieces = F.split(
        F.regexp_replace(guarded(text), F.lit(pattern), F.lit(marked_as)), f"[{OPEN}{CLOSE}]", -1
    )
    start = F.struct(
        F.lit(0).alias("pos"), F.lit(False).alias("hit"), F.array().cast(f"array<{SPAN}>").alias("out")
    )

    def step(acc, piece):
        after = acc["pos"] + F.length(piece)
        found = F.struct(acc["pos"].alias("start"), after.alias("end"), piece.alias("raw"))
        return F.struct(
            after.alias("pos"),
            (~acc["hit"]).alias("hit"),
            F.when(acc["hit"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"),
        )

    return F.when(F.size(pieces) > 1, F.aggregate(pieces, start, step, lambda acc: acc["out"])).otherwise(
        F.array().cast(f"array<{SPAN}>")
    )


def overlaps(a: Column, b: Column) -> Column:
    return F.greatest(a["start"], b["start"]) < F.least(a["end"], b["end"])


def covers(outer: Column, inner: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (outer["end"] >= inner["end"])


def not_covered(candidates: Column, earlier: Column) -> Column:
    """Drop candidates that lie inside one of the earlier spans."""
    return F.filter(candidates, lambda c: ~F.exists(earlier, lambda e: covers(e, c)))


def disjoint_from(candidates: Column, earlier: Column) -> Column:
    return F.filter(candidates, lambda c: ~F.exists(earlier, lambda e: overlaps(e, c)))


def greedy_disjoint(ordered: Column, span_type: str) -> Column:
    """Walk the array once and keep each span that overlaps nothing kept before."""
    empty = F.array().cast(f"array<{span_type}>")
    return F.aggregate(
        ordered,
        empty,
        lambda kept, s: F.when(
            F.exists(kept, lambda k: overlaps(k, s)), kept
        ).otherwise(F.concat(kept, F.array(s))),
    )


def greedy_by_start(ordered: Column, span_type: str) -> Column:
    """Same for input sorted by start: only the last kept end matters, so one pass is linear."""
    start = F.struct(F.lit(-1).alias("last"), F.array().cast(f"array<{span_type}>").alias("out"))

    def step(acc, s):
        free = s["start"] >= acc["last"]
        return F.struct(
            F.when(free, s["end"]).otherwise(acc["last"]).alias("last"),
            F.when(free, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def any_of(words: list[str]) -> str:
    """Whole-word alternation of plain phrases as a Java pattern (text must be lower-cased)."""
    return r"(?U)\b(?:" + "|".join(quote(w) for w in words) + r")\b"


def quote(word: str) -> str:
    """Escape a literal for a Java pattern."""
    return "".join("\\" + ch if not (ch.isalnum() or ch in " '") and ord(ch) < 128 else ch for ch in word)


def contains_any(text: Column, phrases: list[str]) -> Column:
    cond = F.lit(False)
    for p in phrases:
        cond = cond | F.contains(text, F.lit(p))
    return cond


def barrier(df: DataFrame) -> DataFrame:
    """Keep later filters above the large expressions of ``df``.

    A filter pushed through projections has their expressions substituted into it,
    level by level; with extraction expressions that grows without end. Columns
    that come out of a generator are not substituted. No shuffle, no extra rows.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")
