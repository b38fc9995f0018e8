"""Lines between cards as Spark columns: sides, anchors, paths and the marks of cardinality.

A rectangle is a struct of ``x``, ``y``, ``width`` and ``height``, a point one of
``x`` and ``y``; sides are left, right, top and bottom.  Numbers in paths have at
most two decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Measures of curves, loops and marks.
LEAST_BULGE, MOST_BULGE, BULGE = 24, 180, 0.4
LOOP_HALF, LOOP_OUT = 14, 46
FOOT_LENGTH, FOOT_SPREAD, TICK_AT, TICK_HALF, CIRCLE, CIRCLE_GAP = 13, 7, 9, 6, 4, 3


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def center(rect: Column) -> Column:
    return point(rect["x"] + rect["width"] / 2, rect["y"] + rect["height"] / 2)


def anchor(rect: Column, side: Column, at: Column | None = None) -> Column:
    """The point of a side, its middle unless ``at`` moves it along the side."""
    at = F.lit(None).cast("double") if at is None else at
    x = F.when(side == "left", rect["x"]).when(side == "right", rect["x"] + rect["width"]).otherwise(F.coalesce(at, rect["x"] + rect["width"] / 2))
    y = F.when(side == "top", rect["y"]).when(side == "bottom", rect["y"] + rect["height"]).otherwise(F.coalesce(at, rect["y"] + rect["height"] / 2))
    return point(x, y)


def outward(side: Column) -> Column:
    return point(F.when(side == "left", -1).when(side == "right", 1).otherwise(0), F.when(side == "top", -1).when(side == "bottom", 1).otherwise(0))


def sides(start: Column, end: Column) -> Column:
    """The sides through which two cards connect, as ``from_side`` and ``to_side``."""
    right = center(end)["x"] >= center(start)["x"]
    pick = lambda a, b: F.when(right, F.lit(a)).otherwise(F.lit(b))
    return F.struct(pick("right", "left").alias("from_side"), pick("left", "right").alias("to_side"))


def number(value: Column) -> Column:
    """Two decimals at most, without trailing zeros."""
    text = F.format_string("%.2f", F.floor(value * 100 + 0.5) / 100)
    plain = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(plain == "-0", F.lit("0")).otherwise(plain)


def _path(*parts: str | Column) -> Column:
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else number(p) for p in parts])


def _moved(p: Column, way: Column, by: Column | float) -> Column:
    return point(p["x"] + way["x"] * by, p["y"] + way["y"] * by)


def edge_path(a: Column, a_side: Column, b: Column, b_side: Column) -> Column:
    """A cubic curve that leaves both cards at right angles."""
    bulge = F.greatest(F.lit(float(LEAST_BULGE)), F.least(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) * BULGE, F.lit(float(MOST_BULGE))))
    c, d = _moved(a, outward(a_side), bulge), _moved(b, outward(b_side), bulge)
    return _path("M", a["x"], a["y"], "C", c["x"], c["y"], d["x"], d["y"], b["x"], b["y"])


def loop_path(rect: Column, y: Column) -> Column:
    """A relation of a table to itself, on the right side."""
    x, out = rect["x"] + rect["width"], rect["x"] + rect["width"] + LOOP_OUT
    return _path("M", x, y - LOOP_HALF, "C", out, y - LOOP_HALF, out, y + LOOP_HALF, x, y + LOOP_HALF)


def marker(p: Column, side: Column, style: Column) -> Column:
    """Crow's foot or bar at an end of ``one``, ``many``, ``zero-or-one`` or ``zero-or-many``: ``path`` and, for zero, ``circle``."""
    way = outward(side)
    across = point(-way["y"], way["x"])
    many, zero = style.endswith("many"), style.startswith("zero")
    apex = _moved(p, way, FOOT_LENGTH)
    legs = [_path("M", apex["x"], apex["y"], "L", e["x"], e["y"]) for e in (_moved(p, across, FOOT_SPREAD), p, _moved(p, across, -FOOT_SPREAD))]
    middle = _moved(p, way, TICK_AT)
    a, b = _moved(middle, across, TICK_HALF), _moved(middle, across, -TICK_HALF)
    path = F.when(many, F.concat_ws(" ", *legs)).otherwise(_path("M", a["x"], a["y"], "L", b["x"], b["y"]))
    far = _moved(p, way, F.when(many, FOOT_LENGTH).otherwise(TICK_AT) + CIRCLE + CIRCLE_GAP)
    circle = F.when(zero, F.struct(F.round(far["x"], 2).alias("cx"), F.round(far["y"], 2).alias("cy"), F.lit(CIRCLE).alias("r")))
    return F.struct(path.alias("path"), circle.alias("circle"))


def overlap(a: Column, b: Column, pad: float = 0) -> Column:
    across = (a["x"] - pad < b["x"] + b["width"]) & (a["x"] + a["width"] + pad > b["x"])
    return across & (a["y"] - pad < b["y"] + b["height"]) & (a["y"] + a["height"] + pad > b["y"])


def bounds(rects: DataFrame, *keys: str) -> DataFrame:
    """The box around the rectangles ``rect`` of each key; no row where there are none."""
    r = F.col("rect")
    spans = rects.groupBy(*keys).agg(F.min(r["x"]).alias("x"), F.min(r["y"]).alias("y"), F.max(r["x"] + r["width"]).alias("right"), F.max(r["y"] + r["height"]).alias("bottom"))
    return spans.where("x IS NOT NULL").select(*keys, "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height"))


def overlapping(spans: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs (a, b) of ids whose spans (id, low, high) of one key overlap, the smaller id first.

    Spans meet by equality in the strips of ``width`` that they touch; a pair counts
    in the strip where the later of both begins, so none comes twice.
    """
    last = F.greatest(F.floor((F.col("high") - 1) / width), F.floor(F.col("low") / width))
    strips = spans.withColumn("strip", F.explode(F.sequence(F.floor(F.col("low") / width), last)))
    a, b = (strips.select(*keys, "strip", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "low", "high")]) for side in ("a", "b"))
    meets = (F.col("id_a") < F.col("id_b")) & (F.col("low_a") < F.col("high_b")) & (F.col("low_b") < F.col("high_a"))
    begins = F.floor(F.greatest("low_a", "low_b") / width) == F.col("strip")
    return a.join(b, [*keys, "strip"]).where(meets & begins).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
