"""Boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box_metrics(boxes: DataFrame) -> DataFrame:
    """``boxes`` (quad: array of x, y) with extents, centre and size."""
    side = lambda f, c: f(F.transform("quad", lambda p: p[c]))
    out = boxes.withColumns({"x_min": side(F.array_min, "x"), "x_max": side(F.array_max, "x"), "y_min": side(F.array_min, "y"), "y_max": side(F.array_max, "y")})
    return out.withColumns({"cx": (F.col("x_min") + F.col("x_max")) / 2, "cy": (F.col("y_min") + F.col("y_max")) / 2, "w": F.col("x_max") - F.col("x_min"), "h": F.col("y_max") - F.col("y_min")})


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common area of two boxes [x0, y0, x1, y1], as a share of the smaller one."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(side(0) * side(1) / F.nullif(F.least(area(a), area(b)), F.lit(0.0)), F.lit(0.0))


def rotate_box(box: Column, turns: Column, width: Column, height: Column) -> Column:
    """A box after quarter-turns of a page; the page's sides change places with each."""
    x0, y0, x1, y1 = (box[i] for i in range(4))
    return F.when(turns == 1, F.array(height - y1, x0, height - y0, x1)).when(turns == 2, F.array(width - x1, height - y1, width - x0, height - y0)).when(turns == 3, F.array(y0, width - x1, y1, width - x0)).otherwise(box)


def base_scale(width: Column, height: Column) -> Column:
    """1600 for the longer side, between 1 and 1.5."""
    return F.least(F.greatest(F.lit(1600.0) / F.greatest(F.lit(1.0), width, height), F.lit(1.0)), F.lit(1.5))


def to_scene(box: Column, zoom: Column, scale: Column) -> Column:
    """A box in pixels, its corners in order."""
    f = zoom / scale
    return F.array(F.least(box[0], box[2]) * f, F.least(box[1], box[3]) * f, F.greatest(box[0], box[2]) * f, F.greatest(box[1], box[3]) * f)


def flipped(boxes: DataFrame, height: str, scale: str) -> DataFrame:
    """A4: annotation boxes from below to above, and scaled; their source is ``shx``."""
    quad = F.transform("quad", lambda p: F.struct((p["x"] * F.col(scale)).alias("x"), ((F.col(height) - p["y"]) * F.col(scale)).alias("y")))
    return boxes.where(F.col("subject").contains("SHX")).withColumn("quad", quad).withColumn("source", F.lit("shx"))


def char_spans(text: Column, words: Column, offset: Column, scale: Column) -> Column:
    """Spans (s, x0, x1) of words as spans of characters; none if they don't spell the text."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w["s"])), lambda i: F.struct(F.substring(w["s"], i, F.lit(1)).alias("s"), ((w["x0"] + (w["x1"] - w["x0"]) * (i - 1) / F.length(w["s"])) * scale + offset).alias("x0"), ((w["x0"] + (w["x1"] - w["x0"]) * i / F.length(w["s"])) * scale + offset).alias("x1")))
    same = F.array_join(F.transform(words, lambda w: w["s"]), "") == F.replace(text, F.lit(" "), F.lit(""))
    return F.when(same, F.flatten(F.transform(words, one)))


def orientation(votes_upright: Column, votes_turned: Column) -> Column:
    """Whether a page has to be tried in other directions."""
    return (votes_turned >= 12) & (votes_turned > 2 * votes_upright)


def accept_reread(before: Column, after: Column, letters_before: Column, letters_after: Column) -> Column:
    """Whether a second reading of a flipped box is taken: clearly more alike, and of like length."""
    ratio = letters_after / F.nullif(letters_before, F.lit(0))
    return F.coalesce((before < 0.78) & (after >= 0.85) & (after >= before + 0.10) & ratio.between(0.5, 2.5), F.lit(False))


def tiles(width: Column, height: Column, size: int = 2400, step: int = 1900) -> Column:
    """Overlapping tiles [x0, y0, x1, y1] that cover an image."""
    starts = lambda side: F.when(side <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(side - size + step - 1, F.lit(0)).cast("int"), F.lit(step)))
    return F.flatten(F.transform(starts(height), lambda y: F.transform(starts(width), lambda x: F.array(x, y, F.least(x + size, width), F.least(y + size, height)))))
