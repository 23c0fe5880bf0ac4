"""Box algebra on struct<x, y, width, height> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<x:int,y:int,width:int,height:int>"


def rounded(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5).cast("int")


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("width"), h.cast("int").alias("height"))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def area(b: Column) -> Column:
    return b["width"].cast("double") * b["height"]


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(right(a), right(b)) - F.greatest(a["x"], b["x"]), F.lit(0)).cast("double")
    h = F.greatest(F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"]), F.lit(0))
    both = w * h
    total = area(a) + area(b) - both
    return F.when(total > 0, both / total).otherwise(0.0)


def contains(a: Column, b: Column) -> Column:
    return (a["x"] <= b["x"]) & (a["y"] <= b["y"]) & (right(a) >= right(b)) & (bottom(a) >= bottom(b))


def overlaps(a: Column, b: Column) -> Column:
    """They share area; touching edges do not count."""
    return (a["x"] < right(b)) & (right(a) > b["x"]) & (a["y"] < bottom(b)) & (bottom(a) > b["y"])


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(right(a), right(b)) - x, F.greatest(bottom(a), bottom(b)) - y)


def enclosing(boxes: Column) -> Column:
    """The smallest box around an array of boxes; all zero for none."""
    x, y = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
    w, h = F.array_max(F.transform(boxes, right)) - x, F.array_max(F.transform(boxes, bottom)) - y
    return F.when(F.size(boxes) > 0, box(x, y, w, h)).otherwise(box(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))


def map_box(b: Column, scale_x: Column, scale_y: Column, shot_w: Column, shot_h: Column) -> Column:
    """From page to picture: scaled, rounded, then clamped to the picture; the width is not reduced by what x was moved."""
    x = F.greatest(F.lit(0), F.least(rounded(b["x"] * scale_x), shot_w - 1))
    y = F.greatest(F.lit(0), F.least(rounded(b["y"] * scale_y), shot_h - 1))
    w = F.greatest(F.lit(1), F.least(rounded(b["width"] * scale_x), shot_w - x))
    h = F.greatest(F.lit(1), F.least(rounded(b["height"] * scale_y), shot_h - y))
    return box(x, y, w, h)


def scale_mismatch(scale_x: Column, scale_y: Column) -> Column:
    return F.abs(scale_x - scale_y) > 0.1


def padded(b: Column, width: Column, height: Column, pad: int = 3) -> Column:
    """Grown by pad on each side, within a canvas."""
    x, y = F.greatest(F.lit(0), b["x"] - pad), F.greatest(F.lit(0), b["y"] - pad)
    return box(x, y, F.least(right(b) + pad, width) - x, F.least(bottom(b) + pad, height) - y)


def position_tag(b: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """top/mid/bottom-left/center/right by thirds of the page."""
    width, height = width if width is not None else F.lit(1280), height if height is not None else F.lit(800)
    cx, cy = (b["x"] + b["width"] / 2) / width, (b["y"] + b["height"] / 2) / height
    v = F.when(cy < 0.33, "top").when(cy < 0.66, "mid").otherwise("bottom")
    h = F.when(cx < 0.33, "left").when(cx < 0.66, "center").otherwise("right")
    return F.when(b.isNotNull(), F.concat_ws("-", v, h))


def fitted(width: Column, height: Column, dpr: Column, longest: int = 1152) -> Column:
    """struct<width, height, reduction>: to CSS pixels, then the long edge at most ``longest``, never enlarged; the area saved in percent."""
    w, h = rounded(width / dpr), rounded(height / dpr)
    s = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(w, h))
    fw, fh = F.greatest(F.lit(1), rounded(w * s)), F.greatest(F.lit(1), rounded(h * s))
    return F.struct(fw.alias("width"), fh.alias("height"), F.round((1 - fw.cast("double") * fh / (width.cast("double") * height)) * 100, 1).alias("reduction"))


def calibration(df: DataFrame, width: str, height: str, dpr: str, sizes: tuple[int, ...] = (1536, 1152, 896, 640)) -> DataFrame:
    """A row for each size a picture could be fitted to."""
    each = F.array(*[F.struct(F.lit(s).alias("longest"), fitted(F.col(width), F.col(height), F.col(dpr), s).alias("fit")) for s in sizes])
    return df.select("*", F.inline(each))


def read_scale(width: Column, height: Column) -> Column:
    """The factor that text recognition enlarges or reduces a crop by."""
    m = F.greatest(width, height).cast("double")
    return F.when(m < 500, F.least(F.lit(2.0), 900 / m)).when(m > 2000, 2000 / m).otherwise(1.0)


def cells(b: Column, size: int = 120) -> Column:
    """array<struct<cx, cy>> of the grid cells a box touches."""
    lo = lambda v: F.floor(v / size)
    return F.flatten(F.transform(F.sequence(lo(b["x"]), lo(right(b))), lambda cx: F.transform(F.sequence(lo(b["y"]), lo(bottom(b))), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def grid_join(a: DataFrame, b: DataFrame, key: str, box_a: str, box_b: str, on, size: int = 120) -> DataFrame:
    """Pairs of rows of equal key whose boxes satisfy ``on``: an equi-join on grid cells; each pair is kept in one cell only."""
    la = a.select("*", F.inline(cells(F.col(box_a), size)))
    lb = b.withColumnRenamed(key, "_key").select("*", F.inline(cells(F.col(box_b), size)).alias("_cx", "_cy"))
    first = lambda v: F.floor(F.greatest(F.col(box_a)[v], F.col(box_b)[v]) / size)
    met = (F.col(key) == F.col("_key")) & (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy"))
    return la.join(lb, met).where((F.col("cx") == first("x")) & (F.col("cy") == first("y")) & on(F.col(box_a), F.col(box_b))).drop("cx", "cy", "_cx", "_cy", "_key")
