"""Clusters along a line and over touching boxes.

Gaps-and-islands windows are exact where a gap to the neighbour decides. Where a running mean or an
earlier choice decides, one page at a time goes through pandas; a page is small and bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, group: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of rows within a group; a run begins where ``starts`` is true."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def edge_clusters(values: DataFrame, group: str, value: str, tolerance: float) -> DataFrame:
    """(group, cluster, n, mean): values chained by gaps of up to ``tolerance``; nulls are left out.

    Values within half a tolerance of each other are in one chain, so they are summed up by such steps
    before the shuffle; the window runs over steps, whose number follows the range of the values and
    not how many there are.
    """
    at = F.floor(F.col(value) / (tolerance / 2)) if tolerance > 0 else F.col(value)
    steps = values.where(F.col(value).isNotNull()).groupBy(group, at.alias("__at")).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__sum"))
    gap = F.col("__low") - F.lag("__high").over(Window.partitionBy(group).orderBy("__at"))
    marked = islands(steps, [group], ["__at"], F.coalesce(gap > tolerance, F.lit(False)), "cluster")
    return marked.groupBy(group, "cluster").agg(F.sum("__n").alias("n"), (F.sum("__sum") / F.sum("__n")).alias("mean"))


def row_islands(rows: DataFrame, group: str, row: str = "row") -> DataFrame:
    """Blocks of consecutive rows."""
    w = Window.partitionBy(group).orderBy(row)
    return rows.withColumn("block", F.col(row) - F.row_number().over(w))


def gap_segments(items: DataFrame, gap: float, height: float = 3.0) -> DataFrame:
    """Items of a line in segments, cut where the gap is over max(``gap``, ``height`` heights)."""
    w = Window.partitionBy("doc_id", "page", "line").orderBy("x_min", "ord")
    cut = F.coalesce(F.col("x_min") - F.lag("x_max").over(w) > F.greatest(F.lit(gap), F.lit(height) * F.col("h")), F.lit(False))
    return islands(items, ["doc_id", "page", "line"], ["x_min", "ord"], cut, "segment")


def joined_items(items: DataFrame, by: list[str]) -> DataFrame:
    """Texts in reading order with the box around them."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x_min", "ord", "text"))), lambda x: x["text"]), " ")
    return items.groupBy(*by).agg(text.alias("text"), F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"))


def reading_direction(chars: DataFrame) -> DataFrame:
    """(doc_id, page, rotation) by votes of steps from one character to the next; another
    direction than the usual one needs 1.5 times its votes."""
    w = Window.partitionBy("doc_id", "page", "line").orderBy("ord")
    step = chars.select("doc_id", "page", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy")).where("dx is not null")
    flat = F.abs("dx") >= F.abs("dy")
    votes = step.groupBy("doc_id", "page").agg(F.count_if(flat & (F.col("dx") > 0)).alias("v0"), F.count_if(~flat & (F.col("dy") > 0)).alias("v90"), F.count_if(flat & (F.col("dx") <= 0)).alias("v180"), F.count_if(~flat & (F.col("dy") <= 0)).alias("v270"))
    best = F.greatest("v90", "v180", "v270")
    rotation = F.when(best < F.col("v0") * 1.5, 0).when(F.col("v90") == best, 90).when(F.col("v180") == best, 180).otherwise(270)
    return votes.withColumn("rotation", F.when(best == 0, 0).otherwise(rotation))


def overlap_anti(primary: DataFrame, extra: DataFrame, share: float = 0.3) -> DataFrame:
    """Boxes of ``extra`` of which no box of ``primary`` on their page covers over ``share``."""
    p = primary.select("doc_id", "page", *(F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")))
    over = F.greatest(F.lit(0.0), F.least("x1", "p_x1") - F.greatest("x0", "p_x0")) * F.greatest(F.lit(0.0), F.least("y1", "p_y1") - F.greatest("y0", "p_y0"))
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1e-9))
    return extra.alias("e").join(p.alias("p"), (F.col("e.doc_id") == F.col("p.doc_id")) & (F.col("e.page") == F.col("p.page")) & (over > share * area), "left_anti")


def nearest_key_line(lines: DataFrame, keys: DataFrame, factor: float = 3.0) -> DataFrame:
    """Each line with the nearest key line of its page, if within ``factor`` heights."""
    both = lines.alias("l").join(keys.select("doc_id", "page", F.col("line").alias("key_line"), F.col("cy").alias("key_cy")).alias("k"), ["doc_id", "page"], "left")
    near = both.groupBy("doc_id", "page", "line", "cy", "h").agg(F.min_by("key_line", F.struct(F.abs(F.col("cy") - F.col("key_cy")), "key_line")).alias("key_line"), F.min(F.abs(F.col("cy") - F.col("key_cy"))).alias("distance"))
    return near.withColumn("key_line", F.when(F.col("distance") <= factor * F.col("h"), F.col("key_line")))


def lines_of(cy: np.ndarray, h: np.ndarray, tolerance: float = 0.0) -> np.ndarray:
    """Line of each item, from the top: the first line whose running mean is near enough."""
    tolerance = tolerance or max(6.0, 0.55 * float(np.median(h))) if len(cy) else tolerance
    out, means, counts = np.zeros(len(cy), np.int64), [], []
    for i in np.argsort(cy, kind="stable"):
        at = next((k for k, m in enumerate(means) if abs(cy[i] - m) < tolerance), len(means))
        if at == len(means):
            means.append(0.0)
            counts.append(0)
        means[at] = (means[at] * counts[at] + cy[i]) / (counts[at] + 1)
        counts[at] += 1
        out[i] = at
    return out


def columns_of(x: np.ndarray, w: np.ndarray, tolerance: float = 45.0) -> np.ndarray:
    """Column of each item from the left, by running means; then the nearest mean."""
    if not len(x):
        return np.zeros(0, np.int64)
    tolerance = max(20.0, 0.45 * float(np.median(w))) if tolerance in (0, 45.0) else tolerance
    means: list[float] = []
    counts: list[int] = []
    for v in np.sort(x):
        near = [k for k, m in enumerate(means) if abs(v - m) <= tolerance]
        if near:
            k = near[0]
            means[k] = (means[k] * counts[k] + v) / (counts[k] + 1)
            counts[k] += 1
        else:
            means.append(float(v))
            counts.append(1)
    centres = np.sort(np.array(means))
    return np.abs(x[:, None] - centres[None, :]).argmin(1)


def _by_page(items: DataFrame, run, more: str) -> DataFrame:
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema), more])
    return items.groupBy("doc_id", "page").applyInPandas(run, schema)


def page_lines(items: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``items`` with their ``line``."""
    return _by_page(items, lambda f: f.assign(line=lines_of(f["cy"].to_numpy(), f["h"].to_numpy(), tolerance)), "line long")


def text_columns(items: DataFrame, tolerance: float = 45.0) -> DataFrame:
    """``items`` with their ``column``."""
    return _by_page(items, lambda f: f.assign(column=columns_of(f["x_min"].to_numpy(), (f["x_max"] - f["x_min"]).to_numpy(), tolerance)), "column long")


def _shares(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Overlap of a box with others, as a share of the smaller one."""
    w = np.clip(np.minimum(box[2], others[:, 2]) - np.maximum(box[0], others[:, 0]), 0, None)
    h = np.clip(np.minimum(box[3], others[:, 3]) - np.maximum(box[1], others[:, 1]), 0, None)
    area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    return w * h / np.maximum(np.minimum(area(box), area(others)), 1e-9)


def suppress(frame: pd.DataFrame, share: float = 0.5) -> pd.DataFrame:
    """Of boxes that overlap keep the longest and surest; boxes cut at a tile's edge stay
    only where no whole box covers them. In order of y, x."""
    order = frame.assign(n=frame["text"].str.len()).sort_values(["cut", "n", "score", "ord"], ascending=[True, False, False, True])
    boxes = order[["x0", "y0", "x1", "y1"]].to_numpy(float)
    kept: list[int] = []
    for i in range(len(boxes)):
        if not kept or (_shares(boxes[i], boxes[kept]) < share).all():
            kept.append(i)
    return order.iloc[kept][frame.columns].sort_values(["y0", "x0", "ord"])


def deduplicated_boxes(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """E23 by page."""
    return boxes.groupBy("doc_id", "page").applyInPandas(lambda f: suppress(f, share), boxes.schema)


def touching_groups(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, gap: float) -> np.ndarray:
    """Groups of cells that touch within ``gap``, by a sweep from left to right and union-find."""
    root = np.arange(len(x0))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = np.argsort(x0, kind="stable")
    active: list[int] = []
    for i in order.tolist():
        active = [j for j in active if x1[j] + gap >= x0[i]]
        for j in active:
            if y0[i] - gap <= y1[j] and y0[j] - gap <= y1[i]:
                root[find(i)] = find(j)
        active.append(i)
    return np.array([find(i) for i in range(len(x0))])


def ruled_tables(cells: DataFrame, unit: float = 1.0) -> DataFrame:
    """Grids (doc_id, page, grid_id, x0, y0, x1, y1, row_edges, col_edges, n_cells) of touching
    cells: four or more, in two or more rows and columns; numbered from the top left."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a = {c: frame[c].to_numpy(float) for c in ("x0", "y0", "x1", "y1")}
        group = touching_groups(a["x0"], a["y0"], a["x1"], a["y1"], 8 * unit)
        edges = lambda v: _means(np.sort(v), 8 * unit)
        rows = []
        for g in np.unique(group):
            m = group == g
            cols, lines = edges(np.concatenate((a["x0"][m], a["x1"][m]))), edges(np.concatenate((a["y0"][m], a["y1"][m])))
            if m.sum() >= 4 and len(cols) >= 3 and len(lines) >= 3:
                rows.append((a["x0"][m].min(), a["y0"][m].min(), a["x1"][m].max(), a["y1"][m].max(), lines, cols, int(m.sum())))
        rows.sort(key=lambda r: (r[1], r[0]))
        return pd.DataFrame([(frame["doc_id"].iloc[0], frame["page"].iloc[0], i, *r) for i, r in enumerate(rows)], columns=["doc_id", "page", "grid_id", "x0", "y0", "x1", "y1", "row_edges", "col_edges", "n_cells"])

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    return cells.groupBy("doc_id", "page").applyInPandas(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, grid_id int, x0 double, y0 double, x1 double, y1 double, row_edges array<double>, col_edges array<double>, n_cells int")


def _means(values: np.ndarray, tolerance: float) -> list[float]:
    """E3 for one page: means of chained values."""
    cuts = np.flatnonzero(np.diff(values) > tolerance) + 1
    return [float(part.mean()) for part in np.split(values, cuts)]
