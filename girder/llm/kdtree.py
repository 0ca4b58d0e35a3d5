"""Sharding by a k-d tree over document metadata, with distributed weighted medians.

A node is split along the metadata dimension that is widest in it, at the median of its documents
weighted by bytes, until there are as many leaves as bring them to the target bytes. All nodes of a
level are split together, by aggregations over narrow rows: the range of each dimension in each node,
then histograms of bytes that close in on the medians. Nodes and their limits are small tables that
rows are joined with, broadcast up to a number of nodes; the driver sees how many are still open.

A place along a dimension is a long: 31 bits of the value, then 31 bits of a hash of id and text.
The value of a name is its number among the distinct names in order. The hash splits values that many
documents share, so no value is too common to be divided. Only documents equal in id and text share a
place; where they straddle a median they stay together, until the leaf; see ``shards``.

Slots within a shard are numbered by hash ranges: each range is counted, ranges are offset by the
sums before them, and rows are numbered within their range. The number of ranges follows the number
of documents, so a task never holds more than a bounded part of a shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import looked_up, places, saved

#: Production parameters.
SHARDS = 8
SEED = 42
#: Bins of a histogram pass; bytes beside the median that end the passes, as a share of the node.
BINS = 1 << 16
TOLERANCE = 1e-4
#: Rows of one range when slots are numbered.
RANGE_ROWS = 50_000

_LOW = 31
_TOP = (1 << 31) - 1


def _place(value: Column, tie: Column) -> Column:
    return F.shiftleft(F.least(F.greatest(F.coalesce(value, F.lit(0)).cast("long"), F.lit(0).cast("long")), F.lit(_TOP).cast("long")), _LOW).bitwiseOR(tie)


def _medians(rows: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """``(node, cut)``: the place up to which the share ``share`` of a node's bytes lies.

    ``rows``: (node, size, p); ``nodes``: (node, share, low, high, bytes), with the range of their
    places; there are ``most`` at most.
    """
    state = saved(nodes.select("node", "low", "high", "bytes", (F.col("share") * F.col("bytes")).alias("aim"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("cut")))
    while not (open_ := state.where("cut is null")).isEmpty():
        limits = open_.withColumn("step", F.greatest(F.lit(1).cast("long"), F.expr(f"(high - low) div {BINS} + 1")))
        bins = looked_up(rows, limits, "node", F.col("p"), most).where("p between low and high").groupBy("node", F.expr("(p - low) div step").alias("bin")).agg(F.sum("size").alias("size"))
        known = looked_up(bins, limits, "node", F.col("bin"), most)
        upto = known.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("node").orderBy("bin")))
        # The first bin that reaches the share; the last one does.
        first = upto.where("upto >= aim").groupBy("node").agg(F.min(F.struct("bin", "size", "upto", "low", "high", "step", "bytes", "aim")).alias("b"))
        start = F.col("b.low") + F.col("b.bin") * F.col("b.step")
        end = F.least(F.col("b.high"), start + F.col("b.step") - 1)
        below = F.col("b.upto") - F.col("b.size")
        # The cut lies on the side of the bin that is nearer.
        cut = F.when(F.abs(F.col("b.upto") - F.col("b.aim")) <= F.abs(below - F.col("b.aim")), end).otherwise(start - 1)
        found = first.select("node", start.alias("low"), end.alias("high"), "b.bytes", "b.aim", below.alias("before"), F.when((F.col("b.step") == 1) | (F.col("b.size") <= TOLERANCE * F.col("b.bytes")), cut).alias("cut"))
        state = saved(state.where("cut is not null").unionByName(found))
    return state.select("node", "cut")


def tree(rows: DataFrame, leaves: int, dims: list[str]) -> DataFrame:
    """``rows`` with ``shard``: the leaf of the tree that a row is in, of ``leaves``.

    ``rows``: size and a place for each of ``dims``. Of equally wide dimensions, as a share of what
    they are in all rows, the first is cut; a node whose documents are all alike is cut by the hash.
    """
    value = lambda d: F.shiftright(d, _LOW)
    first = rows.agg(*(F.greatest(F.lit(1), F.max(value(d)) - F.min(value(d))) for d in dims)).first()
    scale = [x or 1 for x in first]
    nodes = rows.sparkSession.range(1).select(F.lit(1).cast("long").alias("node"), F.lit(leaves).cast("long").alias("leaves"), F.lit(0).cast("long").alias("first"))
    current = rows.withColumn("node", F.lit(1).cast("long"))
    for level in range((leaves - 1).bit_length()):
        most = min(leaves, 1 << level)
        held = looked_up(current, nodes.where("leaves > 1"), "node", F.col(dims[0]), most)
        ranges = [x for d in dims for x in (F.min(d).alias(f"low_{d}"), F.max(d).alias(f"high_{d}"))]
        sums = held.groupBy("node", "leaves", "first").agg(F.sum("size").alias("bytes"), *ranges)
        widths = F.array(*((value(f"high_{d}") - value(f"low_{d}")) / F.lit(float(s)) for d, s in zip(dims, scale, strict=True)))
        of = lambda side: F.get(F.array(*(F.col(f"{side}_{d}") for d in dims)), F.col("dim"))
        left = F.expr("(leaves + 1) div 2")
        split = sums.withColumn("dim", (F.array_position(widths, F.array_max(widths)) - 1).cast("int")).select("node", "leaves", "first", "bytes", "dim", of("low").alias("low"), of("high").alias("high"), left.alias("left"), (left / F.col("leaves")).alias("share"))
        split = saved(split)
        place = F.get(F.array(*map(F.col, dims)), F.col("dim"))
        at = looked_up(current, split.select("node", "dim"), "node", F.col(dims[0]), most).select("node", "size", place.alias("p"))
        cuts = saved(split.join(_medians(at, split, most), "node"))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("leaves"), F.col("first")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("leaves") - F.col("left")).alias("leaves"), (F.col("first") + F.col("left")).alias("first")))
        moved = looked_up(current, cuts.select("node", "dim", "cut"), "node", F.col(dims[0]), most, "left")
        side = F.when(F.col("cut").isNull(), F.col("node")).otherwise(F.col("node") * 2 + (place > F.col("cut")).cast("long"))
        # Narrow rows are written at each level, so that no plan holds the joins of those before.
        current = saved(moved.withColumn("node", side).select(*current.columns))
        nodes = saved(nodes.where("leaves = 1").unionByName(cuts.select(F.explode(sides).alias("x")).select("x.*")))
    named = nodes.select("node", F.col("first").cast("int").alias("shard"))
    return looked_up(current, named, "node", F.col(dims[0]), leaves).drop("node")


def shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text", numbers: tuple[str, ...] = ("n_chars",), names: tuple[str, ...] = ("source", "lang"), seed: int = SEED) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every row of ``docs``.

    Give ``n_shards``, or ``target_bytes`` for as many shards as keep to it on average. ``size``:
    UTF-8 bytes of the text and 1. Dimensions are the size, the columns ``numbers`` (0 to 2**31, cut
    off beyond) and ``names`` (in order of code points). Shards are numbered from 0 in the order of
    the tree; ``slot`` runs from 0 without gaps in each. With a number of shards that is no power of
    two, a node is cut in the proportion of the leaves on its sides.

    A null text has no bytes; null numbers count as 0, null names come last; rows without an id take
    part. Rows that are equal in id and text share a place, so that they come to one shard. An
    empty table gives no rows. The same rows and seed give the same shards.
    """
    rows, dims = _placed(docs, doc_id, text, numbers, names, seed)
    rows = saved(rows)
    count, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    leaves = n_shards if n_shards else max(1, math.ceil((total or 0) / target_bytes))
    placed = tree(rows, leaves, dims).select("doc_id", "size", "text_crc32", "tie", "shard")
    return numbered(placed, max(1, -(-(count or 0) // RANGE_ROWS)))


def _placed(docs: DataFrame, doc_id: str, text: str, numbers: tuple[str, ...], names: tuple[str, ...], seed: int) -> tuple[DataFrame, list[str]]:
    """Narrow rows with a place for each dimension, and the names of those columns."""
    crc = F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.crc32(F.encode(F.col(text), "utf-8")))
    tie = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), 64 - _LOW)
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    number = [f"d{i + 1}" for i in range(len(numbers))]
    name = [f"d{i + 1 + len(numbers)}" for i in range(len(names))]
    rows = saved(docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), tie.alias("tie"), *(F.col(c).cast("long").alias(d) for c, d in zip(numbers, number, strict=True)), *(F.col(c).alias(d) for c, d in zip(names, name, strict=True))))
    for d in name:
        rows = looked_up(rows, places(rows.select(d)).withColumnRenamed("value", d).withColumnRenamed("place", f"{d}_place"), d, F.col("tie"))
    values = {"d0": F.col("size")} | {d: F.col(d) for d in number} | {d: F.col(f"{d}_place") for d in name}
    return rows.select("doc_id", "size", "text_crc32", "tie", *(_place(v, F.col("tie")).alias(d) for d, v in values.items())), list(values)


def numbered(placed: DataFrame, ranges: int) -> DataFrame:
    """``placed`` without ``tie``, with ``slot``: 0, 1, ... in each shard, in the order of ties."""
    placed = saved(placed.withColumn("part", F.expr(f"(tie * {ranges}L) div {1 << _LOW}L").cast("int")))
    sums = placed.groupBy("shard", "part").count()
    before = sums.select(F.col("shard").alias("s"), F.col("part").alias("r"), (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("tie", "doc_id", "text_crc32", "size")) - 1
    numbers = placed.withColumn("within", within)
    return numbers.join(before, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("r"))).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"))
