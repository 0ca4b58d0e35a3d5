"""Mixing sources to target weights by capped water-filling, with seeded repetitions.

A source's target is its weight's share of the mix, but at most ``max_epochs`` times its size; what
is cut off goes to the others in proportion to their weights, until none is above its limit. A
source then gives each document whole repetitions, as many as fit in its target, and once more the
documents that come first in a seeded order, until the target is reached.

The seeded order is that of a hash. Where it has to be cut is found in passes: sizes by source and
bucket of the hash, 256 of them and combined map-side, then the same within the bucket that holds
the cut, and at last the documents of a bucket that holds a 2**24th of its source. So neither a
source with most of the rows nor its order ever meets in one task. Copies of one document share a
place; where the cut falls among them they are counted, and as many are taken as bring the source
nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import looked_up, places, saved, word_count

#: Production parameters.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 42

#: Bits of a place in the seeded order; bits that a pass looks at, and passes.
_PLACES, _STEP, _PASSES = 63, 8, 3
#: Copies of a document that one row makes at once.
_AT_ONCE = 10_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` from one row ``(source, source_size)`` for each source.

    Sources in order of code points, null last, weigh ``weights`` in turn, repeating, and share
    ``share`` times all sizes. A mix of more than ``max_epochs`` times everything is cut to that.
    """
    turns = places(sizes.select("source")).select(F.col("value").alias("source"), (F.col("place") % len(weights)).cast("int").alias("turn"))
    known = saved(looked_up(sizes, turns, "source", F.xxhash64("source")).select("source", "source_size", F.get(F.array(*map(F.lit, map(float, weights))), F.col("turn")).alias("weight")))
    limit = F.col("source_size") * F.lit(float(max_epochs))
    total = min(share, max_epochs) * float(known.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        # A source stays at its limit once it is there: the level never falls.
        full = F.lit(clamped >= 0) & (limit <= F.col("weight") * F.lit(level))
        n, held, free = known.agg(F.count(F.when(full, 1)), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - (held or 0.0)) / free
    return known.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(level)).alias("target"))


def _order(doc_id: str, text: str, seed: int) -> Column:
    """Place of a document in the seeded order, from 0 up."""
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).bitwiseAND(F.lit((1 << _PLACES) - 1))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """What each document weighs, and what each source gives.

    First ``(doc_id, source, size, at)``, written once; second one row for each source: ``(source,
    source_size, target, whole, cut, tie, take)``: documents with ``at <= cut`` are taken once more
    than ``whole`` times, and so are ``take`` of those at ``tie``, if that isn't null.
    """
    sized = saved(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _order(doc_id, text, seed).alias("at")))
    aims = saved(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    # Each pass finds, for each source, the bucket of the order in which the rest of its target ends.
    cuts = aims.select("source", F.lit(0).cast("long").alias("bucket"), F.col("rest").alias("left")).where("left > 0")
    for low in range(_PLACES - _STEP, _PLACES - _PASSES * _STEP - 1, -_STEP):
        found = _joined(sized, cuts).where(F.shiftright("at", low + _STEP) == F.col("bucket"))
        sums = found.groupBy("source", "left", F.shiftright("at", low).alias("bucket")).agg(F.sum("size").alias("n"))
        before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n"))
        cuts = saved(before.where("n > 0 and before < left and left <= before + n").select("source", "bucket", (F.col("left") - F.col("before")).alias("left")))
    # Places of the last bucket: those that fit whole, and of the one that is cut so many copies.
    edge = _joined(sized, cuts).where(F.shiftright("at", low) == F.col("bucket")).groupBy("source", "bucket", "left", "at").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("copies"))
    upto = edge.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("at")))
    before = F.col("upto") - F.col("n")
    split = F.when((before < F.col("left")) & (F.col("upto") > F.col("left")), F.struct("at", F.round((F.col("left") - before) * F.col("copies") / F.col("n")).cast("long").alias("take"), "copies"))
    ends = upto.groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("left"), F.col("at"))).alias("fit"), F.max(split).alias("split"), F.min("bucket").alias("bucket"))
    every, some = F.col("split.take") == F.col("split.copies"), (F.col("split.take") > 0) & (F.col("split.take") < F.col("split.copies"))
    ends = ends.select("source", F.coalesce(F.when(every, F.col("split.at")), "fit", F.shiftleft("bucket", low) - 1).alias("cut"), F.when(some, F.col("split.at")).alias("tie"), F.when(some, F.col("split.take")).alias("take"))
    match = F.col("a.source").eqNullSafe(F.col("e.source"))
    out = aims.alias("a").join(ends.alias("e"), match, "left").select("a.source", "source_size", "target", "whole", F.coalesce("e.cut", F.lit(-1).cast("long")).alias("cut"), "e.tie", "e.take")
    return sized, saved(out)


def _joined(rows: DataFrame, of_source: DataFrame) -> DataFrame:
    """``rows``, with a source and a place in the order, and the columns of ``of_source``."""
    return looked_up(rows, of_source, "source", F.col("at"))


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says; many copies of one are made by many tasks."""
    parts = rows.where(F.col(times) > 0).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / _AT_ONCE))))
    dealt = parts.repartition(F.xxhash64(*(F.col(f"`{c}`") for c in parts.columns)))
    return dealt.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_AT_ONCE), F.col(times) - F.col("__part") * _AT_ONCE)))).drop("__part", "__turn", times)


def _with_repeats(rows: DataFrame, aims: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of each of ``rows`` and ``repeats``, how often the mix has it.

    Equal rows at a place that is cut are counted, and the first ``take`` of them are taken once more.
    """
    joined = _joined(rows, aims)
    once = F.col("whole") + (F.col("at") <= F.col("cut")).cast("int")
    if aims.where("tie is not null").isEmpty():
        return joined.select(*columns, once.alias("repeats"))
    tied = F.coalesce(F.col("at") == F.col("tie"), F.lit(False))
    equal = joined.where(tied).groupBy(*columns, *([] if "source" in columns else ["source"]), "whole", "take").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(*columns)).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("take") - F.coalesce(F.sum("copies").over(order), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("copies"), left))
    sides = equal.withColumn("more", more).withColumn("side", F.explode(F.array(F.struct((F.col("whole") + 1).alias("repeats"), F.col("more").alias("copies")), F.struct(F.col("whole").alias("repeats"), (F.col("copies") - F.col("more")).alias("copies")))))
    dealt = _repeated(sides.select(*columns, F.col("side.repeats").alias("repeats"), F.col("side.copies").alias("__copies")), "__copies")
    return joined.where(~tied).select(*columns, once.alias("repeats")).unionByName(dealt)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, repeats, taken)`` for every row of ``docs``.

    ``size``: words, 0 for a null or empty text. ``repeats``: how often the mix has the document,
    ``max_epochs`` rounded up at most; ``taken`` = size * repeats. Documents without words have a
    source's whole repetitions, and another where their place in the order says so. Null is a source
    like another, the last. Of documents that are equal in id and text, some may be taken once more
    than others, so a source of such copies comes as near to its target as any. An empty table gives
    no rows; other columns may have any names. The same rows and seed give the same result.
    """
    sized, aims = plan(docs, doc_id, text, source, weights, share, max_epochs, seed)
    out = _with_repeats(sized, aims, ["doc_id", "source", "size", "source_size", "target"])
    return out.withColumn("taken", F.col("size") * F.col("repeats"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix`` says, with their columns.

    Odd rows are as in ``mix``; columns may have any names, but none may be a map.
    """
    _, aims = plan(docs, doc_id, text, source, weights, share, max_epochs, seed)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source).alias("source"), _order(doc_id, text, seed).alias("at"))
    out = _with_repeats(rows, aims, ["row"])
    return out.where("repeats > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), "repeats"))).select("row.*")
