"""SimHash near-duplicates, found by deletion variants of fingerprint segments.

Two fingerprints of 64 bits that differ in at most 3 are cut into 2 segments of 32: in one of them
they differ by at most one bit. So each distinct fingerprint is indexed under each of its segments
with one bit left out, 64 keys in all, and two fingerprints that link share a key. Under each key
they are then compared in full. Exact copies are one fingerprint from the start.

A key that more than ``LARGEST`` fingerprints share is not compared as it is. Those fingerprints
agree in 31 bits; they are indexed anew under the other segment, cut into halves of 16 bits that
again differ by at most one bit in one half, and where that still leaves too many, under its
quarters of 8. By then 53 bits agree, and at most 2**11 fingerprints can share a key. No pair is
lost at any level, and no task holds more than one key's bounded list.

Within a key a search from fingerprint to fingerprint emits a spanning forest of the links, never
all pairs; connected components need no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ddl, per_batch, saved, tune, utf8, with_text
from .components import components

#: Production parameters.
SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
LARGEST = 8192

_BITS = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text; 0 for a null text or one without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BITS):
        part = hashes[i : i + _BITS].astype(">u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp``, the fingerprint as a signed long."""
    tune(docs.sparkSession)
    source, name = with_text(docs, keep, text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle, seed) for t in utf8(batch, name)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(fps)], [*keep, "fp"])

    return source.mapInArrow(per_batch(run), ddl(source.select(*keep), "fp long"))


def _mask(low: int, bits: int, without: int | None = None) -> int:
    """Signed long with ``bits`` bits set from bit ``low`` up, but for bit ``without``."""
    mask = ((1 << bits) - 1) << low & ~(0 if without is None else 1 << without)
    return mask - (1 << 64) if mask >> 63 else mask


def _by_region(bits: int, of) -> Column:
    """The array that ``of`` makes for the open region of ``bits`` bits that starts at column ``low``."""
    out = F.array(*of(0))
    for low in range(bits, 64, bits):
        out = F.when(F.col("low") == low, F.array(*of(low))).otherwise(out)
    return out


def _halves(low: int, bits: int) -> list[tuple[int, int]]:
    """Start of each half of a region, and of the other half."""
    return [(low, low + bits // 2), (low + bits // 2, low)]


def _keyed(rows: DataFrame, bits: int) -> DataFrame:
    """Rows (k, low, fp) under the keys of their open region: a half of it with one bit left out."""
    variants = _by_region(bits, lambda low: [F.struct(F.lit(_mask(at, bits // 2, i)).alias("mask"), F.lit(other).alias("low")) for at, other in _halves(low, bits) for i in range(at, at + bits // 2)])
    out = rows.select("k", "fp", F.explode(variants).alias("v"))
    return out.select(F.xxhash64("k", "v.mask", F.col("fp").bitwiseAND(F.col("v.mask"))).alias("k"), "v.low", "fp")


def _heavy(rows: DataFrame, bits: int, largest: int) -> DataFrame:
    """Keys of ``_keyed`` that may have over ``largest`` rows.

    A key holds what has either of two values in a half, so one of them has over half as many; two
    rows for each fingerprint are counted for it, not one for each key.
    """
    parts = _by_region(bits, lambda low: [F.struct(F.lit(at).alias("at"), F.lit(_mask(at, bits // 2)).alias("mask")) for at, _ in _halves(low, bits)])
    values = rows.select("k", "fp", F.explode(parts).alias("v")).groupBy("k", "v.at", F.col("fp").bitwiseAND(F.col("v.mask")).alias("s")).count().where(F.col("count") > largest // 2)
    masks = F.array(*(F.array(*(F.lit(_mask(at, bits // 2, i)) for i in range(at, at + bits // 2))) for at in range(0, 64, bits // 2)))
    return values.select("k", "s", F.explode(F.get(masks, (F.col("at") / (bits // 2)).cast("int"))).alias("mask")).select(F.xxhash64("k", "mask", F.col("s").bitwiseAND(F.col("mask"))).alias("k")).distinct()


def _links(group: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Spanning forest of the links among distinct fingerprints."""
    a: list[int] = []
    b: list[int] = []
    rest = group
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= most
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                a.extend([int(at)] * len(found))
                b.extend(found.tolist())
    return a, b


def _forest(most: int):
    """``mapInArrow`` function over rows (k, fp) sorted by k: links within each k, each k at once."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows cut between keys, so that no key stands in two blocks."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            k, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1], "left"))
            if held and k[0] != held[-1][0][-1] or cut:
                held.append((k[:cut], fp[:cut]))
                held = [x for x in held if len(x[0])]
                if held:
                    yield np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                held = []
            held.append((k[cut:], fp[cut:]))
        if held:
            yield np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, fp in blocks(batches):
            fp = fp.view(np.uint64)
            edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            sizes = np.diff(edge)
            pairs = edge[:-1][sizes == 2]
            near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= most
            a, b = [fp[pairs[near]]], [fp[pairs[near] + 1]]
            for start, size in zip(edge[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                x, y = _links(fp[start : start + size], most)
                a.append(np.array(x, np.uint64))
                b.append(np.array(y, np.uint64))
            links = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return run


def near_links(fps: DataFrame, most: int = MAX_DISTANCE, largest: int = LARGEST) -> DataFrame:
    """Links ``(a, b)`` that connect what fingerprints within ``most`` (3 or fewer) bits connect.

    ``fps``: distinct values in a column ``fp``. Every pair that is returned is a link; pairs that
    follow through others under the same key are left out.
    """
    if not 0 <= most <= 3:
        raise ValueError("halves with one bit left out hold links of at most 3 bits")
    rows = fps.select(F.lit(0).cast("long").alias("k"), F.lit(0).alias("low"), "fp").where("fp is not null")
    forest = lambda df: df.select("k", "fp").repartition("k").sortWithinPartitions("k", "fp").mapInArrow(_forest(most), "a long, b long")
    links = None
    for bits in (64, 32, 16):
        keyed = _keyed(rows, bits)
        heavy = saved(_heavy(rows, bits, largest)) if bits > 16 else None
        last = heavy is None or heavy.isEmpty()
        found = forest(keyed if last else keyed.join(heavy, "k", "left_anti"))
        links = found if links is None else links.union(found)
        if last:
            break
        rows = saved(keyed.join(heavy, "k", "left_semi"))
    return links


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), most: int = MAX_DISTANCE, shingle: int = SHINGLE, seed: int = SEED, largest: int = LARGEST) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``fp``, ``root`` and ``component_id`` of every row of ``docs``.

    Texts are lower-cased (A-Z only) and cut into words at ASCII white space; a fingerprint's bit
    is set if it is in over half the XXH64 of the ``shingle``-word shingles, repeats included.
    Fingerprints that differ in ``most`` bits or fewer link; ``component_id`` is the smallest
    ``doc_id`` reachable, the row's own included. ``root``, a fingerprint, names the component too.

    A text with fewer words than a shingle is hashed as a whole; a null text, or one without words,
    has fingerprint 0, which links like any other. Rows without a ``doc_id`` take part; a component
    without any has a null ``component_id``. Repeated rows come back as often as they came; an empty
    table gives no rows; other columns may have any names.
    """
    marked = saved(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), *(F.col(c) for c in keep)), "__text", ("doc_id", *keep), shingle, seed))
    fps = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("own")))
    rooted = fps.join(components(near_links(fps, most, largest)).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("own").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", *keep, "fp", "root", "component_id")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates: of each component the one with the smallest id.

    An id that several rows share, or a component without ids, leaves the row with the smallest
    hash; of rows that are equal in all columns one stays. All columns come back as they were.
    """
    keys = [F.xxhash64(F.lit(n), *(F.col(f"`{c}`") for c in docs.columns)).alias(f"__k{n}") for n in (1, 2)]
    marked = docs.select("*", *keys)
    groups = near_duplicates(marked, text, doc_id, ("__k1", "__k2"), most)
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__k1", "__k2")).alias("x")).select("x.__k1", "x.__k2")
    return marked.join(kept, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2")


def hex_of(fp: Column) -> Column:
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
