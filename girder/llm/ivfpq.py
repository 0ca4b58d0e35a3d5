"""Approximate nearest neighbours by cosine: inverted lists, product-quantised residuals, exact reranking.

Fitting takes at most ``SAMPLE`` vectors: coarse centroids by k-means on unit vectors, then for each
pair of dimensions a codebook of residuals. From the same sample it measures how many lists a query
must visit for its true neighbours to be in them.

Equal vectors are one entry of the index, with its smallest ids, as many as a result can need. The
index is one row for each entry: list, codes, id. Lists are packed into blocks of about
``BLOCK_ROWS`` entries, and a list that is larger is dealt over several. Queries, one for each
different vector, go to the blocks that hold their lists; where more than ``QUERY_ROWS`` visit a block
they go in chunks, and only that block is read once for each of its chunks. Lists grow in number with
the square root of the table, up to an eighth of the sample, so that blocks stay as they are and the
queries of a block don't grow with the table. A block and a chunk meet in one task: inner products with the codewords make a table for each query, and sums over codes score every
entry. Each entry carries its own quantisation error, the length of what the codes leave of it, which
bounds how far its score can be off. The exact scores of the ``RERANK`` best give a floor; every entry
that the bound doesn't put below it is scored exactly on the original vectors, which stand in the
block, however many there are. So the best of the visited lists are found for certain, in groups of
near copies too, and only they leave the block.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import per_batch, saved, tune

#: Production parameters. SAMPLE bounds the vectors that the driver fits on; RERANK doesn't bound what
#: is scored exactly, only what the floor of a block is taken from.
SAMPLE = 20_000
CODEWORDS = 256
SUB_DIMS = 2
ROUNDS = 8
COVERAGE = 0.98
RERANK = 64
BLOCK_ROWS = 16_384
BLOCK_BYTES = 32 << 20
QUERY_ROWS = 16_384
SEED = 42


class Model(NamedTuple):
    centroids: np.ndarray  # lists x dims, unit vectors
    codebooks: np.ndarray  # parts x codewords x SUB_DIMS
    probes: int
    dims: int

    def lists(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centroids.T, axis=1)

    def codes(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        rest = _parts(x - self.centroids[at])
        return np.stack([_nearest(rest[:, m], book) for m, book in enumerate(self.codebooks)], 1).astype(np.uint8)

    def errors(self, x: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Length of what the codes leave of each row: no unit vector's product is off by more."""
        rest = _parts(x.astype(np.float64) - self.centroids[at])
        left = sum(((rest[:, m] - book[codes[:, m]]) ** 2).sum(1) for m, book in enumerate(self.codebooks))
        return np.sqrt(left)


def _parts(x: np.ndarray) -> np.ndarray:
    """rows x parts x SUB_DIMS; zeros fill the last part."""
    over = -x.shape[1] % SUB_DIMS
    return np.pad(x, ((0, 0), (0, over))).reshape(len(x), -1, SUB_DIMS)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmax(x[i : i + 4096] @ centres.T - half, axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, unit: bool, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        # A centre that nothing is near starts again from a row.
        lost = np.flatnonzero(n == 0)
        sums[lost], n[lost] = x[rng.integers(len(x), size=len(lost))], 1
        centres = sums / n[:, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(sample: np.ndarray, total: int, k: int, seed: int = SEED) -> Model:
    """Model from unit vectors ``sample`` of a table of ``total`` vectors, for ``k`` neighbours."""
    rng = np.random.default_rng(seed)
    sample = sample.astype(np.float32)
    lists = max(1, min(int(total**0.5), len(sample) // 8 or 1))
    centroids = _kmeans(sample, lists, True, rng)
    rest = _parts(sample - centroids[np.argmax(sample @ centroids.T, axis=1)])
    books = np.stack([_kmeans(rest[:, m], min(CODEWORDS, len(sample)), False, rng) for m in range(rest.shape[1])])
    model = Model(centroids, books, lists, sample.shape[1])
    if lists == 1:
        return model
    # Rank, among the lists as a query would visit them, of the list of each of its true neighbours.
    asked = rng.choice(len(sample), min(256, len(sample)), replace=False)
    close = sample[asked] @ sample.T
    close[np.arange(len(asked)), asked] = -2
    true = np.argpartition(-close, min(k, len(sample) - 2), axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(sample[asked] @ centroids.T), axis=1), axis=1)
    need = np.take_along_axis(rank, model.lists(sample)[true], axis=1).ravel()
    return model._replace(probes=int(np.sort(need)[int(COVERAGE * (len(need) - 1))]) + 1)


def _valid(embedding: Column, dims: int | None = None) -> Column:
    """Whether a vector takes part: no nulls, finite, not zero (and of the right length)."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(embedding, lambda x: x != 0)
    ok = embedding.isNotNull() & F.coalesce(finite, F.lit(False))
    return ok if dims is None else ok & (F.size(embedding) == dims)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column that all have one length, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    # Largest component first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes; in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    exact = (small == x).all(axis=1)
    return [(s if e else r).tobytes() for r, s, e in zip(x, small, exact, strict=True)]


def _unpacked(rows: pd.Series, dims: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dims else np.float64) for r in rows]).astype(np.float64)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` with those of ``b``, in double precision."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        dot = np.einsum("ij,ij->i", a, b)
        score = dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
    wrong = ~np.isfinite(score) | (dot == 0)
    if wrong.any():  # components whose squares are out of range
        score[wrong] = np.einsum("ij,ij->i", _unit(a[wrong]), _unit(b[wrong]))
    return score


#: What single precision can add to the error of a score.
_ROUNDING = 1e-4
#: Pairs that are scored at once.
_PAIRS = 16_384


def _search(shared: Broadcast[Model], probes: int, best: int, rerank: int):
    """Cogrouped function of a block's entries and the queries that visit it: the ``best`` entries of each."""

    def run(key: tuple, entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        model = shared.value
        q_out, id_out, s_out = [], [], []
        if len(entries) and len(asked):
            entries = entries.sort_values("entry", kind="stable")  # ties go to the smaller id
            ids, at, error = entries["entry"].to_numpy(), entries["list"].to_numpy(), entries["error"].to_numpy() + _ROUNDING
            codes = np.ascontiguousarray(np.frombuffer(b"".join(entries["codes"]), np.uint8).reshape(len(ids), -1).T)
            vectors = _unpacked(entries["v"], model.dims)
            units = _unit(vectors)
            queries = asked["query"].to_numpy()
            for i in range(0, len(queries), 64):
                qv = _unpacked(asked["v"].iloc[i : i + 64], model.dims)
                unit = _unit(qv)
                q = unit.astype(np.float32)
                coarse = q @ model.centroids.T
                far = np.argsort(np.argsort(-coarse, axis=1, kind="stable"), axis=1) >= probes
                coarse[far] = -np.inf
                score = coarse[:, at]
                parts = _parts(q)
                for m, book in enumerate(model.codebooks):
                    score += (parts[:, m] @ book.T)[:, codes[m]]
                if len(ids) <= best:
                    maybe = np.isfinite(score)
                else:
                    # Floor: the exact score of the last of the best among those that look nearest.
                    n = min(max(rerank, best), len(ids))
                    top = np.argpartition(-score, n - 1, axis=1)[:, :n]
                    close = np.stack([units[t] @ u for t, u in zip(top, unit, strict=True)])
                    close[~np.isfinite(np.take_along_axis(score, top, axis=1))] = -np.inf
                    floor = np.partition(close, n - best, axis=1)[:, n - best]
                    maybe = np.isfinite(score) & (score + error >= floor[:, None])
                    # All of those exactly, with a margin for the order in which products are added.
                    cols = np.flatnonzero(maybe.any(axis=0))
                    sure = np.where(maybe[:, cols], unit @ units[cols].T, -np.inf)
                    if len(cols) > best:
                        floor = np.partition(sure, len(cols) - best, axis=1)[:, len(cols) - best]
                        maybe[:, cols] &= sure >= floor[:, None] - 1e-13 * model.dims
                row, col = np.nonzero(maybe)
                near = [_cosine(qv[row[j : j + _PAIRS]], vectors[col[j : j + _PAIRS]]) for j in range(0, len(row), _PAIRS)]
                near = np.concatenate(near) if near else np.empty(0)
                order = np.lexsort((col, -near, row))
                row, col, near = row[order], col[order], near[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < best
                q_out.append(queries[i : i + 64][row[first]])
                id_out.append(ids[col[first]])
                s_out.append(near[first])
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        return pd.DataFrame({"query": join(q_out, np.int64), "entry": join(id_out, np.int64), "score": join(s_out, np.float64)})

    return run


def _chunked(entries: DataFrame, visits: DataFrame, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both with a ``chunk``: the visits of each ``block`` in chunks of about ``query_rows``, and the
    entries of a block as often as it has chunks. A block that nothing visits is left out."""
    chunks = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("chunks"))
    every = entries.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return every, visits.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int")).drop("chunks")


def nearest(vectors: DataFrame, queries: Column | None = None, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", rerank: int = RERANK, seed: int = SEED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its ``k`` nearest of all other rows.

    ``queries``: a condition on ``vectors``; its rows are asked, and every row but the query's own
    is searched. ``score``: cosine of the original vectors in double precision. Nearest first, ties
    to the smaller id; fewer than ``k`` only if there are no more.

    Vectors that are null or zero or hold null or non-finite components take no part, nor do those
    whose length is not the most common one, or rows without an id. Repeated rows with one id are one
    row: the one whose vector sorts first. An empty table, or one without queries, gives no rows;
    other columns may have any names.
    """
    spark = vectors.sparkSession
    tune(spark)
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    source = vectors.select(F.col(vec_id).cast("long").alias("id"), F.transform(F.col(embedding), lambda x: x.cast("double")).alias("v"), asked.alias("asked")).where(_valid(F.col("v")) & F.col("id").isNotNull())
    common = source.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], out)
    source = source.where(F.size("v") == common["n"]).groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))
    # Equal vectors are one entry, named by the smallest id; k + 1 ids of each are enough.
    key = [F.xxhash64(F.lit(n), "v").alias(f"k{n}") for n in (1, 2)]
    keyed = source.select("id", "v", "asked", *key)
    member = keyed.withColumn("turn", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))).where(F.col("turn") <= k + 1)
    entries = saved(member.groupBy("k1", "k2").agg(F.min("id").alias("entry"), F.sort_array(F.collect_list("id")).alias("members"), F.min_by("v", "id").alias("v")))
    askers = saved(keyed.where("asked").select(F.col("id").alias("query_id"), "k1", "k2").join(entries.select("k1", "k2", "entry"), ["k1", "k2"]).select("query_id", F.col("entry").alias("query")))
    total = entries.count()

    span = (1 << 63) - 1
    share = F.xxhash64(F.lit(seed), "entry").bitwiseAND(F.lit(span)) <= F.lit(span if total <= SAMPLE else int(span * min(1.0, 1.1 * SAMPLE / total)))
    rows = entries.where(share).select("entry", "v").orderBy("entry").limit(SAMPLE).collect()
    sample = _unit(np.array([r.v for r in rows], np.float64))
    model = fit(sample, total, k, seed)
    shared = spark.sparkContext.broadcast(model)

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _unit(_matrix(batch.column("v"))).astype(np.float32)
        at = shared.value.lists(x)
        codes = shared.value.codes(x, at)
        columns = [pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(shared.value.errors(x, at, codes)), pa.array(_packed(_matrix(batch.column("v"))), pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column("entry"), *columns], ["entry", "list", "codes", "error", "v"])

    indexed = saved(entries.select("entry", "v").mapInArrow(per_batch(index), "entry long, list int, codes binary, error double, v binary"))
    # Lists in blocks: one size for each list, of which there are at most an eighth of the sample.
    sizes = {r.list: r["count"] for r in indexed.groupBy("list").count().collect()}
    # Any lists that a query visits hold more than k entries, if there are as many.
    fewest = np.cumsum(sorted(sizes.get(i, 0) for i in range(len(model.centroids))))
    probes = max(model.probes, min(len(fewest), int(np.searchsorted(fewest, k + 1)) + 1))
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * model.dims)))
    blocks: dict[int, tuple[int, int]] = {}
    block, held = 0, 0
    for at in sorted(sizes):
        parts = -(-sizes[at] // block_rows)
        if parts > 1 or held + sizes[at] > block_rows:
            block, held = block + bool(held), 0
        blocks[at] = (block, parts)
        if parts > 1:
            block += parts
        else:
            held += sizes[at]
    where = spark.createDataFrame([(at, *b) for at, b in blocks.items()], "list int, first int, parts int")
    dealt = indexed.join(F.broadcast(where), "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int"))

    distinct = saved(askers.select("query").distinct().join(entries.select(F.col("entry").alias("query"), "v"), "query"))

    def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = _matrix(batch.column("v"))
        probed = np.argsort(-(_unit(vectors).astype(np.float32) @ shared.value.centroids.T), axis=1, kind="stable")[:, :probes]
        # Lists that no entry is in have no block.
        seen = [sorted({b + i for at in row for b, n in [blocks.get(at, (0, 0))] for i in range(n)}) for row in probed.tolist()]
        return pa.RecordBatch.from_arrays([batch.column("query"), pa.array(_packed(vectors), pa.binary()), pa.array(seen, pa.list_(pa.int32()))], ["query", "v", "blocks"])

    visits = saved(distinct.mapInArrow(per_batch(visit), "query long, v binary, blocks array<int>"))
    every, asking = _chunked(dealt, visits.select("query", "v", F.explode("blocks").alias("block")), QUERY_ROWS)
    # Each entry has a member, so k + 1 entries hold a query's own and its k nearest.
    found = every.groupBy("block", "chunk").cogroup(asking.groupBy("block", "chunk")).applyInPandas(_search(shared, probes, k + 1, rerank), "query long, entry long, score double")
    best = found.withColumn("turn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))).where(F.col("turn") <= k + 1)
    scored = best.select("query", "entry", "score").join(entries.select("entry", "members"), "entry")
    ranked = scored.select("query", "score", F.explode("members").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    few = ranked.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("turn", "vec_id", "score"))).alias("near"))
    mine = askers.join(few, "query").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return mine.select("query_id", F.posexplode("near")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))
