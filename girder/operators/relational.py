"""Small relational operators."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def page_range(value: Column, total: Column) -> Column:
    """A1, V4: sorted distinct 1-based pages of ``1-3,5``; blank means all.

    Bad syntax, a page below 1 or above ``total``, or a range that runs backwards raises an error.
    """
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", "")
    parts = F.transform(F.split(text, ","), lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int").alias("low"), F.coalesce(F.regexp_extract(p, r"-(\d+)$", 1).try_cast("int"), F.regexp_extract(p, r"^(\d+)$", 1).try_cast("int")).alias("high"), p.rlike(r"^\d+(-\d+)?$").alias("ok")))
    bad = F.exists(parts, lambda p: ~p["ok"] | (p["low"] < 1) | (p["high"] > total) | (p["low"] > p["high"]))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(p["low"], p["high"])))))
    return F.when(text == "", F.sequence(F.lit(1), total)).when(bad, F.raise_error(F.concat(F.lit("not a range of pages: "), text)).cast("array<int>")).otherwise(pages)


def select_pages(pages: DataFrame, value: str, page: str = "page") -> DataFrame:
    """A1: the pages of a range; the range is checked against the largest page. A blank one means all.

    Only the parts of the range go to the executors, as a filter that the source can apply.
    """
    top = pages.agg(F.max(page).cast("int").alias("top"))
    checked = top.select(F.size(page_range(F.lit(value), F.col("top"))).alias("n")).first()
    parts = [part.split("-") for part in re.sub(r"\s+", "", value or "").split(",") if part]
    if not parts or checked is None:
        return pages.where(F.col(page).isNotNull())
    return pages.where(reduce(or_, (F.col(page).between(int(p[0]), int(p[-1])) for p in parts)))


def object_stats(objects: DataFrame, kinds: list[str]) -> DataFrame:
    """A5: by page, of each document if ``objects`` name it, the number of objects of each kind, and the
    share of its area that images cover."""
    by = [c for c in ("doc_id", "page") if c in objects.columns]
    return objects.groupBy(*by).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.round(F.coalesce(F.sum(F.when(F.col("kind") == "image", F.col("area"))), F.lit(0.0)) / F.first("page_area"), 6).alias("image_share"))


def ocr_route(chars: Column, image_share: Column, vectors: Column, longest_side: Column) -> Column:
    """Why a page needs reading by OCR; empty if it doesn't. The first rule that applies decides."""
    return F.when((chars < 30) & (image_share > 0.5), "scan").when((chars < 200) & (vectors >= 20), "vector_text").when((longest_side >= 1100) & (vectors >= 3000), "mixed_shx").otherwise("")


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """K1: the first ``k`` rows of each group; Spark keeps ``k`` of a group in each task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def exploded_tables(pages: DataFrame) -> DataFrame:
    """One row for each table of each page; keys of the table come before those of the page."""
    rows = pages.select("*", F.explode("tables").alias("t"))
    inner = pages.schema["tables"].dataType.elementType.fieldNames()
    return rows.select(*(F.col(c) for c in pages.columns if c != "tables" and c not in inner), "t.*")


def merged_maps(left: Column, right: Column) -> Column:
    """Entries of both, those of ``right`` where both have a key."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def distinct_matches(text: Column, pattern: str) -> Column:
    """V1: distinct matches in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))


def value_after_label(lines: DataFrame, inline: Column, is_label: Column, most: int = 3) -> DataFrame:
    """The value beside a label, or else up to ``most`` lines below it, up to the next label.

    ``lines``: doc_id, page, line, text; rows of labels come back with ``value``.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    marked = lines.withColumns({"__inline": inline, "__label": is_label})
    below = F.collect_list(F.struct("__label", "text")).over(w.rowsBetween(1, most))
    end = F.array_min(F.transform(below, lambda x, i: F.when(x["__label"], i)))
    kept = F.transform(F.slice(below, F.lit(1), F.coalesce(end, F.size(below))), lambda x: x["text"])
    out = marked.withColumn("value", F.when(F.trim(F.coalesce("__inline", F.lit(""))) != "", F.trim("__inline")).otherwise(F.nullif(F.array_join(kept, " "), F.lit(""))))
    return out.where("__label").drop("__inline", "__label")


def throttled(events: DataFrame, message: str, ts: str = "ts", tie: str = "event_id", order: Column | None = None) -> DataFrame:
    """The last message of each second, and how many there were.

    The last one is that of the largest ``ts`` and ``tie``, or of the largest ``order`` that isn't null.
    Times without a zone are cut without one; by that of the session, an hour that it skips would fall on the next.
    """
    fraction = F.make_dt_interval(secs=F.extract(F.lit("SECOND"), ts) % 1)
    second = F.col(ts) - fraction if isinstance(events.schema[ts].dataType, TimestampNTZType) else F.date_trunc("second", ts)
    return events.groupBy(second.alias("second")).agg(F.max_by(message, F.struct(ts, tie) if order is None else order).alias("message"), F.count(F.lit(1)).alias("n"))
