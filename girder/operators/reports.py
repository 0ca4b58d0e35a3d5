"""Reports, comparisons and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import LABELS


def review_markdown(low: DataFrame) -> DataFrame:
    """(doc_id, page, text): doubtful readings of each page as a list."""
    line = F.concat(F.lit("- `"), F.col("text"), F.lit("` ("), F.format_string("%.2f", F.col("score")), F.lit(")"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    return low.groupBy("doc_id", "page").agg(F.concat(F.lit("## Trang "), F.first(F.col("page").cast("string")), F.lit("\n"), F.array_join(lines, "\n")).alias("text"))


def warning_labels(warnings: DataFrame) -> DataFrame:
    """``warnings`` with the label of their kind, or the kind itself."""
    table = warnings.sparkSession.createDataFrame(list(LABELS.items()), "kind string, label string")
    return warnings.join(F.broadcast(table), "kind", "left").withColumn("label", F.coalesce("label", "kind"))


def audit_report(warnings: DataFrame) -> DataFrame:
    """([doc_id,] page, n, text) by page, of each document if ``warnings`` name it: each warning with
    its label, in order of rows."""
    by = [c for c in ("doc_id", "page") if c in warnings.columns]
    line = F.concat(F.lit("- `"), F.col("label"), F.lit("` "), F.col("mark"), F.lit(": "), F.col("message"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("table_id", "row", "kind", line.alias("line")))), lambda x: x["line"])
    return warning_labels(warnings).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array_join(lines, "\n").alias("text")).orderBy(*by)


def sheet_index(pages: DataFrame) -> DataFrame:
    """Pages with a drawing number or a title, and how many tables they have."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return pages.where(has("so_hieu_ban_ve") | has("ten_ban_ve")).select("doc_id", "page", "so_hieu_ban_ve", "ten_ban_ve", F.size(F.coalesce("tables", F.array())).alias("n_tables"))


def full_markdown(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown): pages in order under a heading each."""
    part = F.concat(F.lit("## [Trang "), F.col("page").cast("string"), F.lit("]\n\n"), F.coalesce("markdown", F.lit("")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("markdown"))


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript): turns in order, each under its role."""
    line = F.concat(F.lit("["), F.col("role"), F.lit("]\n"), F.col("text"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("transcript"))


def doc_metrics(files: DataFrame) -> DataFrame:
    """F8: by document: warnings (lines that begin with ``- ```), bars, tables and Markdown characters.

    ``files``: (doc, kind, text) with kind audit, markdown, rebar or tables; the last two are JSON arrays.
    """
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).cast("long")
    entries = F.coalesce(F.json_array_length("text"), F.json_array_length(F.get_json_object("text", "$.tables")), F.lit(0))
    return files.groupBy("doc").agg(of("audit", F.regexp_count("text", F.lit(r"(?m)^- `"))).alias("warnings"), of("rebar", entries).alias("rebar"), of("tables", entries).alias("tables"), of("markdown", F.length("text")).alias("md_chars"))


def with_total(metrics: DataFrame, key: str = "doc") -> DataFrame:
    """F8: metrics by document and in all."""
    names = [c for c in metrics.columns if c != key]
    return metrics.rollup(key).agg(*(F.sum(c).alias(c) for c in names)).withColumn(key, F.coalesce(key, F.lit("ALL")))


def is_done(md_chars: Column, xlsx_size: Column) -> Column:
    """F10."""
    return F.coalesce((md_chars > 500) & (xlsx_size > 1000), F.lit(False))


def compare(base: DataFrame, other: DataFrame, key: str = "doc", names: tuple[str, ...] = ("warnings", "rebar", "tables", "md_chars")) -> DataFrame:
    """By document both runs' metrics and their difference; a document that one run lacks counts 0 there."""
    left, right = base.select(key, *(F.col(n).alias(f"{n}_base") for n in names)), other.select(key, *(F.col(n).alias(f"{n}_other") for n in names))
    both = left.join(right, key, "left").na.fill(0)
    return both.withColumns({f"{n}_delta": F.col(f"{n}_other") - F.col(f"{n}_base") for n in names})


def compare_totals(both: DataFrame, names: tuple[str, ...] = ("warnings", "rebar", "tables", "md_chars")) -> DataFrame:
    """(metric, base, other, delta, change_percent); no change is given where the base is 0."""
    sums = both.agg(*(F.sum(f"{n}_{s}").alias(f"{n}_{s}") for n in names for s in ("base", "other")))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"{n}_base").alias("base"), F.col(f"{n}_other").alias("other")) for n in names))).alias("x")).select("x.*")
    return rows.withColumns({"delta": F.col("other") - F.col("base"), "change_percent": F.round(100 * (F.col("other") - F.col("base")) / F.nullif("base", F.lit(0)), 2)})


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """For each key the last row by ``order``; with few keys a bounded state by partition."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Q7: ``new`` rows in place of those with the same key."""
    return table.join(new.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def by_pages(docs: DataFrame) -> DataFrame:
    """Documents by number of pages, those that can't be counted last."""
    return docs.orderBy(F.coalesce("pages", F.lit(9999)), "name")


def missing_pages(selected: DataFrame, produced: DataFrame) -> DataFrame:
    """Pages that were asked for and not made."""
    return selected.select("doc_id", "page").distinct().join(produced.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def reason_histogram(pages: DataFrame) -> DataFrame:
    """Q6: pages by reason for reading them by OCR, and blank ones among them."""
    return pages.groupBy(F.coalesce("ocr_reason", F.lit("")).alias("ocr_reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))


def batch_status(files: DataFrame) -> DataFrame:
    """files done, failed, and pages with warnings, from (file, error, warnings)."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum(F.size("warnings").cast("long")), F.lit(0)).alias("warnings"))
