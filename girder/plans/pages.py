"""Analysis of pages from boxes and ruled grids (E17): the stages of ``operators.layout`` in their order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_metrics
from ..functions.text import fold_key, has_any
from ..operators import clustering, layout, tables
from ..operators.cleaning import needs_review

# Folded keys of titles and headers that make a grid on a drawing a table.
GRID_TITLES = ["BANG", "THONGKE", "KHOILUONG", "DANHMUC", "TOADO", "BANGKE", "QUYCACH", "CHITIEU"]
GRID_HEADERS = ["STT", "KYHIEU", "TENTHANH", "DUONGKINH", "CHIEUDAI", "SOLUONG", "TRONGLUONG", "KHOILUONG", "DONVI", "DONGIA", "THANHTIEN", "GIAIDOAN", "SOHIEU"]

_PAGE = ["doc_id", "page"]
_ITEM = [*_PAGE, "ord"]


class Analysis(NamedTuple):
    """``pages``: doc_id, page, layout, markdown; ``tables``; ``metadata``; ``low``: texts to review."""

    pages: DataFrame
    tables: DataFrame
    metadata: DataFrame
    low: DataFrame


def measured(boxes: DataFrame) -> DataFrame:
    """Items of ``boxes`` (M1): Chinese characters taken out, blank texts left out, and the page's extent."""
    text = F.trim(F.regexp_replace("text", "[一-鿿]+", ""))
    items = box_metrics(boxes.withColumn("text", text).where("text <> ''").withColumn("score", F.coalesce("score", F.lit(1.0))))
    size = items.groupBy(*_PAGE).agg(F.greatest(F.lit(1.0), F.max("x_max") - F.min("x_min")).alias("page_w"), F.greatest(F.lit(1.0), F.max("y_max") - F.min("y_min")).alias("page_h"))
    return items.join(size, _PAGE)


def analyze(boxes: DataFrame, grids: DataFrame) -> Analysis:
    """Pages, tables, metadata and doubtful readings of ``boxes``.

    ``grids``: doc_id, page, grid_id, x0, y0, x1, y1, row_edges, col_edges, cells. Grids in a title
    block, with fewer than three texts, or with texts in fewer than 15 % of their cells (three at
    least) are no tables; on drawings a table needs a title or a header that says so. Doubtful
    readings have one shape on all pages, covers included.
    """
    items = measured(boxes)
    facts = layout.page_facts(items)
    blocks = layout.title_blocks(items)
    in_block = layout.inside(items, blocks).withColumn("in_title_block", F.lit(True))
    centre = grids.select(*_PAGE, F.col("grid_id").alias("ord"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    covers = facts.where("is_cover").select(*_PAGE)
    open_grids = grids.join(layout.inside(centre, blocks).withColumnRenamed("ord", "grid_id"), [*_PAGE, "grid_id"], "left_anti").join(covers, _PAGE, "left_anti")
    outside = items.join(in_block.select(*_ITEM), _ITEM, "left_anti")
    stamped = layout.with_stamps(outside.join(layout.inside(outside, open_grids), _ITEM, "left_anti")).where("in_stamp").select(*_ITEM, "in_stamp")
    free = outside.join(stamped.select(*_ITEM), _ITEM, "left_anti")

    drawn = facts.join(blocks.select(*_PAGE).distinct().withColumn("block", F.lit(True)), _PAGE, "left").withColumn("cad", F.coalesce("block", "is_cad_sheet"))
    grid_rows = tables.grid_tables(free, open_grids).join(open_grids.select(*_PAGE, "grid_id", "x0", "y0", "x1", "y1", F.size("cells").alias("n_cells")), [*_PAGE, "grid_id"])
    full = F.size(F.filter(F.flatten("grid"), lambda c: c != ""))
    made = grid_rows.where((F.col("n_items") >= 3) & (full >= F.greatest(F.lit(3.0), 0.15 * F.col("n_cells")))).withColumn("t", tables.split_header(F.col("grid"))).where("t is not null")
    titled = made.join(layout.grid_titles(free, open_grids), [*_PAGE, "grid_id"], "left").join(drawn.select(*_PAGE, "cad"), _PAGE, "left")
    title = F.coalesce(F.col("t.title"), F.col("title"), F.lit(""))
    says_so = has_any(fold_key(title), GRID_TITLES) | has_any(fold_key(F.array_join("t.header", " ")), GRID_HEADERS)
    found = tables.with_values(titled.where(~F.col("cad") | says_so).select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page").cast("string"), F.col("grid_id").cast("string")).alias("table_id"), *_PAGE, title.alias("title"), F.lit("grid").alias("source"), F.array("x0", "y0", "x1", "y1").alias("bbox"), F.col("t.header").alias("header"), F.col("t.rows").alias("rows")))

    boxes_of_tables = found.select(*_PAGE, *(F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))
    rest = free.join(layout.inside(free, boxes_of_tables), _ITEM, "left_anti")
    lines = clustering.joined_items(clustering.page_lines(rest), [*_PAGE, "line"])
    text = layout.rendered(layout.paragraphs(lines)).withColumnRenamed("markdown", "body")
    as_text = F.concat(F.when(F.col("title") != "", F.concat(F.lit("### "), F.col("title"), F.lit("\n\n"))).otherwise(""), tables.to_markdown(F.col("header"), F.col("rows")))
    of_tables = found.groupBy(*_PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("bbox")[1].alias("y"), F.col("bbox")[0].alias("x"), as_text.alias("m")))), lambda x: x["m"]), "\n\n").alias("grids"))
    kind = F.when(F.col("is_cover"), "cover_page").when(F.col("cad"), "cad_drawing").otherwise("document")
    pages = drawn.join(text, _PAGE, "left").join(of_tables, _PAGE, "left").select(*_PAGE, kind.alias("layout"), F.concat_ws("\n\n", "body", "grids").alias("markdown"))

    all_lines = clustering.joined_items(clustering.page_lines(items), [*_PAGE, "line"])
    metadata = layout.metadata(all_lines)
    marked = items.join(in_block, _ITEM, "left").join(stamped, _ITEM, "left").na.fill(False, ["in_title_block", "in_stamp"])
    box = F.array(*(F.round(c, 1) for c in ("x_min", "y_min", "x_max", "y_max")))
    low = marked.where(needs_review(F.col("text"), F.col("score"), F.col("in_stamp"), F.col("in_title_block"))).select(*_ITEM, "text", F.round("score", 3).alias("score"), box.alias("bbox"))
    return Analysis(pages, found, metadata, low)
