"""Table reconstruction and classification.

A table is one row: ``table_id``, ``title``, ``header`` (array of strings), ``rows`` (array of
arrays of strings). What concerns one table's own cells is done with array functions in that row;
what needs statistics over cells is exploded and aggregated by table.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import UNITS, is_number_cell, let, number_style, parse_number, style_votes
from ..functions.text import count_hits, fold_key, fold_upper, has_any
from .clustering import lines_of

# Folded words of titles and headers by category of table.
TITLE_WORDS = {
    "rebar_schedule": ["THONG KE COT THEP", "THONG KE THEP", "BANG KE THEP", "COT THEP", "BANG THEP", "REBAR", "STEEL SCHEDULE", "THEP DAM", "THEP COT", "THEP SAN", "THEP MONG", "THEP BE TONG", "THEP GIA CUONG"],
    "boq": ["KHOI LUONG", "TIEN LUONG", "TONG HOP KHOI LUONG", "BANG BOQ", "BILL OF QUANTITIES", "TAKEOFF", "DU TOAN", "GIA DU THAU", "TONG HOP VAT TU", "KHOI LUONG XAY LAP"],
    "sheet_index": ["DANH MUC BAN VE", "DANH SACH BAN VE", "BANG KE BAN VE", "MUC LUC BAN VE", "SHEET INDEX", "DRAWING LIST", "DANH MUC HO SO"],
    "specs": ["TOA DO", "TIM COC", "COC KHOAN NHOI", "CHI TIEU CO LY", "THONG SO KY THUAT", "TAI TRONG", "MAC BE TONG", "CAP DO BEN", "SPECS"],
}
HEADER_WORDS = {
    "rebar_schedule": ["DUONG KINH", "PHI", "FI", "DIA", "D (MM)", "HINH DANG", "HINH DANG THANH", "SO THANH", "SO LUONG", "CHIEU DAI", "TONG CHIEU DAI", "TRONG LUONG", "KHOI LUONG", "KG"],
    "boq": ["HANG MUC", "TEN CONG VIEC", "NOI DUNG CONG VIEC", "DON VI", "DVT", "KHOI LUONG", "DON GIA", "THANH TIEN", "M3", "M2", "TAN"],
    "sheet_index": ["SO HIEU BAN VE", "KY HIEU BAN VE", "TEN BAN VE", "TY LE", "GIAI DOAN", "NGAY"],
    "specs": ["TOA DO X", "TOA DO Y", "CAO DO", "MUC NUOC", "SUC CHIU TAI", "DO SUT"],
}
TITLE_POINTS = {"rebar_schedule": 60, "boq": 55, "sheet_index": 70, "specs": 60}
HEADER_POINTS = {"rebar_schedule": 15, "boq": 14, "sheet_index": 20, "specs": 15}
TITLE_BLOCK = ["CHU DAU TU", "CO QUAN THIET KE", "DON VI THIET KE", "TEN BAN VE", "GIAI DOAN THIET KE", "CHUNHIEM THIET KE", "CHU NHIEM", "THE HIEN", "QUAN LY KY THUAT", "BAN VE SO", "SO HIEU BAN VE", "GIAM DOC", "LAN XUAT BAN", "CAN BO THIET KE", "NGUOI VE"]
LENGTH_WORDS = ["CHIEU DAI", "CHIEU DI", "L (MM)", "L(MM)", "LENGTH"]
SIGNATURE = [LENGTH_WORDS, ["SO LUONG THANH", "SO THANH", "SO LUONG"], ["KG/M", "KG/ M", "TRONG LUONG DON VI"], ["TEN THANH", "KY HIEU", "MARK", "SO HIEU"]]
DIAMETER_WORDS = ["DUONG KINH", "DRONG KINH", "D (MM)", "D(MM)", "PHI", "FI"]
GENUINE = ["STT", "SOHIEU", "DUONGKINH", "CHIEUDAI", "SOLUONG", "TRONGLUONG", "KHOILUONG", "MAHIEU", "DONGIA", "THANHTIEN", "DONVI", "HANGMUC", "LYTRINH", "COC", "FDAO", "FDAP", "XIMANG", "DOSUT", "MAC", "WBS", "COTTHEP", "BETONG", "D10", "D12", "D14", "D16", "D32", "TENTHANH", "TONGCONG", "KYHIEU"]


def folded_header(header: Column) -> Column:
    return F.transform(F.coalesce(header, F.array().cast("array<string>")), lambda h: fold_upper(F.coalesce(h, F.lit(""))))


def any_header(headers: Column, words: list[str]) -> Column:
    return F.exists(headers, lambda h: has_any(h, words))


def first_column(headers: Column, words: list[str]) -> Column:
    """0-based place of the first header that has one of ``words``; null if none has."""
    return F.array_min(F.transform(headers, lambda h, i: F.when(has_any(h, words), i)))


def all_columns(headers: Column, words: list[str]) -> Column:
    return F.filter(F.transform(headers, lambda h, i: F.when(has_any(h, words), i)), lambda i: i.isNotNull())


def has_rebar_signature(headers: Column) -> Column:
    """a column of diameters, one of lengths, and two of four groups that only bar schedules have."""
    groups = sum((any_header(headers, words).cast("int") for words in SIGNATURE), F.lit(0))
    return any_header(headers, DIAMETER_WORDS) & any_header(headers, LENGTH_WORDS) & (groups >= 2)


def classify(title: Column, header: Column, rows: Column) -> Column:
    """F2: struct (category, confidence); of equal scores the first category wins."""
    none = F.array().cast("array<string>")
    sample = F.transform(F.flatten(F.slice(F.coalesce(rows, F.array().cast("array<array<string>>")), 1, 5)), lambda c: F.coalesce(c, F.lit("")))
    named = F.struct(fold_upper(F.coalesce(title, F.lit(""))).alias("title"), folded_header(header).alias("headers"), F.array_join(F.coalesce(header, none), " ").alias("raw"), fold_upper(F.array_join(sample, " ")).alias("sample"))

    def scored(x: Column) -> Column:
        """What each category scores, in the order of the categories, and hits of title blocks."""
        joined, signature = F.array_join(x["headers"], " "), has_rebar_signature(x["headers"])
        extra = {"rebar_schedule": F.when(x["raw"].rlike("[ΦφØø]|Fi|fi"), 40).otherwise(0) + F.when(signature, 70).otherwise(0), "boq": F.when(signature, -60).otherwise(0)}
        of = lambda j: F.array(*(F.when(has_any(x["title"], TITLE_WORDS[c]), TITLE_POINTS[c]).otherwise(0) + count_hits(j, HEADER_WORDS[c]) * HEADER_POINTS[c] + extra.get(c, F.lit(0)) for c in TITLE_WORDS))
        return let(joined, lambda j: F.struct(of(j).alias("scores"), let(F.concat_ws(" ", x["title"], j, x["sample"]), lambda t: count_hits(t, TITLE_BLOCK)).alias("blocks")))

    def decided(x: Column) -> Column:
        best = lambda b: F.struct(F.when(b < 40, "general").otherwise(F.element_at(F.array(*map(F.lit, TITLE_WORDS)), F.array_position(x["scores"], b).cast("int"))).alias("category"), F.when(b < 40, 0.3).otherwise(F.least(F.lit(1.0), b / 100.0)).alias("confidence"))
        veto = F.struct(F.lit("title_block").alias("category"), F.lit(0.99).alias("confidence"))
        return F.when(x["blocks"] >= 2, veto).otherwise(let(F.array_max(x["scores"]), best))

    return let(let(named, scored), decided)


def classified(tables: DataFrame) -> DataFrame:
    """``tables`` with ``category`` and ``confidence`` where they have no category yet."""
    made = classify(F.col("title"), F.col("header"), F.col("rows"))
    if "category" not in tables.columns:
        return tables.withColumn("__c", made).withColumns({"category": F.col("__c.category"), "confidence": F.col("__c.confidence")}).drop("__c")
    return tables.withColumn("__c", made).withColumn("category", F.coalesce("category", "__c.category")).drop("__c")


def category_counts(tables: DataFrame) -> DataFrame:
    """tables by category (missing: general) and in all, from one aggregation."""
    named = tables.select(F.coalesce("category", F.lit("general")).alias("category"))
    return named.rollup("category").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("category", F.lit("all")).alias("category"), "n")


def cells(tables: DataFrame) -> DataFrame:
    """One row for each cell: ``table_id``, ``row`` from 1, ``col`` from 0, ``text``."""
    rows = tables.select("table_id", F.posexplode("rows").alias("row", "cells"))
    return rows.select("table_id", (F.col("row") + 1).alias("row"), F.posexplode("cells").alias("col", "text"))


def number_styles(tables: DataFrame) -> DataFrame:
    """C3 by table: (table_id, number_style)."""
    return cells(tables).groupBy("table_id").agg(number_style(F.col("text")).alias("number_style"))


def with_values(tables: DataFrame) -> DataFrame:
    """``tables`` with ``number_style`` and ``values``, the numbers of cells in that style.

    A table's cells are in its row, so its style is found there, without a join.
    """
    votes = lambda rows: F.transform(F.flatten(F.filter(rows, lambda r: r.isNotNull())), lambda c: F.struct(*(v.alias(n) for v, n in zip(style_votes(c), ("vn", "us"), strict=True))))
    style = let(votes(F.col("rows")), lambda x: F.when(F.size(F.filter(x, lambda v: v["us"])) > F.size(F.filter(x, lambda v: v["vn"])), "us").otherwise("vn"))
    styled = tables.withColumn("number_style", style)
    return styled.withColumn("values", F.transform("rows", lambda r: F.transform(r, lambda c: parse_number(c, F.col("number_style")))))


def split_header(grid: Column) -> Column:
    """Struct (title, header, rows) of a grid of cells, null with fewer than two rows or columns.

    Empty rows and columns go and short rows are filled. Up to five rows with a header word, or with
    few numbers, at the top become the header, joined by column; a row of one text above is a title.
    Each step is computed once and named; written out in the next ones, their cost multiplies.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    filled = lambda r: F.filter(r, lambda c: c != "")
    data = lambda r: F.size(F.filter(r, is_number_cell)) * 2 >= F.size(filled(r))
    named = lambda r: let(fold_key(F.array_join(r, " ")), lambda k: has_any(k, GENUINE))

    def squared(g: Column) -> Column:
        """Rows with a text, trimmed and filled up to the widest."""
        some = F.filter(g, lambda r: F.exists(r, lambda c: ~blank(c)))
        return let(F.sequence(F.lit(0), F.array_max(F.transform(g, F.size)) - 1), lambda at: F.transform(some, lambda r: F.transform(at, lambda i: F.coalesce(F.trim(F.get(r, i)), F.lit("")))))

    def without_empty(full: Column) -> Column:
        """Columns with a text."""
        used = F.filter(F.sequence(F.lit(0), F.size(F.get(full, F.lit(0))) - 1), lambda i: F.exists(full, lambda r: F.get(r, i) != ""))
        return let(used, lambda at: F.transform(full, lambda r: F.transform(at, lambda i: F.get(r, i))))

    def titled(rows: Column) -> Column:
        top = F.array_distinct(filled(F.get(rows, F.lit(0))))
        title = let(top, lambda t: F.when((F.size(t) == 1) & (F.size(rows) > 2), F.get(t, F.lit(0))))
        return let(title, lambda t: let(F.when(t.isNotNull(), F.slice(rows, F.lit(2), F.size(rows) - 1)).otherwise(rows), lambda body: let(head(body), lambda n: parts(t, body, n))))

    def head(body: Column) -> Column:
        """How many rows of the body are its header."""
        last = F.coalesce(F.array_min(F.transform(F.slice(body, 1, 6), lambda r, i: F.when((data(r) & ~((i == 0) & named(r))) | (i == 5), i))), F.lit(1))
        return F.greatest(F.lit(1), F.least(last, F.size(body) - 1))

    def parts(title: Column, body: Column, n: Column) -> Column:
        top = lambda rows: F.transform(F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1), lambda i: F.array_join(F.array_distinct(F.filter(F.transform(rows, lambda r: F.get(r, i)), lambda c: c != "")), " "))
        return F.struct(title.alias("title"), let(F.slice(body, F.lit(1), n), top).alias("header"), F.slice(body, n + 1, F.greatest(F.size(body) - n, F.lit(0))).alias("rows"))

    return let(let(let(grid, squared), without_empty), lambda rows: F.when((F.size(rows) >= 2) & (F.size(F.get(rows, F.lit(0))) >= 2), titled(rows)))


def is_genuine_table(lines: Column) -> Column:
    """Whether lines (arrays of cell texts) are a table and not prose in columns."""

    def told(x: Column) -> Column:
        flat, average = x["flat"], x["average"]
        n = F.size(flat)
        short = F.size(F.filter(flat, lambda t: is_number_cell(t) | (F.length(t) <= 15)))
        long = F.size(F.filter(flat, lambda t: F.length(t) > 35))
        named = let(fold_key(F.array_join(flat, " ")), lambda k: has_any(k, GENUINE))
        return F.coalesce((x["lines"] >= 2) & (average >= 2) & (long <= n * 0.15) & (((average >= 3) & (short >= n * 0.4)) | (named & (average >= 2.5))), F.lit(False))

    cut = lambda x: F.struct(F.size(x).alias("lines"), F.transform(F.flatten(x), F.trim).alias("flat"), (F.size(F.flatten(x)) / F.nullif(F.size(x), F.lit(0))).alias("average"))
    return let(let(lines, cut), told)


def bisect(edges: Column, at: Column) -> Column:
    """E5: 0-based band of ``at`` between rising ``edges``, kept inside the grid."""
    return F.least(F.greatest(F.size(F.filter(edges, lambda e: e <= at)) - 1, F.lit(0)), F.size(edges) - 2)


def grid_rows(items: DataFrame, grids: DataFrame) -> DataFrame:
    """(doc_id, page, grid_id, grid): texts of items in the cells of ruled grids, row by row.

    Items and grids meet on their page; an item goes to the band of its centre in either direction.
    """
    inside = (F.col("cx") >= F.get("col_edges", F.lit(0))) & (F.col("cx") <= F.element_at("col_edges", -1)) & (F.col("cy") >= F.get("row_edges", F.lit(0))) & (F.col("cy") <= F.element_at("row_edges", -1))
    placed = items.join(grids, ["doc_id", "page"]).where(inside).select("doc_id", "page", "grid_id", "row_edges", "col_edges", bisect(F.col("row_edges"), F.col("cy")).alias("r"), bisect(F.col("col_edges"), F.col("cx")).alias("c"), "cy", "x_min", "text")
    order = F.sort_array(F.collect_list(F.struct("cy", "x_min", "text")))
    texts = placed.groupBy("doc_id", "page", "grid_id", "row_edges", "col_edges", "r", "c").agg(F.array_join(F.transform(order, lambda x: x["text"]), " ").alias("text"))
    by_cell = texts.groupBy("doc_id", "page", "grid_id", "row_edges", "col_edges").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(",", "r", "c"), "text"))).alias("m"))
    n, k = F.size("row_edges") - 2, F.size("col_edges") - 2
    grid = F.transform(F.sequence(F.lit(0), n), lambda r: F.transform(F.sequence(F.lit(0), k), lambda c: F.coalesce(F.try_element_at(F.col("m"), F.concat_ws(",", r, c)), F.lit(""))))
    return by_cell.select("doc_id", "page", "grid_id", grid.alias("grid"))


_NUMBER = re.compile(rf"\s*[-+]?\s*\d[\d.,\s]*\s*(?:{UNITS})?\s*", re.I)


def _is_number(text: str) -> bool:
    return bool(_NUMBER.fullmatch(text)) and not re.search(r"\d\s+\d", text.strip())


def banded_rows(items: pd.DataFrame, row_edges: list[float], col_edges: list[float], cells: list[tuple[float, float, float, float]]) -> list[list[str]]:
    """E5 for one grid, with what plain bisecting leaves out.

    Bands without numbers above the first one with numbers are the header: a text in a merged cell
    stands in every column that the cell covers. A band over 3.5 heights is cut into rows at lines
    with texts in two or more columns; other lines go to the nearest of those within 3 heights.
    """
    rows_n, cols_n = len(row_edges) - 1, len(col_edges) - 1
    place = lambda edges, v, n: int(min(max(np.searchsorted(edges, v, "right") - 1, 0), n - 1))
    centres = [(a + b) / 2 for a, b in zip(col_edges, col_edges[1:], strict=False)]
    height = float(items["h"].median()) if len(items) else 12.0
    items = items.assign(r=[place(row_edges, v, rows_n) for v in items["cy"]], c=[place(col_edges, v, cols_n) for v in items["cx"]]).sort_values(["cy", "x_min"])

    def covered(item) -> list[int]:
        cell = next((b for b in cells if b[0] <= item.cx <= b[2] and b[1] <= item.cy <= b[3]), None)
        return [j for j, x in enumerate(centres) if cell and cell[0] - 2 <= x <= cell[2] + 2] or [item.c]

    def row(part: pd.DataFrame, header: bool = False) -> list[str]:
        texts: list[list[str]] = [[] for _ in range(cols_n)]
        for item in part.itertuples():
            for c in covered(item) if header else [item.c]:
                texts[c].append(item.text)
        return [" ".join(t) for t in texts]

    out: list[list[str]] = []
    data = False
    for r, band in items.groupby("r", sort=True):
        if not any(_is_number(t) for t in band["text"]):
            out.append(row(band, header=not data))
            continue
        data = True
        lines = [band[np.array(at) == k] for at in [lines_of(band["cy"].to_numpy(float), band["h"].to_numpy(float))] for k in range(int(max(at)) + 1)]
        keys = [line for line in lines if line["c"].nunique() >= 2]
        if row_edges[r + 1] - row_edges[r] <= 3.5 * height or not keys:
            out.append(row(band))
            continue
        groups = [[key] for key in keys]
        for line in lines:
            if line["c"].nunique() < 2:
                gaps = [abs(key["cy"].mean() - line["cy"].mean()) for key in keys]
                k = int(np.argmin(gaps))
                groups[k].append(line) if gaps[k] <= 3 * height else groups.append([line])
        parts = [pd.concat(g).sort_values(["cy", "x_min"]) for g in groups]
        out += [row(part) for part in sorted(parts, key=lambda part: part["y_min"].min())]
    return out


def grid_tables(items: DataFrame, grids: DataFrame) -> DataFrame:
    """E5: (doc_id, page, grid_id, n_items, grid): rows of texts of ruled grids, one grid at a time.

    ``grids``: doc_id, page, grid_id, row_edges, col_edges, cells (array of x0, y0, x1, y1).
    """
    inside = (F.col("cx") >= F.get("col_edges", F.lit(0))) & (F.col("cx") <= F.element_at("col_edges", -1)) & (F.col("cy") >= F.get("row_edges", F.lit(0))) & (F.col("cy") <= F.element_at("row_edges", -1))
    both = items.select("doc_id", "page", "text", "cx", "cy", "x_min", "y_min", "h").join(grids.select("doc_id", "page", "grid_id", "row_edges", "col_edges", "cells"), ["doc_id", "page"]).where(inside)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        first = f.iloc[0]
        grid = banded_rows(f, list(first["row_edges"]), list(first["col_edges"]), [tuple(c.values() if isinstance(c, dict) else c) for c in first["cells"]])
        return pd.DataFrame([(first["doc_id"], first["page"], first["grid_id"], len(f), grid)], columns=["doc_id", "page", "grid_id", "n_items", "grid"])

    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    return both.groupBy("doc_id", "page", "grid_id").applyInPandas(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, grid_id {kinds['grid_id']}, n_items int, grid array<array<string>>")


def to_markdown(header: Column, rows: Column) -> Column:
    """A table in Markdown; headers without a name are numbered."""
    safe = lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    names = F.transform(header, lambda h, i: F.when(F.trim(safe(h)) == "", F.concat(F.lit("Cột "), (i + 1).cast("string"))).otherwise(safe(h)))
    rule = F.transform(header, lambda _: F.lit("---"))
    return F.array_join(F.concat(F.array(line(names), line(rule)), F.transform(rows, lambda r: line(F.transform(r, safe)))), "\n")
