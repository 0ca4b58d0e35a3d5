"""Sources (A2, A7-A16, A18, A19): result files, rules, office documents, folders.

JSON sources have fixed schemas with all known keys nullable, so a missing key is a null and no
file is scanned to infer one. Office files are read in executors from ``binaryFile`` rows, one file
at a time, by the standard library; pages and boxes of scans come in through ``boxes``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold_upper

METADATA = "so_hieu_ban_ve STRING, ten_ban_ve STRING, ty_le STRING, ngay STRING, nam STRING, giai_doan STRING, cong_trinh STRING, hang_muc STRING, chu_dau_tu STRING, don_vi_thiet_ke STRING, dia_chi STRING, dia_diem STRING, chu_nhiem STRING, quan_ly_ky_thuat STRING, the_hien STRING, lan_xuat_ban STRING, ly_trinh ARRAY<STRING>"
TABLE = "title STRING, source STRING, bbox ARRAY<DOUBLE>, header ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>, values ARRAY<ARRAY<DOUBLE>>, number_style STRING, cell_boxes ARRAY<ARRAY<ARRAY<DOUBLE>>>, category STRING, confidence DOUBLE"
LOW = "text STRING, score DOUBLE, bbox ARRAY<DOUBLE>"
PAGE = f"page INT, method STRING, layout STRING, metadata STRUCT<{METADATA.replace(' STRING', ':STRING').replace(' ARRAY', ':ARRAY')}>, text STRING, markdown STRING, tables ARRAY<STRUCT<{re.sub(r'(^|, )(\w+) ', r'\1\2:', TABLE)}>>, low_confidence ARRAY<STRUCT<{re.sub(r'(^|, )(\w+) ', r'\1\2:', LOW)}>>, warnings ARRAY<STRING>, geom STRUCT<pw:DOUBLE, ph:DOUBLE, scale:DOUBLE, rot:INT>"
CHUNK = "id STRING, source STRING, page INT, sheet STRING, section STRING, block_type STRING, text STRING, oversized BOOLEAN"
PAYLOAD = f"source STRING, source_path STRING, version STRING, engine STRING, mode STRING, page_count INT, source_page_count INT, seconds DOUBLE, pages ARRAY<STRUCT<{re.sub(r'(^|, )(\w+) (?=[A-Z])', r'\1\2:', PAGE)}>>, note STRING"
BOXES = "doc_id STRING, page INT, ord INT, source STRING, quad ARRAY<STRUCT<x:DOUBLE,y:DOUBLE>>, text STRING, score DOUBLE, chars ARRAY<STRUCT<s:STRING,x0:DOUBLE,x1:DOUBLE>>"
RULES = "pattern STRING, replacement STRING, replace STRING"


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Document payloads, with the folder they came from; a broken file is a row with its text in ``_corrupt_record``."""
    rows = spark.read.schema(f"{PAYLOAD}, _corrupt_record STRING").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows.withColumn("folder", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1))


def pages(documents: DataFrame) -> DataFrame:
    """Pages that have a number, with counts of tables and doubtful readings."""
    rows = documents.select(F.col("folder").alias("doc_id"), "source", F.explode("pages").alias("p")).select("doc_id", "source", "p.*").where("page is not null")
    n = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array())), F.lit(0))
    return rows.withColumns({"n_tables": n("tables"), "n_low": n("low_confidence")})


def page_tables(of_pages: DataFrame) -> DataFrame:
    """Tables with their page's context and a ``table_id``."""
    rows = of_pages.select("doc_id", "page", F.coalesce("metadata.so_hieu_ban_ve", F.lit("")).alias("sheet"), F.coalesce("metadata.ten_ban_ve", F.lit("")).alias("sheet_title"), F.posexplode("tables").alias("i", "t"))
    return rows.select(F.concat_ws("/", "doc_id", F.col("page").cast("string"), F.col("i").cast("string")).alias("table_id"), "doc_id", "page", "sheet", "sheet_title", "t.*")


def low_confidence(of_pages: DataFrame) -> DataFrame:
    return of_pages.select("doc_id", "page", F.posexplode("low_confidence").alias("ord", "x")).select("doc_id", "page", "ord", "x.*")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks as JSON Lines."""
    return spark.read.schema(CHUNK).json(path)


def chunks_or_tables(stored: DataFrame, tables: DataFrame) -> DataFrame:
    """Stored chunks, and a chunk for each table of sources that have none."""
    text = F.concat_ws("\n", F.col("title"), F.array_join("header", " | "), F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n"))
    made = tables.join(stored.select(F.col("source").alias("doc_id")).distinct(), "doc_id", "left_anti").select(F.concat(F.lit("table/"), "table_id").alias("id"), F.col("doc_id").alias("source"), "page", "sheet", F.col("title").alias("section"), F.lit("table").alias("block_type"), text.alias("text"), F.lit(False).alias("oversized"))
    return stored.unionByName(made)


def rules(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """(stage, ord, pattern, replacement) from a JSON array of pairs or of objects, in order."""
    text = spark.read.text(path, wholetext=True).select("value")
    pairs = F.from_json("value", "array<array<string>>")
    objects = F.from_json("value", f"array<struct<{RULES.replace(' STRING', ':string')}>>")
    rows = F.when(F.col("value").rlike(r"^\s*\[\s*\["), F.transform(pairs, lambda p: F.struct(p[0].alias("pattern"), p[1].alias("replacement")))).otherwise(F.transform(objects, lambda o: F.struct(o["pattern"].alias("pattern"), F.coalesce(o["replacement"], o["replace"]).alias("replacement"))))
    return text.select(F.posexplode(rows).alias("ord", "r")).select(F.lit(stage).alias("stage"), "ord", "r.*").where("pattern is not null")


def documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("pdf", "xlsx", "docx", "json")) -> DataFrame:
    """Files below a folder, each once, as a listing has them: path, name, suffix, size, content (read only if asked for)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return rows.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.(\w+)$", 1)).alias("suffix"), F.col("length").alias("size"), "content")


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc, kind, text) of result folders, for metrics."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.when(name.contains("tham_tra"), "audit").when(name.contains("cot_thep"), "rebar").when(name.contains("bang_so_lieu"), "tables").when(name.endswith(".md"), "markdown")
    return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("doc"), kind.alias("kind"), "text").where("kind is not null")


# --- Office documents

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_W = "{" + _NS["w"] + "}"


def _at(ref: str) -> tuple[int, int]:
    """Row and column, from 1, of a reference such as B12."""
    letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


def sheet_cells(content: bytes) -> list[tuple[str, int, int, str, bool, int]]:
    """(sheet, row, col, text, has_formula, merge) of a workbook; a merged range repeats its value down
    its rows, and across for its first row."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        read = lambda n: ElementTree.fromstring(z.read(n))
        strings = ["".join(t.text or "" for t in si.iter("{%s}t" % _NS["m"])) for si in read("xl/sharedStrings.xml").findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        for sheet in read("xl/workbook.xml").find("m:sheets", _NS):
            target = targets[sheet.get("{%s}id" % _NS["r"])]
            root = read(target.lstrip("/") if target.startswith("/") else "xl/" + target)
            cells: dict[tuple[int, int], tuple[str, bool]] = {}
            for c in root.iter("{%s}c" % _NS["m"]):
                v, kind = c.find("m:v", _NS), c.get("t")
                if kind == "s" and v is not None:
                    text = strings[int(v.text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter("{%s}t" % _NS["m"]))
                elif kind == "b" and v is not None:
                    text = "TRUE" if v.text == "1" else "FALSE"
                else:
                    text = canonical(v.text) if v is not None else ""
                cells[_at(c.get("r"))] = (" ".join(text.replace("\xa0", " ").split()), c.find("m:f", _NS) is not None)
            merged = {}
            for i, m in enumerate(root.iter("{%s}mergeCell" % _NS["m"]), 1):
                (r0, c0), (r1, c1) = (_at(x) for x in (m.get("ref").split(":") * 2)[:2])
                for r in range(r0, r1 + 1):
                    for c in range(c0, c1 + 1):
                        merged[r, c] = i
                        if c == c0 or r == r0:
                            cells[r, c] = cells.get((r0, c0), ("", False))
            out += [(sheet.get("name"), r, c, t, f, merged.get((r, c), 0)) for (r, c), (t, f) in sorted(cells.items())]
    return out


def canonical(text: str | None) -> str:
    """Whole numbers without a point, others with ten significant digits."""
    try:
        value = float(text or "")
    except ValueError:
        return text or ""
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else f"{value:.10g}"


def word_blocks(content: bytes) -> list[tuple[int, str, int, str, list[list[str]]]]:
    """A10: (ord, kind, level, text, rows) of a document's body: headings, items, paragraphs and tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find("w:body", _NS)
    text = lambda e: "".join(t.text or "" for t in e.iter(_W + "t"))
    out = []
    for e in body:
        if e.tag == _W + "p":
            style = e.find("w:pPr/w:pStyle", _NS)
            level = re.search(r"heading\s*(\d)", style.get(_W + "val"), re.I) if style is not None else None
            item = e.find("w:pPr/w:numPr/w:ilvl", _NS)
            kind = "heading" if level else "item" if item is not None else "paragraph"
            if t := " ".join(text(e).split()):
                out.append((len(out), kind, int(level[1]) if level else int(item.get(_W + "val")) if item is not None else 0, t, []))
        elif e.tag == _W + "tbl":
            rows = [[" ".join(text(c).split()) for c in r.findall("w:tc", _NS)] for r in e.findall("w:tr", _NS)]
            out.append((len(out), "table", 0, "", rows))
    return out


def _read_office(files: DataFrame, parse: Callable[[bytes], list[tuple]], names: list[str], schema: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(path, *row) for row in parse(content)], columns=["path", *names])

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def excel_cells(files: DataFrame) -> DataFrame:
    """Cells of workbooks."""
    return _read_office(files.where("suffix = 'xlsx'"), sheet_cells, ["sheet", "row", "col", "text", "has_formula", "merge"], "sheet string, row int, col int, text string, has_formula boolean, merge int")


def excel_tables(cells: DataFrame) -> DataFrame:
    """Blocks of rows without a gap; the rows from the first to the last with two or more
    filled cells are a table, the text above it (to 160 characters) its title, which a block without
    a table passes on to the next."""
    rows = cells.where("text <> ''").groupBy("path", "sheet", "row").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda x: x["text"])), " ").alias("line"), F.sort_array(F.collect_list(F.struct("col", "text"))).alias("cells"))
    order = Window.partitionBy("path", "sheet").orderBy("row")
    blocks = rows.withColumn("block", F.col("row") - F.row_number().over(order))
    span = Window.partitionBy("path", "sheet", "block")
    marked = blocks.withColumns({"low": F.min(F.when(F.col("n") >= 2, F.col("row"))).over(span), "high": F.max(F.when(F.col("n") >= 2, F.col("row"))).over(span)})
    by_block = marked.groupBy("path", "sheet", "block").agg(
        F.min("row").alias("first_row"), F.max_by(F.when(F.col("low").isNull() | (F.col("row") < F.col("low")), F.col("line")), F.when(F.col("low").isNull() | (F.col("row") < F.col("low")), F.col("row"))).alias("lead"),
        F.sort_array(F.collect_list(F.when(F.col("row").between(F.col("low"), F.col("high")), F.struct("row", "cells")))).alias("body"),
    )
    before = F.lag(F.when(F.size("body") == 0, F.col("lead"))).over(Window.partitionBy("path", "sheet").orderBy("first_row"))
    titled = by_block.withColumn("title", F.coalesce(F.when(F.length("lead") <= 160, F.col("lead")), before)).where(F.size("body") > 0)
    columns = F.array_sort(F.array_distinct(F.flatten(F.transform("body", lambda r: F.transform(r["cells"], lambda c: c["col"])))))
    grid = F.transform("body", lambda r: F.transform(columns, lambda i: F.coalesce(F.get(F.filter(r["cells"], lambda c: c["col"] == i), F.lit(0))["text"], F.lit(""))))
    return titled.select("path", "sheet", "first_row", "title", grid.alias("grid"))


def word_tables(files: DataFrame) -> DataFrame:
    """A10: tables of documents, titled by the paragraph before if it begins with BANG and is short."""
    blocks = _read_office(files.where("suffix = 'docx'"), word_blocks, ["ord", "kind", "level", "text", "rows"], "ord int, kind string, level int, text string, rows array<array<string>>")
    before = F.lag("text").over(Window.partitionBy("path").orderBy("ord"))
    title = F.when(fold_upper(before).startswith("BANG") & (F.length(before) <= 160), before)
    return blocks.withColumn("title", title).where("kind = 'table'").select("path", "ord", "title", F.col("rows").alias("grid"))


def office_grids(files: DataFrame) -> DataFrame:
    """(path, title, grid) of office files by their suffix; old formats raise an error."""
    checked = files.withColumn("suffix", F.when(F.col("suffix").isin("xls", "doc"), F.raise_error(F.concat(F.lit("save it in the current format first: "), "path")).cast("string")).otherwise(F.col("suffix")))
    return excel_tables(excel_cells(checked)).select("path", "title", "grid").unionByName(word_tables(checked).select("path", "title", "grid"))
