"""Sinks (B1-B4, B10, B11, B14, B16): files of a run, workbooks, knowledge tables.

A run writes each table with Spark's own committer below a folder of its own, so that nothing is
half there and no earlier run is overwritten. Workbooks are made one for each document, in executors.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, reports


def write_run(out: str, run_id: str, **frames: DataFrame) -> list[str]:
    """Each frame as Parquet below ``out/run_id``; fails if the run is there already."""
    paths = []
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(path := f"{out}/{run_id}/{name}")
        paths.append(path)
    return paths


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON Lines, left out if there are no rows."""
    if not df.isEmpty():
        df.write.mode("errorifexists").json(path)


def specialised(tables: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """Bars of all tables, and bills with their rows."""
    bills = tables.where("category = 'boq'").select("page", "sheet", "sheet_title", "title", F.col("header").alias("headers"), "rows")
    return {"rebar_items": items, "boq_tables": bills}


def write_markdown(pages: DataFrame, path: str) -> None:
    """One Markdown text for each document, by document."""
    reports.full_markdown(pages).write.mode("errorifexists").partitionBy("doc_id").text(path)


def _name(i: int) -> str:
    out = ""
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(sheets: list[tuple[str, list[list]]]) -> bytes:
    """A workbook of named sheets of rows; numbers as numbers, all else as text."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(r: int, c: int, v) -> str:
        if v is None or v == "":
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{_name(c)}{r}"><v>{v!r}</v></c>'
        return f'<c r="{_name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    names: list[str] = []
    for title, _ in sheets:  # at most 31 characters, without signs that are not allowed, each once
        base = "".join("_" if ch in '[]:*?/\\' else ch for ch in title)[:28] or "Sheet"
        name, k = base, 1
        while name.lower() in {n.lower() for n in names}:
            k += 1
            name = f"{base}_{k}"
        names.append(name)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (_, rows) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>")
    return out.getvalue()


def workbooks(tables: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, content): a workbook for each document: an index of its tables (title blocks left
    out, numbered from 1), its bars with sums by diameter, and a sheet for each table.

    ``tables``: doc_id, table_id, title, category, header, rows; ``items``: doc_id, mark, diameter,
    length_mm, quantity, total_weight_kg.
    """
    t = tables.where("coalesce(category, '') <> 'title_block'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("table_id", "title", "category", "header", "rows"))).alias("tables"))
    i = items.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("table_id", "mark", "diameter", "length_mm", "quantity", "total_weight_kg"))).alias("items"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for doc in frame.itertuples():
                found = [] if doc.tables is None else list(doc.tables)
                bars = [] if doc.items is None else list(doc.items)
                index = [["No.", "Title", "Category", "Rows"]] + [[n, x["title"] or "", x["category"] or "general", len(x["rows"])] for n, x in enumerate(found, 1)]
                sums = {b: 0.0 for b in ("d <= 10", "10 < d <= 18", "d > 18")}
                for x in bars:
                    sums["d <= 10" if x["diameter"] <= 10 else "10 < d <= 18" if x["diameter"] <= 18 else "d > 18"] += x["total_weight_kg"] or 0.0
                rebar = [["Mark", "Diameter", "Length mm", "Quantity", "kg"]] + [[x["mark"], int(x["diameter"]), int(x["length_mm"]), int(x["quantity"]), float(x["total_weight_kg"])] for x in bars] + [["Sum", k, "", "", round(v, 2)] for k, v in sums.items()] + [["Sum", "all", "", "", round(sum(sums.values()), 2)]]
                sheets = [("Index", index), *([("Rebar", rebar)] if bars else []), *((f"{n} {x['title'] or 'Table'}", [list(x["header"]), *map(list, x["rows"])]) for n, x in enumerate(found, 1))]
                made.append((doc.doc_id, workbook(sheets)))
            yield pd.DataFrame(made, columns=["doc_id", "content"])

    kind = tables.schema["doc_id"].dataType.simpleString()
    return t.join(i, "doc_id", "full").mapInPandas(run, f"doc_id {kind}, content binary")


def save_knowledge(path: str, **frames: DataFrame) -> None:
    """Knowledge tables, each as a new version beside those before, which stay as they are.

    A version counts once it is whole (its ``_SUCCESS`` is there), so a write that fails loses
    nothing, and a table may be read, merged and saved again.
    """
    for name, df in frames.items():
        last = max(_versions(df.sparkSession, f"{path}/{name}", whole=False), default=0)
        df.write.parquet(f"{path}/{name}/v{last + 1:08d}")


def knowledge(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The newest whole version of a knowledge table, or None if there is none."""
    last = max(_versions(spark, f"{path}/{name}", whole=True), default=None)
    return None if last is None else spark.read.parquet(f"{path}/{name}/v{last:08d}")


def _versions(spark: SparkSession, folder: str, whole: bool) -> list[int]:
    """Numbers of a folder's versions; the listing goes to the file system that the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [entry.getPath() for entry in files.listStatus(at)]
    mark = spark._jvm.org.apache.hadoop.fs.Path
    return [int(p.getName()[1:]) for p in found if p.getName()[:1] == "v" and p.getName()[1:].isdigit() and (not whole or files.exists(mark(p, "_SUCCESS")))]


def append_corrections(pairs: DataFrame, path: str) -> None:
    """A log of corrections that is only added to."""
    pairs.write.mode("append").parquet(path)


def audit_tables(tables: DataFrame) -> audit.Audit:
    """The audit that ``write_run`` and ``workbooks`` take, of the bar schedules among ``tables``."""
    return audit.audit_rebar(tables.where("category = 'rebar_schedule'"))
