"""Sources, sinks, plans and streams, end to end on files made here."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from girder.operators import relational
from girder.plans import pipelines
from girder.sources import readers, sinks
from girder.streaming import progress

PAGE = "Tuyến đường nối hai huyện được thiết kế mới với mặt cắt ngang rộng bảy mét và lề đường mỗi bên một mét rưỡi trong khi cầu dầm bản có bề rộng chín mét theo hồ sơ thiết kế"
TABLE = {"title": "Bảng thống kê cốt thép", "header": ["Ký hiệu", "Đường kính (mm)", "Chiều dài (mm)", "Số lượng", "Trọng lượng (kg)"], "rows": [["T1", "16", "2000", "10", "31.56"], ["T2", "16", "1000", "10", "30"]], "number_style": "us"}


@pytest.fixture
def folder(tmp_path):
    out = tmp_path / "in" / "A_run"
    out.mkdir(parents=True)
    page = {"page": 1, "method": "pdftext_fast", "metadata": {"so_hieu_ban_ve": "KC-05", "ten_ban_ve": "Dầm"}, "text": PAGE, "markdown": "### Ghi chú\n" + PAGE, "tables": [TABLE], "low_confidence": [{"text": "D1?", "score": 0.3}]}
    (out / "du_lieu.json").write_text(json.dumps({"source": "a.pdf", "page_count": 2, "pages": [page, {"page": None}]}))
    broken = tmp_path / "in" / "B_run"
    broken.mkdir()
    (broken / "du_lieu.json").write_text("{not json")
    return tmp_path


def test_results(spark, folder):
    docs = readers.payloads(spark, f"{folder}/in/*/du_lieu.json")
    assert {(r.folder, r.source) for r in docs.collect()} == {("A_run", "a.pdf"), ("B_run", None)}
    pages = readers.pages(docs)
    assert [(r.page, r.n_tables, r.n_low) for r in pages.collect()] == [(1, 1, 1)]
    tables = readers.page_tables(pages)
    assert (tables.first().sheet, tables.first().title) == ("KC-05", TABLE["title"]) and readers.low_confidence(pages).first().text == "D1?"
    made = pipelines.convert(pages, tables)
    assert [(r.mark, r.kind) for r in made.audit.warnings.where("row > 0").collect()] == [("T2", "lech_trong_luong")] and made.audit.items.count() == 2
    assert made.index.first().n_tables == 1 and made.chunks.first().id == "text/page/1/chunk/1"
    asked = pipelines.ask(made.chunks, pages, spark.createDataFrame([(1, "ghi chú KC-05 mặt cắt")], "query_id int, query string")).first().messages
    assert [m.role for m in asked] == ["system", "user"] and "KC-05" in asked[1].content
    paths = sinks.write_run(str(folder / "out"), "run1", items=made.audit.items, warnings=made.audit.warnings)
    assert spark.read.parquet(paths[0]).count() == 2
    with pytest.raises(Exception, match="exists"):
        sinks.write_run(str(folder / "out"), "run1", items=made.audit.items)
    stored = spark.createDataFrame([], readers.CHUNK)
    assert readers.chunks_or_tables(stored, tables).first().block_type == "table"
    sinks.write_json_lines(stored, f"{folder}/none.json")
    assert not (folder / "none.json").exists()
    books = sinks.workbooks(tables.withColumn("category", F.lit("rebar_schedule")), made.audit.items.join(tables.select("table_id", "doc_id"), "table_id")).collect()
    cells = readers.sheet_cells(bytes(books[0].content))
    assert {c[0] for c in cells} == {"Index", "Rebar", "1 Bảng thống kê cốt thép"} and ("Rebar", 2, 2, "16", False, 0) in cells
    knowledge = pipelines.learn(pages, spark.createDataFrame([("x",)], "document string"))
    assert knowledge.verified.where("term = 'thiết kế'").first().cnt == 2


def test_rules(spark, tmp_path):
    (tmp_path / "a.json").write_text('[["a", "b"], ["c", "d"]]')
    (tmp_path / "b.json").write_text('[{"pattern": "x", "replace": "y"}, {"pattern": "p", "replacement": "q"}]')
    assert [tuple(r) for r in readers.rules(spark, f"{tmp_path}/a.json", "s").collect()] == [("s", 0, "a", "b"), ("s", 1, "c", "d")]
    assert [(r.pattern, r.replacement) for r in readers.rules(spark, f"{tmp_path}/b.json", "s").collect()] == [("x", "y"), ("p", "q")]


def test_office(spark, tmp_path):
    rows = [["Bảng khối lượng"], [], ["STT", "Tên", "KL"], [1, "a", 12.5], [2, "b", 3], [], ["Ghi chú ở dưới"]]
    (tmp_path / "a.xlsx").write_bytes(sinks.workbook([("S", rows)]))
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Mở đầu</w:t></w:r></w:p><w:p><w:r><w:t>Bảng 1</w:t></w:r></w:p><w:tbl><w:tr>{cell("x")}{cell("y")}</w:tr><w:tr>{cell("1")}{cell("2")}</w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.docx").write_bytes(out.getvalue())
    files = readers.documents(spark, str(tmp_path))
    got = {r.path.rpartition(".")[2]: (r.title, r.grid) for r in readers.office_grids(files).collect()}
    assert got["xlsx"] == ("Bảng khối lượng", [["STT", "Tên", "KL"], ["1", "a", "12.5"], ["2", "b", "3"]]) and got["docx"] == ("Bảng 1", [["x", "y"], ["1", "2"]])
    (tmp_path / "c.xls").write_bytes(b"old")
    with pytest.raises(Exception, match="current format"):
        readers.office_grids(readers.documents(spark, str(tmp_path), ("xls",))).collect()
    assert readers.canonical("1525.0") == "1525" and readers.canonical("0.1234567890123") == "0.123456789" and readers.canonical("abc") == "abc"


def test_page_ranges(spark):
    pages = lambda v: spark.range(1).select(relational.page_range(F.lit(v), F.lit(9)).alias("p")).first().p
    assert pages("1-3, 5,2") == [1, 2, 3, 5] and pages("") == list(range(1, 10)) and pages(None) == list(range(1, 10))
    for bad in ("0", "10", "3-1", "a", "1--2", "1,"):
        with pytest.raises(Exception, match="range of pages"):
            pages(bad)


def test_relational(spark):
    row = spark.range(1).select(relational.merged_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m"), relational.distinct_matches(F.lit("KM 1+200 x KM 3+400 KM 1+200"), r"KM \d+\+\d+").alias("v"), pipelines.route(F.lit("XLSX"), F.lit("vn_ocr")).alias("r"), pipelines.office_warnings(F.array(F.lit("blank page"), F.lit("x")), F.array(F.lit("y"))).alias("w")).first()
    assert row.m == {"a": 1, "b": 3} and row.v == ["KM 1+200", "KM 3+400"] and row.r == "office" and row.w == ["x", "y"]
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(["Chủ đầu tư: A", "Tên bản vẽ:", "một", "hai", "Tỷ lệ:", "1/50"])], "doc_id int, page int, line int, text string")
    out = relational.value_after_label(lines, F.regexp_extract("text", r":\s*(.+)$", 1), F.col("text").contains(":")).orderBy("line").collect()
    assert [r.value for r in out] == ["A", "một hai", "1/50"]
    nested = spark.createDataFrame([(1, "p", [("t", 2)])], "page int, title string, tables array<struct<title:string,n:int>>")
    assert relational.exploded_tables(nested).first().asDict() == {"page": 1, "title": "t", "n": 2}
    objects = spark.createDataFrame([(1, "image", 50.0, 100.0), (1, "path", 1.0, 100.0)], "page int, kind string, area double, page_area double")
    assert tuple(relational.object_stats(objects, ["image", "path", "text"]).first()) == (1, 1, 1, 0, 0.5)


def test_streams(spark, tmp_path):
    lines = [("EVENT " + json.dumps({"type": "progress", "message": f"m{i}", "percent": i}), f"2026-01-01 00:00:{i // 4:02d}.{i % 4}00") for i in range(12)] + [("noise", "2026-01-01 00:00:00")]
    spark.createDataFrame(lines, "value string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("value string, ts timestamp").parquet(f"{tmp_path}/in")
    progress.throttled(progress.parsed(source)).writeStream.format("memory").queryName("seconds").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.message, r.n) for r in spark.table("seconds").collect()) == [("m11", 4), ("m3", 4), ("m7", 4)]

    docs = spark.createDataFrame([(f"d{i}", "pdftext_fast", PAGE) for i in range(2)], "document string, method string, text string")
    docs.write.parquet(f"{tmp_path}/pages")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/pages")
    for _ in range(2):  # the second start finds nothing new
        progress.learn(stream, f"{tmp_path}/kb", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = {r.term: (r.cnt, r.docs) for r in progress.learned(spark, f"{tmp_path}/kb/verified").collect()}
    assert got["thiết kế"] == (4, 2)
    pairs = spark.createDataFrame([("a", "b")], "raw string, corrected string")
    sinks.append_corrections(pairs, f"{tmp_path}/log")
    progress.log_corrections(spark.readStream.schema(pairs.schema).parquet(f"{tmp_path}/log"), f"{tmp_path}/log2", f"{tmp_path}/check2").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log2").count() == 1
