"""Whole pages: from boxes and grids to text, tables, metadata and what to review."""

import pandas as pd
from pyspark.sql import functions as F

from girder.operators import cleaning, tables
from girder.plans import pages


def test_banded_rows():
    rows = [("Khối lượng", 60, 5), ("Tên", 5, 5), ("m", 45, 15), ("kg", 75, 15), ("a", 5, 30), ("1", 45, 30), ("2", 75, 30), ("b", 5, 50), ("tiếp", 5, 62), ("3", 45, 50), ("c", 5, 90), ("4", 75, 90)]
    items = pd.DataFrame([(t, x, y, x - 3, y - 4, 8.0) for t, x, y in rows], columns=["text", "cx", "cy", "x_min", "y_min", "h"])
    got = tables.banded_rows(items, [0.0, 10.0, 20.0, 100.0], [0.0, 30.0, 60.5, 90.0], [(30.0, 0.0, 90.0, 10.0)])
    assert got == [["Tên", "Khối lượng", "Khối lượng"], ["", "m", "kg"], ["a", "1", "2"], ["b tiếp", "3", ""], ["c", "", "4"]]


def test_analyze(spark):
    box = lambda doc, page, i, t, x, y, s=0.9: (doc, page, i, [(float(x), float(y)), (x + 80.0, float(y)), (x + 80.0, y + 10.0), (float(x), y + 10.0)], t, s)
    rows = [box(1, 3, 0, "PHẦN MỞ ĐẦU", 0, 0), box(1, 3, 1, "Câu thứ nhất rất dài", 0, 20), box(1, 3, 2, "còn tiếp.", 0, 40), box(1, 3, 3, "khó đọc lắm 漢", 0, 60, 0.4), box(1, 3, 4, "Bảng khối lượng", 0, 85)]
    rows += [box(1, 3, 10 + 3 * r + c, t, c * 100 + 10, 105 + r * 20) for r, row in enumerate([["STT", "Tên", "KL"], ["1", "a", "2,5"], ["2", "b", "3,5"]]) for c, t in enumerate(row)]
    rows += [box(1, 3, 40, "cuối trang", 900, 1400), box(1, 1, 0, "HỒ SƠ THIẾT KẾ", 0, 0), box(1, 1, 1, "mờ quá không rõ", 0, 20, 0.3)]
    boxes = spark.createDataFrame(rows, "doc_id int, page int, ord int, quad array<struct<x:double,y:double>>, text string, score double")
    cells = [(c * 100.0, 100 + r * 20.0, c * 100 + 100.0, 120 + r * 20.0) for r in range(3) for c in range(3)]
    grids = spark.createDataFrame([(1, 3, 0, 0.0, 100.0, 300.0, 160.0, [100.0, 120.0, 140.0, 160.0], [0.0, 100.0, 200.0, 300.0], cells)], "doc_id int, page int, grid_id int, x0 double, y0 double, x1 double, y1 double, row_edges array<double>, col_edges array<double>, cells array<struct<x0:double,y0:double,x1:double,y1:double>>")
    out = pages.analyze(boxes, grids)
    t = out.tables.collect()
    assert [(r.title, r.header, r.rows, r["values"]) for r in t] == [("Bảng khối lượng", ["STT", "Tên", "KL"], [["1", "a", "2,5"], ["2", "b", "3,5"]], [[1.0, None, 2.5], [2.0, None, 3.5]])]
    got = {r.page: (r.layout, r.markdown) for r in out.pages.collect()}
    assert got[1][0] == "cover_page" and got[3][0] == "document"
    assert got[3][1].startswith("### PHẦN MỞ ĐẦU\n\nCâu thứ nhất rất dài còn tiếp.\n\nkhó đọc lắm") and got[3][1].endswith("| 2 | b | 3,5 |")
    assert {(r.page, r.text) for r in out.low.collect()} == {(3, "khó đọc lắm"), (1, "mờ quá không rõ")}
    assert all(len(r.bbox) == 4 for r in out.low.collect())


def test_second_reading(spark):
    df = spark.createDataFrame([("BE TONG M300", True), ("D14", False), ("KC-01", False), ("1500x200", False), ("SGTVT DA DUYET", False), ("STT", False)], "t string, want boolean")
    assert all(r.v == r.want for r in df.select("want", cleaning.needs_second_reading(F.col("t")).alias("v")).collect())
    at = lambda t, x, y: spark.range(1).select(cleaning.in_margin_or_title_block(F.lit(t), F.lit(x), F.lit(y), F.lit(x + 5), F.lit(y + 5), F.lit(100.0), F.lit(100.0)).alias("v")).first().v
    assert at("x", 1.0, 50.0) and at("CHỦ ĐẦU TƯ", 70.0, 80.0) and not at("Dầm", 70.0, 80.0) and not at("CHỦ ĐẦU TƯ", 30.0, 30.0)
