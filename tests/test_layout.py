"""Geometry and page layout on hand-made items."""

import pytest
from pyspark.sql import functions as F

from girder.functions import geometry as G
from girder.operators import layout as L

ITEM = "doc_id int, page int, ord int, text string, x_min double, y_min double, x_max double, y_max double, cx double, cy double, h double, page_w double, page_h double"


def items(spark, rows, page=1, w=1600.0, h=1100.0):
    return spark.createDataFrame([(1, page, i, t, float(x), float(y), x + 100.0, y + 10.0, x + 50.0, y + 5.0, 10.0, w, h) for i, (t, x, y) in enumerate(rows)], ITEM)


def test_boxes(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (10.0, 1.0), (10.0, 5.0), (0.0, 4.0)],)], "quad array<struct<x:double,y:double>>")
    r = G.box_metrics(df).first()
    assert (r.x_min, r.y_max, r.cx, r.cy, r.w, r.h) == (0, 5, 5, 2.5, 10, 5)
    box = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(G.overlap_ratio(box(0, 0, 10, 10), box(5, 0, 10, 10))) == 1.0 and one(G.overlap_ratio(box(0, 0, 1, 1), box(5, 5, 6, 6))) == 0.0
    for k in range(4):  # back to where it was after four quarter-turns
        b = box(1, 2, 3, 5)
        w, h = 10.0, 20.0
        for _ in range(k):
            b, (w, h) = G.rotate_box(b, F.lit(1), F.lit(w), F.lit(h)), (h, w)
        assert one(G.rotate_box(box(1, 2, 3, 5), F.lit(k), F.lit(10.0), F.lit(20.0))) == one(b)
    assert [one(G.base_scale(F.lit(float(v)), F.lit(1.0))) for v in (100, 1400, 5000)] == [1.5, pytest.approx(1600 / 1400), 1.0]
    assert one(G.to_scene(box(4, 2, 1, 8), F.lit(2.0), F.lit(1.0))) == [2, 4, 8, 16]
    assert one(G.tiles(F.lit(3000), F.lit(1000))) == [[0, 0, 2400, 1000], [1900, 0, 3000, 1000]] and one(G.tiles(F.lit(100), F.lit(100))) == [[0, 0, 100, 100]]
    assert one(G.accept_reread(F.lit(0.5), F.lit(0.9), F.lit(10), F.lit(11))) and not one(G.accept_reread(F.lit(0.8), F.lit(0.95), F.lit(10), F.lit(10))) and one(G.orientation(F.lit(5), F.lit(12)))
    words = spark.createDataFrame([("ab c", [("ab", 0.0, 10.0), ("c", 20.0, 30.0)])], "text string, words array<struct<s:string,x0:double,x1:double>>")
    assert [tuple(c) for c in words.select(G.char_spans(F.col("text"), F.col("words"), F.lit(1.0), F.lit(2.0)).alias("c")).first().c] == [("a", 1, 11), ("b", 11, 21), ("c", 41, 61)]


def test_page_kinds(spark):
    sheet = items(spark, [("MẶT CẮT A-A", 0, 0), ("TỶ LỆ 1/50", 0, 20)] + [(str(i), i * 10, 40) for i in range(20)])
    cover = items(spark, [("HỒ SƠ THIẾT KẾ", 0, 0), ("Công trình: Cầu A", 0, 20)], page=2)
    got = {r.page: (r.is_cad_sheet, r.is_cover) for r in L.page_facts(sheet.unionByName(cover)).collect()}
    assert got == {1: (True, False), 2: (False, True)}
    lines = spark.createDataFrame([(1, 2, 0, "Công trình: Cầu A"), (1, 2, 1, "Địa điểm:"), (1, 2, 2, "Xã B")], "doc_id int, page int, line int, text string")
    assert {r.key: r.value for r in L.key_values(lines).collect()} == {"Công trình": "Cầu A", "Địa điểm": "Xã B"}


def test_title_block_and_stamp(spark):
    rows = [("TÊN BẢN VẼ", 1300, 900), ("CHỦ ĐẦU TƯ", 1300, 950), ("Dầm T1", 1310, 920), ("far away", 10, 10), ("SGTVT THẨM TRA", 500, 500), ("ngày 1", 505, 512)]
    df = items(spark, rows)
    box = L.title_blocks(df)
    assert {r.ord for r in L.inside(df, box).collect()} == {0, 1, 2}
    assert {r.ord for r in L.with_stamps(df).where("in_stamp").collect()} == {4, 5}


def test_metadata(spark):
    lines = [(1, 1, i, t) for i, t in enumerate(["CHỦ ĐẦU TƯ: Ban QLDA", "TÊN BẢN VẼ", "Bố trí chung", "cầu A", "BẢN VẼ SỐ: KC-05", "TỶ LỆ 1/50 ngày 3/7/2024", "Km 1+200 đến KM1+300, Km 1+200"])]
    r = L.metadata(spark.createDataFrame(lines, "doc_id int, page int, line int, text string")).first()
    assert (r.chu_dau_tu, r.ten_ban_ve, r.so_hieu_ban_ve, r.ty_le, r.ngay) == ("Ban QLDA", "Bố trí chung cầu A", "KC-05", "1/50", "03/07/2024") and r.ly_trinh == ["KM1+200", "KM1+300"]


def test_grids_and_tables(spark):
    df = items(spark, [("BẢNG KHỐI LƯỢNG", 20, 80), ("gần hơn", 20, 88), ("NGƯỜI LẬP", 20, 89), ("12", 20, 89)])
    grids = spark.createDataFrame([(1, 1, 0, 0.0, 100.0, 300.0, 200.0, [0.0, 60.0, 300.0])], "doc_id int, page int, grid_id int, x0 double, y0 double, x1 double, y1 double, col_edges array<double>")
    assert L.grid_titles(df, grids).first().title == "BẢNG KHỐI LƯỢNG"
    crossing = spark.createDataFrame([(1, 1, 0, "ab cd", 40.0, 80.0, 60.0, 110.0, [("a", 40.0, 45.0), ("b", 45.0, 50.0), (" ", 50.0, 61.0), ("c", 70.0, 75.0), ("d", 75.0, 80.0)]), (1, 1, 1, "x", 400.0, 410.0, 405.0, 110.0, None)], "doc_id int, page int, ord int, text string, x_min double, x_max double, cx double, cy double, chars array<struct<s:string,x0:double,x1:double>>")
    assert [(r.ord, r.text) for r in L.split_on_columns(crossing, grids).orderBy("ord", "x_min").collect()] == [(0, "ab"), (0, "cd"), (1, "x")]
    lines = spark.createDataFrame([(1, 1, i, float(i * 12), 10.0, t) for i, t in enumerate([["Bảng khối lượng"], ["STT", "Tên", "KL"], ["1", "a", "2"], ["2", "b", "3"]])], "doc_id int, page int, line int, cy double, h double, texts array<string>")
    found = L.keyword_tables(lines).collect()
    assert len(found) == 1 and found[0].title == "Bảng khối lượng" and found[0].rows == [["STT", "Tên", "KL"], ["1", "a", "2"], ["2", "b", "3"]]


def test_text(spark):
    rows = [(f"l{i}", 10, i * 20) for i in range(5)] + [(f"r{i}", 1000, i * 20) for i in range(5)]
    assert L.two_columns(items(spark, rows)).first().two_columns and not L.two_columns(items(spark, [("x", 760, i * 20) for i in range(8)])).first().two_columns
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(["PHẦN MỞ ĐẦU", "Câu một dài", "còn tiếp.", "Câu hai", "- mục a", "tiếp mục"])], "doc_id int, page int, line int, text string")
    assert L.rendered(L.paragraphs(lines)).first().markdown == "### PHẦN MỞ ĐẦU\n\nCâu một dài còn tiếp.\n\nCâu hai\n\n- mục a tiếp mục"
    texts = spark.createDataFrame([(1, 1, "C«ng tr×nh ®­êng bé"), (1, 1, "B¶n"), (1, 1, "plain"), (1, 2, "B¶n")], "doc_id int, page int, text string")
    assert sorted((r.page, r.text, r.kind) for r in L.legacy_kinds(texts).collect() if r.kind) == [(1, "B¶n", "tcvn3"), (1, "C«ng tr×nh ®­êng bé", "tcvn3")]
    cells = spark.createDataFrame([(1, 1, 0, "a", [1.0]), (1, 2, 0, "b", None)], "table_id int, row int, col int, text string, bbox array<double>")
    got = L.cell_lookup(cells, spark.createDataFrame([(1, [9.0])], "table_id int, bbox array<double>"), cells.select("table_id", "row", "col")).orderBy("row").collect()
    assert [r.bbox for r in got] == [[1.0], [9.0]]
