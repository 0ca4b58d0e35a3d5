"""Classification and audit of tables, on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from girder.operators import audit as A
from girder.operators import tables as T

SCHEMA = "table_id long, page int, sheet string, sheet_title string, title string, header array<string>, rows array<array<string>>, number_style string"
HEADER = ["Ký hiệu", "Đường kính (mm)", "Chiều dài (mm)", "Số lượng", "Trọng lượng (kg)"]
BASE = [["T1", "16", "1200+2*300+2*150", "10", "33.1"], ["T2", "", "2000", "5", "15.78"], ["T3", "20", "3000", "4", "50.0"], ["T4", "10", "a+2b", "8", ""], ["T5", "17", "1000", "2", ""]]


def audited(spark, header, rows, style="vn"):
    out = A.audit_rebar(spark.createDataFrame([(1, 7, "KC-05", "Sheet", "Thống kê cốt thép", header, rows, style)], SCHEMA))
    return {(r.mark, r.kind) for r in out.warnings.collect()}, out.items.orderBy("row").collect(), out.summary.first(), out


def test_base_table(spark):
    flags, items, summary, out = audited(spark, HEADER, BASE)
    assert ("T1", "lech_trong_luong") not in flags and ("T3", "lech_trong_luong") in flags
    assert ("T4", "hinh_hoc_phuc_tap") in flags and ("T5", "duong_kinh_la") in flags
    assert [(i.mark, i.diameter, i.length_mm, i.quantity) for i in items] == [("T1", 16, 2100, 10), ("T2", 16, 2000, 5), ("T3", 20, 3000, 4), ("T5", 17, 1000, 2)]
    assert summary.status == "warning" and summary.total_bars == 4 and summary.length_unit == "mm"
    assert {(r.page, r.sheet) for r in out.warnings.collect()} == {(7, "KC-05")}
    assert summary.d_le_18 == pytest.approx(2.1 * 10 * 1.578 + 2 * 5 * 1.578 + 2 * 17 * 17 / 162, abs=0.01)
    buckets = {r.bucket: r.kg for r in A.bucket_rollup(out.summary).collect()}
    assert buckets["ALL"] == pytest.approx(summary.calc_weight_kg, abs=0.02)


def test_shape_expansion(spark):
    header = [*HEADER[:2], "Hình dạng", *HEADER[2:]]
    flags, items, _, _ = audited(spark, header, [["A1", "16", "16 1200 300 300 150 150 90", "a+2b+2c", "4", ""], ["A2", "16", "1200", "a+b", "4", ""], ["A3", "16", "", "2000", "4", ""]])
    assert ("A1", "khai_trien_tu_hinh") in flags and ("A2", "hinh_hoc_phuc_tap") in flags
    assert [(i.mark, i.length_mm, i.length_kind) for i in items] == [("A1", 2100, "from_shape"), ("A3", 2000, "number")]
    assert items[0].shape_segments_mm == [1200, 300, 300, 150, 150] and items[1].shape_segments_mm is None


def test_units_from_consistency(spark):
    """A header without units: lengths are in cm, totals in m, which the weights confirm."""
    header = ["Tên thanh", "Đường kính", "Chiều dài (oan)", "Số lượng", "Tổng chiều dài ()", "Khối lượng"]
    rows = [[f"N{i}", "16", str(cm), str(n), f"{cm * n / 100:.2f}".replace(".", ","), f"{cm * n / 100 * 1.578:.2f}".replace(".", ",")] for i, (cm, n) in enumerate([(250, 10), (310, 8), (120, 30), (475, 4)])]
    flags, items, summary, _ = audited(spark, header, rows)
    assert not flags and summary.length_unit == "cm" and [i.length_mm for i in items] == [2500, 3100, 1200, 4750]


def test_total_and_blank_weights(spark):
    header = ["Tên thanh", "Đường kính (mm)", "Chiều dài (mm)", "Số lượng", "Tổng chiều dài (m)", "Trọng lượng (kg)"]
    rows = [["K1", "16", "2000", "10", "20", "15"], ["A8", "16", "1000", "10", "00", "15.78"], ["K2", "16", "2000", "5", "10", "15.78"], ["K3", "16", "1000", "4", "9", "6.31"], ["K4", "16", "1000", "4", "4", ""]]
    flags, *_ = audited(spark, header, rows)
    assert {("K1", "lech_trong_luong"), ("A8", "o_tong_dai_bang_0"), ("K3", "lech_tong_dai"), ("K4", "o_khoi_luong_trong"), ("TỔNG BẢNG", "lech_tong_bang")} == flags


def test_header_not_to_be_trusted(spark):
    header = ["Ký hiệu", "Đường kính KL đơn vị", "x", "Số lượng", "Trọng lượng (kg)"]
    flags, items, _, _ = audited(spark, header, [["A", "0,888", "D12", "4", "5"], ["B", "1,208", "D14", "4", "5"], ["C", "1,578", "D16", "4", "5"]])
    assert flags == {("TIÊU ĐỀ BẢNG", "tieu_de_khong_tin_cay")} and not items


def test_quantity_and_weight_columns(spark):
    header = ["Số hiệu", "Đường kính (mm)", "Chiều dài (mm)", "Số lượng 1CK", "Số lượng T.Bộ", "(u/ay) kg", "Tổng khối lượng kg"]
    rows = [[f"S{i}", d, "1000", "9", "18", m, f"{18 * float(m):.2f}"] for i, (d, m) in enumerate([("16", "1.578"), ("20", "2.466"), ("25", "3.853")])]
    flags, items, _, _ = audited(spark, header, rows, "us")
    assert not flags and {i.quantity for i in items} == {18}


def test_zero_diameter_is_carried(spark):
    flags, items, _, _ = audited(spark, HEADER, [["Z1", "00", "1000", "2", ""], ["Z2", "", "1000", "2", ""], ["Z3", "12", "1000", "2", ""], ["Z4", "", "", "", ""], ["Z5", "D>18", "D12", "", ""]])
    assert {("Z1", "duong_kinh_khong_doc_duoc"), ("Z2", "duong_kinh_khong_doc_duoc")} == flags and [i.mark for i in items] == ["Z3"]


def test_boq(spark):
    header = ["Hạng mục", "Khối lượng", "Đơn giá", "Thành tiền"]
    table = spark.createDataFrame([(1, 1, "", "", "", header, [["a", "10", "5", "50"], ["b", "10", "5", "60"], ["c", "10", "5", ""]], "vn"), (2, 1, "", "", "", ["x"], [["1"]], "vn")], SCHEMA)
    out = A.audit_boq(table)
    assert [(r.table_id, r.row) for r in out.warnings.collect()] == [(1, 2)]
    assert sorted((r.table_id, r.status, r.total_amount, r.total_items) for r in out.summary.collect()) == [(1, "warning", 110.0, 3), (2, "ok", 0.0, 1)]


@pytest.mark.parametrize(
    "title,header,want",
    [
        ("Bảng thống kê cốt thép dầm", HEADER, ("rebar_schedule", 1.0)), ("Tổng hợp khối lượng bệ trụ T1", HEADER, ("rebar_schedule", 1.0)), ("Dự toán", ["Hạng mục", "Đơn vị", "Khối lượng", "Đơn giá", "Thành tiền"], ("boq", 1.0)),
        ("Danh mục bản vẽ", ["Ngày", "Tỷ lệ"], ("sheet_index", 1.0)), ("", ["a", "b"], ("general", 0.3)), ("", ["Chủ đầu tư", "Tên bản vẽ"], ("title_block", 0.99)), ("Tọa độ", ["x"], ("specs", 0.6)),
    ],
)
def test_classify(spark, title, header, want):
    row = T.classified(spark.createDataFrame([(1, 1, "", "", title, header, [["1"]], "vn")], SCHEMA)).first()
    assert (row.category, row.confidence) == want


def test_grid_to_table(spark):
    grid = [["Bảng 1", "Bảng 1", "Bảng 1"], ["", "", ""], ["STT", "Khối lượng", "Ghi chú"], ["", "(kg)", ""], ["1", "1.525,81", ""], ["2", "25,50"]]
    row = spark.createDataFrame([(grid,)], "g array<array<string>>").select(T.split_header(F.col("g")).alias("t")).select("t.*").first()
    assert row.title == "Bảng 1" and row.header == ["STT", "Khối lượng (kg)", "Ghi chú"] and row.rows == [["1", "1.525,81", ""], ["2", "25,50", ""]]
    out = T.with_values(spark.createDataFrame([(1, row.header, row.rows)], "table_id long, header array<string>, rows array<array<string>>")).first()
    assert out.number_style == "vn" and out["values"] == [[1.0, 1525.81, None], [2.0, 25.5, None]]
    assert spark.createDataFrame([([["a"]],)], "g array<array<string>>").select(T.split_header(F.col("g")).alias("t")).first().t is None


def test_grid_steps_are_computed_once(spark):
    # Steps written out in one another made the work of a grid grow as a power of its depth.
    def plan(df):
        return df._jdf.queryExecution().analyzed().toString()

    df = spark.createDataFrame([([["STT", "Mác"], ["1", "2"]],), ([],)], "grid_cells array<array<string>>")
    assert plan(df.select(T.split_header(F.col("grid_cells")).alias("t"))).count("grid_cells#") <= 3
    genuine = df.select(T.is_genuine_table(F.col("grid_cells")).alias("t"))
    assert plan(genuine).count("grid_cells#") <= 3 and [r.t for r in genuine.collect()] == [False, False]
    cut = spark.createDataFrame([(1, [["1,525.81"], None, ["x"]]), (2, None), (None, [["25.5"]])], "table_id long, rows array<array<string>>")
    made = T.with_values(cut)
    assert "Join" not in plan(made) and [(r.number_style, r["values"]) for r in made.sort(F.col("table_id").asc_nulls_last()).collect()] == [("us", [[1525.81], None, [None]]), ("vn", None), ("us", [[25.5]])]


def test_items_into_grid(spark):
    items = spark.createDataFrame([(1, 1, 5.0, 5.0, 0.0, "a"), (1, 1, 15.0, 5.0, 11.0, "c"), (1, 1, 14.0, 5.0, 10.0, "b"), (1, 1, 20.0, 20.0, 18.0, "d"), (1, 1, 99.0, 5.0, 0.0, "out")], "doc_id long, page int, cx double, cy double, x_min double, text string")
    grids = spark.createDataFrame([(1, 1, 0, [0.0, 10.0, 20.0], [0.0, 10.0, 20.0])], "doc_id long, page int, grid_id int, row_edges array<double>, col_edges array<double>")
    assert T.grid_rows(items, grids).first().grid == [["a", "b c"], ["", "d"]]


def test_genuine_and_markdown(spark):
    df = spark.createDataFrame([([["STT", "Mác", "kg"], ["1", "2", "3"]], [["one", "a much longer piece of prose than a table has"], ["x", "y"]])], "a array<array<string>>, b array<array<string>>")
    assert tuple(df.select(T.is_genuine_table(F.col("a")), T.is_genuine_table(F.col("b"))).first()) == (True, False)
    md = spark.createDataFrame([(["a|b", ""], [["x\ny", None]])], "h array<string>, r array<array<string>>").select(T.to_markdown(F.col("h"), F.col("r")).alias("m")).first().m
    assert md == "| a\\|b | Cột 2 |\n| --- | --- |\n| x y |  |"


def test_category_counts(spark):
    got = {r.category: r.n for r in T.category_counts(spark.createDataFrame([("boq",), (None,), ("boq",)], "category string")).collect()}
    assert got == {"boq": 2, "general": 1, "all": 3}
