"""Learning, reports and clustering on hand-made rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.operators import clustering as K
from girder.operators import learning as L
from girder.operators import reports as R

PAGE = "Tuyến đường nối hai huyện được thiết kế mới với mặt cắt ngang rộng bảy mét và lề đường mỗi bên một mét rưỡi trong khi cầu dầm bản có bề rộng chín mét theo hồ sơ thiết kế"


def test_abbreviations(spark):
    docs = spark.createDataFrame([(1, "Bê tông cốt thép (BTCT) và Hệ thống phòng cháy chữa cháy (PCCC)."), (2, "BTCT (bê tông có thép)\nGPMB : Giải phóng mặt bằng\nXYZ (không khớp chữ)")], "doc_id long, text string")
    assert {r.acro: r.expansion for r in L.abbreviations(docs).collect()} == {"BTCT": "Bê tông cốt thép", "PCCC": "phòng cháy chữa cháy", "GPMB": "Giải phóng mặt bằng"}


@pytest.mark.parametrize("acro,full,want", [("BTCT", "bê tông cốt thép", True), ("PCCC", "phòng cháy chữa cháy", True), ("ABC", "bê tông cốt thép", False), ("X", "xi măng", False)])
def test_expansion(spark, acro, full, want):
    assert (spark.range(1).select(L.expansion(F.lit(acro), F.lit(full)).alias("e")).first().e is not None) is want


def test_terms(spark):
    docs = spark.createDataFrame([(1, "mặt cắt ngang và mặt cắt ngang, abc def abc def"), (2, "mặt cắt một lần")], "doc_id long, text string")
    got = {r.term: r.cnt for r in L.terms(docs).collect()}
    assert got == {"mặt cắt": 2, "cắt ngang": 2, "mặt cắt ngang": 2}
    known = L.terms(docs)
    assert L.new_entries(L.terms(docs), known, "term").count() == 0
    assert {r.term: r.cnt for r in L.merged_terms(known, known).collect()} == {k: 2 * v for k, v in got.items()}


def test_trust_and_verified(spark):
    pages = spark.createDataFrame([(1, "pdftext_fast", PAGE), (2, "office_native", PAGE), (3, "pdftext_fast", "c ọc b ê t ông " * 10), (4, "pdftext_fast", "tuyen duong noi hai huyen " * 10), (5, "ocr", PAGE)], "doc_id long, method string, text string")
    trusted = L.trusted_pages(pages)
    assert {r.doc_id for r in trusted.collect()} == {1, 2}
    found = {r.term: (r.cnt, r.docs) for r in L.verified_terms(trusted).collect()}
    assert found["thiết kế"] == (4, 2) and found["mặt cắt ngang"] == (2, 2) and "và lề" not in found and "lề đường" in found


def test_verified_map(spark):
    rows = [("mặt đường", 9, 3), ("mắt đường", 1, 1), ("cốt thép", 20, 5), ("bản vẽ", 4, 4), ("bán vé", 4, 4), ("dầm bản", 10, 1), ("an toan", 50, 9)]
    got = {r.key: r.phrase for r in L.verified_map(spark.createDataFrame(rows, "term string, cnt long, docs long")).collect()}
    assert got == {"mat duong": "mặt đường", "cot thep": "cốt thép"}


def test_corrections(spark):
    pairs = spark.createDataFrame([("chiu lyrc", "chịu lực", "a", 1), ("chiu lyrc", "chịu lực!", "b", 2), ("12.5", "13.0", "a", 1), ("x", "y", "a", 1), ("same", "same", "a", 1), ("⟦OCR khác: z⟧ thep", "thép", "a", 1)], "raw string, corrected string, source string, ts int")
    got = {r.raw: (r.corrected, r.cnt, r.safe) for r in L.corrections(pairs).collect()}
    assert got == {"chiu lyrc": ("chịu lực!", 2, True), "12.5": ("13.0", 1, False), "thep": ("thép", 1, True)}
    assert {r.raw for r in L.safe_corrections(L.corrections(pairs), 2).collect()} == {"chiu lyrc"}


def test_diff(spark):
    before, after = "dòng một\ntổng chiu lyrc là 25 kg\ncuối", "dòng một\ntổng chịu lực là 26 kg\ncuối"
    assert L.diff_pairs(before, after) == [("chiu lyrc", "chịu lực"), ("25", "26")]
    assert L.diff_pairs("a\nb", "a\nthêm\nb") == [] and L.diff_pairs("Cau nay bi doc sai gan nhu hoan toan boi phan mem.\n", "Day la mot cau hoan toan khac do con nguoi viet lai tu dau.\n") == []
    assert L.diff_pairs("Dong mot giong nhau.\nDong hai giong nhau.\n", "Dong mot giong nhau.\nDong hai giong nhau.\nDong moi them vao.\n") == []
    assert L.diff_pairs("be tonq cot thep\nx y", "bê tông cốt thép x y") == [("be tonq cot thep", "bê tông cốt thép")]
    assert L.diff_pairs("Ket cau be tong cot thep chiu lyrc chinh.\nMac be tong 300, chieu dai 25 m.\n", "Ket cau be tong cot thep chịu lực chinh.\nMac be tong 300, chieu dai 26 m.\n") == [("chiu lyrc", "chịu lực"), ("25", "26")]
    out = L.edited_pairs(spark.createDataFrame([(before, after, "d", 1)], "before string, after string, source string, ts int"))
    assert {(r.raw, r.safe) for r in L.corrections(out).collect()} == {("chiu lyrc", True), ("25", False)}


def test_history(spark, monkeypatch):
    log = spark.createDataFrame([(i, f"d{i}", 10, i, {"a": i, "b": 1}) for i in range(1, 8)], "epoch int, document string, pages int, new_terms int, lessons map<string,int>")
    assert [r.cumulative_terms for r in L.epochs(log).orderBy("epoch").collect()] == [1, 3, 6, 10, 15, 21, 28]
    monkeypatch.setattr(L, "EPOCHS_AT_ONCE", 2)
    assert [r.cumulative_terms for r in L.epochs(log).orderBy("epoch").collect()] == [1, 3, 6, 10, 15, 21, 28]
    row = L.summary(log).first()
    assert (row.documents, row.pages, row.recent_lessons) == (7, 70, 3 + 4 + 5 + 6 + 7 + 5)
    assert L.largest_copy(spark.createDataFrame([("a", 3, True), ("b", 5, False), ("c", 5, True)], "payload string, total_documents_read int, is_local boolean")).first().payload == "c"
    assert {r.document for r in L.not_learned(spark.createDataFrame([("d1",), ("x",)], "document string"), log).collect()} == {"x"}
    assert tuple(L.learned_totals(spark.createDataFrame([("a", 1, 0), ("b", 0, 0), ("c", 0, 2)], "folder string, learned int, numeric int")).first()) == (2, 1, 2)
    aliases = L.header_aliases(spark.createDataFrame([(["Số hiệu thanh", "Đơn giá", "khác"],)], "header array<string>"))
    assert {(r.alias, r.column) for r in aliases.collect()} == {("so hieu thanh", "mark"), ("don gia", "unit_price")}


def test_reports(spark):
    files = spark.createDataFrame([("a", "audit", "- `x` one\n- `y` two\nother"), ("a", "rebar", '[{"m":1},{"m":2}]'), ("a", "tables", '{"tables":[1,2,3]}'), ("a", "markdown", "12345"), ("b", "markdown", "123")], "doc string, kind string, text string")
    m = R.doc_metrics(files)
    assert {tuple(r) for r in m.collect()} == {("a", 2, 2, 3, 5), ("b", 0, 0, 0, 3)}
    assert {r.doc: r.md_chars for r in R.with_total(m).collect()} == {"a": 5, "b": 3, "ALL": 8}
    both = R.compare(m, m.where("doc = 'a'"))
    assert {r.doc: r.md_chars_delta for r in both.collect()} == {"a": 0, "b": -3}
    totals = {r.metric: (r.base, r.other, r.change_percent) for r in R.compare_totals(both).collect()}
    assert totals["md_chars"] == (8, 5, -37.5) and R.compare_totals(R.compare(m.where("doc = 'b'"), m)).where("metric = 'rebar'").first().change_percent is None
    w = spark.createDataFrame([(1, 2, "T1", "lech_trong_luong", "m", 7, "s"), (1, 1, "T0", "khac", "n", 7, "s")], "table_id int, row int, mark string, kind string, message string, page int, sheet string")
    assert R.audit_report(w).first().text == "- `khac` T0: n\n- `Lệch trọng lượng` T1: m"
    turns = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a")], "conv_id int, turn int, role string, text string")
    assert R.transcripts(turns).first().transcript == "[user]\na\n\n[assistant]\nb"
    pages = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "doc_id int, page int, markdown string")
    assert R.full_markdown(pages).first().markdown == "## [Trang 1]\n\nx\n\n## [Trang 2]\n\ny"
    assert [tuple(r) for r in R.missing_pages(pages, pages.where("page = 1")).collect()] == [(1, 2)]
    assert {tuple(r) for r in R.upsert(pages, pages.where("page = 1").withColumn("markdown", F.lit("new")), "page").collect()} == {(1, 2, "y"), (1, 1, "new")}
    assert tuple(R.batch_status(spark.createDataFrame([("a", None, ["w"]), ("b", "e", [])], "file string, error string, warnings array<string>")).first()) == (2, 1, 1)
    low = spark.createDataFrame([(1, 1, 2, "b", 0.5), (1, 1, 1, "a", 0.25)], "doc_id int, page int, ord int, text string, score double")
    assert R.review_markdown(low).first().text == "## Trang 1\n- `a` (0.25)\n- `b` (0.50)"


def test_edge_clusters(spark):
    rng = random.Random(2)
    rows = [(g, float(rng.randrange(0, 300))) for g in range(3) for _ in range(60)]
    got = sorted((r.g, r.n, r["mean"]) for r in K.edge_clusters(spark.createDataFrame(rows, "g int, v double"), "g", "v", 3.0).collect())
    want = []
    for g in range(3):
        values = np.sort([v for k, v in rows if k == g])
        want += [(g, len(p), float(p.mean())) for p in np.split(values, np.flatnonzero(np.diff(values) > 3.0) + 1)]
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)])


def test_page_clusters(spark):
    items = spark.createDataFrame([(1, 1, i, float(x), float(x + 8), float(y), 10.0, t) for i, (x, y, t) in enumerate([(0, 10, "a"), (100, 12, "b"), (0, 30, "c"), (102, 29, "d"), (0, 52, "e")])], "doc_id int, page int, ord int, x_min double, x_max double, cy double, h double, text string")
    lines = {r.text: r.line for r in K.page_lines(items).collect()}
    assert lines == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2}
    assert {r.text: r.column for r in K.text_columns(items).collect()} == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 0}
    lined = K.page_lines(items)
    assert {(r.line, r.segment, r.text) for r in K.joined_items(K.gap_segments(lined.withColumns({"y_min": F.lit(0.0), "y_max": F.lit(1.0)}), 25.0), ["doc_id", "page", "line", "segment"]).collect()} == {(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d"), (2, 0, "e")}


def test_every_item_has_one_line():
    rng = np.random.default_rng(0)
    for _ in range(20):
        cy = rng.uniform(0, 200, 40)
        out = K.lines_of(cy, np.full(40, 10.0))
        assert len(out) == 40 and set(out) == set(range(out.max() + 1))


def test_boxes(spark):
    schema = "doc_id int, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string, score double, cut boolean"
    boxes = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0, "long text", 0.9, False), (1, 1, 1, 1.0, 1.0, 10.0, 10.0, "short", 0.99, False), (1, 1, 2, 0.0, 0.0, 9.0, 10.0, "long text cut", 0.9, True), (1, 1, 3, 20.0, 0.0, 30.0, 10.0, "other", 0.5, True)], schema)
    assert [r.ord for r in K.deduplicated_boxes(boxes).collect()] == [0, 3]
    assert {r.ord for r in K.overlap_anti(boxes.where("ord = 0"), boxes.where("ord > 0")).collect()} == {3}
    cells = spark.createDataFrame([(1, 1, float(c * 50), float(r * 20), float(c * 50 + 48), float(r * 20 + 18)) for r in range(3) for c in range(2)] + [(1, 1, 500.0, 500.0, 510.0, 510.0)], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    grid = K.ruled_tables(cells).collect()
    assert len(grid) == 1 and grid[0].n_cells == 6 and len(grid[0].row_edges) == 4 and len(grid[0].col_edges) == 3


def test_touching_groups_against_all_pairs():
    rng = np.random.default_rng(1)
    x0, y0 = rng.uniform(0, 100, 60), rng.uniform(0, 100, 60)
    x1, y1 = x0 + rng.uniform(1, 10, 60), y0 + rng.uniform(1, 10, 60)
    got = K.touching_groups(x0, y0, x1, y1, 1.0)
    near = (x0[:, None] - 1 <= x1) & (x0 - 1 <= x1[:, None]) & (y0[:, None] - 1 <= y1) & (y0 - 1 <= y1[:, None])
    reach = near.copy()
    for _ in range(60):
        reach = reach | (reach.astype(int) @ near.astype(int) > 0)
    assert ((got[:, None] == got) == reach).all()


def test_lines_and_directions(spark):
    lines = spark.createDataFrame([(1, 1, 0, 10.0, 10.0), (1, 1, 1, 24.0, 10.0), (1, 1, 2, 200.0, 10.0)], "doc_id int, page int, line int, cy double, h double")
    assert {r.line: r.key_line for r in K.nearest_key_line(lines, lines.where("line = 0")).collect()} == {0: 0, 1: 0, 2: None}
    chars = spark.createDataFrame([(1, 1, 0, i, float(i), 0.0) for i in range(5)] + [(1, 2, 0, i, 0.0, float(i)) for i in range(5)], "doc_id int, page int, line int, ord int, x double, y double")
    assert {r.page: r.rotation for r in K.reading_direction(chars).collect()} == {1: 0, 2: 90}
    rows = spark.createDataFrame([(1, r) for r in (1, 2, 4, 5, 9)], "g int, row int")
    assert len({r.block for r in K.row_islands(rows, "g").collect()}) == 3
