"""Restoring accents, merging readings, cleaning notes: golden pairs and laws."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from girder.functions import numbers as N
from girder.functions import restoring as R
from girder.functions import text as T
from girder.operators import cleaning as C


@pytest.mark.parametrize(
    "text,want",
    [("coc C1", "cọc C1"), ("dam T2", "dầm T2"), ("thep D16", "thép D16"), ("mo M1", "mố M1"), ("bang 3", "bảng 3"), ("chu dau tu", "chủ đầu tư"), ("CHU DAU TU", "CHỦ ĐẦU TƯ"), ("da thi cong", "đã thi công"), ("da hoan thanh 50%", "đã hoàn thành 50%"), ("so 1.525,81 D1000 63.36", "so 1.525,81 D1000 63.36"), ("VA GA THU NUOC", "VA GA THU NUOC")],
)
def test_restore(text, want):
    assert R.restore(text) == want


def test_safe_fixes_twice():
    rng = random.Random(1)
    for _ in range(200):
        text = " ".join(rng.choice(["bê", "tong", "cốt", "thep", "khối", "luong", "x", "12"]) for _ in range(12))
        once = R.apply_rules(text, R.SEED_SAFE)
        assert R.apply_rules(once, R.SEED_SAFE) == once
        assert [c for c in R.restore(text) if c.isdigit()] == [c for c in text if c.isdigit()]


def test_verified_and_corrections(spark):
    verified = (("mat duong nhua", "mặt đường nhựa"), ("mat duong", "mặt đường"))
    assert R.restore_line("MAT DUONG nhua va mat duong, mat\tduong", verified=verified) == "MẶT ĐƯỜNG nhựa va mặt đường, mặt\tđường"
    assert R.restore_line("chiu  lyrc 12", corrections=(("chiu lyrc", "chịu lực"), ("12", "13"))) == "chịu lực 12"
    df = spark.createDataFrame([("coc C1: a",), (None,)], "t string")
    out = df.select(R.restored(F.col("t")).alias("a"), R.typos_fixed(F.col("t")).alias("b"), R.safe_fixed(F.col("t")).alias("c"), R.corrected(F.col("t"), (("coc", "cọc"),)).alias("d")).collect()
    assert tuple(out[0]) == ("cọc C1: a", "cọc C1: a", "coc C1: a", "cọc C1: a") and tuple(out[1]) == (None,) * 4


def test_encodings(spark):
    assert R.vni("Coäng hoøa") == "Cộng hòa" and R.vni("ñöôøng") == "đường"
    assert R.vni_letters("Coäng") == [("C", [0]), ("ộ", [1, 2]), ("n", [3]), ("g", [4])] and R.vni("ùa bù") == "ùa bù"
    letters = spark.createDataFrame([("hoøa",), (None,)], "t string").select(R.vni_sources(F.col("t")).alias("v")).collect()
    assert [(x.text, x.sources) for x in letters[0].v] == [("h", [0]), ("ò", [1, 2]), ("a", [3])] and letters[1].v is None
    df = spark.createDataFrame([("C«ng tr×nh ®­êng bé",), ("Công trình đường bộ",)], "t string").select(T.tcvn3(F.col("t")).alias("u"), T.looks_like_tcvn3(F.col("t")).alias("old"))
    assert [tuple(r) for r in df.collect()][0] == ("Công trình đường bộ", True) and df.collect()[1].old is False
    assert spark.createDataFrame([("ệ",)], "t string").select(T.composed(F.col("t")).alias("c")).first().c == "ệ"


@pytest.mark.parametrize(
    "a,b,want",
    [
        ("Tong chieu dai tuyen", "Tổng chiều dài tuyến", "Tổng chiều dài tuyến"), ("Km19+529.080", "Km1945290080", "Km19+529.080"), ("Cau Km19+529", "Cầu Km1945290", "Cầu Km19+529"), ("XOP CHEN KHE", "XỐP CHèn Khe", "XỐP CHÈN KHE"),
        ("B6 tri khoan", "Bố trí khoan", "Bố trí khoan"), ("dai: 27,48Km", "dài: 27,48km", "dài: 27,48Km"), ("MATCATNGANGTRUGIAIDOAN4LANXE", "MẶT CẮT NGANG TRỤ GIAI ĐOẠN 4 LÀN XE", "MẶT CẮT NGANG TRỤ GIAI ĐOẠN 4 LÀN XE"), ("DAY20MM", "DÀY 20MM", "DÀY 20MM"),
        ("DAY20MM", "DÀY 28MM", "DAY20MM"), ("BO TRI SO LE", "BỐ TRÍ SOLE", "BỐ TRÍ SO LE"), ("THEP CHU", "THÉP TẾ CHỦ", "THÉP CHỦ"), ("D14a200", "Đường ống", "D14a200"), ("abc", "", "abc"), ("abc", "xyz", "abc"), ("", "a", ""), ("MATCATNGANG", "MẶT CẮT NGANG", "MẶT CẮT NGANG"),
    ],
)
def test_merge_readings(a, b, want):
    assert R.merge_readings(a, b) == want


def test_judge(spark):
    assert R.judge("BE TONG", "BÊ TÔNG") == (True, "BÊ TÔNG", 0.0)
    assert R.judge("D16 a200", "D18 a200") == (True, "D18 a200 ⟦OCR khác: D16 a200⟧", 0.5)
    assert R.judge("1O0 cm", "100 cm") == (True, "100 cm", 0.0) and R.judge("MAT BANG m6 M1", "MẶT BẰNG mố M1") == (True, "MẶT BẰNG mố M1", 0.0)
    assert R.judge("BE TONG", "BÊ TÔNG混") == (True, "BÊ TÔNG", 0.0) and R.judge("abc", "абв") == (False, "abc", 0.0)
    assert R.judge("THEO VAN BAN 12", "THEO VĂN BẢN 13") == (True, "THEO VĂN BẢN 13", 0.0)
    assert R.judge("kg/m", "giá trị trọng lượng (kg/m)") == (False, "kg/m", 0.0)
    texts = ["s6", "CHOT 032", "I-1", "(217)", "3OMPA", "O2KHE", "Km²", "", "1.KICH 25"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(N.digit_fingerprint(F.col("t")).alias("d")).collect()
    assert [r.d for r in got] == [R.fingerprint(t) for t in texts] == ["", "32", "", "27", "30", "02", "2", "", "25"]


def test_judge_rejects():
    assert not R.judge("BE TONG", "混凝土")[0] and not R.judge("abc", "")[0] and not R.judge("abc", "abc and much more than that")[0]


@pytest.mark.parametrize("word,want", [("hop", True), ("chinh", True), ("nguon", True), ("quip", True), ("ku", True), ("xu", True), ("upnb", False), ("yuip", False), ("iy8n", False), ("gs", False), ("ou", False), ("yui", False)])
def test_syllables(spark, word, want):
    assert spark.createDataFrame([(word,)], "t string").select(T.is_syllable(F.col("t")).alias("v")).first().v is want


def test_likeness(spark):
    df = spark.createDataFrame([("tuyến đường nối hai huyện được thiết kế mới",), ("B4-D18",), ("52@150=7800",), ("",)], "t string")
    got = [r.v for r in df.select(T.likeness(F.col("t")).alias("v")).collect()]
    assert got[0] >= 0.95 and got[1:] == [None, None, None]


def test_text_predicates(spark):
    df = spark.createDataFrame([("1. GIỚI THIỆU CHUNG",), ("PHẦN MỞ ĐẦU",), ("12.5 m",), ("công trình hay",), ("+ mục một",), ("BTCTPCCCXYZKLMNPQRST",), ("Nội dung bình thường",)], "t string")
    rows = df.select(T.is_heading(F.col("t")).alias("h"), T.is_list_item(F.col("t")).alias("l"), T.is_garbled(F.col("t")).alias("g")).collect()
    assert [r.h for r in rows] == [True, True, False, False, False, True, False]
    assert [r.l for r in rows] == [True, False, False, False, True, False, False] and [r.g for r in rows] == [False] * 5 + [True, False]
    row = spark.createDataFrame([("Chủ đầu tư : Công ty ABC",)], "t string").select(T.search_folded(F.col("t"), r"chu dau tu\s*", ".+").alias("s"), T.tokens(F.lit("Bản vẽ KC-05/A, D2")).alias("k"), T.citation(F.lit(3), F.lit(""), F.lit("Ghi chú")).alias("c"), T.cited_pages(F.lit("x [Trang 3] y [Trang 12 • a]")).alias("p"), T.clock(F.lit(125)).alias("m"), T.html_text(F.lit("<p>a &amp; b<script>x</script></p> c")).alias("x")).first()
    assert row.s == "Công ty ABC" and row.k == ["bản", "vẽ", "kc-05/a", "d2"] and row.c == "Trang 3 • Ghi chú" and row.p == [3, 12] and row.m == "02:05" and row.x == "a & b c"


def test_phrases_said_twice():
    assert C.said_once("Bê tông mác 300 đổ tại chỗ Bê tông mác 300 đổ tại chỗ") == "Bê tông mác 300 đổ tại chỗ"
    assert C.said_once("be tong mac 300 do tai cho Bê tông mác 300 đổ tại chỗ") == "Bê tông mác 300 đổ tại chỗ"
    assert C.said_once("không có gì lặp lại ở đây cả") == "không có gì lặp lại ở đây cả"
    assert C.said_once("trước khi thi công phải kiểm tra lại rồi thi công phải kiểm tra lại cao độ") == "trước khi thi công phải kiểm tra lại cao độ"
    assert C.said_once("a b c a b c") == "a b c a b c" and C.said_once("") == ""
    for n in (2, 3, 5):
        assert C.said_once(" ".join(["một hai ba bốn năm sáu bảy"] * n)) == "một hai ba bốn năm sáu bảy"


def plain_owners(keys):
    out = list(range(len(keys)))
    for i, key in enumerate(keys):
        if out[i] == i and key:
            for j in range(i + 1, len(keys)):
                if out[j] == j and keys[j] and difflib.SequenceMatcher(None, key, keys[j]).ratio() >= C.MERGE_RATIO:
                    out[j] = i
    return out


def test_owners_against_all_pairs():
    rng = random.Random(4)
    words = ["be", "tong", "mac", "cot", "thep", "duong", "kinh", "do", "tai", "cho", "300", "b25"]
    for _ in range(30):
        keys = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(25)]
        keys += ["".join(c for c in k if rng.random() > 0.1) for k in keys]
        assert C.owners(keys) == plain_owners(keys)
    many = [" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(10)) for _ in range(2000)]
    began = time.time()
    assert len(C.owners(many)) == 2000 and time.time() - began < 10


def _cleaned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, markdown string")
    return [r.cleaned for r in C.postprocessed(df).orderBy("doc_id").collect()]


def test_notes(spark):
    lines = ["- Bê tông dùng mác 300 đá 1x2", "giữa", "- Be tong dung mac 300 da 1x2", "- BTCTPCCCXYZKLMNPQRST", "- Cốt thép CB400"]
    clean = ["- Bê tông dùng mác 300 đá 1x2", "giữa", "- Cốt thép CB400"]
    md = "# A\n- x y z x y z x y z x y z\n## Ghi chú\n" + "\n".join(lines) + "\n## B\n- q\n- q"
    later = "**GHI CHÚ:**\n" + "\n".join(lines[2::-2]) + "\nGhi chú thêm\n1. abc\n2. abc\n# Ghi chú\n1. abc"
    once = _cleaned(spark, [md, later, None, "", "không có gì"])
    assert once[0] == "# A\n- x y z x y z x y z x y z\n## Ghi chú\n" + "\n".join(clean) + "\n## B\n- q\n- q"
    assert once[1] == "**GHI CHÚ:**\n- Bê tông dùng mác 300 đá 1x2\nGhi chú thêm\n1. abc\n# Ghi chú\n1. abc"
    assert once[2:] == ["", "", "không có gì"] and _cleaned(spark, once) == once


def test_review(spark):
    rows = [("⟦OCR khác: 5⟧ D16", 0.9, True), ("⟦a⟧ SGTVT", 0.9, False), ("text", 0.8, False), ("漢字", 0.3, False), ("-- *", 0.3, False), ("800", 0.6, False), ("800", 0.4, True), ("A", 0.6, False), ("10b", 0.6, False), ("D10", 0.52, False), ("Φ10 (F)", 0.5, True), ("TỶ LỆ 1/50", 0.2, False), ("khó đọc lắm", 0.5, True)]
    df = spark.createDataFrame([(1, 1, i, t, s, False, False) for i, (t, s, _) in enumerate(rows)] + [(1, 1, 99, "khó đọc", 0.1, True, False)], "doc_id long, page int, ord int, text string, score double, in_stamp boolean, in_title_block boolean")
    got = df.select("ord", C.needs_review(F.col("text"), F.col("score"), F.col("in_stamp"), F.col("in_title_block")).alias("v")).collect()
    assert {r.ord: r.v for r in got} == {i: w for i, (_, _, w) in enumerate(rows)} | {99: False}
    first = C.review_list(df, 2).first()
    assert len(first["first"]) == 2 and first.more == 2


def test_dedup(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    assert sorted((r.first_id, r.copies) for r in C.exact_dedup(docs).collect()) == [(1, 2), (3, 1)]
    seen = C.exact_dedup(docs.where("doc_id = 3"))
    assert {r.doc_id for r in C.unseen(docs, seen).collect()} == {1, 2}
    lines = spark.createDataFrame([(1, 1, "Bê tông"), (1, 2, "be  TONG"), (1, 3, "khác")], "g long, slot long, text string")
    assert {r.slot for r in C.first_by_key(lines, "g", "slot").collect()} == {1, 3}
    out = C.postprocessed(spark.createDataFrame([(1, "## Ghi chú\n- a b\n- a b")], "doc_id long, markdown string")).first()
    assert (out.lines_before, out.lines_after) == (3, 2)


def test_headings_by_words_and_folded_numbers(spark):
    df = spark.createDataFrame([("Í. Phần đầu",), ("MỤC 2 về đất",), ("1.\u00a0Abc",), ("1.\x20Abc",), ("công trình hay",)], "t string")
    rows = df.select(T.is_heading(F.col("t")).alias("h"), T.is_heading(T.plain_spaces(F.col("t")), folded=False).alias("p")).collect()
    assert [r.h for r in rows] == [True, True, True, True, False] and [r.p for r in rows] == [False, False, False, True, False]
