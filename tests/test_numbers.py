"""Numbers, units and lengths against hand-made values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from girder.functions import numbers as N


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("text,want", [("1.525,81", True), ("250 kg", True), ("-3,5 m", True), ("Ghi chú", False), ("12 34", False), ("", False), (None, False)])
def test_number_cell(spark, text, want):
    assert value(spark, text, N.is_number_cell) is want


@pytest.mark.parametrize("text,style,want", [("1.525,81", "vn", 1525.81), ("1.525", "vn", 1525.0), ("25,50", "vn", 25.5), ("1,525.81", "us", 1525.81), ("1,525", "us", 1525.0), ("1.525", "us", 1.525), ("12.", "vn", 12.0), ("-1.234.567", "vn", -1234567.0), ("Ghi chú", "unknown", None)])
def test_parse_number(spark, text, style, want):
    assert value(spark, text, lambda c: N.parse_number(c, style)) == want


def test_three_parsers_differ(spark):
    assert value(spark, "1.525", lambda c: N.parse_number(c, "vn")) == 1525.0
    assert value(spark, "1.525", lambda c: N.parse_length(c, "vn"))["value"] == 1525.0
    assert value(spark, "1.525", N.extract_number) == 1.525
    assert value(spark, "about 12,5 kg", N.extract_number) == 12.5 and value(spark, "none", N.extract_number) is None


@pytest.mark.parametrize("cells,want", [(["1.525,81", "25,50"], "vn"), (["1,525.81", "25.50"], "us"), (["abc"], "vn"), (["25.50", "25,50"], "vn")])
def test_style(spark, cells, want):
    assert spark.createDataFrame([(c,) for c in cells], "t string").agg(N.number_style(F.col("t")).alias("s")).first().s == want


@pytest.mark.parametrize(
    "text,want",
    [("1200+2*300+2*150", (2100.0, "formula")), ("2x300", (600.0, "formula")), ("(1200+300)*2", (3000.0, "formula")), ("2000", (2000.0, "number")), ("L=2000mm", (2000.0, "number")), ("2,5", (2.5, "number")), ("a+2b", (None, "symbolic")), ("1200+", (None, "symbolic")), ("7,900,00", (7900.0, "number")), ("8.467.00", (8467.0, "number")), ("7.900,00", (7900.0, "number")), ("1,234,567", (1234567.0, "number")), ("", (None, "empty")), (None, (None, "empty"))],
)
def test_length(spark, text, want):
    got = value(spark, text, lambda c: N.parse_length(c, "vn"))
    assert (got["value"], got["kind"]) == want


@pytest.mark.parametrize("expression,want", [("2*(3+4*(5-1))", 38.0), ("10-2-3", 5.0), ("2*3+4*5", 26.0), ("(1+2", 3.0), ("1+)", None), ("1 2", None), ("*2", None), ("", None), (")(", None)])
def test_expression(spark, expression, want):
    assert value(spark, expression, N.evaluate) == want


def test_expressions_against_python(spark):
    """Random expressions, whole and broken, read as Python reads them."""
    rng = random.Random(7)

    def made(depth):
        kind = rng.randrange(5) if depth else 0
        if kind < 2:
            return str(rng.randrange(1, 90))
        return f"({made(depth - 1)})" if kind == 2 else f"{made(depth - 1)}{rng.choice('+-*')}{made(depth - 1)}"

    texts = [made(5) for _ in range(300)]
    texts += ["".join(c for c in t if rng.random() > 0.08) for t in texts if re.search("[-+*(]", t)]

    def plain(text):
        depth = lowest = 0
        for c in text:
            depth += (c == "(") - (c == ")")
            lowest = min(lowest, depth)
        if lowest < 0 or not text or re.search(r"(^|[-+*(])[-+*]|\(\)|[\d)]\(|\)\d", text) or not re.search(r"[\d)]$", text):
            return None
        return float(eval(text + ")" * depth))

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.evaluate(F.col("t")).alias("v")).collect()
    assert all(r.v == plain(r.t) for r in rows) and sum(r.v is None for r in rows) > 20


@pytest.mark.parametrize("length,unit,want", [(2100.0, "mm", 2.1), (250.0, "cm", 2.5), (3.0, "m", 3.0), (2500.0, None, 2.5), (2.5, None, 2.5)])
def test_metres(spark, length, unit, want):
    assert spark.createDataFrame([(length, unit)], "l double, u string").select(N.to_metres(F.col("l"), F.col("u")).alias("v")).first().v == pytest.approx(want)


@pytest.mark.parametrize("text,want", [("D12", 12.0), ("Φ16", 16.0), ("phi 20 mm", 20.0), ("0,888", None), ("00", 0.0), ("BETON30", None), ("61", None)])
def test_diameter(spark, text, want):
    assert value(spark, text, N.diameter) == want


def test_segments_and_mass(spark):
    assert value(spark, "16 1200 300 300 150 150 90", lambda c: N.shape_segments(c, "vn", F.lit(16))) == [1200, 300, 300, 150, 150]
    rows = spark.createDataFrame([(16,), (17,)], "d int")
    assert [r.m for r in rows.select(N.bar_mass(F.col("d")).alias("m")).collect()] == pytest.approx([1.578, 17 * 17 / 162])
    assert sorted(r.unit_mass for r in N.bar_mass_join(spark, rows, "d").collect()) == pytest.approx([1.578, 17 * 17 / 162])


def test_units_and_fingerprint(spark):
    assert [value(spark, h, N.length_unit) for h in ("CD (MM)", "L (cm)", "TONG (M)", "SO LUONG")] == ["mm", "cm", "m", None]
    assert value(spark, "D1O5 c6 \\times 2", N.digit_fingerprint) == "1052"
    assert [value(spark, v, lambda c: N.canonical_value(c.cast("double"))) for v in ("1525", "1525.81", "-0.5")] == ["1525", "1525.81", "-0.5"]
