"""Numbers, units and lengths as column expressions.

Three parsers coexist on purpose, for cells of a grid (``parse_number``), for quantities anywhere in
a text (``extract_number``) and for lengths (``length_number``); they read ``1.525`` differently.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

# Units that may follow a number in a cell.
UNITS = "mm|cm|dm|m|m2|m3|m²|m³|km|kg|kg/m|kg/m3|t|tấn|T|kN|MPa|%|cái|thanh|md"
# Theoretical mass of reinforcing bars by diameter in mm, kg/m (TCVN 1651:2018).
BAR_MASS = {6: 0.222, 8: 0.395, 10: 0.617, 12: 0.888, 14: 1.208, 16: 1.578, 18: 1.998, 20: 2.466, 22: 2.984, 25: 3.853, 28: 4.834, 32: 6.313, 36: 7.990, 40: 9.870}
# Bends that stand in shape cells and are no lengths, in degrees.
BENDS = (90, 135, 180)

NUMBER_CELL = rf"(?iu)^\s*[-+]?\s*\d[\d.,\s]*\s*(?:{UNITS})?\s*$"


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` mentions it.

    Nested conditions would repeat it in the generated code, until that is too large to compile.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _null() -> Column:
    return F.lit(None).cast("double")


def _both(s: Column) -> Column:
    """A number with points and commas, of which the last is the decimal mark."""
    comma_last = F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))
    return F.when(comma_last, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))


def is_number_cell(text: Column) -> Column:
    """A sign, a number and perhaps a unit, and no two numbers."""
    return F.coalesce(text.rlike(NUMBER_CELL) & ~F.trim(text).rlike(r"\d\s+\d"), F.lit(False))


def style_votes(text: Column) -> tuple[Column, Column]:
    """Whether a cell speaks for the Vietnamese and for the US way to write numbers."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    vn = t.rlike(r"\d\.\d{3},\d+$") | t.rlike(r"(?<![\d.])\d+,\d{1,2}$") | t.rlike(r"^\d{1,3}(?:\.\d{3})+$")
    us = t.rlike(r"\d,\d{3}\.\d+$") | t.rlike(r"(?<![\d,])\d+\.\d{1,2}$")
    return F.coalesce(vn, F.lit(False)), F.coalesce(us & ~vn, F.lit(False))


def number_style(text: Column) -> Column:
    """C3, as an aggregate over the cells of a table: ``us`` if more cells speak for it, else ``vn``."""
    vn, us = style_votes(text)
    return F.when(F.count_if(us) > F.count_if(vn), "us").otherwise("vn")


def parse_number(text: Column, style: Column | str = "unknown") -> Column:
    """A cell's number in its table's style; null if it isn't one."""
    style = F.lit(style) if isinstance(style, str) else style
    sign = F.regexp_extract(text, r"^\s*([-+]?)\s*\d", 1)
    digits = F.regexp_replace(F.regexp_extract(text, r"^\s*[-+]?\s*(\d[\d.,]*)", 1), r"[.,]+$", "")

    def plain(s: Column) -> Column:
        commas, points = F.regexp_count(s, F.lit(",")), F.regexp_count(s, F.lit(r"\."))
        return (
            F.when((commas > 0) & (points > 0), _both(s))
            .when((commas > 1) | ((style == "us") & s.rlike(r"^\d{1,3}(,\d{3})+$")), F.replace(s, F.lit(","), F.lit("")))
            .when(commas > 0, F.replace(s, F.lit(","), F.lit(".")))
            .when((points > 1) | ((style == "vn") & s.rlike(r"^\d{1,3}\.\d{3}$")), F.replace(s, F.lit("."), F.lit("")))
            .otherwise(s)
        )

    return F.when(is_number_cell(text), F.concat(sign, let(digits, plain)).try_cast("double"))


def extract_number(text: Column) -> Column:
    """C4: the first number anywhere in a text; a lone comma is a decimal mark."""
    s = let(F.replace(F.trim(text), F.lit(" "), F.lit("")), lambda s: F.when(F.contains(s, F.lit(".")) & F.contains(s, F.lit(",")), _both(s)).otherwise(F.replace(s, F.lit(","), F.lit("."))))
    return F.nullif(F.regexp_extract(s, r"[-+]?\d*\.?\d+", 0), F.lit("")).try_cast("double")


def length_number(token: Column, style: Column | str = "unknown") -> Column:
    """A number as length cells write it, broken thousands included."""
    style = F.lit(style) if isinstance(style, str) else style

    def plain(t: Column) -> Column:
        commas, points = F.regexp_count(t, F.lit(",")), F.regexp_count(t, F.lit(r"\."))
        return (
            F.when(t.rlike(r"^\d+$"), t)
            .when((commas > 0) & (points > 0), _both(t))
            .when((style != "us") & t.rlike(r"^\d{1,3}(?:,\d{3})+,\d{1,2}$"), F.regexp_replace(F.regexp_replace(t, r",(\d{1,2})$", r".$1"), ",", ""))
            .when((style != "us") & t.rlike(r"^\d{1,3}(?:\.\d{3})+\.\d{1,2}$"), F.regexp_replace(t, r"\.(?=\d{3})", ""))
            .when((commas == 1) & (style != "us") & t.rlike(r",[^,]{0,2}$"), F.replace(t, F.lit(","), F.lit(".")))
            .when(commas > 0, F.replace(t, F.lit(","), F.lit("")))
            .when((style == "vn") & t.rlike(r"^\d{1,3}\.\d{3}$"), F.replace(t, F.lit("."), F.lit("")))
            .otherwise(t)
        )

    return let(let(F.trim(token), plain), lambda p: F.when(p.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)\s*$"), p.try_cast("double")))


def evaluate(expression: Column, style: Column | str = "unknown") -> Column:
    """Value of sums, differences and products with parentheses; null if broken.

    Tokens are read once from left to right. For each open parenthesis the sum of finished terms and
    the term in hand are held; what a parenthesis is worth is a factor of the term around it. One that
    isn't closed ends with the text.
    """
    tokens = F.regexp_extract_all(expression, F.lit(r"\d[\d.,]*|[-+*()]"), 0)
    level = lambda total, term: F.struct(total.alias("sum"), term.alias("term"))
    begin = level(F.lit(0.0), F.lit(1.0))
    start = F.struct(F.lit(True).alias("ok"), F.lit(True).alias("operand"), F.array(begin).alias("open"))

    def step(at: Column, token: Column) -> Column:
        top = F.element_at(at["open"], -1)
        under = F.slice(at["open"], F.lit(1), F.size(at["open"]) - 1)
        on = lambda ok, operand, open_: F.struct((at["ok"] & F.coalesce(ok, F.lit(False))).alias("ok"), F.lit(operand).alias("operand"), open_.alias("open"))
        factor = lambda levels, here, value: F.concat(levels, F.array(level(here["sum"], here["term"] * value)))
        ended = lambda sign: F.concat(under, F.array(level(top["sum"] + top["term"], F.lit(sign))))
        outer = F.element_at(under, -1)
        closed = factor(F.slice(under, F.lit(1), F.size(under) - 1), outer, top["sum"] + top["term"])
        nested = F.size(at["open"]) > 1
        return (
            F.when(~at["ok"], at)
            .when(token == "(", on(at["operand"], True, F.concat(at["open"], F.array(begin))))
            .when((token == ")") & nested, on(~at["operand"], False, closed))
            .when(token == ")", on(F.lit(False), False, at["open"]))
            .when(token == "+", on(~at["operand"], True, ended(1.0)))
            .when(token == "-", on(~at["operand"], True, ended(-1.0)))
            .when(token == "*", on(~at["operand"], True, at["open"]))
            .otherwise(let(length_number(token, style), lambda v: on(at["operand"] & v.isNotNull(), False, factor(under, top, v))))
        )

    def worth(at: Column) -> Column:
        inside = F.aggregate(F.reverse(at["open"]), F.lit(1.0), lambda value, x: x["sum"] + x["term"] * value)
        return F.when(at["ok"] & ~at["operand"], inside)

    return F.aggregate(tokens, start, step, worth)


def parse_length(raw: Column, style: Column | str = "unknown") -> Column:
    """Struct (value, kind) of a length cell; kind is number, formula, symbolic or empty."""
    style = F.lit(style) if isinstance(style, str) else style
    s = F.regexp_replace(F.lower(F.trim(raw)), r"(?U)(chieu dai|chiều dài|gom moc|gồm móc|l\s*=|cd\s*=|mm|cm|\bm\b)", "")
    s = F.regexp_replace(F.translate(s, "×x", "**"), "[–—−]", "-")
    empty = raw.isNull() | (F.trim(raw) == "")

    def read(x: Column) -> Column:
        as_struct = lambda v, kind: F.struct(v.alias("value"), kind.alias("kind"))
        formula = let(evaluate(x, style), lambda v: as_struct(v, F.when(v.isNull(), "symbolic").otherwise("formula")))
        number = let(length_number(x, style), lambda v: as_struct(v, F.when(v.isNull(), "empty").otherwise("number")))
        return F.when(x.rlike("[a-zà-ỹ]"), as_struct(_null(), F.lit("symbolic"))).when(x.rlike(r"[+*()]"), formula).otherwise(number)

    none = F.struct(_null().alias("value"), F.lit("empty").alias("kind"))
    return F.when(empty, none).otherwise(let(s, read))


def length_unit(header: Column) -> Column:
    """Unit that a column header names, else null."""
    t = F.lower(header)
    return F.when(t.contains("mm"), "mm").when(t.contains("cm"), "cm").when(t.rlike(r"(?U)\(m\)|\bm\b"), "m")


def to_metres(length: Column, unit: Column) -> Column:
    """Without a unit, over 100 is taken for millimetres."""
    return F.when(unit == "mm", length / 1000).when(unit == "cm", length / 100).when(unit == "m", length).otherwise(F.when(length > 100, length / 1000).otherwise(length))


def diameter(text: Column) -> Column:
    """A cell that is a diameter and nothing else, 0 or 3 to 60."""
    v = F.replace(F.regexp_extract(text, r"(?iu)^\s*(?:D|Φ|Ø|Đ|ñ|fi|phi)?\s*(\d+(?:[.,]\d+)?)\s*(?:mm)?\s*$", 1), F.lit(","), F.lit(".")).try_cast("double")
    return let(v, lambda x: F.when((x == 0) | x.between(3, 60), x))


def shape_segments(text: Column, style: Column | str = "unknown", dia: Column | None = None) -> Column:
    """C11: straight parts in a shape cell, without bends and the diameter."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d[\d.,]*)"), 1), lambda t: length_number(t, style))
    kept = F.filter(numbers, lambda v: v.between(40, 20000) & ~F.bround(v).isin(*map(float, BENDS)))
    return kept if dia is None else F.filter(kept, lambda v: F.coalesce(~((dia != 0) & (F.abs(v - dia) < 0.5)), F.lit(True)))


def bar_mass(dia: Column) -> Column:
    """kg/m by diameter; d²/162 for one that has no row."""
    table = F.create_map(*(F.lit(x) for d, kg in BAR_MASS.items() for x in (d, kg)))
    return F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, _: k == dia)), F.lit(0)), dia * dia / F.lit(162.0))


def bar_mass_join(spark, df, dia: str):
    """C12 for large tables: a broadcast join with the fixed table of 14 rows, as ``unit_mass``."""
    table = spark.createDataFrame(list(BAR_MASS.items()), f"`{dia}` int, table_mass double")
    return df.join(F.broadcast(table), dia, "left").withColumn("unit_mass", F.coalesce("table_mass", F.col(dia) * F.col(dia) / F.lit(162.0))).drop("table_mass")


# What readers of scans take for digits, in texts without marks, and what it stands for;
# in this order. Digits for letters with marks, diameters, Roman numbers and fractions.
LOOKALIKES = [
    (r"(?<=\d)[oO]|[oO](?=\d)", "0"),
    (r"\b[sS]6\b", "so"),
    (r"\b[nN]g6\b", "ngo"),
    (r"\b[pP]h6\b", "pho"),
    (r"\b[bB]0\b", "bo"),
    (r"\b[mM]6\b", "mo"),
    (r"\b[dD][06]\b", "do"),
    (r"\b[cC]6\b", "co"),
    (r"\b[hH]8\b", "ho"),
    (r"\b[tT]6\b", "to"),
    (r"\b[lL]6\b", "lo"),
    (r"(?i)\b16\s*(khoan|lo)\b", "lo $1"),
    (r"(?i)\b(so|co so)\s+16\b", "$1 lo"),
    (r"(?i)\b1op\b", "lop"),
    (r"(?i)\bty\s*11\b", "tyle"),
    (r"(?i)\b2\s*lupo?i?\s*thep\b", "2 luoi thep"),
    (r"(?i)dan\s*0\s*100", "dan o 100"),
    (r"(?<=[A-Za-z])[068](?![0-9])", ""),
    (r"(?<![0-9])[068](?=[A-Za-z])", ""),
    (r"(?<=[A-Za-z])1(?=[A-Za-z])", ""),
    (r"\b1(?=[a-zA-Z]{2,})", ""),
    (r"(?i)(?<=CHOT\s)0(?=(?:1[02468]|2[0258]|32)\b)", ""),
    (r"(?i)(?<=CHOT)0(?=(?:1[02468]|2[0258]|32)\b)", ""),
    (r"(?i)(?<=THEP\s)0(?=(?:1[02468]|2[0258]|32)\b)", ""),
    (r"(?i)(?<=THEP)0(?=(?:1[02468]|2[0258]|32)\b)", ""),
    (r"\b0(?=(?:1[02468]|2[0258]|32)\b)", ""),
    (r"I\s*-\s*1\b", "I-I"),
    (r"\((\d)1(\d)\)", "($1/$2)"),
    (r"^\s*1\.\s*(?=[A-Za-z])", ""),
    (r"\b1=(?=\d)", "l="),
]
# Powers that are written small.
_SMALL = ("²³¹⁰⁴⁵⁶⁷⁸⁹", "2310456789")


def digit_fingerprint(text: Column) -> Column:
    """Digits of a text, without marks of formulas and with what looks like a digit read as what it stands for."""
    s = fold(F.translate(F.regexp_replace(F.regexp_replace(text, r"\\[a-zA-Z]+", " "), r"[{}_$]", " "), *_SMALL))
    for pattern, meant in LOOKALIKES:
        s = F.regexp_replace(s, pattern, meant)
    return F.regexp_replace(s, r"[^0-9]", "")


def canonical_value(value: Column) -> Column:
    """A9 for doubles: whole numbers without a point, others with ten significant digits."""
    text = F.format_string("%.10f", value)
    trimmed = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(value == F.floor(value), F.format_string("%d", value.cast("long"))).otherwise(trimmed)


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)
