"""Audit of bar schedules and bills of quantities.

A table is one row, and all of its audit is done in that row by array functions: columns get their
roles from folded headers or, where headers can't be trusted, from the cells; units are tried out;
cells are read, diameters carried and sums made. What comes out is exploded once. Nothing is joined,
shuffled or kept, and the source is read once for each result that is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import BAR_MASS, diameter, extract_number, length_unit, let, parse_length, shape_segments, to_metres
from .tables import all_columns, first_column, folded_header

# Folded header words of each role; marks in order of preference.
MARK = ["KY HIEU", "TEN THANH", "SO HIEU", "MARK", "STT"]
DIAMETER = ["DUONG KINH", "DRONG KINH", "DK", "PHI", "FI", "DIA", "D (MM)", "D(MM)", "D="]
LENGTH = ["CHIEU DAI", "CHIEU DI", "CD (MM)", "CD(MM)", "CD (M)", "LENGTH", "L (MM)", "L(MM)"]
QUANTITY = ["SO LUONG", "SO THANH", "SOLURGNG", "QTY", "SL"]
QUANTITY_TOTAL = ["T.BO", "T BO", "TBO", "TONG SO", "TOAN BO", "T. BO", "TONG", "TOTAL"]
TOTAL_LENGTH = ["TONG CHIEU DAI", "TONG CD", "TOTAL LENGTH"]
WEIGHT = ["TRONG LUONG", "KHOI LUONG", "WEIGHT", "KG"]
UNIT_WEIGHT = ["DON VI", "DONVI", "KG/M", "KG/ M", "UNIT", "/M"]
SHAPE = ["HINH DANG", "SO DO UON", "CHI TIET UON", "HINH VE", "SO DO THANH", "SHAPE", "BENDING", "HINH"]
BOQ_QUANTITY, BOQ_PRICE, BOQ_AMOUNT = ["KHOI LUONG", "KHOI LUONG THIET KE", "QTY", "KL"], ["DON GIA", "UNIT PRICE", "GIA"], ["THANH TIEN", "TOTAL AMOUNT", "TONG TIEN"]
LABELS = {
    "duong_kinh_khong_doc_duoc": "duong_kinh_khong_doc_duoc", "duong_kinh_la": "Đường kính lạ", "khai_trien_tu_hinh": "Chiều dài suy từ hình dạng", "hinh_hoc_phuc_tap": "Hình học phức tạp", "lech_trong_luong": "Lệch trọng lượng", "lech_tong_dai": "Lệch tổng chiều dài",
    "o_tong_dai_bang_0": "Ô tổng chiều dài bằng 0", "o_khoi_luong_trong": "Ô khối lượng trống", "lech_tong_bang": "Lệch tổng bảng", "tieu_de_khong_tin_cay": "Tiêu đề không tin cậy",
}

DIAMETER_PREFIX = r"(?iu)^\s*(?:D|Φ|Ø|Đ|phi)\s*\d+"
DIAMETER_LEGEND = r"(?iu)^\s*(?:\d+\s*[<>≤≥]\s*)?[DΦØĐ]\s*(?:[<>≤≥=]\s*)?\d*\s*(?:mm)?\s*$"


class Audit(NamedTuple):
    """``warnings`` (table_id, row, mark, kind, message, col, page, sheet), ``items``, ``summary``."""

    warnings: DataFrame
    items: DataFrame
    summary: DataFrame


def _has(header: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(header, w))


def quantity_column(headers: Column) -> Column:
    """of the quantity columns the first that says it is of all parts, else the first."""
    every = all_columns(headers, QUANTITY)
    return F.coalesce(F.array_min(F.filter(every, lambda i: _has(F.get(headers, i), QUANTITY_TOTAL))), F.array_min(every))


def _mass(dia: Column) -> Column:
    """Kilograms a metre of a bar that the table has, else null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for d, kg in BAR_MASS.items() for x in (d, kg))), F.bround(dia).cast("int"))


def _share(values: Column, holds) -> Column:
    """Share of the filled cells for which ``holds``; 0 if there are fewer than three."""
    filled = F.filter(values, lambda c: F.trim(c) != "")
    return let(filled, lambda x: F.when(F.size(x) >= 3, F.size(F.filter(x, holds)) / F.size(x)).otherwise(0.0))


def _carried(values: Column) -> Column:
    """Each value, or the last one above it that isn't null."""
    places = F.filter(F.transform(values, lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())

    def filled(x: Column) -> Column:
        until = lambda k: F.coalesce(F.get(x["at"], k + 1), F.size(x["v"]))
        runs = F.flatten(F.transform(x["at"], lambda at, k: F.array_repeat(F.get(x["v"], at), until(k) - at)))
        return F.concat(F.array_repeat(F.lit(None).cast("double"), F.coalesce(F.get(x["at"], F.lit(0)), F.size(x["v"]))), runs)

    return let(F.struct(values.alias("v"), places.alias("at")), filled)


def roles(tables: DataFrame) -> DataFrame:
    """``tables`` with the places (``c_...``) and units of their columns and the diameter that
    holds in each row (``carried``); ``trusted`` is false where the header's diameter column has none."""
    h = folded_header(F.col("header"))
    rows = F.coalesce("rows", F.array().cast("array<array<string>>"))
    own = tables.select(
        "table_id", "page", "sheet", "sheet_title", rows.alias("rows"), F.coalesce("number_style", F.lit("unknown")).alias("style"), h.alias("h")
    ).withColumns({
        "c_mark": F.coalesce(*(first_column(F.col("h"), [w]) for w in MARK)), "c_header": first_column(F.col("h"), DIAMETER), "c_len": first_column(F.col("h"), LENGTH), "c_qtys": all_columns(F.col("h"), QUANTITY),
        "c_total": first_column(F.col("h"), TOTAL_LENGTH), "c_weights": all_columns(F.col("h"), WEIGHT), "c_shape": first_column(F.col("h"), SHAPE),
    })
    column = lambda i: F.transform("rows", lambda r: F.get(r, i))
    # the column of diameters is the header's, if its cells are diameters; else the one whose cells say so most.
    marked = F.transform(F.sequence(F.lit(0), F.array_max(F.transform("rows", F.size)) - 1), lambda i: F.struct(_share(column(i), lambda c: c.rlike(DIAMETER_PREFIX)).alias("share"), i.alias("col")))
    best = F.array_max(F.filter(marked, lambda x: x["share"] >= 0.6))["col"]
    named = _share(column(F.col("c_header")), lambda c: diameter(c).isNotNull()) >= 0.5
    has_cells = F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0)) > 0
    own = own.withColumn("c_dia", F.when(F.col("c_header").isNotNull() & named, F.col("c_header")).when(has_cells, F.coalesce(best, "c_header")).otherwise(F.col("c_header")))
    own = own.withColumns({"trusted": F.col("c_header").isNull() | F.col("c_dia").eqNullSafe(F.col("c_header")), "carried": _carried(F.transform("rows", lambda r: diameter(F.get(r, F.col("c_dia")))))})
    # a weight column whose cells are the mass of a metre isn't the column of weights.
    pairs = lambda i: F.filter(F.zip_with(F.transform("carried", _mass), F.transform("rows", lambda r: extract_number(F.get(r, i))), lambda m, v: F.struct(m.alias("m"), v.alias("v"))), lambda x: x["m"].isNotNull() & x["v"].isNotNull())
    of_metre = lambda i: let(pairs(i), lambda x: (F.size(x) >= 3) & (F.size(F.filter(x, lambda y: F.abs(y["v"] - y["m"]) / y["m"] <= 0.06)) >= 0.6 * F.size(x)))
    good = F.filter("c_weights", lambda i: ~_has(F.get("h", i), UNIT_WEIGHT) & ~of_metre(i))
    weight = let(good, lambda g: F.coalesce(F.array_min(F.filter(g, lambda i: F.contains(F.get("h", i), F.lit("TONG")))), F.array_min(g), F.array_min("c_weights")))
    at = lambda c: F.get("h", F.col(c))
    own = own.withColumns({"c_qty": quantity_column(F.col("h")), "c_weight": F.when(F.size("c_weights") > 0, weight), "len_unit": length_unit(at("c_len")), "total_unit": length_unit(at("c_total"))})
    return _with_units(own).drop("c_weights", "h")


#: Units of a length and of a total length, in the order in which they are tried.
_UNITS = [(length, total) for length in ("mm", "cm", "m") for total in ("m", "mm", "cm", None)]


def _with_units(own: DataFrame) -> DataFrame:
    """units that headers don't name, from the units that make most rows consistent."""
    both = F.col("c_total").isNotNull() & F.col("c_weight").isNotNull()
    open_ = F.col("c_len").isNotNull() & (F.col("len_unit").isNull() | (F.col("c_total").isNotNull() & F.col("total_unit").isNull()))
    cell = lambda r, c: F.get(r, F.col(c))

    def sample(r: Column, dia: Column) -> Column:
        quantities = F.filter(F.transform("c_qtys", lambda i: extract_number(F.get(r, i))), lambda q: q > 0)
        return F.struct(dia.alias("dia"), parse_length(cell(r, "c_len"), F.col("style")).alias("l"), quantities.alias("q"), F.coalesce(parse_length(cell(r, "c_total"), F.col("style"))["value"], F.lit(0.0)).alias("tl"), F.coalesce(extract_number(cell(r, "c_weight")), F.lit(0.0)).alias("w"), _mass(dia).alias("mass"))

    rows = F.filter(F.zip_with("rows", "carried", sample), lambda x: F.coalesce((x["l"]["value"] > 0) & (x["l"]["kind"] != "symbolic") & x["dia"].isNotNull() & (F.size(x["q"]) > 0) & ((x["tl"] != 0) | (x["w"] != 0)), F.lit(False)))
    grid = F.array(*(F.struct(F.lit(-i).alias("i"), F.lit(ul).alias("ul"), F.lit(ut).cast("string").alias("ut")) for i, (ul, ut) in enumerate(_UNITS)))
    may = F.filter(grid, lambda u: (F.col("len_unit").isNull() | (u["ul"] == F.col("len_unit"))) & F.when(F.col("total_unit").isNotNull(), u["ut"].eqNullSafe(F.col("total_unit"))).when(F.col("c_total").isNull(), u["ut"].isNull()).otherwise(u["ut"].isNotNull()))

    def points(x: Column, u: Column) -> Column:
        metres = to_metres(x["l"]["value"], u["ul"])
        by_total = (x["tl"] != 0) & u["ut"].isNotNull() & F.exists(x["q"], lambda q: F.abs(metres * q - to_metres(x["tl"], u["ut"])) <= 0.03 * metres * q + 0.011)
        by_weight = (x["w"] != 0) & x["mass"].isNotNull() & F.exists(x["q"], lambda q: F.abs(metres * q * x["mass"] - x["w"]) <= 0.08 * x["w"])
        return F.when(by_total, 1).otherwise(0) + F.when(by_weight, 1).otherwise(0)

    def found(tried: Column) -> Column:
        best = F.array_max(F.transform(may, lambda u: F.struct(F.aggregate(tried, F.lit(0), lambda n, x: n + points(x, u)).alias("score"), u["i"].alias("i"), u["ul"].alias("ul"), u["ut"].alias("ut"))))
        need = F.greatest(F.lit(3.0), 0.5 * F.size(tried) * F.when(both, 2).otherwise(1))
        return F.when(F.size(tried) >= 3, let(best, lambda b: F.when(b["score"] >= need, b)))

    out = own.withColumn("u", F.when(open_, let(rows, found)))
    return out.withColumns({"len_unit": F.coalesce("u.ul", "len_unit"), "total_unit": F.when(F.col("u").isNotNull(), F.col("u.ut")).otherwise(F.col("total_unit"))}).drop("u", "c_qtys")


def _with_fields(structs: Column, fields: Callable[[Column], dict[str, Column]]) -> Column:
    """Each struct of an array with more fields, which are made from those that it has."""
    return F.transform(structs, lambda x: reduce(lambda made, new: made.withField(*new), fields(x).items(), x))


def _bars(own: DataFrame) -> DataFrame:
    """``own`` (see ``roles``) with ``bars``: for each row that has a diameter what its cells say and come to."""
    cell = lambda r, c: F.get(r, F.col(c))

    def read(x: Column, i: Column) -> Column:
        r = x["rows"]
        return F.struct(
            (i + 1).alias("row"), F.coalesce(cell(r, "c_mark"), F.concat(F.lit("Thanh "), (i + 1).cast("string"))).alias("mark"), r.alias("cells"), diameter(cell(r, "c_dia")).alias("own"), x["carried"].alias("carried"),
            parse_length(cell(r, "c_len"), F.col("style")).alias("l"), extract_number(cell(r, "c_qty")).alias("qty"), extract_number(cell(r, "c_weight")).alias("weight"),
        )

    def sized(x: Column) -> dict[str, Column]:
        # A merged diameter cell holds for the rows below it that have data.
        return {"d": F.bround(F.coalesce(x["own"], F.when(x["l"]["value"].isNotNull() | x["qty"].isNotNull(), x["carried"]))).cast("int")}

    def shaped(x: Column) -> dict[str, Column]:
        vague = x["l"]["value"].isNull() | (x["l"]["kind"] == "symbolic")
        return {"parts": F.when(vague & F.col("c_shape").isNotNull() & (x["d"] > 0), shape_segments(cell(x["cells"], "c_shape"), F.col("style"), x["d"]))}

    def long(x: Column) -> dict[str, Column]:
        def of(total: Column) -> Column:
            fits = F.coalesce((F.size(x["parts"]) >= 2) & total.between(100, 30000), F.lit(False))
            unit = F.col("len_unit")
            return F.when(fits, F.struct(total.alias("value"), F.lit("from_shape").alias("kind"), F.lit("mm").alias("unit"))).otherwise(F.struct(x["l"]["value"].alias("value"), x["l"]["kind"].alias("kind"), unit.alias("unit")))

        return {"length": let(F.aggregate(x["parts"], F.lit(0.0), lambda n, p: n + p), of)}

    def computed(x: Column) -> dict[str, Column]:
        return {"metres": F.when((x["d"] > 0) & (x["length"]["value"] > 0) & (x["qty"] > 0), to_metres(x["length"]["value"], x["length"]["unit"]))}

    def run(x: Column) -> dict[str, Column]:
        total = F.when(x["metres"].isNotNull(), parse_length(cell(x["cells"], "c_total"), F.col("style"))["value"])
        return {"run": x["metres"] * x["qty"], "calc": x["metres"] * x["qty"] * F.coalesce(_mass(x["d"]), x["d"] * x["d"] / F.lit(162.0)), "tl": total}

    def totalled(x: Column) -> dict[str, Column]:
        return {"tlm": F.when(x["tl"] > 0, to_metres(x["tl"], F.coalesce("total_unit", "len_unit")))}

    first = F.transform(F.when(F.col("trusted"), F.arrays_zip("rows", "carried")).otherwise(F.array().cast("array<struct<rows:array<string>,carried:double>>")), read)
    bars = F.filter(_with_fields(first, sized), lambda x: x["d"].isNotNull())
    for stage in (shaped, long, computed, run, totalled):
        bars = _with_fields(bars, stage)
    return own.withColumns({"bars": bars, "n_rows": F.size("rows")}).drop("rows", "carried")


def _flags(x: Column) -> Column:
    """Warnings of a bar."""
    bad, shaped = x["d"] <= 0, x["length"]["kind"] == "from_shape"
    cell = lambda c: F.coalesce(F.get(x["cells"], F.col(c)), F.lit(""))
    off = lambda a, b, of: F.abs(a - b) / of
    symbolic = ~bad & (x["length"]["kind"] == "symbolic") & ~F.coalesce(F.get(x["cells"], F.col("c_len")).rlike(DIAMETER_LEGEND), F.lit(False))
    weighed = x["metres"].isNotNull() & (x["weight"] > 0)
    checks = [
        (bad, "duong_kinh_khong_doc_duoc", "c_dia", F.concat(F.lit("diameter can't be read: "), cell("c_dia"))),
        (~bad & ~x["d"].isin(*BAR_MASS), "duong_kinh_la", "c_dia", F.concat(F.lit("diameter not in the table of bars: "), x["d"].cast("string"))),
        (~bad & shaped, "khai_trien_tu_hinh", "c_shape", F.format_string("length %.0f mm from %d parts of the shape", x["length"]["value"], F.size(x["parts"]))),
        (symbolic, "hinh_hoc_phuc_tap", "c_len", F.concat(F.lit("length is a formula with letters: "), cell("c_len"))),
        (weighed & (off(x["weight"], x["calc"], x["weight"]) > 0.08), "lech_trong_luong", "c_weight", F.format_string("%.1f kg given, %.1f kg computed", x["weight"], x["calc"])),
        (x["tlm"].isNotNull() & (off(x["tlm"], x["run"], F.greatest(x["tlm"], x["run"])) > 0.08), "lech_tong_dai", "c_total", F.format_string("%.2f m given, %.2f m computed", x["tlm"], x["run"])),
        (x["tl"] == 0, "o_tong_dai_bang_0", "c_total", F.format_string("0 given, %.2f m computed", x["run"])),
    ]
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), _warning(x["row"], x["mark"], kind, message, F.col(col))) for c, kind, col, message in checks)), lambda w: w.isNotNull())


def _warning(row: Column, mark: Column, kind: str, message: Column, col: Column) -> Column:
    return F.struct(row.cast("int").alias("row"), mark.alias("mark"), F.lit(kind).alias("kind"), message.alias("message"), col.cast("int").alias("col"))


def audit_rebar(tables: DataFrame) -> Audit:
    """warnings, bar items and sums of bar schedules.

    ``tables``: table_id, header, rows, number_style, page, sheet, sheet_title. Rows are numbered
    from 1; warnings of a whole table have row 0. A table without rows has sums of nothing.
    """
    of = _bars(roles(tables))
    total = lambda value, which=None: F.aggregate(F.transform(F.col("bars") if which is None else F.filter("bars", which), value), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    weighed = lambda x: x["metres"].isNotNull() & (x["weight"] > 0)
    blank = lambda x: x["metres"].isNotNull() & F.col("c_weight").isNotNull() & (F.coalesce(x["weight"], F.lit(0.0)) == 0)
    bucket = lambda low, high: total(lambda x: x["calc"], lambda x: (x["d"] > low) & (x["d"] <= high))
    of = of.withColumns({"reported": total(lambda x: x["weight"], weighed), "compared": total(lambda x: x["calc"], weighed), "blanks": F.filter("bars", blank)})
    none = F.lit(None)
    few = (F.col("reported") > 0) & (F.size("blanks") <= F.greatest(F.lit(5), F.floor(0.3 * F.col("n_rows"))))
    unweighed = F.transform("blanks", lambda x: _warning(x["row"], x["mark"], "o_khoi_luong_trong", F.format_string("no weight given, %.1f kg computed", x["calc"]), F.col("c_weight")))
    off = (F.col("reported") > 0) & (F.col("compared") > 0) & (F.abs(F.col("reported") - F.col("compared")) / F.col("reported") > 0.05)
    table_off = _warning(F.lit(0), F.lit("TỔNG BẢNG"), "lech_tong_bang", F.format_string("%.1f kg given in all, %.1f kg computed", F.col("reported"), F.col("compared")), none)
    doubtful = _warning(F.lit(0), F.lit("TIÊU ĐỀ BẢNG"), "tieu_de_khong_tin_cay", F.lit("the header's columns can't be told; to be checked by hand"), none)
    whole = F.filter(F.array(F.when(off, table_off), F.when(~F.col("trusted"), doubtful)), lambda w: w.isNotNull())
    flags = F.concat(F.flatten(F.transform("bars", _flags)), F.when(few, unweighed).otherwise(F.slice(unweighed, 1, 0)), whole)
    warnings = of.select("table_id", "page", "sheet", F.explode(flags).alias("w")).select("table_id", "w.*", "page", "sheet")
    x = F.col("x")
    items = of.select("table_id", "page", "sheet", "sheet_title", F.explode(F.filter("bars", lambda b: b["metres"].isNotNull())).alias("x")).select(
        "table_id", "x.row", "x.mark", x["d"].alias("diameter"), F.bround(x["metres"] * 1000).cast("int").alias("length_mm"), F.bround(x["qty"]).cast("int").alias("quantity"), F.bround(x["calc"], 2).alias("total_weight_kg"), x["length"]["kind"].alias("length_kind"),
        F.when(F.size(x["parts"]) > 0, F.transform(x["parts"], lambda p: F.bround(p).cast("int"))).alias("shape_segments_mm"), "page", "sheet", "sheet_title",
    )
    bars = F.size(F.filter("bars", lambda b: b["metres"].isNotNull()))
    seen = F.size("bars") > 0
    r2 = lambda value: F.when(seen, F.bround(value, 2))
    summary = of.select(
        "table_id", F.when(F.size(flags) > 0, "warning").otherwise("ok").alias("status"), bars.cast("long").alias("total_bars"), r2(total(lambda b: b["calc"])).alias("calc_weight_kg"), F.when(F.col("reported") > 0, F.bround("reported", 2)).alias("reported_weight_kg"),
        r2(bucket(0, 10)).alias("d_le_10"), r2(bucket(10, 18)).alias("d_le_18"), r2(bucket(18, 10**6)).alias("d_gt_18"), F.when(seen, F.coalesce("len_unit", F.lit("auto"))).otherwise("auto").alias("length_unit"),
    )
    return Audit(warnings, items, summary)


def audit_boq(tables: DataFrame) -> Audit:
    """rows whose amount is off quantity x price by over 5 %, and the sum of amounts."""
    h = folded_header(F.col("header"))
    own = tables.select("table_id", F.coalesce("rows", F.array().cast("array<array<string>>")).alias("rows"), first_column(h, BOQ_QUANTITY).alias("q"), first_column(h, BOQ_PRICE).alias("p"), first_column(h, BOQ_AMOUNT).alias("a"))
    rows = own.select("table_id", "q", "p", "a", F.posexplode("rows").alias("row", "cells")).select("table_id", (F.col("row") + 1).alias("row"), F.col("a").alias("col"), *(extract_number(F.get("cells", F.col(c))).alias(f"v{c}") for c in "qpa")).where("vq is not null and vp is not null and va is not null")
    off = rows.where("va > 0 and abs(vq * vp - va) / va > 0.05").select("table_id", "row", F.lit("").alias("mark"), F.lit("lech_thanh_tien").alias("kind"), F.format_string("%.0f given, %.0f computed", F.col("va"), F.col("vq") * F.col("vp")).alias("message"), "col")
    sums = rows.groupBy("table_id").agg(F.bround(F.sum("va"), 2).alias("total_amount"))
    flagged = off.select("table_id").distinct().withColumn("flagged", F.lit(True))
    summary = own.select("table_id", F.size("rows").alias("total_items")).join(sums, "table_id", "left").join(flagged, "table_id", "left").select("table_id", F.when(F.col("flagged"), "warning").otherwise("ok").alias("status"), F.coalesce("total_amount", F.lit(0.0)).alias("total_amount"), "total_items")
    return Audit(off, rows, summary)


def bucket_rollup(summary: DataFrame) -> DataFrame:
    """B2, Q2: kilograms by diameter bucket over all tables, and in all."""
    long = summary.select(F.explode(F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(b).alias("kg")) for b in ("d_le_10", "d_le_18", "d_gt_18")))).alias("x")).select("x.*")
    return long.rollup("bucket").agg(F.bround(F.sum("kg"), 2).alias("kg")).select(F.coalesce("bucket", F.lit("ALL")).alias("bucket"), "kg")


def totals(items: DataFrame) -> DataFrame:
    """bars, pieces, kilograms and tonnes."""
    return items.agg(F.count(F.lit(1)).alias("bars"), F.sum("quantity").alias("pieces"), F.bround(F.sum("total_weight_kg"), 2).alias("kg"), F.bround(F.sum("total_weight_kg") / 1000, 3).alias("tonnes"))
