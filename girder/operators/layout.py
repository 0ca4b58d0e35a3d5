"""Pages from lines and items: kinds of pages, title blocks, stamps, metadata, tables without rules,
text (A3, D16, E9-E20, J7, J8, X2).

Predicates over a page are aggregations. Rules that consume items in turn run page by page.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.restoring import plain
from ..functions.text import count_hits, fold_key, fold_upper, has_any, is_heading, is_list_item, looks_like_tcvn3, looks_like_vni
from .tables import is_genuine_table

# Folded keys that tell a drawing, a cover, a title block (strong ones first), a stamp and tables.
DRAWING = ["MATCAT", "MATBANG", "CHITIET", "TYLE", "CAODO", "BOTRI", "COTTHEP", "MATDUNG", "TRUCCAU", "LYTRINH"]
COVER = ["HOSOTHIETKE", "BAOCAO", "THUYETMINH", "DUANDAUTU", "TAPBANVE"]
TITLE_STRONG = ["TENBANVE", "BANVESO", "SOHIEUBANVE", "CHUDAUTU", "CHUNHIEM"]
TITLE_ALL = [*TITLE_STRONG, "DONVITHIETKE", "GIAIDOAN", "THEHIEN", "TYLE", "NGAY", "KIEMTRA", "GIAMDOC"]
STAMPS = ["SGTVT", "QLCLCT", "THEOVANBAN", "DATHAMDINH", "THAMTRA", "SOGIAOTHONG"]
SIGNATURES = ["NGUOILAP", "KIEMTRA", "GIAMDOC", "CHUNHIEM", "KYTEN"]
TABLE_TITLES = ["BANG", "THONGKE", "KHOILUONG"]


def page_facts(items: DataFrame) -> DataFrame:
    """By page: whether it is a drawing sheet, and whether it is a cover.

    ``items``: doc_id, page, text, page_w, page_h.
    """
    key = fold_key(F.col("text"))
    hit = lambda words: sum((F.max(F.when(key.contains(w), 1).otherwise(0)) for w in words), F.lit(0))
    facts = items.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.avg((F.length("text") > 45).cast("int")).alias("long"), (F.first("page_w") / F.first("page_h")).alias("aspect"), hit(DRAWING).alias("drawing"), hit(COVER).alias("cover"), hit(TITLE_ALL).alias("title"))
    sheet = (F.col("n") >= 15) & (F.col("long") <= 0.2) & (((F.col("aspect") >= 1.2) & (F.col("drawing") >= 2)) | (F.col("drawing") >= 4))
    cover = (F.col("page") <= 2) & (F.col("title") < 2) & (F.col("n") <= 65) & (F.col("drawing") == 0) & (F.col("cover") > 0)
    return facts.select("doc_id", "page", sheet.alias("is_cad_sheet"), cover.alias("is_cover"))


def key_values(lines: DataFrame) -> DataFrame:
    """``KEY: value`` lines of covers; a value that is missing is the next line."""
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    key, value = F.trim(F.regexp_extract("text", r"^([^:]{2,40}):", 1)), F.trim(F.regexp_extract("text", r"^[^:]{2,40}:\s*(.*)$", 1))
    found = lines.withColumn("next", F.lead("text").over(w)).where(key != "")
    return found.select("doc_id", "page", "line", key.alias("key"), F.when(value != "", value).otherwise(F.trim("next")).alias("value"))


def title_blocks(items: DataFrame) -> DataFrame:
    """By page the box around its title block: words in the lower 35 % or the right 28 % of the
    page, two or more of them and one strong."""
    key = fold_key(F.col("text"))
    words = F.filter(F.array(*map(F.lit, TITLE_ALL)), lambda w: F.contains(key, w))
    zone = items.where((F.col("cy") >= F.col("page_h") * 0.65) | (F.col("cx") >= F.col("page_w") * 0.72)).withColumn("words", words).where(F.size("words") > 0)
    found = zone.groupBy("doc_id", "page").agg(F.array_distinct(F.flatten(F.collect_set("words"))).alias("words"), F.min("x_min").alias("x0"), F.min("y_min").alias("y0"), F.max("x_max").alias("x1"), F.max("y_max").alias("y1"), F.avg("h").alias("pad"))
    strong = F.size(F.array_intersect("words", F.array(*map(F.lit, TITLE_STRONG)))) >= 1
    return found.where((F.size("words") >= 2) & strong).select("doc_id", "page", (F.col("x0") - F.col("pad")).alias("x0"), (F.col("y0") - F.col("pad")).alias("y0"), (F.col("x1") + F.col("pad")).alias("x1"), (F.col("y1") + F.col("pad")).alias("y1"))


def inside(items: DataFrame, boxes: DataFrame) -> DataFrame:
    """Ids (doc_id, page, ord) of items whose centre lies in a box of their page."""
    hit = (F.col("cx").between(F.col("x0"), F.col("x1"))) & (F.col("cy").between(F.col("y0"), F.col("y1")))
    return items.join(boxes.select("doc_id", "page", "x0", "y0", "x1", "y1"), ["doc_id", "page"]).where(hit).select("doc_id", "page", "ord").distinct()


def stamp_items(page: pd.DataFrame, rounds: int = 3, reach: float = 16.0) -> list[bool]:
    """Items of a page's stamp: an anchor's neighbours, then theirs, up to three times."""
    keys = page["text"].map(lambda t: re.sub(r"[^0-9A-Z]", "", plain(t or "").upper()))
    inside_ = keys.map(lambda k: any(s in k for s in STAMPS)) & (page["text"].str.len() <= 40)
    height = float(page["h"].median()) if len(page) else 0.0
    for _ in range(rounds if inside_.any() else 0):
        part = page[inside_]
        box = part["x_min"].min() - height * 2, part["y_min"].min() - height * 2, part["x_max"].max() + height * 2, part["y_max"].max() + height * 2
        near = page["cx"].between(box[0], box[2]) & page["cy"].between(box[1], box[3]) & (page["text"].str.len() <= 40)
        if (box[3] - box[1]) > reach * height or (near | inside_).equals(inside_):
            break
        inside_ = inside_ | near
    return inside_.tolist()


def with_stamps(items: DataFrame) -> DataFrame:
    """``items`` with ``in_stamp``."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema), "in_stamp boolean"])
    return items.groupBy("doc_id", "page").applyInPandas(lambda f: f.assign(in_stamp=stamp_items(f)), schema)


_FIELDS = {"so_hieu_ban_ve": r"(?:BAN VE SO|SO HIEU(?: BAN VE)?)", "ten_ban_ve": r"TEN BAN VE", "giai_doan": r"GIAI DOAN(?: THIET KE)?", "chu_dau_tu": r"CHU DAU TU", "don_vi_thiet_ke": r"DON VI THIET KE", "chu_nhiem": r"CHU NHIEM", "the_hien": r"THE HIEN", "hang_muc": r"HANG MUC", "cong_trinh": r"CONG TRINH", "dia_diem": r"DIA DIEM"}


def metadata(lines: DataFrame) -> DataFrame:
    """By page the fields of its title block, from lines in order (doc_id, page, line, text).

    A field's value stands beside its label or in the next lines, three at most, up to another label.
    """
    folded = fold_upper(F.col("text"))
    rows = lines.withColumn("f", folded)
    any_label = "|".join(_FIELDS.values())
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    rows = rows.withColumns({"label": F.col("f").rlike(rf"(?:{any_label})"), "below": F.collect_list(F.struct(F.col("f").rlike(rf"(?:{any_label})").alias("label"), "text")).over(w.rowsBetween(1, 3))})
    end = F.coalesce(F.array_min(F.transform("below", lambda x, i: F.when(x["label"], i))), F.size("below"))
    below = F.array_join(F.transform(F.slice("below", F.lit(1), end), lambda x: x["text"]), " ")

    def field(pattern: str) -> Column:
        label = F.regexp_extract("f", pattern, 0)
        at = F.instr(F.col("f"), label)
        rest = F.regexp_replace(F.substring(F.col("text"), at + F.length(label), F.length("text")), r"^[\s:.\-|]+|[\s.\-|]+$", "")
        return F.when(F.col("f").rlike(pattern), F.nullif(F.when(rest != "", rest).otherwise(below), F.lit("")))

    date = F.regexp_extract_all("text", F.lit(r"(\d{1,2}/\d{1,2}/\d{4})"), 1)
    parts = F.split(F.element_at(date, 1), "/")
    stations = F.transform(F.regexp_extract_all("f", F.lit(r"(KM\s*\d+\s*\+\s*\d+(?:[.,]\d+)?)"), 1), lambda s: F.regexp_replace(s, r"\s+", ""))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line")))
    scale = F.nullif(F.regexp_extract("f", r"\b(1\s*[/:]\s*\d{1,4})\b", 1), F.lit(""))
    day = F.when(F.size(date) > 0, F.concat_ws("/", F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0"), parts[2]))
    return rows.groupBy("doc_id", "page").agg(
        *(first(field(p)).alias(n) for n, p in _FIELDS.items()), first(F.regexp_replace(scale, r"\s", "")).alias("ty_le"), first(day).alias("ngay"), first(F.nullif(F.regexp_extract("f", r"NAM\s*:?\s*((?:19|20)\d{2})", 1), F.lit(""))).alias("nam"),
        F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line", stations.alias("s")))), lambda x: x["s"]))).alias("ly_trinh"),
    )


def grid_titles(items: DataFrame, grids: DataFrame) -> DataFrame:
    """For each grid its title: text up to five heights above it, not far beside it; one with a
    table word before the nearest, and none that is only a number or belongs to signatures."""
    key = fold_key(F.col("text"))
    above = (F.col("y_max") <= F.col("y0") + F.col("h") * 0.5) & (F.col("y_max") >= F.col("y0") - F.col("h") * 5) & (F.col("cx") >= F.col("x0") - (F.col("x1") - F.col("x0")) * 0.1) & (F.col("cx") <= F.col("x1") + (F.col("x1") - F.col("x0")) * 0.1)
    fit = ~has_any(key, SIGNATURES) & (F.length("text") >= 3) & F.col("text").rlike(r"\p{L}")
    near = items.join(grids.select("doc_id", "page", "grid_id", "x0", "y0", "x1", "y1"), ["doc_id", "page"]).where(above & fit)
    return near.groupBy("doc_id", "page", "grid_id").agg(F.max_by("text", F.struct(has_any(key, TABLE_TITLES), "y_max", (-F.col("x_min")).alias("left"))).alias("title"))


def split_on_columns(items: DataFrame, grids: DataFrame) -> DataFrame:
    """Items with character positions that cross borders of a grid's columns, cut there; others as they are."""
    g = grids.select("doc_id", "page", "grid_id", "col_edges", "x0", "y0", "x1", "y1")
    hit = (F.col("i.doc_id") == F.col("g.doc_id")) & (F.col("i.page") == F.col("g.page")) & F.col("i.cx").between(F.col("g.x0"), F.col("g.x1")) & F.col("i.cy").between(F.col("g.y0"), F.col("g.y1"))
    both = items.alias("i").join(g.alias("g"), hit, "left").select("i.*", "g.col_edges")
    band = lambda c: F.when(F.col("col_edges").isNull(), F.lit(0)).otherwise(F.size(F.filter("col_edges", lambda e: e <= (c["x0"] + c["x1"]) / 2)))
    chars = F.when(F.size(F.coalesce("chars", F.array())) > 0, F.col("chars"))
    bands = F.array_distinct(F.transform(chars, band))
    pieces = F.transform(bands, lambda b: F.struct(F.trim(F.array_join(F.transform(F.filter(chars, lambda c: band(c) == b), lambda c: c["s"]), "")).alias("text"), F.array_min(F.transform(F.filter(chars, lambda c: band(c) == b), lambda c: c["x0"])).alias("x_min"), F.array_max(F.transform(F.filter(chars, lambda c: band(c) == b), lambda c: c["x1"])).alias("x_max")))
    whole = F.array(F.struct(F.col("text").alias("text"), F.col("x_min").alias("x_min"), F.col("x_max").alias("x_max")))
    cut = both.withColumn("__p", F.explode(F.when(F.size(bands) > 1, pieces).otherwise(whole)))
    return cut.withColumns({"text": F.col("__p.text"), "x_min": F.col("__p.x_min"), "x_max": F.col("__p.x_max")}).withColumn("cx", (F.col("x_min") + F.col("x_max")) / 2).where("text <> ''").drop("__p", "col_edges")


def keyword_tables(lines: DataFrame, reach: float = 25.0) -> DataFrame:
    """Tables without rules below a header with a table word: (doc_id, page, line, title, rows).

    ``lines``: doc_id, page, line, cy, h, texts (array of cell texts in order). Lines up to 25 heights
    below, six items or more, and no line of an earlier table; those that are a table in shape.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["cy", "line"])
        used: set[int] = set()
        out = []
        for head in page.itertuples():
            text = " ".join(head.texts)
            key = re.sub(r"[^0-9A-Z]", "", plain(text).upper())
            if head.line in used or len(text) >= 90 or not any(k in key for k in TABLE_TITLES):
                continue
            below = [r for r in page.itertuples() if head.cy < r.cy <= head.cy + reach * head.h and r.line not in used and len(r.texts) >= 2]
            if sum(len(r.texts) for r in below) >= 6:
                out.append((head.doc_id, head.page, head.line, text, [list(r.texts) for r in below]))
                used.update([head.line, *(r.line for r in below)])
        return pd.DataFrame(out, columns=["doc_id", "page", "line", "title", "rows"])

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    found = lines.groupBy("doc_id", "page").applyInPandas(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, line {kinds['line']}, title string, rows array<array<string>>")
    return found.where(is_genuine_table(F.col("rows")))


def two_columns(items: DataFrame) -> DataFrame:
    """By page whether its text stands in two columns: few items cross the middle, each side has its share."""
    crosses = (F.col("x_min") < F.col("page_w") * 0.48) & (F.col("x_max") > F.col("page_w") * 0.52)
    left, right = F.col("x_max") <= F.col("page_w") * 0.52, F.col("x_min") >= F.col("page_w") * 0.48
    return items.groupBy("doc_id", "page").agg(((F.count(F.lit(1)) >= 6) & (F.avg(crosses.cast("int")) <= 0.06) & (F.avg(left.cast("int")) >= 0.2) & (F.avg(right.cast("int")) >= 0.2)).alias("two_columns"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, line, text) joined into paragraphs: a heading, an item of a list or a
    line after one that ends a sentence begins a new one. Headings get ``### ``."""
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    marked = lines.withColumns({"heading": is_heading(F.col("text")), "item": is_list_item(F.col("text"))})
    begins = F.col("heading") | F.col("item") | F.coalesce(F.lag("heading").over(w), F.lit(True)) | F.lag("text").over(w).rlike(r"[.!?:;]\s*$")
    grouped = marked.withColumn("begins", begins.cast("int")).withColumn("paragraph", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", F.trim("text").alias("text")))), lambda x: x["text"]), " ")
    return grouped.groupBy("doc_id", "page", "paragraph").agg(F.concat(F.when(F.max("heading"), "### ").otherwise(""), text).alias("text"))


def rendered(of_paragraphs: DataFrame) -> DataFrame:
    """(doc_id, page, markdown): paragraphs in order."""
    return of_paragraphs.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]), "\n\n").alias("markdown"))


def legacy_kinds(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, page, text) with the code each is written in: its own, or for texts with
    odd letters the page's most frequent one, ties by name."""
    own = texts.withColumn("kind", F.when(looks_like_tcvn3(F.col("text")), "tcvn3").when(looks_like_vni(F.col("text")), "vni"))
    votes = own.where("kind is not null").groupBy("doc_id", "page", "kind").count()
    page = votes.groupBy("doc_id", "page").agg(F.max_by("kind", F.struct("count", "kind")).alias("page_kind"))
    odd = F.col("text").rlike(r"[\x80-ÿ]")
    return own.join(page, ["doc_id", "page"], "left").withColumn("kind", F.coalesce("kind", F.when(odd, F.col("page_kind")))).drop("page_kind")


def cell_lookup(cells: DataFrame, tables: DataFrame, wanted: DataFrame) -> DataFrame:
    """Text and box of wanted cells (table_id, row, col); without a box of its own the table's."""
    return wanted.join(cells, ["table_id", "row", "col"], "left").join(tables.select("table_id", F.col("bbox").alias("table_bbox")), "table_id", "left").withColumn("bbox", F.coalesce("bbox", "table_bbox")).drop("table_bbox")


def drawing_words(items: DataFrame) -> DataFrame:
    """View titles of drawing sheets, K9: in order of their place."""
    return items.where(count_hits(fold_key(F.col("text")), DRAWING) > 0).select("doc_id", "page", "text", "cy", "cx").orderBy("doc_id", "page", "cy", "cx")
