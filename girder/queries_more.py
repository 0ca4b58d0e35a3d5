"""More queries: readings of numbers and boxes, reports, learned tables, planted schedules.

They run operators on rows that are built from the tables at hand, so that each rule decides some
of them, and are held against the same rules in SQL. Importing this module adds them to ``QUERIES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import numbers as N
from .functions import text as T
from .operators import audit, cleaning, learning, relational, reports, retrieval, tables
from .plans import pipelines
from .queries import _FOLD, _LATIN, _MASS, _list, _read, _texts, query

# --- Schedules of which every kind of warning is true somewhere

_MM = ["Số hiệu", "Đường kính (mm)", "Chiều dài (mm)", "Số lượng", "Tổng chiều dài (m)", "Trọng lượng (kg)"]
_OPEN = ["Số hiệu", "Đường kính", "Chiều dài", "Số lượng", "Tổng chiều dài", "Trọng lượng"]
_WRONG = ["Số hiệu", "Đường kính KL đơn vị", "x", "Số lượng", "y", "Trọng lượng (kg)"]
_SHAPED = ["Số hiệu", "Đường kính (mm)", "Chiều dài (mm)", "Số lượng", "Hình dạng", "Trọng lượng (kg)"]
_ODD_ROW = "concat(l_partkey, '/', l_suppkey, '/', l_quantity, '/', l_extendedprice, '/', l_discount, '/', l_tax, '/', l_returnflag, '/', l_linestatus, '/', l_shipdate)"


def _odd_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule for each order, of one of four kinds in turn: with units, with units to be found out,
    with diameters in another column than the header says, and with shapes and formulas."""
    line = _read(spark, sf_dir, "lineitem")
    kind, n = F.col("l_orderkey") % 4, F.col("l_linenumber")
    dia = F.element_at(F.array(*(F.lit(d) for d in (10, 12, 16, 20, 25, 17))), (F.col("l_partkey") % 6 + 1).cast("int"))
    mm = (F.col("l_quantity") * 100).cast("int") + 100
    metres = mm / 1000 * n
    kg = metres * N.bar_mass(dia)
    text = lambda c: c.cast("string")
    two = lambda c: F.format_string("%.2f", c)
    mark, count, bar = F.concat(F.lit("K"), text(n)), text(n), text(dia)
    plain = F.array(mark, F.when(F.col("l_suppkey") % 9 == 0, "00").otherwise(bar), text(mm), count, F.when(F.col("l_suppkey") % 7 == 0, "0").when(F.col("l_suppkey") % 7 == 1, two(metres * 1.5)).otherwise(two(metres)), F.when(F.col("l_returnflag") == "A", two(kg)).when(F.col("l_returnflag") == "R", two(kg * 1.25)).otherwise(""))
    open_ = F.array(mark, bar, text((mm / 10).cast("int")), count, two(metres), two(kg))
    wrong = F.array(mark, F.lit("0,888"), F.concat(F.lit("D"), bar), count, F.lit(""), two(kg))
    shape = F.array(mark, bar, F.when(n % 2 == 0, "a+2b").otherwise(text(mm)), count, F.when(n % 4 == 0, "1200").otherwise(F.concat(F.lit("90 "), text(mm), F.lit(" 300 300"))), F.lit(""))
    row = F.struct("l_linenumber", F.expr(_ODD_ROW).alias("tie"), F.when(kind == 0, plain).when(kind == 1, open_).when(kind == 2, wrong).otherwise(shape).alias("cells"))
    made = line.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["cells"]).alias("rows"))
    header = lambda h: F.array(*map(F.lit, h))
    of = F.col("table_id") % 4
    return made.withColumns({"header": F.when(of == 0, header(_MM)).when(of == 1, header(_OPEN)).when(of == 2, header(_WRONG)).otherwise(header(_SHAPED)), "title": F.lit("Thống kê cốt thép"), "number_style": F.lit("us"), "page": (F.col("table_id") % 50).cast("int"), "sheet": F.lit(""), "sheet_title": F.lit("")})


_ODD_SQL = f"""
WITH mass(d, kg) AS (VALUES {_MASS}),
base AS (SELECT l_orderkey AS t, l_orderkey % 4 AS k, l_linenumber AS q, [10, 12, 16, 20, 25, 17][l_partkey % 6 + 1] AS d0, CAST(l_quantity * 100 AS INTEGER) + 100 AS mm, l_suppkey AS s, l_returnflag AS f,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, concat(l_partkey, '/', l_suppkey, '/', l_quantity, '/', l_extendedprice, '/', l_discount, '/', l_tax, '/', l_returnflag, '/', l_linestatus, '/', l_shipdate)) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
kgs AS (SELECT base.*, mm / 1000.0 * q AS metres, mm / 1000.0 * q * coalesce(kg, d0 * d0 / 162.0) AS kg FROM base LEFT JOIN mass ON d = d0),
said AS (SELECT *, CASE WHEN k = 0 AND s % 9 = 0 THEN 0 ELSE d0 END AS d, CASE WHEN k <> 0 OR s % 7 > 1 THEN round(metres, 2) WHEN s % 7 = 0 THEN 0 ELSE round(metres * 1.5, 2) END AS tl,
  CASE WHEN k = 3 THEN NULL WHEN k <> 0 OR f = 'A' THEN round(kg, 2) WHEN f = 'R' THEN round(kg * 1.25, 2) END AS w FROM kgs WHERE k <> 2),
shaped AS (SELECT *, k = 3 AND q % 2 = 0 AS vague, k = 3 AND q % 2 = 0 AND q % 4 <> 0 AS expanded,
  CASE WHEN k = 3 AND q % 2 = 0 THEN CASE WHEN q % 4 <> 0 THEN (mm + 600) / 1000.0 END WHEN k = 1 AND n < 3 THEN CASE WHEN mm / 10 > 100 THEN mm / 10000.0 ELSE mm / 10.0 END ELSE mm / 1000.0 END AS len FROM said),
rows AS (SELECT r.*, r.d > 0 AND len > 0 AS computed, len * q AS run, len * q * coalesce(m.kg, r.d * r.d / 162.0) AS calc FROM shaped r LEFT JOIN mass m ON m.d = r.d),
sums AS (SELECT t, n, sum(w) FILTER (computed AND w > 0) AS reported, sum(calc) FILTER (computed AND w > 0) AS compared, count(*) FILTER (computed AND coalesce(w, 0) = 0) AS blank FROM rows GROUP BY t, n)"""


def _open_total() -> str:
    """Metres of a total length cell: with units to be found out and under three rows, by its size."""
    return "CASE WHEN k = 1 AND n < 3 THEN CASE WHEN tl > 100 THEN tl / 1000 ELSE tl END ELSE tl END"


@query(f"""{_ODD_SQL}
SELECT kind, count(*) AS n FROM (
  SELECT 'duong_kinh_khong_doc_duoc' AS kind FROM rows WHERE d = 0
  UNION ALL SELECT 'duong_kinh_la' FROM rows WHERE d = 17
  UNION ALL SELECT 'khai_trien_tu_hinh' FROM rows WHERE d > 0 AND expanded
  UNION ALL SELECT 'hinh_hoc_phuc_tap' FROM rows WHERE d > 0 AND vague AND NOT expanded
  UNION ALL SELECT 'lech_trong_luong' FROM rows WHERE computed AND w > 0 AND abs(w - calc) / w > 0.08
  UNION ALL SELECT 'lech_tong_dai' FROM rows WHERE computed AND k < 2 AND tl > 0 AND abs({_open_total()} - run) / greatest({_open_total()}, run) > 0.08
  UNION ALL SELECT 'o_tong_dai_bang_0' FROM rows WHERE computed AND k < 2 AND tl = 0
  UNION ALL SELECT 'o_khoi_luong_trong' FROM rows JOIN sums USING (t, n) WHERE computed AND coalesce(w, 0) = 0 AND reported > 0 AND blank <= greatest(5, floor(0.3 * n))
  UNION ALL SELECT 'lech_tong_bang' FROM sums WHERE reported > 0 AND compared > 0 AND abs(reported - compared) / reported > 0.05
  UNION ALL SELECT 'tieu_de_khong_tin_cay' FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 4 = 2 GROUP BY 1 HAVING count(*) >= 3)) GROUP BY 1""")
def audit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of warning, with units and columns to be found out."""
    return audit.audit_rebar(_odd_schedules(spark, sf_dir)).warnings.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_BILL = ["Hạng mục", "Khối lượng", "Đơn giá", "Thành tiền"]


@query("""
WITH r AS (SELECT l_orderkey AS t, l_quantity AS q, floor(l_extendedprice / l_quantity) AS p, CASE l_returnflag WHEN 'A' THEN q * p WHEN 'R' THEN floor(q * p * 1.1) END AS a FROM lineitem),
s AS (SELECT t, count(*) AS n, coalesce(round(sum(a), 2), 0) AS total, count(*) FILTER (a > 0 AND abs(q * p - a) / a > 0.05) AS off FROM r GROUP BY t)
SELECT CASE WHEN off > 0 THEN 'warning' ELSE 'ok' END AS status, count(*) AS bills, sum(n)::BIGINT AS items, round(sum(total), 0) AS total_amount FROM s GROUP BY 1""")
def boq_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bills of quantities, from cells as text to their sums; a bill for each order."""
    q, p = F.col("l_quantity"), F.floor(F.col("l_extendedprice") / F.col("l_quantity"))
    amount = F.when(F.col("l_returnflag") == "A", q * p).when(F.col("l_returnflag") == "R", F.floor(q * p * 1.1).cast("double"))
    whole = lambda c: F.format_string("%d", c.cast("long"))
    cells = F.array(F.col("l_linestatus"), whole(q), whole(p), F.coalesce(whole(amount), F.lit("")))
    made = _read(spark, sf_dir, "lineitem").withColumn("row", F.when(amount.isNull(), F.array(F.col("l_linestatus"), whole(q), whole(p), F.lit(""))).otherwise(cells))
    bills = made.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.collect_list("row").alias("rows")).withColumn("header", F.array(*map(F.lit, _BILL)))
    return audit.audit_boq(bills).summary.groupBy("status").agg(F.count(F.lit(1)).alias("bills"), F.sum("total_items").alias("items"), F.round(F.sum("total_amount"), 0).alias("total_amount"))


# --- Numbers, units, boxes

_HEADERS = ["CD (MM)", "L (cm)", "TONG (M)", "SO LUONG"]


@query(f"""
WITH r AS (SELECT l_returnflag AS flag, l_linenumber AS n, l_quantity AS q, l_extendedprice AS p, p_size AS s FROM lineitem JOIN part ON l_partkey = p_partkey),
u AS (SELECT *, [{_list(["mm", "cm", "m"])}, NULL][n % 4 + 1] AS unit FROM r)
SELECT flag, coalesce(unit, '') AS unit, count(*) AS n, round(sum(q + n / 100.0), 2) AS extracted, round(sum(1000 * n + q), 2) AS lengths, round(sum(CASE unit WHEN 'mm' THEN q * 50 / 1000 WHEN 'cm' THEN q * 50 / 100 WHEN 'm' THEN q * 50 ELSE CASE WHEN q * 50 > 100 THEN q * 50 / 1000 ELSE q * 50 END END), 2) AS metres,
  sum(CASE WHEN q + 39 >= 40 AND q + 39 <> 90 AND q + 39 <> s THEN 2 ELSE 1 END)::BIGINT AS parts, sum(CASE WHEN s IN (6, 8) THEN 32 ELSE s * 100 + 32 END)::BIGINT AS digits,
  count(DISTINCT CASE WHEN p = floor(p) THEN CAST(CAST(p AS BIGINT) AS VARCHAR) ELSE rtrim(printf('%.10f', p), '0') END) AS amounts FROM u GROUP BY 1, 2""")
def number_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and units in texts, by flag and unit."""
    rows = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    n, q, s = F.col("l_linenumber"), F.col("l_quantity"), F.col("p_size")
    unit = N.length_unit(F.element_at(F.array(*map(F.lit, _HEADERS)), n % 4 + 1))
    shape = N.shape_segments(F.format_string("12 90 %d 1200", (q + 39).cast("int")), "us", s)
    made = rows.select(
        F.col("l_returnflag").alias("flag"), F.coalesce(unit, F.lit("")).alias("unit"), N.extract_number(F.format_string("~ %d,%02d kg", q.cast("int"), n)).alias("x"), N.length_number(F.format_string("%d.%03d", n, q.cast("int")), "vn").alias("l"), N.to_metres(q * 50, unit).alias("m"),
        F.size(shape).alias("parts"), N.digit_fingerprint(F.format_string("c6 D%d Ø 032 %s", s, F.lit("m6"))).cast("long").alias("digits"), N.canonical_value(F.col("l_extendedprice")).alias("amount"),
    )
    return made.groupBy("flag", "unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 2).alias("extracted"), F.round(F.sum("l"), 2).alias("lengths"), F.round(F.sum("m"), 2).alias("metres"), F.sum("parts").cast("long").alias("parts"), F.sum("digits").alias("digits"), F.countDistinct("amount").alias("amounts"))


@query("""
WITH b AS (SELECT l_returnflag AS flag, l_linenumber AS n, l_quantity AS x0, l_linenumber * 2.0 AS y0, l_quantity + 3 AS x1, l_linenumber * 2.0 + l_discount * 100 + 1 AS y1 FROM lineitem),
m AS (SELECT *, greatest(0, least(x1, 30) - greatest(x0, 10)) * greatest(0, least(y1, 9) - greatest(y0, 3)) / least((x1 - x0) * (y1 - y0), 120) AS over_,
  CASE n % 4 WHEN 1 THEN 100 - y1 WHEN 2 THEN 60 - x1 WHEN 3 THEN y0 ELSE x0 END AS r0, CASE n % 4 WHEN 1 THEN x0 WHEN 2 THEN 100 - y1 WHEN 3 THEN 60 - x1 ELSE y0 END AS r1, least(greatest(1600 / greatest(1, x0 * 40, 900), 1), 1.5) AS scale FROM b)
SELECT flag, count(*) AS n, round(sum((x0 + x1) / 2), 2) AS cx, round(sum((y0 + y1) / 2), 2) AS cy, round(sum((x1 - x0) * (y1 - y0)), 2) AS area, round(sum(over_), 4) AS overlap, round(sum(r0 + r1), 2) AS turned, round(sum(scale), 4) AS scales, round(sum(x1 * 2 / scale), 2) AS scene,
  round(sum(CASE WHEN n % 3 = 0 THEN (100 - y1) * 1.5 END), 2) AS flipped FROM m GROUP BY 1""")
def box_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes measured, turned, scaled and flipped."""
    x0, y0 = F.col("l_quantity"), F.col("l_linenumber") * 2.0
    x1, y1 = x0 + 3, y0 + F.col("l_discount") * 100 + 1
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("n"), F.array(corner(x1, y0), corner(x0, y1), corner(x0, y0), corner(x1, y1)).alias("quad"), F.when(F.col("l_linenumber") % 3 == 0, "AutoCAD SHX Text").otherwise("note").alias("subject"), F.lit(100.0).alias("height"), F.lit(1.5).alias("zoom"))
    m = G.box_metrics(rows)
    box = F.array("x_min", "y_min", "x_max", "y_max")
    turned = G.rotate_box(box, F.col("n") % 4, F.lit(60.0), F.lit(100.0))
    scale = G.base_scale(F.col("x_min") * 40, F.lit(900.0))
    fixed = F.array(*(F.lit(float(v)) for v in (10, 3, 30, 9)))
    made = m.select("flag", "cx", "cy", (F.col("w") * F.col("h")).alias("area"), G.overlap_ratio(box, fixed).alias("overlap"), (turned[0] + turned[1]).alias("turned"), scale.alias("scale"), G.to_scene(box, F.lit(2.0), scale)[2].alias("scene"))
    flipped = G.box_metrics(G.flipped(rows, "height", "zoom")).groupBy("flag").agg(F.round(F.sum("y_min"), 2).alias("flipped"))
    r = lambda c, name, d: F.round(F.sum(c), d).alias(name)
    sums = made.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), r("cx", "cx", 2), r("cy", "cy", 2), r("area", "area", 2), r("overlap", "overlap", 4), r("turned", "turned", 2), r("scale", "scales", 4), r("scene", "scene", 2))
    return sums.join(flipped, "flag", "left")


# --- Texts

_UPPER_FOLD = f"upper({_FOLD})"
_VIETNAMESE = ["Bê tông móng trụ cầu phải đổ liên tục và bảo dưỡng đủ ngày", "Cốt thép chủ đặt đúng vị trí theo bản vẽ thiết kế được duyệt", "Kiểm tra cao độ đáy móng trước khi đổ bê tông lót dày mười phân"]


@query(f"""
WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS t FROM documents),
m AS (SELECT lang, t, list_filter(regexp_extract_all(t, '{_LATIN}'), lambda w: len(w) >= 2) AS ws, regexp_extract_all(lower({_FOLD.format("t")}), '[a-z0-9]+') AS ts FROM l),
k AS (SELECT lang, len(ws) >= 3 AND len(list_filter(ws, lambda w: lower(w) <> lower({_FOLD.format("w")}))) >= len(ws) * 0.4 AS accented, list_filter(ts, lambda w: len(w) >= 2 AND regexp_matches(w, '[a-z]')) AS ts,
  len(list_filter(regexp_extract_all(t, '[A-Za-zÀ-ỹ]{{2,}}'), lambda w: upper(w) NOT IN ({_list(cleaning.CODES)}) AND regexp_matches(w, '[aeiouyAEIOUYà-ỹĂ-Ỹ]'))) > 0 AND NOT ({" OR ".join(f"contains(regexp_replace({_UPPER_FOLD.format('t')}, '[^0-9A-Z]', '', 'g'), '{w}')" for w in cleaning.STAMP_KEYS)}) AS again FROM m),
s AS (SELECT *, len(list_filter(ts, lambda w: len(w) <= 7 AND regexp_matches(w, '^(?:{T.ONSETS})?(?:{T.NUCLEI})(?:{T.CODAS})?$'))) AS good FROM k)
SELECT lang, count(*) AS n, count(*) FILTER (accented) AS accented, count(*) FILTER (again) AS to_read_again, round(sum(CASE WHEN len(ts) >= 6 THEN good / len(ts) END), 4) AS likeness FROM s GROUP BY 1""")
def syllable_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with accents, lines that read like Vietnamese, and lines to be read again."""
    t = F.col("t")
    lines = _texts(spark, sf_dir).select("lang", F.explode(F.split("text", "\n")).alias("t"))
    return lines.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.already_accented(t)).alias("accented"), F.count_if(cleaning.needs_second_reading(t)).alias("to_read_again"), F.round(F.sum(T.likeness(t)), 4).alias("likeness"))


@query("""
WITH e AS (SELECT event_type, event_id AS i, user_id AS u, '[Trang ' || (event_id % 90 + 1) || '] x [Trang  ' || (user_id % 9 + 1) || ' • a] [trang 3]' AS t FROM events)
SELECT event_type, count(*) AS n, sum(i % 90 + 1 + u % 9 + 1)::BIGINT AS pages, count(DISTINCT lpad(((i % 5000) // 60)::VARCHAR, 2, '0') || ':' || lpad((i % 5000 % 60)::VARCHAR, 2, '0')) AS clocks, sum(10 + floor((i % 37) / 37.0 * 80))::BIGINT AS percents, round(sum(CASE WHEN i % 37 > 0 THEN (37 - i % 37) * 12.0 / (i % 37) END), 2) AS left_ FROM e GROUP BY 1""")
def progress_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that answers cite, times, shares done and times left."""
    i, u = F.col("event_id"), F.col("user_id")
    cited = T.cited_pages(F.format_string("[Trang %d] x [Trang  %d • a] [trang 3]", i % 90 + 1, u % 9 + 1))
    made = _read(spark, sf_dir, "events").select("event_type", F.aggregate(cited, F.lit(0), lambda a, x: a + x).alias("p"), T.clock(i % 5000).alias("c"), T.percent(i % 37, F.lit(37), 10, 90).alias("d"), T.eta(i % 37, F.lit(37), F.lit(12.0)).alias("e"))
    return made.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p").cast("long").alias("pages"), F.countDistinct("c").alias("clocks"), F.sum("d").cast("long").alias("percents"), F.round(F.sum("e"), 2).alias("left_"))


@query("""
WITH t AS (SELECT c_custkey AS i, c_mktsegment AS s, c_custkey % 4 AS k FROM customer)
SELECT DISTINCT CASE k WHEN 0 THEN 'BQLDA' WHEN 1 THEN 'BTCT' WHEN 2 THEN 'CĐT' END AS acro, CASE k WHEN 0 THEN 'Ban Quản Lý Dự Án' WHEN 1 THEN 'bê tông cốt thép' WHEN 2 THEN 'Chủ đầu tư' END AS expansion FROM t WHERE k < 3""")
def abbreviations_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations that texts define, in three ways; a fourth doesn't spell its acronym."""
    of, s = F.col("c_custkey") % 4, F.col("c_mktsegment")
    text = F.when(of == 0, F.concat(F.lit("Công trình của Ban Quản Lý Dự Án (BQLDA) "), s)).when(of == 1, F.concat(F.lit("Dùng BTCT (bê tông cốt thép) "), s)).when(of == 2, F.concat(s, F.lit("\nCĐT: Chủ đầu tư\n"))).otherwise(F.concat(s, F.lit(" không có gì (XYZ)")))
    docs = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    return learning.abbreviations(docs)


@query(f"""
WITH p AS (SELECT c_custkey AS i, c_custkey % 3 AS k, c_custkey % 5 AS m FROM customer)
SELECT i AS doc_id FROM p WHERE k < 2 AND m IN (0, 1, 2)""")
def trusted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that read like Vietnamese, from sources that can be trusted."""
    of, m = F.col("c_custkey") % 3, F.col("c_custkey") % 5
    good = F.lit("\n".join(_VIETNAMESE))
    text = F.when(of == 0, good).when(of == 1, F.concat(good, F.lit("\n"), good)).otherwise(F.concat_ws(" ", F.col("c_name"), F.lit(_VIETNAMESE[0])))
    method = F.element_at(F.array(*map(F.lit, [*learning.TRUSTED_METHODS, "rapid_ocr", "model"])), (m + 1).cast("int"))
    pages = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), method.alias("method"), text.alias("text"))
    return learning.trusted_pages(pages).select("doc_id")


# --- Reports


def _review_sql(t: str, score: str) -> str:
    """F1 of readings that are words of Latin letters and digits."""
    return f"CASE WHEN {score} >= 0.75 THEN false WHEN regexp_matches({t}, '^\\d{{1,6}}([.,]\\d*)?$') AND {score} >= 0.5 THEN false WHEN regexp_matches({t}, '^[A-Za-z0-9_]{{2,4}}$') AND {score} >= 0.5 THEN false WHEN {t} IN ({_list(cleaning.NOISE)}) THEN false ELSE true END"


_LOW = "SELECT user_id AS doc_id, (event_id % 3)::INTEGER AS page, event_id AS ord, CASE WHEN event_id % 5 = 0 THEN event_type || event_id % 100 ELSE event_type END AS text, (event_id % 100) / 100.0 AS score FROM events"


def _low(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (i % 3).cast("int").alias("page"), i.alias("ord"), F.when(i % 5 == 0, F.concat("event_type", (i % 100).cast("string"))).otherwise(F.col("event_type")).alias("text"), ((i % 100) / 100).alias("score"), F.lit(False).alias("in_stamp"), F.lit(False).alias("in_title_block"))


@query(f"""
WITH l AS ({_LOW}),
r AS (SELECT doc_id, page, count(*) AS to_review, greatest(count(*) - 5, 0) AS more FROM l WHERE {_review_sql("text", "score")} GROUP BY 1, 2),
d AS (SELECT doc_id, page, count(*) AS total, count(*) FILTER (regexp_matches(text, '\\d')) AS shown, md5('## Trang ' || page || chr(10) || string_agg('- `' || text || '` (' || printf('%.2f', score::DOUBLE) || ')', chr(10) ORDER BY ord)) AS text_md5 FROM l GROUP BY 1, 2)
SELECT d.doc_id, d.page, total, shown, text_md5, coalesce(to_review, 0) AS to_review, coalesce(more, 0) AS more FROM d LEFT JOIN r USING (doc_id, page)""")
def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubtful readings of each page, as a list and counted."""
    low = _low(spark, sf_dir)
    made = reports.review_markdown(low).join(cleaning.low_with_digits(low), ["doc_id", "page"]).join(cleaning.review_list(low, 5), ["doc_id", "page"], "left")
    listed = F.size(F.filter("first", lambda x: x.isNotNull()))
    return made.select("doc_id", "page", "total", "shown", F.md5("text").alias("text_md5"), F.coalesce(F.when(F.col("first").isNotNull(), listed + F.col("more")), F.lit(0)).cast("long").alias("to_review"), F.coalesce("more", F.lit(0)).cast("long").alias("more"))


_KINDS = [*sorted(audit.LABELS), "khac"]


@query(f"""
WITH labels(kind, label) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in audit.LABELS.items())}),
w AS (SELECT o_orderkey % 20 AS doc_id, (o_custkey % 30)::INTEGER AS page, o_orderkey AS table_id, (o_custkey % 7)::INTEGER AS row, [{_list(_KINDS)}][o_orderkey % {len(_KINDS)} + 1] AS kind, o_orderstatus AS mark, o_orderpriority AS message FROM orders)
SELECT doc_id, page, count(*) AS n, md5(string_agg('- `' || coalesce(label, w.kind) || '` ' || mark || ': ' || message, chr(10) ORDER BY table_id, row, w.kind)) AS text_md5 FROM w LEFT JOIN labels ON labels.kind = w.kind GROUP BY 1, 2""")
def audit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings by document and page with their labels."""
    o = _read(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % len(_KINDS) + 1).cast("int"))
    w = o.select((F.col("o_orderkey") % 20).alias("doc_id"), (F.col("o_custkey") % 30).cast("int").alias("page"), F.col("o_orderkey").alias("table_id"), (F.col("o_custkey") % 7).cast("int").alias("row"), kind.alias("kind"), F.col("o_orderstatus").alias("mark"), F.col("o_orderpriority").alias("message"))
    return reports.audit_report(w).select("doc_id", "page", "n", F.md5("text").alias("text_md5"))


@query("""
WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS page, o_orderpriority AS markdown, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE '' END AS number_, CASE WHEN o_orderkey % 4 = 0 THEN 'Mặt bằng' END AS name_, (o_orderkey % 3)::INTEGER AS n FROM orders)
SELECT doc_id, md5(string_agg('## [Trang ' || page || ']' || chr(10) || chr(10) || markdown, chr(10) || chr(10) ORDER BY page, markdown)) AS text_md5, count(*) FILTER (number_ <> '' OR name_ <> '') AS in_index, coalesce(sum(n) FILTER (number_ <> '' OR name_ <> ''), 0)::BIGINT AS indexed_tables, sum(n)::BIGINT AS tables, coalesce(sum(n * (n - 1) / 2), 0)::BIGINT AS places FROM p GROUP BY 1""")
def page_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as one text, the index of sheets, and tables out of pages."""
    o = _read(spark, sf_dir, "orders")
    n = (F.col("o_orderkey") % 3).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.alias("place"), F.col("o_orderstatus").alias("title")))
    pages = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.col("o_orderpriority").alias("markdown"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise("").alias("so_hieu_ban_ve"), F.when(F.col("o_orderkey") % 4 == 0, "Mặt bằng").alias("ten_ban_ve"), F.slice(made, F.lit(1), n).alias("tables"))
    text = reports.full_markdown(pages).select("doc_id", F.md5("markdown").alias("text_md5"))
    index = reports.sheet_index(pages).groupBy("doc_id").agg(F.count(F.lit(1)).alias("in_index"), F.sum("n_tables").alias("indexed_tables"))
    out = relational.exploded_tables(pages).groupBy("doc_id").agg(F.count(F.lit(1)).alias("tables"), F.sum("place").alias("places"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return text.join(index, "doc_id", "left").join(out, "doc_id", "left").select("doc_id", "text_md5", zero("in_index"), zero("indexed_tables"), zero("tables"), zero("places"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_brand AS b, p_name AS n, p_size AS s, p_retailprice AS c FROM part)
SELECT k AS p_partkey, md5('| ' || b || ' | Cột 2 | a\\|b |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || n || ' |  | x y |' || chr(10) || '| ' || s || ' | ' || n || ' | \\| |') AS markdown_md5, s % 3 < 2 AS genuine, 'Bảng ' || s AS title, md5('STT,Khối lượng (kg),Ghi chú') AS header_md5, 2 AS n_rows, s + 0.5 AS total FROM p""")
def tables_from_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as Markdown, told from prose, and cut into title, header and rows with numbers."""
    s, name = F.col("p_size"), F.col("p_name")
    row = lambda *cells: F.array(*(c if not isinstance(c, str) else F.lit(c) for c in cells))
    markdown = tables.to_markdown(row(F.col("p_brand"), " ", "a|b"), F.array(F.array(name, F.lit(None).cast("string"), F.lit("x \n y")), F.array(s.cast("string"), name, F.lit("|"))))
    prose = F.lit("one line of text that goes on for longer than a cell does")
    lines = F.when(s % 3 == 0, F.array(row("STT", "Mác", "kg"), row("1", name, "3"))).when(s % 3 == 1, F.array(row("1", "2", "3", name), row("4", "5", "6", "7"))).otherwise(F.array(F.array(prose, prose), F.array(prose, prose)))
    title = F.concat(F.lit("Bảng "), s.cast("string"))
    grid = F.array(F.array(title, title, title), row("", "", ""), row("STT", "Khối lượng", "Ghi chú"), row("", "(kg)", ""), F.array(F.lit("1"), F.format_string("%d,50", s), F.lit("")), row("2", "x"))
    parts = _texts(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("table_id"), F.md5(markdown).alias("markdown_md5"), tables.is_genuine_table(lines).alias("genuine"), tables.split_header(grid).alias("t")).select("*", "t.title", "t.header", "t.rows").drop("t")
    total = F.aggregate("values", F.lit(0.0), lambda a, r: a + F.coalesce(F.get(r, F.lit(1)), F.lit(0.0)))
    return tables.with_values(parts).select("p_partkey", "markdown_md5", "genuine", "title", F.md5(F.array_join("header", ",")).alias("header_md5"), F.size("rows").alias("n_rows"), total.alias("total"))


# --- Learned tables


@query("""
WITH p AS (SELECT o_orderkey AS ts, CASE WHEN o_custkey % 11 = 0 THEN o_orderstatus || ' 12' ELSE substr('abcdefghijklmnopqrstuvwxyz', (o_custkey % 13 + 1)::INTEGER, 3) END AS raw, CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN upper(o_orderstatus) || 'x' ELSE o_orderpriority END AS corrected, 's' || o_orderkey % 3 AS source FROM orders),
c AS (SELECT * FROM p WHERE raw <> '' AND corrected <> '' AND raw <> corrected AND len(raw) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY ts DESC) AS n, count(*) OVER (PARTITION BY raw) AS cnt FROM c)
SELECT raw, corrected, cnt, source, NOT regexp_matches(raw, '\\d') AND NOT regexp_matches(corrected, '\\d') AS safe, safe AND cnt >= 3 AS applied FROM r WHERE n = 1""")
def corrections_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6, H7: the last correction of each reading, and which may be applied anywhere."""
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    raw = F.when(k % 11 == 0, F.concat("o_orderstatus", F.lit(" 12"))).otherwise(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (k % 13 + 1).cast("int"), F.lit(3)))
    good = F.when(o % 17 == 0, "").when(o % 5 == 0, F.concat(F.upper("o_orderstatus"), F.lit("x"))).otherwise(F.col("o_orderpriority"))
    pairs = _read(spark, sf_dir, "orders").select(raw.alias("raw"), good.alias("corrected"), F.concat(F.lit("s"), (o % 3).cast("string")).alias("source"), o.alias("ts"))
    made = learning.corrections(pairs)
    applied = learning.safe_corrections(made, 3).select("raw", F.lit(True).alias("applied"))
    return made.join(applied, "raw", "left").select("raw", "corrected", "cnt", "source", "safe", F.coalesce("applied", F.lit(False)).alias("applied"))


@query("""
WITH k AS (SELECT p_type AS term, count(*) AS cnt FROM part WHERE p_size <= 25 AND p_type <> 'ECONOMY' GROUP BY 1), n AS (SELECT p_type AS term, count(*) AS cnt FROM part WHERE p_size > 20 GROUP BY 1)
SELECT term, coalesce(k.cnt, 0) + coalesce(n.cnt, 0) AS cnt, k.term IS NULL AS fresh FROM k FULL JOIN n USING (term)""")
def terms_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3, Q4: counts of known and new terms added up, and which are new."""
    part = _read(spark, sf_dir, "part")
    known, new = (part.where(w).groupBy(F.col("p_type").alias("term")).agg(F.count(F.lit(1)).alias("cnt")) for w in ("p_size <= 25 and p_type <> 'ECONOMY'", "p_size > 20"))
    fresh = learning.new_entries(new, known, "term").select("term", F.lit(True).alias("fresh"))
    return learning.merged_terms(known, new).join(fresh, "term", "left").select("term", "cnt", F.coalesce("fresh", F.lit(False)).alias("fresh"))


_ALIAS_HEADERS = ["Số hiệu thanh", "Đơn giá", "khác", "Tên cấu kiện", "Khối lượng", "", "Quy cách", "Hạng mục"]


@query(f"""
WITH h AS (SELECT DISTINCT trim(lower({_FOLD.format("h")})) AS alias FROM (SELECT [{_list(_ALIAS_HEADERS)}][p_size % 8 + 1] AS h FROM part)),
words(word, col, i) AS (VALUES {", ".join(f"('{w}', '{c}', {i})" for i, (w, c) in enumerate(learning.HEADER_ALIASES.items()))})
SELECT alias, arg_min(col, i) AS "column" FROM h JOIN words ON contains(alias, word) WHERE alias <> '' GROUP BY 1""")
def headers_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of tables and the columns they stand for."""
    header = F.array(F.element_at(F.array(*map(F.lit, _ALIAS_HEADERS)), F.col("p_size") % 8 + 1))
    return learning.header_aliases(_read(spark, sf_dir, "part").select(header.alias("header")))


@query("""
WITH f AS (SELECT user_id AS folder, count(*) FILTER (event_type = 'click') AS learned, count(*) FILTER (event_type = 'view') AS numeric_ FROM events GROUP BY 1),
d AS (SELECT date_trunc('day', ts) AS epoch, count(*) AS pages, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events GROUP BY 1),
last AS (SELECT sum(a + b) AS recent FROM (SELECT a, b FROM d ORDER BY epoch DESC LIMIT 5))
SELECT (SELECT count(*) FROM f WHERE learned > 0 OR numeric_ > 0) AS folders, (SELECT sum(learned) FROM f)::BIGINT AS learned, (SELECT sum(numeric_) FROM f)::BIGINT AS "numeric", (SELECT count(*) FROM d) AS documents, (SELECT sum(pages) FROM d)::BIGINT AS pages, (SELECT recent FROM last)::BIGINT AS recent_lessons""")
def learning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was learned, in all and of late."""
    e = _read(spark, sf_dir, "events")
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    totals = learning.learned_totals(e.groupBy(F.col("user_id").alias("folder")).agg(of("click").alias("learned"), of("view").alias("numeric")))
    log = e.groupBy(F.date_trunc("day", "ts").alias("epoch")).agg(F.count(F.lit(1)).alias("pages"), F.create_map(F.lit("a"), of("click"), F.lit("b"), of("view")).alias("lessons"))
    return totals.crossJoin(learning.summary(log))  # one row each


@query("""
WITH p AS (SELECT o_orderkey AS i, CASE o_orderkey % 4 WHEN 0 THEN 'scan' WHEN 1 THEN 'vector_text' WHEN 2 THEN NULL ELSE '' END AS reason, CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE o_orderpriority END AS text, CASE WHEN o_orderkey % 10 = 0 THEN 'failed' END AS error, o_orderkey % 3 AS w FROM orders),
h AS (SELECT coalesce(reason, '') AS ocr_reason, count(*) AS n, count(*) FILTER (trim(text) = '') AS blank FROM p GROUP BY 1)
SELECT h.*, (SELECT count(*) FROM p) AS files, (SELECT count(error) FROM p) AS failed, (SELECT sum(w) FROM p)::BIGINT AS warnings FROM h""")
def page_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by why they were read, and how a batch of files went."""
    i = F.col("o_orderkey")
    pages = _read(spark, sf_dir, "orders").select(F.when(i % 4 == 0, "scan").when(i % 4 == 1, "vector_text").when(i % 4 == 3, "").alias("ocr_reason"), F.when(i % 6 == 0, " ").otherwise(F.col("o_orderpriority")).alias("text"), F.when(i % 10 == 0, "failed").alias("error"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (i % 3).cast("int")).alias("warnings"))
    return reports.reason_histogram(pages).crossJoin(reports.batch_status(pages))  # one row on the right


@query("""
WITH d AS (SELECT o_orderkey AS i, o_orderpriority AS p FROM orders)
SELECT CASE WHEN i % 5 < 2 THEN 'office' WHEN i % 5 = 2 THEN 'rapid_ocr' ELSE 'model' END AS route, count(*) AS n, count(*) FILTER (i % 1000 > 500 AND i % 3000 > 1000) AS done, sum(CASE WHEN i % 7 = 0 THEN 1 ELSE 2 END + i % 2)::BIGINT AS warnings, count(DISTINCT substr(p, 1, 1)) AS numbers, sum(3 + i % 3)::BIGINT AS merged FROM d GROUP BY 1""")
def files_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How files are routed, and what is kept of them."""
    i = F.col("o_orderkey")
    suffix = F.when(i % 5 == 0, "XLSX").when(i % 5 == 1, "docx").otherwise("pdf")
    warnings = pipelines.office_warnings(F.when(i % 7 == 0, F.array(F.lit("blank page"), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"))), F.when(i % 2 == 1, F.array(F.lit("c"))))
    merged = relational.merged_maps(F.create_map(F.lit("a"), i, F.lit("b"), i), F.when(i % 3 == 0, F.create_map(F.lit("c"), i)).when(i % 3 == 1, F.create_map(F.lit("c"), i, F.lit("d"), i)).otherwise(F.create_map(F.lit("c"), i, F.lit("d"), i, F.lit("e"), i)))
    made = _read(spark, sf_dir, "orders").select(pipelines.route(suffix, F.when(i % 5 == 2, "rapid_ocr").otherwise("auto")).alias("route"), reports.is_done(i % 1000, i % 3000).alias("done"), F.size(warnings).alias("w"), relational.distinct_matches(F.concat("o_orderpriority", F.lit(" "), "o_orderpriority"), r"\d")[0].alias("d"), F.size(merged).alias("m"))
    return made.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.count_if("done").alias("done"), F.sum("w").cast("long").alias("warnings"), F.countDistinct("d").alias("numbers"), F.sum("m").cast("long").alias("merged"))


@query("""
WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line, l_returnflag = 'R' AS label, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN l_quantity::INTEGER::VARCHAR ELSE '' END AS inline, l_linenumber::VARCHAR AS text FROM lineitem),
n AS (SELECT a.doc_id, a.line, a.inline, string_agg(b.text, ' ' ORDER BY b.line) FILTER (b.line < coalesce(c.line, 99999)) AS below FROM l a LEFT JOIN l b ON b.doc_id = a.doc_id AND b.line BETWEEN a.line + 1 AND a.line + 3
  LEFT JOIN (SELECT x.doc_id, x.line AS at, min(y.line) AS line FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.line > x.line AND y.label GROUP BY 1, 2) c ON c.doc_id = a.doc_id AND c.at = a.line WHERE a.label GROUP BY 1, 2, 3)
SELECT doc_id, line, CASE WHEN inline <> '' THEN inline ELSE below END AS value, coalesce(s, '') AS so_hieu_ban_ve FROM n LEFT JOIN (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0) ON k = doc_id""")
def labelled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value beside or below a label, with the drawing's number."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    inline = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), F.col("l_quantity").cast("int").cast("string")).otherwise("")
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.row_number().over(order).cast("long").alias("line"), (F.col("l_returnflag") == "R").alias("label"), inline.alias("inline"), F.col("l_linenumber").cast("string").alias("text"))
    found = relational.value_after_label(lines, F.col("inline"), F.col("label")).withColumn("source", F.col("doc_id"))
    numbers = _read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("source"), F.lit(1).alias("page"), F.col("o_orderstatus").alias("so_hieu_ban_ve"))
    return retrieval.with_drawing_numbers(found, numbers).select("doc_id", "line", "value", "so_hieu_ban_ve")
