"""Review filter, garbled text and duplicates."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.restoring import plain
from ..functions.text import better_of, dedup_key, fold_key, has_any, is_garbled

# Mark of two readings that differ, words of stamps, labels and noise.
CONFLICT = "⟦"
STAMP_CONFLICT = ["SGTVT", "QLCLCT", "THEO VAN BAN", "THEO VĂN BẢN", "GIAO THONG", "GIAO THÔNG", "NAM 202", "NĂM 202"]
STAMP = STAMP_CONFLICT[:6]
LABELS = ["TY LE", "TỶ LỆ", "MAT CAT", "MẶT CẮT", "CẮT"]
NOISE = ["(ww)", "(wu)", "(s/eu)", "om", "bi", "da", "dao", "rn", "rL", "AC"]
CONFIDENT = 0.75


def needs_review(text: Column, score: Column, in_stamp: Column, in_title_block: Column) -> Column:
    """whether a reading has to be looked at by a person; the first rule that applies decides."""
    t = F.trim(text)
    upper = F.upper(t)
    among = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(upper, w))
    low = F.coalesce(score, F.lit(1.0))
    return (
        F.when(F.coalesce(in_stamp, F.lit(False)) | F.coalesce(in_title_block, F.lit(False)), False)
        .when(t.contains(CONFLICT), ~among(STAMP_CONFLICT))
        .when(low >= CONFIDENT, False)
        .when(t.rlike(r"[一-鿿]"), False)
        .when(t.rlike(r"(?U)^[\W_]+$"), False)
        .when(among(STAMP), False)
        .when(t.rlike(r"^\d{1,6}([.,]\d*)?$") & (low >= 0.5), False)
        .when((F.length(t) == 1) & (low >= 0.5), False)
        .when(t.rlike(r"^[A-Za-z0-9_]{2,4}$") & (low >= 0.5), False)
        .when(t.rlike(r"^(D|Φ|φ)\d{1,2}[A-Za-z0-9_() -]*$") & (low >= 0.55), False)
        .when(among(LABELS), False)
        .when(t.isin(*NOISE), False)
        .otherwise(True)
    )


# Codes that are no words, folded words of stamps, and of what stands in title blocks.
CODES = ["STT", "TL", "KC", "DA", "CT", "TCVN", "CAD", "PDF", "OK", "REV", "D10", "D12", "D14", "D16", "D18", "D20", "D22", "D25", "D28", "D32", "CB300", "CB400", "CIII", "CII"]
STAMP_KEYS = ["SGTVT", "QLCLCT", "THEOVANBAN", "SOGIAOTHONG"]
ADMIN_KEYS = ["CONGTY", "CHUDAUTU", "GIAMDOC", "CHUNHIEM", "CHUTRI", "NGUOIVE", "KIEMTRA", "GIAIDOAN", "THIETKE", "BANVE", "TYLE", "NGAY", "KYTEN", "HOVATEN", "PHEDUYET", "THAMDINH", "HANGMUC", "GOITHAU", "DUAN", "CONGTRINH", "SCALE", "DATE", "DWG", "REV", "SHEET", "CAD"]


def needs_second_reading(text: Column) -> Column:
    """A text with a word that may lack its marks; not codes, and not stamps."""
    found = F.filter(F.regexp_extract_all(text, F.lit("([A-Za-zÀ-ỹ]{2,})"), 1), lambda w: ~F.upper(w).isin(*CODES) & w.rlike("[aeiouyAEIOUYà-ỹĂ-Ỹ]"))
    return F.coalesce((F.size(found) > 0) & ~has_any(fold_key(text), STAMP_KEYS), F.lit(False))


def in_margin_or_title_block(text: Column, x_min: Column, y_min: Column, x_max: Column, y_max: Column, width: Column, height: Column) -> Column:
    """In the outer 2 % of a page, or an administrative word where title blocks stand."""
    margin = (x_min <= width * 0.02) | (x_max >= width * 0.98) | (y_min <= height * 0.02) | (y_max >= height * 0.98)
    zone = ((x_min >= width * 0.65) & (y_min >= height * 0.68)) | (x_min >= width * 0.82)
    return margin | (zone & has_any(fold_key(text), ADMIN_KEYS))


def review_list(items: DataFrame, most: int = 30) -> DataFrame:
    """By page the first ``most`` texts to review, and how many more there are."""
    kept = items.where(needs_review(F.col("text"), F.col("score"), F.col("in_stamp"), F.col("in_title_block")))
    order = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord"))
    return kept.withColumn("i", order).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.when(F.col("i") <= most, F.struct("i", "text", "score")))).alias("first"), F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("more"))


def low_with_digits(low: DataFrame) -> DataFrame:
    """by page the doubtful readings, and those that hold digits."""
    return low.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("text").rlike(r"\d")).alias("shown"))


def page_text(markdown: Column) -> Column:
    """Markdown without the rules and bars of tables."""
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(markdown, r"(?m)^\|[\s:|-]+\|[ \t]*\n?", ""), F.lit("|"), F.lit(" ")), "[ \t]+", " "))


def page_warnings(text: Column, low: Column) -> Column:
    """warnings of a page: a blank one, and doubtful readings with digits."""
    digits = F.size(F.filter(low, lambda x: x["text"].rlike(r"\d")))
    return F.filter(F.array(F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "blank page"), F.when(digits > 0, F.concat(digits.cast("string"), F.lit(" doubtful readings with digits")))), lambda w: w.isNotNull())


def without_garbled(lines: DataFrame, text: str = "text") -> DataFrame:
    return lines.where(~is_garbled(F.col(text)))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each text its hash, smallest id and number of copies, combined map-side."""
    return docs.groupBy(F.sha2(F.col(text), 256).alias("sha256")).agg(F.min(doc_id).alias("first_id"), F.count(F.lit(1)).alias("copies"))


def unseen(docs: DataFrame, seen: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text's hash has not been learned from."""
    return docs.withColumn("sha256", F.sha2(F.col(text), 256)).join(seen.select("sha256"), "sha256", "left_anti")


def first_by_key(lines: DataFrame, group: str, slot: str, text: str = "text", chars: int = 60) -> DataFrame:
    """V2: of lines with the same key up to ``chars`` characters the first in its group."""
    order = Window.partitionBy(group, F.substring(dedup_key(F.col(text)), 1, chars)).orderBy(slot)
    return lines.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


# --- Notes sections: lines as rows, one section's bullets in one group.

#: A bullet's mark and its text; the title of a notes section.
BULLET = r"^(\s*(?:[-*+•]|\d{1,2}[.)])\s+)(.*)$"
NOTES_TITLE = r"(?iu)^\s*#*\s*\**\s*ghi ch[uúUÚ]"
ALTERNATIVE = "⟦[^⟧]*⟧"
MERGE_RATIO = 0.82
#: Shortest bullet, in characters and in words, that is searched for a phrase said twice.
LEAST_CHARS, LEAST_WORDS = 24, 5

# A phrase that a bullet begins with and says again (six words rather than three), and one that it says
# twice further in (four words, else three). Words are folded, with one space between them.
_SAID_AGAIN = [re.compile(p) for p in (r"^(?P<phrase>\S+(?: \S+){2,5}) (?P<between>(?:\S+ )*?)(?P<again>(?P=phrase))(?!\S)", r"(?<!\S)(?P<phrase>\S+(?: \S+){3}) (?P<between>(?:\S+ )*?)(?P<again>(?P=phrase))(?!\S)", r"(?<!\S)(?P<phrase>\S+(?: \S+){2}) (?P<between>(?:\S+ )*?)(?P<again>(?P=phrase))(?!\S)")]


def _fuller(one: str, other: str) -> str:
    """D20 for two texts: the one with clearly more marks, or clearly longer; else the first."""
    marks, more = (len(re.findall(r"[^\x00-\x7F]", t)) for t in (one, other))
    return other if (more > 1.1 * marks and len(other) > 5) or len(other) > 1.2 * len(one) else one


def said_once(text: str) -> str:
    """A bullet without a phrase that it says again.

    Said again from the start, the text has two halves, of which the fuller stays; further in, what
    stands between goes. That is done until nothing is said twice.
    """
    left, rest = [], text.strip()
    halves: list[str] = []
    while True:
        words = re.sub(ALTERNATIVE, "", rest).split()
        folded = " ".join("".join(plain(w).lower().split()) or "_" for w in words)
        found = next((m for p in _SAID_AGAIN if (m := p.search(folded))), None) if len(rest) >= LEAST_CHARS and len(words) >= LEAST_WORDS else None
        if not found:
            break
        first, second = (folded.count(" ", 0, found.start(g)) for g in ("phrase", "again"))
        if first:
            left.append(" ".join(words[:first]))
            halves.append("")
        else:
            halves.append(" ".join(words[:second]))
        rest = " ".join(words[second:])
    # From the inside out: a half competes with all that follows it.
    for half in reversed(halves):
        rest = _fuller(half, rest) if half else f"{left.pop()} {rest}".strip()
    return rest


def without_repeats(text: Column) -> Column:
    """G6 as a column; null stays null."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else said_once(t))

    return run(text)


def _common_at_most(one: dict[str, int], length: int, other: str) -> int:
    """Length of the longest common subsequence, by bits; no matching of runs has more characters."""
    row = full = (1 << length) - 1
    for c in other:
        met = row & one.get(c, 0)
        row = (row + met | row - met) & full
    return length - row.bit_count()


def owners(keys: list[str], ratio: float = MERGE_RATIO) -> list[int]:
    """For each text the place of the one that it is merged into: the first that is alike and isn't
    merged itself. Alike means a ``difflib`` ratio of ``ratio`` or more.

    Only pairs that may reach the ratio are compared: by their lengths, by the letters that they have
    in common, and by their longest common subsequence, each of which bounds it.
    """
    n = len(keys)
    out = list(range(n))
    sizes = np.array([len(k) for k in keys])
    letters = {c: i for i, c in enumerate(sorted(set("".join(keys))))}
    counts = np.zeros((n, len(letters)), np.int32)
    for i, key in enumerate(keys):
        np.add.at(counts[i], [letters[c] for c in key], 1)
    free = sizes > 0
    for i in range(n):
        if not free[i]:
            continue
        later = np.flatnonzero(free[i + 1 :]) + i + 1
        need = ratio * (sizes[i] + sizes[later]) / 2 - 1e-9
        later, need = (x[np.minimum(sizes[i], sizes[later]) >= need] for x in (later, need))
        may = np.minimum(counts[i], counts[later]).sum(1) >= need
        places: dict[str, int] = {}
        for at, c in enumerate(keys[i]):
            places[c] = places.get(c, 0) | 1 << at
        for j, least in zip(later[may].tolist(), need[may].tolist(), strict=True):
            if _common_at_most(places, len(keys[i]), keys[j]) >= least and difflib.SequenceMatcher(None, keys[i], keys[j]).ratio() >= ratio:
                out[j] = i
                free[j] = False
    return out


def notes_lines(docs: DataFrame, markdown: str = "markdown", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, slot, line, notes): lines of Markdown; ``notes`` is the slot of the title of the notes
    section that a line is in, or null. Between two headings the first title of notes begins one."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(markdown), F.lit("")), "\n")).alias("slot", "line"))
    heading, title = F.col("line").startswith("#"), F.col("line").rlike(NOTES_TITLE)
    upto = Window.partitionBy("doc_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    headed = lines.withColumn("heading", F.coalesce(F.max(F.when(heading, F.col("slot"))).over(upto), F.lit(-1)))
    start = F.min(F.when(title, F.col("slot"))).over(Window.partitionBy("doc_id", "heading"))
    return headed.withColumn("start", start).select("doc_id", "slot", "line", F.when(F.col("slot") > F.col("start"), F.col("start")).alias("notes"))


def clean_notes(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, slot, line, notes) without garbled bullets, and with alike ones merged in
    the place of the first of them; bullets outside of notes and all other lines stay."""
    bullet = F.col("notes").isNotNull() & F.col("line").rlike(BULLET)
    text = without_repeats(F.regexp_extract("line", BULLET, 2))
    bullets = lines.where(bullet).select("doc_id", "notes", "slot", F.regexp_extract("line", BULLET, 1).alias("mark"), text.alias("text"))
    bullets = bullets.where((F.col("text") != "") & ~is_garbled(F.col("text"))).withColumn("key", dedup_key(F.col("text")))
    kind = bullets.schema["doc_id"].dataType.simpleString()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("slot").reset_index(drop=True)
        return frame.assign(owner=frame["slot"].to_numpy()[owners(frame["key"].tolist())])

    owned = bullets.groupBy("doc_id", "notes").applyInPandas(merge, f"doc_id {kind}, notes int, slot int, mark string, text string, key string, owner int")
    group = F.sort_array(F.collect_list(F.struct("slot", "mark", "text")))
    best = owned.groupBy("doc_id", "notes", F.col("owner").alias("slot")).agg(group.alias("all"))
    chosen = F.aggregate(F.col("all"), F.col("all")[0]["text"], lambda acc, x: better_of(acc, x["text"]))
    made = best.select("doc_id", "notes", "slot", F.col("all")[0]["mark"].alias("mark"), chosen.alias("text"))
    first = first_by_key(made.withColumn("section", F.struct("doc_id", "notes")), "section", "slot")
    return lines.where(~bullet).select("doc_id", "slot", "line").unionByName(first.select("doc_id", "slot", F.concat("mark", "text").alias("line")))


def postprocessed(docs: DataFrame, markdown: str = "markdown", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with cleaned Markdown, and lines and characters before and after.

    ``doc_id`` names one row. A null text counts as an empty one.
    """
    lines = clean_notes(notes_lines(docs, markdown, doc_id))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "line"))), lambda x: x["line"]), "\n")
    cleaned = lines.groupBy(F.col("doc_id").alias("__id")).agg(joined.alias("cleaned"))
    n = lambda c: F.size(F.split(c, "\n"))
    made = docs.join(cleaned, F.col(doc_id).eqNullSafe(F.col("__id")), "left").drop("__id").withColumn("cleaned", F.coalesce("cleaned", F.lit("")))
    return made.withColumns({"lines_before": n(F.coalesce(F.col(markdown), F.lit(""))), "lines_after": n(F.col("cleaned")), "chars_before": F.length(F.coalesce(F.col(markdown), F.lit(""))), "chars_after": F.length("cleaned")})
