"""Learning from a corpus.

Each kind of knowledge is a table of its own, not a part of one dictionary; a document
adds rows, and merging adds counts, so the order of documents and lost tasks don't matter. Where
the first or the last one wins, an order column decides.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, TimestampNTZType

from ..functions.text import fold_lower, fold_upper, has_marks, is_loose_syllable, words

# Words that no term contains or begins and ends with.
STOPWORDS = "của và là các những được trong theo với cho này đó khi đã sẽ có không như tại trên dưới từ đến để một hoặc nếu thì mà do bởi vì nên cũng rất thêm gồm bao sau trước ra vào tới".split()
# Folded words that an acronym may leave out, inside a phrase and before it.
CONNECTORS, LEADERS = ["va", "cua", "cac", "de", "cho", "cong"], ["he", "thong"]
# How a text defines an abbreviation; groups are (acronym, phrase) in turn.
FULL_THEN_ACRONYM = r"([A-Za-zÀ-ỹĐđ][\wÀ-ỹĐđ]*(?:\s+[\wÀ-ỹĐđ]+){1,7})\s*\(\s*([A-ZĐ]{2,8})\s*\)"
ACRONYM_THEN_FULL = r"\b([A-ZĐ]{2,8})\s*\(\s*([A-Za-zÀ-ỹĐđ][^)\n]{3,60})\)"
LEGEND = r"(?m)^\s*([A-ZĐ]{2,8})\s*[:=]\s*([A-ZÀ-Ỹ][A-Za-zÀ-ỹĐđ ]{3,60})$"
TRUSTED_METHODS = ["pdftext_fast", "pdftext_fast+shx_annot", "office_native"]
VERIFIED_COUNT, VERIFIED_DOCS, VERIFIED_SHARE = 3, 2, 0.90


def grams(tokens: Column, n: int) -> Column:
    """The runs of ``n`` tokens; ``tokens`` should be a plain column."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.slice(tokens, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))


def _stop(word: Column) -> Column:
    return F.lower(word).isin(*STOPWORDS)


def terms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """H2: (term, cnt): runs of 2 or 3 words, half of them with marks and no stop word among them,
    that a document has twice or more, with the sum over documents."""
    # Tokens are a column of their own: as an expression they would be found anew for every run.
    tokens = docs.select(F.col(doc_id).alias("doc_id"), F.filter(words(F.col(text)), lambda w: F.length(w) >= 2).alias("t"))
    found = tokens.select("doc_id", F.explode(F.concat(grams(F.col("t"), 2), grams(F.col("t"), 3))).alias("g"))
    found = found.where(~F.exists("g", _stop) & (F.size(F.filter("g", has_marks)) >= F.floor((F.size("g") + 1) / 2)))
    counted = found.groupBy("doc_id", F.lower(F.array_join("g", " ")).alias("term")).count().where("count >= 2")
    return counted.groupBy("term").agg(F.sum("count").alias("cnt"))


def is_trustworthy(text: Column) -> Column:
    """H4: 30 words or more, 90 % of them syllables, 25 % with marks, few tiny lines."""
    w = words(F.coalesce(text, F.lit("")))
    n = F.size(w)
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), F.trim), lambda x: x != "")
    tiny = F.size(F.filter(lines, lambda x: F.length(x) <= 2)) / F.greatest(F.lit(1), F.size(lines))
    return (n >= 30) & (F.size(F.filter(w, is_loose_syllable)) >= n * 0.9) & (F.size(F.filter(w, has_marks)) >= n * 0.25) & (tiny < 0.08)


def trusted_pages(pages: DataFrame, method: str = "method", text: str = "text") -> DataFrame:
    """Pages from a source that can be trusted, and that read like Vietnamese."""
    return pages.where(F.col(method).isin(*TRUSTED_METHODS) & is_trustworthy(F.col(text)))


def verified_terms(pages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """H5: (term, cnt, docs) from trustworthy pages: runs of 2 or 3 syllables within a line and
    between signs and digits, that don't begin or end with a stop word and have a mark."""
    parts = F.flatten(F.transform(F.split(F.col(text), r"\r\n|\r|\n"), lambda line: F.split(line, r"[^\sA-Za-zÀ-ỹĐđ]+")))
    split = pages.where(is_trustworthy(F.col(text))).select(F.col(doc_id).alias("doc_id"), F.explode(parts).alias("part"))
    low = split.select("doc_id", F.filter(F.split(F.lower("part"), r"\s+"), lambda w: w != "").alias("t"))
    found = low.select("doc_id", F.explode(F.concat(grams(F.col("t"), 2), grams(F.col("t"), 3))).alias("g"))
    found = found.where(~_stop(F.get("g", F.lit(0))) & ~_stop(F.element_at("g", -1)) & F.forall("g", is_loose_syllable) & F.exists("g", has_marks))
    by_doc = found.groupBy("doc_id", F.array_join("g", " ").alias("term")).count()
    return by_doc.groupBy("term").agg(F.sum("count").alias("cnt"), F.count(F.lit(1)).alias("docs"))


def verified_map(terms: DataFrame, least: int = VERIFIED_COUNT, docs: int = VERIFIED_DOCS, share: float = VERIFIED_SHARE) -> DataFrame:
    """(key, phrase): for each folded phrase the way it is written nearly always."""
    grouped = terms.groupBy(fold_lower(F.col("term")).alias("key")).agg(F.max(F.struct("cnt", "docs", "term")).alias("best"), F.sum("cnt").alias("total"))
    return grouped.where((F.col("best.cnt") >= least) & (F.col("best.docs") >= docs) & (F.col("best.cnt") >= F.col("total") * share) & (F.col("best.term") != F.col("key"))).select("key", F.col("best.term").alias("phrase"))


def merged_terms(known: DataFrame, new: DataFrame) -> DataFrame:
    """H3, H5, Q4: counts of both added up."""
    sums = [F.sum(c).alias(c) for c in known.columns if c != "term"]
    return known.unionByName(new).groupBy("term").agg(*sums)


def _initials(w: Column) -> Column:
    return F.array_join(F.transform(w, lambda x: fold_upper(F.substring(x, 1, 1))), "")


def expansion(acronym: Column, phrase: Column) -> Column:
    """The last words of a phrase whose initials are the acronym, or null.

    Windows of as many words as the acronym has letters and up to three more are tried, the shortest
    first, as they are and without connecting words.
    """
    w = F.filter(F.split(F.trim(phrase), r"\s+"), lambda x: x.rlike(r"^\p{L}"))
    a = fold_upper(acronym)
    n = F.length(a)
    core = lambda x, skip: F.filter(x, lambda y: ~fold_lower(y).isin(*skip))

    def tried(extra: int) -> Column:
        size = n + extra
        window = F.slice(w, F.greatest(F.size(w) - size + 1, F.lit(1)), F.greatest(size, F.lit(1)))
        inner = core(window, CONNECTORS + LEADERS)
        fits = (size >= 2) & (size <= F.size(w))
        return F.when(fits & (_initials(window) == a), F.array_join(window, " ")).when(fits & (_initials(inner) == a) & (F.size(inner) >= 2), F.array_join(inner, " "))

    whole = F.when((F.size(w) >= 2) & ((_initials(w) == a) | (_initials(core(w, CONNECTORS)) == a)), F.trim(phrase))
    return F.coalesce(*(tried(i) for i in range(4)), whole)


def abbreviations(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """H1: (acro, expansion): definitions in texts; of several the first in the first document."""
    t = F.col(text)
    pairs = []
    ranked = lambda rank: lambda a, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), a.alias("acro"))
    for rank, (pattern, acro, full) in enumerate(((FULL_THEN_ACRONYM, 2, 1), (ACRONYM_THEN_FULL, 1, 2), (LEGEND, 1, 2))):
        p = F.lit("(?U)" + pattern)
        heads = F.transform(F.regexp_extract_all(t, p, acro), ranked(rank))
        pairs.append(F.zip_with(heads, F.regexp_extract_all(t, p, full), lambda h, f: F.struct(h["rank"].alias("rank"), h["i"].alias("i"), h["acro"].alias("acro"), f.alias("full"))))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.concat(*pairs)).alias("x"))
    acro = F.upper(F.trim("x.acro"))
    full = F.regexp_replace(F.regexp_replace("x.full", r"\s+", " "), r"^[ .:\-–—]+|[ .:\-–—]+$", "")
    made = found.select("doc_id", "x.rank", "x.i", acro.alias("acro"), expansion(acro, full).alias("expansion")).where(F.size(F.split("expansion", " ")) >= 2)
    return made.groupBy("acro").agg(F.min_by("expansion", F.struct("doc_id", "rank", "i")).alias("expansion"))


def new_entries(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """H3: entries that were not known."""
    return found.join(known.select(key), key, "left_anti")


def corrections(pairs: DataFrame) -> DataFrame:
    """H6: (raw, corrected, cnt, safe, source) from pairs (raw, corrected, source, ts).

    The last correction wins; it is safe to apply anywhere if there is no digit on either side and
    it is short and on one line. Empty pairs, unchanged ones and single letters are left out.
    """
    raw, good = F.trim(F.regexp_replace("raw", "⟦[^⟧]*⟧", "")), F.trim("corrected")
    clean = pairs.select(raw.alias("raw"), good.alias("corrected"), "source", "ts").where((F.col("raw") != "") & (F.col("corrected") != "") & (F.col("raw") != F.col("corrected")) & (F.length("raw") >= 2))
    out = clean.groupBy("raw").agg(F.max_by("corrected", F.struct("ts", "corrected")).alias("corrected"), F.count(F.lit(1)).alias("cnt"), F.max_by("source", F.struct("ts", "source")).alias("source"))
    safe = ~F.col("raw").rlike(r"\d") & ~F.col("corrected").rlike(r"\d") & (F.length("raw") <= 60) & ~F.col("raw").contains("\n")
    return out.withColumn("safe", safe)


def safe_corrections(table: DataFrame, least: int = 1) -> DataFrame:
    """H7."""
    return table.where(F.col("safe") & (F.col("cnt") >= least)).select("raw", "corrected", "cnt")


def _replaced(a: list[str], b: list[str]) -> Iterator[tuple[list[str], list[str]]]:
    """What stands for each other between the parts that two lists share."""
    i = j = 0
    for k, n, size in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        if k > i and n > j:
            yield a[i:k], b[j:n]
        i, j = k + size, n + size


def diff_pairs(before: str, after: str, most: int = 6) -> list[tuple[str, str]]:
    """H8: pairs of words that an edit changed, of ``most`` words at most on either side.

    Between lines that both have, the words of what was there and of what is there now are compared,
    on however many lines they stand; lines that were only put in or taken out say nothing.
    """
    bare = lambda words: " ".join(words).strip(" .,;:!?()[]\"'|*")
    runs = (run for old, new in _replaced(before.splitlines(), after.splitlines()) for run in _replaced(" ".join(old).split(), " ".join(new).split()))
    pairs = ((bare(old), bare(new)) for old, new in runs if max(len(old), len(new)) <= most)
    return [(x, y) for x, y in pairs if x != y and re.search(r"\w", x) and re.search(r"\w", y)]


def edited_pairs(edits: DataFrame) -> DataFrame:
    """H8: (raw, corrected, source, ts) from edits (before, after, source, ts)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(x, y, e.source, e.ts) for e in frame.itertuples() for x, y in diff_pairs(e.before or "", e.after or "")]
            yield pd.DataFrame(rows, columns=["raw", "corrected", "source", "ts"])

    kinds = {f.name: f.dataType.simpleString() for f in edits.schema}
    return edits.select("before", "after", "source", "ts").mapInPandas(run, f"raw string, corrected string, source {kinds['source']}, ts {kinds['ts']}")


def learned_totals(folders: DataFrame) -> DataFrame:
    """H9: sums over folders that anything was learned from: (folder, learned, numeric)."""
    return folders.where("learned > 0 or numeric > 0").agg(F.count(F.lit(1)).alias("folders"), F.coalesce(F.sum("learned"), F.lit(0)).alias("learned"), F.coalesce(F.sum("numeric"), F.lit(0)).alias("numeric"))


# Folded words of headers and the column they stand for.
HEADER_ALIASES = {"so hieu": "mark", "ten cau kien": "element", "hang muc": "item_name", "khoi luong": "quantity", "don gia": "unit_price", "thanh tien": "total_price", "quy cach": "specs", "tieu chuan ky thuat": "standard", "chung loai": "material_type"}


def header_aliases(tables: DataFrame) -> DataFrame:
    """(alias, column) from tables' headers; it reads ``header`` and folds đ, unlike what it follows."""
    h = tables.select(F.explode("header").alias("h")).select(F.trim(fold_lower(F.col("h"))).alias("alias")).where("alias <> ''").distinct()
    column = F.coalesce(*(F.when(F.col("alias").contains(word), column) for word, column in HEADER_ALIASES.items()))
    return h.withColumn("column", column).where("column is not null")


#: Epochs whose sums run in one task.
EPOCHS_AT_ONCE = 100_000


def epochs(log: DataFrame) -> DataFrame:
    """(epoch, document, pages, new_terms, cumulative_terms, cumulative_pages) by running sums.

    Epochs are numbers, dates or times. A log of over ``EPOCHS_AT_ONCE`` is cut at its percentiles: sums
    run within a part, and go on from the sums of the parts before. Equal epochs are in one part, and
    add up in the order of their other columns.
    """
    parts = -(-log.count() // EPOCHS_AT_ONCE)
    at = F.col("epoch").cast("timestamp") if isinstance(log.schema["epoch"].dataType, TimestampNTZType) else F.col("epoch")
    cuts = sorted(set(log.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)])).first()[0])) if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < at)) if cuts else F.lit(0)
    rest = [F.col(c) for c in log.columns if c != "epoch" and not isinstance(log.schema[c].dataType, MapType)]
    run = Window.partitionBy("__part").orderBy("epoch", *rest).rowsBetween(Window.unboundedPreceding, 0)
    dealt = log.withColumn("__part", part)
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("__part").agg(F.sum("new_terms").alias("t"), F.sum("pages").alias("p"))  # one row for each part
    before = sums.select("__part", F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("t"), F.coalesce(F.sum("p").over(upto), F.lit(0)).alias("p"))
    within = dealt.withColumns({"cumulative_terms": F.sum("new_terms").over(run), "cumulative_pages": F.sum("pages").over(run)})
    return within.join(F.broadcast(before), "__part").select(*log.columns, (F.col("cumulative_terms") + F.col("t")).alias("cumulative_terms"), (F.col("cumulative_pages") + F.col("p")).alias("cumulative_pages"))


def summary(log: DataFrame, last: int = 5) -> DataFrame:
    """Totals over all epochs, and the sum of lessons of the last five."""
    recent = log.orderBy(F.desc("epoch")).limit(last).agg(F.sum(F.aggregate(F.map_values("lessons"), F.lit(0).cast("long"), lambda a, x: a + x)).alias("recent_lessons"))
    return log.agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages")).crossJoin(F.broadcast(recent))


def largest_copy(candidates: DataFrame) -> DataFrame:
    """Of copies of the knowledge base the one that has read most documents; of equals the local one."""
    return candidates.agg(F.max_by("payload", F.struct("total_documents_read", "is_local")).alias("payload"))


def not_learned(docs: DataFrame, history: DataFrame, key: str = "document") -> DataFrame:
    """Documents that are not in the history."""
    return docs.join(history.select(key).distinct(), key, "left_anti")
