"""License scan by canonical digests: whole texts, and whole lines, that are a known license or notice.

A text's canonical form has lower case only, no copyright lines, no punctuation, one space between
words and one spelling for words that are spelled in several ways. Letters and digits of all scripts
are kept, so a text with anything added, in any language, is another text. The SHA-256 of that form is
joined to the digests of known texts. All of it is DataFrame functions; the known digests are a
table of fixed size, so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .known_licenses import EQUIVALENT, FULL_TEXTS, IN_SENTENCES, KNOWN

#: Most known texts that are broadcast; a larger table is joined by a shuffle.
MOST_BROADCAST = 10_000

_LETTER, _OTHER = r"[\p{L}\p{M}\p{N}]", r"[^\p{L}\p{M}\p{N}]"
_LEAD = r"(?:^|\n)[^\n\p{L}\p{M}\p{N}]*"
#: What only a notice has: a year, a place for one, or the reservation of rights.
_NOTICE = r"(?:[0-9]{4}|19yy|year|yyyy|all rights reserved)"
#: A line that is a copyright notice. One that begins with the word is, if it has what a notice has,
#: or goes on with a name: the next word isn't one of those that follow in the middle of a sentence.
COPYRIGHT_LINE = "|".join([
    rf"{_LEAD}©[^\n]*",
    rf"{_LEAD}(?:copyright(?!{_LETTER})|\(c\))[^\n]*{_NOTICE}[^\n]*",
    rf"{_LEAD}copyright(?!{_LETTER})[^\n\p{{L}}\p{{M}}\p{{N}}]*(?!(?:{'|'.join(IN_SENTENCES)})(?!{_LETTER})){_LETTER}[^\n]*",
    rf"{_LEAD}all rights reserved[^\n\p{{L}}\p{{M}}\p{{N}}]*(?=\n|$)",
])


def canonical(text: Column) -> Column:
    """Canonical form of a text; null stays null."""
    out = F.lower(F.replace(text, F.lit("İ"), F.lit("i")))
    out = F.replace(F.replace(out, F.lit("ς"), F.lit("σ")), F.lit("&"), F.lit(" and "))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    out = F.trim(F.regexp_replace(out, f"{_OTHER}+", " "))
    for one, other in EQUIVALENT:
        out = F.replace(out, F.lit(one), F.lit(other))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def _rows(spark: SparkSession, values: list[tuple[str, str]], *names: str) -> DataFrame:
    """A table of two columns of constants."""
    made = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names, strict=True))) for row in values))
    return spark.range(1).select(F.explode(made).alias("x")).select("x.*")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``(digest, license)`` of known texts; of equal texts under several names the first in order."""
    return _rows(spark, known, "license", "text").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), known: list[tuple[str, str]] = KNOWN, full: list[tuple[str, str, str]] = FULL_TEXTS) -> DataFrame:
    """The columns ``keep`` of ``docs``, ``digest``, ``license`` and ``line_licenses``.

    ``digest``: SHA-256 of the whole text's canonical form; ``license``: the known text that has the
    same, or null; ``line_licenses``: sorted names of the known texts that a whole line is. ``full``
    are more known texts, as name, first word and digest of their canonical form.

    One row for each row of ``docs``, repeated ones too. A null text has a null digest and no
    lines; an empty one, or one of punctuation or copyright lines only, has the digest of the empty
    string, which no known text has. A text of any length is hashed as a whole. An empty table gives
    no rows; other columns may have any names.
    """
    spark = docs.sparkSession
    names = known_digests(spark, known)
    # The known texts are a parameter; their digests by name are a constant of the plan.
    pairs = list({**{of: name for name, _, of in full}, **{r.digest: r.license for r in names.collect()}}.items())
    lookup = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    # A line is only worth a digest if it begins with a word that some known text begins with, in
    # either spelling.
    first = {canon.split(" ")[0] for (canon,) in _rows(spark, known, "license", "text").select(canonical(F.col("text"))).collect() if canon}
    begin = sorted(word.replace("license", "licen[cs]e") for word in first | {word for _, word, _ in full})
    worth = rf"(?iu)^{_OTHER}*(" + "|".join(begin) + rf")({_OTHER}|$)"
    candidates = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(worth))
    lines = F.array_sort(F.array_distinct(F.filter(F.transform(candidates, lambda x: F.element_at(lookup, digest(x))), lambda x: x.isNotNull())))
    scanned = docs.select(*keep, digest(F.col(text)).alias("digest"), F.coalesce(lines, F.array().cast("array<string>")).alias("line_licenses"))
    small = _rows(spark, pairs, "digest", "license")
    return scanned.join(F.broadcast(small) if len(pairs) <= MOST_BROADCAST else small, "digest", "left").select(*keep, "digest", "license", "line_licenses")


def sql(known: list[tuple[str, str]] = KNOWN) -> str:
    """DuckDB SQL with the rows of ``license_scan`` over ``documents``, line names joined by commas."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    lead, rest = r"^[^\p{L}\p{M}\p{N}]*", r"[^\p{L}\p{M}\p{N}]"
    # Line by line, and without looking ahead: a notice, or a name after the word.
    notice = f"regexp_matches(l, {quoted(f'{lead}©')}) OR (regexp_matches(l, {quoted(f'{lead}(copyright({rest}|$)|[(]c[)])')}) AND regexp_matches(l, {quoted(_NOTICE)})) OR regexp_matches(l, {quoted(f'{lead}all rights reserved{rest}*$')})"
    named = f"(regexp_matches(l, {quoted(f'{lead}copyright{rest}+[^ ]')}) AND regexp_extract(l, {quoted(f'{lead}copyright{rest}+([' + chr(92) + 'p{L}' + chr(92) + 'p{M}' + chr(92) + 'p{N}]+)')}, 1) NOT IN ('', {', '.join(map(quoted, IN_SENTENCES))}))"

    def form(x: str) -> str:
        out = f"array_to_string(list_filter(string_split(replace(replace(lower(replace({x}, 'İ', 'i')), 'ς', 'σ'), '&', ' and '), chr(10)), lambda l: NOT ({notice} OR {named})), chr(10))"
        out = f"trim(regexp_replace({out}, {quoted(rest + '+')}, ' ', 'g'))"
        for one, other in EQUIVALENT:
            out = f"replace({out}, {quoted(one)}, {quoted(other)})"
        return out

    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in known)
    return f"""
WITH known AS (SELECT sha256({form("t")}) AS digest, min(n) AS license FROM (VALUES {values}) AS v(n, t) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
hits AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM lines JOIN known ON sha256({form("line")}) = digest GROUP BY doc_id)
SELECT d.doc_id, sha256({form("d.text")}) AS digest, k.license, coalesce(h.line_licenses, '') AS line_licenses
FROM documents d LEFT JOIN known k ON sha256({form("d.text")}) = k.digest LEFT JOIN hits h ON h.doc_id = d.doc_id"""
