"""Text as column expressions (D1-D30): folding, keys, tokens, encodings, syllables, predicates.

Texts are expected in composed form (NFC); ``composed`` brings them there.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tone marks and vowel marks of Vietnamese, from which its letters are composed.
_TONES = ["", "̀", "́", "̃", "̉", "̣"]
_VOWELS = ["a", "ă", "â", "e", "ê", "i", "o", "ô", "ơ", "u", "ư", "y"]


@cache
def letters() -> tuple[str, str]:
    """All Vietnamese letters with marks, and the plain letter of each, in the same order."""
    marked, plain = ["đ", "Đ"], ["d", "D"]
    for vowel in _VOWELS:
        for tone in _TONES:
            for case in (str.lower, str.upper):
                letter = unicodedata.normalize("NFC", case(vowel[0]) + vowel[1:] + tone)
                if len(letter) == 1 and letter not in "aeiouyAEIOUY":
                    marked.append(letter)
                    plain.append(case(vowel[0]))
    # Letters of other languages with the same marks.
    for code in range(0xC0, 0x180):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter and base.isascii() and letter not in marked:
            marked.append(letter)
            plain.append(base)
    return "".join(marked), "".join(plain)


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFC, once when texts come in; no built-in function composes."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def fold(text: Column) -> Column:
    """Marks taken off, letter by letter, so that lengths stay."""
    return F.translate(text, *letters())


def fold_upper(text: Column) -> Column:
    """Folded capitals."""
    return F.upper(fold(text))


def fold_lower(text: Column) -> Column:
    return F.lower(fold(text))


def fold_key(text: Column) -> Column:
    """D3: folded capitals and digits only."""
    return F.regexp_replace(fold_upper(text), "[^0-9A-Z]", "")


def has_any(key: Column, words: list[str]) -> Column:
    """D3: whether any of a fixed list of words is in a key."""
    out = F.lit(False)
    for w in words:
        out = out | key.contains(w)
    return F.coalesce(out, F.lit(False))


def count_hits(key: Column, words: list[str]) -> Column:
    """How many of a fixed list of words are in a key."""
    return sum((F.when(key.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def search_folded(text: Column, before: str, group: str) -> Column:
    """What ``group`` matches after ``before`` in the folded text, as the original writes it."""
    folded = fold(text)
    whole = F.regexp_extract(folded, f"(?iu){before}({group})", 0)
    inner = F.regexp_extract(folded, f"(?iu){before}({group})", 1)
    start = F.regexp_instr(folded, F.lit(f"(?iu){before}({group})")) + F.length(whole) - F.length(inner)
    return F.when(F.length(whole) > 0, F.regexp_replace(F.substring(text, start, F.length(inner)), r"^[ :.\-|]+|[ :.\-|]+$", ""))


TOKEN = "[a-zA-Z0-9À-ỹØø]+(?:[-_/][a-zA-Z0-9À-ỹØø]+)*"


def tokens(text: Column) -> Column:
    """Lower-case tokens; codes such as KC-05 stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def words(text: Column) -> Column:
    """Runs of Latin letters, Vietnamese ones included."""
    return F.regexp_extract_all(text, F.lit("([A-Za-zÀ-ỹĐđ]+)"), 1)


def has_marks(word: Column) -> Column:
    """Whether a word differs from its folded form."""
    return F.lower(word) != fold_lower(word)


def already_accented(line: Column, least: int = 3, share: float = 0.4) -> Column:
    """A line of three or more words of which two in five have marks."""
    long = F.filter(words(line), lambda w: F.length(w) >= 2)
    return (F.size(long) >= least) & (F.size(F.filter(long, has_marks)) >= F.size(long) * share)


# The 8-bit code of Vietnamese letters after TCVN 5712, as Latin-1 shows it.
_TCVN3 = ("¸µ¶·¹¨¾»¼½Æ©ÊÇÈÉË®ÐÌÎÏÑªÕÒÓÔÖÝ×ØÜÞãßáâä«èåæçé¬íêëìîóïñòô­øõö÷ùýúûüþ¡¢§£¤¥¦", "áàảãạăắằẳẵặâấầẩẫậđéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵĂÂĐÊÔƠƯ")


def tcvn3(text: Column, upper: bool = False) -> Column:
    """TCVN3 to Unicode, letter by letter."""
    out = F.translate(text, *_TCVN3)
    return F.upper(out) if upper else out


def looks_like_tcvn3(text: Column) -> Column:
    """Two or more letters that TCVN3 texts are full of, 8 % of all, and no real Vietnamese."""
    hits = F.regexp_count(text, F.lit("[µ¶·¹¸¨©ª«¬®­¾»¼½Æ]"))
    all_ = F.regexp_count(text, F.lit(r"\p{L}|[µ¶·¹¸¨©ª«¬®­¾»¼½Æ]"))
    return (hits >= 2) & (hits >= all_ * 0.08) & ~text.rlike("[ạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹđ]")


def looks_like_vni(text: Column) -> Column:
    """Words with VNI's digits-turned-marks: two in a short text, three and a tenth in a longer one."""
    marks = "[aeouyAEOUY][ùøûõïåäáàâãÙØÛÕÏÅÄÁÀÂÃ]|[ñÑ]|[öôÖÔ][ùøûõïÙØÛÕÏ]?"
    all_ = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    hits = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w.rlike(marks)))
    return F.when(all_ <= 6, hits >= 2).otherwise((hits >= 3) & (hits >= all_ * 0.1)) & ~text.rlike("[ạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹđ]")


# Onsets, nuclei and codas of Vietnamese syllables without marks.
ONSETS = "ngh|ng|nh|ch|gh|gi|kh|ph|qu|th|tr|b|c|d|g|h|k|l|m|n|p|r|s|t|v|x"
NUCLEI = "a|e|i|o|u|y|ai|ao|au|ay|eo|eu|ia|ie|iu|oa|oe|oi|oo|ua|ue|ui|uo|uu|uy|ye|ieu|yeu|oai|oao|oay|oeo|uay|uoi|uou|uya|uye|uyu"
CODAS = "ch|ng|nh|c|m|n|p|t"


def is_syllable(word: Column) -> Column:
    """A token that can be a syllable, up to 7 letters."""
    w = fold_lower(word)
    return (F.length(w) <= 7) & w.rlike(f"^(?:{ONSETS})?(?:{NUCLEI})(?:{CODAS})?$")


def is_loose_syllable(word: Column) -> Column:
    """As ``is_syllable``, with any one to three vowels."""
    w = fold_lower(word)
    return (F.length(w) <= 7) & w.rlike(f"^(?:{ONSETS})?[aeiouy]{{1,3}}(?:{CODAS})?$")


def likeness(text: Column) -> Column:
    """Share of syllables among tokens of two letters or more; null below six tokens."""
    t = F.filter(F.regexp_extract_all(fold_lower(text), F.lit("([a-z0-9]+)"), 1), lambda w: (F.length(w) >= 2) & w.rlike("[a-z]"))
    return F.when(F.size(t) >= 6, F.size(F.filter(t, is_syllable)) / F.size(t))


def is_garbled(text: Column) -> Column:
    """Long runs with hardly a vowel, or capitals without a space."""
    t = F.trim(text)
    alpha = F.regexp_count(t, F.lit(r"\p{L}"))
    vowels = F.regexp_count(fold_lower(t), F.lit("[aeiouy]"))
    ratio = vowels / F.nullif(alpha, F.lit(0))
    solid = ~t.contains(" ")
    upper = F.regexp_replace(t, "[-_]", "").rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")
    return F.coalesce((F.length(t) >= 8) & (alpha > 0) & (((ratio < 0.08) & (alpha >= 12)) | (solid & upper & (alpha >= 12) & (ratio < 0.2)) | (solid & upper & (F.length(t) >= 16) & ~t.rlike(r"[^\x00-\x7F]"))), F.lit(False))


def dedup_key(text: Column) -> Column:
    """Folded, lower-case, single spaces."""
    return F.trim(F.regexp_replace(fold_lower(text), r"\s+", " "))


def non_ascii(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x00-\x7F]"))


def better_of(a: Column, b: Column) -> Column:
    """Of two readings the one with clearly more marks, or that is clearly longer."""
    return F.when((non_ascii(b) > non_ascii(a) * 1.1) & (F.length(b) > 5), b).when(F.length(b) > F.length(a) * 1.2, b).otherwise(a)


# Words that open a heading.
HEADING_WORDS = "DỰ ÁN|GÓI THẦU|CÔNG TRÌNH|HẠNG MỤC|HỒ SƠ|PHẦN|CHƯƠNG|MỤC|DU AN|GOI THAU|CONG TRINH|HANG MUC|HO SO|PHAN|CHUONG|MUC"
HEADING_NUMBER = r"[0-9]{1,2}\.(?:[0-9]{1,2}\.?)*\s+[A-ZÀ-Ỹ]|[IVX]{1,5}\.\s|[a-e]\)\s"
HEADING = rf"(?U)^(?:{HEADING_NUMBER}|(?:{HEADING_WORDS})\b)"
# Unicode's spaces, without tabs and ends of lines.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def plain_spaces(text: Column) -> Column:
    """``text`` without Unicode's spaces around it, in which patterns find the white space of ASCII only.

    A vertical tab, a next line and Unicode's separators, which patterns of the JVM take for white space or
    the end of a line, become question marks; the length stays.
    """
    return F.translate(F.trim(text, F.lit(SPACES)), "\x0b\x85\u2028\u2029", "????")


def is_heading(text: Column, folded: bool = True) -> Column:
    """A numbered or named heading, or a line in capitals; not a number.

    Without ``folded`` the number has to stand there as written (``Í.`` isn't ``I.``), with white space of
    ASCII behind it, and words don't make a heading.
    """
    from .numbers import is_number_cell

    t = F.trim(text)
    letters_ = F.regexp_count(t, F.lit(r"\p{L}"))
    capitals = (letters_ >= 8) & ~t.rlike(r"\p{Ll}") & ~t.rlike(r"\d{3,}")
    if folded:
        first = F.split(t, r"\s+")[0]
        named = t.rlike(HEADING) | (first.rlike(r"\p{Lu}") & ~first.rlike(r"\p{Ll}") & fold_upper(t).rlike(HEADING))
    else:
        named = t.rlike(f"^(?:{HEADING_NUMBER})")
    return F.coalesce((t != "") & (F.length(t) <= 120) & ~is_number_cell(t) & (named | capitals), F.lit(False))


def is_list_item(text: Column) -> Column:
    """A bullet, or an item's number or letter."""
    return F.coalesce(F.trim(text).rlike(r"^(?:[+\-*•]|[a-zđ]\)\s|\d{1,2}[.)]?\s+\S|[IVX]{1,4}[.)]?\s+[A-ZÀ-Ỹ])"), F.lit(False))


def html_text(html: Column) -> Column:
    """Text of an HTML fragment, by expressions: tags off, common references decoded, spaces single."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def citation(page: Column, drawing: Column, section: Column) -> Column:
    """``Trang p • Bản vẽ s • section`` without what is blank."""
    part = lambda c, head: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(head), c.cast("string")))
    return F.concat_ws(" • ", part(page, "Trang "), part(drawing, "Bản vẽ "), part(section, ""))


def cited_pages(text: Column) -> Column:
    """Page numbers that an answer cites."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[Trang\s+(\d+)"), 1), lambda p: p.cast("int"))


def clock(seconds: Column) -> Column:
    """Mm:ss."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("long"), (seconds.cast("long") % 60))


def percent(done: Column, total: Column, low: int = 0, high: int = 100) -> Column:
    """Progress between two marks."""
    return (F.lit(low) + F.floor(done / total * (high - low))).cast("int")


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the speed so far."""
    return F.when(done > 0, (total - done) * elapsed / done)
