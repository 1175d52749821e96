"""Text functions as Column builders; only Unicode normalisation needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc_udf():
    """The normaliser as a pandas UDF, for `nfc` and for registration under an SQL name."""
    return F.pandas_udf(_nfc, "string")


def nfc(col) -> Column:
    """Unicode NFC. Texts of ASCII alone are already normal, and null stays null."""
    c = _col(col)
    plain = c.rlike(r"^\p{ASCII}*$")
    return F.when(plain | c.isNull(), c).otherwise(nfc_udf()(F.when(~plain, c)))


#: Fixed value: marks that cleaning keeps beside letters, marks, digits, underscores and blanks.
KEPT_MARKS = ".,!?'\"¿¡·’-"


def clean_text(col) -> Column:
    return F.regexp_replace(_col(col), r"[^\p{L}\p{M}\p{N}_\s" + KEPT_MARKS.replace("-", r"\-") + "]", "")


def ctc_form(col, normalise: bool = True) -> Column:
    """Trimmed, lower-case, NFC, without punctuation."""
    low = F.lower(F.trim(_col(col)))
    return F.regexp_replace(nfc(low) if normalise else low, r"\p{P}", "")


def characters(form: Column) -> Column:
    return F.filter(F.split(form, ""), lambda c: c != "")


def unsupported_chars(form, vocabulary: list[str], blank: str = "<pad>", delimiter: str = "|") -> Column:
    """The first character that is no letter, or not in the vocabulary; 'space' for a blank inside; null if there is none."""
    f = _col(form)
    bad = F.filter(characters(f), lambda c: ~c.isin([v for v in vocabulary if v not in (blank, delimiter)]) | ~c.rlike(r"^\p{L}$"))
    return F.when(f.rlike(r"\s"), F.lit("space")).otherwise(F.try_element_at(bad, F.lit(1)))


def pause_symbol(gap_seconds) -> Column:
    """[0.5, 1) a comma, [1, 1.5] a stop, above three stops; empty below."""
    g = _col(gap_seconds)
    return F.when(g > 1.5, "...").when(g >= 1.0, ".").when(g >= 0.5, ",").otherwise("")


def pause_symbol_v0(gap_seconds) -> Column:
    """The older rule: above 0.5 a comma, above 1 a stop, above 2 three stops."""
    g = _col(gap_seconds)
    return F.when(g > 2.0, "...").when(g > 1.0, ".").when(g > 0.5, ",").otherwise("")


def lexical_words(text) -> Column:
    """Tokens between blanks that hold a letter or digit."""
    return F.filter(F.split(_col(text), r"\s+"), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def format_number(col) -> Column:
    """14.0 -> '14', 7.5 -> '7.5'."""
    c = _col(col)
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def txt_name(col) -> Column:
    return F.regexp_replace(_col(col), r"\.wav$", ".txt")


def uid_from_path(col, exts: list[str] | None = None) -> Column:
    """The base name without its extension; only known extensions are cut if `exts` is given."""
    base = F.regexp_extract(_col(col), r"([^/]*)$", 1)
    return F.regexp_replace(base, r"\.[^.]*$" if exts is None else r"(?i)\.(" + "|".join(exts) + ")$", "")


def classify_path(col, rules: list[tuple[str, str]]) -> Column:
    """The class of the first rule whose text the path contains; null is a violation."""
    c = _col(col)
    out = F.when(c.contains(rules[0][0]), rules[0][1])
    for text, name in rules[1:]:
        out = out.when(c.contains(text), name)
    return out


def report_line(word, start, end, other_start, other_end) -> Column:
    """A fixed-width line for review; dashes where there is no interval."""
    num = lambda c: F.coalesce(F.format_string("%9.3f", _col(c)), F.lit("        -"))
    return F.concat(F.rpad(F.substring(_col(word), 1, 16), 16, " "), *[F.when(_col(c).isNull(), F.lit("        -")).otherwise(num(c)) for c in (start, end, other_start, other_end)])


def vocab_alias(map_col) -> Column:
    """Upper-case single letters of a vocabulary's keys in lower case; the caller checks `vocab_collisions` first."""
    return F.transform_keys(map_col, lambda k, v: F.when(F.length(k) == 1, F.lower(k)).otherwise(k))


def vocab_collisions(map_col) -> Column:
    """Keys that would fall together."""
    keys = F.map_keys(map_col)
    return F.filter(keys, lambda k: (F.length(k) == 1) & (F.lower(k) != k) & F.array_contains(keys, F.lower(k)))
