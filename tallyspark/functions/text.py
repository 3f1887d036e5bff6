"""Tolerant parsers as column expressions: folding, currency, amounts, numbers, dates, percents.

All are pure expressions but fold_exact. What can't be read is null, never an error (the session may
be in ANSI mode). Digits and spaces are matched in their Unicode sense.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyspark.schemas import CURRENCY_CODES, CURRENCY_SYMBOLS, MONTHS


def _latin() -> tuple[str, str]:
    """Letters of the Latin blocks and the plain letter that each decomposes to."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xA0, 0x250)]
    plain = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs]
    return "".join(c for c, d in plain if len(d) == 1 and c != d), "".join(d for c, d in plain if len(d) == 1 and c != d)


LATIN_FROM, LATIN_TO = _latin()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unaccented(text: Column) -> Column:
    """Lower case, without accents; Latin letters, combining marks anywhere."""
    return F.lower(F.regexp_replace(F.translate(text, LATIN_FROM, LATIN_TO), r"\p{M}+", ""))


def fold(text: Column) -> Column:
    """Lower case, without accents and white space."""
    return F.regexp_replace(unaccented(text), r"(?U)\s+", "")


def fold_python(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return "".join(plain.lower().split())


@F.pandas_udf(StringType())
def fold_exact(text: pd.Series) -> pd.Series:
    """fold with full compatibility decomposition, for scripts and signs beyond Latin letters."""
    return text.map(lambda t: None if t is None else fold_python(t))


def first(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match; null without a match or where the group took no part."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def find_currency(text: Column) -> Column:
    """The first known symbol's code, else the first upper-case word of three letters that is a known code."""
    symbols = F.coalesce(*[F.when(F.contains(text, F.lit(s)), F.lit(c)) for s, c in CURRENCY_SYMBOLS.items()])
    words = F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z]{3})\b"), F.lit(1))
    return F.coalesce(symbols, F.get(F.filter(words, lambda w: w.isin(CURRENCY_CODES)), F.lit(0)))


def parse_amount(text: Column) -> Column:
    """decimal(18,2): a final separator with exactly two digits is the decimal one, all others group thousands."""

    def value(kept: Column, digits: Column) -> Column:
        cents = kept.rlike(r"[.,]\d\d$")
        sign = F.when(F.startswith(kept, F.lit("-")), -1).otherwise(1)
        scaled = (digits.try_cast("decimal(20,0)") * sign).cast("decimal(20,0)")
        return F.when(cents, scaled * F.lit("0.01").cast("decimal(3,2)")).otherwise(scaled.cast("decimal(22,2)")).try_cast("decimal(18,2)")

    kept = F.trim(F.regexp_replace(text, r"(?U)[^\d.,'\-\s]+", ""))
    return let(kept, lambda k: let(F.regexp_replace(k, r"\D+", ""), lambda d: F.when(d != "", value(k, d))))


def parse_number(text: Column, separator: Column) -> Column:
    """decimal(12,3): the document's separator decides; a point before three digits groups thousands where the separator is a comma."""

    def value(raw: Column) -> Column:
        grouped = (separator == ",") & raw.rlike(r"\.\d{3}$") & ~F.contains(raw, F.lit(","))
        return F.when(grouped, F.replace(raw, F.lit("."), F.lit(""))).otherwise(F.translate(raw, ",", ".")).try_cast("decimal(12,3)")

    found = F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), r"(?U)-?\d+(?:[.,]\d+)?", 0)
    return let(found, lambda raw: F.when(raw != "", value(raw)))


# Patterns of dates, percents and numeric cells.
NUMERIC_DATE = r"(?U)(\d{1,4})[./\-](\d{1,2})[./\-](\d{2,4})"
WORDY_DATE = r"(?U)(\d{1,2})\.?\s*([A-Za-zÀ-ÿ]{3,10})\.?,?\s*(\d{4})"
PERCENT = r"(?U)(\d{1,2}(?:[.,]\d{1,3})?)\s*%"
NUMERIC_CELL = r"(?U)^[-+]?[\d\s.,']*\d[\d\s.,']*$"
RATE_CELL = r"(?U)^[-+]?\d{1,2}(?:[.,]\d{1,3})?\s*%$"
WORDY_DATE_US = r"(?U)([A-Za-z]{3,10})\.?\s+(\d{1,2}),?\s+(\d{4})"


def _year(c: Column) -> Column:
    return c.try_cast("int") + F.when(F.length(c) == 2, 2000).otherwise(0)


def _parts(text: Column, pattern: str) -> Column:
    """The three groups of the first match; empty strings without one."""
    return F.array(*[F.regexp_extract(text, pattern, i) for i in (1, 2, 3)])


def date_parts(text: Column) -> Column:
    """struct(a, b, year) of a numeric date as printed; an ISO date as day, month, year."""

    def parts(p: Column) -> Column:
        iso = F.length(p[0]) == 4
        pick = lambda x, y: F.when(iso, x).otherwise(y)
        return F.when(p[0] != "", F.struct(pick(p[2], p[0]).try_cast("int").alias("a"), p[1].try_cast("int").alias("b"), pick(p[0].try_cast("int"), _year(p[2])).alias("year")))

    return let(_parts(F.replace(text, F.lit(" "), F.lit("")), NUMERIC_DATE), parts)


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")


def _month(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return let(F.rtrim(fold(word), F.lit(".")), lambda w: F.coalesce(F.try_element_at(table, w), F.try_element_at(table, F.left(w, F.lit(3)))))


def parse_date(text: Column, order: Column | str = "dmy") -> Column:
    """A numeric date in the given order (ISO dates as they are), else one with a month's word; impossible dates are null."""
    us = (F.lit(order) if isinstance(order, str) else order) == "mdy"

    def numeric(p: Column) -> Column:
        x, y = p[0].try_cast("int"), p[1].try_cast("int")
        return F.when(F.length(p[0]) == 4, _date(x, y, p[2].try_cast("int"))).otherwise(_date(_year(p[2]), F.when(us, x).otherwise(y), F.when(us, y).otherwise(x)))

    def wordy(pattern: str, day: int, month: int) -> Column:
        """struct(known month, date): a readable month word decides, even where its date is impossible."""
        return let(_parts(text, pattern), lambda p: let(_month(p[month - 1]), lambda m: F.struct(m.alias("m"), _date(p[2].try_cast("int"), m, p[day - 1].try_cast("int")).alias("d"))))

    by_word = let(wordy(WORDY_DATE, 1, 2), lambda w: F.when(w["m"].isNotNull(), w["d"]).otherwise(wordy(WORDY_DATE_US, 2, 1)["d"]))
    solid = F.replace(text, F.lit(" "), F.lit(""))
    read = let(_parts(solid, NUMERIC_DATE), lambda p: F.when(p[0] != "", numeric(p)).otherwise(by_word))
    # Most texts are no dates: the patterns alone tell.
    return F.when(solid.rlike(NUMERIC_DATE) | text.rlike(WORDY_DATE) | text.rlike(WORDY_DATE_US), read)


def parse_percent(text: Column) -> Column:
    return F.translate(F.regexp_extract(text, PERCENT, 1), ",", ".").try_cast("decimal(6,3)")


def money(value: Column) -> Column:
    """To cents, half away from zero."""
    return F.round(value, 2)


def strip_currency(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "|".join([*map(lambda s: "\\" + s if s == "$" else s, CURRENCY_SYMBOLS), *CURRENCY_CODES]), ""))


def is_numeric(text: Column) -> Column:
    return strip_currency(text).rlike(NUMERIC_CELL)


def is_rate(text: Column) -> Column:
    return F.trim(text).rlike(RATE_CELL)


def compact_ids(text: Column) -> Column:
    """Upper case, without dots, digit groups joined, a two-letter prefix joined to its digits."""
    up = F.replace(F.replace(F.upper(text), F.lit("."), F.lit("")), F.lit("CHE-"), F.lit("CHE"))
    return F.regexp_replace(F.regexp_replace(up, r"(?<=\d) (?=\d)", ""), r"\b([A-Z]{2}) (?=\d)", "$1")


def row_hash(*columns: Column | str) -> Column:
    """16 hex digits of a digest of the row as JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 16)


def norm_name(text: Column) -> Column:
    return F.regexp_replace(fold(text), "[^0-9a-z]", "")


def norm_number(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"(?U)\s", ""))


def total_text(total: Column, currency: Column) -> Column:
    """'total CUR', with ? for what is missing."""
    return F.concat_ws(" ", F.coalesce(total.cast("string"), F.lit("?")), F.coalesce(currency, F.lit("?")))
