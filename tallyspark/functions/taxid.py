"""National tax-id checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import let
from tallyspark.schemas import TAX_FORMATS


def normalize(tax_id: Column) -> Column:
    """Without white space and dots, upper case; a Swiss id without its suffix."""
    t = F.upper(F.regexp_replace(tax_id, r"(?U)[\s.]", ""))
    return F.regexp_replace(t, r"^CHE-?(\d{9})(?:MWST|TVA|IVA)?$", "CHE$1")


def _digit(text: Column, i: int) -> Column:
    return F.coalesce(F.substring(text, i, 1).try_cast("int"), F.lit(0))


def _weighted(text: Column, weights: list[int]) -> Column:
    return sum((w * _digit(text, i) for i, w in enumerate(weights, 1)), F.lit(0))


def de_ok(digits: Column) -> Column:
    """ISO 7064 MOD 11,10 over eight digits."""

    def step(product: Column, i: Column) -> Column:
        s = (F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0)) + product) % 10
        return (2 * F.when(s == 0, 10).otherwise(s)) % 11

    product = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(10), step)
    return (11 - product) % 10 == _digit(digits, 9)


def fr_ok(body: Column) -> Column:
    return F.substring(body, 1, 2).try_cast("int") == (12 + 3 * (F.substring(body, 3, 9).try_cast("int") % 97)) % 97


def gb_ok(digits: Column) -> Column:
    return ((_weighted(digits, [8, 7, 6, 5, 4, 3, 2]) + F.substring(digits, 8, 2).try_cast("int")) % 97).isin(0, 42)


def ch_ok(digits: Column) -> Column:
    check = 11 - _weighted(digits, [5, 4, 3, 2, 7, 6, 5, 4]) % 11
    return (check != 10) & (check % 11 == _digit(digits, 9))


def check(tax_id: Column) -> Column:
    """struct(valid, how); how: checksum, format, US EIN format, unknown-country."""
    result = lambda valid, how: F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), F.lit(how).alias("how"))

    def judged(t: Column) -> Column:
        country, body = F.substring(t, 1, 2), F.substring(t, F.lit(3), F.greatest(F.length(t) - 2, F.lit(0)))
        out = F.when(t.rlike(r"^\d{2}-\d+$"), result(t.rlike(r"^\d{2}-\d{7}$"), "US EIN format"))
        out = out.when(country == "CH", result(t.rlike(r"^CHE\d{9}$") & ch_ok(F.substring(t, 4, 9)), "checksum"))
        for name, size, ok in (("DE", 9, de_ok), ("FR", 11, fr_ok), ("GB", 9, gb_ok)):
            out = out.when(country == name, result(body.rlike(rf"^\d{{{size}}}$") & ok(body), "checksum"))
        for name, pattern in TAX_FORMATS.items():
            out = out.when(country == name, result(body.rlike(f"^{pattern}$"), "format"))
        return out.otherwise(result(t.rlike(r"^[A-Z]{2}[0-9A-Z]{8,12}$"), "unknown-country"))

    return F.when(tax_id.isNotNull(), let(normalize(tax_id), judged))


def de_check_digit(digits: Column) -> Column:
    """The ninth digit that makes eight digits a valid German id."""
    product = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(10), lambda p, i: F.when((F.substring(digits, i, F.lit(1)).cast("int") + p) % 10 == 0, 20 % 11).otherwise((2 * ((F.substring(digits, i, F.lit(1)).cast("int") + p) % 10)) % 11))
    return (11 - product) % 10
