"""Business rules over typed invoices: every broken rule gives an issue. Pure expressions, one scan, no shuffle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import taxid
from tallyspark.functions.text import let
from tallyspark.schemas import ISSUE, LINE_ITEM, REQUIRED, SUSPICIOUS

TOLERANCE = 0.01


def _dec(text: str, kind: str) -> Column:
    return F.lit(text).cast(kind)


def issue(code: Column | str, message: Column | str, severity: str = "error") -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(code).alias("code"), F.lit(severity).alias("severity"), as_column(message).alias("message"))


def share_of(value: Column, percent: Column) -> Column:
    """value * percent / 100 to cents; decimals are narrowed so that no digit is lost."""
    return F.round(value.cast("decimal(18,2)") * (percent.cast("decimal(9,3)") * _dec("0.01", "decimal(3,2)")), 2)


def line_expected(line: Column) -> Column:
    """quantity * unit price less discount, to cents."""
    gross = (line["quantity"].cast("decimal(12,3)") * line["unit_price"].cast("decimal(14,2)")).cast("decimal(24,5)")
    rest = ((_dec("100", "decimal(6,3)") - F.coalesce(line["discount_percent"], _dec("0", "decimal(6,3)"))) * _dec("0.01", "decimal(3,2)")).cast("decimal(10,5)")
    return F.round(gross * rest, 2).cast("decimal(18,2)")


def line_ok(line: Column) -> Column:
    return F.abs(line_expected(line) - line["amount"]) <= TOLERANCE


def lines_sum(items: Column) -> Column:
    return F.aggregate(items, _dec("0", "decimal(18,2)"), lambda a, x: (a + x["amount"]).cast("decimal(18,2)"))


def money(value: Column) -> Column:
    """To cents, half away from zero, as decimal(18,2)."""
    return F.round(value, 2).cast("decimal(18,2)")


def missing(value: Column) -> Column:
    return value.isNull() | (value.cast("string") == "")


def issues(inv: Column, as_of: dt.date, confidence: Column | None = None, min_confidence: float = 0.8, conflicts: Column | None = None) -> Column:
    """array<issue> of an invoice struct, in the order of the rules."""
    confidence = F.lit(None).cast("double") if confidence is None else confidence
    conflicts = F.lit(None).cast("array<string>") if conflicts is None else conflicts
    text = lambda c: c.cast("string")
    items = F.coalesce(inv["line_items"], F.array().cast(f"array<{LINE_ITEM}>"))
    off = lambda a, b: F.abs(a - b) > TOLERANCE

    def bad_line(x: Column, i: Column) -> Column:
        said = lambda e: F.concat(F.lit("line "), text(i + 1), F.lit(": "), text(x["quantity"]), F.lit(" x "), text(x["unit_price"]), F.lit(" = "), text(e), F.lit(", printed "), text(x["amount"]))
        return let(line_expected(x), lambda e: F.when(off(e, x["amount"]), issue("LINE_AMOUNT_MISMATCH", said(e))))

    def lines_off(total: Column) -> Column:
        return F.when((F.size(items) > 0) & off(total, inv["subtotal"]), issue("LINES_SUM_MISMATCH", F.concat(F.lit("lines add up to "), text(total), F.lit(", subtotal is "), text(inv["subtotal"]))))

    def tax_off(expected: Column) -> Column:
        return F.when(off(expected, inv["tax_amount"]), issue("TAX_MISMATCH", F.concat(text(inv["tax_rate"]), F.lit("% of "), text(inv["subtotal"]), F.lit(" is "), text(expected), F.lit(", printed "), text(inv["tax_amount"]))))

    def bad_id(checked: Column) -> Column:
        return F.when(~missing(inv["vendor_tax_id"]) & ~checked["valid"], issue("INVALID_TAX_ID", F.concat(inv["vendor_tax_id"], F.lit(" fails the "), checked["how"], F.lit(" check"))))

    bad_lines = F.filter(F.transform(items, bad_line), lambda x: x.isNotNull())
    one = lambda condition, made: F.when(condition, made)
    before = [one(missing(inv[f]), issue(f"MISSING_{f.upper()}", f"{f} not found on the document")) for f in REQUIRED]
    before.append(let(taxid.check(inv["vendor_tax_id"]), bad_id))
    after = [
        one(F.size(items) == 0, issue("NO_LINE_ITEMS", "no line items could be read", "review")),
        let(lines_sum(items), lines_off),
        let(share_of(inv["subtotal"], inv["tax_rate"]), tax_off),
        one(off(inv["subtotal"] + inv["tax_amount"], inv["total"]), issue("TOTAL_MISMATCH", F.concat(text(inv["subtotal"]), F.lit(" + "), text(inv["tax_amount"]), F.lit(" != printed total "), text(inv["total"])))),
        one(inv["due_date"] < inv["issue_date"], issue("DUE_BEFORE_ISSUE", F.concat(F.lit("due "), text(inv["due_date"]), F.lit(" is before issue "), text(inv["issue_date"])))),
        one(inv["issue_date"] > F.lit(as_of), issue("FUTURE_DATE", F.concat(F.lit("issue date "), text(inv["issue_date"]), F.lit(f" is after {as_of}")))),
        one(confidence < min_confidence, issue("LOW_CONFIDENCE", F.concat(F.lit("extraction confidence "), F.format_number(confidence, 2)), "review")),
    ]
    disagree = F.transform(F.coalesce(conflicts, F.array().cast("array<string>")), lambda c: issue("READERS_DISAGREE", c, "review"))
    present = lambda cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    return F.concat(disagree, present(before), bad_lines, present(after)).cast(f"array<{ISSUE}>")


def needs_second_reading(method: Column, found: Column) -> Column:
    """A page without a text layer whose issues a second reader may resolve."""
    return (method != "text") & F.exists(found, lambda x: F.startswith(x["code"], F.lit("MISSING_")) | x["code"].isin(SUSPICIOUS))


def with_issues(invoices: DataFrame, as_of: dt.date) -> DataFrame:
    """Adds issues; an invoice column is read, confidence and conflicts where there are such columns."""
    has = lambda c: F.col(c) if c in invoices.columns else None
    return invoices.withColumn("issues", issues(F.col("invoice"), as_of, has("confidence"), conflicts=has("conflicts")))
