"""Two readings of one document become one. A one-to-one join on the document, then expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import taxid
from tallyspark.functions.text import norm_name, norm_number
from tallyspark.operators.validation import line_ok, lines_sum, share_of
from tallyspark.schemas import INVOICE, INVOICE_FIELDS, LINE_ITEM, MONEY, REQUIRED

SCALARS = ["vendor_name", "vendor_tax_id", "invoice_number", "issue_date", "due_date", "currency", "tax_rate"]
NORMS = {"vendor_tax_id": taxid.normalize, "vendor_name": norm_name, "invoice_number": norm_number}


def same(field: str, a: Column, b: Column) -> Column:
    norm = NORMS.get(field, lambda c: c)
    return norm(a) == norm(b)


def _evidence(tax_id: Column) -> Column:
    """Whether an id passes a check that is evidence: its country's own."""
    checked = taxid.check(tax_id)
    return checked["valid"] & (checked["how"] != "unknown-country")


def adds_up(subtotal: Column, tax: Column, total: Column, rate: Column, items: Column) -> Column:
    """Total, tax and lines agree to a cent, as far as they are there; a missing amount is no agreement."""
    cents = F.abs(subtotal + tax - total) <= 0.01
    by_rate = F.coalesce(F.abs(share_of(subtotal, rate) - tax) <= 0.01, rate.isNull())
    by_lines = F.when(F.size(items) > 0, F.abs(lines_sum(items) - subtotal) <= 0.01).otherwise(True)
    return F.coalesce(cents & by_rate & by_lines, F.lit(False))


def reconcile(readings: DataFrame) -> DataFrame:
    """Rows with structs a (by rules) and b (the second reader's; null where there is none), each with invoice and notes.

    Adds out: struct(invoice, method, confidence, notes, conflicts); null where b is null.
    """
    a, b = F.col("a.invoice"), F.col("b.invoice")
    fields, notes, conflicts = {}, [], []
    for f in SCALARS:
        x, y = a[f], b[f]
        differ = x.isNotNull() & y.isNotNull() & ~same(f, x, y)
        agreed = F.coalesce(y, x)
        if f == "vendor_tax_id":
            ok_a, ok_b = _evidence(x), _evidence(y)
            decided = differ & (ok_a != ok_b)
            fields[f] = F.when(decided, F.when(ok_a, x).otherwise(y)).when(differ, x).otherwise(agreed)
            notes.append(F.when(decided, F.concat(F.lit("tax ID: readers disagree ("), x, F.lit(" / "), y, F.lit("); kept the one that passes its check"))))
            differ = differ & ~decided
        elif f == "vendor_name":
            fields[f] = agreed
            notes.append(F.when(differ, F.concat(F.lit("vendor name: readers disagree ('"), x, F.lit("' / '"), y, F.lit("')"))))
            continue
        else:
            fields[f] = F.when(differ, x).otherwise(agreed)
        conflicts.append(F.when(differ, F.concat(F.lit(f"{f}: OCR read '"), x.cast("string"), F.lit("', LLM read '"), y.cast("string"), F.lit("'"))))

    items_b = F.coalesce(b["line_items"], F.array().cast(f"array<{LINE_ITEM}>"))
    items_a = F.coalesce(a["line_items"], F.array().cast(f"array<{LINE_ITEM}>"))
    differs = {f: F.coalesce(a[f] != b[f], F.lit(False)) for f in MONEY}
    any_differs = differs["subtotal"] | differs["tax_amount"] | differs["total"]
    b_fits = adds_up(b["subtotal"], b["tax_amount"], b["total"], fields["tax_rate"], items_b)
    a_fits = adds_up(a["subtotal"], a["tax_amount"], a["total"], fields["tax_rate"], items_b)
    keep_a = any_differs & ~b_fits & a_fits
    for f in MONEY:
        fields[f] = F.when(keep_a, a[f]).otherwise(F.coalesce(b[f], a[f]))
        fields[f] = F.coalesce(fields[f], a[f])
    notes.append(F.when(keep_a, F.lit("amounts: kept the OCR reading, which adds up")))
    shown = F.concat_ws(", ", *[F.when(differs[f], F.concat(F.lit(f"{f} "), a[f].cast("string"), F.lit(" / "), b[f].cast("string"))) for f in MONEY])
    conflicts.append(F.when(any_differs & ~b_fits & ~a_fits, F.concat(F.lit("amounts: readers disagree and neither reading adds up: "), shown)))

    def merged(x: Column, y: Column) -> Column:
        equal = x["quantity"].eqNullSafe(y["quantity"]) & x["unit_price"].eqNullSafe(y["unit_price"]) & x["amount"].eqNullSafe(y["amount"])
        # The second reader has no discounts: the first one's is kept, so that a discounted line still multiplies out.
        y_full = y.withField("discount_percent", F.coalesce(y["discount_percent"], x["discount_percent"]))
        take_y = equal | F.coalesce(line_ok(y_full), F.lit(False))
        take_x = ~take_y & F.coalesce(line_ok(x), F.lit(False))
        item = F.when(take_x, x.withField("description", y["description"])).otherwise(y_full)
        return F.struct(item.alias("item"), F.when(take_y, "b").when(take_x, "a").otherwise("none").alias("kept"))

    pairs = F.zip_with(items_a, items_b, merged)
    matched = (F.size(items_a) == F.size(items_b)) & (F.size(items_a) > 0)
    fields["line_items"] = F.when(matched, F.transform(pairs, lambda p: p["item"])).when(F.size(items_b) == 0, items_a).otherwise(items_b)
    told = lambda kept, text: F.when(matched, F.filter(F.transform(pairs, lambda p, i: F.when(p["kept"] == kept, F.concat(F.lit("line "), (i + 1).cast("string"), F.lit(text)))), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    listed = lambda cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    invoice = F.struct(*[fields[f].alias(f) for f in INVOICE_FIELDS]).cast(INVOICE)
    found = sum((fields[f].isNotNull().cast("int") for f in REQUIRED), F.lit(0))
    no_notes = F.array().cast("array<string>")
    all_notes = F.concat(F.coalesce(F.col("a.notes"), no_notes), F.coalesce(F.col("b.notes"), no_notes), listed(notes), told("a", ": kept the OCR numbers, which multiply out"))
    all_conflicts = F.concat(listed(conflicts), told("none", ": neither reading multiplies out"))
    out = F.struct(invoice.alias("invoice"), F.lit("ocr+llm").alias("method"), F.round(found / 6, 3).alias("confidence"), all_notes.alias("notes"), all_conflicts.alias("conflicts"))
    return readings.withColumn("out", F.when(F.col("b").isNotNull(), out))
