"""Aggregates of the review queue and of the evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import taxid
from tallyspark.functions.text import norm_name, norm_number, total_text
from tallyspark.schemas import MONEY, REQUIRED

COMPARED = [*REQUIRED[:4], "due_date", "currency", "subtotal", "tax_rate", "tax_amount", "total"]


def status_counts(records: DataFrame, by: str = "status") -> DataFrame:
    return records.groupBy(by).agg(F.count("*").alias("n"))


def issue_histogram(records: DataFrame) -> DataFrame:
    """Issues for each code (a document with two bad lines counts twice) and the documents that have it."""
    e = records.select("name", F.explode("issues.code").alias("code"))
    return e.groupBy("code").agg(F.count("*").alias("n_issues"), F.countDistinct("name").alias("n_invoices"))


def review_queue(records: DataFrame) -> DataFrame:
    inv = F.col("invoice")
    text = lambda f: F.concat_ws("; ", F.transform("issues", lambda x: x[f]))
    return records.where("status = 'needs_review'").select(F.col("name").alias("file"), inv["vendor_name"].alias("vendor"), *[inv[f].alias(f) for f in ("invoice_number", "total", "currency")], text("code").alias("issue_codes"), text("message").alias("issues"), F.concat_ws("; ", "notes").alias("notes"), total_text(inv["total"], inv["currency"]).alias("shown_total"))


def same(field: str, a: Column, b: Column) -> Column:
    norm = {"vendor_name": norm_name, "vendor_tax_id": taxid.normalize, "invoice_number": norm_number}.get(field)
    return a.eqNullSafe(b) if norm is None else norm(a).eqNullSafe(norm(b))


def compare(pairs: DataFrame) -> DataFrame:
    """Rows with structs truth and got: adds one boolean column ok_<field> for each field, and for lines and descriptions."""
    t, g = F.col("truth"), F.col("got")
    lines = lambda test: (F.size(t["line_items"]) == F.size(g["line_items"])) & F.forall(F.zip_with(t["line_items"], g["line_items"], test), lambda x: x)
    numbers = lines(lambda a, b: a["quantity"].eqNullSafe(b["quantity"]) & a["unit_price"].eqNullSafe(b["unit_price"]) & a["amount"].eqNullSafe(b["amount"]))
    names = lines(lambda a, b: norm_name(a["description"]).eqNullSafe(norm_name(b["description"])))
    checks = {f: same(f, t[f], g[f]) for f in COMPARED} | {"lines": numbers, "descriptions": names}
    return pairs.select("*", *[F.coalesce(c, F.lit(False)).alias(f"ok_{f}") for f, c in checks.items()])


def field_accuracy(compared: DataFrame) -> DataFrame:
    """For each field: right and all, of scans and of text pages."""
    fields = [*COMPARED, "lines", "descriptions"]
    long = compared.select("scanned", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"ok_{f}").alias("ok")) for f in fields])).alias("e"))
    when = lambda c: F.count_if(c)
    return long.groupBy("e.field").agg(when(F.col("scanned") & F.col("e.ok")).alias("scan_ok"), when(F.col("scanned")).alias("scan_n"), when(~F.col("scanned") & F.col("e.ok")).alias("text_ok"), when(~F.col("scanned")).alias("text_n"))


def defects_caught(evaluated: DataFrame) -> DataFrame:
    """evaluated (defect, expected_issues, codes): planted and caught for each defect."""
    return evaluated.where("defect is not null").groupBy("defect").agg(F.count("*").alias("planted"), F.count_if(F.arrays_overlap("expected_issues", "codes")).alias("caught"))


def clean_flagged(evaluated: DataFrame) -> DataFrame:
    clean = evaluated.where("defect is null")
    return clean.agg(F.count("*").alias("clean"), F.count_if(F.size("codes") > 0).alias("flagged"))


def false_alarms(evaluated: DataFrame) -> DataFrame:
    """Codes that a document should not have, once for each document."""
    return evaluated.select(F.explode(F.array_except(F.array_distinct("codes"), "expected_issues")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def slipped(evaluated: DataFrame) -> DataFrame:
    """Defective documents without an issue, and documents without an issue that have a wrong field (ok_all false)."""
    bare = evaluated.where(F.size("codes") == 0)
    return bare.where("defect is not null or not ok_all").select("file", F.when(F.col("defect").isNotNull(), "defective_passed").otherwise("wrong_field").alias("kind"))
