"""Files, pages, labels and second readings as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.schemas import INVOICE, LABEL, LINE_ITEM, PAGE, REQUIRED, SECOND_READING


def scan_inbox(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """sha256, name, path, content of the folder's own files; the name orders them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    return files.select(F.sha2("content", 256).alias("sha256"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", "content")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages that an adapter has read (Parquet of PAGE)."""
    return spark.read.schema(PAGE).parquet(path)


def unread(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content no cached page has: only these go to the expensive reader."""
    return files.join(cache.select("sha256"), "sha256", "left_anti")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL).json(path)


def second_readings(replies: DataFrame) -> DataFrame:
    """replies (sha256, json) of a second reader -> sha256, b: struct(invoice, notes).

    Numbers and dates that can't be read are null; lines with such a number are dropped; other fields that are
    empty are null. A reply that is no JSON gives no row.
    """
    r = F.from_json("json", SECOND_READING, {"mode": "PERMISSIVE"})
    got = replies.select("sha256", r.alias("r")).where("r is not null")
    blank = lambda c: F.when(F.trim(c) != "", c)
    r = F.col("r")
    dec = lambda c, kind: blank(c).try_cast(kind)
    lines = F.transform(F.coalesce(r["line_items"], F.array().cast("array<struct<description:string,quantity:string,unit_price:string,amount:string>>")), lambda x: F.struct(F.coalesce(x["description"], F.lit("")).alias("description"), dec(x["quantity"], "decimal(12,3)").alias("quantity"), dec(x["unit_price"], "decimal(18,2)").alias("unit_price"), dec(x["amount"], "decimal(18,2)").alias("amount"), F.lit(None).cast("decimal(6,3)").alias("discount_percent")))
    whole = F.filter(lines, lambda x: x["quantity"].isNotNull() & x["unit_price"].isNotNull() & x["amount"].isNotNull()).cast(f"array<{LINE_ITEM}>")
    fields = [*[blank(r[f]).alias(f) for f in ("vendor_name", "vendor_tax_id", "invoice_number")], *[dec(r[f], "date").alias(f) for f in ("issue_date", "due_date")], blank(r["currency"]).alias("currency"), dec(r["subtotal"], "decimal(18,2)").alias("subtotal"), dec(r["tax_rate"], "decimal(6,3)").alias("tax_rate"), *[dec(r[f], "decimal(18,2)").alias(f) for f in ("tax_amount", "total")], whole.alias("line_items")]
    invoice = F.struct(*fields).cast(INVOICE)
    found = sum((invoice[f].isNotNull().cast("int") for f in REQUIRED), F.lit(0))
    return got.select("sha256", F.struct(invoice.alias("invoice"), F.array().cast("array<string>").alias("notes"), F.round(found / 6, 3).alias("confidence")).alias("b"))
