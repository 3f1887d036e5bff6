"""Keys, duplicates, the vendor registry, and what goes to the sheets. Set-based forms of a run in order of seq.

First-per-key, and the registry's first teacher of a tax id, are minima by key, combined before the shuffle and
joined back, so a key that many documents share is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import taxid
from tallyspark.functions.text import row_hash
from tallyspark.operators.validation import issue
from tallyspark.schemas import INVOICE_HEADER, ISSUE, LINE_HEADER


def invoice_key(tax_id: Column, number: Column, sha: Column) -> Column:
    named = (F.coalesce(tax_id, F.lit("")) != "") & (F.coalesce(number, F.lit("")) != "")
    return F.when(named, F.concat(taxid.normalize(tax_id), F.lit("|"), F.upper(F.trim(number)))).otherwise(F.concat(F.lit("file:"), F.substring(sha, 1, 12)))


def unseen(files: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The first file of each content hash, by (seq, name), that the state does not hold."""
    others = [c for c in files.columns if c != "sha256"]
    out = files.groupBy("sha256").agg(F.min_by(F.struct(*others), F.struct("seq", "name")).alias("f")).select("sha256", *[F.col("f")[c].alias(c) for c in others]).select(*files.columns)
    return out if state is None else out.join(state.select("sha256"), "sha256", "left_anti")


def first_per_key(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Adds of each document's invoice key the first holder: first_seq, first_total, first_date, first_subtotal.

    known (invoice_key, total, issue_date, subtotal): earlier runs' records that are no duplicates; these come first.
    """
    holder = F.struct("seq", "total", "issue_date", "subtotal")
    mine = docs.groupBy("invoice_key").agg(F.min(holder).alias("h"))
    if known is not None:
        theirs = known.select("invoice_key", F.struct(F.lit(-1).cast("long").alias("seq"), "total", "issue_date", "subtotal").alias("h"))
        mine = mine.union(theirs).groupBy("invoice_key").agg(F.min("h").alias("h"))
    return docs.join(mine, "invoice_key").select(*docs.columns, F.col("h.seq").alias("first_seq"), F.col("h.total").alias("first_total"), F.col("h.issue_date").alias("first_date"), F.col("h.subtotal").alias("first_subtotal"))


def settle(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """docs (seq, sha256, invoice_key, total, issue_date, subtotal, issues, ...): status, final key and issues.

    A later document of a key is a duplicate where its content is the first one's, else a conflict:
    it keeps a suffixed key and an issue. Documents keyed by file are never compared.
    """
    placed = first_per_key(docs, known)
    keyed = ~F.startswith("invoice_key", F.lit("file:"))
    later = keyed & (F.col("seq") != F.col("first_seq"))
    alike = F.col("total").eqNullSafe(F.col("first_total")) & F.col("issue_date").eqNullSafe(F.col("first_date")) & F.col("subtotal").eqNullSafe(F.col("first_subtotal"))
    conflict = later & ~alike
    told = F.array(issue("DUPLICATE_INVOICE", F.concat(F.lit("another invoice with key "), F.col("invoice_key"), F.lit(" and other amounts was processed before")))).cast(f"array<{ISSUE}>")
    issues = F.when(conflict, F.concat("issues", told)).otherwise(F.col("issues"))
    status = F.when(later & alike, "duplicate").when(F.size(issues) > 0, "needs_review").otherwise("ok")
    key = F.when(conflict, F.concat("invoice_key", F.lit("#conflict-"), F.substring("sha256", 1, 8))).otherwise(F.col("invoice_key"))
    return placed.select(*[c for c in docs.columns if c not in ("invoice_key", "issues")], key.alias("invoice_key"), issues.alias("issues"), status.alias("status"))


def enrich_from_registry(docs: DataFrame, vendors: DataFrame | None = None) -> DataFrame:
    """docs (seq, method, tax_id, vendor_name, notes, ...): names by the registry as it was when each document came.

    The first text-layer document with a valid id and a name teaches it for good; documents that teach
    nothing take the known name where theirs differs, with a note.
    """
    tid = F.when(taxid.check(F.col("tax_id"))["valid"], taxid.normalize(F.col("tax_id")))
    teaches = (F.col("method") == "text") & (F.coalesce("vendor_name", F.lit("")) != "") & F.col("_tid").isNotNull()
    out = docs.withColumn("_tid", tid)
    # The first teacher of an id is what all later documents know; a document never learns from itself.
    teacher = out.where(teaches).groupBy("_tid").agg(F.min_by("vendor_name", "seq").alias("_name"), F.min("seq").alias("_from"))
    valid = out.where("_tid is not null").join(teacher, "_tid", "left").withColumn("_known", F.when(F.col("_from") < F.col("seq"), F.col("_name"))).drop("_name", "_from")
    if vendors is not None:
        valid = valid.join(vendors.select(F.col("tax_id").alias("_tid"), F.col("name").alias("_old")), "_tid", "left").withColumn("_known", F.coalesce("_old", "_known")).drop("_old")
    out = valid.unionByName(out.where("_tid is null"), allowMissingColumns=True)
    takes = ~teaches & F.col("_known").isNotNull() & ~F.col("_known").eqNullSafe(F.col("vendor_name")) & F.col("_tid").isNotNull()
    note = F.concat(F.lit("vendor name '"), F.coalesce("vendor_name", F.lit("")), F.lit("' replaced from registry"))
    notes = F.when(takes, F.concat("notes", F.array(note))).otherwise(F.col("notes"))
    name = F.when(takes, F.col("_known")).otherwise(F.col("vendor_name"))
    return out.select(*[c for c in docs.columns if c not in ("vendor_name", "notes")], name.alias("vendor_name"), notes.alias("notes"))


def learnt_vendors(docs: DataFrame, vendors: DataFrame | None = None) -> DataFrame:
    """Registry rows (tax_id, name, source) that the documents teach and the registry lacks; the first document wins."""
    taught = docs.where((F.col("method") == "text") & (F.coalesce("vendor_name", F.lit("")) != "") & taxid.check(F.col("tax_id"))["valid"])
    out = taught.groupBy(taxid.normalize(F.col("tax_id")).alias("tax_id")).agg(F.min_by("vendor_name", "seq").alias("name"), F.min_by("name", "seq").alias("source"))
    return out if vendors is None else out.join(vendors, "tax_id", "left_anti")


def invoice_rows(records: DataFrame) -> DataFrame:
    """The invoices sheet: one row of INVOICE_HEADER for each record that is no duplicate."""
    inv = F.col("invoice")
    values = {"key": F.col("invoice_key"), "status": F.col("status"), "line_count": F.size(inv["line_items"]), "issues": F.concat_ws(", ", F.transform("issues", lambda x: x["code"])), "notes": F.concat_ws("; ", "notes"), "source_file": F.col("name"), "method": F.col("method")}
    number = {"subtotal", "tax_rate", "tax_amount", "total"}
    return records.where("status <> 'duplicate'").select(*[values.get(c, inv[c].cast("double") if c in number else inv[c].cast("string") if c.endswith("date") else inv[c] if c not in values else None).alias(c) for c in INVOICE_HEADER])


def line_rows(records: DataFrame) -> DataFrame:
    """The line items sheet: a row of LINE_HEADER for each line, numbered from 1."""
    at = records.where("status <> 'duplicate'").select("invoice_key", F.col("invoice.currency").alias("currency"), F.posexplode("invoice.line_items").alias("pos", "item"))
    line = F.col("pos") + 1
    return at.select(F.concat("invoice_key", F.lit("#"), line.cast("string")).alias("key"), "invoice_key", line.alias("line"), "item.description", *[F.col(f"item.{c}").cast("double").alias(c) for c in ("quantity", "unit_price", "amount")], "currency").select(*LINE_HEADER)


def outbox_rows(sheet: str, rows: DataFrame) -> DataFrame:
    """Sheet rows as outbox rows: key, JSON, hash; not yet synced."""
    return rows.select(F.lit(sheet).alias("sheet"), F.col("key").alias("row_key"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("row"), row_hash(*rows.columns).alias("row_hash"), F.lit(None).cast("string").alias("synced_hash"))


def merge_outbox(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones by (sheet, row_key); what was synced stays known."""
    keys = ["sheet", "row_key"]
    kept = old.join(new.select(*keys), keys, "left_anti")
    synced = old.select(*keys, F.col("synced_hash").alias("_was"))
    return kept.unionByName(new.join(synced, keys, "left").withColumn("synced_hash", F.col("_was")).drop("_was"))


def pending(outbox: DataFrame) -> DataFrame:
    return outbox.where(~F.col("row_hash").eqNullSafe(F.col("synced_hash")))


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in a batch, at the place where the key first stood."""
    columns = [c for c in rows.columns if c not in (key, order)]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r"), F.min(order).alias(order))
    return last.select(key, order, *[F.col(f"r.{c}").alias(c) for c in columns])


def upsert_plan(existing: DataFrame, rows: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """Rows to write with action update or append; of a key that comes twice, the last row."""
    one = last_per_key(rows, key, order)
    known = existing.select(F.col(key)).where(F.col(key).isNotNull() & (F.col(key) != "")).distinct().withColumn("_known", F.lit(True))
    return one.join(known, key, "left").withColumn("action", F.when(F.col("_known"), "update").otherwise("append")).drop("_known")


def prune(existing: DataFrame, keep: DataFrame, key: str = "key") -> DataFrame:
    """Existing rows without those whose key is not kept; rows with a blank key stay."""
    blank = F.col(key).isNull() | (F.col(key) == "")
    return existing.where(~blank).join(keep.select(key).distinct(), key, "left_semi").select(*existing.columns).union(existing.where(blank))
