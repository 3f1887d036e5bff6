"""Whole runs: pages to state, state to sheets, state to a report, labels to accuracy."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import keys, reporting, validation
from tallyspark.operators.batching import numbered
from tallyspark.operators.extraction import extract
from tallyspark.operators.reconciliation import reconcile
from tallyspark.schemas import FILES, INVOICE_HEADER, LINE_HEADER
from tallyspark.sources.inbox import second_readings
from tallyspark.sources.sinks import Sink, with_retry
from tallyspark.sources.state import State

HEADERS = {"invoices": INVOICE_HEADER, "line_items": LINE_HEADER}


def read_documents(pages: DataFrame, as_of: dt.date, ask: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pages to sha256, name, invoice, method, confidence, notes, conflicts, issues; doubtful scans get a second reading where there is one."""
    first = extract(pages).withColumn("issues", validation.issues(F.col("invoice"), as_of, F.col("confidence")))
    if ask is None:
        return first
    routed = validation.needs_second_reading(F.col("method"), F.col("issues"))
    replies = second_readings(ask(first.where(routed).select("sha256", "name", "raw_text")))
    both = first.join(replies, "sha256", "left").withColumn("a", F.struct("invoice", "notes"))
    out = reconcile(both).withColumn("hit", F.col("out").isNotNull() & routed)
    pick = lambda c: F.when(F.col("hit"), F.col(f"out.{c}")).otherwise(F.col(c)).alias(c)
    merged = out.select("sha256", "name", "raw_text", *map(pick, ("invoice", "method", "confidence", "notes", "conflicts")))
    return merged.withColumn("issues", validation.issues(F.col("invoice"), as_of, F.col("confidence"), conflicts=F.col("conflicts")))


def process(pages: DataFrame, state: State, as_of: dt.date, ask: Callable[[DataFrame], DataFrame] | None = None, now: dt.datetime | None = None) -> dict[str, int]:
    """One run over the pages that the state has not seen. All of it is committed at once; run again, it does nothing."""
    files, vendors, outbox = (state.read(t) for t in ("files", "vendors", "outbox"))
    base = (files.agg(F.max("seq")).first()[0] or 0) + 1
    ordered = numbered(pages.select("sha256", "name"), "name").select("sha256", "name", (F.col("number") + base).alias("seq"))
    fresh = keys.unseen(ordered, files)
    if fresh.isEmpty():
        return {"processed": 0}
    read = read_documents(pages.join(fresh.select("sha256", "name"), ["sha256", "name"], "left_semi").dropDuplicates(["sha256"]), as_of, ask)
    # The reading is the expensive part and used by all that follows: it is written once.
    path = f"{state.folder}/reading"
    read.write.mode("overwrite").parquet(path)
    docs = state.spark.read.schema(read.schema).parquet(path).join(fresh.select("sha256", "seq"), "sha256")
    named = docs.withColumn("vendor_name", F.col("invoice.vendor_name")).withColumn("tax_id", F.col("invoice.vendor_tax_id"))
    learnt = keys.learnt_vendors(named, vendors)
    enriched = keys.enrich_from_registry(named, vendors).withColumn("invoice", F.col("invoice").withField("vendor_name", F.col("vendor_name")))
    inv = F.col("invoice")
    keyed = enriched.select("sha256", "name", "seq", "method", "confidence", "notes", "issues", "invoice", keys.invoice_key(inv["vendor_tax_id"], inv["invoice_number"], F.col("sha256")).alias("invoice_key"), *[inv[f].alias(f) for f in ("total", "issue_date", "subtotal")])
    old = files.where("status <> 'duplicate' and not contains(invoice_key, '#conflict-')").select("invoice_key", *[F.col(f"invoice.{f}").alias(f) for f in ("total", "issue_date", "subtotal")])
    settled = keys.settle(keyed, old).withColumn("processed_at", F.lit(now or dt.datetime.now(dt.UTC)).cast("timestamp"))
    records = settled.select(*[c.split()[0] for c in FILES.split(", ")]).persist()
    try:
        counts = {r["status"]: r["n"] for r in reporting.status_counts(records).collect()}
        if not counts:
            return {"processed": 0}
        new = keys.outbox_rows("invoices", keys.invoice_rows(records)).unionByName(keys.outbox_rows("line_items", keys.line_rows(records)))
        state.commit(files=files.unionByName(records), vendors=vendors.unionByName(learnt), outbox=keys.merge_outbox(outbox, new))
    finally:
        records.unpersist()
    return {"processed": sum(counts.values()), **counts}


def sync(state: State, sink: Sink, batch_size: int = 100, prune: bool = False, **retry) -> dict[str, int]:
    """Pending rows to the sink by batches in order of key, each marked as synced once the sink has it."""
    stats = {"updated": 0, "appended": 0, "pruned": 0, "retries": 0}

    def again() -> None:
        stats["retries"] += 1

    for sheet, header in HEADERS.items():
        waiting = keys.pending(state.read("outbox")).where(F.col("sheet") == sheet).orderBy("row_key").select("row_key", "row", "row_hash")
        batch: list = []

        def push(rows: list, sheet: str = sheet, header: list[str] = header) -> None:
            grid = [[json.loads(r["row"]).get(c) for c in header] for r in rows]
            got = with_retry(lambda: sink.upsert(sheet, header, grid), on_retry=again, **retry)
            stats["updated"] += got["updated"]
            stats["appended"] += got["appended"]
            state.ack([(sheet, r["row_key"], r["row_hash"]) for r in rows])

        for row in waiting.toLocalIterator():  # one partition at a time comes to the driver, which is the sink's only client
            batch.append(row)
            if len(batch) == batch_size:
                push(batch)
                batch = []
        if batch:
            push(batch)
        if prune:
            keep = {r[0] for r in state.read("outbox").where(F.col("sheet") == sheet).select("row_key").toLocalIterator()}
            stats["pruned"] += with_retry(lambda s=sheet, k=keep: sink.prune(s, k), on_retry=again, **retry)
    return stats


def report(state: State, folder: str) -> None:
    """report.md and review_queue.csv."""
    files = state.read("files").persist()
    Path(folder).mkdir(parents=True, exist_ok=True)
    section = lambda title, df: [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *["| " + " | ".join(map(str, r)) + " |" for r in df.collect()], ""]
    lines = ["# Run report", "", *section("Status", reporting.status_counts(files).orderBy(F.desc("n"), "status")), *section("Method", reporting.status_counts(files, "method").orderBy(F.desc("n"), "method")), *section("Issues", reporting.issue_histogram(files.where("status = 'needs_review'")).orderBy(F.desc("n_issues"), "code"))]
    (Path(folder) / "report.md").write_text("\n".join(lines))
    reporting.review_queue(files).drop("shown_total").coalesce(1).orderBy("file").write.mode("overwrite").csv(f"{folder}/review_queue", header=True)
    files.unpersist()


def evaluate(pages: DataFrame, labels: DataFrame, as_of: dt.date, ask: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Accuracy against labels; re-sent copies are left out. State, registry and sheets take no part."""
    docs = read_documents(pages, as_of, ask)
    pairs = labels.where("duplicate_of is null").join(docs, F.col("file") == F.col("name")).select("file", F.coalesce("scanned", F.lit(False)).alias("scanned"), "defect", F.coalesce("expected_issues", F.array().cast("array<string>")).alias("expected_issues"), labels["invoice"].alias("truth"), docs["invoice"].alias("got"), F.col("issues.code").alias("codes"))
    compared = reporting.compare(pairs)
    compared = compared.withColumn("ok_all", F.forall(F.array(*[c for c in compared.columns if c.startswith("ok_")]), lambda x: x))
    return {"fields": reporting.field_accuracy(compared), "defects": reporting.defects_caught(compared), "clean": reporting.clean_flagged(compared), "false_alarms": reporting.false_alarms(compared), "slipped": reporting.slipped(compared)}
