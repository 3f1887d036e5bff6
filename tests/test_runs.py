"""Rules one by one, two readings, and whole runs: idempotence, duplicates, conflicts, flaky sinks, crashes."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import extraction, keys, layout, reconciliation, validation
from tallyspark.pages import STYLES, synthetic_pages
from tallyspark.plans import run as plans
from tallyspark.schemas import INVOICE, INVOICE_FIELDS, PAGE
from tallyspark.sources.sinks import FileSink, FlakySink, SinkError, make_sink, with_retry
from tallyspark.sources.state import State

AS_OF = dt.date(2026, 9, 25)
LINE = {"description": "Work", "quantity": Decimal("2"), "unit_price": Decimal("50.00"), "amount": Decimal("100.00"), "discount_percent": None}
CLEAN = {"vendor_name": "Acme", "vendor_tax_id": "DE136695976", "invoice_number": "R-1", "issue_date": dt.date(2026, 9, 1), "due_date": dt.date(2026, 10, 1), "currency": "EUR", "subtotal": Decimal("100.00"), "tax_rate": Decimal("19"), "tax_amount": Decimal("19.00"), "total": Decimal("119.00"), "line_items": [LINE]}
MUTATIONS = [({}, []), ({"vendor_name": None}, ["MISSING_VENDOR_NAME"]), ({"invoice_number": ""}, ["MISSING_INVOICE_NUMBER"]), ({"vendor_tax_id": "DE136695977"}, ["INVALID_TAX_ID"]), ({"line_items": [LINE | {"amount": Decimal("101.00")}], "subtotal": Decimal("101.00"), "tax_amount": Decimal("19.19"), "total": Decimal("120.19")}, ["LINE_AMOUNT_MISMATCH"]), ({"line_items": []}, ["NO_LINE_ITEMS"]), ({"subtotal": Decimal("110.00"), "tax_amount": Decimal("20.90"), "total": Decimal("130.90")}, ["LINES_SUM_MISMATCH"]), ({"tax_amount": Decimal("20.00"), "total": Decimal("120.00")}, ["TAX_MISMATCH"]), ({"total": Decimal("120.00")}, ["TOTAL_MISMATCH"]), ({"total": Decimal("119.01")}, []), ({"due_date": dt.date(2026, 8, 1)}, ["DUE_BEFORE_ISSUE"]), ({"issue_date": dt.date(2026, 9, 26)}, ["FUTURE_DATE"]), ({"line_items": [LINE | {"discount_percent": Decimal("10"), "amount": Decimal("90.00")}], "subtotal": Decimal("90.00"), "tax_amount": Decimal("17.10"), "total": Decimal("107.10")}, [])]


def test_rules(spark):
    df = spark.createDataFrame([(i, CLEAN | m) for i, (m, _) in enumerate(MUTATIONS)], f"i int, invoice {INVOICE}")
    got = {r[0]: r[1] for r in df.select("i", validation.issues(F.col("invoice"), AS_OF)["code"]).collect()}
    assert [got[i] for i in range(len(MUTATIONS))] == [e for _, e in MUTATIONS]
    low = df.where("i = 0").select(validation.issues(F.col("invoice"), AS_OF, F.lit(0.79), conflicts=F.array(F.lit("x")))["code"]).first()[0]
    assert low == ["READERS_DISAGREE", "LOW_CONFIDENCE"]


def merge(spark, a, b):
    reading = f"struct<invoice:{INVOICE},notes:array<string>>"
    df = spark.createDataFrame([({"invoice": a, "notes": []}, {"invoice": b, "notes": []})], f"a {reading}, b {reading}")
    return reconciliation.reconcile(df).select("out.*").first().asDict(recursive=True)


def test_two_readings(spark):
    same = merge(spark, CLEAN, CLEAN | {"vendor_name": "ACME!", "due_date": None})
    assert same["conflicts"] == [] and same["invoice"]["due_date"] == CLEAN["due_date"] and same["confidence"] == 1.0
    tax = merge(spark, CLEAN | {"vendor_tax_id": "DE136695977"}, CLEAN)
    assert tax["invoice"]["vendor_tax_id"] == "DE136695976" and not tax["conflicts"] and "tax ID" in tax["notes"][0]
    number = merge(spark, CLEAN, CLEAN | {"invoice_number": "R-7"})
    assert number["invoice"]["invoice_number"] == "R-1" and len(number["conflicts"]) == 1
    total = merge(spark, CLEAN, CLEAN | {"total": Decimal("911.00")})
    assert total["invoice"]["total"] == Decimal("119.00") and "amounts" in total["notes"][0]
    neither = merge(spark, CLEAN | {"total": Decimal("1.00")}, CLEAN | {"total": Decimal("2.00")})
    assert neither["invoice"]["total"] == Decimal("2.00") and "neither" in neither["conflicts"][0]
    line = merge(spark, CLEAN, CLEAN | {"line_items": [LINE | {"quantity": Decimal("7"), "description": "Labour"}]})
    assert line["invoice"]["line_items"][0]["quantity"] == 2 and line["invoice"]["line_items"][0]["description"] == "Labour"
    fewer = merge(spark, CLEAN, CLEAN | {"line_items": []})
    assert len(fewer["invoice"]["line_items"]) == 1
    discount = LINE | {"discount_percent": Decimal("10"), "amount": Decimal("90.00")}
    kept = merge(spark, CLEAN | {"line_items": [discount]}, CLEAN | {"line_items": [discount | {"discount_percent": None}]})
    assert kept["invoice"]["line_items"][0]["discount_percent"] == 10


def test_labels(spark):
    cases = {
        "Rechnungsnummer:": ("invoice_number", "rechnungsnummer"),
        "Rechnungsnumner:": ("invoice_number", "rechnungsnummer"),
        "VAT Reg No": ("vendor_tax_id", "vatregno"),
        "VAT number NL8829": ("vendor_tax_id", "vatnumber"),
        "Data Systems Ltd": None,
        "Total Due": ("total", "totaldue"),
        "Rechnungsbetrag CHF": ("total", "rechnungsbetrag"),
        "USt-ldNr": ("vendor_tax_id", "ust-idnr"),
        "Nº Factura: 7": ("invoice_number", "nºfactura"),
        "": None,
        "12.50": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["m"] and (r["m"]["field"], r["m"]["label"]) for r in df.select("t", extraction.label_of(text.fold(F.col("t")), F.col("t")).alias("m")).collect()}
    assert got == cases


def as_invoices(spark, invoices):
    rows = [(i, f"{i:03d}.pdf", f"sha{i}", inv) for i, inv in enumerate(invoices)]
    return spark.createDataFrame(rows, f"order_key long, name string, sha256 string, invoice {INVOICE}")


def documents(n=12):
    out = []
    for i in range(n):
        q = Decimal(i % 5 + 1)
        items = [LINE | {"description": "blue ring", "quantity": q, "amount": q * 50}]
        sub = q * 50
        tax = (sub * Decimal("0.19")).quantize(Decimal("0.01"))
        out.append(CLEAN | {"vendor_name": "Supplier#Ltd", "invoice_number": f"R-{i}", "line_items": items, "subtotal": sub, "tax_rate": None, "tax_amount": tax, "total": sub + tax})
    return out


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """Written once, as a reader's pages are."""
    path = str(tmp_path_factory.mktemp("pages") / "pages")
    synthetic_pages(as_invoices(spark, documents())).write.parquet(path)
    return spark.read.parquet(path)


def test_extraction_is_exact(spark, pages):
    from tallyspark.operators.extraction import extract

    got = {r["name"]: r["invoice"] for r in extract(pages).collect()}
    for i, inv in enumerate(documents()):
        g = got[f"{i:03d}.pdf"]
        for f in INVOICE_FIELDS:
            if f not in ("vendor_name", "line_items", "currency", "tax_rate"):
                assert g[f] == inv[f], (i, f)
        assert g["currency"] == STYLES[i % len(STYLES)].currency
        assert [(x["quantity"], x["amount"]) for x in g["line_items"]] == [(x["quantity"], x["amount"]) for x in inv["line_items"]]


def grids(folder):
    return {s: sorted(map(tuple, FileSink(folder).read(s))) for s in plans.HEADERS}


def test_run_sync_rerun(spark, pages, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    first = plans.process(pages, state, AS_OF)
    assert first["processed"] == 12
    assert plans.process(pages, state, AS_OF) == {"processed": 0}
    stats = plans.sync(state, FileSink(str(tmp_path / "a")), batch_size=5)
    assert stats["appended"] == 24 and stats["updated"] == 0
    assert plans.sync(state, FileSink(str(tmp_path / "a")), batch_size=5)["appended"] == 0
    plans.report(state, str(tmp_path / "report"))
    assert "## Status" in (tmp_path / "report" / "report.md").read_text()
    # The same rows through a sink that fails and loses answers.
    other = State(spark, str(tmp_path / "other"))
    plans.process(pages, other, AS_OF)
    flaky = plans.sync(other, FlakySink(FileSink(str(tmp_path / "b")), 0.2, 0.1, 0.3, seed=4), batch_size=3, attempts=20, sleep=lambda s: None)
    assert flaky["retries"] > 0
    assert grids(tmp_path / "a") == grids(tmp_path / "b")


def test_crash_between_write_and_mark(spark, pages, tmp_path):
    """Killed after a write, or between a version's tables and its pointer: the next run converges to the same sheets."""
    state = State(spark, str(tmp_path / "state"))

    class Dies(FileSink):
        def upsert(self, sheet, header, rows):
            super().upsert(sheet, header, rows)
            raise KeyboardInterrupt

    plans.process(pages, state, AS_OF)
    for _ in range(3):
        with pytest.raises(KeyboardInterrupt):
            plans.sync(state, Dies(str(tmp_path / "a")), batch_size=4)
    plans.sync(state, FileSink(str(tmp_path / "a")), batch_size=4)
    clean = State(spark, str(tmp_path / "clean"))
    plans.process(pages, clean, AS_OF)
    plans.sync(clean, FileSink(str(tmp_path / "b")))
    assert grids(tmp_path / "a") == grids(tmp_path / "b")
    version = state.version()
    (tmp_path / "state" / f"v={version + 1}" / "files").mkdir(parents=True)  # a commit that died
    assert state.read("files").count() == 12
    state.commit(files=state.read("files"))
    assert state.version() == version + 1 and state.read("files").count() == 12


def test_each_batch_is_acknowledged(spark, pages, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    plans.process(pages, state, AS_OF)
    calls = []

    class DiesLater(FileSink):
        def upsert(self, sheet, header, rows):
            calls.append(len(rows))
            if len(calls) == 3:
                raise KeyboardInterrupt
            return super().upsert(sheet, header, rows)

    with pytest.raises(KeyboardInterrupt):
        plans.sync(state, DiesLater(str(tmp_path / "a")), batch_size=4)
    assert keys.pending(state.read("outbox")).count() == 24 - 8
    assert plans.sync(state, FileSink(str(tmp_path / "a")), batch_size=4)["updated"] == 0
    state.commit()
    assert keys.pending(state.read("outbox")).count() == 0


def test_duplicates_conflicts_and_registry(spark, tmp_path):
    base = documents(4)
    changed = base[1] | {"total": base[1]["total"] + 5}
    sent = synthetic_pages(as_invoices(spark, [*base[:2], base[0], changed]).withColumn("order_key", F.lit(0).cast("long")))
    state = State(spark, str(tmp_path / "state"))
    got = plans.process(sent, state, AS_OF)
    assert got["duplicate"] == 1 and got["needs_review"] == 1
    rows = {r["name"]: r for r in state.read("files").collect()}
    assert rows["002.pdf"]["status"] == "duplicate" and "#conflict-" in rows["003.pdf"]["invoice_key"]
    assert "DUPLICATE_INVOICE" in [i["code"] for i in rows["003.pdf"]["issues"]]
    assert state.read("vendors").count() == 1
    docs = spark.createDataFrame([(1, "ocr", "DE136695976", "Acne", []), (2, "text", "DE136695976", "Acme", []), (3, "ocr", "DE136695976", "Acne", []), (4, "text", "DE136695976", "Other", []), (5, "text", "DE136695976", None, []), (6, "ocr", "DE1", "Acne", [])], "seq long, method string, tax_id string, vendor_name string, notes array<string>")
    named = {r["seq"]: (r["vendor_name"], len(r["notes"])) for r in keys.enrich_from_registry(docs).collect()}
    assert named == {1: ("Acne", 0), 2: ("Acme", 0), 3: ("Acme", 1), 4: ("Other", 0), 5: ("Acme", 1), 6: ("Acne", 0)}


def test_second_reader(spark, tmp_path):
    scan = synthetic_pages(as_invoices(spark, [documents(1)[0] | {"invoice_number": None}])).withColumn("source", F.lit("ocr")).withColumn("cells", F.filter("cells", lambda c: ~c["text"].startswith("R-")))
    reply = json.dumps({"invoice_number": "R-0", "vendor_tax_id": "DE136695976", "total": "59.50", "line_items": [{"description": "x", "quantity": "a", "unit_price": "1", "amount": "1"}], "subtotal": None})
    ask = lambda docs: docs.select("sha256", F.lit(reply).alias("json"))
    before = plans.read_documents(scan, AS_OF).first()
    after = plans.read_documents(scan, AS_OF, ask).first()
    assert before["invoice"]["invoice_number"] is None and after["invoice"]["invoice_number"] == "R-0"
    assert after["method"] == "ocr+llm" and len(after["invoice"]["line_items"]) == 1


def test_streaming(spark, pages, tmp_path):
    from tallyspark.streaming.incremental import watch

    pages.select(*[f.split()[0] for f in ("sha256", "name", "cells", "width", "height", "source", "ocr_scores")]).write.parquet(str(tmp_path / "in"))
    state = State(spark, str(tmp_path / "state"))
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), state, AS_OF, str(tmp_path / "marks")).awaitTermination()
    assert state.read("files").count() == 12


def test_evaluate(spark, pages):
    truth = as_invoices(spark, documents()).select(F.col("name").alias("file"), F.lit(False).alias("scanned"), F.lit(None).cast("string").alias("defect"), F.array().cast("array<string>").alias("expected_issues"), F.lit(None).cast("string").alias("duplicate_of"), "invoice")
    got = {r["field"]: r for r in plans.evaluate(pages, truth, AS_OF)["fields"].collect()}
    assert got["total"]["text_ok"] == 12 and got["lines"]["text_ok"] == 12 and got["invoice_number"]["text_n"] == 12


def test_sinks(tmp_path):
    sink = FileSink(str(tmp_path))
    assert sink.upsert("s", ["key", "v"], [["a", 1], ["b", 2], ["a", 3]]) == {"updated": 0, "appended": 2}
    assert sink.read("s") == [["key", "v"], ["a", 3], ["b", 2]]
    assert sink.prune("s", {"b"}) == 1
    waits = []

    def fail():
        raise SinkError(429)

    with pytest.raises(SinkError):
        with_retry(fail, sleep=waits.append)
    assert len(waits) == 6
    with pytest.raises(SinkError):
        with_retry(lambda: (_ for _ in ()).throw(SinkError(404)), sleep=waits.append)
    assert len(waits) == 6
    asked = []

    def busy():
        asked.append(1)
        if len(asked) < 4:
            raise [SinkError(429, retry_after=0.0), SinkError(503, retry_after=9.0), ConnectionError()][len(asked) - 1]
        return "done"

    waits.clear()
    assert with_retry(busy, sleep=waits.append, base=4.0) == "done"
    assert len(waits) == 3 and waits[0] > 0 and waits[1] >= 9.0
    assert make_sink("none") is None
    with pytest.raises(ValueError):
        make_sink("ftp:x")


def test_lines_and_geometry(spark):
    cell = lambda t, x, y, s=10.0, b=False: {"text": t, "x0": float(x), "x1": float(x + 20), "top": float(y), "bottom": float(y + s), "size": s, "bold": b}
    words = [cell("b", 25, 1), cell("a", 0, 0), cell("far", 100, 0), cell("below", 0, 30)]
    lines = layout.lines_of(words, "text")
    assert [[c["text"] for c in line] for line in lines] == [["a b", "far"], ["below"]]
    assert layout.lines_of([], "text") == []
    boxes = spark.createDataFrame([("p", 0.0, 0.0, 100.0, 10.0), ("p", 0.0, 0.0, 10.0, 10.0)], "sha256 string, x0 double, y0 double, x1 double, y1 double")
    assert abs(layout.deskew_angle(boxes).first()["angle"] - 0.0996687) < 1e-6
    upright = layout.unrotate(spark.createDataFrame([([0.0, 10.0], [0.0, 10.0], 0.0, 100.0, 100.0)], "xs array<double>, ys array<double>, angle double, width double, height double"), dpi=72).first()
    assert (upright["x0"], upright["top"], upright["x1"], upright["bottom"]) == (0.0, 0.0, 10.0, 10.0)


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], PAGE)
    assert plans.process(none, State(spark, str(tmp_path / "s")), AS_OF) == {"processed": 0}
