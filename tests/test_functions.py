import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import taxid, text

AMOUNTS = [("£2,258.26", "2258.26"), ("3.156,55 €", "3156.55"), ("1 487,78 €", "1487.78"), ("1 487,78", "1487.78"), ("3.202.08", "3202.08"), ("1'234.50", "1234.50"), ("-12,00", "-12.00"), ("12,5", "125"), ("1.5", "15"), ("0.125", "125"), ("no digits", None), ("", None), (",50", "0.50")]
DATES = [("07 Sep 2026", "dmy", (2026, 9, 7)), ("07.09.2026", "dmy", (2026, 9, 7)), ("09/07/2026", "mdy", (2026, 9, 7)), ("09/07/2026", "dmy", (2026, 7, 9)), ("2026-09-07", "mdy", (2026, 9, 7)), ("7. März 2026", "dmy", (2026, 3, 7)), ("Sep 7, 2026", "dmy", (2026, 9, 7)), ("31.02.2026", "dmy", None), ("7.9.26", "dmy", (2026, 9, 7)), ("5 août 2026", "dmy", (2026, 8, 5)), ("nothing", "dmy", None), ("12 Foo 2026", "dmy", None)]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def read(spark, values, f):
    return [r[0] for r in column(spark, values).select(f(F.col("x"))).collect()]


def test_amounts(spark):
    expected = [None if e is None else Decimal(e) for _, e in AMOUNTS]
    assert read(spark, [t for t, _ in AMOUNTS], text.parse_amount) == expected


def test_dates(spark):
    for order in ("dmy", "mdy"):
        cases = [(t, e and dt.date(*e)) for t, o, e in DATES if o == order]
        assert read(spark, [t for t, _ in cases], lambda c, o=order: text.parse_date(c, o)) == [e for _, e in cases]


def test_numbers_and_percents(spark):
    cases = [("39,75", ",", "39.75"), ("2", ".", "2"), ("8.875", ".", "8.875"), ("1.250", ",", "1250"), ("1,250", ".", "1.25"), ("x", ".", None)]
    for t, sep, e in cases:
        e = None if e is None else Decimal(e)
        assert read(spark, [t], lambda c, s=sep: text.parse_number(c, F.lit(s))) == [e]
    assert read(spark, ["VAT 20 %", "8,875%", "none"], text.parse_percent) == [Decimal("20"), Decimal("8.875"), None]


def test_fold(spark):
    cases = {"Fällig am": "falligam", "N° TVA": "n°tva", "Échéance": "echeance", "ÀÉÎÕÜ ñ": "aeioun", "a b": "ab"}
    assert read(spark, list(cases), text.fold) == list(cases.values())
    assert read(spark, list(cases), text.fold_exact) == list(cases.values())
    assert read(spark, ["ﬁ ①", None], text.fold_exact) == ["fi1", None]


def test_currency_and_cells(spark):
    assert read(spark, ["€ 5 GBP", "5 CHF", "ABC XYZ", "USD EUR"], text.find_currency) == ["EUR", "CHF", None, "USD"]
    assert read(spark, ["1.234,56 €", "EUR 5", "abc", "- 5", "12x"], text.is_numeric) == [True, True, False, True, False]
    assert read(spark, ["GB 526 0181 74", "CHE-123.456.789"], text.compact_ids) == ["GB526018174", "CHE123456789"]


# An independent maker of valid ids.
def make(country, rng):
    d = [rng.randrange(10) for _ in range(9)]
    s = "".join(map(str, d))
    if country == "DE":
        s = "1" + s[1:8]
        p = 10
        for c in s:
            m = (int(c) + p) % 10
            p = (2 * (m if m else 10)) % 11
        return f"DE{s}{(11 - p) % 10}"
    if country == "FR":
        return f"FR{(12 + 3 * (int(s) % 97)) % 97:02d}{s}"
    if country == "GB":
        w = sum((8 - i) * int(c) for i, c in enumerate(s[:7]))
        return f"GB{s[:7]}{(97 - w % 97) % 97:02d}"
    while True:
        s = "".join(str(rng.randrange(10)) for _ in range(8))
        c = 11 - sum(w * int(x) for w, x in zip((5, 4, 3, 2, 7, 6, 5, 4), s, strict=True)) % 11
        if c != 10:
            return f"CHE{s}{c % 11}"


def test_tax_ids(spark):
    rng = random.Random(3)
    good = [make(c, rng) for c in ("DE", "FR", "GB", "CH") for _ in range(100)]
    bad = [t[:-1] + str((int(t[-1]) + 1 + rng.randrange(8)) % 10) for t in good if t[:2] in ("DE", "CH")]
    valid = lambda ts: [r[0] for r in column(spark, ts).select(taxid.check(F.col("x"))["valid"]).collect()]
    assert all(valid(good))
    assert not any(valid(bad))
    cases = [("DE136695976", True, "checksum"), ("de 136 695 976", True, "checksum"), ("ATU12345678", True, "format"), ("NL123456789B01", True, "format"), ("12-3456789", True, "US EIN format"), ("12-345678", False, "US EIN format"), ("LU12345678", True, "unknown-country"), ("CHE-123.456.788 MWST", True, "checksum"), ("CH76950391", False, "checksum"), ("", False, "unknown-country"), ("D", False, "unknown-country")]
    got = column(spark, [c[0] for c in cases]).select(taxid.check(F.col("x")).alias("c")).select("c.*").collect()
    assert [(r["valid"], r["how"]) for r in got] == [c[1:] for c in cases]
    assert column(spark, [None]).select(taxid.check(F.col("x"))).first()[0] is None


@pytest.mark.parametrize("value,expected", [("2.345", "2.35"), ("-2.345", "-2.35"), ("2.344", "2.34")])
def test_money(spark, value, expected):
    assert spark.sql("select 1").select(text.money(F.lit(value).cast("decimal(10,3)"))).first()[0] == Decimal(expected)
