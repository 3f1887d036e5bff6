"""Amounts of two readings when the lines miss the printed subtotal."""

from decimal import Decimal

from test_runs import CLEAN, LINE, merge


def test_no_reading_fits_whose_lines_miss_the_subtotal(spark):
    off = {"subtotal": Decimal("104.00"), "tax_amount": Decimal("19.76"), "total": Decimal("123.76")}
    out = merge(spark, CLEAN | off, CLEAN | off | {"total": Decimal("132.76")})
    assert out["invoice"]["total"] == Decimal("132.76")
    assert out["conflicts"] == ["amounts: readers disagree and neither reading adds up: total 123.76 / 132.76"]
    freight = LINE | {"quantity": Decimal("1"), "unit_price": Decimal("4.00"), "amount": Decimal("4.00")}
    whole = merge(spark, CLEAN | off | {"line_items": [LINE, freight]}, CLEAN | off | {"line_items": [LINE, freight], "total": Decimal("132.76")})
    assert whole["invoice"]["total"] == Decimal("123.76") and whole["conflicts"] == []
