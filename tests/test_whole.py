"""Queries over their whole tables: rows that an id subset would leave out."""

import random

from tallyspark.queries import queries

SF = "/root/testdata/sf0.001"


def test_sync_batches_number_all_orders(spark, tmp_path):
    keys = [3 * i for i in range(5000)]
    shuffled = random.Random(1).sample(keys, len(keys))
    spark.createDataFrame([(k,) for k in shuffled], "o_orderkey long").repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    got = queries()["sync_batches"](spark, str(tmp_path)).collect()
    assert sorted((r["o_orderkey"], r["batch"], r["n_rows"]) for r in got) == [(k, i // 100, 5000) for i, k in enumerate(keys)]


def test_registry_sees_all_turns(spark, tmp_path):
    rows = [(conv, turn, "assistant" if turn > late and turn % 3 == 0 else "user", "x") for conv, n, late in ((1, 1500, 1200), (2, 4, 0), (10, 5, 0), (11, 1300, 0), (12, 3, 1)) for turn in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    known, expected = {}, []
    for conv, turn, role, _ in sorted(rows):
        shop, name = conv % 10, f"{role}-{conv % 3}-{turn}"
        had = known.get(shop) if shop else None
        takes = role != "assistant" and had is not None and had != name
        expected.append((had if takes else name, int(takes)))
        if shop and role == "assistant":
            known.setdefault(shop, name)
    got = sorted(queries()["vendor_registry"](spark, str(tmp_path)).collect(), key=lambda r: r["seq"])
    assert len({r["seq"] for r in got}) == len(rows)
    assert [(r["vendor_name"], r["n_notes"]) for r in got] == expected
