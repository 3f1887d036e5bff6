"""A deterministic invoice view over the order tables, with planted defects: test support and input of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import taxid

AS_OF = "1998-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vendor_id, vendor_name, tax_id (a German one whose check digit is wrong for every 11th), currency."""
    key = F.col("s_suppkey")
    digits = F.lpad((F.lit(10_000_000) + key).cast("string"), 8, "0")
    check = taxid.de_check_digit(digits)
    wrong = F.when(key % 11 == 0, (check + 1) % 10).otherwise(check)
    return read(spark, sf_dir, "supplier").select(key.alias("vendor_id"), F.col("s_name").alias("vendor_name"), F.concat(F.lit("DE"), digits, wrong.cast("string")).alias("tax_id"), F.when(F.col("s_nationkey") % 3 == 0, "EUR").when(F.col("s_nationkey") % 3 == 1, "GBP").otherwise("USD").alias("currency"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_key, vendor_id, line_no, description, quantity, unit_price, discount_percent, rate, amount; every 17th part's amount is off by one."""
    item, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    priced = item.join(part.select("p_partkey", "p_name", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    q, u = F.col("l_quantity").cast("decimal(9,3)"), F.col("p_retailprice").cast("decimal(12,2)")
    disc = F.round(F.col("l_discount") * 100).cast("decimal(5,2)")
    net = F.round((q * u).cast("decimal(20,5)") * ((F.lit(100).cast("decimal(5,2)") - disc) * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(9,4)"), 2).cast("decimal(18,2)")
    printed = (net + F.when(F.col("l_partkey") % 17 == 0, F.lit("1.00")).otherwise("0.00").cast("decimal(3,2)")).cast("decimal(18,2)")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_extendedprice", "l_returnflag", "l_linestatus")
    return priced.select(F.col("l_orderkey").alias("order_key"), F.col("l_suppkey").alias("vendor_id"), F.row_number().over(order).alias("line_no"), F.col("p_name").alias("description"), q.cast("decimal(12,3)").alias("quantity"), u.cast("decimal(18,2)").alias("unit_price"), disc.cast("decimal(6,3)").alias("discount_percent"), F.round(F.col("l_tax") * 100).cast("decimal(6,3)").alias("rate"), printed.alias("amount"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_key, name, seq, sha256, method, confidence, notes, invoice: an order is an invoice, its supplier with the least key the vendor."""
    item = F.struct("line_no", "description", "quantity", "unit_price", "amount", "discount_percent")
    by_order = lines(spark, sf_dir).groupBy("order_key").agg(F.min("vendor_id").alias("vendor_id"), F.sum("amount").cast("decimal(18,2)").alias("subtotal"), F.max("rate").alias("rate"), F.sort_array(F.collect_list(item)).alias("items"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.to_date("o_orderdate").alias("issued"))
    k = F.col("order_key")
    printed = (F.col("subtotal") + F.when(k % 47 == 0, F.lit("4.00")).otherwise("0.00").cast("decimal(3,2)")).cast("decimal(18,2)")
    by_order = by_order.withColumn("subtotal", printed)
    tax = F.round(F.col("subtotal") * (F.col("rate") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(9,5)"), 2).cast("decimal(18,2)")
    printed_tax = (tax + F.when(k % 37 == 0, F.lit("2.00")).otherwise("0.00").cast("decimal(3,2)")).cast("decimal(18,2)")
    total = (F.col("subtotal") + tax + F.when(k % 41 == 0, F.lit("3.00")).otherwise("0.00").cast("decimal(3,2)")).cast("decimal(18,2)")
    fields = {
        "vendor_name": F.when(k % 29 != 0, F.col("vendor_name")), "vendor_tax_id": F.col("tax_id"), "invoice_number": F.when(k % 31 != 0, F.concat(F.lit("INV-"), k.cast("string"))),
        "issue_date": F.col("issued"), "due_date": F.date_add("issued", F.when(k % 23 == 0, -1).otherwise(30)), "currency": F.when(k % 43 != 0, F.col("currency")),
        "subtotal": F.col("subtotal"), "tax_rate": F.col("rate"), "tax_amount": printed_tax, "total": total,
        "line_items": F.coalesce(F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in ("description", "quantity", "unit_price", "amount", "discount_percent")])), F.array().cast("array<struct<description:string,quantity:decimal(12,3),unit_price:decimal(18,2),amount:decimal(18,2),discount_percent:decimal(6,3)>>")),
    }
    joined = orders.join(by_order, "order_key", "left").join(vendors(spark, sf_dir), "vendor_id", "left")
    method = F.when(k % 3 == 0, "ocr").otherwise("text")
    confidence = (F.lit(0.7) + (k % 30) / 100).cast("double")
    return joined.select("order_key", F.concat(F.lit("inv-"), F.lpad(k.cast("string"), 10, "0"), F.lit(".pdf")).alias("name"), k.alias("seq"), F.sha2(k.cast("string"), 256).alias("sha256"), method.alias("method"), F.round(confidence, 2).alias("confidence"), F.array().cast("array<string>").alias("notes"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("invoice"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with re-sent copies: every 13th comes again unchanged, every 19th with another total. seq orders them."""
    flat = invoices(spark, sf_dir)
    again = flat.where("order_key % 13 = 0").withColumn("seq", F.col("seq") + 1_000_000_000).withColumn("sha256", F.sha2(F.concat(F.col("sha256"), F.lit("again")), 256))
    changed = flat.where("order_key % 19 = 0").withColumn("seq", F.col("seq") + 2_000_000_000).withColumn("sha256", F.sha2(F.concat(F.col("sha256"), F.lit("changed")), 256))
    changed = changed.withColumn("invoice", F.col("invoice").withField("total", (F.col("invoice.total") + F.lit("5.00").cast("decimal(3,2)")).cast("decimal(18,2)")))
    return flat.union(again).union(changed)


# The same in DuckDB SQL: common table expressions vendor, line, inv and arrival.
_DIGITS = "lpad(cast(10000000 + s_suppkey as varchar), 8, '0')"


def _de_steps(source: str, digits: str, keep: str) -> str:
    """Nested selects, one for each digit, that end in a column product."""
    sql = f"(select *, {digits} as d, 10 as p0 from {source})"
    for i in range(1, 9):
        s = f"(cast(substr(d, {i}, 1) as integer) + p{i - 1}) % 10"
        sql = f"(select *, (2 * (case when {s} = 0 then 10 else {s} end)) % 11 as p{i} from {sql})"
    return f"select {keep} from {sql}"


VENDOR_SQL = "vendor as (" + _de_steps("supplier", _DIGITS, "s_suppkey as vendor_id, s_name as vendor_name, 'DE' || d || cast(case when s_suppkey % 11 = 0 then ((11 - p8) % 10 + 1) % 10 else (11 - p8) % 10 end as varchar) as tax_id, case when s_nationkey % 3 = 0 then 'EUR' when s_nationkey % 3 = 1 then 'GBP' else 'USD' end as currency") + ")"
LINE_SQL = """line as (
  select l_orderkey as order_key, l_suppkey as vendor_id, l_partkey,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate, l_extendedprice, l_returnflag, l_linestatus) as line_no,
    p_name as description, cast(l_quantity as decimal(12,3)) as quantity, cast(p_retailprice as decimal(18,2)) as unit_price,
    cast(round(l_discount * 100) as decimal(6,3)) as discount_percent, cast(round(l_tax * 100) as decimal(6,3)) as rate,
    cast(round(cast(cast(l_quantity as decimal(9,3)) * cast(p_retailprice as decimal(12,2)) as decimal(20,5)) * cast((100 - cast(round(l_discount * 100) as decimal(5,2))) * cast(0.01 as decimal(3,2)) as decimal(9,4)), 2) as decimal(18,2)) as net
  from lineitem join part on l_partkey = p_partkey),
priced as (select *, cast(net + case when l_partkey % 17 = 0 then 1.00 else 0.00 end as decimal(18,2)) as amount from line)"""
INV_SQL = f"""{VENDOR_SQL}, {LINE_SQL},
by_order as (select order_key, min(vendor_id) as vendor_id, cast(sum(amount) as decimal(18,2)) as lines_total, cast(sum(amount) + case when order_key % 47 = 0 then 4.00 else 0.00 end as decimal(18,2)) as subtotal, max(rate) as rate, count(*) as n_lines,
  count(*) filter (l_partkey % 17 = 0) as bad_lines from priced group by order_key),
taxed as (select o_orderkey as order_key, cast(o_orderdate as date) as issue_date, b.vendor_id, subtotal, lines_total, rate as tax_rate, coalesce(n_lines, 0) as n_lines, coalesce(bad_lines, 0) as bad_lines,
  cast(round(subtotal * cast(rate * cast(0.01 as decimal(3,2)) as decimal(9,5)), 2) as decimal(18,2)) as tax from orders left join by_order b on o_orderkey = order_key),
inv as (select order_key, cast(order_key as bigint) as seq, 'inv-' || lpad(cast(order_key as varchar), 10, '0') || '.pdf' as name, sha256(cast(order_key as varchar)) as sha256,
  case when order_key % 3 = 0 then 'ocr' else 'text' end as method, round(0.7 + (order_key % 30) / 100, 2) as confidence,
  case when order_key % 29 <> 0 then v.vendor_name end as vendor_name, v.tax_id as vendor_tax_id, case when order_key % 31 <> 0 then 'INV-' || cast(order_key as varchar) end as invoice_number,
  issue_date, cast(issue_date + (case when order_key % 23 = 0 then -1 else 30 end) as date) as due_date, case when order_key % 43 <> 0 then v.currency end as currency, subtotal, tax_rate,
  cast(tax + case when order_key % 37 = 0 then 2.00 else 0.00 end as decimal(18,2)) as tax_amount,
  cast(subtotal + tax + case when order_key % 41 = 0 then 3.00 else 0.00 end as decimal(18,2)) as total, n_lines, bad_lines, lines_total, tax, t.vendor_id
  from taxed t left join vendor v on t.vendor_id = v.vendor_id)"""
ARRIVAL_SQL = f"""{INV_SQL}, arrival as (select * from inv
  union all select * replace (seq + 1000000000 as seq, sha256(sha256 || 'again') as sha256) from inv where order_key % 13 = 0
  union all select * replace (seq + 2000000000 as seq, sha256(sha256 || 'changed') as sha256, cast(total + 5.00 as decimal(18,2)) as total) from inv where order_key % 19 = 0)"""
