"""The registered queries of the invoice operators, and the same in DuckDB SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark import fixtures, pages
from tallyspark.fixtures import ARRIVAL_SQL, INV_SQL, LINE_SQL, VENDOR_SQL, read
from tallyspark.functions import taxid, text
from tallyspark.operators import extraction, keys, layout, reconciliation, reporting, validation
from tallyspark.schemas import CELL, CURRENCY_CODES, CURRENCY_SYMBOLS, LABELS, REQUIRED, SUSPICIOUS, TAX_FORMATS

AS_OF = dt.date.fromisoformat(fixtures.AS_OF)
Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _FOUND[f.__name__] = f, sql
        return f

    return register


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def _fields(struct: str, *names: str) -> list:
    return [F.col(f"{struct}.{n}").alias(n) for n in names]


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


# --- scalar functions -----------------------------------------------------------------------------

_STYLES = "unnest(['en', 'de', 'fr', 'ch', 'whole'])"


def _printed(value):
    """An amount as different countries print it: array<struct<style, text>>."""

    def styles(us):
        shown = {
            "en": F.concat(F.lit("£"), us),
            "de": F.concat(F.translate(us, ",.", ".,"), F.lit(" €")),
            "fr": F.concat(F.translate(us, ",.", " ,"), F.lit(" EUR")),
            "ch": F.concat(F.lit("-"), F.translate(us, ",", "'")),
            "whole": F.translate(us, ",.", ""),
        }
        return F.array(*[F.struct(F.lit(k).alias("style"), v.alias("text")) for k, v in shown.items()])

    return text.let(F.format_number(value, 2), styles)


@query(f"""
with printed as (select l_orderkey, l_partkey, style, format('{{:,.2f}}', cast(l_extendedprice as decimal(14,2))) as us from lineitem, (select {_STYLES} as style)),
shown as (select l_orderkey, l_partkey, style, case style when 'en' then '£' || us when 'de' then translate(us, ',.', '.,') || ' €' when 'fr' then translate(us, ',.', ' ,') || ' EUR'
  when 'ch' then '-' || replace(us, ',', '''') else replace(replace(us, '.', ''), ',', '') end as t from printed),
kept as (select *, trim(regexp_replace(t, '[^0-9.,''\\-\\s]', '', 'g')) as k from shown),
parsed as (select *, regexp_replace(k, '[^0-9]', '', 'g') as d, regexp_matches(k, '[.,][0-9][0-9]$') as cents from kept)
select style, count(*) as n, cast(sum(try_cast((case when k like '-%' then '-' else '' end) || (case when cents then left(d, length(d) - 2) || '.' || right(d, 2) else d end) as decimal(18,2))) as decimal(28,2)) as total
from parsed group by style""")
def parse_amount_formats(spark, d):
    """Every price in five countries' styles, printed once and read back."""
    prices = read(spark, d, "lineitem").select(F.explode(_printed(F.col("l_extendedprice").cast("decimal(14,2)"))).alias("p"))
    return prices.groupBy("p.style").agg(F.count("*").alias("n"), F.sum(text.parse_amount(F.col("p.text"))).cast("decimal(28,2)").alias("total"))


@query("""
with raw as (select s as printed_sep, r as read_sep, cast(l_quantity * 1000 + l_partkey % 1000 as decimal(12,3)) as v from lineitem, (select unnest(['.', ',']) as s), (select unnest(['.', ',']) as r))
select printed_sep, read_sep, count(*) as n, cast(sum(case when printed_sep = '.' and read_sep = ',' then v * 1000 else v end) as decimal(28,3)) as total from raw group by 1, 2""")
def parse_number_sep(spark, d):
    """Numbers with three decimals, printed and read with either separator: a point before three digits groups where the separator is a comma."""
    value = (F.col("l_quantity") * 1000 + F.col("l_partkey") % 1000).cast("decimal(12,3)").cast("string")
    both = lambda: F.explode(F.array(F.lit("."), F.lit(",")))
    raw = read(spark, d, "lineitem").select(value.alias("v"), both().alias("printed_sep")).select("*", both().alias("read_sep"))
    got = text.parse_number(F.replace("v", F.lit("."), F.col("printed_sep")), F.col("read_sep"))
    return raw.groupBy("printed_sep", "read_sep").agg(F.count("*").alias("n"), F.sum(got).cast("decimal(28,3)").alias("total"))


@query("""
select cast(round(l_tax * 100) as integer) as pct, count(*) as n, cast(sum(cast(regexp_extract(replace(t, ',', '.'), '([0-9]{1,2}(?:\\.[0-9]{1,3})?)\\s*%', 1) as decimal(6,3))) as decimal(18,3)) as total
from (select l_tax, 'MwSt ' || replace(cast(cast(round(l_tax * 100) as decimal(6,1)) as varchar), '.', ',') || ' %' as t from lineitem) group by 1""")
def parse_percent(spark, d):
    rate = F.round(F.col("l_tax") * 100)
    t = F.concat(F.lit("MwSt "), F.replace(rate.cast("decimal(6,1)").cast("string"), F.lit("."), F.lit(",")), F.lit(" %"))
    return read(spark, d, "lineitem").groupBy(rate.cast("int").alias("pct")).agg(F.count("*").alias("n"), F.sum(text.parse_percent(t)).cast("decimal(18,3)").alias("total"))


_DATE_STYLES = {"iso": "%Y-%m-%d", "dmy": "%d.%m.%Y", "mdy": "%m/%d/%Y", "short": "%d/%m/%y", "wordy": "%d %b %Y"}
_SPARK_DATES = {"iso": "yyyy-MM-dd", "dmy": "dd.MM.yyyy", "mdy": "MM/dd/yyyy", "short": "dd/MM/yy", "wordy": "dd MMM yyyy"}


@query(f"""
with styled as (select o_orderkey, style, cast(case when style = 'short' then o_orderdate + interval 20 year else o_orderdate end as date) as day from orders, (select unnest({list(_DATE_STYLES)}) as style)),
shown as (select *, case style {" ".join(f"when '{k}' then strftime(day, '{v}')" for k, v in _DATE_STYLES.items())} end as t from styled)
select style, count(*) as n, count(*) filter (cast(case style {" ".join(f"when '{k}' then try_strptime(t, '{v}')" for k, v in _DATE_STYLES.items())} end as date) = day) as right_n,
  sum(year(day))::bigint as years, sum(day(day))::bigint as days, count(*) filter (style in ('mdy') and day(day) > 12) as swapped_null from shown group by style""")
def parse_date_orders(spark, d):
    day = F.to_date(F.when(F.col("style") == "short", F.add_months("o_orderdate", 240)).otherwise(F.col("o_orderdate")))
    base = read(spark, d, "orders").select("o_orderdate", F.explode(F.array(*map(F.lit, _DATE_STYLES))).alias("style")).withColumn("day", day)
    shown = F.coalesce(*[F.when(F.col("style") == k, F.date_format("day", v)) for k, v in _SPARK_DATES.items()])
    order = F.when(F.col("style") == "mdy", "mdy").otherwise("dmy")
    got = base.withColumn("t", shown).withColumn("p", text.parse_date(F.col("t"), order)).withColumn("q", text.parse_date(F.col("t"), "dmy"))
    return got.groupBy("style").agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("day")).alias("right_n"), F.sum(F.year("p")).alias("years"), F.sum(F.dayofmonth("p")).alias("days"), F.count_if((F.col("style") == "mdy") & F.col("q").isNull()).alias("swapped_null"))


@query(f"""
select currency, count(*) as n from (select doc_id, coalesce({", ".join(f"case when contains(text, '{s}') then '{c}' end" for s, c in CURRENCY_SYMBOLS.items())},
  list_filter(regexp_extract_all(text, '\\b[A-Z]{{3}}\\b'), lambda w: w in ({", ".join(f"'{c}'" for c in CURRENCY_CODES)}))[1]) as currency from documents) group by currency""")
def find_currency_docs(spark, d):
    return read(spark, d, "documents").groupBy(text.find_currency(F.col("text")).alias("currency")).agg(F.count("*").alias("n"))


@query("""select doc_id, sha256(regexp_replace(lower(strip_accents(text)), '\\s+', '', 'g')) as folded from documents""")
def fold_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded"))


_LABEL_VALUES = ", ".join(f"('{f}', '{w.replace(chr(39), chr(39) * 2)}', {i})" for i, (f, w) in enumerate((f, w) for f, ws in LABELS.items() for w in ws))


@query(f"""
with labels_t(field, label, ord) as (values {_LABEL_VALUES}),
words as (select distinct case p_partkey % 3 when 0 then label || cast(p_size as varchar) when 1 then left(label, 2) || 'q' || substr(label, 4) || cast(p_size as varchar) else lower(replace(p_name, ' ', '')) end as w
  from part join labels_t on ord = p_partkey % (select count(*) from labels_t)),
hit as (select w, field, label, length(label) as len, ord, starts_with(w, label) as exact from words join labels_t on starts_with(w, label)
  or (length(label) >= 6 and length(w) >= length(label) and levenshtein(left(w, length(label)), label) <= 1))
select w, field, label, exact from hit qualify row_number() over (partition by w order by exact desc, len desc, ord) = 1""")
def label_match(spark, d):
    """The longest label that starts each text, exact before one edit: a theta join with the small constant table."""
    table = spark.createDataFrame([(f, w, i) for i, (f, w) in enumerate((f, w) for f, ws in LABELS.items() for w in ws)], "field string, label string, ord int")
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    parts = read(spark, d, "part").join(F.broadcast(table), F.col("ord") == F.col("p_partkey") % table.count())
    misread = F.concat(F.left("label", F.lit(2)), F.lit("q"), F.substring("label", 4, 99), size)
    words = parts.select(F.when(k == 0, F.concat("label", size)).when(k == 1, misread).otherwise(F.lower(F.replace("p_name", F.lit(" "), F.lit("")))).alias("w")).distinct()
    return layout.best_labels(words, table)


# --- tax ids --------------------------------------------------------------------------------------


@query(f"with {VENDOR_SQL} select vendor_id, tax_id, vendor_id % 11 <> 0 as valid, 'checksum' as how from vendor")
def taxid_de(spark, d):
    c = taxid.check(F.col("tax_id"))
    return fixtures.vendors(spark, d).select("vendor_id", "tax_id", c["valid"].alias("valid"), c["how"].alias("how"))


def _customers(spark, d, make):
    key = F.col("c_custkey")
    t = make(key)
    c = taxid.check(t)
    return read(spark, d, "customer").select("c_custkey", t.alias("tax_id"), c["valid"].alias("valid"), c["how"].alias("how"))


@query("""select c_custkey, 'FR' || lpad(cast((12 + 3 * ((100000000 + c_custkey) % 97)) % 97 + (case when c_custkey % 7 = 0 then 1 else 0 end) as varchar), 2, '0') || cast(100000000 + c_custkey as varchar) as tax_id,
  c_custkey % 7 <> 0 as valid, 'checksum' as how from customer""")
def taxid_fr(spark, d):
    def make(k):
        siren = 100_000_000 + k
        return F.concat(F.lit("FR"), F.lpad(((12 + 3 * (siren % 97)) % 97 + F.when(k % 7 == 0, 1).otherwise(0)).cast("string"), 2, "0"), siren.cast("string"))

    return _customers(spark, d, make)


_GB = "(8 * ((c_custkey // 1000000) % 10 + 0) + 7 * ((c_custkey // 100000) % 10) + 6 * ((c_custkey // 10000) % 10) + 5 * ((c_custkey // 1000) % 10) + 4 * ((c_custkey // 100) % 10) + 3 * ((c_custkey // 10) % 10) + 2 * (c_custkey % 10))"


@query(f"""select c_custkey, 'GB' || lpad(cast(c_custkey as varchar), 7, '0') || lpad(cast(c_custkey % 97 as varchar), 2, '0') as tax_id,
  ({_GB} + c_custkey % 97) % 97 in (0, 42) as valid, 'checksum' as how from customer""")
def taxid_gb(spark, d):
    return _customers(spark, d, lambda k: F.concat(F.lit("GB"), F.lpad(k.cast("string"), 7, "0"), F.lpad((k % 97).cast("string"), 2, "0")))


_CH = "(11 - (5 * ((c_custkey // 10000000) % 10) + 4 * ((c_custkey // 1000000) % 10) + 3 * ((c_custkey // 100000) % 10) + 2 * ((c_custkey // 10000) % 10) + 7 * ((c_custkey // 1000) % 10) + 6 * ((c_custkey // 100) % 10) + 5 * ((c_custkey // 10) % 10) + 4 * (c_custkey % 10)) % 11)"


@query(f"""select c_custkey, 'CHE-' || lpad(cast(c_custkey as varchar), 8, '0') || cast(c_custkey % 10 as varchar) || ' MWST' as tax_id,
  {_CH} <> 10 and {_CH} % 11 = c_custkey % 10 as valid, 'checksum' as how from customer""")
def taxid_ch(spark, d):
    return _customers(spark, d, lambda k: F.concat(F.lit("CHE-"), F.lpad(k.cast("string"), 8, "0"), (k % 10).cast("string"), F.lit(" MWST")))


_COUNTRIES = [*TAX_FORMATS, "LU", "US"]


@query(f"""
with c as (select c_custkey, {_COUNTRIES}[1 + c_custkey % {len(_COUNTRIES)}] as country, lpad(cast(c_custkey as varchar), 9, '0') as n from customer),
t as (select c_custkey, country, case country when 'AT' then 'ATU' || right(n, 8) when 'BE' then 'BE' || cast(c_custkey % 3 as varchar) || n when 'ES' then 'ESX' || right(n, 7) || 'A' when 'IT' then 'IT' || n || '12'
  when 'NL' then 'NL' || n || 'B0' || cast(c_custkey % 20 as varchar) when 'US' then right(n, 2) || '-' || n else country || n end as tax_id from c)
select c_custkey, tax_id, case country when 'US' then regexp_full_match(tax_id, '[0-9]{{2}}-[0-9]{{7}}') {" ".join(f"when '{k}' then regexp_full_match(substr(tax_id, 3), '{v}')" for k, v in TAX_FORMATS.items())} else regexp_full_match(tax_id, '[A-Z]{{2}}[0-9A-Z]{{8,12}}') end as valid,
  case country when 'US' then 'US EIN format' when 'LU' then 'unknown-country' else 'format' end as how from t""")
def taxid_formats(spark, d):
    def make(k):
        n = F.lpad(k.cast("string"), 9, "0")
        country = F.element_at(F.array(*map(F.lit, _COUNTRIES)), (k % len(_COUNTRIES)).cast("int") + 1)
        out = F.when(country == "AT", F.concat(F.lit("ATU"), F.right(n, F.lit(8)))).when(country == "BE", F.concat(F.lit("BE"), (k % 3).cast("string"), n)).when(country == "ES", F.concat(F.lit("ESX"), F.right(n, F.lit(7)), F.lit("A")))
        out = out.when(country == "IT", F.concat(F.lit("IT"), n, F.lit("12"))).when(country == "NL", F.concat(F.lit("NL"), n, F.lit("B0"), (k % 20).cast("string")))
        return out.when(country == "US", F.concat(F.right(n, F.lit(2)), F.lit("-"), n)).otherwise(F.concat(country, n))

    return _customers(spark, d, make)


# --- rules over the invoice view ------------------------------------------------------------------


def _judged(spark, d):
    return validation.with_issues(fixtures.invoices(spark, d), AS_OF)


def _codes(*codes):
    def run(spark, d):
        e = _judged(spark, d).select("order_key", F.explode("issues.code").alias("code")).where(F.col("code").isin(*codes))
        return e.groupBy("order_key", "code").agg(F.count("*").alias("n"))

    return run


_RULES = [f"MISSING_{f.upper()}" for f in REQUIRED] + ["INVALID_TAX_ID", "LINE_AMOUNT_MISMATCH", "NO_LINE_ITEMS", "LINES_SUM_MISMATCH", "TAX_MISMATCH", "TOTAL_MISMATCH", "DUE_BEFORE_ISSUE", "FUTURE_DATE", "LOW_CONFIDENCE"]


def _issues_of(relation: str) -> str:
    """(seq, order_key, code) of the invoices in a relation with the columns of inv, from their values alone."""
    found = [(f"MISSING_{f.upper()}", f"{f} is null") for f in REQUIRED]
    found += [
        ("INVALID_TAX_ID", "vendor_id % 11 = 0"),
        ("NO_LINE_ITEMS", "n_lines = 0"),
        ("LINES_SUM_MISMATCH", "n_lines > 0 and abs(lines_total - subtotal) > 0.01"),
        ("TAX_MISMATCH", "abs(tax - tax_amount) > 0.01"),
        ("TOTAL_MISMATCH", "abs(subtotal + tax_amount - total) > 0.01"),
        ("DUE_BEFORE_ISSUE", "due_date < issue_date"),
        ("FUTURE_DATE", f"issue_date > date '{fixtures.AS_OF}'"),
        ("LOW_CONFIDENCE", "confidence < 0.8"),
    ]
    each = [f"select seq, order_key, '{code}' as code from {relation} where {when}" for code, when in found]
    each.append(f"select i.seq, i.order_key, 'LINE_AMOUNT_MISMATCH' from {relation} i join priced p using (order_key) where abs(p.net - p.amount) > 0.01")
    return " union all ".join(each)


_ISSUE_SQL = f"{INV_SQL}, issue as ({_issues_of('inv')})"


def _issue_sql(*codes):
    return f"with {_ISSUE_SQL} select order_key, code, count(*) as n from issue where code in ({', '.join(repr(c) for c in codes)}) group by order_key, code"


for _name, _wanted in {
    "missing_fields": ["MISSING_VENDOR_NAME", "MISSING_VENDOR_TAX_ID", "MISSING_INVOICE_NUMBER", "MISSING_ISSUE_DATE", "MISSING_CURRENCY", "MISSING_TOTAL"], "invalid_tax_id": ["INVALID_TAX_ID"], "line_mismatch": ["LINE_AMOUNT_MISMATCH"],
    "lines_sum": ["LINES_SUM_MISMATCH", "NO_LINE_ITEMS"], "tax_mismatch": ["TAX_MISMATCH"], "total_mismatch": ["TOTAL_MISMATCH"], "date_rules": ["DUE_BEFORE_ISSUE", "FUTURE_DATE"], "low_confidence": ["LOW_CONFIDENCE"],
}.items():
    _FOUND[_name] = _codes(*_wanted), _issue_sql(*_wanted)


@query(f"with {_ISSUE_SQL} select code, count(*) as n_issues, count(distinct order_key) as n_invoices from issue group by code")
def issue_histogram(spark, d):
    return reporting.issue_histogram(_judged(spark, d))


@query(f"with {_ISSUE_SQL}, n as (select order_key, count(*) as k from issue group by 1) select case when k is null then 'ok' else 'needs_review' end as status, method, count(*) as n from inv left join n using (order_key) group by 1, 2")
def status_counts(spark, d):
    return _judged(spark, d).groupBy(F.when(F.size("issues") > 0, "needs_review").otherwise("ok").alias("status"), "method").agg(F.count("*").alias("n"))


@query(f"with {_ISSUE_SQL} select order_key from inv where method <> 'text' and order_key in (select order_key from issue where code like 'MISSING_%' or code in ({', '.join(repr(c) for c in SUSPICIOUS)}))")
def second_read_router(spark, d):
    return _judged(spark, d).where(validation.needs_second_reading(F.col("method"), F.col("issues"))).select("order_key")


@query(f"""with {_ISSUE_SQL}, n as (select order_key, string_agg(code, ',' order by code) as codes from issue group by 1)
select name as file, vendor_name as vendor, invoice_number, total, currency, codes as issue_codes from inv join n using (order_key)""")
def review_queue(spark, d):
    q = reporting.review_queue(_judged(spark, d).withColumn("status", F.when(F.size("issues") > 0, "needs_review").otherwise("ok")))
    return q.select("file", "vendor", "invoice_number", "total", "currency", F.array_join(F.sort_array(F.split("issue_codes", "; ")), ",").alias("issue_codes"))


# --- files, keys, duplicates, registry ------------------------------------------------------------


@query("select doc_id, sha256(text) as sha256 from documents qualify row_number() over (partition by sha256(text) order by doc_id) = 1")
def seen_filter(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("seq"), F.lit("").alias("name"))
    return keys.unseen(docs).select("doc_id", "sha256")


def _arrivals(spark, d):
    inv = F.col("invoice")
    docs = validation.with_issues(fixtures.arrivals(spark, d), AS_OF)
    return docs.select("seq", "name", "sha256", "method", "confidence", "notes", "issues", "invoice", keys.invoice_key(inv["vendor_tax_id"], inv["invoice_number"], F.col("sha256")).alias("invoice_key"), inv["total"].alias("total"), inv["issue_date"].alias("issue_date"), inv["subtotal"].alias("subtotal"))


_KEY_SQL = f"{ARRIVAL_SQL}, keyed as (select *, case when vendor_tax_id is not null and invoice_number is not null then vendor_tax_id || '|' || upper(invoice_number) else 'file:' || left(sha256, 12) end as invoice_key from arrival)"
_FIRST_SQL = f"{_KEY_SQL}, first_of as (select invoice_key, seq as first_seq, total as first_total from keyed qualify row_number() over (partition by invoice_key order by seq) = 1)"


@query(f"with {_FIRST_SQL} select seq, invoice_key, first_seq, first_total from keyed join first_of using (invoice_key)")
def first_per_key(spark, d):
    return keys.first_per_key(_arrivals(spark, d)).select("seq", "invoice_key", "first_seq", "first_total")


_SETTLED_SQL = f"""{_FIRST_SQL}, arrived as ({_issues_of("arrival")}),
later as (select k.*, f.first_seq, k.invoice_key not like 'file:%' and seq <> first_seq as again, total is not distinct from first_total as alike from keyed k join first_of f using (invoice_key)),
told as (select seq, code from arrived union all select seq, 'DUPLICATE_INVOICE' from later where again and not alike),
ranked as (select seq, string_agg(code, ', ' order by list_position({[*_RULES, "DUPLICATE_INVOICE"]}, code)) as codes from told group by seq),
settled as (select later.* replace (case when again and not alike then invoice_key || '#conflict-' || left(sha256, 8) else invoice_key end as invoice_key),
  coalesce(codes, '') as codes, case when again and alike then 'duplicate' when codes is not null then 'needs_review' else 'ok' end as status from later left join ranked using (seq))"""


@query(f"with {_SETTLED_SQL} select seq, invoice_key, status, codes from settled")
def duplicate_status(spark, d):
    """Later copies of a key: the same content is a duplicate, other content a conflict with an issue of its own."""
    return keys.settle(_arrivals(spark, d)).select("seq", "invoice_key", "status", F.array_join("issues.code", ", ").alias("codes"))


@query("""
with stream as (select conv_id * 4294967296 + turn as seq, case when role = 'assistant' then 'text' else 'ocr' end as method, conv_id % 10 as shop, role || '-' || cast(conv_id % 3 as varchar) || '-' || cast(turn as varchar) as vendor_name from conversations),
ids as (select *, case shop when 0 then null when 1 then 'DE136695976' else 'LU' || lpad(cast(shop as varchar), 8, '0') end as tax_id from stream),
known as (select *, first_value(case when method = 'text' and tax_id is not null then vendor_name end ignore nulls) over (partition by tax_id order by seq rows between unbounded preceding and 1 preceding) as k from ids)
select seq, case when tax_id is not null and method <> 'text' and k is not null then k else vendor_name end as vendor_name, case when tax_id is not null and method <> 'text' and k is not null and k is distinct from vendor_name then 1 else 0 end as n_notes from known""")
def vendor_registry(spark, d):
    c = read(spark, d, "conversations")
    shop = F.col("conv_id") % 10
    tax = F.when(shop == 0, None).when(shop == 1, "DE136695976").otherwise(F.concat(F.lit("LU"), F.lpad(shop.cast("string"), 8, "0")))
    # Turns have 32 bits of their own.
    docs = c.select((F.col("conv_id").cast("long") * 2**32 + F.col("turn")).alias("seq"), F.when(F.col("role") == "assistant", "text").otherwise("ocr").alias("method"), tax.alias("tax_id"), F.concat("role", F.lit("-"), (F.col("conv_id") % 3).cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("vendor_name"), F.array().cast("array<string>").alias("notes"))
    return keys.enrich_from_registry(docs).select("seq", "vendor_name", F.size("notes").alias("n_notes"))


@query(f"with {INV_SQL} select vendor_tax_id as tax_id, arg_min(vendor_name, seq) as name, arg_min(name, seq) as source from inv where method = 'text' and vendor_name is not null and vendor_id % 11 <> 0 group by 1")
def learnt_vendors(spark, d):
    return keys.learnt_vendors(fixtures.invoices(spark, d).select("seq", "name", "method", F.col("invoice.vendor_tax_id").alias("tax_id"), F.col("invoice.vendor_name").alias("vendor_name")))


# --- sheets and the outbox ------------------------------------------------------------------------


@query(f"""with {_SETTLED_SQL} select invoice_key as key, status, vendor_name, vendor_tax_id, invoice_number, cast(issue_date as varchar) as issue_date, cast(due_date as varchar) as due_date, currency,
  cast(subtotal as double) as subtotal, cast(tax_rate as double) as tax_rate, cast(tax_amount as double) as tax_amount, cast(total as double) as total, cast(n_lines as integer) as line_count, codes as issues, '' as notes, name as source_file, method
from settled where status <> 'duplicate'""")
def sheet_rows_invoices(spark, d):
    """All 17 columns of the invoices sheet, for all arrivals."""
    return keys.invoice_rows(keys.settle(_arrivals(spark, d)))


_LINES_SHEET_SQL = """select invoice_key || '#' || cast(line_no as varchar) as key, invoice_key, cast(line_no as integer) as line, description, cast(p.quantity as double) as quantity, cast(unit_price as double) as unit_price, cast(amount as double) as amount, currency
from settled join priced p using (order_key) where status <> 'duplicate'"""


@query(f"with {_SETTLED_SQL} {_LINES_SHEET_SQL}")
def sheet_rows_lines(spark, d):
    return keys.line_rows(keys.settle(_arrivals(spark, d)))


def _old_and_new(spark, d):
    """Two versions of a small sheet: all orders as they were, and those that changed or are new."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("ord"))
    old = keys.outbox_rows("orders", o.where("ord % 4 <> 0").select("key", "status"))
    old = old.withColumn("synced_hash", F.when(F.col("row_key").cast("long") % 5 != 0, F.col("row_hash")))
    new = keys.outbox_rows("orders", o.where("ord % 2 = 0").select("key", F.when(F.col("ord") % 6 == 0, F.lit("changed")).otherwise(F.col("status")).alias("status")))
    return old, new


@query("""
with o as (select o_orderkey as k, o_orderstatus as s from orders)
select 'orders' as sheet, cast(k as varchar) as row_key from o where (k % 4 <> 0 and k % 2 <> 0 and k % 5 = 0) or (k % 2 = 0 and (k % 4 = 0 or k % 5 = 0 or (k % 6 = 0 and s <> 'changed')))""")
def outbox_pending(spark, d):
    return keys.pending(keys.merge_outbox(*_old_and_new(spark, d))).select("sheet", "row_key")


@query("""
with rows_t as (select o_orderkey % 5000 as key, o_orderstatus as status, o_orderkey as ord from orders), last_t as (select key, max_by(status, ord) as status, min(ord) as ord from rows_t group by key)
select cast(key as varchar) as key, status, ord, case when key in (select c_custkey from customer) then 'update' else 'append' end as action from last_t""")
def upsert_plan(spark, d):
    rows = read(spark, d, "orders").select((F.col("o_orderkey") % 5000).cast("string").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("ord"))
    return keys.upsert_plan(read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key")), rows)


@query("select cast(c_custkey as varchar) as key, c_name from customer where c_custkey in (select o_custkey from orders)")
def prune(spark, d):
    existing = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_name")
    return keys.prune(existing, read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key")))


@query("select cast(floor((row_number() over (order by o_orderkey) - 1) / 100) as bigint) as batch, count(*) over () as n_rows, o_orderkey from orders")
def sync_batches(spark, d):
    """Slices of 100 in order of key: ranges by one global sort, numbered without gathering rows in one task."""
    from tallyspark.operators.batching import numbered

    o = read(spark, d, "orders").select("o_orderkey")
    n = o.agg(F.count("*").alias("n_rows"))
    return numbered(o, "o_orderkey").join(F.broadcast(n)).select(F.floor(F.col("number") / 100).alias("batch"), "n_rows", "o_orderkey")


# --- two readings ---------------------------------------------------------------------------------


def _readings(spark, d):
    """The invoice view read twice: the second reader errs in number, total or tax id for some orders, and loses discounts."""
    k = F.col("order_key")
    base = fixtures.invoices(spark, d).where("method = 'ocr'")
    inv = F.col("invoice")
    b = inv.withField("invoice_number", F.when(k % 7 == 0, F.lit("X-1")).otherwise(F.lower(inv["invoice_number"]))).withField("total", F.when(k % 11 == 0, (inv["total"] + F.lit("9.00").cast("decimal(3,2)")).cast("decimal(18,2)")).otherwise(inv["total"]))
    b = b.withField("vendor_tax_id", F.when(k % 5 == 0, F.lit("LU12345678")).otherwise(inv["vendor_tax_id"])).withField("due_date", F.lit(None).cast("date")).withField("line_items", F.transform(inv["line_items"], lambda x: x.withField("discount_percent", F.lit(None).cast("decimal(6,3)"))))
    return base.withColumn("a", F.struct(inv.alias("invoice"), "notes")).withColumn("b", F.struct(b.alias("invoice"), "notes"))


@query(f"""with {INV_SQL}, r as (select *, case when order_key % 7 = 0 then 'X-1' else lower(invoice_number) end as number_b, case when order_key % 11 = 0 then cast(total + 9 as decimal(18,2)) else total end as total_b,
  case when order_key % 5 = 0 then 'LU12345678' else vendor_tax_id end as tax_b from inv where method = 'ocr'),
f as (select *, coalesce(abs(subtotal + tax_amount - total_b) <= 0.01 and order_key % 37 <> 0, false) as b_fits, coalesce(abs(subtotal + tax_amount - total) <= 0.01 and order_key % 37 <> 0, false) as a_fits, coalesce(total <> total_b, false) as differs from r)
select order_key, case when invoice_number is null then number_b when number_b is null then invoice_number when upper(invoice_number) = upper(number_b) then number_b else invoice_number end as invoice_number,
  case when vendor_tax_id is null then tax_b when vendor_tax_id = tax_b then tax_b when vendor_id % 11 <> 0 then vendor_tax_id else vendor_tax_id end as vendor_tax_id,
  due_date, case when differs and not b_fits and a_fits then total else coalesce(total_b, total) end as total,
  cast((case when invoice_number is not null and number_b is not null and upper(invoice_number) <> upper(number_b) then 1 else 0 end) + (case when vendor_tax_id <> tax_b and vendor_id % 11 = 0 then 1 else 0 end) + (case when differs and not b_fits and not a_fits then 1 else 0 end)
    + bad_lines * 0 as integer) as n_conflicts from f""")
def reconcile_fields(spark, d):
    out = reconciliation.reconcile(_readings(spark, d)).select("order_key", "out")
    return out.select("order_key", *_fields("out.invoice", "invoice_number", "vendor_tax_id", "due_date", "total"), F.size(F.filter("out.conflicts", lambda c: ~F.startswith(c, F.lit("line ")))).alias("n_conflicts"))


@query(f"""with {LINE_SQL}, ocr as (select * from priced where order_key % 3 = 0 and order_key in (select o_orderkey from orders))
select order_key, count(*) as n_lines, cast(sum(discount_percent) as decimal(18,3)) as discounts, cast(sum(amount) as decimal(18,2)) as amounts from ocr group by order_key""")
def reconcile_lines(spark, d):
    out = reconciliation.reconcile(_readings(spark, d)).select("order_key", F.explode("out.invoice.line_items").alias("x"))
    return out.groupBy("order_key").agg(F.count("*").alias("n_lines"), F.sum("x.discount_percent").cast("decimal(18,3)").alias("discounts"), F.sum("x.amount").cast("decimal(18,2)").alias("amounts"))


# --- evaluation -----------------------------------------------------------------------------------


def _evaluated(spark, d):
    """The invoice view against itself with planted misreadings."""
    k = F.col("order_key")
    base = _judged(spark, d)
    inv = F.col("invoice")
    wrong = {
        "total": F.when(k % 10 != 0, inv["total"]),
        "vendor_name": F.concat(F.upper(inv["vendor_name"]), F.lit(" .")),
        "currency": F.when(k % 8 == 0, F.lit("JPY")).otherwise(inv["currency"]),
        "vendor_tax_id": F.when(k % 6 == 0, F.lit("DE1")).otherwise(F.concat(F.lit(" "), F.lower(inv["vendor_tax_id"]))),
        "invoice_number": F.when(k % 9 == 0, F.lit("0")).otherwise(F.lower(inv["invoice_number"])),
        "issue_date": F.when(k % 12 != 0, inv["issue_date"]),
        "tax_rate": F.when(k % 14 == 0, inv["tax_rate"] + 1).otherwise(inv["tax_rate"]).cast("decimal(6,3)"),
        "line_items": F.transform(inv["line_items"], lambda x: x.withField("amount", F.when(k % 15 == 0, x["amount"] + 1).otherwise(x["amount"]).cast("decimal(18,2)")).withField("description", F.concat(F.upper(x["description"]), F.when(k % 16 == 0, "x").otherwise("!")))),
    }
    got = inv
    for field, value in wrong.items():
        got = got.withField(field, value)
    defect = F.when(k % 37 == 0, "tax").when(k % 41 == 0, "total").when(k % 23 == 0, "due")
    expected = F.when(k % 37 == 0, F.array(F.lit("TAX_MISMATCH"))).when(k % 41 == 0, F.array(F.lit("TOTAL_MISMATCH"))).when(k % 23 == 0, F.array(F.lit("DUE_BEFORE_ISSUE"))).otherwise(F.array().cast("array<string>"))
    return base.select(F.col("name").alias("file"), (F.col("method") == "ocr").alias("scanned"), inv.alias("truth"), got.alias("got"), defect.alias("defect"), expected.alias("expected_issues"), F.col("issues.code").alias("codes"))


_WRONG = {"total": "total is null or order_key % 10 <> 0", "currency": "order_key % 8 <> 0", "vendor_tax_id": "order_key % 6 <> 0", "invoice_number": "order_key % 9 <> 0", "issue_date": "order_key % 12 <> 0", "tax_rate": "tax_rate is null or order_key % 14 <> 0", "lines": "n_lines = 0 or order_key % 15 <> 0", "descriptions": "n_lines = 0 or order_key % 16 <> 0"}
_CHECKED = ", ".join(f"{{'field': '{f}', 'ok': {_WRONG.get(f, 'true')}}}" for f in [*reporting.COMPARED, "lines", "descriptions"])


@query(f"""with {INV_SQL}, c as (select method = 'ocr' as scanned, unnest([{_CHECKED}]) as e from inv)
select e.field as field, count(*) filter (scanned and e.ok) as scan_ok, count(*) filter (scanned) as scan_n, count(*) filter (not scanned and e.ok) as text_ok, count(*) filter (not scanned) as text_n from c group by 1""")
def field_accuracy(spark, d):
    return reporting.field_accuracy(reporting.compare(_evaluated(spark, d)))


_EVAL_SQL = f"""{_ISSUE_SQL}, e as (select order_key, case when order_key % 37 = 0 then 'tax' when order_key % 41 = 0 then 'total' when order_key % 23 = 0 then 'due' end as defect,
  case when order_key % 37 = 0 then 'TAX_MISMATCH' when order_key % 41 = 0 then 'TOTAL_MISMATCH' when order_key % 23 = 0 then 'DUE_BEFORE_ISSUE' end as expected from inv)"""


@query(f"with {_EVAL_SQL} select defect, count(*) as planted, count(*) filter (exists (select 1 from issue where issue.order_key = e.order_key and code = expected)) as caught from e where defect is not null group by defect")
def defects_caught(spark, d):
    return reporting.defects_caught(_evaluated(spark, d))


@query(f"with {_EVAL_SQL} select count(*) as clean, count(*) filter (order_key in (select order_key from issue)) as flagged from e where defect is null")
def clean_flagged(spark, d):
    return reporting.clean_flagged(_evaluated(spark, d))


@query(f"with {_EVAL_SQL} select code, count(distinct e.order_key) as n from e join issue using (order_key) where code is distinct from expected group by code")
def false_alarms(spark, d):
    return reporting.false_alarms(_evaluated(spark, d))


# --- pages: cells, lines, fields ------------------------------------------------------------------


@query("""
with c as (select p_partkey, p_size from part), h as (select p_partkey % 50 as page, median(p_size * 1.0) as med, max(p_size) as top, cast(avg(p_size) as double) as mean from c group by 1)
select page, cast(med as double) as med, top, mean from h""")
def cell_heights(spark, d):
    """The geometry aggregates: median, maximum and mean by page."""
    return read(spark, d, "part").groupBy((F.col("p_partkey") % 50).alias("page")).agg(F.median(F.col("p_size").cast("double")).alias("med"), F.max("p_size").alias("top"), F.avg("p_size").alias("mean"))


@query("""
with cells as (select l_orderkey % 500 as page, cast(l_quantity as double) as size, l_partkey % 2 = 0 as bold, cast(l_suppkey as double) as top, l_partkey as id, cast(l_suppkey as double) <= 30 as high from lineitem),
best as (select *, max(size) over (partition by page) as biggest from cells where high)
select page, id from best where size >= biggest - 0.5 qualify row_number() over (partition by page order by bold desc, top, id) = 1""")
def vendor_name_topk(spark, d):
    item = read(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("page"), F.col("l_quantity").alias("size"), (F.col("l_partkey") % 2 == 0).alias("bold"), F.col("l_suppkey").cast("double").alias("top"), F.col("l_partkey").alias("id"))
    return layout.top_cell(item.where("top <= 30"), "page", "id").select("page", "id")


def _pages(spark, d):
    return pages.synthetic_pages(fixtures.invoices(spark, d))


@query("""
with word as (select l_orderkey as page, l_linenumber as line, l_partkey, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) as pos from lineitem),
line as (select page, line, string_agg('p' || cast(l_partkey as varchar) || ' x', '  ' order by pos) as t from word group by 1, 2)
select page, count(*) as n_lines, string_agg(t, chr(10) order by line) as text from line group by page""")
def line_clustering(spark, d):
    """Words with places become lines of cells: close words of a line merge, wider gaps part columns, tops that differ a little are one line."""
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    item = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(order).alias("pos"))
    left, top = F.col("pos") * 100.0, F.col("l_linenumber") * 20.0 + F.col("pos") % 2
    word = lambda t, x, y: F.struct(t.alias("text"), x.alias("x0"), (x + 40).alias("x1"), y.alias("top"), (y + 9).alias("bottom"), F.lit(9.0).alias("size"), F.lit(False).alias("bold"))
    words = F.array(word(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), left, top), word(F.lit("x"), left + 43, top + 1))
    cells = F.flatten(F.collect_list(words)).cast(f"array<{CELL}>")
    page = item.groupBy("l_orderkey").agg(cells.alias("cells")).select(F.col("l_orderkey").alias("page"), "cells", F.lit("text").alias("source"))
    return layout.with_lines(page).select("page", F.size("lines").alias("n_lines"), layout.page_text(F.col("lines")).alias("text"))


_STYLE = f"{[s.name for s in pages.STYLES]}[cast(order_key % {len(pages.STYLES)} + 1 as integer)]"
_PRINTED_SQL = f"""{INV_SQL}, named as (select *, {_STYLE} as style, translate(vendor_name, '#0123456789', ' ABCDEFGHIJ') as shown from inv),
page as (select sha256, order_key, style, case when style = 'us' then upper(shown) else shown end as vendor_name, vendor_tax_id, invoice_number, issue_date, due_date,
  case when style = 'it' then 'EUR' when style = 'ch' then 'CHF' when n_lines = 0 then null when style = 'us' then 'USD' when style = 'uk' then 'GBP' else 'EUR' end as currency,
  subtotal, tax_rate, tax_amount, total, method from named)"""


@query(f"""with {_PRINTED_SQL}, counted as (select *, (vendor_name is not null)::int + (vendor_tax_id is not null)::int + (invoice_number is not null)::int + (issue_date is not null)::int + (currency is not null)::int + (total is not null)::int as found from page)
select sha256, vendor_name, vendor_tax_id, invoice_number, issue_date, due_date, currency, subtotal, tax_rate, tax_amount, total, round(found / 6 * case when method = 'ocr' then 0.9 else 1 end, 3) as confidence from counted""")
def extract_fields(spark, d):
    """What is read from the printed pages of all invoices, in eight styles and from scans, is what was printed."""
    got = extraction.extract(_pages(spark, d))
    fields = ["vendor_name", "vendor_tax_id", "invoice_number", "issue_date", "due_date", "currency", "subtotal", "tax_rate", "tax_amount", "total"]
    return got.select("sha256", *_fields("invoice", *fields), "confidence")


@query(f"""with {_PRINTED_SQL}
select sha256, cast(line_no - 1 as integer) as pos, regexp_replace(p.description, '[0-9#]', 'x', 'g') as description, quantity, unit_price, amount, case when style = 'es' and discount_percent > 0 then discount_percent end as discount_percent
from page join priced p using (order_key)""")
def line_item_table(spark, d):
    """All lines of all pages: wrapped descriptions, rate and discount columns, quantities and separators that a scan lost."""
    return extraction.line_items(_pages(spark, d)).select("sha256", F.posexplode("line_items").alias("pos", "item")).select("sha256", "pos", "item.*")
