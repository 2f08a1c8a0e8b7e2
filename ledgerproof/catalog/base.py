"""Invoice-shaped tables derived from `orders`, `lineitem` and `supplier`.

Every order with lines becomes one document. All rows of the tables take part;
the order key only decides which defect, if any, a document shows. The SQL
below derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerproof.catalog.core import Tables, derived
from ledgerproof.functions.text import fixed2
from ledgerproof.schemas import LINE_ITEM, WORD


def _every(n: int, r: int = 0) -> Column:
    return F.col("k") % n == r


def _cents(x: Column) -> Column:
    return F.rint(x * 100).cast("bigint")


@derived
def lines(t: Tables) -> DataFrame:
    """Totals per order: plain sums of whole cents, combined before the shuffle."""
    price = F.col("l_extendedprice")
    cents = _cents(price)
    flag = F.col("l_returnflag")
    kinds = {"a": flag == "A", "n": flag == "N", "r": ~flag.isin("A", "N")}
    aggs = []
    for name, cond in kinds.items():
        aggs.append(F.count_if(cond).alias(f"{name}_n"))
        aggs.append(F.sum(F.when(cond, cents).otherwise(0)).alias(f"{name}_cents"))
    return t.lineitem.groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("suppkey"),
        F.max("l_shipdate").cast("date").alias("due_date"),
        F.sum(cents).alias("line_cents"),
        F.sum(F.floor(price * F.col("l_tax") * 100 + 0.5)).alias("tax_cents"),
        *aggs,
    )


@derived
def base(t: Tables) -> DataFrame:
    """One row per document with the values printed on it."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    suppliers = t.supplier.select("s_suppkey", "s_name")
    rows = (
        orders.join(lines(t), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(suppliers, F.col("suppkey") == F.col("s_suppkey"), "left")
        .withColumn("k", F.col("o_orderkey"))
    )
    name = (
        F.when(_every(23), F.lit(None).cast("string"))
        .when(_every(19), F.concat(F.lit("  "), F.upper("s_name")))
        .otherwise(F.col("s_name"))
    )
    currency = F.when(_every(7, 5), F.lit(None).cast("string"))
    for r, code in {0: "USD", 1: "eur", 2: "GBP", 3: "US Dollars", 4: "JPY", 6: "XXX"}.items():
        currency = currency.when(_every(7, r), F.lit(code))

    def money(c):
        return F.col(c).cast("double") / 100.0

    def item(kind, label):
        amount = money(f"{kind}_cents")
        if kind == "n":
            amount = F.when(~_every(11), amount)
        return F.when(
            F.col(f"{kind}_n") > 0,
            F.struct(
                F.lit(label).alias("description"),
                F.col(f"{kind}_n").cast("double").alias("quantity"),
                F.lit(None).cast("double").alias("unit_price"),
                amount.alias("amount"),
            ).cast(LINE_ITEM),
        )

    rows = rows.withColumn("subtotal", money("line_cents") + F.when(_every(13), 1.0).otherwise(0.0))
    rows = rows.withColumn("tax", money("tax_cents"))
    rows = rows.withColumn("sum_total", F.col("subtotal") + F.col("tax"))
    return rows.select(
        "k",
        F.concat(F.lit("D"), F.lpad(F.col("k").cast("string"), 12, "0")).alias("document_id"),
        F.concat(F.lit("t"), F.col("o_custkey") % 5).alias("tenant_id"),
        name.alias("supplier"),
        F.concat(F.lit("INV-"), F.col("k") % 40).alias("invoice_number"),
        F.col("o_orderdate").cast("date").alias("invoice_date"),
        "due_date",
        currency.alias("currency"),
        "subtotal", "tax",
        F.when(_every(5), F.col("o_totalprice")).otherwise(F.col("sum_total")).alias("total"),
        F.array_compact(
            F.array(item("a", "accepted"), item("n", "new"), item("r", "returned"))
        ).alias("line_items"),
        "sum_total",
    )


BASE_SQL = """
lines AS (
  SELECT l_orderkey, min(l_suppkey) AS suppkey, CAST(max(l_shipdate) AS DATE) AS due_date,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS line_cents,
    CAST(sum(CAST(floor(l_extendedprice * l_tax * 100 + 0.5) AS BIGINT)) AS BIGINT) AS tax_cents,
    sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS n_n,
    max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) + max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)
      + max(CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 1 ELSE 0 END) AS n_items,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS a_cents,
    CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS n_cents,
    CAST(sum(CASE WHEN l_returnflag NOT IN ('A', 'N') THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS r_cents
  FROM lineitem GROUP BY l_orderkey),
base0 AS (
  SELECT o_orderkey AS k,
    'D' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS document_id,
    't' || CAST(o_custkey % 5 AS VARCHAR) AS tenant_id,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL
         WHEN o_orderkey % 19 = 0 THEN '  ' || upper(s_name) ELSE s_name END AS supplier,
    'INV-' || CAST(o_orderkey % 40 AS VARCHAR) AS invoice_number,
    CAST(o_orderdate AS DATE) AS invoice_date, due_date,
    CASE o_orderkey % 7 WHEN 0 THEN 'USD' WHEN 1 THEN 'eur' WHEN 2 THEN 'GBP'
      WHEN 3 THEN 'US Dollars' WHEN 4 THEN 'JPY' WHEN 6 THEN 'XXX' END AS currency,
    CAST(line_cents AS DOUBLE) / 100e0 + CASE WHEN o_orderkey % 13 = 0 THEN 1e0 ELSE 0e0 END AS subtotal,
    CAST(tax_cents AS DOUBLE) / 100e0 AS tax,
    CASE WHEN o_orderkey % 11 = 0 AND n_n > 0 THEN NULL
      ELSE 0e0 + CAST(a_cents AS DOUBLE) / 100e0 + CAST(n_cents AS DOUBLE) / 100e0
           + CAST(r_cents AS DOUBLE) / 100e0 END AS line_sum,
    o_totalprice, n_items
  FROM orders JOIN lines ON o_orderkey = l_orderkey LEFT JOIN supplier ON suppkey = s_suppkey),
base AS (
  SELECT *, subtotal + tax AS sum_total,
    CASE WHEN k % 5 = 0 THEN o_totalprice ELSE subtotal + tax END AS total FROM base0)
"""


@derived
def suppliers(t: Tables) -> DataFrame:
    """The known suppliers of every tenant: those with a non-negative balance."""
    known = t.supplier.where(F.col("s_acctbal") >= 0).select(F.col("s_name").alias("name"))
    tenants = F.array(*[F.lit(f"t{i}") for i in range(5)])
    return known.select(F.explode(tenants).alias("tenant_id"), "name")


SUPPLIERS_SQL = """
known AS (
  SELECT 't' || CAST(i AS VARCHAR) AS tenant_id, s_name AS name
  FROM supplier CROSS JOIN range(5) AS r(i) WHERE s_acctbal >= 0)
"""


def records(t: Tables) -> DataFrame:
    """The base rows as records of a first attempt."""
    return base(t).select(
        "k", F.concat("document_id", F.lit("-1")).alias("extraction_id"),
        "document_id", "tenant_id", F.lit(1).alias("attempt_no"),
        F.struct(
            "supplier", "invoice_number", "invoice_date", "due_date", "currency", "subtotal",
            "tax", "total", "line_items",
        ).alias("record"),
    )


def _page_total() -> Column:
    return F.when(_every(20), F.col("sum_total")).otherwise(F.col("total"))


@derived
def pages(t: Tables) -> DataFrame:
    """Two pages per document, with a box for every word."""

    def row(label, value):
        return F.concat(F.lit(label), value)

    one = F.array_compact(F.array(
        row("Supplier: ", F.col("supplier")),
        row("Invoice ", F.col("invoice_number")),
        row("Invoice Date: ", F.col("invoice_date").cast("string")),
        row("Due Date: ", F.col("due_date").cast("string")),
    ))
    two = F.array_compact(F.array(
        row("Currency: ", F.col("currency")),
        row("Subtotal: ", fixed2(F.col("subtotal"))),
        row("Tax: ", fixed2(F.col("tax"))),
        row("Total: ", fixed2(_page_total())),
    ))

    def page(no, parts):
        return F.struct(F.lit(no).alias("page_no"), F.array_join(parts, "\n").alias("text"))

    return base(t).select("document_id", F.inline(F.array(page(1, one), page(2, two)))).select(
        "document_id", "page_no", F.lit("text_layer").alias("text_source"), "text",
        word_boxes(F.col("text")).alias("words"),
    )


def word_boxes(text: Column) -> Column:
    """Words of a text with boxes that follow from their position."""
    tokens = F.array_remove(F.split(text, "[ \n\t\r]+"), "")
    return F.transform(
        tokens,
        lambda w, i: F.struct(
            w.alias("text"),
            F.array(i * 10.0, F.lit(20.0), i * 10.0 + 8.0, F.lit(30.0)).alias("bbox"),
        ),
    ).cast(f"array<{WORD}>")


@derived
def answers(t: Tables) -> DataFrame:
    """Two answers per document in the grounded JSON shape, plus a review.

    First answers show the defects a model makes; second ones are clean and
    correct every other wrong total. What both say alike is written once per document.
    """
    first = F.col("attempt_no") == 1

    def bad(n):
        return first & _every(n)

    null = F.lit("null")

    def quoted(x):
        return F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), null)

    def number(x):
        return F.coalesce(x.cast("string"), null)

    def wrap(value, source, page):
        """A wrapped value; all three parts are already JSON text or columns of it."""
        page = F.lit(str(page)) if isinstance(page, int) else page
        return F.concat(
            F.lit('{"value":'), value, F.lit(',"page_no":'),
            F.when(source.isNull(), null).otherwise(page),
            F.lit(',"source_text":'), quoted(source), F.lit("}"),
        )

    def text(c):
        return F.col(c).cast("string")

    def printed(c):
        return wrap(number(F.col(c)), fixed2(F.col(c)), 2)

    def item(i, quantity):
        return F.concat(
            F.lit('{"description":'), quoted(i["description"]), F.lit(',"quantity":'), quantity,
            F.lit(',"unit_price":null,"amount":'), number(i["amount"]), F.lit("}"),
        )

    # A base row has an item per kind at most; read by place, without a lambda, they run as generated code.
    slots = [F.get("line_items", F.lit(i)) for i in range(3)]

    def items(quantity):
        return F.concat_ws(",", *[F.when(i.isNotNull(), item(i, quantity(i))) for i in slots])

    alike = {
        "supplier_cell": wrap(quoted(F.col("supplier")), F.col("supplier"), 1),
        "due_date_cell": wrap(quoted(text("due_date")), text("due_date"), 1),
        "currency_cell": wrap(quoted(F.col("currency")), F.col("currency"), 2),
        "subtotal_cell": printed("subtotal"),
        "tax_cell": printed("tax"),
        "total_number": text("total"),
        "total_text": fixed2(F.col("total")),
        "sum_number": F.when(_every(10), text("sum_total")),
        "sum_text": F.when(_every(10), fixed2(F.col("sum_total"))),
        "items": items(lambda i: number(i["quantity"])),
        "odd_items": F.when(_every(10, 3), items(lambda i: F.lit('"a lot"'))),
    }
    both = base(t).withColumns(alike).withColumn(
        "attempt_no", F.explode(F.array(F.lit(1), F.lit(2)))
    )
    corrected = ~first & _every(10)
    total = F.when(corrected, F.col("sum_number")).otherwise(F.col("total_number"))
    total_text = F.when(corrected, F.col("sum_text")).otherwise(F.col("total_text"))
    date_text = F.when(bad(29), F.lit("03/04")).otherwise(text("invoice_date"))
    number_text = F.when(bad(27), F.lit("no such words here")).otherwise(F.col("invoice_number"))
    listed = F.when(first & _every(10, 3), F.col("odd_items")).otherwise(F.col("items"))
    parts = {
        "supplier": F.when(bad(31), quoted(F.col("supplier")))
        .otherwise(F.col("supplier_cell")),
        "invoice_number": wrap(
            F.when(bad(41), F.lit("12345")).otherwise(quoted(F.col("invoice_number"))),
            number_text, 1,
        ),
        "invoice_date": wrap(quoted(date_text), date_text, 1),
        "due_date": F.col("due_date_cell"),
        "currency": F.col("currency_cell"),
        "subtotal": F.col("subtotal_cell"),
        "tax": F.when(bad(37), wrap(F.lit('{"bad":1}'), fixed2(F.col("tax")), 2))
        .otherwise(F.col("tax_cell")),
        "total": F.when(
            first & _every(6, 1), wrap(quoted(F.concat(F.lit(" "), total_text, F.lit(" "))), total_text, 2)
        ).otherwise(wrap(number(total), total_text, F.when(bad(17), "1").otherwise("2"))),
        "line_items": F.when(bad(43), F.lit('"n/a"')).otherwise(
            F.concat(F.lit("["), listed, F.lit("]"))
        ),
    }
    answer = F.concat(
        F.lit("{"),
        F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]),
        F.lit("}"),
    )
    agrees = F.when(
        F.when(first, _every(9, 4)).otherwise(_every(45, 4)), F.lit(False)
    ).when(_every(3), F.lit(True))
    review = F.concat(F.lit('{"total":{"agrees":'), number(agrees), F.lit("}}"))
    return both.select(
        "k", F.concat("document_id", F.lit("-"), "attempt_no").alias("extraction_id"),
        "document_id", "tenant_id", "attempt_no",
        answer.alias("raw"), review.alias("review"),
    )


ANSWERS_SQL = BASE_SQL + """,
tries AS (
  SELECT base.*, attempt_no, document_id || '-' || CAST(attempt_no AS VARCHAR) AS extraction_id,
    attempt_no = 1 AS f,
    CASE WHEN k % 20 = 0 THEN sum_total ELSE total END AS page_total
  FROM base CROSS JOIN (VALUES (1), (2)) AS a(attempt_no)),
ans0 AS (
  SELECT k, document_id, tenant_id, attempt_no, extraction_id, f, page_total,
    CASE WHEN f AND k % 31 = 0 THEN NULL ELSE supplier END AS supplier,
    CASE WHEN f AND k % 41 = 0 THEN NULL ELSE invoice_number END AS invoice_number,
    CASE WHEN f AND k % 29 = 0 THEN NULL ELSE invoice_date END AS invoice_date,
    due_date, currency, subtotal, tax AS printed_tax,
    CASE WHEN f AND k % 37 = 0 THEN NULL ELSE tax END AS tax,
    CASE WHEN NOT f AND k % 10 = 0 THEN sum_total
         WHEN f AND k % 6 = 1 THEN CAST(format('{:.2f}', total) AS DOUBLE)
         ELSE total END AS total,
    CASE WHEN f AND k % 43 = 0 THEN NULL ELSE line_sum END AS line_sum,
    CASE WHEN f AND k % 43 = 0 THEN 0 ELSE n_items END AS n_items,
    CASE WHEN f AND k % 43 = 0 THEN 1 ELSE 0 END AS w_items,
    CASE WHEN f AND k % 41 = 0 THEN 1 ELSE 0 END AS w_number,
    CASE WHEN f AND k % 29 = 0 THEN 1 ELSE 0 END AS w_date,
    CASE WHEN f AND k % 37 = 0 THEN 1 ELSE 0 END AS w_tax,
    CASE WHEN f THEN CASE WHEN k % 9 = 4 THEN false WHEN k % 3 = 0 THEN true END
         ELSE CASE WHEN k % 45 = 4 THEN false WHEN k % 3 = 0 THEN true END END AS agrees_total
  FROM tries),
ans AS (
  SELECT *,
    supplier IS NOT NULL AS g_supplier,
    NOT (f AND k % 27 = 0) AS g_number,
    NOT (f AND k % 29 = 0) AS g_date,
    true AS g_due, currency IS NOT NULL AS g_currency, true AS g_subtotal, true AS g_tax,
    NOT (f AND k % 17 = 0 AND k % 6 <> 1)
      AND format('{:.2f}', total) IN (format('{:.2f}', subtotal), format('{:.2f}', printed_tax),
                                      format('{:.2f}', page_total)) AS g_total,
    CASE WHEN supplier IS NULL OR supplier = '' THEN 1 ELSE 0 END AS e_supplier,
    CASE WHEN invoice_number IS NULL OR invoice_number = '' THEN 1 ELSE 0 END AS e_number,
    CASE WHEN invoice_date IS NULL THEN 1 ELSE 0 END AS e_date,
    CASE WHEN abs(line_sum - subtotal) > 0.02e0 THEN 1 ELSE 0 END AS e_lines,
    CASE WHEN abs(subtotal + tax - total) > 0.02e0 THEN 1 ELSE 0 END AS e_total,
    CASE WHEN due_date < invoice_date THEN 1 ELSE 0 END AS e_due,
    CASE WHEN upper(currency) NOT IN (@CODES@) THEN 1 ELSE 0 END AS w_currency
  FROM ans0),
judged AS (
  SELECT *,
    e_supplier + e_number + e_date + e_lines + e_total + e_due AS n_errors,
    w_items + w_number + w_date + w_tax + w_currency AS n_warnings,
    (e_supplier + e_number + e_date + e_lines + e_total + e_due > 0)
      OR (supplier IS NOT NULL AND NOT g_supplier) OR (invoice_number IS NOT NULL AND NOT g_number)
      OR (invoice_date IS NOT NULL AND NOT g_date) OR (total IS NOT NULL AND NOT g_total)
      OR (agrees_total IS NOT DISTINCT FROM false) AS suspect,
    CASE WHEN supplier IS NULL OR g_supplier THEN 1 ELSE 0 END + (1 - e_supplier) + 1 AS s_supplier,
    CASE WHEN invoice_number IS NULL OR g_number THEN 1 ELSE 0 END + (1 - e_number) + 1 AS s_number,
    CASE WHEN invoice_date IS NULL OR g_date THEN 1 ELSE 0 END + (1 - e_date) + 1 AS s_date,
    1 + (1 - e_due) + 1 AS s_due, 3 AS s_currency, 1 + (1 - e_lines) + 1 AS s_subtotal, 3 AS s_tax,
    CASE WHEN total IS NULL OR g_total THEN 1 ELSE 0 END + (1 - e_total)
      + CASE WHEN agrees_total IS NOT DISTINCT FROM false THEN 0 ELSE 1 END AS s_total
  FROM ans),
final AS (
  SELECT j.*, o.suspect AS escalated,
    least(j.s_supplier, j.s_number, j.s_date, j.s_total) AS s_min,
    (least(j.s_supplier, j.s_number, j.s_date, j.s_total)
      + CASE WHEN o.suspect THEN 0 ELSE 1 END) / 4e0 AS confidence
  FROM judged j JOIN judged o ON o.document_id = j.document_id AND o.attempt_no = 1
  WHERE j.attempt_no = CASE WHEN o.suspect THEN 2 ELSE 1 END)
"""


def _codes() -> str:
    from ledgerproof.config import CURRENCY_CODES

    return ", ".join(f"'{c}'" for c in CURRENCY_CODES)


ANSWERS_SQL = ANSWERS_SQL.replace("@CODES@", _codes())
