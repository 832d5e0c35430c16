"""Business documents derived from the order tables, by one SQL text for Spark and for the oracle.

Amounts are whole cents until the last step, so both engines compute the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that "today" is in all queries, so that results can be repeated.
AS_OF = "2030-01-01"

LINES = """
SELECT k, idx, supp, q, unit_c, cast(q * unit_c as bigint) AS true_c,
       CASE WHEN (k + idx) % 37 = 0 THEN NULL WHEN (k + idx) % 11 = 0 THEN cast(q * unit_c as bigint) + 1500 ELSE cast(q * unit_c as bigint) END AS printed_c
FROM (
  SELECT l_orderkey AS k, l_suppkey AS supp, cast(l_quantity as bigint) AS q,
         cast(floor(cast(round(l_extendedprice * 100) as double) / l_quantity) as bigint) AS unit_c,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS idx
  FROM {lineitem}
) x"""

INVOICES = """
SELECT k, concat('INV-', lpad(cast(k as string), 8, '0')) AS invoice_number,
       CASE WHEN k % 17 = 0 THEN NULL ELSE coalesce(s_name, 'Counter sale') END AS vendor_name, c_name AS customer_name,
       CASE WHEN k % 19 = 0 THEN '14/03/2024' WHEN k % 23 = 0 THEN '2024-02-31' WHEN k % 29 = 0 THEN '1974-05-06' WHEN k % 31 = 0 THEN '2031-01-15' ELSE cast(day as string) END AS issue_date,
       cast(CASE WHEN k % 13 = 0 THEN day - 5 ELSE day + 30 END as string) AS due_date,
       CASE k % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'SR' WHEN 3 THEN 'sar' END AS currency,
       sub_c, tax_c, ship_c, sub_c + tax_c + coalesce(ship_c, 0) + CASE WHEN k % 7 = 0 THEN 1500 ELSE 0 END AS total_c
FROM (
  SELECT o_orderkey AS k, cast(o_orderdate as date) AS day, s_name, c_name, coalesce(sub_c, 0) AS sub_c,
         cast(floor(cast(coalesce(sub_c, 0) as double) / 20) as bigint) AS tax_c, CASE WHEN o_orderkey % 3 = 0 THEN cast(1000 as bigint) END AS ship_c
  FROM {orders}
  LEFT JOIN {customer} ON o_custkey = c_custkey
  LEFT JOIN (SELECT k AS lk, cast(sum(true_c) as bigint) AS sub_c, max(CASE WHEN idx = 0 THEN supp END) AS supp FROM {lines} GROUP BY k) l ON o_orderkey = lk
  LEFT JOIN {supplier} ON supp = s_suppkey
) y"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINES, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "supplier")}
    return spark.sql(INVOICES, lines=lines(spark, sf_dir), **read)


def _amount(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c) / F.lit(100.0)


def both_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, a, b): the typed invoices that engine 'a' (all right) and 'b' (with faults) give, built at once."""
    item = lambda x, quantity: F.struct(quantity.alias("quantity"), x["unit_price"].alias("unit_price"), x["total"].alias("total"))
    row = F.struct("idx", F.col("q").cast("double").alias("quantity"), _amount("unit_c").alias("unit_price"), _amount("printed_c").alias("total"))
    rows = lines(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    all_items = F.transform("rows", lambda x: item(x, x["quantity"]))
    # Engine b drops the last line of some documents and misreads the first of others.
    heard = F.when(F.col("k") % 9 == 0, F.slice("rows", 1, F.size("rows") - 1)).otherwise(F.col("rows"))
    misread = F.transform(heard, lambda x: item(x, F.when((F.col("k") % 8 == 0) & (x["idx"] == 0), x["quantity"] + 1).otherwise(x["quantity"])))
    empty = F.array().cast("array<struct<quantity:double,unit_price:double,total:double>>")

    def doc(vendor: Column, total: Column, items: Column) -> Column:
        return F.struct(
            "invoice_number", vendor.alias("vendor_name"), "customer_name", "issue_date", "due_date", "currency",
            _amount("sub_c").alias("subtotal"), _amount("tax_c").alias("tax_amount"), _amount("ship_c").alias("shipping"), _amount(total).alias("total"),
            F.coalesce(items, empty).alias("items"),
        )

    right = doc(F.col("vendor_name"), F.col("total_c"), all_items)
    wrong = doc(F.when(F.col("k") % 12 != 0, F.col("vendor_name")), F.when(F.col("k") % 10 == 0, F.col("total_c") + 100).otherwise(F.col("total_c")), misread)
    return invoices(spark, sf_dir).join(rows, "k", "left").select("k", right.alias("a"), F.when(F.col("k") % 41 != 0, wrong).alias("b"))


def invoice_docs(spark: SparkSession, sf_dir: str, answer: str = "a") -> DataFrame:
    """(k, doc) of one engine."""
    return both_docs(spark, sf_dir).select("k", F.col(answer).alias("doc"))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, text) of each invoice as printed lines; some totals in Arabic digits."""
    return spark.sql(RENDERED, inv=invoices(spark, sf_dir))


RENDERED = """
SELECT k, concat(CASE WHEN k % 6 = 0 THEN 'شركة النور' ELSE coalesce(vendor_name, '') END, chr(10),
  CASE k % 3 WHEN 0 THEN 'Invoice No: ' WHEN 1 THEN 'INV NO ' ELSE 'Invoice # - ' END, invoice_number, chr(10),
  'Issue Date: ', CASE WHEN k % 4 = 0 THEN '07.03.99' ELSE issue_date END, chr(10),
  'Subtotal ', cast(sub_c as string), '.00', chr(10),
  CASE WHEN k % 5 = 0 THEN 'Total ' ELSE 'Grand Total ' END, CASE k % 4 WHEN 0 THEN '$' WHEN 1 THEN 'SAR ' WHEN 2 THEN 'eur ' ELSE '' END,
  CASE WHEN k % 7 = 0 THEN translate(cast(total_c as string), '0123456789', '٠١٢٣٤٥٦٧٨٩') ELSE concat(cast(total_c as string), '.50') END, chr(10), 'Thank you') AS text
FROM {inv}"""

#: The same for the oracle, as leading common table expressions.
CTE = f"""WITH ln AS ({LINES.format(lineitem="lineitem")}),
inv AS ({INVOICES.format(orders="orders", customer="customer", supplier="supplier", lines="ln")}),
txt AS ({RENDERED.format(inv="inv")})"""
