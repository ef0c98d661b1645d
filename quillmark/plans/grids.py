"""Queries of tables on pages, made from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids
from .catalogue import query, t

#: An order's lines are rows of two tables, one to a page; a third of the orders has tables of another kind.
_GRID = """li AS (SELECT l_orderkey AS ord, l_linenumber % 2 AS page, l_linenumber AS row, CAST(l_shipdate AS DATE) + 5110 AS a, CAST(l_shipdate AS DATE) + 5110 + CAST(l_quantity AS INTEGER) * 40 - 80 AS b FROM lineitem),
td AS (SELECT ord, page, row, a AS s, b AS e FROM li WHERE ord % 3 <> 0),
ok AS (SELECT ord, page, s, e FROM td WHERE e > s AND year(s) BETWEEN 2005 AND 2026 AND year(e) BETWEEN 2005 AND 2026 AND e - s < 1460),
first AS (SELECT ord, min(page) AS first FROM ok GROUP BY ord),
tx AS (SELECT o_orderkey AS ord, 0 AS page, date_trunc('month', CAST(o_orderdate AS DATE) + 5110)::DATE AS s, (date_trunc('month', CAST(o_orderdate AS DATE) + 5110) + INTERVAL 2 MONTH)::DATE AS e FROM orders WHERE o_orderkey % 2 = 0
 UNION ALL SELECT o_orderkey, 1, date_trunc('month', CAST(o_orderdate AS DATE) + 5110)::DATE, (date_trunc('month', CAST(o_orderdate AS DATE) + 5110) + INTERVAL 5 MONTH)::DATE FROM orders),
early AS (SELECT tx.* FROM tx LEFT JOIN first USING (ord) WHERE first IS NULL OR page < first QUALIFY row_number() OVER (PARTITION BY ord ORDER BY page) = 1),
p AS (SELECT DISTINCT ord, s, e FROM (SELECT ord, s, e FROM ok UNION ALL SELECT ord, s, e FROM early)),
m AS (SELECT *, max(e) OVER (PARTITION BY ord ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY ord ORDER BY s, e) AS k FROM m),
g AS (SELECT ord, k, (max(e) - min(s)) // 30 AS months, count(*) AS n FROM i GROUP BY ord, k)"""


@query("grid_months", f"""WITH {_GRID} SELECT o_orderkey AS ord, CAST(coalesce(sum(n), 0) AS INTEGER) AS n_periods, CAST(coalesce(any_value(early.page), -1) AS INTEGER) AS text_page, CAST(least(coalesce(sum(months), 0), 400) AS INTEGER) AS months
FROM orders LEFT JOIN g ON g.ord = o_orderkey LEFT JOIN early ON early.ord = o_orderkey GROUP BY o_orderkey""")
def grid_months(spark, sf):
    day = lambda n: F.date_format(F.date_add(F.col("l_shipdate").cast("date"), n + 5110), "dd/MM/yyyy")
    page = (F.col("l_linenumber") % 2).cast("int").alias("page")
    li = t(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("ord"), page, F.lit(0).alias("table"), F.col("l_linenumber").cast("int").alias("row"), F.array("l_returnflag", F.lit(None).cast("string"), day(F.lit(0)), day(F.col("l_quantity").cast("int") * 40 - 80), day(F.lit(900))).alias("cells"))
    heads = li.select(F.col("l_orderkey").alias("ord"), page).distinct().select("ord", "page", F.lit(0).alias("table"), F.lit(0).alias("row"), F.when(F.col("ord") % 3 == 0, F.array(F.lit("Item"), F.lit("From"), F.lit("To"))).otherwise(F.array(F.lit("Ship"), F.lit("Sign"), F.lit("on"))).alias("cells"))
    month = lambda n: F.date_format(F.add_months(F.date_trunc("month", F.date_add(F.col("o_orderdate").cast("date"), 5110)), n), "MM/yyyy")
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.explode(F.array(F.struct(F.lit(0).alias("page"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(month(0), F.lit(" – "), month(2))).alias("text")), F.struct(F.lit(1).alias("page"), F.concat(F.lit("Joined "), month(0), F.lit(", left "), month(5)).alias("text")))).alias("p")).select("ord", "p.*")
    return grids.service_months(rows.unionByName(heads), o, "ord", F.lit("2024-01-01").cast("date")).fillna(-1, ["text_page"])
