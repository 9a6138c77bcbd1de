"""The ``contracts`` stand-in input: one contract text per order.

The driver's tables hold no contract wording, so contract texts are rendered
from orders, customers and nations by one SQL statement that Spark and DuckDB
both accept unchanged. This only produces rows of the schema the engine reads,
``(doc_id STRING, text STRING)``; every later step (extraction, normalisation,
cross-reference, scoring) works on the text alone and never on the columns the
text was rendered from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import deal_rows, read_table, spread

# The SELECT list reads rows o, c and n. Spark hands them joined, c and n as structs beside the
# columns of o; the DuckDB oracle fills {orders} {customer} {nation} with view names.
CONTRACT_COLUMNS = """
SELECT 'C' || lpad(CAST(o.o_orderkey AS STRING), 8, '0') || '.txt' AS doc_id,
  'MASTER SUPPLY AGREEMENT. This Agreement is '
  || CASE WHEN o.o_orderkey % 31 = 0 THEN 'offered by ' ELSE 'made by and between ' END
  || c.c_name || ' Holdings and '
  || CASE WHEN o.o_orderkey % 5 = 0 THEN 'vendor  group ' ELSE 'Vendor Group ' END
  || CAST(o.o_custkey % 7 AS STRING) || ', as follows. '
  || CASE WHEN o.o_orderkey % 11 = 0 THEN ''
          WHEN o.o_orderkey % 4 = 0 THEN 'Effective Date: ' || CAST(month(o.o_orderdate) AS STRING) || '/' || CAST(day(o.o_orderdate) AS STRING) || '/' || CAST(year(o.o_orderdate) AS STRING) || '. '
          WHEN o.o_orderkey % 4 = 1 THEN 'Commencement Date: ' || CAST(month(o.o_orderdate) AS STRING) || '/' || CAST(day(o.o_orderdate) AS STRING) || '/' || substr(CAST(year(o.o_orderdate) AS STRING), 3, 2) || '. '
          WHEN o.o_orderkey % 4 = 2 THEN 'Effective Date: ' || substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(o.o_orderdate) * 3 - 2 AS INT), 3) || ' ' || CAST(day(o.o_orderdate) AS STRING) || ', ' || CAST(year(o.o_orderdate) AS STRING) || '. '
          ELSE 'Effective Date: Sept ' || CAST(day(o.o_orderdate) AS STRING) || ', ' || CAST(year(o.o_orderdate) AS STRING) || '. ' END
  || CASE WHEN o.o_orderkey % 7 = 0 THEN '' ELSE 'Payment Terms: Buyer shall pay '
       || CASE WHEN o.o_orderkey % 19 = 0 THEN 'USD 1,' || lpad(CAST(CAST(floor(o.o_totalprice / 1000) AS INT) AS STRING), 3, '0') || ',000.00'
               WHEN o.o_orderkey % 23 = 0 THEN '$' || CAST(CAST(floor(o.o_totalprice) AS INT) AS STRING)
               ELSE 'US$ ' || CAST(CAST(floor(o.o_totalprice / 1000) AS INT) AS STRING) || ',000.00' END
       || ' per invoice, net ' || CASE WHEN o.o_orderkey % 13 = 0 THEN '150' WHEN o.o_orderkey % 6 = 0 THEN '60' WHEN o.o_orderkey % 6 = 1 THEN '45' ELSE '30' END || ' days'
       || CASE WHEN o.o_orderkey % 3 = 0 THEN ', using commercially reasonable efforts. ' ELSE '. ' END END
  || CASE WHEN o.o_orderkey % 9 = 0 THEN '' ELSE 'This Agreement is governed by the laws of the State of '
       || CASE WHEN o.o_orderkey % 29 = 0 THEN 'California' WHEN o.o_custkey % 4 = 0 THEN 'Delaware' WHEN o.o_custkey % 4 = 1 THEN 'New York' WHEN o.o_custkey % 4 = 2 THEN 'Texas' ELSE n.n_name END
       || CASE WHEN o.o_orderkey % 17 = 0 THEN ' (without regard to conflicts). ' ELSE ', as amended. ' END END
  || CASE WHEN o.o_orderkey % 10 = 3 THEN '' ELSE 'Termination. Either party may terminate this Agreement upon ' || CAST(10 * (1 + o.o_orderkey % 9) AS STRING) || ' days written notice'
       || CASE WHEN o.o_orderkey % 5 = 2 THEN ' following a material breach of this Agreement. ' ELSE ' to the other party. ' END END
  || 'IN WITNESS WHEREOF the undersigned have executed this Agreement.' AS text
"""
CONTRACT_ROWS = """FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""


CONTRACTS_SQL = CONTRACT_COLUMNS + CONTRACT_ROWS

#: Contracts of one task of the stages that follow: a few seconds of patterns and some 30 MB.
CONTRACTS_PER_TASK = 25_000


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)`` for every order of the given scale factor.

    The narrow rows are joined first and then dealt to as many tasks as there are rows for;
    texts are rendered after that, in the task that reads them. A join leaves tasks of the
    size of its narrow rows, each of which would render and read a multiple of that."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    rows = spark.sql(
        "SELECT o.*, struct(c.c_name) AS c, struct(n.n_name) AS n " + CONTRACT_ROWS,
        orders=spread(orders, "o_orderkey"),
        customer=read_table(spark, sf_dir, "customer"),
        nation=read_table(spark, sf_dir, "nation"),
    )
    dealt = deal_rows(rows, orders.count(), CONTRACTS_PER_TASK, F.xxhash64(*rows.columns))
    return spark.sql(CONTRACT_COLUMNS + "FROM {rows} o", rows=dealt)


def contracts_sql_duckdb() -> str:
    """The same statement over DuckDB views (for use as a CTE)."""
    return CONTRACTS_SQL.format(orders="orders", customer="customer", nation="nation")
