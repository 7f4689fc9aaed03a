"""The two sources of the registered queries, derived from the given tables.

Each frame is one SELECT that Spark and the checking engine both run, so the
two sides start from the same rows. Every order is a bulk row about the entity
``o_custkey``. Every customer is a curated row, two thirds of them about the
entity of that key and the others about one the orders do not know; every
supplier repeats the curated row of its key. Numbers are written in several
spellings, and nulls, blanks, placeholders and a generic title are mixed in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from masterloom.functions import fixed_values as fv
from masterloom.session import spread, written

BULK_SQL = f"""
SELECT
  o_orderkey AS row_index,
  CASE
    WHEN o_orderkey % 97 = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE ' nan ' END
    WHEN o_orderkey % 89 = 1 THEN 'pro'
    WHEN o_orderkey % 83 = 1 THEN ' - '
    WHEN o_custkey % 8 = 0 THEN
      CASE o_orderkey % 3 WHEN 0 THEN 'D' || n WHEN 1 THEN 'USD' || n || 'S1' ELSE 'us d' || n || ' s' END
    WHEN o_custkey % 8 = 1 THEN CASE o_orderkey % 2 WHEN 0 THEN 'RE' || n ELSE ' USRE' || n END
    WHEN o_custkey % 8 = 2 THEN
      CASE o_orderkey % 3 WHEN 0 THEN 'EP ' || n || ' A1' WHEN 1 THEN 'EP' || n || 'B1' ELSE 'EP' || n END
    WHEN o_custkey % 8 = 3 THEN CASE o_orderkey % 2 WHEN 0 THEN 'US2020' || n || 'A1' ELSE 'US 2020/' || n END
    WHEN o_custkey % 8 = 4 THEN
      CASE o_orderkey % 3 WHEN 0 THEN 'CN' || n || '.3' WHEN 1 THEN 'CN' || n || '.3B' ELSE 'CN ' || n || '.3 C' END
    WHEN o_custkey % 8 = 5 THEN CASE o_orderkey % 2 WHEN 0 THEN 'DE' || n || 'C1' ELSE 'DE-' || n END
    WHEN o_custkey % 8 = 6 THEN 'X/' || n || '.Q'
    ELSE
      CASE o_orderkey % 5
        WHEN 0 THEN 'US ' || n || ' B2' WHEN 1 THEN 'US-' || n || '-A' WHEN 2 THEN n
        WHEN 3 THEN 'US' || n || 'P2' ELSE n || 'B2' END
  END AS number,
  CASE
    WHEN o_orderkey % 6 = 0 THEN NULL
    WHEN o_custkey % 10 = 3 THEN 'Flush Valve'
    ELSE p_name || ' - ' || p_type || ', ' || p_brand
  END AS title,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'About ' || CAST(o_orderkey AS STRING) || ': ' || o_orderpriority END AS abstract,
  'Body ' || CAST(o_orderkey AS STRING) AS main_text,
  CASE o_orderkey % 3 WHEN 0 THEN 'None' WHEN 1 THEN '  ' ELSE 'Claim 1 of ' || CAST(o_orderkey AS STRING) END AS claims,
  CASE
    WHEN o_orderkey % 7 = 0 THEN NULL
    WHEN o_orderkey % 31 = 0 THEN 'soon'
    ELSE CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)
  END AS filing_date,
  CASE
    WHEN o_orderkey % 3 = 0 THEN NULL
    ELSE CAST(year(o_orderdate) + 2 AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-15'
  END AS granted_date,
  CASE
    WHEN o_orderkey % 5 < 2 THEN NULL
    WHEN o_orderkey % 41 = 2 THEN 'in dispute'
    WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderpriority = '2-HIGH' THEN ' Withdrawn' ELSE 'Pending' END
    WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'Active - Reinstated' ELSE 'Active' END
    WHEN o_orderpriority = '1-URGENT' THEN 'Expired - Lifetime'
    WHEN o_orderpriority = '2-HIGH' THEN 'Expired - Fee Related'
    WHEN o_orderpriority = '3-MEDIUM' THEN 'Abandoned'
    WHEN o_orderpriority = '5-LOW' THEN 'Not-in-force'
    ELSE 'EXPIRED '
  END AS status,
  CASE
    WHEN o_orderkey % 9 = 0 THEN NULL
    WHEN o_custkey % 11 = 0 THEN 'Arichell Technologies, Inc.'
    WHEN o_custkey % 11 = 1 THEN 'RECURRENT  SOLUTIONS LP'
    WHEN o_custkey % 11 = 2 THEN 'Stone And Steel Systems LLC'
    WHEN o_custkey % 11 = 3 THEN '{fv.HOUSE_OWNER} LLC'
    WHEN o_custkey % 11 = 4 THEN ' {fv.HOUSE_OWNER.upper()} '
    WHEN o_custkey % 11 = 5 THEN '{fv.OWNER_RULES[4][1]}'
    WHEN o_custkey % 11 = 6 THEN 'Bauer Industries, Inc.'
    WHEN o_custkey % 11 = 7 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Haldex Midland Brake' ELSE 'The {fv.OWNER_RULES[5][1]} Ltd' END
    ELSE 'Holder ' || CAST(o_custkey % 23 AS STRING)
  END AS current_assignee,
  CASE
    WHEN o_orderkey % 13 = 0 THEN NULL
    ELSE 'Ann ' || CAST(o_custkey % 7 AS STRING) || ', Bob ' || CAST(o_orderkey % 5 AS STRING)
      || CASE WHEN o_orderkey % 4 = 0 THEN ',, Cy 1 , Ann ' || CAST(o_custkey % 7 AS STRING) ELSE '' END
  END AS inventors,
  'fig/' || CAST(o_orderkey AS STRING) AS figure_urls
FROM (SELECT *, CAST(1000000 + o_custkey * 37 AS STRING) AS n FROM orders) AS o
LEFT JOIN part ON p_partkey = o_custkey
"""

CURATED_SQL = """
SELECT
  row_index,
  CASE
    WHEN k % 101 = 1 THEN NULL
    WHEN k % 10 = 7 THEN 'granted'
    ELSE CASE k % 9
      WHEN 0 THEN 'Granted' WHEN 1 THEN 'Pending' WHEN 2 THEN 'Published ' WHEN 3 THEN 'Filed'
      WHEN 4 THEN 'Allowed' WHEN 5 THEN 'Unfiled' WHEN 6 THEN NULL WHEN 7 THEN 'Active' ELSE 'lapsed?' END
  END AS ip_status,
  CASE
    WHEN k % 101 = 1 THEN NULL
    WHEN k % 37 = 0 THEN NULL
    WHEN k % 8 = 2 THEN 'EP' WHEN k % 8 = 4 THEN 'CN' WHEN k % 8 = 5 THEN 'DE' ELSE 'US'
  END AS country,
  CASE
    WHEN k % 101 = 1 THEN ' '
    WHEN k % 5 = 3 THEN 'FLUSH  valve.'
    WHEN k % 47 = 0 THEN NULL
    ELSE upper(p_name) || ': ' || p_type || ' ' || p_brand
  END AS title,
  CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(1960 + k % 60 AS STRING) || '-0' || CAST(1 + k % 9 AS STRING) || '-11' END AS filing_date,
  CASE
    WHEN k % 101 = 1 THEN NULL
    WHEN k % 17 = 0 THEN CASE k % 4 WHEN 0 THEN 'PRO' WHEN 1 THEN 'ord' WHEN 2 THEN 'CON' ELSE 'D' END
    WHEN k % 29 = 0 THEN NULL
    WHEN k % 8 = 0 THEN 'D' || n
    WHEN k % 8 = 1 THEN 'RE' || n
    WHEN k % 8 = 3 THEN 'US2020' || n || 'A1'
    WHEN k % 8 = 4 THEN 'ZL' || n || '.3'
    WHEN k % 8 = 5 THEN CASE WHEN k % 16 = 5 THEN 'US' || n ELSE n END
    WHEN k % 8 = 6 THEN 'X' || n || '.Q'
    ELSE n
  END AS number,
  CASE WHEN k % 6 < 2 THEN NULL ELSE CAST(3 + k % 9 AS STRING) || '/' || CAST(1 + k % 28 AS STRING) || '/' || CAST(1970 + k % 50 AS STRING) END AS issue_date,
  CASE WHEN k % 5 < 2 THEN NULL ELSE CAST(2024 + k % 6 AS STRING) || '-' || lpad(CAST(1 + k % 12 AS STRING), 2, '0') || '-20' END AS expiration_date,
  CASE WHEN k % 7 = 0 THEN 'No product' WHEN k % 7 = 1 THEN NULL ELSE p_brand END AS model,
  CASE
    WHEN k % 12 = 0 THEN NULL
    WHEN k % 12 = 5 THEN c_mktsegment || ' / IOT'
    ELSE c_mktsegment
  END AS product_line,
  CASE WHEN k % 3 = 1 THEN 'https://example.org/doc/' || n ELSE NULL END AS link
FROM (
  SELECT c_custkey AS k, c_custkey AS row_index, c_mktsegment,
    CAST(CASE WHEN c_custkey % 3 = 0 THEN 5000000 ELSE 1000000 END + c_custkey * 37 AS STRING) AS n
  FROM customer
  UNION ALL
  SELECT s_suppkey AS k, s_suppkey + 100000000 AS row_index, 'SUPPLY' AS c_mktsegment,
    CAST(CASE WHEN s_suppkey % 3 = 0 THEN 5000000 ELSE 1000000 END + s_suppkey * 37 AS STRING) AS n
  FROM supplier
) AS c
LEFT JOIN part ON p_partkey = k
"""


_landed: dict[tuple[str, str, str], DataFrame] = {}


def _landing(spark: SparkSession, sf_dir: str, name: str, sql: str, *tables: str) -> DataFrame:
    """Rows of a SELECT over the named tables, written once per application as
    the landing table that all queries read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _landed:
        for table in tables:
            scan = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            # The first table is the source; the others are looked up.
            (spread(scan) if table == tables[0] else scan).createOrReplaceTempView(table)
        _landed[key] = written(spark.sql(sql), name)
    return _landed[key]


def bulk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landing(spark, sf_dir, "bulk_rows", BULK_SQL, "orders", "part")


def curated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landing(spark, sf_dir, "curated_rows", CURATED_SQL, "customer", "supplier", "part")
