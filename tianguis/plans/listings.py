"""The trade tables seen as listing captures, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item: who offers which part where, at what unit price, captured when.

    Parts, suppliers and nations join by key; which side is sent around is left to the
    planner's size statistics.
    """
    item, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    joined = item.join(part, item.l_partkey == part.p_partkey).join(supplier, item.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.lower("l_returnflag").alias("source_id"), F.when(F.col("l_linestatus") == "O", "CUP").otherwise("USD").alias("currency"),
        F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" ml")).alias("title"), F.col("p_brand").alias("brand"),
        F.col("s_name").alias("seller"), F.col("n_name").alias("province"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_shipdate").alias("captured_at"),
    )


#: The same in SQL, to stand before a query's own parts.
LISTINGS_SQL = """
WITH listings AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, lower(l_returnflag) AS source_id,
    CASE WHEN l_linestatus = 'O' THEN 'CUP' ELSE 'USD' END AS currency,
    p_name || ' ' || CAST(p_size AS VARCHAR) || ' ml' AS title, p_brand AS brand, s_name AS seller, n_name AS province,
    l_extendedprice / l_quantity AS price, l_shipdate AS captured_at, p_size, p_name
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""


def closure_sql(rows: str, scope: list[str]) -> str:
    """CTEs that end in ``uniq``: of rows (scope, uid, seen_at) with keys (key, kind) in ``keyed``, each one's component and whether it stays."""
    s, on = ", ".join(scope), " AND ".join(f"x.{c} = y.{c}" for c in scope)
    xs = ", ".join(f"x.{c}" for c in scope)
    return f"""
firsts AS (SELECT {s}, kind, uid, min(uid) OVER (PARTITION BY {s}, kind, key) AS first FROM keyed),
lnk AS (SELECT DISTINCT {s}, uid AS a, first AS b, kind FROM firsts WHERE uid > first),
ways AS (SELECT {s}, a, b FROM lnk UNION SELECT {s}, b, a FROM lnk),
reach AS (SELECT {s}, a AS uid, a AS r FROM ways UNION SELECT {xs}, x.uid, y.b FROM reach x JOIN ways y ON {on} AND x.r = y.a),
comp AS (SELECT {s}, uid, min(r) AS part FROM reach GROUP BY ALL),
uniq AS (SELECT x.*, coalesce(y.part, x.uid) AS part, first_value(x.uid) OVER (PARTITION BY {xs}, coalesce(y.part, x.uid) ORDER BY seen_at DESC, x.uid) AS kept
  FROM {rows} x LEFT JOIN comp y ON {on} AND x.uid = y.uid)"""
