"""Registry of runnable queries with their SQL twins, and the proxy inputs they share.

The given tables stand in for application data (see FIXTURES.md): orders are
applications, customers applicants, market segments partners. Both sides build
the proxies with the same arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.readers import read_table

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def tbl(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(C(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def q6(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in cols})


def stamp(c: Column | str) -> Column:
    """A timestamp as text, the same on both sides."""
    return F.date_format(C(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


def q_stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def applications(spark: SparkSession, sf: str) -> DataFrame:
    o, c = tbl(spark, sf, "orders"), tbl(spark, sf, "customer")
    pr = C("o_orderpriority")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        C("o_orderkey").alias("ca_id"), C("o_custkey").alias("customer_id"), C("c_mktsegment").alias("partner"),
        "c_name", "c_nationkey", C("o_orderdate").alias("ca_created_at"),
        C("o_totalprice").alias("requested_loan_amount"), C("o_orderstatus").alias("product_type"),
        pr.alias("priority"), (pr == "1-URGENT").cast("int").alias("dep_var"),
        (pr == "2-HIGH").cast("int").alias("first_party_fraud"),
        pr.isin("1-URGENT", "2-HIGH").cast("int").alias("any_fraud"))


APPS = """apps AS (
  SELECT o_orderkey AS ca_id, o_custkey AS customer_id, c_mktsegment AS partner, c_name, c_nationkey,
         o_orderdate AS ca_created_at, o_totalprice AS requested_loan_amount, o_orderstatus AS product_type,
         o_orderpriority AS priority, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS dep_var,
         CAST(o_orderpriority = '2-HIGH' AS INTEGER) AS first_party_fraud,
         CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS any_fraud
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Applications with a score, the scaled base score (null for some) and ytrue = dep_var."""
    u = (C("ca_id") * 7919 % 10007) / F.lit(10007.0)
    df = applications(spark, sf).withColumn("score", 0.7 * u + 0.3 * C("dep_var"))
    base = C("score") * 1.22643393399164 + 0.00197736842965041
    return df.withColumns({"ytrue": C("dep_var"), "fm_5_score": F.when(C("ca_id") % 97 != 0, base)})


SCORED = APPS + """, scored AS (
  SELECT *, dep_var AS ytrue,
         CASE WHEN ca_id % 97 <> 0 THEN score * 1.22643393399164e0 + 0.00197736842965041e0 END AS fm_5_score
  FROM (SELECT *, 0.7e0 * ((ca_id * 7919 % 10007) / 10007.0e0) + 0.3e0 * dep_var AS score FROM apps))"""


def curve_sql(source: str, groups: tuple[str, ...] = (), score: str = "score", label: str = "ytrue",
              weight: str = "1", name: str = "cum") -> str:
    """CTE text: distinct-score counts with plain windows (the independent twin of curve_counts)."""
    g = "".join(f"{x}, " for x in groups)
    part = f"PARTITION BY {', '.join(groups)} " if groups else ""
    return f"""{name}_s AS (SELECT {g}{score} AS score,
    CAST(SUM(CASE WHEN {label} = 1 THEN {weight} ELSE 0 END) AS BIGINT) AS pos,
    CAST(SUM(CASE WHEN {label} = 1 THEN 0 ELSE {weight} END) AS BIGINT) AS neg
  FROM {source} WHERE {score} IS NOT NULL GROUP BY {g}{score}),
{name} AS (SELECT *, CAST(SUM(pos) OVER w AS BIGINT) AS tp, CAST(SUM(neg) OVER w AS BIGINT) AS fp,
    CAST(SUM(pos) OVER ({part}) AS BIGINT) AS p, CAST(SUM(neg) OVER ({part}) AS BIGINT) AS n
  FROM {name}_s WINDOW w AS ({part}ORDER BY score DESC))"""


AP = "SUM(pos / p * (tp / (tp + fp)))"
AUC = "SUM(neg * (tp - pos / 2)) / MAX(p * n)"
PR_AREA = ("SUM(pos / p * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg = 0 THEN 1.0e0 "
           "ELSE (tp - pos) / (tp - pos + fp - neg) END) / 2)")


def md5_bucket(expr: str, modulus: int, seed: int = 42) -> str:
    return f"(CAST('0x' || substr(md5(CAST({expr} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT) % {modulus})"
