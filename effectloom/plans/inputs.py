"""Supplied tables re-read as customers, policies, claims and sessions.

Each derived table is stated twice: as DataFrame columns and as the SQL the
oracle runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASOF = "1999-06-30"         # inside the order dates
EVENTS_ASOF = "2024-01-31"  # after the last event
PRODUCTS = ["medical", "critical_illness", "accident", "life", "annuity"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_day(col: str):
    return F.date_format(F.to_date(col), "yyyy-MM-dd")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    k, bal = F.col("c_custkey"), F.greatest(F.col("c_acctbal"), F.lit(0.0))
    return table(spark, sf, "customer").select(
        k.alias("user_id"), (k * 7 % 60 + 18).cast("int").alias("age"), (bal * 50).alias("income"),
        (k % 3).cast("int").alias("children"), (k % 18).cast("int").alias("youngest_age"),
        (F.col("c_nationkey") % 3 + 1).cast("int").alias("city_tier"), (k % 6 + 1).cast("int").alias("occupation_class"),
        (k % 5).cast("int").alias("complaints"), (bal * 20).alias("expense"), (k % 4 * 250000).cast("double").alias("mortgage"),
        (k % 7 * 10000).cast("double").alias("other_debt"), (k % 3 * 400000).cast("double").alias("education"),
        (k % 2 * 200000).cast("double").alias("elder_cost"), (bal * 10).alias("savings"),
        F.col("c_mktsegment").alias("segment"), (k * 13 % 101).cast("double").alias("engagement"))


CUSTOMERS = """customers AS (SELECT c_custkey AS user_id, CAST(c_custkey*7%60+18 AS INTEGER) AS age,
 greatest(c_acctbal,0.0)*50 AS income, CAST(c_custkey%3 AS INTEGER) AS children, CAST(c_custkey%18 AS INTEGER) AS youngest_age,
 CAST(c_nationkey%3+1 AS INTEGER) AS city_tier, CAST(c_custkey%6+1 AS INTEGER) AS occupation_class,
 CAST(c_custkey%5 AS INTEGER) AS complaints, greatest(c_acctbal,0.0)*20 AS expense, CAST(c_custkey%4*250000 AS DOUBLE) AS mortgage,
 CAST(c_custkey%7*10000 AS DOUBLE) AS other_debt, CAST(c_custkey%3*400000 AS DOUBLE) AS education,
 CAST(c_custkey%2*200000 AS DOUBLE) AS elder_cost, greatest(c_acctbal,0.0)*10 AS savings, c_mktsegment AS segment,
 CAST(c_custkey*13%101 AS DOUBLE) AS engagement FROM customer)"""


def policies(spark: SparkSession, sf: str) -> DataFrame:
    k, prio = F.col("o_orderkey"), F.col("o_orderpriority")
    product = (F.when(prio == "1-URGENT", "medical").when(prio == "2-HIGH", "accident")
               .when(prio == "3-MEDIUM", "critical_illness").when(prio == "4-NOT SPECIFIED", "life").otherwise("annuity"))
    return table(spark, sf, "orders").select(
        k.alias("policy_id"), F.col("o_custkey").alias("user_id"), product.alias("product"),
        F.when(k % 3 == 0, "self").when(k % 3 == 1, "spouse").otherwise("child_1").alias("person"),
        F.to_date("o_orderdate").alias("effective_date"), F.date_add(F.to_date("o_orderdate"), 365).alias("expiry_date"),
        F.col("o_totalprice").alias("sum_insured"), (F.col("o_totalprice") * 0.02).alias("premium"),
        F.when(F.col("o_orderstatus") == "F", "in_force").when(F.col("o_orderstatus") == "O", "lapsed")
        .otherwise("surrendered").alias("status"),
        F.when(k % 4 == 0, "annual").when(k % 4 == 1, "half").when(k % 4 == 2, "quarter").otherwise("month").alias("pay_freq"),
        F.when(k % 10 == 0, 1).otherwise(0).alias("has_claim"))


POLICIES = """policies AS (SELECT o_orderkey AS policy_id, o_custkey AS user_id,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'medical' WHEN '2-HIGH' THEN 'accident' WHEN '3-MEDIUM' THEN 'critical_illness'
  WHEN '4-NOT SPECIFIED' THEN 'life' ELSE 'annuity' END AS product,
 CASE o_orderkey%3 WHEN 0 THEN 'self' WHEN 1 THEN 'spouse' ELSE 'child_1' END AS person,
 CAST(o_orderdate AS DATE) AS effective_date, CAST(o_orderdate AS DATE)+365 AS expiry_date,
 o_totalprice AS sum_insured, o_totalprice*0.02 AS premium,
 CASE o_orderstatus WHEN 'F' THEN 'in_force' WHEN 'O' THEN 'lapsed' ELSE 'surrendered' END AS status,
 CASE o_orderkey%4 WHEN 0 THEN 'annual' WHEN 1 THEN 'half' WHEN 2 THEN 'quarter' ELSE 'month' END AS pay_freq,
 CASE WHEN o_orderkey%10=0 THEN 1 ELSE 0 END AS has_claim FROM orders)"""


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with in-force cover by product (aggregated before the join)."""
    day = F.lit(ASOF).cast("date")
    live = policies(spark, sf).filter((F.col("effective_date") <= day) & (F.col("expiry_date") >= day))
    cover = live.groupBy("user_id").agg(*[
        F.sum(F.when(F.col("product") == p, F.col("sum_insured")).otherwise(0.0)).alias(f"sum_{p}") for p in PRODUCTS], *[
        F.count_if(F.col("product") == p).alias(f"n_{p}") for p in PRODUCTS])
    out = customers(spark, sf).join(cover, "user_id", "left").na.fill(0, [f"{a}_{p}" for a in ("sum", "n") for p in PRODUCTS])
    return out.withColumns({"have_medical": F.col("sum_medical"), "have_ci": F.col("sum_critical_illness"),
                            "have_accident": F.col("sum_accident"), "have_life": F.col("sum_life"),
                            "have_property": F.col("sum_annuity"), "cap": F.lit(300000.0)})


COVERAGE = (CUSTOMERS + ", " + POLICIES + f""", cover AS (SELECT user_id, """
            + ", ".join(f"sum(CASE WHEN product='{p}' THEN sum_insured ELSE 0 END) AS sum_{p}, count(*) FILTER (product='{p}') AS n_{p}"
                        for p in PRODUCTS)
            + f""" FROM policies WHERE effective_date <= DATE '{ASOF}' AND expiry_date >= DATE '{ASOF}' GROUP BY 1),
coverage AS (SELECT c.*, """ + ", ".join(f"coalesce(sum_{p},0.0) AS sum_{p}, coalesce(n_{p},0) AS n_{p}" for p in PRODUCTS)
            + """, coalesce(sum_medical,0.0) AS have_medical, coalesce(sum_critical_illness,0.0) AS have_ci,
 coalesce(sum_accident,0.0) AS have_accident, coalesce(sum_life,0.0) AS have_life, coalesce(sum_annuity,0.0) AS have_property,
 300000.0 AS cap FROM customers c LEFT JOIN cover USING (user_id))""")


def r(col, n: int = 4):
    return F.round(col if not isinstance(col, str) else F.col(col), n)
