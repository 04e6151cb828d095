"""Readers, sinks and multi-table assembly over the supplied tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..sources import assemble as asm
from ..sources import readers, sinks
from ..sources.workspace import new_path
from .inputs import table
from .registry import query


@query("A1_csv_scan", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, sf):
    path = new_path(spark, "customer") + ".csv"
    table(spark, sf, "customer").write.option("sep", ";").csv(path, header=True)
    return readers.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string")


@query("A2_json_scan", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def json_scan(spark, sf):
    path = new_path(spark, "supplier") + ".json"
    table(spark, sf, "supplier").write.json(path)
    return readers.read_table(spark, path, "s_suppkey long, s_name string, s_nationkey long, s_acctbal double")


@query("A3_parquet_scan", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity),2) AS qty FROM lineitem "
       "WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def parquet_scan(spark, sf):
    return (readers.read_table(spark, f"{sf}/lineitem.parquet").filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
            .groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")))


@query("A4_format_dispatch", "SELECT f AS format, (SELECT count(*) FROM supplier) AS n FROM (VALUES ('csv'),('json'),('parquet')) t(f)")
def format_dispatch(spark, sf):
    src = table(spark, sf, "supplier")
    parts = []
    for ext in ("csv", "json", "parquet"):
        path = new_path(spark, "supplier") + f".{ext}"
        writer = src.write.option("header", True) if ext == "csv" else src.write
        writer.format(ext).save(path)
        schema = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double" if ext != "parquet" else None
        df = readers.read_table(spark, path, schema)
        parts.append(df.agg(F.count("s_suppkey").alias("n")).select(F.lit(ext).alias("format"), "n"))
    return reduce(lambda a, b: a.union(b), parts)


@query("A5_path_expansion", "SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'conversations', count(*) FROM conversations "
       "UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'orders_1', count(*) FROM orders")
def path_expansion(spark, sf):
    tables = readers.load_tables(spark, [f"{sf}/c*.parquet", f"{sf}/orders.parquet", f"{sf}/order?.parquet"])
    return reduce(lambda a, b: a.union(b), [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
                                            for n, df in tables.items()])


def _id_tables(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("CustomerID"), "c_name", F.col("c_acctbal").alias("amount"),
                                               "c_mktsegment", "c_nationkey")
    spend = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("CustomerID")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("amount"), F.count("*").alias("n_orders"), F.max("o_orderkey").alias("last_order"))
    return {"customer": cust, "spend": spend}


@query("A6_merge_strategy", "SELECT 'parts' AS case_name, 'concat' AS strategy, '' AS keys, (SELECT count(*) FROM orders) AS n "
       "UNION ALL SELECT 'keyed','merge','CustomerID',(SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)) "
       "UNION ALL SELECT 'apart','separate','',(SELECT count(*) FROM nation)+(SELECT count(*) FROM part)")
def merge_strategy(spark, sf):
    o = table(spark, sf, "orders")
    cases = {"parts": {s: o.filter(F.col("o_orderstatus") == s) for s in ("F", "O", "P")},
             "keyed": _id_tables(spark, sf),
             "apart": {"nation": table(spark, sf, "nation"), "part": table(spark, sf, "part")}}
    rows = []
    for name, tables in cases.items():
        how, keys = asm.merge_strategy(tables)
        got = asm.assemble(tables)
        frames = list(got.values()) if isinstance(got, dict) else [got]
        n = reduce(lambda a, b: a.union(b), [f.agg(F.count("*").alias("n")) for f in frames]).agg(F.sum("n").alias("n"))
        rows.append(n.select(F.lit(name).alias("case_name"), F.lit(how).alias("strategy"), F.lit(",".join(keys)).alias("keys"), "n"))
    return reduce(lambda a, b: a.union(b), rows)


@query("A7_concat_align", "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS sname FROM customer "
       "UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier")
def concat_align(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("sname"))
    return asm.concat_tables([c, s])


_MERGED = """WITH s AS (SELECT o_custkey AS CustomerID, round(sum(o_totalprice),2) AS amount_1, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT coalesce(c.c_custkey, s.CustomerID) AS CustomerID, c.c_name, c.c_acctbal AS amount, s.amount_1,
 CAST(s.n_orders AS DOUBLE) AS n_orders FROM customer c FULL OUTER JOIN s ON c.c_custkey = s.CustomerID"""


@query("A8_outer_merge", _MERGED)
def outer_merge(spark, sf):
    t = _id_tables(spark, sf)
    return asm.merge_tables(list(t.values()), ["CustomerID"]).select(
        "CustomerID", "c_name", "amount", "amount_1", F.col("n_orders").cast("double").alias("n_orders"))


@query("A9_separate_clean", "SELECT 'customer' AS table_name, count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) "
       "UNION ALL SELECT 'orders', count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)")
def separate_clean(spark, sf):
    tables = {"customer": table(spark, sf, "customer").select("c_nationkey", "c_mktsegment"),
              "orders": table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")}
    done = asm.each_table(tables, lambda d: d.dropDuplicates())
    return reduce(lambda a, b: a.union(b), [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, d in done.items()])


@query("A10_csv_sink", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders GROUP BY 1")
def csv_sink(spark, sf):
    path = sinks.write_csv(table(spark, sf, "orders"), new_path(spark, "orders") + ".csv")
    back = spark.read.csv(path, header=True, schema="o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                                                    "o_orderdate string, o_orderpriority string")
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("A11_json_documents", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, count(*) AS n FROM events GROUP BY 1,2")
def json_documents(spark, sf):
    docs = (table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
            .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")))
    path = sinks.write_documents(docs, new_path(spark, "daily"), ["day"])
    back = spark.read.schema("user_id long, n long, value double, day string").json(path)
    return back.select("day", "user_id", "n")


CATALOGUED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query("A12_catalogue", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, count(*) AS n_columns, string_agg(name, ', ' ORDER BY cid) AS fields FROM pragma_table_info('{t}')" for t in CATALOGUED))
def catalogue(spark, sf):
    files = {n: f"{sf}/{n}.parquet" for n in CATALOGUED}
    return sinks.catalogue(spark, files).select("table_name", "n_rows", "n_columns", "fields")


@query("A13_read_through_cache", "SELECT c_mktsegment AS segment, round(avg(c_acctbal),4) AS mean_balance, count(*) AS n FROM customer GROUP BY 1")
def read_through_cache(spark, sf):
    path = new_path(spark, "segment-params")

    def build():
        return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
            F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), F.count("*").alias("n"))
    sinks.read_through(spark, path, build, "2024-01-31")
    return sinks.read_through(spark, path, lambda: build().limit(0), "2024-03-31")  # fresh: the builder is not used
