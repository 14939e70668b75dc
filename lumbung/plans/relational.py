"""Relational shapes at volume on the star-schema tables: grouped sums, multi-way joins, anti joins, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumbung.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


@query("SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, count(*) AS lines FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read_table(spark, sf_dir, n)
    # sums per order before the join with customers, so that lines aren't shuffled twice
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"), F.count("*").alias("n"))
    c = t("customer").select("c_custkey", "c_nationkey").join(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = t("orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.round(F.sum("rev"), 2).alias("revenue"), F.sum("n").alias("lines"))


@query("SELECT c.c_custkey, c.c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left_anti")


@query("SELECT n, count(*) AS customers FROM (SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 100000 GROUP BY 1) GROUP BY 1")
def order_count_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").filter("o_totalprice > 100000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read_table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").groupBy(F.coalesce("n", F.lit(0)).alias("n")).agg(F.count("*").alias("customers"))


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS total, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS n FROM orders QUALIFY n <= 2")
def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read_table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).filter("n <= 2").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("total"), "n")


@query("SELECT p.p_brand, count(DISTINCT l.l_suppkey) AS suppliers, round(sum(l.l_quantity), 2) AS qty FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size BETWEEN 5 AND 25 GROUP BY 1")
def brand_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part").filter("p_size between 5 and 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    # per brand and supplier first: the distinct count then needs no expanded rows
    per = li.join(p, "l_partkey").groupBy("p_brand", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return per.groupBy("p_brand").agg(F.count("*").alias("suppliers"), F.round(F.sum("q"), 2).alias("qty"))


@query("SELECT CAST(date_trunc('month', CAST(o_orderdate AS TIMESTAMP)) AS DATE) AS month, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def orders_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month"), "o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
