"""Joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrisk.catalog.base import query, table
from tallyrisk.operators import joins as J
from tallyrisk.operators.aggregate import aggregate_by


@query(
    "join_left_child_aggs",
    """WITH o AS (SELECT o_custkey, count(*) AS N_ORDERS, avg(o_totalprice) AS PRICE_MEAN FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1),
    l AS (SELECT o_custkey, count(*) AS N_LINES, sum(l_quantity) AS QUANTITY FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT c_custkey, c_mktsegment, N_ORDERS, PRICE_MEAN, N_LINES, QUANTITY FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN l ON c_custkey = l.o_custkey""",
    "PRICE_MEAN QUANTITY",
)
def join_left_child_aggs(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    urgent = orders.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    per_order = urgent.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("N_ORDERS"), F.avg("o_totalprice").alias("PRICE_MEAN"))
    # Lines fold to one row per order before they meet the orders: the join moves less.
    folded = lines.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    per_line = (
        folded.join(orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("c_custkey")
        .agg(F.sum("n").alias("N_LINES"), F.sum("q").alias("QUANTITY"))
    )
    client = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return J.spread_joins(client, [per_order, per_line], ["c_custkey"])


_CHAIN = "SELECT n_nationkey, n_name, r_name, s_suppkey, s_acctbal FROM nation {how} JOIN region ON n_regionkey = r_regionkey {how} JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON n_nationkey = s_nationkey"


def _chain(spark, sf, how):
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    supplier = table(spark, sf, "supplier").where("s_acctbal > 5000").withColumnRenamed("s_nationkey", "n_nationkey")
    return J.join_chain([nation, region, supplier], ["n_regionkey", "n_nationkey"], how).select("n_nationkey", "n_name", "r_name", "s_suppkey", "s_acctbal")


@query("join_chain_inner", _CHAIN.format(how="INNER"), "s_acctbal")
def join_chain_inner(spark, sf):
    return _chain(spark, sf, "inner")


@query(
    "join_chain_outer",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1),
    b AS (SELECT o_custkey AS k, count(*) AS n_low FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'O' GROUP BY 1),
    c AS (SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_acctbal < 0)
    SELECT coalesce(a.k, b.k, c.k) AS k, n_urgent, n_low, c_acctbal FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k""",
    "c_acctbal",
)
def join_chain_outer(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    a = orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").groupBy("k").agg(F.count(F.lit(1)).alias("n_urgent"))
    b = orders.where("o_orderpriority = '5-LOW' AND o_orderstatus = 'O'").groupBy("k").agg(F.count(F.lit(1)).alias("n_low"))
    c = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), "c_acctbal")
    return J.join_chain([a, b, c], "k", "outer")


@query("join_semi", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)", "o_totalprice")
def join_semi(spark, sf):
    big = table(spark, sf, "lineitem").where("l_quantity > 45").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.members_of(table(spark, sf, "orders"), big, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "join_distinct_pairs",
    """WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), s AS (SELECT l_partkey, avg(l_extendedprice) AS PART_L_EXTENDEDPRICE_MEAN, count(*) AS PART_L_EXTENDEDPRICE_SIZE FROM lineitem WHERE l_tax > 0.02 GROUP BY 1)
    SELECT p.l_suppkey, p.l_partkey, PART_L_EXTENDEDPRICE_MEAN, PART_L_EXTENDEDPRICE_SIZE FROM p LEFT JOIN s USING (l_partkey)""",
    "PART_L_EXTENDEDPRICE_MEAN",
)
def join_distinct_pairs(spark, sf):
    lines = table(spark, sf, "lineitem")
    per_part = aggregate_by(lines.where("l_tax > 0.02"), "l_partkey", {"l_extendedprice": ["mean", "size"]}, "PART_")
    return J.pairs_with(lines, ["l_suppkey", "l_partkey"], per_part, "l_partkey")


@query(
    "union_by_name",
    """SELECT c_custkey AS k, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS supplier FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""",
    "balance",
)
def union_by_name(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_name").alias("supplier"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    return J.union_tables([customers, suppliers])
