"""Decision-support queries on the star schema, with the columns that it has."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


@R.add(
    "tpch_q1",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
           round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
    """,
)
def q1(t):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(price), 2).alias("sum_disc_price"),
            F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
    )


REVENUE = "l_extendedprice * (1 - l_discount)"

R.sql("tpch_q3", f"""
SELECT l_orderkey, round(sum({REVENUE}), 2) AS revenue, o_orderdate FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
R.sql("tpch_q5", f"""
SELECT n_name, round(sum({REVENUE}), 2) AS revenue FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey
JOIN {{supplier}} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name""")
R.sql("tpch_q6", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem}
WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""")
R.sql("tpch_q7", f"""
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 0) AS revenue FROM (
    SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, {REVENUE} AS volume
    FROM {{supplier}} JOIN {{lineitem}} ON s_suppkey = l_suppkey JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{customer}} ON c_custkey = o_custkey
    JOIN {{nation}} a ON s_nationkey = a.n_nationkey JOIN {{nation}} b ON c_nationkey = b.n_nationkey
    WHERE ((a.n_name = 'NATION_6' AND b.n_name = 'NATION_7') OR (a.n_name = 'NATION_7' AND b.n_name = 'NATION_6'))
      AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31') GROUP BY supp_nation, cust_nation, l_year""")
R.sql("tpch_q8", f"""
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_1' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
    SELECT CAST(year(o_orderdate) AS INT) AS o_year, {REVENUE} AS volume, b.n_name AS nation FROM {{part}} JOIN {{lineitem}} ON p_partkey = l_partkey JOIN {{orders}} ON o_orderkey = l_orderkey
    JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} a ON c_nationkey = a.n_nationkey JOIN {{region}} ON a.n_regionkey = r_regionkey
    JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{nation}} b ON s_nationkey = b.n_nationkey
    WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31') GROUP BY o_year""")
R.sql("tpch_q10", f"""
SELECT c_custkey, c_name, round(sum({REVENUE}), 2) AS revenue, c_acctbal, n_name FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey
JOIN {{nation}} ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
R.sql("tpch_q13", """
SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey) GROUP BY c_count""")
R.sql("tpch_q14", f"""
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 4) AS promo_revenue FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
WHERE l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01'""")
R.sql("tpch_q15", f"""
WITH r AS (SELECT l_suppkey, round(sum({REVENUE}), 2) AS total FROM {{lineitem}}
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total FROM {{supplier}} JOIN r ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM r)""")
R.sql("tpch_q17", """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
JOIN (SELECT l_partkey AS k, 0.2 * avg(l_quantity) AS q FROM {lineitem} GROUP BY l_partkey) ON l_partkey = k WHERE p_brand = 'Brand#3' AND l_quantity < q""")
# the quantities of an order are summed once, for the limit and for the result
R.sql("tpch_q18", """
SELECT c_name, o_orderkey, round(o_totalprice, 2) AS o_totalprice, sum_qty FROM (SELECT l_orderkey, sum(l_quantity) AS sum_qty FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey""")
R.sql("tpch_q19", f"""
SELECT round(sum({REVENUE}), 2) AS revenue FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
   OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)""")
R.sql("tpch_q22", """
SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM {customer}
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey) GROUP BY c_nationkey""")
