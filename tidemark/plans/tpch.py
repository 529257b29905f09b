"""The 22 decision-support queries on the given tables.

The tables have no partsupp and no commit and receipt dates: the parts a supplier sells are
those of its lineitems (its cost: the least extended price by quantity, down to the cent), a line is late
where it ships more than 1,000 days after its order. Every query is one text for both
engines; sums go through decimals and every LIMIT has a full tie-breaker.
"""

from __future__ import annotations

from tidemark.plans.sqltext import davg, dsum, isum, year

REVENUE = "l_extendedprice * (1 - l_discount)"
PARTSUPP = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(FLOOR(MIN(l_extendedprice / l_quantity) * 100) AS DOUBLE) / CAST(100 AS DOUBLE) AS ps_supplycost, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey)"
LATE = "l_shipdate > o_orderdate + INTERVAL '1000' DAY"

QUERIES: dict[str, str] = {
    "tpch_q01": f"""
        SELECT l_returnflag, l_linestatus, {dsum('l_quantity')} AS sum_qty, {dsum('l_extendedprice')} AS sum_base_price, {dsum(REVENUE)} AS sum_disc_price,
               {dsum(REVENUE + ' * (1 + l_tax)', 6)} AS sum_charge, {davg('l_quantity')} AS avg_qty, {davg('l_extendedprice')} AS avg_price, {davg('l_discount')} AS avg_disc, COUNT(*) AS count_order
        FROM lineitem WHERE l_shipdate <= DATE '2001-09-01' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tpch_q02": f"""
        SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, ROUND(ps_supplycost, 6) AS supplycost
        FROM part, supplier, {PARTSUPP} ps, nation, region
        WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size BETWEEN 10 AND 20 AND p_type LIKE '%M' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
          AND ps_supplycost = (SELECT MIN(ps2.ps_supplycost) FROM {PARTSUPP} ps2, supplier s2, nation n2, region r2
                               WHERE p_partkey = ps2.ps_partkey AND s2.s_suppkey = ps2.ps_suppkey AND s2.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND r2.r_name = 'EUROPE')
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q03": f"""
        SELECT l_orderkey, {dsum(REVENUE)} AS revenue, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS o_orderdate
        FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q04": f"""
        SELECT o_orderpriority, COUNT(*) AS order_count FROM orders
        WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-07-01' + INTERVAL '3' MONTH
          AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND {LATE})
        GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q05": f"""
        SELECT n_name, {dsum(REVENUE)} AS revenue FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
          AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-01-01' + INTERVAL '1' YEAR
        GROUP BY n_name ORDER BY revenue DESC""",
    "tpch_q06": f"""
        SELECT {dsum('l_extendedprice * l_discount')} AS revenue FROM lineitem
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '1' YEAR AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q07": f"""
        SELECT supp_nation, cust_nation, l_year, {dsum('volume')} AS revenue
        FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, {year('l_shipdate')} AS l_year, {REVENUE} AS volume
              FROM supplier, lineitem, orders, customer, nation n1, nation n2
              WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
                AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6')) AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1998-12-31') shipping
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "tpch_q08": f"""
        SELECT o_year, ROUND({dsum("CASE WHEN nation = 'NATION_6' THEN volume ELSE 0.0 END")} / {dsum('volume')}, 6) AS mkt_share
        FROM (SELECT {year('o_orderdate')} AS o_year, {REVENUE} AS volume, n2.n_name AS nation
              FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
              WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey
                AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND p_type = 'ECONOMY') all_nations
        GROUP BY o_year ORDER BY o_year""",
    "tpch_q09": f"""
        SELECT nation, o_year, ROUND({dsum('amount', 6)}, 2) AS sum_profit
        FROM (SELECT n_name AS nation, {year('o_orderdate')} AS o_year, {REVENUE} - ps_supplycost * l_quantity AS amount
              FROM part, supplier, lineitem, {PARTSUPP} ps, orders, nation
              WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%ring%') profit
        GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "tpch_q10": f"""
        SELECT c_custkey, c_name, {dsum(REVENUE)} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1997-10-01' + INTERVAL '3' MONTH AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""
        SELECT ps_partkey, {dsum('ps_supplycost * ps_availqty')} AS value_held FROM {PARTSUPP} ps, supplier, nation
        WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7'
        GROUP BY ps_partkey
        HAVING {dsum('ps_supplycost * ps_availqty')} > (SELECT {dsum('ps_supplycost * ps_availqty')} * 0.0001 FROM {PARTSUPP} ps, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7')
        ORDER BY value_held DESC, ps_partkey""",
    "tpch_q12": f"""
        SELECT l_linestatus, {isum("CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END")} AS high_line_count,
               {isum("CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END")} AS low_line_count
        FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND {LATE} AND l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-01-01' + INTERVAL '1' YEAR
        GROUP BY l_linestatus ORDER BY l_linestatus""",
    "tpch_q13": """
        SELECT c_count, COUNT(*) AS custdist
        FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%SPECIFIED%' GROUP BY c_custkey) c_orders
        GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "tpch_q14": f"""
        SELECT ROUND(100.00 * {dsum(f"CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0.0 END")} / {dsum(REVENUE)}, 6) AS promo_revenue
        FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-09-01' + INTERVAL '1' MONTH""",
    "tpch_q15": f"""
        WITH revenue AS (SELECT l_suppkey AS supplier_no, {dsum(REVENUE)} AS total_revenue FROM lineitem
                         WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-01-01' + INTERVAL '3' MONTH GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT MAX(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "tpch_q16": f"""
        SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM {PARTSUPP} ps, part
        WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
        GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "tpch_q17": f"""
        SELECT ROUND({dsum('l_extendedprice')} / 7.0, 6) AS avg_yearly FROM lineitem, part
        WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND p_type = 'SMALL' AND l_quantity < (SELECT 0.5 * AVG(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": f"""
        SELECT c_name, c_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS o_orderdate, o_totalprice, {dsum('l_quantity')} AS sum_qty FROM customer, orders, lineitem
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": f"""
        SELECT {dsum(REVENUE)} AS revenue FROM lineitem, part
        WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 15)
           OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 30)
           OR (p_partkey = l_partkey AND p_brand = 'Brand#4' AND l_quantity >= 20 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 45)""",
    "tpch_q20": f"""
        SELECT s_name, s_acctbal FROM supplier, nation
        WHERE s_suppkey IN (SELECT ps_suppkey FROM {PARTSUPP} ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%')
                              AND ps_availqty > (SELECT 0.5 * SUM(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01'))
          AND s_nationkey = n_nationkey AND n_regionkey = 3 ORDER BY s_name""",
    "tpch_q21": f"""
        SELECT s_name, COUNT(*) AS numwait FROM supplier, (SELECT l_orderkey, l_suppkey FROM lineitem, orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F' AND {LATE}) l1, nation
        WHERE s_suppkey = l1.l_suppkey AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT * FROM lineitem l3, orders o3 WHERE l3.l_orderkey = l1.l_orderkey AND o3.o_orderkey = l3.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o3.o_orderdate + INTERVAL '1000' DAY)
          AND s_nationkey = n_nationkey AND n_regionkey = 2
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": f"""
        SELECT cntrycode, COUNT(*) AS numcust, {dsum('c_acctbal')} AS totacctbal
        FROM (SELECT SUBSTRING(c_name FROM 17 FOR 2) AS cntrycode, c_acctbal FROM customer
              WHERE SUBSTRING(c_name FROM 17 FOR 2) IN ('13', '31', '23', '29', '30', '18', '17')
                AND c_acctbal > (SELECT {davg('c_acctbal')} FROM customer WHERE c_acctbal > 0.00)
                AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')) custsale
        GROUP BY cntrycode ORDER BY cntrycode""",
}
