"""A query for each relational operator and expression, with its SQL."""

from __future__ import annotations

import atexit
import contextlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expressions as E
from tidemark.operators import relational as R
from tidemark.plans.sqltext import davg, dsum, isum
from tidemark.sources.catalog import Catalog, Partition, Table, existing
from tidemark.sources.modes import Mode, Scans
from tidemark.sources.prune import Column as ZoneColumn
from tidemark.sources.prune import pruned
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
col, lit = E.col, E.num_lit


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sum(c, scale: int = 4):
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double")


def _avg(c, scale: int = 4):
    return F.round(_sum(c, scale) / F.count(c), 6)


# ---- scans

@query("SELECT r_regionkey, r_name FROM region")
def scan_parquet(s, d):
    return table(s, d, "region")


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def scan_project(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_quantity")


@query("SELECT n_name, n_nationkey FROM nation")
def scan_project_exist(s, d):
    df = table(s, d, "nation")
    return df.select(existing(df, ["N_NAME", "not_there", "n_nationkey"]))


def _shared(s: SparkSession, tag: str) -> str:
    """A new folder that all executors see: in spark.checkpoint.dir, or where neither that nor a
    checkpoint folder is set a temporary one, in local mode only. Removed when the process
    ends, since lazy results may read it until then."""
    sc = s.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        return f"file://{own}/{tag}"
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, sc, path)
    return path


def _remove(sc, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _declared(root: str) -> Catalog:
    fields = [("n_nationkey", "int64"), ("n_name", "utf8"), ("n_regionkey", "int32")]
    return Catalog.from_json(root, json.dumps({"tables": [{"name": "Nation", "format": "csv", "delimiter": "|", "primaryKeyNames": ["N_NATIONKEY"], "fields": [{"name": n, "type": t} for n, t in fields]}]}))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey FROM nation")
def scan_csv_roundtrip(s, d):
    root = _shared(s, "csv")
    table(s, d, "nation").write.options(sep="|", header=True).csv(f"{root}/nation.csv")
    return _declared(root)["NATION"].read(s)


@query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def scan_catalog_sql(s, d):
    root = _shared(s, "csv")
    table(s, d, "nation").write.options(sep="|", header=True, compression="gzip").csv(f"{root}/nation.csv")
    _declared(root).register(s)
    out = s.sql("SELECT N_Name AS n_name FROM Nation WHERE n_regionkey = 2")
    s.catalog.dropTempView("nation")
    return out


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def scan_filterable(s, d):
    return Scans(Mode.PUSHDOWN_ONLY).scan("customer", table(s, d, "customer"), ["c_custkey", "c_name"], col("c_acctbal") > 5000, ("c_acctbal",))


# ---- projection, filters

@query("SELECT o_orderkey AS k, o_totalprice AS price, o_totalprice + 1 AS plus, o_totalprice - 1 AS minus, o_totalprice * 2 AS times, o_totalprice / 4 AS by4 FROM orders")
def project_rename_expr(s, d):
    p = col("o_totalprice")
    return R.project(table(s, d, "orders"), {"o_orderkey": "k", "o_totalprice": "price"}, plus=p + 1, minus=p - 1, times=p * 2, by4=E.divide(p, F.lit(4)))


def _filter(name: str, tab: str, keys: list[str], condition, where: str) -> None:
    QUERIES[name] = lambda s, d: table(s, d, tab).where(condition()).select(keys)
    SQL[name] = f"SELECT {', '.join(keys)} FROM {tab} WHERE {where}"


_filter("filter_eq", "part", ["p_partkey"], lambda: col("p_size") == 7, "p_size = 7")
_filter("filter_ne", "part", ["p_partkey"], lambda: col("p_size") != 7, "p_size <> 7")
_filter("filter_lt", "part", ["p_partkey"], lambda: col("p_size") < 7, "p_size < 7")
_filter("filter_le", "part", ["p_partkey"], lambda: col("p_size") <= 7, "p_size <= 7")
_filter("filter_gt", "part", ["p_partkey"], lambda: col("p_retailprice") > 950.0, "p_retailprice > 950.0")
_filter("filter_ge", "part", ["p_partkey"], lambda: col("p_retailprice") >= 950.0, "p_retailprice >= 950.0")
_filter("filter_and_or_not", "part", ["p_partkey"], lambda: E.or_(E.and_(col("p_size") > 10, col("p_type") == "PROMO"), ~(col("p_size") < 48)), "(p_size > 10 AND p_type = 'PROMO') OR NOT (p_size < 48)")
_filter("filter_between", "lineitem", ["l_orderkey", "l_linenumber"], lambda: col("l_discount").between(0.03, 0.05), "l_discount BETWEEN 0.03 AND 0.05")
_filter("filter_in_str", "customer", ["c_custkey"], lambda: E.in_(col("c_mktsegment"), ["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filter("filter_in_int", "part", ["p_partkey"], lambda: E.in_(col("p_size"), [1, 4, 9]), "p_size IN (1, 4, 9)")
_filter("filter_in_double", "lineitem", ["l_orderkey", "l_linenumber"], lambda: E.in_(col("l_tax"), [0.01, 0.03]), "l_tax IN (0.01, 0.03)")
_filter("filter_in_date", "orders", ["o_orderkey"], lambda: E.in_(col("o_orderdate").cast("date"), [F.to_date(F.lit("1997-01-05")), F.to_date(F.lit("1998-03-01"))]), "CAST(o_orderdate AS DATE) IN (DATE '1997-01-05', DATE '1998-03-01')")
_filter("filter_not_in", "nation", ["n_name"], lambda: ~E.in_(col("n_regionkey"), [1, 3]), "n_regionkey NOT IN (1, 3)")
_filter("filter_like", "part", ["p_partkey", "p_name"], lambda: E.like(col("p_name"), "%r_d%"), "p_name LIKE '%r_d%'")
_filter("filter_not_like", "part", ["p_partkey"], lambda: ~E.like(col("p_type"), "S%"), "p_type NOT LIKE 'S%'")


def _with_nulls(s, d):
    return table(s, d, "customer").select("c_custkey", F.nullif(col("c_mktsegment"), F.lit("BUILDING")).alias("seg"), F.when(col("c_nationkey") != 3, col("c_nationkey")).alias("nk"))


_NULLS = "(SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg, NULLIF(c_nationkey, 3) AS nk FROM customer) t"


@query(f"SELECT c_custkey FROM {_NULLS} WHERE seg IS NULL")
def filter_is_null(s, d):
    return _with_nulls(s, d).where(col("seg").isNull()).select("c_custkey")


@query(f"SELECT c_custkey FROM {_NULLS} WHERE seg IS NOT NULL")
def filter_is_not_null(s, d):
    return _with_nulls(s, d).where(col("seg").isNotNull()).select("c_custkey")


@query(f"SELECT c_custkey FROM {_NULLS} WHERE (nk > 10) IS NOT TRUE")
def filter_is_not_true(s, d):
    return _with_nulls(s, d).where(E.is_not_true(col("nk") > 10)).select("c_custkey")


@query(f"SELECT c_custkey FROM {_NULLS} WHERE (nk > 10) IS TRUE")
def filter_is_true(s, d):
    return _with_nulls(s, d).where(E.is_true(col("nk") > 10)).select("c_custkey")


# ---- expressions

@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'large' END AS band FROM part")
def expr_case(s, d):
    return R.project(table(s, d, "part"), {"p_partkey": "p_partkey"}, band=E.case([(col("p_size") < 10, E.str_lit("small")), (col("p_size") < 30, E.str_lit("mid"))], E.str_lit("large")))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN CASE WHEN p_size > 25 THEN 2 ELSE 1 END ELSE 0 END AS v FROM part")
def expr_nested_case(s, d):
    return R.project(table(s, d, "part"), {"p_partkey": "p_partkey"}, v=E.if_(col("p_type") == "PROMO", E.if_(col("p_size") > 25, lit(2, "int"), lit(1, "int")), lit(0, "int")))


@query("SELECT c_custkey, CAST(substring(c_name, 10, 9) AS INTEGER) AS i, CAST(substring(c_name, 10, 9) AS BIGINT) AS l, CAST(substring(c_name, 10, 9) AS DOUBLE) AS x, CAST(CAST(substring(c_name, 10, 9) AS DECIMAL(30,8)) AS DOUBLE) AS dec FROM customer")
def expr_cast(s, d):
    t = E.substr(col("c_name"), 10, 9)
    return R.project(table(s, d, "customer"), {"c_custkey": "c_custkey"}, i=E.cast(t, "int"), l=E.cast(t, "long"), x=E.cast(t, "double"), dec=E.cast(t, "decimal(30,8)").cast("double"))


@query("SELECT c_custkey, substring(c_name, 1, 4) AS head FROM customer")
def expr_substring(s, d):
    return R.project(table(s, d, "customer"), {"c_custkey": "c_custkey"}, head=E.substr(col("c_name"), 1, 4))


@query("SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS dd FROM orders")
def expr_extract(s, d):
    t = col("o_orderdate")
    return R.project(table(s, d, "orders"), {"o_orderkey": "o_orderkey"}, y=E.date_extract("YEAR", t), m=E.date_extract("MONTH", t), dd=E.date_extract("DAY", t))


_DATE = "CAST(o_orderdate AS DATE)"
for _name, _n, _unit in (("expr_date_add_day", 90, "DAY"), ("expr_date_add_month", 1, "MONTH"), ("expr_date_add_year", 1, "YEAR"), ("expr_date_sub", -45, "DAY")):
    QUERIES[_name] = lambda s, d, n=_n, unit=_unit: R.project(table(s, d, "orders"), {"o_orderkey": "o_orderkey"}, day=E.date_plus(col("o_orderdate").cast("date"), n, unit).cast("string"))
    SQL[_name] = f"SELECT o_orderkey, CAST(CAST({_DATE} {'+' if _n > 0 else '-'} INTERVAL '{abs(_n)}' {_unit} AS DATE) AS VARCHAR) AS day FROM orders"


@query("SELECT o_orderkey, CAST(o_orderkey // 7 AS BIGINT) AS q FROM orders")
def expr_div_int(s, d):
    return R.project(table(s, d, "orders"), {"o_orderkey": "o_orderkey"}, q=E.divide(col("o_orderkey"), lit(7), whole=True))


@query("SELECT r_regionkey, CAST(NULL AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS t, CAST(NULL AS DATE) AS d, r_regionkey + CAST(NULL AS BIGINT) AS plus FROM region")
def expr_null_literal(s, d):
    return R.project(table(s, d, "region"), {"r_regionkey": "r_regionkey"}, n=lit(None, "long"), t=E.str_lit(None), d=E.date_lit(None), plus=col("r_regionkey") + lit(None, "long"))


# ---- aggregates

@query(f"SELECT {dsum('l_extendedprice')} AS s, COUNT(l_tax) AS c, COUNT(*) AS n, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, {davg('l_quantity')} AS a FROM lineitem")
def agg_global(s, d):
    return R.group(table(s, d, "lineitem"), [], _sum(col("l_extendedprice")).alias("s"), F.count("l_tax").alias("c"), F.count("*").alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), _avg(col("l_quantity")).alias("a"))


@query("SELECT CAST(SUM(p_size) AS BIGINT) AS s, COUNT(*) AS n, MIN(p_size) AS lo FROM part WHERE p_size < 0")
def agg_global_empty(s, d):
    return R.group(table(s, d, "part").where("p_size < 0"), [], F.sum("p_size").alias("s"), F.count("*").alias("n"), F.min("p_size").alias("lo"))


@query("SELECT p_brand, COUNT(*) AS n FROM part WHERE p_size < 0 GROUP BY p_brand")
def agg_group_empty(s, d):
    return R.group(table(s, d, "part").where("p_size < 0"), ["p_brand"], F.count("*").alias("n"))


@query(f"SELECT {dsum('l_extendedprice * (1 - l_discount)')} AS revenue FROM lineitem")
def agg_expr(s, d):
    return R.group(table(s, d, "lineitem"), [], _sum(col("l_extendedprice") * (1 - col("l_discount"))).alias("revenue"))


@query("SELECT p_brand, CAST(SUM(p_size) AS BIGINT) AS s, COUNT(*) AS n FROM part GROUP BY p_brand")
def agg_group(s, d):
    return R.group(table(s, d, "part"), ["p_brand"], F.sum("p_size").alias("s"), F.count("*").alias("n"))


@query(f"SELECT l_returnflag, l_linestatus, {dsum('l_quantity')} AS q, {davg('l_discount')} AS a FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group_multi(s, d):
    return R.group(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], _sum(col("l_quantity")).alias("q"), _avg(col("l_discount")).alias("a"))


@query("SELECT o_orderstatus, MIN(o_orderpriority) AS lo, MAX(o_orderpriority) AS hi, CAST(CAST(MIN(o_orderdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(MAX(o_orderdate) AS DATE) AS VARCHAR) AS last_day FROM orders GROUP BY o_orderstatus")
def agg_min_max_string_date(s, d):
    return R.group(table(s, d, "orders"), ["o_orderstatus"], F.min("o_orderpriority").alias("lo"), F.max("o_orderpriority").alias("hi"), F.min("o_orderdate").cast("date").cast("string").alias("first_day"), F.max("o_orderdate").cast("date").cast("string").alias("last_day"))


@query("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(s, d):
    return R.group(table(s, d, "lineitem"), ["l_returnflag"], F.countDistinct("l_suppkey").alias("n"))


@query("SELECT p_brand, AVG(p_size) AS a, AVG(CASE WHEN p_size > 25 THEN p_size END) AS large FROM part GROUP BY p_brand")
def agg_avg(s, d):
    """Averages of whole numbers, which both engines divide alike; nulls don't count."""
    return R.group(table(s, d, "part"), ["p_brand"], F.avg("p_size").alias("a"), F.avg(F.when(col("p_size") > 25, col("p_size"))).alias("large"))


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
def agg_having(s, d):
    return R.group(table(s, d, "orders"), ["o_custkey"], F.count("*").alias("n")).where("n > 12")


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def agg_no_agg_distinct(s, d):
    return R.group(table(s, d, "customer"), ["c_mktsegment", "c_nationkey"])


@query(f"SELECT nk, COUNT(seg) AS c, COUNT(*) AS n FROM {_NULLS} GROUP BY nk")
def agg_null_keys(s, d):
    return R.group(_with_nulls(s, d), ["nk"], F.count("seg").alias("c"), F.count("*").alias("n"))


# ---- joins

# NULLIF makes null keys and rows without a partner

def _whole(s, d):
    return table(s, d, "orders").select("o_orderkey", F.nullif(col("o_custkey"), F.lit(7)).alias("ok")), table(s, d, "customer").select(F.nullif(col("c_custkey"), F.lit(11)).alias("ck"), "c_nationkey")


_O, _C = "(SELECT o_orderkey, NULLIF(o_custkey, 7) AS ok FROM orders) o", "(SELECT NULLIF(c_custkey, 11) AS ck, c_nationkey FROM customer) c"
_S, _N = "(SELECT s_suppkey, s_acctbal FROM supplier) s", "(SELECT n_nationkey, n_nationkey * 400.0 AS bar FROM nation) n"
for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    QUERIES[f"join_{_how}"] = lambda s, d, how=_how: R.hash_join(*_whole(s, d), [("ok", "ck")], how)
    SQL[f"join_{_how}"] = f"SELECT * FROM {_O} {_sql} {_C} ON ok = ck"
    QUERIES[f"join_theta_{_how}"] = lambda s, d, how=_how: R.nested_loop_join(
        table(s, d, "supplier").select("s_suppkey", "s_acctbal"), table(s, d, "nation").select("n_nationkey", (col("n_nationkey") * 400.0).alias("bar")),
        (col("s_acctbal") < col("bar")) & (col("s_acctbal") > col("bar") - 150), how)
    SQL[f"join_theta_{_how}"] = f"SELECT s_suppkey, s_acctbal, n_nationkey, CAST(bar AS DOUBLE) AS bar FROM {_S} {_sql} {_N} ON s_acctbal < bar AND s_acctbal > bar - 150"
for _how, _sql in (("semi", "EXISTS"), ("anti", "NOT EXISTS")):
    QUERIES[f"join_{_how}"] = lambda s, d, how=_how: R.hash_join(*_whole(s, d), [("ok", "ck")], how)
    SQL[f"join_{_how}"] = f"SELECT * FROM {_O} WHERE {_sql} (SELECT 1 FROM {_C} WHERE ck = ok)"


@query(f"SELECT a.l_partkey, a.l_suppkey, a.n, b.q FROM (SELECT l_partkey, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY ALL) a JOIN (SELECT l_partkey AS pk, l_suppkey AS sk, {dsum('l_quantity')} AS q FROM lineitem WHERE l_tax > 0.05 GROUP BY ALL) b ON a.l_partkey = b.pk AND a.l_suppkey = b.sk")
def join_inner_multikey(s, d):
    li = table(s, d, "lineitem")
    a = R.group(li, ["l_partkey", "l_suppkey"], F.count("*").alias("n"))
    b = R.group(li.where("l_tax > 0.05"), ["l_partkey", "l_suppkey"], _sum(col("l_quantity")).alias("q")).withColumnsRenamed({"l_partkey": "pk", "l_suppkey": "sk"})
    return R.hash_join(a, b, [("l_partkey", "pk"), ("l_suppkey", "sk")]).select("l_partkey", "l_suppkey", "n", "q")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(s, d):
    return R.nested_loop_join(table(s, d, "nation"), table(s, d, "region")).select("n_name", "r_name")


@query("SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_r, b.n_name AS n_name_r, b.n_regionkey AS n_regionkey_r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_rename_conflict(s, d):
    return R.hash_join(table(s, d, "nation"), table(s, d, "nation"), [("n_regionkey", "n_regionkey")])


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000")
def join_bloom(s, d):
    o = table(s, d, "orders").where((col("o_orderpriority") == "1-URGENT") & (col("o_totalprice") > 300000))
    return R.bloom_join(table(s, d, "lineitem"), o, [("l_orderkey", "o_orderkey")]).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("SELECT n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 0) r ON n_regionkey = r_regionkey")
def join_empty_side(s, d):
    return R.hash_join(table(s, d, "nation"), table(s, d, "region").where("r_regionkey < 0"), [("n_regionkey", "r_regionkey")], "left").select("n_name", "r_name")


@query("SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000 GROUP BY c_custkey")
def join_left_on_predicate(s, d):
    o = table(s, d, "orders").where("o_totalprice > 450000")
    return R.group(R.hash_join(table(s, d, "customer"), o, [("c_custkey", "o_custkey")], "left"), ["c_custkey"], F.count("o_orderkey").alias("n"))


@query(f"SELECT COUNT(*) AS n FROM {_NULLS} JOIN (SELECT NULLIF(n_nationkey, 4) AS k FROM nation) u ON t.nk = u.k")
def join_null_keys(s, d):
    u = table(s, d, "nation").select(F.when(col("n_nationkey") != 4, col("n_nationkey")).alias("k"))
    return R.group(R.hash_join(_with_nulls(s, d), u, [("nk", "k")]), [], F.count("*").alias("n"))


@query(f"SELECT r_name, {dsum('l_extendedprice')} AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_broadcast(s, d):
    """Dimensions are small; whether they are broadcast is left to their size in the scan's statistics."""
    j = R.hash_join(R.hash_join(R.hash_join(table(s, d, "lineitem"), table(s, d, "supplier"), [("l_suppkey", "s_suppkey")]), table(s, d, "nation"), [("s_nationkey", "n_nationkey")]), table(s, d, "region"), [("n_regionkey", "r_regionkey")])
    return R.group(j, ["r_name"], _sum(col("l_extendedprice")).alias("s"))


# ---- sub-queries through SQL

SUBQUERIES: dict[str, str] = {
    "subq_scalar": f"SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT {davg('o_totalprice')} * 1.9 FROM orders)",
    "subq_scalar_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "subq_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)",
    "subq_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
    "subq_not_in_null": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 5) FROM orders WHERE o_totalprice > 480000)",
    "subq_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "subq_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "cte_reuse": f"WITH t AS (SELECT o_custkey, {dsum('o_totalprice')} AS spent FROM orders GROUP BY o_custkey) SELECT a.o_custkey, a.spent FROM t a WHERE a.spent > (SELECT 0.7 * MAX(b.spent) FROM t b)",
    "derived_table": f"SELECT k, {isum('n')} AS n FROM (SELECT c_nationkey, COUNT(*) FROM customer GROUP BY c_nationkey) AS t (k, n) GROUP BY k",
    "quoted_identifiers": 'SELECT "value", "n" FROM (SELECT p_size AS "value", COUNT(*) AS "n" FROM part GROUP BY p_size) "t" WHERE "n" > 20',
}

# ---- order

@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice DESC NULLS LAST")
def sort_multi(s, d):
    return R.sort(table(s, d, "orders"), ("o_orderpriority", "ASC"), ("o_totalprice", "DESC")).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(s, d):
    return R.top_k(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 25, ("o_totalprice", "DESC"), ("o_orderkey", "ASC"))


@query(f"SELECT c_custkey, nk FROM {_NULLS} ORDER BY nk DESC NULLS LAST, c_custkey LIMIT 40")
def topk_ties_deterministic(s, d):
    return R.top_k(_with_nulls(s, d).select("c_custkey", "nk"), 40, ("nk", "DESC"), ("c_custkey", "ASC"))


# ---- exchange, plumbing

@query("SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey")
def exchange_hash(s, d):
    return R.group(R.shuffle(table(s, d, "lineitem").select("l_orderkey"), ["l_orderkey"]), ["l_orderkey"], F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def exchange_split(s, d):
    return R.split(table(s, d, "nation"), 4).select("n_nationkey", "n_name")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def merge_columns(s, d):
    c = table(s, d, "customer")
    return R.merge_columns(c.select("c_custkey", "c_name"), c.select("c_custkey", "c_acctbal"), ["c_custkey"])


@query("SELECT n_nationkey FROM nation UNION ALL SELECT c_nationkey FROM customer")
def bag_union(s, d):
    return R.bag_union(table(s, d, "nation").select("n_nationkey"), table(s, d, "customer").select(col("c_nationkey").alias("n_nationkey")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 300 AND o_orderkey < 400 AND (o_custkey < 500 OR o_orderkey > 1000000)")
def prune_zone_map(s, d):
    """Orders by ranges of their key in four files; the zone maps leave those that can hold 300 to 399."""
    root, o = _shared(s, "zones"), table(s, d, "orders")
    width = (o.agg(F.max("o_orderkey")).first()[0] + 4) // 4
    o.withColumn("z", F.least(F.floor(col("o_orderkey") / width), F.lit(3)).cast("int")).write.partitionBy("z").parquet(root)
    parts = tuple(Partition(f"{root}/z={k}", {"o_orderkey": (k * width, (k + 1) * width - 1)}) for k in range(4))
    where = ("and", (">=", ZoneColumn("o_orderkey"), 300), (">", 400, ZoneColumn("o_orderkey")), ("or", ("<", ZoneColumn("o_custkey"), 500), (">", ZoneColumn("o_orderkey"), 1_000_000)))
    t = Table("orders", "parquet", o.schema, ("o_orderkey",), parts)
    left = t.read(s, None, pruned(t, where))
    return left.where("o_orderkey >= 300 AND o_orderkey < 400 AND (o_custkey < 500 OR o_orderkey > 1000000)").select("o_orderkey", "o_totalprice")


def _mode(mode: Mode):
    def f(s, d):
        """In the hybrid mode two columns come from memory and the third from a pushed-down scan.
        The result is written, so that nothing is left in memory when it is handed on."""
        o, root = table(s, d, "orders"), _shared(s, "mode")
        with Scans(mode, {"orders": ("o_orderkey",)}) as scans:
            if mode is Mode.HYBRID:
                scans.keep("orders", o, ["o_orderstatus", "o_totalprice"])
            df = scans.scan("orders", o, ["o_orderstatus", "o_totalprice"], (col("o_orderpriority") < "3") & (col("o_totalprice") > 50_000), ("o_orderpriority",))
            out = R.group(df, ["o_orderstatus"], _sum(col("o_totalprice")).alias("q"))
            out.write.parquet(root)
        return s.read.schema(out.schema).parquet(root)

    return f


for _m, _name in ((Mode.PULL_UP, "mode_pullup"), (Mode.PUSHDOWN_ONLY, "mode_pushdown"), (Mode.CACHING_ONLY, "mode_caching"), (Mode.HYBRID, "mode_hybrid_equiv")):
    QUERIES[_name] = _mode(_m)
    SQL[_name] = f"SELECT o_orderstatus, {dsum('o_totalprice')} AS q FROM orders WHERE o_orderpriority < '3' AND o_totalprice > 50000 GROUP BY o_orderstatus"
