"""Scan, projection, filter, grouping, sorting and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dialect as D
from ..plans.registry import query

ORDERS_AS_OF, LINES_AS_OF, EVENTS_AS_OF = "2001-08-01", "2001-11-04", "2024-01-30"


def money(x):
    return F.round(x, 2)


def stamp(day: str):
    return F.lit(day).cast("timestamp_ntz")


@query("SELECT r_regionkey, r_name FROM region")
def scan_table(t):
    return t.region.select("r_regionkey", "r_name")


@query("SELECT c_custkey, c_name AS name, c_acctbal * 2 AS twice FROM customer")
def project(t):
    return t.customer.select("c_custkey", F.col("c_name").alias("name"), (F.col("c_acctbal") * 2).alias("twice"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand = 'Brand#12'")
def filter_cmp(t):
    return t.part.filter("p_size >= 10 AND p_size < 20 AND p_brand = 'Brand#12'").select("p_partkey", "p_size")


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY")
def filter_date_window(t):
    return t.orders.filter(F.col("o_orderdate") >= stamp(ORDERS_AS_OF) - F.expr("INTERVAL 30 DAYS")).select("o_orderkey", "o_totalprice")


@query(f"SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') = strftime(DATE '{ORDERS_AS_OF}', '%Y-%m')")
def filter_same_month(t):
    first = F.trunc(F.lit(ORDERS_AS_OF).cast("date"), "MM")  # a range, so that it reaches the scan
    return t.orders.filter((F.col("o_orderdate") >= first.cast("timestamp_ntz")) & (F.col("o_orderdate") < F.add_months(first, 1).cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer")
def case_when(t):
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high").alias("band"))


_BAND = "CASE WHEN l_extendedprice < 10000 THEN 'low' WHEN l_extendedprice < 40000 THEN 'mid' ELSE 'high' END"


@query(f"SELECT {_BAND} AS price_range, count(*) AS n, round(avg(l_quantity), 4) AS avg_qty FROM lineitem GROUP BY 1")
def group_by_alias(t):
    band = F.when(F.col("l_extendedprice") < 10000, "low").when(F.col("l_extendedprice") < 40000, "mid").otherwise("high")
    return t.lineitem.groupBy(band.alias("price_range")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"))


@query("SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1) WHERE n > 10")
def derived_table(t):
    return t.customer.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n")).filter("n > 10")


@query("WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1), b AS (SELECT c_mktsegment, s FROM a JOIN customer ON o_custkey = c_custkey) SELECT c_mktsegment, round(sum(s), 2) AS total FROM b GROUP BY 1")
def cte(t):
    a = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    b = a.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return b.groupBy("c_mktsegment").agg(money(F.sum("s")).alias("total"))


@query("SELECT count(*) AS n FROM lineitem")
def agg_count_star(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


def _agg(fn):
    return f"SELECT l_returnflag, l_linestatus, round({fn}(l_quantity), 2) AS v FROM lineitem GROUP BY 1, 2"


@query(_agg("sum"))
def agg_sum(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(money(F.sum("l_quantity")).alias("v"))


@query(_agg("avg"))
def agg_avg(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(money(F.avg("l_quantity")).alias("v"))


@query(_agg("min"))
def agg_min(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(money(F.min("l_quantity")).alias("v"))


@query(_agg("max"))
def agg_max(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(money(F.max("l_quantity")).alias("v"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(DISTINCT o_custkey) AS users FROM orders GROUP BY 1")
def agg_count_distinct(t):
    return t.orders.groupBy(D.date_format(F.col("o_orderdate"), "%Y-%m").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("users"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1")
def agg_group_expr(t):
    return t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY GROUP BY 1")
def agg_daily_30d(t):
    rows = t.orders.filter(F.col("o_orderdate") >= stamp(ORDERS_AS_OF) - F.expr("INTERVAL 30 DAYS"))
    return rows.groupBy(D.date_format(F.col("o_orderdate"), "%Y-%m-%d").alias("day")).agg(F.count(F.lit(1)).alias("n"), money(F.sum("o_totalprice")).alias("amount"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def agg_having(t):
    return t.events.groupBy("user_id", D.date_format(F.col("ts"), "%Y-%m-%d %H:%i").alias("minute")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT r_regionkey AS region, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_group_concat(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_regionkey").alias("region")).agg(D.group_concat(F.col("n_name")).alias("names"))


@query("SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def agg_distinct_via_group(t):
    return t.orders.select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING sum(o_totalprice) > (SELECT 2 * avg(o_totalprice) FROM orders)")
def scalar_subquery(t):
    mean = t.orders.agg((F.avg("o_totalprice") * 2).alias("twice"))  # one row
    return t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).join(F.broadcast(mean), F.col("s") > F.col("twice")).select("o_custkey", money("s").alias("total"))


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def sort_multi(t):
    return t.customer.select("c_mktsegment", "c_custkey", "c_acctbal").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def limit_offset(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(10)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5")
def limit_comma(t):
    offset, count = 5, 10  # LIMIT 5, 10
    return t.customer.select("c_custkey", "c_name").orderBy("c_custkey").offset(offset).limit(count)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 10")
def keyset_page(t):
    return t.orders.filter("o_orderkey > 100").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def topk_global(t):
    return t.part.select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(15)


@query("SELECT c_custkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def union_all(t):
    return t.customer.select(F.col("c_custkey").alias("k"), F.lit("customer").alias("kind")).unionAll(t.supplier.select("s_suppkey", F.lit("supplier")))
