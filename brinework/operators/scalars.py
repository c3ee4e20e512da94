"""Scalar functions of the dialect, each over a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dialect as D
from ..plans.registry import query
from .aggregates import ORDERS_AS_OF, stamp


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS d FROM orders")
def fn_date_format(t):
    return t.orders.select("o_orderkey", D.date_format(F.col("o_orderdate"), "%Y-%m-%d %H:%i").alias("d"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 7 DAY AS a, o_orderdate - INTERVAL 2 MONTH AS b FROM orders")
def fn_date_add_sub(t):
    return t.orders.select("o_orderkey", D.date_shift(F.col("o_orderdate"), 7, "DAY").alias("a"), D.date_shift(F.col("o_orderdate"), -2, "MONTH").alias("b"))


@query(f"SELECT o_custkey, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS active, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '{ORDERS_AS_OF}') AS since FROM orders GROUP BY 1")
def fn_datediff(t):
    return t.orders.groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("active"), F.datediff(F.lit(ORDERS_AS_OF).cast("date"), F.max("o_orderdate")).cast("long").alias("since"))


@query(f"SELECT TIMESTAMP '{ORDERS_AS_OF}' AS now, DATE '{ORDERS_AS_OF}' AS today, '00:00:00' AS clock FROM region")
def fn_now(t):
    """NOW, CURDATE and CURTIME; the query gives a time, so that a rerun is the same."""
    return clock(t.region, stamp(ORDERS_AS_OF))


def clock(rows, now=None):
    """The session's time beside each row, or the one given."""
    now = F.localtimestamp() if now is None else now
    return rows.select(now.alias("now"), F.to_date(now).alias("today"), D.date_format(now, "%T").alias("clock"))


@query("SELECT event_id, CAST(ts AS DATE) AS d FROM events")
def fn_date(t):
    return t.events.select("event_id", F.to_date("ts").alias("d"))


@query("SELECT hour(ts) AS h, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def fn_hour(t):
    return t.events.groupBy(F.hour("ts").cast("long").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT o_orderkey, ifnull(nullif(o_orderstatus, 'O'), 'open') AS a, coalesce(nullif(o_orderstatus, 'P'), nullif(o_orderpriority, '1-URGENT'), 'none') AS b FROM orders")
def fn_ifnull_coalesce(t):
    status = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.ifnull(F.nullif(status, F.lit("O")), F.lit("open")).alias("a"), F.coalesce(F.nullif(status, F.lit("P")), F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")), F.lit("none")).alias("b"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS sign FROM customer")
def fn_if(t):
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, "plus").otherwise("minus").alias("sign"))


@query("SELECT c_custkey, c_name || '/' || nullif(c_mktsegment, 'BUILDING') AS x FROM customer")
def fn_concat(t):
    return t.customer.select("c_custkey", F.concat("c_name", F.lit("/"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))).alias("x"))


@query("SELECT c_custkey, concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING'), 'z') AS x FROM customer")
def fn_concat_ws(t):
    return t.customer.select("c_custkey", F.concat_ws("-", "c_name", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("z")).alias("x"))


@query("SELECT p_partkey, substring(p_name, 2, 4) AS a, right(p_name, 3) AS b, '' AS c FROM part")
def fn_substring(t):
    name = F.col("p_name")
    return t.part.select("p_partkey", D.substring(name, 2, 4).alias("a"), D.substring(name, -3).alias("b"), D.substring(name, 0, 2).alias("c"))


@query("SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes, CAST(length(text) AS INTEGER) AS chars FROM documents")
def fn_length(t):
    return t.documents.select("doc_id", D.length(F.col("text")).alias("bytes"), F.char_length("text").alias("chars"))


@query("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim('  ' || p_type || ' ') AS t FROM part")
def fn_case_trim(t):
    return t.part.select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_brand").alias("l"), F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("t"))


@query("SELECT c_custkey, round(c_acctbal, 1) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c FROM customer")
def fn_round(t):
    return t.customer.select("c_custkey", F.round("c_acctbal", 1).alias("r"), F.floor("c_acctbal").alias("f"), F.ceil("c_acctbal").alias("c"))


@query("SELECT c_custkey, abs(c_acctbal) AS a, c_custkey % 7 AS m, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % (c_custkey % 3) END AS z FROM customer")
def fn_abs_mod(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", F.abs("c_acctbal").alias("a"), D.mod(k, F.lit(7)).alias("m"), D.mod(k, k % 3).alias("z"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(p_retailprice AS DECIMAL(10,2)) AS d, CAST(p_size AS DOUBLE) / nullif(p_size % 2, 0) AS q FROM part")
def fn_cast(t):
    return t.part.select("p_partkey", F.col("p_size").cast("string").alias("s"), F.col("p_retailprice").cast("decimal(10,2)").alias("d"), D.divide(F.col("p_size"), F.col("p_size") % 2).alias("q"))
