"""Window functions. Orders end in a unique key, so that results don't depend on ties."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import dialect as D
from ..plans.registry import query
from .aggregates import money

_OVER = "OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)"


def by_nation():
    return Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")


@query(f"SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() {_OVER} AS rn FROM customer) WHERE rn <= 3")
def win_row_number(t):
    return t.customer.withColumn("rn", F.row_number().over(by_nation())).filter("rn <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rk FROM part")
def win_rank(t):
    return t.part.select("p_partkey", F.rank().over(Window.partitionBy("p_brand").orderBy("p_size")).cast("long").alias("rk"))


@query("SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rk FROM part")
def win_dense_rank(t):
    return t.part.select("p_partkey", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")).cast("long").alias("rk"))


@query("SELECT o_custkey, round(s, 2) AS total FROM (SELECT o_custkey, s, ntile(10) OVER (ORDER BY s DESC, o_custkey) AS tile FROM (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1)) WHERE tile = 1")
def win_ntile(t):
    """The top decile. A global order cut by rank: the cut's place is counted first, so no task gets all rows."""
    spent = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    n = spent.count()
    return spent.orderBy(F.desc("s"), "o_custkey").limit(-(-n // 10)).select("o_custkey", money("s").alias("total"))


@query(f"SELECT c_custkey, lag(c_acctbal) {_OVER} AS prev FROM customer")
def win_lag(t):
    return t.customer.select("c_custkey", F.lag("c_acctbal").over(by_nation()).alias("prev"))


@query(f"SELECT c_custkey, lead(c_acctbal) {_OVER} AS next FROM customer")
def win_lead(t):
    return t.customer.select("c_custkey", F.lead("c_acctbal").over(by_nation()).alias("next"))


@query(f"SELECT c_custkey, first_value(c_custkey) {_OVER} AS best, last_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS worst FROM customer")
def win_first_last(t):
    whole = by_nation().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.customer.select("c_custkey", F.first_value("c_custkey").over(by_nation()).alias("best"), F.last_value("c_custkey").over(whole).alias("worst"))


@query("SELECT brand, round(total, 2) AS total FROM (SELECT p_brand AS brand, p_type, sum(p_retailprice) AS total, avg(sum(p_retailprice)) OVER (PARTITION BY p_brand) AS mean FROM part GROUP BY 1, 2) WHERE total > mean + 0.001")
def win_agg(t):
    sums = t.part.groupBy(F.col("p_brand").alias("brand"), "p_type").agg(F.sum("p_retailprice").alias("total"))
    return sums.withColumn("mean", F.avg("total").over(Window.partitionBy("brand"))).filter("total > mean + 0.001").select("brand", money("total").alias("total"))


@query("SELECT s_suppkey, round(sum(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM supplier")
def win_cumulative(t):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.supplier.select("s_suppkey", money(F.sum("s_acctbal").over(w)).alias("running"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
def win_range_frame(t):
    return t.spark.sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM {events}", events=t.events.select("event_id", "user_id", "ts"))


def streaks(t, least: int):
    """Runs of days in a row: a day less its rank in the run is the same throughout."""
    days = t.events.select("user_id", F.to_date("ts").alias("d")).distinct()
    island = F.date_sub("d", F.row_number().over(Window.partitionBy("user_id").orderBy("d")))
    return days.withColumn("g", island).groupBy("user_id", "g").agg(F.min("d").alias("first_day"), F.count(F.lit(1)).alias("days")).filter(F.col("days") >= least).drop("g")


def _streaks(least):
    return f"""SELECT user_id, min(d) AS first_day, count(*) AS days FROM (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS g
        FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events)) GROUP BY user_id, g HAVING count(*) >= {least}"""


@query(_streaks(2))
def win_streak(t):
    return streaks(t, 2)


@query(_streaks(7))
def win_streak_7(t):
    return streaks(t, 7)


@query(_streaks(3))
def win_streak_3(t):
    return streaks(t, 3)


@query("SELECT c_mktsegment, c_nationkey, round(sum(c_acctbal) / sum(sum(c_acctbal)) OVER (PARTITION BY c_mktsegment), 6) AS share, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sum(c_acctbal) DESC, c_nationkey) AS rn FROM customer GROUP BY 1, 2")
def agg_of_agg_window(t):
    sums = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.sum("c_acctbal").alias("s"))
    seg = Window.partitionBy("c_mktsegment")
    return sums.select("c_mktsegment", "c_nationkey", F.round(F.col("s") / F.sum("s").over(seg), 6).alias("share"), F.row_number().over(seg.orderBy(F.desc("s"), "c_nationkey")).cast("long").alias("rn"))


@query("""SELECT month, brand, round(total, 2) AS total, round(prev, 2) AS prev FROM (SELECT strftime(l_shipdate, '%Y-%m') AS month, p_brand AS brand, sum(l_extendedprice) AS total,
    lag(sum(l_extendedprice)) OVER (PARTITION BY p_brand ORDER BY strftime(l_shipdate, '%Y-%m')) AS prev FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE (total - prev) / prev > 0.5""")
def qualify(t):
    month = D.date_format(F.col("l_shipdate"), "%Y-%m").alias("month")
    sums = t.lineitem.join(t.part.select("p_partkey", F.col("p_brand").alias("brand")), F.col("l_partkey") == F.col("p_partkey")).groupBy(month, "brand").agg(F.sum("l_extendedprice").alias("total"))
    grown = sums.withColumn("prev", F.lag("total").over(Window.partitionBy("brand").orderBy("month")))
    return grown.filter("(total - prev) / prev > 0.5").select("month", "brand", money("total").alias("total"), money("prev").alias("prev"))
