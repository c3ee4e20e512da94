"""Joins, subqueries, recursion and distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import dialect as D
from ..plans.registry import query
from .aggregates import LINES_AS_OF, ORDERS_AS_OF, money, stamp

SHARDS = 8
#: The dialect's bound for replicated tables.
REPLICATED_BYTES = 100 << 20


def replicated(df: DataFrame) -> DataFrame:
    """A broadcast side where its values are under the bound, as it is otherwise.

    Texts count by their bytes, lists by those of their texts, all else as eight.
    """
    def size(name: str, kind: str):
        if kind == "string":
            return F.coalesce(F.octet_length(name), F.lit(0)) + 8
        if kind == "array<string>":
            return F.coalesce(F.octet_length(F.array_join(name, "", "")), F.lit(0)) + 8 * (1 + F.coalesce(F.size(name), F.lit(0)))
        return F.lit(8)

    sizes = [size(f"`{c}`", k) for c, k in df.dtypes]
    total = df.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0
    return F.broadcast(df) if total <= REPLICATED_BYTES else df


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_equi(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("""SELECT a.user_id, CAST(a.ts AS DATE) AS day, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE)
    WHERE a.event_type = 'click' AND b.event_type = 'purchase' GROUP BY 1, 2""")
def join_inner_multi(t):
    """Two keys, one of them DATE(a) = DATE(b); both sides are counted before they meet."""
    def counted(kind):
        return t.events.filter(F.col("event_type") == kind).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias(kind))
    met = counted("click").join(counted("purchase"), ["user_id", "day"])
    return met.select("user_id", "day", (F.col("click") * F.col("purchase")).alias("n"))


@query(f"""SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 60 DAY GROUP BY 1) ON o_custkey = c_custkey""")
def join_left(t):
    recent = t.orders.filter(F.col("o_orderdate") >= stamp(ORDERS_AS_OF) - F.expr("INTERVAL 60 DAYS")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(recent, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join_semi(t):
    return t.part.join(t.lineitem.filter("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey")


@query(f"SELECT p_partkey, p_name, p_size FROM part WHERE p_size < 5 AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '{LINES_AS_OF}' - INTERVAL 90 DAY)")
def exists_correlated(t):
    sold = t.lineitem.filter(F.col("l_shipdate") >= stamp(LINES_AS_OF) - F.expr("INTERVAL 90 DAYS"))
    return t.part.filter("p_size < 5").join(sold, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey", "p_name", "p_size")


@query("SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def join_replicated(t):
    dims = replicated(t.nation.join(replicated(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    fact = t.orders.select("o_custkey", "o_totalprice").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return fact.join(dims, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), money(F.sum("o_totalprice")).alias("amount"))


@query("SELECT s.s_suppkey, n.n_name FROM supplier s JOIN (SELECT n_nationkey AS s_nationkey, n_name FROM nation) n USING (s_nationkey)")
def join_using(t):
    return t.supplier.join(t.nation.withColumnRenamed("n_nationkey", "s_nationkey"), on=["s_nationkey"]).select("s_suppkey", "n_name")


@query("SELECT a.r_name AS x, b.r_name AS y FROM region a, region b")
def join_cross(t):
    a, b = t.region.select(F.col("r_name").alias("x")), t.region.select(F.col("r_name").alias("y"))
    return a.crossJoin(b)  # the fixed dimension of five rows


_CHAIN = """WITH RECURSIVE c(k, lvl) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey = 101
    UNION ALL SELECT c_custkey // 2, lvl + 1 FROM c JOIN customer ON c.k = c_custkey WHERE c_custkey // 2 > 0) SELECT k, lvl FROM c"""


def climb(t):
    """(k, lvl): the agents above customer 101, each half of the one below."""
    # halving reaches 1 in 63 steps at most, within Spark's limit of 100 levels
    return t.spark.sql("""WITH RECURSIVE c(k, lvl) AS (SELECT c_custkey, 0 FROM {customer} WHERE c_custkey = 101
        UNION ALL SELECT c_custkey DIV 2, lvl + 1 FROM c JOIN {customer} ON c.k = c_custkey WHERE c_custkey DIV 2 > 0) SELECT k, lvl FROM c""", customer=t.customer.select("c_custkey"))


@query(_CHAIN)
def recursive_cte(t):
    return climb(t)


@query(_CHAIN.rsplit("SELECT", 1)[0] + "SELECT max(lvl) AS depth, count(*) AS n FROM c")
def join_recursive(t):
    return climb(t).agg(F.max("lvl").alias("depth"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT CAST(o_custkey % {SHARDS} AS BIGINT) AS shard, count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders GROUP BY 1")
def shard_counts(t):
    return t.orders.groupBy(D.shard(F.col("o_custkey"), SHARDS).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("keys"))


#: Columns of orders that might distribute it.
_KEYS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{k}' AS key, CAST({k} AS VARCHAR) AS v, count(*) AS n FROM orders GROUP BY 2" for k in _KEYS) + f"""),
    s AS (SELECT key, count(DISTINCT v) AS distinct_values, coalesce(sum(n) FILTER (WHERE v IS NULL), 0)::BIGINT AS nulls, round(max(n) / sum(n), 6) AS most FROM c GROUP BY 1)
    SELECT *, row_number() OVER (ORDER BY distinct_values < {SHARDS}, most, key) = 1 AS advised FROM s""")
def skew_advice(t):
    """Each column as a distribution key: different values, nulls, its most frequent value's share; the evenest is advised."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("v")) for k in _KEYS]))
    counts = t.orders.select(each.alias("c")).groupBy("c.key", "c.v").agg(F.count(F.lit(1)).alias("n"))
    got = counts.groupBy("key").agg(F.count("v").alias("distinct_values"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("nulls"), F.round(F.max("n") / F.sum("n"), 6).alias("most"))
    rank = F.row_number().over(Window.orderBy(F.col("distinct_values") < SHARDS, "most", "key"))  # a row for each column
    return got.withColumn("advised", rank == 1)


@query(f"SELECT o_orderkey, CAST(o_custkey % {SHARDS} AS BIGINT) AS node FROM orders")
def fn_dbnode(t):
    return t.orders.select("o_orderkey", D.shard(F.col("o_custkey"), SHARDS).alias("node"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1")
def hash_distribute(t):
    # dealt by the key once; the grouping adds no second exchange
    return t.orders.select("o_custkey", "o_totalprice").repartition("o_custkey").groupBy("o_custkey").agg(money(F.sum("o_totalprice")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def replicate(t):
    return t.supplier.join(replicated(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
