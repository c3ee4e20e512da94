"""Tables on disk: distributed (bucketed), replicated, partitioned, loaded and rewritten."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.registry import query

BUCKETS = 8


def own(spark: SparkSession, name: str) -> str:
    """A table name of this run's own, so that runs beside each other don't meet; dropped when the application ends."""
    name = f"{name}_{uuid.uuid4().hex[:12]}"

    def drop():
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session has ended and with it the way to the catalogue
            pass

    atexit.register(drop)
    return name


def save(df: DataFrame, name: str, distributed_by: str | None = None, replicated: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Writes a table, bucketed by its distribution key or marked as replicated, and reads it."""
    spark, name = df.sparkSession, own(df.sparkSession, name)
    w = df.write.format("parquet").mode("overwrite")
    (w.bucketBy(buckets, distributed_by).sortBy(distributed_by) if distributed_by else w).saveAsTable(name)
    if replicated:
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('distribution' = 'replicated')")
    return spark.table(name)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def create_distributed(t):
    return save(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "bw_orders_distributed", "o_custkey")


@query("SELECT n_nationkey, n_name FROM nation")
def create_replicated(t):
    return save(t.nation.select("n_nationkey", "n_name"), "bw_nation_replicated", replicated=True)


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def ctas(t):
    return save(t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")), "bw_totals", "o_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_colocated(t):
    """Both sides bucketed by the join key: no exchange before the join or the grouping."""
    orders = save(t.orders.select("o_orderkey", "o_custkey"), "bw_orders_by_customer", "o_custkey")
    customers = save(t.customer.select("c_custkey"), "bw_customers", "c_custkey")
    return customers.join(orders.hint("merge"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


def numbered(df: DataFrame, by: str, into: str) -> DataFrame:
    """``df`` with gapless numbers from 1 in the order of a unique column, over all shards.

    Rows are dealt by ranges of the column and numbered within each; what each range
    begins with is a running sum over one count for each range.
    """
    laid = save(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id()), "bw_numbered")
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = laid.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    return laid.join(F.broadcast(starts), part == F.col("__part")).withColumn(into, (F.col("__start") + within + 1).cast("long")).drop("__at", "__part", "__start")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS seq FROM supplier")
def auto_increment(t):
    return numbered(t.supplier.select("s_suppkey"), "s_suppkey", "seq")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NOWHERE'")
def insert_values(t):
    rows = t.region.select("r_regionkey", "r_name")
    name = own(t.spark, "bw_region_insert")
    rows.write.format("parquet").saveAsTable(name)
    t.spark.sql(f"INSERT INTO {name} VALUES (99, 'NOWHERE')")
    return t.spark.table(name)


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_nationkey <> 3")
def update_delete(t):
    """Files don't change in place: the rows that stay are written as the next version."""
    kept = t.supplier.filter("s_nationkey <> 3")
    return save(kept.select("s_suppkey", F.when(F.col("s_acctbal") < 0, 0.0).otherwise(F.col("s_acctbal")).alias("s_acctbal")), "bw_supplier_next")


@query("SELECT CAST(0 AS BIGINT) AS n FROM (SELECT 1)")
def drop_table(t):
    name = own(t.spark, "bw_region_drop")
    t.region.write.format("parquet").saveAsTable(name)
    t.spark.sql(f"DROP TABLE {name}")
    return t.spark.sql(f"SHOW TABLES LIKE '{name}'").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def load_data(t):
    path = folder(t.spark, "bw_nation_csv")
    t.nation.select("n_nationkey", "n_name", "n_regionkey").write.mode("overwrite").csv(path, header=True)
    return t.spark.read.schema("n_nationkey int, n_name string, n_regionkey int").csv(path, header=True)


@query("SELECT o_orderkey, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) = 2000")
def partitioning(t):
    """Written by year; the filter reads one folder."""
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"))
    name = own(t.spark, "bw_orders_by_year")
    rows.repartition("y").write.partitionBy("y").format("parquet").saveAsTable(name)
    return t.spark.table(name).filter("y = 2000")


#: The dialect's encodings and what Parquet's writer is told for them.
ENCODINGS = {"dict": "true", "plain": "false"}


@query("SELECT p_partkey, p_size FROM part")
def column_encoding(t):
    """An encoding named for a column is told to Parquet's writer, and stays with the column as metadata."""
    chosen = {"p_size": "dict", "p_partkey": "plain"}
    path = folder(t.spark, "bw_part_encoded")
    w = t.part.select(*[F.col(c).alias(c, metadata={"encoding": e}) for c, e in chosen.items()]).write.mode("overwrite")
    for c, e in chosen.items():
        w = w.option(f"parquet.enable.dictionary#{c}", ENCODINGS[e])
    w.parquet(path)
    return t.spark.read.parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}_{uuid.uuid4().hex[:12]}"


def _lines(t, name: str, rows: DataFrame) -> str:
    path = folder(t.spark, name)
    rows.write.text(path)
    return path


@query("""SELECT item_id, text AS question, CASE WHEN item_id % 4 = 0 THEN 'top-n' ELSE '' END AS pattern, CASE WHEN item_id % 4 = 1 THEN 'hard' ELSE 'medium' END AS difficulty FROM benchmark WHERE item_id % 7 <> 3""")
def load_examples(t):
    """JSON lines with blank and broken ones between them, which are skipped; what a line leaves out has a default."""
    k = F.col("item_id") % 7
    said = F.struct("item_id", F.col("text").alias("question"), F.when(F.col("item_id") % 4 == 0, "top-n").alias("pattern"), F.when(F.col("item_id") % 4 == 1, "hard").alias("difficulty"))
    line = F.when(k == 3, F.concat(F.lit('{"item_id": '), F.substring("text", 1, 9))).otherwise(F.concat(F.to_json(said), F.when(k == 2, F.lit("\n\n")).otherwise(F.lit(""))))
    return examples(t.spark, _lines(t, "bw_examples", t.benchmark.select(line.alias("value"))))


def examples(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("item_id long, question string, pattern string, difficulty string").json(path, mode="DROPMALFORMED").filter("question is not null")
    return rows.select("item_id", "question", F.coalesce("pattern", F.lit("")).alias("pattern"), F.coalesce("difficulty", F.lit("medium")).alias("difficulty"))


@query("SELECT item_id, text AS question, 'k' || CAST(item_id % 5 AS VARCHAR) || ',all' AS keywords FROM benchmark")
def load_faq(t):
    """Files of one JSON array each, whose lines end anywhere."""
    entry = F.struct("item_id", F.col("text").alias("question"), F.array(F.concat(F.lit("k"), (F.col("item_id") % 5).cast("string")), F.lit("all")).alias("keywords"))
    # a thousand entries to a file
    arrays = t.benchmark.groupBy(F.floor(F.col("item_id") / 1000).alias("file")).agg(F.concat(F.lit("[\n"), F.array_join(F.transform(F.collect_list(entry), lambda e: F.to_json(e)), ",\n"), F.lit("\n]")).alias("value"))
    path = folder(t.spark, "bw_faq")
    arrays.write.partitionBy("file").text(path)
    rows = t.spark.read.schema("item_id long, question string, keywords array<string>").option("recursiveFileLookup", True).json(path, multiLine=True)
    return rows.select("item_id", "question", F.array_join("keywords", ",").alias("keywords"))


@query("""SELECT section, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'syntax' WHEN 2 THEN 'functions.supported' ELSE 'functions.unsupported' END AS section, n_name AS name
    FROM nation WHERE n_nationkey % 6 <> 5 UNION ALL SELECT 'syntax', r_name FROM region) GROUP BY 1""")
def load_rules(t):
    """Rule files of several sections each, merged by section; a file that can't be read is skipped."""
    k, rule = F.col("n_nationkey"), F.to_json(F.array(F.struct(F.col("n_name").alias("name"))))
    body = F.when(k % 4 == 0, F.concat(F.lit('"unsupported": '), rule)).when(k % 4 == 1, F.concat(F.lit('"syntax": '), rule)).when(k % 4 == 2, F.concat(F.lit('"functions": {"supported": '), rule, F.lit("}"))).otherwise(F.concat(F.lit('"functions": {"unsupported": '), rule, F.lit("}")))
    good = F.concat(F.lit("{"), body, F.when(k % 6 == 5, F.lit(", ")).otherwise(F.lit("}")))  # one in six is broken off
    files = t.nation.select(k.alias("file"), good.alias("value")).unionByName(t.region.select((F.col("r_regionkey") + 100).alias("file"), F.concat(F.lit('{"syntax": '), F.to_json(F.array(F.struct(F.col("r_name").alias("name")))), F.lit("}")).alias("value")))
    path = folder(t.spark, "bw_rules")
    files.write.partitionBy("file").text(path)
    return rules(t.spark, path).groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def rules(spark: SparkSession, path: str) -> DataFrame:
    """(section, name) of all rules in a folder of files."""
    items = "array<struct<name:string>>"
    files = spark.read.schema(f"unsupported {items}, syntax {items}, functions struct<supported:{items}, unsupported:{items}>").option("recursiveFileLookup", True).json(path, multiLine=True, mode="DROPMALFORMED")
    sections = {"unsupported": "unsupported", "syntax": "syntax", "functions.supported": "functions.supported", "functions.unsupported": "functions.unsupported"}
    every = F.array(*[F.struct(F.lit(k).alias("section"), F.col(c).alias("rules")) for k, c in sections.items()])
    return files.select(F.explode(every).alias("s")).select("s.section", F.explode("s.rules").alias("rule")).select("section", "rule.name")
