"""Windows over conversation history, and the small records kept beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.registry import query

#: CJK characters, and runs of ASCII letters at 1.3 tokens each, plus 5.
_CJK = "[一-鿿]"
_TOKENS = f"(length(regexp_replace(text, '[^一-鿿]', '', 'g')) + CAST(floor(len(regexp_extract_all(text, '[A-Za-z]+')) * 1.3) AS BIGINT) + 5)"


def newest():
    return Window.partitionBy("conv_id").orderBy(F.desc("turn"))


def token_count(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(_CJK)) + F.floor(F.regexp_count(text, F.lit("[A-Za-z]+")) * F.lit(1.3).cast("double")) + 5).cast("long")


@query(f"SELECT conv_id, turn, CAST({_TOKENS} AS BIGINT) AS tokens FROM conversations")
def token_estimate(t):
    return t.conversations.select("conv_id", "turn", token_count(F.col("text")).alias("tokens"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 50")
def recent_messages(t):
    return t.conversations.withColumn("rn", F.row_number().over(newest())).filter("rn <= 50").select("conv_id", "turn")


def within_budget(turns: DataFrame, budget: int) -> DataFrame:
    """The newest turns whose tokens stay within the budget; the newest one always."""
    counted = turns.withColumn("tokens", token_count(F.col("text")))
    run = counted.withColumn("used", F.sum("tokens").over(newest().rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(newest()))
    return run.filter((F.col("used") <= budget) | (F.col("rn") == 1)).select("conv_id", "turn", "used")


def _budget(n):
    return f"""SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum({_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE used <= {n} OR rn = 1"""


@query(_budget(4000))
def history_budget(t):
    return within_budget(t.conversations, 4000)


@query(_budget(400))
def history_budget_400(t):
    return within_budget(t.conversations, 400)


@query("SELECT conv_id, turn, n FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations), (VALUES (12), (6)) v(n) WHERE rn <= n")
def history_last_n(t):
    ranked = t.conversations.select("conv_id", "turn", F.row_number().over(newest()).alias("rn"))
    return ranked.withColumn("n", F.explode(F.array(F.lit(12), F.lit(6)))).filter("rn <= n").select("conv_id", "turn", "n")


@query("""SELECT conv_id, CASE WHEN length(x) > 30 THEN substring(x, 1, 30) || '...' ELSE x END AS title
    FROM (SELECT conv_id, arg_min(text, turn) AS x FROM conversations WHERE role = 'user' GROUP BY 1)""")
def conv_title(t):
    first = t.conversations.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("x"))
    return first.select("conv_id", F.when(F.char_length("x") > 30, F.concat(F.substring("x", 1, 30), F.lit("..."))).otherwise(F.col("x")).alias("title"))


@query("""SELECT c.conv_id, last, n, turns FROM (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1 ORDER BY last DESC, conv_id LIMIT 50) c
    JOIN (SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1) m ON c.conv_id = m.conv_id""")
def conv_list(t):
    top = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last")).orderBy(F.desc("last"), "conv_id").limit(50)
    held = t.conversations.join(F.broadcast(top.select("conv_id")), "conv_id", "left_semi")  # 50 rows at most
    msgs = held.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda m: m["role"]), ",").alias("turns"))
    return top.join(msgs, "conv_id").select("conv_id", "last", "n", "turns")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 7")
def conv_get(t):
    return t.conversations.filter("conv_id = 7").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, CASE WHEN conv_id = 7 AND turn = 0 THEN substring('patched', 1, 200) ELSE text END AS text FROM conversations")
def conv_patch(t):
    hit = (F.col("conv_id") == 7) & (F.col("turn") == 0)
    return t.conversations.select("conv_id", "turn", F.when(hit, F.substring(F.lit("patched"), 1, 200)).otherwise(F.col("text")).alias("text"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def conv_delete(t):
    gone = t.conversations.filter("role = 'system'").select("conv_id").distinct()
    return t.conversations.join(gone, "conv_id", "left_anti").select("conv_id", "turn")


@query("SELECT conv_id, turn, role FROM conversations UNION ALL SELECT 999999, 0, 'user' UNION ALL SELECT 999999, 1, 'assistant'")
def msg_insert(t):
    added = t.spark.range(2).select(F.lit(999999).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"))
    return t.conversations.select("conv_id", "turn", "role").unionByName(added)


_ACTION = "CASE turn % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'modified' ELSE 'liked' END"


@query(f"SELECT conv_id, turn, {_ACTION} AS action, text AS original FROM conversations WHERE role = 'assistant' AND {_ACTION} <> 'liked'")
def feedback_insert(t):
    """Feedback with an action that is known, about a message that exists; it keeps what was said."""
    notes = t.conversations.select("conv_id", "turn", F.expr(_ACTION).alias("action")).filter(F.col("action").isin("accepted", "rejected", "modified"))
    told = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("original"))
    return notes.join(told, ["conv_id", "turn"])


def _connections(t) -> DataFrame:
    """Connections: a supplier is one, active unless its key divides by 5, with a schema unless by 3."""
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 5 != 0).alias("is_active"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("CREATE TABLE "), "s_name")).alias("schema_ddl"))


_CONN = "(SELECT s_suppkey AS id, s_name AS name, s_suppkey % 5 <> 0 AS is_active, CASE WHEN s_suppkey % 3 <> 0 THEN 'CREATE TABLE ' || s_name END AS schema_ddl FROM supplier)"


@query(f"SELECT id, name FROM {_CONN} WHERE is_active")
def conn_list(t):
    return _connections(t).filter("is_active").select("id", "name").orderBy(F.desc("id"))  # the newest first


@query(f"SELECT id, name, schema_ddl FROM {_CONN} WHERE id = 4 AND is_active")
def conn_get(t):
    return _connections(t).filter("id = 4 AND is_active").select("id", "name", "schema_ddl")


@query(f"SELECT id, name FROM {_CONN} UNION ALL SELECT -1, 'new'")
def conn_create(t):
    return _connections(t).select("id", "name").unionByName(t.spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("new").alias("name")))


@query(f"SELECT id, coalesce(CASE WHEN id = 4 THEN 'renamed' END, name) AS name, coalesce(NULL, schema_ddl) AS schema_ddl FROM {_CONN}")
def conn_patch(t):
    new = F.when(F.col("id") == 4, "renamed")
    return _connections(t).select("id", F.coalesce(new, "name").alias("name"), F.coalesce(F.lit(None).cast("string"), "schema_ddl").alias("schema_ddl"))


@query(f"SELECT id, is_active AND id <> 4 AS is_active FROM {_CONN}")
def conn_soft_delete(t):
    return _connections(t).select("id", (F.col("is_active") & (F.col("id") != 4)).alias("is_active"))


@query(f"SELECT id, coalesce(length(schema_ddl), 0) > 0 AS has_schema FROM {_CONN}")
def conn_has_schema(t):
    return _connections(t).select("id", (F.coalesce(F.char_length("schema_ddl"), F.lit(0)) > 0).alias("has_schema"))


@query(f"SELECT id, schema_ddl FROM {_CONN} WHERE id = 7 AND is_active")
def schema_lookup(t):
    return _connections(t).filter("id = 7 AND is_active").select("id", "schema_ddl")


@query("SELECT conv_id, turn, '{\"chars\":' || length(text) || '}' AS usage, CAST(length(text) AS BIGINT) AS back FROM conversations")
def usage_json(t):
    usage = F.to_json(F.struct(F.char_length("text").alias("chars")))
    return t.conversations.select("conv_id", "turn", usage.alias("usage"), F.from_json(usage, "chars bigint")["chars"].alias("back"))


@query("SELECT conv_id, turn, 'data: {\"role\":\"' || role || '\"}' || chr(10) || chr(10) AS frame FROM conversations")
def sse_frame(t):
    return t.conversations.select("conv_id", "turn", F.concat(F.lit("data: "), F.to_json(F.struct("role")), F.lit("\n\n")).alias("frame"))


_PROMPT_HEAD = "Answer in the dialect."


@query(f"""SELECT conv_id, '{_PROMPT_HEAD}' || chr(10) || chr(10) || '-- table nation' || chr(10) || d.ddl || chr(10) || chr(10) || h.said AS prompt
    FROM (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS said FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 12 GROUP BY 1) h,
    (SELECT 'nation(' || string_agg(n_name, ', ' ORDER BY n_nationkey) || ')' AS ddl FROM nation) d""")
def prompt_render(t):
    """Rules, the schema's text and the last twelve messages, whole, as one prompt for each conversation."""
    schema = t.nation.agg(F.concat(F.lit("nation("), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda n: n["n_name"]), ", "), F.lit(")")).alias("ddl"))
    last = t.conversations.withColumn("rn", F.row_number().over(newest())).filter("rn <= 12")
    line = F.concat("role", F.lit(": "), "text")
    said = last.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda m: m["line"]), "\n").alias("said"))
    head = F.concat(F.lit(f"{_PROMPT_HEAD}\n\n-- table nation\n"), "ddl", F.lit("\n\n"), "said")
    return said.crossJoin(F.broadcast(schema)).select("conv_id", head.alias("prompt"))  # one row
