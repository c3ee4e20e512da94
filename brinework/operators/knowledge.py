"""Retrieval over question tables, and extraction from message texts.

The test tables hold no statements, so the queries put some into messages: a message
is a turn of ``conversations`` with a block, a statement or a reply beside its text,
by a rule that DuckDB reads as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.registry import query
from .joins import replicated

_TICKS, _NL = "chr(96) || chr(96) || chr(96)", "chr(10)"
#: A message's content, reply and tags as SQL over a row of conversations.
CONTENT = f"""CASE (conv_id + turn) % 6
    WHEN 0 THEN text || {_NL} || {_TICKS} || 'sql' || {_NL} || 'SELECT ' || role || ' FROM t' || CAST(turn AS STRING) || {_NL} || {_TICKS} || {_NL} || 'done'
    WHEN 1 THEN {_TICKS} || 'SELECT a FROM ' || role || {_TICKS} || text || {_TICKS} || 'SQL' || {_NL} || 'SELECT 2' || {_NL} || {_TICKS} || {_NL}
    WHEN 2 THEN text || {_NL} || 'delete from ' || role || ' where turn = ' || CAST(turn AS STRING) || {_NL} || {_NL} || 'bye'
    WHEN 3 THEN text || {_TICKS} || 'sql' || {_NL} || 'WITH c AS (SELECT 1)'
    WHEN 4 THEN ''
    ELSE text END"""
REPLY = """CASE (conv_id + turn) % 6 WHEN 0 THEN '{"intent": "sql"}' WHEN 1 THEN 'so: {"intent":"qa", "why": "' || role || '"} ok' WHEN 2 THEN text
    WHEN 3 THEN '{"intent": "other"}' WHEN 4 THEN '{"intent": general}' ELSE 'x {"intent":"general"}' END"""
TAGS = """CASE (conv_id + turn) % 5 WHEN 0 THEN '["' || role || '","b"]' WHEN 1 THEN 'not json' WHEN 2 THEN NULL WHEN 3 THEN '[]' ELSE '["q", "' || CAST(turn AS STRING) || '"]' END"""


def messages(t) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", "text", F.expr(CONTENT).alias("content"), F.expr(REPLY).alias("reply"), F.expr(TAGS).alias("tags"))


_MSG = f"(SELECT *, {CONTENT} AS content, {REPLY} AS reply, {TAGS} AS tags FROM conversations)"
#: A fenced block, and the words that a bare statement begins with.
_FENCE = r"(?is)```(?:sql)?\s*\n?(.*?)```"
_BARE = r"(?is)((?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|WITH)[^\p{L}\p{N}_].*?)(?:\n\n|$)"
_ENDS = r"^\s+|\s+$"


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, _ENDS, "")


def extracted(x: Column) -> Column:
    """The first fenced block, else the first statement up to a blank line, else null."""
    def found(p):
        return F.when(F.regexp_like(x, F.lit(p)), stripped(F.regexp_extract(x, p, 1)))
    return F.coalesce(found(_FENCE), found(_BARE))


@query(f"""SELECT conv_id, turn, CASE WHEN regexp_matches(content, '{_FENCE}') THEN regexp_replace(regexp_extract(content, '{_FENCE}', 1), '{_ENDS}', '', 'g')
    WHEN regexp_matches(content, '{_BARE}') THEN regexp_replace(regexp_extract(content, '{_BARE}', 1), '{_ENDS}', '', 'g') END AS sql FROM {_MSG}""")
def sql_extract(t):
    return messages(t).select("conv_id", "turn", extracted(F.col("content")).alias("sql"))


#: A complete block, and how an open one begins.
_BLOCK, _OPEN = r"(?is)```sql\n?(.*?)```", "```sql"


def segments(rows: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, n, kind, body, complete): texts and statement blocks in order; an open block is not complete.

    Complete blocks are marked by two control characters, and the text is cut there.
    """
    parts = F.split(F.regexp_replace(content, _BLOCK, "\x01$1\x02"), "\x02")
    cut = rows.select(*keys, F.size(parts).alias("of"), F.posexplode(parts).alias("k", "part"))
    last = F.col("k") == F.col("of") - 1
    at = F.when(last, F.instr("part", _OPEN)).otherwise(F.instr("part", "\x01"))
    before = F.when(at > 0, F.substring(F.col("part"), F.lit(1), at - 1)).otherwise(F.col("part"))
    after = F.when(at > 0, F.substr(F.col("part"), at + F.when(last, F.lit(len(_OPEN))).otherwise(F.lit(1))))
    block = F.when(last, F.regexp_replace(after, r"^\n", "")).otherwise(stripped(after))
    two = F.array(F.struct(F.lit("text").alias("kind"), before.alias("body"), F.lit(True).alias("complete")), F.struct(F.lit("sql").alias("kind"), block.alias("body"), (~last).alias("complete")))
    both = cut.select(*keys, "k", F.posexplode(two).alias("j", "s")).select(*keys, (F.col("k") * 2 + F.col("j")).alias("n"), "s.*")
    return both.filter(F.when(F.col("kind") == "text", stripped(F.col("body")) != "").otherwise(F.col("body") != ""))


@query(f"""WITH p AS (SELECT conv_id, turn, string_split(regexp_replace(content, '{_BLOCK}', chr(1) || '\\1' || chr(2), 'g'), chr(2)) AS parts FROM {_MSG}),
    c AS (SELECT conv_id, turn, k::INTEGER AS k, parts[k + 1] AS part, k = len(parts) - 1 AS last FROM p, unnest(range(len(parts))) u(k)),
    s AS (SELECT *, CASE WHEN last THEN instr(part, '{_OPEN}') ELSE instr(part, chr(1)) END AS cut FROM c),
    b AS (SELECT conv_id, turn, 2 * k AS n, 'text' AS kind, CASE WHEN cut > 0 THEN substring(part, 1, cut - 1) ELSE part END AS body, true AS complete FROM s
        UNION ALL SELECT conv_id, turn, 2 * k + 1, 'sql', CASE WHEN last THEN regexp_replace(substring(part, cut + {len(_OPEN)}), '^\\n', '') ELSE regexp_replace(substring(part, cut + 1), '{_ENDS}', '', 'g') END, NOT last FROM s WHERE cut > 0)
    SELECT conv_id, turn, n, kind, body, complete FROM b WHERE CASE WHEN kind = 'text' THEN regexp_replace(body, '{_ENDS}', '', 'g') <> '' ELSE body <> '' END""")
def content_segments(t):
    return segments(messages(t), ["conv_id", "turn"])


@query(f"""SELECT conv_id, turn, CASE WHEN i IN ('sql', 'qa', 'general') THEN i ELSE 'general' END AS intent FROM
    (SELECT conv_id, turn, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.intent') END AS i FROM (SELECT conv_id, turn, regexp_extract(reply, '(?s)(\\{{.*\\}})', 1) AS j FROM {_MSG}))""")
def intent_parse(t):
    """The intent of the reply's outermost braces; general where they hold none that is known."""
    found = F.get_json_object(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), "$.intent")
    return messages(t).select("conv_id", "turn", F.when(found.isin("sql", "qa", "general"), found).otherwise("general").alias("intent"))


@query(f"SELECT conv_id, turn, CASE WHEN json_valid(tags) THEN array_to_string(from_json(tags, '[\"VARCHAR\"]'), '|') ELSE '' END AS tags FROM {_MSG}")
def tags_parse(t):
    """A JSON list of tags, or none where it can't be read."""
    tags = F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>"))
    return messages(t).select("conv_id", "turn", F.array_join(tags, "|").alias("tags"))


@query("SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,，]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM conversations")
def tags_split(t):
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "[,，]"), lambda x: F.trim(x)), lambda x: x != "")
    return t.conversations.select("conv_id", "turn", F.array_join(parts, "|").alias("tags"))


@query("SELECT doc_id, substring(text, 1, 100) || '...' AS excerpt FROM documents")
def qa_sources(t):
    return t.documents.select("doc_id", F.concat(F.substring("text", 1, 100), F.lit("...")).alias("excerpt"))


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 5")
def topk_examples(t):
    return t.benchmark.select("item_id", "text").orderBy("item_id").limit(5)


def retrieve(asked: DataFrame, faq: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """The first ``top`` entries for each of ``asked`` (keys, asked, wanted), in the entries' order.

    An entry (ord, question, answer, category, keywords) is a hit if a keyword stands in
    what is asked or a word of it stands in the question, and its category is the one
    wanted, where one is. These are substring tests and no join keys, so the curated
    entries are a query set: each question meets each entry once, and the entries go to
    the tasks whole only under the bound of ``replicated``.
    """
    words = F.filter(F.split(F.lower("asked"), r"\s+"), lambda w: F.char_length(w) > 1)
    hit = F.exists("keywords", lambda k: F.contains(F.col("said"), F.lower(k))) | F.exists("words", lambda w: F.contains(F.lower("question"), w))
    told = asked.withColumn("words", words).withColumn("said", F.lower("asked"))
    met = told.join(replicated(faq), (F.col("wanted").isNull() | (F.col("wanted") == F.col("category"))) & hit)
    first = met.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).filter(F.col("rn") <= top)
    content = F.concat(F.lit("问题："), "question", F.lit("\n\n答案："), "answer")
    return first.select(*keys, F.col("rn").cast("long").alias("rn"), "ord", content.alias("content"), F.concat(F.lit("FAQ - "), "category").alias("source"))


#: Entries and questions as SQL over benchmark and conversations.
_ENTRY = """item_id AS ord, text AS question, 'see item ' || CAST(item_id AS STRING) AS answer, CASE item_id % 3 WHEN 0 THEN 'usage' WHEN 1 THEN 'limits' ELSE 'types' END AS category"""
_WANTED = "CASE conv_id % 3 WHEN 0 THEN 'usage' WHEN 1 THEN 'types' END AS wanted"


@query(f"""SELECT conv_id, turn, rn, ord, '问题：' || question || chr(10) || chr(10) || '答案：' || answer AS content, 'FAQ - ' || category AS source FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ord) AS rn FROM (SELECT conv_id, turn, text AS asked, {_WANTED} FROM conversations WHERE role = 'user')
    JOIN (SELECT {_ENTRY}, [string_split(text, ' ')[1], string_split(text, ' ')[3]] AS keywords FROM benchmark) ON (wanted IS NULL OR wanted = category)
    AND (len(list_filter(keywords, lambda k: contains(lower(asked), lower(k)))) > 0 OR len(list_filter(regexp_split_to_array(lower(asked), '\\s+'), lambda w: length(w) > 1 AND contains(lower(question), w))) > 0)) WHERE rn <= 3""")
def faq_retrieve(t):
    words = F.split("text", " ")
    faq = t.benchmark.select(*[F.expr(x) for x in _split_columns(_ENTRY)], F.array(F.get(words, F.lit(0)), F.get(words, F.lit(2))).alias("keywords"))
    asked = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"), F.expr(_WANTED))
    return retrieve(asked, faq, ["conv_id", "turn"])


def _split_columns(columns: str) -> list[str]:
    return [c.strip() for c in columns.split(", ")]


#: Model names by task: the first part of a brand is its primary model, the next three are what it falls back on.
@query("""WITH o AS (SELECT p_brand AS task, 'org/' || replace(p_name, ' ', '-') AS model, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM part),
    f AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY task, pos) AS rn FROM o WHERE pos <= 4)
    SELECT model AS id, array_to_string(list_transform(string_split(string_split(model, '/')[-1], '-'), lambda w: upper(w[1]) || w[2:]), ' ') AS name, task AS task_type, pos = 1 AS "primary" FROM f WHERE rn = 1""")
def models_distinct(t):
    ranked = t.part.withColumn("pos", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).filter("pos <= 4")
    one = F.struct("pos", F.concat(F.lit("org/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).alias("model"))
    tasks = ranked.groupBy(F.col("p_brand").alias("task_type")).agg(F.sort_array(F.collect_list(one)).alias("models"))
    return distinct_models(tasks)


def distinct_models(tasks: DataFrame) -> DataFrame:
    """(id, name, task_type, primary) of every model of (task_type, models), primary first; its first place counts."""
    flat = tasks.select("task_type", F.explode("models").alias("m")).select("task_type", "m.pos", F.col("m.model").alias("id"))
    first = flat.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("task_type", "pos"))).filter("rn = 1")
    name = F.initcap(F.replace(F.element_at(F.split("id", "/"), -1), F.lit("-"), F.lit(" ")))
    return first.select("id", name.alias("name"), "task_type", (F.col("pos") == 1).alias("primary"))
