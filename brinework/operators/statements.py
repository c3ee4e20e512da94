"""Rules over a table of statements: each a column, a grouping or a join with the schema.

The statements are made from the rows of ``customer``, thirty-two forms by turns, by a
rule that DuckDB reads as well. A statement is looked at outside its string literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query

_K = "CAST(c_custkey AS STRING)"
_FORMS = [
    f"'SELECT c_custkey, c_name FROM customer WHERE c_custkey = ' || {_K}", "'SELECT FROM'", "''", f"'SELECT o_orderkey FROM orders WHERE o_custkey = ' || {_K} || ' FOR UPDATE'",
    "'lock tables orders WRITE'", f"'CREATE TRIGGER on_' || {_K} || ' BEFORE INSERT ON orders FOR EACH ROW SET @a = 1'", "'CREATE EVENT nightly ON SCHEDULE EVERY 1 DAY DO SELECT 2'",
    f"'INSERT INTO region (r_regionkey) VALUES (' || {_K} || ')'", "'DROP TABLE nation'", "'SELECT * FROM part'", "'SELECT p_partkey, * FROM part'",
    f"'CREATE TABLE a' || {_K} || ' (ak INT, av VARCHAR(30)) DISTRIBUTED BY(''ak'')'", f"'CREATE TABLE b' || {_K} || ' (bk INT, bv VARCHAR(30)) DISTRIBUTED BY(''zk'')'",
    "'CREATE TABLE c (ck INT) REPLICATED DISTRIBUTED BY(''ck'')'", f"'CREATE TABLE d' || {_K} || ' (dk INT, dv VARCHAR(30)) REPLICATED'", f"'SELECT w FROM stock_' || {_K}",
    f"'SELECT none_' || {_K} || ' FROM supplier'", "'SELECT s.wrong FROM supplier s'", "'SELECT s.s_name FROM supplier AS s'", "'SELECT COUNT(*) FROM events'", "'SELECT n_name FROM nation JOIN region'",
    "'SELECT n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey'", "'SELECT n_name FROM nation JOIN region USING (n_regionkey)'",
    "'SELECT l_returnflag, l_linestatus, COUNT(*) FROM lineitem GROUP BY l_returnflag'", "'SELECT l_returnflag, l_linestatus AS s, SUM(l_tax) FROM lineitem GROUP BY l_returnflag, l_linestatus'",
    "'SELECT p_name FROM part WHERE p_type = ''lock tables for update'''", "'SELECT p_name FROM part LOCK IN SHARE MODE'", "'WITH c AS (SELECT p_brand FROM part) SELECT p_brand FROM c'",
    "'SELECT (p_size FROM part'", f"'UPDATE orders SET o_orderstatus = ''F'' WHERE o_orderkey = ' || {_K}", f"'CREATE TABLE e' || {_K} || ' (ek INT, ev DECIMAL(10,2), `key` INT) DISTRIBUTED BY(''key'')'",
    "'SELECT o_orderkey FROM orders WHERE o_clerk > 3'",
]
STATEMENT = f"CASE c_custkey % {len(_FORMS)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_FORMS)) + " END"


def statements(t) -> DataFrame:
    return t.customer.select("c_custkey", F.expr(STATEMENT).alias("statement"))


_STM = f"(SELECT c_custkey, {STATEMENT} AS statement FROM customer)"

#: What the dialect lacks, by name; the last three from its list of prohibitions.
_LACKS = r"for\s+update|lock\s+in\s+share\s+mode|lock\s+tables|unlock\s+tables|create\s+trigger|drop\s+trigger|alter\s+trigger|create\s+event|get\s+diagnostics|signal|fulltext"
#: Words that begin a statement.
_VERBS = r"^\s*(select|insert|update|delete|create|drop|alter|with|lock|unlock|replace|truncate|show|set|use|explain|call|grant|revoke)\b"
#: Each rule: its level, and a condition over x (the statement without literals) and s (as it is). M is the engine's regular expression test.
RULES = {
    "val_syntax": ("error", "trim(x) = '' OR NOT M(x, '(?i)" + _VERBS + r"') OR M(x, '(?i)select\s+from\b') OR length(replace(x, '(', '')) <> length(replace(x, ')', ''))"),
    "val_keywords": ("error", rf"M(x, '(?i)\b({_LACKS})\b')"),
    "val_trigger_event": ("error", r"M(x, '(?i)create\s+(trigger|event)\b')"),
    "val_lock": ("error", r"M(x, '(?i)\bfor\s+update\b|\block\s+in\s+share\s+mode\b')"),
    "val_dist_exclusive": ("error", r"M(x, '(?i)\breplicated\b') AND M(x, '(?i)\bdistributed\s+by\b')"),
    "val_dml": ("warning", r"M(x, '(?i)^\s*(insert|update|delete)\b')"),
    "val_drop": ("warning", r"M(x, '(?i)^\s*drop\b')"),
    "val_star": ("warning", r"M(x, '(?i)\bselect\s+(\*|[^()]*,\s*\*)')"),
    "val_join_on": ("warning", r"M(x, '(?i)\bjoin\s+\w+(\s+(as\s+)?\w+)?\s*$|\bjoin\s+\w+\s+(where|group|order|limit|join)\b')"),
}
_PLAIN = "regexp_replace(statement, '''[^'']*''', '''''')"


def plain(t) -> DataFrame:
    """(c_custkey, s, x) of every statement."""
    return statements(t).select("c_custkey", F.col("statement").alias("s"), F.expr(_PLAIN).alias("x"))


_X = f"(SELECT c_custkey, statement AS s, regexp_replace(statement, '''[^'']*''', '''''', 'g') AS x FROM {_STM})"


def in_spark(rule: str) -> str:
    return rule.replace("M(x, '", "regexp_like(x, r'")


def in_duckdb(rule: str) -> str:
    return rule.replace("M(x, ", "regexp_matches(x, ")


def _flag(name: str):
    _, rule = RULES[name]

    def flagged(t):
        return plain(t).select("c_custkey", F.expr(in_spark(rule)).alias("flagged"))

    flagged.__name__ = name
    query(f"SELECT c_custkey, {in_duckdb(rule)} AS flagged FROM {_X}")(flagged)


for _name in RULES:
    _flag(_name)

@query(f"SELECT c_custkey, {', '.join(f'{in_duckdb(rule)} AS {name}' for name, (_, rule) in RULES.items())} FROM {_X}")
def lint_statements(t):
    """All rules that look at one statement, a column each."""
    return plain(t).select("c_custkey", *[F.expr(in_spark(rule)).alias(name) for name, (_, rule) in RULES.items()])


_KEY = r"(?i)distributed\s+by\s*\(?\s*[''\"`]?(\w+)"
_BODY = r"(?is)create\s+table\s+[`\"]?[^\s(`\"]+[`\"]?\s*\((.*)\)\s*(?:replicated|distributed.*)?\s*$"
#: Words that begin a key or constraint and name no column.
_NO_COLUMNS = ("primary", "unique", "index", "constraint", "foreign", "key")


def column_names(body):
    """The names in a list of column definitions; what stands in inner brackets is no part of it."""
    flat = F.regexp_replace(body, r"\([^()]*\)", "")
    first = F.transform(F.split(flat, ","), lambda c: F.regexp_extract(F.trim(c), r"(?s)^\s*(\S+)", 1))
    bare = F.filter(first, lambda c: ~F.lower(c).isin("", *_NO_COLUMNS))
    return F.transform(bare, lambda c: F.regexp_replace(c, "[`\"]", ""))


def _names_sql(body: str) -> str:
    first = rf"list_transform(string_split(regexp_replace({body}, '\([^()]*\)', '', 'g'), ','), lambda c: regexp_extract(trim(c), '(?s)^\s*(\S+)', 1))"
    return f"list_transform(list_filter({first}, lambda c: lower(c) NOT IN ('', {', '.join(repr(x) for x in _NO_COLUMNS)})), lambda c: regexp_replace(c, '[`\"]', '', 'g'))"


@query(f"""SELECT c_custkey, k <> '' AND NOT list_contains(list_transform({_names_sql('b')}, lambda c: lower(c)), k) AS flagged
    FROM (SELECT c_custkey, lower(regexp_extract(s, '{_KEY}', 1)) AS k, regexp_extract(s, '{_BODY}', 1) AS b FROM {_X})""")
def val_dist_column(t):
    """A distribution key that is none of the columns defined."""
    key, body = F.lower(F.regexp_extract("s", _KEY.replace("''", "'"), 1)), F.regexp_extract("s", _BODY, 1)
    known = F.transform(column_names(body), lambda c: F.lower(c))
    return plain(t).select("c_custkey", ((key != "") & ~F.array_contains(known, key)).alias("flagged"))


_LIST, _GROUP = r"(?is)^\s*select\s+(.*?)\s+from\s", r"(?is)\sgroup\s+by\s+(.*?)(?:\s+(?:having|order|limit)\s.*)?$"
_BARE, _NAME = r"(?i)^(\w+\.)?[a-z_]\w*(\s+(as\s+)?\w+)?$", r"^(?:\w+\.)?(\w+)"


def bare_columns(items):
    """Names of the plain columns, aliased or not, in a comma list."""
    cut = F.transform(F.split(F.regexp_replace(items, r"\([^()]*\)", "()"), ","), lambda c: F.trim(c))
    return F.transform(F.filter(cut, lambda c: F.regexp_like(c, F.lit(_BARE))), lambda c: F.lower(F.regexp_extract(c, _NAME, 1)))


def _bare_sql(items: str) -> str:
    cut = rf"list_transform(string_split(regexp_replace({items}, '\([^()]*\)', '()', 'g'), ','), lambda c: trim(c))"
    return f"list_transform(list_filter({cut}, lambda c: regexp_matches(c, '{_BARE}')), lambda c: lower(regexp_extract(c, '{_NAME}', 1)))"


@query(f"SELECT c_custkey, g <> '' AND len(list_filter({_bare_sql('l')}, lambda c: NOT list_contains({_bare_sql('g')}, c))) > 0 AS flagged FROM (SELECT c_custkey, regexp_extract(x, '{_LIST}', 1) AS l, regexp_extract(x, '{_GROUP}', 1) AS g FROM {_X})")
def val_group_by(t):
    """A plain column that is selected and not grouped by."""
    group = F.regexp_extract("x", _GROUP, 1)
    return plain(t).select("c_custkey", ((group != "") & (F.size(F.array_except(bare_columns(F.regexp_extract("x", _LIST, 1)), bare_columns(group))) > 0)).alias("flagged"))


_TABLE, _CTE = r"(?i)\b(?:from|join|into|update)\s+(\w+)", r"(?i)\b(\w+)\s+as\s*\(\s*select\b"
_ALIAS, _QUALIFIED, _COMPARED = r"(?i)\b(?:from|join)\s+(\w+\s+(?:as\s+)?\w+)", r"\b([A-Za-z_]\w*\.\w+)", r"(?i)\b([a-z_]\w*)\s*(?:=|<>|<=|>=|<|>)"
#: Words that follow a table and are no alias of it.
_NO_ALIAS = ("where", "join", "on", "using", "group", "order", "limit", "for", "lock", "set")
#: The tables that statements may name.
SCHEMA = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def schema(t) -> DataFrame:
    """(tab, col): the columns of all tables, some seventy rows."""
    return t.spark.createDataFrame([(n, c) for n in SCHEMA for c in getattr(t, n).columns], "tab string, col string")


_SCHEMA = f"(SELECT table_name AS tab, column_name AS col FROM information_schema.columns WHERE table_name IN {SCHEMA})"


def all_of(x: str, pattern: str):
    return F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), lambda c: F.lower(c))


def _all_sql(pattern: str) -> str:
    return f"list_transform(regexp_extract_all(x, '{pattern}', 1), lambda c: lower(c))"


def tables_named(t) -> DataFrame:
    """(c_custkey, tab): the tables that each statement reads or writes, but for those it defines."""
    return plain(t).select("c_custkey", F.explode(F.array_except(all_of("x", _TABLE), all_of("x", _CTE))).alias("tab"))


_TABS = f"(SELECT DISTINCT c_custkey, unnest(list_filter({_all_sql(_TABLE)}, lambda c: NOT list_contains({_all_sql(_CTE)}, c))) AS tab FROM {_X})"


@query(f"SELECT c_custkey, tab FROM {_TABS} WHERE tab NOT IN (SELECT tab FROM {_SCHEMA})")
def val_unknown_table(t):
    return tables_named(t).join(F.broadcast(schema(t).select("tab").distinct()), "tab", "left_anti").select("c_custkey", "tab")


@query(f"""WITH a AS (SELECT c_custkey, lower(regexp_extract(p, '(\\w+)$', 1)) AS alias, lower(regexp_extract(p, '^(\\w+)', 1)) AS tab FROM (SELECT c_custkey, unnest(regexp_extract_all(x, '{_ALIAS}', 1)) AS p FROM {_X})),
    r AS (SELECT c_custkey, tab AS alias, tab FROM {_TABS} UNION SELECT * FROM a WHERE alias NOT IN {_NO_ALIAS}),
    c AS (SELECT DISTINCT c_custkey, split_part(q, '.', 1) AS alias, split_part(q, '.', 2) AS col FROM (SELECT c_custkey, unnest({_all_sql(_QUALIFIED)}) AS q FROM {_X})
        UNION SELECT c_custkey, NULL, unnest(list_concat({_bare_sql(f"regexp_extract(regexp_replace(x, '[A-Za-z_]\\w*\\.\\w+', '0', 'g'), '{_LIST}', 1)")}, list_transform(regexp_extract_all(regexp_replace(x, '[A-Za-z_]\\w*\\.\\w+', '0', 'g'), '{_COMPARED}', 1), lambda c: lower(c)))) FROM {_X}),
    known AS (SELECT r.c_custkey, r.alias, s.tab, s.col FROM r JOIN {_SCHEMA} s ON r.tab = s.tab)
    SELECT c_custkey, col FROM c WHERE EXISTS (SELECT 1 FROM known k WHERE k.c_custkey = c.c_custkey AND (c.alias IS NULL OR k.alias = c.alias))
    AND NOT EXISTS (SELECT 1 FROM known k WHERE k.c_custkey = c.c_custkey AND (c.alias IS NULL OR k.alias = c.alias) AND k.col = c.col)""")
def val_unknown_column(t):
    """Columns that none of the statement's known tables has; a qualified one is looked up by its alias."""
    x = plain(t)
    pair = x.select("c_custkey", F.explode(F.regexp_extract_all("x", F.lit(_ALIAS), F.lit(1))).alias("p"))
    alias = pair.select("c_custkey", F.lower(F.regexp_extract("p", r"(\w+)$", 1)).alias("alias"), F.lower(F.regexp_extract("p", r"^(\w+)", 1)).alias("tab")).filter(~F.col("alias").isin(*_NO_ALIAS))
    named = tables_named(t).select("c_custkey", F.col("tab").alias("alias"), "tab").unionByName(alias).distinct()
    rest = F.regexp_replace("x", r"[A-Za-z_]\w*\.\w+", "0")
    lone = F.concat(bare_columns(F.regexp_extract(rest, _LIST, 1)), F.transform(F.regexp_extract_all(rest, F.lit(_COMPARED), F.lit(1)), lambda c: F.lower(c)))
    wanted = x.select("c_custkey", F.explode(all_of("x", _QUALIFIED)).alias("q")).select("c_custkey", F.split_part("q", F.lit("."), F.lit(1)).alias("alias"), F.split_part("q", F.lit("."), F.lit(2)).alias("col"))
    wanted = wanted.unionByName(x.select("c_custkey", F.lit(None).cast("string").alias("alias"), F.explode(lone).alias("col"))).distinct()
    # a statement's columns and those of its known tables meet by statement and, where there is one, alias
    known = named.join(F.broadcast(schema(t)), "tab").select("c_custkey", "alias", F.col("col").alias("has"))
    every = known.unionByName(known.withColumn("alias", F.lit("")))
    lists = every.groupBy("c_custkey", "alias").agg(F.collect_set("has").alias("has"))
    met = wanted.withColumn("alias", F.coalesce("alias", F.lit(""))).join(lists, ["c_custkey", "alias"])
    return met.filter(~F.array_contains("has", F.col("col"))).select("c_custkey", "col").distinct()


_ALL = {name: (level, in_duckdb(rule)) for name, (level, rule) in RULES.items()}


def _reported(level: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for n, (at, r) in _ALL.items() if at == level) + "], lambda c: c IS NOT NULL), ',')"


@query(f"SELECT c_custkey, e = '' AS is_valid, e AS errors, CASE WHEN contains(e, 'val_syntax') THEN '' ELSE w END AS warnings FROM (SELECT c_custkey, {_reported('error')} AS e, {_reported('warning')} AS w FROM {_X})")
def validate_sql(t):
    """The verdict over the rules that look at one statement; one that can't be read has no warnings."""
    def reported(level):
        return F.array_join(F.array_compact(F.array(*[F.when(F.expr(in_spark(rule)), F.lit(name)) for name, (at, rule) in RULES.items() if at == level])), ",")
    got = plain(t).select("c_custkey", reported("error").alias("errors"), reported("warning").alias("warnings"))
    return got.select("c_custkey", (F.col("errors") == "").alias("is_valid"), "errors", F.when(F.contains("errors", F.lit("val_syntax")), "").otherwise(F.col("warnings")).alias("warnings"))


#: Two tables and another statement in one text, as SQL over a row of supplier.
_DDL = "'CREATE TABLE `' || s_name || '` (Id INT, bal DECIMAL(10,2), PRIMARY KEY (Id)); create table t_' || CAST(s_suppkey AS STRING) || ' (`Key` INT, v VARCHAR(9), FOREIGN KEY (v) REFERENCES r(v)); DROP TABLE x; '"
_CREATED = r"(?is)^create\s+table\s+[`\"]?([^\s(`\"]+)[`\"]?\s*\((.*)\)"


@query(f"""SELECT s_suppkey, n::INTEGER AS n, regexp_extract(s, '{_CREATED}', 1) AS "table", array_to_string({_names_sql(f"regexp_extract(s, '{_CREATED}', 2)")}, ',') AS columns
    FROM (SELECT s_suppkey, k AS n, trim(string_split(ddl, ';')[k + 1]) AS s FROM (SELECT s_suppkey, {_DDL} AS ddl FROM supplier), unnest(range(4)) u(k)) WHERE starts_with(upper(s), 'CREATE TABLE')""")
def ddl_to_schema(t):
    """(s_suppkey, n, table, columns) of every CREATE TABLE statement of a text; keys and constraints are no columns."""
    cut = t.supplier.select("s_suppkey", F.posexplode(F.split(F.expr(_DDL), ";")).alias("n", "s")).withColumn("s", F.trim("s")).filter(F.startswith(F.upper("s"), F.lit("CREATE TABLE")))
    return cut.select("s_suppkey", "n", F.regexp_extract("s", _CREATED, 1).alias("table"), F.array_join(column_names(F.regexp_extract("s", _CREATED, 2)), ",").alias("columns"))
