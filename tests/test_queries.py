import datetime

import pytest
from pyspark.sql import functions as F

from brinework.operators import joins, knowledge, scalars, statements
from brinework.plans import catalogue

from .oracle import connect, same

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name):
    same(con, catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name])


TICKS = "`" * 3


def test_every_query_has_sql():
    assert catalogue.queries().keys() == catalogue.oracle_sql().keys()


def test_extraction_of_statements(spark):
    said = [f"Here:\n{TICKS}sql\nSELECT a FROM t\n{TICKS}\ndone", f"{TICKS}WITH c AS (SELECT 1) SELECT a FROM c{TICKS}", "try\nselect b FROM u\nWHERE b > 1\n\nthanks", "nothing here", f"{TICKS}sql\nDELETE FROM t", "", None]
    df = spark.createDataFrame(list(enumerate(said)), "id int, content string")
    got = {r.id: r.sql for r in df.select("id", knowledge.extracted(F.col("content")).alias("sql")).collect()}
    assert got == {0: "SELECT a FROM t", 1: "WITH c AS (SELECT 1) SELECT a FROM c", 2: "select b FROM u\nWHERE b > 1", 3: None, 4: "DELETE FROM t", 5: None, 6: None}


def test_segments_of_messages(spark):
    said = [f"a{TICKS}sql\nS1\n{TICKS}b{TICKS}SQL S2{TICKS}", f"x {TICKS}sql\nS3", f"{TICKS}sql\n\n{TICKS} ", f"{TICKS}py\nz{TICKS}", f"{TICKS}sql"]
    df = spark.createDataFrame(list(enumerate(said)), "id int, content string")
    got = sorted((r.id, r.n, r.kind, r.body, r.complete) for r in knowledge.segments(df, ["id"]).collect())
    assert [x[:1] + x[2:] for x in got] == [(0, "text", "a", True), (0, "sql", "S1", True), (0, "text", "b", True), (0, "sql", "S2", True), (1, "text", "x ", True), (1, "sql", "S3", False), (3, "text", said[3], True)]


def test_retrieval_by_keyword_word_and_category(spark):
    faq = spark.createDataFrame([(1, "How are tables distributed", "a1", "usage", ["shard"]), (2, "How large may a copy be", "a2", "limits", ["replicated"]), (3, "Is JSON supported", "a3", "types", ["json"]), (4, "How to page", "a4", "usage", ["limit"]), (5, "how else", "a5", "usage", [])],
                                "ord int, question string, answer string, category string, keywords array<string>")
    asked = spark.createDataFrame([(1, "how", None), (2, "JSON or json", None), (3, "zz q", None), (4, "a limit of how", "usage"), (5, "replicated", "usage"), (6, "shard", "usage")], "id int, asked string, wanted string")
    got = knowledge.retrieve(asked, faq, ["id"]).collect()
    assert sorted((r.id, r.rn, r.ord) for r in got) == [(1, 1, 1), (1, 2, 2), (1, 3, 4), (2, 1, 3), (4, 1, 1), (4, 2, 4), (4, 3, 5), (6, 1, 1)]
    assert {r.source for r in got if r.id == 4} == {"FAQ - usage"} and all(r.content.endswith(f"a{r.ord}") for r in got)


def test_rules_by_form(spark):
    forms = len(statements._FORMS)
    flagged = {name: {r.c_custkey % forms for r in catalogue.queries()[name](spark, SF).filter("flagged").collect()} for name in [*statements.RULES, "val_dist_column", "val_group_by"]}
    assert flagged == {
        "val_syntax": {1, 2, 28}, "val_keywords": {3, 4, 5, 6, 26}, "val_trigger_event": {5, 6}, "val_lock": {3, 26}, "val_dist_exclusive": {13}, "val_dml": {7, 29}, "val_drop": {8}, "val_star": {9, 10},
        "val_join_on": {20}, "val_dist_column": {12}, "val_group_by": {23},
    }
    assert {r.c_custkey % forms for r in catalogue.queries()["val_unknown_table"](spark, SF).collect()} == {15}
    unknown = {(r.c_custkey % forms, r.col.rstrip("0123456789")) for r in catalogue.queries()["val_unknown_column"](spark, SF).collect()}
    assert {f for f, _ in unknown} >= {16, 17, 31} and not {f for f, _ in unknown} & {0, 3, 9, 18, 19, 20, 21, 22, 24, 25, 27, 29}, unknown
    valid = {r.c_custkey % forms: r.is_valid for r in catalogue.queries()["validate_sql"](spark, SF).collect()}
    assert {f for f, v in valid.items() if not v} == {1, 2, 28, 3, 4, 5, 6, 26, 13}


def test_columns_of_a_definition(spark):
    df = spark.createDataFrame([("a INT, `b` DECIMAL(10,2), \"c\" VARCHAR(5), PRIMARY KEY (a, b), CONSTRAINT x UNIQUE (c)",), ("",)], "body string")
    assert [r[0] for r in df.select(statements.column_names(F.col("body"))).collect()] == [["a", "b", "c"], []]


def test_numbers_have_no_gaps(spark):
    from brinework.sources import layout

    got = layout.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), "k", "n").collect()
    assert sorted((r.k, r.n) for r in got) == [(k, k + 1) for k in range(1000)]


def test_a_side_over_the_bound_is_not_sent(spark, monkeypatch):
    small = spark.range(10).select(F.col("id").cast("string").alias("s"), F.array(F.lit("x")).alias("l"))
    assert "broadcast" in joins.replicated(small)._jdf.queryExecution().logical().toString()
    monkeypatch.setattr(joins, "REPLICATED_BYTES", 20)
    assert "broadcast" not in joins.replicated(small)._jdf.queryExecution().logical().toString()


def test_the_clock_is_the_sessions_own(spark):
    assert abs((scalars.clock(spark.range(1)).first().now - datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)).total_seconds()) < 600


def test_colocated_join_has_no_exchange(spark, capsys):
    catalogue.queries()["join_colocated"](spark, SF).explain()
    assert "Exchange" not in capsys.readouterr().out
