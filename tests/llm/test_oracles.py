"""Operators whose rows SQL can give, against DuckDB."""

import zlib

import pytest

from brinework.llm import oracles, queries
from tests.oracle import connect, same

from .cases import SMALL


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(connect(SMALL), queries.queries()[name](spark, SMALL), queries.oracle_sql()[name])


def test_checksum_in_sql():
    con = connect(SMALL)
    got = con.execute(f"WITH {oracles._TABLE} SELECT text, {oracles._crc32('text')} FROM (SELECT text FROM documents WHERE text IS NOT NULL UNION ALL SELECT ''), crc").fetchall()
    assert got and all(zlib.crc32(t.encode()) == c for t, c in got)


def test_chat_lengths_in_sql():
    from brinework.llm.chat import escape
    texts = ["", "\\", "a </s> b", "[INST][/INST] \\[SYS]", "[TURN:x] [PART:3] [TURN] <s", "plain ü🙂"]
    con = connect(SMALL)
    for t in texts:
        assert con.execute(f"SELECT {oracles._escaped('t')} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone()[0] == len(escape(t))
