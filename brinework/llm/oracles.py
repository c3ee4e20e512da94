"""SQL that DuckDB runs for the same rows, where SQL can say what an operator does.

Near duplicates here are every pair of documents that share a shingle, the
permutation is walked by a recursive table, and the chat template is added up by
lengths. None of it goes the way of the operators.
"""

from __future__ import annotations

from .sharding import PRIME, round_keys

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NEAR_DUPLICATES = rf"""WITH RECURSIVE
    w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
    places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM places),
    sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON other = x),
    least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)"""

_CONTROL = r"</?s>|\[/?(?:INST|SYS|TURN)\]|\[TURN:|\[PART:"


def _escaped(column: str) -> str:
    """The length of a text with a backslash before each backslash and control string."""
    return rf"length({column}) + len(regexp_extract_all({column}, '\\|{_CONTROL}'))"


CHAT = rf"""WITH told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    sized AS (SELECT *, {_escaped('text')} + 3 + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
        ELSE 14 + {_escaped('role')} + len(regexp_extract_all(role, '\]')) END AS n FROM told)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        sum(n)::BIGINT AS formatted_chars, 0::BIGINT AS attached_tokens FROM sized GROUP BY 1"""

#: The remainder of a polynomial over two elements, a bit at a time.
_BIT = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


def _crc32(column: str) -> str:
    step = "xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])"
    read = f"list_transform(regexp_extract_all(hex(encode({column})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {read}), lambda c, b: {step}), 4294967295)"


def sharded(shards: int = 24, key: int = 7) -> str:
    """Every row's place under the law ``rows``: six rounds on the two halves of its number."""
    halves = "SELECT row_number, x // b AS l, x % b AS r, a, b, n FROM walk, d WHERE NOT arrived"
    for i, (x, y, z) in enumerate(round_keys(key)):
        moved, by, within = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        mixed = f"((m * m + {z}) % {PRIME} * {y} + {x}) % {PRIME}"
        first = f"SELECT *, ({by} * {x} + {y}) % {PRIME} AS m FROM ({halves})"
        halves = f"SELECT * EXCLUDE m REPLACE (({moved} + {mixed}) % {within} AS {moved}) FROM ({first})"
    return f"""WITH RECURSIVE
    {_TABLE},
    sized AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
    r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number FROM sized),
    side AS (SELECT n, greatest(1, (floor(sqrt(greatest(0, n - 1))) + 1)::BIGINT) AS a FROM (SELECT count(*) AS n FROM documents)),
    d AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM side),
    walk(row_number, x, arrived) AS (SELECT row_number, row_number, false FROM r UNION ALL SELECT row_number, l * b + r, l * b + r < n FROM ({halves}))
    SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {shards})::INTEGER AS shard, x // {shards} AS slot, NULL::INTEGER AS grown_shard, row_number, x AS position
    FROM walk JOIN r USING (row_number) WHERE arrived"""


def _table() -> str:
    """``crc``: one row with the 256 remainders as a list ``t``."""
    levels = "SELECT k, k AS c FROM (SELECT unnest(range(256)) AS k)"
    for _ in range(8):
        levels = f"SELECT k, {_BIT.format('c')} AS c FROM ({levels})"
    return f"crc AS (SELECT list(c ORDER BY k) AS t FROM ({levels}))"


_TABLE = _table()


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": NEAR_DUPLICATES, "op7_chat_formatting": CHAT, "op8_sharding": sharded()}
