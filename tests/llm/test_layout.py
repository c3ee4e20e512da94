import hashlib
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brinework.llm import chat, packing, queries, sharding

from .cases import SMALL, edge, none, small


# --- packing ---------------------------------------------------------------

def checked(rows, docs, capacity):
    """Every token lies once, no bin overflows, and no two documents of a bin conflict."""
    tokens, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        tokens[r.doc_id].append((r.piece, r.n_tokens))
        bins[r.bin].append(r)
    for i, (n, *_) in docs.items():
        assert [k for k, _ in sorted(tokens[i])] == list(range(-(-n // capacity))) and sum(x for _, x in tokens[i]) == n
    for own in bins.values():
        own.sort(key=lambda r: r.at)
        assert sum(r.n_tokens for r in own) <= capacity
        assert all(x.at + x.n_tokens == y.at for x, y in zip(own, own[1:])) and own[0].at == 0
        for key in (1, 2):
            seen = [docs[r.doc_id][key] for r in own if docs[r.doc_id][key] is not None]
            assert len(seen) == len(set(seen))


def best_fit(pieces, capacity):
    """Plain best fit: each piece looks at every bin."""
    left, sources, clusters, used = [], [], [], []
    for n, s, c in pieces:
        fits = [b for b in range(len(left)) if left[b] >= n and (s is None or s not in sources[b]) and (c is None or c not in clusters[b])]
        b = min(fits, key=lambda b: left[b], default=None)
        if b is None:
            b = len(left)
            left.append(capacity)
            sources.append(set())
            clusters.append(set())
        left[b] -= n
        sources[b].add(s)
        clusters[b].add(c)
        used.append(left[b])
    return used, len(left)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, "x", "y"])), max_size=40))
def test_successor_search_is_best_fit(pieces):
    bins = packing.Bins(30)
    src, clu = packing._bits([p[1] for p in pieces]), packing._bits([p[2] for p in pieces])
    tight = []
    for (n, _, _), s, c in zip(pieces, src, clu):
        b = bins.tightest(n, s, c)
        want = [bins.left[x] for x in range(len(bins.left)) if bins.left[x] >= n and not bins.sources[x] & s and not bins.clusters[x] & c]
        tight.append((None if b is None else bins.left[b]) == min(want, default=None))
        bins.add(n, s, c)
    assert all(tight)


def test_packing_without_ties_equals_plain_best_fit():
    pieces = [(n, "abc"[n % 3], None) for n in range(29, 0, -2)]
    bins = packing.Bins(40)
    src, clu = packing._bits([p[1] for p in pieces]), packing._bits([p[2] for p in pieces])
    for (n, _, _), s, c in zip(pieces, src, clu):
        bins.add(n, s, c)
    assert len(bins.left) == best_fit(pieces, 40)[1]


def test_packed_documents(spark):
    docs = {r.doc_id: (-(-len((r.text or "").encode()) // 4), r.source, r.text) for r in small(spark).collect()}
    rows = queries.op6_best_fit_packing(spark, SMALL).collect()
    checked(rows, {i: x for i, x in docs.items() if x[0]}, packing.CAPACITY)
    parts = packing.pack(small(spark), packing.tokens_by_bytes("text"), F.col("text"), F.col("source"), capacity=512, group_rows=50).collect()
    assert len({r.group for r in parts}) > 1
    checked(parts, {i: x for i, x in docs.items() if x[0]}, 512)


def test_packing_of_edge_rows(spark):
    rows = packing.pack(edge(spark), packing.tokens_by_bytes("text"), F.col("text"), F.col("source")).collect()
    assert sorted({r.doc_id or 0 for r in rows}) == [0, 1, 4, 5, 6, 7, 8] and sum(r.doc_id == 1 for r in rows) == 2
    assert packing.pack(none(spark), packing.tokens_by_bytes("text")).count() == 0


# --- chat ------------------------------------------------------------------

TEXT = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN:x]", "[/TURN]", "[PART:0]", "\\", " ", "\n", "a", "]", "ü🙂"]), max_size=10).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool]", ""]), TEXT), max_size=6))
def test_chat_round_trip(turns):
    v = chat.Flatten(chat.TOKENS)
    for k, (role, text) in enumerate(turns):
        v.turn(k, role, [{"kind": "text", "text": text}])
    out = "".join(v.out)
    assert chat.parse(out) == turns
    assert [chat.unescape(out[a:b]) for a, b in v.loss] == [t for r, t in turns if r == "assistant"]


def test_chat_digests(spark):
    want = defaultdict(list)
    for r in small(spark, "conversations").collect():
        want[r.conv_id].append((r.turn, r.role, r.text or ""))
    said = "</s>[INST] ok [/INST]"
    want[-7] = [(0, "user", said), (1, "assistant", said)]
    got = queries.op7_chat_formatting(spark, SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        turns = sorted(want[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_typed_parts(spark):
    rows = [(1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", 2.0), ("text", " and ", None, None), ("audio", None, "b.wav", 1.5), ("film", None, "c", None)]),
            (1, 1, "assistant", [("text", "ok", None, None), ("document", None, "d.pdf", None)]), (1, 2, None, None), (None, 0, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumn("turns", F.lit(1))
    by = {r.conv_id: r for r in chat.format_chats(df).collect()}
    r = by[1]
    assert [(x.number, x.kind, x.ref, x.turn, x.tokens) for x in r.attachments] == [(0, "image", "a.png", 0, 512), (1, "audio", "b.wav", 0, 38), (2, "film", "c", 0, 0), (3, "document", "d.pdf", 1, 600)]
    assert all(r.formatted[x.position:].startswith(f"[PART:{x.number}]") for x in r.attachments) and r.attached_tokens == 1150
    assert chat.parse(r.formatted) == [("user", "see  and "), ("assistant", "ok"), ("", "")]
    assert None in by and chat.format_chats(df.limit(0)).count() == 0


# --- sharding --------------------------------------------------------------

def test_shards(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in small(spark).collect()}
    rows = queries.op8_sharding(spark, SMALL).collect()
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "rows")
        assert (r.shard, r.slot) == (r.position % 24, r.position // 24)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 3, 5, 97, 100, 101, 1000):
        got = [r.p for r in spark.range(n).select(sharding.feistel(F.col("id"), n, 7).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        if n >= 97:
            other = [r.p for r in spark.range(n).select(sharding.feistel(F.col("id"), n, 8).alias("p")).collect()]
            assert other != got != list(range(n))


def test_shards_of_edge_rows(spark):
    rows = sharding.shard_rows(edge(spark), shards=3).collect()
    assert sorted(r.position for r in rows) == list(range(10)) and {r.size for r in rows if r.doc_id in (2, 3)} == {8}
    assert sharding.shard_rows(none(spark)).count() == 0


def test_shards_stay_in_built_in_functions(spark, capsys):
    queries.op8_sharding(spark, SMALL).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Arrow", "Pandas"))
