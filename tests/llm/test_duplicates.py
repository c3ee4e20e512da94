import random

from hypothesis import given, settings
from hypothesis import strategies as st

from brinework.llm import line_dedup, near_dups, shared

from .cases import components, distance, edge, near_components, none, shingles, small


def test_near_duplicates_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in small(spark).collect()]
    want = near_components(docs)
    got = {r.doc_id: r for r in near_dups.near_duplicates(small(spark)).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        assert got[i].component_id == want[i] and got[i].n_shingles == len(shingles(text)) and got[i].kept == (want[i] == i)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(300):
        words = base[:]
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))) for i in range(50)]
    want = near_components(rows)
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_of_edge_rows(spark):
    got = near_dups.near_duplicates(edge(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 10
    assert by[2].component_id == 2 and by[2].n_shingles == 0 and by[2].kept and by[3].kept and by[4].kept
    assert by[6].component_id == 5 and not by[6].kept and by[5].n_shingles == 1
    assert near_dups.near_duplicates(none(spark)).count() == 0
    kept = near_dups.keep_one(edge(spark))
    assert kept.columns == edge(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 3, 4, 5, 7, 8]


@settings(max_examples=600, deadline=None)
@given(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)))
def test_banded_distance(a, b):
    assert line_dedup.within(a, b, 2) == (distance(a, b) <= 2)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=60, max_size=200), st.lists(st.tuples(st.sampled_from("isd"), st.integers(0, 300), st.integers(0, 255)), max_size=4))
def test_banded_distance_of_edited_lines(a, ops):
    b = bytearray(a)
    for op, at, x in ops:
        at %= max(1, len(b))
        if op == "i":
            b.insert(at, x)
        elif op == "s":
            b[at] = x
        else:
            del b[at]
    assert line_dedup.within(a, bytes(b), 2) == (distance(a, bytes(b)) <= 2)


def edited(rng, line):
    s = list(line)
    for _ in range(rng.randrange(1, 3)):
        at, how = rng.randrange(len(s)), rng.randrange(3)
        if how == 0:
            s[at] = rng.choice("xyz")
        elif how == 1:
            s.insert(at, rng.choice("xyz"))
        else:
            del s[at]
    return "".join(s)


def line_docs():
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(24, 60))) for _ in range(25)]
    docs = []
    for i in range(60):
        lines = [edited(rng, x) if rng.random() < 0.4 else x for x in rng.choices(pool, k=rng.randrange(1, 6))] + [f"short {i}"]
        docs.append((i, "\n".join(lines)))
    return docs


def brute_lines(docs):
    """Places, class and links of each different line with a letter or digit; ``within`` is held against the plain distance elsewhere."""
    places = {}
    for i, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            if any(ord(c) >= 128 or c.isalnum() for c in line):
                places.setdefault(line, []).append((i, n))
    lines = sorted(places, key=lambda x: len(x.encode()))
    size = [len(x.encode()) for x in lines]
    near = []
    for k, a in enumerate(lines):
        edits = int(line_dedup.allowed(size[k]))
        for j in range(k + 1, len(lines)):
            if size[j] - size[k] > edits:
                break
            if edits and line_dedup.within(a.encode(), lines[j].encode(), edits):
                near.append((a, lines[j]))
    root = components(lines, near)
    return places, root, near


def test_line_classes_equal_brute_force(spark):
    docs = line_docs()
    places, root, near = brute_lines(docs)
    size, first = {}, {}
    for line, at in places.items():
        size[root[line]] = size.get(root[line], 0) + len(at)
        first[root[line]] = min([*at, first.get(root[line], (1 << 40, 0))])
    want = {}
    for line, at in places.items():
        if size[root[line]] > 1:
            degree = sum(line in x for x in near)
            for i in {i for i, _ in at}:
                own = [n for j, n in at if j == i]
                want[i, min(own)] = (len(own), size[root[line]], degree, first[root[line]] == (i, min(own)))
    got = line_dedup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no): (r.times, r.class_size, r.n_links, r.kept) for r in got} == want


def test_dropping_lines_equals_brute_force(spark):
    docs = line_docs()
    places, root, _ = brute_lines(docs)
    first = {}
    for line, at in places.items():
        first[root[line]] = min([*at, first.get(root[line], (1 << 40, 0))])
    want = {}
    for i, text in docs:
        left = [x for n, x in enumerate(text.split("\n")) if x not in root or first[root[x]] == (i, n)]
        want[i] = "\n".join(left)
    got = line_dedup.drop_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {i: t for i, t in want.items() if t.split()}


def test_short_repeats_and_long_lines_with_more_edits(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdefghij ") for _ in range(n)) for n in (97, 200, 300, 700)]
    docs = [(1, "Yes.\n---\nAll rights reserved.\n" + "\n".join(plain)), (2, "Yes.\n---\nAll rights reserved.\nNo."), (3, "Yes!\n---")]
    for k, line in enumerate(plain):
        edits = line_dedup.allowed(len(line) - 1)
        for more in (0, 1):
            cuts = sorted(rng.sample(range(len(line) // 9), edits + more))
            s = list(line)
            for x in cuts:
                s[9 * x + 4 * more] = "X"
            docs.append((10 + 2 * k + more, "".join(s)))
    got = line_dedup.drop_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    left = {r.doc_id: r.text for r in got}
    assert left[1] == docs[0][1] and left[2] == "---\nNo." and left[3] == "Yes!\n---"
    assert [i in left for i in range(10, 18)] == [False, True] * 4


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=20, max_size=40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 2)), max_size=7), st.integers(1, 6))
def test_banded_distance_with_other_bounds(a, ops, edits):
    b = bytearray(a)
    for at, how in ops:
        at = min(at, len(b) - 1)
        if how == 0:
            b[at] = 88
        elif how == 1:
            b.insert(at, 89)
        else:
            del b[at]
    assert line_dedup.within(a, bytes(b), edits) == (distance(a, bytes(b)) <= edits)


def test_all_lines_equal_brute_force(spark):
    """Lines of every length, equal and edited as far as their length allows and one further."""
    rng = random.Random(23)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(n)).strip() + "." for n in (1, 3, 9, 20, 23, 25, 60, 94, 96, 99, 190, 193, 200)]
    docs = []
    for i in range(70):
        lines = []
        for x in rng.choices(pool, k=4):
            s = list(x)
            for _ in range(rng.randrange(0, int(line_dedup.allowed(len(x))) + 2)):
                at, how = rng.randrange(len(s)), rng.randrange(3)
                s[at:at + 1] = [[rng.choice("xyz")], [s[at], "q"], []][how]
            lines.append("".join(s))
        docs.append((i, "\n".join(lines)))
    lines = sorted({x for _, t in docs for x in t.split("\n") if any(c.isalnum() for c in x)})

    def near(a, b):
        return abs(len(a) - len(b)) <= 9 and distance(a.encode(), b.encode()) <= line_dedup.allowed(min(len(a), len(b)))

    links = [(a, b) for k, a in enumerate(lines) for b in lines[k + 1:] if near(a, b)]
    root = components(lines, links)
    size, first, want = {}, {}, {}
    places = [(i, n, x) for i, t in docs for n, x in enumerate(t.split("\n")) if x in root]
    for i, n, x in places:
        size[root[x]] = size.get(root[x], 0) + 1
        first[root[x]] = min((i, n), first.get(root[x], (1 << 40, 0)))
    for i, n, x in places:
        if size[root[x]] > 1 and not any(j == i and m < n and y == x for j, m, y in places):
            want[i, n] = (size[root[x]], sum(x in e for e in links), first[root[x]] == (i, n))
    assert len(links) > 200 and len(want) > 150
    got = line_dedup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no): (r.class_size, r.n_links, r.kept) for r in got} == want


def test_a_template_of_many_lines_is_dealt(spark, monkeypatch):
    """Lines that share a segment and nothing else: shared keys leave their buckets, blocks meet in pairs."""
    rng = random.Random(3)
    lines = ["Posted by the team on this very page: " + "".join(rng.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(3000)]
    lines += [x[:-1] + "z" for x in lines[:40]]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(line_dedup, "BLOCK", 256)
    monkeypatch.setattr(line_dedup, "TEXTS", 16)
    monkeypatch.setattr(line_dedup, "FLUSH", 5000)
    got = line_dedup.repeated_lines(docs).collect()
    assert {r.doc_id for r in got} == {*range(40), *range(3000, 3040)} and all(r.class_size == 2 and r.n_links == 1 for r in got)
    own = line_dedup.line_table(docs).select("h", "parity", "edits")
    dealt = line_dedup.shared_keys(docs, {2: 4})
    assert dealt.select("key").distinct().count() > 1 and own.count() == 3040


def test_a_large_class_is_counted_in_blocks(spark, monkeypatch):
    rng = random.Random(31)
    base = "every line here is one of a large family of lines"
    lines = sorted({base[:k] + rng.choice("xyz") + base[k + 1:] for k in range(len(base)) for _ in range(4)})
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    want = {i: sum(distance(x.encode(), y.encode()) <= 2 for y in lines) - 1 for i, x in enumerate(lines)}
    monkeypatch.setattr(line_dedup, "TEXTS", 30)
    monkeypatch.setattr(line_dedup, "BLOCK", 40)
    got = line_dedup.repeated_lines(docs).collect()
    assert {r.doc_id: r.n_links for r in got} == want and {r.class_size for r in got} == {len(lines)}


def test_star_steps_equal_one_task(spark, monkeypatch):
    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    df = spark.createDataFrame(links, "a long, b long")
    want = components({x for e in links for x in e if e[0] != e[1]}, [e for e in links if e[0] != e[1]])
    for few in (500_000, 0):
        monkeypatch.setattr(shared, "FEW_LINKS", few)
        got = {r.id: r.root for r in shared.components(shared.Kept(spark), df).collect()}
        assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 2)), max_size=6), st.booleans()), min_size=1, max_size=12), st.integers(1, 6))
def test_bands_side_by_side(rows, edits):
    pairs = []
    for a, ops, swap in rows:
        b = bytearray(a)
        for at, how in ops:
            at = min(at, len(b))
            b[at:at + (how != 1)] = [b"X", b"Y", b""][how]
        pairs.append((bytes(b), a) if swap else (a, bytes(b)))
    got = line_dedup.all_within([a for a, _ in pairs], [b for _, b in pairs], edits)
    assert got.tolist() == [distance(a, b) <= edits for a, b in pairs]


def test_lines_of_edge_rows(spark):
    out = line_dedup.drop_repeated(edge(spark))
    assert out.columns == edge(spark).columns
    by = {r.doc_id: r for r in out.collect()}
    assert by[2].text is None and by[3].text == "" and by[8].text.count("line that") == 1 and by[8].n_chars == len(by[8].text)
    assert line_dedup.repeated_lines(none(spark)).count() == 0 and line_dedup.drop_repeated(none(spark)).count() == 0
