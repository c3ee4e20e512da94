"""Near-duplicate documents by a chosen-path set similarity join.

A text's set is its distinct five-word shingles. Texts with equal sets are one class
from the start. Each class gets SIZE minwise tokens; a tree sends it along the two
tokens that a node selects to two children, named by the path and the token's value,
and TREES trees do so independently. Two sets that share three quarters of their
shingles agree in a token with that probability, so a pair's shared paths multiply
from level to level instead of dying out: a tree loses it with a probability of 1/9
at any depth, and five trees with less than 2e-5.

Within one component there is nothing left to find, so dense nodes are joined first:
each by its least class, and what that leaves apart by the heaviest forest of its
signatures' agreements. In a node that still holds more than one component, each class
outside its largest one is compared with all others (signatures first, then the full
sets) where there are LIMIT of them or fewer; other nodes branch on. Nodes that don't split within DEPTH levels are compared
in blocks of pairs. Every link is confirmed on full shingle sets.

Null and empty texts have an empty set and no links. A text of fewer than five words
is one shingle. Rows with equal ids are one document. Rows with a null id are linked
only through the classes of others and keep a null component where there is none. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Kept, Words, components, map_batches, seeds, shingle_sets, signed, utf8

WORDS, SIZE, TREES, LIMIT, DEPTH, CHUNK = 5, 128, 5, 2048, 8, 256
#: Agreeing tokens, of SIZE, from which a pair is confirmed: four deviations under three quarters.
LIKELY = 76
#: The same for the longer signatures of classes that are still apart after the forests.
LONG, LIKELY_LONG = 512, 345
#: Classes that one forest spans; a larger node is dealt by hash to parts of this size.
FOREST = 4096
#: Ids that go to the tasks whole (4 MB); more are met by shuffle.
SENT_IDS = 500_000
#: Rows of a node that one task may get; larger nodes that go to the tasks whole (10 MB).
HEAVY, SENT_NODES = 128, 250_000
_A, _B = seeds(LONG, 101), seeds(LONG, 102)


def linked(common: int, union: int) -> bool:
    return 100 * common >= 75 * union


def _sets(column: pa.Array) -> list[np.ndarray]:
    return shingle_sets(Words(*utf8(column), lower=True), WORDS)


def minwise(sets: list[np.ndarray], size: int) -> np.ndarray:
    """(sets, size) least 32-bit hashes; empty sets have zeros. In blocks that stay in cache."""
    n = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), size), np.uint32)
    full = np.flatnonzero(n)
    ends = np.cumsum(n[full])
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - n[full[a]] + (1 << 14))))
        flat = np.concatenate([sets[i] for i in full[a:b]])
        at = np.append(0, np.cumsum(n[full[a:b]])[:-1])
        got = np.empty((size, b - a), np.uint64)
        for k in range(size):
            got[k] = np.minimum.reduceat((flat ^ _B[k]) * _A[k], at)
        out[full[a:b]] = (got >> np.uint64(32)).T
        a = b
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, root, sig): hashes of the whole set, 32 bits of the trees' first tokens, 16 of all."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = _sets(b.column("text"))
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            sig = minwise(sets, SIZE)
            hi, lo = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                hi[full] = np.add.reduceat((flat ^ _A[0]) * _B[1] ^ (flat >> np.uint64(29)), at)
                lo[full] = np.add.reduceat((flat ^ _A[1]) * (flat | np.uint64(1)), at)
            offsets = np.arange(len(sets) + 1, dtype=np.int32)
            root = pa.ListArray.from_arrays(pa.array(offsets * (2 * TREES)), pa.array(sig[:, :2 * TREES].ravel().view(np.int32)))
            every = pa.ListArray.from_arrays(pa.array(offsets * SIZE), pa.array(sig.astype(np.uint16).ravel().view(np.int16)))
            yield pa.record_batch([b.column("doc_id"), pa.array(n), pa.array(signed(hi)), pa.array(signed(lo)), root, every], ["doc_id", "n_shingles", "hi", "lo", "root", "sig"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, n_shingles long, hi long, lo long, root array<int>, sig array<smallint>")


def long_signatures(docs: DataFrame) -> DataFrame:
    """(id, sig): LONG minwise tokens of each text, 16 bits of each."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = _sets(b.column("text"))
            sig = minwise(sets, LONG)
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * LONG)
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(sig.astype(np.uint16).ravel().view(np.int16)))], ["id", "sig"])

    return map_batches(docs.select("doc_id", "text"), work, "id long, sig array<smallint>")


def only(df: DataFrame, column: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose ``column`` is (or, with left_anti, isn't) among the ids; by broadcast where they are few."""
    ids = ids.toDF("__id")
    small = ids.count() <= SENT_IDS
    return df.join(F.broadcast(ids) if small else ids, F.col(column) == F.col("__id"), how)


def by_node(kept: Kept, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with the columns of their node, for those whose node is among ``nodes`` (node, n, ...).

    Nodes of more than HEAVY rows are sent to the tasks, the largest SENT_NODES of them:
    only rows of other nodes are dealt by node, so that no task gets a large one whole.
    """
    heavy = kept.put(nodes.filter(F.col("n") > HEAVY).orderBy(F.desc("n"), "node").limit(SENT_NODES))
    if heavy.isEmpty():
        return rows.join(nodes, "node")
    hot = rows.join(F.broadcast(heavy), "node")
    rest = rows.join(F.broadcast(heavy.select("node")), "node", "left_anti").join(nodes, "node")
    return hot.unionByName(rest.select(*hot.columns))


def confirm(kept: Kept, docs: DataFrame, pairs: DataFrame, accept: Callable[[int, int], bool] = linked) -> DataFrame:
    """The pairs (a, b) whose full sets are close enough.

    Texts meet at a: its set is held while those of its partners stream by. An a
    with many partners is dealt to parts of about CHUNK, each with its own copy of
    a's text.
    """
    pairs = pairs.filter("a <> b").distinct()
    ids = kept.put(pairs.select(F.col("a").alias("i")).unionByName(pairs.select(F.col("b").alias("i"))).distinct())
    texts = only(docs, "doc_id", ids)
    parts = kept.put(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts")))
    hubs = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(texts, F.col("a") == F.col("doc_id")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    many = parts.filter("parts > 1")  # others need no join to know that they are one part
    members = pairs.join(F.broadcast(many) if many.count() <= SENT_IDS else many, "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    members = members.withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "b", "part").join(texts, F.col("b") == F.col("doc_id")).select("a", "part", "b", "text")
    met = hubs.unionByName(members).repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_of, over = [], None, None
        for rb in batches:
            a, part, b = rb.column("a").to_pylist(), rb.column("part").to_pylist(), rb.column("b").to_pylist()
            out_a, out_b = [], []
            for i, s in enumerate(_sets(rb.column("text"))):
                if b[i] is None:
                    if (a[i], part[i]) != over:
                        hub, hub_of, over = [], a[i], (a[i], part[i])
                    hub.append(s)
                elif hub_of == a[i]:
                    for h in hub:
                        small, large = (s, h) if len(s) <= len(h) else (h, s)
                        if accept(len(small), len(large)) and len(small):
                            common = np.intersect1d(small, large, assume_unique=True).size
                            if accept(common, len(s) + len(h) - common):
                                out_a.append(a[i])
                                out_b.append(b[i])
                                break
            yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return kept.put(map_batches(met, work, "a long, b long"))


def _forest(ids: np.ndarray, comp: np.ndarray, sig: np.ndarray) -> tuple[list, list]:
    """Edges between components of the heaviest forest over likely pairs (Prim's way)."""
    m = len(ids)
    best, via, free = np.full(m, -1), np.zeros(m, np.int64), np.ones(m, bool)
    a, b, v = [], [], 0
    for _ in range(m - 1):
        free[v] = False
        near = np.count_nonzero(sig == sig[v], axis=1)
        near[comp == comp[v]] = SIZE + 1
        better = free & (near > best)
        best[better], via[better] = near[better], v
        v = int(np.argmax(np.where(free, best, -2)))
        if best[v] >= LIKELY and comp[v] != comp[via[v]]:
            x, y = ids[v], ids[via[v]]
            a.append(min(x, y))
            b.append(max(x, y))
    return a, b


def _pairs_of(node_rows: DataFrame, keys: list[str], sides: bool = False, forest: bool = False, first: bool = False) -> DataFrame:
    """Likely pairs of different components within each node, from the signatures.

    Rows with side 1 are compared to all others of another component, or with
    ``sides`` only to those with side 0. ``forest``: only the edges of a heaviest
    forest. ``first``: a pair counts only in the first of the root's nodes that both
    lie in, leaving out those in the bits ``skip``.
    """
    size, likely = (SIZE, LIKELY) if forest else (LONG, LIKELY_LONG)
    met = node_rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def node(ids, comp, side, sig, *where):
            if forest:
                return _forest(ids, comp, sig)
            a, b = [], []
            for i in np.flatnonzero(side == 1).tolist():
                near = (np.count_nonzero(sig == sig[i], axis=1) >= likely) & (comp != comp[i])
                if sides:
                    near &= side == 0
                if first:
                    k, skip, root = where
                    at = np.flatnonzero(near)
                    both = (root[at] == root[i]) & ((skip[i] >> np.arange(2 * TREES)) & 1 == 0)
                    near[at[np.argmax(both, axis=1) != k[i]]] = False
                a += np.minimum(ids[near], ids[i]).tolist()
                b += np.maximum(ids[near], ids[i]).tolist()
            return a, b

        def work_on(k, cols, last):
            edge = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            starts, stops = [0, *edge.tolist()], [*edge.tolist(), len(k)]
            a, b = [], []
            n = len(starts) if last else len(starts) - 1
            for lo, hi in zip(starts[:n], stops[:n]):
                if hi - lo > 1:
                    x, y = node(*[c[lo:hi] for c in cols])
                    a += x
                    b += y
            rest = None if last else (k[starts[-1]:], [c[starts[-1]:] for c in cols])
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]), rest

        for rb in batches:
            if not rb.num_rows:
                continue
            k = np.stack([rb.column(c).to_numpy(zero_copy_only=False) for c in keys], axis=1)
            cols = [rb.column("id").to_numpy(), rb.column("comp").to_numpy(), rb.column("side").to_numpy(), rb.column("sig").flatten().to_numpy().reshape(-1, size)]
            if first:
                cols += [rb.column("k").to_numpy(), rb.column("skip").to_numpy(), rb.column("root").flatten().to_numpy().reshape(-1, 2 * TREES)]
            if held:
                k, cols = np.concatenate([held[0], k]), [np.concatenate(x) for x in zip(held[1], cols)]
            out, held = work_on(k, cols, False)
            yield out
        if held:
            yield work_on(*held, True)[0]

    return map_batches(met, work, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    kept = Kept(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    every = kept.put(signatures(docs, "doc_id", "text"))
    full = every.filter("n_shingles > 0")
    classes = kept.put(full.groupBy("hi", "lo").agg(F.min("doc_id").alias("id")))
    alone = classes.select("id").filter("id is not null")
    sigs = kept.put(full.join(alone, full.doc_id == alone.id, "left_semi").select(F.col("doc_id").alias("id"), "root", "sig"))

    # first level: two tokens of each tree's root
    child = F.explode(F.array(*[F.struct(F.xxhash64(F.lit(k), F.col("root")[k]).alias("node"), F.lit(k).alias("k")) for k in range(2 * TREES)]))
    rows = kept.put(sigs.select(child.alias("c"), "id").select("c.node", "c.k", "id"))
    sizes = kept.put(rows.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    live = kept.put(by_node(kept, rows, sizes).select("node", "k", "id", "least", "n"))
    kept.drop(rows, sizes)
    dense = confirm(kept, docs, live.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")))

    def labelled(r: DataFrame, links: DataFrame) -> DataFrame:
        """``r`` with comp, from the components of the links so far."""
        comp = components(kept, links)
        return r.join(comp.select("id", "root"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")

    def mixed(r: DataFrame) -> DataFrame:
        """Rows of nodes with more than one component, with the node's size."""
        r = kept.put(r)
        n = r.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("comp", "c").alias("major"), F.count(F.lit(1)).alias("comps"))
        n = kept.put(n.filter("comps > 1").drop("comps"))
        out = kept.put(by_node(kept, r, n))
        kept.drop(r)
        return out

    tokens = sigs.select("id", "sig")
    apart = mixed(labelled(live.filter("n > 2").select("node", "k", "id"), dense))
    parts = apart.join(tokens, "id").withColumn("side", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / FOREST)).cast("int"))
    heavy = confirm(kept, docs, _pairs_of(parts, ["node", "side"], forest=True))
    dense = kept.put(dense.unionByName(heavy))
    at, found = mixed(labelled(apart.select("node", "k", "id"), dense)), []
    few = F.col("n") - F.col("most") <= LIMIT
    longer = kept.put(long_signatures(only(docs, "doc_id", at.select("id").distinct())).groupBy("id").agg(F.first("sig").alias("sig")))
    skip = at.filter(~few).groupBy("id").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("skip"))
    at = kept.put(at.join(skip, "id", "left").withColumn("skip", F.coalesce("skip", F.lit(0))).join(sigs.select("id", "root"), "id").join(longer, "id"))
    for depth in range(DEPTH + 1):
        if at.isEmpty():
            break
        parts, minor = F.ceil(F.col("n") / FOREST).cast("int"), F.col("comp") != F.col("major")
        # those outside the largest component go to every part of it
        dealt = at.filter(few).withColumn("part", F.explode(F.when(minor, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), parts).cast("int")))))
        found.append(kept.put(_pairs_of(dealt.withColumn("side", minor.cast("int")), ["node", "part"], first=depth == 0).distinct()))
        large = at.filter(~few)
        if depth == DEPTH:
            # each pair of blocks of a node meets once
            blocks = F.ceil(F.col("n") * 2 / LIMIT).cast("int")
            cut = large.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            cut = cut.select("node", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "comp", "sig", "own", "other")
            across = _pairs_of(cut.filter("own <> other").drop("own", "other"), ["node", "x", "y"], sides=True)
            within = _pairs_of(cut.filter("own = other").drop("own", "other").withColumn("side", F.lit(1)), ["node", "x", "y"])
            found.append(kept.put(across.unionByName(within).distinct()))
            break
        child = F.explode(F.array(*[F.struct(F.pmod(F.xxhash64("node", F.lit(j)), F.lit(LONG)).cast("int").alias("k"), F.lit(j).alias("j")) for j in (0, 1)]))
        split = large.withColumn("c", child).select(F.xxhash64("node", "c.j", F.get("sig", F.col("c.k"))).alias("node"), "id", "comp", "sig")
        at = mixed(split)

    links = dense
    if found:
        more = found[0]
        for x in found[1:]:
            more = more.unionByName(x)
        links = dense.unionByName(confirm(kept, docs, more))
    comp = components(kept, links)
    ends = classes.join(comp, "id", "left").select("hi", "lo", F.coalesce("root", "id").alias("component_id"))
    out = full.select("doc_id", "n_shingles", "hi", "lo").join(ends, ["hi", "lo"], "left").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(every.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stands for its component, all columns as they were."""
    kept = Kept(docs.sparkSession)
    gone = kept.put(near_duplicates(docs).filter("not kept and doc_id is not null").select("doc_id").distinct())
    return only(docs, "doc_id", gone, "left_anti")
