"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact verification.

Texts and items are sequences of lower-cased words without punctuation. A text is
contaminated by an item of n words if some stretch of it lies within n // 5 word
edits of the item.

The CGK walk reads a sequence from the left: step j puts out the word under the
pointer and moves the pointer by a random bit of (walk, j, word). Two sequences few
edits apart fall into step again soon, so most of their outputs agree. Every stretch
of a text that may hold an item is walked from its first word, several times with
other bits; from each walk ``TABLES`` keys of ``BITS`` sampled outputs are looked up
among the items' keys, sampled from the first 2 * n steps of the items' size class.
How many walks a size class needs is found when its index is built: random sequences
of its largest size with all n // 5 edits used up are walked until ``RECALL`` of them
meet in a table. What meets is verified by bit-parallel edit distance against the
text, so results are exact but for items that no table finds. Items of fewer than
``SHORT`` words allow no edit and are found exactly, by the hash of their words.

Before that, positions are left out at which a match can't begin: an edit breaks two
pairs of neighbouring words, so one within e edits keeps n - 1 - 2 * e of the item's
pairs within n + e words of the text. Pairs known to the benchmark are counted there
(by a bit table, whose false hits only cost work).

The items are a stated query set: a hash deals them to blocks of about ``BLOCK``, a task
builds each block's index, and the driver sends one after the other to the tasks, a
pass over the texts for each; where there are more than one, a pass is written before
the next index is fetched. Null and empty texts and items hold nothing; equal items
are reported under each id, repeated rows of items once, repeated rows of texts as
often as they stand. Other columns are not looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import PUNCTUATION, Kept, Words, map_batches, mix, row_and, seeds, utf8, windows

SHORT, TABLES, BITS, BLOCK = 5, 12, 3, 8000
#: The share of items with all edits used up that the tables must find, and the pairs it is measured on.
RECALL, TRIED = 0.99, 400
#: Words of the shortest item for which ``clean`` drops a text; fewer are too common to speak of contamination.
TELLING = 5
_PAIRS = 24
_PAD = np.uint64(0x5851F42D4C957F2D)


def edits(n):
    return n // 5


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = Words(*utf8(column), lower=True, apart=PUNCTUATION)
    return w.hash, w.first


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and any stretch of the text, and where that ends.

    Myers' bit-parallel search, the column of the item's prefixes in one integer.
    """
    m = len(item)
    peq: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text.tolist()):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def walk(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: np.uint64, steps: list[int]) -> dict[int, np.ndarray]:
    """The CGK outputs at the given steps of the sequences words[starts:ends]."""
    out, at, wanted = {}, starts.copy(), set(steps)
    padded = np.append(words, _PAD)
    bit_of_step = seeds(steps[-1] + 1, int(salt) & 0xFFFFFFFF)
    last = len(words)
    for j in range(steps[-1] + 1):
        w = padded[np.where(at < ends, at, last)]
        if j in wanted:
            out[j] = w
        at += (((w ^ salt) * bit_of_step[j]) >> np.uint64(63)).astype(np.int64)
    return out


def sampled_steps(size: int, walks: int) -> list[list[int]]:
    """The steps of each table, those of one walk after another."""
    rng = np.random.default_rng(17)
    return [sorted(rng.choice(2 * size, BITS, replace=False).tolist()) for _ in range(walks * TABLES)]


def salts(walks: int) -> np.ndarray:
    return seeds(1024, 41)[:walks]


@cache
def walks_for(least: int, most: int, recall: float = RECALL) -> int:
    """Walks after which that share of random items of ``most`` words, edited to the limit, has met its copy."""
    rng = np.random.default_rng(most)
    pairs = []
    for _ in range(TRIED):
        item = rng.integers(1, 1 << 62, most).tolist()
        copy = list(item)
        for _ in range(edits(most)):
            at, how = int(rng.integers(len(copy))), rng.integers(3)
            copy[at:at + 1] = [[int(rng.integers(1, 1 << 62))], [copy[at], int(rng.integers(1, 1 << 62))], []][how]
        pairs.append((item, copy + rng.integers(1, 1 << 62, most).tolist()))  # the text goes on
    flat = [np.concatenate([np.array(p[k], np.uint64) for p in pairs]) for k in (0, 1)]
    ends = [np.cumsum([len(p[k]) for p in pairs]) for k in (0, 1)]
    starts = [e - [len(p[k]) for p in pairs] for k, e in enumerate(ends)]
    met, every = np.zeros(TRIED, bool), sampled_steps(least, 256)
    for w, salt in enumerate(salts(256)):
        own = every[w * TABLES:(w + 1) * TABLES]
        steps = sorted({j for s in own for j in s})
        a, b = (walk(flat[k], starts[k], ends[k], salt, steps) for k in (0, 1))
        for s in own:
            met |= np.all([a[j] == b[j] for j in s], axis=0)
        if met.mean() >= recall:
            return w + 1
    return 256


class Index:
    """The keys of a block of items, by size class."""

    def __init__(self, ids: list[int], items: list[np.ndarray]):
        self.ids, self.items = ids, items
        sizes = np.array([len(x) for x in items], np.int64)
        #: For each size below SHORT the items' hashes, in order, and the items.
        self.short: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in range(1, SHORT):
            own = np.flatnonzero(sizes == n)
            if len(own):
                h = np.array([windows(items[i], n)[0] for i in own], np.uint64)
                self.short.append((n, np.sort(h), own[np.argsort(h, kind="stable")]))
        self.sizes = np.unique(sizes[sizes >= SHORT])
        known = np.zeros(1 << _PAIRS, bool)
        for x in items:
            if len(x) >= SHORT:
                known[self.slots(x)] = True
        self.known = np.packbits(known, bitorder="little")
        # classes of sizes within a half of each other share their sampled steps
        self.classes: list[tuple[int, int]] = []
        for n in self.sizes.tolist():
            if not self.classes or n >= self.classes[-1][0] * 1.5:
                self.classes.append((n, n))
            self.classes[-1] = (self.classes[-1][0], n)
        self.walks = [walks_for(lo, hi) for lo, hi in self.classes]
        self.salts = salts(max(self.walks, default=0))
        self.steps = [sampled_steps(lo, walks) for (lo, _), walks in zip(self.classes, self.walks)]
        self.needed = [sorted({j for c in range(len(self.classes)) for t in self.tables(c, w) for j in self.steps[c][t]}) for w in range(len(self.salts))]
        self.keys, self.owner = [], []
        self.mult = seeds(BITS, 43)
        if not items:
            return
        flat = np.concatenate(items)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        for c, (lo, hi) in enumerate(self.classes):
            own = np.flatnonzero((sizes >= lo) & (sizes <= hi))
            keys, owner = [], []
            for w in range(self.walks[c]):
                out = walk(flat, starts[own], ends[own], self.salts[w], self.needed[w])
                for t in self.tables(c, w):
                    keys.append(self.key(out, c, t))
                    owner.append(own)
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.owner.append(owner[order])

    def tables(self, c: int, w: int) -> range:
        """The tables of walk w in class c: none where the class needs fewer walks."""
        return range(w * TABLES, (w + 1) * TABLES) if w < self.walks[c] else range(0)

    def key(self, out: dict[int, np.ndarray], c: int, t: int) -> np.ndarray:
        k = np.full(len(out[self.steps[c][t][0]]), t + 1, np.uint64)
        for b, j in enumerate(self.steps[c][t]):
            k = k + out[j] * self.mult[b]
        return mix(k)

    @staticmethod
    def slots(words: np.ndarray) -> np.ndarray:
        return (windows(words, 2) >> np.uint64(64 - _PAIRS)).astype(np.int64)

    def places(self, words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each class, the positions at which an item of it may begin."""
        n = max(0, len(words) - 1)
        sums = np.zeros(n + 1, np.int32)
        slots = self.slots(words)
        np.cumsum(self.known[slots >> 3] >> (slots & 7).astype(np.uint8) & 1, out=sums[1:])
        out = []
        for lo, hi in self.classes:
            may = np.zeros(n, bool)
            for size in self.sizes[(self.sizes >= lo) & (self.sizes <= hi)].tolist():
                e = edits(size)
                reach = min(n, size + e - 1)  # over a text's end counts too much, which is safe
                have = np.empty(n, np.int32)
                have[:n - reach + 1] = sums[reach:] - sums[:n - reach + 1]
                have[n - reach + 1:] = sums[n] - sums[n - reach + 1:n]
                may |= have >= size - 1 - 2 * e
            out.append(np.flatnonzero(may))
        return out

    def candidates(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) pairs that some table brings together, distinct, by position."""
        places = self.places(words, first)
        starts = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
        found_at, found = [], []
        for lo in range(0, len(starts), 1 << 16):
            part = starts[lo:lo + (1 << 16)]
            ends = first[np.searchsorted(first, part, "right")]
            mine = [np.isin(part, p, assume_unique=True) for p in places]
            for w in range(len(self.salts)):
                out = walk(words, part, ends, self.salts[w], self.needed[w])
                for c in range(len(self.classes)):
                    rows = np.flatnonzero(mine[c])
                    if not len(rows):
                        continue
                    own = {j: out[j][rows] for t in self.tables(c, w) for j in self.steps[c][t]}
                    for t in self.tables(c, w):
                        k = self.key(own, c, t)
                        left = np.searchsorted(self.keys[c], k, "left")
                        hit = np.flatnonzero(self.keys[c][np.minimum(left, len(self.keys[c]) - 1)] == k)
                        if len(hit):
                            right = np.searchsorted(self.keys[c], k[hit], "right")
                            many = right - left[hit]
                            at = np.repeat(part[rows[hit]], many)
                            run = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                            found_at.append(at)
                            found.append(self.owner[c][np.repeat(left[hit], many) + run])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(found_at) * len(self.items) + np.concatenate(found))
        return both // len(self.items), both % len(self.items)

    def matches(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, first word) of the best match of each pair within its edits."""
        at, item = self.candidates(words, first)
        text = np.searchsorted(first, at, "right") - 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        last: dict[tuple[int, int], int] = {}
        for p, i, t in zip(at.tolist(), item.tolist(), text.tolist()):
            e = edits(n := len(self.items[i]))
            # the region searched before covers this start too
            if p - last.get((t, i), -1 << 40) <= e or best.get((t, i), (1,))[0] == 0:
                continue
            last[t, i] = p
            lo, hi = max(first[t], p - e), min(first[t + 1], p + n + 2 * e)
            d, end = best_match(self.items[i], words[lo:hi])
            if d <= e and d < best.get((t, i), (1 << 40,))[0]:
                best[t, i] = d, int(lo + end - n - first[t])
        for n, hashes, owner in self.short:
            at = np.arange(max(0, len(words) - n + 1))
            text = np.searchsorted(first, at, "right") - 1
            h = windows(words, n)
            left, right = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            # a window over a text's end is none of its
            for k in np.flatnonzero((right > left) & (at + n <= first[text + 1])).tolist():
                for i in owner[left[k]:right[k]].tolist():
                    best.setdefault((int(text[k]), i), (0, int(at[k] - first[text[k]])))
        return [(t, i, d, max(0, s)) for (t, i), (d, s) in best.items()]


def indexes(kept: Kept, items: DataFrame, id_col: str = "item_id", text_col: str = "text", least: int = 1) -> tuple[DataFrame, int]:
    """(block, index) rows, an index of about BLOCK items in each, and how many there are."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.lower(text_col).alias("t")).filter("t is not null").distinct()
    blocks = -(-rows.count() // BLOCK)

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by([("i", "ascending"), ("t", "ascending")])
        h, first = word_hashes(part["t"].combine_chunks() if part["t"].num_chunks != 1 else part["t"].chunk(0))
        some = [k for k in range(part.num_rows) if first[k + 1] - first[k] >= least]
        ids = part["i"].to_pylist()
        made = Index([ids[k] for k in some], [h[first[k]:first[k + 1]] for k in some])
        return pa.table({"block": part["block"][:1], "index": pa.array([pickle.dumps(made)], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(max(1, blocks))).cast("int"))
    return kept.put(dealt.groupBy("block").applyInArrow(build, "block int, index binary")), blocks


def sent_indexes(kept: Kept, items: DataFrame, item_col: str, least: int = 1) -> Iterator[tuple[Broadcast, bool]]:
    """Each block's index, sent to the tasks, and whether others follow or came before."""
    made, blocks = indexes(kept, items, item_col, least=least)
    for k in range(blocks):
        for r in made.filter(F.col("block") == k).collect():  # one row
            yield kept.spark.sparkContext.broadcast(bytes(r["index"])), blocks > 1


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_edits, item_words, start_word): one row for each text and item it holds.

    start_word is where an item's length before the end of its best match begins.
    """
    spark, schema = docs.sparkSession, "doc_id long, item_id long, n_edits int, item_words int, start_word long"
    kept = Kept(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_col).alias("text"))
    out = spark.range(0).selectExpr("id as doc_id", "id as item_id", "cast(id as int) as n_edits", "cast(id as int) as item_words", "id as start_word")
    for sent, several in sent_indexes(kept, items, item_col):
        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ix = pickle.loads(sent.value)
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                got = ix.matches(*word_hashes(b.column("text")))
                yield pa.record_batch([
                    pa.array([ids[t] for t, *_ in got], pa.int64()), pa.array([ix.ids[i] for _, i, *_ in got], pa.int64()), pa.array([d for _, _, d, _ in got], pa.int32()),
                    pa.array([len(ix.items[i]) for _, i, *_ in got], pa.int32()), pa.array([s for *_, s in got], pa.int64()),
                ], ["doc_id", "item_id", "n_edits", "item_words", "start_word"])

        found = map_batches(rows, work, schema)
        if several:
            found = kept.put(found)
            sent.destroy()
        out = out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", telling: int = TELLING) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``telling`` words or more, all columns as they were."""
    kept = Kept(docs.sparkSession)
    for sent, several in sent_indexes(kept, items, item_col, telling):
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lower(F.col(f"`{text_col}`")).alias("text"))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ix = pickle.loads(sent.value)
            for b in batches:
                bad = {t for t, *_ in ix.matches(*word_hashes(b.column("text")))}
                yield pa.record_batch([b.column("row").filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))], ["row"])

        left = map_batches(rows, work, row_and(rows)).select("row.*")
        if several:
            left, before = kept.put(left), docs
            sent.destroy()
            kept.drop(before)
        docs = left
    return docs
