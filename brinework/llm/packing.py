"""Best-fit packing of documents into sequences, with conflicts.

A document of ``tokens`` takes pieces of at most ``capacity``: full ones, and a
rest. A bin takes pieces up to its capacity, but no two documents of one source
(``one_per_source``) and no two of one duplicate cluster. Open bins stand in order
of what they have left; each carries a bitmap of its sources and one of its clusters.
A piece, longest first, goes to the tightest bin that it fits and whose bitmaps don't
meet its own; the search goes on to the next larger residual until it finds one, and
opens a bin where there is none.

Rows are dealt by a hash of id and piece to groups of about ``group_rows`` pieces,
packed by one task each; a source or cluster however hot is dealt over all groups.
Each group leaves at most its last open bins unfilled.

Null and empty texts have no tokens and no pieces, so no rows; a null source or
cluster meets no conflict. Repeated rows are packed as often as they stand. Other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY, GROUP_ROWS = 2048, 20_000


def tokens_by_bytes(text: str = "text") -> Column:
    """A quarter of the UTF-8 bytes, rounded up: the usual size of byte-pair tokens."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / F.lit(4)).cast("long")


class Bins:
    """Open bins by residual; bins of one residual by their source bitmap.

    ``having`` counts the open bins of each residual that hold a source or cluster, so
    that residuals at which all bins conflict are passed over without a look at them.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.by_left: list[dict[int, dict[int, None]]] = [{} for _ in range(capacity + 1)]
        self.total = np.zeros(capacity + 1, np.int64)
        self.having: tuple[dict[int, dict[int, int]], dict[int, dict[int, int]]] = ({}, {})

    def _count(self, bin_: int, by: int) -> None:
        left = self.left[bin_]
        self.total[left] += by
        for bits, having in zip((self.sources[bin_], self.clusters[bin_]), self.having):
            while bits:
                low = bits & -bits
                held = having.setdefault(low, {})
                held[left] = held.get(left, 0) + by
                if not held[left]:
                    del held[left]
                bits ^= low

    def _out(self, bin_: int) -> None:
        self._count(bin_, -1)
        same = self.by_left[self.left[bin_]]
        del same[self.sources[bin_]][bin_]
        if not same[self.sources[bin_]]:
            del same[self.sources[bin_]]

    def _in(self, bin_: int) -> None:
        self._count(bin_, 1)
        self.by_left[self.left[bin_]].setdefault(self.sources[bin_], {})[bin_] = None

    def tightest(self, need: int, source: int, cluster: int) -> int | None:
        free = self.total > 0
        for own, having in zip((source, cluster), self.having):
            for left, n in having.get(own, {}).items():
                free[left] &= n < self.total[left]
        for r in np.flatnonzero(free[need:]).tolist():
            for bits, bins in self.by_left[need + r].items():
                if not bits & source:
                    for b in bins:
                        if not self.clusters[b] & cluster:
                            return b
        return None

    def add(self, need: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin that takes the piece, and where in it the piece begins."""
        b = self.tightest(need, source, cluster)
        if b is None:
            b = len(self.left)
            self.left.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._out(b)
        at = self.capacity - self.left[b]
        self.left[b] -= need
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if self.left[b]:
            self._in(b)
        return b, at


def _bits(values: list) -> list[int]:
    """A bit for each value that stands more than once; others can't conflict."""
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    bit = {v: 1 << i for i, v in enumerate(v for v, n in seen.items() if n > 1 and v is not None)}
    return [bit.get(v, 0) for v in values]


def pack(docs: DataFrame, tokens: Column, cluster: Column | None = None, source: Column | None = None, id_col: str = "doc_id", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, piece, n_tokens, group, bin, at): where each piece lies.

    ``bin`` is unique over all groups; ``piece`` k of a document covers its tokens
    from k * capacity. Texts are not shuffled, only lengths and the two keys.
    """
    def key(c: Column | None) -> Column:
        return F.lit(None).cast("long") if c is None else F.when(c.isNotNull(), F.xxhash64(c))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), tokens.cast("long").alias("n"), key(source).alias("source"), key(cluster).alias("cluster")).filter("n > 0")
    cut = F.lit(capacity)
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("n") - 1, cut).cast("long"))))
    pieces = pieces.select("doc_id", "piece", F.least(F.col("n") - F.col("piece") * cut, cut).alias("n_tokens"), "source", "cluster")
    total = docs.select(F.sum(F.ceil(tokens / cut))).first()[0] or 0
    groups = max(1, -(-int(total) // group_rows))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(groups)).cast("int"))

    def work(table: pa.Table) -> pa.Table:
        t = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins = Bins(capacity)
        need, src, clu = t["n_tokens"].to_pylist(), _bits(t["source"].to_pylist()), _bits(t["cluster"].to_pylist())
        put = [bins.add(*x) for x in zip(need, src, clu)]
        group = t["group"].to_numpy().astype(np.int64)
        return pa.table({"doc_id": t["doc_id"], "piece": t["piece"], "n_tokens": t["n_tokens"], "group": t["group"], "bin": pa.array(group * (1 << 32) + np.array([b for b, _ in put], np.int64)), "at": pa.array([a for _, a in put], pa.int64())})

    return dealt.groupBy("group").applyInArrow(work, "doc_id long, piece long, n_tokens long, group int, bin long, at long")
