"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (one to three letters, a
boundary sign around words) in order. A text's own most frequent n-grams are
compared to each profile: every n-gram costs the distance between its two ranks, or
the most there is where the profile lacks it; the language with the least sum wins.

Profiles count all n-grams of all training texts: partial counts by task, sums by
shuffle, the top of each language by a window. Only the profiles go to the tasks
(languages x ``size`` rows).

Texts that are null or have no letters are ``und`` with score 0. Rows with a null
language teach nothing. Ties of counts go to the smaller n-gram, ties of distance
to the first language by name. Without profiles everything is ``und``. Repeated
rows count as often as they stand; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import map_batches

SIZE = 400
_FLUSH = 200_000


def _letters() -> np.ndarray:
    """Whether each code point is a letter; made once in a process."""
    if not hasattr(_letters, "table"):
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _letters.table = table
    return _letters.table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as numbers, and how often each stands there."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, 0)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)  # one boundary sign between words
    p = np.concatenate([[0], points[keep], [0]]).astype(np.uint64)
    if not p.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = p[:-1] | p[1:] << np.uint64(21)
    three = two[:-1] | p[2:] << np.uint64(42)
    inner = two[:-1] != 0
    every = np.concatenate([p[p != 0], two[two != 0], three[inner & (p[1:-1] != 0)]])
    codes, counts = np.unique(every, return_counts=True)
    return codes.view(np.int64), counts


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, in order; equal counts by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        at = counts >= least
        codes, counts = codes[at], counts[at]
    return codes[np.lexsort((codes, -counts))][:size]


def profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = SIZE) -> dict[str, np.ndarray]:
    """Each language's ranked n-grams, from every row with a language and a text."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))

        def flush(lang):
            codes, at = np.unique(np.concatenate(tally[lang][0]), return_inverse=True)
            n = np.bincount(at, np.concatenate(tally[lang][1])).astype(np.int64)
            tally[lang] = ([codes], [n])

        def out():
            for lang in tally:
                flush(lang)
                codes, n = tally[lang][0][0], tally[lang][1][0]
                yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])
            tally.clear()

        held: dict[str, int] = defaultdict(int)
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                codes, n = grams(text)
                if len(codes):
                    tally[lang][0].append(codes)
                    tally[lang][1].append(n)
                    held[lang] += len(codes)
                    if held[lang] > 10 * _FLUSH:
                        flush(lang)
                        held[lang] = len(tally[lang][0][0])
            if sum(len(x[0]) for t in tally.values() for x in zip(t[0])) > 40 * _FLUSH:
                yield from out()
                held.clear()
        yield from out()

    counts = map_batches(rows, work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram")))).filter(F.col("rank") <= size)
    found = top.select("lang", "gram", "rank").toPandas().sort_values(["lang", "rank"])
    return {str(k): g["gram"].to_numpy(np.int64) for k, g in found.groupby("lang")}


class Nearest:
    """Distance of a ranked list of n-grams to each profile."""

    def __init__(self, known: dict[str, np.ndarray], size: int):
        self.langs, self.size = sorted(known), size
        self.codes = np.unique(np.concatenate([known[x] for x in self.langs])) if known else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, known[lang])] = np.arange(len(known[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text) if text else ((), ())
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        ranks = self.ranks[:, at]
        cost = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))), self.size)).sum(axis=1)
        best = int(np.argmin(cost))
        return self.langs[best], float(1 - cost[best] / (self.size * len(own)))


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, lang_pred, score): score is 1 less the distance's share of the most possible."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(known, size)
        for b in batches:
            got = [near(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, lang_pred string, score double")
