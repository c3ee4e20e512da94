"""Quality rules whose thresholds follow the corpus.

Each text gets a few ratios. Mergeable quantile sketches (KLL) of every ratio are
kept for each language and source, merged up to the language and to the corpus, and
read as fences. Rubbish that is more than the sketch's rank error (1.5 %) shows as a
valley: from the median up, the first two neighbouring quantiles of which the upper is
``VALLEY`` times the lower; the fence stands between them, at their geometric mean.
Without a valley it stands beyond the tail: the 0.995 quantile plus its distance from
the median. Nothing else is fixed but the resolution of a ratio: one event in a text of
median length, which is added to both quantiles of a valley and, four times, to a tail.
A fence is a mean of the group's own and its language's, by rows against ``PRIOR``
rows, and the language's one of its own and the corpus's; so small groups lean on
larger ones without a switch. A group's fence is never wider than ``slack`` times its
language's, so that a source of nothing but rubbish doesn't pass for normal. Rows
beyond a fence are rejected.

Null texts count as empty (and fail the base rule); null lang and source are groups
of their own. Rows are judged one by one, so repeated rows and ids keep their places.
An empty table gives no rows. Whatever other columns the input has pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Kept, Words, line_hashes, line_spans, map_batches, row_and, utf8, windows

#: Each ratio and the count that it is a share of.
RATIOS = {"symbol_ratio": "n_words", "dup_line_ratio": "n_lines", "repeat_ratio": "n_words", "word_length": None, "word_brevity": None, "pipe_ratio": "n_words", "capital_ratio": "n_letters"}
VALLEY, SLACK, PRIOR = 4.0, 2.0, 200
#: Ranks between which a valley is looked for, and the tail's.
RANKS = [0.5 + k / 200 for k in range(98)]
TAIL = 0.995
#: Groups up to this many go to the tasks whole (some 20 MB); more are joined by shuffle.
SENT_GROUPS = 50_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_pipes", "n_capitals", "n_letters"]


def _line_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each line that has a word, over its exact bytes, and where it starts."""
    starts, ends = line_spans(words.data, words.offsets)
    full = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[full], ends[full]
    return line_hashes(words.data, starts, ends), starts


def _repeats(hashes: np.ndarray, size: int = 3) -> int:
    """Words that stand in some window of ``size`` words found twice or more."""
    every = windows(hashes, size)
    if len(every) < 2:
        return 0
    order = np.argsort(every, kind="stable")
    s = every[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    if not twice.any():
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = order[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def measure(column: pa.Array) -> list[np.ndarray]:
    """The counts named in _NAMES of every text of an Arrow column."""
    data, offsets = utf8(column)
    w = Words(data, offsets, lower=False)
    n = len(offsets) - 1
    first = w.first

    def per_text(flag: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flag, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    # code points of words: bytes that begin one and aren't white space
    inside = (data & 0xC0) != 0x80
    space = per_text((data == 32) | ((data >= 9) & (data <= 13)))
    upper = (data >= 65) & (data <= 90)
    lines, starts = _line_hashes(w)
    cut = np.searchsorted(starts, offsets)
    dup, rep, full = np.zeros(n, np.int64), np.zeros(n, np.int64), np.diff(cut)
    for i in range(n):
        if full[i] > 1:
            dup[i] = full[i] - len(np.unique(lines[cut[i]:cut[i + 1]]))
        if first[i + 1] - first[i] > 3:
            rep[i] = _repeats(w.hash[first[i]:first[i + 1]])
    lone = (w.end - w.start == 1)
    pipes = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(lone & (data[w.start] == 124) if len(w.start) else lone, out=pipes[1:])
    return [np.diff(first), per_text(inside) - space, per_text(_SYMBOL[data]), dup, rep, full, pipes[first[1:]] - pipes[first[:-1]], per_text(upper), per_text(upper | ((data >= 97) & (data <= 122)))]


def with_features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep`` of it) with a struct column q of those counts."""
    keep = docs.columns if keep is None else keep
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kind = pa.struct([(x, pa.int64()) for x in _NAMES])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [pa.array(x, pa.int64()) for x in measure(b.column("text"))]
            yield pa.record_batch([b.column("row"), pa.StructArray.from_arrays(cols, fields=list(kind))], ["row", "q"])

    return map_batches(src, work, row_and(src, q=T.StructType([T.StructField(x, T.LongType()) for x in _NAMES])))


def ratios() -> dict:
    words, letters = F.greatest(F.col("q.n_words"), F.lit(1)), F.greatest(F.col("q.n_letters"), F.lit(1))
    return {
        "symbol_ratio": F.col("q.n_symbols") / words, "dup_line_ratio": F.col("q.n_dup_lines") / F.greatest(F.col("q.n_lines"), F.lit(1)),
        "repeat_ratio": F.col("q.n_repeat_words") / words, "word_length": F.col("q.word_chars") / words, "word_brevity": words / F.greatest(F.col("q.word_chars"), F.lit(1)),
        "pipe_ratio": F.col("q.n_pipes") / words, "capital_ratio": F.col("q.n_capitals") / letters,
    }


def base_failed():
    return (F.col("q.n_words") < 50) | (F.lit(100) * F.col("q.n_repeat_words") > F.lit(50) * F.col("q.n_words"))


def fence(sketch: str, resolution) -> Column:
    """The fence that a sketch of one ratio shows."""
    q = F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, RANKS)))
    tail, middle = F.kll_sketch_get_quantile_double(sketch, F.lit(TAIL)), F.kll_sketch_get_quantile_double(sketch, F.lit(0.5))

    def at(i):
        return F.element_at(q, i) + resolution

    steps = F.filter(F.sequence(F.lit(1), F.lit(len(RANKS) - 1)), lambda i: at(i + 1) >= VALLEY * at(i))
    first = F.get(steps, F.lit(0))
    return F.when(F.size(steps) > 0, F.sqrt(at(first) * at(first + 1)) - resolution).otherwise(2 * tail - middle + 4 * resolution)


def fences(kept: Kept, features: DataFrame) -> DataFrame:
    """(lang, source, f_<ratio>...) for each group, from one pass of partial sketches.

    ``features`` has lang, source and q. Only rows that pass the base rule count: a
    quantile should describe texts that may stay.
    """
    r, sizes = ratios(), sorted({x for x in RATIOS.values() if x})
    good = features.filter(~base_failed())
    rows = good.select("lang", "source", *[v.cast("double").alias(k) for k, v in r.items()], *[F.col(f"q.{x}").cast("double").alias(x) for x in sizes])
    groups = kept.put(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(k).alias(k) for k in [*r, *sizes]]))

    def merged(df, keys):
        return df.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(k).alias(k) for k in [*r, *sizes]])

    by_lang = kept.put(merged(groups, ["lang"]))
    corpus = merged(by_lang, []).filter("n > 0")  # a sketch of nothing has no quantiles
    one = {x: F.kll_sketch_get_quantile_double(x, F.lit(0.5)) for x in sizes}
    unit = {k: 1 / F.greatest(one[x], F.lit(1.0)) if (x := RATIOS[k]) else F.lit(0.0) for k in r}
    whole = kept.put(corpus.select(*[unit[k].alias(f"r_{k}") for k in r], *[fence(k, unit[k]).alias(f"w_{k}") for k in r]))  # one row

    def leaning(n, own, up):
        return (n * own + PRIOR * up) / (n + PRIOR)

    langs = by_lang.crossJoin(F.broadcast(whole))
    langs = langs.select(F.col("lang").alias("__l"), *[f"r_{k}" for k in r], *[leaning(F.col("n"), fence(k, F.col(f"r_{k}")), F.col(f"w_{k}")).alias(f"l_{k}") for k in r])
    j = groups.join(kept.put(langs), F.col("lang").eqNullSafe(F.col("__l")))
    return kept.put(j.select("lang", "source", *[F.least(leaning(F.col("n"), fence(k, F.col(f"r_{k}")), F.col(f"l_{k}")), SLACK * F.col(f"l_{k}")).alias(f"f_{k}") for k in r]))


def judged(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(row, q, base_failed, rejected_by, kept): ``row`` holds the input columns ``keep``.

    One pass over the texts: the counts are written beside the columns that stay, and
    read for the fences and again for the verdicts.
    """
    kept = Kept(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    src = docs.select("*", F.col(f"`{lang_col}`").cast("string").alias("__l"), F.col(f"`{source_col}`").cast("string").alias("__s"))
    rows = kept.put(with_features(src, text_col, keep=[*dict.fromkeys([*keep, "__l", "__s"])]))
    limits = fences(kept, rows.select(F.col("row.__l").alias("lang"), F.col("row.__s").alias("source"), "q"))
    names = {k: f"f_{k}" for k in ratios()}
    side = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *names.values())
    if limits.count() <= SENT_GROUPS:
        side = F.broadcast(side)
    j = rows.join(side, F.col("row.__l").eqNullSafe(F.col("__lang")) & F.col("row.__s").eqNullSafe(F.col("__source")), "left")
    over = F.array_compact(F.array(*[F.when(v > F.col(names[k]), F.lit(k)) for k, v in ratios().items()]))
    out = F.struct(*[F.col(f"row.`{c}`").alias(c) for c in keep]).alias("row")
    return j.select(out, "q", base_failed().alias("base_failed"), over.alias("rejected_by")).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were."""
    return judged(docs).filter("kept").select("row.*")
