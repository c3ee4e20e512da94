"""What the operators of this subpackage share: places for cut lineage, batches, word hashes.

Word and shingle hashes are 64-bit numbers computed with numpy over the UTF-8
bytes of an Arrow batch, so that no Python object is made for a word.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
BLOCK_BYTES = 1 << 18


# --- lineage -------------------------------------------------------------

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/brinework"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="brinework-"))
    return shared_dir(spark)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that operators put to the shared folder within it.

    For a caller that has written an operator's result elsewhere by then::

        with scratch(spark):
            line_dedup.drop_repeated(docs).write.parquet(path)
    """
    paths: list[str] = []
    outer = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(outer)
        for path in paths:
            drop_path(spark, path)


class Kept:
    """Tables written to the shared folder in place of a long lineage.

    ``put`` writes a frame as Parquet and rereads it; ``drop`` deletes what an
    iteration has left behind. What a returned frame still reads goes with the
    ``scratch`` around it, or when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        # the frame is held beside its path, so that no other can take its id
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def put(self, df: DataFrame, aside: bool = True) -> DataFrame:
        """``df`` as written; with ``aside`` false it outlives the ``scratch`` around it."""
        path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        written = _written.get()
        if aside and written is not None:
            written.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        atexit.register(_quietly, drop_path, self.spark, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _, path = self.paths.pop(id(df), (None, None))
            if path:
                drop_path(self.spark, path)


def _quietly(f: Callable, *args) -> None:
    try:
        f(*args)
    except Exception:  # the session has ended and with it the way to the store
        pass


# --- batches -------------------------------------------------------------

def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over batches of at most BATCH_ROWS rows and about BATCH_BYTES.

    Spark reads these two settings when the plan runs, so they stay set in the session;
    a session that asks for smaller batches keeps its own.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(conf.get(key).rstrip("b")) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(f, schema)


def row_and(rows: DataFrame, **more: T.DataType) -> T.StructType:
    """Schema of the struct column ``row`` of ``rows`` and more columns beside it; names in it may hold any sign."""
    return T.StructType([T.StructField("row", rows.schema["row"].dataType), *[T.StructField(k, v) for k, v in more.items()]])


def strings(column: pa.Array) -> list[str]:
    """A string column with null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets between them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    data = data[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


# --- hashes --------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20260117))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
#: Space, tab, line feed, vertical tab, form feed and carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: All ASCII but letters and digits, for words without punctuation.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        m = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BACK)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit; one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 sums from which span_hash takes the hash of any span."""
    up, _ = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same wherever the span stands."""
    _, down = _power(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _cuts(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK_BYTES that divide no word."""
    at, total = 0, len(data)
    while at < total:
        end = at + BLOCK_BYTES
        if end >= total:
            yield at, total
            return
        own = offsets[np.searchsorted(offsets, end, "right") - 1]
        if own <= at:
            back = np.flatnonzero(space[at:end])
            if len(back):
                own = at + back[-1] + 1
            else:  # a word longer than a block
                more = np.flatnonzero(space[end:])
                stop = offsets[np.searchsorted(offsets, end, "left")]
                own = min(stop, end + more[0] if len(more) else total)
        yield at, int(own)
        at = int(own)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch: byte spans, hashes, and each text's range of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, apart: np.ndarray | None = None):
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        space = (_SPACE if apart is None else apart)[data]
        starts, ends, hashes = [], [], []
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        for lo, hi in _cuts(data, offsets, space):
            sp, ed = space[lo:hi], edge[lo:hi]
            before = np.empty(hi - lo, bool)
            before[0], before[1:] = True, sp[:-1]
            s = np.flatnonzero(~sp & (before | ed))
            after = np.empty(hi - lo, bool)
            after[-1], after[:-1] = True, sp[1:] | ed[1:]
            e = np.flatnonzero(~sp & after) + 1
            hashes.append(span_hash(prefix_sums(data[lo:hi]), s, e))
            starts.append(s + lo)
            ends.append(e + lo)
        none = np.zeros(0, np.int64)
        self.start = np.concatenate(starts) if starts else none
        self.end = np.concatenate(ends) if ends else none
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, offsets, "left")  # first[i]:first[i + 1] are text i's words


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines (split at line feeds) of all texts, in order; empty lines are left out."""
    feeds = np.flatnonzero(data == 10)
    starts = np.union1d(feeds + 1, offsets[:-1])
    starts = starts[starts < len(data)]
    ends = np.append(feeds, len(data))[np.searchsorted(feeds, starts)]
    ends = np.minimum(ends, offsets[np.searchsorted(offsets, starts, "right")])
    full = ends > starts
    return starts[full], ends[full]


def line_blocks(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lines of about BLOCK_BYTES together, so that sums over them stay small."""
    at = 0
    while at < len(starts):
        till = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES)))
        yield at, till
        at = till


def line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for a, b in line_blocks(starts, ends):
        lo, hi = starts[a], ends[b - 1]
        out[a:b] = span_hash(prefix_sums(data[lo:hi]), starts[a:b] - lo, ends[a:b] - lo)
    return out


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` hashes; one fewer than size at the end."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k:k + n] * _STEP[k]
    return mix(out)


def shingle_sets(words: Words, size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a shorter text is one shingle."""
    h, first = words.hash, words.first
    every = windows(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(every[a:b - size + 1]))
        elif b > a:
            whole = (h[a:b] * _STEP[8:8 + b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(whole ^ mix(np.array([b - a], np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def seeds(n: int, salt: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(salt)).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


# --- a bounded sieve -----------------------------------------------------

SIEVE_BITS = 20


def sieve(df: DataFrame, column: str) -> np.ndarray:
    """A bit table of 2 ** SIEVE_BITS entries, set where a value of the 64-bit column falls.

    Its size (128 KB) doesn't depend on the rows. It lets tasks leave out rows that
    can't meet a partner before a shuffle; a row it wrongly lets through is dropped
    by the join that follows, and a full table only lets all rows through.
    """
    bits = (1 << SIEVE_BITS) - 1
    got = df.select(F.col(column).bitwiseAND(F.lit(bits)).cast("int").alias("b")).groupBy("b").agg(F.lit(1)).select("b").toPandas()["b"].to_numpy()
    table = np.zeros((1 << SIEVE_BITS) // 8, np.uint8)
    np.bitwise_or.at(table, got >> 3, np.left_shift(1, got & 7).astype(np.uint8))
    return table


def sieved(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    b = (values.astype(np.int64) & ((1 << SIEVE_BITS) - 1))
    return (table[b >> 3] >> (b & 7).astype(np.uint8)) & 1 > 0


# --- components ----------------------------------------------------------

#: Links that one task joins by itself (8 MB).
FEW_LINKS = 500_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id of the links and the least one reachable."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    up = np.arange(len(ids))
    while True:
        s, t = up[x], up[y]
        apart = s != t
        if not apart.any():
            return ids, ids[up]
        np.minimum.at(up, np.maximum(s, t)[apart], np.minimum(s, t)[apart])
        while (up[up] != up).any():
            up = up[up]


def components(kept: Kept, links: DataFrame) -> DataFrame:
    """(id, root) for every id of ``links`` (a, b), with root the least id reachable.

    FEW_LINKS or fewer are joined in one task. More of them go through large-star and
    small-star steps until no link changes. Each step is one shuffle of the links with
    partial minima; every step is written to the shared folder, and nothing but a count
    and a sum comes to the driver.
    """
    links = kept.put(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if links.count() > FEW_LINKS:
        return starred(kept, links)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
        if got:
            yield pa.record_batch([pa.array(x) for x in roots(*map(np.concatenate, zip(*got)))], ["id", "root"])

    return kept.put(map_batches(links.coalesce(1), work, "id long, root long"))


def starred(kept: Kept, e: DataFrame) -> DataFrame:
    """``components`` of distinct links (a > b), by star steps."""
    def both(e):
        return e.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("w")))

    def star(e, large):
        n = both(e)
        if not large:
            n = n.filter("w <= v")
        least = n.groupBy("v").agg(F.min("w").alias("m")).select(F.col("v").alias("k"), F.least("m", "k").alias("m"))
        j = n.join(least, n.v == least.k)
        if large:
            return j.filter("w > v").select(F.col("w").alias("a"), F.col("m").alias("b")).distinct()
        return j.filter("w <> m").select(F.col("w").alias("a"), F.col("m").alias("b")).unionByName(
            least.filter("k <> m").select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()

    def mark(x):
        return x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    was = mark(e)
    while was[0]:
        nxt = kept.put(star(star(e, True), False))
        now = mark(nxt)
        kept.drop(e)
        e = nxt
        if now == was:
            break
        was = now
    own = F.col("b").alias("root")
    return e.select(F.col("a").alias("id"), own).unionByName(e.select(F.col("b").alias("id"), own).distinct())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
