"""Line dedup by a segment-partition edit join.

Lines that equal each other, or lie within so many edits (of UTF-8 bytes) of each
other as the shorter one's length allows, form a class; a class keeps its first line
(least document id, then least line number) and loses the others. Lines under 24
bytes must be equal; from there two edits are allowed, from 96 bytes three and one
more at each doubling.

A line of n bytes with ``edits`` allowed is split into edits + 1 segments. Within
``edits`` edits one of them stays whole, so a line that is as long or up to ``edits``
longer finds it by probing its segments' substring index: for each length and segment
the few substrings of the longer line that can stand there when edits to the left and
right of it add up. Index entries and probes meet by the hash of (length, segment,
substring).

Most substrings stand in one line only, so there are two rounds. The first deals all
keys to buckets of a bounded number of keys, packed to about nine bytes each (the
order within a bucket, and the high bits of the line's hash), and leaves only keys that
two different lines share. A key that different lines share within one task is known
to be shared: its lines skip the bucket, and two of them stand for all, so a bucket
doesn't grow with a template however common. The second round brings those lines
together by key; a key of more than ``BLOCK`` lines is dealt to pairs of blocks, each
of which meets once. There a 64-bit parity of the lines' byte pairs drops pairs too
many edits apart (an edit flips four bits at most). Of the likely pairs that are left
only a forest is written: its components hold every pair that may be linked. Each
component's lines, dealt to pairs of blocks where they are many, then meet once with
their texts; likely pairs are verified by banded bit-parallel edit distance, and each
line's links are counted on the spot, so that no list of pairs is ever written.

Lines without a letter or digit are left as they are. Null texts have no lines. A
line's identity is a 63-bit hash, of which the first round keeps 39 bits. A line that
repeats within its document counts once there and loses its later places. Rows with
equal ids are one document, those with a null id as well. A text that loses all its
words goes. Columns beyond those named pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Kept, components, line_blocks, line_hashes, line_spans, map_batches, mix, prefix_sums, roots, row_and, sieve, sieved, signed, span_hash, utf8

#: A line's edits are as many as there are bounds up to its length.
BOUNDS = np.array([24, 24, *(96 << k for k in range(25))])
#: Stands in for a null document id.
NO_ID = -(2**63)
#: Bits of a line's hash, the last of them a role, that go with a key; keys dealt to a bucket; keys that a task gathers before it deals them.
ID_BITS, BUCKET, FLUSH = 40, 1 << 22, 1 << 20
#: Lines of a key that one task compares; keys of more lines than that which go to the tasks whole (12 MB); lines that a task remembers.
BLOCK, SENT_KEYS, SEEN = 8192, 500_000, 1 << 18
#: Lines and bytes of a group that one task holds from a block.
TEXTS, TEXT_BYTES = 256, 8 << 20
#: Pairs that are verified side by side.
PAIRS = 4096
_ONE = np.uint64(1)
# letters and digits of ASCII, and whatever lies beyond it
_WORDED = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter, segment, shift) of every substring to look at; the index entries come first."""
    out = [(0, i, 0) for i in range(edits + 1)]
    for less in range(edits + 1):
        for i in range(edits + 1):
            lo, hi = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [(less, i, s) for s in range(lo, hi + 1) if (less, s) != (0, 0)]
    return out


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i: the last of them take what doesn't divide."""
    parts = edits + 1
    size, more = length // parts, length % parts
    return i * size + np.maximum(0, i - (parts - more)), size + (i >= parts - more)


def identity(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """63-bit line hashes; the last bit is free for a role."""
    return line_hashes(data, starts, ends) & ~_ONE


def allowed(length):
    """The edits that lines may be apart of which the shorter has this length."""
    return np.searchsorted(BOUNDS, length, "right")


def parities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each line's parity of byte pairs, by 64 classes of pairs."""
    out = np.zeros(len(starts), np.uint64)
    for a, b in line_blocks(starts, ends):
        lo, hi = starts[a], ends[b - 1]
        part = data[lo:hi]
        pair = (part[:-1].astype(np.uint64) * np.uint64(0x9E3779B1) + part[1:] * np.uint64(0x85EBCA6B)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(58)
        flip = np.append(_ONE << pair, np.uint64(0))
        flip[ends[a:b] - 1 - lo] = 0  # a pair over a line's end isn't the line's
        edge = np.empty(2 * (b - a), np.int64)
        edge[0::2], edge[1::2] = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = np.bitwise_xor.reduceat(np.append(flip, np.uint64(0)), edge)[0::2]
    return out


def join_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(edits, keys, ids) of the lines, in blocks; an id's last bit is set for an index entry."""
    for a, b in line_blocks(starts, ends):
        lo = starts[a]
        sums, s, n = prefix_sums(data[lo:ends[b - 1]]), starts[a:b] - lo, ends[a:b] - starts[a:b]
        most, tags = allowed(n), h[a:b] >> np.uint64(64 - ID_BITS) & ~_ONE
        for edits in range(1, int(most.max()) + 1):
            # of longer lines only those that a probe shortens into this class
            own = np.flatnonzero((most >= edits) & (allowed(n - edits) <= edits))
            less, i, shift = np.array(probes(edits)).T
            # some hundred thousand keys at a time
            for own in np.array_split(own, max(1, len(own) * len(less) >> 18)) if len(own) else ():
                left = n[own, None] - less
                line, probe = np.nonzero(allowed(left) == edits)
                left, line = left[line, probe], own[line]
                at, size = segment(left, i[probe], edits)
                at += s[line] + shift[probe]
                key = mix(span_hash(sums, at, at + size) ^ mix((left * 64 + i[probe]).astype(np.uint64)))
                yield edits, key, tags[line] | (probe <= edits).astype(np.uint64)


def common(a: bytes, b: bytes) -> int:
    """How many bytes a and b begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def within(a: bytes, b: bytes, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: Hyyro's bit-vectors over a diagonal band."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    same = common(a, b)
    a, b = a[same:], b[same:]
    same = common(a[::-1], b[::-1])
    a, b = a[:len(a) - same], b[:len(b) - same]
    m, n = len(a), len(b)
    if m <= edits:
        return True
    width = 2 * edits + 1
    full = (1 << width) - 1
    masks: dict[int, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << (i + edits)
    vp, vn, score = full ^ ((1 << edits) - 1), 0, edits
    low = 1 << (width - 2)
    for j, c in enumerate(b):
        x = (masks.get(c, 0) >> j) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if j < m - edits:
            score += not d0 >> (width - 1)
        else:
            score += bool(hp & low) - bool(hn & low)
            low >>= 1
        vp = hn | (full & ~((d0 >> 1) | hp))
        vn = (d0 >> 1) & hp
        if score > 2 * edits + max(0, m - edits - j):
            return False
    return score <= edits


def all_within(left: list[bytes], right: list[bytes], edits: int) -> np.ndarray:
    """``within`` for many pairs side by side: the same bands, one 64-bit word for each pair. ``edits`` up to 31."""
    n = len(left)
    a, b = [], []
    for x, y in zip(left, right):
        if len(x) < len(y):
            x, y = y, x
        same = common(x, y)
        x, y = x[same:], y[same:]
        same = common(x[::-1], y[::-1])
        a.append(x[:len(x) - same])
        b.append(y[:len(y) - same])
    m, size = np.array([len(x) for x in a]), np.array([len(y) for y in b])
    out, width = m <= edits, 2 * edits + 1
    todo = np.flatnonzero(~out & (m - size <= edits))
    todo = todo[np.argsort(size[todo], kind="stable")]
    one, full = np.uint64(1), np.uint64((1 << width) - 1)
    for part in np.array_split(todo, max(1, -(-len(todo) // 1024))) if len(todo) else ():
        most, long = m[part], int(size[part].max())
        # a row for each place: texts stand side by side
        x = np.full((max(long, int(most.max())) + width, len(part)), -1, np.int16)
        y = np.full((long, len(part)), -2, np.int16)
        for k, i in enumerate(part.tolist()):
            x[edits:edits + m[i], k] = np.frombuffer(a[i], np.uint8)
            y[:size[i], k] = np.frombuffer(b[i], np.uint8)
        vp, vn = np.full(len(part), (1 << width) - 1 ^ (1 << edits) - 1, np.uint64), np.zeros(len(part), np.uint64)
        score = np.full(len(part), edits, np.int64)
        bits, own = np.zeros((len(part), 64), bool), size[part]
        for j in range(long):
            bits[:, :width] = (x[j:j + width] == y[j]).T
            eq = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
            d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
            hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
            inner = j < most - edits
            low = np.maximum(width - 2 - (j - (most - edits)), 0).astype(np.uint64)
            step = np.where(inner, (d0 >> np.uint64(width - 1) & one ^ one).astype(np.int64), (hp >> low & one).astype(np.int64) - (hn >> low & one).astype(np.int64))
            score += np.where(j < own, step, 0)
            down = d0 >> one
            vp, vn = hn | (full & ~(down | hp)), down & hp
        out[part] = score <= edits
    return out


def worded_lines(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes; starts, ends and text of the lines with a letter or digit; their line numbers."""
    data, offsets = utf8(text)
    starts, ends = line_spans(data, offsets)
    of = np.searchsorted(offsets, starts, "right") - 1
    feeds = np.flatnonzero(data == 10)
    number = np.searchsorted(feeds, starts) - np.searchsorted(feeds, offsets[of])
    known = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_WORDED[data], out=known[1:])
    keep = known[ends] > known[starts]
    return data, starts[keep], ends[keep], of[keep], number[keep]


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, times, h, parity, edits): one row for each different worded line of each row of docs."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, starts, ends, of, number = worded_lines(b.column("text"))
            h = identity(data, starts, ends)
            order = np.lexsort((number, h, of))
            new = np.ones(len(order), bool)
            new[1:] = (of[order][1:] != of[order][:-1]) | (h[order][1:] != h[order][:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order)))
            own = np.sort(order[first])
            times = times[np.argsort(order[first], kind="stable")]
            yield pa.record_batch([
                b.column("doc_id").take(pa.array(of[own])), pa.array(number[own], pa.int64()), pa.array(times, pa.int64()), pa.array(signed(h[own])),
                pa.array(signed(parities(data, starts[own], ends[own]))), pa.array(allowed(ends[own] - starts[own]), pa.int32()),
            ], ["doc_id", "line_no", "times", "h", "parity", "edits"])

    return map_batches(docs, work, "doc_id long, line_no long, times long, h long, parity long, edits int")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and how long it is."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


def _shared(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of entries sorted by key, those whose key different lines have."""
    starts, sizes = _runs(key)
    line = ids & ~_ONE
    varied = np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts) if len(key) else np.zeros(0, bool)
    return np.repeat(varied, sizes)


def _packed(values: np.ndarray, width: int) -> bytes:
    """The values' bytes, all lowest first and all highest last: those of sorted values compress there."""
    return values.view(np.uint8).reshape(-1, values.itemsize)[:, :width].T.tobytes()


def _unpacked(packed: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(packed, np.uint8).reshape(width, -1).T
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return out.view(np.uint64).ravel()


def shared_keys(docs: DataFrame, buckets: dict[int, int]) -> DataFrame:
    """(edits, key, id): index entries and probes of keys that different lines have. ``buckets`` by edits."""
    low = np.uint64(0xFFFFFFFF)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        seen, size = np.zeros(0, np.uint64), 0
        names = ["edits", "bucket", "deal", "keys", "ids"]

        def flushed(edits, keys, ids):
            n = buckets.get(edits, 1)
            place = (keys >> np.uint64(32)) % np.uint64(n) << np.uint64(32) | keys & low
            order = np.argsort(place, kind="stable")
            place, ids = place[order], ids[order]
            known = _shared(place, ids)
            # those go anywhere: dealt by their first key
            out = [(edits, -1, int(signed(place[known][:1])[0]), _packed(place[known], 8), _packed(ids[known], 5))] if known.any() else []
            # two different lines stand for a key that is known to be shared
            starts, sizes = _runs(place)
            line = ids & ~_ONE
            least, most = (np.repeat(f.reduceat(line, starts), sizes) for f in (np.minimum, np.maximum))
            stay = np.ones(len(place), bool)
            stay[1:] = (place[1:] != place[:-1]) | (line[1:] != line[:-1]) | (ids[1:] != ids[:-1])
            stay &= ~known | (line == least) | (line == most)
            place, ids = place[stay], ids[stay]
            where = place >> np.uint64(32)
            starts, sizes = _runs(where)
            for a, k in zip(starts.tolist(), sizes.tolist()):
                out.append((edits, int(where[a]), 0, _packed(place[a:a + k] & low, 4), _packed(ids[a:a + k], 5)))
            return out

        def flush():
            rows = [r for e, (k, i) in held.items() for r in flushed(e, np.concatenate(k), np.concatenate(i))]
            held.clear()
            for a in range(0, len(rows), 256):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[a:a + 256]), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names)

        for b in batches:
            data, starts, ends, _, _ = worded_lines(b.column("text"))
            h, at = np.unique(identity(data, starts, ends), return_index=True)
            new = ~np.isin(h, seen, assume_unique=True)
            h, at = h[new], np.sort(at[new])
            # a line that this task had lately needs no second entry
            seen = np.concatenate([seen[-SEEN:], h])
            own = identity(data, starts[at], ends[at])
            for edits, keys, ids in join_keys(data, starts[at], ends[at], own):
                k, i = held.setdefault(edits, ([], []))
                k.append(keys)
                i.append(ids)
                size += len(keys)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over, keys, ids = None, [], []

        def rows(edits, place, ids):
            for a in range(0, len(place), 1 << 18):
                part = place[a:a + (1 << 18)]
                yield pa.record_batch([pa.array(np.full(len(part), edits, np.int32)), pa.array(signed(part)), pa.array(signed(ids[a:a + (1 << 18)]))], ["edits", "key", "id"])

        def bucket():
            place = np.concatenate(keys) << np.uint64(32) | np.arange(sum(map(len, keys)), dtype=np.uint64)
            place.sort()
            own = np.concatenate(ids)[(place & low).astype(np.int64)]
            place >>= np.uint64(32)
            both = _shared(place, own)
            yield from rows(over[0], place[both] | np.uint64(over[1]) << np.uint64(32), own[both])

        for b in batches:
            for edits, where, k, i in zip(*[b.column(c).to_pylist() for c in ("edits", "bucket", "keys", "ids")]):
                if where < 0:
                    yield from rows(edits, _unpacked(k, 8), _unpacked(i, 5))
                    continue
                if over != (edits, where):
                    if keys:
                        yield from bucket()
                    over, keys, ids = (edits, where), [], []
                keys.append(_unpacked(k, 4))
                ids.append(_unpacked(i, 5))
        if keys:
            yield from bucket()

    dealt = map_batches(docs.select("text"), deal, "edits int, bucket long, deal long, keys binary, ids binary")
    met = dealt.repartition("edits", "bucket", "deal").sortWithinPartitions("edits", "bucket")
    return map_batches(met, merge, "edits int, key long, id long")


def candidates(kept: Kept, docs: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b): a forest over different lines that share a segment and may be within the edits allowed.

    ``own`` has one row (h, parity, edits) for each different line.
    """
    sizes = own.filter("edits > 0").groupBy("edits").agg(F.count(F.lit(1)).alias("n")).collect()  # some twenty rows
    buckets = {r["edits"]: -(-r["n"] * len(probes(r["edits"])) // BUCKET) for r in sizes}
    found = kept.put(shared_keys(docs, buckets).distinct())
    tag = F.shiftrightunsigned("id", 1).alias("tag")
    lines = own.select("h", "parity", F.shiftrightunsigned("h", 65 - ID_BITS).alias("tag")).join(found.select(tag).distinct(), "tag", "left_semi")
    entries = found.select("edits", "key", tag, F.col("id").bitwiseAND(F.lit(1)).alias("entry")).join(lines, "tag")
    entries = kept.put(entries.select("edits", "key", F.col("h").bitwiseOR(F.col("entry")).alias("id"), "parity"))
    # keys of many lines: each pair of their blocks meets once
    many = entries.groupBy("edits", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("edits", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    many = kept.put(many)
    some = F.broadcast(many) if many.count() <= SENT_KEYS else many
    block = F.pmod(F.xxhash64("id"), "parts").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cut = entries.join(some, ["edits", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("block", block).withColumn("other", other)
    cut = cut.select("edits", "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "parity")
    met = cut.repartition("edits", "key", "x", "y").sortWithinPartitions("edits", "key", "x", "y")
    names = ["edits", "key", "x", "y", "block", "id", "parity"]

    def likely(cols, i, j):
        """Whether entries i and j (arrays of places that share a key) make a pair."""
        edits, _, x, y, block, ids, parity = cols
        line = ids & ~1
        good = ((ids[i] | ids[j]) & 1 > 0) & (line[i] != line[j]) & ((x[i] == y[i]) | (block[i] != block[j]))
        return good & (np.bitwise_count((parity[i] ^ parity[j]).view(np.uint64)) <= 4 * edits[i])

    def forest(cols):
        mark = np.ones(len(cols[0]), bool)
        mark[1:] = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
        starts = np.flatnonzero(mark)
        sizes = np.diff(np.append(starts, len(mark)))
        run = np.repeat(np.arange(len(starts)), sizes)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def take(i, j):
            good = likely(cols, i, j)
            a.append(cols[5][i[good]] & ~1)
            b.append(cols[5][j[good]] & ~1)
            return j[good]

        short = np.flatnonzero((sizes <= 64)[run])
        for d in range(1, 64):  # entries d places apart
            short = short[short + d < len(run)]
            short = short[run[short] == run[short + d]]
            if not len(short):
                break
            take(short, short + d)
        for k in np.flatnonzero(sizes > 64).tolist():
            rest, found = np.arange(starts[k], starts[k] + sizes[k]), []
            while len(rest):  # from each entry to those that no other has reached
                if not found:
                    found, rest = [rest[0]], rest[1:]
                i = found.pop()
                near = take(np.full(len(rest), i), rest)
                found += near.tolist()
                rest = rest[~np.isin(rest, near, assume_unique=True)]
        ids, top = roots(np.concatenate(a), np.concatenate(b))
        return pa.record_batch([pa.array(ids[ids != top]), pa.array(top[ids != top])], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rb in batches:
            cols = [rb.column(c).to_numpy() for c in names]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero(np.any([c != c[-1] for c in cols[:4]], axis=0))
            last = int(last[-1]) + 1 if len(last) else 0
            if last:
                yield forest([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None and len(held[0]):
            yield forest(held)

    return map_batches(met, work, "a long, b long")


def links(kept: Kept, docs: DataFrame, own: DataFrame) -> DataFrame:
    """(h, n_links, root): lines with links, a row for each meeting; root is a line reached from h there."""
    groups = components(kept, candidates(kept, docs, own).distinct())
    wanted = sieve(groups.select(F.shiftright("id", 1).alias("i")), "i")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for b in batches:
            data, starts, ends, _, _ = worded_lines(b.column("text"))
            h = signed(identity(data, starts, ends))
            at = np.flatnonzero(sieved(wanted, h >> 1) & ~np.isin(h, seen))
            _, once = np.unique(h[at], return_index=True)
            at = at[once]
            seen = np.concatenate([seen[-SEEN:], h[at]])
            yield pa.record_batch([pa.array(h[at]), pa.array([data[s:e].tobytes() for s, e in zip(starts[at].tolist(), ends[at].tolist())], pa.binary())], ["h", "line"])

    found = map_batches(docs.select("text"), texts, "h long, line binary").join(groups.toDF("h", "group"), "h").groupBy("h", "group").agg(F.first("line").alias("line"))
    found = kept.put(found)
    # blocks of bounded lines and bytes; each pair of a group's blocks meets once
    size = found.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TEXTS), F.ceil(F.sum(F.octet_length("line")) / TEXT_BYTES)).cast("int").alias("parts")).filter("parts > 1")
    size = kept.put(size)
    some = F.broadcast(size) if size.count() <= SENT_KEYS else size
    cut = found.join(some, "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("h"), "parts").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("group", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "h", "line")
    met = cut.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y")

    def likely(size, parity, block, across):
        """Places i < j of the lines of one meeting that may be linked, and the edits they are allowed."""
        for i in range(len(size) - 1):
            j = np.arange(i + 1, len(size))
            most = allowed(np.minimum(size[i], size[j]))
            good = (np.abs(size[j] - size[i]) <= most) & (np.bitwise_count(parity[j] ^ parity[i]) <= 4 * most)
            if across:
                good &= block[j] != block[i]
            yield from zip([i] * int(good.sum()), j[good].tolist(), most[good].tolist())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over, rows, pairs = None, [], []

        def met_lines():
            size, parity, block = (np.array([r[k] for r in rows], t) for k, t in ((2, np.int64), (3, np.uint64), (4, np.int64)))
            for i, j, edits in likely(size, parity, block, over[1] != over[2]):
                pairs.append((edits, rows[i][0], rows[j][0], rows[i][1], rows[j][1]))
                if len(pairs) >= PAIRS:
                    yield linked()

        def linked():
            """(h, links, root) of the lines that have links among the pairs gathered."""
            pairs.sort(key=lambda x: x[0])
            a, b = [], []
            for edits, some in groupby(pairs, lambda x: x[0]):
                some = list(some)
                good = all_within([x[3] for x in some], [x[4] for x in some], edits) if edits <= 31 else [within(x[3], x[4], edits) for x in some]
                a += [x[1] for x, ok in zip(some, good) if ok]
                b += [x[2] for x, ok in zip(some, good) if ok]
            pairs.clear()
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            ids, n = np.unique(np.concatenate([a, b]), return_counts=True)
            return pa.record_batch([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(roots(a, b)[1])], ["h", "n_links", "root"])

        for b in batches:
            lines = b.column("line").to_pylist()
            size = np.array([len(x) for x in lines], np.int64)
            ends = np.cumsum(size)
            parity = parities(np.frombuffer(b"".join(lines), np.uint8), ends - size, ends).tolist()
            for group, x, y, h, line, n, p, block in zip(*[b.column(c).to_pylist() for c in ("group", "x", "y", "h")], lines, size.tolist(), parity, b.column("block").to_pylist()):
                if over != (group, x, y):
                    if len(rows) > 1:
                        yield from met_lines()
                    over, rows = (group, x, y), []
                rows.append((h, line, n, p, block))
        if len(rows) > 1:
            yield from met_lines()
        if pairs:
            yield linked()

    return kept.put(map_batches(met, verify, "h long, n_links long, root long"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line of a class that stands more than once.

    (doc_id, line_no, times, h, class_id, class_size, n_links, kept): times within the
    document, class_id the least line hash of the class, class_size its places over
    all documents, n_links the different lines linked to this one, kept for the
    place that stays.
    """
    kept = Kept(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    lines = kept.put(line_table(docs))
    first = F.min(F.struct("doc_id", "line_no"))
    own = kept.put(lines.groupBy("h").agg(first.alias("first"), F.sum("times").alias("n"), F.min("parity").alias("parity"), F.min("edits").alias("edits"))
                   .select("h", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"), "n", "parity", "edits"))
    near = links(kept, docs, own)
    degree = near.groupBy("h").agg(F.sum("n_links").alias("n_links"))
    root = components(kept, near.select(F.col("h").alias("a"), F.col("root").alias("b")))
    own = own.join(root.toDF("h", "root"), "h", "left").withColumn("class_id", F.coalesce("root", "h")).filter("root is not null or n > 1")
    own = kept.put(own.select("h", "first_doc", "first_line", "n", "class_id").join(degree, "h", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")))
    classes = own.groupBy("class_id").agg(F.sum("n").alias("class_size"), F.min(F.struct("first_doc", "first_line")).alias("first")).filter("class_size > 1")
    members = own.select("h", "class_id", "n_links").join(classes, "class_id")
    out = lines.select("doc_id", "line_no", "times", "h").join(members, "h")
    return out.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "line_no", "times", "h", "class_id", "class_size", "n_links", ((F.col("doc_id") == F.col("first.first_doc")) & (F.col("line_no") == F.col("first.first_line"))).alias("kept"))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the lines that its classes lose, and without texts of which no word is left.

    ``chars_col``, where the table has it, follows the new text. A null text stays.
    """
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    gone = repeated_lines(docs, id_col, text_col).filter("not kept or times > 1")
    lists = gone.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id")).agg(F.collect_set(F.when(~F.col("kept"), F.col("h"))).alias("__gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"), key.alias("__key"))
    rows = rows.join(lists, rows["__key"] == lists["__id"], "left").select("row", "text", F.col("__gone").alias("gone"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, texts, stay = b.column("gone").to_pylist(), b.column("text").to_pylist(), []
            for k, (t, g) in enumerate(zip(texts, lists)):
                if t is None or g is None:
                    stay.append(True)
                    continue
                data, starts, ends, _, number = worded_lines(pa.array([t], pa.string()))
                drop, seen = set(), set(g)
                for n, h in zip(number.tolist(), signed(identity(data, starts, ends)).tolist()):
                    if h in seen:
                        drop.add(n)
                    seen.add(h)
                texts[k] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop)
                stay.append(not drop or bool(texts[k].split()))
            yield pa.record_batch([b.column("row"), pa.array(texts, pa.string())], ["row", "text"]).filter(pa.array(stay, pa.bool_()))

    made = map_batches(rows, work, row_and(rows, text=T.StringType()))

    def column(c: str):
        old = F.col(f"row.`{c}`")
        if c == text_col:
            return F.col("text").alias(c)
        if c == chars_col and c in docs.columns:
            return F.when(F.col("text").isNull(), old).otherwise(F.char_length("text")).cast(docs.schema[c].dataType).alias(c)
        return old.alias(c)

    return made.select(*[column(c) for c in docs.columns])
