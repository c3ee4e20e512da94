"""Masked pseudo-likelihood from a bidirectional window network, trained in numpy.

The network predicts a word from the two words before and the two behind it; the word
itself is masked. A document's score is the sum over its words of
log P(word | both sides).

The vocabulary comes from the counts of all words of the corpus: the most frequent
ones, as many as the square root of the number of running words, up to ``MOST_WORDS``.
Each is predicted by itself, as a leaf of a tree of three levels in the order of
frequency, whose branches begin with the logarithms of their counts. All other words
share an eighth as many leaves by hash, and such a leaf's probability is divided by the
different words that the corpus has there.

Training goes over every word of the corpus once. The rounds grow with the logarithm of
the running words. Texts are cut into blocks of BLOCK words with their neighbours, four
bytes a word, and a hash of the document's id, the block's place in it and its words
deals the blocks to a round and, within it, to copies of the network that see about
``copy_words`` words each. So a copy's share is a mixture of the whole corpus however
the files are laid out, a hot source or one very long text is spread over all copies,
and the number of copies grows with the corpus. Blocks that are equal in all of that
are dealt by their place in the files where they are many. Each copy trains by Adagrad
from the weights and the gradient history of the round before; both are averaged by
words, as whole numbers, so that no sum depends on its order. A copy sees at least
eight words for each weight, which bounds the traffic of the averages. Vocabulary and
averaged weights (40 bytes for each word known, 11 MB at most) reach the driver.

Null and empty texts have no words, score 0 and a null mean. Repeated rows train and
score as often as they stand; an empty table leaves the weights as they began. Other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Kept, Words, map_batches, signed, utf8

WIDTH, HIDDEN, MOST_WORDS = 8, 16, 1 << 18
SIDES = (-2, -1, 1, 2)
STEP, RATE, BOUND = 8192, 0.08, 4.0
LANES = 64
#: Words of a block, and about how many words train one copy in one round at least.
BLOCK, COPY_WORDS = 4096, 1 << 20
#: Equal blocks that stay together.
EQUAL_BLOCKS = 64
#: Different words that a task counts before it hands them on.
_COUNTED = 1 << 20


class Vocabulary:
    """Word hashes by rank, rare leaves behind them, and the tree over all leaves."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rare_counts: np.ndarray, rare_words: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.rank = hashes[order], order.astype(np.int32)
        self.known, self.rare = len(hashes), len(rare_counts)
        self.size = self.known + self.rare
        #: Branches of a node; leaf r hangs on r // base ** 2, r // base % base, r % base.
        self.base = max(1, math.ceil(round(self.size ** (1 / 3), 9)))
        n = np.zeros(self.base**3)
        n[:self.size] = np.concatenate([counts, rare_counts]) + 0.5
        tree = n.reshape(self.base, self.base, self.base)

        def logs(x):  # branches without leaves have no probability to speak of
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.log(x / x.sum(-1, keepdims=True))
            return np.where(np.isfinite(out), out, -60).astype(np.float32)

        self.prior = (logs(tree.sum((1, 2))), logs(tree.sum(2)), logs(tree).reshape(-1, self.base))
        self.share = np.zeros(self.size + 1)
        self.share[self.known:self.size] = -np.log(np.maximum(rare_words, 1))

    def leaves(self, hashes: np.ndarray) -> np.ndarray:
        """The leaf of each word."""
        out = self.known + (signed(hashes) % self.rare).astype(np.int32)
        if self.known:
            at = np.minimum(np.searchsorted(self.hashes, hashes), self.known - 1)
            own = self.hashes[at] == hashes
            out[own] = self.rank[at[own]]
        return out

    def shapes(self) -> dict[str, tuple]:
        d, h = self.base, HIDDEN
        return {"emb": (self.size + 1, WIDTH), "w": (len(SIDES) * WIDTH, h), "b": (h,), "u1": (h, d), "u2": (h, d), "u3": (h, d), "g1": (d, h), "g2": (d * d, h)}

    def first_weights(self, seed: int = 5) -> np.ndarray:
        rng = np.random.default_rng(seed)
        scale = {"emb": 0.1, "w": 0.2, "g1": 0.1, "g2": 0.1}
        flat = np.concatenate([rng.normal(0, scale[k], s).ravel() if k in scale else np.zeros(s).ravel() for k, s in self.shapes().items()])
        return np.concatenate([flat, np.zeros(-len(flat) % LANES)]).astype(np.float32)


class Net:
    """Views into one flat weight vector."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray, past: np.ndarray | None = None):
        self.vocabulary, self.flat, at = vocabulary, flat, 0
        self.past = np.full_like(flat, 1e-8) if past is None else past
        for name, shape in vocabulary.shapes().items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at:at + n].reshape(shape))
            at += n

    def forward(self, ids: np.ndarray, leaf: np.ndarray):
        """ids: (n, 4) leaves around each word; its log-probability and what backward needs.

        Weights are bounded by 4 and hidden units by 1, so no exponent exceeds 64.
        """
        n, d = len(ids), self.vocabulary.base
        a, ab, c = leaf // (d * d), leaf // d, leaf % d
        b = ab % d
        x = self.emb[ids].reshape(n, -1)
        h1 = np.tanh(x @ self.w + self.b)
        h2, h3 = np.tanh(h1 + self.g1[a]), np.tanh(h1 + self.g2[ab])
        at, logs, back = np.arange(n), 0.0, []
        for h, u, prior, t in ((h1, self.u1, self.vocabulary.prior[0], a), (h2, self.u2, self.vocabulary.prior[1][a], b), (h3, self.u3, self.vocabulary.prior[2][ab], c)):
            logits = h @ u
            logits += prior
            own = logits[at, t]
            p = np.exp(logits, out=logits)
            z = p.sum(1)
            logs = logs + (own - np.log(z))
            back.append((h, p, z, t))
        return logs, (x, a, ab, back)

    def train(self, ids: np.ndarray, leaf: np.ndarray) -> None:
        n, d = len(ids), self.vocabulary.base
        _, (x, a, ab, back) = self.forward(ids, leaf)
        grad = np.zeros_like(self.flat)
        out = Net(self.vocabulary, grad, grad)
        at, down = np.arange(n), []
        for (h, p, z, t), u, du in zip(back, (self.u1, self.u2, self.u3), (out.u1, out.u2, out.u3)):
            p /= z[:, None]
            p[at, t] -= 1
            du[:] = h.T @ p
            down.append((p @ u.T) * (1 - h * h) if h is not back[0][0] else p @ u.T)
        for rows, into, dk in ((a, out.g1, down[1]), (ab, out.g2, down[2])):
            for j in range(HIDDEN):
                into[:, j] = np.bincount(rows, dk[:, j], len(into))
        h1 = back[0][0]
        dh = (down[0] + down[1] + down[2]) * (1 - h1 * h1)
        out.w[:], out.b[:] = x.T @ dh, dh.sum(0)
        dx = (dh @ self.w.T).reshape(-1, WIDTH)
        flat_ids = ids.ravel()
        for j in range(WIDTH):
            out.emb[:, j] = np.bincount(flat_ids, dx[:, j], len(out.emb))
        grad /= n
        self.past += grad * grad
        self.flat -= RATE * grad / np.sqrt(self.past)
        np.clip(self.flat, -BOUND, BOUND, out=self.flat)


class Model:
    """A vocabulary and the weights of its network."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def vocabulary(kept: Kept, docs: DataFrame, most: int = MOST_WORDS) -> tuple[Vocabulary, int]:
    """The vocabulary of (doc_id, text) rows, and their number of running words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([x for _, x in held])).astype(np.int64)
            return pa.record_batch([pa.array(signed(h)), pa.array(n)], ["h", "n"])

        for b in batches:
            h, n = np.unique(Words(*utf8(b.column("text")), lower=True).hash, return_counts=True)
            held.append((h, n))
            size += len(h)
            if size > _COUNTED:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    counts = kept.put(map_batches(docs, work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    words = counts.agg(F.sum("n")).first()[0] or 0
    top = kept.put(counts.orderBy(F.desc("n"), "h").limit(min(most, math.isqrt(words))))
    rare = max(1, math.isqrt(words) // 8)
    rare = min(rare, most // 8)
    # at most MOST_WORDS rows, and an eighth as many
    known = top.orderBy(F.desc("n"), "h").toPandas()
    least = known["n"].iloc[-1] if len(known) else 0
    rest = counts.filter(F.col("n") <= int(least)).join(top.select("h"), "h", "left_anti") if len(known) else counts
    leaf = rest.groupBy(F.pmod("h", F.lit(rare)).alias("leaf")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).toPandas()
    n, different = np.zeros(rare), np.zeros(rare)
    at = leaf["leaf"].to_numpy(np.int64)
    n[at], different[at] = leaf["n"].to_numpy(), leaf["words"].to_numpy()
    kept.drop(counts, top)
    return Vocabulary(known["h"].to_numpy(np.int64).view(np.uint64), known["n"].to_numpy(np.float64), n, different), int(words)


def windows_of(known: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves with two pads at each text's ends, where each word stands there, words' ends by text."""
    w = Words(*utf8(column), lower=True)
    n = np.diff(w.first)
    at = np.arange(len(w.hash)) + 2 * np.repeat(np.arange(len(n)), n) + 2
    ids = np.full(len(w.hash) + 2 * len(n) + 4, known.size, np.int32)
    ids[at] = known.leaves(w.hash)
    return ids, at, w.first


def chunks(ids: np.ndarray, at: np.ndarray):
    side = np.array(SIDES)
    for lo in range(0, len(at), STEP):
        own = at[lo:lo + STEP]
        yield ids[own[:, None] + side], ids[own]


def blocks(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """(deal, place, n, codes): n words and the two leaves on either side of them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for b in batches:
            ids, _, first = windows_of(known, b.column("text"))
            rows, parts, n, made = [], [], [], []
            for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                for part, s in enumerate(range(lo, hi, BLOCK)):
                    e = min(hi, s + BLOCK)
                    rows.append(i)
                    parts.append(part)
                    n.append(e - s)
                    made.append(ids[s + 2 * i:e + 2 * i + 4].tobytes())
            yield pa.record_batch([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([row + i for i in rows], pa.int64()), pa.array(parts, pa.int64()), pa.array(n, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "place", "part", "n", "codes"])
            row += b.num_rows

    cut = map_batches(docs, work, "doc_id long, place long, part long, n long, codes binary")
    return cut.select(F.xxhash64("doc_id", "part", "codes").alias("deal"), F.xxhash64(F.spark_partition_id(), "place").alias("place"), "n", "codes")


def block_windows(known: Vocabulary, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What ``chunks`` wants, from the codes of many blocks."""
    flat = np.frombuffer(b"".join(codes), np.int32)
    sizes = np.array([len(c) // 4 for c in codes])
    ends = np.cumsum(sizes)
    target = np.ones(len(flat), bool)
    for k in (0, 1):
        target[ends - 1 - k] = False
        target[ends - sizes + k] = False
    return flat, np.flatnonzero(target)


def whole(values: np.ndarray, words: int, bits: int) -> np.ndarray:
    """The values' part of an average over words, as whole numbers of 2 ** -bits."""
    return np.rint(values.astype(np.float64) * 2.0**bits).astype(np.int64) * words


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None, copy_words: int | None = None, most_words: int = MOST_WORDS) -> Model:
    """A model after every word of the corpus has been a target once."""
    kept, docs = Kept(docs.sparkSession), texts_of(docs, id_col, text_col)
    known, total = vocabulary(kept, docs, most_words)
    flat = known.first_weights()
    past = np.full_like(flat, 1e-8)
    copy_words = max(COPY_WORDS, 8 * len(flat)) if copy_words is None else copy_words
    rounds = max(2, (total // copy_words).bit_length() // 2 + 1) if rounds is None else rounds
    turn = F.pmod("deal", F.lit(rounds))
    cut = kept.put(blocks(docs, known))
    equal = kept.put(cut.groupBy("deal").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > EQUAL_BLOCKS).select("deal"))
    if not equal.isEmpty():
        many = equal.withColumn("many", F.lit(True))
        cut = cut.join(F.broadcast(many) if equal.count() <= 500_000 else many, "deal", "left")
    else:
        cut = cut.withColumn("many", F.lit(None).cast("boolean"))
    words = {r["turn"]: r["n"] for r in cut.groupBy(turn.alias("turn")).agg(F.sum("n").alias("n")).collect()}  # one row a round
    schema = ", ".join(["k long", "n long", *[f"w{i} long" for i in range(LANES)]])
    for r in sorted(words):
        copies = -(-words[r] // copy_words)
        # whole numbers that leave room for the sum over all words of the round
        bits = min(30, 59 - words[r].bit_length())
        start, before = flat, past

        def work(share: pa.Table) -> pa.Table:
            net, share = Net(known, start.copy(), before.copy()), share.sort_by([("deal", "ascending"), ("place", "ascending")])
            ids, at = block_windows(known, share["codes"].to_pylist())
            for chunk in chunks(ids, at):
                net.train(*chunk)
            lanes = np.concatenate([whole(net.flat, len(at), bits), whole(np.minimum(net.past, 64), len(at), bits - 4)]).reshape(-1, LANES)
            return pa.table([pa.array(np.arange(len(lanes)), pa.int64()), pa.array(np.full(len(lanes), len(at), np.int64)), *[pa.array(lanes[:, i].copy()) for i in range(LANES)]], ["k", "n", *[f"w{i}" for i in range(LANES)]])

        copy = F.pmod(F.xxhash64("deal", F.when(F.col("many"), F.col("place"))), F.lit(copies)).alias("copy")
        share = cut.filter(turn == r).select(copy, "deal", "place", "codes").repartition(copies, "copy")
        made = share.groupBy("copy").applyInArrow(work, schema)
        got = made.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(LANES)]).orderBy("k").toPandas()
        mean = (got[[f"w{i}" for i in range(LANES)]].to_numpy().astype(np.float64) / got[["n"]].to_numpy()).ravel()
        flat = (mean[:len(flat)] * 2.0**-bits).astype(np.float32)
        past = np.maximum(mean[len(flat):] * 2.0**(4 - bits), 1e-8).astype(np.float32)
    kept.drop(cut, equal)
    return Model(known, flat)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every row."""
    known = model.vocabulary

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(known, model.weights, model.weights)
        for b in batches:
            ids, at, first = windows_of(known, b.column("text"))
            logs = [net.forward(i, t)[0].astype(np.float64) + known.share[t] for i, t in chunks(ids, at)]
            sums = np.concatenate([[0.0], np.cumsum(np.concatenate(logs))]) if logs else np.zeros(1)
            n, total = np.diff(first), sums[first[1:]] - sums[first[:-1]]
            mean = [None if k == 0 else float(t / k) for k, t in zip(n.tolist(), total.tolist())]
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.where(n == 0, 0.0, total)), pa.array(mean, pa.float64())], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return map_batches(texts_of(docs, id_col, text_col), work, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")
