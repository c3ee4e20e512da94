import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from brinework.llm import decontamination, langid, pseudo_likelihood, quality, queries
from brinework.llm.shared import Kept, Words, utf8

from .cases import SMALL, SPACE, edge, nearest_stretch, none, small


def features(text):
    words = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_base_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in small(spark).collect()}
    for r in queries.op5_quality_rules(spark, SMALL).collect():
        want = features(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.rejected_by == "")


def test_quality_of_edge_rows(spark):
    out = quality.keep_good(edge(spark))
    assert out.columns == edge(spark).columns
    got = [(r.row.doc_id, r.q.n_words, r.base_failed) for r in quality.judged(edge(spark), ["doc_id"]).collect()]
    assert len(got) == 10 and (2, 0, True) in got and (7, 30_000, True) in got
    assert quality.keep_good(none(spark)).count() == 0


def test_fences_follow_the_group(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good + f" tail{i}", "en", "a") for i in range(400)] + [(1000 + i, "## $ " * 30 + good, "en", "a") for i in range(3)]
    got = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got} == set(range(400))


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, sf).collect()
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)


def test_language_of_edge_rows(spark):
    known = langid.profiles(edge(spark))
    assert set(known) == {"en", "de"}
    by = {r.doc_id: r for r in langid.identify(edge(spark), known).collect()}
    assert len(by) == 9 and all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (2, 3, 4))
    assert by[7].lang_pred == "en"
    assert langid.profiles(none(spark)) == {}
    assert {r.lang_pred for r in langid.identify(edge(spark), {}).collect()} == {"und"}


def test_leaks_equal_brute_force(spark):
    def words(text):
        h, _ = decontamination.word_hashes(decontamination.pa.array([(text or "").lower()], decontamination.pa.string()))
        return h.tolist()

    docs = {r.doc_id: words(r.text) for r in small(spark).collect()}
    items = {r.item_id: words(r.text) for r in small(spark, "benchmark").collect()}
    want = set()
    for i, text in docs.items():
        if len(text) < 3000:
            for j, item in items.items():
                pairs = set(zip(item, item[1:]))
                # one within n // 5 edits keeps a pair of neighbours at least
                if any(p in pairs for p in zip(text, text[1:])):
                    d = nearest_stretch(item, text)
                    if d <= len(item) // 5:
                        want.add((i, j, d))
    got = {(r.doc_id, r.item_id, r.n_edits) for r in decontamination.leaks(small(spark), small(spark, "benchmark")).collect() if len(docs[r.doc_id]) < 3000}
    assert want and {x[:2] for x in got} <= {x[:2] for x in want}
    assert len({x[:2] for x in got}) >= 0.95 * len(want)


def test_items_edited_to_the_limit_are_found(spark, monkeypatch):
    """Items of many sizes, each with all n // 5 edits used up amid other words; those of one to four words whole."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(5000)]

    def some(n):
        return rng.choice(vocabulary, n).tolist()

    items, docs, want = [], [], {}
    for k, n in enumerate([1, 2, 3, 4, 4] + [5, 9, 12, 19, 30, 45, 60, 100, 150, 300, 400] * 10):
        item = [f"item{k}", *some(n - 1)]
        copy = list(item)
        for _ in range(decontamination.edits(n)):
            at, how = int(rng.integers(len(copy))), rng.integers(3)
            copy[at:at + 1] = [["xx"], [copy[at], "yy"], []][how]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(some(80) + copy + some(80))))
        want[k] = nearest_stretch(item, docs[-1][1].split())
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK", 40)  # three blocks
    got = {r.doc_id: r.n_edits for r in decontamination.leaks(docs, items).collect() if r.doc_id == r.item_id}
    assert all(k in got for k in range(5))
    assert sum(k in got for k in want) >= 0.97 * len(want)
    assert sum(got[k] == want[k] for k in got) >= 0.98 * len(got)
    left = {r.doc_id for r in decontamination.clean(docs, items).collect()}
    assert left == {k for k in want if k < 5 or k not in got}


def test_leaks_of_edge_rows(spark):
    items = spark.createDataFrame([(1, "Quick brown fox, jumps over the LAZY dog near"), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    got = decontamination.leaks(edge(spark), items).collect()
    assert sorted((r.doc_id, r.item_id, r.n_edits, r.start_word) for r in got) == [(1, 1, 0, 1), (1, 1, 0, 1), (5, 4, 0, 0), (6, 4, 0, 0)]
    again = decontamination.leaks(edge(spark), items.unionByName(items)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    left = decontamination.clean(edge(spark), items)
    assert left.columns == edge(spark).columns and left.count() == 8
    assert decontamination.leaks(none(spark), items).count() == 0 and decontamination.leaks(edge(spark), items.limit(0)).count() == 0
    assert decontamination.clean(edge(spark), items.limit(0)).count() == 10


def plain_fence(values, unit):
    s = sorted(values)

    def q(rank):
        return s[max(0, math.ceil(round(rank * len(s), 9)) - 1)]

    for lo, hi in zip(quality.RANKS, quality.RANKS[1:]):
        if q(hi) + unit >= quality.VALLEY * (q(lo) + unit):
            return math.sqrt((q(lo) + unit) * (q(hi) + unit)) - unit
    return 2 * q(quality.TAIL) - q(0.5) + 4 * unit


def test_verdicts_equal_brute_force(spark):
    rows = small(spark).select("doc_id", "text", "lang", "source").collect()
    measured = dict(zip(quality._NAMES, quality.measure(pa.array([r.text for r in rows], pa.string()))))
    ratio = {
        "symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words"),
        "word_brevity": ("n_words", "word_chars"), "pipe_ratio": ("n_pipes", "n_words"), "capital_ratio": ("n_capitals", "n_letters"),
    }
    value = {k: measured[a] / np.maximum(measured[b], 1) for k, (a, b) in ratio.items()}
    n = measured["n_words"]
    good = ~((n < 50) | (100 * measured["n_repeat_words"] > 50 * n))
    lang, source = np.array([str(r.lang) for r in rows]), np.array([str(r.source) for r in rows])
    over = np.zeros(len(rows), bool)
    for k, base in quality.RATIOS.items():
        unit = 1 / max(1, sorted(measured[base][good])[math.ceil(good.sum() / 2) - 1]) if base else 0.0
        whole = plain_fence(value[k][good], unit)
        for x in set(lang[good]):
            mine = good & (lang == x)
            up = (mine.sum() * plain_fence(value[k][mine], unit) + quality.PRIOR * whole) / (mine.sum() + quality.PRIOR)
            for y in set(source[mine]):
                own = mine & (source == y)
                fence = min((own.sum() * plain_fence(value[k][own], unit) + quality.PRIOR * up) / (own.sum() + quality.PRIOR), quality.SLACK * up)
                over |= own & (value[k] > fence)
    got = {r.doc_id: r for r in queries.op5_quality_rules(spark, SMALL).collect()}
    assert [got[r.doc_id].kept for r in rows] == (good & ~over).tolist() and over.any()


def test_sketched_quantiles_are_close(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    values = np.sort(np.array([r.n for r in docs.selectExpr("cast(length(text) as double) as n").collect()]))
    ranks = spark.createDataFrame([(float(x),) for x in values], "n double").repartition(7).agg(F.kll_sketch_agg_double("n").alias("k"))
    got = ranks.select(F.kll_sketch_get_quantile_double("k", F.array(*map(F.lit, quality.RANKS)))).first()[0]
    for p, q in zip(quality.RANKS, got):
        assert abs(np.searchsorted(values, q, "right") / len(values) - p) < 0.03


def test_labelled_good_texts_stay(spark):
    where = "/root/testdata/sf0.1"
    got = queries.op5_quality_rules(spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").filter("not base_failed")
    share = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] >= 0.98 and share[0] <= 0.02


def mean_score(docs, model):
    return pseudo_likelihood.score(docs, model).selectExpr("sum(log_likelihood) / sum(n_tokens) as m").first().m


def test_pseudo_likelihood_learns(spark):
    p = pseudo_likelihood
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) between 300 and 5000")
    model = p.train(docs)
    unigrams = p.Model(model.vocabulary, model.vocabulary.first_weights())
    assert mean_score(docs, model) > mean_score(docs, unigrams) + 0.1
    turned = docs.selectExpr("doc_id", "array_join(shuffle(split(text, ' '), 5), ' ') as text")
    plain = {r.doc_id: r.mean_log_likelihood for r in p.score(docs, model).collect()}
    mixed = p.score(turned, model).collect()
    assert sum(plain[r.doc_id] >= r.mean_log_likelihood for r in mixed) > 0.6 * len(mixed)


def plain_score(model, counts, text):
    """The sum of log P(word | sides), word by word in plain Python."""
    known, h, d = model.vocabulary, pseudo_likelihood.HIDDEN, model.vocabulary.base
    net = pseudo_likelihood.Net(known, model.weights, model.weights)
    w = {k: getattr(net, k).tolist() for k in known.shapes()}
    prior = [x.tolist() for x in known.prior]
    words = Words(*utf8(pa.array([text])), lower=True).hash.tolist()
    rank = dict(zip(known.hashes.tolist(), known.rank.tolist()))
    rare = {}
    for x in counts:
        if x not in rank:
            rare.setdefault(x % known.rare if x < 1 << 63 else (x - (1 << 64)) % known.rare, set()).add(x)
    leaf = [rank[x] if x in rank else known.known + (x if x < 1 << 63 else x - (1 << 64)) % known.rare for x in words]
    out = [known.size] * 2 + leaf + [known.size] * 2
    total = 0.0
    for i, t in enumerate(leaf):
        x = [v for k in (0, 1, 3, 4) for v in w["emb"][out[i + k]]]
        h1 = [math.tanh(sum(a * w["w"][r][j] for r, a in enumerate(x)) + w["b"][j]) for j in range(h)]
        a, b, c = t // (d * d), t // d % d, t % d
        h2 = [math.tanh(v + w["g1"][a][j]) for j, v in enumerate(h1)]
        h3 = [math.tanh(v + w["g2"][a * d + b][j]) for j, v in enumerate(h1)]
        for hid, u, pr, k in ((h1, "u1", prior[0], a), (h2, "u2", prior[1][a], b), (h3, "u3", prior[2][a * d + b], c)):
            logits = [sum(v * w[u][r][m] for r, v in enumerate(hid)) + pr[m] for m in range(d)]
            total += logits[k] - math.log(sum(map(math.exp, logits)))
        if t >= known.known:
            total -= math.log(len(rare[t - known.known]))
    return total


def test_pseudo_likelihood_equals_plain_python(spark):
    p = pseudo_likelihood
    docs = small(spark).filter("length(text) < 3000")
    model = p.train(docs)
    texts = [r.text for r in docs.collect() if r.text]
    counts = Counter(x for t in texts for x in Words(*utf8(pa.array([t])), lower=True).hash.tolist())
    known = model.vocabulary
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0] if x[0] < 1 << 63 else x[0] - (1 << 64)))[:math.isqrt(sum(counts.values()))]
    assert [x for x, _ in top] == known.hashes[np.argsort(known.rank)].tolist()
    got = {r.doc_id: r for r in p.score(docs, model).collect()}
    for r in docs.limit(6).collect():
        assert abs(got[r.doc_id].log_likelihood - plain_score(model, counts, r.text)) < 1e-3 * max(1, got[r.doc_id].n_tokens)
    # all leaves together have a probability of one
    every = np.arange(known.size)
    logs = p.Net(known, model.weights, model.weights).forward(np.full((known.size, 4), known.size), every)[0]
    assert abs(np.exp(logs.astype(float)).sum() - 1) < 1e-3


def test_pseudo_likelihood_gradient(spark):
    p, rng = pseudo_likelihood, np.random.default_rng(2)
    known = p.Vocabulary(np.arange(1, 31, dtype=np.uint64), np.arange(30.0, 0, -1), np.ones(4), np.ones(4))
    flat = known.first_weights() + rng.normal(0, 0.2, len(known.first_weights())).astype(np.float32)
    ids, leaf = rng.integers(0, 35, (50, 4)), rng.integers(0, 34, 50)
    net = p.Net(known, flat.copy(), np.full_like(flat, 1e-12))
    net.train(ids, leaf)
    for k in rng.choice(np.flatnonzero(net.past > 1e-7), 25, replace=False):
        up, down = flat.astype(np.float64), flat.astype(np.float64)
        up[k] += 1e-4
        down[k] -= 1e-4
        slope = (p.Net(known, down, down).forward(ids, leaf)[0].mean() - p.Net(known, up, up).forward(ids, leaf)[0].mean()) / 2e-4
        assert abs(abs(slope) - np.sqrt(net.past[k])) < 2e-3 * max(1, abs(slope)) and (slope > 0) == (net.flat[k] < flat[k])


def test_pseudo_likelihood_is_the_same_for_other_files(spark):
    p, docs = pseudo_likelihood, small(spark).filter("length(text) < 20000")
    one = p.train(docs.coalesce(1), copy_words=20_000)
    two = p.train(docs.repartition(5), copy_words=20_000)
    assert (one.weights == two.weights).all() and (one.vocabulary.hashes == two.vocabulary.hashes).all()


def test_pseudo_likelihood_vocabulary_grows(spark):
    p, kept = pseudo_likelihood, Kept(spark)
    few, n = p.vocabulary(kept, p.texts_of(small(spark), "doc_id", "text"))
    more, m = p.vocabulary(kept, p.texts_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text"))
    assert few.known == math.isqrt(n) and more.known == math.isqrt(m) and m > n


def test_pseudo_likelihood_of_edge_rows(spark):
    p = pseudo_likelihood
    by = {r.doc_id: r for r in p.score(edge(spark), p.train(edge(spark))).collect()}
    assert by[2].n_tokens == 0 and by[2].log_likelihood == 0 and by[2].mean_log_likelihood is None
    assert by[7].n_tokens == 30_000 and by[7].log_likelihood < 0
    empty = p.train(none(spark))
    assert (empty.weights == empty.vocabulary.first_weights()).all()
    assert p.score(none(spark), empty).count() == 0 and p.score(edge(spark), empty).count() == 10


def test_pseudo_likelihood_blocks_hold_every_window_once(spark):
    p = pseudo_likelihood
    known, _ = p.vocabulary(Kept(spark), p.texts_of(edge(spark), "doc_id", "text"))
    texts = [r.text or "" for r in edge(spark).collect()]
    ids, at, _ = p.windows_of(known, pa.array(texts))
    plain = Counter(tuple(x) for i, t in p.chunks(ids, at) for x in np.column_stack([i, t]).tolist())
    cut = p.blocks(p.texts_of(edge(spark), "doc_id", "text"), known).collect()
    dealt = Counter(tuple(x) for i, t in p.chunks(*p.block_windows(known, [bytes(r.codes) for r in cut])) for x in np.column_stack([i, t]).tolist())
    assert dealt == plain and sum(r.n for r in cut) == len(at)
    assert max(r.n for r in cut) == p.BLOCK


