import corpus_pipeline
from brinework.llm import decontamination, quality
from brinework.llm.shared import Kept

from .cases import SMALL, components, distance, edge, near_components, nearest_stretch, small
from .test_duplicates import brute_lines
from .test_layout import checked


def stages(spark, docs):
    kept, out = Kept(spark), []
    for _, stage in corpus_pipeline.STAGES:
        docs = kept.put(stage(spark, docs, SMALL))
        out.append(docs)
    return out


def test_stages_equal_brute_force(spark):
    docs = small(spark).filter("length(text) < 8000")
    good, lined, single, clean, packed = stages(spark, docs)
    verdict = {r.row.doc_id for r in quality.judged(docs, ["doc_id"]).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in good.collect()}
    assert set(texts) == verdict and good.columns == lined.columns == single.columns == clean.columns == docs.columns

    places, root, _ = brute_lines(list(texts.items()))
    first = {}
    for line, at in places.items():
        first[root[line]] = min([*at, first.get(root[line], (1 << 40, 0))])
    left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if x not in root or first[root[x]] == (i, n)) for i, t in texts.items()}
    left = {i: t for i, t in left.items() if t.split()}
    assert {r.doc_id: r.text for r in lined.collect()} == left

    comp = near_components(list(left.items()))
    assert {r.doc_id for r in single.collect()} == {i for i in left if comp[i] == i}

    def words(text):
        return decontamination.word_hashes(decontamination.pa.array([text.lower()], decontamination.pa.string()))[0].tolist()

    items = [w for w in (words(r.text) for r in small(spark, "benchmark").collect()) if len(w) >= decontamination.TELLING]
    stay = {r.doc_id for r in clean.collect()}
    for r in single.collect():
        text = words(r.text)
        pairs = set(zip(text, text[1:]))
        close = [w for w in items if any(p in pairs for p in zip(w, w[1:]))]
        assert (r.doc_id in stay) == (not any(nearest_stretch(w, text) <= len(w) // 5 for w in close))
    checked(packed.collect(), {r.doc_id: (-(-len(r.text.encode()) // 4), r.source, r.text) for r in clean.collect()}, 2048)


def test_run_equals_the_stages(spark):
    want = stages(spark, small(spark))[-1]
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_edge_rows(spark):
    for docs in (edge(spark), edge(spark).limit(0)):
        for df in stages(spark, docs)[:-1]:
            assert df.columns == docs.columns


def test_helpers():
    assert distance("abc", "axc") == 1 and components([1, 2, 3], [(2, 3)]) == {1: 1, 2: 2, 3: 2}
