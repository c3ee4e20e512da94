"""Rows that every operator must survive, and plain versions to hold results against."""

import re

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")

#: Null and empty texts, ties, repeated rows, null keys, one long text.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \n\t ", "de", None),
    (5, "one two", None, "b"),
    (6, "one two", "en", "b"),
    (7, "word " * 30_000, "en", "a"),
    (8, "ü🙂 " * 40 + "\n" + "line that is surely long enough to count\n" * 3, "de", "c"),
    (None, "a row without any id but with quite enough words in its text", "en", "a"),
]


def edge(spark):
    """The rows above with columns whose names operators might use themselves."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    for i, name in enumerate(("id", "row", "q", "h", "n", "root", "part", "a", "b", "group", "kept", "size", "dotted.name")):
        df = df.withColumn(name, F.lit(i))
    return df


def none(spark):
    return edge(spark).limit(0)


def small(spark, name="documents"):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def shingles(text, size=5):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def components(ids, links):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def near_components(docs):
    """Least id reachable over links of similarity 0.75, from every pair of ids and texts."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
    return components(ids, links)


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def nearest_stretch(item, text):
    """Least edits between the item and any stretch of the text."""
    last = list(range(len(item) + 1))
    best = last[-1]
    for w in text:
        row = [0]
        for j, y in enumerate(item, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (w != y)))
        last = row
        best = min(best, last[-1])
    return best
