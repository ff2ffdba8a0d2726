"""Documents with everything that may go wrong, and plain-Python twins of shared steps."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, h int, score string, kept string, llm_id string, part int, shard int"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do " * 3000

ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en"), (2, "alpha  beta\tgamma delta\nepsilon zeta", "en"), (3, "", None), (4, None, "en"),
    (5, " \t\n", "fr"), (6, "one", "en"), (7, "one", None), (None, "alpha beta gamma delta epsilon zeta", "en"), (8, LONG, "en"), (9, LONG + "end", "de"),
    (10, "same row", "en"), (10, "same row", "en"), (11, "Ünïcode ñandú 你好 \U0001F600 é", "es"), (12, "12345 !!! 67", "en"), (13, "same  row", None),
    (14, " alpha beta gamma delta epsilon zeta", "en")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, lang, None, None, "x", 1, 2, None, "k", "l", 7, 8) for i, t, lang in rows], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def classes(rows):
    """{id: smallest id reachable} by comparing all pairs of (id, text)."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i in root}


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
