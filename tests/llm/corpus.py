"""Small corpora with every awkward case, shared by the tests of the operators."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, kept boolean, words string, bucket string, id string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'aeiou'[rng.randrange(5)]}" for _ in range(n))


def documents(seed=1):
    """(doc_id, text): copies, near copies, shared passages, repeats, null, empty, blank, long and non-ASCII texts."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    out = [words(rng, rng.randrange(20, 160)) + "\n" + words(rng, rng.randrange(5, 40)) for _ in range(40)]
    out += [out[0]] * 4 + [out[1] + " tail"] + [passage + " " + words(rng, 30), words(rng, 10) + "\n" + passage, passage + " " + passage]
    parts = out[2].split(" ")
    for k in range(6):
        parts = [*parts]
        parts[k * 3] = f"x{k}"
        out.append(" ".join(parts))
    out += [None, "", " \n\t ", "one", "é" * 300 + " ñandú", "ab" * 400, "same words same words " * 40, "\n".join([words(rng, 12)] * 9), "x" * 200_000, words(rng, 30_000), "line\r\nwith\tmany\x0bspaces  here"]
    return [(i * 7 % 1000, t) for i, t in enumerate(out)]


def frame(spark, rows, lang="en", source=lambda i: f"s{i % 3}"):
    """rows as a documents table with extra columns whose names clash with working columns."""
    return spark.createDataFrame([(i, t, lang, source(i) if i is not None else None, 0, 9, True, "w", "b", "x") for i, t in rows], SCHEMA)


def awkward(spark):
    """Repeated rows and a null doc_id besides."""
    rows = documents()
    return frame(spark, [*rows, rows[3], rows[3], (None, rows[4][1]), (None, None)])
