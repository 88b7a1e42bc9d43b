import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, _x int"


def _words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + rng.choice(["", "s", "x", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, blanks, long and repeated texts, near copies, repeated rows and clashing column names."""
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "one", "One", "two words", "a b c d e", "a b c d e", "A b C d e", "été ß 中文", "x" * 3000, "the " * 900]
    base = [_words(rng, 200) for _ in range(4)]
    for t in base:
        for edits in range(4):
            w = t.split()
            for _ in range(edits * 2):
                w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
    texts += [base[0], base[0].upper(), _words(rng, 5000), base[1] + "\n" + base[2], base[3] * 2]
    texts += [f"{_words(rng, 30)} {base[2][:500]} {_words(rng, 30)}" for _ in range(6)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "s2", None]), None, "clash", None, i) for i, t in enumerate(texts)]
    rows += [rows[15], rows[15], (None, base[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "another text of the same id", "en", "s1", 1, "c", "c", 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows(tricky):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in tricky.collect()]
