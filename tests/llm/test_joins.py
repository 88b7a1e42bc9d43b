"""N-gram Jaccard join, exact dedup and repeated strings against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from stratalog.llm import components, exact_dedup, jaccard_join, suffix_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[100 + i] == 100 for i in range(40))
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join(tricky, rows):
    sets = [(i, _shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for b, (j, t) in enumerate(sets[:a]):
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                parent[find(a)] = find(b)
    lowest = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            lowest[find(a)] = min(i, lowest.get(find(a), i))
    want = Counter((i, len(s), lowest.get(find(a)) if s else i) for a, (i, s) in enumerate(sets))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(tricky).collect())
    assert got == want


def test_a_large_group_of_near_copies_needs_few_pairs(spark, monkeypatch):
    base = [f"w{i}" for i in range(100)]
    docs = [(k, " ".join([*base[:50], f"own{k}", *base[50:]])) for k in range(300)]
    pairs = []
    true_links = jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda r, c, w, p, n: (pairs.append(p.count()), true_links(r, c, w, p, n))[1])
    got = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}
    assert sum(pairs) < 300 * 20


@pytest.mark.parametrize("limits", [{}, {"CHUNK_SHINGLES": 700, "CHUNK_SETS": 4}])
def test_n_links_counts_every_link(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard_join, name, value)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:50], f"own{k}", *base[50:]]) for k in range(12)]
    texts += [" ".join([*base[k:], *(f"end{i}" for i in range(k))]) for k in range(2, 40, 4)]  # a chain: not all of a component link
    texts += [texts[0], texts[3], "two words", "a pair of five words only once", "a pair of five words only once more", None]
    docs = [*enumerate(texts), (0, texts[20]), (0, texts[0])]  # an id of two sets, one of them twice
    sets = [_shingles(t) for _, t in docs]
    kinds = {frozenset(s) for s in sets if s}
    want = Counter((i, len(s), sum(s != t and 100 * len(s & t) >= 75 * len(s | t) for t in kinds) if s else 0) for (i, _), s in zip(docs, sets, strict=True))
    got = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got.collect()) == want


@pytest.mark.parametrize("dense", [1, 3, 1000])
def test_link_counts(monkeypatch, dense):
    monkeypatch.setattr(jaccard_join, "DENSE", dense)
    monkeypatch.setattr(jaccard_join, "DENSE_COLUMNS", 16)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(60, 50 - k % 7, replace=False)).astype(np.uint64) for k in range(30)]
    linked = np.array([[100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t)) for t in sets] for s in sets])
    assert (jaccard_join.link_counts(sets)[0] == linked.sum(1) - 1).all()
    low, high = jaccard_join.link_counts(sets[:10], sets[10:])
    assert (low == linked[:10, 10:].sum(1)).all() and (high == linked[:10, 10:].sum(0)).all()


def test_words_and_signatures_that_collide(spark, monkeypatch):
    one, two = "a", "b"
    for _ in range(10):  # a polynomial modulo 2**64 takes these for one another
        one, two = one + two, two + one
    texts = [one, two, one, "a b c d e f g", "a b c d e f g h", "x y z"]
    true = jaccard_join.signatures
    monkeypatch.setattr(jaccard_join, "signatures", lambda value, sizes: (np.where(sizes > 0, 7, 0), true(value, sizes)[1]))
    rows = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string")
    profiles, classes, twins = jaccard_join._classes(rows, "long")
    assert classes.count() == 5 and len(twins) == 5
    monkeypatch.setattr(jaccard_join, "signatures", true)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3, 5: 5}


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64))
        y = np.unique(np.concatenate((rng.choice(x, rng.integers(0, len(x) + 1), replace=False), rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64))))
        bits = [np.frombuffer(jaccard_join.sketches(s, np.zeros(len(s), np.int64), np.array([len(s)]))[0], np.uint8) for s in (x, y)]
        assert jaccard_join.most_overlap(*bits, len(x), len(y)) >= len(np.intersect1d(x, y))


def test_one_of_each_group(tricky, rows):
    kept = jaccard_join.one_of_each_group(tricky)
    assert kept.columns == tricky.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 0 in ids and 13 not in ids and None in ids


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(tricky, rows, keep):
    norm = [(i, (t or "").translate(LOWER)) for i, t, *_ in rows]
    pick = min if keep == "smallest" else max
    want = Counter()
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        best = pick([j for j in ids if j is not None], default=None)
        want[i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = exact_dedup.exact_groups(tricky.repartition(20), keep=keep)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_drop_copies(tricky):
    assert exact_dedup.drop_copies(tricky).columns == tricky.columns


def test_repeated_strings(tricky, rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    count = Counter(b[k : k + 400] for b in texts for k in range(len(b) - 399))
    want = Counter()
    for (i, *_), b in zip(rows, texts, strict=True):
        mark = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                mark[k : k + 400] = True
        runs = int((np.diff(np.concatenate(([0], mark.astype(int)))) == 1).sum())
        want[i, len(b), int(mark.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~mark].tobytes()).hexdigest()] += 1
    got = suffix_dedup.repeated_strings(tricky)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()) == want


def test_repeated_strings_of_any_id_type(spark):
    docs = spark.createDataFrame([("2024-01-01", 1.5, "ab" * 300), ("2024-01-02", 2.5, "xy")], "day string, n double, text string").selectExpr("cast(day as date) AS day", "n", "text")
    for column in ("day", "n"):
        assert {r["n_removed"] for r in suffix_dedup.repeated_strings(docs, column).collect()} == {600, 0}


def test_empty_tables(nothing):
    assert jaccard_join.near_duplicates(nothing).count() == 0
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert suffix_dedup.repeated_strings(nothing).count() == 0
