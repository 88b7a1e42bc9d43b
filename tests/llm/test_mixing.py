"""Mixing, sharding and the pipeline."""

import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

import __spark_entry__
from stratalog.llm import mixing, sharding, toxicity
from stratalog.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        share = sum(weight[s] for s in free)
        left = total - sum(capped.values())
        want = {s: left * weight[s] / share for s in free}
        over = [s for s in free if want[s] >= 3 * sizes[s]]
        if not over:
            return capped | want
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_taken(tricky, rows):
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    got = mixing.mix_report(tricky).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert {r["source_size"] for r in got} == set(sizes.values())
    assert {round(r["target"], 6) for r in got} == {round(x, 6) for x in want.values()}
    again = mixing.mix_report(tricky.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mix(tricky)
    assert mixed.columns == tricky.columns
    assert mixed.count() == sum(r["copies"] for r in got)


def test_many_documents_come_near_their_targets(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id * 7919 % 60 as int)) AS text", "case when id % 3 = 0 then 'hot' else concat('s', id % 6) end AS source")
    sums = mixing.mix_report(docs).groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    assert all(abs(taken - target) <= 0.01 * target for _, target, taken in sums)


def test_mixing_without_words(spark, nothing):
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {r["taken"] for r in mixing.mix_report(none).collect()} == {0}
    assert mixing.mix_report(nothing).count() == 0 and mixing.mix(nothing).count() == 0


CLASHES = "_words _copies _copy _source _row _size _id _range _md5 _key _shard _draw _rate _name _at _end".split()


def test_columns_of_any_name_stay_as_they_are(tricky):
    docs = tricky.selectExpr("*", *(f"concat('{c}', doc_id) AS `{c}`" for c in CLASHES), "'odd' AS `a.b c`")
    want = Counter(tuple(r) for r in docs.collect())
    assert Counter(tuple(r)[: len(docs.columns)] for r in sharding.with_shards(docs.drop("shard")).select(*(f"`{c}`" for c in docs.drop("shard").columns)).collect()) == Counter(tuple(r) for r in docs.drop("shard").collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert set(map(tuple, mixed.collect())) <= set(want)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards(tricky, rows, shards):
    got = sharding.with_shards(tricky, shards).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_many_copies_are_split_evenly(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "case when id % 3 = 0 then repeat('copy ', 30) else repeat(cast(id as string), 20) end AS text")
    sums = [r["s"] for r in sharding.with_shards(docs).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "s").collect()]
    assert len(sums) == 24 and max(sums) - min(sums) <= 2 * 200


def test_no_rows_no_shards(nothing):
    assert sharding.with_shards(nothing).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        duck.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda d: sorted(tuple("null" if pd.isna(v) else str(v) for v in r) for r in d[columns].itertuples(index=False))
    assert key(got) == key(want)


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def components_of(rows):
    """component of each place of ``rows``, by all pairs."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = plain_words((r["text"] or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    of = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s and t and of[i] != of[j] and 100 * len(s & t) >= 75 * len(s | t):
                old, new = of[i], of[j]
                of = [new if x == old else x for x in of]
    return of


def contaminated(text, windows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
    hit = {p for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
    return len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("which", ["tricky", "documents", "nothing"])
def test_pipeline(spark, request, tmp_path, which):
    """Every stage on all that its predecessor kept, against plain Python; run() gives what the stages give."""
    pipeline = pytest.importorskip("corpus_pipeline")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet") if which == "documents" else request.getfixturevalue(which).withColumn("_words", F.lit("mine"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower)) for t in items]
    windows = {tuple(w[k : k + 13]) for w in split if w for k in range(max(1, len(w) - 12))}
    count = lambda rows: Counter(map(tuple, rows))
    now, before, last = docs, docs.collect(), None
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        rows = now.collect()
        if name != "sharding":
            assert now.columns == docs.columns
        if name == "toxicity":
            judged = toxicity.toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()
            gone = {r["doc_id"] for r in judged}
            assert count(rows) == count(r for r in before if r["doc_id"] not in gone)
        elif name == "jaccard_join":
            of = components_of(before)
            lowest = {c: min((r["doc_id"] for r, k in zip(before, of, strict=True) if k == c and r["doc_id"] is not None), default=None) for c in set(of)}
            gone = {r["doc_id"] for r, c in zip(before, of, strict=True) if r["doc_id"] is not None and r["doc_id"] != lowest[c]}
            assert count(rows) == count(r for r in before if r["doc_id"] not in gone)
        elif name == "decontamination":
            gone = {r["doc_id"] for r in before if contaminated(r["text"], windows)}
            assert count(rows) == count(r for r in before if r["doc_id"] not in gone)
        elif name == "mixing":
            sizes = defaultdict(int)
            for r in before:
                sizes[r["source"]] += len(plain_words(r["text"]))
            want, had, got = targets(sizes) if sizes else {}, count(before), count(rows)
            for r in before:
                rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
                assert int(rate) * had[tuple(r)] <= got[tuple(r)] <= -int(-rate // 1) * had[tuple(r)]
            assert set(got) <= set(had)
        else:
            kept = [c for c in docs.columns if c not in ("shard", "slot", "size")]
            assert count(tuple(r[c] for c in kept) for r in rows) == count(tuple(r[c] for c in kept) for r in before)
            slots = defaultdict(list)
            for r in rows:
                assert r["size"] == len((r["text"] or "").encode()) + 8
                slots[r["shard"]].append((r["slot"], r["size"]))
            assert all(sorted(k for k, _ in s) == list(range(len(s))) for s in slots.values())
            if rows:
                sums = [sum(b for _, b in slots[k]) for k in range(24)]
                assert max(sums) - min(sums) <= 2 * max(r["size"] for r in rows)
            last = count(rows)
        before = rows
    assert count(pipeline.run(spark, str(tmp_path)).collect()) == last
    assert "pipeline" in __spark_entry__.queries()
