"""Operators with literal expectations and against small plain models."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import text
from stratalog.operators import graph, packs, refs
from stratalog.streaming import state


def test_merge_graph_difference(spark):
    # R; A and B on R; M merges A and B.
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3)], "src long, dst long")
    one = lambda oid: spark.createDataFrame([(0, oid)], "root long, oid long")
    ids = lambda d: {r["oid"] for r in d.collect()}
    assert ids(graph.needed(edges, one(3), one(2))) == {3}
    assert ids(graph.needed(edges, one(4), one(2))) == {4, 3}
    assert ids(graph.closure(edges, one(9))) == {9}  # unknown ids stay as leaves
    assert ids(graph.closure(edges, one(4), one(3))) == {4, 2, 1}


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    assert graph.closure(edges, spark.createDataFrame([(0, 1)], "root long, oid long")).count() == 2


def test_atomic_pushes(spark):
    have = spark.createDataFrame([(1, "refs/heads/a", 5)], "repo long, name string, oid long")
    rows = [(1, 1, "refs/heads/b", 0, 7), (1, 1, "refs/heads/a", 9, 8), (2, 1, "refs/heads/a", 5, 0), (3, 1, "HEAD", 0, 1), (4, 1, "refs/heads/a", 0, 6), (5, 1, "refs/heads/x", 0, 0)]
    rows += [(6, 1, "refs/heads/c", 0, 1), (6, 1, "refs/heads/c", 0, 2)]  # both see the references before their push
    judged = refs.cas(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, push long, repo long, name string, old long, new long"), have)
    got = {(r["push"], r["name"]): (r["status"], r["applied"]) for r in judged.collect()}
    assert got[1, "refs/heads/b"] == ("ok", False)
    assert got[1, "refs/heads/a"] == ("stale old-oid", False)
    assert got[2, "refs/heads/a"] == ("ok", True)
    assert got[3, "HEAD"] == ("invalid ref", False)
    assert got[4, "refs/heads/a"] == ("ok", True)  # push 2 has deleted it
    assert got[5, "refs/heads/x"] == ("no such ref", False)
    assert {(r["name"], r["oid"]) for r in refs.apply_commands(have, judged).collect()} == {("refs/heads/a", 6), ("refs/heads/c", 2)}
    assert {r["push"]: r["report"] for r in refs.reports(judged).collect()}[1] == "ok refs/heads/b\nng refs/heads/a stale old-oid"


@pytest.mark.parametrize("name,valid", [("refs/heads/a", True), ("HEAD", False), ("refs/heads/a b", False), ("refs/heads/a.lock", False), ("refs//a", False), ("refs/heads/.a", True), ("refs/heads/./a", False), ("refs/heads/a..b", True), ("refs/../a", False), ("refs/heads/a.lock/b", True), ("refs/heads/a.", False), ("refs/a@{1}", False), ("refs/a\\b", False), ("heads/a", False)])
def test_ref_names(spark, name, valid):
    assert spark.createDataFrame([(name,)], "n string").select(refs.is_valid_name(F.col("n"))).first()[0] is valid


def test_keep_set_by_epochs(spark):
    names = [("last", None)] + [(f"e200-{i}", 200) for i in range(3)] + [("998", None)] + [(f"e100-{i}", 100) for i in range(3)] + [("997", None), ("996", None)]
    rows = [(0, n, i, e, n == "last") for i, (n, e) in enumerate(names)]
    kept = packs.keep_set(spark.createDataFrame(rows, "repo long, pack string, ord long, epoch long, is_latest boolean"), keep=3)
    assert {r["pack"] for r in kept.where("kept").collect()} == {"last", "e200-0", "e200-1", "e200-2"}


def test_delta_chains_of_any_length(spark):
    entries = [(1, i, i - 1 if i else None) for i in range(200)] + [(2, 7, 6), (2, 8, 7)]  # 6 is not in pack 2
    entries += [(3, 1, 2), (3, 2, 1), (3, 3, 1), (3, 4, 4), (3, 5, None)]
    got = {(r["pack"], r["oid"]): (r["depth"], r["base"]) for r in packs.delta_chains(spark.createDataFrame(entries, "pack long, oid long, base long")).collect()}
    want = {(1, i): (i, 0) for i in range(200)} | {(2, 7): (1, 6), (2, 8): (2, 6), (3, 5): (0, 5)} | {(3, i): (None, None) for i in (1, 2, 3, 4)}
    assert got == want


def test_segments_against_a_model(spark):
    rng = random.Random(3)
    rows = [(w, o, rng.choice([10, 500, 3000, 20000])) for w in range(3) for o in range(60)]
    got = {(r["work"], r["oid"]): r["segment"] for r in packs.segments(spark.createDataFrame(rows, "work long, oid long, length long"), 10, 5000).collect()}
    for w in range(3):
        left, number = [(o, -(-n * 6 // 10) + 32) for ww, o, n in rows if ww == w], 0
        while left:
            used, taken = 0, []
            for o, n in left:
                if len(taken) < 10 and (not taken or used + n <= 5000):
                    taken.append(o)
                    used += n
            assert all(got[w, o] == number for o in taken)
            left, number = [x for x in left if x[0] not in set(taken)], number + 1


def test_rate_limit(spark):
    times = [0, 1, 2, 3, 4, 5, 6, 304, 305, 306]
    rows = [(1, i, t, t == 306) for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts_s long, ok boolean")
    got = [r["decision"] for r in state.folded(events, "user_id", state.rate_limit).orderBy("event_id").collect()]
    assert got == ["failed"] * 5 + ["blocked"] * 3 + ["failed", "allowed"]


def test_push_queue(spark):
    events = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 1, 100), (1, 3, 2, 100), (1, 4, 150, 10)], "repo long, event_id long, ts_s long, work_s long")
    got = [r["decision"] for r in state.folded(events, "repo", state.push_queue).orderBy("event_id").collect()]
    assert got == ["started", "queued", "refused", "queued"]


def test_the_stream_decides_as_the_batch(spark, tmp_path):
    events = spark.createDataFrame([(i % 3, i, i * 7) for i in range(60)], "user_id long, event_id long, ts_s long")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = state.streamed(source, "user_id", state.touch, 1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    both = [{(r["event_id"], r["decision"]) for r in d.collect()} for d in (spark.read.parquet(str(tmp_path / "out")), state.folded(events, "user_id", state.touch))]
    assert both[0] == both[1]


def test_text_functions(spark):
    row = spark.createDataFrame([("a\r\nb", "x/y/z", bytearray(b"\xef\xbb\xbfhi"), 1536, 90061)], "t string, p string, b binary, n long, s long")
    got = row.select(
        text.line_count(F.col("t")), text.first_line(F.col("t")), text.parent_path(F.col("p")), text.breadcrumbs(F.col("p")), text.to_text(F.col("b")),
        text.format_size(F.col("n")), text.ago(F.col("s")), text.escape_html(F.lit('<a href="b">&')), text.format_when(F.lit(0).cast("long"), F.lit("+0200")), text.percent(F.lit(1), F.lit(8)),
    ).first()
    assert list(got) == [2, "a", "x/y", ["x", "x/y", "x/y/z"], "hi", "1.5 KB", "1d", "&lt;a href=&quot;b&quot;&gt;&amp;", "1970-01-01 00:00:00 UTC (+0200)", 13]


def test_walks_without_caps(spark, monkeypatch):
    """Long chains, cycles, and both ways of a closure."""
    chain = [(i, i - 1 if i else None) for i in range(3000)]
    commits = spark.createDataFrame(chain, "oid long, p1 long")
    starts = spark.createDataFrame([(2999, 2999), (5, 5), (9999, 9999)], "root long, oid long")
    got = {(r["root"], r["oid"], r["depth"]) for r in graph.ancestors(commits, starts, 2500).collect()}
    assert got == {(2999, 2999 - d, d) for d in range(2501)} | {(5, 5 - d, d) for d in range(6)} | {(9999, 9999, 0)}
    ring = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "oid long, p1 long")
    assert {(r["oid"], r["depth"]) for r in graph.ancestors(ring, spark.createDataFrame([(0, 0)], "root long, oid long"), 50).collect()} == {(0, 0), (2, 1), (1, 2)}
    with pytest.raises(ValueError):
        graph.levels(ring.selectExpr("oid AS src", "p1 AS dst"), ring.select("oid"))
    edges = spark.createDataFrame([(r, a, b) for r in (1, 2) for a, b in [(1, 2), (2, 3), (3, 1), (3, 4 + r), (7, 8)]], "root long, src long, dst long")
    roots, stop = spark.createDataFrame([(1, 1), (2, 2), (2, 77)], "root long, oid long"), spark.createDataFrame([(2, 3)], "root long, oid long")
    one = {tuple(r) for r in graph.closure(edges, roots, stop).collect()}
    monkeypatch.setattr(graph, "TASK_EDGES", 0)
    assert one == {tuple(r) for r in graph.closure(edges, roots, stop).collect()} == {(1, 1), (1, 2), (1, 3), (1, 5), (2, 2), (2, 77)}


def test_stored_size_estimate(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (100,), (101,)], "n long").select(packs.estimated_bytes(F.col("n"))).collect()] == [32, 33, 92, 93]
