"""References: resolution, listing, name rules, and atomic compare-and-swap updates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO = 0


def is_valid_name(name: Column) -> Column:
    """Whether a reference may have this name: under refs/, no control character, blank or one of ~^:?*[, no backslash,
    no "@{", no empty component, none that is "." or "..", and neither "." nor ".lock" at the end of the name."""
    bad = name.rlike(r"[\x00-\x20~^:?*\[]") | name.contains("//") | name.contains("@{") | name.contains("\\")
    dots = F.exists(F.split(name, "/"), lambda p: p.isin(".", ".."))
    return name.startswith("refs/") & ~name.endswith("/") & ~name.endswith(".") & ~name.endswith(".lock") & ~bad & ~dots


def resolve(requests: DataFrame, refs: DataFrame, heads: DataFrame) -> DataFrame:
    """``requests`` (repo, request, ...) with oid.

    40 hex digits are an id themselves; HEAD goes to its target; full names match exactly;
    short names are looked up as branches, then as tags.
    """
    target = heads.select("repo", F.col("target").alias("_target"))
    rows = requests.join(target, "repo", "left")
    name = F.when(F.col("request") == "HEAD", F.coalesce("_target", F.lit("refs/heads/main"))).otherwise(F.col("request"))
    rows = rows.withColumn("_full", name)
    full = F.col("_full").startswith("refs/")
    rows = rows.withColumn("_head", F.when(full, F.col("_full")).otherwise(F.concat(F.lit("refs/heads/"), "_full")))
    rows = rows.withColumn("_tag", F.when(~full, F.concat(F.lit("refs/tags/"), "_full")))
    by = lambda key, out: refs.select("repo", F.col("name").alias(key), F.col("oid").alias(out))
    rows = rows.join(by("_head", "_o1"), ["repo", "_head"], "left").join(by("_tag", "_o2"), ["repo", "_tag"], "left")
    own = F.when(F.col("request").rlike("(?i)^[0-9a-f]{40}$"), F.lower("request"))
    return rows.withColumn("oid", F.coalesce(own, F.col("_o1").cast("string"), F.col("_o2").cast("string"))).select(*requests.columns, "oid")


def head_state(heads: DataFrame, refs: DataFrame) -> DataFrame:
    """repo, target, oid, unborn: HEAD without its branch is unborn."""
    found = heads.join(refs.select("repo", F.col("name").alias("target"), "oid"), ["repo", "target"], "left")
    return found.select("repo", "target", "oid", F.col("oid").isNull().alias("unborn"))


def listing(refs: DataFrame, tags: DataFrame, prefixes: list[str]) -> DataFrame:
    """repo, name, oid, peeled of the references under any of ``prefixes`` (none: all); only tags are peeled, one level."""
    wanted = F.lit(not prefixes)
    for p in prefixes:
        wanted = wanted | F.col("name").startswith(p)
    rows = refs.where(wanted).join(tags.select("repo", F.col("oid"), F.col("peeled")), ["repo", "oid"], "left")
    return rows.select("repo", "name", "oid", F.when(F.col("name").startswith("refs/tags/"), F.col("peeled")).alias("peeled"))


def cas(commands: DataFrame, refs: DataFrame) -> DataFrame:
    """``commands`` (repo, push, event_id, name, old, new) with status, ok, applied.

    The pushes of a repository are judged in order, each against the references as the pushes before
    left them; within a push every command sees the references before it. A zero ``new`` deletes, a
    zero ``old`` creates. A push is applied only if all of its commands are valid. Judging is sequential in a
    repository by nature: its commands are one task's, its references are not (each command brings its own).
    """
    first = refs.select("repo", "name", F.col("oid").alias("_head"))
    rows = commands.join(first, ["repo", "name"], "left").withColumn("_valid", is_valid_name(F.col("name")))

    def judge(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([("push", "ascending"), ("event_id", "ascending")])
        push, name, old, new, head, valid = (batch[c].to_pylist() for c in ("push", "name", "old", "new", "_head", "_valid"))
        now: dict[str, int] = {}
        status, applied = [], []
        start = 0
        while start < len(push):
            stop = start
            while stop < len(push) and push[stop] == push[start]:
                current = now.get(name[stop], head[stop] or ZERO)
                status.append(_status(valid[stop], current, old[stop], new[stop]))
                stop += 1
            done = all(x == "ok" for x in status[start:stop])
            if done:
                now.update(zip(name[start:stop], new[start:stop], strict=True))
            applied += [done] * (stop - start)
            start = stop
        batch = batch.drop_columns(["_head", "_valid"]).append_column("status", pa.array(status, pa.string()))
        return batch.append_column("ok", pa.array([x == "ok" for x in status], pa.bool_())).append_column("applied", pa.array(applied, pa.bool_()))

    rows = rows.select("event_id", "push", "repo", "name", "old", "new", "_head", "_valid")
    return rows.groupBy("repo").applyInArrow(judge, "event_id long, push long, repo long, name string, old long, new long, status string, ok boolean, applied boolean")


def _status(valid: bool, current: int, old: int, new: int) -> str:
    if not valid:
        return "invalid ref"
    if new == ZERO:
        return "no such ref" if current == ZERO else "ok" if current == old else "stale old-oid"
    if current == ZERO:
        return "ok" if old == ZERO else "expected zero old-oid"
    return "ok" if current == old else "stale old-oid"


def reports(judged: DataFrame) -> DataFrame:
    """repo, push, report, changed: a line "ok ref" or "ng ref reason" for each command, in order."""
    line = F.when(F.col("ok"), F.concat(F.lit("ok "), "name")).otherwise(F.concat_ws(" ", F.lit("ng"), "name", "status"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"])
    return judged.groupBy("repo", "push").agg(F.array_join(lines, "\n").alias("report"), F.every("applied").alias("changed"))


def apply_commands(refs: DataFrame, judged: DataFrame) -> DataFrame:
    """The references after the applied commands; of several to one reference the last one wins."""
    last = judged.where("applied").groupBy("repo", "name").agg(F.max_by("new", F.struct("push", "event_id")).alias("new"))
    rows = refs.join(last, ["repo", "name"], "full")
    return rows.select("repo", "name", F.coalesce("new", "oid").alias("oid")).where(F.col("oid") != ZERO)
