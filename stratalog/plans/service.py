"""Registered queries: hydration, pack lists, schedules and small states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalog.functions import keys
from stratalog.operators import hydration, lookups, maintain, packs, service
from stratalog.plans.prelude import COMMITS, LAYOUT, MEMBERS, PACKS, sql
from stratalog.plans.queries import AS_OF, KEPT
from stratalog.plans.registry import query
from stratalog.sources import tables
from stratalog.sources.tables import table


def _listed(spark, sf_dir):
    return tables.pack_list(tables.pack_objects(spark, sf_dir)).withColumn("repo", F.lit(0).cast("long"))


def _window(spark, sf_dir):
    return hydration.stable_window(packs.keep_set(_listed(spark, sf_dir), keep=10), 6)


STABLE = "win AS (SELECT pack, position FROM (SELECT pack, row_number() OVER (ORDER BY ord) - 1 AS position FROM keep JOIN weights USING (kind, unit) WHERE kept AND epoch IS NOT NULL) WHERE position < 6)"
COVER = "cover AS (SELECT DISTINCT oid FROM members SEMI JOIN win USING (pack))"


@query(sql(MEMBERS, PACKS, KEPT, STABLE, "SELECT 0::BIGINT AS repo, pack, position FROM win"))
def stable_window(spark, sf_dir):
    """The first six hydration packs of stable epochs: the window's bound is the feature."""
    return _window(spark, sf_dir)


@query(sql(MEMBERS, PACKS, "SELECT * FROM (SELECT 0::BIGINT AS repo, pack, row_number() OVER (ORDER BY is_latest DESC, ord) - 1 AS position FROM (SELECT pack, ord, ord = 3 AS is_latest FROM packs)) WHERE position < 8"))
def recent_window(spark, sf_dir):
    """The latest pack (here the fourth of the list) and the next ones: the window's bound is the feature."""
    return hydration.recent_window(_listed(spark, sf_dir).withColumn("is_latest", F.col("ord") == 3), 8)


@query(sql(MEMBERS, PACKS, KEPT, STABLE, COVER, "SELECT 0::BIGINT AS repo, oid FROM cover"))
def hydration_cover(spark, sf_dir):
    return hydration.cover(_window(spark, sf_dir), tables.pack_objects(spark, sf_dir))


@query(sql(MEMBERS, PACKS, KEPT, STABLE, COVER, "SELECT 0::BIGINT AS repo, count(*) AS covered, count(*) > 0 AS any_covered FROM cover"))
def hydration_cover_count(spark, sf_dir):
    return hydration.cover(_window(spark, sf_dir), tables.pack_objects(spark, sf_dir)).groupBy("repo").agg(F.count(F.lit(1)).alias("covered")).withColumn("any_covered", F.col("covered") > 0)


@query(
    sql(
        MEMBERS, PACKS, LAYOUT, KEPT, STABLE, COVER,
        """o AS (SELECT layout.pack, oid, row_number() OVER (PARTITION BY pack ORDER BY "offset") - 1 AS place, count(*) OVER (PARTITION BY pack) AS n FROM layout SEMI JOIN win USING (pack)),
        e AS (SELECT pack, CASE WHEN oid % 4 > 0 THEN oid - 1 END AS base FROM o WHERE place % greatest(1, n // 128) = 0 AND place // greatest(1, n // 128) < 128),
        b AS (SELECT DISTINCT base FROM e WHERE base IS NOT NULL AND (NOT EXISTS (SELECT 1 FROM members m WHERE m.pack = e.pack AND m.oid = base) OR base NOT IN (SELECT oid FROM cover))),
        l AS (SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT oid FROM cover)),
        c AS (SELECT (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM l) AS l)
        SELECT 0::BIGINT AS repo, b AS delta_bases, l AS loose_only, b + l AS to_pack, ceil((b + l) / 50)::BIGINT AS segments FROM c""",
    )
)
def hydration_plan(spark, sf_dir):
    """An estimate from evenly sampled entries: the sampling is the feature."""
    members = tables.pack_objects(spark, sf_dir)
    window = _window(spark, sf_dir)
    covered = hydration.cover(window, members)
    entries = hydration.sampled(packs.layout(members).join(window.select("pack", "repo"), "pack"))
    entries = entries.select("repo", "pack", F.when(F.col("oid") % 4 > 0, F.col("oid") - 1).alias("base"))
    loose = table(spark, sf_dir, "labels").select(F.lit(0).cast("long").alias("repo"), F.col("doc_id").alias("oid")).join(covered, ["repo", "oid"], "left_anti")
    return hydration.plan(hydration.bases_to_pack(entries, members, covered), loose, 50)


@query(sql(MEMBERS, "SELECT pack, oid FROM members WHERE oid % 3 = 0 AND NOT (oid % 2 = 0 AND oid % 5 > 0)"))
def pending_after_build(spark, sf_dir):
    """What is still pending when a segment has been built; built oids that were not pending change nothing."""
    members = tables.pack_objects(spark, sf_dir).select("pack", "oid")
    return maintain.delete(members.where("oid % 3 = 0"), members.where("oid % 2 = 0 and oid % 5 > 0"), ["pack", "oid"])


@query(sql(MEMBERS, PACKS, KEPT, STABLE, COVER, "SELECT 0::BIGINT AS repo, oid FROM cover UNION SELECT 0, oid FROM members WHERE pack % 100 = 5 UNION SELECT 0, doc_id FROM labels"))
def coverage_union(spark, sf_dir):
    """Coverage with what was built and what its index names."""
    members = tables.pack_objects(spark, sf_dir)
    built = members.where("pack % 100 = 5").select(F.lit(0).cast("long").alias("repo"), "oid")
    indexed = table(spark, sf_dir, "labels").select(F.lit(0).cast("long").alias("repo"), F.col("doc_id").alias("oid"))
    return maintain.insert_ignore(hydration.cover(_window(spark, sf_dir), members), built.unionByName(indexed), ["repo", "oid"])


YEARS = """years AS (
  SELECT pack // 100 AS repo, pack, row_number() OVER (PARTITION BY pack // 100 ORDER BY pack DESC) - 1 AS ord, CASE WHEN pack // 100 % 3 > 0 AND pack % 100 % 4 = 0 THEN pack // 100 * 10 + pack % 100 // 7 END AS epoch FROM packs
)"""


def _years(spark, sf_dir):
    """A list of packs for each year; every third year has no hydration packs."""
    rows = tables.pack_list(tables.pack_objects(spark, sf_dir)).withColumn("repo", F.floor(F.col("pack") / 100))
    month = F.col("pack") % 100
    epoch = F.when((F.col("repo") % 3 > 0) & (month % 4 == 0), F.col("repo") * 10 + F.floor(month / 7))
    ord_ = (F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("pack"))) - 1).cast("long")
    return rows.select("repo", "pack", ord_.alias("ord"), epoch.alias("epoch")).withColumn("is_latest", F.col("ord") == 0)


@query(
    sql(
        MEMBERS, PACKS, YEARS,
        """k AS (SELECT *, CASE WHEN ord = 0 THEN 0 WHEN epoch IS NOT NULL THEN 1 ELSE 2 END AS kind, CASE WHEN ord = 0 THEN -1 WHEN epoch IS NOT NULL THEN min(ord) OVER (PARTITION BY repo, epoch) ELSE ord END AS unit FROM years),
        w AS (SELECT repo, kind, unit, coalesce(sum(count(*)) OVER (PARTITION BY repo ORDER BY kind, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 4 AS kept FROM k GROUP BY repo, kind, unit),
        g AS (SELECT k.*, NOT kept AND count(epoch) OVER (PARTITION BY repo) > 0 AS gone FROM k JOIN w USING (repo, kind, unit))
        SELECT repo, count_if(gone) AS removed, count_if(NOT gone) AS stays, coalesce(max(CASE WHEN ord = 0 AND NOT gone THEN pack END), arg_min(pack, ord) FILTER (NOT gone)) AS latest, bool_or(gone AND epoch IS NOT NULL) AS follow_up FROM g GROUP BY repo""",
    )
)
def maintenance_run(spark, sf_dir):
    return hydration.maintained(packs.keep_set(_years(spark, sf_dir), keep=4))


@query(sql(MEMBERS, PACKS, YEARS, "SELECT repo, count(*) AS packs, coalesce(max(CASE WHEN ord = 0 THEN pack END), arg_min(pack, ord)) AS latest FROM years WHERE pack % 100 <> 12 - repo % 3 GROUP BY repo"))
def pack_removed(spark, sf_dir):
    return hydration.latest_of(_years(spark, sf_dir), F.col("pack") % 100 == 12 - F.col("repo") % 3)


@query(sql(MEMBERS, PACKS, YEARS, "SELECT repo, count_if(epoch IS NULL) AS packs, coalesce(max(CASE WHEN ord = 0 AND epoch IS NULL THEN pack END), arg_min(pack, ord) FILTER (epoch IS NULL)) AS latest FROM years GROUP BY repo"))
def hydration_cleared(spark, sf_dir):
    return hydration.latest_of(_years(spark, sf_dir), F.col("epoch").isNotNull())


@query(
    sql(
        MEMBERS, PACKS, YEARS,
        """l AS (SELECT repo, pack, ord::DOUBLE AS place FROM years UNION ALL SELECT repo, repo * 100 + 77, coalesce(max(CASE WHEN pack % 100 = 6 AND repo % 3 > 0 THEN ord END), -1) + 0.5 FROM years GROUP BY repo)
        SELECT repo, pack, row_number() OVER (PARTITION BY repo ORDER BY place) - 1 AS ord FROM l""",
    )
)
def hydration_pack_insert(spark, sf_dir):
    listed = _years(spark, sf_dir).withColumn("is_latest", (F.col("pack") % 100 == 6) & (F.col("repo") % 3 > 0))
    return hydration.inserted_after_latest(listed, listed.select("repo", (F.col("repo") * 100 + 77).alias("pack")).distinct())


NOW_MS = AS_OF * 1000


@query(
    sql(
        f"""a AS (SELECT user_id, floor(epoch(max(ts)))::BIGINT * 1000 AS access, floor(epoch(max(CASE WHEN event_type = 'purchase' THEN ts END)))::BIGINT * 1000 AS care FROM events GROUP BY user_id),
        s AS (SELECT *, user_id % 11 = 0 AS unpacking, CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'error' ELSE 'plan' END AS stage, {NOW_MS} + CASE WHEN user_id % 3 = 0 THEN user_id * 1000 ELSE -5 END AS retry_at, user_id % 4 = 0 AS queued,
          CASE WHEN access + 1800000 <= {NOW_MS} THEN {NOW_MS} + 1800000 ELSE access + 1800000 END AS idle,
          CASE WHEN coalesce(care, {NOW_MS}) + 86400000 <= {NOW_MS} THEN {NOW_MS} + 86400000 ELSE coalesce(care, {NOW_MS}) + 86400000 END AS maint FROM a),
        r AS (SELECT *, CASE WHEN unpacking THEN 'unpack' WHEN stage = 'plan' OR (stage IS NULL AND queued) THEN 'hydration' WHEN maint <= idle THEN 'maint' ELSE 'idle' END AS reason FROM s),
        t AS (SELECT *, (CASE WHEN reason = 'unpack' THEN {NOW_MS} + 500 WHEN reason = 'hydration' THEN CASE WHEN stage = 'plan' AND retry_at > {NOW_MS} THEN retry_at ELSE {NOW_MS} + 500 END ELSE least(idle, maint) END)::BIGINT AS "at" FROM r)
        SELECT user_id, "at", reason, (CASE WHEN user_id % 2 = 0 OR "at" < {NOW_MS} + 60000 THEN greatest("at", {NOW_MS} + 5) ELSE {NOW_MS} + 60000 END)::BIGINT AS alarm FROM t"""
    )
)
def next_alarm(spark, sf_dir):
    a = tables.pushes(spark, sf_dir).groupBy("user_id").agg((F.max("ts_s") * 1000).alias("access"), (F.max(F.when(F.col("event_type") == "purchase", F.col("ts_s"))) * 1000).alias("care"))
    now, u = F.lit(NOW_MS).cast("long"), F.col("user_id")
    stage = F.when(u % 5 == 1, "error").when(u % 5 > 1, "plan")
    retry = now + F.when(u % 3 == 0, u * 1000).otherwise(-5)
    rows = a.select("user_id", service.next_alarm(now, u % 11 == 0, stage, retry, u % 4 == 0, F.col("access"), F.col("care")).alias("n"))
    return rows.select("user_id", "n.at", "n.reason", service.sooner(F.when(u % 2 == 1, now + 60000), F.col("n.at"), now).alias("alarm"))


@query(sql(MEMBERS, "o AS (SELECT *, (row_number() OVER (PARTITION BY pack ORDER BY oid) - 1) // 100 AS chunk, count(*) OVER (PARTITION BY pack) AS n FROM members) SELECT pack, oid, chunk, floor(100 * least((chunk + 1) * 100, n) / n + 0.5)::BIGINT AS percent FROM o"))
def unpack_chunks(spark, sf_dir):
    return service.chunks(tables.pack_objects(spark, sf_dir))


@query(
    sql(
        """p AS (SELECT p_partkey, p_size * 10 AS total, p_partkey % 500 AS done, p_partkey % 3 AS run, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE p_size END AS nxt FROM part)
        SELECT p_partkey, CASE WHEN done < total THEN 'continue' WHEN nxt > 0 THEN 'promote' ELSE 'hydrate' END AS action, (CASE WHEN done < total THEN CASE WHEN run = 0 THEN 1000 ELSE 500 END WHEN nxt > 0 THEN 500 END)::BIGINT AS delay FROM p"""
    )
)
def unpack_steps(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    follow = F.when(n % 4 == 1, 0).when(n % 4 > 1, n)
    return table(spark, sf_dir, "part").select("p_partkey", service.after_slice(n * 10, k % 500, k % 3, follow).alias("s")).select("p_partkey", "s.action", "s.delay")


@query(
    sql(
        """e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS ts_s, event_type = 'error' AS failed FROM events),
        r AS (SELECT *, count_if(NOT failed) OVER (PARTITION BY user_id ORDER BY ts_s, event_id) AS run FROM e)
        SELECT user_id, event_id, ts_s, failed, count_if(failed) OVER (PARTITION BY user_id, run ORDER BY ts_s, event_id) AS retries, CASE WHEN failed THEN ts_s * 1000 + 1000 END AS retry_at FROM r"""
    )
)
def retry_counters(spark, sf_dir):
    e = tables.pushes(spark, sf_dir).select("user_id", "event_id", "ts_s", (F.col("event_type") == "error").alias("failed"))
    return service.retries(e, "user_id", ["ts_s", "event_id"], F.col("failed"), F.col("ts_s") * 1000, 500)


@query(sql("l AS (SELECT user_id AS owner, event_id % 5 AS token, arg_max(event_type <> 'click', event_id) AS added FROM events GROUP BY 1, 2) SELECT owner, string_agg('t' || token, ',' ORDER BY token) AS tokens FROM l WHERE added GROUP BY owner"))
def owner_tokens(spark, sf_dir):
    e = tables.pushes(spark, sf_dir)
    changes = e.select(F.col("user_id").alias("owner"), F.concat(F.lit("t"), F.col("event_id") % 5).alias("token"), F.col("event_id").alias("seq"), (F.col("event_type") != "click").alias("added"))
    return service.token_sets(changes).select("owner", F.array_join("tokens", ",").alias("tokens"))


@query(sql("SELECT c_custkey, c_name FROM customer WHERE NOT (c_nationkey % 5 = 0 AND c_custkey % 2 = 0)"))
def purged_repos(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    asked = c.where("c_nationkey % 5 = 0").select("c_custkey", F.concat(F.lit("purge-"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("x")).alias("confirm"))
    return service.purged(c.select("c_custkey", "c_name"), asked, "c_custkey")


@query(
    sql(
        """r AS (SELECT s_suppkey, s_suppkey % 2 AS haves, s_suppkey % 4 AS packs, s_suppkey % 9 AS union_size, s_suppkey % 5 AS missing_roots, s_suppkey % 3 AS covering, s_suppkey % 7 > 0 AS closed FROM supplier)
        SELECT s_suppkey, CASE WHEN haves = 0 AND packs >= 2 AND union_size > 0 THEN CASE WHEN missing_roots > 0 THEN 'union of all' ELSE 'union' END WHEN packs = 0 THEN 'not ready'
          WHEN NOT closed THEN CASE WHEN packs >= 2 THEN 'union' ELSE 'not ready' END WHEN covering > 0 THEN 'one pack' ELSE 'several packs' END AS plan FROM r"""
    )
)
def fetch_plan(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", *((k % n).alias(c) for c, n in (("haves", 2), ("packs", 4), ("union_size", 9), ("missing_roots", 5), ("covering", 3))), (k % 7 > 0).alias("closed"))
    return service.fetch_plans(rows).select("s_suppkey", "plan")


@query(sql(COMMITS, "w AS (SELECT author AS request, oid, row_number() OVER (PARTITION BY author ORDER BY oid DESC) - 1 AS position FROM commits) SELECT request, count_if(oid % 7 = 0) AS missing FROM w WHERE position < 16 GROUP BY request"))
def missing_roots(spark, sf_dir):
    """Of the first sixteen wants of a request: the bound is the feature."""
    rows = tables.commits(spark, sf_dir)
    wants = lookups.page(rows.select(F.col("author").alias("request"), "oid"), "request", [F.desc("oid")], 0).withColumn("position", F.col("position") - 1)
    trees = rows.select("oid", (F.col("oid") + tables.TREES).alias("tree"))
    held = rows.where("oid % 7 <> 0").select(F.col("author").alias("request"), (F.col("oid") + tables.TREES).alias("oid"))
    return service.missing_roots(wants, trees, held)


@query(
    sql(
        """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'Running: ' || CASE p_size % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'done' ELSE 'plan' END WHEN p_size % 3 = 1 THEN 'Completed' WHEN p_size % 4 > 0 THEN 'Queued (' || p_size % 4 || ' pending)'
          WHEN p_size % 5 > 0 AND p_size % 6 > 0 THEN 'Completed (hydration packs present)' ELSE 'Not Started' END AS status FROM part"""
    )
)
def hydration_statuses(spark, sf_dir):
    n = F.col("p_size")
    stage = F.when(n % 3 == 1, "done").when(n % 3 == 2, "plan")
    return table(spark, sf_dir, "part").select("p_partkey", keys.hydration_status(n % 7 == 0, stage, n % 4, n % 5, n % 6).alias("status"))
