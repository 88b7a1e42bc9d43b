"""The registered queries over version histories, each with its DuckDB oracle beside it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalog.functions import codec, http, text
from stratalog.operators import graph, maintain, packs, refs
from stratalog.plans.prelude import BRANCHES, COMMITS, EDGES, HEADS, LAYOUT, MEMBERS, PACKS, TAGS, sql
from stratalog.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from stratalog.sources import tables
from stratalog.sources.staging import written
from stratalog.sources.tables import table
from stratalog.streaming import state

# References.

REQUEST = """CASE c_custkey % 4 WHEN 0 THEN 'refs/heads/c' || c_custkey WHEN 1 THEN 'c' || c_custkey WHEN 2 THEN 'n' || c_nationkey ELSE 'HEAD' END"""


@query(
    sql(
        COMMITS, BRANCHES, TAGS, HEADS,
        "refs AS (SELECT repo, name, oid FROM branches UNION ALL SELECT repo, name, oid FROM tags)",
        f"q AS (SELECT c_custkey, c_nationkey::BIGINT AS repo, {REQUEST} AS request FROM customer)",
        """f AS (SELECT q.*, CASE WHEN request = 'HEAD' THEN coalesce(target, 'refs/heads/main') ELSE request END AS full_name FROM q LEFT JOIN heads USING (repo))
        SELECT c_custkey, f.repo, request, coalesce(a.oid, b.oid)::VARCHAR AS oid FROM f
        LEFT JOIN refs a ON a.repo = f.repo AND a.name = CASE WHEN full_name LIKE 'refs/%' THEN full_name ELSE 'refs/heads/' || full_name END
        LEFT JOIN refs b ON b.repo = f.repo AND full_name NOT LIKE 'refs/%' AND b.name = 'refs/tags/' || full_name""",
    )
)
def ref_resolve(spark, sf_dir):
    rows = tables.commits(spark, sf_dir)
    every = tables.branch_heads(rows).unionByName(tables.tags(rows).drop("peeled"))
    c = table(spark, sf_dir, "customer")
    requests = c.select("c_custkey", F.col("c_nationkey").cast("long").alias("repo"), F.expr(REQUEST).alias("request"))
    return refs.resolve(requests, every, tables.heads(rows))


@query(sql(COMMITS, BRANCHES, HEADS, "SELECT repo, target, oid, oid IS NULL AS unborn FROM heads LEFT JOIN branches USING (repo) WHERE name = target OR name IS NULL"))
def head_state(spark, sf_dir):
    rows = tables.commits(spark, sf_dir)
    return refs.head_state(tables.heads(rows), tables.branch_heads(rows))


@query(
    sql(
        COMMITS, BRANCHES, TAGS,
        """SELECT repo, name, oid, NULL::BIGINT AS peeled FROM branches WHERE starts_with(name, 'refs/heads/c1') UNION ALL SELECT repo, name, oid, peeled FROM tags""",
    )
)
def ls_refs_prefix_peel(spark, sf_dir):
    rows = tables.commits(spark, sf_dir)
    marked = tables.tags(rows)
    return refs.listing(tables.branch_heads(rows).unionByName(marked.drop("peeled")), marked, ["refs/tags/", "refs/heads/c1"])


BRANCH_NAME = "'refs/heads/' || CASE e.event_id % 11 WHEN 0 THEN 'bad name' WHEN 1 THEN 'x/../y' WHEN 2 THEN 'a.lock' ELSE 'c' || e.user_id END"
BAD_NAMES = "('refs/heads/bad name', 'refs/heads/x/../y', 'refs/heads/a.lock')"
#: Pushes of each repository in order; the state of a fold is the list of references that pushes have changed.
CAS = (
    f"""c0 AS (SELECT e.event_id, floor(epoch(ts) / 600)::BIGINT AS push, {BRANCH_NAME} AS name, event_type, c_nationkey::BIGINT AS repo
        FROM events e JOIN customer ON user_id = c_custkey)""",
    """c1 AS (SELECT c0.*, coalesce(b.oid, 0) AS head, CASE WHEN event_type = 'signup' THEN 0 WHEN event_type = 'error' THEN coalesce(b.oid, 0) + 1 ELSE coalesce(b.oid, 0) END AS "old",
        CASE WHEN event_type = 'click' THEN 0 ELSE event_id + 1 END AS "new" FROM c0 LEFT JOIN branches b ON b.repo = c0.repo AND b.name = c0.name)""",
    """c2 AS (SELECT repo, push, row_number() OVER (PARTITION BY repo ORDER BY push) AS k,
        list({'id': event_id, 'name': name, 'head': head, 'old': "old", 'new': "new"} ORDER BY event_id) AS cmds FROM c1 GROUP BY repo, push)""",
    f"""f AS (SELECT repo, 0::BIGINT AS k, 0::BIGINT AS push, []::STRUCT(id BIGINT, name VARCHAR, "old" BIGINT, "new" BIGINT, status VARCHAR)[] AS judged, MAP([]::VARCHAR[], []::BIGINT[]) AS now FROM (SELECT DISTINCT repo FROM c2)
      UNION ALL SELECT repo, k, push, judged, CASE WHEN len(list_filter(judged, lambda j: j.status <> 'ok')) = 0
          THEN map_concat(now, map_from_entries(list_transform(list_filter(judged, lambda j: len(list_filter(judged, lambda i: i.name = j.name AND i.id > j.id)) = 0), lambda j: {{'k': j.name, 'v': j."new"}}))) ELSE now END
      FROM (SELECT c2.repo, c2.k, c2.push, now, list_transform(list_transform(cmds, lambda c: {{'c': c, 'cur': coalesce(now[c.name], c.head)}}),
          lambda x: {{'id': x.c.id, 'name': x.c.name, 'old': x.c."old", 'new': x.c."new", 'status': CASE WHEN x.c.name IN {BAD_NAMES} THEN 'invalid ref'
            WHEN x.c."new" = 0 AND x.cur = 0 THEN 'no such ref' WHEN x.c."new" = 0 AND x.cur <> x.c."old" THEN 'stale old-oid' WHEN x.c."new" = 0 THEN 'ok'
            WHEN x.cur = 0 AND x.c."old" <> 0 THEN 'expected zero old-oid' WHEN x.cur <> 0 AND x.cur <> x.c."old" THEN 'stale old-oid' ELSE 'ok' END}}) AS judged
        FROM f JOIN c2 ON c2.repo = f.repo AND c2.k = f.k + 1))""",
    "j AS (SELECT repo, push, unnest(judged) AS j FROM f)",
)


@query(sql(COMMITS, BRANCHES, *CAS, """SELECT j.id AS event_id, push, repo, j.name, j."old", j."new", j.status, j.status = 'ok' AS ok, bool_and(j.status = 'ok') OVER (PARTITION BY repo, push) AS applied FROM j""", recursive=True))
def refs_cas_apply(spark, sf_dir):
    return refs.cas(_push_commands(spark, sf_dir), tables.branch_heads(tables.commits(spark, sf_dir)))


@query(
    sql(
        COMMITS, BRANCHES, *CAS,
        """s AS (SELECT repo, push, j.id AS event_id, j.name AS name, j.status AS status, bool_and(j.status = 'ok') OVER (PARTITION BY repo, push) AS applied FROM j)
        SELECT repo, push, string_agg(CASE WHEN status = 'ok' THEN 'ok ' || name ELSE 'ng ' || name || ' ' || status END, chr(10) ORDER BY event_id) AS report, bool_and(applied) AS changed FROM s GROUP BY repo, push""",
        recursive=True,
    )
)
def push_reports(spark, sf_dir):
    judged = refs.cas(_push_commands(spark, sf_dir), tables.branch_heads(tables.commits(spark, sf_dir)))
    return refs.reports(judged)


@query(
    sql(
        COMMITS, BRANCHES, *CAS,
        """last AS (SELECT repo, now FROM f QUALIFY row_number() OVER (PARTITION BY repo ORDER BY k DESC) = 1),
        c AS (SELECT repo, unnest(map_entries(now)) AS e FROM last)
        SELECT repo, name, oid FROM (SELECT coalesce(b.repo, c.repo) AS repo, coalesce(b.name, c.e.key) AS name, coalesce(c.e.value, b.oid) AS oid FROM branches b FULL JOIN c ON c.repo = b.repo AND c.e.key = b.name) WHERE oid <> 0""",
        recursive=True,
    )
)
def refs_after_pushes(spark, sf_dir):
    heads = tables.branch_heads(tables.commits(spark, sf_dir))
    return refs.apply_commands(heads, refs.cas(_push_commands(spark, sf_dir), heads))


def _push_commands(spark, sf_dir):
    e = table(spark, sf_dir, "events").alias("e")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("repo"))
    rows = e.join(c, "user_id").select("e.event_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600).alias("push"), "repo", F.expr(BRANCH_NAME.replace("e.user_id", "user_id")).alias("name"), "event_type")
    head = tables.branch_heads(tables.commits(spark, sf_dir)).withColumnRenamed("oid", "head")
    rows = rows.join(head, ["repo", "name"], "left")
    known = F.coalesce("head", F.lit(0))
    old = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "error", known + 1).otherwise(known)
    new = F.when(F.col("event_type") == "click", 0).otherwise(F.col("event_id") + 1)
    return rows.select("event_id", "push", "repo", "name", old.cast("long").alias("old"), new.cast("long").alias("new"))


@query(
    sql(
        """n AS (SELECT DISTINCT url AS u, substring(url, instr(url, '://') + 3) AS name FROM pages)
        SELECT u, 'refs/heads/' || name AS name,
          name <> '' AND NOT (regexp_matches(name, '[\\x00-\\x20~^:?*\\[]') OR contains(name, chr(92)) OR contains('refs/heads/' || name, '//') OR contains(name, '@{')
            OR name LIKE '%/' OR name LIKE '%.' OR name LIKE '%.lock' OR len(list_filter(string_split(name, '/'), lambda p: p IN ('.', '..'))) > 0) AS valid FROM n"""
    )
)
def ref_name_rules(spark, sf_dir):
    name = F.concat(F.lit("refs/heads/"), F.expr("substring(url, instr(url, '://') + 3)"))
    return table(spark, sf_dir, "pages").select(F.col("url").alias("u")).distinct().select("u", F.expr("concat('refs/heads/', substring(u, instr(u, '://') + 3))").alias("name")).select("u", "name", refs.is_valid_name(F.col("name")).alias("valid"))


# Histories and graphs.


def _edges(rows):
    """Parent edges with the repository that they lie in."""
    return tables.parent_edges(rows).withColumnRenamed("repo", "root")


def _tips(rows):
    return tables.tags(rows).select(F.col("repo").alias("root"), F.col("peeled").alias("oid"))


@query(
    sql(
        COMMITS, BRANCHES,
        "walk AS (SELECT oid AS root, oid, 0::BIGINT AS depth FROM branches UNION ALL SELECT root, p1, depth + 1 FROM walk JOIN commits USING (oid) WHERE p1 IS NOT NULL AND depth < 9)",
        "SELECT root, oid, depth, author, when_s, message, p2 IS NOT NULL AS is_merge FROM walk JOIN commits USING (oid) WHERE depth BETWEEN 5 AND 9",
        recursive=True,
    )
)
def first_parent_page(spark, sf_dir):
    rows = tables.commits(spark, sf_dir)
    starts = tables.branch_heads(rows).select(F.col("oid").alias("root"), "oid")
    return graph.first_parent_page(rows, starts, offset=5, limit=5)


@query(
    sql(
        COMMITS,
        "m AS (SELECT oid, p1, p2 FROM commits WHERE p2 IS NOT NULL)",
        "side AS (SELECT oid AS merge, p2 AS oid, 0::BIGINT AS depth FROM m UNION ALL SELECT merge, p1, depth + 1 FROM side JOIN commits USING (oid) WHERE p1 IS NOT NULL AND depth < 20)",
        "line AS (SELECT oid AS merge, p1 AS oid, 0::BIGINT AS depth FROM m WHERE p1 IS NOT NULL UNION ALL SELECT merge, p1, depth + 1 FROM line JOIN commits USING (oid) WHERE p1 IS NOT NULL AND depth < 100)",
        "hit AS (SELECT merge, min(side.depth) AS stop FROM side JOIN line USING (merge, oid) GROUP BY merge)",
        """k AS (SELECT merge, oid, depth, min((when_s, oid)) OVER (PARTITION BY merge ORDER BY depth) AS key
             FROM side JOIN commits USING (oid) LEFT JOIN hit USING (merge) WHERE stop IS NULL OR depth < stop)
        SELECT * FROM (SELECT merge, oid, row_number() OVER (PARTITION BY merge ORDER BY key DESC, depth) AS rank FROM k) WHERE rank <= 20""",
        recursive=True,
    )
)
def merge_side_walk(spark, sf_dir):
    rows = tables.commits(spark, sf_dir)
    return graph.merge_side(rows, rows.where("p2 is not null"), limit=20, probe=100)


CLOSURE = "{name} AS (SELECT repo AS root, peeled AS oid FROM tags UNION SELECT root, dst FROM {name} JOIN edges ON oid = src)"


@query(sql(COMMITS, EDGES, TAGS, CLOSURE.format(name="reach"), "SELECT root, oid FROM reach", recursive=True))
def closure_reach(spark, sf_dir):
    rows = written(tables.commits(spark, sf_dir), "commits")
    return graph.closure(_edges(rows), _tips(rows))


HAVES = "haves AS (SELECT repo AS root, max(oid) AS oid FROM commits WHERE message = '2-HIGH' GROUP BY repo)"


def _haves(rows):
    return rows.where("message = '2-HIGH'").groupBy(F.col("repo").alias("root")).agg(F.max("oid").alias("oid"))


@query(
    sql(
        COMMITS, EDGES, TAGS, HAVES, CLOSURE.format(name="want"),
        "have AS (SELECT root, oid FROM haves UNION SELECT root, dst FROM have JOIN edges ON oid = src)",
        "SELECT root, oid FROM want ANTI JOIN have USING (root, oid)",
        recursive=True,
    )
)
def closure_needed_exact(spark, sf_dir):
    rows = written(tables.commits(spark, sf_dir), "commits")
    return graph.needed(_edges(rows), _tips(rows), _haves(rows))


@query(
    sql(
        COMMITS, EDGES, TAGS, HAVES,
        "chain AS (SELECT root, oid, 0 AS depth FROM haves UNION ALL SELECT root, p1, depth + 1 FROM chain JOIN commits USING (oid) WHERE p1 IS NOT NULL AND depth < 20)",
        "stop AS (SELECT DISTINCT root, oid FROM chain)",
        """want AS (SELECT repo AS root, peeled AS oid FROM tags ANTI JOIN stop ON stop.root = tags.repo AND stop.oid = peeled
            UNION SELECT want.root, dst FROM want JOIN edges ON want.oid = src LEFT JOIN stop ON stop.root = want.root AND stop.oid = dst WHERE stop.oid IS NULL)
        SELECT root, oid FROM want""",
        recursive=True,
    )
)
def closure_needed_stopset(spark, sf_dir):
    rows = written(tables.commits(spark, sf_dir), "commits")
    stop = graph.ancestors(rows, _haves(rows), 20)
    return graph.closure(_edges(rows), _tips(rows), stop)


@query(
    sql(
        COMMITS, EDGES,
        "deep AS (SELECT oid, 0::BIGINT AS level FROM commits UNION SELECT src, level + 1 FROM deep JOIN edges ON dst = deep.oid)",
        "SELECT oid, max(level) AS level FROM deep GROUP BY oid",
        recursive=True,
    )
)
def topo_levels(spark, sf_dir):
    rows = tables.commits(spark, sf_dir)
    return graph.levels(tables.parent_edges(rows), rows.select("oid"))


@query(
    sql(
        COMMITS,
        """w AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN conv_id * 7 % 20000 ELSE turn + conv_id END AS oid FROM conversations),
        k AS (SELECT conv_id, turn, w.oid FROM w SEMI JOIN commits ON commits.oid = w.oid WHERE turn < 128)
        SELECT conv_id, turn, oid, CASE WHEN lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 'ready' ELSE 'common' END AS ack FROM k""",
    )
)
def want_have_common(spark, sf_dir):
    known = tables.commits(spark, sf_dir).select("oid")
    haves = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("conv_id") * 7 % 20000).otherwise(F.col("turn") + F.col("conv_id")).alias("oid"))
    common = haves.where("turn < 128").join(known, "oid", "left_semi")
    last = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).isNull()
    return common.select("conv_id", "turn", "oid", F.when(last, "ready").otherwise("common").alias("ack"))


@query(
    sql(
        """d AS (SELECT doc_id, unnest([doc_id, doc_id + 1, doc_id]) AS oid, unnest([0, 1, 2]) AS pos FROM documents)
        SELECT doc_id, pos::BIGINT AS pos, d.oid, l.doc_id IS NOT NULL AS present FROM d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.oid"""
    ).replace("SELECT doc_id, pos::BIGINT", "SELECT d.doc_id, pos::BIGINT")
)
def has_batch_aligned(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array("doc_id", F.col("doc_id") + 1, "doc_id")).alias("pos", "oid"))
    held = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("oid")).distinct().withColumn("_in", F.lit(True))
    return asked.join(held, "oid", "left").select("doc_id", F.col("pos").cast("long"), "oid", F.col("_in").isNotNull().alias("present"))


@query(
    sql(
        COMMITS, EDGES, "have AS (SELECT oid FROM commits WHERE oid % 10 <> 0)",
        """SELECT src AS oid, dst AS missing, CASE ordinal WHEN 0 THEN 'parent' ELSE 'merge' END AS kind FROM edges SEMI JOIN have ON have.oid = src ANTI JOIN have h2 ON h2.oid = dst""",
    )
)
def connectivity_violations(spark, sf_dir):
    rows = tables.commits(spark, sf_dir)
    have = rows.where("oid % 10 <> 0").select("oid")
    edges = tables.parent_edges(rows)
    inside = edges.join(have, edges["src"] == have["oid"], "left_semi")
    lost = inside.join(have, inside["dst"] == have["oid"], "left_anti")
    return lost.select(F.col("src").alias("oid"), F.col("dst").alias("missing"), F.when(F.col("ordinal") == 0, "parent").otherwise("merge").alias("kind"))


@query(
    sql(
        """t AS (SELECT p_partkey AS oid, CASE WHEN p_size % 5 > 0 THEN p_partkey // 2 END AS target FROM part),
        h AS (SELECT oid, target FROM t WHERE target IS NOT NULL)
        SELECT 'n' || t.oid AS name, t.oid, CASE WHEN h4.oid IS NULL THEN coalesce(h3.target, h2.target, h1.target, t.oid) END AS final,
          ((h1.oid IS NOT NULL)::INT + (h2.oid IS NOT NULL)::INT + (h3.oid IS NOT NULL)::INT)::BIGINT AS steps
        FROM t LEFT JOIN h h1 ON h1.oid = t.oid LEFT JOIN h h2 ON h2.oid = h1.target LEFT JOIN h h3 ON h3.oid = h2.target
        LEFT JOIN h h4 ON h4.oid = coalesce(h3.target, h2.target, h1.target, t.oid)"""
    )
)
def tag_unwrap_depth3(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("oid"), F.when(F.col("p_size") % 5 > 0, F.floor(F.col("p_partkey") / 2)).alias("target"))
    return graph.unwrap(t.where("target is not null"), t.select(F.concat(F.lit("n"), "oid").alias("name"), "oid"))


TREE = """tree AS (
  SELECT -1::BIGINT AS tree, r_name AS name, r_regionkey::BIGINT AS child, true AS is_dir FROM region
  UNION ALL SELECT n_regionkey, n_name, 100 + n_nationkey, true FROM nation UNION ALL SELECT 100 + s_nationkey, s_name, 1000 + s_suppkey, false FROM supplier
)"""


def _tree(spark, sf_dir):
    """Nested trees: the root holds regions, a region nations, a nation its suppliers as files."""
    row = lambda name, *c: table(spark, sf_dir, name).select(*(x.alias(n) for x, n in zip(c, ("tree", "name", "child", "is_dir"), strict=True)))
    k = lambda c, add=0: (F.col(c) + add).cast("long")
    top = row("region", F.lit(-1).cast("long"), F.col("r_name"), k("r_regionkey"), F.lit(True))
    mid = row("nation", k("n_regionkey"), F.col("n_name"), k("n_nationkey", 100), F.lit(True))
    return top.unionByName(mid).unionByName(row("supplier", k("s_nationkey", 100), F.col("s_name"), k("s_suppkey", 1000), F.lit(False)))


@query(sql(TREE, "SELECT tree, name, child, is_dir, row_number() OVER (PARTITION BY tree ORDER BY is_dir DESC, name) AS position FROM tree"))
def tree_listing(spark, sf_dir):
    order = Window.partitionBy("tree").orderBy(F.desc("is_dir"), "name")
    return _tree(spark, sf_dir).withColumn("position", F.row_number().over(order).cast("long"))


@query(
    sql(
        TREE,
        """p AS (SELECT s_suppkey AS request, string_split(CASE WHEN s_suppkey % 5 = 0 THEN r_name || '/nowhere' WHEN s_suppkey % 5 = 1 THEN r_name || '/' || n_name ELSE r_name || '/' || n_name || '/' || s_name END, '/') AS parts
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT request, array_to_string(parts, '/') AS path, CASE len(parts) WHEN 1 THEN a.child WHEN 2 THEN b.child ELSE c.child END AS oid,
          CASE len(parts) WHEN 1 THEN a.is_dir WHEN 2 THEN b.is_dir ELSE c.is_dir END AS is_dir
        FROM p LEFT JOIN tree a ON a.tree = -1 AND a.name = parts[1] LEFT JOIN tree b ON b.tree = a.child AND b.name = parts[2] LEFT JOIN tree c ON c.tree = b.child AND c.name = parts[3]""",
    )
)
def path_resolve(spark, sf_dir):
    r, n, s = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    base = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.when(F.col("s_suppkey") % 5 == 0, F.concat("r_name", F.lit("/nowhere"))).when(F.col("s_suppkey") % 5 == 1, F.concat_ws("/", "r_name", "n_name")).otherwise(F.concat_ws("/", "r_name", "n_name", "s_name"))
    rows = base.select(F.col("s_suppkey").alias("request"), path.alias("path"), F.lit(-1).cast("long").alias("oid"), F.lit(True).alias("is_dir"))
    rows = rows.withColumn("_parts", text.path_parts(F.col("path")))
    for depth in range(3):
        step = _tree(spark, sf_dir).select(F.col("tree").alias("oid"), F.col("name").alias("_name"), F.col("child").alias("_child"), F.col("is_dir").alias("_dir"))
        more = F.size("_parts") > depth
        rows = rows.withColumn("_name", F.get("_parts", F.lit(depth))).join(step, ["oid", "_name"], "left")
        rows = rows.select("request", "path", "_parts", F.when(more, F.col("_child")).otherwise(F.col("oid")).alias("oid"), F.when(more, F.col("_dir")).otherwise(F.col("is_dir")).alias("is_dir"))
    return rows.select("request", "path", "oid", "is_dir")


NAMES = ["README.md", "README.MD", "Readme.md", "README", "readme.md"]


@query(
    sql(
        f"""n AS (SELECT doc_id, source, list_position({NAMES!r}, CASE doc_id % 7 WHEN 0 THEN 'README.md' WHEN 1 THEN 'README.MD' WHEN 2 THEN 'Readme.md' WHEN 3 THEN 'README' WHEN 4 THEN 'readme.md' ELSE 'main.c' END) AS ord FROM documents)
        SELECT source, arg_min(doc_id, (ord, doc_id)) AS doc_id, min(ord)::BIGINT AS ord FROM n WHERE ord > 0 GROUP BY source"""
    )
)
def readme_first(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, [*NAMES, "main.c", "main.c"])), (F.col("doc_id") % 7 + 1).cast("int"))
    ord_ = F.array_position(F.array(*map(F.lit, NAMES)), name)
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", ord_.alias("ord")).where("ord > 0")
    return rows.groupBy("source").agg(F.min_by("doc_id", F.struct("ord", "doc_id")).alias("doc_id"), F.min("ord").alias("ord"))


# Packs.


@query(sql(MEMBERS, PACKS, "SELECT DISTINCT oid FROM members SEMI JOIN (SELECT pack FROM packs WHERE ord < 10) USING (pack)"))
def pack_union(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir)
    return packs.union_of(members, tables.pack_list(members).where("ord < 10"))


@query(
    sql(
        MEMBERS,
        """w AS (SELECT p_partkey AS request, p_partkey AS a, p_partkey + 1 AS b FROM part)
        SELECT request, pack, bool_or(oid = a) AS has_commit, bool_or(oid = b) AS has_tree FROM w JOIN members ON oid IN (a, b) GROUP BY request, pack""",
    )
)
def pack_membership_matrix(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir).select("pack", "oid")
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request"), F.posexplode(F.array("p_partkey", F.col("p_partkey") + 1)).alias("which", "oid"))
    return asked.join(members, "oid").groupBy("request", "pack").agg(F.bool_or(F.col("which") == 0).alias("has_commit"), F.bool_or(F.col("which") == 1).alias("has_tree"))


@query(sql(MEMBERS, PACKS, "SELECT oid, arg_min(pack, ord) AS pack, min(ord) AS ord, arg_min(size, ord) AS size, count(*) AS copies FROM members JOIN packs USING (pack) GROUP BY oid"))
def pack_choose_canonical(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir)
    return packs.canonical(members, tables.pack_list(members))


WANTED = "SELECT DISTINCT l_suppkey AS request, l_partkey AS oid FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 45"


@query(
    sql(
        MEMBERS, PACKS, f"w AS ({WANTED})",
        """n AS (SELECT request, count(*) AS needed FROM w GROUP BY request),
        h AS (SELECT request, pack, count(*) AS held FROM w JOIN members USING (oid) GROUP BY request, pack)
        SELECT request, arg_min(pack, ord) AS pack, any_value(needed) AS needed FROM h JOIN n USING (request) JOIN packs USING (pack) WHERE held = needed GROUP BY request""",
    )
)
def pack_single_cover(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir)
    wanted = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity >= 45").select(F.col("l_suppkey").alias("request"), F.col("l_partkey").alias("oid"))
    cover = packs.covering_packs(members, wanted).join(tables.pack_list(members).select("pack", "ord"), "pack")
    return cover.groupBy("request").agg(F.min_by("pack", "ord").alias("pack"), F.any_value("needed").alias("needed"))


@query(sql(MEMBERS, LAYOUT, 'SELECT pack, oid, size, "offset", next_offset FROM layout'))
def pack_layout_offsets(spark, sf_dir):
    return packs.layout(tables.pack_objects(spark, sf_dir))


RANGES = 'ranges AS (SELECT pack, "offset" AS "begin", next_offset AS "end" FROM layout WHERE oid % 3 = 0)'


def _ranges(spark, sf_dir):
    return packs.layout(tables.pack_objects(spark, sf_dir)).where("oid % 3 = 0").select("pack", F.col("offset").alias("begin"), F.col("next_offset").alias("end"))


@query(
    sql(
        MEMBERS, LAYOUT, RANGES,
        """g AS (SELECT *, max("end") OVER (PARTITION BY pack ORDER BY "begin", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranges),
        s AS (SELECT *, sum(CASE WHEN "begin" - reach > 64 THEN 1 ELSE 0 END) OVER (PARTITION BY pack ORDER BY "begin", "end")::BIGINT AS "group" FROM g)
        SELECT pack, "group", min("begin") AS "begin", max("end") AS "end", count(*) AS n FROM s GROUP BY pack, "group" """,
    )
)
def range_islands_gap(spark, sf_dir):
    return packs.islands(_ranges(spark, sf_dir), gap=64)


@query(
    sql(
        MEMBERS, LAYOUT, RANGES,
        """r AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY "begin", "end") AS k FROM ranges),
        f AS (SELECT pack, k, "begin", "end", "begin" AS g0, "end" AS g1, 0::BIGINT AS "group" FROM r WHERE k = 1
          UNION ALL SELECT r.pack, r.k, r."begin", r."end", CASE WHEN r."begin" - f.g1 <= 64 AND r."end" - f.g0 <= 2000 THEN f.g0 ELSE r."begin" END,
            CASE WHEN r."begin" - f.g1 <= 64 AND r."end" - f.g0 <= 2000 THEN greatest(f.g1, r."end") ELSE r."end" END,
            CASE WHEN r."begin" - f.g1 <= 64 AND r."end" - f.g0 <= 2000 THEN f."group" ELSE f."group" + 1 END FROM f JOIN r ON r.pack = f.pack AND r.k = f.k + 1)
        SELECT pack, "group", min("begin") AS "begin", max(g1) AS "end", count(*) AS n FROM f GROUP BY pack, "group" """,
        recursive=True,
    )
)
def range_groups_full(spark, sf_dir):
    return packs.greedy_groups(_ranges(spark, sf_dir), gap=64, span=2000)


ENTRIES = "entries AS (SELECT pack, oid, CASE WHEN oid % 4 > 0 THEN oid - 1 END AS base FROM members)"


@query(
    sql(
        MEMBERS, ENTRIES,
        """chain AS (SELECT pack, oid, oid AS cur, 0::BIGINT AS depth FROM entries
          UNION ALL SELECT c.pack, c.oid, e.base, c.depth + 1 FROM chain c JOIN entries e ON c.pack = e.pack AND c.cur = e.oid WHERE e.base IS NOT NULL)
        SELECT pack, oid, max(depth) AS depth, arg_max(cur, depth) AS base FROM chain GROUP BY pack, oid""",
        recursive=True,
    )
)
def delta_chain_depth(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir)
    return packs.delta_chains(members.select("pack", "oid", F.when(F.col("oid") % 4 > 0, F.col("oid") - 1).alias("base")))


@query(
    sql(
        MEMBERS, PACKS, "cover AS (SELECT epoch AS work, oid FROM members JOIN packs USING (pack) WHERE is_hydration)",
        "cand AS (SELECT pack // 100 AS work, pack, oid FROM members)",
        "SELECT work, pack, oid FROM cand ANTI JOIN cover USING (work, oid)",
    )
)
def coverage_uncovered(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir)
    cover = members.join(tables.pack_list(members).where("is_hydration").select("pack", F.col("epoch").alias("work")), "pack").select("work", "oid")
    return packs.uncovered(members.select(F.floor(F.col("pack") / 100).alias("work"), "pack", "oid"), cover)


@query(sql(MEMBERS, "SELECT pack // 100 AS work, count_if(oid % 3 = 0) AS base, count_if(oid % 3 > 0) AS loose FROM members GROUP BY 1"))
def hydration_pending_counts(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir)
    return members.groupBy(F.floor(F.col("pack") / 100).alias("work")).agg(F.count_if(F.col("oid") % 3 == 0).alias("base"), F.count_if(F.col("oid") % 3 > 0).alias("loose"))


#: One step a row: an object is taken, waits for a later segment, or ends the segment; what waits begins the next.
SEGMENTS = (
    "q AS (SELECT pack AS work, list({'oid': oid, 'size': (size * 6 + 9) // 10 + 32} ORDER BY oid) AS todo FROM members GROUP BY pack)",
    """s AS (SELECT work, 0::BIGINT AS segment, 0::BIGINT AS used, 0::BIGINT AS n, todo, []::STRUCT(oid BIGINT, size BIGINT)[] AS later, NULL::BIGINT AS taken FROM q
      UNION ALL SELECT work, CASE WHEN over THEN segment + 1 ELSE segment END, CASE WHEN over THEN 0 WHEN fits THEN used + todo[1].size ELSE used END, CASE WHEN over THEN 0 WHEN fits THEN n + 1 ELSE n END,
        CASE WHEN over THEN list_concat(later, todo) ELSE todo[2:] END, CASE WHEN over THEN [] WHEN fits THEN later ELSE list_append(later, todo[1]) END, CASE WHEN NOT over AND fits THEN todo[1].oid END
      FROM (SELECT *, len(todo) = 0 OR n >= 200 AS over, n = 0 OR used + todo[1].size <= 10000 AS fits FROM s WHERE len(todo) + len(later) > 0))""",
)


@query(sql(MEMBERS, *SEGMENTS, "SELECT work, taken AS oid, segment FROM s WHERE taken IS NOT NULL", recursive=True))
def hydration_segments(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir)
    return packs.segments(members.select(F.col("pack").alias("work"), "oid", F.col("size").alias("length")), most_objects=200, most_bytes=10_000)


KEPT = """keep AS (
  SELECT *, CASE WHEN is_latest THEN 0 WHEN epoch IS NOT NULL THEN 1 ELSE 2 END AS kind,
    CASE WHEN is_latest THEN -1 WHEN epoch IS NOT NULL THEN min(ord) OVER (PARTITION BY epoch) ELSE ord END AS unit FROM packs
), weights AS (
  SELECT kind, unit, coalesce(sum(count(*)) OVER (ORDER BY kind, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 10 AS kept FROM keep GROUP BY kind, unit
)"""


def _kept(members):
    return packs.keep_set(tables.pack_list(members).withColumn("repo", F.lit(0)), keep=10)


@query(sql(MEMBERS, PACKS, KEPT, "SELECT pack, ord, epoch, is_latest, kept FROM keep JOIN weights USING (kind, unit)"))
def retention_keep_set(spark, sf_dir):
    return _kept(tables.pack_objects(spark, sf_dir)).select("pack", "ord", "epoch", "is_latest", "kept")


@query(sql(MEMBERS, PACKS, KEPT, "SELECT pack, oid, size FROM members ANTI JOIN (SELECT pack FROM keep JOIN weights USING (kind, unit) WHERE kept) USING (pack)"))
def retention_orphans(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir)
    return packs.orphans(members, _kept(members))


@query(sql(MEMBERS, PACKS, "SELECT pack, row_number() OVER (ORDER BY is_latest DESC, is_hydration DESC, ord) AS rank FROM packs"))
def pack_candidate_order(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir)
    return packs.candidate_order(tables.pack_list(members).withColumn("repo", F.lit(0))).select("pack", "rank")


@query(
    sql(
        MEMBERS, PACKS,
        "SELECT epoch, count(*) AS packs, sum(n)::BIGINT AS objects, sum(bytes)::BIGINT AS bytes, bool_or(is_latest) AS has_latest, (floor(100 * sum(n) / (SELECT sum(n) FROM packs) + 0.5))::BIGINT AS percent FROM packs GROUP BY epoch",
    )
)
def storage_stats(spark, sf_dir):
    listed = tables.pack_list(tables.pack_objects(spark, sf_dir))
    total = listed.agg(F.sum("n").alias("_all"))
    stats = listed.groupBy("epoch").agg(F.count(F.lit(1)).alias("packs"), F.sum("n").alias("objects"), F.sum("bytes").alias("bytes"), F.bool_or("is_latest").alias("has_latest"))
    return stats.join(F.broadcast(total)).select("epoch", "packs", "objects", "bytes", "has_latest", text.percent(F.col("objects"), F.col("_all")).alias("percent"))  # one row


# Objects and texts.


@query(sql("""d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS oid FROM d"""))
def object_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", codec.object_id(F.lit("blob"), F.coalesce("text", F.lit(""))).alias("oid"))


@query(
    sql(
        """c AS (SELECT o_orderkey AS oid, sha1('t' || o_orderkey) AS tree, sha1('c' || (o_orderkey - 1)) AS p1, 'c' || o_custkey AS name, epoch(o_orderdate)::BIGINT AS when_s, o_orderpriority AS message FROM orders)
        SELECT oid, tree, CASE WHEN oid % 5 = 0 THEN 0 ELSE 1 END::BIGINT AS n_parents, CASE WHEN oid % 5 > 0 THEN p1 END AS first_parent, name AS author, name || '@x' AS email, when_s, '+0100' AS tz, message, false AS is_merge FROM c"""
    )
)
def commit_text_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    who = F.concat(F.lit("c"), "o_custkey", F.lit(" <c"), "o_custkey", F.lit("@x> "), F.unix_seconds(F.col("o_orderdate").cast("timestamp")), F.lit(" +0100"))
    sha = lambda mark, key: F.sha1(F.concat(F.lit(mark), key.cast("string")).cast("binary"))
    parent = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("parent "), sha("c", F.col("o_orderkey") - 1), F.lit("\n"))).otherwise("")
    body = F.concat(F.lit("tree "), sha("t", F.col("o_orderkey")), F.lit("\n"), parent, F.lit("author "), who, F.lit("\ncommitter "), who, F.lit("\n\n"), "o_orderpriority", F.lit("\nparent "), sha("x", F.col("o_orderkey")))
    rows = o.select(F.col("o_orderkey").alias("oid"), codec.commit_fields(body).alias("c"))
    return rows.select("oid", "c.tree", F.size("c.parents").cast("long").alias("n_parents"), F.get("c.parents", F.lit(0)).alias("first_parent"), F.col("c.author.name").alias("author"), "c.author.email", F.col("c.author.when").alias("when_s"), "c.author.tz", text.first_line(F.col("c.message")).alias("message"), (F.size("c.parents") > 1).alias("is_merge"))


@query(
    sql(
        r"""d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, regexp_matches(text[1:8192], '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS is_binary, CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(text, '\r?\n')) END::BIGINT AS lines,
          CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' bytes' ELSE printf('%.1f KB', floor(strlen(text) * 10 / 1024 + 0.5) / 10) END AS size FROM d"""
    )
)
def text_profile(spark, sf_dir):
    t = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_binary(t.cast("binary")).alias("is_binary"), text.line_count(t).alias("lines"), text.format_size(F.octet_length(t)).alias("size"))


EXT = "CASE page_id % 8 WHEN 0 THEN 'a.py' WHEN 1 THEN 'b.RS' WHEN 2 THEN 'Makefile' WHEN 3 THEN 'c.toml' WHEN 4 THEN 'run' WHEN 5 THEN 'x.unknown' WHEN 6 THEN 'page.html' ELSE 'lib.tsx' END"


@query(
    sql(
        f"""p AS (SELECT page_id, {EXT} AS name, CASE WHEN page_id % 8 = 4 THEN '#!/usr/bin/env ' || CASE page_id % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'python3' ELSE 'bash' END ELSE '' END AS line FROM pages)
        SELECT page_id, name, CASE page_id % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'makefile' WHEN 3 THEN 'ini' WHEN 6 THEN 'xml' WHEN 7 THEN 'typescript'
          WHEN 4 THEN CASE page_id % 3 WHEN 0 THEN 'javascript' WHEN 1 THEN 'python' ELSE 'bash' END END AS language FROM p"""
    )
)
def language_infer(spark, sf_dir):
    line = F.when(F.col("page_id") % 8 == 4, F.concat(F.lit("#!/usr/bin/env "), F.element_at(F.array(F.lit("node"), F.lit("python3"), F.lit("bash")), (F.col("page_id") % 3 + 1).cast("int")))).otherwise("")
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(EXT).alias("name"), line.alias("line"))
    return rows.select("page_id", "name", text.shown_language(text.language(F.col("name"), F.col("line"))).alias("language"))


@query(
    sql(
        """p AS (SELECT page_id, repeat(md5(url), 5000) AS t FROM pages WHERE html IS NOT NULL AND html <> '')
        SELECT page_id, seq, 1::BIGINT AS channel, md5(substring(t, seq * 65515 + 1, 65515)) AS payload_md5 FROM (SELECT page_id, t, unnest(range(0, ((strlen(t) + 65514) // 65515)::BIGINT)) AS seq FROM p)"""
    )
)
def sideband_frames(spark, sf_dir):
    payload = F.expr("repeat(md5(cast(url as binary)), 5000)").cast("binary")
    rows = table(spark, sf_dir, "pages").where("html is not null and html <> ''").select("page_id", F.explode(codec.frames(payload)).alias("f"))
    return rows.select("page_id", "f.seq", F.conv(F.hex(F.substring("f.frame", 1, 1)), 16, 10).cast("long").alias("channel"), F.md5(F.substring("f.frame", 2, codec.SIDEBAND_BYTES)).alias("payload_md5"))


@query(sql("SELECT conv_id, turn, strlen(text)::BIGINT AS length, true AS same FROM conversations WHERE text IS NOT NULL"))
def pktline_roundtrip(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    payload = F.col("text").cast("binary")
    rows = c.select("conv_id", "turn", payload.alias("p"), codec.pkt_lines(F.concat(codec.pkt_line(payload), F.lit(b"0000"))).alias("l"))
    same = (F.size("l") == 2) & (F.col("l")[0]["payload"] == F.col("p")) & (F.col("l")[1]["kind"] == "flush")
    return rows.select("conv_id", "turn", F.octet_length("p").cast("long").alias("length"), same.alias("same"))


# Keyed state.


def _limit_oracle(wins: str, keys: str) -> str:
    step = f"CASE WHEN {wins} THEN [0, 0, 0, 0] WHEN ts_s < u THEN [a, l, u, 1] WHEN ok THEN [0, 0, 0, 0] WHEN a = 0 OR ts_s - l >= 60 THEN [1, ts_s, 0, 2] WHEN a >= 5 THEN [a, ts_s, ts_s + 300, 1] ELSE [a + 1, ts_s, 0, 2] END"
    return sql(
        f"e AS (SELECT user_id, event_id % 3 AS ip, event_id, floor(epoch(ts))::BIGINT AS ts_s, event_type = 'signup' AS ok, row_number() OVER (PARTITION BY {keys} ORDER BY floor(epoch(ts))::BIGINT, event_id) AS k FROM (SELECT *, event_id % 3 AS ip FROM events))",
        f"""f AS (SELECT e.*, {step} AS s FROM (SELECT *, 0::BIGINT AS a, 0::BIGINT AS l, 0::BIGINT AS u FROM e WHERE k = 1) e
          UNION ALL SELECT user_id, ip, event_id, ts_s, ok, k, {step} FROM (SELECT e.*, f.s[1] AS a, f.s[2] AS l, f.s[3] AS u FROM f JOIN e ON e.k = f.k + 1 AND {' AND '.join(f'e.{c} = f.{c}' for c in keys.split(', '))}))
        SELECT user_id, ip, event_id, ts_s, ok, CASE s[4] WHEN 0 THEN 'allowed' WHEN 1 THEN 'blocked' ELSE 'failed' END AS decision FROM f""".replace("(SELECT *, 0::BIGINT AS a, 0::BIGINT AS l, 0::BIGINT AS u FROM e WHERE k = 1) e", "(SELECT *, 0::BIGINT AS a, 0::BIGINT AS l, 0::BIGINT AS u FROM e WHERE k = 1) e").replace("SELECT e.*, CASE", "SELECT user_id, ip, event_id, ts_s, ok, k, CASE"),
        recursive=True,
    )


def _attempts(spark, sf_dir):
    rows = tables.pushes(spark, sf_dir)
    return rows.select("user_id", (F.col("event_id") % 3).alias("ip"), "event_id", "ts_s", (F.col("event_type") == "signup").alias("ok"))


@query(_limit_oracle("false", "user_id, ip"))
def rate_limit_decisions(spark, sf_dir):
    return state.folded(_attempts(spark, sf_dir), ["user_id", "ip"], state.rate_limit)


@query(_limit_oracle("ok", "ip"))
def admin_limit_decisions(spark, sf_dir):
    """One key for each address; the right token wins even when the address is blocked."""
    return state.folded(_attempts(spark, sf_dir), "ip", state.admin_limit)


@query(
    sql(
        "e AS (SELECT user_id % 97 AS repo, event_id, floor(epoch(ts))::BIGINT AS ts_s, event_id % 7 * 3600 AS work_s, row_number() OVER (PARTITION BY user_id % 97 ORDER BY floor(epoch(ts))::BIGINT, event_id) AS k FROM events)",
        """f AS (SELECT repo, event_id, ts_s, work_s, k, ts_s + work_s AS act, 0::BIGINT AS nxt, 'started' AS decision FROM e WHERE k = 1
          UNION ALL SELECT repo, event_id, ts_s, work_s, k, CASE WHEN a0 = 0 THEN ts_s + work_s ELSE a0 END, CASE WHEN a0 = 0 THEN 0 WHEN n0 = 0 THEN a0 + work_s ELSE n0 END,
            CASE WHEN a0 = 0 THEN 'started' WHEN n0 = 0 THEN 'queued' ELSE 'refused' END
          FROM (SELECT e.*, CASE WHEN act > e.ts_s THEN act WHEN nxt > e.ts_s THEN nxt ELSE 0 END AS a0, CASE WHEN act > e.ts_s THEN nxt ELSE 0 END AS n0 FROM f JOIN e ON e.repo = f.repo AND e.k = f.k + 1))
        SELECT repo, event_id, ts_s, work_s, decision FROM f""",
        recursive=True,
    )
)
def push_queue_decisions(spark, sf_dir):
    e = tables.pushes(spark, sf_dir).select(F.pmod("user_id", F.lit(97)).alias("repo"), "event_id", "ts_s", (F.col("event_id") % 7 * 3600).alias("work_s"))
    return state.folded(e, "repo", state.push_queue)


@query(
    sql(
        """e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS ts_s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS k FROM events),
        f AS (SELECT *, ts_s AS kept, 'written' AS decision FROM e WHERE k = 1
          UNION ALL SELECT e.*, CASE WHEN e.ts_s - f.kept < 60 THEN f.kept ELSE e.ts_s END, CASE WHEN e.ts_s - f.kept < 60 THEN 'skipped' ELSE 'written' END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
        SELECT user_id, event_id, ts_s, decision FROM f""",
        recursive=True,
    )
)
def access_touch_throttle(spark, sf_dir):
    return state.folded(tables.pushes(spark, sf_dir).select("user_id", "event_id", "ts_s"), "user_id", state.touch)


AS_OF = 1706745600


@query(sql(f"a AS (SELECT user_id, floor(epoch(max(ts)))::BIGINT AS last_s, count_if(event_type = 'purchase') AS objects FROM events GROUP BY user_id) SELECT user_id, last_s, {AS_OF} - last_s AS idle_s, objects = 0 AS purge FROM a WHERE {AS_OF} - last_s >= 1800"))
def idle_repos(spark, sf_dir):
    a = tables.pushes(spark, sf_dir).groupBy("user_id").agg(F.max("ts_s").alias("last_s"), F.count_if(F.col("event_type") == "purchase").alias("objects"))
    idle = F.lit(AS_OF).cast("long") - F.col("last_s")
    return a.select("user_id", "last_s", idle.alias("idle_s"), (F.col("objects") == 0).alias("purge")).where("idle_s >= 1800")


@query(sql("SELECT user_id, event_type AS reason, min(event_id) AS work, count(*) AS asked FROM events GROUP BY user_id, event_type"))
def hydration_queue_dedup(spark, sf_dir):
    return tables.pushes(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("reason")).agg(F.min("event_id").alias("work"), F.count(F.lit(1)).alias("asked"))


@query(
    sql(
        f"""a AS (SELECT user_id, floor(epoch(max(ts)))::BIGINT AS last_s, floor(epoch(max(CASE WHEN event_type = 'purchase' THEN ts END)))::BIGINT AS maint_s FROM events GROUP BY user_id),
        d AS (SELECT user_id, greatest(last_s + 1800, {AS_OF}) AS idle_at, CASE WHEN maint_s IS NULL THEN {AS_OF} ELSE greatest(maint_s + 86400, {AS_OF}) END AS maint_at FROM a)
        SELECT user_id, idle_at::BIGINT AS idle_at, maint_at::BIGINT AS maint_at, least(idle_at, maint_at)::BIGINT AS next_at, CASE WHEN maint_at <= idle_at THEN 'maintenance' ELSE 'idle' END AS next_task FROM d"""
    )
)
def maintenance_due(spark, sf_dir):
    a = tables.pushes(spark, sf_dir).groupBy("user_id").agg(F.max("ts_s").alias("last_s"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts_s"))).alias("maint_s"))
    now = F.lit(AS_OF).cast("long")
    due = a.select("user_id", F.greatest(F.col("last_s") + 1800, now).alias("idle_at"), F.coalesce(F.greatest(F.col("maint_s") + 86400, now), now).alias("maint_at"))
    due = due.withColumn("maint_at", F.when(F.col("maint_at").isNull(), now).otherwise(F.col("maint_at")))
    return due.select("*", F.least("idle_at", "maint_at").alias("next_at"), F.when(F.col("maint_at") <= F.col("idle_at"), "maintenance").otherwise("idle").alias("next_task"))


# Stored sets and requests.

KEY = "CASE WHEN oid % 2 = 0 THEN 'do/1/objects/pack/' ELSE '' END || 'pack-hydr-e' || pack || '-' || oid % 3 || '.pack'"


@query(sql(MEMBERS, f"k AS (SELECT {KEY} AS key, oid // 2 AS oid FROM members)", "SELECT DISTINCT regexp_replace(key, '^.*/', '') AS key, oid, regexp_extract(key, 'pack-hydr-(e[0-9A-Za-z]+)-', 1) AS epoch FROM k"))
def pack_keys_normalised(spark, sf_dir):
    rows = tables.pack_objects(spark, sf_dir).select(F.expr(KEY).alias("key"), F.floor(F.col("oid") / 2).alias("oid"))
    return maintain.normalized(rows, "key", ["oid"]).select("key", "oid", maintain.epoch_of(F.col("key")).alias("epoch"))


@query(sql(MEMBERS, "SELECT pack, oid FROM members WHERE oid % 2 = 0 UNION SELECT pack, oid + 1 FROM members"))
def membership_insert_ignore(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir).select("pack", "oid")
    return maintain.insert_ignore(members.where("oid % 2 = 0"), members.select("pack", F.col("oid") + 1).toDF("pack", "oid"), ["pack", "oid"])


@query(sql(MEMBERS, "SELECT pack, oid FROM members WHERE pack % 100 <> 6"))
def membership_delete(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir).select("pack", "oid")
    return maintain.delete(members, members.where("pack % 100 = 6").select("pack").distinct(), ["pack"])


@query(
    sql(
        MEMBERS, PACKS,
        """l AS (SELECT epoch AS repo, pack, ord FROM packs WHERE epoch IS NOT NULL UNION ALL SELECT DISTINCT epoch, epoch * 100 + 13, -1 FROM packs WHERE epoch IS NOT NULL),
        r AS (SELECT repo, pack, row_number() OVER (PARTITION BY repo ORDER BY ord, pack DESC) - 1 AS ord FROM l)
        SELECT repo, pack, ord FROM r WHERE ord < 3""",
    )
)
def pack_list_push(spark, sf_dir):
    listed = tables.pack_list(tables.pack_objects(spark, sf_dir)).where("epoch is not null").withColumn("repo", F.col("epoch"))
    new = listed.select("repo", (F.col("repo") * 100 + 13).alias("pack")).distinct()
    return maintain.pushed_front(listed, new, most=3)


@query(sql("SELECT c_nationkey::BIGINT AS owner, c_custkey AS repo, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'added' ELSE 'removed' END AS action FROM customer"))
def registry_sync(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("owner"), F.col("c_custkey").alias("repo"))
    alive = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo")).distinct().join(asked, "repo")
    return maintain.registry_sync(asked, alive)


@query(
    sql(
        MEMBERS, PACKS,
        """SELECT p_partkey AS oid, p_partkey IN (SELECT oid FROM members JOIN packs USING (pack) WHERE is_latest) AS latest,
          p_partkey IN (SELECT oid FROM members JOIN packs USING (pack) WHERE is_hydration) AS hydration, p_partkey IN (SELECT oid FROM members) AS packed FROM part""",
    )
)
def oid_presence(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir)
    listed = members.join(tables.pack_list(members).select("pack", "is_latest", "is_hydration"), "pack")
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("oid"))
    return maintain.presence(asked, {"latest": listed.where("is_latest"), "hydration": listed.where("is_hydration"), "packed": listed})


@query(
    sql(
        """SELECT b.item_id AS oid, coalesce(l.quality::VARCHAR, d.source) AS payload, CASE WHEN l.doc_id IS NOT NULL THEN 0 WHEN d.doc_id IS NOT NULL THEN 1 END::BIGINT AS tier
        FROM benchmark b LEFT JOIN labels l ON l.doc_id = b.item_id LEFT JOIN documents d ON d.doc_id = b.item_id"""
    )
)
def object_first_tier(spark, sf_dir):
    loose = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("oid"), F.col("quality").cast("string").alias("payload"))
    packed = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("oid"), F.col("source").alias("payload"))
    return maintain.first_found(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("oid")), [loose, packed])


@query(
    sql(
        COMMITS, BRANCHES,
        "b AS (SELECT repo, count(*) AS branches FROM branches GROUP BY repo)",
        "SELECT repo, count(*) AS commits, count(p2) AS merges, count_if(p1 IS NULL) AS roots, max(when_s) AS last_s, any_value(branches) AS branches FROM commits JOIN b USING (repo) GROUP BY repo",
    )
)
def repo_rollup(spark, sf_dir):
    rows = tables.commits(spark, sf_dir)
    branches = tables.branch_heads(rows).groupBy("repo").agg(F.count(F.lit(1)).alias("branches"))
    stats = rows.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.count("p2").alias("merges"), F.count_if(F.col("p1").isNull()).alias("roots"), F.max("when_s").alias("last_s"))
    return stats.join(branches, "repo")


@query(
    sql(
        """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name END AS "user", CASE c_custkey % 3 WHEN 0 THEN 'p:' || c_custkey END AS password, CASE c_custkey % 3 WHEN 1 THEN 't' || c_custkey END AS token FROM customer"""
    )
)
def auth_headers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    basic = F.concat(F.lit("Basic "), F.base64(F.concat_ws(":", "c_name", F.lit("p"), "c_custkey").cast("binary")))
    header = F.when(F.col("c_custkey") % 3 == 0, basic).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Bearer t"), "c_custkey")).otherwise("Digest x")
    rows = c.select("c_custkey", header.alias("h")).select("c_custkey", http.basic_credentials(F.col("h")).alias("b"), http.bearer_token(F.col("h")).alias("token"))
    return rows.select("c_custkey", "b.user", "b.password", "token")


FILE = "CASE page_id % 5 WHEN 0 THEN 'a.PNG' WHEN 1 THEN 'b.TXT' WHEN 2 THEN 'LICENSE' WHEN 3 THEN 'c.tar.gz' ELSE 'd.svg' END"


@query(sql(f"SELECT page_id, {FILE} AS name, CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/plain; charset=utf-8' WHEN 4 THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS media FROM pages"))
def media_types(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(FILE).alias("name")).select("page_id", "name", http.media_type(F.col("name")).alias("media"))


@query(
    sql(
        """l AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'want ' ELSE 'have ' END AS k, rpad((turn // 2)::VARCHAR, 40, '0') AS oid FROM conversations)
        SELECT conv_id, count(DISTINCT CASE WHEN k = 'want ' THEN oid END) AS wants, count_if(k = 'have ') AS haves, count(*) % 2 = 0 AS done FROM l GROUP BY conv_id"""
    )
)
def fetch_args(spark, sf_dir):
    line = F.concat(F.when(F.col("role") == "user", "want ").otherwise("have "), F.rpad(F.floor(F.col("turn") / 2).cast("string"), 40, "0"), F.lit(" extra"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(lines.alias("l"))
    rows = rows.withColumn("l", F.when(F.size("l") % 2 == 0, F.array_append("l", F.lit("done"))).otherwise(F.col("l")))
    got = rows.select("conv_id", http.fetch_request(F.col("l")).alias("r"))
    return got.select("conv_id", F.size("r.wants").cast("long").alias("wants"), F.size("r.haves").cast("long").alias("haves"), "r.done")


@query(sql(MEMBERS, PACKS, "SELECT pack, oid FROM members SEMI JOIN (SELECT pack FROM packs WHERE ord = 5) USING (pack) ORDER BY oid LIMIT 20 OFFSET 10"))
def pack_oids_page(spark, sf_dir):
    """A page of one pack's oids: the limit is the feature."""
    members = tables.pack_objects(spark, sf_dir)
    one = tables.pack_list(members).where("ord = 5").select("pack")
    return members.join(one, "pack", "left_semi").select("pack", "oid").orderBy("oid").offset(10).limit(20)


from stratalog.plans import assembly, lookups, service  # noqa: E402, F401  they register their queries
