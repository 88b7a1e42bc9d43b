"""Registered queries: closures over commits, trees and blobs, integrity, and the assembly of result packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import codec, text
from stratalog.operators import assembly, graph, lookups
from stratalog.plans.prelude import COMMITS, LAYOUT, MEMBERS, OBJECT_EDGES, PACKS, TAGS, sql
from stratalog.plans.queries import HAVES, _haves, _tips
from stratalog.plans.registry import query
from stratalog.sources import tables
from stratalog.sources.staging import written
from stratalog.sources.tables import BLOBS, TREES, table

OBJECTS = "{name} AS ({start} UNION SELECT root, dst FROM {name} JOIN oedges ON repo = root AND oid = src)"
WANTS, HELD = "SELECT repo AS root, peeled AS oid FROM tags", "SELECT root, oid FROM haves"
KIND = "CASE WHEN oid >= 8000000000 THEN 'blob' WHEN oid >= 4000000000 THEN 'tree' ELSE 'commit' END AS kind"


def _graph(spark, sf_dir):
    rows = written(tables.commits(spark, sf_dir), "commits")
    return rows, tables.object_edges(spark, sf_dir, rows).withColumnRenamed("repo", "root")


def _kind():
    return F.when(F.col("oid") >= BLOBS, "blob").when(F.col("oid") >= TREES, "tree").otherwise("commit").alias("kind")


@query(sql(COMMITS, OBJECT_EDGES, TAGS, OBJECTS.format(name="reach", start=WANTS), f"SELECT root, oid, {KIND} FROM reach", recursive=True))
def closure_objects(spark, sf_dir):
    rows, edges = _graph(spark, sf_dir)
    return graph.closure(edges, _tips(rows)).select("root", "oid", _kind())


@query(
    sql(
        COMMITS, OBJECT_EDGES, TAGS, HAVES, OBJECTS.format(name="want", start=WANTS), OBJECTS.format(name="have", start=HELD),
        f"SELECT root, oid, {KIND} FROM want ANTI JOIN have USING (root, oid)", recursive=True,
    )
)
def closure_objects_needed(spark, sf_dir):
    """Exactly the commits, trees and blobs that the other side lacks."""
    rows, edges = _graph(spark, sf_dir)
    return graph.needed(edges, _tips(rows), _haves(rows)).select("root", "oid", _kind())


@query(
    sql(
        COMMITS, OBJECT_EDGES, TAGS, HAVES,
        "chain AS (SELECT root, oid, 0 AS depth FROM haves UNION ALL SELECT root, p1, depth + 1 FROM chain JOIN commits USING (oid) WHERE p1 IS NOT NULL AND depth < 20)",
        "stop AS (SELECT DISTINCT root, oid FROM chain)",
        f"""want AS (SELECT repo AS root, peeled AS oid FROM tags ANTI JOIN stop ON stop.root = tags.repo AND stop.oid = peeled
            UNION SELECT want.root, dst FROM want JOIN oedges ON repo = want.root AND want.oid = src LEFT JOIN stop ON stop.root = want.root AND stop.oid = dst WHERE stop.oid IS NULL)
        SELECT root, oid, {KIND} FROM want""",
        recursive=True,
    )
)
def closure_objects_fast(spark, sf_dir):
    """With a stop set of known commits: shared trees and blobs of commits beyond it may come along."""
    rows, edges = _graph(spark, sf_dir)
    return graph.closure(edges, _tips(rows), graph.ancestors(rows, _haves(rows), 20)).select("root", "oid", _kind())


@query(
    sql(
        COMMITS, OBJECT_EDGES,
        """a AS (SELECT DISTINCT c_custkey * 3 AS oid FROM customer UNION SELECT DISTINCT 4000000000 + c_custkey * 3 FROM customer)
        SELECT oid, coalesce(list_sort(list(DISTINCT dst) FILTER (dst IS NOT NULL)), [])::VARCHAR AS refs FROM a LEFT JOIN oedges ON src = oid GROUP BY oid""",
    )
)
def object_refs_batch(spark, sf_dir):
    """What each asked object names; unknown objects name nothing."""
    _, edges = _graph(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    asked = c.select((F.col("c_custkey") * 3).cast("long").alias("oid")).union(c.select((F.col("c_custkey") * 3 + TREES).cast("long")))
    rows = lookups.lists_of(asked, edges.select(F.col("src").alias("oid"), "dst"), "oid", "dst")
    return rows.select("oid", F.concat(F.lit("["), F.array_join("values", ", "), F.lit("]")).alias("refs"))


@query(
    sql(
        COMMITS, OBJECT_EDGES,
        """h AS (SELECT c_custkey AS c, coalesce(max(o_orderkey), 5) AS head FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
        tg AS (SELECT -c AS oid, CASE WHEN c % 5 = 0 THEN head ELSE 1 - c END AS target FROM h),
        q AS (SELECT c AS request, CASE c % 4 WHEN 0 THEN head WHEN 1 THEN -c WHEN 2 THEN 4000000000 + head ELSE 8000000000 + c END AS oid FROM h),
        kinds AS (SELECT oid, 'commit' AS kind FROM commits WHERE oid % 10 <> 0 UNION SELECT 4000000000 + oid, 'tree' FROM commits WHERE oid % 7 <> 0 UNION SELECT 8000000000 + p_partkey, 'blob' FROM part WHERE p_partkey % 11 <> 0),
        u AS (SELECT request, q.oid, CASE WHEN t4.oid IS NULL THEN coalesce(t3.target, t2.target, t1.target, q.oid) END AS final FROM q LEFT JOIN tg t1 ON t1.oid = q.oid LEFT JOIN tg t2 ON t2.oid = t1.target LEFT JOIN tg t3 ON t3.oid = t2.target
          LEFT JOIN tg t4 ON t4.oid = coalesce(t3.target, t2.target, t1.target, q.oid)),
        k AS (SELECT u.*, coalesce(kind, 'unknown') AS kind FROM u LEFT JOIN kinds ON kinds.oid = final),
        m AS (SELECT src, max(role) AS lost FROM oedges WHERE role IN ('parent', 'tree') AND dst NOT IN (SELECT oid FROM kinds) GROUP BY src)
        SELECT request, oid, final, kind, CASE WHEN kind = 'unknown' THEN 'unknown object' WHEN kind = 'commit' AND lost IS NOT NULL THEN 'missing ' || lost ELSE 'ok' END AS status FROM k LEFT JOIN m ON src = final""",
    )
)
def object_integrity(spark, sf_dir):
    """Targets of updates of every kind against what the stores hold."""
    rows, edges = _graph(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.max("o_orderkey").alias("head"))
    h = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c")).join(orders, "c", "left").withColumn("head", F.coalesce("head", F.lit(5)).cast("long"))
    tags = h.select((-F.col("c")).cast("long").alias("oid"), F.when(F.col("c") % 5 == 0, F.col("head")).otherwise(1 - F.col("c")).cast("long").alias("target"))
    target = F.when(F.col("c") % 4 == 0, F.col("head")).when(F.col("c") % 4 == 1, -F.col("c")).when(F.col("c") % 4 == 2, F.col("head") + TREES).otherwise(F.col("c") + BLOBS)
    stores = [
        rows.where("oid % 10 <> 0").select("oid", F.lit("commit").alias("kind")),
        rows.where("oid % 7 <> 0").select((F.col("oid") + TREES).alias("oid"), F.lit("tree").alias("kind")),
        table(spark, sf_dir, "part").where("p_partkey % 11 <> 0").select((F.col("p_partkey") + BLOBS).alias("oid"), F.lit("blob").alias("kind")),
    ]
    kinds = stores[0].unionByName(stores[1]).unionByName(stores[2])
    return graph.integrity(h.select(F.col("c").alias("request"), target.cast("long").alias("oid")), kinds, edges.where("role <> 'entry'").select("src", "dst", "role"), tags)


@query(
    sql(
        """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'commit' END AS kind, CASE WHEN p_size % 3 = 0 THEN sha1(p_name) END AS tree, CASE p_size % 3 WHEN 1 THEN 'Not a commit' WHEN 2 THEN 'Not found' END AS error FROM part"""
    )
)
def commit_read(spark, sf_dir):
    """Stored objects read as commits: other types and damaged objects are named as errors, not dropped."""
    p = table(spark, sf_dir, "part")
    body = F.concat(F.lit("tree "), F.sha1(F.col("p_name").cast("binary")), F.lit("\nauthor a <b> 1 +0000\n\nm")).cast("binary")
    stored = codec.deflated(codec.encoded(F.when(F.col("p_size") % 3 == 1, "blob").otherwise("commit"), body))
    rows = p.select("p_partkey", codec.stored_object(F.when(F.col("p_size") % 3 == 2, F.lit(b"no object")).otherwise(stored)).alias("o"))
    good = F.col("o.type") == "commit"
    error = F.when(F.col("o.type").isNull(), "Not found").when(~good, "Not a commit")
    return rows.select("p_partkey", F.when(good, F.col("o.type")).alias("kind"), F.when(good, codec.commit_fields(F.col("o.payload").cast("string"))["tree"]).alias("tree"), error.alias("error"))


HEADER = "CASE WHEN size < 16 THEN 1 ELSE 1 + ceil((length(bin(size)) - 4) / 7)::BIGINT END"


@query(
    sql(
        MEMBERS, LAYOUT, PACKS,
        f"""s AS (SELECT pack, 12 + bytes + 20 AS pack_size FROM packs),
        n AS (SELECT pack, oid, size, "offset", coalesce(lead("offset") OVER (PARTITION BY pack ORDER BY "offset"), pack_size - 20)::BIGINT AS next_offset FROM layout JOIN s USING (pack))
        SELECT *, next_offset - "offset" - {HEADER} AS payload FROM n""",
    )
)
def pack_payloads(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir)
    sizes = members.groupBy("pack").agg((F.sum("size") + assembly.START + assembly.TRAILER).alias("pack_size"))
    return assembly.payloads(packs_layout(members), sizes)


def packs_layout(members):
    from stratalog.operators import packs

    return packs.layout(members).select("pack", "oid", "size", "offset")


DELTAS = "deltas AS (SELECT pack, oid, size, CASE WHEN oid % 4 < 3 THEN oid + 1 END AS base FROM members)"


def _deltas(spark, sf_dir):
    return tables.pack_objects(spark, sf_dir).select("pack", "oid", "size", F.when(F.col("oid") % 4 < 3, F.col("oid") + 1).alias("base"))


@query(
    sql(
        MEMBERS, DELTAS,
        """x AS (SELECT pack, oid FROM deltas WHERE oid % 8 = 0 UNION SELECT x.pack, d.base FROM x JOIN deltas d USING (pack, oid) JOIN deltas b ON b.pack = x.pack AND b.oid = d.base)
        SELECT x.pack, x.oid, x.oid % 8 <> 0 AS added, d.base IS NOT NULL AND b.oid IS NULL AS thin FROM x JOIN deltas d USING (pack, oid) LEFT JOIN deltas b ON b.pack = x.pack AND b.oid = d.base""",
        recursive=True,
    )
)
def delta_base_expansion(spark, sf_dir):
    rows = _deltas(spark, sf_dir)
    return assembly.with_bases(rows.where("oid % 8 = 0"), rows)


ORDER = """runs AS (SELECT *, oid // 4 * 10000000000 + row_number() OVER (PARTITION BY pack, oid // 4 ORDER BY oid DESC) + oid AS run FROM deltas),
  ranked AS (SELECT pack, oid, size, lead(oid) OVER (PARTITION BY pack ORDER BY oid) = base AS has_base, row_number() OVER (PARTITION BY pack ORDER BY max(oid) OVER (PARTITION BY pack, run), oid DESC) - 1 AS position,
    CASE WHEN size < 16 THEN 1 ELSE 1 + ceil((length(bin(size)) - 4) / 7)::BIGINT END AS own FROM runs)""".replace("row_number() OVER (PARTITION BY pack ORDER BY max(oid) OVER (PARTITION BY pack, run), oid DESC) - 1 AS position,", "max(oid) OVER (PARTITION BY pack, run) AS root,")
ORDER += ", placed AS (SELECT pack, oid, size, coalesce(has_base, false) AS has_base, own, row_number() OVER (PARTITION BY pack ORDER BY root, oid DESC) - 1 AS position FROM ranked), r0 AS (SELECT *, own + has_base::INT AS head FROM placed)"


def _round(k: int) -> str:
    """A base stands right before its delta in this fixture, so the distance is the length of the entry before."""
    return f"""r{k + 1} AS (SELECT pack, oid, size, has_base, own, position, own + CASE WHEN NOT has_base THEN 0 WHEN lag(head + size) OVER (PARTITION BY pack ORDER BY position) < 128 THEN 1
      WHEN lag(head + size) OVER (PARTITION BY pack ORDER BY position) < 16512 THEN 2 ELSE 3 END AS head FROM r{k})"""


@query(
    sql(
        MEMBERS, DELTAS, ORDER, *map(_round, range(6)),
        """SELECT pack AS result, oid, position, (12 + coalesce(sum(head + size) OVER (PARTITION BY pack ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", head::BIGINT AS header FROM r6""",
    )
)
def assembled_offsets(spark, sf_dir):
    """Order, header lengths and offsets of the objects of each result pack."""
    rows = _deltas(spark, sf_dir)
    return assembly.arranged(rows.select(F.col("pack").alias("result"), "oid", "base", F.lit(0).alias("pack_ord"), F.col("oid").alias("at"), "size", F.col("size").alias("payload")))


@query(sql(MEMBERS, PACKS, "SELECT pack, '5041434b00000002' || lpad(lower(hex(n)), 8, '0') AS header FROM packs"))
def pack_headers(spark, sf_dir):
    listed = tables.pack_list(tables.pack_objects(spark, sf_dir))
    return listed.select("pack", F.lower(F.hex(assembly.pack_header(F.col("n")))).alias("header"))


@query(
    sql(
        """c AS (SELECT conv_id, count(*) AS n, max(turn) % 2 = 0 AS done FROM conversations GROUP BY conv_id),
        f AS (SELECT conv_id, 0 AS seq, 0 AS channel, 'acknowledgments' AS what FROM c WHERE NOT done UNION ALL SELECT conv_id, 1, 2, 'progress ' || n FROM c UNION ALL SELECT conv_id, 2, 1, md5(conv_id::VARCHAR) FROM c UNION ALL SELECT conv_id, 3, 3, 'fatal: cut' FROM c WHERE n % 3 = 0)
        SELECT conv_id, seq::BIGINT AS seq, channel::BIGINT AS channel, what, lpad(lower(hex(strlen(what) + 4 + (channel > 0)::INT)), 4, '0') AS length FROM f"""
    )
)
def response_frames(spark, sf_dir):
    """The packets of a response: acknowledgments unless the request was done, progress, data, and an error at the end if there is one."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), (F.max("turn") % 2 == 0).alias("done"))
    part = lambda seq, channel, what, on: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(channel).cast("long").alias("channel"), what.alias("what"), on.alias("on"))
    every = F.array(
        part(0, 0, F.lit("acknowledgments"), ~F.col("done")), part(1, 2, F.concat(F.lit("progress "), "n"), F.lit(True)),
        part(2, 1, F.md5(F.col("conv_id").cast("string").cast("binary")), F.lit(True)), part(3, 3, F.lit("fatal: cut"), F.col("n") % 3 == 0),
    )
    rows = c.select("conv_id", F.explode(F.filter(every, lambda x: x["on"])).alias("f"))
    mark = F.when(F.col("f.channel") > 0, F.unhex(F.lpad(F.hex("f.channel"), 2, "0"))).otherwise(F.lit(b""))
    line = codec.pkt_line(F.concat(mark, F.col("f.what").cast("binary")))
    return rows.select("conv_id", "f.seq", "f.channel", "f.what", F.substring(line, 1, 4).cast("string").alias("length"))


@query(
    sql(
        MEMBERS, PACKS,
        """m AS (SELECT oid, arg_min(pack, ord) AS pack, arg_min(size, ord) AS size, min(ord) AS ord FROM members JOIN packs USING (pack) GROUP BY oid)
        SELECT oid, pack, (12 + coalesce(sum(size) OVER (ORDER BY ord, oid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM m""",
    )
)
def multi_pack_assembly(spark, sf_dir):
    """Each needed object from the first pack that has it, and where it lands in one result pack.

    One file is one line of offsets: packs are summed first, so a task holds one source pack.
    """
    members = tables.pack_objects(spark, sf_dir)
    from stratalog.operators import packs

    chosen = packs.canonical(members, tables.pack_list(members)).select("oid", "pack", "ord", "size")
    return assembly.one_file(chosen)


@query(
    sql(
        """d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents) SELECT doc_id, first_line AS title, n > 1 AS more FROM (SELECT doc_id, regexp_split_to_array(t, '\\r?\\n')[1] AS first_line, len(regexp_split_to_array(t, '\\r?\\n')) AS n FROM d)"""
    )
)
def message_titles(spark, sf_dir):
    t = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.first_line(t).alias("title"), (F.size(F.split(t, "\r?\n", -1)) > 1).alias("more"))
