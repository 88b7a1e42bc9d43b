"""Registered queries: batched lookups, keys, requests, objects and packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import codec, keys, text
from stratalog.operators import lookups, maintain
from stratalog.plans.prelude import BRANCHES, COMMITS, HEADS, MEMBERS, PACKS, sql
from stratalog.plans.registry import query
from stratalog.sources import packfiles, tables
from stratalog.sources.tables import table


@query(
    sql(
        """r AS (SELECT p_partkey AS request, CASE WHEN p_size % 9 = 0 THEN -p_partkey ELSE p_partkey % 200 END AS key, (p_size % 50 * 7)::BIGINT AS "offset", 20::BIGINT AS length FROM part),
        f AS (SELECT doc_id AS key, md5(coalesce(text, '')) || md5(coalesce(source, '')) || repeat('x', 100) AS content FROM documents)
        SELECT request, r.key, "offset", length, substring(content, ("offset" + 1)::BIGINT, 20) AS data FROM r LEFT JOIN f ON f.key = r.key"""
    )
)
def range_read(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    requests = p.select(F.col("p_partkey").alias("request"), F.when(F.col("p_size") % 9 == 0, -F.col("p_partkey")).otherwise(F.col("p_partkey") % 200).alias("key"), (F.col("p_size") % 50 * 7).cast("long").alias("offset"), F.lit(20).cast("long").alias("length"))
    content = F.concat(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.md5(F.coalesce("source", F.lit("")).cast("binary")), F.expr("repeat('x', 100)"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), content.cast("binary").alias("content"))
    return lookups.ranges(requests, files).withColumn("data", F.col("data").cast("string"))


@query(sql("SELECT b.item_id AS oid, coalesce(l.quality + 1, strlen(coalesce(d.text, '')))::BIGINT AS value FROM benchmark b LEFT JOIN labels l ON l.doc_id = b.item_id LEFT JOIN documents d ON d.doc_id = b.item_id"))
def object_sizes(spark, sf_dir):
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("oid"), (F.col("quality") + 1).cast("long").alias("size"))
    loose = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("oid"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    found = lookups.first_tier(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("oid")), "oid", [(stored, "size"), (loose, "size")])
    return found.withColumn("value", F.coalesce("value", F.lit(0).cast("long"))).select("oid", F.when(F.col("value") >= 0, F.col("value")).alias("value"))


@query(sql("SELECT source, doc_id, position FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents WHERE doc_id > 40) WHERE position <= 250"))
def loose_keyset_page(spark, sf_dir):
    """The next 250 keys after a cursor: the limit is the feature."""
    return lookups.page(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 250, after=F.col("doc_id") > 40)


@query(sql("SELECT c_nationkey::BIGINT AS owner, c_name AS repo, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS position FROM customer"))
def owner_registry(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("owner"), F.col("c_name").alias("repo"))
    return lookups.page(rows, "owner", ["repo"], 0)


@query(
    sql(
        MEMBERS,
        """a AS (SELECT pack AS key FROM (SELECT DISTINCT pack FROM members) UNION SELECT DISTINCT pack + 7000 FROM members)
        SELECT key, coalesce(list_sort(list(oid) FILTER (oid IS NOT NULL)), [])::VARCHAR AS oids FROM a LEFT JOIN members ON pack = key GROUP BY key""",
    )
)
def pack_oids_batch(spark, sf_dir):
    members = tables.pack_objects(spark, sf_dir).select(F.col("pack").alias("key"), "oid")
    asked = members.select("key").union(members.select(F.col("key") + 7000))
    rows = lookups.lists_of(asked, members, "key", "oid")
    return rows.select("key", F.concat(F.lit("["), F.array_join("values", ", "), F.lit("]")).alias("oids"))


@query(sql(MEMBERS, "SELECT pack, oid, row_number() OVER (PARTITION BY pack ORDER BY oid) AS position FROM members WHERE oid % 3 = 0"))
def pending_oids_page(spark, sf_dir):
    """A limit of 0 gives all pending oids of a work item and kind."""
    members = tables.pack_objects(spark, sf_dir).select("pack", "oid")
    return lookups.page(members, "pack", ["oid"], 0, after=F.col("oid") % 3 == 0)


@query(
    sql(
        COMMITS, BRANCHES, HEADS,
        """r AS (SELECT repo, name || CASE WHEN oid % 5 = 0 THEN '/a-rather-long-branch-name' ELSE '' END AS name FROM branches UNION ALL SELECT repo, 'refs/tags/n' || repo FROM heads)
        SELECT repo, name, CASE WHEN starts_with(name, 'refs/heads/') THEN 'branch' ELSE 'tag' END AS kind,
          CASE WHEN length(short) > 30 THEN substring(short, 1, 27) || '...' ELSE short END AS shown, substring(target, 12) AS default_branch
        FROM (SELECT *, regexp_replace(name, '^refs/(heads|tags)/', '') AS short FROM r) JOIN heads USING (repo)""",
    )
)
def ref_display(spark, sf_dir):
    rows = tables.commits(spark, sf_dir)
    heads = tables.heads(rows)
    branches = tables.branch_heads(rows).select("repo", F.concat("name", F.when(F.col("oid") % 5 == 0, "/a-rather-long-branch-name").otherwise("")).alias("name"))
    every = branches.unionByName(heads.select("repo", F.concat(F.lit("refs/tags/n"), "repo").alias("name")))
    short = F.regexp_replace("name", "^refs/(heads|tags)/", "")
    return every.join(heads, "repo").select("repo", "name", F.when(F.col("name").startswith("refs/heads/"), "branch").otherwise("tag").alias("kind"), text.short_name(short).alias("shown"), keys.default_branch(F.col("target")).alias("default_branch"))


REQUESTED = "CASE page_id % 6 WHEN 0 THEN 'HEAD' WHEN 1 THEN sha1(url) WHEN 2 THEN url WHEN 3 THEN repeat('a', 300) WHEN 4 THEN '' ELSE 'refs/heads/x-' || page_id END"


@query(
    sql(
        f"""p AS (SELECT page_id, url, {REQUESTED} AS ref, CASE WHEN page_id % 4 = 0 THEN url || chr(9) ELSE url END AS path FROM pages)
        SELECT page_id, regexp_full_match(ref, '[A-Za-z0-9._/-]{{1,256}}') AS ref_ok, NOT regexp_matches(path, '[\\x00-\\x1F]') AND length(path) <= 4096 AS path_ok,
          regexp_full_match(ref, '[A-Za-z0-9._-]{{1,100}}') AS repo_ok, regexp_full_match(ref, '[0-9a-fA-F]{{40}}') AS is_oid FROM p"""
    )
)
def request_validators(spark, sf_dir):
    ref, path = F.expr(REQUESTED.replace("sha1(url)", "sha1(cast(url as binary))").replace("'refs/heads/x-' || page_id", "concat('refs/heads/x-', page_id)")), F.expr("CASE WHEN page_id % 4 = 0 THEN concat(url, '\t') ELSE url END")
    rows = table(spark, sf_dir, "pages").select("page_id", ref.alias("ref"), path.alias("path"))
    return rows.select("page_id", keys.is_request_ref(F.col("ref")).alias("ref_ok"), keys.is_request_path(F.col("path")).alias("path_ok"), keys.is_owner_or_repository(F.col("ref")).alias("repo_ok"), codec.is_oid(F.col("ref")).alias("is_oid"))


@query(
    sql(
        MEMBERS, PACKS,
        """k AS (SELECT pack, 'do/a' || pack % 7 || '/objects/pack/' || CASE WHEN is_hydration THEN 'pack-hydr-e' || epoch || '-1' ELSE 'pack-' || pack END || CASE WHEN pack % 5 = 0 THEN '.idx' ELSE '.pack' END AS key FROM packs)
        SELECT pack, key, CASE WHEN pack % 5 = 0 THEN 'index' ELSE 'pack' END AS kind, regexp_replace(key, '\\.(pack|idx)$', '.idx') AS index_key, regexp_replace(key, '\\.(pack|idx)$', '.pack') AS pack_key,
          'a' || pack % 7 AS actor, contains(key, 'pack-hydr-') AS is_hydration, 'do/a' || pack % 7 || '/objects/loose/' || sha1(pack::VARCHAR) AS loose_key FROM k""",
    )
)
def storage_keys(spark, sf_dir):
    listed = tables.pack_list(tables.pack_objects(spark, sf_dir))
    name = F.concat(F.when(F.col("is_hydration"), F.concat(F.lit("pack-hydr-e"), "epoch", F.lit("-1"))).otherwise(F.concat(F.lit("pack-"), "pack")), F.when(F.col("pack") % 5 == 0, ".idx").otherwise(".pack"))
    prefix = keys.actor_prefix(F.concat(F.lit("a"), F.col("pack") % 7))
    rows = listed.select("pack", keys.pack_key(prefix, name).alias("key"))
    key = F.col("key")
    return rows.select(
        "pack", "key", keys.kind(key).alias("kind"), keys.index_of_pack(key).alias("index_key"), keys.pack_of_index(key).alias("pack_key"), keys.actor_of(key).alias("actor"),
        keys.is_hydration(key).alias("is_hydration"), keys.loose_key(prefix, F.sha1(F.col("pack").cast("string").cast("binary"))).alias("loose_key"),
    )


@query(
    sql(
        """l AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'command=' || role WHEN turn % 7 = 2 THEN '' ELSE role || ' ' || turn END AS line, CASE WHEN turn > 0 AND turn % 7 = 2 THEN 'delim' ELSE 'line' END AS kind FROM conversations),
        a AS (SELECT *, coalesce(bool_or(kind = 'delim') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after FROM l)
        SELECT conv_id, min(CASE WHEN NOT after AND starts_with(line, 'command=') THEN substring(line, 9) END) AS command,
          coalesce(string_agg(CASE WHEN after AND kind = 'line' THEN line END, '|' ORDER BY turn), '') AS arguments FROM a GROUP BY conv_id"""
    )
)
def v2_command(spark, sf_dir):
    delim = (F.col("turn") > 0) & (F.col("turn") % 7 == 2)
    line = F.when(F.col("turn") == 0, F.concat(F.lit("command="), "role")).when(delim, "").otherwise(F.concat_ws(" ", "role", "turn"))
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"), F.when(delim, "delim").otherwise("line").alias("kind"))
    return lookups.arguments(lines, "conv_id", "turn").select("conv_id", "command", F.array_join("arguments", "|").alias("arguments"))


@query(
    sql(
        """SELECT doc_id, strlen(coalesce(text, '')) * 10 > 30000 * 10 OR strlen(coalesce(text, '')) > 5242880 AS too_large, CASE WHEN strlen(coalesce(text, '')) <= 30000 THEN md5(coalesce(text, '')) END AS payload_md5, strlen(coalesce(text, ''))::BIGINT AS size FROM documents"""
    )
)
def blob_read(spark, sf_dir):
    """Blobs by their size, and by their payload unless they are too large (stored sizes are scaled up to meet the bound)."""
    payload = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", payload.alias("p")).withColumn("size", F.octet_length("p").cast("long"))
    rows = rows.withColumn("too_large", keys.too_large(F.col("size") * keys.TOO_LARGE / 300_000, F.col("size")))
    stored = codec.stored_object(codec.deflated(codec.encoded(F.lit("blob"), F.col("p"))))
    return rows.select("doc_id", "too_large", F.when(~F.col("too_large"), F.md5(stored["payload"])).alias("payload_md5"), "size")


@query(sql("SELECT doc_id, 'blob' AS type, sha1('blob ' || strlen(coalesce(text, '')) || chr(0) || coalesce(text, '')) AS oid, strlen(coalesce(text, ''))::BIGINT AS size, doc_id % 3 = 0 AS damaged FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, NULL, NULL, NULL, true FROM documents WHERE doc_id % 3 = 0"))
def object_roundtrip(spark, sf_dir):
    """Objects encoded, deflated, inflated and parsed; a third of them are damaged on the way and come back as nothing."""
    stored = codec.deflated(codec.encoded(F.lit("blob"), F.coalesce("text", F.lit("")).cast("binary")))
    broken = F.col("doc_id") % 3 == 0
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(broken, F.substring(stored, 2, 1 << 30)).otherwise(stored).alias("stored"), broken.alias("damaged"))
    rows = rows.withColumn("o", codec.stored_object(F.col("stored")))
    return rows.select("doc_id", "o.type", codec.object_id(F.col("o.type"), F.col("o.payload")).alias("oid"), F.octet_length("o.payload").cast("long").alias("size"), "damaged")


@query(
    sql(
        """o AS (SELECT coalesce(source, 'none') AS pack, doc_id, sha1('blob ' || strlen(coalesce(text, '')) || chr(0) || coalesce(text, '')) AS oid, strlen(coalesce(text, ''))::BIGINT AS size FROM documents)
        SELECT pack, oid, size, copies, row_number() OVER (PARTITION BY pack ORDER BY oid) - 1 AS first_position FROM (SELECT pack, oid, any_value(size) AS size, count(*) AS copies FROM o GROUP BY pack, oid)"""
    )
)
def pack_file_roundtrip(spark, sf_dir):
    """Packs and indexes written from objects and read again: every object is found at the offset that the index names."""
    docs = table(spark, sf_dir, "documents")
    objects = docs.select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(F.col("doc_id") / 2000)).alias("pack"), F.col("doc_id").alias("pos"), F.lit("blob").alias("type"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    files = packfiles.write_packs(objects)
    index = packfiles.decode_indexes(files.select("pack", F.col("index").alias("content"))).select("pack", "oid", "offset")
    held = packfiles.decode_packs(files.select("pack", "content")).select("pack", "oid", "offset", F.octet_length("payload").cast("long").alias("size"))
    both = held.join(index, ["pack", "oid", "offset"]).withColumn("pack", F.substring_index("pack", "/", 1))
    rows = both.groupBy("pack", "oid").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    return lookups.page(rows, "pack", ["oid"], 0).select("pack", "oid", "size", "copies", (F.col("position") - 1).alias("first_position"))


@query(
    sql(
        """t AS (SELECT n_regionkey::BIGINT AS tree, n_name AS name, sha1(n_name) AS oid, CASE WHEN n_nationkey % 3 = 0 THEN '40000' ELSE '100644' END AS mode FROM nation)
        SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY name) - 1 AS position, mode, name, oid, mode = '40000' AS is_dir FROM t"""
    )
)
def tree_payloads(spark, sf_dir):
    """Trees put together as bytes and parsed again; a truncated tail is ignored."""
    n = table(spark, sf_dir, "nation")
    entry = F.struct("n_name", F.when(F.col("n_nationkey") % 3 == 0, "40000").otherwise("100644").alias("mode"), F.sha1(F.col("n_name").cast("binary")).alias("oid"))
    rows = n.groupBy(F.col("n_regionkey").cast("long").alias("tree")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    rows = rows.select("tree", F.concat(codec.tree_payload(F.transform("e", lambda x: F.struct(x["mode"].alias("mode"), x["n_name"].alias("name"), x["oid"].alias("oid")))), F.lit(b"100644 cut\0abc")).alias("p"))
    rows = rows.select("tree", F.posexplode(codec.tree_entries_of(F.col("p"))).alias("position", "e"))
    return rows.select("tree", F.col("position").cast("long").alias("position"), "e.mode", "e.name", "e.oid", (F.col("e.mode") == "40000").alias("is_dir"))


@query(sql("SELECT p_partkey, CASE WHEN p_size % 4 = 1 THEN NULL ELSE sha1(p_name) END AS target, CASE WHEN p_size % 4 = 1 THEN NULL WHEN p_size % 4 = 2 THEN 'tag' ELSE 'commit' END AS type FROM part"))
def tag_targets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    body = F.concat(F.lit("object "), F.upper(F.sha1(F.col("p_name").cast("binary"))), F.lit("\n"), F.when(F.col("p_size") % 4 == 1, "").when(F.col("p_size") % 4 == 2, "type tag\n").otherwise("type commit\n"), F.lit("tag v1\n\nmessage"))
    rows = p.select("p_partkey", codec.tag_target(body).alias("t"))
    return rows.select("p_partkey", F.col("t.oid").alias("target"), "t.type")


@query(
    sql(
        """e AS (SELECT l_orderkey, l_linenumber, l_orderkey * l_linenumber * 37 AS size, l_orderkey * l_linenumber AS distance FROM lineitem)
        SELECT l_orderkey, l_linenumber, size::BIGINT AS size, distance::BIGINT AS distance, (1 + CASE WHEN size >= 16 THEN ceil((floor(log2(size)) + 1 - 4) / 7) ELSE 0 END)::BIGINT AS size_bytes,
          (CASE WHEN distance < 128 THEN 1 WHEN distance < 16512 THEN 2 WHEN distance < 2113664 THEN 3 WHEN distance < 270549120 THEN 4 ELSE 5 END)::BIGINT AS distance_bytes, 6::BIGINT AS type FROM e"""
    )
)
def entry_headers(spark, sf_dir):
    """Headers of delta entries, encoded and decoded again, with the lengths of their two parts."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * F.col("l_linenumber") * 37).cast("long").alias("s"), (F.col("l_orderkey") * F.col("l_linenumber")).cast("long").alias("d"))
    head, distance = codec.object_header_of(F.lit(codec.OFFSET_DELTA), F.col("s")), codec.offset_distance_of(F.col("d"))
    rows = rows.select("l_orderkey", "l_linenumber", head.alias("h"), distance.alias("o")).withColumn("e", codec.entry_header_of(F.concat("h", "o")))
    return rows.select("l_orderkey", "l_linenumber", "e.size", F.col("e.base_distance").alias("distance"), F.octet_length("h").cast("long").alias("size_bytes"), F.octet_length("o").cast("long").alias("distance_bytes"), "e.type")


@query(
    sql(
        """l AS (SELECT conv_id, turn, md5(coalesce(text, '')) || chr(10) AS line FROM conversations),
        p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, 'line' AS kind, line FROM l)
        SELECT conv_id, position, kind, replace(line, chr(10), '') AS payload FROM p
        UNION ALL SELECT conv_id, count(*), 'delim', '' FROM l GROUP BY conv_id UNION ALL SELECT conv_id, count(*) + 1, 'flush', '' FROM l GROUP BY conv_id UNION ALL SELECT conv_id, count(*) + 2, 'end', '' FROM l GROUP BY conv_id"""
    )
)
def packet_streams(spark, sf_dir):
    """All packets of a conversation in one stream, a malformed tail after them, and parsed again."""
    line = codec.pkt_line(F.concat(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.lit("\n")).cast("binary"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))
    rows = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]).alias("lines"))
    stream = F.concat(codec.joined(F.col("lines")), F.lit(codec.DELIM + codec.FLUSH + codec.END + b"zz12"))
    rows = rows.select("conv_id", F.posexplode(codec.pkt_lines(stream)).alias("position", "p"))
    return rows.select("conv_id", F.col("position").cast("long").alias("position"), "p.kind", F.regexp_replace(F.col("p.payload").cast("string"), "\r?\n$", "").alias("payload"))


@query(
    sql(
        """SELECT l_orderkey, l_linenumber, substring(sha1(l_comment), 1, 7) AS short, strftime(l_shipdate::TIMESTAMP, '%Y-%m-%d %H:%M:%S') || ' UTC (+0100)' AS shown,
          CASE WHEN s >= 86400 THEN s // 86400 || 'd' WHEN s >= 3600 THEN s // 3600 || 'h' WHEN s >= 60 THEN s // 60 || 'm' ELSE s || 's' END AS ago,
          replace(replace(replace(replace('<' || l_returnflag || '&"' || l_linestatus || '">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html
        FROM (SELECT *, (l_partkey * l_linenumber * 13)::BIGINT AS s, l_returnflag || l_linestatus AS l_comment FROM lineitem)"""
    )
)
def shown_values(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", F.substring(F.sha1(F.concat("l_returnflag", "l_linestatus").cast("binary")), 1, 7).alias("short"),
        text.format_when(F.unix_seconds(F.col("l_shipdate").cast("timestamp")), F.lit("+0100")).alias("shown"), text.ago((F.col("l_partkey") * F.col("l_linenumber") * 13).cast("long")).alias("ago"),
        text.escape_html(F.concat(F.lit("<"), "l_returnflag", F.lit('&"'), "l_linestatus", F.lit('">'))).alias("html"),
    )


@query(
    sql(
        """SELECT page_id, '/_cache/obj/' || lower(url) || CASE WHEN page_id % 3 = 0 AND page_id % 4 = 0 THEN '' ELSE '?' END || CASE WHEN page_id % 3 > 0 THEN 'ref=v' || page_id || CASE WHEN page_id % 4 > 0 THEN '&' ELSE '' END ELSE '' END || CASE WHEN page_id % 4 > 0 THEN 'page=' || page_id % 4 ELSE '' END AS key FROM pages"""
    )
)
def cache_keys(spark, sf_dir):
    ref = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("v"), "page_id")).when(F.col("page_id") % 2 == 0, "")
    page = F.when(F.col("page_id") % 4 > 0, (F.col("page_id") % 4).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", keys.cache_key(F.concat(F.lit("/_cache/obj/"), F.lower("url")), {"ref": ref, "page": page}).alias("key"))


@query(sql("SELECT c_custkey, c_custkey % 2 = 0 AS right_token, false AS wrong_token FROM customer"))
def token_hashes(spark, sf_dir):
    """Salted hashes of tokens, checked against the right and against other tokens; few rounds, as each is slow by design."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("t"), "c_custkey").alias("token"))
    rows = c.withColumn("stored", codec.token_hash(F.col("token"), F.sha1(F.col("token").cast("binary")), 100))
    offered = F.when(F.col("c_custkey") % 2 == 0, F.col("token")).otherwise("x")
    return rows.select("c_custkey", codec.token_matches(offered, F.col("stored")).alias("right_token"), codec.token_matches(F.lit("t"), F.col("stored")).alias("wrong_token"))


@query(sql("SELECT page_id, to_json({'page_id': page_id, 'url': url})::VARCHAR AS json FROM pages"))
def json_rows(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.to_json(F.struct("page_id", "url"), {"ignoreNullFields": "false"}).alias("json"))


@query(
    sql(
        MEMBERS, PACKS,
        """SELECT p_partkey AS oid, coalesce(list_sort(list(DISTINCT pack) FILTER (pack IS NOT NULL)), [])::VARCHAR AS packs, bool_or(coalesce(is_latest, false)) AS in_latest FROM part LEFT JOIN members ON oid = p_partkey LEFT JOIN packs USING (pack) GROUP BY p_partkey""",
    )
)
def oid_packs(spark, sf_dir):
    """For each oid, in any case of letters, the packs that hold it."""
    members = tables.pack_objects(spark, sf_dir)
    listed = members.join(tables.pack_list(members).select("pack", "is_latest"), "pack").select(F.hex("oid").alias("oid"), "pack", "is_latest")
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lower(F.hex("p_partkey")).alias("oid"))
    found = asked.join(listed.withColumn("oid", F.lower("oid")), "oid", "left").groupBy(F.col("key").alias("oid")).agg(F.array_sort(F.collect_set("pack")).alias("packs"), F.coalesce(F.bool_or("is_latest"), F.lit(False)).alias("in_latest"))
    return found.select("oid", F.concat(F.lit("["), F.array_join("packs", ", "), F.lit("]")).alias("packs"), "in_latest")


@query(
    sql(
        MEMBERS, PACKS,
        """a AS (SELECT epoch AS repo, pack AS key, ord FROM packs WHERE epoch IS NOT NULL), b AS (SELECT epoch AS repo, epoch * 100 + 1 + ord % 9 AS key, ord FROM packs WHERE epoch IS NOT NULL),
        u AS (SELECT repo, key, min((l, ord)) AS place FROM (SELECT repo, key, 0 AS l, ord FROM a UNION ALL SELECT repo, key, 1, ord FROM b) GROUP BY repo, key)
        SELECT repo, key, row_number() OVER (PARTITION BY repo ORDER BY place, key) - 1 AS ord FROM u""",
    )
)
def pack_candidates(spark, sf_dir):
    """Known packs and then listed ones, each once, at its first place."""
    listed = tables.pack_list(tables.pack_objects(spark, sf_dir)).where("epoch is not null").withColumnRenamed("epoch", "repo")
    more = listed.select("repo", (F.col("repo") * 100 + 1 + F.col("ord") % 9).alias("key"), "ord")
    return lookups.merged_unique([listed.select("repo", F.col("pack").alias("key"), "ord"), more], "repo", "key")


@query(sql("SELECT c_custkey, greatest(coalesce(p, 0), 0)::BIGINT AS page, s::BIGINT AS size, (greatest(coalesce(p, 0), 0) * s)::BIGINT AS \"offset\", d::BIGINT AS keep_packs FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 7 - 2 END AS p, greatest(5, least(100, coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 150 END, 25))) AS s, greatest(1, least(greatest(1, least(100, c_custkey % 130)), c_custkey % 60)) AS d FROM customer)"))
def page_parameters(spark, sf_dir):
    k = F.col("c_custkey")
    bounds = keys.page_bounds(F.when(k % 3 > 0, k % 7 - 2), F.when(k % 4 > 0, k % 150))
    most = keys.clamped((k % 130).cast("string"), 1, 100)
    return table(spark, sf_dir, "customer").select("c_custkey", bounds.alias("b"), keys.clamped((k % 60).cast("string"), 1, most).alias("keep_packs")).select("c_custkey", "b.page", "b.size", "b.offset", "keep_packs")


@query(sql(MEMBERS, PACKS, "n AS (SELECT epoch * 100 + 1 AS pack, oid FROM members JOIN packs USING (pack) WHERE epoch IS NOT NULL)", "SELECT pack, oid FROM members UNION SELECT pack, oid FROM n WHERE pack NOT IN (SELECT pack FROM members)"))
def membership_backfill(spark, sf_dir):
    """Rows of packs that the table does not know yet are added; known packs are left as they are."""
    members = tables.pack_objects(spark, sf_dir)
    old = members.join(tables.pack_list(members).where("epoch is not null").select("pack", "epoch"), "pack").select((F.col("epoch") * 100 + 1).alias("pack"), "oid").distinct()
    return maintain.backfill(members.select("pack", "oid"), old, "pack")


@query(sql("SELECT source, count(*) AS sampled, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, any_value(n) > 250 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE k <= 250 GROUP BY source"))
def loose_sample(spark, sf_dir):
    """The first 250 keys of each repository, counted: the limit is the feature."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    kept = lookups.page(docs, "source", ["doc_id"], 251)
    return kept.groupBy("source").agg(F.count_if(F.col("position") <= 250).alias("sampled"), F.sum(F.when(F.col("position") <= 250, F.col("n"))).alias("bytes"), (F.max("position") > 250).alias("truncated"))


@query(sql(MEMBERS, PACKS, "SELECT pack, ord, bytes + 32 AS pack_size, n * 28 + 1072 AS index_size, n FROM packs WHERE ord < 20"))
def pack_stats_first(spark, sf_dir):
    """Sizes of the first twenty packs and of their indexes: the limit is the feature."""
    listed = tables.pack_list(tables.pack_objects(spark, sf_dir)).where("ord < 20")
    return listed.select("pack", "ord", (F.col("bytes") + 32).alias("pack_size"), (F.col("n") * 28 + 1072).alias("index_size"), "n")
