"""The derived version-history relations as DuckDB SQL, for the oracles."""

COMMITS = """commits0 AS (
  SELECT c_nationkey::BIGINT AS repo, o_orderkey AS oid, o_custkey AS author, epoch(o_orderdate)::BIGINT AS when_s, o_orderpriority AS message,
    lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p1,
    lag(o_orderkey) OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS pn
  FROM orders JOIN customer ON o_custkey = c_custkey
), commits AS (
  SELECT repo, oid, author, when_s, message, p1, CASE WHEN message = '1-URGENT' AND pn IS DISTINCT FROM p1 THEN pn END AS p2 FROM commits0
)"""
EDGES = """edges AS (
  SELECT oid AS src, p1 AS dst, 0 AS ordinal FROM commits WHERE p1 IS NOT NULL UNION ALL SELECT oid, p2, 1 FROM commits WHERE p2 IS NOT NULL
)"""
BRANCHES = "branches AS (SELECT repo, 'refs/heads/c' || author AS name, arg_max(oid, (when_s, oid)) AS oid FROM commits GROUP BY repo, author)"
TAGS = "tags AS (SELECT repo, 'refs/tags/n' || repo AS name, -arg_max(oid, (when_s, oid)) AS oid, arg_max(oid, (when_s, oid)) AS peeled FROM commits GROUP BY repo)"
HEADS = "heads AS (SELECT repo, 'refs/heads/c' || min(author) AS target FROM commits GROUP BY repo)"
MEMBERS = """members AS (
  SELECT (year(l_shipdate) * 100 + month(l_shipdate))::BIGINT AS pack, l_partkey AS oid, sum(l_quantity::BIGINT)::BIGINT AS size FROM lineitem GROUP BY 1, 2
)"""
PACKS = """packs AS (
  SELECT pack, (row_number() OVER (ORDER BY pack DESC) - 1)::BIGINT AS ord, pack % 100 % 3 = 0 AS is_hydration, CASE WHEN pack % 100 % 3 = 0 THEN pack // 100 END::BIGINT AS epoch,
    row_number() OVER (ORDER BY pack DESC) = 1 AS is_latest, n, bytes
  FROM (SELECT pack, count(*) AS n, sum(size)::BIGINT AS bytes FROM members GROUP BY pack)
)"""
LAYOUT = """layout0 AS (
  SELECT *, (12 + coalesce(sum(size) OVER (PARTITION BY pack ORDER BY oid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM members
), layout AS (SELECT *, coalesce(lead("offset") OVER (PARTITION BY pack ORDER BY oid), "offset" + size)::BIGINT AS next_offset FROM layout0)"""


OBJECT_EDGES = """oedges AS (
  SELECT repo, oid AS src, p1 AS dst, 'parent' AS role FROM commits WHERE p1 IS NOT NULL UNION ALL SELECT repo, oid, p2, 'parent' FROM commits WHERE p2 IS NOT NULL
  UNION ALL SELECT repo, oid, 4000000000 + oid, 'tree' FROM commits UNION ALL SELECT DISTINCT repo, 4000000000 + oid, 8000000000 + l_partkey, 'entry' FROM lineitem JOIN commits ON oid = l_orderkey
)"""


def sql(*parts: str, recursive: bool = False) -> str:
    """A query from common table expressions and a last statement."""
    *tables, last = parts
    if not tables and last.startswith("SELECT"):
        return last
    head = f"WITH {'RECURSIVE ' if recursive else ''}"
    if last.startswith("SELECT"):
        return f"{head}{', '.join(tables)} {last}"
    return f"{head}{', '.join((*tables, last))}"  # the last part ends with a statement
