"""Common table expressions of the oracles: the layers of ``lattica.sources.adapters`` in SQL."""

VERTICES = """vertices AS (
  SELECT p_partkey AS rowid, replace(p_name, ' ', '_') AS name, p_type || ' ' || p_brand || '::' || replace(p_name, ' ', '_') AS definition,
    CASE WHEN p_size <= 40 THEN 'function' WHEN p_size <= 45 THEN 'variable' ELSE 'macro' END AS kind,
    p_brand AS file, p_size % 2 = 0 AS is_def, p_size::BIGINT AS lines FROM part)"""
RAW = """led AS (
  SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
raw AS (
  SELECT l_partkey AS src, dst, CASE l_returnflag WHEN 'A' THEN 'direct' WHEN 'N' THEN 'member' ELSE 'binding' END AS source,
    CASE WHEN l_quantity < 10 THEN 'fuzzy' WHEN l_linestatus = 'O' THEN 'resolved' ELSE 'exact' END AS grade,
    l_quantity AS weight, l_orderkey AS s1, l_linenumber AS s2, l_partkey AS s3, l_suppkey AS s4 FROM led WHERE dst IS NOT NULL)"""
EDGES = RAW + """,
edges AS (
  SELECT src, dst, source, arg_min(grade, row(s1, s2, s3, s4)) AS grade FROM raw GROUP BY src, dst, source)"""
#: All deduplicated edges that are not fuzzy.
FIRM = EDGES + """,
firm AS (SELECT DISTINCT src, dst FROM edges WHERE grade <> 'fuzzy' AND src <> dst)"""
ACCESSES = """accesses AS (
  SELECT user_id AS participant, json_extract_string(props, '$.k') || '/' || ((day(ts) - 1) // 7)::VARCHAR AS key_name,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS role,
    CASE event_type WHEN 'purchase' THEN 'queued' WHEN 'signup' THEN 'inline' ELSE 'unknown' END AS mode, event_id
  FROM events WHERE event_type <> 'error')"""
SECTIONS = """ev AS (SELECT event_id, user_id, epoch_us(ts) AS at, event_type FROM events),
ends AS (
  SELECT *, min(CASE WHEN event_type = 'signup' THEN ev.at END) OVER (
    PARTITION BY user_id ORDER BY ev.at, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM ev),
sections AS (SELECT event_id AS section, user_id AS holder, ends.at AS lo, hi FROM ends WHERE event_type = 'error')"""
PATHS = """paths AS (
  SELECT r_name || '/' || n_name || '/' || c_mktsegment AS path, c_custkey AS symbol, c_acctbal < 0 AS external, c_acctbal > 9000 AS unresolved
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
QUALIFIED = """qualified AS (
  SELECT *, coalesce(list_last(list_filter(regexp_split_to_array(definition, '\\s+'), lambda t: t = name OR t LIKE '%:' || name OR t LIKE '%.' || name)), name) AS q FROM vertices)"""


def points(kind: str) -> str:
    return f"points AS (SELECT event_id AS point, user_id AS holder, epoch_us(ts) AS at FROM events WHERE event_type = '{kind}')"


def query(*parts: str, recursive: bool = False) -> str:
    """``WITH`` all parts but the last, then the last."""
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts[:-1]) + "\n" + parts[-1]
