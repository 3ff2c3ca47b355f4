"""Queries that describe whole layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import edges as E
from lattica.operators import rosters as R
from lattica.operators.text import matches_glob
from lattica.plans.sql import ACCESSES, EDGES, PATHS, VERTICES, query
from lattica.sources import adapters as A

QUERIES, ORACLES = {}, {}


def register(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _edges(s, d):
    return E.first_writer(A.raw_edges(s, d).drop("weight"), ["src", "dst", "source"], "seq").drop("seq")


@register(query(EDGES, "SELECT source, grade, count(*) AS n FROM edges GROUP BY ALL"))
def edge_counts_by_source(s, d):
    return _edges(s, d).groupBy("source", "grade").agg(F.count("*").alias("n"))


@register(query(EDGES, "SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_pairs, round(sum(n) / count(*), 4) AS inflation FROM (SELECT count(*) AS n FROM edges GROUP BY src, dst)"))
def edge_row_inflation(s, d):
    return R.row_inflation(_edges(s, d))


@register(query(PATHS, """SELECT split_part(path, '/', 1) AS dir, count(DISTINCT path) AS n_files, count(DISTINCT symbol) AS n_symbols, sum(external::INT)::BIGINT AS external_rows,
  sum(unresolved::INT)::BIGINT AS unresolved_rows, count(DISTINCT CASE WHEN external THEN path END) AS external_files FROM paths GROUP BY 1"""))  # fmt: skip
def directory_rollup(s, d):
    return R.directory_rollup(A.paths(s, d))


@register(query(PATHS, "SELECT path, count(DISTINCT symbol) AS n_symbols FROM paths GROUP BY path"))
def file_inventory(s, d):
    return A.paths(s, d).where("path not like '[%'").groupBy("path").agg(F.countDistinct("symbol").alias("n_symbols"))


@register(query(PATHS, """best AS (SELECT path, min(CASE WHEN NOT external AND NOT unresolved THEN 0 WHEN external THEN 1 ELSE 2 END) AS r FROM paths GROUP BY path)""",
    "SELECT CASE r WHEN 0 THEN 'first_party' WHEN 1 THEN 'external' ELSE 'unresolved' END AS origin, count(*) AS n FROM best GROUP BY 1"))
def origin_split(s, d):
    return R.origin_split(A.paths(s, d))


@register(query(PATHS, "SELECT DISTINCT path FROM paths WHERE path LIKE '%/BUILD%' OR (split_part(path, '/', 2) LIKE '_R%' AND path LIKE '%/M%')"))
def glob_filter(s, d):
    p = A.paths(s, d).select("path").distinct()
    return p.where(matches_glob(F.col("path"), "BUILD*") | matches_glob(F.col("path"), "*/?R*/M*") & F.rlike("path", F.lit("^[^/]+/.R")))


@register(query(VERTICES, "SELECT kind, count(*) AS n, min(file) AS first_file, min(definition) AS first_definition FROM vertices GROUP BY kind"))
def gate_rollup(s, d):
    return A.vertices(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.min("file").alias("first_file"), F.min("definition").alias("first_definition"))


@register("SELECT nationkey, count(*) AS n FROM (SELECT c_custkey AS id, c_nationkey AS nationkey FROM customer UNION SELECT s_suppkey, s_nationkey FROM supplier) GROUP BY nationkey")
def symbols_per_file(s, d):
    a = A.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nationkey"))
    b = A.table(s, d, "supplier").select("s_suppkey", "s_nationkey")
    return a.union(b).distinct().groupBy("nationkey").agg(F.count("*").alias("n"))


@register(query(VERTICES, "f AS (SELECT file, count(DISTINCT name) AS n_symbols, sum(lines)::BIGINT AS n_lines FROM vertices GROUP BY file)", "SELECT *, n_lines >= 100 AS substantive, n_lines >= 100 AND n_symbols <= 1 AS barren FROM f"))
def coverage(s, d):
    return R.coverage(A.vertices(s, d), 100)


@register(query(VERTICES, EDGES, """SELECT 'vertices' AS layer, CASE WHEN count(*) > 0 THEN 'populated' ELSE 'empty' END AS state, count(*) AS n FROM vertices
UNION ALL SELECT 'edges', CASE WHEN count(*) > 0 THEN 'populated' ELSE 'empty' END, count(*) FROM edges
UNION ALL SELECT 'unused', CASE WHEN count(*) > 0 THEN 'populated' ELSE 'empty' END, count(*) FROM vertices WHERE kind = 'none' UNION ALL SELECT 'locks', 'absent', 0"""))
def layer_states(s, d):
    v = A.vertices(s, d)
    return R.layer_states({"vertices": v, "edges": _edges(s, d), "unused": v.where("kind = 'none'"), "locks": None})


@register(r"""WITH x AS (SELECT regexp_extract(p_name, '^([a-z]+) (.+)$', 1) AS prefix, regexp_extract(p_name, '^([a-z]+) (.+)$', 2) AS key FROM part)
SELECT prefix, count(DISTINCT key) AS n_keys, count(*) AS n_rows FROM x WHERE prefix <> '' GROUP BY prefix HAVING count(DISTINCT key) >= 2""")
def accessor_families(s, d):
    return R.families(A.table(s, d, "part").select(F.col("p_name").alias("name")), "^([a-z]+) (.+)$", 2)


@register("""WITH n AS (SELECT DISTINCT p_brand || '_' || CASE p_size % 4 WHEN 0 THEN 'lock' WHEN 1 THEN 'unlock' WHEN 2 THEN 'take' ELSE 'give' END AS name FROM part WHERE p_size % 9 <> 0)
SELECT a.name AS first, b.name AS second FROM n a JOIN n b ON b.name = CASE WHEN a.name LIKE '%\\_take' ESCAPE '\\' THEN replace(a.name, '_take', '_give') WHEN a.name LIKE '%\\_lock' ESCAPE '\\' THEN replace(a.name, '_lock', '_unlock') END""".replace("\\\\", "\\"))
def lock_primitive_pairs(s, d):
    word = F.when(F.col("p_size") % 4 == 0, "lock").when(F.col("p_size") % 4 == 1, "unlock").when(F.col("p_size") % 4 == 2, "take").otherwise("give")
    names = A.table(s, d, "part").where("p_size % 9 <> 0").select(F.concat_ws("_", "p_brand", word).alias("name"))
    return R.partner_pairs(names, (("_lock", "_unlock"), ("_take", "_give")))


@register(query(ACCESSES, """f AS (SELECT key_name, list(DISTINCT participant) FILTER (role = 'write') AS w, list(DISTINCT participant) FILTER (role = 'read') AS r FROM accesses GROUP BY key_name)""",
    "SELECT key_name, len(w)::BIGINT AS n_setters, len(r)::BIGINT AS n_getters, len(list_intersect(w, r))::BIGINT AS n_both FROM f WHERE len(list_intersect(w, r)) >= 2"))
def accessor_pairs(s, d):
    # a participant that writes and reads is counted by grouping twice, so no key's set is ever gathered
    own = A.key_accesses(s, d).groupBy("key_name", "participant").agg(F.max((F.col("role") == "write").cast("int")).alias("w"), F.max((F.col("role") == "read").cast("int")).alias("r"))
    return own.groupBy("key_name").agg(F.sum("w").cast("long").alias("n_setters"), F.sum("r").cast("long").alias("n_getters"), F.sum(F.col("w") * F.col("r")).cast("long").alias("n_both")).where("n_both >= 2")


@register("""SELECT p_brand, p_name, p_partkey, place, total FROM (SELECT p_brand, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey)::BIGINT AS place, count(*) OVER (PARTITION BY p_brand) AS total FROM part) WHERE place <= 6""")
def externals_capped(s, d):
    rows = A.table(s, d, "part").select("p_brand", "p_name", "p_partkey")
    return R.capped(rows, "p_brand", ["p_name", "p_partkey"], 6).withColumn("place", F.col("place").cast("long"))


_SHARES = """WITH c AS (SELECT o_custkey AS pool, o_orderkey AS item, floor(o_totalprice)::BIGINT AS claim FROM orders),
r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY pool) AS n, coalesce(sum(claim) OVER (PARTITION BY pool ORDER BY claim, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS served FROM c WINDOW w AS (PARTITION BY pool ORDER BY claim, item)),
l AS (SELECT *, (1000000 - served)::DOUBLE / (n - k + 1) AS level FROM r),
cut AS (SELECT pool, min(k) AS k0, arg_min(level, k) AS level0 FROM l WHERE claim > level GROUP BY pool)
SELECT l.pool, item, claim, round(CASE WHEN k0 IS NULL OR k < k0 THEN claim::DOUBLE ELSE level0 END, 4) AS share FROM l LEFT JOIN cut ON cut.pool = l.pool"""


@register(_SHARES)
def fair_shares(s, d):
    claims = A.table(s, d, "orders").select(F.col("o_custkey").alias("pool"), F.col("o_orderkey").alias("item"), F.floor("o_totalprice").alias("claim"))
    return R.fair_shares(claims, "pool", "item", "claim", 1_000_000)


@register(query(VERTICES, PATHS, """SELECT c_mktsegment AS dir, count(DISTINCT n_name) AS n_files, count(DISTINCT c_custkey) AS n_definitions, sum((c_acctbal < 0 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < 0))::INT)::BIGINT AS n_shadowed
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment"""))
def dir_summary(s, d):
    c = A.table(s, d, "customer").join(A.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    inside = A.table(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey")).distinct().withColumn("known", F.lit(1))
    both = c.join(inside, "c_nationkey", "left")
    return both.groupBy(F.col("c_mktsegment").alias("dir")).agg(F.countDistinct("n_name").alias("n_files"), F.countDistinct("c_custkey").alias("n_definitions"), F.sum((F.col("c_acctbal").__lt__(0) & F.col("known").isNotNull()).cast("int")).alias("n_shadowed"))


_DOSSIER = query(VERTICES, EDGES, """seeds AS (SELECT rowid, name, definition FROM vertices WHERE lines = 50),
o AS (SELECT src, count(DISTINCT dst) AS n_callees FROM edges GROUP BY src), i AS (SELECT dst, count(DISTINCT src) AS n_callers FROM edges GROUP BY dst),
s AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_partkey)""",
    "SELECT rowid, name, definition, coalesce(n_callees, 0) AS n_callees, coalesce(n_callers, 0) AS n_callers, coalesce(n_suppliers, 0) AS n_suppliers, coalesce(n_orders, 0) AS n_orders FROM seeds LEFT JOIN o ON src = rowid LEFT JOIN i ON dst = rowid LEFT JOIN s ON l_partkey = rowid")


@register(_DOSSIER)
def dossier_batch(s, d):
    seeds = A.vertices(s, d).where("lines = 50").select("rowid", "name", "definition")
    e = _edges(s, d)
    out = e.groupBy(F.col("src").alias("rowid")).agg(F.countDistinct("dst").alias("n_callees"))
    into = e.groupBy(F.col("dst").alias("rowid")).agg(F.countDistinct("src").alias("n_callers"))
    sites = A.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("rowid")).agg(F.countDistinct("l_suppkey").alias("n_suppliers"), F.countDistinct("l_orderkey").alias("n_orders"))
    return seeds.join(out, "rowid", "left").join(into, "rowid", "left").join(sites, "rowid", "left").fillna(0, ["n_callees", "n_callers", "n_suppliers", "n_orders"])
