"""Queries over edges, identities, intervals and closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.storage import materialize
from lattica.operators import closure as C
from lattica.operators import edges as E
from lattica.operators import identity as I
from lattica.operators import intervals as V
from lattica.plans.sql import ACCESSES, EDGES, QUALIFIED, RAW, SECTIONS, FIRM, VERTICES, points, query
from lattica.sources import adapters as A

QUERIES, ORACLES = {}, {}
#: Width of a bucket of the time axis: a day in microseconds.
DAY = 86_400_000_000


def register(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _edges(s, d):
    return E.first_writer(A.raw_edges(s, d).drop("weight"), ["src", "dst", "source"], "seq").drop("seq")


@register(query(VERTICES, RAW, "SELECT a.name AS caller, b.name AS callee, source, grade, count(*) AS n FROM raw JOIN vertices a ON src = a.rowid JOIN vertices b ON dst = b.rowid WHERE a.kind = 'function' AND b.kind = 'function' GROUP BY ALL"))
def edges_direct(s, d):
    v = A.vertices(s, d).where("kind = 'function'")
    both = A.raw_edges(s, d).join(v.select(F.col("rowid").alias("src"), F.col("name").alias("caller")), "src").join(v.select(F.col("rowid").alias("dst"), F.col("name").alias("callee")), "dst")
    return both.groupBy("caller", "callee", "source", "grade").agg(F.count("*").alias("n"))


def _firm_edges(s, d):
    """(src, dst): all deduplicated edges that are not fuzzy."""
    return _edges(s, d).where("grade <> 'fuzzy' and src <> dst").select("src", "dst").distinct()


@register(query(EDGES, "SELECT src, dst, source, grade FROM edges"))
def edges_dedup_first(s, d):
    return _edges(s, d)


@register(query(VERTICES, FIRM, """kinds AS (SELECT rowid, kind FROM vertices)""", """SELECT a.src, b.dst, min(a.dst) AS via, count(*) AS n_paths FROM firm a JOIN firm b ON a.dst = b.src
JOIN kinds x ON x.rowid = a.src JOIN kinds m ON m.rowid = a.dst JOIN kinds y ON y.rowid = b.dst
WHERE a.src <> b.dst AND x.kind = 'function' AND m.kind = 'macro' AND y.kind = 'function' GROUP BY ALL"""))
def macro_hop_edges(s, d):
    """Calls that functions make through macros: kinds are tested before edges are deduplicated, and those left are written once."""
    kinds = A.vertices(s, d).select("rowid", "kind")
    raw = A.raw_edges(s, d).drop("weight").where("src <> dst").join(kinds.select(F.col("rowid").alias("src"), F.col("kind").alias("of")), "src").join(kinds.select(F.col("rowid").alias("dst"), F.col("kind").alias("to")), "dst")
    through = raw.where("of = 'function' and to = 'macro' or of = 'macro' and to = 'function'")
    firm = E.first_writer(through, ["src", "dst", "source", "of", "to"], "seq").where("grade <> 'fuzzy'")
    e = materialize(firm.select("src", "dst", "of").distinct(), "macro-edges")
    return E.two_hop(e.where("of = 'function'"), onward=e.where("of = 'macro'"))


_RANK = "CASE grade WHEN 'exact' THEN 2 WHEN 'resolved' THEN 1 ELSE 0 END"
_PLACE = "CASE source WHEN 'direct' THEN 0 WHEN 'member' THEN -1 ELSE -2 END"


@register(query(VERTICES, EDGES, f"SELECT src, b.name AS callee, arg_max(source, row({_RANK}, {_PLACE}, source, grade)) AS source, arg_max(grade, row({_RANK}, {_PLACE}, source, grade)) AS grade, count(*) AS n_rows FROM edges JOIN vertices b ON dst = b.rowid GROUP BY src, b.name"))
def callees_collapsed(s, d):
    named = _edges(s, d).join(A.vertices(s, d).select(F.col("rowid").alias("dst"), F.col("name").alias("callee")), "dst")
    return E.strongest(named, ["src", "callee"], A.GRADES, A.SOURCES)


@register(query(VERTICES, EDGES, f"SELECT dst, a.name AS caller, arg_max(source, row({_RANK}, {_PLACE}, source, grade)) AS source, arg_max(grade, row({_RANK}, {_PLACE}, source, grade)) AS grade, count(*) AS n_rows FROM edges JOIN vertices a ON src = a.rowid GROUP BY dst, a.name"))
def callers_collapsed(s, d):
    named = _edges(s, d).join(A.vertices(s, d).select(F.col("rowid").alias("src"), F.col("name").alias("caller")), "src")
    return E.strongest(named, ["dst", "caller"], A.GRADES, A.SOURCES)


@register(query(EDGES, "SELECT src, dst, count(*) AS n_rows FROM edges GROUP BY ALL HAVING sum(CASE WHEN grade <> 'fuzzy' THEN 1 ELSE 0 END) = 0"))
def pairs_without_nonfuzzy(s, d):
    return E.without_evidence(_edges(s, d))


_OVERRIDES = "overrides AS (SELECT rowid AS child, first AS parent FROM (SELECT rowid, min(rowid) OVER (PARTITION BY name, file) AS first FROM vertices) WHERE rowid <> first)"


def _overrides(s, d):
    from pyspark.sql import Window

    first = F.min("rowid").over(Window.partitionBy("name", "file"))
    return A.vertices(s, d).select("rowid", first.alias("parent")).where("rowid <> parent").select(F.col("rowid").alias("child"), "parent")


@register(query(VERTICES, _OVERRIDES, "SELECT child, parent FROM overrides"))
def override_refs(s, d):
    return _overrides(s, d)


_DOMINATED = [VERTICES, QUALIFIED, _OVERRIDES, EDGES, """named AS (SELECT e.*, name, q FROM edges e JOIN qualified v ON dst = v.rowid),
pairs AS (SELECT child AS x, parent AS y FROM overrides UNION SELECT parent, child FROM overrides),
verdicts AS (
  SELECT f.src, f.dst, f.source, CASE WHEN count(a.dst) = 0 THEN 'unanchored' WHEN max((f.q = a.q)::INT) = 1 THEN 'same_identity'
    WHEN max((p.x IS NOT NULL)::INT) = 1 THEN 'override' ELSE 'dominated' END AS verdict
  FROM named f LEFT JOIN (SELECT DISTINCT src, name, dst, q FROM named WHERE grade <> 'fuzzy') a ON a.src = f.src AND a.name = f.name
  LEFT JOIN pairs p ON p.x = f.dst AND p.y = a.dst WHERE f.grade = 'fuzzy' GROUP BY ALL)"""]


def _verdicts(s, d):
    v = A.vertices(s, d)
    return E.dominated(_edges(s, d), v.select("rowid", "name", I.qualified(F.col("definition"), F.col("name")).alias("qualified")), _overrides(s, d))


@register(query(*_DOMINATED, "SELECT * FROM verdicts"))
def dominated_verdicts(s, d):
    return _verdicts(s, d)


@register(query(*_DOMINATED, "SELECT src, dst, source, grade FROM edges WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.src = edges.src AND v.dst = edges.dst AND v.source = edges.source AND edges.grade = 'fuzzy' AND verdict = 'dominated')"))
def edges_pruned(s, d):
    gone = _verdicts(s, d).where("verdict = 'dominated'").select("src", "dst", "source", F.lit("fuzzy").alias("grade"))
    return _edges(s, d).join(gone, ["src", "dst", "source", "grade"], "left_anti")


@register(query(EDGES, "SELECT src, dst, source, grade FROM edges WHERE src <> dst OR EXISTS (SELECT 1 FROM edges e WHERE e.src = edges.src AND e.dst = edges.dst AND e.source = 'direct')"))
def self_edges_pruned(s, d):
    e = _edges(s, d)
    proven = e.where("source = 'direct' and src = dst").select("src", "dst").distinct()
    return e.where("src <> dst").unionByName(e.where("src = dst").join(proven, ["src", "dst"], "left_semi").select(e.columns))


_FUNCTION = "SELECT name, count(*) AS n_rows, arg_min(rowid, row(NOT is_def, rowid)) AS rowid, arg_min(is_def, row(NOT is_def, rowid)) AS is_def FROM vertices WHERE kind = 'function' GROUP BY name"


@register(query(VERTICES, _FUNCTION))
def identity_canonical(s, d):
    return I.canonical(A.vertices(s, d))


@register(query(VERTICES, QUALIFIED, "SELECT name, count(*) AS n_rows, count(DISTINCT q) AS n_identities, count(DISTINCT definition) AS n_definitions, count(DISTINCT definition) > 1 AS overloaded FROM qualified GROUP BY name"))
def identity_candidates(s, d):
    return I.candidates(A.vertices(s, d))


@register(query(VERTICES, "SELECT name, rowid FROM vertices v WHERE is_def = (SELECT max(is_def::INT) = 1 FROM vertices w WHERE w.name = v.name)"))
def identity_definitions(s, d):
    return I.definition_preferring(A.vertices(s, d))


@register(query(VERTICES, EDGES, "SELECT name, count(DISTINCT rowid) AS n_targets, count(*) AS n_edges, sum((grade = 'fuzzy')::INT)::BIGINT AS n_fuzzy FROM edges JOIN vertices ON dst = rowid GROUP BY name HAVING count(DISTINCT rowid) > 1"))
def name_ambiguity(s, d):
    named = _edges(s, d).join(A.vertices(s, d).select(F.col("rowid").alias("dst"), "name"), "dst")
    return named.groupBy("name").agg(F.countDistinct("dst").alias("n_targets"), F.count("*").alias("n_edges"), F.sum((F.col("grade") == "fuzzy").cast("int")).alias("n_fuzzy")).where("n_targets > 1")


@register(query(VERTICES, "SELECT rowid, definition FROM vertices WHERE regexp_matches(definition, '(^|[^A-Za-z0-9_])PROMO([^A-Za-z0-9_]|$)') OR regexp_matches(definition, '(^|[^A-Za-z0-9_])Brand#13([^A-Za-z0-9_]|$)')"))
def boundary_match(s, d):
    v = A.vertices(s, d)
    return v.where(I.at_boundary(F.col("definition"), "PROMO") | I.at_boundary(F.col("definition"), "Brand#13")).select("rowid", "definition")


_SITES = """sites AS (SELECT o_orderkey AS site, CASE WHEN o_orderkey % 7 = 0 THEN 'nowhere' ELSE replace(p_name, ' ', '_') END AS name,
  CASE WHEN o_orderkey % 3 = 0 THEN p_brand WHEN o_orderkey % 3 = 1 THEN 'Brand#0' END AS qualifier
  FROM orders JOIN part ON p_partkey = o_custkey)"""


@register(query(VERTICES, _SITES, """met AS (
  SELECT site, s.name, qualifier, rowid, rowid IS NOT NULL AND (qualifier IS NULL OR contains(definition, qualifier || '::')) AS fits
  FROM sites s LEFT JOIN (SELECT * FROM vertices WHERE kind = 'function') v ON v.name = s.name),
grouped AS (SELECT site, name, qualifier, count(rowid) AS n, sum(fits::INT) AS n_fit, min(rowid) AS only_row, min(CASE WHEN fits THEN rowid END) AS fit FROM met GROUP BY ALL),
matched AS (SELECT *, CASE WHEN n_fit = 1 THEN 'resolved' WHEN n = 0 THEN 'external' WHEN n = 1 AND n_fit = 0 THEN 'receiver_unverified' ELSE 'ambiguous' END AS match FROM grouped)""",
    "SELECT site, name, qualifier, n, CASE match WHEN 'resolved' THEN fit WHEN 'receiver_unverified' THEN only_row END AS rowid, match FROM matched"))
def callee_resolution(s, d):
    both = A.table(s, d, "orders").select("o_orderkey", "o_custkey").join(A.table(s, d, "part").select("p_partkey", "p_name", "p_brand"), F.col("p_partkey") == F.col("o_custkey"))
    k = F.col("o_orderkey")
    sites = both.select(k.alias("site"), F.when(k % 7 == 0, "nowhere").otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, "Brand#0").alias("qualifier"))
    return I.resolve_names(sites, A.vertices(s, d))


_PAIRS = """own AS (SELECT DISTINCT key_name, role, participant FROM accesses),
counts AS (SELECT key_name, sum((role = 'write')::INT)::BIGINT AS writers, sum((role = 'read')::INT)::BIGINT AS readers FROM own GROUP BY key_name)"""


@register(query(ACCESSES, _PAIRS, "SELECT w.key_name, w.participant AS writer, r.participant AS reader FROM own w JOIN own r ON w.key_name = r.key_name AND w.role = 'write' AND r.role = 'read' JOIN counts c ON c.key_name = w.key_name WHERE writers * readers BETWEEN 1 AND 64"))
def shared_key_inferred(s, d):
    return E.shared_key_pairs(A.key_accesses(s, d))


@register(query(ACCESSES, _PAIRS, "SELECT * FROM counts WHERE writers * readers > 64"))
def shared_key_suppressed(s, d):
    return E.shared_key_pairs(A.key_accesses(s, d), suppressed=True)


@register(query(ACCESSES, "SELECT key_name, CASE WHEN max((role = 'write')::INT) = 1 THEN 'write' ELSE 'read' END AS side FROM accesses GROUP BY key_name HAVING count(DISTINCT role) = 1"))
def one_sided_topics(s, d):
    return E.one_sided(A.key_accesses(s, d))


@register(query(ACCESSES, "SELECT key_name, participant, arg_min(mode, row(mode = 'unknown', event_id)) AS mode FROM accesses GROUP BY ALL"))
def dispatch_mode_first_known(s, d):
    return E.first_known(A.key_accesses(s, d), ["key_name", "participant"], "mode", "event_id")


_INSIDE = "s.holder = p.holder AND p.at >= s.lo AND (s.hi IS NULL OR p.at <= s.hi)"


@register(query(SECTIONS, points("click"), f"SELECT p.point, min(s.section) AS section FROM points p LEFT JOIN sections s ON {_INSIDE} GROUP BY p.point"))
def line_in_span(s, d):
    return V.enclosing(A.points(s, d, "click"), A.sections(s, d), DAY)


@register(query(SECTIONS, points("purchase"), f"SELECT point, holder, p.at FROM points p WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE {_INSIDE})"))
def spans_anti_overlap(s, d):
    return V.uncovered(A.points(s, d, "purchase"), A.sections(s, d), DAY)


@register(query(SECTIONS, points("view"), f"SELECT p.point, p.holder, p.at, s.section, s.lo, s.hi FROM points p JOIN sections s ON {_INSIDE}"))
def locks_held(s, d):
    return V.contained(A.points(s, d, "view"), A.sections(s, d), DAY)


@register(query(SECTIONS, "SELECT section, holder, lo, hi, hi IS NULL AS open_ended FROM sections"))
def lock_sections(s, d):
    return A.sections(s, d).withColumn("open_ended", F.col("hi").isNull())


_NESTED = "nested AS (SELECT o.section AS outer_section, i.section AS inner_section, i.holder FROM sections i JOIN sections o ON i.holder = o.holder AND o.section <> i.section AND o.lo < i.lo AND i.hi IS NOT NULL AND (o.hi IS NULL OR i.hi < o.hi) AND (o.hi IS NULL OR i.lo <= o.hi))"
_LAYERED = SECTIONS + ",\nlayered AS (SELECT section, holder, lo, CASE WHEN section % 2 = 0 THEN hi ELSE lo + 3600000000 * 30 END AS hi FROM sections)"
_LAYERED_NESTED = _NESTED.replace("sections", "layered")


def _layered(s, d):
    """Sections of which every other one lasts thirty hours, so that some lie inside others."""
    return A.sections(s, d).withColumn("hi", F.when(F.col("section") % 2 == 0, F.col("hi")).otherwise(F.col("lo") + 3_600_000_000 * 30))


@register(query(_LAYERED, _LAYERED_NESTED, "SELECT * FROM nested"))
def lock_nestings(s, d):
    return V.nestings(_layered(s, d), DAY)


@register(query(_LAYERED, _LAYERED_NESTED, "SELECT holder, count(*) AS n_sites, sum((inner_section % 2 = 0)::INT)::BIGINT AS n_good, arg_min(inner_section, row(inner_section % 2 <> 0, inner_section)) AS exemplar FROM nested GROUP BY holder"))
def nesting_pairs(s, d):
    from lattica.operators.rosters import exemplars

    return exemplars(V.nestings(_layered(s, d), DAY), ["holder"], F.col("inner_section") % 2 == 0, "inner_section")


@register(query(SECTIONS, points("click"), "counted AS (SELECT s.section, count(p.point) AS n FROM sections s LEFT JOIN points p ON " + _INSIDE + " GROUP BY s.section)", "SELECT holder, count(*) AS n_sections, sum((hi IS NULL)::INT)::BIGINT AS n_open, sum(n)::BIGINT AS n_calls FROM sections JOIN counted USING (section) GROUP BY holder"))
def lock_roster(s, d):
    inside = V.contained(A.points(s, d, "click"), A.sections(s, d), DAY).groupBy("section").agg(F.count("*").alias("n"))
    both = A.sections(s, d).join(inside, "section", "left")
    return both.groupBy("holder").agg(F.count("*").alias("n_sections"), F.sum(F.col("hi").isNull().cast("int")).alias("n_open"), F.sum(F.coalesce("n", F.lit(0))).alias("n_calls"))


@register(query(SECTIONS, """given AS (SELECT event_id, user_id AS holder, epoch_us(ts) AS g_lo, epoch_us(ts) + 1800000000 AS g_hi FROM events WHERE event_type = 'purchase')""",
    "SELECT section, CASE WHEN hi IS NOT NULL AND EXISTS (SELECT 1 FROM given g WHERE g.holder = s.holder AND g_lo - 600000000 <= s.hi AND g_hi + 600000000 >= s.lo) THEN 'hit' WHEN EXISTS (SELECT 1 FROM given g WHERE g.holder = s.holder) THEN 'holder_only' ELSE 'missed' END AS grade FROM sections s"))
def interval_overlap_drift(s, d):
    given = A.points(s, d, "purchase").select("holder", F.col("at").alias("lo"), (F.col("at") + 1_800_000_000).alias("hi"))
    return V.overlap_grades(A.sections(s, d), given, 600_000_000, DAY)


@register("""SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
FROM (SELECT event_id, user_id, event_type, ts FROM events)""")
def last_event_attribution(s, d):
    e = A.table(s, d, "events").select("event_id", "user_id", "event_type", "ts")
    return V.last_before(e, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", "event_id")


@register("""WITH a AS (SELECT user_id, event_id // 3 AS pair, min(epoch_us(ts)) AS at FROM events WHERE event_id % 3 = 0 GROUP BY ALL),
b AS (SELECT event_id // 3 AS pair, min(epoch_us(ts)) AS at FROM events WHERE event_id % 3 = 1 AND event_type <> 'error' GROUP BY ALL),
p AS (SELECT user_id, count(*) AS n_pairs, sum(greatest(b.at - a.at, 0))::BIGINT AS total FROM a JOIN b USING (pair) GROUP BY user_id)
SELECT DISTINCT a.user_id, coalesce(n_pairs, 0) AS n_pairs, total FROM a LEFT JOIN p USING (user_id)""")
def start_stop_pairs(s, d):
    e = A.table(s, d, "events").select("user_id", "event_type", (F.col("event_id") % 3).alias("r"), F.floor(F.col("event_id") / 3).alias("pair"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    a = e.where("r = 0").groupBy("user_id", "pair").agg(F.min("at").alias("at"))
    b = e.where("r = 1 and event_type <> 'error'").groupBy("pair").agg(F.min("at").alias("at"))
    return V.paired_duration(a, b, "pair", "user_id")


_SEEDS = "seeds AS (SELECT rowid AS node FROM vertices WHERE lines = 50)"


def _seeds(s, d):
    return A.vertices(s, d).where("lines = 50").select(F.col("rowid").alias("node"))


@register(query(VERTICES, FIRM, "seeds AS (SELECT rowid AS node FROM vertices WHERE lines = 50), reach(node) AS (SELECT node FROM seeds UNION SELECT dst FROM reach JOIN firm ON src = node)", "SELECT rowid, CASE WHEN EXISTS (SELECT 1 FROM reach WHERE node = rowid) THEN 'live' ELSE 'orphan' END AS state FROM vertices", recursive=True))
def reachability_liveness(s, d):
    return C.liveness(A.vertices(s, d), _seeds(s, d), _firm_edges(s, d)).drop("depth")


_MEMBERS = "reach(thread, node) AS (SELECT file, rowid FROM vertices WHERE lines >= 49 UNION SELECT thread, dst FROM reach JOIN firm ON src = node)"


@register(query(VERTICES, FIRM, _MEMBERS, "SELECT thread, node FROM reach", recursive=True))
def thread_membership(s, d):
    return _members(s, d)


def _members(s, d):
    seeds = A.vertices(s, d).where("lines >= 49").select(F.col("file").alias("thread"), F.col("rowid").alias("node"))
    return C.closure(seeds, _firm_edges(s, d), "thread").drop("depth")


@register(query(VERTICES, FIRM, _MEMBERS, "SELECT thread, count(*) AS n_members, min(node) AS first_member FROM reach GROUP BY thread", recursive=True))
def thread_roster(s, d):
    return _members(s, d).groupBy("thread").agg(F.count("*").alias("n_members"), F.min("node").alias("first_member"))


@register(query(VERTICES, FIRM, _MEMBERS, "SELECT node, count(*) AS n_threads FROM reach GROUP BY node HAVING count(*) > 1", recursive=True))
def multi_thread_members(s, d):
    return _members(s, d).groupBy("node").agg(F.count("*").alias("n_threads")).where("n_threads > 1")


@register(query(VERTICES, FIRM, _MEMBERS, "sets AS (SELECT node, list(thread) AS groups FROM reach GROUP BY node)", "SELECT src, dst, CASE WHEN a.groups IS NOT NULL AND b.groups IS NOT NULL THEN NOT list_has_any(a.groups, b.groups) END AS crosses, CASE WHEN len(b.groups) = 1 THEN b.groups[1] END AS to_group FROM firm LEFT JOIN sets a ON a.node = src LEFT JOIN sets b ON b.node = dst", recursive=True))
def thread_boundaries(s, d):
    from lattica.operators.rosters import boundaries

    return boundaries(_firm_edges(s, d), _members(s, d).withColumnRenamed("thread", "group"))


def _levels(fan_out: int, depth: int, edges: str) -> list[str]:
    """Unrolled levels of a bounded, tapered walk."""
    parts = ["f1 AS (SELECT node AS seed, node AS src FROM seeds)", "x0 AS (SELECT seed, src FROM f1)"]
    for k in range(1, depth + 1):
        cap = max(fan_out >> (k - 1), 1)
        parts.append(f"h{k} AS (SELECT * FROM (SELECT seed, {k}::BIGINT AS depth, f.src, e.dst, greatest(count(*) OVER w - {cap}, 0)::BIGINT AS omitted, row_number() OVER (PARTITION BY seed, f.src ORDER BY e.dst) AS place FROM f{k} f JOIN {edges} e ON e.src = f.src WINDOW w AS (PARTITION BY seed, f.src)) WHERE place <= {cap})")
        parts.append(f"f{k + 1} AS (SELECT DISTINCT seed, dst AS src FROM h{k} WHERE NOT EXISTS (SELECT 1 FROM x{k - 1} x WHERE x.seed = h{k}.seed AND x.src = h{k}.dst))")
        parts.append(f"x{k} AS (SELECT * FROM x{k - 1} UNION ALL SELECT * FROM f{k + 1})")
    return parts


def _chain_sql(edges: str) -> str:
    return query(VERTICES, FIRM, "back AS (SELECT dst AS src, src AS dst FROM firm)", _SEEDS, *_levels(4, 3, edges), " UNION ALL ".join(f"SELECT seed, depth, src, dst, omitted FROM h{k}" for k in (1, 2, 3)))


@register(_chain_sql("firm"))
def chain_forward(s, d):
    return C.chains(_seeds(s, d), _firm_edges(s, d), 3, 4)


@register(_chain_sql("back"))
def chain_backward(s, d):
    e = _firm_edges(s, d)
    return C.chains(_seeds(s, d), e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), 3, 4)


_DECLARED = """own AS (SELECT DISTINCT n_name AS key_name, 'write' AS role, s_suppkey AS participant FROM nation JOIN supplier ON s_nationkey = n_nationkey
  UNION SELECT n_name, 'read', c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey),
n AS (SELECT key_name, sum((role = 'write')::INT)::BIGINT AS w, sum((role = 'read')::INT)::BIGINT AS r FROM own GROUP BY key_name)"""


@register(query(_DECLARED, "SELECT key_name, role, participant, CASE role WHEN 'write' THEN r ELSE w END AS n_others FROM own JOIN n USING (key_name) WHERE w > 0 AND r > 0"))
def shared_key_declared(s, d):
    """All nations, suppliers and customers, as counts: the pairs of a nation grow with the square of its size."""
    keys = A.table(s, d, "nation").select(F.col("n_name").alias("key_name"), "n_nationkey")
    w = keys.join(A.table(s, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).select("key_name", F.lit("write").alias("role"), F.col("s_suppkey").alias("participant"))
    r = keys.join(A.table(s, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).select("key_name", F.lit("read").alias("role"), F.col("c_custkey").alias("participant"))
    return E.side_counts(w.unionByName(r), ("write", "read"))
