"""Queries of scalar rules, dispatch and gradings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.operators import dispatch as D
from lattica.operators import edges as E
from lattica.plans.linking import _OVERRIDES, _PLACE, _RANK, _overrides
from lattica.plans.sql import EDGES, PATHS, VERTICES, query
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


@register(query(VERTICES, _OVERRIDES, EDGES, f"""best AS (SELECT src, dst, arg_max(grade, row({_RANK}, {_PLACE}, source, grade)) AS incoming FROM edges GROUP BY src, dst),
n AS (SELECT parent, count(*) AS n FROM overrides GROUP BY parent)""", "SELECT src, child AS dst, parent AS via, CASE WHEN n = 1 AND incoming <> 'fuzzy' THEN 'resolved' ELSE 'fuzzy' END AS grade FROM best JOIN overrides ON parent = best.dst JOIN n USING (parent) WHERE src <> child"))
def dispatch_crossed(s, d):
    return D.crossed(_edges(s, d), _overrides(s, d), A.GRADES, A.SOURCES)


@register(query(VERTICES, _OVERRIDES, EDGES, "SELECT DISTINCT src, v.file || '::' || v.name AS boundary FROM edges JOIN vertices v ON dst = v.rowid WHERE dst IN (SELECT parent FROM overrides)"))
def dispatch_boundary(s, d):
    parents = _overrides(s, d).select(F.col("parent").alias("rowid")).distinct()
    named = A.vertices(s, d).join(parents, "rowid", "left_semi").select(F.col("rowid").alias("dst"), F.concat_ws("::", "file", "name").alias("boundary"))
    return _edges(s, d).join(named, "dst").select("src", "boundary").distinct()


_BINDINGS = """named AS (SELECT l_partkey AS callee, l_linenumber % 3 AS place, l_returnflag, s_nationkey AS target, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS to_callee FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
passed AS (SELECT DISTINCT callee, place, target FROM named WHERE l_returnflag <> 'R'),
fw AS (SELECT DISTINCT callee, place, to_callee, (place + 1) % 3 AS to_place FROM named WHERE l_returnflag = 'R' AND to_callee IS NOT NULL),
bound(callee, place, target) AS (SELECT callee, place, target FROM passed UNION SELECT to_callee, to_place, target FROM bound JOIN fw USING (callee, place))"""


@register(query(_BINDINGS, "SELECT callee, place, target FROM bound", recursive=True))
def callback_bindings(s, d):
    """All order lines: a returned one forwards its place to the next line's part, the others pass their supplier's nation."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = A.table(s, d, "lineitem").join(A.table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target")), "l_suppkey")
    named = line.select(F.col("l_partkey").alias("callee"), (F.col("l_linenumber") % 3).alias("place"), "l_returnflag", "target", F.lead("l_partkey").over(order).alias("to"))
    passed = named.where("l_returnflag <> 'R'").select("callee", "place", "target")
    forwarded = named.where("l_returnflag = 'R' and `to` is not null").select("callee", "place", "to", ((F.col("place") + 1) % 3).alias("to_place")).distinct()
    return D.bind_callbacks(passed, forwarded)


_ROLES = """roles AS (SELECT n_name AS topic, 'emit' AS role, s_name AS name, s_suppkey AS rowid, s_acctbal > 0 AS is_def FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT n_name, 'handle', c_mktsegment, c_custkey, c_acctbal > 0 FROM customer JOIN nation ON n_nationkey = c_nationkey),
own AS (SELECT DISTINCT topic, role, rowid FROM (SELECT *, max(is_def::INT) OVER (PARTITION BY topic, role, name) AS any_def FROM roles) WHERE is_def::INT = any_def),
n AS (SELECT topic, sum((role = 'emit')::INT)::BIGINT AS e, sum((role = 'handle')::INT)::BIGINT AS h FROM own GROUP BY topic)"""


@register(query(_ROLES, "SELECT topic AS key_name, role, rowid AS participant, CASE role WHEN 'emit' THEN h ELSE e END AS n_others FROM own JOIN n USING (topic) WHERE e > 0 AND h > 0"))
def event_edges(s, d):
    """All suppliers and customers, with the number of those each meets: the pairs of a topic grow with its square."""
    n = A.table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("topic"))
    emit = A.table(s, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select("topic", F.lit("emit").alias("role"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("rowid"), (F.col("s_acctbal") > 0).alias("is_def"))
    handle = A.table(s, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("topic", F.lit("handle").alias("role"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("rowid"), (F.col("c_acctbal") > 0).alias("is_def"))
    own = D.topic_roles(emit.unionByName(handle)).select(F.col("topic").alias("key_name"), "role", F.col("rowid").alias("participant"))
    return E.side_counts(own, ("emit", "handle"))


@register(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), c AS (SELECT *, regexp_extract(left(t, 240), '^(.*) ', 1) AS cut FROM f)
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE CASE WHEN cut = '' THEN left(t, 240) ELSE cut END || '…' END AS brief FROM c""")
def doc_briefs(s, d):
    return A.table(s, d, "documents").select("doc_id", S.brief(F.col("text")).alias("brief"))


@register("SELECT doc_id, CASE WHEN length(text) > 4000 THEN left(text, 4000) || ' [+' || (length(text) - 4000) || ' characters]' ELSE text END AS detail FROM documents")
def capped_details(s, d):
    return A.table(s, d, "documents").select("doc_id", S.capped_detail(F.col("text")).alias("detail"))


@register(r"SELECT p_partkey, upper(regexp_replace(p_brand, '[\s_#-]+', '', 'g')) || '_' || upper(regexp_replace(p_type, '[\s_#-]+', '', 'g')) AS define, CASE WHEN starts_with(p_type, 'STANDARD ') THEN substr(p_type, 10) WHEN starts_with(p_type, 'SMALL ') THEN substr(p_type, 7) ELSE p_type END AS bare, left(sha1(p_name), 6) AS slug FROM part")
def symbol_names(s, d):
    return A.table(s, d, "part").select("p_partkey", S.define_name(F.col("p_brand"), F.col("p_type")).alias("define"), S.without_prefix(F.col("p_type"), ("STANDARD ", "SMALL ")).alias("bare"), S.slug(F.col("p_name")).alias("slug"))


@register(query(PATHS, "SELECT split_part(path, '/', 1) AS dir, lower(split_part(path, '/', 3)) AS extension, count(*) AS n FROM (SELECT DISTINCT path FROM paths) GROUP BY ALL"))
def index_scope(s, d):
    p = A.paths(s, d).select("path").distinct()
    return p.groupBy(F.substring_index("path", "/", 1).alias("dir"), F.lower(F.substring_index("path", "/", -1)).alias("extension")).agg(F.count("*").alias("n"))


@register("""SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'signup') = 0 THEN NULL WHEN count(*) FILTER (event_type = 'error') * 4 >= count(*) THEN 'vetoed' ELSE 'checked' END AS verdict FROM events GROUP BY user_id""")
def falsity_check(s, d):
    one = lambda kind: F.sum((F.col("event_type") == kind).cast("int"))
    verdict = F.when(one("signup") == 0, None).when(one("error") * 4 >= F.count("*"), "vetoed").otherwise("checked")
    return A.table(s, d, "events").groupBy("user_id").agg(verdict.alias("verdict"))


@register("""SELECT user_id, count(*) AS n_total, sum((event_type <> 'error' AND value > 0)::INT)::BIGINT AS n_marked, sum((event_type = 'error')::INT)::BIGINT AS n_fenced,
round(100.0 * sum((event_type <> 'error' AND NOT (value > 0))::INT) / nullif(sum((event_type <> 'error')::INT), 0), 2) AS unmarked_pct FROM events GROUP BY user_id""")
def score_rollup(s, d):
    fenced, marked = F.col("event_type") == "error", F.col("value") > 0
    one = lambda c: F.sum(c.cast("int"))
    rows = A.table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n_total"), one(~fenced & marked).alias("n_marked"), one(fenced).alias("n_fenced"), one(~fenced & ~marked).alias("unmarked"))
    total = F.assert_true(F.col("n_marked") + F.col("n_fenced") + F.col("unmarked") == F.col("n_total"), F.lit("rows were lost"))
    live = F.nullif(F.col("n_total") - F.col("n_fenced"), F.lit(0))
    return rows.where(total.isNull()).select("user_id", "n_total", "n_marked", "n_fenced", F.round(100.0 * F.col("unmarked") / live, 2).alias("unmarked_pct"))


@register("SELECT event_type, CASE WHEN value IS NULL THEN 'unknown' WHEN value < 1 THEN 'empty' WHEN value < 50 THEN 'rows' ELSE 'source' END AS bucket, count(*) AS n FROM events GROUP BY ALL")
def result_buckets(s, d):
    bucket = F.when(F.col("value").isNull(), "unknown").when(F.col("value") < 1, "empty").when(F.col("value") < 50, "rows").otherwise("source")
    return A.table(s, d, "events").groupBy("event_type", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@register("""WITH cited AS (SELECT DISTINCT o_orderpriority AS arm, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
got AS (SELECT DISTINCT o_orderpriority AS arm, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A')
SELECT c.arm, count(*) AS n_cited, sum((g.l_partkey IS NULL)::INT)::BIGINT AS n_unretrieved, round(avg((g.l_partkey IS NULL)::INT), 4) AS rate FROM cited c LEFT JOIN got g ON g.arm = c.arm AND g.l_partkey = c.l_partkey GROUP BY c.arm""")
def unretrieved(s, d):
    both = A.table(s, d, "lineitem").join(A.table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("arm")), F.col("o_orderkey") == F.col("l_orderkey"))
    # one grouping tells for each pair whether it was cited and whether it was got
    pairs = both.groupBy("arm", "l_partkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("cited"), F.max((F.col("l_returnflag") == "A").cast("int")).alias("got")).where("cited = 1")
    missed = F.sum(1 - F.col("got"))
    return pairs.groupBy("arm").agg(F.count("*").alias("n_cited"), missed.alias("n_unretrieved"), F.round(missed / F.count("*"), 4).alias("rate"))


@register("""WITH n AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (value > 99)) AS e, list_sort(list(DISTINCT event_type) FILTER (value > 97)) AS dd, list_sort(list(DISTINCT event_type) FILTER (value > 90)) AS h FROM events GROUP BY user_id)
SELECT user_id, array_to_string(CASE WHEN len(e) > 0 THEN e WHEN len(dd) > 0 THEN dd ELSE coalesce(h, []) END, ',') AS options FROM n""")
def layered_options(s, d):
    some = lambda least: F.array_sort(F.collect_set(F.when(F.col("value") > least, F.col("event_type"))))  # noqa: E731  five types at most
    rows = A.table(s, d, "events").groupBy("user_id").agg(some(99).alias("e"), some(97).alias("dd"), some(90).alias("h"))
    return rows.select("user_id", F.array_join(S.layered(F.col("e"), F.col("dd"), F.col("h"), F.array().cast("array<string>")), ",").alias("options"))


@register(query(VERTICES, "SELECT name, count(*) AS n_sites, min(file) AS first_file, sum((starts_with(lower(name), 'test_') OR contains(lower(file), '#1'))::INT)::BIGINT AS n_test FROM vertices WHERE kind = 'macro' GROUP BY name"))
def macro_definitions(s, d):
    v = A.vertices(s, d).where("kind = 'macro'")
    test = F.startswith(F.lower("name"), F.lit("test_")) | F.contains(F.lower("file"), F.lit("#1"))
    return v.groupBy("name").agg(F.count("*").alias("n_sites"), F.min("file").alias("first_file"), F.sum(test.cast("int")).alias("n_test"))


@register("""WITH s AS (SELECT user_id, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY user_id), t AS (SELECT max(ts) AS now FROM events)
SELECT user_id, n, round(epoch_us(now) / 86400000000.0 - epoch_us(last_seen) / 86400000000.0, 3) AS age_days FROM s, t WHERE last_seen >= now - INTERVAL 1 DAY""")
def registry_cull(s, d):
    e = A.table(s, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    own = e.groupBy("user_id").agg(F.max("at").alias("last_seen"), F.count("*").alias("n"))
    now = e.agg(F.max("at").alias("now"))
    both = own.crossJoin(F.broadcast(now)).where(F.col("last_seen") >= F.col("now") - 86_400_000_000)  # one row
    return both.select("user_id", "n", F.round(F.col("now") / 86_400_000_000 - F.col("last_seen") / 86_400_000_000, 3).alias("age_days"))
