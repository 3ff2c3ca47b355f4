"""Queries over changes and measured cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import edges as E
from lattica.operators import incremental as N
from lattica.operators import report as R
from lattica.sources import adapters as A

QUERIES, ORACLES = {}, {}


def register(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@register("""WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def delta_classify(s, d):
    docs = A.table(s, d, "documents").select("doc_id", "text")
    before = docs.where("doc_id % 11 <> 0").select("doc_id", F.md5("text").alias("h"))
    after = docs.where("doc_id % 13 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("h"))
    return N.delta(before, after, "doc_id", "h")


@register("""WITH f AS (SELECT source, doc_id::VARCHAR AS p, concat_ws(':', doc_id::VARCHAR, sha256(text)) AS line FROM documents), n AS (SELECT source, ceil(count(*) / 64.0)::BIGINT AS buckets FROM f GROUP BY source),
b AS (SELECT f.source, ('0x' || left(md5(p), 8))::BIGINT % buckets AS bucket, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM f JOIN n ON f.source IS NOT DISTINCT FROM n.source GROUP BY ALL)
SELECT source, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS digest FROM b GROUP BY source""")
def tree_digests(s, d):
    files = A.table(s, d, "documents").select("source", F.col("doc_id").cast("string").alias("p"), F.sha2("text", 256).alias("h"))
    return N.merkle_digest(files, "source", "p", "h", bucket=64)


@register("""SELECT user_id, max(ts) AS last_seen, max(CASE WHEN event_type = 'signup' THEN ts END) AS built, coalesce(max(ts) > max(CASE WHEN event_type = 'signup' THEN ts END), true) AS stale,
sum((event_type = 'error')::INT)::BIGINT AS n_errors FROM events GROUP BY user_id""")
def staleness_axes(s, d):
    built = F.max(F.when(F.col("event_type") == "signup", F.col("ts")))
    return A.table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"), built.alias("built"), F.coalesce(F.max("ts") > built, F.lit(True)).alias("stale"), F.sum((F.col("event_type") == "error").cast("int")).alias("n_errors"))


@register("SELECT user_id, event_type, arg_max(value, row(ts, event_id)) AS value, max(row(ts, event_id)).event_id AS event_id FROM (SELECT user_id, event_type, value, ts, event_id FROM events) GROUP BY ALL".replace("max(row(ts, event_id)).event_id", "arg_max(event_id, row(ts, event_id))"))
def last_attempt(s, d):
    return R.last_attempt(A.table(s, d, "events").select("user_id", "event_type", "value", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"], ["value", "event_id"])


@register("SELECT l_partkey, l_suppkey, max(l_orderkey) AS l_orderkey, arg_max(l_quantity, row(l_orderkey, l_quantity)) AS l_quantity FROM lineitem GROUP BY l_partkey, l_suppkey")
def upsert_last_wins(s, d):
    return E.last_writer(A.table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity"), ["l_partkey", "l_suppkey"], "l_orderkey")


@register("""WITH c AS (SELECT event_id, user_id, event_type, sum((event_type = 'view')::INT) OVER w AS searches, sum((event_type = 'purchase')::INT) OVER w AS uses FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, event_type, searches::BIGINT AS searches, uses::BIGINT AS uses, (searches - 3 * uses)::BIGINT AS pressure, event_type = 'view' AND searches - 3 * uses >= 5 AND ((searches - 3 * uses) % 5 = 0 OR searches - 3 * uses >= 20) AS due FROM c""")
def pressure_counter(s, d):
    e = A.table(s, d, "events").select("event_id", "user_id", "event_type", "ts")
    return N.pressure(e, "user_id", ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "purchase").drop("ts")


@register("""WITH p AS (SELECT o_orderpriority AS priority, o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS x, avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS y FROM orders WHERE o_totalprice > 0 GROUP BY ALL),
r AS (SELECT priority, x / y AS r FROM p WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT priority, count(*) AS n_pairs, round(exp(avg(ln(r))), 4) AS geomean, round(stddev_samp(r) / avg(r), 4) AS cv, round(median(r), 4) AS median FROM r GROUP BY priority""")
def paired_ratio_geomean(s, d):
    cells = A.table(s, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority").alias("priority"))
    return R.paired_ratios(cells, "o_custkey", "o_orderstatus", "o_totalprice", "F", "O", "priority")


@register("""SELECT count(*) AS n, round(avg((quality = 1)::INT), 4) AS p_first, round(avg((toxic = 1)::INT), 4) AS p_second,
round(sum((quality = 1 AND toxic <> 1)::INT) / nullif(sum((toxic <> 1)::INT), 0), 4) AS p_first_given_not_second, round(sum((toxic = 1 AND quality <> 1)::INT) / nullif(sum((quality <> 1)::INT), 0), 4) AS p_second_given_not_first,
round(avg((quality = 1 OR toxic = 1)::INT), 4) AS p_union FROM labels""")
def headroom(s, d):
    return R.headroom(A.table(s, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@register("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, arg_max(event_type, row(n, -first)) AS event_type, sum(n)::BIGINT AS n_votes, round(max(n) / sum(n), 4) AS agreement FROM c GROUP BY user_id""")
def majority_vote(s, d):
    return R.majority(A.table(s, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


@register("SELECT p_partkey, r_name FROM part, region WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3)")
def cell_grid(s, d):
    fenced = A.table(s, d, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("p_partkey"))
    return R.cells(A.table(s, d, "part").select("p_partkey"), A.table(s, d, "region").select("r_name"), fenced, "p_partkey")


@register("""SELECT l_orderkey, bool_and(CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linestatus = 'F' END) IS NOT NULL OR count(*) = 0 AS any_known,
CASE WHEN bool_or(l_returnflag <> 'N' AND l_linestatus <> 'F') THEN false WHEN bool_or(l_returnflag = 'N') THEN NULL ELSE true END AS every,
CASE WHEN bool_or(l_returnflag <> 'N' AND l_linestatus = 'F') THEN true WHEN bool_or(l_returnflag = 'N') THEN NULL ELSE false END AS some FROM lineitem GROUP BY l_orderkey""")
def condition_3vl(s, d):
    guard = F.when(F.col("l_returnflag") != "N", F.col("l_linestatus") == "F")
    # three flags are enough, and they combine before the shuffle
    any_of = lambda c: F.max(F.coalesce(c, F.lit(False)))
    flags = A.table(s, d, "lineitem").groupBy("l_orderkey").agg(any_of(guard).alias("yes"), any_of(~guard).alias("no"), any_of(guard.isNull()).alias("unknown"))
    every = F.when(F.col("no"), False).when(~F.col("unknown"), True)
    some = F.when(F.col("yes"), True).when(~F.col("unknown"), False)
    return flags.select("l_orderkey", (F.col("yes") | F.col("no")).alias("any_known"), every.alias("every"), some.alias("some"))


@register("SELECT event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS elapsed FROM events")
def stage_timing(s, d):
    e = A.table(s, d, "events").select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return R.segment_times(e, "user_id", ["ts", "event_id"], "at").select("event_id", "user_id", "elapsed")


_ENTRY = """WITH c AS (SELECT p_partkey, p_name, p_brand, count(*) OVER (PARTITION BY p_name, p_brand) AS same, count(*) OVER (PARTITION BY p_name) AS anywhere FROM part),
w AS (SELECT DISTINCT l_orderkey AS script, p_name, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1)
SELECT script, w.p_name, min(coalesce(a.p_partkey, b.p_partkey)) AS rowid FROM w LEFT JOIN c a ON a.p_name = w.p_name AND a.p_brand = w.p_brand AND a.same = 1 LEFT JOIN c b ON b.p_name = w.p_name AND b.anywhere = 1 GROUP BY ALL"""


@register(_ENTRY)
def entry_seeds(s, d):
    part = A.table(s, d, "part").select("p_partkey", "p_name", "p_brand")
    same = part.groupBy("p_name", "p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("here")).where("n = 1").drop("n")
    unique = part.groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("there")).where("n = 1").drop("n")
    scripts = A.table(s, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("script"), F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey").select("script", "p_name", "p_brand").distinct()
    both = scripts.join(same, ["p_name", "p_brand"], "left").join(unique, "p_name", "left")
    return both.groupBy("script", "p_name").agg(F.min(F.coalesce("here", "there")).alias("rowid"))
