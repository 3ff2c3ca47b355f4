"""Queries over declared manifests, external termini and verified stage results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.functions.storage import scratch_path
from lattica.functions import scalars as S
from lattica.operators import answers as W
from lattica.operators import manifests as M
from lattica.operators import report as R
from lattica.operators import scans as X
from lattica.operators import stages as C
from lattica.operators import termini as T
from lattica.plans.sql import query
from lattica.sources import adapters as A

QUERIES, ORACLES = {}, {}


def register(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _manifest_texts(s, d):
    """(manifest, text): one JSON document an order, by the order's key tables, spaces, a list of names or something else."""
    key, text = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    line = A.table(s, d, "lineitem").join(A.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"), "l_orderkey")
    name = F.when(F.col("l_quantity") >= 3, F.concat_ws("#", F.concat(F.lit("supp "), text("l_suppkey")), text("l_linenumber")))
    helpers = F.when(F.col("l_tax") >= 0.02, F.col("l_linestatus") == "O")
    kind, units = F.concat(F.lit("u"), text("l_linenumber")), F.col("l_quantity").cast("int")
    table = F.struct(name.alias("id"), kind.alias("type"), units.alias("default"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("enum"), helpers.alias("helpers"))
    enum = F.when(F.col("l_returnflag") == "R", F.struct(F.lit(1).alias("on")))
    space = F.struct(name.alias("name"), F.struct(kind.alias("mem"), F.when(F.col("l_discount") > 0.05, units).alias("default")).alias("type"), enum.alias("enum_set"), helpers.alias("generate_helpers"))
    group = F.concat_ws("-", "l_linestatus", (F.col("o_custkey") % 10).cast("string"))
    # only the form that the order's document takes is carried along
    of = lambda form, c: F.when(F.col("l_orderkey") % 4 == form, c)
    line = line.select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("P-"), "o_orderpriority").alias("ns"), group.alias("class"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("k"), of(0, table).alias("t"), of(1, space).alias("p"), of(3, name).alias("n"))
    # one list of a class, sorted once; its columns are the three forms
    classes = line.groupBy("o_orderkey", "ns", "class").agg(F.sort_array(F.collect_list(F.struct("k", "t", "p", "n"))).alias("x"))
    form = lambda f: F.transform("x", lambda x: x[f])
    classes = classes.select("o_orderkey", "ns", "class", form("t").alias("t"), form("p").alias("p"), F.array_distinct(F.array_compact(form("n"))).alias("n"))
    own = F.sort_array(F.collect_list(F.struct("class", "t", "p", "n")))
    order = classes.groupBy("o_orderkey", "ns").agg(own.alias("c"))
    of_tables = F.struct(F.struct(F.col("ns").alias("id")).alias("meta"), F.transform("c", lambda c: F.struct(c["class"].alias("id"), c["t"].alias("keys"))).alias("classes"))
    of_spaces = F.struct(F.col("ns").alias("namespace"), F.transform("c", lambda c: F.struct(c["class"].alias("name"), c["p"].alias("data"))).alias("classes"))
    names = F.flatten(F.transform("c", lambda c: F.transform(c["n"], lambda n: M.define_name(F.col("ns"), c["class"], n))))
    names = F.when(key % 8 == 7, F.concat(names, F.array(F.lit("note")))).otherwise(names)
    doc = F.when(key % 4 == 0, F.to_json(of_tables)).when(key % 4 == 1, F.to_json(of_spaces)).when(key % 4 == 2, F.to_json(F.struct(key.alias("order"), F.lit("none").alias("classes")))).otherwise(F.to_json(names))
    # cut short: the shortest, an empty list, would be whole within seven characters
    cut = F.substring(doc, F.lit(1), F.least(F.lit(7), F.length(doc) - 1))
    return order.select(key.alias("manifest"), F.when(key % 101 == 0, cut).otherwise(doc).alias("text"))


def _observed(s, d):
    line = A.table(s, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 3").join(A.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"), "l_orderkey")
    group = F.concat_ws("-", "l_linestatus", (F.col("o_custkey") % 10).cast("string"))
    return line.select(M.define_name(F.concat(F.lit("P-"), "o_orderpriority"), group, F.concat_ws("#", F.concat(F.lit("supp "), F.col("l_suppkey").cast("string")), F.col("l_linenumber").cast("string"))).alias("define_name"))


_MANIFESTS = r"""lines AS (
  SELECT *, 'P-' || o_orderpriority AS ns, l_linestatus || '-' || o_custkey % 10 AS class, CASE WHEN l_quantity >= 3 THEN 'supp ' || l_suppkey || '#' || l_linenumber END AS key_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
named AS (
  SELECT *, array_to_string(list_transform([ns, class, key_id], lambda x: upper(regexp_replace(x, '[\s_#-]+', '', 'g'))), '_') AS define_name FROM lines WHERE key_id IS NOT NULL),
documents_ AS (
  SELECT l_orderkey AS manifest, count(key_id) AS n, CASE WHEN l_orderkey % 101 = 0 THEN 'malformed' WHEN l_orderkey % 4 = 0 THEN 'tables' WHEN l_orderkey % 4 = 1 THEN 'spaces'
    WHEN l_orderkey % 8 = 3 AND count(key_id) > 0 THEN 'key_list' ELSE 'other' END AS shape FROM lines GROUP BY l_orderkey),
shaped AS (SELECT * FROM named JOIN documents_ ON manifest = l_orderkey),
listed AS (SELECT DISTINCT define_name FROM shaped WHERE shape = 'key_list'),
observed AS (SELECT DISTINCT define_name FROM named WHERE l_returnflag = 'R'),
firsts AS (
  SELECT * FROM shaped WHERE shape IN ('tables', 'spaces') QUALIFY row_number() OVER (PARTITION BY manifest, define_name ORDER BY class, l_linenumber, l_partkey, l_suppkey) = 1),
flagged AS (SELECT f.*, l.define_name IS NOT NULL AS listed, o.define_name IS NOT NULL AS observed FROM firsts f LEFT JOIN listed l USING (define_name) LEFT JOIN observed o USING (define_name)),
kept AS (SELECT manifest, bool_or(listed) AS kept, count(*) AS n_keys FROM flagged GROUP BY manifest)"""


@register(query(_MANIFESTS, """SELECT manifest, define_name, shape, ns AS namespace, class AS class_name, key_id, 'u' || l_linenumber AS value_type, CASE shape WHEN 'tables' THEN l_quantity::INT::VARCHAR END AS default_value,
  CASE WHEN shape = 'tables' AND l_returnflag <> 'N' THEN l_returnflag END AS enum_name, CASE WHEN l_tax >= 0.02 THEN l_linestatus = 'O' END AS helpers,
  CASE shape WHEN 'spaces' THEN nullif(concat_ws(',', CASE WHEN l_discount > 0.05 THEN 'default' END, CASE WHEN l_returnflag = 'R' THEN 'enum_set' END), '') END AS unresolved, listed, observed
FROM flagged WHERE manifest IN (SELECT manifest FROM kept WHERE kept)"""))
def data_model_keys(s, d):
    return M.select_manifests(M.read_manifests(_manifest_texts(s, d), "manifest", "text"), _observed(s, d))[0]


@register(query(_MANIFESTS, "SELECT d.manifest, shape, CASE WHEN shape NOT IN ('tables', 'spaces') THEN shape WHEN kept THEN 'selected' ELSE 'unlisted' END AS state, coalesce(n_keys, 0) AS n_keys FROM documents_ d LEFT JOIN kept k ON k.manifest = d.manifest"))
def manifest_states(s, d):
    return M.select_manifests(M.read_manifests(_manifest_texts(s, d), "manifest", "text"), _observed(s, d))[1]


_TERMINI = """led AS (
  SELECT *, l_partkey * 3 + l_linenumber % 3 AS slot, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) * 3 + (l_linenumber + 1) % 3 AS next_slot FROM lineitem),
registered AS (SELECT DISTINCT l_orderkey AS name, slot FROM led WHERE l_returnflag = 'A'),
invoked AS (SELECT DISTINCT l_orderkey AS name, l_partkey AS invoker FROM led WHERE l_returnflag = 'N'),
concrete AS (SELECT DISTINCT next_slot AS slot FROM led WHERE l_returnflag = 'N' AND l_quantity < 5 AND next_slot IS NOT NULL),
forwarded AS (SELECT DISTINCT next_slot AS slot, slot AS giver FROM led WHERE l_returnflag = 'R' AND l_quantity >= 42 AND next_slot <> slot),
walk(slot, node, depth, path) AS (
  SELECT DISTINCT slot, slot, 0::BIGINT, [slot] FROM registered
  UNION ALL SELECT w.slot, giver, depth + 1, list_append(path, giver) FROM walk w JOIN forwarded f ON f.slot = w.node WHERE NOT list_contains(path, giver)),
reach AS (SELECT slot, node, min(depth) AS depth, arg_min(path, row(depth, path)) AS path FROM walk GROUP BY slot, node),
bound AS (SELECT DISTINCT name FROM registered JOIN reach USING (slot) WHERE node IN (SELECT slot FROM concrete)),
ends AS (SELECT * FROM reach WHERE depth > 0 AND node NOT IN (SELECT slot FROM concrete UNION SELECT slot FROM forwarded)),
free AS (
  SELECT name, arg_min(row(depth, path, slot, node), row(depth, path, slot, node)) AS m, count(DISTINCT node) AS n_termini FROM registered JOIN ends USING (slot) WHERE name NOT IN (SELECT name FROM bound) GROUP BY name)"""


@register(query(_TERMINI, "SELECT name, invoker, m[3] AS registered_by, m[4] AS terminus, m[1] AS depth, m[2] AS path, n_termini FROM invoked JOIN free USING (name)", recursive=True))
def external_termini(s, d):
    """An order is a name; its lines register, invoke, bind or forward parameters of their parts, as their return flag says."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    led = line.withColumn("slot", F.col("l_partkey") * 3 + F.col("l_linenumber") % 3).withColumn("next", F.lead("l_partkey").over(order) * 3 + (F.col("l_linenumber") + 1) % 3)
    registered = led.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("name"), "slot")
    invoked = led.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("name"), F.col("l_partkey").alias("invoker"))
    concrete = led.where("l_returnflag = 'N' and l_quantity < 5 and next is not null").select(F.col("next").alias("slot"))
    forwarded = led.where("l_returnflag = 'R' and l_quantity >= 42 and next <> slot").select(F.col("next").alias("slot"), F.col("slot").alias("by"))
    return T.external_termini(registered, invoked, concrete, forwarded)


@register(r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS words FROM documents)
SELECT doc_id, len(words)::BIGINT AS n_words, len(list_distinct(words))::BIGINT AS n_distinct, doc_id % 10 <> 0 OR text = '' AS reused FROM w""")
def stage_cache_reuse(s, d):
    """A stage over all documents, after a run over a state in which every tenth text was still empty."""
    docs = A.table(s, d, "documents").select("doc_id", "text")

    def compute(rows):
        words = F.filter(F.split("text", r"\s+"), lambda t: t != "")
        return rows.select("doc_id", F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))

    digested = lambda rows: rows.withColumn("digest", F.sha2("text", 256))
    path, options = scratch_path(s, "stage-results"), {"unit": "word"}
    before = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text")))
    C.cached_stage(digested(before), "doc_id", "digest", compute, path, "1", options)
    return C.cached_stage(digested(docs), "doc_id", "digest", compute, path, "1", options)


@register(r"""WITH d AS (SELECT doc_id, 1 + doc_id % 3 AS start, (string_split(text, chr(10)))[1 + doc_id % 3:3 + doc_id % 3] AS w FROM documents),
k AS (SELECT *, coalesce(list_position(list_transform(w, lambda x: contains(x, ',')), true), 0) AS k, CASE WHEN len(w) = 0 THEN NULL WHEN k > 0 THEN k ELSE len(w) END AS n FROM d)
SELECT doc_id, CASE WHEN n IS NOT NULL THEN array_to_string(w[1:n], chr(10)) END AS excerpt, start + n - 1 AS last_line, CASE WHEN n IS NOT NULL THEN k = 0 AND n = 3 END AS truncated FROM k""")
def declaration_excerpts(s, d):
    """Of each document the statement that one of its first lines begins: up to a comma, at most three lines."""
    excerpt, last, truncated = W.declaration_excerpt(F.col("text"), (1 + F.col("doc_id") % 3).cast("int"), 3, ",")
    return A.table(s, d, "documents").select("doc_id", excerpt.alias("excerpt"), last.alias("last_line"), truncated.alias("truncated"))


@register("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_size || '.' || p_partkey % 7 END AS version FROM part")
def symbol_versions(s, d):
    word = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"))
    body = F.when(F.col("p_size") % 3 == 0, F.when(F.col("p_size") % 2 == 0, "  ")).otherwise(F.concat(F.lit("  "), word, F.lit(" since")))
    detail = F.concat(F.lit("<para>"), "p_name", F.lit('</para><simplesect kind="version"><para>'), body, F.lit("</para></simplesect>"))
    return A.table(s, d, "part").select("p_partkey", S.extract_version(detail).alias("version"))


_DRAFT = """owing AS (SELECT n_name || '/' || s_suppkey % 3 AS section, s_name AS key, floor(s_acctbal)::INT::VARCHAR AS value, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey),
own AS (SELECT section, key, value FROM owing WHERE s_acctbal < 0),
sections AS (SELECT section, CASE WHEN count(*) FILTER (s_acctbal < 0) = 0 THEN 'no_candidates' WHEN count(*) FILTER (s_acctbal < 0) * 2 > count(*) THEN 'report_only' ELSE 'proposed' END AS status FROM owing GROUP BY section)"""


@register(query(_DRAFT, """SELECT section, 0::BIGINT AS place, '# ' || section || ': ' || status AS line FROM sections
UNION ALL SELECT section, row_number() OVER (PARTITION BY section ORDER BY key, value), CASE status WHEN 'proposed' THEN '#> ' ELSE '#  ' END || key || ': ' || value FROM own JOIN sections USING (section)"""))
def proposal_draft(s, d):
    """Sections of suppliers; those that owe are proposed, unless most of a section do."""
    n = A.table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = A.table(s, d, "supplier").join(n, "s_nationkey").select(F.concat_ws("/", "n_name", (F.col("s_suppkey") % 3).cast("string")).alias("section"), F.col("s_name").alias("key"), F.floor("s_acctbal").cast("string").alias("value"), "s_acctbal")
    owes = F.count_if(F.col("s_acctbal") < 0)
    status = F.when(owes == 0, "no_candidates").when(owes * 2 > F.count("*"), "report_only").otherwise("proposed")
    return R.drafted(rows.groupBy("section").agg(status.alias("status")), rows.where("s_acctbal < 0").select("section", "key", "value"))


@register("SELECT event_type, '| ' || event_type || ' | ' || count(*) || ' | ' || count(DISTINCT user_id) || ' |' AS line FROM events GROUP BY event_type")
def metric_report(s, d):
    e = A.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return e.select("event_type", S.report_line(F.col("event_type"), F.col("n"), F.col("users")).alias("line"))


@register("SELECT doc_id, left(text, length(text)::INT - 1) || CASE WHEN strlen(right(text, 1)) > 1 THEN chr(65533) ELSE '' END AS repaired FROM documents WHERE text <> ''")
def repaired_texts(s, d):
    """Whole texts of which the last byte was lost."""
    data = F.encode("text", "UTF-8")
    return A.table(s, d, "documents").where("text <> ''").select("doc_id", X.repaired_bytes(F.substring(data, F.lit(1), F.octet_length(data) - 1)).alias("repaired"))
