"""Queries of revising fixpoints, indexed search, walks of two edge classes, conditions and subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.storage import materialize
from lattica.operators import budget as B
from lattica.operators import conditions as K
from lattica.operators import fixpoint as X
from lattica.operators import postings as P
from lattica.operators import subjects as S
from lattica.operators import walks as W
from lattica.plans.sql import EDGES, VERTICES, query
from lattica.sources import adapters as A

QUERIES, ORACLES = {}, {}


def register(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# An order line calls the next one's part and hands over two arguments: at place 0 a parameter of its own where no tax is due, at
# place 1 where there is no discount; else something of its own making.
_PASSES = """passes AS MATERIALIZED (
  SELECT l_partkey AS name, dst AS callee, CASE WHEN l_tax < 0.005 THEN l_quantity::INT % 2 END AS p0, CASE WHEN l_discount < 0.005 THEN (l_linenumber % 2)::INT END AS p1
  FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL),
k0 AS MATERIALIZED (
  SELECT rowid AS name, (rowid % 2)::INT AS place, CASE WHEN rowid % 3 > 0 THEN (1 - rowid % 2)::INT END AS label, CASE rowid % 3 WHEN 0 THEN 'task' WHEN 1 THEN 'thread' ELSE 'process' END AS kind, '' AS via, '' AS conflicts
  FROM vertices WHERE lines = 50),
r0 AS (SELECT NULL::BIGINT AS name, '' AS places WHERE false)"""


def _revisions(rounds: int) -> list[str]:
    parts = []
    for i in range(1, rounds + 1):
        parts.append(f"""e{i} AS MATERIALIZED (
  SELECT name, array_to_string(list_sort(list(DISTINCT own)), ',') AS places, CASE WHEN count(DISTINCT own) = 1 THEN min(own) END AS place,
    CASE WHEN count(DISTINCT coalesce(own_label, -1)) = 1 THEN min(own_label) END AS label,
    CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'unknown' END AS kind, array_to_string(list_sort(list(DISTINCT callee)), ',') AS via,
    concat_ws(',', CASE WHEN count(DISTINCT kind) > 1 OR min(kind) = 'unknown' THEN 'kind' END, CASE WHEN count(DISTINCT coalesce(own_label, -1)) > 1 THEN 'label' END) AS conflicts
  FROM (SELECT p.name, callee, k.kind, CASE k.place WHEN 0 THEN p0 ELSE p1 END AS own, CASE k.label WHEN 0 THEN p0 WHEN 1 THEN p1 END AS own_label
    FROM passes p JOIN k{i - 1} k ON k.name = callee WHERE p.name NOT IN (SELECT name FROM k0))
  WHERE own IS NOT NULL GROUP BY name),
k{i} AS MATERIALIZED (SELECT * FROM k{i - 1} WHERE name NOT IN (SELECT name FROM e{i}) UNION ALL SELECT name, place, label, kind, via, conflicts FROM e{i} WHERE place IS NOT NULL),
r{i} AS MATERIALIZED (SELECT * FROM r{i - 1} WHERE name NOT IN (SELECT name FROM e{i}) UNION ALL SELECT name, places FROM e{i} WHERE place IS NULL)""")
    return parts


@register(query(VERTICES, _PASSES, *_revisions(X.MOST_ROUNDS), f"""SELECT name, place, label, kind, via, conflicts, place::VARCHAR AS places,
  CASE WHEN name IN (SELECT name FROM k0) THEN 'seed' WHEN name IN (SELECT name FROM e{X.MOST_ROUNDS}) THEN 'derived' ELSE 'unsupported' END AS state FROM k{X.MOST_ROUNDS}
UNION ALL SELECT name, NULL, NULL, NULL, NULL, NULL, places, 'refused' FROM r{X.MOST_ROUNDS}"""))
def wrapper_fixpoint(s, d):
    """Every order line hands its two arguments on; parts of size 50 are the primitives."""
    line = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount")
    order = W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    first = F.when(F.col("l_tax") < 0.005, F.col("l_quantity").cast("int") % 2)
    second = F.when(F.col("l_discount") < 0.005, (F.col("l_linenumber") % 2).cast("int"))
    passes = line.withColumn("callee", F.lead("l_partkey").over(order)).select(F.col("l_partkey").alias("name"), "callee", F.create_map(F.lit(0), first, F.lit(1), second).alias("own"))
    k = F.col("rowid")
    kind = F.when(k % 3 == 0, "task").when(k % 3 == 1, "thread").otherwise("process")
    seeds = A.vertices(s, d).where("lines = 50").select(k.alias("name"), (k % 2).alias("place"), F.when(k % 3 > 0, 1 - k % 2).alias("label"), kind.alias("kind"))
    return X.derive_revising(seeds, passes)


#: Asked at once: all words somewhere, a word that is nowhere, phrases, a quote too many, a word twice, nothing to ask for.
ASKED = {1: "the and with", 2: "the nosuchword", 3: '"of the"', 4: '"the of" and', 5: 'and "the', 6: '"nosuchword the" of', 7: "nosuchword", 8: "The, the!", 9: "?!", 10: '"the the the"'}


def _asked_sql(asked: dict[int, str]) -> str:
    rows = [(q, u, k, t, len(unit), len(units)) for q, text in asked.items() for units in [P.parsed(text)] for u, unit in enumerate(units) for k, t in enumerate(unit)]
    return "asked(query, unit, off, term, size, units) AS (VALUES " + ", ".join(f"({q}, {u}, {k}, '{t}', {n}, {m})" for q, u, k, t, n, m in rows) + ")"


def _scored_sql(name: str, asked: str) -> str:
    return f"""{name}_starts AS (SELECT query, unit, id, n, t.pos - off AS start FROM toks t JOIN {asked} a ON a.term = t.term GROUP BY query, unit, id, n, size, t.pos - off HAVING count(*) = size),
{name}_tf AS (SELECT query, unit, id, n, count(*) AS tf FROM {name}_starts GROUP BY ALL),
{name}_df AS (SELECT query, unit, count(*) AS df FROM {name}_tf GROUP BY ALL),
{name} AS (
  SELECT query, id, count(*)::INT AS n_hit, round(sum(ln(1 + (documents - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score
  FROM {name}_tf JOIN {name}_df USING (query, unit), stats GROUP BY ALL)"""


_TOKENS = """words AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda t: t <> '') AS w FROM documents),
stats AS (SELECT count(*) AS documents, avg(len(w)) AS mean FROM words),
toks AS (SELECT id, len(w) AS n, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM words)"""


@register(query(_TOKENS, _asked_sql(ASKED), _scored_sql("strict", "asked"),
    "full_hits AS (SELECT s.*, false AS widened FROM strict s WHERE n_hit = (SELECT any_value(units) FROM asked a WHERE a.query = s.query))",
    """loose_terms AS (SELECT query, dense_rank() OVER (PARTITION BY query ORDER BY term) AS unit, 0 AS off, term, 1 AS size FROM (SELECT DISTINCT query, term FROM asked WHERE query NOT IN (SELECT query FROM full_hits)
  AND query IN (SELECT query FROM asked GROUP BY query HAVING count(DISTINCT term) > 1)))""",
    _scored_sql("loose", "loose_terms"),
    """every AS (SELECT * FROM full_hits UNION ALL SELECT *, true FROM loose)""",
    "SELECT query, id AS doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank, score, n_hit, widened FROM every"))
def prose_index_batch(s, d):
    """One index of all documents, written once and asked a batch of queries."""
    return P.search_index(P.build_postings(A.table(s, d, "documents"), "doc_id", "text"), s, ASKED)


_HOPS = """calls AS (
  SELECT src, dst, max(CASE grade WHEN 'exact' THEN 'exact' ELSE NULL END) AS exact FROM edges WHERE grade <> 'fuzzy' AND src <> dst GROUP BY ALL),
own AS (
  SELECT DISTINCT l_suppkey || '/' || strftime(l_shipdate, '%Y-%m') AS key_name, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'write' ELSE 'read' END AS role, l_partkey AS participant FROM lineitem),
keyed AS (
  SELECT w.participant AS src, r.participant AS dst, key_name, w.l_suppkey FROM own w JOIN own r USING (key_name)
  WHERE w.role = 'write' AND r.role = 'read' AND w.participant <> r.participant),
hops AS (
  SELECT src, dst, 'call' AS class, CASE exact WHEN 'exact' THEN 0 ELSE 1 END AS level FROM calls
  UNION ALL SELECT src, dst, 'key', CASE WHEN s_acctbal >= 0 THEN 2 ELSE 3 END + CASE WHEN coalesce(split_part(a.definition, ' ', 1), '') <> coalesce(split_part(b.definition, ' ', 1), '') THEN 2 ELSE 0 END
  FROM keyed JOIN supplier ON s_suppkey = l_suppkey JOIN vertices a ON a.rowid = src JOIN vertices b ON b.rowid = dst),
near AS MATERIALIZED (SELECT h.*, v.kind FROM hops h JOIN vertices v ON v.rowid = dst),
offers AS (SELECT src, count(*) FILTER (WHERE class = 'call') AS calls, count(*) FILTER (WHERE class = 'key') AS keys FROM near GROUP BY src),
links AS MATERIALIZED (SELECT src, dst, kind, min(level) AS level FROM near GROUP BY ALL)"""
_WALKS = """walked(seed, node, depth) USING KEY (seed, node) AS (
  SELECT rowid, rowid, 0::BIGINT FROM vertices WHERE lines = 40 AND kind <> 'macro'
  UNION SELECT seed, dst, w.depth + 1 FROM walked w JOIN links ON src = node
  WHERE level < 4 AND kind <> 'macro' AND NOT EXISTS (SELECT 1 FROM recurring.walked x WHERE x.seed = w.seed AND x.node = dst)),
reached AS (SELECT seed, depth + 1 AS depth, dst, kind, min(level) AS level FROM walked JOIN links ON src = node GROUP BY ALL),
judged AS (
  SELECT r.*, w.depth AS walked, min(r.depth) OVER (PARTITION BY r.seed, dst) AS first,
    CASE WHEN kind = 'macro' THEN 'terminus' WHEN w.depth = 0 THEN 'seen' WHEN r.depth = w.depth THEN NULL ELSE 'boundary' END AS stop
  FROM reached r LEFT JOIN walked w ON w.seed = r.seed AND w.node = dst)"""


#: Lines of a part, or readers of a key, beyond which their hops are dealt to several tasks: fewer than one in so many lines are.
HUB_LINES = 20_000
#: Firm and other calls, firm and other keys, and what crossing adds: the order in which hops are evidence for a part.
_LEVELS = {"call": (0, 1), "key": (2, 3)}
_BEYOND = 2


def _level(kind: str, firm):
    return F.when(firm, _LEVELS[kind][0]).otherwise(_LEVELS[kind][1]).alias("level")


@register(query(VERTICES, EDGES, _HOPS, _WALKS, """SELECT seed, depth, dst, kind, CASE WHEN level < 2 THEN 'call' ELSE 'key' END AS class, CASE level WHEN 0 THEN 'exact' WHEN 1 THEN 'resolved' END AS certainty,
  CASE WHEN level IN (2, 4) THEN 'declared' WHEN level IN (3, 5) THEN 'inferred' END AS strength, level >= 4 AS crosses, coalesce(calls, 0) AS calls, coalesce(keys, 0) AS keys, stop
FROM judged LEFT JOIN offers ON src = dst WHERE depth = first OR depth = walked""", recursive=True))
def chain_two_classes(s, d):
    """Calls that are not fuzzy and keys that parts of a supplier's month share, from functions of size 40 on.

    One row for each function of size 40 and part that its walk reaches, with the strongest hop that reaches it and the numbers of
    hops that leave it. Macros are termini, and a shared key between parts of different make crosses a boundary.
    """
    v, line = A.vertices(s, d), A.table(s, d, "lineitem")
    # a definition is null in SQL where one of its columns is
    make = F.when(F.col("name").isNotNull() & F.col("file").isNotNull(), F.substring_index("definition", " ", 1)).otherwise("")
    parts = v.select("rowid", "kind", make.alias("make"), (F.col("kind") == "macro").alias("ends"))
    sides = materialize(parts.select("make").distinct().withColumn("side", F.monotonically_increasing_id()), "chain-makes")
    parts = materialize(parts.join(sides, "make").drop("make"), "chain-parts").hint("merge")
    # the first writer of each source in one grouping: the pair of a hop is moved once, with numbers only
    grade = F.when(F.col("grade") == "exact", 2).when(F.col("grade") == "resolved", 1).otherwise(0)
    first = F.struct("seq.l_orderkey", "seq.l_linenumber", "seq.l_suppkey", grade.alias("grade"))
    firsts = [F.min(F.when(F.col("source") == x, first))["grade"] for x in A.SOURCES]
    calls = A.raw_edges(s, d).where("src <> dst").groupBy("src", "dst").agg(F.greatest(*firsts).alias("grade")).where("grade > 0")
    calls = calls.join(parts.select(F.col("rowid").alias("dst"), "ends"), "dst").select("src", "dst", _level("call", F.col("grade") == 2), "ends")
    calls = materialize(calls, "chain-calls")
    # a key is one number: that of its supplier, below 2^37 in 16 partitions, and 23 bits for the month
    suppliers = A.table(s, d, "supplier").coalesce(16).select(F.col("s_suppkey").alias("l_suppkey"), _level("key", F.col("s_acctbal") >= 0), F.monotonically_increasing_id().alias("number"))
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    key = (F.col("number") * (1 << 23) + month + (1 << 22)).alias("group")
    writes = F.coalesce((F.col("l_returnflag") == "R").cast("int"), F.lit(0))
    lines = line.where("l_shipdate is not null").join(materialize(suppliers, "chain-suppliers"), "l_suppkey").select(F.col("l_partkey").alias("rowid"), key, "level", writes.alias("writes"))
    own = lines.repartition("rowid").groupBy("rowid", "group", "level").agg(F.max("writes").alias("writes"), F.max(1 - F.col("writes")).alias("reads"))
    own = materialize(own.join(parts.drop("kind"), "rowid"), "chain-keys")
    into = own.where("writes = 1 and not ends").select(F.col("rowid").alias("src"), "group", "side")
    out = own.where("reads = 1").select("group", "side", F.col("rowid").alias("dst"), "level", "ends")
    readers = materialize(out.groupBy("group").agg(F.count("*").alias("readers")), "chain-readers")
    # a part that reads what it writes does not meet itself
    met = own.where("writes = 1").join(readers.hint("merge"), "group").groupBy(F.col("rowid").alias("dst")).agg(F.sum(F.col("readers") - F.col("reads")).alias("keys"))
    called = calls.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("calls"))
    about = parts.select(F.col("rowid").alias("dst"), "ends", "kind").join(called.hint("merge"), "dst", "left").join(met.hint("merge"), "dst", "left")
    about = materialize(about.select("dst", "ends", "kind", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("keys", F.lit(0)).alias("keys")), "chain-about")
    hubs = line.groupBy(F.col("l_partkey").alias("src")).agg(F.count("*").alias("lines")).where(F.col("lines") > HUB_LINES).select("src")
    seeds = v.where("lines = 40 and kind <> 'macro'").select(F.col("rowid").alias("node"))
    walks = W.whole_walks(seeds, calls, into, out, _BEYOND, about, materialize(hubs, "chain-hubs"), readers.where(F.col("readers") > HUB_LINES).select("group"))
    level = F.col("level")
    strength = F.when(level.isin(2, 4), "declared").when(level.isin(3, 5), "inferred")
    return walks.select(
        "seed", "depth", "dst", "kind", F.when(level < 2, "call").otherwise("key").alias("class"), F.when(level == 0, "exact").when(level == 1, "resolved").alias("certainty"),
        strength.alias("strength"), (level >= 4).alias("crosses"), "calls", "keys", "stop",
    )


# A line's guard is built of three operands, each true, false or unknown by its columns, in one of eight shapes.
_OPERANDS = """operands AS (
  SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'defined(F_A)' WHEN 'R' THEN 'defined F_R' ELSE 'LEVEL_N >= 2' END AS ta, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS a,
    CASE WHEN l_linenumber = 7 THEN 'HAS(x, 1)' WHEN l_linestatus = 'O' THEN 'defined( S_O )' ELSE 'defined(S_F)' END AS tb, CASE WHEN l_linenumber <> 7 THEN l_linestatus = 'O' END AS b,
    CASE WHEN l_quantity < 25 THEN 'defined(Q_LOW)' ELSE 'defined(Q_HIGH)' END AS tc, l_quantity < 25 AS c FROM lineitem),
guards AS (
  SELECT l_orderkey, l_linenumber, CASE l_orderkey % 8 WHEN 0 THEN ta || ' && ' || tb WHEN 1 THEN ta || '||' || tb WHEN 2 THEN '!(' || ta || ' || ' || tb || ') && ' || tc
      WHEN 3 THEN '((' || ta || ') && (' || tb || ' || !' || tc || ')) || (' || tc || ' && !!' || tb || ')' WHEN 4 THEN '!' || ta || ' && ' || tb || ' || ' || tc
      WHEN 5 THEN '(' || ta || ' && ' || tc WHEN 6 THEN tc || ' ' || ta ELSE tb || ' && ' END AS condition,
    CASE l_orderkey % 8 WHEN 0 THEN a AND b WHEN 1 THEN a OR b WHEN 2 THEN NOT (a OR b) AND c WHEN 3 THEN (a AND (b OR NOT c)) OR (c AND b) WHEN 4 THEN ((NOT a) AND b) OR c
      WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE b AND NULL END AS live FROM operands)"""
#: Names that the configuration defines.
DEFINED = ["F_A", "S_O", "Q_LOW"]


def _guards(s, d):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    a = F.when(flag == "A", "defined(F_A)").when(flag == "R", "defined F_R").otherwise("LEVEL_N >= 2")
    b = F.when(F.col("l_linenumber") == 7, "HAS(x, 1)").when(status == "O", "defined( S_O )").otherwise("defined(S_F)")
    c = F.when(F.col("l_quantity") < 25, "defined(Q_LOW)").otherwise("defined(Q_HIGH)")
    shapes = ["{a} && {b}", "{a}||{b}", "!({a} || {b}) && {c}", "(({a}) && ({b} || !{c})) || ({c} && !!{b})", "!{a} && {b} || {c}", "({a} && {c}", "{c} {a}", "{b} && "]
    text = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        # a shape's text between its operands
        parts = [{"a": a, "b": b, "c": c}[p[0]] if p[1:] == "}" else F.lit(p) for p in shape.replace("{", "\0").replace("}", "}\0").split("\0") if p]
        text = F.when(F.col("l_orderkey") % 8 == i, F.concat(*parts)).otherwise(text)
    return A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("condition"))


@register(query(_OPERANDS, "SELECT condition, live, count(*) AS n FROM guards GROUP BY ALL"))
def conditions_evaluated(s, d):
    return K.evaluated(_guards(s, d).groupBy("condition").agg(F.count("*").alias("n")), DEFINED).select("condition", K.verdict(F.col("value")).alias("live"), "n")


@register(query(_OPERANDS, """values_of AS (SELECT l_orderkey, CASE WHEN live IS NULL THEN 1 WHEN live = (l_linenumber % 3 > 0) THEN 2 ELSE 0 END AS v FROM guards)""",
    "SELECT l_orderkey, CASE min(v) WHEN 2 THEN 'live' WHEN 0 THEN 'dead' ELSE 'undecided' END AS verdict FROM values_of GROUP BY l_orderkey"))
def guard_verdicts(s, d):
    """An order's lines are the guards around it; every third one has it in its other branch."""
    guards = _guards(s, d)
    value = K.evaluated(guards.groupBy("condition").agg(F.count("*").alias("n")), DEFINED).select(F.col("condition").alias("of"), "value")
    both = guards.join(value, F.col("condition").eqNullSafe(F.col("of")))
    return both.groupBy("l_orderkey").agg(K.chain_verdict(F.col("value"), F.col("l_linenumber") % 3 == 0).alias("verdict"))


_NAMED = """named AS (
  SELECT name, kind, rowid, is_def, CASE WHEN rowid % 3 = 0 THEN definition ELSE '' END AS brief FROM vertices
  UNION ALL SELECT n_name, 'class', n_nationkey, true, 'of region ' || n_regionkey FROM nation UNION ALL SELECT r_name, 'class', r_regionkey, true, '' FROM region
  UNION ALL SELECT s_name, 'thread', s_suppkey, true, '' FROM supplier UNION ALL SELECT p_brand, 'lock', p_partkey, p_size > 45, p_type FROM part
  UNION ALL SELECT replace(p_name, ' ', '_'), 'lock', p_partkey, false, '' FROM part WHERE p_size = 1
  UNION ALL SELECT json_extract_string(props, '$.k'), 'key', event_id, false, event_type FROM events UNION ALL SELECT 'REQ-' || item_id, 'requirement', item_id, true, '' FROM benchmark
  UNION ALL SELECT c_mktsegment, 'enumeration', c_custkey, true, '' FROM customer UNION ALL SELECT o_orderpriority, 'enumerator', o_orderkey, true, '' FROM orders UNION ALL SELECT o_orderpriority, 'typedef', o_orderkey, true, '' FROM orders),
asked AS (
  SELECT DISTINCT name FROM named UNION SELECT DISTINCT event_type FROM events UNION SELECT DISTINCT lang FROM documents)"""


@register(query(VERTICES, _NAMED, """ranked AS (SELECT *, list_position(['function', 'macro', 'variable', 'class', 'thread', 'lock', 'key', 'requirement'], kind) AS rank FROM named),
by_kind AS (SELECT name, kind, rank, count(*) AS n_sites, arg_min(rowid, row(NOT is_def, rowid)) AS site, arg_min(brief, row(NOT is_def, rowid)) FILTER (WHERE brief <> '') AS brief FROM ranked GROUP BY ALL)""",
    """SELECT a.name, f.kind, CASE WHEN f.kind IS NOT NULL THEN coalesce((SELECT string_agg(kind, ',' ORDER BY rank) FROM by_kind b WHERE b.name = a.name AND b.rank > f.rank), '') END AS also, f.n_sites, f.site, f.brief,
  CASE WHEN f.kind IS NOT NULL THEN NULL WHEN EXISTS (SELECT 1 FROM by_kind b WHERE b.name = a.name) THEN 'undescribed: ' || (SELECT string_agg(kind, ',' ORDER BY kind) FROM by_kind b WHERE b.name = a.name) ELSE 'absent' END AS miss
FROM asked a LEFT JOIN (SELECT * FROM by_kind WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank) = 1) f ON f.name = a.name"""))  # fmt: skip
def subjects_resolved(s, d):
    """All names there are, and some that are in no relation, each told what it is."""
    v = A.vertices(s, d)
    yes, no = F.lit(True), F.lit(False)

    def part(table, name, kind, rowid, is_def=yes, brief=None):
        columns = [F.col(name) if isinstance(name, str) else name, F.lit(kind), F.col(rowid).cast("long"), is_def, F.lit("") if brief is None else brief]
        return A.table(s, d, table).select(*[c.alias(n) for c, n in zip(columns, ("name", "kind", "rowid", "is_def", "brief"), strict=True)])

    own = v.select("name", "kind", "rowid", "is_def", F.when(F.col("rowid") % 3 == 0, F.col("definition")).otherwise("").alias("brief"))
    named = S.corpus(
        [
            own,
            part("nation", "n_name", "class", "n_nationkey", brief=F.concat(F.lit("of region "), F.col("n_regionkey").cast("string"))),
            part("region", "r_name", "class", "r_regionkey"),
            part("supplier", "s_name", "thread", "s_suppkey"),
            part("part", "p_brand", "lock", "p_partkey", F.col("p_size") > 45, F.col("p_type")),
            v.where("lines = 1").select("name", F.lit("lock").alias("kind"), "rowid", no.alias("is_def"), F.lit("").alias("brief")),
            part("events", F.get_json_object("props", "$.k"), "key", "event_id", no, F.col("event_type")),
            part("benchmark", F.concat(F.lit("REQ-"), F.col("item_id").cast("string")), "requirement", "item_id"),
            part("customer", "c_mktsegment", "enumeration", "c_custkey"),
            part("orders", "o_orderpriority", "enumerator", "o_orderkey"),
            part("orders", "o_orderpriority", "typedef", "o_orderkey"),
        ]
    )
    asked = named.select("name").unionByName(A.table(s, d, "events").select(F.col("event_type").alias("name"))).unionByName(A.table(s, d, "documents").select(F.col("lang").alias("name")))
    return S.resolve(asked, named)


_ANSWERS = """bought AS (SELECT o_custkey AS customer, o_orderkey, o_orderpriority, l_partkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
nodes AS (SELECT customer, list({'name': name, 'depth': depth} ORDER BY depth, name) AS nodes FROM (SELECT DISTINCT customer, 'o' || o_orderkey AS name, 1 AS depth FROM bought
  UNION SELECT customer, 'p' || l_partkey, 2 FROM bought UNION SELECT customer, 's' || l_suppkey, 3 FROM bought) GROUP BY customer),
hops AS (SELECT customer, list({'from': a, 'to': b} ORDER BY a, b) AS hops FROM (SELECT customer, 'o' || o_orderkey AS a, 'p' || l_partkey AS b FROM bought
  UNION SELECT customer, 'p' || l_partkey, 's' || l_suppkey FROM bought) GROUP BY customer),
bodies AS (SELECT customer, list(DISTINCT o_orderkey ORDER BY o_orderkey) AS orders, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS priorities FROM bought GROUP BY customer),
steps AS (
  SELECT customer, nodes, hops, orders, priorities, 0 AS rings, 0 AS halvings, 0 AS n, len(nodes) + len(hops) + len(orders) + len(priorities) AS total FROM nodes JOIN hops USING (customer) JOIN bodies USING (customer)
  UNION ALL
  SELECT customer, CASE WHEN deep THEN inner_nodes ELSE nodes END, CASE WHEN deep THEN list_filter(hops, lambda h: list_contains(names, h['from']) AND list_contains(names, h['to'])) ELSE hops END,
    CASE WHEN NOT deep AND len(orders) >= len(priorities) THEN orders[1:greatest(len(orders) // 2, 1)] ELSE orders END,
    CASE WHEN NOT deep AND len(orders) < len(priorities) THEN priorities[1:greatest(len(priorities) // 2, 1)] ELSE priorities END,
    rings + deep::INT, halvings + (NOT deep)::INT, n + 1, total
  FROM (SELECT *, list_transform(inner_nodes, lambda x: x['name']) AS names FROM (
    SELECT *, list_max(list_transform(nodes, lambda x: x['depth'])) > 1 AS deep, list_filter(nodes, lambda x: x['depth'] < list_max(list_transform(nodes, lambda y: y['depth']))) AS inner_nodes FROM steps))
  WHERE n < 64 AND strlen(to_json({'customer': customer, 'nodes': nodes, 'hops': hops, 'orders': orders, 'priorities': priorities})::VARCHAR) > 600 AND (deep OR greatest(len(orders), len(priorities)) > 1))"""


@register(query(_ANSWERS, """SELECT customer, len(nodes) AS n_nodes, len(hops) AS n_hops, len(orders) AS n_orders, len(priorities) AS n_priorities, rings, halvings, (total - len(nodes) - len(hops) - len(orders) - len(priorities))::INT AS left_out,
  strlen(to_json({'customer': customer, 'nodes': nodes, 'hops': hops, 'orders': orders, 'priorities': priorities})::VARCHAR)::INT AS n_bytes FROM steps QUALIFY n = max(n) OVER (PARTITION BY customer)""", recursive=True))
def answers_in_budget(s, d):
    """A customer's orders, their parts and suppliers as rings of a chain, and two lists, in 600 bytes."""
    lines = A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    bought = A.table(s, d, "orders").select(F.col("o_custkey").alias("customer"), "o_orderkey", "o_orderpriority").join(lines, "o_orderkey")
    one = lambda *c: F.struct(*c)
    # keys are collected as numbers, distinct and one row a line; names are made of them within a customer's row
    own = bought.groupBy("customer").agg(
        F.collect_set(one("o_orderkey")).alias("o"), F.collect_set(one("l_partkey")).alias("p"), F.collect_set(one("l_suppkey")).alias("s"),
        F.collect_set(one("o_orderkey", "l_partkey")).alias("op"), F.collect_set(one("l_partkey", "l_suppkey")).alias("ps"), F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"),
    )
    keys = {"o": "o_orderkey", "p": "l_partkey", "s": "l_suppkey"}
    name = lambda x, k: F.concat(F.lit(k), x[keys[k]].cast("string"))
    ring = lambda k, depth: F.array_sort(F.transform(k, lambda x: F.struct(name(x, k).alias("name"), F.lit(depth).alias("depth"))))
    hops = lambda pair: F.transform(pair, lambda x: F.struct(name(x, pair[0]).alias("from"), name(x, pair[1]).alias("to")))
    rows = own.select("customer", F.concat(ring("o", 1), ring("p", 2), ring("s", 3)).alias("nodes"), F.array_sort(F.concat(hops("op"), hops("ps"))).alias("hops"), F.array_sort(F.transform("o", lambda x: x["o_orderkey"])).alias("orders"), "priorities")
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return B.shrink(rows, "customer", ["orders", "priorities"], 600).select("customer", size("nodes"), size("hops"), size("orders"), size("priorities"), "rings", "halvings", "left_out", "n_bytes")
