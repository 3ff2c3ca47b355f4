"""Queries that answer about subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import answers as W
from lattica.operators import edges as E
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


def _words(expression: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({expression}), '[^a-z0-9#]+'), lambda t: t <> ''))"


_ASKED = f"""asked AS (SELECT DISTINCT lower(p_type) || ' ' || split_part(p_name, ' ', 1) AS query FROM part UNION SELECT lower(c_mktsegment) FROM customer
  UNION SELECT lower(p_brand) || ' ' || lower(p_type) || ' ' || p_name FROM part UNION SELECT lower(n_name) || ' region' FROM nation UNION SELECT p_name || ' ' || lower(c_mktsegment) FROM part JOIN customer ON p_partkey = c_custkey),
wanted AS (SELECT query, unnest({_words('query')}) AS word FROM asked), sizes AS (SELECT query, count(*) AS n_words FROM wanted GROUP BY query),
searched AS (SELECT name, unnest({_words("name || ' ' || definition")}) AS word FROM vertices WHERE kind = 'function'),
unread AS (SELECT name, unnest({_words("name || ' ' || definition")}) AS word FROM vertices WHERE kind <> 'function' UNION SELECT n_name, unnest({_words("n_name || ' region ' || n_regionkey")}) FROM nation),
f AS (SELECT query, count(*) AS n_found FROM (SELECT query, name, count(DISTINCT word) AS n FROM wanted JOIN searched USING (word) GROUP BY ALL) JOIN sizes USING (query) WHERE n = n_words GROUP BY query),
u AS (SELECT query, count(*) AS n_unread FROM (SELECT query, name, count(DISTINCT word) AS n FROM wanted JOIN unread USING (word) GROUP BY ALL) JOIN sizes USING (query) WHERE n = n_words GROUP BY query),
s AS (SELECT query, count(*) AS n_seen FROM wanted WHERE word IN (SELECT word FROM searched) GROUP BY query),
b AS (SELECT query, n_words, coalesce(n_found, 0) AS n_found, coalesce(n_unread, 0) AS n_unread, n_words - coalesce(n_seen, 0) AS n_missing FROM sizes LEFT JOIN f USING (query) LEFT JOIN u USING (query) LEFT JOIN s USING (query))"""


@register(query(VERTICES, _ASKED, "SELECT query, n_found, CASE WHEN n_found > 0 THEN 'answered' WHEN n_unread > 0 THEN 'unread_corpus' WHEN n_words = 1 THEN 'definitive' WHEN n_missing > 0 THEN 'missing_word' ELSE 'conjunction' END AS grade, n_missing, n_unread FROM b"))
def emptiness_grades(s, d):
    part, customer, nation = (A.table(s, d, t) for t in ("part", "customer", "nation"))
    low = lambda c: F.lower(c)
    asked = (
        part.select(F.concat_ws(" ", low("p_type"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("query"))
        .union(customer.select(low("c_mktsegment")))
        .union(part.select(F.concat_ws(" ", low("p_brand"), low("p_type"), "p_name")))
        .union(nation.select(F.concat(low("n_name"), F.lit(" region"))))
        .union(part.join(customer, F.col("p_partkey") == F.col("c_custkey")).select(F.concat_ws(" ", "p_name", low("c_mktsegment"))))
    )
    v = A.vertices(s, d).select("kind", "name", F.col("definition").alias("text"))
    other = nation.select(F.col("n_name").alias("name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("text"))
    return W.emptiness(asked.distinct(), v.where("kind = 'function'").drop("kind"), v.where("kind <> 'function'").drop("kind").unionByName(other))


@register(query(VERTICES, "first AS (SELECT name, min(rowid) AS rowid, arg_min(file, row(rowid, file)) AS file, count(DISTINCT file) AS n_places FROM vertices GROUP BY name)",
    "few AS (SELECT name, file, row_number() OVER (PARTITION BY name ORDER BY file) AS k FROM (SELECT DISTINCT v.name, v.file FROM vertices v JOIN first f ON f.name = v.name AND f.file <> v.file))",
    "listed AS (SELECT name, string_agg(file, ',' ORDER BY file) AS also_in FROM few WHERE k <= 5 GROUP BY name)", "SELECT name, rowid, file, n_places, coalesce(also_in, '') AS also_in FROM first LEFT JOIN listed USING (name)"))
def names_also_in(s, d):
    return W.also_in(A.vertices(s, d).select("name", "file", "rowid"), "name", "file", "rowid")


@register(r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, 1 + doc_id % 3 AS lo, 1 + doc_id % 3 + doc_id % 7 AS hi FROM documents)
SELECT doc_id, array_to_string(l[lo:least(hi, lo + 3)], chr(10)) AS body, greatest(len(l[lo:hi]) - 4, 0)::INT AS left_out FROM d""")
def source_slices(s, d):
    lo = 1 + F.col("doc_id") % 3
    body, left = W.source_slice(F.coalesce("text", F.lit("")), lo.cast("int"), (lo + F.col("doc_id") % 7).cast("int"), 4)
    return A.table(s, d, "documents").select("doc_id", body.alias("body"), left.alias("left_out"))


_CLASSES = """classes AS (SELECT n_name AS class, r_name AS base FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, NULL FROM region),
members AS (SELECT n_name AS class, 's' || s_suppkey AS member FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT n_name, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
own AS (SELECT class, count(DISTINCT member) AS n FROM members GROUP BY class)"""


@register(query(_CLASSES, "SELECT c.class, c.base, coalesce(o.n, 0) AS n_own, coalesce(b.n, 0) AS n_inherited, (SELECT count(*) FROM classes k WHERE k.base = c.class) AS n_derived FROM classes c LEFT JOIN own o ON o.class = c.class LEFT JOIN own b ON b.class = c.base"))
def class_hierarchy(s, d):
    n = A.table(s, d, "nation").join(A.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("class"), F.col("r_name").alias("base"))
    classes = n.select("class", "base").unionByName(A.table(s, d, "region").select(F.col("r_name").alias("class"), F.lit(None).cast("string").alias("base")))
    own = lambda table, key, nation, mark: A.table(s, d, table).join(n, F.col(nation) == F.col("n_nationkey")).select("class", F.concat(F.lit(mark), F.col(key).cast("string")).alias("member"))
    members = own("supplier", "s_suppkey", "s_nationkey", "s").unionByName(own("customer", "c_custkey", "c_nationkey", "c")).unionByName(n.select(F.col("base").alias("class"), F.col("class").alias("member")))
    return W.hierarchy(classes, members)


@register("SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, unnest(json_keys(props))) AS value FROM events WHERE props IS NOT NULL")
def declared_rows(s, d):
    """Declared manifests are JSON objects; each entry is a row."""
    e = A.table(s, d, "events").where("props is not null")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@register("SELECT p_partkey, CASE WHEN starts_with(p_name, 'small ') THEN 'small:' || substr(p_name, 7) WHEN p_name LIKE '% bolt' THEN 'bolt:' || p_name WHEN starts_with(p_name, 'red ') THEN 'red:' || substr(p_name, 5) WHEN p_name LIKE '_l% g%' THEN 'other:' || p_name END AS access FROM part")
def accessor_matches(s, d):
    patterns = [("small", "small "), ("bolt", "* bolt"), ("red", "red "), ("other", "?l* g*")]
    return A.table(s, d, "part").select("p_partkey", W.first_pattern(F.col("p_name"), patterns).alias("access"))


@register(r"SELECT topic, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(lower(event_type || '/' || coalesce(json_extract_string(props, '$.k'), '')), '[^a-z0-9]+', '.', 'g'), '^\.+|\.+$', '', 'g') AS topic FROM events) GROUP BY topic")
def topic_names(s, d):
    raw = F.concat_ws("/", "event_type", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")))
    return A.table(s, d, "events").groupBy(W.topic(raw).alias("topic")).agg(F.count("*").alias("n"))


@register("""SELECT source, count(*) AS n, sum((l.doc_id IS NOT NULL)::INT)::BIGINT AS n_covered, round(avg((l.doc_id IS NOT NULL)::INT), 4) AS coverage,
coalesce(sum(CASE WHEN l.doc_id IS NOT NULL THEN strlen(text) ELSE 0 END), 0)::BIGINT AS bytes_covered FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY source""")
def sidecar_coverage(s, d):
    return W.sidecar_coverage(A.table(s, d, "documents"), A.table(s, d, "labels"), "doc_id", "source")


@register("SELECT conv_id, turn FROM conversations WHERE contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' of the ')")
def prose_phrase(s, d):
    return A.table(s, d, "conversations").where(W.phrase(F.col("text"), '"of" (the')).select("conv_id", "turn")


@register(query(VERTICES, EDGES, """i AS (SELECT dst, count(DISTINCT src) AS n_in, sum((grade = 'fuzzy')::INT)::BIGINT AS n_fuzzy FROM edges GROUP BY dst), o AS (SELECT src, count(DISTINCT dst) AS n_out FROM edges GROUP BY src)""",
    "SELECT rowid, kind, CASE kind WHEN 'function' THEN 'callers ' || coalesce(n_in, 0) || ', callees ' || coalesce(n_out, 0) WHEN 'variable' THEN 'accessors ' || coalesce(n_in, 0) || ', fuzzy ' || coalesce(n_fuzzy, 0) ELSE 'expansions ' || coalesce(n_in, 0) || ' in ' || file END AS facts FROM vertices LEFT JOIN i ON dst = rowid LEFT JOIN o ON src = rowid"))
def subject_facts(s, d):
    """What is told of a subject depends on its kind; both degrees are counted once for all of them."""
    e = E.first_writer(A.raw_edges(s, d).drop("weight"), ["src", "dst", "source"], "seq")
    into = e.groupBy(F.col("dst").alias("rowid")).agg(F.countDistinct("src").alias("n_in"), F.sum((F.col("grade") == "fuzzy").cast("int")).alias("n_fuzzy"))
    out = e.groupBy(F.col("src").alias("rowid")).agg(F.countDistinct("dst").alias("n_out"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    facts = (
        F.when(F.col("kind") == "function", F.concat(F.lit("callers "), n("n_in"), F.lit(", callees "), n("n_out")))
        .when(F.col("kind") == "variable", F.concat(F.lit("accessors "), n("n_in"), F.lit(", fuzzy "), n("n_fuzzy")))
        .otherwise(F.concat(F.lit("expansions "), n("n_in"), F.lit(" in "), F.col("file")))
    )
    return A.vertices(s, d).join(into, "rowid", "left").join(out, "rowid", "left").select("rowid", "kind", facts.alias("facts"))
