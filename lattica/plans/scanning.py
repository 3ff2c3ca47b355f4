"""Queries of scans, declarations, what-if runs and sanity counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import intervals as I
from lattica.operators import scans as C
from lattica.plans.sql import PATHS, VERTICES, query
from lattica.sources import adapters as A

QUERIES, ORACLES = {}, {}


def register(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


@register("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS brief, length(html) AS n_chars FROM pages WHERE html IS NOT NULL")
def file_docs(s, d):
    """The description that stands at the head of each file."""
    return A.table(s, d, "pages").where("html is not null").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("brief"), F.length("html").alias("n_chars"))


@register("""SELECT page_id, regexp_extract(tag, '^[a-z]+ ([a-z]+)="([^"]*)"', 1) AS name, regexp_extract(tag, '^[a-z]+ ([a-z]+)="([^"]*)"', 2) AS value FROM (SELECT page_id, unnest(string_split(html, '<')) AS tag FROM pages) WHERE name <> ''""")
def header_values(s, d):
    """The first assignment within each tag."""
    pattern = '^[a-z]+ ([a-z]+)="([^"]*)"'
    tags = A.table(s, d, "pages").select("page_id", F.explode(F.split("html", "<")).alias("tag"))
    return tags.select("page_id", F.regexp_extract("tag", pattern, 1).alias("name"), F.regexp_extract("tag", pattern, 2).alias("value")).where("name <> ''")


_SHAPE = "(small|red)_?(bolt|ring)|(bolt|ring)_?(small|red)"


@register(query(VERTICES, f"SELECT rowid, name FROM vertices WHERE regexp_matches(name, '{_SHAPE}') AND NOT starts_with(name, 'test_')"))
def spawn_shaped(s, d):
    """Names in which a subject and a verb are neighbours, in either order, but those of tests."""
    return A.vertices(s, d).where(F.rlike("name", F.lit(_SHAPE)) & ~F.startswith("name", F.lit("test_"))).select("rowid", "name")


@register("SELECT l_suppkey AS file, sum((l_linenumber <= 3 AND h >= 3 AND h > 0)::INT)::BIGINT AS n_covering, sum((h = 0)::INT)::BIGINT AS n_unplaceable FROM (SELECT *, CASE WHEN l_quantity >= 48 THEN 0 ELSE l_linenumber + l_suppkey % 4 END AS h FROM lineitem) GROUP BY l_suppkey")
def gates_covering(s, d):
    line = A.table(s, d, "lineitem")
    end = F.when(F.col("l_quantity") >= 48, F.lit(0)).otherwise(F.col("l_linenumber") + F.col("l_suppkey") % 4)
    return I.covering(line.select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("lo"), end.alias("hi")), 3)


@register(query(VERTICES, "SELECT rowid, CASE WHEN NOT is_def THEN 'recovered in ' || file END AS provenance FROM vertices"))
def symbol_provenance(s, d):
    """Null unless a row was recovered."""
    return A.vertices(s, d).select("rowid", F.when(~F.col("is_def"), F.concat(F.lit("recovered in "), F.col("file"))).alias("provenance"))


@register("""WITH b AS (SELECT l_orderkey AS name, l_suppkey AS target, CASE WHEN l_returnflag = 'R' THEN FALSE WHEN l_linestatus = 'O' THEN TRUE END AS branch FROM lineitem),
p AS (SELECT name, target, bool_or(coalesce(branch, TRUE)) AS live FROM b GROUP BY ALL), n AS (SELECT name, bool_or(live) AS any_live FROM p GROUP BY name)
SELECT name, target, CASE WHEN live THEN 'resolved' ELSE 'fuzzy' END AS grade FROM p JOIN n USING (name) WHERE live OR NOT any_live""")
def live_bindings(s, d):
    branch = F.when(F.col("l_returnflag") == "R", F.lit(False)).when(F.col("l_linestatus") == "O", F.lit(True))
    return C.live_bindings(A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_suppkey").alias("target"), branch.alias("branch")))


@register(query(VERTICES, "prose AS (SELECT file, name, min(definition) AS body, 'prose' AS origin FROM vertices WHERE is_def GROUP BY file, name)",
    "members AS (SELECT file, name, min(definition) AS body, 'member' AS origin FROM vertices WHERE NOT is_def GROUP BY file, name)",
    "SELECT * FROM prose UNION ALL SELECT * FROM members m WHERE NOT EXISTS (SELECT 1 FROM prose p WHERE p.file = m.file AND p.name = m.name)"))
def prose_and_members(s, d):
    """Both corpora, a member's text only where its file has no prose under that heading."""
    one = lambda part, origin: A.vertices(s, d).where(part).groupBy("file", "name").agg(F.min("definition").alias("body")).withColumn("origin", F.lit(origin))
    return C.union_by_key(one("is_def", "prose"), one("not is_def", "member"), ["file", "name"])


@register(query(VERTICES, "k AS (SELECT file, name, definition, row_number() OVER (PARTITION BY file ORDER BY length(definition) DESC, name, definition) AS place FROM (SELECT DISTINCT file, name, definition FROM vertices))", "SELECT file, name, place::INT AS place FROM k WHERE place <= 5"))
def member_docs_longest(s, d):
    return C.longest(A.vertices(s, d).select("file", "name", "definition").distinct(), "file", "definition", "name", 5).select("file", "name", "place")


@register("""WITH c AS (SELECT doc_id, text, list_max(list_filter(range(0, 42), lambda i: strlen(left(text, i::INT)) <= 41)) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, left(text, n::INT) || CASE WHEN strlen(left(text, n::INT)) < 41 AND strlen(text) > strlen(left(text, n::INT)) THEN chr(65533) ELSE '' END AS head FROM c""")
def repaired_heads(s, d):
    return A.table(s, d, "documents").where("text is not null").select("doc_id", C.repaired(F.col("text"), 41).alias("head"))


@register(query(VERTICES, "SELECT kind, sum((a AND b)::INT)::BIGINT AS n_kept, sum((NOT a AND b)::INT)::BIGINT AS n_added, sum((a AND NOT b)::INT)::BIGINT AS n_removed FROM (SELECT kind, starts_with(name, 'small_') AS a, name LIKE '%bolt' AS b FROM vertices) GROUP BY kind"))
def dry_run_delta(s, d):
    """What a candidate pattern would add to and take from the seeds."""
    return C.what_if(A.vertices(s, d), F.startswith("name", F.lit("small_")), F.endswith("name", F.lit("bolt")), "kind")


_WATCHED = ["token", "secret", "the and", "copyright"]


@register(f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '({'|'.join(_WATCHED)})', 1)) AS word FROM documents) GROUP BY ALL")
def call_census(s, d):
    return C.census(A.table(s, d, "documents"), "doc_id", "text", _WATCHED)


@register(query(PATHS, "dirs AS (SELECT path, count(*) AS n, sum(external::INT)::BIGINT AS n_external FROM paths GROUP BY path)", "SELECT path, n_evidence FROM dirs JOIN (SELECT path, count(*) AS n_evidence FROM paths WHERE unresolved GROUP BY path) USING (path) WHERE n_external * 8 >= n"))
def cross_conflicts(s, d):
    """Directories declared out of scope that hold evidence all the same."""
    out, seen = F.sum(F.col("external").cast("int")), F.sum(F.col("unresolved").cast("int"))
    return A.paths(s, d).groupBy("path").agg(F.count("*").alias("n"), out.alias("n_external"), seen.alias("n_evidence")).where("n_external * 8 >= n and n_evidence > 0").select("path", "n_evidence")


@register(query(VERTICES, "SELECT file, count(*) AS n, sum((kind = 'function' AND is_def)::INT)::BIGINT AS n_bodies, bool_and(NOT (kind = 'function' AND is_def AND lines > 38)) AS suspicious FROM vertices GROUP BY file"))
def body_sanity(s, d):
    """Files whose functions have no long body."""
    body = (F.col("kind") == "function") & F.col("is_def")
    return A.vertices(s, d).groupBy("file").agg(F.count("*").alias("n"), F.sum(body.cast("int")).alias("n_bodies"), F.bool_and(~(body & (F.col("lines") > 38))).alias("suspicious"))


@register("SELECT event_id, array_to_string(list_sort(list_transform(list_filter(json_keys(props), lambda k: json_extract_string(props, '$.' || k) IS NOT NULL), lambda k: k || ': ' || json_extract_string(props, '$.' || k))), chr(10)) AS declaration FROM events WHERE props IS NOT NULL")
def stated_declarations(s, d):
    """Only what was stated, as text."""
    return A.table(s, d, "events").where("props is not null").select("event_id", C.stated(F.from_json("props", "map<string,string>")).alias("declaration"))


@register("SELECT key, key IN ('k') AS known, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL UNION ALL SELECT event_type FROM events) GROUP BY ALL")
def option_audit(s, d):
    """Options that the schema knows, and those that it refuses."""
    e = A.table(s, d, "events")
    keys = e.where("props is not null").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key")).unionByName(e.select(F.col("event_type").alias("key")))
    return keys.groupBy("key", F.col("key").isin("k").alias("known")).agg(F.count("*").alias("n"))


@register("SELECT CASE WHEN lower(trim(o_orderpriority)) IN ('1-urgent', '2-high') THEN 'up' WHEN lower(trim(o_orderpriority)) IN ('5-low') THEN 'down' END AS way, o_orderstatus, count(*) AS n FROM orders GROUP BY way, o_orderstatus")
def direction_words(s, d):
    way = C.direction(F.col("o_orderpriority"), {"up": ["1-urgent", "2-high"], "down": ["5-low"]})
    return A.table(s, d, "orders").groupBy(way.alias("way"), "o_orderstatus").agg(F.count("*").alias("n"))


@register(query(VERTICES, "u AS (SELECT DISTINCT file, name FROM vertices WHERE kind = 'macro')", "k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY name) AS k, count(*) OVER (PARTITION BY file) AS n_names FROM u)", "SELECT file, n_names, string_agg(name, ',' ORDER BY name) AS names FROM k WHERE k <= 5 GROUP BY file, n_names"))
def build_diagnostics(s, d):
    return C.capped_names(A.vertices(s, d).where("kind = 'macro'"), "file", "name", 5)


@register("SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value < 50) AS n_valid, sum(round(value * 100)::BIGINT) FILTER (value < 50)::BIGINT / 100.0::DOUBLE / count(*) FILTER (value < 50) AS mean, coalesce(max(value) FILTER (value >= 0 AND value < 50), -1.0) AS worst FROM events GROUP BY user_id, event_type")
def metric_means(s, d):
    """Means over valid rows alone, in whole cents so that no order of rows matters, and the worst of them, -1 where there is none."""
    valid = F.when(F.col("value") < 50, F.col("value"))
    worst = F.coalesce(F.max(F.when(valid >= 0, valid)), F.lit(-1.0))
    return A.table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count(valid).alias("n_valid"), (F.sum(F.round(valid * 100).cast("long")) / F.lit(100.0) / F.count(valid)).alias("mean"), worst.alias("worst"))


@register(query(VERTICES, "impl AS (SELECT name, count(*) AS n_impls, min(rowid) AS first_impl FROM vertices WHERE is_def GROUP BY name)", "SELECT rowid, name, replace(definition, '::', '.') AS path, coalesce(n_impls, 0) AS n_impls, first_impl FROM vertices LEFT JOIN impl USING (name) WHERE NOT is_def"))
def impl_members(s, d):
    """Declared members with what implements them: counted, as the pairs of a name grow with its square."""
    v = A.vertices(s, d)
    impl = v.where("is_def").groupBy("name").agg(F.count("*").alias("n_impls"), F.min("rowid").alias("first_impl"))
    return v.where("not is_def").join(impl, "name", "left").select("rowid", "name", F.replace("definition", F.lit("::"), F.lit(".")).alias("path"), F.coalesce("n_impls", F.lit(0)).alias("n_impls"), "first_impl")
