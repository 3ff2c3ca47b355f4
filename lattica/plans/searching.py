"""Queries over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import text as X
from lattica.plans.sql import VERTICES, query
from lattica.sources import adapters as A

QUERIES, ORACLES = {}, {}


def register(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_CORPUS = """corpus AS (SELECT CASE kind WHEN 'function' THEN 0 WHEN 'variable' THEN 1 ELSE 2 END AS tier, name, definition AS brief FROM vertices
UNION ALL SELECT 3, s_name, 'supplier of nation ' || s_nationkey FROM supplier
UNION ALL SELECT 4, n_name, 'class of region ' || n_regionkey FROM nation UNION ALL SELECT 5, c_name, 'small account of brand#1' || c_nationkey || ' in ' || c_mktsegment FROM customer)"""
_TEXT = "small brand#1"


def _corpus(s, d):
    tier = F.when(F.col("kind") == "function", 0).when(F.col("kind") == "variable", 1).otherwise(2)
    own = A.vertices(s, d).select(tier.alias("tier"), "name", F.col("definition").alias("brief"))
    other = A.table(s, d, "supplier").select(F.lit(3).alias("tier"), F.col("s_name").alias("name"), F.concat(F.lit("supplier of nation "), F.col("s_nationkey").cast("string")).alias("brief"))
    classes = A.table(s, d, "nation").select(F.lit(4).alias("tier"), F.col("n_name").alias("name"), F.concat(F.lit("class of region "), F.col("n_regionkey").cast("string")).alias("brief"))
    account = F.concat(F.lit("small account of brand#1"), F.col("c_nationkey").cast("string"), F.lit(" in "), F.col("c_mktsegment"))
    accounts = A.table(s, d, "customer").select(F.lit(5).alias("tier"), F.col("c_name").alias("name"), account.alias("brief"))
    return own.unionByName(other).unionByName(classes).unionByName(accounts)


_EITHER = " AND ".join(f"(contains(lower(name), '{t}') OR contains(lower(brief), '{t}'))" for t in _TEXT.split())
_SCORE = " + ".join(f"CASE WHEN contains(lower(name), '{t}') THEN 50 ELSE 0 END + CASE WHEN contains(lower(brief), '{t}') THEN 5 ELSE 0 END" for t in _TEXT.split()) + f" + CASE WHEN lower(name) = '{_TEXT}' THEN 1000 ELSE 0 END + CASE WHEN contains(lower(name), '{_TEXT}') THEN 200 ELSE 0 END"


@register(query(VERTICES, _CORPUS, f"SELECT tier, name, max({_SCORE}) AS score FROM corpus WHERE {_EITHER} GROUP BY ALL ORDER BY score DESC, tier, name LIMIT 25"))
def search_ranked(s, d):
    return X.search(_corpus(s, d), _TEXT)


@register(query(VERTICES, _CORPUS, "SELECT token, (SELECT count(DISTINCT name) FROM corpus WHERE contains(lower(name), token) OR contains(lower(brief), token)) AS n_names FROM (VALUES ('small'), ('brand#1')) t(token)"))
def search_token_hits(s, d):
    return X.token_hits(_corpus(s, d), _TEXT)


@register(query(VERTICES, "SELECT kind, count(DISTINCT name) AS n FROM vertices WHERE kind NOT IN ('function') GROUP BY kind"))
def search_unsearched(s, d):
    return A.vertices(s, d).where("kind not in ('function')").groupBy("kind").agg(F.countDistinct("name").alias("n"))


@register("SELECT p_brand, arg_min(p_name, row(p_size > 40, length(p_name), p_name)) AS best FROM part GROUP BY p_brand")
def class_rank(s, d):
    return A.table(s, d, "part").groupBy("p_brand").agg(F.min_by("p_name", F.struct((F.col("p_size") > 40).alias("synthetic"), F.length("p_name").alias("n"), "p_name")).alias("best"))


def _bm25_sql(docs: str, words: list[str]) -> str:
    lists = ", ".join(f"'{w}'" for w in words)
    return f"""docs AS ({docs}),
words AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda t: t <> '') AS w FROM docs),
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
hits AS (SELECT id, len(w) AS len, t.token, len(list_filter(w, lambda x: x = t.token)) AS tf FROM words, (SELECT unnest([{lists}]) AS token) t),
df AS (SELECT token, sum((tf > 0)::INT) AS df FROM hits GROUP BY token),
scored AS (
  SELECT id, sum((tf > 0)::INT)::INT AS n_hit, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
  FROM hits JOIN df USING (token), stats GROUP BY id HAVING sum((tf > 0)::INT) > 0)"""


_DOCS = "SELECT doc_id AS id, text FROM documents"
_TURNS = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"


@register(query(_bm25_sql(_DOCS, ["and", "the", "with"]), "SELECT id AS doc_id, n_hit, score FROM scored"))
def prose_bm25(s, d):
    return X.bm25(A.table(s, d, "documents"), "doc_id", "text", ["the", "and", "with"])


@register(query(_bm25_sql(_TURNS, ["nosuchword", "the"]), "SELECT id, n_hit, score, (SELECT max(n_hit) FROM scored) < 2 AS widened FROM scored WHERE (SELECT max(n_hit) FROM scored) < 2 OR n_hit = 2"))
def prose_widened(s, d):
    turns = A.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return X.widened(X.bm25(turns, "id", "text", ["the", "nosuchword"]), 2)


@register(r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w FROM conversations),
p AS (SELECT *, list_position(list_transform(w, lambda x: lower(x)), 'the') AS at FROM w)
SELECT conv_id, turn, CASE WHEN p.at > 0 THEN array_to_string(list_transform(w[greatest(p.at - 8, 1):greatest(p.at - 8, 1) + 16], lambda x: CASE WHEN lower(x) = 'the' THEN '[' || x || ']' ELSE x END), ' ') END AS snippet FROM p""")
def prose_snippet(s, d):
    return A.table(s, d, "conversations").select("conv_id", "turn", X.snippet(F.col("text"), "the").alias("snippet"))


@register(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def strip_markup(s, d):
    return A.table(s, d, "pages").select("page_id", X.strip_markup(F.col("html")).alias("text"))


@register(r"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL")
def extract_tags(s, d):
    tags = F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))
    return A.table(s, d, "pages").select("page_id", tags.alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def _lines(df, id_col):
    """(id, line): the distinct lines of texts, trimmed, that are not empty."""
    line = F.explode(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))
    return df.select(id_col, line.alias("line")).where("line <> ''").distinct()


_REQ = """lines AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
items AS (SELECT DISTINCT item_id, trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark),
req AS (SELECT DISTINCT item_id, doc_id FROM items JOIN lines USING (line) WHERE line <> '')"""


def _req(s, d):
    return _lines(A.table(s, d, "benchmark"), "item_id").join(_lines(A.table(s, d, "documents"), "doc_id"), "line").select("item_id", "doc_id").distinct()


@register(query(_REQ, "SELECT item_id, doc_id FROM req"))
def req_edges(s, d):
    return _req(s, d)


@register(query(_REQ, "SELECT b.item_id, count(DISTINCT r.doc_id) AS n_docs, count(DISTINCT l.doc_id) AS n_labelled FROM benchmark b LEFT JOIN req r USING (item_id) LEFT JOIN labels l ON l.doc_id = r.doc_id GROUP BY b.item_id"))
def req_trace(s, d):
    labelled = A.table(s, d, "labels").select("doc_id").distinct().withColumn("known", F.col("doc_id"))
    both = A.table(s, d, "benchmark").select("item_id").join(_req(s, d), "item_id", "left").join(labelled, "doc_id", "left")
    return both.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("known").alias("n_labelled"))


@register(query(_REQ, "SELECT r.item_id, r.doc_id, l.quality FROM req r JOIN labels l ON l.doc_id = r.doc_id WHERE r.item_id IN (SELECT item_id FROM req GROUP BY item_id HAVING count(*) > 1)"))
def req_tests(s, d):
    req = _req(s, d)
    many = req.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").select("item_id")
    return req.join(many, "item_id", "left_semi").join(A.table(s, d, "labels").select("doc_id", "quality"), "doc_id").select("item_id", "doc_id", "quality")
