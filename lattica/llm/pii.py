"""Personal data: high-recall generators propose overlapping spans, boosted trees decide which to add to the fixed ones.

The fixed patterns (email, ip, card, phone) always count. Generators propose spans that merely look similar; trees fitted
on a bounded sample score each by its format and context, and a threshold for each generator, calibrated on all documents
but those of the fit, selects. A proposal is labelled by whether a fixed span covers any of it (a number that begins with
00 also by whether it would be a phone with a plus instead), and no feature tells
the parts that a fixed pattern insists on (a leading plus, an at sign). Everything is DataFrame operations; the fitted
trees become one SQL expression, so the whole corpus is scored where it is read, without a shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.spans import count_of, joined, luhn, match_spans, outside, replaced, sampled, touched

# Kinds in the order of their rank, and their patterns. Possessive forms and the conditions on what stands
# before give the same matches as the plain forms without trying every start within a long run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")

#: Generators: kind of the proposed span, and its pattern.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{2,62}){1,4}"),
    ("phone", r"(?<![0-9.])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9.])"),
    ("phone", r"(?<![0-9])00[0-9][\x20().0-9-]{6,18}[0-9](?![0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|\(dot\)|\[\.\])\x20?[0-9]{1,3}){3}(?![0-9])"),
)
#: The generator of numbers that begin with 00.
INTERNATIONAL = 2
#: Documents that the trees are fitted on at most.
SAMPLE_DOCS = 20_000
TREES, DEPTH, STEP = 12, 3, 0.3
#: Share of labelled ones among what a threshold selects from the documents held back. The labels miss what the fixed
#: patterns miss, so the true share is higher.
LEAST_PRECISION = 0.9
#: Labelled proposals that calibrate a threshold at least; below that a generator adds nothing.
LEAST_CALIBRATED = 20

FEATURES = ("generator", "chars", "digits", "letters", "blanks", "points", "hyphens", "groups", "longest", "luhn", "parens", "zeros", "first_group", "last_group", "octets", "cue", "edge_before", "edge_after")
_CUES = r"(?i)(phone|tel|call|mobile|fax|mail|contact|card|visa|pay|account|addr|host|\bip)[^A-Za-z]{0,6}$"


def base_spans(text: Column) -> Column:
    """Spans of kinds email, ip, card and phone, as the fixed patterns find them."""

    def octets(s: Column) -> Column:
        parts = F.transform(F.split(s["value"], r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
        return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.coalesce(F.try_to_number(F.lpad(x, 3, "0"), F.lit("999")), F.lit(0)) <= 255))

    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    email = F.when(F.contains(text, F.lit("@")), match_spans(text, EMAIL, "email", 0)).otherwise(F.array())
    ip = F.filter(match_spans(text, IP, "ip", 1), octets)
    card = F.filter(match_spans(text, CARD, "card", 2), lambda s: luhn(digits(s)))
    phone = F.when(F.contains(text, F.lit("+")), F.filter(match_spans(text, PHONE, "phone", 3), lambda s: F.length(digits(s)).between(8, 15))).otherwise(F.array())
    return F.concat(email, ip, card, phone)


def proposed_spans(text: Column) -> Column:
    """Spans of all generators with their context; ``rank`` holds the generator's number."""
    each = []
    for i, (kind, pattern) in enumerate(GENERATORS):
        gate = F.rlike(text, F.lit(r"@|[({\[]at[)}\]]")) if kind == "email" else F.rlike(text, F.lit("[0-9]"))
        each.append(F.when(gate, match_spans(text, pattern, kind, i, context=True)).otherwise(F.array()))
    return F.concat(*each)


def features(s: Column) -> list[Column]:
    """Numbers that describe a proposed span, in the order of ``FEATURES``."""
    value = s["value"]
    left = lambda keep: F.length(F.regexp_replace(value, f"[^{keep}]", ""))
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    yes = lambda c: c.cast("int")
    small = F.forall(groups, lambda g: (F.length(g) <= 3) & (F.coalesce(F.try_to_number(F.left(g, F.lit(3)), F.lit("999")), F.lit(0)) <= 255))
    found = [
        s["rank"], F.length(value), left("0-9"), left("A-Za-z"), left(r"\x20"), left("."), left(r"\-"), F.size(groups), F.coalesce(F.array_max(sizes), F.lit(0)),
        yes(luhn(F.regexp_replace(value, "[^0-9]", ""))), left("()"), left("0"), F.coalesce(F.get(sizes, 0), F.lit(0)), F.coalesce(F.get(sizes, F.size(sizes) - 1), F.lit(0)),
        yes(small), yes(F.rlike(s["before"], F.lit(_CUES))), yes(F.rlike(s["before"], F.lit("[0-9A-Za-z]$"))), yes(F.rlike(s["after"], F.lit("^[0-9A-Za-z]"))),
    ]
    return [F.coalesce(c.cast("double"), F.lit(0.0)) for c in found]


def described(s: Column) -> Column:
    """A proposed span with its features as array ``f``, so that trees read numbers instead of text."""
    return F.struct(*[s[c].alias(c) for c in ("kind", "rank", "start", "end", "value")], F.array(*features(s)).alias("f"))


#: A leaf's value, or (feature, cut, node up to the cut, node above it).
Node = float | tuple


def _node(fitted) -> Node:
    """A node of a fitted tree, as Spark ML holds it."""
    if not fitted.numDescendants():
        return float(fitted.prediction())
    split = fitted.split()
    return split.featureIndex(), float(split.threshold()), _node(fitted.leftChild()), _node(fitted.rightChild())


class Trees:
    """Fitted trees and each generator's threshold (None: it adds nothing)."""

    def __init__(self, trees: list[Node], weights: list[float], thresholds: list[float | None] | None = None):
        self.trees, self.weights = trees, weights
        self.thresholds = thresholds or [None] * len(GENERATORS)

    def _value(self, node: Node, f: Column) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        feature, cut, low, high = node
        return F.when(F.get(f, F.lit(feature)) <= cut, self._value(low, f)).otherwise(self._value(high, f))

    def score(self, f: Column) -> Column:
        """Chance, 0 to 1, that a span with features ``f`` is personal data."""
        margin = sum((self._value(t, f) * w for t, w in zip(self.trees, self.weights, strict=True)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def selects(self, x: Column) -> Column:
        least = F.get(F.array(*[F.lit(t).cast("double") for t in self.thresholds]), x["rank"])
        return F.coalesce(self.score(x["f"]) >= least, F.lit(False))


def _label(s: Column, hit: Column) -> Column:
    """Whether a proposal is true: a fixed span covers some of it (``hit``), or would if its leading 00 were a plus."""
    as_plus = F.concat(F.lit("+"), F.substring(s["value"], 3, 1_000_000))
    digits = F.length(F.regexp_replace(as_plus, "[^0-9]", ""))
    return hit | ((s["rank"] == INTERNATIONAL) & as_plus.rlike(f"^{PHONE}$") & digits.between(8, 15))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE_DOCS) -> Trees | None:
    """Trees from the proposals in ``bound`` documents; None where the sample lacks either label.

    A quarter of the sample, by a hash of the text, is held back. There and in all documents outside the sample a threshold
    is, for each generator, the smallest score from which on the share of true ones is at least ``LEAST_PRECISION``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(id_col, text_col)
    fitted = F.coalesce(sampled(docs, bound) & (F.pmod(F.xxhash64(text), F.lit(4)) != 0), F.lit(False))

    def labelled(some: DataFrame) -> DataFrame:
        found = some.select(text.alias("text")).select(base_spans(F.col("text")).alias("base"), proposed_spans(F.col("text")).alias("proposed")).where(F.size("proposed") > 0)
        each = found.select(F.explode(F.transform(touched(F.col("proposed"), F.col("base")), lambda x: F.struct(_label(x["s"], x["hit"]).cast("int").alias("label"), described(x["s"]).alias("s")))).alias("x"))
        return each.select("x.label", F.col("x.s.rank").alias("rank"), F.col("x.s.f").alias("f"))

    rows = labelled(docs.where(fitted)).persist()
    try:
        if {r.label for r in rows.select("label").distinct().collect()} != {0, 1}:
            return None
        flat = rows.select("label", *[F.get("f", F.lit(i)).alias(name) for i, name in enumerate(FEATURES)])
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(flat))
        trees = Trees([_node(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights))
        steps = labelled(docs.where(~fitted)).groupBy("rank", F.floor(trees.score(F.col("f")) * 100).alias("step")).agg(F.sum("label").alias("true"), F.count("*").alias("n")).collect()  # at most 101 a generator
    finally:
        rows.unpersist()
    for i in range(len(GENERATORS)):
        true = n = 0
        for r in sorted((r for r in steps if r["rank"] == i), key=lambda r: -r.step):
            true, n = true + r.true, n + r.n
            if n >= LEAST_CALIBRATED and true >= LEAST_PRECISION * n:
                trees.thresholds[i] = r.step / 100
    return trees


def find_personal(docs: DataFrame, trees: Trees | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, base, added): spans as array<struct<kind, rank, start, end, value>>.

    ``added`` holds selected proposals that share no character with a fixed span; they may overlap each other. One row
    for each input row; null and empty texts have no spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    if trees is None or all(t is None for t in trees.thresholds):
        return found.withColumn("added", F.slice("base", 1, 0))
    fresh = outside(proposed_spans(F.col("text")), F.col("base"))
    chosen = F.filter(F.transform(fresh, described), trees.selects)
    ranks = F.create_map(*[x for i, k in enumerate(BASE_KINDS) for x in (F.lit(k), F.lit(i))])
    added = F.transform(chosen, lambda x: F.struct(x["kind"].alias("kind"), F.element_at(ranks, x["kind"]).alias("rank"), *[x[c].alias(c) for c in ("start", "end", "value")]))
    return found.withColumn("added", F.array_distinct(added))


def redact_personal(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(doc_id, text) with each stretch of personal data replaced by its kind in brackets."""
    return find_personal(docs, trees).select("doc_id", replaced(F.col("text"), F.concat("base", "added")).alias("text"))


def personal_digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(F.col("base"), False), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), False).alias("spans"),
    )


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return personal_digest(find_personal(docs, fit(docs)))
