"""Secret scans: fixed patterns, and tokens whose characters look random under two Markov models.

Two character-bigram models, one of random strings and one of ordinary identifiers, are trained from labelled samples
taken from the documents: values that the fixed patterns find are random strings, other words are identifiers. A long
token is reported when its log-likelihood ratio per bigram is above a threshold set on the labelled identifiers of all
documents; the models themselves are trained on a bounded sample. All of it
is DataFrame operations; the models are two tables of fixed size that end up as literals of an expression.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.spans import bounded_sample, count_of, joined, let, match_spans, outside, replaced

# Kinds in the order of their rank, and their patterns.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: What may be a secret without a telling name.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: Characters of the models; others share the last place.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents that the models are trained on at most.
SAMPLE_DOCS = 20_000
#: Steps of a score, by which those of all identifiers are counted.
STEPS = 1000
#: Added to each bigram's count.
SMOOTH = 0.5
#: Share of labelled identifiers that may lie above the threshold.
MOST_FALSE = 0.0005


def base_spans(text: Column) -> Column:
    """Spans of kinds assign, access and hex, as the fixed patterns find them."""
    assign = F.filter(match_spans(text, ASSIGN, "assign", 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= LEAST_ASSIGN)
    access = F.filter(match_spans(text, ACCESS, "access", 1), lambda s: F.length(s["value"]) >= LEAST_ACCESS)
    return F.concat(assign, access, match_spans(text, HEX, "hex", 2))


def _bigrams(value: Column) -> Column:
    """Numbers of the pairs of neighbouring characters."""
    n = len(ALPHABET) + 1
    place = lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(n)) - 1
    pairs = lambda at: F.transform(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, i: F.get(at, i) * n + b)
    return let(F.transform(F.split(value, ""), place), pairs)


def labelled_tokens(sample: DataFrame, text_col: str) -> DataFrame:
    """(value, secret): values of fixed patterns, and distinct other words of at least 8 letters, digits and marks."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = sample.select(F.explode(base_spans(text)).alias("s")).select("s.kind", "s.value")
    random = found.select(F.when(F.col("kind") == "assign", F.regexp_extract("value", ASSIGN_VALUE, 1)).otherwise(F.col("value")).alias("value")).distinct()
    words = sample.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}+"), F.lit(0))).alias("value")).distinct()
    ordinary = words.where(~F.col("value").rlike("[0-9].*[0-9].*[0-9]")).join(random, "value", "left_anti")
    return random.withColumn("secret", F.lit(1)).unionByName(ordinary.withColumn("secret", F.lit(0)))


class MarkovModel:
    """Log-likelihood ratios of bigrams, and the ratio per bigram from which a token counts as random."""

    def __init__(self, ratios: list[float], threshold: float):
        self.ratios, self.threshold = ratios, threshold

    def score(self, value: Column) -> Column:
        """Mean log-likelihood ratio per bigram; values of fewer than two characters have none."""
        table = F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")  # one literal after folding
        mean = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda total, p: total + F.get(table, p)) / F.nullif(F.size(pairs), F.lit(0))
        return let(_bigrams(value), mean)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE_DOCS) -> MarkovModel | None:
    """Models from the labelled tokens of ``bound`` documents, the threshold from those of all documents; None where the
    sample lacks either label."""
    tokens = labelled_tokens(bounded_sample(docs.select(id_col, text_col), bound), text_col).persist()
    counts = tokens.select("secret", F.explode(_bigrams(F.col("value"))).alias("pair")).groupBy("secret", "pair").count().collect()  # two tables of fixed size
    size = (len(ALPHABET) + 1) ** 2
    own = {label: {r.pair: r["count"] for r in counts if r.secret == label} for label in (0, 1)}
    if not own[0] or not own[1]:
        tokens.unpersist()
        return None
    log_p = {label: [log((c.get(i, 0) + SMOOTH) / (sum(c.values()) + SMOOTH * size)) for i in range(size)] for label, c in own.items()}
    model = MarkovModel([a - b for a, b in zip(log_p[1], log_p[0], strict=True)], 0.0)
    tokens.unpersist()
    ordinary = labelled_tokens(docs.select(id_col, text_col), text_col).where("secret = 0")
    steps = ordinary.groupBy(F.floor(model.score(F.col("value")) * STEPS).alias("step")).count().collect()  # scores are bounded, and so are their steps
    above, most = 0, MOST_FALSE * sum(r["count"] for r in steps)
    for r in sorted(steps, key=lambda r: -r.step):
        above += r["count"]
        if above > most:
            model.threshold = max(0.0, (r.step + 1) / STEPS)
            break
    return model


def scan_secrets(docs: DataFrame, model: MarkovModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): all secrets of each text as array<struct<kind, rank, start, end, value>>.

    Spans of kind ``markov`` are added where the models call a token of letters and digits random and no fixed pattern has
    found any part of it.
    One row for each input row; null and empty texts have no spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    if model is None:
        return found.select("doc_id", "text", F.col("base").alias("found"))
    tokens = match_spans(F.col("text"), CANDIDATE, "markov", 3)
    mixed = F.filter(tokens, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    added = F.filter(outside(mixed, F.col("base")), lambda s: model.score(s["value"]) > model.threshold)
    return found.select("doc_id", "text", F.concat("base", added).alias("found"))


def redact_secrets(docs: DataFrame, model: MarkovModel | None = None) -> DataFrame:
    """(doc_id, text) with each secret replaced by its kind in brackets."""
    return scan_secrets(docs, model).select("doc_id", replaced(F.col("text"), F.col("found")).alias("text"))


def secret_digest(found: DataFrame) -> DataFrame:
    base = F.filter("found", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id",
        *[count_of(F.col("found"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base, True), 256).alias("base_sha256"),
        joined(F.col("found"), True).alias("spans"),
    )


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secret_digest(scan_secrets(docs, train(docs)))
