"""Toxic spans by a linear-chain conditional random field with two tags, document scores from its marginals.

Labels are of documents, the field tags tokens, so tokens are labelled first: over the labelled rows, features (a word,
its beginnings) that occur in toxic documents and hardly in others mark the tokens of toxic documents. These labels only
start the fit, by gradient ascent on the conditional log-likelihood; then they are replaced, ``RELABELS`` times, by what the
field itself expects of a document of which all that is known is that some token is toxic (or that none is). Forward and
backward messages give each token's marginal; a document's score is a calibrated logistic function of the marginals' pooled evidence, and the
tokens above ``SPAN_LEAST`` are its offending spans.

The two messages of a whole batch of documents are computed at once: a step of a two-tag chain is a 2 x 2 matrix, matrices
within blocks are multiplied in parallel, and documents are cut apart by matrices that forget what came before.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import materialize

#: Labelled documents that features and weights are fitted on at most.
SAMPLE_DOCS = 24_000
#: Lengths of the beginnings of words that are features.
PREFIXES = (4, 5, 6)
#: A feature needs a log-likelihood ratio (twice the gain in nats) between toxic and other sample documents that chance gives
#: to fewer than ``BY_CHANCE`` of all that occur in enough documents, and this log-odds.
BY_CHANCE, LEAST_ODDS = 0.01, 2.5
#: Features kept at most (the strongest); bounds what is sent to executors.
MOST_FEATURES = 20_000
#: Documents of the field's fit, half of them toxic, and characters of each half, at most; its rounds, rate and ridge.
FIT_DOCS, FIT_CHARS, ROUNDS, RATE, RIDGE = 2_000, 1_500_000, 40, 2.0, 1e-3
#: How often token labels are made anew, evenly over the later half of the rounds.
RELABELS = 4
#: Added to a document's evidence before its logarithm is taken.
FLOOR = 0.05
#: Chances from which a token adds to its document's evidence and from which it is a span, and the score that counts as toxic.
SUSPICIOUS, SPAN_LEAST, SCORE_LEAST = 0.1, 0.5, 0.3
#: A worker's table of words starts anew beyond this.
TABLE_WORDS = 400_000
#: Tokens of documents that are scored together.
BATCH_TOKENS = 500_000

tokens_of = re.compile(r"\w+").findall


def features_of(word: str) -> list[str]:
    """A lower-case word, and its beginnings where they are shorter."""
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


@dataclass
class ToxicField:
    """Weights of the field: per feature, of a tag for unknown words, of neighbouring tags; and of the document score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    #: Log-weights of tag pairs [before, after].
    pairs: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    calibration: tuple[float, float] = (1.0, 0.0)

    def emission(self, word: str) -> float:
        """Log-weight of the toxic tag over the other one; unknown features weigh nothing."""
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features_of(word))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices whose entries 00, 01, 10, 11 are the rows of ``a`` and ``b``."""
    return np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])


def _products(steps: np.ndarray) -> np.ndarray:
    """Running products M0, M0 M1, ... of matrices in rows of entries (4, n), scaled to a largest entry of 1."""
    n, width = steps.shape[1], 64
    eye = np.array([1.0, 0.0, 0.0, 1.0])[:, None]
    if n <= width:
        run, out = eye, np.empty_like(steps)
        for i in range(n):
            run = _times(run, steps[:, i : i + 1])
            run = run / run.max()
            out[:, i : i + 1] = run
        return out
    blocks = -(-n // width)
    padded = np.concatenate([steps, np.repeat(eye, blocks * width - n, axis=1)], axis=1).reshape(4, blocks, width)
    by_step = np.ascontiguousarray(padded.transpose(2, 0, 1))
    inner, run = np.empty_like(by_step), np.repeat(eye, blocks, axis=1)
    for i in range(width):
        run = _times(run, by_step[i])
        if i % 8 == 7:
            run /= run.max(axis=0)
        inner[i] = run
    before = np.concatenate([eye, _products(inner[-1])[:, :-1]], axis=1)
    out = np.stack([_times(before, inner[i]) for i in range(width)])
    out = out.transpose(1, 2, 0).reshape(4, -1)[:, :n]
    return out / out.max(axis=0)


def marginals(emissions: np.ndarray, starts: np.ndarray, pairs: np.ndarray, joint: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over documents laid end to end: (chance of the toxic tag, summed chances of tag pairs).

    ``starts`` holds the index of each document's first token, ascending; no document may be empty. The sums (2, 2) are
    made on demand.
    """
    n = len(emissions)
    if not n:
        return np.zeros(0), np.zeros((2, 2)) if joint else None
    e = np.clip(emissions, -30, 30)
    local = np.exp(np.stack([np.minimum(0, -e), np.minimum(0, e)]))
    moves = np.exp(pairs - pairs.max())
    first = np.zeros(n, bool)
    first[starts] = True
    last = np.append(first[1:], True)
    entering = np.stack([moves[i, j] * local[j] for i in (0, 1) for j in (0, 1)])
    # at a document's start both tags begin alike, whatever came before
    forward = _products(np.where(first, np.stack([local[0], local[1]] * 2), entering))[:2]
    leaving = np.where(last, 1.0, np.roll(entering, -1, axis=1))[[0, 2, 1, 3]]
    backward = _products(leaving[:, ::-1])[:2, ::-1]
    both = forward * backward
    chance = both[1] / (both[0] + both[1])
    if not joint:
        return chance, None
    inner = np.flatnonzero(~first)
    four = np.stack([forward[i, inner - 1] * moves[i, j] * local[j, inner] * backward[j, inner] for i in (0, 1) for j in (0, 1)])
    return chance, (four / four.sum(axis=0)).sum(axis=1).reshape(2, 2)


def evidence(chance: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each document's pooled evidence: minus the log-chance that none of its suspicious tokens is toxic.

    Tokens below ``SUSPICIOUS`` are left out: their small chances would add up over a long clean document. ``starts`` ascend
    and are distinct.
    """
    clean = np.where(chance >= SUSPICIOUS, -np.log1p(-np.minimum(chance, 1 - 1e-9)), 0.0)
    return np.add.reduceat(clean, starts) if len(starts) else np.zeros(0)


def fit_field(texts: list[str], toxic: list[int], features: list[str], share: float) -> ToxicField:
    """A field for the given features, from bounded lists of texts and their labels; ``share`` of all texts are toxic."""
    known = {f: i for i, f in enumerate(features)}
    words = [[w.lower() for w in tokens_of(t)] for t in texts]
    starts, rows, cols, n = [], [], [], 0
    cache: dict[str, list[int]] = {}
    gold, kept = [], []
    for own, label in zip(words, toxic, strict=True):
        if not own:
            continue
        starts.append(n)
        kept.append(label)
        for w in own:
            found = cache.get(w)
            if found is None:
                found = cache[w] = [known[f] for f in features_of(w) if f in known]
            rows += [n] * len(found)
            cols += found
            gold.append(label and bool(found))
            n += 1
    made = ToxicField()
    if not n:
        return made
    rows, cols, gold, starts = np.array(rows, np.int64), np.array(cols, np.int64), np.array(gold, float), np.array(starts)
    first = np.zeros(n, bool)
    first[starts] = True
    inner = np.flatnonzero(~first)
    of_doc = np.cumsum(first) - 1
    toxic_doc = np.array(kept, bool)[of_doc]
    relabel = {ROUNDS - 1 - ROUNDS // 2 * i // RELABELS for i in range(1, RELABELS + 1)}

    def pair_counts() -> np.ndarray:
        one, other = gold[inner - 1], gold[inner]
        return np.array([[((1 - one) * (1 - other)).sum(), ((1 - one) * other).sum()], [(one * (1 - other)).sum(), (one * other).sum()]])

    want_pairs = pair_counts()
    seen = np.bincount(cols, minlength=len(features)) + 1.0
    weights, bias, pairs = np.full(len(features), 4.0), -8.0, np.zeros((2, 2))
    for at in range(ROUNDS):
        emissions = np.bincount(rows, weights[cols], n) + bias
        chance, joint = marginals(emissions, starts, pairs, joint=True)
        if at in relabel:
            some = -np.expm1(np.add.reduceat(np.log1p(-np.minimum(chance, 1 - 1e-9)), starts))  # chance that some token is toxic
            gold = np.where(toxic_doc, np.minimum(chance / np.maximum(some[of_doc], 1e-9), 1.0), 0.0)
            want_pairs = pair_counts()
        error = gold - chance
        weights += RATE * (np.bincount(cols, error[rows], len(features)) / seen - RIDGE * weights)
        bias += np.log((gold.sum() + 1) / (chance.sum() + 1)) / 4
        gap = (want_pairs - joint) / (want_pairs.sum(axis=1, keepdims=True) + 1)
        pairs += RATE * (gap - RIDGE * pairs)
    emissions = np.bincount(rows, weights[cols], n) + bias
    pooled = np.log(evidence(marginals(emissions, starts, pairs)[0], starts) + FLOOR)
    # then each document's chance by its pooled evidence (Newton's method with short steps, as the two may be quite apart),
    # shifted to the share of toxic documents
    kept, by, x = np.array(kept, float), np.array([1.0, 0.0]), np.stack([pooled, np.ones(len(pooled))], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ by, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (kept - p) - 0.1 * by)
        by = by + step * min(1.0, 0.5 / np.abs(step).max())
    fitted = min(max(kept.mean(), 1e-3), 1 - 1e-3)
    slope, shift = max(0.1, by[0]), by[1] + np.log(share / (1 - share)) - np.log(fitted / (1 - fitted))
    return ToxicField(dict(zip(features, weights.tolist(), strict=True)), float(bias), tuple(map(tuple, pairs.tolist())), (float(slope), float(shift)))


def copies_key(text: str) -> int:
    """Least hash of the text's three-word shingles; near copies mostly share it."""
    words = [w.lower() for w in tokens_of(text)]
    return min((zlib.crc32(" ".join(x).encode()) for x in zip(words, words[1:], words[2:], strict=False)), default=zlib.crc32(" ".join(words).encode()))


def _count_features(texts: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """(feature, n): documents with each feature (each wanted one), summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = {f for w in {w.lower() for w in tokens_of(text or "")} for f in features_of(w)}
                for f in own if wanted is None else own & wanted:
                    total[f] = total.get(f, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["feature", "n"])

    return texts.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def choose_features(sample: DataFrame) -> list[str]:
    """Features of (text, toxic) rows that set toxic documents apart; groups of near copies count once.

    Ratio and odds are taken over all sample rows that differ; the sample is bounded, and so is what is collected.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([copies_key(t) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, batch.column(0), batch.column(1)], ["key", "text", "toxic"])

    apart = materialize(sample.select("text", "toxic").mapInArrow(keyed, "key long, text string, toxic int").dropDuplicates(["key", "toxic"]), "toxic-apart")
    sizes = {r.toxic: r.n for r in apart.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return []
    toxic = {r.feature: r.n for r in _count_features(apart.where("toxic = 1"), None).where("n > 3").collect()}
    other = {r.feature: r.n for r in _count_features(apart.where("toxic = 0"), frozenset(toxic)).collect()}
    f, a = np.array(list(toxic), object), np.array(list(toxic.values()), float)
    b, n = np.array([other.get(x, 0) for x in f], float), n_toxic + n_other
    ratio = np.zeros(len(f))
    for seen, rate in ((a, (a + b) * n_toxic / n), (b, (a + b) * n_other / n), (n_toxic - a, n_toxic - (a + b) * n_toxic / n), (n_other - b, n_other - (a + b) * n_other / n)):
        ratio += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(rate, 1e-9)), 0)
    odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_other + 1))
    # a chance ratio is above x for a share exp(-x / 2) of features at most
    good = np.flatnonzero((ratio >= 2 * np.log(max(len(f), 2) / BY_CHANCE)) & (odds >= LEAST_ODDS))
    return [str(f[i]) for i in sorted(good, key=lambda i: (-ratio[i], f[i]))[:MOST_FEATURES]]


def train(docs: DataFrame, labels: DataFrame, keep_out: bool = True, bound: int = SAMPLE_DOCS) -> ToxicField:
    """A field from labelled documents, ``bound`` of them at most, chosen by a hash of the id.

    With ``keep_out``, rows whose crc32(id as text) mod 4 is 2 are not used. Where a document has several labels, the
    highest counts; null labels do not. Without both labels the field has no features and scores nothing as toxic.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    if keep_out:
        own = own.where(~_held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    if n > bound:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the labels chosen number about ``bound``, so they may be sent to all tasks
    sample = materialize(texts.join(F.broadcast(own), "doc_id").select("doc_id", "text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")), "toxic-sample")
    features = choose_features(sample)
    if not features:
        return ToxicField()
    share = sample.agg(F.avg("toxic")).first()[0]
    keyed = sample.where("text <> ''").withColumn("hash", F.xxhash64("text")).dropDuplicates(["toxic", "doc_id", "hash"])
    # ids and lengths of the sample, SAMPLE_DOCS of them at most
    sizes = keyed.select("toxic", "doc_id", "hash", F.length("text").alias("chars"), F.xxhash64("doc_id", "hash").alias("place")).collect()
    chosen, docs_of, chars_of = [], [0, 0], [0, 0]
    for r in sorted(sizes, key=lambda r: (r.place, r.doc_id, r.hash)):
        if docs_of[r.toxic] < FIT_DOCS // 2 and chars_of[r.toxic] + r.chars <= FIT_CHARS:
            docs_of[r.toxic] += 1
            chars_of[r.toxic] += r.chars
            chosen.append((r.toxic, r.doc_id, r.hash))
    picked = docs.sparkSession.createDataFrame(chosen, "toxic int, doc_id long, hash long")
    rows = keyed.join(F.broadcast(picked), ["toxic", "doc_id", "hash"], "left_semi").orderBy("toxic", "hash", "doc_id").collect()  # FIT_CHARS of each label at most
    return fit_field([r.text for r in rows], [r.toxic for r in rows], features, min(max(share, 1e-3), 1 - 1e-3))


def _held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


class _WordWeights(dict):
    """Emissions of words as written, made when first asked for; starts anew when full."""

    def __init__(self, made: ToxicField):
        super().__init__()
        self.made = made

    def __missing__(self, word: str) -> float:
        weight = self.made.emission(word.lower())
        if len(self) >= TABLE_WORDS:
            self.clear()
        self[word] = weight
        return weight


class Scorer:
    """Scores and offending offsets of texts under a field."""

    def __init__(self, made: ToxicField):
        self.made, self.table, self.pairs = made, _WordWeights(made), np.array(made.pairs)

    def _some(self, texts: list[str], words: list[list[str]]) -> list[tuple[float, list[tuple[int, int]]]]:
        counts = np.array([len(w) for w in words])
        filled = np.flatnonzero(counts)
        starts = np.cumsum(counts[filled]) - counts[filled]
        emissions = np.concatenate([np.fromiter(map(self.table.__getitem__, words[i]), float, counts[i]) for i in filled]) if len(filled) else np.zeros(0)
        chance, _ = marginals(emissions, starts, self.pairs)
        pooled = np.zeros(len(texts))
        pooled[filled] = evidence(chance, starts)
        slope, shift = self.made.calibration
        scores = 1 / (1 + np.exp(-np.clip(slope * np.log(pooled + FLOOR) + shift, -500, 500)))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        hits = np.flatnonzero(chance >= SPAN_LEAST)
        for k in np.unique(np.searchsorted(starts, hits, side="right") - 1):
            i, own = filled[k], hits[(hits >= starts[k]) & (hits < starts[k] + counts[filled[k]])] - starts[k]
            at = [m.span() for m in re.finditer(r"\w+", texts[i])]
            for j in own:
                if spans[i] and own[0] < j and j - 1 in own:
                    spans[i][-1] = (spans[i][-1][0], at[j][1])
                else:
                    spans[i].append(at[j])
        return list(zip(scores.tolist(), spans, strict=True))

    def score(self, texts: list[str]) -> list[tuple[float, list[tuple[int, int]]]]:
        """(score, spans) of each text; documents are taken together up to ``BATCH_TOKENS`` tokens."""
        out, held, words, n = [], [], [], 0
        for text in texts:
            held.append(text)
            words.append(tokens_of(text))
            n += len(words[-1])
            if n >= BATCH_TOKENS:
                out += self._some(held, words)
                held, words, n = [], [], 0
        return out + self._some(held, words) if held else out


def score_documents(docs: DataFrame, made: ToxicField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans array<struct<start, end>>): one row for each input row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(made)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = scorer.score([t or "" for t in batch.column(1).to_pylist()])
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.float64()), spans], ["doc_id", "score", "spans"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")


def drop_toxic(docs: DataFrame, made: ToxicField, text_col: str = "text", least: float = SCORE_LEAST) -> DataFrame:
    """Rows of ``docs`` whose score is below ``least``, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(made)
        for batch in batches:
            found = scorer.score([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([x < least for x, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, made)
    return scored.select(
        "doc_id",
        _held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= SCORE_LEAST).cast("int").alias("predicted"),
        F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))).alias("spans"),
    )
