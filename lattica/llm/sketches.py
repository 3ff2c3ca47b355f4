"""Ranked lexical search with hashed max-sketches.

``build_index`` reads every text once and writes a row for each document: its length, its distinct terms with their counts, and
a sketch: ``ROWS`` rows of hashed coordinates, each with the largest impact of the terms that fall on it. An impact grows with a
term's count in a document of given length, so the sketch keeps the largest counts (255: that or more) and they become impacts
once the corpus' size is known; documents can be added without making old sketches anew. A sketch has at least ``SPREAD``
coordinates for each distinct term, so its size follows the text.

``search`` asks a batch of items at a time. The least of a term's coordinates bounds its impact from above, and an item's sum of
these times the weights bounds its score. A first round rescores the few documents of highest bound in each batch of documents:
the k-th best of them all is a score that the k-th best document has at least. The second round goes through each batch by
descending bound, rescores exactly, and ends where a bound falls below that threshold or below the batch's own k-th score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.storage import materialize

#: Hashed rows of a sketch, and coordinates of each for a distinct term at least.
ROWS, SPREAD = 2, 4
#: Documents an item gets, and those rescored for a threshold in each batch of documents.
TOP, PROBES = 50, 4
#: Items asked at once, and bytes of their texts: what is sent to the tasks is bounded by these.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 16 << 20
#: Cells of a matrix of bounds.
CELLS = 4_000_000

terms_of = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall


def coordinates(terms: list[bytes], size: int) -> np.ndarray:
    """(ROWS, terms): where each term falls in sketch rows of ``size`` coordinates, a power of two."""
    found = np.fromiter(map(crc32, terms), np.uint64, len(terms))
    second = (found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return np.stack([found, second]) & np.uint64(size - 1)


def sketch(terms: list[bytes], counts: np.ndarray) -> bytes:
    """Coordinatewise maxima of counts, ROWS rows one after the other; no terms: empty."""
    if not terms:
        return b""
    size = 1 << (SPREAD * len(terms) - 1).bit_length()
    rows = np.zeros((ROWS, size), np.uint8)
    held = np.minimum(counts, 255).astype(np.uint8)
    for row, at in zip(rows, coordinates(terms, size), strict=True):
        np.maximum.at(row, at, held)
    return rows.tobytes()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts, sketch): written to the shared folder; one row for each row of ``docs``.

    ``terms`` are the distinct terms joined by spaces, ``counts`` theirs as unsigned 32-bit integers. Null and empty texts have
    no terms. Only the two named columns are read.
    """
    names = ["doc_id", "n", "terms", "counts", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                held = Counter(terms_of((text or "").encode().lower()))  # bytes: only A-Z are lower-cased
                words, n = list(held), np.fromiter(held.values(), np.uint32, len(held))
                sizes.append(int(n.sum()))
                terms.append(b" ".join(words))
                counts.append(n.tobytes())
                sketches.append(sketch(words, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (terms, counts, sketches))], names)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n long, terms binary, counts binary, sketch binary")
    return materialize(rows, "search-index")


class Questions:
    """A batch of items with the weights of their terms, ready to bound and score documents."""

    def __init__(self, items: dict[int, set[bytes]], weights: dict[bytes, int], documents: int, words: int):
        self.documents, self.words = documents, words
        held = {item: [t for t in sorted(terms) if weights.get(t, 0) > 0] for item, terms in items.items()}
        self.items = [item for item, terms in held.items() if terms]
        self.terms = [[(t, weights[t]) for t in held[item]] for item in self.items]
        self.distinct = sorted({t for item in self.items for t in held[item]})
        number = {t: i for i, t in enumerate(self.distinct)}
        self.columns = np.array([number[t] for pairs in self.terms for t, _ in pairs], np.int64)
        self.weights = np.array([w for pairs in self.terms for _, w in pairs], np.float64)
        self.starts = np.cumsum([0] + [len(pairs) for pairs in self.terms])[:-1]

    def length(self, n: np.ndarray | int):
        """Of documents of ``n`` terms: 100 for one of mean length."""
        return 50 + (50 * n * self.documents) // self.words

    def bounds(self, n: np.ndarray, sketches: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of documents, their upper bounds for each item), documents of one sketch size at a time."""
        sizes = np.array([len(s) // ROWS for s in sketches])
        step = max(1, CELLS // max(1, len(self.columns)))
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = coordinates(self.distinct, size).astype(np.int64)
            those = np.flatnonzero(sizes == size)
            rows_at_once = max(1, min(step, CELLS // size))
            for i in range(0, len(those), rows_at_once):
                some = those[i : i + rows_at_once]
                held = np.frombuffer(b"".join(sketches[j] for j in some.tolist()), np.uint8).reshape(len(some), ROWS, size)
                most = held[:, 0, at[0]]
                for r in range(1, ROWS):
                    most = np.minimum(most, held[:, r, at[r]])
                tf, m = most.astype(np.float64), self.length(n[some]).astype(np.float64)
                impact = np.where(most == 255, 1e6, 1e9 * tf / (1000 * tf + 20 * m[:, None]))
                yield some, np.add.reduceat(impact[:, self.columns] * self.weights, self.starts, axis=1)

    def score(self, held: dict[bytes, int], m: int, item: int) -> int:
        """Exact score of a document's terms for the item of this number."""
        return sum(w * ((1_000_000_000 * held[t]) // (1000 * held[t] + 20 * m)) for t, w in self.terms[item] if t in held)


def _batches_of(items: DataFrame, at_once: int, bytes_at_once: int) -> Iterator[dict[int, set[bytes]]]:
    """Items with their terms, dealt by id, so that all texts of an id are in one batch."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("item_id is not null and text is not null").distinct()
    n, size = own.agg(F.countDistinct("item_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    turns = max(1, -(-n // at_once), -(-size // bytes_at_once))
    for turn in range(turns):
        found: dict[int, set[bytes]] = {}
        for row in own.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn).collect():
            found.setdefault(row.item_id, set()).update(terms_of(row.text.encode().lower()))
        if found:
            yield found


def _document_frequency(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """In how many documents of the index each of the terms is."""
    shared = index.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, held = shared.value, Counter()
        for batch in batches:
            for line in batch.column(0).to_pylist():
                held.update(wanted.intersection(line.split(b" ")))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["term", "df"])

    rows = index.where("n > 0").select("terms").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {bytes(r.term): r.df for r in rows}


def _rescored(index: DataFrame, asked: Questions, least: dict[int, int], most: int, probe: bool) -> DataFrame:
    """(item_id, doc_id, score): of each batch of documents up to ``most`` an item, by descending bound.

    ``least``: scores that an item's results must reach. ``probe``: only the documents of the ``most`` highest bounds are rescored.
    """
    context = index.sparkSession.sparkContext
    shared, floors = context.broadcast(asked), context.broadcast(np.array([least.get(i, 1) for i in asked.items], np.int64))
    kinds, names = (pa.int64(), pa.int64(), pa.int64()), ["item_id", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floor_of = shared.value, floors.value
        for batch in batches:
            n = batch.column(1).to_numpy()
            bounded = list(q.bounds(n, batch.column(2).to_pylist()))
            if not bounded:
                continue
            docs = np.concatenate([x for x, _ in bounded])
            bounds = np.concatenate([x for _, x in bounded])
            del bounded
            ids, terms, counts = batch.column(0), batch.column(3), batch.column(4)
            opened: dict[int, tuple[dict[bytes, int], int]] = {}
            rows = []
            for i, item in enumerate(q.items):
                # a rounding error of a bound stays far below one unit of a score
                live = np.flatnonzero(bounds[:, i] + 1 >= floor_of[i])
                if probe and len(live) > most:
                    live = live[np.argpartition(-bounds[live, i], most)[:most]]
                live = live[np.argsort(-bounds[live, i], kind="stable")]
                found, kth, next_at = [], int(floor_of[i]), most
                for place in live.tolist():
                    if bounds[place, i] + 1 < kth:
                        break
                    doc = int(docs[place])
                    if doc not in opened:
                        held = dict(zip(terms[doc].as_py().split(b" "), np.frombuffer(counts[doc].as_py(), np.uint32).tolist(), strict=True))
                        opened[doc] = held, int(q.length(int(n[doc])))
                    score = q.score(*opened[doc], i)
                    if score >= kth:
                        found.append((score, doc))
                        if len(found) >= next_at:  # the k-th score so far is a threshold
                            found = sorted(found, key=lambda x: (-x[0], _order(ids[x[1]].as_py())))[:most]
                            kth, next_at = found[-1][0], 2 * most
                found.sort(key=lambda x: (-x[0], _order(ids[x[1]].as_py())))
                rows += [(item, ids[doc].as_py(), score) for score, doc in found[:most]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return index.where("n > 0").select("doc_id", "n", "sketch", "terms", "counts").mapInArrow(run, "item_id long, doc_id long, score long")


def _order(doc_id: int | None) -> tuple[bool, int]:
    """Ascending ids, nulls last."""
    return doc_id is None, doc_id or 0


def search(index: DataFrame, items: DataFrame, top: int = TOP, at_once: int = ITEMS_AT_ONCE, bytes_at_once: int = BYTES_AT_ONCE) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of highest score above 0 for each item, exactly.

    Equal scores come by ascending doc_id, null ids last; each row of the index is a document of its own. Texts of an item id
    count as one item; items without a term of the corpus have no rows.
    """
    spark = index.sparkSession
    documents, words = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = None
    for items_now in _batches_of(items, at_once, bytes_at_once):
        if not documents:
            break
        df = _document_frequency(index, set().union(*items_now.values()))
        weights = {t: floor(1000 * log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
        asked = Questions(items_now, weights, documents, words)
        if not asked.items:
            continue
        probed = _rescored(index, asked, {}, PROBES, probe=True)
        ranked = probed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        least = {r.item_id: r.score for r in ranked.where(F.col("rank") == top).select("item_id", "score").collect()}
        more = _rescored(index, asked, least, top, probe=False)
        found = more if found is None else found.unionByName(more)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_sketch_search(spark, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH held AS (SELECT doc_id, row_number() OVER () AS row, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, row, len(terms)::BIGINT AS n, terms FROM held WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS words FROM sized),
counted AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM sized) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(documents) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counted, total WHERE term IN (SELECT term FROM asked) GROUP BY term),
lengths AS (SELECT row, doc_id, 50 + (50 * n * documents) // words AS m FROM sized, total),
scored AS (
  SELECT item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (row) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50"""
