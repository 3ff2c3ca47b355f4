"""Benchmark decontamination: training passages query a BM25 index of test items with block-max WAND.

Items are cut into segments, which are the index's documents; its terms are pairs of neighbouring words, as single words of
ordinary prose occur in most segments and let no passage be passed over (an item of one word has this word as its term).
Weights are divided by the score a segment gives itself, so one threshold serves segments of any length. Every training text
is read as overlapping passages; a passage whose terms' largest weights cannot add up to the threshold is done, others
traverse the postings with block-max WAND, which skips by the ends of blocks and returns every segment at or above the
threshold. What is found is verified: word trigrams of the item's question part and of its answer part must both occur
around the passage.

The index holds about ``ITEMS_AT_ONCE`` items and ``BYTES_AT_ONCE`` bytes of text at most, so what is sent to executors is
bounded; more items are searched in turns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import materialize

K1, B = 1.2, 0.75
#: Words of a segment at most, of a passage, and between the starts of passages.
SEGMENT, PASSAGE, STRIDE = 48, 96, 48
#: Share of a segment's score by itself from which it is retrieved.
THRESHOLD = 0.5
#: Share of trigrams of the question, and of the answer, that must occur.
LEAST_QUESTION, LEAST_ANSWER = 0.7, 0.7
#: Share of an item's words that are its question; the rest is its answer.
QUESTION = 2 / 3
#: Postings of a block; items of one index, and bytes of their texts.
BLOCK, ITEMS_AT_ONCE, BYTES_AT_ONCE = 32, 20_000, 64 << 20

words_of = re.compile(r"\w+").findall


def grams(words: list[str]) -> set[tuple[str, ...]]:
    """Trigrams; of fewer words, the whole sequence."""
    return set(zip(words, words[1:], words[2:], strict=False)) if len(words) >= 3 else {tuple(words)}


class Index:
    """Inverted index of items: for each term, postings (segment, normalised weight) in blocks with their largest weight
    and last segment.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.parts, segments, self.owner = [], [], []
        #: Items of one word: their postings, by term; the word gives such an item its whole score.
        self.single: dict[str, list[int]] = {}
        for item, text in items:
            words = words_of(text.lower())
            if not words:
                continue
            cut = min(max(1, round(len(words) * QUESTION)), max(1, len(words) - 1))
            self.parts.append((item, len(words), grams(words[:cut]), grams(words[cut:]) if words[cut:] else set()))
            if len(words) == 1:
                self.single.setdefault(words[0], []).append(item)
            for i in range(0, len(words), SEGMENT):
                segments.append(words[i : i + SEGMENT])
                self.owner.append(len(self.parts) - 1)
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for words in segments for w in words))}
        counts: dict[int, dict[int, int]] = {}
        sizes = [len(words) - 1 for words in segments]
        for s, words in enumerate(segments):
            for pair in self.pairs(words).tolist():
                counts.setdefault(pair, {}).setdefault(s, 0)
                counts[pair][s] += 1
        mean = sum(sizes) / max(1, len(sizes))
        weights: dict[int, dict[int, float]] = {}
        own = [0.0] * len(segments)
        for pair, found in counts.items():
            idf = log(1 + (len(segments) - len(found) + 0.5) / (len(found) + 0.5))
            weights[pair] = {s: idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[s] / mean)) for s, tf in found.items()}
            for s, x in weights[pair].items():
                own[s] += x
        ordered = sorted(weights)
        self.codes = np.array(ordered, np.int64)
        self.segments = [sorted(weights[p]) for p in ordered]
        self.weights = [[weights[p][s] / own[s] for s in segs] for p, segs in zip(ordered, self.segments, strict=True)]
        self.block_most = [[max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for w in self.weights]
        self.block_last = [[segs[min(i + BLOCK, len(segs)) - 1] for i in range(0, len(segs), BLOCK)] for segs in self.segments]
        self.most = np.array([max(b) for b in self.block_most] + [0.0])  # the last is for pairs of no item

    def pairs(self, words: list[str]) -> np.ndarray:
        """Codes of neighbouring words, -1 where either is in no item."""
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        first, second = numbers[:-1], numbers[1:]
        return np.where((first < 0) | (second < 0), -1, first * len(self.number) + second)

    def terms(self, words: list[str]) -> np.ndarray:
        """Term numbers of neighbouring words, the number of terms where no item has the pair."""
        pairs = self.pairs(words)
        known = np.flatnonzero(pairs >= 0)
        out = np.full(len(pairs), len(self.codes))
        if len(known) and len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, pairs[known]), len(self.codes) - 1)
            out[known] = np.where(self.codes[at] == pairs[known], at, len(self.codes))
        return out

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All (segment, score) at or above the threshold for distinct terms, by block-max WAND."""
        most, segments, last = self.most, self.segments, self.block_last
        at = dict.fromkeys(terms, 0)
        live = sorted(terms, key=lambda t: segments[t][0])
        out = []
        slack = threshold - 1e-9
        while live:
            total, pivot = 0.0, -1
            for i, t in enumerate(live):
                total += most[t]
                if total >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            segment = segments[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and segments[live[pivot + 1]][at[live[pivot + 1]]] == segment:
                pivot += 1
            # the blocks that would hold the pivot segment: their largest weights, and where the first of them ends
            bound, after = 0.0, 1 << 60
            for t in live[: pivot + 1]:
                k = bisect_left(last[t], segment, at[t] // BLOCK)
                if k < len(last[t]):
                    bound += self.block_most[t][k]
                    after = min(after, last[t][k] + 1)
            if pivot + 1 < len(live):
                after = min(after, segments[live[pivot + 1]][at[live[pivot + 1]]])
            if bound < slack:
                target = max(after, segment + 1)
            else:
                target = segment
                if segments[live[0]][at[live[0]]] == segment:
                    score = sum(self.weights[t][at[t]] for t in live[: pivot + 1])
                    if score >= slack:
                        out.append((segment, score))
                    target = segment + 1
            for t in live[: pivot + 1]:
                k = bisect_left(last[t], target, at[t] // BLOCK)  # whole blocks are passed over
                at[t] = bisect_left(segments[t], target, max(at[t], k * BLOCK), min((k + 1) * BLOCK, len(segments[t])))
            live = sorted((t for t in live if at[t] < len(segments[t])), key=lambda t: segments[t][at[t]])
        return out

    def leaks(self, text: str, threshold: float = THRESHOLD) -> list[tuple[int, float, float, float]]:
        """Verified (item, best score, question overlap, answer overlap) of a text, by item."""
        words = words_of(text.lower())
        if not words or not self.parts:
            return []
        terms = self.terms(words)
        sums = np.concatenate([[0.0], np.cumsum(self.most[terms])])
        starts = np.arange(0, max(1, len(words) - PASSAGE + STRIDE), STRIDE)
        starts = starts[starts < len(terms)]
        ends = np.minimum(starts + PASSAGE - 1, len(terms))
        best: dict[int, tuple[float, float, float]] = {}
        if self.single:
            best = {item: (1.0, 1.0, 1.0) for w in self.single.keys() & set(words) for item in self.single[w]}
        hits: dict[int, dict[tuple[int, int], float]] = {}
        for i in np.flatnonzero(sums[ends] - sums[starts] >= threshold - 1e-9):
            start, end = int(starts[i]), int(ends[i])
            known = [t for t in set(terms[start:end].tolist()) if t < len(self.codes)]
            for segment, score in self.search(known, threshold):
                held = hits.setdefault(self.owner[segment], {})
                held[start, end] = max(score, held.get((start, end), 0.0))
        places: dict[int, dict[tuple[str, ...], list[int]]] = {}
        for part, held in hits.items():
            item, size, question, answer = self.parts[part]
            around = [(max(0, start - size), end + 1 + size) for start, end in sorted(held)]  # both ends ascend
            q = _shares(question, words, around, places)
            a = _shares(answer, words, around, places) if answer else q
            for window, x, y in zip(sorted(held), q, a, strict=True):
                if x >= LEAST_QUESTION and y >= LEAST_ANSWER:
                    old = best.get(item, (0.0, 0.0, 0.0))
                    best[item] = (max(held[window], old[0]), max(x, old[1]), max(y, old[2]))
        return [(item, *found) for item, found in sorted(best.items())]


def _shares(part: set[tuple[str, ...]], words: list[str], around: list[tuple[int, int]], places: dict[int, dict[tuple[str, ...], list[int]]]) -> list[float]:
    """For each window of a text, whose ends ascend, the share of a part's runs of words that occur in it.

    The text's runs are filed once by their places in ``places``; a run enters the count with the first window that holds it and
    leaves with the first that starts behind it, so the time follows the occurrences and not the windows' sizes.
    """
    n = len(next(iter(part)))
    if n not in places:
        filed = places[n] = {}
        for k, run in enumerate(zip(*(words[j:] for j in range(n)), strict=False)):
            filed.setdefault(run, []).append(k)
    spots = sorted((k, i) for i, run in enumerate(part) for k in places[n].get(run, ()))
    counts, shares, entered, left = {}, [], 0, 0
    for low, high in around:
        while entered < len(spots) and spots[entered][0] + n <= high:
            i = spots[entered][1]
            counts[i] = counts.get(i, 0) + 1
            entered += 1
        while left < entered and spots[left][0] < low:
            i = spots[left][1]
            counts[i] -= 1
            if not counts[i]:
                del counts[i]
            left += 1
        shares.append(len(counts) / len(part))
    return shares


def indexes(items: DataFrame, at_once: int = ITEMS_AT_ONCE, bytes_at_once: int = BYTES_AT_ONCE) -> Iterator[Index]:
    """Indexes over all items with a text, each of at most about ``at_once`` of them and ``bytes_at_once`` bytes; repeated rows
    count once, an item longer than that has an index of its own or one with few others. All texts of an item are in one."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    turns = max(1, -(-n // at_once), -(-size // bytes_at_once))
    for turn in range(turns):
        some = own.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn).orderBy("item_id", "text")
        yield Index([(r.item_id, r.text) for r in some.collect()])


def find_leaks(docs: DataFrame, items: DataFrame, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): each verified pair once for each row of ``docs``.

    ``score`` is the best passage's share of the segment's own score. Null texts and items have no pairs; an item's repeats
    with different texts count as one item, whose best values are given, however many indexes there are. Time is linear in the
    length of a text, and in that of an item it holds.
    """
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]

    def searched(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaks = shared.value.leaks
            for batch in batches:
                rows = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for x in leaks(text)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    found = None
    for index in indexes(items, at_once):
        more = searched(index)
        found = more if found is None else found.unionByName(more)
    return found


def drop_leaks(docs: DataFrame, items: DataFrame, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """Rows of ``docs`` in which no item leaks, with all their columns; null texts stay.

    With several indexes, the rows that each leaves are written before the next one searches them, so a task never holds more
    than one.
    """
    at, kept = docs.columns.index("text"), None
    for index in indexes(items, at_once):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        kept = docs if kept is None else materialize(kept, "unleaked")

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            leaks = shared.value.leaks
            for batch in batches:
                yield batch.filter(pa.array([not (t and leaks(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
