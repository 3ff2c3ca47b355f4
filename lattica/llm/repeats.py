"""Repeated byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A window is a string of ``LENGTH`` bytes of a text. Windows that occur twice are found in three steps:

1. Anchors. A window's key is the least hash of the ``ANCHOR``-byte strings in it, so equal windows have equal keys. A text is
   cut into segments, runs of windows of one key; keys that occur once in the corpus cannot hold a repeat and are dropped by a
   count of keys, so only text around repeated anchors moves on.
2. Intervals. Distinct segments meet by key and are sorted into blocks of about ``BLOCK`` bytes. The Burrows-Wheeler transform of
   a block is expanded backwards, breadth first: the intervals of strings of length l give those of length l + 1, and an
   interval that is the first to end at a place sets the common prefix there to l. So common prefixes come by increasing value
   and expansion stops at ``LENGTH``: places without a value lie within intervals of longer strings. An interval whose rows
   stand for two or more occurrences is a repeat.
3. Spans. Repeats go back to the texts that hold their segments, where covered bytes are removed.

Joins merge sorted sides: what compresses well on disk may be large, so no side is broadcast for the size of its files.
Distinct texts and distinct segments are kept once with the number of their occurrences, so groups of copies stay small. The
distinct segments of keys with over ``HOT_BYTES`` of them, as at the ends of a passage that many texts continue in their own way,
are taken as texts in turn, with a longer anchor: fewer windows have an anchor without a byte of their own, and segments are
shorter, so that more of them are alike. The last anchor is the window itself. A window is in one segment of its text, so its
occurrences in distinct segments, by the texts that hold these, are those in the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import discard, materialize

#: Bytes of a window, and of the strings whose least hash is its key.
LENGTH, ANCHOR = 200, 64
#: Windows of a segment at most.
MOST_WINDOWS = 4096
#: Bytes of a block, about; the arrays of one stay in a core's cache.
BLOCK = 1 << 18
#: Bytes of distinct segments of a key beyond which they are cut by longer anchors.
HOT_BYTES = 1 << 20
#: Distinct segments that a key may have whatever their bytes are: in periodic text they are long, and no anchor parts them.
MANY = 1024
#: A longer anchor leaves one part in so many of the bytes that an anchor lacks of a window.
NEARER = 4
#: Bytes of texts that are hashed together, about; their arrays stay in a core's cache.
BATCH_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def string_hashes(held: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each place on; equal strings have equal hashes."""
    if len(held) < length:
        return np.zeros(0, np.uint64)
    h, step, done = held.astype(np.uint64) + np.uint64(1), 1, 0
    found, base = None, _BASE
    # the hash of a string is the sum of its bytes times powers of the base: put together from runs of powers of two
    while True:
        if length & step:
            n = len(held) - length + 1
            part = h[done : done + n]
            found = part.copy() if found is None else found * np.uint64(base) + part
            done += step
        if 2 * step > length:
            break
        h = h[:-step] * np.uint64(base) + h[step:]
        base = base * base % (1 << 64)
        step *= 2
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ found >> np.uint64(29)


def window_keys(held: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, hashes: np.ndarray | None = None) -> np.ndarray:
    """For each window, the least hash of the ``anchor``-byte strings in it; ``hashes`` are those, if known."""
    if len(held) < length:
        return np.zeros(0, np.uint64)
    h, width, span = string_hashes(held, anchor) if hashes is None else hashes, length - anchor + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    n = len(held) - length + 1
    return np.minimum(h[:n], h[width - span : width - span + n])


def twin_anchors(held: np.ndarray, keys: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place, place of the next one) of neighbouring anchors with one hash that a window can hold both of, as in periodic text."""
    h, width, span = string_hashes(held, anchor) if hashes is None else hashes, length - anchor + 1, 1
    # an anchor is the least of some window if the largest key of the windows around it is its own hash
    most = np.concatenate([np.zeros(width - 1, np.uint64), keys, np.zeros(width - 1, np.uint64)])
    while 2 * span <= width:
        most = np.maximum(most[:-span], most[span:])
        span *= 2
    n = len(h)
    least = np.flatnonzero(np.maximum(most[:n], most[width - span : width - span + n]) == h)
    near = np.flatnonzero((h[least[1:]] == h[least[:-1]]) & (np.diff(least) <= width))
    return least[near], least[near + 1]


def segments(keys: np.ndarray, most: int = MOST_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of runs of one key, cut into at most ``most`` windows."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.append(0, edges)
    sizes = np.diff(np.append(starts, len(keys)))
    parts = -(-sizes // most)
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(starts, parts) + inner * most, np.minimum(most, np.repeat(sizes, parts) - inner * most)


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Places of ``text`` (symbols below 512, the last one 0 and nowhere else) in the order of the ``length`` symbols from there."""
    n, have = len(text), 7
    padded = np.concatenate([text, np.zeros(have, np.uint16)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(have):
        word = word << np.uint64(9) | padded[k : k + n]
    order = np.argsort(word)
    word = word[order]
    rank = np.empty(n, np.int64)  # the first row of those that are equal so far
    first = np.append(True, word[1:] != word[:-1])
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    rows = np.arange(n)
    while have < length:
        alone = first & np.append(first[1:], True)
        rows = rows[~alone]
        if not len(rows):
            break
        ahead = min(have, length - have)
        places = order[rows]
        # what is not alone ends before the last symbol, so there is a suffix ahead
        word = rank[places] << 32 | rank[places + ahead]
        by = np.argsort(word)
        word, places = word[by], places[by]
        order[rows] = places
        first = np.append(True, word[1:] != word[:-1])
        rank[places] = rows[np.flatnonzero(first)[np.cumsum(first) - 1]]
        have += ahead
    return order


def prefix_edges(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True where the common prefix of a suffix and the one before it in ``order`` is shorter than ``length``.

    Breadth-first backward extension: intervals [low, high] of the strings of one length are extended by each symbol that stands
    before them; an extended interval that is the first to end at its place sets the common prefix there and is kept.
    """
    n = len(text)
    before = text[order - 1]  # the transform; before the first symbol stands the last
    first = text[order]
    by_symbol = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)  # where the suffix that is longer by one symbol stands
    back[by_symbol] = np.arange(n)
    every = np.arange(n)
    is_set = np.zeros(n + 1, bool)
    is_set[[0, n]] = True
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(length):
        if not len(low):
            break
        size = high - low + 1
        alone = size == 1
        single = back[low[alone]]
        low, size = low[~alone], size[~alone]
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) + np.repeat(low - (np.cumsum(size) - size), size)
        # within an interval, rows of one symbol go to neighbouring places
        if 8 * len(rows) > n:
            of_row = np.full(n, -1, np.int32)
            of_row[rows] = owner
            owner, place = of_row[by_symbol], every
        else:
            place = np.sort(owner << 32 | back[rows])
            owner, place = place >> 32, place & 0xFFFFFFFF
        symbol = first[place]
        new = np.append(True, (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])) if len(place) else np.zeros(0, bool)
        ends = np.append(new[1:], True) if len(place) else new
        low = np.concatenate([single, place[new & (owner >= 0)]])
        high = np.concatenate([single, place[ends & (owner >= 0)]])
        fresh = ~is_set[high + 1]
        low, high = low[fresh], high[fresh]
        is_set[high + 1] = True
    return is_set[:n]


def repeated_windows(strings: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, the places whose ``length`` bytes occur at another place of any string, or in one that counts twice.

    ``counts``: how often each string occurs.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    n = int(sizes.sum()) + len(strings)
    text = np.zeros(n + 1, np.uint16)
    at = np.cumsum(sizes + 1) - (sizes + 1)
    whole = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    text[:n] = whole.astype(np.uint16) + 2
    text[at + sizes] = 1  # the end of a string; the end of all is 0
    weight = np.zeros(n + 1, np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    own = np.repeat(at - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    weight[own] = np.repeat(np.minimum(np.array(counts, np.int64), 2), windows)
    order = suffix_order(text, length)
    starts = np.flatnonzero(prefix_edges(text, order, length))
    rows = np.add.reduceat(weight[order], starts)
    repeated = np.zeros(n + 1, bool)
    repeated[order] = np.repeat(rows >= 2, np.diff(np.append(starts, n + 1)))
    repeated &= weight > 0
    found = np.flatnonzero(repeated)
    cuts = np.searchsorted(found, np.append(at, n))
    return [found[cuts[i] : cuts[i + 1]] - at[i] for i in range(len(strings))]


def covered(places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [from, to) of bytes that strings of ``length`` at ascending ``places`` cover, touching ones together."""
    if not len(places):
        return places, places
    apart = np.flatnonzero(places[1:] > places[:-1] + length)
    return places[np.append(0, apart + 1)], places[np.append(apart, len(places) - 1)] + length


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their bytes one after the other, starts, sizes) of runs of about BATCH_BYTES."""
    for batch in batches:
        held = batch.column(column).to_pylist()
        at = 0
        while at < len(held):
            end, size = at, 0
            while end < len(held) and (end == at or size + len(held[end]) <= BATCH_BYTES):
                size += len(held[end])
                end += 1
            sizes = np.array([len(x) for x in held[at:end]], np.int64)
            yield batch.slice(at, end - at), np.frombuffer(b"".join(held[at:end]), np.uint8), np.cumsum(sizes) - sizes, sizes
            at = end


def _key_rows(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(dk, copies, keys, starts, sizes, twins): segments of each distinct text; twins: an anchor of the key's hash may occur twice in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, held, at, sizes in _texts(batches, 1):
            hashes = string_hashes(held, anchor)
            keys = window_keys(held, length, anchor, hashes)
            twin, other = twin_anchors(held, keys, length, anchor, hashes)
            out = []
            for a, size in zip(at.tolist(), sizes.tolist(), strict=True):
                own = keys[a : a + max(0, size - length + 1)]
                first, n = segments(own)
                pair = np.searchsorted(twin, a + first)  # the first pair from the segment's start on
                ends = np.append(other, len(held))[pair]
                out.append((own[first].view(np.int64), first, n, ends + anchor <= a + first + n - 1 + length))
            arrays = [pa.array([x[k] for x in out], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), *arrays], ["dk", "copies", "keys", "starts", "sizes", "twins"])

    return texts.select("dk", "held", "copies").mapInArrow(run, "dk binary, copies long, keys array<long>, starts array<long>, sizes array<long>, twins array<boolean>")


def _cut(placed: DataFrame, length: int) -> DataFrame:
    """(dk, copies, key, start, digest, string): the segments of each text whose key occurs twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                held, live = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                strings = [held[x["start"] : x["start"] + x["size"] + length - 1] for x in live]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * len(live), pa.binary()),
                        pa.array([batch.column(3)[i].as_py()] * len(live), pa.int64()),
                        pa.array([x["key"] for x in live], pa.int64()),
                        pa.array([x["start"] for x in live], pa.int64()),
                        pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in strings], pa.binary()),
                        pa.array(strings, pa.binary()),
                    ],
                    ["dk", "copies", "key", "start", "digest", "string"],
                )

    return placed.select("dk", "held", "live", "copies").mapInArrow(run, "dk binary, copies long, key long, start long, digest binary, string binary")


def _expanded(strings: DataFrame, length: int, block: int) -> DataFrame:
    """(digest, low, high): runs [low, high) of bytes of each string that repeats cover. Strings of a key must be in one partition,
    next to each other; a block ends with a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(some: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
            places = repeated_windows([s for _, s, _ in some], [n for _, _, n in some], length)
            runs = [covered(p, length) for p in places]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d for (d, _, _), (low, _) in zip(some, runs, strict=True) for _ in range(len(low))], pa.binary()),
                    pa.array(np.concatenate([low for low, _ in runs]), pa.int64()),
                    pa.array(np.concatenate([high for _, high in runs]), pa.int64()),
                ],
                ["digest", "low", "high"],
            )

        some, size, last = [], 0, None
        for batch in batches:
            for key, digest, string, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key != last and size >= block:
                    yield done(some)
                    some, size = [], 0
                some.append((digest, string, n))
                size += len(string)
                last = key
        if some:
            yield done(some)

    return strings.select("key", "digest", "string", "n").mapInArrow(run, "digest binary, low long, high long")


def _joined(placed: DataFrame) -> DataFrame:
    """(digest, low, high): the runs of each ``dk``, those that touch or overlap together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                end = -1
                for low, high in sorted((x["low"], x["high"]) for x in runs):
                    if low > end:
                        out.append([digest, low, high])
                    end = out[-1][2] = max(end, high)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64()))], ["digest", "low", "high"])

    return placed.mapInArrow(run, "digest binary, low long, high long")


def repeats(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot_bytes: int = HOT_BYTES, block: int = BLOCK, owned: dict[str, str] | None = None) -> DataFrame:
    """(dk, low, high): runs of bytes of the distinct texts that repeated strings of ``length`` bytes cover; runs may touch.

    ``texts``: (dk, held, copies), a row for each distinct text and how many rows have it. Intermediate tables go once the
    next ones are written; ``owned`` gets the paths of the two that the result reads.
    """
    spark = texts.sparkSession
    owned, own_paths, nearer = {} if owned is None else owned, {}, {}
    marked = materialize(_key_rows(texts, length, anchor), "repeats-anchors", owned=own_paths)
    each = F.explode(F.arrays_zip("keys", "starts", "sizes", "twins")).alias("x")
    listed = marked.select("dk", "copies", each).select("dk", "copies", F.col("x.keys").alias("key"), F.col("x.starts").alias("start"), F.col("x.sizes").alias("size"), F.col("x.twins").alias("twin"))
    # a segment may repeat within itself where two of its anchors have the key's hash
    twice = materialize(listed.groupBy("key").agg(F.sum("copies").alias("n"), F.max("twin").alias("twin")).where("n > 1 or twin").select("key"), "repeats-keys", owned=own_paths)
    live = listed.join(twice.hint("merge"), "key").groupBy("dk").agg(F.collect_list(F.struct("key", "start", "size")).alias("live"))
    cut = materialize(_cut(texts.join(live.hint("merge"), "dk"), length), "repeats-cut", owned=owned)
    discard(spark, [own_paths.pop(name) for name in ("repeats-anchors", "repeats-keys")])

    strings = cut.groupBy("key", "digest", "string").agg(F.sum("copies").alias("n"))
    strings = materialize(strings, "repeats-strings", owned=own_paths)
    sizes = strings.groupBy("key").agg(F.sum(F.octet_length("string")).alias("bytes"), F.count("*").alias("strings"))
    large = (F.col("bytes") > hot_bytes) & (F.col("strings") > MANY) if anchor < length else F.lit(False)
    hot = materialize(sizes.where(large).select("key"), "repeats-hot", owned=own_paths)
    found = _expanded(strings.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key"), length, block)
    if not hot.isEmpty():
        wide = strings.join(hot, "key", "left_semi").select(F.col("digest").alias("dk"), F.col("string").alias("held"), F.col("n").alias("copies"))
        wide = materialize(wide, "repeats-wide", owned=own_paths)
        runs = repeats(wide, length, length - (length - anchor) // NEARER, hot_bytes, block, nearer)
        # many runs of a string meet in one row here, so that shorter ones that touch are one
        found = found.unionByName(_joined(runs.groupBy("dk").agg(F.collect_set(F.struct("low", "high")).alias("runs"))))
    found = materialize(found, "repeats-found", owned=owned)
    discard(spark, [*own_paths.values(), *nearer.values()])
    return cut.select("dk", "digest", "start").join(found.hint("merge"), "digest").select("dk", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))


def _removed(placed: DataFrame) -> DataFrame:
    """(dk, kept, n_bytes, n_removed, n_spans): each distinct text without the bytes of its runs."""
    names = ["dk", "kept", "n_bytes", "n_removed", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for held, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at, parts, spans, end = 0, [], 0, -1
                for low, high in sorted((x["low"], x["high"]) for x in runs or ()):
                    if low > end:
                        parts.append(held[at:low])
                        spans += 1
                    end = max(end, high)
                    at = end
                parts.append(held[at:])
                kept.append(b"".join(parts))
                counts.append((len(held), len(held) - len(kept[-1]), spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))], names)

    return placed.mapInArrow(run, "dk binary, kept binary, n_bytes long, n_removed long, n_spans long")


def _cleaned(docs: DataFrame, length: int, anchor: int, hot_bytes: int, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, dk) of all rows, and what is left of each distinct text."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("held"))
    dk = F.unhex(F.sha2("held", 256)).alias("dk")
    paths: dict[str, str] = {}
    texts = materialize(own.select(dk, "held").groupBy("dk", "held").agg(F.count("*").alias("copies")), "repeats-texts", owned=paths)
    runs = repeats(texts.where(F.octet_length("held") >= length), length, anchor, hot_bytes, block, paths)
    runs = runs.groupBy("dk").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    left = materialize(_removed(texts.select("dk", "held").join(runs.hint("merge"), "dk", "left")), "repeats-left")
    discard(docs.sparkSession, list(paths.values()))
    return own.select("doc_id", dk), left


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot_bytes: int = HOT_BYTES, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans): each text without the bytes that repeated strings cover.

    A byte goes if a string of ``length`` bytes that covers it also starts elsewhere, in the same text or another; repeats are
    judged on the input. Nothing is left of a text of ``length`` bytes or more that occurs twice. Null texts count as empty;
    texts shorter than ``length`` stay. One row for each row of ``docs``, repeats and null ids included; only the two named
    columns are read. What is kept may end within a character, hence bytes.
    """
    if not 0 < anchor <= length:
        raise ValueError("an anchor is a part of a window")
    own, left = _cleaned(docs, length, anchor, hot_bytes, block, id_col, text_col)
    return own.join(left.hint("merge"), "dk").drop("dk")


def op13_repeats(spark, sf_dir: str) -> DataFrame:
    own, left = _cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet"), LENGTH, ANCHOR, HOT_BYTES, BLOCK, "doc_id", "text")
    # the digest is made before texts meet their ids, so that no text moves once more
    left = left.select("dk", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return own.join(left.hint("merge"), "dk").drop("dk")
