"""Near-duplicates by SimHash, with candidates found by pigeonring filtering.

A 64-bit fingerprint is cut into ``SEGMENTS`` segments that form a ring. If two fingerprints differ in at most ``k`` bits,
then from some segment on every chain of consecutive segments keeps within its proportional budget: the first ``l``
segments differ in at most ``floor(l * k / SEGMENTS)`` bits together, for every ``l``. With ``k < SEGMENTS`` the first
segment is equal and the first two differ in at most ``floor(2k / SEGMENTS)`` bits; with at most one, a bit that one side
has and the other lacks. So each fingerprint is filed under (start, two segments) and looked up there as it is and with
each set bit of the second segment cleared: an equi-join of bounded fan-out. Longer chains and then all 64 bits are
checked on the pairs that meet.

Equal fingerprints are grouped first. Where many distinct ones meet under a key, filed or looked up, they are dealt into
blocks, and each pair of blocks gives a spanning forest of its links instead of all pairs; components stay the same. Chains
are checked there too: a pair that breaks a budget at this key meets under another one, or does not link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.components import connected_components
from lattica.functions.storage import materialize

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Lengths of the ring's segments; they add up to 64.
SEGMENTS = (13, 13, 13, 13, 12)
#: Distinct fingerprints under a key, filed or looked up, beyond which blocks are used, and fingerprints of a block.
HOT_KEY, BLOCK = 1024, 1024
#: A fingerprint is common if over one in so many rows has it; so fewer than that many fingerprints are.
COMMON_OF = 10_000
#: Shingles whose bits are unpacked at a time.
BITS_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the word shingles' XXH64 hashes; no words: 0."""
    import xxhash

    words = text.encode().lower().split()  # on bytes: ASCII letters, and exactly the six ASCII white-space bytes
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BITS_AT_ONCE):
        some = hashes[i : i + BITS_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): one row for each input row; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, fp long")


def _low(start: int) -> int:
    """Right shift of the segment number ``start``."""
    return 64 - sum(SEGMENTS[: start + 1])


def _chain_mask(start: int, length: int) -> int:
    """Bits of a chain, as a signed 64-bit integer."""
    mask = 0
    for i in range(start, start + length):
        n = i % len(SEGMENTS)
        mask |= ((1 << SEGMENTS[n]) - 1) << _low(n)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _keys(fp: Column, start: int, lookups: bool) -> list[Column]:
    """Keys of one start: as filed, or all it is looked up by with one bit of the second segment cleared (null if unset)."""
    second = (start + 1) % len(SEGMENTS)
    first = F.shiftrightunsigned(fp, _low(start)).bitwiseAND(F.lit((1 << SEGMENTS[start]) - 1))
    other = F.shiftrightunsigned(fp, _low(second)).bitwiseAND(F.lit((1 << SEGMENTS[second]) - 1))
    key = lambda x: F.lit(start << 40).bitwiseOR(F.shiftleft(first, 20)).bitwiseOR(x)
    if not lookups:
        return [key(other)]
    return [F.when(other.bitwiseAND(F.lit(1 << i)) != 0, key(other.bitwiseAND(F.lit(~(1 << i))))) for i in range(SEGMENTS[second])]


def _within(a: Column, b: Column, start: Column, most: int) -> Column:
    """Every chain from ``start`` keeps its budget; the whole ring is the full Hamming distance."""
    n, differing = len(SEGMENTS), a.bitwiseXOR(b)
    test = F.bit_count(differing) <= most
    for length in range(2, n):
        chain = F.lit(None).cast("long")
        for s in range(n):
            chain = F.when(start == s, F.lit(_chain_mask(s, length))).otherwise(chain)
        test = test & (F.bit_count(differing.bitwiseAND(chain)) <= length * most // n)
    return test


def _block_forest(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    """A spanning forest of the links within one pair of blocks (one block alone: of its own links).

    Rows are filed (``own``) or looked up; a link has a filed end, and every chain from the key's start keeps its budget.
    """
    start, n = int(pdf["key"].iloc[0]) >> 40, len(SEGMENTS)
    filed = np.unique(pdf.loc[pdf["own"], "fp"].to_numpy(np.int64))
    fps = np.unique(pdf["fp"].to_numpy(np.int64))
    at = np.searchsorted(fps, filed)
    masks = [(length * most // n, np.uint64(_chain_mask(start, length) & (1 << 64) - 1)) for length in range(2, n)]
    bits = fps.view(np.uint64)
    up = list(range(len(fps)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    links = []
    for i in at.tolist():
        differing = bits ^ bits[i]
        near = np.arange(len(fps))
        for budget, mask in masks:  # short chains first: few pairs are left for the longer ones
            near = near[np.bitwise_count(differing[near] & mask) <= budget]
        for j in near[np.bitwise_count(differing[near]) <= most].tolist():
            a, b = find(i), find(j)
            if a != b:
                up[b] = a
                links.append((i, j))
    ends = np.array(links, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": fps[ends.min(axis=1)], "b": fps[ends.max(axis=1)]})


def fingerprint_links(distinct: DataFrame, most: int = MOST_BITS, hot_key: int = HOT_KEY, block: int = BLOCK) -> DataFrame:
    """(a, b): links of at most ``most`` differing bits between the distinct values of ``distinct.fp``.

    All of them, except under keys with over ``hot_key`` values, where links that follow from others through a shared
    component may be left out; components are whole.
    """
    n = len(SEGMENTS)
    if not 0 <= most < n or 2 * most // n > 1:
        raise ValueError(f"chains of these segments serve at most {n - 1} differing bits")
    fp = F.col("fp")
    filed = distinct.select("fp", F.explode(F.array(*[k for s in range(n) for k in _keys(fp, s, False)])).alias("key"))
    looked = distinct.select("fp", F.explode(F.array_compact(F.array(*[k for s in range(n) for k in _keys(fp, s, True)]))).alias("key"))
    filed = materialize(filed, "simhash-filed", "lz4")
    both = filed.withColumn("own", F.lit(True)).unionByName(looked.withColumn("own", F.lit(False)))
    sizes = both.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("any_filed")).where((F.col("n") > hot_key) & F.col("any_filed"))
    hot = materialize(sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "simhash-hot")

    start = F.shiftrightunsigned(F.col("key"), 40)
    a, b = filed.join(hot, "key", "left_anti").select("key", F.col("fp").alias("a")), both.select("key", "own", F.col("fp").alias("b"))
    met = a.join(b, "key").where(F.when(F.col("own"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")) & _within(F.col("a"), F.col("b"), start, most))
    plain = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # of B blocks, number i takes part in the pairs (0, i) ... (i, i) ... (i, B - 1)
    dealt = both.join(hot, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = dealt.select("fp", "key", "own", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("x"), F.greatest("i", j).alias("y")))).alias("pair"))
    forest = paired.groupBy("key", "pair").applyInPandas(lambda pdf: _block_forest(pdf, most), "a long, b long")
    return plain.unionByName(forest).distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(doc_id, fp, root, component_id): the component of each row, known by its least fingerprint, and its smallest id."""
    marked = materialize(fingerprints(docs, id_col, text_col), "simhash-docs", "lz4")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows")), "simhash-distinct", "lz4")
    links = materialize(fingerprint_links(distinct.select("fp"), most), "simhash-links", "lz4")
    roots = connected_components(links).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "n_rows", "root", "component_id")
    classes = materialize(classes, "simhash-fp-classes", "lz4")

    # common fingerprints are few by their definition and are sent to all tasks, so that none of them meets in one task
    total = distinct.agg(F.sum("n_rows")).first()[0] or 0
    is_common = F.col("n_rows") * COMMON_OF > total
    found = marked.join(F.broadcast(classes.where(is_common).drop("n_rows").withColumn("common", F.lit(True))), "fp", "left")
    rare = found.where("common is null").select("doc_id", "fp").join(classes.where(~is_common).drop("n_rows"), "fp")
    return found.where("common").drop("common").unionByName(rare)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``most`` differing bits, the own one included;
    equal fingerprints are linked. Null and empty texts share fingerprint 0. Rows with a null id belong to their component; a component of null ids alone has
    a null id.
    """
    every = _classes(docs, id_col, text_col, most)
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """One document of each component stays: the one with the smallest id (of rows of the component that share it, one).

    All columns stay. Documents with a null id stay where their component has no id at all. An id that several rows have is
    judged by row: it may be the one of its component with one text and go with another.
    """
    small = materialize(_classes(docs, "doc_id", "text", most), "simhash-classes", "lz4")
    several = materialize(small.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "simhash-several", "lz4")
    losers = small.where("doc_id != component_id").select("doc_id").distinct()
    same_id = docs["doc_id"].eqNullSafe(several["doc_id"])
    kept = docs.join(losers, "doc_id", "left_anti").join(several, same_id, "left_anti")
    if several.isEmpty():
        return kept

    @F.pandas_udf("long")
    def marks(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or "") for t in texts], np.uint64).view(np.int64))

    fp, root, component = (f"{name} of {'_'.join(docs.columns)}" for name in ("fp", "root", "component"))  # no column of docs
    own = docs.join(several, same_id, "left_semi").withColumn(fp, marks("text"))
    classes = small.select(F.col("doc_id").alias(component + " id"), F.col("fp").alias(fp + " id"), F.col("root").alias(root), F.col("component_id").alias(component)).distinct()
    held = own.join(classes, own["doc_id"].eqNullSafe(classes[component + " id"]) & (own[fp] == classes[fp + " id"]))
    first = held.where(F.col("doc_id") == F.col(component)).dropDuplicates(["doc_id", root])
    nameless = held.where(F.col("doc_id").isNull() & F.col(component).isNull())
    return kept.unionByName(first.unionByName(nameless).select(docs.columns))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
