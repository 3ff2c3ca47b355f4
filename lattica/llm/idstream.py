"""Token ids in files: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in descending corpus frequency, so common ids take one byte. A rank takes 1 to 4 bytes;
four 2-bit lengths share a control byte, and control and data bytes are kept apart, so a block is decoded by table
lookup and a running sum without looking at single values.

A file holds blocks of documents in ascending order of id. Blocks are rows of Parquet files (binary columns ``control``
and ``data``), so that Spark's committer and any store that Spark writes hold them; a lost executor's blocks are written
anew. Files are numbered by ``shard``, and shards follow each other in id order. The table of ids by rank is written beside
the blocks (folders ``blocks`` and ``ranks``), so a folder alone is enough to read the ids.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.storage import materialize, scratch_path

#: Entries of a worker's tables of distinct words, and of distinct lower-case words without what follows them.
TABLE_WORDS, TABLE_CORES = 600_000, 400_000
#: Words longer than this are encoded but not kept in the table.
KEPT_WORD_CHARS = 64
#: Id appended to each document.
END_ID = 1
#: Documents of a block at most, and ids after which a block is closed.
BLOCK_DOCS, BLOCK_IDS = 1024, 1 << 20

#: Lengths of the four values that a control byte announces.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTable(dict):
    """Ids of words as bytes, made when first asked for; starts anew when full.

    A word of Latin letters with punctuation after it is lower-cased and cut as the tokenizer does it, so that ``Word``,
    ``word,`` and ``word.`` share the work of one segmentation.
    """

    _PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)").fullmatch

    def __init__(self, path: str, words: int = TABLE_WORDS, cores: int = TABLE_CORES):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.most_cores = words, cores
        self.cores: dict[str, bytes] = {}
        self.kind = id_kind(self.tokenizer.get_vocab_size())
        self._form = "<%dH" if self.kind == "<u2" else "<%dI"
        # a core is one pre-token, so its bytes' letters go to the model at once
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._letters = {c: as_bytes(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self._model = self.tokenizer.model.tokenize

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(self._form % len(ids), *ids)

    def _segment(self, word: str) -> bytes:
        return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _core(self, core: str) -> bytes:
        ids = self.cores.get(core)
        if ids is None:
            ids = self._packed([t.id for t in self._model(core if core.isascii() else core.translate(self._letters))])
            if len(self.cores) >= self.most_cores:
                self.cores.clear()
            if len(core) <= KEPT_WORD_CHARS:
                self.cores[core] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if not word:
            ids = b""
        elif plain := self._PLAIN(word):
            ids = self._core(plain[1].lower()) + (self._core(plain[2]) if plain[2] else b"")
        else:
            ids = self._segment(word)
        if len(self) >= self.words:
            self.clear()
        if len(word) <= KEPT_WORD_CHARS:
            self[word] = ids
        return ids


def id_kind(vocabulary: int) -> str:
    """Number format of ids in memory and in tables before ranking."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class WordEncoder:
    """Ids of a text by a bounded table of distinct words.

    The tokenizer's pattern drops white space and never crosses it, and normal forms do not compose across it, so the
    words between spaces, tabs and line ends are independent.
    """

    def __init__(self, path: str, words: int = TABLE_WORDS, cores: int = TABLE_CORES):
        self.table = WordTable(path, words, cores)

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.table.__getitem__, words))


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    lengths = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = lengths - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values that ``pack`` stored."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    starts = ends - lengths
    out = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        out[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_words(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(id, ids binary in the tokenizer's ``id_kind``, end id included); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.array([end_id], encoder.table.kind).tobytes()
        for batch in batches:
            ids = pa.array([encoder.encode(t or "") + end for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, ids binary")


def rank_by_frequency(encoded: DataFrame, kind: str) -> np.ndarray:
    """Ids in descending order of their count over all documents (ties: the smaller id first).

    Counts are summed per task before the shuffle; the result has one entry for each id in use, so it is bounded by
    the vocabulary.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            if len(got) > len(total):
                total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
            total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["token", "n"])

    counts = encoded.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "token"], ascending=[False, True])["token"].to_numpy(np.uint32)


def write_blocks(encoded: DataFrame, by_rank: np.ndarray, kind: str, path: str) -> None:
    """Blocks in ascending order of document id, and the table of ids by rank, written to a folder.

    Columns of ``blocks``: shard, block, offset (ids of the shard before this block), n_ids, doc_ids, lengths, control, data;
    of ``ranks``: rank, token. Rows are dealt by range of document id, so a shard follows the one before; of rows with the same
    id the order is that of their ids' hash, then of the ids themselves.
    """
    width = np.dtype(kind).itemsize
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    names = ["shard", "block", "offset", "n_ids", "doc_ids", "lengths", "control", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, offset = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal block, offset, ids, parts
            control, data = pack(rank[np.frombuffer(b"".join(parts), kind)])
            lengths = np.array([len(p) // width for p in parts], np.int64)
            row = [[shard], [block], [offset], [int(lengths.sum())], [ids], [lengths], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            ids, parts, block, offset = [], [], block + 1, offset + int(lengths.sum())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        held = 0
        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                parts.append(own)
                held += len(own) // width
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_IDS:
                    yield close()
                    held = 0
        if ids:
            yield close()

    order = [F.col("doc_id"), F.xxhash64("ids"), F.col("ids")]
    dealt = encoded.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    blocks = dealt.mapInArrow(run, "shard int, block int, offset long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary")
    blocks.write.parquet(f"{path}/blocks")
    ranks = pd.DataFrame({"rank": np.arange(len(by_rank)), "token": by_rank.astype(np.int64)})
    encoded.sparkSession.createDataFrame(ranks, "rank long, token long").coalesce(1).write.parquet(f"{path}/ranks")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) decoded from the files of a folder that ``write_blocks`` has written.

    ``start`` counts the ids of all documents before. The table of ranks, bounded by the vocabulary, and shards' sums, one
    number each, go through the driver; the payload is read once, without a shuffle.
    """
    ranks = spark.read.schema("rank long, token long").parquet(f"{path}/ranks").orderBy("rank").toPandas()
    by_rank = ranks["token"].to_numpy(np.uint32)
    blocks = spark.read.schema("shard int, block int, offset long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary").parquet(f"{path}/blocks")
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    ends = np.cumsum([r.n for r in sums])
    first = {r.shard: int(end - r.n) for r, end in zip(sums, ends, strict=True)}
    values = by_rank.astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ids = values[unpack(row["control"], row["data"], int(lengths.sum()))]
                ends = np.cumsum(lengths)
                starts = first[row["shard"]] + row["offset"] + ends - lengths
                own = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def store_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode, rank, write to ``folder`` (none: a new one in the shared folder) and read back: (doc_id, start, n_tokens, ids).

    One row for each row of ``docs``; rows with the same id follow each other in the order of their ids' hash, null ids come
    first, null texts hold the end id alone, and an empty table gives none.
    """
    from tokenizers import Tokenizer

    path = path or tokenizer_path()
    kind = id_kind(Tokenizer.from_file(path).get_vocab_size())
    encoded = materialize(encode_words(docs, path, id_col, text_col), "ids", "lz4")
    by_rank = rank_by_frequency(encoded, kind)
    folder = folder or scratch_path(docs.sparkSession, "id-stream")
    write_blocks(encoded, by_rank, kind, folder)
    return read_blocks(docs.sparkSession, folder)


def with_checksums(stored: DataFrame) -> DataFrame:
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_idstream(spark, sf_dir: str) -> DataFrame:
    return with_checksums(store_ids(spark.read.parquet(f"{sf_dir}/documents.parquet")))
