"""SentencePiece encoding and decoding by a table of distinct chunks.

When no piece of a model holds a non-marker before a marker (U+2581), no merge can cross the start of a marker run, so a
text falls into chunks that are segmented independently. Each distinct chunk is segmented once; the ids of a text are
the ids of its chunks, joined by position. A line feed that occurs in no piece of several characters is a boundary too.

The table is held by each Python worker and bounded (``TABLE_CHUNKS`` entries; it starts anew when full). Joining ids
back by a shuffle of (document, position, chunk) would move every word of the corpus twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Entries of a worker's table of distinct chunks.
TABLE_CHUNKS = 400_000
#: Chunks longer than this are segmented but not kept.
KEPT_CHUNK_CHARS = 64


class ChunkEncoder:
    """Encodes texts exactly as ``encode(text, add_bos=True, add_eos=True)`` of the model does."""

    def __init__(self, model_path: str, table_chunks: int = TABLE_CHUNKS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.limit = table_chunks
        self.table: dict[str, bytes] = {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Both must hold for chunks to be independent; else whole texts are one chunk.
        self.chunked = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.encode("  a") != self.model.encode("a")
        feed = not any("\n" in p for p in pieces)
        self.split = re.compile(f"{MARK}+[^{MARK}\n]*|\n+[^{MARK}\n]*" if feed else f"{MARK}+[^{MARK}]*").findall
        self.begin = np.array([self.model.bos_id()], "<u4").tobytes()
        self.end = np.array([self.model.eos_id()], "<u4").tobytes()

    def _segment(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; the model itself puts one marker before what it is given."""
        marked = self.model.encode([c[1:] if c[0] == MARK else c for c in chunks], num_threads=1)
        marked = [ids or [self.model.piece_to_id(MARK)] for ids in marked]  # nothing follows a lone marker
        return [np.array(ids if c[0] == MARK else ids[1:], "<u4").tobytes() for c, ids in zip(chunks, marked, strict=True)]

    def encode(self, text: str) -> bytes:
        """Ids with begin and end as little-endian unsigned 32-bit integers."""
        if not text:
            return self.begin + self.end
        if not self.chunked:
            return self.begin + np.array(self.model.encode(text, num_threads=1), "<u4").tobytes() + self.end
        chunks = self.split(MARK + text.replace(" ", MARK))
        table = self.table
        if new := [c for c in set(chunks) if c not in table]:
            if len(table) + len(new) > self.limit:
                table.clear()
                new = list(set(chunks))
            for chunk, ids in zip(new, self._segment(new), strict=True):
                table[chunk] = ids
        body = b"".join(map(table.__getitem__, chunks))
        for chunk in [c for c in new if len(c) > KEPT_CHUNK_CHARS]:
            del table[chunk]
        return self.begin + body + self.end

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=1)
def _encoder(model_path: str) -> ChunkEncoder:
    return ChunkEncoder(model_path)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): every text's ids, begin and end included; a null text counts as empty.

    One row for each row of ``docs``, repeats included; only the two named columns are read.
    """
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode
        for batch in batches:
            ids = [encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode_pieces(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text): the texts that ids stand for, by the model's ``decode``."""
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(path).decode
        for batch in batches:
            texts = [decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def piece_round_trip(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text encoded and decoded in one pass: (id, n_tokens, ids_sha256, decoded_sha256, n_chars_decoded).

    Null texts count as empty; an empty text has the begin and end ids alone. One row for each input row.
    """
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _encoder(path)
        for batch in batches:
            counts, hashes, texts, chars = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = pieces.encode(text or "")
                decoded = pieces.decode(ids)
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                texts.append(hashlib.sha256(decoded.encode()).hexdigest())
                chars.append(len(decoded))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string()), pa.array(chars, pa.int64())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_chars_decoded"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars_decoded long")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return piece_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
