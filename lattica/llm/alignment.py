"""Alignment of two tokenizers by lockstep merging of token ends.

A text's tokens under A (byte-level BPE, of a space and the text) and under B (SentencePiece, which adds the space itself) cover
the same bytes. Both lists of ends are merged: a pointer stands in each, the one whose token ends first moves on, and where both
end together there is a link of the two tokens and a cut after them. One NumPy state vector holds the pointers of all lanes of a
batch, so that one step moves every lane; finished lanes are taken out. A lane is a document, or a piece of a long one between
two common ends that binary search finds about every ``LANE`` tokens, so the number of steps does not follow the longest text.

How often two ids are linked is counted over the corpus. Linked tokens end together, so the shorter one is a suffix of the
longer, and the pairs there can be follow from the two vocabularies (``possible_pairs``): the table of counts is bounded by these
whatever the corpus, and is sent to all tasks for the second pass, over the links that the first one wrote.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import materialize
from lattica.llm.wordpieces import MARK, model_path

#: Tokens of a lane, about.
LANE = 512
#: Bytes of texts that are merged together, about.
BATCH_BYTES = 2 << 20
#: Steps between compactions of the state vector.
COMPACT = 16
#: Ids of B are the low bits of a pair's code.
B_BITS = 24


def byte_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def unicode_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, and the bytes that their tokens stand for."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            told = json.load(file)
        alphabet = unicode_bytes()
        special = {x["id"] for x in told["added_tokens"]}
        entries = {i: bytes(alphabet[c] for c in entry) for entry, i in told["model"]["vocab"].items() if i not in special}
        # ids follow the order of merges, so they are the ranks; strings of special tokens are plain text
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in entries.items()}, special_tokens={})
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        #: Decimal ids of both with what follows them in a digest, within a group and at its end.
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.written = [f"{i}{end}" for count, ends in ((n, ",|"), (m, ",;")) for end in ends for i in range(count)]

    @staticmethod
    def _piece(piece: str, byte: bool) -> bytes:
        return bytes([int(piece[3:-1], 16)]) if byte else piece.replace(MARK, " ").encode()

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none where a tokenizer's bytes differ from a space and the text, or there is no text."""
        none = np.zeros(0, np.int32)
        out = []
        for text, pieces in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1), strict=True):
            if not text:
                out.append((none, none))
                continue
            whole = b" " + text.encode()
            a, b = np.array(self.a.encode_ordinary(" " + text), np.int32), np.array(pieces, np.int32)
            # lengths first: they differ wherever a marker of B stands in the text
            same = int(self.b_sizes[b].sum()) == int(self.a_sizes[a].sum()) == len(whole) and b"".join(map(self.b_bytes.__getitem__, pieces)) == whole
            same = same and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == whole
            out.append((a, b) if same else (none, none))
        return out

    def groups_text(self, a: np.ndarray, b: np.ndarray, a_places: np.ndarray, b_places: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: ids of both between cuts."""
        if not len(a_places):
            return ""
        n, m = len(self.a_bytes), len(self.b_bytes)
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[a_places] = b_last[b_places] = True
        # a group's A tokens come after the B tokens of the groups before, its B tokens after its own A tokens
        a_sizes, b_sizes = np.diff(a_places, prepend=-1), np.diff(b_places, prepend=-1)
        order = np.empty(len(a) + len(b), np.int32)
        order[np.arange(len(a)) + np.repeat(np.cumsum(b_sizes) - b_sizes, a_sizes)] = a + n * a_last
        order[np.arange(len(b)) + np.repeat(np.cumsum(a_sizes), b_sizes)] = b + 2 * n + m * b_last
        return "".join(map(self.written.__getitem__, order.tolist()))[:-1]

    def possible_pairs(self) -> set[tuple[int, int]]:
        """All (A id, B id) whose tokens can end together: one's bytes are a suffix of the other's."""
        a_by, b_by = {}, {}
        for by, held in ((a_by, self.a_bytes), (b_by, self.b_bytes)):
            for i, x in enumerate(held):
                by.setdefault(x, []).append(i)
        found = {(i, j) for i, x in enumerate(self.a_bytes) for k in range(len(x)) for j in b_by.get(x[k:], ())}
        return found | {(i, j) for j, x in enumerate(self.b_bytes) for k in range(len(x)) for i in a_by.get(x[k:], ())}


@lru_cache(maxsize=1)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def lanes(a_ends: np.ndarray, b_ends: np.ndarray, lane: int = LANE) -> list[tuple[int, int]]:
    """(A tokens, B tokens) before each lane of a document: (0, 0), then common ends at least ``lane`` A tokens apart."""
    found, at = [(0, 0)], lane
    while at < len(a_ends):
        near = a_ends[at - 1 : at - 1 + lane]
        place = np.minimum(np.searchsorted(b_ends, near), len(b_ends) - 1)
        common = np.flatnonzero(b_ends[place] == near)
        if not len(common):
            at += lane
            continue
        at += int(common[0])
        if at < len(a_ends):
            found.append((at, int(place[common[0]]) + 1))
        at += lane
    return found


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of A and B tokens that end together, in the order of A's, of all lanes at once.

    ``a_ends`` and ``b_ends`` hold the ends of all lanes' tokens, a lane's within the two ranges.
    """
    live = (a_from < a_to) & (b_from < b_to)
    x, y, x_to, y_to = a_from[live], b_from[live], a_to[live], b_to[live]
    a_ends, b_ends = np.append(a_ends, 0), np.append(b_ends, 0)  # pointers of finished lanes may stand at the end
    links_a, links_b = [], []
    while len(x):
        for _ in range(COMPACT):
            end_a, end_b = a_ends[x], b_ends[y]
            going = (x < x_to) & (y < y_to)
            a_on, b_on = going & (end_a <= end_b), going & (end_b <= end_a)
            cut = np.flatnonzero(a_on & b_on)
            links_a.append(x[cut])
            links_b.append(y[cut])
            x, y = x + a_on, y + b_on
        going = (x < x_to) & (y < y_to)
        x, y, x_to, y_to = x[going], y[going], x_to[going], y_to[going]
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found_a, found_b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(found_a)
    return found_a[order], found_b[order]


def align(encoded: list[tuple[np.ndarray, np.ndarray]], a_sizes: np.ndarray, b_sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document, the places of A and B tokens that end together."""
    a_ids, b_ids = [a for a, _ in encoded], [b for _, b in encoded]
    a_at, b_at = np.cumsum([0, *map(len, a_ids)]), np.cumsum([0, *map(len, b_ids)])
    a_ends = [np.cumsum(a_sizes[x]) for x in a_ids]
    b_ends = [np.cumsum(b_sizes[x]) for x in b_ids]
    starts = [(d, i, j) for d in range(len(encoded)) for i, j in lanes(a_ends[d], b_ends[d])]
    doc, i, j = np.array(starts, np.int64).reshape(-1, 3).T
    a_from, b_from = a_at[doc] + i, b_at[doc] + j
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    a_to = np.where(last, a_at[doc + 1], np.append(a_from[1:], 0))
    b_to = np.where(last, b_at[doc + 1], np.append(b_from[1:], 0))
    none = [np.zeros(0, np.int64)]
    found_a, found_b = lockstep(np.concatenate(a_ends or none), np.concatenate(b_ends or none), a_from, a_to, b_from, b_to)
    cuts = np.searchsorted(found_a, a_at)
    return [(found_a[cuts[d] : cuts[d + 1]] - a_at[d], found_b[cuts[d] : cuts[d + 1]] - b_at[d]) for d in range(len(encoded))]


def _batches(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about BATCH_BYTES."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text or "")
        if size >= BATCH_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _aligned(batches: Iterator[pa.RecordBatch], pair: Pair) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]]:
    """(document ids, ids of both tokenizers, places that link) of runs of rows of (id, text)."""
    for batch in batches:
        at = 0
        for texts in _batches(batch.column(1).to_pylist()):
            encoded = pair.encode(texts)
            yield batch.column(0).slice(at, len(texts)), encoded, align(encoded, pair.a_sizes, pair.b_sizes)
            at += len(texts)


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, a_ids, b_ids, a_ends, b_ends): ids of both tokenizers and places of the tokens that link.

    Arrays are little-endian unsigned 32-bit integers; a text without tokens (null, empty, or one that a tokenizer does not give
    back) has empty ones. One row for each row of ``docs``; only the two named columns are read.
    """
    paths = a_path or byte_path(), b_path or model_path()
    names = ["doc_id", "n_a", "n_b", "n_groups", "a_ids", "b_ids", "a_ends", "b_ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, encoded, places in _aligned(batches, _pair(*paths)):
            arrays = zip(*[(a, b, p, q) for (a, b), (p, q) in zip(encoded, places, strict=True)], strict=True)
            counts = [[len(a) for a, _ in encoded], [len(b) for _, b in encoded], [len(p) for p, _ in places]]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in counts), *(pa.array([x.astype("<u4").tobytes() for x in column], pa.binary()) for column in arrays)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, a_ids binary, b_ids binary, a_ends binary, b_ends binary")


def link_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << B_BITS | b


def linked(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, links, groups_sha256): the linked id pairs of each document as 64-bit codes, and its digest."""
    paths = a_path or byte_path(), b_path or model_path()
    names = ["doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*paths)
        for ids, encoded, places in _aligned(batches, pair):
            links = [link_codes(a[p], b[q]).astype("<i8").tobytes() for (a, b), (p, q) in zip(encoded, places, strict=True)]
            digests = [hashlib.sha256(pair.groups_text(a, b, p, q).encode()).hexdigest() if len(a) else "" for (a, b), (p, q) in zip(encoded, places, strict=True)]
            counts = [[len(a) for a, _ in encoded], [len(b) for _, b in encoded], [len(p) for p, _ in places]]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in counts), pa.array(links, pa.binary()), pa.array(digests, pa.string())], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, links binary, groups_sha256 string")


def pair_counts(links: DataFrame) -> DataFrame:
    """(a_id, b_id, n): how many links of the corpus hold each pair; at most ``len(Pair.possible_pairs())`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")
            found, n = np.unique(more, return_counts=True)
            every = np.concatenate([codes, found])
            codes, at = np.unique(every, return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["code", "n"])

    summed = links.select("links").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return summed.select(F.shiftright("code", B_BITS).alias("a_id"), F.col("code").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b_id"), "n")


def tokenizer_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a digest of each document's alignment.

    ``n_best`` counts links whose pair is the most frequent of its B id in the corpus, ties included; ``count_sum`` adds the
    counts of all links. Texts without tokens have zeros and an empty digest. Repeated rows count as documents of their own.
    """
    links = materialize(linked(docs, a_path, b_path, id_col, text_col), "alignment")
    table = pair_counts(links).toPandas()  # bounded by the vocabularies
    codes = link_codes(table["a_id"].to_numpy(np.int64), table["b_id"].to_numpy(np.int64))
    order = np.argsort(codes)
    counts = table["n"].to_numpy(np.int64)
    highest = table.groupby("b_id")["n"].transform("max").to_numpy(np.int64)
    shared = links.sparkSession.sparkContext.broadcast((codes[order], counts[order], (counts == highest)[order]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = shared.value
        for batch in batches:
            held = [np.searchsorted(codes, np.frombuffer(x, "<i8")) for x in batch.column(4).to_pylist()]
            made = [[len(x) for x in held], [int(best[x].sum()) for x in held], [int(counts[x].sum()) for x in held]]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *(pa.array(x, pa.int64()) for x in made), batch.column(5)], names)

    return links.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    return tokenizer_alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
