"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral images, stored as NPY tiles.

Decoders and writers work on one image's bytes. ``store_payloads`` lays texts out as 8-bit grey images and writes them,
``tile_images`` reads stored images back and makes an NPY tile and a difference hash of each.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import materialize

#: Samples of a row of a payload image, and bytes that payloads are padded to.
ROW = 64
#: Rows and columns of a tile.
TILE = 16
#: Samples of an image at most, unless its file has a byte for each: what a header claims must not size memory beyond its bytes.
MOST_SAMPLES = 1 << 28


def _netpbm_head(blob: bytes) -> tuple[int, list[int], int]:
    """(kind, the header's numbers, where the samples begin), read token by token."""
    if len(blob) < 2 or blob[:1] != b"P" or blob[1] not in b"123456":
        raise ValueError("no Netpbm header")
    kind, numbers, at = blob[1] - 48, [], 2
    for _ in range(2 if kind in (1, 4) else 3):
        spaced = False
        while at < len(blob) and (blob[at] in b" \t\r\n\v\f" or blob[at] == 35):
            spaced = True
            if blob[at] == 35:
                end = blob.find(b"\n", at)
                at = len(blob) if end < 0 else end
            else:
                at += 1
        end = at
        while end < len(blob) and end - at < 10 and 48 <= blob[end] < 58:
            end += 1
        if not spaced or end == at:
            raise ValueError("no Netpbm header")
        numbers.append(int(blob[at:end]))
        at = end
    if at >= len(blob) or blob[at] not in b" \t\r\n\v\f":
        raise ValueError("no white space after the header")
    return kind, numbers, at + 1


def _sized(blob: bytes, width: int, height: int, colours: int = 1) -> int:
    """Samples of an image; refuses empty and huge ones."""
    n = width * height * colours
    if width <= 0 or height <= 0 or n > max(MOST_SAMPLES, len(blob)):
        raise ValueError(f"no image of {width} x {height}")
    return n


def _bytes_at(blob: bytes, start: int, n: int) -> np.ndarray:
    if start < 0 or start + n > len(blob):
        raise ValueError("image is cut short")
    return np.frombuffer(blob, np.uint8, n, start)


def decode_netpbm(blob: bytes) -> np.ndarray:
    """P1 to P6: (height, width) or (height, width, 3) of uint8, or uint16 where the largest value is above 255.

    Bitmaps give 0 for black and 255 for white. Raises ValueError for what is not such an image or is cut short.
    """
    kind, numbers, at = _netpbm_head(blob)
    width, height, colours = numbers[0], numbers[1], 3 if kind in (3, 6) else 1
    n = _sized(blob, width, height, colours)
    if kind == 4:
        row = -(-width // 8)
        bits = np.unpackbits(_bytes_at(blob, at, row * height).reshape(height, row), axis=1)[:, :width]
        return ((1 - bits) * 255).astype(np.uint8)
    plain = re.sub(rb"#[^\n]*", b"", blob[at:]) if kind < 4 else b""
    if kind == 1:
        digits = b"".join(plain.split())[:n]
        if len(digits) < n or digits.strip(b"01"):
            raise ValueError("bits are missing or not 0 and 1")
        return ((49 - np.frombuffer(digits, np.uint8).reshape(height, width)) * 255).astype(np.uint8)
    most = numbers[2]
    if not 0 < most < 65536:
        raise ValueError("no largest value")
    kept = np.uint8 if most < 256 else np.uint16
    if kind in (2, 3):
        words = plain.split()[:n]
        if len(words) < n or not all(w.isdigit() and len(w) < 10 for w in words):
            raise ValueError("samples are missing or no numbers")
        values = np.array([int(w) for w in words], np.int64)
    elif most < 256:
        values = _bytes_at(blob, at, n)
    else:
        values = _bytes_at(blob, at, 2 * n).view(">u2")
    if values.max() > most:
        raise ValueError("a sample is above the largest value")
    return values.astype(kept).reshape((height, width) if colours == 1 else (height, width, 3))


def encode_pgm(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + grey.astype(np.uint8).tobytes()


def encode_bmp(grey: np.ndarray) -> bytes:
    """8 bits a sample with a grey palette, bottom row first, rows padded to 4 bytes."""
    height, width = grey.shape
    row = -(-width // 4) * 4
    rows = np.zeros((height, row), np.uint8)
    rows[:, :width] = grey[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start, size = 54 + 1024, row * height
    field = lambda n, v: int(v).to_bytes(n, "little", signed=v < 0)
    head = b"BM" + field(4, start + size) + bytes(4) + field(4, start)
    info = field(4, 40) + field(4, width) + field(4, height) + field(2, 1) + field(2, 8) + field(4, 0) + field(4, size) + field(4, 2835) * 2 + field(4, 256) + field(4, 0)
    return head + info + palette.tobytes() + rows.tobytes()


def decode_bmp(blob: bytes) -> np.ndarray:
    """Uncompressed BMP of 8, 24 or 32 bits: (height, width) where the palette is grey, else (height, width, 3) in RGB."""
    if blob[:2] != b"BM" or len(blob) < 54:
        raise ValueError("no BMP header")
    at = lambda i, n: int.from_bytes(blob[i : i + n], "little", signed=n == 4)
    start, header, width, height, depth, packing, used = at(10, 4), at(14, 4), at(18, 4), at(22, 4), at(28, 2), at(30, 4), at(46, 4)
    if packing or depth not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("only uncompressed images of 8, 24 or 32 bits are read")
    _sized(blob, width, abs(height), depth // 8)
    row = -(-width * depth // 32) * 4
    rows = _bytes_at(blob, start, row * abs(height)).reshape(abs(height), row)
    rows = rows[::-1] if height > 0 else rows
    if depth > 8:
        return rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[:, :, 2::-1]
    if not 0 <= used <= 256:
        raise ValueError("no palette")
    palette = _bytes_at(blob, 14 + header, 4 * (used or 256)).reshape(-1, 4)
    samples = rows[:, :width]
    if samples.max() >= len(palette):
        raise ValueError("a sample is not in the palette")
    if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all():
        return palette[:, 0][samples]
    return palette[:, 2::-1][samples]


def decode_image(blob: bytes) -> np.ndarray:
    return decode_bmp(blob) if blob[:2] == b"BM" else decode_netpbm(blob)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a colour image; a grey one as it is."""
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def _sums_at(sums: np.ndarray, n: int) -> np.ndarray:
    """``n`` equal steps' differences of running sums along the first axis, fractional edges interpolated."""
    edges = np.linspace(0, len(sums) - 1, n + 1)
    low = np.minimum(edges.astype(np.int64), len(sums) - 2)
    part = (edges - low).reshape(-1, *[1] * (sums.ndim - 1))
    return np.diff(sums[low] + (sums[low + 1] - sums[low]) * part, axis=0)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target sample, from the integral image (exact for fractional areas)."""
    integral = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])
    areas = _sums_at(_sums_at(integral, height).T, width).T
    return areas * (height * width / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 areas is darker than the one to its right."""
    small = np.round(area_resize(image, 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def payload(text: str) -> tuple[bytes, int]:
    """(UTF-8 padded with zero bytes to a positive multiple of ``ROW``, bytes before padding)."""
    raw = text.encode()
    return raw + bytes(-len(raw) % ROW or (0 if raw else ROW)), len(raw)


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "media") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a grey image of ``ROW`` columns, written to the shared folder and read back.

    An even number of rows is stored as PGM, an odd one as BMP, so equal texts have equal images. A null text is stored as
    an empty one; one row for each input row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, sizes = [], []
            for text in batch.column(1).to_pylist():
                raw, n = payload(text or "")
                samples = np.frombuffer(raw, np.uint8).reshape(-1, ROW)
                media.append((encode_bmp if len(samples) % 2 else encode_pgm)(samples))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return materialize(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary"), name)


def tile_images(images: DataFrame, media_col: str = "media", tile: int = TILE, keep_samples: bool = False) -> DataFrame:
    """``images`` with height, width, tile (NPY bytes), dhash (16 hex digits) and error in place of ``media_col``.

    ``keep_samples`` adds the decoded samples' bytes as ``samples``. What cannot be decoded (null included) has nulls and
    the reason in ``error``.
    """
    kept = [c for c in images.columns if c not in {media_col, "height", "width", "tile", "dhash", "error", "samples"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob in batch.column(len(kept)).to_pylist():
                try:
                    image = decode_image(blob or b"")
                    shades = grey(image)
                    small = np.clip(np.round(area_resize(shades, tile, tile)), 0, 65535).astype(image.dtype)
                    rows.append((*image.shape[:2], npy_bytes(small), f"{difference_hash(shades):016x}", None, image.tobytes() if keep_samples else None))
                except ValueError as e:
                    rows.append((None, None, None, None, str(e), None))
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.binary()]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + made[: 5 + keep_samples], [*kept, "height", "width", "tile", "dhash", "error", "samples"][: len(kept) + 5 + keep_samples])

    schema = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in kept) + ", height int, width int, tile binary, dhash string, error string" + ", samples binary" * keep_samples
    return images.select(*kept, media_col).mapInArrow(run, schema)


def media_digests(stored: DataFrame, name: str = "tiles") -> DataFrame:
    """Digests of stored payload images, from their bytes read back, with the tiles written to the shared folder.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, tile).
    ``feature`` is the difference hash and the tile's SHA-256 prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob in batch.column(2).to_pylist():
                image = decode_image(blob)
                raw = image.tobytes()
                tile = npy_bytes(np.round(area_resize(image, TILE, TILE)).astype(np.uint8))
                feature = f"{difference_hash(image):016x}:{hashlib.sha256(tile).hexdigest()[:16]}"
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-ROW:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, tile))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return materialize(stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema), name)


def op5_media(spark, sf_dir: str) -> DataFrame:
    return media_digests(store_payloads(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("tile")
