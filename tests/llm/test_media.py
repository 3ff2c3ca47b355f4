from __future__ import annotations

import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from lattica.llm import media as M


def by_cells(image, height, width):
    """Area means by summing every sample's share of every target cell."""
    def shares(n, m):
        return np.array([[max(0, min((i + 1) * n / m, j + 1) - max(i * n / m, j)) for j in range(n)] for i in range(m)])
    a, b = shares(image.shape[0], height), shares(image.shape[1], width)
    return a @ image @ b.T / (image.shape[0] * image.shape[1] / height / width)


@pytest.mark.parametrize("shape", [(1, 1), (1, 64), (3, 7), (64, 64), (19, 33)])
def test_area_resize_against_cells(shape):
    image = np.random.default_rng(1).integers(0, 256, shape)
    for target in [(8, 9), (16, 16), (1, 1)]:
        assert np.allclose(M.area_resize(image, *target), by_cells(image, *target))


def test_formats_round_trip():
    g = np.random.default_rng(2).integers(0, 256, (5, 7)).astype(np.uint8)
    assert (M.decode_image(M.encode_pgm(g)) == g).all()
    assert (M.decode_image(M.encode_bmp(g)) == g).all()
    assert (M.decode_image(b"P2 # c\n7 5\n255\n" + b" ".join(str(v).encode() for v in g.ravel())) == g).all()
    rgb = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    assert (M.decode_image(b"P6\n3 2\n255\n" + rgb.tobytes()) == rgb).all()
    assert (M.decode_image(b"P1\n3 2\n0 1 0\n1 1 1\n") == [[255, 0, 255], [0, 0, 0]]).all()
    assert (M.decode_image(b"P4\n3 2\n" + bytes([0b01000000, 0b11100000])) == [[255, 0, 255], [0, 0, 0]]).all()
    assert (M.decode_image(b"P5\n2 1\n65535\n\x01\x02\x03\x04") == [[258, 772]]).all()
    for bad in (b"", b"P5\n4 4\n255\n12", b"BM", b"P9 1 1 1 "):
        with pytest.raises(ValueError):
            M.decode_image(bad)


def test_documents(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("media", T.StringType())])
    texts = {0: "", 1: None, 2: "a", 3: "x" * 64, 4: "ä" * 5000, 5: "x" * 65, 6: "x" * 64, 7: "\x00 end\x00"}
    docs = spark.createDataFrame([(k, v, "m") for k, v in texts.items()] + [(2, "a", None)], schema)
    got = M.media_digests(M.store_payloads(docs)).collect()
    assert len(got) == 9
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        assert np.load(io.BytesIO(r.tile)).shape == (16, 16)
    by = {r.doc_id: (r.feature, r.media_sha256) for r in got}
    assert by[3] == by[6] and by[0] == by[1] and by[2] != by[3]
    assert M.media_digests(M.store_payloads(docs.limit(0))).count() == 0


def test_bad_images_are_told(spark):
    rows = [(1, bytearray(M.encode_bmp(np.eye(4)))), (2, bytearray(b"junk")), (3, None)]
    images = spark.createDataFrame(rows, "image_id long, media binary")
    got = {r.image_id: r for r in M.tile_images(images, keep_samples=True).collect()}
    assert got[1].error is None and got[1].samples == np.eye(4, dtype=np.uint8).tobytes()
    assert got[2].tile is None and got[3].error


def test_malformed_images_are_refused_in_time():
    """Truncated, altered and random bytes give an image or a ValueError, and soon."""
    import random
    import time

    grey = np.arange(60, dtype=np.uint8).reshape(6, 10)
    whole = [M.encode_pgm(grey), M.encode_bmp(grey), b"P1\n2 2\n0 1 1 0\n", b"P2 2 1 255 3 4 ", b"P3\n1 1\n65535\n1 2 3\n", b"P4\n9 1\n\xff\x80", b"P6 1 1 255 abc"]
    rng, began = random.Random(8), time.monotonic()
    for blob in whole:
        assert M.decode_image(blob).size
        tries = [blob[:i] for i in range(len(blob))][:200]
        for _ in range(200):
            x = bytearray(blob)
            for _ in range(rng.randrange(1, 4)):
                x[rng.randrange(min(len(x), 60))] = rng.randrange(256)
            tries.append(bytes(x))
        for x in tries:
            try:
                assert M.decode_image(x).size
            except ValueError:
                pass
    bad = [b"P5" + b"\n" * 100_000 + b"x", b"P5" + b"# a\n" * 50_000, b"P5 0 0 255 ", b"P5 99999 99999 255 x", b"P2 1 1 255 300 ", b"P2 1 1 255 -3 ", b"P5 1 1 70000 ab", b"P2 1 1 255 " + b"9" * 5000, b"", b"P", b"BM" + bytes(100), b"P5 1 1 7 \x09", b"P1 2 1 02"]
    for x in bad:
        with pytest.raises(ValueError):
            M.decode_image(x)
    assert time.monotonic() - began < 20


def test_malformed_images_in_a_table(spark):
    rows = [(1, b"P5 0 0 255 "), (2, b"P2 1 1 255 300 "), (3, None), (4, b""), (5, M.encode_pgm(np.zeros((2, 2), np.uint8)))]
    got = {r.id: r for r in M.tile_images(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert all(got[i].error and got[i].tile is None for i in (1, 2, 3, 4)) and got[5].error is None and got[5].height == 2


def test_payloads_beyond_the_bound_are_read(monkeypatch):
    monkeypatch.setattr(M, "MOST_SAMPLES", 100)
    samples = np.arange(64 * 6, dtype=np.uint8).reshape(-1, 64)
    for blob in (M.encode_pgm(samples), M.encode_bmp(samples)):
        assert np.array_equal(M.decode_image(blob), samples)
    with pytest.raises(ValueError):
        M.decode_image(b"P4 64 64 " + bytes(512))
