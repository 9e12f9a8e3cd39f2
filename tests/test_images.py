"""Image source + hashes (IO5, IMG1): self-consistent pHash/dHash and Hamming."""

import struct
import zlib

from pyspark.sql import functions as F

from pairlens import functions as PF
from pairlens.operators.images import attach_image_hashes, image_hashes
from pairlens.sources.images import read_images


def _png(path, w, h, pixel):
    raw = b"".join(b"\x00" + b"".join(bytes(pixel(x, y)) for x in range(w)) for y in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)
    png = (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
           + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    path.write_bytes(png)


def test_image_hashes(spark, tmp_path):
    d = tmp_path / "img"
    d.mkdir()
    _png(d / "a.png", 64, 48, lambda x, y: (x * 4 % 256, y * 5 % 256, 80))
    _png(d / "a_copy.png", 64, 48, lambda x, y: (x * 4 % 256, y * 5 % 256, 80))
    _png(d / "b.png", 64, 48, lambda x, y: (255 - x * 4 % 256, (x * y) % 256, 200))
    (d / "broken.png").write_bytes(b"not an image")
    h = {r.url.rsplit("/", 1)[-1]: r for r in image_hashes(read_images(spark, str(d))).collect()}
    assert set(h) == {"a.png", "a_copy.png", "b.png"}
    assert h["a.png"].phash == h["a_copy.png"].phash and len(h["a.png"].phash) == 16
    df = spark.createDataFrame([(h["a.png"].phash, h["a_copy.png"].phash, h["b.png"].phash)], "x string, y string, z string")
    r = df.select(PF.hamming_pct("x", "y").alias("same"), PF.hamming_pct("x", "z").alias("diff")).first()
    assert r.same == 100.0 and 0.0 <= r.diff < 100.0

    rec = spark.createDataFrame([("p1", "link_1", [h["b.png"].url, "http://missing/x.png", h["a.png"].url])],
                                "pair_id string, link_key string, urls array<string>")
    rec = rec.select("pair_id", "link_key", F.struct(F.col("urls").alias("image_urls")).alias("raw"))
    out = attach_image_hashes(rec, image_hashes(read_images(spark, str(d)))).first()
    assert [x.phash for x in out.image_hashes] == [h["b.png"].phash, h["a.png"].phash]


def test_resize_equals_cell_means():
    import numpy as np

    from pairlens.operators.images import _gray, _resize, _summed
    rng = np.random.default_rng(1)
    for h, w, c in ((3, 5, 3), (64, 64, 1), (97, 33, 4), (200, 301, 3), (1, 1, 1)):
        data = rng.integers(0, 256, (h, w, c), dtype=np.uint8)
        grey = data[..., 0] * 1.0 if c == 1 else data[..., 2] * 0.299 + data[..., 1] * 0.587 + data[..., 0] * 0.114
        ys, xs = np.linspace(0, h, 9), np.linspace(0, w, 10)
        want = np.array([[grey[int(ys[i]):max(int(np.ceil(ys[i + 1])), int(ys[i]) + 1),
                               int(xs[j]):max(int(np.ceil(xs[j + 1])), int(xs[j]) + 1)].mean() for j in range(9)] for i in range(8)])
        assert np.abs(_resize(_summed(_gray(data.tobytes(), h, w, c)), 8, 9) - want).max() < 1e-9
    flat = np.full((50, 70, 3), 137, np.uint8)
    assert len(np.unique(_resize(_summed(_gray(flat.tobytes(), 50, 70, 3)), 8, 9))) == 1  # equal areas stay equal
