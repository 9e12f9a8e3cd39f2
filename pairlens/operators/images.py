"""Image hashing (IMG1) and hash codes (SIM4 inputs).

Hashes are computed per image row inside Spark tasks (``mapInPandas`` over the
image source, numpy only) and compared with the native Hamming expression.
They are self-consistent (same job, same hash), not byte-equal to other
libraries' resize filters (H15).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sign_code(vec: Column, bits: int = 64) -> Column:
    """Bit ``i`` set when ``vec[i] > 0`` as a bigint; a vector of another length than ``bits`` raises."""
    one = F.lit(1).cast("bigint")
    whole = F.assert_true(F.size(vec) == bits, F.lit(f"a code needs vectors of {bits} entries"))
    code = F.aggregate(
        F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("bigint"),
        lambda acc, i: acc.bitwiseOR(F.when(F.get(vec, i) > 0, F.call_function("shiftleft", one, i))
                                     .otherwise(F.lit(0).cast("bigint"))))
    return F.when(whole.isNull(), code)


def long_to_hex(code: Column) -> Column:
    """bigint -> 16 lower-case hex digits (two's complement)."""
    return F.lpad(F.lower(F.hex(code)), 16, "0")


def sign_code_hex(vec: Column, bits: int = 64) -> Column:
    return long_to_hex(sign_code(vec, bits))


# ---------------------------------------------------------------------------
# perceptual hashes (IMG1), computed per image inside the tasks
# ---------------------------------------------------------------------------

HASH_SCHEMA = "url string, phash string, dhash string"


def _gray(data: bytes, h: int, w: int, c: int):
    """Grey values in thousandths, as whole numbers."""
    import numpy as np
    a = np.frombuffer(data, dtype=np.uint8)
    if c == 1:
        return a.reshape(h, w) * np.int64(1000)
    a = a.reshape(h, w, c).astype(np.int64)
    b, g, r = a[..., 0], a[..., 1], a[..., 2]  # image source stores BGR(A)
    return r * 299 + g * 587 + b * 114


def _summed(grey):
    """Summed-area table: entry (y, x) is the sum above and left of it, exactly."""
    import numpy as np
    table = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), np.int64)
    table[1:, 1:] = grey.cumsum(0).cumsum(1)
    return table


def _resize(table, out_h: int, out_w: int):
    """Area-average resize (box filter) to out_h x out_w: every cell from four entries of the summed-area table."""
    import numpy as np

    def edges(n: int, cells: int):
        at = np.linspace(0, n, cells + 1)
        low = at[:-1].astype(np.int64)
        return low, np.maximum(np.ceil(at[1:]).astype(np.int64), low + 1)

    (y0, y1), (x0, x1) = edges(table.shape[0] - 1, out_h), edges(table.shape[1] - 1, out_w)
    total = table[np.ix_(y1, x1)] - table[np.ix_(y0, x1)] - table[np.ix_(y1, x0)] + table[np.ix_(y0, x0)]
    return total / (np.outer(y1 - y0, x1 - x0) * 1000.0)


def _bits_hex(bits) -> str:
    import numpy as np
    return np.packbits(bits.flatten()).tobytes().hex()


def _dct_matrix(n: int):
    import numpy as np
    k = np.arange(n)[:, None]
    i = np.arange(n)[None, :]
    return 2.0 * np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def phash_dhash(data: bytes, h: int, w: int, c: int) -> tuple[str, str]:
    """pHash: 32x32 grey, 2-D DCT-II, top-left 8x8 above its median.
    dHash: 9x8 grey, each pixel brighter than its left neighbour."""
    import numpy as np
    g = _summed(_gray(data, h, w, c))
    small = _resize(g, 32, 32)
    d = _dct_matrix(32)
    coeffs = d @ small @ d.T
    low = coeffs[:8, :8]
    ph = _bits_hex(low > np.median(low))
    dd = _resize(g, 8, 9)
    dh = _bits_hex(dd[:, 1:] > dd[:, :-1])
    return ph, dh


def _hash_batches(batches):
    import pandas as pd
    for pdf in batches:
        rows = []
        for img in pdf["image"]:
            try:
                ph, dh = phash_dhash(bytes(img["data"]), int(img["height"]), int(img["width"]), int(img["nChannels"]))
                rows.append((img["origin"], ph, dh))
            except Exception:  # unreadable image: no hash, like a failed download
                continue
        yield pd.DataFrame(rows, columns=["url", "phash", "dhash"])


def image_hashes(images: DataFrame) -> DataFrame:
    """``read_images`` output -> ``(url, phash, dhash)``, one row per image."""
    return images.select("image").mapInPandas(_hash_batches, HASH_SCHEMA)


def attach_image_hashes(records: DataFrame, hashes: DataFrame, url_of=None, max_images: int | None = None) -> DataFrame:
    """Add ``image_hashes`` (all image URLs that hashed, in page order; with
    ``max_images``, of the first so many) to raw records. ``url_of`` maps an image
    URL to the stored file's origin (identity by default)."""
    from pyspark.sql import functions as F
    key = ["pair_id", "link_key"]
    imgs = records.select(*key, F.posexplode(
        F.slice(F.col("raw.image_urls"), 1, max_images) if max_images else F.col("raw.image_urls")).alias("pos", "url"))
    if url_of is not None:
        imgs = imgs.withColumn("origin", url_of(F.col("url")))
    else:
        imgs = imgs.withColumn("origin", F.col("url"))
    h = hashes.withColumnRenamed("url", "origin")
    joined = imgs.join(h, "origin", "inner")
    per = joined.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "url", "phash", "dhash"))).alias("_h"))
    per = per.select(*key, F.transform("_h", lambda x: F.struct(x["url"].alias("url"), x["phash"].alias("phash"),
                                                               x["dhash"].alias("dhash"))).alias("image_hashes"))
    empty = F.array().cast("array<struct<url:string,phash:string,dhash:string>>")
    return records.join(per, key, "left").withColumn("image_hashes", F.coalesce(F.col("image_hashes"), empty))
