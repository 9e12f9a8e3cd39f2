"""Hard negatives for contrastive training, by a secondary sort of scores.

For every anchor the nearest rows of its own label are its positives; a positive's
hard negatives are the nearest rows of other labels whose score lies between ``LOW``
percent of the positive's and the positive's own.

Rows are never shuffled. Anchors are stored and taken in chunks of ``CHUNK_BYTES`` at
most, each broadcast to the tasks that scan the rows. Two scans per chunk:

1. every task keeps an anchor's best rows of its label among the rows that it saw, and
   the best of these over all tasks give each positive's score, the window's upper end;
2. every task keeps, for each window, its first negatives inside it, and sends these
   and its best positives. What a task leaves out comes after enough rows of its own
   in the same window, so nothing is lost, and a task sends a few dozen rows for an anchor
   however many rows tie or share a label.

What is sent is keyed by packed bytes (anchor, descending score, positives first, id),
dealt by the anchor and sorted by key within partitions. One pass over the sorted
rows of an anchor opens a window at each of its first positives and gives every
negative to the open windows that its score fits, until each is full; it holds the open windows and
nothing else of the anchor.

Defined results: rows with a null id, label or vector, or with null or non-finite
components, take no part; an anchor's own id is neither positive nor negative for it;
ties go to the smaller id; repeated rows are rows of their own, as anchors and as
results; with a positive score below zero nothing fits; a shorter vector counts as padded with zeros; an empty table,
no anchors, or anchors without positives give no rows. Scores are exact while a
hundred times a score fits into 64 bits. Extra columns don't matter: only vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import stored

POSITIVES = 5
NEGATIVES = 5
LOW = 80
SCALE = 256
CHUNK_BYTES = 8 << 20
ANCHORS_AT_ONCE = 512
_SIGN = 1 << 63

RESULT = T.StructType([T.StructField(c, T.IntegerType() if c == "rank" else T.LongType()) for c in
                       ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])


def labelled_vectors(vecs: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the rows that take part, components as floor(scale * x)."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    d = vecs.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), "embedding")
    d = d.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(ok, F.lit(False)))
    return d.select("vec_id", "label", F.transform(x, lambda e: F.floor(e * scale).cast("bigint")).alias("v"))


def _matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Vectors as an integer matrix of at least ``width`` columns, shorter ones padded with zeros."""
    lens = np.diff(np.asarray(vectors.offsets))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(lens.max(initial=0)))
    if (lens == width).all():
        return flat.reshape(len(lens), width)
    out = np.zeros((len(lens), width), np.int64)
    out[np.arange(width) < lens[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where these are exact."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if top < 2.0 ** 53 else a @ b.T


class Nearest:
    """The first ``k`` rows of each slot, by descending score and then id, of all that were offered."""

    def __init__(self, slots: int, k: int):
        self.k, self.floor = k, np.full(slots, -_SIGN, np.int64)
        self.rows = np.empty((0, 4), np.int64)  # slot, score, id, number of the row
        self.new: list[np.ndarray] = []
        self.waiting = 0

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        self.new.append(np.column_stack([slot, score, ids, row]))
        self.waiting += len(slot)
        if self.waiting > 4 * self.k * len(self.floor) + 65536:
            self.settle()

    def settle(self) -> np.ndarray:
        every = np.concatenate([self.rows, *self.new])
        every = every[np.lexsort((every[:, 3], every[:, 2], -every[:, 1], every[:, 0]))]
        first = np.searchsorted(every[:, 0], every[:, 0], side="left")
        rank = np.arange(len(every)) - first
        full = every[rank == self.k - 1]
        self.floor[full[:, 0]] = full[:, 1]
        self.rows, self.new, self.waiting = every[rank < self.k], [], 0
        return self.rows


class Chunk:
    """Anchors as arrays: number, id, label, vectors, and the ends of their windows (absent: the least number)."""

    def __init__(self, t: pa.Table, positives: int):
        self.number, self.id, self.label = (t.column(c).to_numpy() for c in ("ano", "vec_id", "label"))
        self.v = _matrix(t.column("v").combine_chunks()) if t.num_rows else np.zeros((0, 0), np.int64)
        self.ends = np.full((t.num_rows, positives), -_SIGN, np.int64)
        if "ends" in t.column_names:
            for i, e in enumerate(t.column("ends").to_pylist()):
                self.ends[i, :len(e or [])] = e or []

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(first anchor, scores, same label, other row, ids, row numbers) for parts of the anchors and each batch."""
        seen = 0
        for b in batches:
            ids, labels, v = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
            rows = np.arange(seen, seen + len(ids))
            seen += len(ids)
            for at in range(0, len(self.id), ANCHORS_AT_ONCE):
                part = slice(at, at + ANCHORS_AT_ONCE)
                other = self.id[part, None] != ids
                yield at, _products(self.v[part], v), self.label[part, None] == labels, other, ids, rows


def _offer(best: Nearest, fits: np.ndarray, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Offer the pairs that fit, but for those behind what their slot already has."""
    i, j = np.nonzero(fits & (scores >= best.floor[slots][:, None]))
    if len(i):
        best.offer(slots[i], scores[i, j], ids[j], rows[j])


def best_positives(rows: DataFrame, chunk, k: int) -> DataFrame:
    """(ano, score, id): every task's first k rows of each anchor's label."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Chunk = chunk.value
        best = Nearest(len(c.id), k)
        for at, scores, same, other, ids, numbers in c.scores(batches):
            _offer(best, same & other, np.arange(at, at + len(scores)), scores, ids, numbers)
        got = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(c.number[got[:, 0]]), pa.array(got[:, 1]), pa.array(got[:, 2])], ["ano", "score", "id"])
    return rows.mapInArrow(near, "ano bigint, score bigint, id bigint")


def packed(ano: np.ndarray, score: np.ndarray, negative: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """Keys whose byte order is (anchor, descending score, positives first, id)."""
    cols = np.column_stack([ano, -score, ids]).astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    head, tail = cols[:, :2].astype(">u8").tobytes(), cols[:, 2].astype(">u8").tobytes()
    return [head[16 * i:16 * i + 16] + (b"\1" if n else b"\0") + tail[8 * i:8 * i + 8] for i, n in enumerate(negative)]


def unpacked(key: bytes) -> tuple[int, int, bool, int]:
    ano, score, ids = (int.from_bytes(key[a:a + 8], "big") - _SIGN for a in (0, 8, 17))
    return ano, -score, key[16] == 1, ids


def candidates(rows: DataFrame, chunk, positives: int, negatives: int, low: int) -> DataFrame:
    """(key, anchor_id): every task's best positives, and its first negatives of each window."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Chunk = chunk.value
        n = len(c.id)
        same_label, inside = Nearest(n, positives), Nearest(n * positives, negatives)
        for at, scores, same, other, ids, numbers in c.scores(batches):
            part = np.arange(at, at + len(scores))
            _offer(same_label, same & other, part, scores, ids, numbers)
            for w in range(positives):
                end = c.ends[part, w][:, None]
                least = -(-np.maximum(end, 0) * low // 100)
                fits = ~same & other & (end >= 0) & (scores <= end) & (scores >= least)
                _offer(inside, fits, part * positives + w, scores, ids, numbers)
        pos, neg = same_label.settle(), inside.settle()
        neg[:, 0] //= positives
        neg = np.unique(neg, axis=0)  # a row may lie in several windows
        both = np.concatenate([pos, neg])
        kind = np.arange(len(both)) >= len(pos)
        for a in range(0, len(both), 8192):
            b = both[a:a + 8192]
            keys = packed(c.number[b[:, 0]], b[:, 1], kind[a:a + 8192], b[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(c.id[b[:, 0]])], ["key", "anchor_id"])
    return rows.mapInArrow(near, "key binary, anchor_id bigint")


def open_windows(positives: int, negatives: int, low: int):
    """The streaming pass over sorted (key, anchor id): result rows of each anchor's windows."""
    def stream(rows: Iterator[tuple[bytes, int]]) -> Iterator[tuple]:
        now, windows = None, []
        for key, anchor in rows:
            ano, score, negative, row_id = unpacked(key)
            if ano != now:
                now, windows, opened = ano, [], 0
            if not negative:
                if opened < positives:
                    opened += 1
                    windows.append([row_id, score, 0])
                continue
            for w in windows:
                if low * w[1] <= 100 * score <= 100 * w[1] and w[2] < negatives:
                    w[2] += 1
                    yield anchor, w[0], w[2], row_id, w[1], score
    return stream


def mine(vecs: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, scale: int = SCALE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Hard negatives of the rows that ``is_anchor`` names (by vec_id and label): the columns of ``RESULT``."""
    if positives < 1 or negatives < 1 or not 0 < low <= 100:
        raise ValueError("at least one positive and one negative, and a part of the positive's score")
    spark = vecs.sparkSession
    rows = stored(labelled_vectors(vecs, F.col("label") if label is None else label, scale), "labelled-vectors")
    anchors = stored(rows.where(is_anchor).withColumn("ano", F.monotonically_increasing_id()), "anchors")
    n, width = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
    chunks = max(1, -(-n * (8 * (width or 0) + 64) // chunk_bytes))
    nearest = Window.partitionBy("ano").orderBy(F.desc("score"), "id")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for at in range(chunks):
        now = anchors.where(F.pmod(F.xxhash64("ano"), F.lit(chunks)) == at)
        first = spark.sparkContext.broadcast(Chunk(now.toArrow(), positives))
        best = stored(best_positives(rows, first, positives), "best-positives")
        first_ones = best.withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= positives)
        ends = first_ones.groupBy("ano").agg(F.sort_array(F.collect_list("score"), asc=False).alias("ends"))
        second = spark.sparkContext.broadcast(Chunk(now.join(ends, "ano", "left").toArrow(), positives))
        part = stored(candidates(rows, second, positives, negatives, low), "candidates")
        keyed = part.rdd.map(lambda r: (bytes(r[0]), r[1]))
        every = keyed if at == 0 else every.union(keyed)
    dealt = every.repartitionAndSortWithinPartitions(partitions, lambda key: int.from_bytes(key[:8], "big") * 0x9E3779B1 >> 16)
    return spark.createDataFrame(dealt.mapPartitions(open_windows(positives, negatives, low)), RESULT)


def op13_hard_negatives(vecs: DataFrame) -> DataFrame:
    """Contract rows: anchors are the ids divisible by 100; where an id is divisible by 7 the label is the next one of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vecs, F.col("vec_id") % 100 == 0, label)
