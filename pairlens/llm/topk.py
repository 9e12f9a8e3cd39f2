"""Exact inner-product search over buckets of vectors of like length.

Vectors are grouped into buckets by length, and buckets into blocks of at most a
few thousand vectors. A first pass compares the queries with a seed block of the
longest vectors and gives every query a lower bound for its k-th score. With that bound
each pair of query and block has a local cosine threshold, bound / (|q| * longest
length of the block):

* above 1, the block cannot hold a result and is skipped;
* at or above ``COORDINATE`` the few largest coordinates of the query each limit
  the coordinate that a result may have (Cauchy-Schwarz on the rest), and only
  vectors within all limits are verified;
* below, vectors are verified in order of length while length * |q| can still reach
  the bound.

Verification is the exact integer product. Results of a task's blocks are merged
as they come, longest blocks first, so the bound rises; the k best per query are
then taken over all tasks. Nothing is approximate.

Queries and candidates meet in blocks: every query block with every candidate
block, dealt out by the pair. A bucket that holds a third of all vectors is only
many blocks.

Defined results: vectors that are null, or hold null or non-finite components, and
rows without an id take no part; a query never gets a row of its own id; a shorter
vector counts as padded with zeros; ties go to the smaller id, and rows that repeat
an id and score are separate results; an empty table gives an empty result. Extra
columns don't matter: only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored

K = 5
SCALE = 256
BLOCK = 4096
QUERIES_PER_BLOCK = 1024
FOCUS = 4
COORDINATE = 0.6
RATIO = 1.1  # lengths in a bucket differ by this factor at most


def integer_vectors(vecs: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, norm): the vectors that take part, components as floor(scale * x)."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.floor(e * scale).cast("bigint"))
    d = vecs.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(ok, F.lit(False)))
    d = d.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.explode(F.array(v)).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    return d.withColumn("norm", F.sqrt(square))


def _blocks(d: DataFrame, size: int) -> DataFrame:
    """Vectors in blocks of about ``size`` of one bucket: (bucket, blk, longest, ids, vectors)."""
    bucket = F.when(F.col("norm") > 0, F.floor(F.log(F.col("norm")) / float(np.log(RATIO)))).otherwise(F.lit(-(1 << 40)))
    d = d.withColumn("bucket", bucket.cast("bigint"))
    counts = stored(d.groupBy("bucket").agg(F.ceil(F.count("*") / size).alias("blocks")), "vector-buckets")
    d = d.join(counts, "bucket")
    d = d.withColumn("blk", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    return d.groupBy("bucket", "blk").agg(F.max("norm").alias("longest"), F.collect_list("vec_id").alias("ids"),
                                          F.collect_list("v").alias("vectors"))


def _matrix(vectors: pa.ListScalar) -> np.ndarray:
    """The vectors of a block as an integer matrix, shorter ones padded with zeros."""
    rows = vectors.values
    flat, ends = rows.flatten().to_numpy(zero_copy_only=False), np.asarray(rows.offsets)
    lens = np.diff(ends)
    width = int(lens.max()) if len(lens) else 0
    if len(lens) and (lens == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(lens), width), np.int64)
    for i, (a, n) in enumerate(zip(ends[:-1] - ends[0], lens)):
        out[i, :n] = flat[a:a + n]
    return out


class Best:
    """The k best results of each query of a block so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray | None):
        self.ids, self.q, self.k = ids, q, k
        self.norms = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        self.unit = q / np.maximum(self.norms, 1e-300)[:, None]
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.bound = np.full(len(ids), -np.inf) if bound is None else bound.astype(np.float64)
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]

    def add(self, ids: np.ndarray, p: np.ndarray) -> None:
        """Search a block of candidates, longest first."""
        norms = np.sqrt((p.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-norms, kind="stable")
        ids, p, norms = ids[order], p[order], norms[order]
        width = min(p.shape[1], self.q.shape[1])
        unit = p / np.maximum(norms, 1e-300)[:, None]
        exact = np.abs(p).max(initial=0) * float(np.abs(self.q).max(initial=0)) * max(width, 1) < 2.0 ** 53
        kind = np.float64 if exact else np.int64  # products in doubles are exact below 2^53
        pw, qw = np.ascontiguousarray(p[:, :width].astype(kind)), self.q[:, :width].astype(kind)
        every: list[int] = []
        for i in range(len(self.ids)):
            top = self.norms[i] * norms[0]
            bound = self.bound[i]
            if top > 0 and bound > top * (1 + 1e-9):
                continue  # local threshold above 1
            theta = bound / top if top > 0 else -1.0
            if theta >= COORDINATE:
                self.verify(i, ids, pw, qw[i], self.within(i, unit, theta))
            elif bound > 0:
                n = int(np.searchsorted(-norms * self.norms[i], -bound * (1 - 1e-9), side="right"))
                self.verify(i, ids, pw, qw[i], slice(0, n))
            else:
                every.append(i)
        for at in range(0, len(every), 256):  # no bound yet: products of many queries at once
            part = every[at:at + 256]
            scores = qw[part] @ pw.T
            for row, i in enumerate(part):
                self.keep(i, ids, scores[row])

    def within(self, i: int, unit: np.ndarray, theta: float) -> np.ndarray:
        """Candidates whose focus coordinates leave a cosine of theta possible."""
        at = np.arange(len(unit))
        for f in self.focus[i]:
            if f >= unit.shape[1]:
                continue
            a, x = self.unit[i, f], unit[at, f]
            best = a * x + np.sqrt(max(0.0, 1 - a * a)) * np.sqrt(np.maximum(0.0, 1 - x * x))
            at = at[best >= theta - 1e-9]
        return at

    def verify(self, i: int, ids: np.ndarray, p: np.ndarray, q: np.ndarray, at) -> None:
        self.keep(i, ids[at], p[at] @ q)

    def keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ok = ids != self.ids[i]
        ids, scores = ids[ok], scores[ok]
        if len(ids) > self.k:
            least = np.partition(scores, len(ids) - self.k)[len(ids) - self.k]
            ok = scores >= least
            ids, scores = ids[ok], scores[ok]
        if len(ids):
            best = sorted([*self.found[i], *((-int(s), int(v)) for s, v in zip(scores, ids))])[:self.k]
            self.found[i] = best
            if len(best) == self.k:
                self.bound[i] = max(self.bound[i], -best[-1][0])


def _rows(best: Best) -> pa.RecordBatch:
    out = [(int(q), v, -s) for q, found in zip(best.ids, best.found) for s, v in found]
    cols = list(zip(*out)) if out else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])


def search(vecs: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """The k best rows for every row that ``is_query`` names: query_id, rank, vec_id, score."""
    ints = stored(integer_vectors(vecs, scale), "vectors")
    blocks = stored(_blocks(ints, BLOCK), "vector-blocks")
    queries = stored(_blocks(ints.where(is_query), QUERIES_PER_BLOCK).withColumn("qno", F.monotonically_increasing_id()),
                     "query-blocks")
    q = queries.select("qno", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    best_score = "query_id bigint, vec_id bigint, score bigint"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                best = Best(np.asarray(b.column(1)[r].values), _matrix(b.column(2)[r]), k, None)
                best.add(np.asarray(b.column(3)[r].values), _matrix(b.column(4)[r]))
                low = [-f[-1][0] if len(f) == k else None for f in best.found]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1), pa.array([low], pa.list_(pa.int64()))], ["n", "low"])

    # lower bounds from one block of the longest vectors
    seed = blocks.orderBy(F.desc("longest"), "bucket", "blk").limit(1).select("ids", "vectors", F.lit(0).alias("one"))
    lows = q.withColumn("one", F.lit(0)).join(F.broadcast(seed), "one").select("qno", "q_ids", "q_vectors", "ids", "vectors")
    lows = stored(lows.mapInArrow(first, "n bigint, low array<bigint>"), "query-bounds")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for b in batches:
            for r in range(b.num_rows):
                n = b.column(0)[r].as_py()
                if n != now:
                    if best:
                        yield _rows(best)
                    low = np.array([-np.inf if x is None else x for x in b.column(3)[r].as_py()], np.float64)
                    now, best = n, Best(np.asarray(b.column(1)[r].values), _matrix(b.column(2)[r]), k, low)
                best.add(np.asarray(b.column(4)[r].values), _matrix(b.column(5)[r]))
        if best:
            yield _rows(best)

    # every query block with every candidate block, dealt by the pair; longest blocks first in a task
    numbers = queries.select(F.collect_list("qno").alias("all"))
    pairs = blocks.crossJoin(F.broadcast(numbers)).select("ids", "vectors", "longest", F.explode("all").alias("n"))
    dealt = pairs.join(q.join(lows, F.col("qno") == F.col("n")).drop("n"), F.col("n") == F.col("qno"))
    dealt = (dealt.repartition("qno", F.pmod(F.xxhash64("ids"), F.lit(64)))
             .sortWithinPartitions("qno", F.desc("longest")).select("qno", "q_ids", "q_vectors", "low", "ids", "vectors"))
    got = dealt.mapInArrow(meet, best_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op6_topk(vecs: DataFrame) -> DataFrame:
    """Contract rows: queries are the ids divisible by 50."""
    return search(vecs, F.col("vec_id") % 50 == 0)
