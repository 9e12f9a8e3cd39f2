"""Training-order materialisation: a keyed Feistel permutation and fixed-stride shards.

Token streams are cut into sequences of ``length`` tokens, the last one of a
document padded. Sequences are numbered 0..n-1 in table order: every task of the
scan counts its own, and the sums before it give its first number. The permutation
sends a number to its slot in training order. It is a Feistel network over the
least even number of bits that holds n; a value outside 0..n-1 is permuted again
until it falls inside (cycle-walking), which keeps it a bijection. Anyone with the
key can compute any slot, and no shuffle order has to be stored.

Slots are cut into shards of ``per_shard`` records. A record has the same stride
everywhere: the token count (4 bytes, little-endian), the tokens, zeros, and a line
end. So the record of a slot is at (slot mod per_shard) * stride in shard
slot div per_shard, and a reader resumes at any slot by a seek. Tasks write ranges
of shards, of about ``TASK_BYTES`` at most or one shard. Shards are written
through Spark's text sink, whose commit makes a lost executor's files vanish.

Defined results: a null or empty stream has no sequence; repeated rows have
sequences of their own; a bad length or a stream that isn't whole tokens raises; an
empty table writes no shard and gives an empty result. Extra columns don't matter:
only the named ones are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import discard, stored

LENGTH = 512
TASK_BYTES = 256 << 20  # of shards that one task writes
PASSES = 2  # the shuffle files of a pass go before the next one, so that they and all shards never lie on disk together
PER_SHARD = 8192
ROUNDS = 8
KEY = 0x5EED_0F_0DE2


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection on 0..n-1."""
    n: int
    key: int = KEY
    rounds: int = ROUNDS

    @property
    def half(self) -> int:
        return max(1, ((max(self.n, 2) - 1).bit_length() + 1) // 2)

    def _keys(self) -> list[np.uint64]:
        out, x = [], self.key & (2**64 - 1)
        for _ in range(self.rounds):
            x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
            out.append(np.uint64(x))
        return out

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        h, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & low
        for key in (reversed(keys) if back else keys):
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return (left << h) | right

    def __call__(self, i: np.ndarray, back: bool = False) -> np.ndarray:
        """Slots of the numbers (or, back, numbers of the slots)."""
        keys, x = self._keys(), np.asarray(i, np.uint64)
        x = self._once(x, keys, back)
        while (out := np.flatnonzero(x >= np.uint64(self.n))).size:
            x[out] = self._once(x[out], keys, back)
        return x.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Where the records are: everything a reader needs."""
    path: str
    n: int
    length: int
    width: int
    per_shard: int
    key: int

    @property
    def stride(self) -> int:
        return 4 + self.length * self.width + 1

    def place(self, slot: int) -> tuple[int, int]:
        """Shard and byte offset of a slot."""
        return slot // self.per_shard, slot % self.per_shard * self.stride


def _sequences(streams: DataFrame, layout: Layout, firsts: dict[int, tuple[int, int]], content: bool,
               within: tuple[int, int] | None = None) -> DataFrame:
    """One row per sequence (of the shards from ``within[0]`` to before ``within[1]``, if given): id, seq_no, slot, shard,
    n_tokens, and the record if ``content``."""
    size = layout.length * layout.width
    perm = Permutation(layout.n, layout.key)
    key_type = streams.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key_type}, seq_no bigint, slot bigint, shard bigint, n_tokens bigint, record binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, expected = firsts.get(TaskContext.get().partitionId(), (0, 0))
        end = at + expected
        for b in batches:
            doc, seq, n, rec = [], [], [], []
            sizes = [-(-len(x.as_buffer()) // size) if x.is_valid else 0 for x in b.column(1)]
            slots = perm(np.arange(at, at + sum(sizes)))
            at += slots.size
            if at > end:
                raise ValueError("the table was dealt out differently than when it was counted")
            lo, hi = within or (0, -(-layout.n // layout.per_shard))
            wanted = (slots >= lo * layout.per_shard) & (slots < hi * layout.per_shard)
            asked = iter(wanted.tolist())
            for r, x in enumerate(b.column(1)):
                ids = x.as_buffer().to_pybytes() if x.is_valid else b""
                if len(ids) % layout.width:
                    raise ValueError("a stream isn't whole tokens")
                for k in range(0, len(ids), size):
                    if not next(asked):
                        continue
                    part = ids[k:k + size]
                    doc.append(r)
                    seq.append(k // size)
                    n.append(len(part) // layout.width)
                    rec.append(n[-1].to_bytes(4, "little") + part.ljust(size, b"\0") if content else None)
            slots = slots[wanted]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc, pa.int64())), pa.array(seq, pa.int64()), pa.array(slots),
                 pa.array(slots // layout.per_shard), pa.array(n, pa.int64()), pa.array(rec, pa.binary())],
                ["doc_id", "seq_no", "slot", "shard", "n_tokens", "record"])
        if at != end:
            raise ValueError("the table was dealt out differently than when it was counted")

    return streams.mapInArrow(run, schema)


def materialise(streams: DataFrame, width: int = 1, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY,
                path: str | None = None, from_files: bool = False) -> tuple[Layout, DataFrame]:
    """Write the shards of ``streams`` (doc_id, ids: packed tokens of ``width`` bytes).

    Returns the layout and, per sequence, doc_id, seq_no, slot, shard and n_tokens.
    Counting and writing scan ``streams`` twice and must see it dealt out alike:
    ``from_files`` says that it comes straight from files, whose splits are pinned
    here; anything else is stored first. A task that finds other rows than were
    counted for it raises.
    """
    if length < 1 or width < 1 or per_shard < 1:
        raise ValueError("length, width and per_shard must be positive")
    spark = streams.sparkSession
    s = streams.select("doc_id", "ids")
    if not from_files:
        s = stored(s, "streams")
    size = length * width
    pinned = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(pinned, None)
    spark.conf.set(pinned, str(before or max(1, spark.sparkContext.defaultParallelism)))
    try:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            for b in batches:
                n += sum(-(-len(x.as_buffer()) // size) for x in b.column(1) if x.is_valid)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())],
                                             ["part", "n"])

        # one row per task of the scan
        counts = sorted((r["part"], r["n"]) for r in s.mapInArrow(count, "part int, n bigint").collect())
        firsts, n = {}, 0
        for part, k in counts:
            firsts[part] = (n, k)
            n += k
        path = path or f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
        layout = Layout(path, n, length, width, per_shard, key)
        if n:
            shards = -(-n // per_shard)
            tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * layout.stride // TASK_BYTES)))
            passes = min(PASSES, shards)
            for k in range(passes):
                within = shards * k // passes, shards * (k + 1) // passes
                rows = _sequences(s, layout, firsts, content=True, within=within)
                rows = rows.select("shard", "slot", F.col("record").cast("string").alias("value"))
                some, own = -(-tasks // passes), within[1] - within[0]
                # ranges by arithmetic: range partitioning samples uneven scans anew under other partition numbers
                task = F.floor((F.col("shard") - within[0]) * min(some, own) / own).cast("int")
                (rows.repartitionById(some, task).sortWithinPartitions("shard", "slot").drop("slot")
                 .write.mode("append" if within[0] else "errorifexists").partitionBy("shard").text(path))
                del rows
                discard(rounds=3)  # this pass's shuffle files
        manifest = stored(_sequences(s, layout, firsts, content=False).drop("record"), "manifest")
    finally:
        if before is None:
            spark.conf.unset(pinned)
        else:
            spark.conf.set(pinned, before)
    return layout, manifest


def read_from(spark: SparkSession, layout: Layout, slot: int = 0) -> DataFrame:
    """Records from a slot on: slot, shard, offset, n_tokens, ids. Earlier shards are not read."""
    stride, per = layout.stride, layout.per_shard
    schema = "slot bigint, shard bigint, offset bigint, n_tokens bigint, ids binary"
    if slot >= layout.n:
        return spark.createDataFrame([], schema)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("basePath", layout.path).load(layout.path)
             .where(F.col("shard").cast("bigint") >= slot // per).select(F.col("shard").cast("bigint").alias("shard"), "content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = content.as_buffer().to_pybytes()
                if len(data) % stride or len(data) != min(per, layout.n - shard * per) * stride:
                    raise ValueError(f"shard {shard} has the wrong size")
                at = np.arange(0, len(data), stride)
                at = at[shard * per + at // stride >= slot]
                n = [int.from_bytes(data[a:a + 4], "little") for a in at]
                ids = [data[a + 4:a + 4 + k * layout.width] for a, k in zip(at, n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard * per + at // stride), pa.array([shard] * len(at), pa.int64()), pa.array(at),
                     pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["slot", "shard", "offset", "n_tokens", "ids"])

    return files.mapInArrow(run, schema)


def op2_shards(docs: DataFrame) -> DataFrame:
    """UTF-8 bytes as token ids, written and read back: where every sequence of a document is, and its checksum there."""
    layout, manifest = materialise(docs.select("doc_id", F.col("text").cast("binary").alias("ids")), from_files=True)
    back = read_from(docs.sparkSession, layout).select(
        F.col("slot").alias("s"), "shard", "offset", F.col("n_tokens").alias("stored_tokens"), F.crc32("ids").alias("stored_crc32"))
    return (manifest.drop("shard").join(back, F.col("slot") == F.col("s")).drop("s")
            .select("doc_id", "seq_no", "slot", "shard", "offset", "n_tokens", "stored_tokens", "stored_crc32"))
