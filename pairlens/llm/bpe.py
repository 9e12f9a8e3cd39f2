"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until its parts are leaves; leaves are encoded by themselves and
neighbours are joined upwards. A join encodes anew only a window around the seam:
it grows, left and right, to the nearest place where a character that isn't white
space meets a white space character. No match of the split pattern spans such a
place, and no match beside it looks past it, so the tokens outside the window are
provably those of the whole text. Inside one long match (a run of letters without
a space) the same reduction works on bytes: the window grows by tokens until the
pair of tokens at either edge encodes to itself, which makes the whole sequence
the encoding.

Texts over ``SPAN`` characters are first dealt out as spans over the cluster,
encoded there, and joined by document, so one long text doesn't hold up a task
with other work. Decoding concatenates the byte strings of the tokens.

The encoding is what the tiktoken library gives for each match of the pattern,
without special tokens. Defined results: a null or empty text has no tokens and
decodes to the empty byte string; rows are encoded each by itself, repeated ones
too; an empty table gives an empty result. Extra columns are carried; the names of
the added columns are replaced where they clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

LEAF = 1 << 16
PIECE = 256
SPAN = 1 << 20
CACHE = 150_000

# The characters that the pattern's \s matches.
SPACES = r"\t-\r \x85\xa0  -     　"
SEGMENT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
SEAM = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")
UNEVEN = re.compile(f"[{SPACES}]{{2}}|[^\\S \n]|\0")


class Codec:
    """Encodes and decodes texts for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = pattern
        self.cache: dict[str, bytes] = {}  # recent segments; before it fills up, it becomes ``older``
        self.older: dict[str, bytes] = {}

    # -- inside one match -------------------------------------------------
    def merge(self, piece: bytes) -> list[int]:
        """BPE of a byte string: merge the lowest-ranked, leftmost neighbours until none has a rank."""
        ranks, n = self.ranks, len(piece)
        if n <= 1:
            return [ranks[piece]] if n else []
        part = [piece[i:i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            r, i, size = heappop(heap)
            j = after[i]
            if part[i] is None or j < 0 or len(part[i]) + len(part[j]) != size or ranks.get(part[i] + part[j]) != r:
                continue  # one of the two has been merged since
            part[i], part[j] = part[i] + part[j], None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right >= 0 and (r := ranks.get(part[left] + part[right])) is not None:
                    heappush(heap, (r, left, len(part[left]) + len(part[right])))
        return [ranks[x] for x in part if x is not None]

    def fits(self, a: int, b: int) -> bool:
        return self.merge(self.tokens[a] + self.tokens[b]) == [a, b]

    def join_tokens(self, x: list[int], y: list[int]) -> list[int]:
        """Encoding of the concatenation of two encoded byte strings of one match."""
        if not x or not y:
            return x or y
        left = right = 4
        while True:
            left, right = min(left, len(x)), min(right, len(y))
            mid = self.merge(b"".join(self.tokens[t] for t in x[len(x) - left:] + y[:right]))
            lo = left == len(x) or self.fits(x[-left - 1], mid[0])
            hi = right == len(y) or self.fits(mid[-1], y[right])
            if lo and hi:
                return x[:len(x) - left] + mid + y[right:]
            left, right = left if lo else 2 * left, right if hi else 2 * right

    def piece(self, b: bytes) -> list[int]:
        """BPE of one match."""
        if len(b) <= PIECE:
            return self.merge(b)
        h = len(b) // 2
        return self.join_tokens(self.piece(b[:h]), self.piece(b[h:]))

    # -- texts ------------------------------------------------------------
    def segment(self, s: str) -> bytes:
        """Packed ids of a text without an inner seam."""
        if len(s) <= PIECE // 4:
            ids = self.base.encode_ordinary(s)
        else:
            import regex
            ids = [t for m in regex.findall(self.pattern, s) for t in self.piece(m.encode())]
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def leaf(self, text: str) -> bytes:
        """Packed ids of a short text: its segments, each looked up or encoded."""
        if UNEVEN.search(text):
            segments = SEGMENT.findall(text)
        else:  # single blanks and line ends only: the same segments without a pattern
            segments = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        cache, out = self.cache, []
        for s in segments:
            ids = cache.get(s)
            if ids is None:
                ids = self.older.get(s) or self.segment(s)
                if len(s) <= 64:
                    cache[s] = ids
            out.append(ids)
        if len(cache) > CACHE:
            self.older, self.cache = cache, {}
        return b"".join(out)

    def join(self, a: str, x: bytes, b: str, y: bytes) -> bytes:
        """Packed ids of ``a + b`` from those of its parts, through a window around the seam."""
        if not a or not b:
            return x or y
        lo, width = 0, 64
        while True:  # the last seam of a, looked for in growing windows
            start = max(0, len(a) - width)
            seams = [m.start() for m in SEAM.finditer(a, start)]
            seams = [i for i in seams if i < len(a)]
            if seams or not start:
                lo = seams[-1] if seams else 0
                break
            width *= 4
        m = SEAM.search(b)
        hi = m.start() if m else len(b)
        tail, head = a[lo:], b[:hi]
        return x[:len(x) - len(self.leaf(tail))] + self.leaf(tail + head) + y[len(self.leaf(head)):]

    def encode(self, text: str) -> bytes:
        """Packed little-endian ids of a whole text."""
        if len(text) <= LEAF:
            return self.leaf(text)
        h = len(text) // 2
        a, b = text[:h], text[h:]
        return self.join(a, self.encode(a), b, self.encode(b))

    def reduce(self, parts: list[tuple[str, bytes]]) -> bytes:
        """Join encoded neighbours, pair by pair, level by level."""
        while len(parts) > 1:
            up = [(a + b, self.join(a, x, b, y)) for (a, x), (b, y) in zip(parts[::2], parts[1::2])]
            parts = up + parts[len(up) * 2:]
        return parts[0][1] if parts else b""

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return spelled(self.tokens, ids)


def spelled(tokens: dict[int, bytes], ids: bytes) -> bytes:
    """The bytes that packed ids stand for, by a table of the tokens."""
    return b"".join([tokens[i] for i in memoryview(ids).cast("I")]) if ids else b""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its id per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _ranks(name: str) -> dict[bytes, int]:
    return read_ranks(SparkFiles.get(name))


@lru_cache(maxsize=2)
def _tokens(name: str) -> dict[int, bytes]:
    return {i: b for b, i in _ranks(name).items()}


@lru_cache(maxsize=2)
def _codec(name: str, pattern: str) -> Codec:
    return Codec(_ranks(name), pattern)


_SENT: set[tuple[str, str]] = set()


def ship(spark: SparkSession, path: str) -> str:
    """Hand the rank file (a megabyte) to the executors; the name they find it under."""
    sent = (spark.sparkContext.applicationId, path)
    if sent not in _SENT:
        spark.sparkContext.addFile(path)
        _SENT.add(sent)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", span: int = SPAN, ids: str = "ids") -> DataFrame:
    """Add ``ids``: the tokens of every whole text as packed little-endian unsigned 32-bit integers."""
    name = ship(docs.sparkSession, path)
    d = docs.drop(ids)
    schema = T.StructType([*d.schema.fields, T.StructField(ids, T.BinaryType())])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for b in pieces(batches):
            out = [codec.encode(x.as_py() or "") for x in b.column(b.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, ids])

    long_text = F.coalesce(F.length(text) > span, F.lit(False))
    done = d.where(~long_text).mapInArrow(short, schema)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for b in pieces(batches):
            out = [codec.encode(x.as_py()) for x in b.column(b.schema.get_field_index("part"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "part_ids"])

    # a document of many spans: its columns stay with span 0, the others carry only their part
    n_spans = F.ceil(F.length(text) / span)
    far = d.where(long_text).withColumn("__uid", F.monotonically_increasing_id())
    parts = far.select("__uid", F.struct(*[F.col(f"`{c}`") for c in d.columns if c != text]).alias("__row"), text,
                       F.explode(F.sequence(F.lit(0), (n_spans - 1).cast("int"))).alias("no"))
    parts = parts.select("__uid", "no", F.when(F.col("no") == 0, F.col("__row")).alias("row"),
                         F.substring(F.col(text), F.col("no") * span + 1, F.lit(span)).alias("part"))
    parts = parts.repartition("__uid", "no")
    kind = T.StructType([*parts.schema.fields, T.StructField("part_ids", T.BinaryType())])
    encoded = parts.mapInArrow(spans, kind)

    def joined(pdf):
        import pandas as pd
        codec = _codec(name, pattern)
        pdf = pdf.sort_values("no")
        whole = codec.reduce(list(zip(pdf["part"], pdf["part_ids"])))
        return pd.DataFrame({"uid": pdf["uid"].iloc[:1].to_numpy(), "text": ["".join(pdf["part"])], "ids": [whole]})

    whole = (encoded.select(F.col("__uid").alias("uid"), "no", "part", "part_ids")
             .groupBy("uid").applyInPandas(joined, "uid long, text string, ids binary"))
    rows = encoded.where("no = 0").select(F.col("__uid").alias("uid"), "row")
    j = rows.join(whole, "uid")
    back = j.select(*[(F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in d.columns],
                    F.col("ids").alias(ids))
    return done.unionByName(back)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``decoded``: the bytes that the packed ids stand for."""
    name = ship(df.sparkSession, path)
    d = df.drop(out)
    schema = T.StructType([*d.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(name)
        for b in pieces(batches):
            got = [spelled(tokens, x.as_py()) for x in b.column(b.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], [*b.schema.names, out])

    return d.mapInArrow(run, schema)


def op8_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Contract rows: token count, digest of the ids and of what they decode to."""
    coded = encode(docs.select("doc_id", "text"), path, pattern).select("doc_id", "ids")
    return decode(coded, path).select(
        "doc_id", F.floor(F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
