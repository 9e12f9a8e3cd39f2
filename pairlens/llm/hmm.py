"""A hidden Markov language model trained and scored over the cluster.

A text is its lower-cased words and one end. The model emits a word in two steps:
a hidden state emits a word class (``CLASSES`` of them, by the first and last
letters of the word, and one for the end), and the class emits the word:

    P(word | state) = B[state, class(word)] * (count(word) + 1) / (N(class) + V(class) + 1)

with add-one smoothing over the class's words of the training corpus and one
unknown word. States, transitions and class emissions have a fixed size, so they
are broadcast; word counts grow with the corpus and stay a distributed table.

Baum-Welch runs on classes: every task runs scaled forward and backward passes over
its training texts, whole and many of like length at a time, and returns its
expected counts; Spark adds them up, and the driver holds only the parameters. A
pass keeps some 70 bytes a token, of one batch or one longer text.
Scoring runs the scaled forward recursion over whole texts, so the likelihood is
that of the full sequence. A task scores texts of like length together, out of
``HELD_TOKENS`` tokens of texts, or one longer text. The word part is a sum over tokens and needs only
counts: frequent words come with the task (at most ``FREQUENT`` of them), all
others meet their counts in a join by word.

Defined results: a null or empty text is the end alone; words unseen in training
get the unknown word's share of their class; a document without an id counts as
one with an empty id for the fold; repeated rows train and score like any other;
with no training text the model is uniform and N is 0; an empty table gives an
empty result. Extra columns are carried; names of added columns are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

STATES = 6
CLASSES = 4096
ITERATIONS = 4
BATCH_TOKENS = 400_000
HELD_TOKENS = 4_000_000  # of texts that a task scores together
LANE_ROWS = 2048         # texts of like length in one recursion
RUN_BYTES = 1 << 20      # of texts whose words are classed together
SCALE_EVERY = 8
FREQUENT = 50_000
PRIOR = 0.1  # pseudo-count of every transition and emission
STAY = 0.9   # a state follows itself at the start of training


@dataclass
class Model:
    """Start, transition and class emission probabilities."""
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def class_of(word: bytes) -> int:
    """A word's class, by its first two and last three bytes."""
    return zlib.crc32(word[:2] + b" " + word[-3:]) % CLASSES


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def word_classes(text: bytes) -> np.ndarray:
    """``class_of`` every word of a lower-cased text, all at once."""
    b = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(~SPACE[b], prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    n = end - start

    def step(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
        return CRC[(crc ^ byte) & 255] ^ crc >> 8

    crc = step(np.full(len(n), 0xFFFFFFFF, np.uint32), b[start])
    crc = np.where(n > 1, step(crc, b[np.minimum(start + 1, end - 1)]), crc)
    crc = step(crc, 32)
    for k in (3, 2, 1):
        crc = np.where(n >= k, step(crc, b[np.maximum(end - k, start)]), crc)
    return ((crc ^ np.uint32(0xFFFFFFFF)) % CLASSES).astype(np.uint16)


def classed(texts: Iterable[str | None]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Per text its words and the classes of the words and of the end.

    Texts are classed in runs of about ``RUN_BYTES``, or one longer text.
    """
    run, words, size = [], [], 0

    def flush() -> Iterator[tuple[list[bytes], np.ndarray]]:
        ids, at = word_classes(b"\n".join(run)), 0
        for ws in words:
            yield ws, np.append(ids[at:at + len(ws)], np.uint16(CLASSES))
            at += len(ws)

    for x in texts:
        text = (x or "").encode("utf-8", "surrogatepass").lower()
        run.append(text)
        words.append(text.split())
        size += len(text)
        if size >= RUN_BYTES:
            yield from flush()
            run, words, size = [], [], 0
    yield from flush()


def first_model(seed: int = 11) -> Model:
    """States that stay and differ a little in what they emit, so that training can part them."""
    rng = np.random.default_rng(seed)
    emit = rng.lognormal(0.0, 0.5, (STATES, CLASSES + 1))
    move = np.full((STATES, STATES), (1 - STAY) / (STATES - 1)) if STATES > 1 else np.ones((1, 1))
    np.fill_diagonal(move, STAY if STATES > 1 else 1.0)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True))


def _aligned(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, as one array in time order: tokens, start of each step, order."""
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    lens = np.array([len(seqs[i]) for i in order])
    steps = np.arange(lens[0])
    active = np.searchsorted(-lens, -steps, side="left")  # sequences longer than the step
    start = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(start[-1], np.int64)
    for row, i in enumerate(order):
        flat[start[:lens[row]] + row] = seqs[i]
    return flat, start, order


def forward(model: Model, seqs: list[np.ndarray], keep: bool = False):
    """Log10 likelihood of every sequence by the scaled forward recursion (and, if kept, the passes).

    The passes are scaled every ``SCALE_EVERY`` steps and where a sequence ends; one column per token.
    """
    flat, start, order = _aligned(seqs)
    emit, move = np.ascontiguousarray(model.emit), np.ascontiguousarray(model.move.T)
    alpha = np.empty((len(model.start), len(flat) if keep else 0))
    scales = np.ones(len(flat) if keep else 0)
    log = np.zeros(len(seqs))
    bounds = [*start.tolist(), int(start[-1])]
    a = None
    for t in range(len(bounds) - 2):
        lo, hi, after = bounds[t:t + 3]
        e = emit.take(flat[lo:hi], 1)
        a = np.multiply(e, model.start[:, None], e) if t == 0 else np.multiply(move @ a[:, :hi - lo], e, e)
        first = 0 if t % SCALE_EVERY == SCALE_EVERY - 1 else after - hi  # of the columns to scale
        if first < hi - lo:
            part = a[:, first:]
            c = part.sum(0)
            part /= c
            log[first:hi - lo] += np.log10(c)
            if keep:
                scales[lo + first:hi] = c
        if keep:
            alpha[:, lo:hi] = a
    out = np.empty(len(seqs))
    out[order] = log
    return (out, flat, start, alpha, scales) if keep else out


def expected(model: Model, seqs: list[np.ndarray]):
    """Expected start, transition and emission counts of the sequences, and their log10 likelihood."""
    log, flat, start, gamma, scales = forward(model, seqs, keep=True)  # the forward pass becomes gamma in place
    k, emit = len(model.start), np.ascontiguousarray(model.emit)
    moves = np.zeros((k, k))
    bounds = start.tolist()
    x, n = np.empty((k, 0)), 0  # backward pass times emission of the step behind, and its columns
    for t in range(len(bounds) - 2, -1, -1):
        lo, hi = bounds[t], bounds[t + 1]
        g = gamma[:, lo:hi]
        b = np.ones((k, hi - lo))
        if n:
            moves += g[:, :n] @ x.T
            b[:, :n] = model.move @ x
        g *= b
        x, n = b, hi - lo
        x *= emit.take(flat[lo:hi], 1)
        x /= scales[lo:hi]
    emits = np.stack([np.bincount(flat, gamma[z], CLASSES + 1) for z in range(k)])
    return gamma[:, :start[1]].sum(1), moves * model.move, emits, float(log.sum())


def _batches(seqs: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sequences of like length (within a factor of two) in lists of about BATCH_TOKENS tokens."""
    lanes: dict[int, tuple[list[np.ndarray], int]] = {}
    for s in seqs:
        lane = len(s).bit_length()
        held, size = lanes.pop(lane, ([], 0))
        held.append(s)
        size += len(s)
        if size >= BATCH_TOKENS:
            yield held
        else:
            lanes[lane] = held, size
    yield from (held for held, _ in lanes.values())


def in_training(doc_id: Column) -> Column:
    """The fold: crc32 of the id as text, mod 7, is not 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def training_pass(docs: DataFrame) -> DataFrame:
    """One stored pass over the training texts: rows of class sequences (packed 16-bit), rows of counts (word, c) by task."""
    src = docs.where(in_training(F.col("doc_id"))).select("text")
    names = ["classes", "word", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def flush() -> pa.RecordBatch:
            n = len(counts)
            out = pa.RecordBatch.from_arrays([pa.nulls(n, pa.binary()), pa.array(list(counts), pa.binary()),
                                              pa.array(list(counts.values()), pa.int64())], names)
            counts.clear()
            return out
        for b in batches:
            out = []
            for ws, seq in classed(b.column(0).to_pylist()):
                out.append(seq.tobytes())
                counts.update(ws)
                if len(counts) > 500_000:
                    yield flush()
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names)
        yield flush()

    return stored(src.mapInArrow(run, "classes binary, word binary, c bigint"), "hmm-pass")


def class_table(docs: DataFrame, both: DataFrame | None = None) -> DataFrame:
    """The class sequences of the training texts, for the passes of training."""
    return (training_pass(docs) if both is None else both).where("classes IS NOT NULL").select("classes")


def word_counts(docs: DataFrame, both: DataFrame | None = None) -> DataFrame:
    """(word, c): counts of the training words, combined in the tasks first."""
    return (training_pass(docs) if both is None else both).where("word IS NOT NULL").groupBy("word").agg(F.sum("c").alias("c"))


def train(table: DataFrame, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over the stored class sequences; each round is one job whose result is the model's size."""
    model = first_model()
    for _ in range(iterations):
        now = model

        def run(batches: Iterator[pa.RecordBatch], model: Model = now) -> Iterator[pa.RecordBatch]:
            start, moves = np.zeros(STATES), np.zeros((STATES, STATES))
            emits = np.zeros((STATES, CLASSES + 1))

            def texts():
                for b in batches:
                    for x in b.column(0):
                        yield np.frombuffer(x.as_buffer(), np.uint16).astype(np.int64)

            for held in _batches(texts()):
                s, m, e, _ = expected(model, held)
                start, moves, emits = start + s, moves + m, emits + e
            # rows: one per class, then one per state of origin, then the start
            rows = np.concatenate([emits.T, moves, start[None]])
            at = np.arange(len(rows))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(rows[:, z]) for z in range(STATES)]],
                                             ["row", *[f"s{z}" for z in range(STATES)]])

        cols = [f"s{z}" for z in range(STATES)]
        sums = (table.mapInArrow(run, "row int, " + ", ".join(f"{c} double" for c in cols))
                .groupBy("row").agg(*[F.sum(c).alias(c) for c in cols]).collect())
        got = np.zeros((CLASSES + 1 + STATES + 1, STATES))
        for r in sums:
            got[r[0]] = r[1:]
        emit = got[:CLASSES + 1].T + PRIOR
        move = got[CLASSES + 1:-1] + PRIOR
        start = got[-1] + PRIOR
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    return model


def score(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """The documents with held_out, n_tokens, n_known, train_tokens, base_score and score."""
    both = training_pass(docs)
    counts = stored(word_counts(docs, both), "hmm-words")
    ends = docs.where(in_training(F.col("doc_id"))).count()
    by_class = counts.mapInArrow(_class_totals, "class int, n bigint, v bigint").groupBy("class").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # at most CLASSES rows
    n_class, v_class = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in by_class:
        n_class[r["class"]], v_class[r["class"]] = r["n"], r["v"]
    total = int(n_class.sum()) + ends
    types = int(v_class.sum()) + (1 if ends else 0)
    n_class[CLASSES], v_class[CLASSES] = ends, 1 if ends else 0
    frequent = {bytes(r["word"]): math.log10(r["c"] + 1) for r in counts.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()}
    model = train(class_table(docs, both), iterations)

    below = np.log10(n_class + v_class + 1)
    base_below = float(np.log10(total + types + 1))
    end_c = ends
    d = docs.drop("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in d.columns if c != "text"]
    sent = docs.sparkSession.sparkContext.broadcast((model, frequent, below))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
              T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
              T.StructField("__rare", T.ArrayType(T.BinaryType())), T.StructField("__times", T.ArrayType(T.LongType()))]
    schema = T.StructType([*[d.schema[c] for c in keep], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent, below = sent.value
        end = float(np.log10(end_c + 1))
        held: list[pa.RecordBatch] = []  # rows that wait for the hidden part of their score
        seqs: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            hidden = np.zeros(len(seqs))
            lanes = defaultdict(list)
            for i, s in enumerate(seqs):
                lanes[len(s).bit_length()].append(i)
            for lane in lanes.values():
                for i in range(0, len(lane), LANE_ROWS):  # a step's columns stay in the cache
                    part = lane[i:i + LANE_ROWS]
                    hidden[part] = forward(model, [seqs[j] for j in part])
            done = 0
            for h in held:
                at = h.schema.get_field_index("score")
                total = pa.array(h.column(at).to_numpy() + hidden[done:done + h.num_rows], pa.float64())
                yield h.set_column(at, "score", total)
                done += h.num_rows
            held.clear()
            seqs.clear()

        size = 0
        for b in batches:
            at = b.schema.get_field_index("text")
            n_tokens, seen, base, word, rare, times = [], [], [], [], [], []
            for ws, seq in classed(b.column(at).to_pylist()):
                n = len(seq)
                logs = np.fromiter(map(frequent.get, ws, repeat(0.0)), np.float64, n - 1)
                # a word that isn't frequent counts as unknown here; the join adds log10(count + 1)
                few = Counter(compress(ws, logs == 0.0))
                part = float(logs.sum()) + end
                n_tokens.append(n)
                seen.append(n - 1 - few.total() + (1 if end_c else 0))
                base.append(part - n * base_below)
                word.append(part - float(below[seq].sum()))
                rare.append(list(few))
                times.append(list(few.values()))
                seqs.append(seq)
                size += n
            rows = [pa.array(n_tokens, pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64()),
                    pa.array(word, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
            held.append(pa.RecordBatch.from_arrays([*b.remove_column(at).columns, *rows], schema.names))
            if size >= HELD_TOKENS:
                yield from flush()
                size = 0
        yield from flush()

    scored = stored(d.mapInArrow(run, schema).withColumn("__uid", F.monotonically_increasing_id()), "hmm-scored")
    pairs = scored.select("__uid", F.explode(F.arrays_zip(F.col("__rare").alias("word"), F.col("__times").alias("times"))).alias("z"))
    hit = (pairs.select("__uid", "z.word", "z.times").join(counts, "word").groupBy("__uid")
           .agg(F.sum("times").alias("__k"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("__add")))
    out = scored.drop("__rare", "__times").join(hit, "__uid", "left")
    add = F.coalesce("__add", F.lit(0.0))
    return out.select(
        *[F.col(f"`{c}`") for c in keep], (~in_training(F.col("doc_id"))).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("__k", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + add).alias("base_score"), (F.col("score") + add).alias("score"))


def _class_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and types of each class in the word counts of a task."""
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for b in batches:
        c = word_classes(b"\n".join(b.column(0).to_pylist()))
        n += np.bincount(c, b.column(1).to_numpy(), CLASSES).astype(np.int64)
        v += np.bincount(c, minlength=CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES), pa.int32()), pa.array(n), pa.array(v)], ["class", "n", "v"])


def op1_hmm_scores(docs: DataFrame) -> DataFrame:
    """Contract rows."""
    return score(docs.select("doc_id", "text"))
