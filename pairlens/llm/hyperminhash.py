"""Near duplicates by HyperMinHash registers, banding, estimates and exact verification.

A document's set is its distinct word shingles. Its sketch has ``BUCKETS``
registers; each keeps the least hash of its bucket in compressed form, the count
of leading zeros and ``MANTISSA`` bits behind the leading one. An empty bucket
borrows the register of the first filled bucket in an order of its own, so small
sets fill all bands. Bands of ``ROWS`` registers are the candidate keys: sets with
similarity 0.8 miss each other in all 64 bands with probability 4e-9.

Documents with equal sets are one class from the start (grouped on the map side),
so copies are never paired. In a bucket, the least member is compared with all
others, not all with all: pairs grow with the members. After the components of
these links, only buckets that still hold several components are searched further,
in blocks, and only for pairs between components, which is all that can change the
result; a pair is looked at in the first band that its members share, in the task
that holds both full sets, and only links leave the task. Candidates must pass the
Jaccard estimate, corrected for chance collisions of registers, within six standard
deviations; then the full sets decide.

Sets are kept as 64-bit hashes of shingles, classes as 128-bit digests of the sets.

Defined results: a document without words or text has the empty set and links with
nothing; with fewer words than a shingle, the whole sequence is its one shingle;
documents are rows, so repeated rows are linked like other equal sets; a component
has the least doc_id in it, null only if all are null; an empty table gives an
empty result. Extra columns don't matter: only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .components import components

BUCKETS = 384
ROWS = 6
MANTISSA = 10
BLOCK = 128
WORD_CACHE = 300_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit integers so that all bits depend on all bits."""
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


class WordHashes:
    """64-bit hashes of the lower-cased words of a text; a bounded table of recent words saves rehashing."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        from xxhash import xxh3_64_intdigest
        words = text.encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        if len(known) > WORD_CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles (fewer words: the whole sequence as one)."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    acc = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        acc = mixed(acc * _M1 + words[j:n - size + 1 + j])
    return np.unique(acc)


@lru_cache(maxsize=1)
def _lenders() -> np.ndarray:
    """For every bucket, the order in which it looks for a filled one."""
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)]).astype(np.int64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set: BUCKETS registers of 16 bits."""
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (shingles % np.uint64(BUCKETS)).astype(np.int64), mixed(shingles + _M2))
    filled = least != np.iinfo(np.uint64).max
    high = least >> np.uint64(11)  # 53 bits: exact as a float
    zeros = np.minimum(53 - np.frexp(high.astype(np.float64))[1], 53).astype(np.uint64)
    bits = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = ((zeros << np.uint64(MANTISSA)) | bits).astype(np.uint16)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = _lenders()[empty]
        first = filled[order].argmax(axis=1)
        out[empty] = out[order[np.arange(len(empty)), first]]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    r = sketch.reshape(-1, ROWS).astype(np.uint64)
    acc = np.arange(len(r), dtype=np.uint64)
    for j in range(ROWS):
        acc = mixed(acc * _M1 + r[:, j])
    return acc.view(np.int64)


@lru_cache(maxsize=4096)
def chance(load_a: float, load_b: float) -> float:
    """Probability that two unrelated registers agree, for so many shingles per bucket (log2, rounded)."""
    i = np.arange(54, dtype=np.float64)[:, None]
    width = 2.0 ** (-i - 1 - MANTISSA)
    start = 2.0 ** (-i - 1) + width * np.arange(1 << MANTISSA)[None, :]
    a, b = (np.exp(-x * start) - np.exp(-x * (start + width)) for x in (2.0 ** load_a, 2.0 ** load_b))
    return float((a * b).sum())


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> float:
    """Jaccard similarity from two sketches, corrected for chance agreement."""
    load = lambda n: round(2 * float(np.log2(max(n / BUCKETS, 1.0)))) / 2
    c = chance(load(na), load(nb))
    return (float((a == b).mean()) - c) / (1 - c)


def lowest(percent: int) -> float:
    """The least estimate that a pair at the threshold may have: six standard deviations below."""
    t = percent / 100
    return t - 6 * (t * (1 - t) / BUCKETS) ** 0.5


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """Per row: doc_id, digest of the text, set size, class digest and sketch (null for the empty set)."""
    src = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n, sid, sk = [], [], []
            for x in b.column(1):
                s = shingle_set(hashes(x.as_py() or ""), k)
                n.append(len(s))
                sid.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sk.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(sk, pa.binary())],
                ["doc_id", "h", "n", "class", "sketch"])

    return src.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h bigint, n bigint, "
                               "class binary, sketch binary")


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Shingle sets (packed, sorted) of the wanted classes (node, doc_id, h).

    A class's text is taken from the row that stands for it; repeated rows are dropped where the
    join has put them side by side, so that texts are shuffled, but never the sets.
    """
    t = docs.select(F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("ti"), "text", F.xxhash64("text").alias("th"))
    w = wanted.select("node", F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("i"), "h")
    j = w.join(t, (F.col("i") == F.col("ti")) & (F.col("h") == F.col("th")))
    j = j.groupBy("i", "h", "node").agg(F.min("text").alias("text")).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            out = [shingle_set(hashes(x.as_py() or ""), k).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["node", "shingles"])

    return j.mapInArrow(run, "node bigint, shingles binary")


def _beside(pairs: DataFrame, table: DataFrame, cols: list[str]) -> DataFrame:
    """Pairs with the columns of both their nodes."""
    for side in "ab":
        t = table.select(F.col("node").alias(f"n{side}"), *[F.col(c).alias(f"{c}_{side}") for c in cols])
        pairs = pairs.join(t, F.col(side) == F.col(f"n{side}")).drop(f"n{side}")
    return pairs


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate can belong to the threshold."""
    least = lowest(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            ok = [estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), n, m) >= least
                  for x, y, n, m in zip(c["sketch_a"], c["sketch_b"], c["n_a"], c["n_b"])]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    sized = _beside(pairs, nodes, ["sketch", "n"])
    # sets of too different sizes cannot reach the threshold
    sized = sized.where((100 * F.least("n_a", "n_b")) >= percent * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold (stored)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    wanted = wanted.join(nodes.select("node", "doc_id", "h"), F.col("w") == F.col("node")).drop("w")
    sets = stored(_full_sets(docs, wanted, k), "shingle-sets")
    discard()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                s, t = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    links = stored(_beside(pairs, sets, ["shingles"]).select("a", "b", "shingles_a", "shingles_b").mapInArrow(
        run, "a bigint, b bigint"), "star-links")
    discard(sets)
    return links


def _keys(nodes: DataFrame) -> DataFrame:
    """Rows (key, node): every band key of every node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [band_keys(np.frombuffer(x.as_buffer(), np.uint16)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["node", "keys"])

    return nodes.select("node", "sketch").mapInArrow(run, "node bigint, keys array<bigint>").select(
        F.explode("keys").alias("key"), "node")


def _between(members: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components inside buckets (stored). ``members``: key, node, comp, count.

    A bucket is cut into blocks of about BLOCK members: a component of that many members has blocks
    of its own, the others share blocks. Blocks of one component never meet, as nothing between them can change
    the result; every two others meet once, and a task holds the sets of two blocks at a time. So a large group is sent
    as often as the rest of its bucket has blocks. Of the links of a node to one component, one is enough.
    """
    wanted = members.select("node").distinct().join(nodes.select(F.col("node").alias("nn"), "doc_id", "h"),
                                                    F.col("node") == F.col("nn")).drop("nn")
    sets = _full_sets(docs, wanted, k).withColumnRenamed("node", "sn")
    held = stored(nodes.select("node", "sketch", "n").join(sets, F.col("node") == F.col("sn")).drop("sn"), "block-sets")
    discard()
    least = lowest(percent)
    large = F.col("members") >= BLOCK
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("members"))
    shared = sizes.groupBy("key").agg(F.ceil(F.sum(F.when(large, 0).otherwise(F.col("members"))) / BLOCK).alias("shared"))
    # the component of a block (-1: several), and its number
    own = F.struct(F.col("comp").alias("of"), F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK)).alias("no"))
    mixed_ = F.struct(F.lit(-1).cast("bigint").alias("of"), F.pmod(F.xxhash64("comp"), F.col("shared")).alias("no"))
    m = members.select("key", "node", "comp").join(sizes, ["key", "comp"]).join(shared, "key")
    m = stored(m.select("key", F.col("node").alias("mn"), "comp", F.when(large, own).otherwise(mixed_).alias("blk")), "block-members")
    discard()
    ids = m.select("key", "blk").distinct()
    others = ids.select("key", F.col("blk").alias("other"))
    # which blocks meet is found by their names; the sets then join that list where they are
    meets = ids.join(others, "key").where((F.col("other.of") != F.col("blk.of")) | (F.col("blk.of") == -1))
    blocks = m.join(held, F.col("mn") == F.col("node")).groupBy("key", "blk").agg(
        F.collect_list(F.struct("node", "comp", "n", "sketch", "shingles")).alias("xs"))
    meet = blocks.join(meets, ["key", "blk"])
    meet = (meet.groupBy("key", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
            .agg(F.collect_list("xs").alias("sides")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, row in zip(b.column(0).to_pylist(), b.column(1)):
                sides = [_side(x) for x in row.values]
                band = int(np.flatnonzero(band_keys(sides[0][3][0]) == key)[0])  # keys differ between bands
                links = _links(sides[0], sides[-1], len(sides) == 1, band, least, percent)
                if links:
                    lo, hi = zip(*links)
                    yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["a", "b"])

    links = stored(meet.select("key", "sides").mapInArrow(run, "a bigint, b bigint").distinct(), "cross-links")
    discard(held, m)
    return links


def _side(members: pa.ListScalar) -> tuple:
    """A block as arrays over the batch's own memory: nodes, components, sizes, sketches, and the sets."""
    m = members.values
    return (*[m.field(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "n")],
            np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in m.field("sketch")]),
            [np.frombuffer(x.as_buffer(), np.uint64) for x in m.field("shingles")])


def _links(x: tuple, y: tuple, same: bool, band: int, least: float, percent: int) -> list[tuple[int, int]]:
    """Links between members of different components of two blocks of a bucket (or of one, if the same)."""
    nodes, comps, sizes, sketches, sets = y
    out = []
    for i in range(len(x[0])):
        n = x[2][i]
        fit = (comps != x[1][i]) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
        if same:
            fit[:i + 1] = False
        at = np.flatnonzero(fit)
        if not len(at):
            continue
        equal = sketches[at] == x[3][i]
        ok = equal.mean(axis=1) >= least  # the correction for chance agreement only lowers an estimate
        at, equal = at[ok], equal[ok]
        ok = equal.reshape(len(at), BUCKETS // ROWS, ROWS).all(axis=2).argmax(axis=1) == band  # no earlier band holds the pair
        at = [j for j in at[ok] if estimate(x[3][i], sketches[j], n, sizes[j]) >= least]
        if not at:
            continue
        own, others = x[4][i], np.concatenate([sets[j] for j in at])
        hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
        lens = sizes[at]
        both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(lens)[:-1]]))
        linked = 100 * both >= percent * (n + lens - both)
        done = set()
        for j, good in zip(at, linked):
            if good and comps[j] not in done:
                done.add(comps[j])
                out.append((int(min(x[0][i], nodes[j])), int(max(x[0][i], nodes[j]))))
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, h (hash of the text), n_shingles, component_id, and the row that stands
    for the component: rep_id and rep_h."""
    whole = stored(sketches(docs, k), "sketches")
    classes = whole.where("class IS NOT NULL").groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("r"),
        F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    nodes = stored(classes.select("class", "r.doc_id", "r.h", "n", "sketch",
                                  F.monotonically_increasing_id().alias("node")), "classes")
    rows = stored(whole.select("doc_id", "h", "n", "class"), "rows")
    discard(whole)
    keys = _keys(nodes)  # as good as stored: one pass over the sketches gives them again
    buckets = keys.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("count")).where("count > 1")
    shared = stored(keys.join(buckets, "key"), "shared-bands")
    discard()
    stars = shared.where("node > lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    tried = stored(_likely(stars, nodes, percent), "star-pairs")
    discard()
    links = _verified(tried, docs, nodes, k, percent)

    # buckets that still hold several components: pairs between those
    roots = components(links)
    discard()
    comp = F.coalesce("root", "node").alias("comp")
    m = shared.where("count > 2").join(roots.withColumnRenamed("node", "rn"), F.col("node") == F.col("rn"), "left")
    m = m.select("key", "node", comp, "count")
    split = m.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    m = stored(m.join(split, "key", "left_semi"), "split-buckets")
    discard(shared)
    links = links.unionByName(_between(m, docs, nodes, k, percent))
    discard(m)
    roots = components(links)

    of = nodes.join(roots.withColumnRenamed("node", "rn"), F.col("node") == F.col("rn"), "left").select(
        "class", comp, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h").alias("r"))
    least = of.groupBy("comp").agg(F.min("r").alias("rep"))
    of = of.join(least, "comp").select(F.col("class").alias("c"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.h").alias("rep_h"))
    out = rows.select("doc_id", "h", "n", "class").join(of, F.col("class") == F.col("c"), "left")
    alone = F.col("c").isNull()
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("rep_id")).alias("component_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("rep_id")).alias("rep_id"),
                      F.when(alone, F.col("h")).otherwise(F.col("rep_h")).alias("rep_h"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stand for their components; rows alike in doc_id and text are one document."""
    dup = near_duplicates(docs, k, percent)
    keep = dup.where(F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("h") == F.col("rep_h"))).select(
        F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    d = docs.withColumn("__th", F.xxhash64("text"))
    d = d.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h")), "left_semi")
    return d.dropDuplicates(["doc_id", "__th"]).select(*docs.columns)


def op9_minhash(docs: DataFrame) -> DataFrame:
    """Contract rows: 2-word shingles, similarity 0.8 or more."""
    return near_duplicates(docs, k=2, percent=80).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
