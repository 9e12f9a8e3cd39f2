"""Personal data by patterns, and terms that give it away by corpus statistics.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each value
found is a protected entity. A term is a word, lower-cased and without punctuation
at its ends. How much a term reveals of an entity is their pointwise mutual
information over documents as a share of the entity's information content:

    reveals(t, e) = log(n(t, e) * n / (n(t) * n(e))) / log(n / n(e))

n(t, e) counts documents in which t and e meet, at most ``WINDOW`` words apart in
a line; 1 means that whoever
reads t knows e. A term that reveals ``REMOVE`` or more goes, and one that reveals
``GENERALISE`` or more becomes a placeholder, in all documents, whether or not
they hold the entity. All counts cover all documents.

Copies of one line prove nothing, so only different lines count as evidence. The
first line in which a term meets an entity names the pair, and every further one
tests it: ``SUPPORT`` different lines are enough, and fewer are if chance would
bring the further ones about with a probability of ``CHANCE`` at most (bounded by
the divergence of the term's share of documents with the entity from that of all
documents). So a rare entity is tested from its second line on.

The counts of terms are combined in the tasks and then by term; co-occurrences
are rows (entity, term, line) of documents that hold an entity, counted in two
steps, so a common entity or term is spread. Places of revealing terms are found
by a second pass over all texts, joined by term; a bitmap of fixed size over the
terms' hashes keeps most other words out of that join.

Defined results: a null or empty text has no spans; rows alike in doc_id and text
get the same spans; spans of different kinds may overlap, of one kind never; with
an empty table the result is empty. Extra columns are carried by ``sanitise``;
names of added columns are replaced where they clash.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

KINDS = ["email", "ip", "card", "phone"]
SUPPORT = 3
CHANCE = 0.05
WINDOW = 20
GENERALISE = 0.7
REMOVE = 0.9

# Bits of the filter over terms, a multiple of the bits that Spark's bitmap functions put in one bucket.
FILTER_BITS = 1 << 22
BUCKET_BITS = 1 << 15

# The patterns of the four kinds. The first two are matched in
# linear time: an address around its @, groups of digits in fours.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # shorter runs are passed over below
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        groups = [(g.start(), g.end()) for g in re.finditer(r"[0-9]+", m.group())]
        for i in range(0, len(groups) - 3, 4):
            four = groups[i:i + 4]
            parts = [m.group()[a:b].lstrip("0") for a, b in four]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                yield m.start() + four[0][0], m.start() + four[3][1]


def luhn(digits: str) -> bool:
    twice = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = "".join(DIGIT.findall(m.group())) if len(m.group()) <= 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= len(DIGIT.findall(m.group())) <= 15:
            yield m.span()


def find(text: str) -> list[tuple[str, int, int]]:
    """All base spans, by kind and then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for kind, match in (("ip", addresses), ("card", cards), ("phone", phones)):
            out += [(kind, a, b) for a, b in match(text)]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def value(kind: str, s: str) -> str:
    """An entity's value, the same however it is written."""
    return f"{kind}:" + (s.lower() if kind in ("email", "ip") else "".join(DIGIT.findall(s)))


def bare(text: str, a: int, b: int) -> tuple[str, int, int]:
    """A word's term and where it stands."""
    word = text[a:b]
    term = word.strip(PUNCTUATION)
    head = a + len(word) - len(word.lstrip(PUNCTUATION))
    return term.lower(), head, head + len(term)


def touched(starts: list[int], spans: list[tuple[str, int, int]]) -> set[int]:
    """The words, given by their starts, that a base span touches."""
    out = set()
    for _, a, b in spans:
        out.update(range(max(bisect_right(starts, a) - 1, 0), bisect_left(starts, b)))
    return out


def terms_beside(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, str, int, int, int]]:
    """(entity, term, start, end, hash of the line) for the words within WINDOW words of an entity in its line."""
    out, spans = [], sorted(spans, key=lambda s: s[1])
    at, i = 0, 0
    for line in text.split("\n"):
        end = at + len(line)
        here = []
        while i < len(spans) and spans[i][1] < end:
            here.append(spans[i])
            i += 1
        if here:
            mark = zlib.crc32(line.encode("utf-8", "surrogatepass"))
            words = [(at + m.start(), at + m.end()) for m in re.finditer(r"\S+", line)]
            starts = [a for a, _ in words]
            inside = touched(starts, here)
            for kind, a, b in here:
                e = value(kind, text[a:b])
                for j in range(max(0, bisect_left(starts, a) - WINDOW), min(len(words), bisect_left(starts, b) + WINDOW)):
                    term, head, tail = bare(text, *words[j])
                    if term and j not in inside:
                        out.append((e, term, head, tail, mark))
        at = end + 1
    return out


def meetings(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Each (entity, term, line) of the text once; ``new`` is 1 in the first line of a pair."""
    out, pairs = [], set()
    for e, t, line in dict.fromkeys((e, t, line) for e, t, _, _, line in terms_beside(text, spans)):
        out.append({"e": e, "t": t, "line": line, "new": int((e, t) not in pairs)})
        pairs.add((e, t))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, h (hash of the text), counts and spans of each kind, entities, terms beside them by line."""
    src = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    beside = pa.list_(pa.struct([("e", pa.string()), ("t", pa.string()), ("line", pa.int64()), ("new", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = {k: [] for k in KINDS}
            base, entities, near = [], [], []
            for x in batch.column(2):
                text = x.as_py() or ""
                spans = find(text)
                kinds = Counter(k for k, _, _ in spans)
                for k in KINDS:
                    n[k].append(kinds[k])
                base.append(joined(spans))
                entities.append(sorted({value(k, text[a:b]) for k, a, b in spans}))
                near.append(meetings(text, spans) if spans else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(n[k], pa.int64()) for k in KINDS], pa.array(base, pa.string()),
                 pa.array(entities, pa.list_(pa.string())), pa.array(near, beside)],
                ["doc_id", "h", *[f"n_{k}" for k in KINDS], "base", "entities", "beside"])

    return src.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h bigint, "
                          + ", ".join(f"n_{k} bigint" for k in KINDS)
                          + ", base string, entities array<string>, "
                            "beside array<struct<e:string,t:string,line:bigint,new:bigint>>")


def term_counts(docs: DataFrame) -> DataFrame:
    """(t, n_t): in how many documents each term occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                             ["t", "n"])
            counts.clear()
            return out
        for b in batches:
            for x in b.column(0):
                words = set((x.as_py() or "").split())
                counts.update({w.strip(PUNCTUATION).lower() for w in words})
                if len(counts) > 300_000:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "t string, n bigint").groupBy("t").agg(F.sum("n").alias("n_t"))


def revealing(docs: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE,
              remove: float = REMOVE, chance: float = CHANCE) -> DataFrame:
    """(e, t, reveals, action): the terms that give an entity away."""
    n = float(found.count())
    by_line = found.select(F.explode("beside").alias("z")).groupBy("z.e", "z.t", "z.line").agg(F.sum("z.new").alias("n"))
    pairs = by_line.groupBy("e", "t").agg(F.sum("n").alias("n_te"), F.count("*").alias("lines")).where(
        F.col("lines") >= min(support, 2))
    of_e = found.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    j = pairs.join(of_e, "e").join(term_counts(docs), "t")
    reveals = F.log(F.col("n_te") * n / (F.col("n_t") * F.col("n_e"))) / F.log(F.lit(n) / F.col("n_e"))
    j = j.where(F.col("n_e") < n).withColumn("reveals", reveals).where(F.col("reveals") >= generalise)
    # Chernoff bound, per line that holds both: share of the term's documents with the entity against that of all documents
    share, base = F.col("n_te") / F.col("n_t"), F.col("n_e") / F.lit(n)
    rest = F.when(share < 1, (1 - share) / share * F.log((1 - share) / (1 - base))).otherwise(0.0)
    proof = (F.col("lines") - 1) * (F.log(share / base) + rest)
    j = j.where((F.col("lines") >= support) | (proof >= -math.log(chance)))
    return j.select("e", "t", "reveals", F.when(F.col("reveals") >= remove, "remove").otherwise("generalise").alias("action"))


def term_filter(terms: DataFrame) -> bytes:
    """A bitmap with the bit of every term's hash set."""
    at = F.crc32("t") % FILTER_BITS + 1
    out = bytearray(FILTER_BITS // 8)
    for r in terms.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect():
        first = (r.bucket - 1) * BUCKET_BITS // 8
        out[first:first + len(r.bits)] = r.bits
    return bytes(out)


def places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, h, a, b, t): the words that are terms of ``terms`` or share a bit of its filter, outside base spans."""
    bits = term_filter(terms)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def passes(word: str) -> bool:
        i = zlib.crc32(word.strip(PUNCTUATION).lower().encode("utf-8", "surrogatepass")) % FILTER_BITS
        return bool(bits[i >> 3] >> (i & 7) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            rows, at = [], []
            for i, x in enumerate(batch.column(2)):
                text = x.as_py() or ""
                if len(known) > 300_000:
                    known.clear()
                hits = set()
                for w in set(text.split()):
                    hit = known.get(w)
                    if hit is None:
                        hit = known[w] = passes(w)
                    if hit:
                        hits.add(w)
                if not hits:
                    continue
                words = [m.span() for m in re.finditer(r"\S+", text)]
                inside = touched([a for a, _ in words], find(text))
                for j, (a, b) in enumerate(words):
                    if text[a:b] in hits and j not in inside:
                        term, head, tail = bare(text, a, b)
                        if term:
                            rows.append((term, head, tail))
                            at.append(i)
                if len(rows) > 100_000:
                    yield placed(batch, at, rows)
                    rows, at = [], []
            yield placed(batch, at, rows)

    def placed(batch: pa.RecordBatch, at: list[int], rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
        i = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(i), batch.column(1).take(i), pa.array([a for _, a, _ in rows], pa.int64()),
             pa.array([b for _, _, b in rows], pa.int64()), pa.array([t for t, _, _ in rows], pa.string())],
            ["doc_id", "h", "a", "b", "t"])

    src = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return src.mapInArrow(run, f"doc_id {kind}, h bigint, a bigint, b bigint, t string")


def detect(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, h, counts, ``base`` spans, ``spans`` of all kinds and the term ``actions``."""
    found = stored(scan(docs), "pii-scan")
    terms = stored(revealing(docs, found).groupBy("t").agg(F.max("action").alias("action")), "pii-terms")
    hit = (places(docs, terms).join(terms, "t").groupBy("doc_id", "h", "a", "b").agg(F.max("action").alias("action"))
           .groupBy(F.col("doc_id").alias("i"), F.col("h").alias("g"))
           .agg(F.sort_array(F.collect_list(F.struct("a", "b", "action"))).alias("actions")))
    out = found.drop("beside", "entities").join(
        hit, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left").drop("i", "g")
    texts = F.array_join(F.transform("actions", lambda x: F.concat_ws(":", F.lit("term"), x["a"], x["b"])), ",")
    more = F.coalesce(texts, F.lit(""))
    spans = F.when(more == "", F.col("base")).when(F.col("base") == "", more).otherwise(F.concat_ws(",", "base", more))
    return out.withColumn("spans", spans)


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` freed of what was found, and ``spans`` of the original text.

    Base spans become a placeholder of their kind, revealing terms a placeholder or nothing.
    """
    d = docs.drop("spans")
    marks = detect(docs).select(F.col("doc_id").alias("__i"), F.col("h").alias("__g"), "spans", F.col("actions").alias("__a"))
    marks = marks.dropDuplicates(["__i", "__g"])
    j = d.withColumn("__t", F.xxhash64("text")).join(
        marks, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__g")), "left").drop("__i", "__g", "__t")
    schema = T.StructType([*d.schema.fields, T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.schema.get_field_index
            out = []
            for x, spans, acts in zip(b.column(c("text")), b.column(c("spans")), b.column(c("__a"))):
                out.append(_replaced(x.as_py(), spans.as_py() or "", acts.as_py() or []))
            cols = {name: b.column(c(name)) for name in schema.names} | {"text": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([cols[name] for name in schema.names], schema.names)

    return j.mapInArrow(run, schema)


def _replaced(text: str | None, spans: str, actions: list[dict]) -> str | None:
    if text is None or not spans:
        return text
    acts = {(x["a"], x["b"]): x["action"] for x in actions}
    marks = []
    for s in spans.split(","):
        kind, a, b = s.split(":")
        a, b = int(a), int(b)
        marks.append((a, -b, "" if acts.get((a, b)) == "remove" and kind == "term" else f"[{kind.upper()}]"))
    out, at = [], 0
    for a, b, mark in sorted(marks):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def op10_pii(docs: DataFrame) -> DataFrame:
    """Contract rows."""
    return detect(docs.select("doc_id", "text")).select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
