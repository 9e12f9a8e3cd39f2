"""Fill-in-middle (op11), decontamination (op12), hard negatives (op13): brute force and edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm import decontaminate, fim, hardnegatives
from .util import DOCS, docs_table, with_clashes

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KEYED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- fill in the middle

def plain_fim(doc_id, text, seed=1):
    x = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    text = text or ""
    u = UNITS.findall(text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 20:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def fim_rows():
    rng = random.Random(11)
    parts = ["word", "Ab", " ", "\n", "é", "日本", "😀", "1", "<", "P>", ">", "\x00", "\r\n", "ß"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    return rows + [(300, None), (301, ""), (None, "no id here"), (302, "holds <M> marker"), (303, "<P"), (304, ">S>" * 30),
                   (305, "long text " * 30000), (306, "x" * 200000), (7, rows[7][1]), (7, "other text of the same id")]


def test_fim_against_plain_cuts(spark):
    rows = fim_rows()
    df = with_clashes(docs_table(spark, rows)).withColumn("form", F.lit("mine")).withColumn("output", F.lit("mine"))
    got = fim.fill_in_middle(df)
    got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((str(r.doc_id), r.text or "", r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in got) == \
        sorted((str(d), t or "", *map(shown, range(5), plain_fim(d, t))) for d, t in rows)
    assert all(r.back == (r.text or "") and r["size"] == "mine" for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def shown(at, x):
    return str(x) if at in (2, 3) else x


def test_fim_query_and_empty_table(spark):
    rows = fim_rows()
    got = fim.op11_fim(docs_table(spark, rows)).collect()
    want = [(d, *plain_fim(d, t), t or "") for d, t in rows]
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got))) == \
        sorted(map(str, ((d, n, f, p, m, sha(o), sha(t)) for d, n, f, p, m, o, t in want)))
    assert fim.op11_fim(spark.createDataFrame([], DOCS)).collect() == []


def test_fim_markers_that_could_arise_at_a_seam_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("ab", "ba", "<M>"), ("<P>", "<P>x", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Markers(*marks)
    fim.Markers("[pre]", "[suf]", "[mid]")


# ---------------------------------------------------------------- decontamination

def keyed_words(text):
    return KEYED.findall((text or "").translate(LOWER))


def plain_scan(docs, items, size=10):
    windows = {}
    for item, t in items:
        w = keyed_words(t)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    sizes = {len(g) for g in windows}
    out = []
    for d, t in docs:
        w, hit, who = keyed_words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                g = tuple(w[i:i + n])
                if g in windows:
                    hit |= set(range(i, i + n))
                    who |= windows[g]
        out.append((d, len(w), len(hit), len(who), sha(",".join(sorted(who))), bool(hit), sorted(hit)))
    return out


ITEM = "item_id long, text string"


def leak_tables():
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(30)] + ["Über", "ÉTÉ", "日本語", "x9"]
    def text(n):
        return "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--", ". "]) for _ in range(n))
    items = [(i, text(rng.randint(11, 25))) for i in range(8)]
    items += [(8, "Three word item"), (9, "w1"), (10, ""), (11, None), (None, text(12)), (3, text(14)), (12, items[0][1]), (12, items[0][1])]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    for i in range(60, 100):  # passages of items, whole or in part, in other writing
        w = keyed_words(items[i % 8][1])
        a = rng.randint(0, 3)
        docs.append((i, text(rng.randint(0, 9)) + " ".join(w[a:a + rng.randint(9, 25)]).upper() + "; " + text(rng.randint(0, 9))))
    docs += [(100, None), (101, ""), (102, "..."), (103, "THREE  word-item"), (None, items[1][1]), (104, "three word"), (60, docs[60][1]),
             (60, docs[60][1]), (60, "another text of this id"), (105, (items[2][1] + " zz ") * 800), (106, "w1 " * 3000)]
    return docs, items


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 4000])
def test_scan_against_plain_windows(spark, limit):
    docs, items = leak_tables()
    d, i = with_clashes(docs_table(spark, docs)), spark.createDataFrame(items, ITEM).withColumn("g", F.lit("mine")).withColumn("w", F.lit(1))
    v = decontaminate.scan(d, i, broadcast_bytes=limit)
    got = [(r["__id"], r.n_words, r.n_hit, len(r["items"]), sha(",".join(r["items"])), r.n_hit > 0,
            [k - 1 for s in r.spans for k in range(s["from"], s["until"])]) for r in v.collect() for _ in range(r.copies)]
    assert sorted(map(str, got)) == sorted(map(str, plain_scan(docs, items)))


def test_decontamination_query(spark):
    docs, items = leak_tables()
    got = decontaminate.op12_decontaminate(docs_table(spark, docs), spark.createDataFrame(items, ITEM)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(x[:-1]) for x in plain_scan(docs, items))
    none = spark.createDataFrame([], ITEM)
    assert all(not r.contaminated and r.items_sha256 == sha("") for r in decontaminate.op12_decontaminate(docs_table(spark, docs), none).collect())
    assert decontaminate.op12_decontaminate(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEM)).collect() == []


def test_documents_and_spans_are_removed(spark):
    docs, items = leak_tables()
    d, i = with_clashes(docs_table(spark, docs)), spark.createDataFrame(items, ITEM)
    v = decontaminate.scan(d, i)
    want = plain_scan(docs, items)
    kept = decontaminate.remove_documents(d, v)
    assert kept.columns == d.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == \
        sorted(str((k, t)) for (k, t), x in zip(docs, want) if not x[5])

    def cut(text, hit):
        if not hit:
            return text
        low = text.translate(LOWER)
        words = [m.span() for m in KEYED.finditer(low)]
        hit, out, at = set(hit), [], 0
        for k, (a, b) in enumerate(words):
            if k in hit:
                if k - 1 not in hit:
                    out.append(text[at:a])
                at = b
        return "".join(out) + text[at:]
    spared = decontaminate.remove_spans(d, v)
    assert spared.columns == d.columns and all(r["size"] == "mine" for r in spared.select("size").collect())
    assert sorted(map(str, ((r.doc_id, r.text) for r in spared.collect()))) == sorted(str((k, cut(t, x[6]))) for (k, t), x in zip(docs, want))
    again = decontaminate.scan(spared.where("doc_id = 105"), i).collect()
    assert again[0].n_hit == 0


# ---------------------------------------------------------------- hard negatives

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType())])


def plain_mine(rows, relabel=True, anchor=100, positives=5, negatives=5, low=80):
    import math
    live = []
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((i, [math.floor(256 * x) for x in v], (y + 1) % 10 if relabel and i % 7 == 0 else y))
    out = []
    for a, av, ay in live:
        if a % anchor:
            continue
        near = sorted((-sum(p * q for p, q in zip(av, v)), i, y) for i, v, y in live if i != a)
        for s, i, y in [x for x in near if x[2] == ay][:positives]:
            fit = [x for x in near if x[2] != ay and low * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, i, k, n[1], -s, -n[0]) for k, n in enumerate(fit, 1)]
    return sorted(out)


def vector_rows():
    rng = random.Random(13)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)], rng.randint(0, 3)) for i in range(620)]
    rows += [(1000 + i, [1.0, 0.5, 0.5, 0.0, 0.0, 0.0], i % 4) for i in range(400)]  # one vector in a third of the rows
    rows += [(2000, None, 1), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2200, [float("nan")] * 6, 1), (2300, [float("inf")] * 6, 2), (2400, [1.0] * 6, None),
             (None, [1.0] * 6, 1), (2500, [], 1), (2600, [1.0, 2.0], 2), (2700, [-1.0] * 6, 9), (100, rows[100][1], rows[100][2]), (33, rows[33][1], rows[33][2])]
    return rows


@pytest.mark.parametrize("limit", [hardnegatives.CHUNK_BYTES, 500])
def test_hard_negatives_against_all_pairs(spark, limit):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumn("v", F.lit("mine")).withColumn("ano", F.lit(1)).withColumn("score", F.lit(1))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hardnegatives.mine(df, F.col("vec_id") % 100 == 0, label, chunk_bytes=limit).collect()
    assert sorted(tuple(r) for r in got) == plain_mine(rows)


def test_hard_negative_query_and_general_parameters(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS)
    assert sorted(tuple(r) for r in hardnegatives.op13_hard_negatives(df).collect()) == plain_mine(rows)
    got = hardnegatives.mine(df, F.col("vec_id") % 50 == 0, positives=2, negatives=3, low=60).collect()
    assert sorted(tuple(r) for r in got) == plain_mine(rows, relabel=False, anchor=50, positives=2, negatives=3, low=60)
    assert hardnegatives.op13_hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []


def test_packed_keys_sort_by_anchor_score_kind_and_id():
    import numpy as np
    rng = random.Random(1)
    rows = [(rng.randint(0, 3), rng.choice([-(2 ** 40), -5, 0, 5, 2 ** 40]), rng.randint(0, 1), rng.choice([-7, 0, 3, 2 ** 50])) for _ in range(200)]
    keys = hardnegatives.packed(*[np.array(c) for c in zip(*rows)])
    assert [hardnegatives.unpacked(k) for k in sorted(keys)] == [(a, s, bool(n), i) for a, s, n, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))]
