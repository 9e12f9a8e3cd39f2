"""Rule ledger (op4), line dedup (op5), mixing (op7): brute force and edge cases."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pairlens.llm import linededup, mixing, quality
from .util import DOCS, WORD, docs_table, with_clashes, words


def brute_quality(text):
    w = words(text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_and_verdicts(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "a b c a b c", "x\nx\nx\n\n", "é ü z a b c", "# $ %" * 40, "w " * 30000]
    texts += ["\n".join(" ".join(rng.choice("ab cd ef gh ij kl mn".split()) for _ in range(rng.randint(0, 30))) for _ in range(6))
              for _ in range(40)]
    texts += texts[-3:]
    rows = docs_table(spark, texts)
    got = {r.doc_id: r for r in quality.op4_quality_rules(rows).collect()}
    for i, t in enumerate(texts):
        r, b = got[i], brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, repr(t)[:80]
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r.base_failed and r.kept)


def test_quality_policies_and_ablations(spark):
    texts = ["word " * 60, "few", "### ### " * 60, " ".join(f"w{i}" for i in range(80)), "a\nb\nc"]
    book = quality.ledger(docs_table(spark, texts * 2)).cache()
    bits = [r.fail_bits for r in book.collect()]
    m = quality.mask(quality.POLICIES["v2"])
    for r in quality.ablations(book, "v2").collect():
        bit = quality.mask([r.rule])
        assert r.n_fail == sum(b & bit != 0 for b in bits)
        assert r.n_only == sum(b & m == bit for b in bits)
        assert r.n_kept_without == sum(b & m & ~bit == 0 for b in bits)


def test_quality_clashing_columns_and_empty_table(spark):
    rows = with_clashes(docs_table(spark, ["a b c", None]))
    out = quality.ledger(rows)
    assert out.count() == 2 and "mine" in [r.size for r in out.collect()]
    assert quality.op4_quality_rules(spark.createDataFrame([], DOCS)).collect() == []


def brute_lines(rows, g=25, t=50):
    """Every repeated run of whole lines with t words or more must lose its later copy."""
    content = {d: [(p, x) for p, x in enumerate((s or "").split("\n")) if WORD.search(x)] for d, s in rows}
    must = defaultdict(set)
    order = sorted(content)
    for d in order:
        for e in [x for x in order if x < d]:
            a, b = content[d], content[e]
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k][1] == b[j + k][1]:
                        k += 1
                    if sum(len(words(x)) for _, x in a[i:i + k]) >= t:
                        must[d].update(p for p, _ in a[i:i + k])
    return must


def test_line_dedup_deletes_later_runs(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, long_line, header = [line(12) for _ in range(6)], line(60), line(8)
    rows = []
    for i in range(12):
        body = [header, line(20), ""] + (passage if i % 3 == 0 else [line(12) for _ in range(5)])
        body += [line(15)] + ([long_line] if i % 4 == 1 else []) + [line(30)]
        rows.append((i, "\n".join(body)))
    rows += [(50, rows[0][1]), (51, None), (52, ""), (53, "\n\n"), (54, "x\n" * 300)]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs_table(spark, rows)).collect()}
    must = brute_lines(rows)
    for d, text in rows:
        r = got[d]
        if text is None:
            assert r.text is None
            continue
        kept, all_lines = Counter(r.text.split("\n")), text.split("\n")
        if d == 54:
            assert 1 <= r.text.count("x") < 60  # a periodic text keeps its first lines
            continue
        assert r.removed_lines == len(must[d]), d
        assert Counter(x for p, x in enumerate(all_lines) if p not in must[d]) == kept or not r.text
    assert header in got[7].text and long_line in got[1].text and long_line not in got[5].text


def test_line_dedup_edges(spark):
    assert linededup.op5_line_dedup(spark.createDataFrame([], DOCS)).collect() == []
    text = "\n".join(" ".join(f"a{i}_{j}" for j in range(20)) for i in range(5))
    rows = with_clashes(docs_table(spark, [(1, text), (1, text), (None, text), (2, "short")]))
    out = linededup.dedup_lines(rows).collect()
    assert sorted((r.doc_id or 99, len(r.text)) for r in out) == [(1, len(text)), (1, len(text)), (2, 5), (99, 0)]
    assert all(r.spans == "mine" for r in out)


def _removed(spark, rows):
    out = linededup.dedup_lines(docs_table(spark, rows)).collect()
    return {r.doc_id: (r.removed_lines, r.text) for r in out}


def test_line_dedup_takes_whole_runs_with_long_lines(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = [[line(n) for n in sizes] for sizes in ((10, 22, 93, 2), (5, 360, 7), (3, 120, 4, 90, 1, 1))]
    rows = [(0, "\n".join(a)), (1, "\n".join(a)), (2, "\n".join(b)), (3, "\n".join(["", *b, " "])),
            (4, "\n".join(c + [line(30)])), (5, "\n".join([line(8), *c[:3], "", *c[3:], line(9)]))]
    got = _removed(spark, rows)
    assert got[1] == (4, "") and got[3] == (3, "\n ") and got[5][0] == 6
    assert [x for x in got[5][1].split("\n")] == [rows[5][1].split("\n")[i] for i in (0, 4, 8)]
    assert all(got[d] == (0, rows[d][1]) for d in (0, 2, 4))


def test_line_dedup_random_line_lengths(spark):
    rng = random.Random(21)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = [[line(rng.choice([1, 2, 5, 12, 20, 60, 130])) for _ in range(rng.randint(1, 9))] for _ in range(8)]
    rows = []
    for i in range(50):
        body = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(shared)
            k = rng.randrange(len(p))
            body += p[k:k + rng.randint(1, 9)] + [line(rng.randint(1, 40))] * rng.randint(0, 1)
        rows.append((i, "\n".join(body)))
    got, must = _removed(spark, rows), brute_lines(rows)
    assert sum(map(len, must.values())) > 100
    for d, text in rows:
        # shorter runs and repeats within a document may go too
        kept = Counter(x for x in got[d][1].split("\n") if x)
        assert not kept - Counter(x for p, x in enumerate(text.split("\n")) if p not in must[d]), d


def test_line_dedup_longest_earlier_run(spark):
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    # p alone comes first; p and r together, 54 words, only in the later documents
    for _ in range(4):
        p, r = [line(15), line(15)], [line(12), line(12)]
        rows = [(1, "\n".join(p + [line(40)])), (2, "\n".join([line(30)] + p + r + [line(30)])),
                (3, "\n".join([line(35)] + p + r + [line(35)]))]
        got = _removed(spark, rows)
        assert got[3][0] == 4 and not any(x in got[3][1] for x in p + r)


def test_line_dedup_hot_passage_and_very_long_text(spark):
    rng = random.Random(13)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    hot = [line(9) for _ in range(8)]
    rows = [(i, "\n".join([line(11), *hot[:4 + i % 5], line(14)])) for i in range(60)]
    rows += [(100, "\n".join(line(7) for _ in range(3000)))]
    rows += [(101, "\n".join([line(3), *rows[100 - 40][1].split("\n")[500:2500], line(3)]))]
    got, must = _removed(spark, rows), brute_lines(rows)
    assert len(must[101]) == 2000 and got[101][0] == 2000 and got[100][0] == 0
    for d, text in rows:
        kept = Counter(got[d][1].split("\n"))
        assert not kept - Counter(x for p, x in enumerate(text.split("\n")) if p not in must[d]), d
        assert all(text.split("\n")[i] in kept for i in (0, -1))


def brute_targets(sizes, weights=(5, 2, 1), rate=1.5, limit=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    mass, full, out = rate * sum(sizes.values()), set(), {}
    while True:
        rest = mass - sum(limit * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        out = {s: limit * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if out[s] > limit * sizes[s] + 1e-9}
        if not over:
            return out
        full |= over


def test_mix_hits_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 80)), rng.choice(["b", "a", "hot", "hot", "hot", None, "é", "z"])) for i in range(900)]
    rows += [(None, None, None), (3, rows[3][1], rows[3][2]), (5, "", "empty")]
    df = docs_table(spark, rows)
    got = mixing.op7_mixing(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, taken = brute_targets(dict(sizes)), defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 81, s  # one document at most
    key = lambda x: sorted((r.doc_id or -1, r["size"], r.taken) for r in x)
    assert key(got) == key(mixing.op7_mixing(df.repartition(7)).collect())


def test_mix_probabilities_and_levels(spark):
    # 700 equal documents wanted 0.75 times each, in blocks of 4: many levels, exact count
    rows = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"),
                                   F.lit("mine").alias("stratum"), F.lit("x").alias("p"))
    out = mixing.mix(rows, weights=(1,), rate=0.75, block=4)
    copies = [r.copies for r in out.collect()]
    assert sum(copies) == 525 and set(copies) == {0, 1}
    assert mixing.replicated(out, ["doc_id", "p"]).count() == 525
    half = mixing.mix(rows, weights=(1,), rate=0.75, block=64).where("doc_id < 350").agg(F.sum("copies")).first()[0]
    assert 200 < half < 325  # both halves of the table are drawn alike
    assert mixing.op7_mixing(spark.createDataFrame([], DOCS)).collect() == []
