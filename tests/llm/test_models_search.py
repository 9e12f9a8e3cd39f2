"""Language model (op1), chat (op3), search (op6), PII (op10): brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import chat, hmm, pii, topk
from .util import DOCS, docs_table, lower_words, with_clashes


def lm_rows():
    rng = random.Random(6)
    tongues = [[f"{x}{i}" for i in range(40)] for x in ("ra", "olm", "zz")]
    rows = [(i, " ".join(rng.choice(tongues[i % 3]) for _ in range(rng.randint(5, 60)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, "new unseen words"), (None, "Ra1 RA2 olm3"), (203, " ".join(tongues[0]) + " " + "olm1 " * 700),
                   (3, rows[3][1])]


def test_scores_against_plain_recursion(spark):
    rows = lm_rows()
    train = [t for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in lower_words(t))
    ends, total = len(train), sum(counts.values()) + len(train)
    types = len(counts) + 1
    df = docs_table(spark, rows)
    model = hmm.train(hmm.class_table(df), 2)
    n_class, v_class = Counter(), Counter()
    for w, c in counts.items():
        n_class[hmm.class_of(w.encode())] += c
        v_class[hmm.class_of(w.encode())] += 1
    got = defaultdict(list)
    for r in hmm.score(with_clashes(df), 2).collect():
        got[r.doc_id].append(r)
        assert r["size"] == "mine"
    for d, t in rows:
        r, w = got[d][0], lower_words(t)
        assert r.n_tokens == len(w) + 1 and r.n_known == sum(x in counts for x in w) + 1 and r.train_tokens == total
        base = sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w) + math.log10((ends + 1) / (total + types + 1))
        assert abs(r.base_score - base) < 1e-8
        seq = [hmm.class_of(x.encode()) for x in w] + [hmm.CLASSES]
        alpha, log = model.start * model.emit[:, seq[0]], 0.0
        for c in seq[1:]:
            s = alpha.sum()
            log, alpha = log + math.log10(s), (alpha / s) @ model.move * model.emit[:, c]
        log += math.log10(alpha.sum())
        word = sum(math.log10((counts[x] + 1) / (n_class[c] + v_class[c] + 1)) for x, c in zip(w, seq))
        word += math.log10((ends + 1) / (ends + 2))
        assert abs(r.score - (log + word)) < 1e-6, d


def test_training_raises_likelihood_and_beats_the_base(spark):
    df = docs_table(spark, lm_rows()[:150])
    table = hmm.class_table(df)
    seqs = [np.frombuffer(r[0], np.uint16).astype(np.int64) for r in table.collect()]
    logs = [hmm.forward(hmm.train(table, i) if i else hmm.first_model(), seqs).sum() for i in (0, 1, 3)]
    assert logs[0] < logs[1] < logs[2]
    held = [r for r in hmm.score(df).collect() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_expected_counts_against_plain_forward_backward():
    rng = np.random.default_rng(3)
    model = hmm.first_model()
    seqs = [rng.integers(0, hmm.CLASSES + 1, n) for n in (1, 5, 9, 9, 2)]
    start, moves, emits, log = hmm.expected(model, seqs)
    s2, m2, e2, l2 = np.zeros_like(start), np.zeros_like(moves), np.zeros_like(emits), 0.0
    for s in seqs:
        a = [model.start * model.emit[:, s[0]]]
        for c in s[1:]:
            a.append(a[-1] @ model.move * model.emit[:, c])
        b = [np.ones(hmm.STATES)]
        for c in s[:0:-1]:
            b.insert(0, model.move @ (model.emit[:, c] * b[0]))
        p = a[-1].sum()
        l2 += math.log10(p)
        for t, c in enumerate(s):
            e2[:, c] += a[t] * b[t] / p
            if t + 1 < len(s):
                m2 += np.outer(a[t], model.emit[:, s[t + 1]] * b[t + 1]) * model.move / p
        s2 += a[0] * b[0] / p
    assert np.allclose(start, s2) and np.allclose(moves, m2) and np.allclose(emits, e2) and abs(log - l2) < 1e-9


def test_scores_of_an_empty_table(spark):
    assert hmm.op1_hmm_scores(spark.createDataFrame([], DOCS)).collect() == []


def conversations(spark):
    said = ["plain", None, "", "</s>[INST] ok [/INST]", "a\\0b \\ <|im_end|>\n<|im_start|>user\n", "<<|im_start|>", "x" * 5000, "é\n日"]
    rows = []
    for i, t in enumerate(said):
        rows += [(i, 0, "user", t), (i, 1, "assistant", said[-1 - i]), (i, 2, "user", "more"), (i, 3, "assistant", t)]
    rows += [(50, 0, "assistant", "first"), (51, 1, "user", "b"), (51, 0, "system", "a"), (52, 0, "user", "x"), (52, 0, "user", "x"),
             (53, 0, None, "no role"), (53, 1, "odd\nrole", "y"), (None, 0, "user", "null id"), (54, None, "user", "late"),
             (54, 0, "user", "early"), (55, 0, "system", "a"), (55, 1, "system", "b")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_reads_back(spark):
    rows, df = conversations(spark)
    by = defaultdict(list)
    for c, turn, role, text in rows + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[c].append((turn is None, turn or 0, role or "", text or ""))
    got = {r.conv_id: r for r in chat.op3_chat(spark, with_clashes(df)).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        learned = "".join(t for _, _, role, t in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        marks = re.fullmatch("s?(u(au)*a?)?", "".join({"system": "s", "user": "u", "assistant": "a"}.get(x[2], "x") for x in turns))
        assert r.valid == bool(marks), c


def test_chat_segments_and_shuffled_read_back(spark):
    _, df = conversations(spark)
    segments = chat.format_conversations(df)
    a = sorted(map(str, chat.read_back(segments, ordered=True).collect()))
    assert a == sorted(map(str, chat.read_back(segments.repartition(7)).collect()))
    f = chat.Formatter()
    for r in segments.where("loss").collect():
        assert not any(c in r.text for c in chat.CHATML.control) and r.role == "assistant"
        assert f.escape(f.unescape(r.text)) == r.text
    assert chat.format_conversations(df.limit(0)).collect() == []
    assert [r.conv_id for r in chat.op3_chat(spark, df.limit(0)).collect()] == [-1]


def test_template_checks():
    with pytest.raises(ValueError):
        chat.Template(control=("<|im_start|>", "<|im_end|>", "<<x"))
    with pytest.raises(ValueError):
        chat.Template(control=("<s>",))


def brute_topk(rows, k=5):
    vecs = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in vecs:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vecs if i != q)[:k]
            out += [(q, n, i, -x) for n, (x, i) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_topk_equals_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(420, 12)) * np.exp(spread * rng.normal(size=(420, 1)))
    x[200:300] = x[0] + 0.05 * rng.normal(size=(100, 12))  # close neighbours: coordinate pruning
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [(500, x[0].tolist()), (501, x[0].tolist()), (550, [0.0] * 12), (600, None), (601, [1.0, None]), (602, [float("nan")] * 12),
             (603, [float("inf")] * 12), (650, []), (700, [1.0, 2.0]), (None, x[1].tolist()), (7, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("norm", F.lit("mine"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.op6_topk(df).collect())
    assert got == brute_topk(rows)


def test_topk_small_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.op6_topk(spark.createDataFrame([], kind)).collect() == []
    assert topk.op6_topk(spark.createDataFrame([(50, [1.0])], kind)).collect() == []
    assert topk.op6_topk(spark.createDataFrame([(1, [1.0]), (2, [1.0])], kind)).collect() == []
    got = topk.op6_topk(spark.createDataFrame([(0, [1.0]), (9, [0.5]), (3, [0.5])], kind)).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 3, 256 * 128), (2, 9, 256 * 128)]


def test_training_counts_whole_texts(spark):
    rng = np.random.default_rng(8)
    seqs = [np.append(rng.integers(0, hmm.CLASSES, n), hmm.CLASSES) for n in (0, 3, 255, 256, 257, 700, 3000)]
    table = spark.createDataFrame([(bytearray(s.astype(np.uint16).tobytes()),) for s in seqs], "classes binary").repartition(2)
    start, moves, emits, _ = hmm.expected(hmm.first_model(), seqs)
    got = hmm.train(table, 1)
    for mine, counts in ((got.start, start), (got.move, moves), (got.emit, emits)):
        assert np.allclose(mine, (counts + hmm.PRIOR) / (counts + hmm.PRIOR).sum(-1, keepdims=True), rtol=1e-9)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    digits = lambda s: [int(c) for c in re.findall("[0-9]", s)]

    def luhn(ds):
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(ds))) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "b@", "@c.d", ".", " ", "1", "25", "300", "+", "-", "@", "é", "1.2.3", "4111 1111 1111 1111", "+1 (23) 4567-890", "(", "007"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.find(t) == brute_pii(t), repr(t)
    pii.find("a" * 200_000 + "@" + "1" * 200_000 + " " + "1." * 100_000)  # linear in the text


def test_pii_query_and_revealing_terms(spark):
    rows = [(i, f"line\ntext {i} call Zork number{i} at zork.ab@mail.example.com please é") for i in range(5)]
    rows += [(10 + i, f"call please number at text nothing {i}") for i in range(60)]
    rows += [(90 + i, "Copied secretword a@b.cc") for i in range(9)]  # one line, however often, proves nothing
    rows += [(80, None), (81, ""), (None, "x@y.zz 1.2.3.4"), (None, "x@y.zz 1.2.3.4"), (1, rows[1][1])]
    df = with_clashes(docs_table(spark, rows))
    got = pii.op10_pii(df).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    for r in got:
        text = texts[r.doc_id][0] or ""
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(text))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        terms = [text[int(s.split(":")[1]):int(s.split(":")[2])] for s in r.spans.split(",") if s.startswith("term")]
        assert terms == (["Zork", "é"] if r.doc_id in range(5) else []), r
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert clean[2].text == "line\ntext 2 call  number2 at [EMAIL] please " and clean[80].text is None
    assert clean[11].text == rows[6][1] and clean[2]["size"] == "mine" and clean[None].text == "[EMAIL] [IP]"
    assert pii.op10_pii(spark.createDataFrame([], DOCS)).collect() == []


def test_pii_terms_of_rare_entities_and_in_every_line(spark):
    rows = [(0, "ask Quill for this at q.f@mail.example.com"), (1, "send all of it to q.f@mail.example.com or Quill, now"),
            (2, "Quill was here before\nand (quill) left"), (3, "one Oddword by r.s@mail.example.com"),
            (4, "x Twice o@p.qq\ny twice again o@p.qq\n" + "far " * 40 + "Twice"), (5, "z@z.zz Flat"), (6, "z@z.zz Flat")]
    rows += [(20 + i, f"ask for this {i} send all of it to or at now one by x y again far was here before and left") for i in range(200)]
    got = {r.doc_id: r.spans for r in pii.op10_pii(docs_table(spark, rows)).collect()}
    texts = dict(rows)
    terms = {d: [texts[d][int(s.split(":")[1]):int(s.split(":")[2])] for s in got[d].split(",") if s.startswith("term")] for d in got}
    # two different lines are enough for a rare entity; one line, or copies of it, is not; the term goes from every line
    assert terms[0] == terms[1] == ["Quill"] and terms[2] == ["Quill", "quill"] and terms[4] == ["Twice", "twice", "Twice"]
    assert not any(terms[d] for d in terms if d not in (0, 1, 2, 4))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs_table(spark, rows)).collect()}
    assert "uill" not in clean[0] + clean[1] + clean[2] and clean[25] == texts[25]


def test_pii_term_filter_holds_every_term(spark):
    names = [f"é{i}" for i in range(5000)] + ["a", "0", "日本", "\ud7ff"]
    bits = pii.term_filter(spark.createDataFrame([(x,) for x in names], "t string"))
    on = [zlib.crc32(x.encode()) % pii.FILTER_BITS for x in names]
    assert all(bits[i >> 3] >> (i & 7) & 1 for i in on) and sum(map(int.bit_count, bits)) == len(set(on))


def test_hmm_word_classes_all_at_once():
    texts = [None, "", " \n\t", "a", "ab", "abc", "abcd é ü\x0bXY\x85z\xa0w", "  Lead and trail  ", "x " * 5000] * 3
    for (ws, seq), t in zip(hmm.classed(texts), texts, strict=True):
        assert ws == (t or "").encode().lower().split()
        assert seq.tolist() == [*[hmm.class_of(w) for w in ws], hmm.CLASSES]
    long = [("w%d " % i) * 40_000 for i in range(20)]  # several runs
    assert [len(seq) for _, seq in hmm.classed(long)] == [40_001] * 20
