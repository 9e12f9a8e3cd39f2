"""The corpus job: its stages on a small corpus, against plain versions, and its edges."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

import corpus_pipeline as job
from pairlens.llm import bpe
from .test_quality_lines_mix import brute_lines, brute_quality, brute_targets
from .util import DOCS, Sets, docs_table, with_clashes, words


def corpus():
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = ["\n".join(line(rng.randint(10, 25)) for _ in range(rng.randint(3, 9))) for _ in range(60)]
    passage = "\n".join(line(20) for _ in range(3))
    rows = [(i, t if i % 5 else t + "\n" + passage, rng.choice(["a", "b", "hot", "hot", None])) for i, t in enumerate(texts)]
    for i in range(60, 80):  # near copies of one line
        w = texts[i - 60].replace("\n", " ").split()
        w[len(w) // 2] = "changed"
        rows.append((i, " ".join(w), "b"))
        w[0] = "other"
        rows.append((100 + i, " ".join(w), "a"))
    rows += [(300, "few words", "a"), (301, None, "a"), (302, "", "b"), (303, "same " * 100, "b"), (304, texts[3], "hot"),
             (5, texts[5] + "\n" + passage, rows[5][2])]
    return rows


def test_stages_against_plain_versions(spark, tmp_path):
    rows = corpus()
    docs = with_clashes(docs_table(spark, rows))
    names = [n for n, _ in job.STAGES]
    assert len(names) == 5

    def step(i, d):
        out = job.STAGES[i][1](spark, d, "")
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or sorted(out.columns) == sorted(d.columns)
        assert all(r["size"] == "mine" for r in out.collect())
        return out

    kept = step(0, docs)
    good = [r for r in rows if brute_quality(r[1])[0] >= 50 and 100 * brute_quality(r[1])[4] <= 50 * brute_quality(r[1])[0]]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _, _ in good)

    lined = step(1, kept)
    one = {d: t for d, t, _ in good}
    gone = brute_lines(list(one.items()))
    want = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[d]) for d, t in one.items()}
    got = {r.doc_id: r for r in lined.collect()}
    assert {d: t for d, t in want.items() if words(t)} == {d: r.text for d, r in got.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())

    single = step(2, lined)
    pairs = sorted((d, r.text) for d, r in got.items())
    comps = Sets(pairs, 5).component
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(comps))

    mixed = step(3, single)
    size, taken = defaultdict(int), defaultdict(int)
    for r in single.collect():
        size[r.source] += len(words(r.text))
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
    target = brute_targets(dict(size))
    assert all(abs(taken[s] - target[s]) <= 250 for s in size)
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2

    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    last = step(4, mixed).collect()
    assert len(last) == mixed.count() and all(r.decodes for r in last)
    assert all(bytes(r.ids) == codec.encode(r.text) and r.n_tokens * 4 == len(r.ids) for r in last)


@pytest.mark.parametrize("texts", [[], [None, ""], ["word " * 10]])
def test_run_on_little_input(spark, tmp_path, texts):
    df = docs_table(spark, texts) if texts else spark.createDataFrame([], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert job.run(spark, str(tmp_path)).collect() == []


def test_stages_apply_the_settings_of_the_job(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = docs_table(spark, [f"text {i}" for i in range(2500)]).coalesce(1)
    for stage in (job.quality_stage, job.line_stage, job.mixing_stage):
        spark.conf.set(size, 10000)  # Spark's own
        stage(spark, docs, "")
        assert spark.conf.get(size) == "1000"

    def rows_at_once(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    spark.conf.set(size, 10000)
    ns = [r["n"] for r in job.token_stage(spark, docs, "").select("ids").mapInArrow(rows_at_once, "n long").collect()]
    assert sum(ns) == 2500 and max(ns) <= 1000
