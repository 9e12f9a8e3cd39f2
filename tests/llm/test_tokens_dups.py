"""BPE (op8), near duplicates (op9), shards (op2): library, brute force, round trips."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pairlens.llm import bpe, components, hyperminhash, shards
from .util import DOCS, Sets, docs_table, lower_words, with_clashes

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


ALPHABET = ["a", "b", "the", " ", "  ", "\n", "'", "re", "'s", "1", "23", "é", "ß", "日本", "\x85", "\xa0", "\x1c", "!", "...",
            " ", "\t", "𝄞", "ing", "\0", "Q", "　"]


def test_tree_reduction_equals_the_library(codec, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(bpe, "LEAF", 8)
    monkeypatch.setattr(bpe, "PIECE", 8)
    for k in range(1500):
        t = "".join(rng.choice(ALPHABET if k % 3 else ["a", "ab", "the", "日", "ñ"]) for _ in range(rng.randint(0, 150)))
        want = packed(codec.base.encode_ordinary(t))
        assert codec.encode(t) == want, repr(t)
        cut = rng.randint(1, 40)
        assert codec.reduce([(t[i:i + cut], codec.encode(t[i:i + cut])) for i in range(0, len(t), cut)]) == want, repr(t)
        assert codec.decode(want) == t.encode()


def test_long_runs(codec):
    for t in ["a" * 5000, "ab" * 3000, "日本語" * 1500, "-" * 4000, " " * 3000 + "x", "1" * 3000]:
        assert codec.encode(t) == packed(codec.base.encode_ordinary(t))


def test_bpe_query(spark, codec):
    long_text = "Der Fluss, 12 ways; l'été  \n" * 400
    texts = [None, "", "x", " \n ", long_text, long_text, "日" * 900, "plain words and more"]
    rows = docs_table(spark, texts)
    want = {i: codec.base.encode_ordinary(t or "") for i, t in enumerate(texts)}
    for r in bpe.op8_bpe(rows, PATH, public_tokenizers.PATTERN).collect():
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(packed(want[r.doc_id])).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    # long texts dealt out as spans, other columns carried
    out = bpe.encode(with_clashes(rows), PATH, public_tokenizers.PATTERN, span=500).collect()
    assert len(out) == len(texts)
    for r in out:
        assert bytes(r.ids) == packed(want[r.doc_id]) and r.text == texts[r.doc_id] and r["size"] == "mine"
    assert bpe.op8_bpe(spark.createDataFrame([], DOCS), PATH, public_tokenizers.PATTERN).collect() == []


def test_workers_take_large_batches_in_pieces(codec, monkeypatch):
    """A batch of 27 MB leaves in pieces of about one, and decoding builds no encoder."""
    import pyarrow as pa
    monkeypatch.setattr(bpe, "ship", lambda spark, path: path)
    monkeypatch.setattr(bpe.SparkFiles, "get", lambda name: name)
    frame = type("Frame", (), {"sparkSession": None, "schema": bpe.T.StructType(), "drop": lambda self, c: self,
                               "mapInArrow": lambda self, task, schema: task})()
    text = "plain words and more " * 64
    ids = codec.encode(text)
    n = 27_000_000 // len(ids)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "ids": pa.array([ids] * n, pa.binary())})
    bpe._codec.cache_clear()
    monkeypatch.setattr(bpe, "Codec", None)
    out = list(bpe.decode(frame, PATH)(iter([batch, batch.slice(0, 0), batch.slice(5, 1)])))
    assert [i for b in out for i in b["doc_id"].to_pylist()] == [*range(n), 5]
    assert {x for b in out for x in b["decoded"].to_pylist()} == {text.encode()}
    assert max(b["ids"].nbytes for b in out) <= 1 << 20


def near_rows():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 8, 30, 120, 500]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 5)):
            w = list(base)
            for _ in range(int(len(w) * rng.random() * 0.12)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.2 else "  ".join(w)))
    hot = [rng.choice(vocab) for _ in range(150)]
    for i in range(120):  # one large group, from copies to hardly alike
        w = list(hot)
        for _ in range(int(i * 0.25)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one one"), (906, "a b c d"), (907, "a b c d e"),
             (None, rows[0][1]), (5, rows[1][1]), (908, "É é"), (909, "é É")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = near_rows()
    want = Sets(rows, k)
    got = hyperminhash.near_duplicates(with_clashes(docs_table(spark, rows)), k).collect()
    key = lambda d, n, c: (d is None, d or 0, n, c)
    assert sorted(key(r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(
        key(d, n, c if n else d) for (d, _), n, c in zip(rows, want.sizes, want.component))


def test_one_of_each_keeps_one(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (None, "A b c d e f g h"), (7, None), (8, ""),
            (9, "quite another text of more words")]
    out = hyperminhash.one_of_each(with_clashes(docs_table(spark, rows))).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, rows[0][1]), (7, None), (8, ""), (9, rows[6][1])]
    assert hyperminhash.one_of_each(spark.createDataFrame([], DOCS)).collect() == []
    assert hyperminhash.op9_minhash(spark.createDataFrame([], DOCS)).collect() == []


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for n in (3, 40, 400, 4000):
        for share in (0.3, 0.8, 1.0):
            errors = []
            for _ in range(20):
                both, own = int(n * share), n - int(n * share)
                x = rng.integers(0, 2**63, both + 2 * own).astype(np.uint64)
                a, b = x[:both + own], np.concatenate([x[:both], x[both + own:]])
                est = hyperminhash.estimate(hyperminhash.registers(a), hyperminhash.registers(b), len(a), len(b))
                errors.append(est - both / (both + 2 * own))
            assert abs(np.mean(errors)) < 0.04 and np.max(np.abs(errors)) < 0.15, (n, share)


def test_word_hashes_follow_the_contract():
    h = hyperminhash.WordHashes()
    t = "The\x0bthe É é x\x1cy z \x85"
    assert len(h(t)) == len(lower_words(t)) and h(t)[0] == h(t)[1] and h(t)[2] != h(t)[3]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7), (100, 101)] + [(500, 501 + i) for i in range(60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[103] == got[101] == 100
    assert len(got) == 40 + 3 + 61


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = shards.Permutation(n, key=9)
        slots = p(np.arange(n))
        assert sorted(slots) == list(range(n)) and (p(slots, back=True) == np.arange(n)).all()
    assert (shards.Permutation(1000, 1)(np.arange(1000)) != shards.Permutation(1000, 2)(np.arange(1000))).any()


def test_shards_round_trip(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", "x", "é" * 700, "\n" * 30] + ["".join(rng.choice("abc é日\n\0") for _ in range(rng.randint(0, 900))) for _ in range(60)]
    df = with_clashes(docs_table(spark, texts).drop("ids")).drop("ids").selectExpr("doc_id", "cast(text as binary) ids", "slot")
    layout, manifest = shards.materialise(df.repartition(5), length=64, per_shard=16, path=str(tmp_path / "out"))
    rows, back = manifest.collect(), {r.slot: r for r in shards.read_from(spark, layout).collect()}
    assert sorted(r.slot for r in rows) == sorted(back) == list(range(layout.n))
    streams = {}
    for r in sorted(rows, key=lambda r: r.seq_no):
        got = back[r.slot]
        assert layout.place(r.slot) == (got.shard, got.offset) and got.n_tokens == r.n_tokens
        streams[r.doc_id] = streams.get(r.doc_id, b"") + bytes(got.ids)
    assert streams == {i: t.encode() for i, t in enumerate(texts) if t}
    assert sorted(r.slot for r in shards.read_from(spark, layout, 40).collect()) == list(range(40, layout.n))
    # any record by a seek
    shard, offset = layout.place(21)
    [part] = (tmp_path / "out" / f"shard={shard}").glob("part-*")
    with open(part, "rb") as f:
        f.seek(offset)
        record = f.read(layout.stride)
    assert record[4:4 + back[21].n_tokens] == bytes(back[21].ids)


def test_shards_of_bpe_ids_and_errors(spark, codec, tmp_path):
    rows = docs_table(spark, ["some words here " * 30, "日本語"])
    coded = bpe.encode(rows, PATH, public_tokenizers.PATTERN).select("doc_id", "ids")
    layout, manifest = shards.materialise(coded, width=4, length=16, per_shard=4, path=str(tmp_path / "ids"))
    back = {r.slot: bytes(r.ids) for r in shards.read_from(spark, layout).collect()}
    ids = b"".join(back[r.slot] for r in sorted(manifest.where("doc_id = 0").collect(), key=lambda r: r.seq_no))
    assert codec.decode(ids).decode() == "some words here " * 30
    with pytest.raises(ValueError):
        shards.materialise(coded, length=0)
    assert shards.op2_shards(spark.createDataFrame([], DOCS)).collect() == []


def test_shards_query(spark):
    import zlib
    texts = ["abc " * 300, None, "", "é日", "abc " * 300]
    rows = shards.op2_shards(docs_table(spark, texts)).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    for r in rows:
        part = texts[r.doc_id].encode()[r.seq_no * shards.LENGTH:(r.seq_no + 1) * shards.LENGTH]
        assert r.stored_crc32 == zlib.crc32(part) and r.n_tokens == r.stored_tokens == len(part)


def test_shards_in_passes_are_those_of_one_pass(spark, tmp_path, monkeypatch):
    rows = docs_table(spark, [f"text {i} é " * (i % 40) for i in range(50)]).selectExpr("doc_id", "cast(text as binary) ids").coalesce(1)
    ends, found = [], {}
    monkeypatch.setattr(shards, "discard", lambda *tables, rounds: ends.append(len(list((tmp_path / "2").glob("shard=*")))))
    for passes in (1, 2):
        monkeypatch.setattr(shards, "PASSES", passes)
        layout, manifest = shards.materialise(rows, length=64, per_shard=16, path=str(tmp_path / str(passes)))
        found[passes] = ({f.parent.name: f.read_bytes() for f in (tmp_path / str(passes)).glob("shard=*/part-*")},
                         sorted(map(tuple, manifest.collect())))
    assert found[1] == found[2] and len(found[1][0]) == -(-layout.n // 16)
    assert 0 < ends[1] < ends[2] == len(found[2][0])  # shuffle files go between the passes, when half the shards are there
    with pytest.raises(Exception, match="exist"):
        shards.materialise(rows, length=64, per_shard=16, path=str(tmp_path / "2"))


def test_shards_of_an_uneven_scan(spark, tmp_path):
    """One row group cut into several splits: all rows are one task's."""
    docs_table(spark, ["ab c " * 400] * 3000).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = shards.op2_shards(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()
    assert len(rows) == 3000 * 4 and all(r.n_tokens == r.stored_tokens for r in rows)
