"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, fim, hardnegatives, hmm, hyperminhash, linededup, mixing, pii, quality, shards, topk
from .common import read_table


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.op1_hmm_scores(read_table(spark, sf_dir, "documents"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.op2_shards(read_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op3_chat(spark, read_table(spark, sf_dir, "conversations"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op4_quality_rules(read_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.op5_line_dedup(read_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op7_mixing(read_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.op8_bpe(read_table(spark, sf_dir, "documents"),
                       public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.op9_minhash(read_table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op6_topk(read_table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op10_pii(read_table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.op11_fim(read_table(spark, sf_dir, "documents"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op12_decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardnegatives.op13_hard_negatives(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_hmm_scores": op1_hmm_scores,
    "op2_shards": op2_shards,
    "op3_chat": op3_chat,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_topk": op6_topk,
    "op7_mixing": op7_mixing,
    "op8_bpe": op8_bpe,
    "op9_minhash": op9_minhash,
    "op10_pii": op10_pii,
    "op11_fim": op11_fim,
    "op12_decontaminate": op12_decontaminate,
    "op13_hard_negatives": op13_hard_negatives,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT uid, doc_id, text, {_WORDS} AS w FROM d),
ln AS (SELECT uid, unnest(string_split(text, chr(10))) AS line FROM d),
lc AS (SELECT uid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY uid),
g AS (SELECT uid, unnest(generate_series(1, len(w) - 2)) AS i, w FROM w WHERE len(w) >= 3),
gh AS (SELECT uid, i, [w[i], w[i + 1], w[i + 2]] AS gram FROM g),
rep AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, gram) AS n FROM gh) WHERE n > 1),
cov AS (SELECT uid, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY uid),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN lc USING (uid) LEFT JOIN cov USING (uid)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
             + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 4 * n_symbols > n_words AND n_symbols > 2 * n_lines THEN 4 ELSE 0 END
             + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
             + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits % 4 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

# Every pair of places of a fingerprint, extended both ways over the whole texts.
OP5_SQL = r"""
WITH t AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
l0 AS (SELECT doc_id, pos, md5(line) AS m, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM t),
l1 AS (SELECT doc_id, pos, m, n::BIGINT AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx FROM l0 WHERE n > 0),
l2 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum,
              sum(n) OVER (PARTITION BY doc_id) AS total FROM l1),
l3 AS (SELECT *, md5(array_to_string(list(m) OVER a, ',')) AS gram, count(*) OVER a AS lines
       FROM l2 WINDOW a AS (PARTITION BY doc_id ORDER BY cum RANGE BETWEEN CURRENT ROW AND 24 FOLLOWING)),
l4 AS (SELECT *, CASE WHEN cum + 50 <= total THEN
                 (min({'gram': gram, 'idx': idx}) OVER (PARTITION BY doc_id ORDER BY cum RANGE BETWEEN CURRENT ROW AND 25 FOLLOWING)).idx END AS pick FROM l3),
p AS (SELECT DISTINCT doc_id, pick AS idx FROM l4 WHERE pick IS NOT NULL),
fp AS (SELECT l4.doc_id, idx, gram, lines FROM l4 JOIN p USING (doc_id, idx)),
w AS (SELECT doc_id, list(m ORDER BY idx) AS w FROM l1 GROUP BY doc_id),
m AS (SELECT x.doc_id, x.idx, x.lines, wx.w[x.idx + x.lines + 1:] AS ra, wy.w[y.idx + y.lines + 1:] AS rb,
             list_reverse(wx.w[1:x.idx]) AS la, list_reverse(wy.w[1:y.idx]) AS lb
      FROM fp x JOIN fp y ON x.gram = y.gram AND (y.doc_id < x.doc_id OR y.doc_id = x.doc_id AND y.idx < x.idx)
      JOIN w wx ON wx.doc_id = x.doc_id JOIN w wy ON wy.doc_id = y.doc_id),
e AS (SELECT doc_id, idx, lines, [ra[k] IS NOT DISTINCT FROM rb[k] AND k <= len(ra) FOR k IN generate_series(1, len(ra) + 1)] AS er,
             [la[k] IS NOT DISTINCT FROM lb[k] AND k <= len(la) FOR k IN generate_series(1, len(la) + 1)] AS el FROM m),
x AS (SELECT doc_id, idx, lines, max(list_position(er, false) - 1) AS rt, max(list_position(el, false) - 1) AS lt FROM e GROUP BY ALL),
gone AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM l1 JOIN (
           SELECT doc_id, unnest(generate_series(idx - lt, idx + lines - 1 + rt)) AS idx FROM x) USING (doc_id, idx) GROUP BY doc_id),
k AS (SELECT t.doc_id, t.pos, t.line FROM t LEFT JOIN gone USING (doc_id) WHERE gone IS NULL OR NOT list_contains(gone, t.pos)),
kt AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(gone), 0)::BIGINT AS removed_lines, length(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kt.text, '') END)::BIGINT AS kept_chars,
       sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kt.text, '') END) AS text_sha256
FROM documents d LEFT JOIN gone USING (doc_id) LEFT JOIN kt ON kt.doc_id = d.doc_id
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w ELSE [w[i], w[i + 1]] END AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.b, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP6_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.v, p.v)::BIGINT AS score
      FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP3_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(12 + length(role) + 1 + chars + 10 + 1)::BIGINT AS formatted_chars,
       regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, ''
                                    ORDER BY turn, role, text), 's?(u(au)*a?)?') AS valid
FROM e GROUP BY conv_id
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, [('0x' || substr(x, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM h),
p AS (SELECT doc_id, t, n, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                  WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

OP12_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS uid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT uid, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark),
g AS (SELECT DISTINCT item, w[k:k + 9] AS gram FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT len(gram) AS size FROM g),
p AS (SELECT uid, k, size, w[k:k + size - 1] AS gram FROM (SELECT uid, w, unnest(generate_series(1, len(w))) AS k FROM d), z WHERE k + size - 1 <= len(w)),
h AS (SELECT DISTINCT uid, k, size, item FROM p JOIN g USING (gram)),
n AS (SELECT uid, count(DISTINCT k + o) AS n_hit FROM (SELECT uid, k, unnest(generate_series(0, size - 1)) AS o FROM h) GROUP BY uid),
o AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT uid, item FROM h) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (uid) LEFT JOIN o USING (uid)
"""

OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.uid, a.vec_id AS anchor_id, r.uid AS row_uid, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
      FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, row_uid) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.uid, p.row_uid ORDER BY s.score DESC, s.vec_id, s.row_uid) AS rank
      FROM p JOIN s ON s.uid = p.uid AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

SQL = {
    "op13_hard_negatives": OP13_SQL,
    "op12_decontaminate": OP12_SQL,
    "op11_fim": OP11_SQL,
    "op3_chat": OP3_SQL,
    "op6_topk": OP6_SQL,
    "op9_minhash": OP9_SQL,
    "op4_quality_rules": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
}
