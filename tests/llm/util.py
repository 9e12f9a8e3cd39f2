"""Small tables and plain-Python versions that the operators are held against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_table(spark, texts, **more):
    """texts: list of text, or (doc_id, text), or (doc_id, text, source)."""
    rows = []
    for i, t in enumerate(texts):
        t = t if isinstance(t, tuple) else (i, t)
        rows.append((t[0], t[1], "en", t[2] if len(t) > 2 else "s", len(t[1] or "")))
    return spark.createDataFrame(rows, DOCS)


# columns whose names the operators use themselves
CLASHING = ["size", "n_words", "fail_bits", "ids", "copies", "target", "source_size", "h", "n", "node", "class", "key", "row",
            "pos", "removed_lines", "spans", "base", "score", "slot", "shard", "p", "bit", "stratum", "blocks", "word", "c",
            "uid", "rare", "times", "n_tokens", "decodes", "text_sha256", "kept", "component_id", "rep_id", "a", "b"]


def with_clashes(df):
    from pyspark.sql import functions as F
    for c in CLASHING:
        df = df.withColumn(c, F.lit("mine"))
    return df


def words(text):
    return WORD.findall(text or "")


def lower_words(text):
    return words((text or "").translate(LOWER))


class Sets:
    """Union-find over documents whose shingle sets reach the threshold, pair by pair."""

    def __init__(self, rows, k, percent=80):
        sets = []
        for _, t in rows:
            w = lower_words(t)
            sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
        parent = list(range(len(rows)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
        self.sizes = [len(s) for s in sets]
        least = {}
        for i, (d, _) in enumerate(rows):
            r = root(i)
            if d is not None:
                least[r] = min(least.get(r, d), d)
        self.component = [least.get(root(i)) for i in range(len(rows))]
