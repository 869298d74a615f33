"""Quality rules against a plain version in Python, and odd tables."""

import math
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from quern.llm import quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def h(data: bytes) -> int:
    x = xxhash.xxh64_intdigest(data, seed=42)
    return x - (1 << 64) if x >= 1 << 63 else x


def pair(a: int, b: int) -> int:
    """xxhash64 of two longs: the hash of the first is the seed of the second."""
    seed = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), seed=42)
    x = xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), seed=seed)
    return x - (1 << 64) if x >= 1 << 63 else x


def counts(text):
    words = WORD.findall(text or "")
    spans = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(spans), set()
    for i, s in enumerate(spans):
        if often[s] > 1:
            covered.update(range(i, i + 8))
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), twice, len(covered)


def grams(text):
    hs = [h(w.encode()) for w in WORD.findall(text or "")]
    return [x % quality.BUCKETS for x in (*hs, *(pair(a, b) for a, b in zip(hs, hs[1:], strict=False)))]


def plain(rows, trusted):
    """rows: (id, text)."""
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in trusted:
            good.update(grams(t))
    total, total_good = sum(raw.values()), sum(good.values())
    out = []
    for i, t in rows:
        c, g = counts(t), grams(t)
        score = sum(math.log((good[b] + 1) / (max(raw[b] - 1, 0) * total_good / total + 1)) for b in g) / len(g) if g and total_good else 0.0
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        out.append((i, *c, failed, not failed and score >= quality.LEAST, round(score, 9)))
    return sorted(out, key=repr)


def rows_of(found):
    return sorted(((*r[:-1], round(r[-1], 9)) for r in found.collect()), key=repr)


def test_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    got = rows_of(quality.op12_quality_rules(spark, SF))
    assert got == plain(docs, trusted) and any(r[7] for r in got) and any(not r[7] and not r[6] for r in got)


def test_odd_tables(spark):
    rng = random.Random(3)
    loop = " ".join(rng.choices("abcde", k=40))
    long = " ".join(rng.choices([f"w{i}" for i in range(500)], k=30_000))
    rows = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, loop), (4, loop), (None, long), (5, "\n".join(["one two three"] * 9)), (6, "é|# ß " * 12), (7, "a\n a\na\n\n\na b"), (8, " ".join("x" * 25)), (9, f"{loop}\n{long[:900]} {loop}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "words", "hashes", "id", "t_id", "grams", "kept", "ratios", "good", "spans")})
    judged = lambda d, ids: quality.judge(d, quality.fit(d, ids)).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    for good in ([], [4, 9], [2]):
        ids = spark.createDataFrame([(i,) for i in good], "i long")
        assert rows_of(judged(docs, ids)) == plain(rows, good)
    assert judged(docs.limit(0), spark.createDataFrame([(4,)], "i long")).count() == 0


def test_trusted_ids_are_bounded(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    labels = labels.union(labels).union(spark.createDataFrame([(None, 1)], "doc_id long, quality int"))
    ids = [r.id for r in quality.trusted_ids(labels, F.col("quality") == 1, most=100).collect()]
    assert len(ids) == len(set(ids)) == 100 and all(i % 2 for i in ids)
    assert ids == [r.id for r in quality.trusted_ids(labels.repartition(7), F.col("quality") == 1, most=100).collect()]
    assert quality.trusted_ids(labels, F.col("quality") == 1, most=9000).count() == 2500
