import random

from pyspark.sql import functions as F

from quern.llm import secrets
from quern.llm.secrets import candidates, op5_secret_scan, scan


def corpus(n=400):
    rng = random.Random(3)
    words = "the of and on with for data time house river stone light under over paper".split()
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    rows = []
    for i in range(n):
        what = [f'token = "{hexes(40)}"', f"password={hexes(18)}", f"card {rng.randrange(10**15, 10**16)}", "paperhouseriverstone2", "AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16))][i % 5]
        rows.append((i, f"src{i % 3}", f"{text(12)} {what} {text(9)}", 1 if i % 5 in (0, 1, 4) else 0))
    return rows


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, source string, text string, truth int")
    truth = F.when(F.pmod("doc_id", F.lit(5)).isin(0, 1, 4), 1).otherwise(0)
    got = scan(docs, F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 1, truth).filter("not learned").collect()
    assert len(got) > 80
    assert sum((r.score >= 0.5) == (r.label == 1) for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_candidates_by_hand(spark):
    rows = [(1, None, None), (2, "p", ""), (3, "p", "é key=abcdEFGH12345678, x"), (None, "p", "A" * 15 + "1"), (4, "p", "a" * 40), (5, "p", "1" * 200_000), (3, "p", "é key=abcdEFGH12345678, x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("value", F.lit(1)).withColumn("path", F.lit(2))
    got = sorted(((r.doc_id or 0, r.start, len(r.value), r.before, r.after[:3]) for r in candidates(docs).collect()))
    assert got == [(0, 0, 16, "", " "), (3, 7, 16, "é key=", ", x"), (3, 7, 16, "é key=", ", x"), (5, 0, 200_000, "", " ")]


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "p", "see Zk39fjQQm2kd8sPx01 here")], "doc_id long, source string, text string")
    assert [(r.score, r.is_secret, r.label) for r in scan(docs, F.lit(True)).collect()] == [(1.0, True, None)]
    assert scan(docs.limit(0), F.lit(True)).count() == 0


def test_query(spark):
    got = op5_secret_scan(spark, "/root/testdata/sf0.01").collect()
    labelled = [r for r in got if r.label is not None and r.held_out]
    assert labelled and all(r.is_secret == bool(r.label) for r in labelled)


def test_tree_splits_on_a_threshold():
    import numpy as np

    x = np.zeros((100, 4), np.float32)
    x[:, :] = np.arange(100)[:, None]
    feature, threshold, right, share = secrets.grow(x, (np.arange(100) >= 50).astype(float), 1)
    assert feature[0] >= 0 and 40 < threshold[0] < 60 and share[1] < 0.2 < 0.8 < share[right[0]]


def test_values_after_key_words_and_in_urls(spark):
    texts = ["password=Hunter2x9, then", 'set "secret": "correct horse battery" here', "api_key: ab.cd=ef~gh!ij$kl&mn", "see postgres://admin:Zk39fjQQm2kd8sPx01@host/db", "ftp://u:p~w@h", "password=", "x1 y2", "Token: é9"]
    docs = spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    found = candidates(docs).withColumn("label", secrets.format_label(F.col("value"), F.col("before"))).collect()
    want = {(0, "Hunter2x9", 1), (1, "correct horse battery", None), (2, "ab.cd=ef~gh!ij$kl&mn", None), (3, "Zk39fjQQm2kd8sPx01", None), (4, "p~w", None), (7, "é9", 1)}
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.value, r.label)) for r in found)
    assert all(texts[r.doc_id].encode()[r.start :].startswith(r.value.encode()) for r in found)
