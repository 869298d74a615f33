"""Periodic runs against a plain search, and odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from quern.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(x):
    """(start, length, period) of every run that counts, period by period."""
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(x[i : j + q - d] == x[i + d : j + q] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(rows):
    out = []
    for i, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = plain_runs(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append((i, len(runs), s, length, q, 1000 * length // q if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return sorted(out, key=repr)


def made(rng):
    n = rng.choice([0, 1, 3, 6, 40, 150, 400])
    x = [rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(n)]
    for _ in range(rng.randrange(4) if n >= 5 else 0):
        a = rng.randrange(n)
        p = 1 + rng.randrange((n - a) // 3 + 1)
        for i in range(a, min(n, a + p * rng.choice([3, 4, 5, 9]))):
            x[i] = x[a + (i - a) % p]
    return x


def test_runs_of_symbols():
    rng = random.Random(1)
    for _ in range(300):
        symbols, want = [], []
        for k in range(rng.choice([1, 3, 8])):
            x = made(rng)
            want += [(len(symbols) + s, length, q) for s, length, q in plain_runs(x)]
            symbols += [1000 * k + v for v in x] + [-1]
        assert list(zip(*(a.tolist() for a in periodic.runs_of(np.array(symbols, np.int64))), strict=True)) == want


def test_nested_and_long():
    block = ([1] * 10 + [2]) * 6  # runs within a run
    assert plain_runs(block + [3] + block) == [tuple(r) for r in np.stack(periodic.runs_of(np.array([*block, 3, *block, -1])), axis=1).tolist()]
    whole = (list(range(6_000)) * 6)[:30_000]
    assert [a.tolist() for a in periodic.runs_of(np.array([*whole, -1]))] == [[0], [30_000], [6_000]]
    assert [a.tolist() for a in periodic.runs_of(np.array([5] * 100_000 + [-1]))] == [[0], [100_000], [1]]


def run(spark, tmp_path, name, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "runs", "words", "n_words", "collapsed", "best", "start")})
    docs.repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    found = periodic.op13_periodic_runs(spark, f"{tmp_path}/{name}")
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_against_brute_force(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = [(i, " ".join((t or "").split(" ")[:1500])) for i, t in docs]  # the plain search is quadratic
    got = run(spark, tmp_path, "sf", docs)
    assert got == plain(docs) and any(r[1] > 1 for r in got) and any(not r[1] for r in got)


def test_odd_tables(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.choice([" ", "\t\n", "\x0b "]).join(f"é{v}" if v % 3 else "w" for v in made(rng))) for i in range(250)]
    rows += [(None, None), (None, ""), (None, "a " * 30), (1000, None), (1001, " \n\t"), (1002, "x"), (1002, "x"), (1003, "\n a  a a\na a a b "), (1004, "a\x00b " * 9), (1005, " ".join(f"w{i % 700}" for i in range(4000)))]
    rows += [(i, None) for i in range(2000, 2040)] + [(i, "one") for i in range(3000, 3040)]
    assert run(spark, tmp_path, "odd", rows) == plain(rows)
    assert run(spark, tmp_path, "none", []) == []
    kept = {r.row.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(spark.createDataFrame([(1, "b a a a a a a c"), (2, "x y")], "doc_id long, text string")).collect()}
    assert kept == {1: (8, [(1, 6, 1)], "b a c"), 2: (2, [], "x y")}
