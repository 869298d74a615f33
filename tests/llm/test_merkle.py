"""The manifest against a plain tree in Python, and odd tables."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from quern.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The top, and for each node its siblings left and right at every level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = level[i - i % 8 : i - i % 8 + 8]
            path.append((run[: i % 8], run[i % 8 + 1 :]))
            i //= 8
        paths.append(path)
    return levels[-1][0], paths


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, placed = [], []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, paths = tree([leaf(r) for r in own])
        tops.append(top)
        placed.append((own, paths))
    root, over = tree(tops) if tops else (None, [])
    out = []
    for (own, paths), top, above in zip(placed, tops, over, strict=True):
        for r, path in zip(own, paths, strict=True):
            whole = path + above
            cur = leaf((*r[:4], lower(r[4]))) if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 == 0 else leaf(r)
            for left, right in whole:
                cur = sha("".join([*left, cur, *right]))
            out.append((r[0], leaf(r), top, root, sha("".join(x for left, right in whole for x in (*left, *right))), cur, cur == root))
    return sorted(out, key=repr)


def run(spark, tmp_path, name, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs.withColumns({c: F.lit(1) for c in ("node", "grp", "id", "gid", "part", "at", "pos", "path", "c_seen", "root", "leaf")}).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    found = merkle.op11_merkle_manifest(spark, f"{tmp_path}/{name}")
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_against_brute_force(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = run(spark, tmp_path, "sf", docs)
    assert got == plain(docs) and {r[6] for r in got} == {True, False}


def test_odd_tables(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"s{i % 3}", rng.choice(["en", "de", "é", "zz", "", None]), i if i % 7 else None, rng.choice(["Ab", "x", None, "", "Äb é\n|"])) for i in range(300)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (7, "s", "en", 1, "A" * 2_000_000), (7, "s", "en", 1, "B"), (7, "s", "en", 1, "B"), (1, None, "alone", None, "X")]
    rows += [(1000 + i, "s", f"l{i}", 1, "Q") for i in range(70)]  # more than two levels of groups
    assert run(spark, tmp_path, "odd", rows) == plain(rows)
    for name, some in (("none", []), ("one", [(3, "s", None, 1, "T")]), ("two", [(3, "s", "a", 1, "t"), (4, "s", "b", 1, "t")]), ("nine", [(i, "s", "a", 1, "T") for i in range(9)])):
        assert run(spark, tmp_path, name, some) == plain(some)
