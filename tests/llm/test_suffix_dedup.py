import hashlib
import random
from collections import Counter

from quern.llm import suffix_dedup
from quern.llm.suffix_dedup import SPAN, op6_suffix_dedup


def brute(texts):
    """doc -> (n_bytes, n_removed, n_spans, sha256 of what is left)."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + SPAN] for b in raw for i in range(len(b) - SPAN + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - SPAN + 1):
            if seen[b[i : i + SPAN]] > 1:
                gone[i : i + SPAN] = b"\1" * SPAN
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone[:-1], strict=True)) if b else 0
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, other = text(60), text(45)
    out = [text(rng.randint(1, 120)) for _ in range(40)]
    out += [f"{text(20)} {passage} {text(20)}" for _ in range(12)] + [f"{text(5)} {passage[k:]} {other[: 150 + k]}" for k in range(0, 60, 5)]
    copy = text(200)
    out += [copy, copy, copy[:300] + "X" + copy[301:], copy[:500] + "YY" + copy[500:], copy[100:]]
    out += ["", None, "a" * 1000, "b" * 199, "c" * 200, "d" * 201, "ab" * 300, passage[:SPAN], passage[1 : SPAN + 1], " " * 400]
    return out


def check(spark, texts):
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, k1 int")
    got = {r[0]: r for r in suffix_dedup.dedup_spans(docs).collect()}
    for i, want in enumerate(brute(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) == want, (i, (texts[i] or "")[:80])


def test_brute_force(spark):
    check(spark, cases())


def test_divided_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST", 3)
    check(spark, cases())


def test_repeated_rows_and_null_ids(spark):
    text = "the quick brown fox jumps over it " * 12
    docs = spark.createDataFrame([(1, text), (1, text), (None, "x"), (2, None)], "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in suffix_dedup.dedup_spans(docs).fillna(-1).collect())
    assert got == [(-1, 1, 0, 0), (1, len(text), len(text), 1), (1, len(text), len(text), 1), (2, 0, 0, 0)]


def test_empty_table(spark):
    assert suffix_dedup.dedup_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows]), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op6_suffix_dedup(spark, sf).collect()}
    assert got == want
