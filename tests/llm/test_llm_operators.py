"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with nulls, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import oracle_rows, spark_rows
from pyspark.sql import functions as F

from quern.llm import bpe, decontam, jaccard, langid, line_dedup, registry, token_files, topk

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(spark, SMALL, registry.QUERIES[name]) == oracle_rows(SMALL, registry.ORACLE_SQL[name])


def small_docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text))


# 1


def test_lines_by_hand(spark):
    rows = [(1, "a\nb\nc\nd", "x"), (2, "z\nb\nc\nd\nb\nc\nd", "x"), (3, None, "x"), (4, "", "x"), (5, "\n\n\n\n", "x"), (6, "b\nc", "x"), (None, "q\nr\ns", "x"), (7, "q\nr\ns", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {r.id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup.mark_lines(docs).select(F.col("row.doc_id").alias("id"), "n_lines", "n_removed", "kept").collect()}
    assert got == {1: (4, 0, "a\nb\nc\nd"), 2: (7, 6, "z"), 3: (0, 0, None), 4: (1, 0, ""), 5: (5, 0, "\n\n\n\n"), 6: (2, 0, "b\nc"), None: (3, 0, "q\nr\ns"), 7: (3, 3, "")}
    assert sorted(r.doc_id or 0 for r in line_dedup.dedup_lines(docs).collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert line_dedup.mark_lines(docs.limit(0)).count() == 0


# 2


def test_language_model(spark):
    docs = small_docs(spark)
    got = {r.doc_id: r for r in registry.QUERIES["op2_context_mixing"](spark, SMALL).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    counts = Counter(w for d, t in docs.items() if not held[d] for w in [*words_of(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    for d, t in docs.items():
        tokens = [*words_of(t), "\n"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score <= 0


def test_language_model_beats_the_base(spark):
    # The 180 training texts of the smallest size are too few for it (README); from a thousand on it is ahead.
    held = registry.QUERIES["op2_context_mixing"](spark, "/root/testdata/sf0.01").filter("held_out")
    model, base = held.agg(F.sum("score"), F.sum("base_score")).first()
    assert model > base


# 3


def test_packing_round_trip():
    rng = random.Random(1)
    for ids in ([], [0] * 1000, [1], [rng.randrange(49408) for _ in range(3000)], [rng.randrange(1 << rng.choice((1, 9, 30, 59))) for _ in range(1500)]):
        assert token_files.unpack(token_files.pack(np.array(ids, np.uint64))).tolist() == ids


def test_token_files(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(path("word_bpe_49k.json")), 0
    tokenizer.no_truncation()
    tokenizer.no_padding()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in registry.QUERIES["op3_token_files"](spark, SMALL).collect()}
    for d, t in sorted(small_docs(spark).items()):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# 4


def test_top_k_ties_and_bad_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice((-0.5, 0.25, 0.75)) for _ in range(6)]) for i in range(300)] + [(300, None), (301, [None] * 6), (400, [float("nan")] * 6), (500, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    good = {i: [math.floor(1024 * x) for x in v] for i, v in rows[:300]}
    want = set()
    for q in range(0, 300, 100):
        best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(frame, frame.filter("vec_id % 100 = 0")).collect()} == want
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_top_k_repeated_ids_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 5)
    rows = [(0, [1.0, 2.0]), (0, [3.0]), (1, [5e6, 1.0]), (2, [0.5, 0.5, 9.0]), (2, [0.5, 0.5, 9.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0])] + [(i, [float(i % 7), -1.0]) for i in range(101, 130)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    want = Counter()
    for n, (q, v) in enumerate(ints):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(ints) if m != n)[:10]
            want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    assert Counter(tuple(r) for r in topk.top_k(frame, frame.filter("vec_id % 100 = 0")).collect()) == want


# 7


def test_languages_held_out(spark):
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = registry.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in got} == set(lang) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id][0] is not None and len(lang[r.doc_id][1] or "") > 60]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in held) / len(held) > 0.95


def test_languages_without_letters(spark):
    docs = spark.createDataFrame([(1, "the house and the river", "en"), (2, "das haus und der fluss", "de"), (3, None, "en"), (4, "123 !?", None), (5, "", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    found = {r.row.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.train(docs)).collect()}
    assert found[1][0] == "en" and found[2][0] == "de" and found[3] == found[4] == found[5] == ("und", 0.0)
    assert {r.doc_id for r in langid.keep_known(docs).collect()} == {1, 2}


# 8


def test_encoding_as_the_library(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    texts = ["", None, "Hello  WORLD's  <|endoftext|> x", "ÀÉß İΣς ñ́ 日本語   9,5€", "a" * 3000, "\n\t ", "don't!!! <|startoftext|>"] + list(small_docs(spark).values())
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    for r in bpe.encode(docs).collect():
        ids = tokenizer.encode(texts[r.row.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, tokenizer.decode(ids, skip_special_tokens=False)), texts[r.row.doc_id]


# 9


def brute_classes(texts, n, least):
    sets, parent = {}, {d: d for d in texts}
    for d, t in texts.items():
        w = words_of(t or "")
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    share, ids = defaultdict(Counter), sorted(texts)
    by = defaultdict(list)
    for d in ids:
        for s in sets[d]:
            for e in by[s]:
                share[d][e] += 1
            by[s].append(d)
    for d in ids:
        for e, k in share[d].items():
            if 100 * k >= least * (len(sets[d]) + len(sets[e]) - k):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize(("n", "least"), [(3, 90), (5, 80)])
def test_jaccard_classes(spark, n, least, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 200)  # many blocks, so that counts come from several parts
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for i in range(60)}
    base = rng.choices(vocabulary, k=120)
    for i in range(60, 130):  # a large group of near copies, each with edits of its own
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts[i] = " ".join(own)
    texts |= {200: "", 201: None, 202: "one two", 203: "One  TWO", 204: texts[3], 205: "\n\t"}
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, n int")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, n, least).collect()} == brute_classes(texts, n, least)


def test_jaccard_query(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.QUERIES["op9_ngram_jaccard"](spark, SMALL).collect()}
    assert got == brute_classes(small_docs(spark), 3, 90)


# 10


def test_leaks_by_hand(spark):
    items = spark.createDataFrame([(1, "If Tom buys 12 apples and then sells 5 apples how many are left"), (2, "short item"), (3, None)], "item_id long, text string")
    docs = [(1, "he said if Ann buys 30 apples and then sells 7 apples how many are left now", 0), (2, "nothing to be found in this one at all", 0), (3, None, 0), (4, "", 0), (None, "x", 0)]
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, w int"), items).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 1)]
    kept = decontam.drop_leaks(spark.createDataFrame(docs, "doc_id long, text string, w int"), items).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 2, 3, 4]


# The pipeline


def test_pipeline_against_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    docs = {d: t for d, t in rows.items() if any(c.isalpha() for c in t)}
    windows, kept = set(), {}
    for d in sorted(docs):
        lines, gone = docs[d].split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(x.strip(" ") for x in w):
                gone |= {i, i + 1, i + 2} if w in windows else set()
                windows.add(w)
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or text.strip(" "):
            kept[d] = text
    kept = {d: t for d, t in kept.items() if brute_classes(kept, 5, 80)[d][1] == d} if len(kept) < 3 else {d: kept[d] for d, (_, c) in brute_classes(kept, 5, 80).items() if c == d}
    table = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    leaks = {r.doc_id for r in decontam.find_leaks(table, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    want = {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in kept.items() if d not in leaks}
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {d: (i, hashlib.sha256(tokenizer.decode(i, skip_special_tokens=False).encode()).hexdigest()) for d, i in want.items()}
