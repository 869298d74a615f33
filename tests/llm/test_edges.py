"""Odd tables for every operator: nulls, empty and very long texts, repeated rows and ids, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, common, decontam, jaccard, langid, line_dedup, mixing, secrets, suffix_dedup, token_files
from quern.llm.common import Work

LONG = " ".join(random.Random(8).choices([f"w{i}" for i in range(3000)], k=50_000))
ROWS = [(1, "one two three\nfour five\nsix seven"), (1, "one two three\nfour five\nsix seven"), (2, None), (3, ""), (4, " \n\t"), (5, LONG), (None, "alone here"), (6, "one two three\nfour five\nsix seven"), (7, "x"), (7, "other words altogether, of the same id")]
CLASH = ("row", "block", "learned", "part", "tie", "k1", "id", "lang_pred", "component_id", "n", "words", "kept", "n_tokens", "text_x", "gone_id", "twice_id", "leaks_id", "k_id", "k_text", "l_id", "__h", "__id", "__least")


@pytest.fixture
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return frame.withColumns({c: F.lit(1) for c in CLASH})


def library():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path("word_bpe_49k.json"))
    out.no_truncation()
    out.no_padding()
    return out


def key(x):
    return (x[0] is not None, x[0] or 0, *map(str, x[1:]))


def test_lines(docs):
    got = sorted(((r.doc_id, r.n_removed, r.left or "") for r in line_dedup.mark_lines(docs).select(F.col("row.doc_id").alias("doc_id"), "n_removed", F.col("kept").alias("left")).collect()), key=key)
    # Rows that share an id and text are one document, of which the first keeps its lines; that of another id loses them.
    assert {(d, n) for d, n, _ in got} == {(None, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 3), (7, 0)} and len(got) == len(ROWS)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_language_model(docs):
    got = mixing.score(docs, F.coalesce(F.col("doc_id") != 2, F.lit(False))).collect()
    assert len(got) == len(ROWS) and all(r.score <= 0 for r in got)
    assert sorted(r.n_tokens for r in got) == sorted(len((t or "").split()) + 1 for _, t in ROWS)


def test_tokens(spark, docs):
    work, tokens, start = Work(spark), library(), 0
    token_files.write_tokens(docs, f"{work.path}/t")
    got = token_files.read_tokens(spark, f"{work.path}/t", digests=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d or 0))
    want = {(d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, t in ROWS for ids in [[*tokens.encode(t or "", add_special_tokens=False).ids, 1]]}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want
    for r in got:
        assert r.start == start
        start += r.n_tokens
    token_files.write_tokens(docs.limit(0), f"{work.path}/none")
    assert token_files.read_tokens(spark, f"{work.path}/none").count() == 0


def test_secrets(docs):
    found = secrets.scan(docs.withColumn("text", F.concat("text", F.lit(" token=ab12cd34ef56gh78"))), F.lit(True)).collect()
    assert sorted((r.doc_id or 0 for r in found if r.value == "ab12cd34ef56gh78")) == sorted(d or 0 for d, t in ROWS if t is not None)


def test_spans(docs):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_spans(docs).collect()), key=key)
    assert got == sorted(((d, len((t or "").encode()), 0) for d, t in ROWS), key=key)
    twice = docs.filter("doc_id = 5").union(docs.filter("doc_id = 5"))
    assert [(r.n_removed, r.n_spans) for r in suffix_dedup.dedup_spans(twice).collect()] == [(len(LONG), 1)] * 2


def test_languages(docs):
    found = langid.predict(docs, langid.train(docs)).select("row.doc_id", "row.text", "lang_pred", "score").collect()
    assert len(found) == len(ROWS) and all((r.lang_pred == "en") == any(c.isalpha() for c in r.text or "") for r in found)
    none = docs.limit(0)
    assert langid.predict(none, langid.train(none)).count() == 0 and {r.lang_pred for r in langid.predict(docs, langid.train(none)).collect()} == {"und"}
    tied = docs.withColumn("lang", F.when(F.col("doc_id") == 1, "b").when(F.col("doc_id") == 6, "a")).filter("doc_id in (1, 6)").dropDuplicates(["doc_id"])
    assert {r.lang_pred for r in langid.predict(tied, langid.train(tied)).collect()} == {"a"}


def test_encoding(docs):
    tokens = library()
    got = sorted(((r.row.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, digests=True).collect()), key=key)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(tokens.decode(ids, skip_special_tokens=False).encode())) for d, t in ROWS for ids in [tokens.encode(t or "", add_special_tokens=False).ids]]
    assert got == sorted(want, key=key)
    assert bpe.encode(docs.limit(0)).count() == 0


def test_near_copies(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()}
    assert got == {(1, 3, 1), (6, 3, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 49_996, 5), (None, 1, None), (7, 1, 7), (7, 3, 7)}
    kept = jaccard.keep_first(docs)
    assert sorted((r.doc_id or 0 for r in kept.collect())) == [0, 1, 2, 3, 4, 5, 7] and kept.columns == docs.columns
    assert jaccard.classes(docs.limit(0)).count() == 0


def test_rows_of_an_id_link_its_copies(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.classes(docs).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_long_words_of_equal_make_up(spark):
    # Sequences whose polynomials modulo 2^64 are equal for every odd base.
    for n in (1024, 4096):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        b = a.translate(str.maketrans("ab", "ba"))
        docs = spark.createDataFrame([(1, f"one two {a}"), (2, f"one two {b}"), (3, f"one two {a.upper()}")], "doc_id long, text string")
        assert {(r.doc_id, r.component_id) for r in jaccard.classes(docs).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_leaks(spark, docs):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, LONG[:200]), (3, None), (None, "x")], "item_id long, text string").withColumn("w", F.lit(1))
    found = decontam.find_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (6, 1), (5, 2)}
    assert decontam.find_leaks(docs.limit(0), items).count() == 0 and decontam.find_leaks(docs, items.limit(0)).count() == 0
    assert sorted((r.doc_id or 0 for r in decontam.drop_leaks(docs, items).collect())) == [0, 2, 3, 4, 7, 7]


def test_pipeline(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    items = spark.createDataFrame([(1, LONG[:200])], "item_id long, text string")
    for name, rows in (("odd", docs), ("none", docs.limit(0))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.coalesce(1).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    # 2, 3 and 4 have no letters, 6 repeats lines of 1, of 1 and 7 one row stays, 5 holds the item.
    assert sorted((r.doc_id or 0 for r in got.collect())) == [0, 1, 7]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_workers_give_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.record_batch([pa.array(["a b", "c"])], names=["text"])
    assert sum(p.num_rows for p in common.pieces(iter([batch, batch]), "text")) == 4 and len(given) == 1
    assert common.lean(lambda *t: pa.concat_tables(t), pa.table({"x": [1]}), pa.table({"x": [2]})).num_rows == 2 and len(given) == 2
    sent = []
    monkeypatch.setattr(jaccard, "lean", lambda f, *groups: sent.append(f.__name__))
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInArrow", lambda self, f, schema: f(None) or spark.createDataFrame([], schema))
    monkeypatch.setattr(type(spark.range(1).groupBy("id").cogroup(spark.range(1).groupBy("id"))), "applyInArrow", lambda self, f, schema: f(None, None) or spark.createDataFrame([], schema))
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    slim = jaccard._sets(docs, 3, False)
    jaccard._features(docs, slim, slim.select("k1", "k2", F.col("doc_id").alias("rep")), 3, 90)
    assert sent == ["send", "answer", "finish"]
