import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import functions as F

from quern.llm import mixing


def test_context_odds_are_those_of_exact_counts(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 90))), i % 4 != 0, i % 3) for i in range(60)] + [(60, "", True, 0), (61, "abc" * 50, False, 1)]
    placed = spark.createDataFrame(rows, "doc_id long, text string, learned boolean, block int")
    trees, first = mixing.train(placed.filter("learned"))
    answers = mixing.context_odds(placed, spark.sparkContext.broadcast(trees), 3).toArrow()
    sym = {i: [*t.encode(), 256] for i, t, _, _ in rows}
    paths = lambda c, s: [(int(trees.node[k]), int(trees.bit[k])) for k in range(trees.start[c * 257 + s], trees.start[c * 257 + s + 1])]
    steps = {i: [(tuple(([256] * 6 + x)[j : j + 6]), n, b) for j, s in enumerate(x) for n, b in paths(([256] * 6 + x)[j + 5], s)] for i, x in sym.items()}
    counts = Counter((o, c[6 - o :], n, b) for i, _, learned, _ in rows if learned for c, n, b in steps[i] for o in (1, *mixing.ORDERS))
    for block in range(3):
        mine = [r for r in rows if r[3] == block]
        table = pa.table({"text": [r[1] for r in mine]})
        found = mixing.Decisions(table.column("text").combine_chunks(), trees, first, answers.filter(pa.compute.equal(answers.column("block"), block)), 3)
        for o, odds in zip((1, *mixing.ORDERS), found.predictors(), strict=True):
            pairs = np.array([[counts[o, c[6 - o :], n, b] for b in (0, 1)] for r in mine for c, n, _ in steps[r[0]]])
            assert odds.tolist() == mixing.odds_of(pairs[:, 0], pairs[:, 1]).tolist()


def coder(text, docs, trees):
    """Bits of a text, decision by decision, with counts of all learned texts (a list): slow and plain."""
    paths = lambda c, s: [(int(trees.node[k]), int(trees.bit[k])) for k in range(trees.start[c * 257 + s], trees.start[c * 257 + s + 1])]
    steps = lambda t: [(tuple(([256] * 6 + x)[j : j + 6]), n, b) for x in ([*t.encode(), 256],) for j, s in enumerate(x) for n, b in paths(([256] * 6 + x)[j + 5], s)]
    counts = Counter((o, c[6 - o :], n, b) for t in docs for c, n, b in steps(t) for o in (1, *mixing.ORDERS))
    k = len(mixing.ORDERS) + 1
    weights, bits = [[1.6 / k] * k, [1.6 / k] * k], 0.0
    table = [1 / (1 + math.exp(-(c - 16) / 2)) for c in range(33)]
    for c, n, b in steps(text):
        x = [max(-127, min(127, round(math.log((counts[o, c[6 - o :], n, 1] + 0.4) / (counts[o, c[6 - o :], n, 0] + 0.4)) * 12))) / 12 for o in (1, *mixing.ORDERS)]
        gate = abs(x[-1]) / (abs(x[-1]) + 1)
        share = (gate, 1 - gate)
        z = sum(g * sum(w * v for w, v in zip(ws, x, strict=True)) for g, ws in zip(share, weights, strict=True))
        z = max(-8.0, min(8.0, z))
        p = 1 / (1 + math.exp(-z))
        cell = round(2 * z) + 16
        mixed = (p + table[cell]) / 2
        bits -= math.log2(mixed if b else 1 - mixed)
        weights = [[w + 0.02 * (b - p) * g * v for w, v in zip(ws, x, strict=True)] for g, ws in zip(share, weights, strict=True)]
        table[cell] += 0.02 * (b - table[cell])
    return bits


def test_scores_are_those_of_a_plain_coder(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdé  ") for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(30)] + [(31, ""), (32, None), (33, "ab" * 400), (34, text(900)), (35, rows_text := text(40)), (35, rows_text), (None, "xyz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') as text", "1 as learned")
    learned = [t or "" for i, t in rows if i is not None and i % 5]
    trees, _ = mixing.train(docs.filter("doc_id % 5 <> 0"))
    for block in (1 << 20, 300):  # one block for each length, and several
        monkeypatch.setattr(mixing, "BLOCK_BYTES", block)
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.score, r.n_bytes) for r in mixing.score(docs.drop("learned"), F.coalesce(F.col("doc_id") % 5 != 0, F.lit(False))).collect())
        want = sorted(((i if i is not None else -1), -coder(t or "", learned, trees) * math.log10(2), len((t or "").encode())) for i, t in rows)
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g[0] == w[0] and g[2] == w[2] and math.isclose(g[1], w[1], rel_tol=2e-4), (g, w)


def test_empty_table(spark):
    assert mixing.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0


def test_what_blocks_exchange_is_smaller_than_their_texts(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(200)), i % 10 != 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learned boolean")
    trees, _ = mixing.train(docs)
    placed, size = mixing.dealt(docs)
    assert sorted(r for x in placed.collect() for r in zip(x.ids, x.learned, strict=True)) == [(i, learned) for i, _, learned in rows]
    answers = mixing.answered(placed, spark.sparkContext.broadcast(trees), 4).toArrow()
    back = sum(map(len, answers.column("odds").to_pylist() + answers.column("words").to_pylist()))
    there = sum(len(x.texts) for x in placed.collect())
    assert size == sum(len(t) for _, t, _ in rows) and there < 0.75 * size and back < size
    count = Counter(w for _, t, learned in rows if learned for w in t.split())
    assert sum(x for x in answers.column("known").to_pylist() if x) == len(count) + 1
    assert sum(x for x in answers.column("total").to_pylist() if x) == sum(count.values()) + 360


def test_odds_of_equal_contexts_are_laid_out_once(spark):
    rows = [(i, "the same words again and again " * 40, True, 0) for i in range(30)] + [(30, "", True, 0), (31, "others", False, 0)]
    placed = spark.createDataFrame(rows, "doc_id long, text string, learned boolean, block int")
    trees, first = mixing.train(placed.filter("learned"))
    answers = mixing.context_odds(placed, spark.sparkContext.broadcast(trees), 3).toArrow()
    found = mixing.Decisions(pa.array([r[1] for r in rows]), trees, first, answers, 3)
    assert 20 * len(found.table) < int(found.start[-1])
    bits = mixing.bits_of(found)
    assert np.allclose(bits[:30], bits[0]) and 0 < bits[30] < bits[31]


def test_distinct_keys_stand_at_their_places():
    rng = np.random.default_rng(3)
    for n, many in ((0, 1), (1, 1), (5000, 40), (5000, 1 << 62), (1 << 16, 3000)):
        keys = rng.integers(0, many, n).astype(np.uint64)
        own, which = mixing.distinct(keys)
        assert (own[which] == keys).all() and len(own) == len(np.unique(keys))


def test_many_short_texts_are_not_one_block(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_BYTES", 8 << 10)
    docs = spark.range(0, 4000, 1, 8).selectExpr("id as doc_id", "if(id % 2 = 0, 'a', '') as text", "true as learned")
    placed, size = mixing.dealt(docs)
    rows = placed.selectExpr("block", "size(ids) as n").groupBy("block").agg(F.sum("n").alias("n")).collect()
    assert size == 2000 and sum(r.n for r in rows) == 4000 and max(r.n for r in rows) < 1600
