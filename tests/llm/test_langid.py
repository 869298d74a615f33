"""The mixture of languages against a plain expectation-maximisation, word by word."""

import math
import random

import numpy as np
import pyarrow as pa

from quern.llm import langid


def gram(a, b, c):
    m = 0xFFFFFFFF
    code = (a * 0x9E3779B1 & m) ^ (b * 0x85EBCA6B & m) ^ (c * 0xC2B2AE35 & m)
    return ((code ^ code >> 15) * 0x2C1B3C6D & m) >> 16


def words_of(text):
    """The grams of each word: letters are a to z and all bytes beyond ASCII."""
    data = text.lower().encode() + b" "
    letter = [97 <= b <= 122 or b >= 0x80 for b in data]
    at = lambda i: data[i] if i >= 0 and letter[i] else 32
    words, inside = [], False
    for i in range(len(data)):
        if letter[i]:
            if not inside:
                words.append([])
            words[-1].append(gram(at(i - 1), at(i), at(i + 1)))
        inside = letter[i]
    return words


def plain(text, table, penalty):
    words = words_of(text)
    k = table.shape[1]
    if not words:
        return [0.0] * k
    like = []
    for w in words:
        logs = [sum(float(table[g, j]) for g in w) for j in range(k)]
        like.append([math.exp(x - max(logs)) for x in logs])

    def fit(theta, steps):
        for _ in range(steps):
            total = [0.0] * k
            for row in like:
                part = [a * b for a, b in zip(row, theta, strict=True)]
                for j, x in enumerate(part):
                    total[j] += x / (sum(part) + 1e-30)
            theta = [x / len(like) for x in total]
        return theta

    theta = fit([1 / k] * k, langid.STEPS)
    order = sorted(range(k), key=lambda j: -theta[j])
    best = None
    for m in range(1, k + 1):
        some = [theta[j] + 1e-6 if j in order[:m] else 0.0 for j in range(k)]
        some = [x / sum(some) for x in some]
        if m > 1:
            some = fit(some, 2)
        value = sum(math.log(sum(a * b for a, b in zip(row, some, strict=True)) + 1e-30) for row in like) - penalty * m * math.log(len(like) + 1)
        if best is None or value > best[0]:
            best = (value, some)
    return [x / sum(best[1]) for x in best[1]]


def test_infer_against_plain_em(spark):
    rng = random.Random(9)
    own = {lang: ["".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(60)] for lang, letters in (("a", "abcdet"), ("b", "xyzöpt"), ("c", "mnoéat"))}
    make = lambda lang, n: " ".join(rng.choices(own[lang], k=n))
    docs = spark.createDataFrame([(lang, make(lang, 80)) for lang in own for _ in range(5)], "lang string, text string")
    langs, table = langid.train(docs)
    assert langs == ["a", "b", "c"]
    texts = ["", "12 .", make("a", 1), make("b", 40), f"{make('a', 60)}, {make('c', 30)}", f"{make('a', 25)} {make('b', 25)} {make('c', 25)}", make("c", 5) + " Zzz!", None]
    shares, words = langid.infer(pa.array(texts, pa.string()), table)
    several = 0
    for text, row, n in zip(texts, shares, words, strict=True):
        want = plain(text or "", table, langid.PENALTY)
        assert n == len(words_of(text or ""))
        assert [x > 0 for x in row] == [x > 0 for x in want] and np.allclose(row, want, atol=2e-3)
        several += sum(x > 0 for x in row) > 1
    assert several >= 2
