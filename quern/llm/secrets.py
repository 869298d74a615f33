"""Secret scans with a random forest that removes false positives.

Candidates are runs of 16 or more of the characters that keys are made of, with a digit or with both cases, and, of any
length and characters, values after key words (password=, "token": ...) and passwords in URLs (user:password@). A run that
is such a value is one candidate; where they differ both stay. Features of a candidate: its length and kinds of characters, its character transitions (how often the kind changes, and how likely
the pairs of bytes are in the corpus), dictionary coverage (the share in letter runs whose four-letter grams are frequent in
the corpus), its path and its neighbouring words, both hashed. The forest is trained from labelled findings: MOST_TRAIN
rows of either label at most, those of the smallest hashes. Its trees grow in a Spark task each. Corpus counts come from
all documents, in a table of fixed size.

Defined cases: null texts are empty and have no candidates; null paths are empty ones; a null id stays null; rows that repeat
are scanned each; with findings of one label only all scores are that label, without any all are 1 (nothing is removed).
Columns other than those named aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import PAGE, PAGES_SCHEMA, Work, crc_mod, pages_out, pieces, text_bytes, vector_of

LEAST = 16
#: Labelled findings of either label that the forest is trained from at most.
MOST_TRAIN = 10_000
TREES, DEPTH, LEAF, CUTS = 32, 10, 5, 16
GRAMS = 1 << 18
BEFORE, AFTER = 48, 24
PATHS, WORDS = 16, 48

#: Values after a key word, up to a quote or blank, and passwords in URLs.
_KEYED = re.compile(rb"""(?i)(?:token|secret|password|passwd|api[_-]?key)["']?\s*[=:]\s*(?:"([^"\n]+)"|'([^'\n]+)'|["']?([^\s"']+))""")
_IN_URL = re.compile(rb"://[^\s/@:]*:([^\s/@]+)@")

_KIND = np.zeros(256, np.uint8)  # 0: none, 1: digit, 2: lower, 3: upper, 4: other
_KIND[ord("0") : ord("9") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 2
_KIND[ord("A") : ord("Z") + 1] = 3
_KIND[[ord(x) for x in "+/_-"]] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    filled = pc.fill_null(texts, "")
    return text_bytes(pc.binary_join_element_wise(filled, pa.scalar("", filled.type), pa.scalar(" ", filled.type)))


def _keyed(raw: bytes, at: np.ndarray) -> set[tuple[int, int]]:
    """Where values after key words and passwords in URLs start and end; no match reaches into the next text."""
    spans = set()
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        text = raw[lo:hi]
        for m in _KEYED.finditer(text):
            value = m[m.lastindex] if m.lastindex < 3 else m[3].rstrip(b",;.)]}") or m[3]
            spans.add((lo + m.start(m.lastindex), lo + m.start(m.lastindex) + len(value)))
        spans |= {(lo + m.start(1), lo + m.end(1)) for m in _IN_URL.finditer(text)}
    return spans


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, path, start (in bytes), value, before and after (what stands around it)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))

    def run(batches):
        for piece in pieces(batches, "text"):
            data, at = _joined(piece.column("text"))
            kind = _KIND[data]
            edge = np.diff((kind > 0).astype(np.int8), prepend=0)
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long = b - a >= LEAST
            a, b = a[long], b[long]
            has = [np.concatenate(([0], np.cumsum(kind == k))) for k in (1, 2, 3)]
            n = [h[b] - h[a] for h in has]
            ok = (n[0] > 0) | ((n[1] > 0) & (n[2] > 0))
            raw = data.tobytes()
            both = sorted(_keyed(raw, at) | set(zip(a[ok].tolist(), b[ok].tolist(), strict=True)))
            a, b = np.array(both, np.int64).reshape(-1, 2).T
            doc = np.searchsorted(at, a, side="right") - 1
            first, end = at[doc].tolist(), at[doc + 1].tolist()
            cut = lambda x, y: raw[x:y].decode("utf-8", "ignore")
            spans = list(zip(a.tolist(), b.tolist(), first, end, strict=True))
            yield pa.record_batch(
                [
                    *(piece.column(c).take(pa.array(doc)) for c in ("doc_id", "path")),
                    pa.array(a - at[doc]),
                    pa.array([cut(x, y) for x, y, _, _ in spans], pa.string()),
                    pa.array([cut(max(f, x - BEFORE), x) for x, _, f, _ in spans], pa.string()),
                    pa.array([cut(y, min(e, y + AFTER)) for _, y, _, e in spans], pa.string()),
                ],
                names=["doc_id", "path", "start", "value", "before", "after"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, path string, start long, value string, before string, after string")


def _gram_slots(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all four-letter grams of lower-cased bytes, and where they start."""
    letter = _KIND[b] == 2
    if len(b) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(letter[:-3] & letter[1:-2] & letter[2:-1] & letter[3:])
    code = sum((b[at + k].astype(np.int64) - 97) * 26**k for k in range(4))  # below 456976
    return (code * 0x9E3779B1 >> 13) & (GRAMS - 1), at


SIZE = -(-(65536 + GRAMS) // PAGE) * PAGE


def corpus_tables(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of byte pairs (256 x 256) and which slots of four-letter grams are frequent, over all documents."""

    def count(batches):
        counts = np.zeros(SIZE, np.int64)
        for piece in pieces(batches, "text"):
            b = _LOWER[_joined(piece.column("text"))[0]]
            counts[:65536] += np.bincount(b[:-1].astype(np.int64) * 256 + b[1:], minlength=65536)
            counts[65536 : 65536 + GRAMS] += np.bincount(_gram_slots(b)[0], minlength=GRAMS)
        yield from pages_out(counts)

    counts = vector_of(docs.select(F.col(text_col).alias("text")).mapInArrow(count, PAGES_SCHEMA), SIZE)
    pairs, grams = counts[:65536].reshape(256, 256), counts[65536 : 65536 + GRAMS]
    return np.log((pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 128.0)), grams * GRAMS * 8 >= max(int(grams.sum()), 1)


def _slot(word: str, n: int) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) % n


def features(value: str, before: str, after: str, path: str, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    pairs, frequent = tables
    b = np.frombuffer(value.encode(), np.uint8)
    kind, low, n = _KIND[b], _LOWER[b], len(b)
    share = [float((kind == k).sum()) / n for k in (1, 2, 3, 4)]
    slots, at = _gram_slots(low)
    covered = np.zeros(n + 4, np.int64)
    good = at[frequent[slots]]
    np.add.at(covered, good, 1)
    np.add.at(covered, good + 4, -1)
    counts = np.array(list(Counter(value).values())) / n
    plain = [
        n,
        *share,
        sum(c in "0123456789abcdef" for c in value) / n,
        float((kind[1:] != kind[:-1]).sum()) / max(n - 1, 1),
        float(pairs[low[:-1], low[1:]].mean()) if n > 1 else 0.0,
        float((np.cumsum(covered)[:n] > 0).sum()) / n,
        float(-(counts * np.log2(counts)).sum()),
        len(counts) / n,
        float(before.rstrip("\"' ").endswith(("=", ":"))),
        float(before.endswith(('"', "'"))),
    ]
    out = np.zeros(len(plain) + PATHS + WORDS, np.float32)
    out[: len(plain)] = plain
    out[len(plain) + _slot(path, PATHS)] = 1
    words = [w.strip(".,;:=\"'()").lower() for w in [*before.split()[-3:], *after.split()[:1]]]
    for w in filter(None, words):
        out[len(plain) + PATHS + _slot(w, WORDS)] = 1
    return out


def with_features(found: DataFrame, tables: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(tables)  # fixed size

    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("value", "before", "after", "path")]
            rows = [features(*x, shared.value) for x in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float32()))], names=[*batch.schema.names, "features"])

    return found.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", features array<float>")


Tree = tuple[list[int], list[float], list[int], list[float]]


def grow(x: np.ndarray, y: np.ndarray, seed: int) -> Tree:
    """One tree on a bootstrap sample: split feature (-1: leaf), threshold, right child (the left one follows), share of secrets."""
    rng = np.random.default_rng(seed)
    feature, threshold, right, share = [], [], [], []

    def node(rows: np.ndarray, depth: int) -> None:
        me, p = len(feature), float(y[rows].mean())
        feature.append(-1)
        threshold.append(0.0)
        right.append(-1)
        share.append(p)
        if depth == DEPTH or p in (0.0, 1.0) or len(rows) < 2 * LEAF:
            return
        best = (p * (1 - p) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], min(math.isqrt(x.shape[1]) + 4, x.shape[1]), replace=False):
            v = x[rows, f]
            for t in np.unique(np.quantile(v, np.linspace(0.02, 0.98, CUTS), method="lower")):
                go = v <= t
                k = int(go.sum())
                if LEAF <= k <= len(rows) - LEAF:
                    p1 = float(y[rows[go]].mean())
                    p2 = (p * len(rows) - p1 * k) / (len(rows) - k)
                    best = min(best, ((k * p1 * (1 - p1) + (len(rows) - k) * p2 * (1 - p2)) / len(rows), int(f), float(t)))
        if best[1] < 0:
            return
        feature[me], threshold[me] = best[1], best[2]
        go = x[rows, best[1]] <= best[2]
        node(rows[go], depth + 1)
        right[me] = len(feature)
        node(rows[~go], depth + 1)

    node(rng.integers(0, len(y), len(y)), 0)
    return feature, threshold, right, share


def train(found: DataFrame, label_col: str = "label", seed: int = 7) -> list[Tree]:
    """The forest from findings with features and a label (null: not labelled)."""
    spark = found.sparkSession
    order = F.xxhash64("value", "before", "path", "start")
    some = lambda k: found.filter(F.col(label_col).cast("int") == k).orderBy(order).limit(MOST_TRAIN).select("features", F.lit(k).alias("y"))
    sample = some(0).union(some(1)).toArrow()
    if not sample.num_rows:
        return [([-1], [0.0], [-1], [1.0])]
    x = np.array(sample.column("features").to_pylist(), np.float32)
    y = np.asarray(sample.column("y"), np.float64)
    shared = spark.sparkContext.broadcast((x, y))  # bounded by MOST_TRAIN

    def run(frames):
        for frame in frames:
            for k in frame["id"]:
                yield pd.DataFrame([(k, *grow(*shared.value, seed + int(k)))], columns=["id", "feature", "threshold", "right", "share"])

    trees = spark.range(TREES, numPartitions=TREES).mapInPandas(run, "id long, feature array<int>, threshold array<double>, right array<int>, share array<double>")
    return [tuple(r)[1:] for r in sorted(trees.collect())]


def score(found: DataFrame, forest: list[Tree]) -> DataFrame:
    """The findings with score, the mean over trees of the share of secrets in the leaf; is_secret from 0.5 on."""
    shared = found.sparkSession.sparkContext.broadcast([tuple(map(np.array, t)) for t in forest])

    @F.pandas_udf("double")
    def rate(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype="float64")
        x, total = np.stack(column.to_list()), np.zeros(len(column))
        for feature, threshold, right, share in shared.value:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                step = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at], at + 1, right[at])
                at = np.where(f < 0, at, step)
            total += share[at]
        return pd.Series(total / len(shared.value))

    out = found.withColumn("score", rate("features")).drop("features")
    return out.withColumn("is_secret", F.col("score") >= 0.5)


def format_label(value: Column, before: Column) -> Column:
    """Labels for findings whose format leaves no doubt, null for all others: where no one has labelled any."""
    key = value.rlike("^AKIA[0-9A-Z]{16}$") | (before.rlike(r"(?i)(token|secret|password|passwd|api[_-]?key)\s*[=:]\s*[\"']?$") & value.rlike("[0-9]"))
    number = value.rlike("^[0-9]+$") | value.rlike("^[0-9]{4}(-[0-9]{4}){3}$")
    in_url = before.rlike(r"://[^\s/@:]*:[^\s/@]*$")  # may be a password
    return F.when(key, 1).when(number | (before.rlike("(@|://)[^ ]*$") & ~in_url), 0)


def scan(docs: DataFrame, learn_from: Column, label: Column | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """All findings with label, score and is_secret; the forest learns from labelled ones for which learn_from (on doc_id) holds."""
    work = Work(docs.sparkSession)
    found = candidates(docs, id_col, text_col, path_col)
    label = format_label(F.col("value"), F.col("before")) if label is None else label
    found = work.save("findings", with_features(found, corpus_tables(docs, text_col)).withColumn("label", label).withColumn("learned", learn_from))
    return score(found, train(found.filter("learned")))


def op5_secret_scan(spark, sf_dir):
    """All findings in the documents; a third of the documents is held out from training. Values come as hashes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, crc_mod(F.col("doc_id"), 3) != 1)
    return found.select("doc_id", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "path", (~F.col("learned")).alias("held_out"), "label", "score", "is_secret")
