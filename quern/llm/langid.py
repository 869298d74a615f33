"""Language identification as inference of a mixture: each document's languages and their shares.

Letters give hashed trigrams of bytes (lower-cased, other characters as spaces); counts per language over all training
documents give smoothed likelihoods. A word's likelihood under a language is the product of its trigrams'. Expectation-
maximisation over a document's words estimates the shares of all languages; of the nested sets of its k largest
languages, each refitted, the one with the best likelihood less `penalty * k * log(words)` is selected. The prediction is
the largest language of that set, the score its share.

Defined cases: texts that are null, empty or without a letter get `und` and score 0, and so do all texts when there is no
labelled training row. Null languages aren't learned from. Ties go to the language that sorts first. Repeated rows are
predicted alike; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import PAGE, PAGES_SCHEMA, crc_mod, pages_out, pieces, text_bytes, vector_of

GRAMS = 1 << 16
SMOOTH = 0.5
PENALTY = 3.0
STEPS = 8
#: Languages at most; beyond that the model (GRAMS values for each) is no longer a table of a proven small size.
MOST_LANGUAGES = 250

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram of each letter byte; the text of each; where each word starts among the letters; the text of each word."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    data, at = text_bytes(pc.binary_join_element_wise(lowered, pa.scalar("", lowered.type), pa.scalar(" ", lowered.type)))
    letter = _LETTER[data]
    b = np.where(letter, data, 32).astype(np.uint32)
    i = np.flatnonzero(letter)
    before = np.where(i > 0, b[i - 1], 32).astype(np.uint32)
    code = before * np.uint32(0x9E3779B1) ^ b[i] * np.uint32(0x85EBCA6B) ^ b[i + 1] * np.uint32(0xC2B2AE35)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    gram = (code >> np.uint32(16)).astype(np.int64)
    starts = np.flatnonzero(np.diff(i, prepend=-2) != 1)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[i]
    return gram, text, starts, text[starts]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", grams: int = GRAMS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-likelihood table (grams x languages), from all rows with a language."""
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    code = {x: k for k, x in enumerate(langs)}

    def count(batches):
        counts = np.zeros(len(code) * grams, np.int64)
        for piece in pieces(batches, "text"):
            lang = np.array([code[x] for x in piece.column("lang").to_pylist()], np.int64)
            gram, text, _, _ = _grams(piece.column("text"))
            counts += np.bincount(lang[text] * grams + gram, minlength=len(counts))
        yield from pages_out(counts)

    counts = vector_of(rows.mapInArrow(count, PAGES_SCHEMA), -(-len(langs) * grams // PAGE) * PAGE).reshape(-1, grams) if langs else np.zeros((0, grams))
    table = np.log((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * grams))
    return langs, np.ascontiguousarray(table.T, np.float32)


def infer(texts: pa.Array, table: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """For each text the shares of its selected languages (texts x languages, 0 for others) and its number of words."""
    n, k = len(texts), table.shape[1]
    shares, words = np.zeros((n, k)), np.zeros(n, np.int64)
    gram, _, starts, owner = _grams(texts)
    if not len(starts) or not k:
        return shares, words
    words = np.bincount(owner, minlength=n)
    there = np.flatnonzero(words)
    first = np.concatenate(([0], np.cumsum(words[there])[:-1]))
    size = words[there]
    logs = np.add.reduceat(table[gram], starts, axis=0)
    top = logs.max(axis=1, keepdims=True)
    like = np.exp(logs - top)

    def fit(theta: np.ndarray, steps: int) -> np.ndarray:
        for _ in range(steps):
            part = like * np.repeat(theta, size, axis=0)
            part /= part.sum(axis=1, keepdims=True) + 1e-30
            theta = (np.add.reduceat(part, first, axis=0, dtype=np.float64) / size[:, None]).astype(np.float32)
        return theta

    theta = fit(np.full((len(there), k), 1 / k, np.float32), STEPS)
    rank = np.empty_like(theta, np.int64)
    np.put_along_axis(rank, np.argsort(-theta, axis=1, kind="stable"), np.arange(k)[None, :], axis=1)
    best, chosen = np.full(len(there), -np.inf), np.zeros_like(theta)
    for m in range(1, k + 1):
        some = np.where(rank < m, theta + 1e-6, 0).astype(np.float32)
        some /= some.sum(axis=1, keepdims=True)
        if m > 1:
            some = fit(some, 2)
        mixed = np.log((like * np.repeat(some, size, axis=0)).sum(axis=1) + 1e-30)
        value = np.add.reduceat(mixed, first, dtype=np.float64) - penalty * m * np.log(size + 1.0)
        better = value > best
        best[better], chosen[better] = value[better], some[better]
    shares[there] = chosen / chosen.sum(axis=1, keepdims=True)
    return shares, words


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: Column | None = None, text_col: str = "text") -> DataFrame:
    """Columns `row` (what `keep` says; by default a struct of all columns), lang_pred, score, languages (share by language)."""
    langs, table = model
    # Where the row holds the text, it is taken from there, so that it is sent once.
    rows = docs.select(F.struct("*").alias("row")) if keep is None else docs.select(keep.alias("row"), F.col(text_col).alias("text"))
    own = keep is None  # tasks get this, as a Column can't be sent to them
    shared = docs.sparkSession.sparkContext.broadcast(table)  # GRAMS x languages, bounded by MOST_LANGUAGES

    def run(batches):
        names = np.array([*langs, "und"], object)
        if own:
            batches = (pa.record_batch([b.column("row"), b.column("row").field(text_col)], names=["row", "text"]) for b in batches)
        for piece in pieces(batches, "text"):
            texts = piece.column("text")
            shares, words = infer(texts, shared.value)
            first = np.where(words > 0, shares.argmax(axis=1) if langs else 0, len(langs))
            score = np.where(words > 0, shares.max(axis=1, initial=0), 0.0)
            # Bytes over 0x7f count as letters above; where a text has no other ones, look at its characters.
            plain = pc.match_substring_regex(pc.fill_null(texts, ""), "[A-Za-z]").to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(~plain & (words > 0)):
                if not any(c.isalpha() for c in texts[int(k)].as_py()):
                    first[k], score[k], shares[k] = len(langs), 0.0, 0.0
            found = [[(langs[j], float(row[j])) for j in np.flatnonzero(row > 0)] for row in shares]
            yield pa.record_batch(
                [piece.column("row"), pa.array(names[first], pa.string()), pa.array(np.clip(score, 0.0, 1.0)), pa.array(found, pa.map_(pa.string(), pa.float64()))],
                names=["row", "lang_pred", "score", "languages"],
            )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, lang_pred string, score double, languages map<string, double>")


def keep_known(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text has a language; rows without any letter go. All columns are kept."""
    return predict(docs, train(docs, text_col, lang_col), text_col=text_col).filter("lang_pred != 'und'").select("row.*")


def op7_language_id(spark, sf_dir):
    """The language of every document, learned from those outside of the held-out third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = train(docs.filter(~held_out))
    found = predict(docs, model, F.struct("doc_id", held_out.alias("held_out")))
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "languages")
