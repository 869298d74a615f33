"""BPE encoding and decoding with a pair occurrence index.

A task collects the distinct words of its texts that it hasn't met yet and lays their symbols out as one linked list.
An index maps each mergeable pair to all its positions; the ranks that occur are taken from a heap in ascending order, all
positions of that pair are merged from left to right, and the lists of the pairs to either side are updated. Texts are then
put together from their words' ids. ASCII white space never joins what it parts, so a word's ids don't depend on its text.

The vocabulary is a `tokenizers` JSON file of a BPE model with word ends (normaliser: NFC, spaces, lower case; a split
pattern that drops white space; byte level); results equal that library's encode(text, add_special_tokens=False) and
decode(ids, skip_special_tokens=False). Special tokens that stand in a text are found as the library finds them.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows are encoded alike; columns
other than those asked for aren't read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import pieces, remembered

#: Words that a worker remembers: once half as many are new, it forgets those that it hasn't met since the last time.
MOST_WORDS = 500_000
#: The split of the vocabulary file, with its white space (Unicode's) spelled out.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Capitals whose lower case depends on their neighbours or is more than a letter.
HARD_LOWER = frozenset("\u03a3\u0130")


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(printable))
    chars = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


class PairIndexBPE:
    """The model of a vocabulary file."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kinds = spec["model"], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        plain = all(not x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or not plain or kinds != ["Split", "ByteLevel"] or split != SPLIT or model["unk_token"] is not None or model["ignore_merges"]:
            raise ValueError(f"{path} isn't a vocabulary of the kind that this encoder reads")
        self.normalize = tokenizers.Tokenizer.from_file(path).normalizer.normalize_str
        vocab = model["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t.encode() for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_bytes = [x.encode() for x in self.special]
        end, alphabet = model["end_of_word_suffix"] or "", byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.last = np.array([vocab[c + end] for c in alphabet], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.keys = [vocab[a] << 20 | vocab[b] for a, b in merges]
        self.made = [vocab[a + b] for a, b in merges]
        self.ranks = {k: r for r, k in enumerate(self.keys)}
        by_key = sorted(self.ranks.items())
        self.sorted_keys, self.sorted_ranks = np.array([k for k, _ in by_key], np.int64), np.array([r for _, r in by_key], np.int64)
        self.words_ascii = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\s]+")
        self.words_any = regex.compile(SPLIT.replace(r"\s", SPACE))

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        symbols[ends] = -1
        pair = symbols[:-1] << 20 | symbols[1:]
        pair[(symbols[:-1] < 0) | (symbols[1:] < 0)] = -1
        spot = np.minimum(np.searchsorted(self.sorted_keys, pair), len(self.sorted_keys) - 1)
        at = np.flatnonzero(self.sorted_keys[spot] == pair)
        rank = self.sorted_ranks[spot[at]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        heap = rank[np.concatenate(([0], cuts))].tolist() if len(rank) else []
        index = dict(zip(heap, (x.tolist() for x in np.split(at, cuts)), strict=True)) if heap else {}
        sym = symbols.tolist()
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        ranks, keys, push = self.ranks.get, self.keys, heapq.heappush
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if not places:
                continue
            places.sort()
            a, b = keys[r] >> 20, keys[r] & 0xFFFFF
            new = self.made[r]
            for k, p in enumerate(places):
                q = nxt[p]
                if sym[p] != a or sym[q] != b:
                    continue
                n, left, early = nxt[q], prv[p], False
                sym[p], sym[q], nxt[p], prv[n] = new, -2, n, p
                hit = ranks((sym[left] << 20) | new) if left >= 0 else None
                if hit is not None:
                    if hit in index:
                        index[hit].append(left)
                    else:
                        index[hit] = [left]
                        push(heap, hit)
                    early = hit < r
                hit = ranks(new << 20 | sym[n])
                if hit is not None:
                    if hit in index:
                        index[hit].append(p)
                    else:
                        index[hit] = [p]
                        push(heap, hit)
                    early |= hit < r
                if early:  # a lower rank has come up: it goes first
                    if places[k + 1 :]:
                        if r in index:
                            index[r] += places[k + 1 :]
                        else:
                            index[r] = places[k + 1 :]
                            push(heap, r)
                    break
        live = np.array(sym)
        flat = live[live >= 0].tolist()
        upto = np.cumsum(live >= 0)[ends].tolist()
        return [flat[lo:hi] for lo, hi in zip([0, *upto], upto, strict=False)]

    def split(self, word: bytes) -> list[bytes | int]:
        """What a stretch without ASCII white space consists of: words for merge(), and ids of special tokens."""
        if word.isalpha():
            return [word.lower()]
        if word.isascii():
            if not any(s in word for s in self.special_bytes):
                return self.words_ascii.findall(word.lower())
        elif (text := word.decode()).isalpha() and is_normalized("NFC", text) and not HARD_LOWER.intersection(text):
            return [text.lower().encode()]
        out: list[bytes | int] = []
        for k, part in enumerate(self.find_special.split(word.decode()) if self.find_special else [word.decode()]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += [x.encode() for x in self.words_any.findall(self.normalize(part))]
        return out

    def encode_words(self, words: Iterable[bytes], known: dict[bytes, tuple[bytes, bytes]], before: dict[bytes, tuple[bytes, bytes]]) -> dict[bytes, tuple[bytes, bytes]]:
        """For each stretch its ids (little-endian, 32 bits each) and what they decode to.

        Words that stretches consist of are looked up in known and before, and all are in known afterwards.
        """
        parts = {w: self.split(w) for w in words}
        new = {x for p in parts.values() for x in p if isinstance(x, bytes) and x not in known}
        known.update((x, before[x]) for x in new if x in before)
        new = [x for x in new if x not in known]
        token = self.token
        for word, ids in zip(new, self.merge(new), strict=True):
            known[word] = struct.pack(f"<{len(ids)}I", *ids), b" ".join([token[i] for i in ids])
        out = {}
        for w, p in parts.items():
            if len(p) == 1 and isinstance(p[0], bytes):
                out[w] = known[p[0]]
            else:
                found = [known[x] if isinstance(x, bytes) else (struct.pack("<I", x), token[x]) for x in p]
                out[w] = b"".join([i for i, _ in found]), b" ".join([t for _, t in found])
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b" ".join([self.token[i] for i in ids]).decode()


@lru_cache(maxsize=4)
def load(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def encode_column(texts: pa.Array, path: str):
    """Yields (ids as bytes, decoded text as bytes) of each text."""
    # Stretches and words that this worker has met: since it last forgot some, and before.
    memory = remembered("bpe").setdefault(path, {"now": {}, "before": {}, "words": {}, "words_before": {}})
    split = [(x or "").encode().split() for x in texts.to_pylist()]
    wanted, known = set().union(*split), memory["now"]
    new = [w for w in wanted if w not in known]
    if len(known) + len(new) > MOST_WORDS // 2:
        memory |= {"before": known, "now": {}, "words_before": memory["words"], "words": {}}
        known, new = memory["now"], wanted
    before = memory["before"]
    known.update((w, before[w]) for w in new if w in before)
    known.update(load(path).encode_words([w for w in new if w not in known], memory["words"], memory["words_before"]))
    for ws in split:
        got = list(map(known.__getitem__, ws))
        yield b"".join([i for i, _ in got]), b" ".join([t for _, t in got if t])


def encode(docs: DataFrame, keep: Column | None = None, text_col: str = "text", vocab: str | None = None, digests: bool = False) -> DataFrame:
    """Columns `row` (what `keep` says; by default a struct of all columns), n_tokens, and ids and decoded, or sha256 digests of these two."""
    path = vocab or default_vocab()
    rows = docs.select((F.struct("*") if keep is None else keep).alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        for piece in pieces(batches, "text", keeps="bpe"):
            pairs = list(encode_column(piece.column("text"), path))
            n = pa.array([len(i) // 4 for i, _ in pairs], pa.int64())
            if digests:
                one = pa.array([hashlib.sha256(i).hexdigest() for i, _ in pairs], pa.string())
                two = pa.array([hashlib.sha256(t).hexdigest() for _, t in pairs], pa.string())
            else:
                flat = pa.array(np.frombuffer(b"".join(i for i, _ in pairs), "<u4").astype(np.int32))
                one = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(i) // 4 for i, _ in pairs)]), pa.int32()), flat)
                two = pa.array([t.decode() for _, t in pairs], pa.string())
            yield pa.record_batch([piece.column("row"), n, one, two], names=["row", "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kinds = ["string", "string"] if digests else ["array<int>", "string"]
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}")


def op8_bpe(spark, sf_dir):
    """Every document encoded and decoded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, F.struct("doc_id"), digests=True).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
