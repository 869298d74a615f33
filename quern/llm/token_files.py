"""Token ids in a word-aligned binary form: Simple-8b with escapes and block offsets.

An id stream is cut into blocks of 256 ids. Each 64-bit word has a 4-bit selector and as many ids of one width as fit in
60 bits (down to the escape, selector 15: one id of up to 60 bits); a block's last words are chosen so that it ends with a
word, and its first word's number is kept, so blocks and words decode in parallel without looking at the ones before.

A token table holds segments (rows) of whole documents in ascending order of doc_id, in parts that one task each wrote:
part, start (ids before it in its part), doc_ids, n_tokens, payload. payload is one segment in the file format:
magic, ids, words, blocks (4 little-endian 32-bit integers), block offsets (32 bits each), words (64 bits each).

Defined cases: null and empty texts have the end id only; rows that share an id are ordered by a hash of their text, equal
rows come twice; a null id sorts first. Columns other than the id and the text aren't read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.llm.bpe import byte_alphabet
from quern.llm.common import Work, pieces, remembered, text_bytes

BLOCK = 256
#: Ids after which a segment is closed, at the end of a document.
SEGMENT = 1 << 18
END_ID = 1
#: Bytes of texts whose words are told apart at a time.
PIECE = 8 << 20
#: Words that a worker remembers: once half as many are new, it forgets those that it hasn't met since the last time.
MOST_WORDS = 1_600_000
MAGIC = 0x42385351
#: Simple-8b's number of values and their width in bits, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def pack(ids: np.ndarray) -> bytes:
    """One segment in the file format."""
    ids = np.ascontiguousarray(ids, U)
    n = len(ids)
    if n and int(ids.max()) >> 60:
        raise ValueError("ids must have 60 bits at most")
    left = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n)).astype(np.uint16)
    # The least selector whose width holds an id; the greatest of a stretch grows with its length, so each is made of a shorter one.
    width = np.zeros(n, np.uint8)
    for s in range(1, 15):
        width += ids >= U(1) << U(WIDTHS[s])
    choice, greatest, size = np.full(n, 15, np.uint8), width, 1
    for s in range(14, -1, -1):
        k = int(COUNTS[s])
        while size < k:
            step = min(size, k - size)
            greatest = np.maximum(greatest, np.concatenate((greatest[step:], np.full(min(step, n), 255, np.uint8))))
            size += step
        # Selectors 0 and 1 both have width 0, which only ids of 0 fit.
        choice[(greatest <= max(s - 1, 0)) & (left >= k)] = s
    choice = choice.astype(np.int64)
    at = np.arange(0, n, BLOCK)
    ends, found = np.minimum(at + BLOCK, n), []
    while len(at):  # all blocks at once, a word each
        found.append(at)
        at = at + COUNTS[choice[at]]
        live = at < ends
        at, ends = at[live], ends[live]
    spots = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    sel = choice[spots]
    words = sel.astype(U) << U(60)
    for s in range(2, 16):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            values = ids[spots[mine][:, None] + np.arange(COUNTS[s])]
            words[mine] |= np.bitwise_or.reduce(values << (np.arange(COUNTS[s]) * WIDTHS[s]).astype(U), axis=1)
    offsets = np.searchsorted(spots, np.arange(0, n, BLOCK)).astype("<u4")
    return struct.pack("<4I", MAGIC, n, len(words), len(offsets)) + offsets.tobytes() + words.astype("<u8").tobytes()


def unpack(payload: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of a segment, or of its blocks from the first up to (not with) the last."""
    magic, n, n_words, n_blocks = struct.unpack_from("<4I", payload)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    offsets = np.frombuffer(payload, "<u4", n_blocks, 16)
    words = np.frombuffer(payload, "<u8", n_words, 16 + 4 * n_blocks)
    last = n_blocks if last_block is None else min(last_block, n_blocks)
    if first_block >= last:
        return np.zeros(0, U)
    words = words[offsets[first_block] : offsets[last] if last < n_blocks else n_words]
    sel = (words >> U(60)).astype(np.int64)
    start = np.cumsum(COUNTS[sel]) - COUNTS[sel]
    out = np.zeros(min(last * BLOCK, n) - first_block * BLOCK, U)
    for s in range(2, 16):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(U)
            out[start[mine][:, None] + np.arange(COUNTS[s])] = (words[mine][:, None] >> shifts) & U((1 << int(WIDTHS[s])) - 1)
    return out


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    import tokenizers

    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


#: The split of the vocabulary file that is known to part words at ASCII white space and letters from what follows.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=4)
def _parts_words(path: str) -> bool:
    """Whether the library's ids of a text are those of its words. Other vocabularies are asked for whole texts."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x.get("type") for x in ((spec["normalizer"] or {}).get("normalizers") or [])]
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or []
    model, plain = spec["model"], all(not x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and spec["normalizer"]["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
        and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": _SPLIT}
        and steps[0]["invert"]
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and model["type"] == "BPE"
        and not model["dropout"]
        and plain
    )


def _by_library(library, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Each piece with its ids. Words of small letters go to the library's model at once, as nothing is left to normalise or split."""
    tokens, other = library.model.tokenize, []
    for x in pieces:
        if x.isalpha() and x.islower():
            yield x, np.array([t.id for t in tokens(x.decode())], "<u4").tobytes()
        elif not x.isascii() and (word := x.decode()).isalpha() and max(word) < "\u0250" and _DOTTED not in x:
            # Letters up to here have one form and one small letter each; the model reads a character for each byte.
            yield x, np.array([t.id for t in tokens(word.lower().encode().decode("latin-1").translate(_BYTES))], "<u4").tobytes()
        else:
            other.append(x)
    for lo in range(0, len(other), 4096):
        some = other[lo : lo + 4096]
        for x, e in zip(some, library.encode_batch_fast([y.decode() for y in some], add_special_tokens=False), strict=True):
            yield x, np.array(e.ids, "<u4").tobytes()


#: The printable character that stands for each byte.
_BYTES = dict(enumerate(byte_alphabet()))
#: A capital whose small form is two characters, which what follows may change.
_DOTTED = "\u0130".encode()
#: A word with what ends it. The vocabulary's pattern parts them, and it lowers case.
_ENDED = re.compile(rb"([A-Za-z\x80-\xff]+)([^A-Za-z0-9'\x80-\xff]*)")


def _learn(words: list[bytes], path: str) -> dict[bytes, bytes]:
    """The library's ids by word. Its vocabulary parts words at ASCII white space, so each stretch between is encoded once."""
    library, memory = _library(path), remembered("tokens").setdefault(path, {"now": {}, "before": {}, "pieces": {}})
    known = memory["now"]
    new = {w for w in words if w not in known}
    if len(known) + len(new) > MOST_WORDS // 2:
        memory |= {"before": known, "now": {}, "pieces": {}}
        known, new = memory["now"], set(words)
    before, pieces = memory["before"], memory["pieces"]
    known.update((w, before[w]) for w in new if w in before)
    parts = {w: (m[1].lower() if m[1].isascii() else m[1], m[2]) if (m := _ENDED.fullmatch(w)) and (m[1].isascii() or m[1].decode().isalpha() and _DOTTED not in w) else (w, b"") for w in new if w not in known}
    pieces[b""] = b""
    pieces.update(_by_library(library, list({x for p in parts.values() for x in p if x not in pieces})))
    known.update((w, pieces[x] + pieces[y]) for w, (x, y) in parts.items())
    return known


def _stretches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Where each word begins, which of the distinct stretches (a word and the white space after it) it is, and these."""
    white = _WHITE[data]
    begins = ~white
    begins[1:] &= white[:-1]
    first = np.flatnonzero(begins)
    ends = np.append(first, len(data)).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    return first, found.indices.to_numpy(), found.dictionary.to_pylist()


def _encoded(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, an end id after each, and how many each text has."""
    filled = pc.fill_null(column, "")
    if not _parts_words(path):
        ids = [e.ids for e in _library(path).encode_batch_fast(filled.to_pylist(), add_special_tokens=False)]
        return np.array([x for i in ids for x in (*i, END_ID)], "<u4"), np.array([len(i) + 1 for i in ids], np.int64)
    data, at = text_bytes(pc.binary_join_element_wise(filled, pa.scalar("", filled.type), pa.scalar(" ", filled.type)))
    # A word begins where white space ends; texts end with a space, so none reaches into the next.
    begins, which, stretches = _stretches(data)
    words = [x.rstrip() for x in stretches]
    known = _learn(words, path)
    ids = list(map(known.__getitem__, words))
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    size = sizes[which]
    per_word = np.concatenate(([0], np.cumsum(size)))
    flat = np.frombuffer(b"".join(ids), "<u4")
    spot = np.repeat((np.cumsum(sizes) - sizes)[which] - per_word[:-1], size) + np.arange(per_word[-1])
    ends = per_word[np.searchsorted(begins, at)[1:]]
    return np.insert(flat[spot], ends, END_ID), np.diff(ends, prepend=0) + 1


def write_tokens(docs: DataFrame, path: str, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents, each with the end id after it, and write them in ascending order of their ids."""
    file = vocab or default_vocab()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(tasks, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches):
        part, start, size, ids, counts, held = 0, 0, 0, [], [], []

        def close():
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([counts], pa.list_(pa.int64())), pa.array([pack(np.concatenate(held))], pa.binary())],
                names=["part", "start", "doc_ids", "n_tokens", "payload"],
            )

        for piece in pieces(batches, "text", PIECE, keeps="tokens"):
            found, per = _encoded(piece.column("text"), file)
            kind, part, names = piece.schema.field("doc_id").type, piece.column("part")[0].as_py(), piece.column("doc_id").to_pylist()
            total, at = np.concatenate(([0], np.cumsum(per))), 0
            while at < len(per):
                to = min(int(np.searchsorted(total, total[at] + SEGMENT - size)), len(per))
                ids += names[at:to]
                counts += per[at:to].tolist()
                held.append(found[total[at] : total[to]])
                size += int(total[to] - total[at])
                at = to
                if size >= SEGMENT:
                    yield close()
                    start, size, ids, counts, held = start + size, 0, [], [], []
        if ids:
            yield close()

    ordered.mapInArrow(run, f"part int, start long, doc_ids array<{rows.schema['doc_id'].dataType.simpleString()}>, n_tokens array<long>, payload binary").write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids_crc32 or the ids, of every document of a token table."""
    table = spark.read.parquet(path)
    sizes = table.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, v: s + v)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.select(F.col("part").alias("p"), before.alias("before"))  # a row per writing task
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, counts = unpack(row["payload"]).astype("<u4"), np.array(row["n_tokens"], np.int64)
                at = np.concatenate(([0], np.cumsum(counts)))
                n = len(counts)
                if digests:
                    last = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.record_batch(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(at[:-1] + row["start"]), pa.array(counts), last],
                    names=["part", "doc_id", "start", "n_tokens", name],
                )

    name, what = ("ids_crc32", "long") if digests else ("ids", "array<int>")
    docs = table.mapInArrow(run, f"part int, doc_id {kind}, start long, n_tokens long, {name} {what}")
    return docs.join(F.broadcast(parts), F.col("part") == F.col("p")).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", name)


def op3_token_files(spark, sf_dir):
    """Every document encoded, written and read back."""
    work = Work(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{work.path}/tokens")
    return read_tokens(spark, f"{work.path}/tokens", digests=True)
