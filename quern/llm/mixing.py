"""Language-model scores by online logistic mixing of context bit predictors.

A text is coded as its bytes and an end symbol, each symbol as the path of its leaf in a Huffman tree of its predecessor
(trees from all training documents), so that a byte takes about three binary decisions. Predictors of four context
lengths hold, per (context, tree node), how often either branch was taken in all training documents; these counts are
those of the corpus and don't change while a text is scored. A decision's log odds are the predictors' odds weighted by
two weight sets, which a gate (how sure the longest context is) blends; weights learn online from each decision's error,
and an adaptive table of the mixed odds refines the result. Each document is one pass: its weights and table start from
constants and go on to its end, so a score depends on the text and the counts alone (to rounding).

All documents of a block advance together, a decision each, so a block holds documents of about the same length; the few
longest ones, which outlive the rest of their block, go on one by one.

The base score is a unigram model with additive smoothing over lower-cased words and one end per text. Counts travel in
blocks of documents: each block sends the words and the contexts with their next symbols that it holds, and gets back the
counts of the words and the odds along the paths of the symbols. So what is kept grows with the corpus; of fixed size are
only the trees and the odds by the preceding symbol alone, all of whose values exist. The larger a block, the fewer keys a
byte of its text has. Texts, keys and answers are compressed before they are shuffled.

Defined cases: a null text is empty; an empty text is one end token and one end symbol; rows that repeat an id are scored
(and learned from) each; without training documents all counts are 0. Columns other than the id and the text aren't read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import PAGE, PAGES_SCHEMA, Work, crc_mod, lean, pages_out, pieces, text_bytes, texts, vector_of
from quern.llm.jaccard import U, mixed, word_hashes

ORDERS = (2, 4, 6)
SYMBOLS = 257  # bytes and the end
RATE, RATE_TABLE = 0.02, 0.02
CELLS = 33
STEP = 12.0  # odds are kept in steps of 1/12
#: Keys whose paths are laid out at a time.
SOME = 1 << 14
#: Bytes of text in a block of documents, and for each part of the counts, about.
BLOCK_BYTES, PART_BYTES = 14 << 20, 32 << 20
#: What a text's own weights and table count for in a block, in bytes of text.
STATE_BYTES = 32
#: Bytes of texts of about the same length that go to a block together, at most (or one longer text), and that a task sorts by length at a time.
RUN_BYTES, SORTED_BYTES = 128 << 10, 8 << 20
#: Symbols that are worked on together, decisions whose odds are laid out together, about, and those of them that are mixed together.
LAID, WINDOW, AT_ONCE = 1 << 20, 1 << 19, 1 << 15
#: Documents that still advance together; fewer go on one by one.
FEW = 6
END_WORD = U(0x5EED)


def symbols_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols, an end after each text, and where each text starts."""
    data, at = text_bytes(column)
    n = len(at) - 1
    out = np.full(len(data) + n, 256, np.uint16)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = data
    return out, at + np.arange(n + 1)


def contexts(sym: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last six symbols before each, 9 bits each, the nearest highest; 256 stands for all before a text's start."""
    one = np.full(len(sym), 256, U)
    one[1:] = sym[:-1]
    two = one << U(9)
    two[1:] |= one[:-1]
    del one
    four = two << U(18)
    four[2:] |= two[:-2]
    six = four
    six <<= U(18)
    six[4:] |= two[:-4]
    for j in range(6):  # the first symbols of each text
        spot = at[:-1] + j
        spot = spot[spot < at[1:]]
        low = 9 * (6 - j)
        six[spot] = (six[spot] >> U(low) << U(low)) | U(sum(256 << 9 * k for k in range(6 - j)))
    return six


class Trees:
    """A Huffman tree for each preceding symbol: where each leaf's path starts, its nodes and branches."""

    def __init__(self, pairs: np.ndarray):
        start, nodes, bits = np.zeros(SYMBOLS * SYMBOLS + 1, np.int64), [], []
        for c in range(SYMBOLS):
            weights = pairs[c] * 64 + 1
            parent, side = np.zeros(2 * SYMBOLS, np.int64), np.zeros(2 * SYMBOLS, np.int8)
            heap = [(int(w), s) for s, w in enumerate(weights)]
            heapq.heapify(heap)
            fresh = SYMBOLS
            while len(heap) > 1:
                (w0, a), (w1, b) = heapq.heappop(heap), heapq.heappop(heap)
                parent[a], parent[b], side[b] = fresh, fresh, 1
                heapq.heappush(heap, (w0 + w1, fresh))
                fresh += 1
            for s in range(SYMBOLS):
                path, x = [], s
                while x != fresh - 1:
                    path.append((parent[x] - SYMBOLS, side[x]))
                    x = parent[x]
                nodes += [p for p, _ in reversed(path)]
                bits += [b for _, b in reversed(path)]
                start[c * SYMBOLS + s + 1] = len(path)
        self.start, self.node, self.bit = np.cumsum(start).astype(np.int32), np.array(nodes, np.uint8), np.array(bits, np.int8)


def keys_of(last: np.ndarray, sym: np.ndarray, order: int) -> np.ndarray:
    """A symbol, highest, and the context before it (9 bits a symbol), exact in 63 bits. Keys of an order begin with those of lower ones."""
    return (sym.astype(U) << U(9 * order)) | (last >> U(9 * (6 - order)))


def context_of(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & U((1 << 9 * order) - 1)


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Which of the numbers, equal ones side by side, are the first of their kind."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def stretches(n: int) -> list[slice]:
    """0 to n in stretches, so that what is needed on the way stays small."""
    return [slice(lo, min(lo + LAID, n)) for lo in range(0, n, LAID)]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and which of them stands at each place. Sorted are hashes with their places, in one number; where hashes of
    different keys are equal, a key may be among the distinct ones more than once."""
    n = len(keys)
    width = n.bit_length()
    packed = np.empty(n, U)
    for some in stretches(n):
        one = packed[some]
        np.multiply(keys[some], U(0x9E3779B97F4A7C15), out=one)
        one ^= one >> U(32)
        one *= U(0xD6E8FEB86659FD93)
        one >>= U(width)
        one <<= U(width)
        one |= np.arange(some.start, some.stop, dtype=U)
    packed.sort()
    spot = np.empty(n, np.uint32 if width <= 32 else np.int64)
    for some in stretches(n):
        spot[some] = packed[some] & U((1 << width) - 1)
    del packed
    new = np.ones(n, bool)
    for some in stretches(n):
        mine = keys[spot[max(some.start - 1, 0) : some.stop]]
        new[max(some.start, 1) : some.stop] = mine[1:] != mine[:-1]
    which, number = np.empty(n, np.int32), -1
    for some in stretches(n):
        here = np.cumsum(new[some], dtype=np.int32)
        here += np.int32(number)
        number = int(here[-1])
        which[spot[some]] = here
    return keys[spot[new]], which


def path_starts(keys: np.ndarray, trees: Trees, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the path of each key's symbol starts, and how long it is."""
    leaf = (((keys >> U(9 * (order - 1))) & U(511)) * U(SYMBOLS) + (keys >> U(9 * order))).astype(np.int64)
    first = trees.start[leaf]
    return first, trees.start[leaf + 1] - first


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(firsts(keys))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def words_of(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """By piece of the texts, their words, an end each (after all words), and the texts that these are from."""
    for piece in pieces(table.combine_chunks().to_batches(), "text"):
        found, owner = word_hashes(piece.column("text"))
        n = piece.num_rows
        yield piece, np.concatenate((found, np.full(n, END_WORD))), np.concatenate((owner, np.arange(n)))


def tally(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys of all texts, ascending, and how often each occurs in learned ones: those of each order, and words."""
    sym, at = symbols_of(table.column("text").combine_chunks())
    keys, flags = contexts(sym, at), table.column("learned").to_numpy().astype(bool)
    learned, found = np.repeat(flags, np.diff(at)), []
    for some in stretches(len(sym)):
        keys[some] = keys_of(keys[some], sym[some], ORDERS[-1]) << U(1) | learned[some]
    del sym, learned
    keys.sort()
    ones = np.cumsum(keys.astype(np.uint8) & np.uint8(1), dtype=np.int32)
    keys >>= U(1)
    ends = np.append(np.flatnonzero(firsts(keys))[1:] - 1, len(keys) - 1) if len(keys) else np.zeros(0, np.int64)
    keys, ones = keys[ends], ones[ends]  # and the counts up to each
    for order in reversed(ORDERS):  # keys of lower orders are the first symbols of these, so they are sorted
        found.insert(0, (keys, np.diff(ones, prepend=0).astype(np.int64)))
        if order != ORDERS[0]:
            lower = keys >> U(9 * (order - ORDERS[ORDERS.index(order) - 1]))
            ends = np.append(np.flatnonzero(firsts(lower))[1:] - 1, len(keys) - 1) if len(keys) else ends
            keys, ones = lower[ends], ones[ends]
    every, mine, done = [np.zeros(0, U)], [np.zeros(0, U)], 0
    for piece, word, owner in words_of(table):
        every.append(word)
        mine.append(word[flags[done : done + piece.num_rows][owner]])
        done += piece.num_rows
    names, mine = np.sort(np.concatenate(every)), np.sort(np.concatenate(mine))
    names = names[firsts(names)]
    return [*found, (names, np.searchsorted(mine, names, side="right") - np.searchsorted(mine, names))]


def part_of(keys: np.ndarray, place: int, parts: int) -> np.ndarray:
    """All keys of a context are in one part."""
    by = context_of(keys, ORDERS[place]) if place < len(ORDERS) else keys
    return ((mixed(by * U(0x9E3779B97F4A7C15) + U(place)) >> U(16)) % U(parts)).astype(np.int64)


def by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """The places in order of their parts; small numbers are sorted much faster."""
    return np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int32), kind="stable")


def packed(numbers: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(numbers.astype(U).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(U).reshape(-1)


def odds_of(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log((n1 + 0.4) / (n0 + 0.4)) * STEP), -127, 127).astype(np.int8)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size of them) for each."""
    total = np.cumsum(size, dtype=np.int64)
    kind = np.int32 if not len(total) or max(int(total[-1]), int(start.max()) + int(size.max())) < 1 << 31 else np.int64
    out = np.repeat((start - (total - size)).astype(kind), size)
    out += np.arange(len(out), dtype=kind)
    return out


def path_odds(keys: np.ndarray, counts: np.ndarray, trees: Trees, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The odds at each node on the path of each key, all keys of their contexts counted; where a key's odds start, and how many they are."""
    by = np.argsort(context_of(keys, order), kind="stable")
    keys, counts = keys[by], counts[by]
    context = context_of(keys, order)
    out, new = [np.zeros(0, np.int8)], np.flatnonzero(firsts(context))
    cuts = np.unique(np.concatenate((new[np.searchsorted(new, np.arange(0, len(keys), SOME), side="right") - 1], [len(keys)])))
    sizes = [np.zeros(0, np.int64)]
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        ctx = np.cumsum(firsts(context[lo:hi])) - 1
        first, size = path_starts(keys[lo:hi], trees, order)
        path = ragged(first, size)
        spot = np.repeat(ctx * 256, size) + trees.node[path]
        weight, ones = np.repeat(counts[lo:hi], size), trees.bit[path] == 1
        n1, n = np.bincount(spot[ones], weight[ones], int(spot.max()) + 1), np.bincount(spot, weight)
        out.append(odds_of(n - n1, n1)[spot])
        sizes.append(size)
    size = np.concatenate(sizes)
    start = np.empty(len(keys), np.int64)
    start[by] = np.cumsum(size) - size
    back = np.empty(len(keys), np.int64)
    back[by] = size
    return np.concatenate(out), start, back


def small(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def gathered(rows: DataFrame, runs: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """Rows (doc_id, text, learned and what runs needs) in runs of one block: their texts as one compressed value.

    runs says of some rows which of them go to which block.
    """

    def run(batches):
        for piece in pieces(batches, "text", SORTED_BYTES):
            for block, spot in runs(piece):
                some = piece.take(pa.array(spot))
                data, at = text_bytes(some.column("text"))
                yield pa.record_batch(
                    [
                        pa.array([block], pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, len(spot)], pa.int32()), some.column("doc_id")),
                        pa.ListArray.from_arrays(pa.array([0, len(spot)], pa.int32()), some.column("learned")),
                        pa.array([np.diff(at)], pa.list_(pa.int64())),
                        pa.array([small(data.tobytes())], pa.binary()),
                    ],
                    names=["block", "ids", "learned", "sizes", "texts"],
                )

    return rows.mapInArrow(run, f"block int, ids array<{rows.schema['doc_id'].dataType.simpleString()}>, learned array<boolean>, sizes array<long>, texts binary")


def opened(group: pa.Table) -> pa.Table:
    """doc_id, text, learned of gathered rows."""
    sizes = [np.asarray(x.values, np.int64) for x in group.column("sizes")]
    data = b"".join(pa.decompress(raw.as_py(), decompressed_size=int(n.sum()), codec="zstd", asbytes=True) for raw, n in zip(group.column("texts"), sizes, strict=True))
    at = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    text = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))
    flat = {c: pc.list_flatten(group.column(c)) for c in ("ids", "learned")}
    return pa.table([flat["ids"], pa.chunked_array([text]), flat["learned"]], names=["doc_id", "text", "learned"])


def context_odds(placed: DataFrame, trees, parts: int) -> DataFrame:
    """The answers to each block of documents (with doc_id, block, text, learned), see answered()."""

    def runs(piece: pa.RecordBatch):
        block = piece.column("block").to_numpy()
        return ((int(b), np.flatnonzero(block == b)) for b in np.unique(block))

    return answered(gathered(placed, runs), trees, parts)


def answered(placed: DataFrame, trees, parts: int) -> DataFrame:
    """For each block and part: odds (compressed, of n bytes), those at the block's own keys, in the order (part, order, key); words, the counts
    of its own n_words words by their hash. One row of a part has in known and total how many words it counted, and all their counts.

    A block sends each part its distinct keys and their counts; a part adds those of all blocks and answers each.
    """
    kinds = len(ORDERS) + 1

    def send(group: pa.Table) -> pa.Table:
        found = tally(opened(group))
        keys, counts, place = (np.concatenate(x) for x in ([k for k, _ in found], [c for _, c in found], [np.full(len(k), j) for j, (k, _) in enumerate(found)]))
        part = np.concatenate([part_of(k, j, parts) for j, (k, _) in enumerate(found)])
        order = by_part(part, parts)
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        sizes = np.bincount(part * kinds + place, minlength=parts * kinds).reshape(parts, -1)
        rows = np.flatnonzero(np.diff(ends))
        spans = [order[a:b] for a, b in zip(ends[rows].tolist(), ends[rows + 1].tolist(), strict=True)]
        block = group.column("block")[0].as_py() if group.num_rows else 0
        return pa.table(
            [
                pa.array(rows, pa.int32()),
                pa.array(np.full(len(rows), block, np.int32)),
                pa.array(sizes[rows].tolist(), pa.list_(pa.int32())),
                pa.array([packed(np.diff(keys[s], prepend=U(0))) for s in spans], pa.binary()),
                pa.array([packed(counts[s]) for s in spans], pa.binary()),
            ],
            names=["part", "block", "sizes", "keys", "counts"],
        )

    def answer(group: pa.Table) -> pa.Table:
        sizes = np.array(group.column("sizes").to_pylist(), np.int64).reshape(-1, kinds)
        n, ends = sizes.sum(axis=1).tolist(), np.cumsum(sizes, axis=1)
        keys = [np.cumsum(unpacked(raw.as_py(), k), dtype=U) for raw, k in zip(group.column("keys"), n, strict=True)]
        counts = [unpacked(raw.as_py(), k).astype(np.int64) for raw, k in zip(group.column("counts"), n, strict=True)]
        out: list[list[bytes]] = [[] for _ in n]
        for j in range(kinds):
            own = [slice(*(e[j] - s[j], e[j])) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
            every, total = merged(np.concatenate([k[o] for k, o in zip(keys, own, strict=True)]), np.concatenate([c[o] for c, o in zip(counts, own, strict=True)]))
            if j == len(ORDERS):
                words = [packed(total[np.searchsorted(every, k[o])]) for k, o in zip(keys, own, strict=True)]
                break
            odds, start, size = path_odds(every, total, trees.value, ORDERS[j])
            for i, (k, o) in enumerate(zip(keys, own, strict=True)):
                spot = np.searchsorted(every, k[o])
                out[i].append(odds[ragged(start[spot], size[spot])].tobytes())
        once = [1] + [None] * (len(n) - 1)
        columns = [
            pa.array([sum(map(len, o)) for o in out], pa.int64()),
            pa.array([small(b"".join(o)) for o in out], pa.binary()),
            pa.array(sizes[:, -1], pa.int64()),
            pa.array(words, pa.binary()),
            pa.array([x and int((total > 0).sum()) for x in once], pa.int64()),
            pa.array([x and int(total.sum()) for x in once], pa.int64()),
        ]
        return pa.table([group.column("block"), group.column("part"), *columns], names=["block", "part", "n", "odds", "n_words", "words", "known", "total"])

    sent = placed.groupBy("block").applyInArrow(lambda group: lean(send, group), "part int, block int, sizes array<int>, keys binary, counts binary")
    return sent.groupBy("part").applyInArrow(lambda group: lean(answer, group), "block int, part int, n long, odds binary, n_words long, words binary, known long, total long")


class Decisions:
    """The decisions of a block of texts: each one's branch, the odds that each predictor gives it, and where a text's start.

    The longest context and the symbol decide all odds along the symbol's path, so these are laid out once for each such key: those of all
    predictors side by side, as odds for the branch that is taken.
    """

    def __init__(self, column: pa.Array, trees: Trees, first: np.ndarray, answers: pa.Table, parts: int):
        sym, self.at = symbols_of(column)
        keys, top = contexts(sym, self.at), ORDERS[-1]
        for some in stretches(len(sym)):
            keys[some] = keys_of(keys[some], sym[some], top)
        del sym
        own, which = distinct(keys)
        del keys
        by = np.argsort(own)
        every, place = [], []
        for order in ORDERS:
            keys = own[by] >> U(9 * (top - order))
            new = firsts(keys)
            every.append(keys[new])
            place.append(np.empty(len(own), np.int32))
            place[-1][by] = np.cumsum(new, dtype=np.int32) - 1
        size = np.concatenate([path_starts(k, trees, o)[1] for k, o in zip(every, ORDERS, strict=True)])
        by = by_part(np.concatenate([part_of(k, j, parts) for j, k in enumerate(every)]), parts)
        at = np.empty(len(by), np.int64)
        at[by] = np.cumsum(size[by]) - size[by]
        cut = np.cumsum([0, *map(len, every)])
        del every, by
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("part", "n", "odds")), strict=True))
        odds = np.frombuffer(b"".join(pa.decompress(raw, decompressed_size=n, codec="zstd", asbytes=True) for _, n, raw in rows), np.int8)
        del rows
        leaf = np.diff(trees.start)
        by_predecessor = first[np.repeat(np.arange(len(leaf)) // SYMBOLS * 256, leaf) + trees.node]  # at all places of all paths
        path, size = path_starts(own, trees, top)
        start = np.cumsum(size, dtype=np.int64) - size
        total = int(size.sum(dtype=np.int64))
        # the last one stands for no decision: its odds are even whatever the weights
        self.table, self.branch = np.zeros((total + 1, len(ORDERS) + 1), np.int8), np.zeros(total + 1, np.int8)
        for some in (slice(lo, lo + (LAID >> 3)) for lo in range(0, len(own), LAID >> 3)):
            paths, here = ragged(path[some], size[some]), slice(start[some][0], start[some][-1] + size[some][-1])
            self.branch[here] = trees.bit[paths]
            sign = self.branch[here] * np.int8(2) - np.int8(1)
            np.multiply(by_predecessor[paths], sign, out=self.table[here, 0])
            for j, mine in enumerate(place):
                np.multiply(odds[ragged(at[cut[j] + mine[some]], size[some])], sign, out=self.table[here, j + 1])
        kind = np.int32 if total < 1 << 31 else np.int64
        self.spot, self.size = start.astype(kind)[which], size.astype(np.uint8)[which]
        del which
        many = int(self.size.sum(dtype=np.int64))
        self.start = np.zeros(len(self.size) + 1, np.int32 if many < 1 << 31 else np.int64)  # of each symbol's decisions
        np.cumsum(self.size, out=self.start[1:])

    def laid(self, some: np.ndarray | slice) -> np.ndarray:
        """Where all decisions of some symbols are in table and branch."""
        return ragged(self.spot[some], self.size[some])

    def predictors(self) -> Iterator[np.ndarray]:
        """The odds of all decisions, a predictor after another."""
        spot = self.laid(slice(None))
        sign = self.branch[spot] * np.int8(2) - np.int8(1)
        for odds in self.table.T:
            yield odds[spot] * sign


def train(docs: DataFrame) -> tuple[Trees, np.ndarray]:
    """Trees and the odds at their nodes, counted over all rows of docs (doc_id, text): as many as there are pairs of symbols."""
    rows = docs.select("text")

    def count_pairs(batches):
        counts = np.zeros(-(-SYMBOLS * SYMBOLS // PAGE) * PAGE, np.int64)
        for piece in pieces(batches, "text"):
            sym, at = symbols_of(piece.column("text"))
            sym = sym.astype(np.int64)
            code = np.empty(len(sym), np.int64)
            code[1:] = sym[:-1] * SYMBOLS
            code[at[:-1]] = 256 * SYMBOLS
            counts += np.bincount(code + sym, minlength=len(counts))
        yield from pages_out(counts)

    pairs = vector_of(rows.mapInArrow(count_pairs, PAGES_SCHEMA), -(-SYMBOLS * SYMBOLS // PAGE) * PAGE)[: SYMBOLS * SYMBOLS]
    trees = Trees(pairs.reshape(SYMBOLS, SYMBOLS))
    weight = np.repeat(pairs, np.diff(trees.start))
    spot = np.repeat(np.arange(SYMBOLS * SYMBOLS) // SYMBOLS * 256, np.diff(trees.start)) + trees.node
    n1, n = np.bincount(spot, weight * trees.bit, SYMBOLS * 256), np.bincount(spot, weight, SYMBOLS * 256)
    return trees, odds_of(n - n1, n1)


def bits_of(decisions: Decisions) -> np.ndarray:
    """The total of bits that each text takes."""
    ends = decisions.start[decisions.at].astype(np.int64)
    first, size = ends[:-1], np.diff(ends)
    order = np.argsort(-size, kind="stable")  # the longest come first, so those still running lead
    first, size = first[order], size[order]
    n, k = len(first), len(ORDERS) + 1
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    # Two weight sets; the gate, how sure the longest context is, says how much each has to say. Weights are divided by the root of
    # the rate, and what they weigh is multiplied by it, so an error needs no factor.
    root = math.sqrt(RATE)
    weights = np.full((2 * k, n), 1.6 / k / root, np.float32)
    table = np.tile(1 / (1 + np.exp(-(np.arange(CELLS, dtype=np.float32) - CELLS // 2) / 2)), n).astype(np.float32)
    spent = np.zeros(n)
    together = int(np.searchsorted(-live, -FEW, side="right"))  # live falls
    starts = np.concatenate(([0], np.cumsum(live[:together])))
    whole = decisions.table.view(np.uint32).reshape(-1) if k == 4 else decisions.table  # four odds move as one number

    windows = np.unique(np.append(np.searchsorted(starts, np.arange(0, starts[-1], WINDOW)), together))
    lo = np.searchsorted(decisions.start, first.astype(decisions.start.dtype))  # the symbols that the next step is in
    for a, b in pairwise(windows.tolist()):
        m, steps, over = int(live[a]), np.arange(b - a), int(live[b - 1])
        lo, last = lo[:m], first[:m] + np.minimum(size[:m], b)
        hi = np.searchsorted(decisions.start, last.astype(decisions.start.dtype))  # of one type, or all are copied
        laid = decisions.start[hi].astype(np.int64) - decisions.start[lo]
        at = np.cumsum(laid) - laid + first[:m] + a - decisions.start[lo]
        spot = np.append(decisions.laid(ragged(lo, hi - lo)), len(whole) - 1)
        by_step = at + steps[:, None]
        ended = steps[:, None] >= size[over:m] - a
        by_step[:, over:][ended] = len(spot) - 1
        lo = hi - (decisions.start[hi] > last)
        spot = spot[by_step]
        x, bit, w = whole.take(spot, axis=0).view(np.int8).reshape(b - a, m, k), decisions.branch.take(spot), np.ascontiguousarray(weights[:, :m])
        del by_step, spot
        many = max(1, AT_ONCE // m)
        for c in range(0, b - a, many):
            nats = stepped(x[c : c + many], bit[c : c + many], w, table)
            nats[:, over:][ended[c : c + many]] = 0
            spent[:m] += nats.sum(axis=0, dtype=np.float64)
        weights[:, :m] = w
    weights *= np.float32(root)
    for lane in range(int(live[together]) if together < len(live) else 0):
        w, cells = weights[:, lane].tolist(), table[lane * CELLS : (lane + 1) * CELLS].tolist()
        lo, hi = (int(np.searchsorted(decisions.start, decisions.start.dtype.type(first[lane] + t), side="right")) - 1 for t in (together, int(size[lane])))
        spot = decisions.laid(np.arange(lo, hi))[int(first[lane] + together - decisions.start[lo]) :]
        bit = decisions.branch[spot]
        x = decisions.table[spot] * (bit * np.int8(2) - np.int8(1))[:, None]
        spent[lane] += alone([(odds / STEP).tolist() for odds in x.T], bit.tolist(), w, cells)
    out = np.empty(n)
    out[order] = spent / np.log(2)
    return out


def stepped(odds: np.ndarray, bits: np.ndarray, weights: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Nats of decisions (step, lane), those of a step side by side; weights and table move on. Odds are those of the branch taken."""
    steps, m, k = odds.shape
    v = np.empty((steps, 2 * k, m), np.float32)
    for j in range(k):
        np.multiply(odds[:, :, j], np.float32(math.sqrt(RATE) / 2 / STEP), out=v[:, k + j])  # so sums are half the mixed odds
    gate = np.abs(odds[:, :, -1].astype(np.float32))
    gate /= gate + np.float32(STEP)
    np.multiply(v[:, k:], gate[:, None], out=v[:, :k])
    v[:, k:] -= v[:, :k]
    z, p, r = (np.empty((steps, m), np.float32) for _ in range(3))
    low, high, one, keep = (np.array(c, np.float32) for c in (-4, 4, 1, 1 - RATE_TABLE))
    maximum, minimum, tanh, subtract, multiply, add, error, weighed = np.maximum, np.minimum, np.tanh, np.subtract, np.multiply, np.add, np.empty(m, np.float32), np.empty((2 * k, m), np.float32)
    for some, odd, mine in zip(v, z, p, strict=True):
        multiply(weights, some, weighed)
        add.reduce(weighed, 0, None, odd)
        maximum(odd, low, odd)
        minimum(odd, high, odd)
        tanh(odd, mine)
        subtract(one, mine, error)  # twice the error
        multiply(some, error, some)
        add(weights, some, weights)
    sign = bits * np.float32(8) - np.float32(4)
    z *= sign
    cells = np.rint(z, out=z).astype(np.intp)
    cells += np.arange(CELLS // 2, m * CELLS, CELLS)
    step, fresh = bits * np.float32(RATE_TABLE), error
    for cell, mine, hit in zip(cells, r, step, strict=True):
        table.take(cell, out=mine, mode="clip")
        multiply(mine, keep, fresh)
        add(fresh, hit, fresh)
        table[cell] = fresh
    # the chance of the branch taken: (1 + p) / 2 by the mixer, by the table r or 1 - r
    r -= np.float32(0.5)
    sign *= np.float32(0.25)
    r *= sign
    p *= np.float32(0.5)
    r += p
    r += one
    r *= np.float32(0.5)
    return -np.log(r, out=r)


def alone(odds: list[list[float]], bits: list[int], weights: list[float], table: list[float]) -> float:
    """Nats that the decisions of one text take, from the state that it has; the same steps as those taken together."""
    k, spent = len(odds), 0.0
    w1, w2, exp, log = weights[:k], weights[k:], math.exp, math.log
    for hit, *v in zip(bits, *odds, strict=True):
        gate = abs(v[-1])
        gate /= gate + 1
        other = 1 - gate
        z = max(-8.0, min(8.0, gate * sum(map(mul, w1, v)) + other * sum(map(mul, w2, v))))
        p = 1 / (1 + exp(-z))
        step = (hit - p) * RATE
        w1 = [w + step * gate * a for w, a in zip(w1, v, strict=True)]
        w2 = [w + step * other * a for w, a in zip(w2, v, strict=True)]
        cell = round(z * 2) + CELLS // 2
        refined = table[cell]
        table[cell] = refined + (hit - refined) * RATE_TABLE
        spent -= log(abs(1 - hit - (p + refined) * 0.5))
    return spent


def dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows, gathered in blocks, and how many bytes there are. A block's texts are of about the same length and make BLOCK_BYTES.

    What goes to a block together are some texts that a task met one after another; which block they go to is drawn by their place.
    """
    size = F.octet_length("text")
    kind = F.floor(2 * F.log2(size + 1)).cast("int")
    found = rows.groupBy(kind.alias("kind")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).collect()  # two for each power of two
    sizes, state = {r.kind: r.bytes for r in found}, {r.kind: STATE_BYTES * r.n for r in found}
    first, many, total = {}, {}, 0
    for c in sorted(sizes):
        first[c], many[c] = total, max(1, -(-(sizes[c] + state[c]) // BLOCK_BYTES))
        total += many[c]
    run_bytes = min(RUN_BYTES, max(1, BLOCK_BYTES // 16))
    seen: dict[int, int] = {}

    def runs(piece: pa.RecordBatch):
        kinds, size = piece.column("kind").to_numpy(), np.diff(text_bytes(piece.column("text"))[1])
        for c in np.unique(kinds).tolist():
            spot = np.flatnonzero(kinds == c)
            ends = np.cumsum(size[spot])
            lo = 0
            while lo < len(spot):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + run_bytes, side="right")))
                task = TaskContext.get().partitionId()
                seen[task] = seen.get(task, 0) + 1
                yield first[c] + zlib.crc32(b"%d %d" % (task, seen[task])) % many[c], spot[lo:hi]
                lo = hi

    return gathered(rows.withColumn("kind", kind), runs), sum(sizes.values())


def score(docs: DataFrame, learn_from: Column) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, learned, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    work = Work(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), learn_from.alias("learned"))
    trees, first = train(rows.filter("learned"))
    shared, shared_trees = spark.sparkContext.broadcast(first), spark.sparkContext.broadcast(trees)  # as many as there are pairs of symbols
    kind = rows.schema["doc_id"].dataType.simpleString()
    placed, size = dealt(rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        whole = opened(left)
        bits = bits_of(Decisions(whole.column("text").combine_chunks(), shared_trees.value, shared.value, right, parts))
        answers = sorted(zip(*(right.column(c).to_pylist() for c in ("part", "n_words", "words")), strict=True))
        counts = np.concatenate([unpacked(raw, n).astype(np.int64) for _, n, raw in answers])
        found = list(words_of(whole))
        name = np.sort(np.concatenate([word for _, word, _ in found]))
        name = name[firsts(name)]
        c = np.empty(len(name), np.int64)
        c[by_part(part_of(name, len(ORDERS), parts), parts)] = counts
        logs = np.log10(c + 0.1)
        out, done = [], 0
        for piece, word, owner in found:
            spot = np.searchsorted(name, word)
            n = piece.num_rows
            done += n
            out.append(
                pa.table(
                    [
                        piece.column("doc_id"),
                        piece.column("learned"),
                        pa.array(np.bincount(owner, minlength=n)),
                        pa.array(np.bincount(owner, c[spot] > 0, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(owner, logs[spot], minlength=n)),
                        pa.array(bits[done - n : done]),
                        pa.array(np.diff(text_bytes(piece.column("text"))[1])),
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.int64()),
                    ],
                    names=names,
                )
            )
        # what parts counted, as far as their answers to this block say so: the number of known words, and of training words
        zeros = [pa.nulls(1, c.type) for c in out[0].columns[:7]]
        out.append(pa.table([*zeros, *(pa.array([pc.sum(right.column(c)).as_py() or 0], pa.int64()) for c in ("known", "total"))], names=names))
        return pa.concat_tables(out)

    names = ["doc_id", "learned", "n_tokens", "n_known", "logs", "bits", "n_bytes", "words", "train_tokens"]
    scored = placed.groupBy("block").cogroup(answered(placed, shared_trees, parts).groupBy("block")).applyInArrow(
        lambda left, right: lean(finish, left, right), f"doc_id {kind}, learned boolean, n_tokens long, n_known long, logs double, bits double, n_bytes long, words long, train_tokens long"
    )
    scored = work.save("scored", scored)
    totals = scored.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("v"), F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("n"))
    out = scored.filter("learned is not null").drop("words", "train_tokens").crossJoin(F.broadcast(totals))  # one row
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.col("n") + 0.1 * (F.col("v") + 1))
    return out.select("doc_id", "learned", "n_tokens", "n_known", F.col("n").alias("train_tokens"), base.alias("base_score"), (-F.col("bits") * float(np.log10(2))).alias("score"), "n_bytes", (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def op2_context_mixing(spark, sf_dir):
    """Scores of all documents under models of nine tenths of them."""
    docs = texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = score(docs, crc_mod(F.col("doc_id"), 10) != 0)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
