"""Periodic runs of words: stretches that repeat a period, found by refining classes of positions that begin equal factors.

Positions of a text are classed by the factor of `length` words that begins there, and length grows by one. A position moves
to another class where its next position did: of the parts of a class that split, the largest needs no look, since what
precedes it stays where the others left it (smaller-half strategy), so all lengths together cost n log n moves. Each class
keeps its positions linked in order; neighbours exactly `length` apart begin a square of that period, and neighbouring
squares of a period merge into a run, which by construction has no smaller period and can't be extended.

Only runs of exponent LEAST_EXPONENT (4) or more are reported. Up to the period's length, each position of such a run shares
its class with two others at least, and all of them stand in a row of more than three times that length. So classes of
fewer than three positions are let go, and from time to time short rows, and with them nearly all of an ordinary text. What
is let go could only have shortened runs of lower exponents.

The work is done by task, on pieces of a few megabytes (a longer text alone): memory is a multiple of the longest text. The
first lengths, at which most positions move, refine all that is left by one sort each. Every length costs some numpy calls
for all texts of a piece together, and there are at most a third as many lengths as words in the longest repetition.

Defined cases: null and empty texts have no words and no runs, and collapse to an empty text. Words are compared as bytes.
Repeated rows are done each on its own. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, pieces, text_bytes
from quern.llm.quality import words_of

LEAST_EXPONENT = 4
LEAST_WORDS = 6
#: Lengths that refine all positions at once, before lists of classes are kept.
AT_ONCE = 8
PIECE_BYTES = 4 << 20
#: So few positions are unlinked one by one.
FEW = 48

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _rows(at: np.ndarray, least: int) -> np.ndarray:
    """Which of the sorted positions stand in a row of at least so many."""
    start = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    long = np.diff(start, append=len(at))
    return np.repeat(long >= least, long)


def squares(symbols: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(period, sorted positions at which a square of that period begins), for periods in ascending order.

    symbols: numbers from 0, equal for equal words of a text and for no words of different texts; texts one after another,
    each followed by -1. Squares that belong to no run of exponent LEAST_EXPONENT may be left out.
    """
    found: list[tuple[int, np.ndarray]] = []
    cls = symbols.astype(np.int64)
    at = np.flatnonzero(cls >= 0)
    members = LEAST_EXPONENT - 1
    for length in range(1, AT_ONCE):
        size = np.bincount(cls[at])
        at = at[size[cls[at]] >= members]
        at = at[_rows(at, members * length + 1)]
        if not len(at):
            return found
        order = at[np.argsort(cls[at], kind="stable")]
        hit = order[:-1][(np.diff(order) == length) & (np.diff(cls[order]) == 0)]
        if len(hit):
            found.append((length, np.sort(hit)))
        live = np.full(len(cls), -1, np.int64)
        live[at] = cls[at]
        at = at[live[at + 1] >= 0]
        both = live[at] * (int(live.max()) + 1) + live[at + 1]
        cls = np.full(len(cls), -1, np.int64)
        cls[at] = np.unique(both, return_inverse=True)[1]
    size = np.bincount(cls[at], minlength=1)
    at = at[size[cls[at]] >= members]
    return found + _refine(cls, at[_rows(at, members * AT_ONCE + 1)], AT_ONCE) if len(at) else found


def _refine(cls: np.ndarray, at: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Squares of all periods from `length` on. cls: the class of each position by factors of that length; at: those that count, sorted."""
    found: list[tuple[int, np.ndarray]] = []
    members = LEAST_EXPONENT - 1
    keep = np.full(len(cls), -1, np.int64)
    keep[at] = np.unique(cls[at], return_inverse=True)[1]
    cls, top = keep, int(keep.max(initial=-1)) + 1
    size = np.bincount(cls[at], minlength=1)
    order = at[np.argsort(cls[at], kind="stable")]
    lists = dict(enumerate(np.split(order, np.cumsum(size)[:-1])))
    nxt, prv = np.full(len(cls), -1, np.int64), np.full(len(cls), -1, np.int64)
    same = np.diff(cls[order]) == 0
    nxt[order[:-1][same]], prv[order[1:][same]] = order[1:][same], order[:-1][same]
    waiting: dict[int, list[np.ndarray]] = {}

    def wait(places: np.ndarray) -> None:
        """Neighbours that may begin a square later, by their distance."""
        gap = nxt[places] - places
        some = (nxt[places] >= 0) & (gap >= length)
        by = np.argsort(gap[some], kind="stable")
        places, gap = places[some][by], gap[some][by]
        cut = np.flatnonzero(np.diff(gap)) + 1
        if len(gap):
            for k, part in zip(gap[np.append(0, cut)].tolist(), np.split(places, cut), strict=True):
                waiting.setdefault(k, []).append(part)

    wait(at)
    moved, dead, alive, look = at, np.setdiff1d(at + 1, at), len(at), length * 5 // 4
    while alive:
        if length in waiting:
            hit = np.unique(np.concatenate(waiting.pop(length)))
            hit = hit[(cls[hit] >= 0) & (nxt[hit] - hit == length)]
            if len(hit):
                found.append((length, hit))
        # What stands before the dead dies; what stands before the moved is told apart by the class of the moved.
        length += 1
        gone = dead - 1
        gone = gone[cls[gone] >= 0]
        if length >= look:
            look = length * 5 // 4
            at = at[cls[at] >= 0]
            # Neighbours half a length apart or less lie in one stretch of a shorter period, so two of the wider gaps are needed.
            wide = np.bincount(cls[at[(nxt[at] >= 0) & (2 * (nxt[at] - at) > length)]], minlength=top)
            gone = np.union1d(gone, at[~_rows(at, members * length + 1) | (wide[cls[at]] < members - 1)])
        then = cls[moved]
        cls[gone], was_gone = -1, cls[gone]
        i = moved - 1
        i, then = i[cls[i] >= 0], then[cls[i] >= 0]
        if not len(i) and len(gone) <= FEW:
            # The common case late in a text: the last position of each repetition dies.
            parts, wider = [gone], []
            for x, k in zip(gone.tolist(), was_gone.tolist(), strict=True):
                l, r = int(prv[x]), int(nxt[x])
                if l >= 0:
                    nxt[l] = r
                    wider.append(l)
                if r >= 0:
                    prv[r] = l
                size[k] -= 1
                if size[k] < members and k in lists:
                    rest = lists.pop(k)
                    rest = rest[cls[rest] == k]
                    cls[rest] = -1
                    parts.append(rest)
            moved, dead = i, parts[0] if len(parts) == 1 else np.concatenate(parts)
            alive -= len(dead)
            for x in wider:
                if nxt[x] - x >= length:
                    waiting.setdefault(int(nxt[x]) - x, []).append(np.array([x]))
            continue
        order = np.lexsort((i, then, cls[i]))
        i, then = i[order], then[order]
        own = cls[i]
        begins = (np.diff(own, prepend=-1) != 0) | (np.diff(then, prepend=-1) != 0)
        start = np.flatnonzero(begins)
        count = np.diff(start, append=len(i))
        # All of these leave their lists; stretches of neighbours that leave are bridged at once.
        leaving, was = np.concatenate((gone, i)), np.concatenate((was_gone, own))
        order = np.lexsort((leaving, was))
        leaving, was = leaving[order], was[order]
        head = np.flatnonzero(np.append(-2, nxt[leaving[:-1]]) != leaving)
        left, right = prv[leaving[head]], nxt[leaving[np.append(head[1:], len(leaving)) - 1]] if len(head) else prv[:0]
        nxt[left[left >= 0]] = right[left >= 0]
        prv[right[right >= 0]] = left[right >= 0]
        touched, n_left = np.unique(was, return_counts=True)
        size[touched] -= n_left
        # The others form classes of their own, or die where they are too few.
        few = count < members
        ids = np.full(len(count), -1, np.int64)
        ids[~few] = np.arange(top, top + np.count_nonzero(~few))
        top += np.count_nonzero(~few)
        if top > len(size):
            size = np.concatenate((size, np.zeros(max(top, len(size)), np.int64)))
        size[ids[~few]] = count[~few]
        cls[i] = np.repeat(ids, count)
        nxt[i], prv[i] = -1, -1
        link = ~begins[1:]
        nxt[i[:-1][link]], prv[i[1:][link]] = i[1:][link], i[:-1][link]
        for k, lo, n in zip(ids[~few].tolist(), start[~few].tolist(), count[~few].tolist(), strict=True):
            lists[k] = i[lo : lo + n]
        # Of what a class split into, the largest part needs no look: the rest, or else one of the others.
        slot = np.searchsorted(touched, own[start])
        most = np.zeros(len(touched), np.int64)
        np.maximum.at(most, slot, count)
        rest_most = size[touched] >= most
        first = np.full(len(touched), -1)
        largest = np.flatnonzero(count == most[slot])[::-1]
        first[slot[largest]] = largest
        looked = ~few
        looked[first[~rest_most]] = False
        more, gone_too = [i[np.repeat(looked, count)]], [gone, i[np.repeat(few, count)]]
        for k in touched[(~rest_most & (size[touched] > 0)) | (size[touched] < members)].tolist():
            rest = lists.pop(k)
            rest = rest[cls[rest] == k]
            if len(rest) < members:
                cls[rest] = -1
                gone_too.append(rest)
            else:
                lists[k] = rest
                more.append(rest)
        moved, dead = np.concatenate(more), np.concatenate(gone_too)
        alive -= len(dead)
        wait(np.concatenate((left[left >= 0], i)))
    return found


def runs_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs that count, by start and period. symbols: see `squares`."""
    out = [np.zeros((0, 3), np.int64)]
    for period, places in squares(symbols):
        start = np.flatnonzero(np.diff(places, prepend=-2) != 1)
        end = np.append(start[1:], len(places)) - 1
        length = places[end[: len(start)]] - places[start] + 2 * period
        some = length >= max(LEAST_WORDS, LEAST_EXPONENT * period)
        out.append(np.stack((places[start][some], length[some], np.full(np.count_nonzero(some), period)), axis=1))
    runs = np.concatenate(out)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _parts(texts: pa.Array):
    """The bytes of all texts, each with a space after it; where each begins; where each word begins and ends; the text of each word."""
    data, at = text_bytes(pc.binary_join_element_wise(pc.fill_null(texts, ""), pa.scalar("", texts.type), pa.scalar(" ", texts.type)))
    word = ~_SPACE[data]
    turn = np.diff(word.astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    return data, at, begin, end, np.searchsorted(at, begin, side="right") - 1


def found_in(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each text: its number of words, its runs, and what is left when each run keeps its first period only."""
    data, at, begin, end, owner = _parts(texts)
    n = len(texts)
    offsets = np.concatenate(([0], np.cumsum(end - begin)))
    letters = data[np.repeat(begin - offsets[:-1], end - begin) + np.arange(offsets[-1])]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Numbers for (text, word), and a -1 after each text; word k stands at k + its text.
    symbols = np.full(len(ids) + n, -1, np.int64)
    symbols[np.arange(len(ids)) + owner] = np.unique(owner * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)[1]
    start, length, period = runs_of(symbols)
    n_words = np.bincount(owner, minlength=n)
    base = np.concatenate(([0], np.cumsum(n_words)[:-1])) + np.arange(n)
    text = np.searchsorted(base, start, side="right") - 1
    at_list = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n))))
    runs = pa.StructArray.from_arrays([pa.array(start - base[text]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    # Words within a run after its first period go, each with the space after it; all other spaces go too.
    change = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    stays = (np.cumsum(change)[np.arange(len(ids)) + owner] == 0) if len(start) else np.ones(len(ids), bool)
    flag = np.zeros(len(data) + 1, np.int8)
    flag[begin[stays]] = 1
    flag[end[stays] + 1] -= 1
    kept = np.cumsum(flag[:-1], dtype=np.int8).astype(bool)
    data = data.copy()
    data[end] = 0x20
    # The last space of a text goes as well.
    last = np.flatnonzero(stays)
    last = last[np.diff(owner[last], append=n) != 0]
    kept[end[last]] = False
    sizes = np.concatenate(([0], np.cumsum(kept)))[at]
    collapsed = pa.LargeStringArray.from_buffers(n, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[kept])))
    return pa.array(n_words.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at_list, pa.int32()), runs), collapsed


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame, text: Column | None = None, row: Column | None = None) -> DataFrame:
    """Columns `row` (a struct of all columns, or what `row` says), n_words, runs (by start, then period) and collapsed. text: by default the column of that name."""
    rows = docs.select((F.struct("*") if row is None else row).alias("row"), (F.col("text") if text is None else text).alias("text"))

    def run(batches):
        for piece in pieces(batches, "text", PIECE_BYTES):
            n_words, runs, collapsed = found_in(piece.column("text"))
            yield pa.record_batch([piece.column("row"), n_words, runs, collapsed.cast(pa.string())], names=["row", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string")


def made_periodic(doc_id: Column, words: Column) -> Column:
    """The words, of every tenth document by the crc32 of its id with a part made periodic."""
    h, n = F.crc32(doc_id.cast("string").cast("binary")), F.when(F.size(words) > 0, F.size(words).cast("long"))
    g = F.floor(h / 10).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    loop = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & n.isNotNull(), loop)


def op13_periodic_runs(spark, sf_dir):
    """Every document's runs, some documents made periodic first, and the text that is left without repetitions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Only what changes is split into words here.
    tenth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    docs = docs.select("doc_id", "text", F.when(tenth, words_of(F.col("text"))).alias("words"))
    changed = F.array_join(made_periodic(F.col("doc_id"), F.col("words")), " ")
    found = find_runs(docs, F.coalesce(changed, F.col("text")), F.struct("doc_id"))
    # The longest run; of equal ones that which begins first, then that of the shorter period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
