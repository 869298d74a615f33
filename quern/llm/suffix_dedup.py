"""Suffix-array dedup by prefix-free parsing: every byte goes that a string of 200 bytes covers which starts anywhere else too.

Rolling-hash triggers cut each text into phrases: a 16-byte gram is a trigger where its hash is the least of a window of 136
gram starts (the first of equal ones), so that equal strings are cut alike and no phrase is longer than the window. A
string of 200 bytes has its first window's trigger inside; it starts s < 136 bytes before it, and the first 64 bytes
after it belong to the string. All starts with one trigger make one context: the end of a phrase, and what the parse has
from the trigger on.

Contexts are grouped by the 64 bytes after the trigger, the only ones where equal strings can be. A group with one
occurrence has nothing repeated; a group of equal contexts repeats as a whole. For all others the dictionary (the ends
of phrases, sorted from the trigger backwards) and the parse (what follows, sorted) have suffix arrays with common prefix
lengths; for each s, equal classes of both are neighbours in corpus order, and classes with two occurrences or more are
repeated. A group with more different contexts than a task should hold is divided: strings that start in one half of the
range of s have more bytes in common, so each half is a group of its own by those bytes, and is divided again where it must
be. At a single s the bytes are the string itself. Counts of groups are pre-aggregated, so no group meets in one task.

Strings are judged on the input and never cross documents. Defined cases: a null text is an empty one; texts of fewer than
200 bytes have nothing to lose; rows that repeat an id are documents of their own, also where the text is the same (then
both lose it). Any type of id does, also null. Columns other than the id and the text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Work, pieces, text_bytes
from quern.llm.jaccard import U, mixed

SPAN = 200
GRAM = 16
WINDOW = 136
NEAR = SPAN - WINDOW
#: Different contexts of a group that one task holds at most (about 500 bytes each); a larger group is divided.
MOST = 1 << 15
#: Contexts that are sorted together, about.
CHUNK = 16384
_BYTE = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_PLACE = U((1 << 31) - 1)


def triggers(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per context: its trigger, and the first and last start of a string that has it; texts lie in data, cut at `at`."""
    starts = np.zeros(len(data) + 1, np.int8)
    long = np.flatnonzero(np.diff(at) >= SPAN)
    starts[at[long]] = 1
    starts[at[long + 1] - SPAN + 1] -= 1
    start = np.flatnonzero(np.cumsum(starts[:-1]))
    if not len(start):
        return start, start, start
    h, k = _BYTE[data], 1
    while k < GRAM:
        h = h[:-k] * U(pow(_BASE, k, 1 << 64)) + h[k:]
        k *= 2
    key = (mixed(h) & ~_PLACE) | np.arange(len(h), dtype=U)
    k = 1
    while 2 * k <= WINDOW:
        key = np.minimum(key[:-k], key[k:])
        k *= 2
    if k < WINDOW:
        key = np.minimum(key[: k - WINDOW], key[WINDOW - k :])
    trigger = (key[start] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.diff(trigger, prepend=-1))
    last = np.append(start[new[1:] - 1], start[-1])
    return trigger[new], start[new], last


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    row = F.struct(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.select(F.xxhash64(F.col(id_col)).alias("k1"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k2"), row.alias("row"))


def _contexts(keyed: DataFrame) -> DataFrame:
    """k1, k2, spot (the trigger's place, how far before it strings start, most and least), g and c, hashes of group and context."""
    rows = keyed.select("k1", "k2", F.col("row.text").alias("text")).filter(F.octet_length("text") >= SPAN)

    def run(batches):
        for piece in pieces(batches, "text", 1 << 20):
            data, at = text_bytes(piece.column("text"))
            trigger, first, last = triggers(data, at)
            raw, near, whole = data.tobytes(), xxhash.xxh3_64_intdigest, xxhash.xxh3_64_intdigest
            t, f, e = trigger.tolist(), first.tolist(), (last + SPAN).tolist()
            g = np.fromiter((near(raw[a : a + NEAR]) for a in t), U, len(t))
            c = np.fromiter((whole(raw[b:z], a - b) for a, b, z in zip(t, f, e, strict=True)), U, len(t))
            doc = np.searchsorted(at, trigger, side="right") - 1
            spot = (trigger - at[doc]) << 16 | (trigger - first) << 8 | (trigger - last)
            keys = [piece.column(k).take(pa.array(doc)) for k in ("k1", "k2")]
            yield pa.record_batch([*keys, pa.array(spot), pa.array(g.view(np.int64)), pa.array(c.view(np.int64))], names=["k1", "k2", "spot", "g", "c"])

    return rows.mapInArrow(run, "k1 long, k2 long, spot long, g long, c long")


def _most(spot: Column) -> Column:
    return F.shiftright(spot, 8).bitwiseAND(255).cast("int")


def _least(spot: Column) -> Column:
    return spot.bitwiseAND(255).cast("int")


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of all lists, and the row of each; null lists have none."""
    return column.flatten(), np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0), np.int64))


_PHRASES = "g long, c long, n long, least int, most int, left binary, right binary"


def _cut(batches):
    """The bytes of the contexts that a document is to show."""
    for batch in batches:
        rows = pa.record_batch([batch.column("row").field("text"), batch.column("wants")], names=["text", "wants"])
        for piece in pieces([rows], "text"):
            data, at = text_bytes(piece.column("text"))
            wants, doc = _lists(piece.column("wants"))
            raw, spot = data.tobytes(), np.asarray(wants.field("spot"), np.int64)
            most, least = spot >> 8 & 255, spot & 255
            t = (at[doc] + (spot >> 16)).tolist()
            left = [raw[a - m : a] for a, m in zip(t, most.tolist(), strict=True)]
            right = [raw[a : a + SPAN - k] for a, k in zip(t, least.tolist(), strict=True)]
            cols = [wants.field(k) for k in ("g", "c", "n")]
            yield pa.record_batch([*cols, pa.array(least.astype(np.int32)), pa.array(most.astype(np.int32)), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["g", "c", "n", "least", "most", "left", "right"])


def _sorted_classes(group: np.ndarray, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each text in the order of (group, text), and the common prefix length of neighbours in that order."""
    body = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(-1, width)
    table = np.concatenate((group.astype(">i8").view(np.uint8).reshape(-1, 8), body), axis=1)
    table = np.ascontiguousarray(table)
    order = np.argsort(table.view(f"S{width + 8}").ravel(), kind="stable")
    table = table[order]
    apart = table[1:] != table[:-1]
    common = np.where(apart.any(axis=1), apart.argmax(axis=1), width + 8)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, common


def repeated_starts(group: np.ndarray, times: np.ndarray, least: np.ndarray, most: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For each context and each s whether the string that starts s bytes before the trigger occurs twice or more."""
    back, back_common = _sorted_classes(group, [x[::-1] for x in left], WINDOW)
    ahead, ahead_common = _sorted_classes(group, right, SPAN)
    out = np.zeros((len(group), WINDOW), bool)
    cls = lambda common, depth: np.concatenate(([0], np.cumsum(common < depth + 8)))
    for s in range(WINDOW):
        live = np.flatnonzero((least <= s) & (s <= most))
        code = cls(back_common, s)[back[live]] * len(group) + cls(ahead_common, SPAN - s)[ahead[live]]
        _, which = np.unique(code, return_inverse=True)
        out[live, s] = np.bincount(which, times[live])[which] >= 2 if len(live) else False
    return out


_RANGES = "g long, c long, ranges array<struct<f: int, t: int>>"


def _combine(batches):
    """Contexts, sorted by group p, to ranges of repeated starts; a group's contexts are in one chunk."""

    def ended(t: pa.Table) -> pa.RecordBatch:
        col = {k: t.column(k).combine_chunks() for k in t.column_names}
        num = {k: np.asarray(col[k], np.int64) for k in ("p", "n", "least", "most")}
        mask = repeated_starts(num["p"], num["n"], num["least"], num["most"], col["left"].to_pylist(), col["right"].to_pylist())
        edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, f = np.nonzero(edge == 1)
        _, to = np.nonzero(edge == -1)
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(mask)))))
        items = pa.StructArray.from_arrays([pa.array(f.astype(np.int32)), pa.array((to - 1).astype(np.int32))], names=["f", "t"])
        return pa.record_batch([col["g"], col["c"], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items)], names=["g", "c", "ranges"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            t = pa.Table.from_batches(held)
            p = np.asarray(t.column("p").combine_chunks(), np.int64)
            cut = int(np.searchsorted(p, p[-1]))  # the last group may go on
            if cut:
                yield ended(t.slice(0, cut))
            held = t.slice(cut).to_batches()
    if sum(b.num_rows for b in held):
        yield ended(pa.Table.from_batches(held))


def _divided(large: DataFrame) -> DataFrame:
    """Groups of starts lo to hi as groups of either half, by the bytes that all strings of a half have in common."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("hi").alias("b")))
    rows = large.withColumn("half", F.explode(halves)).withColumn("lo", F.col("half.a")).withColumn("hi", F.col("half.b"))
    rows = rows.withColumn("least", F.greatest("least", "lo")).withColumn("most", F.least("most", "hi")).filter("least <= most")
    before = F.substring("left", F.octet_length("left") - F.col("lo") + 1, F.col("lo"))
    after = F.substring("right", F.lit(1), F.lit(SPAN) - F.col("hi"))
    return rows.withColumn("p", F.xxhash64("p", "lo", before, after)).drop("half")


def _verdicts(shown: DataFrame, work: Work) -> DataFrame:
    """g, c, ranges: the repeated starts of every context."""
    parts = int(shown.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level, found = 0, []
    rest = shown.withColumn("p", F.col("g")).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(WINDOW - 1))
    while True:
        sizes = rest.groupBy(F.col("p").alias("q")).agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("times"))
        sizes = work.save(f"sizes{level}", sizes.filter("times > 1"))
        told = rest.join(sizes, F.col("p") == F.col("q")).drop("q", "times")
        told = told if level == 0 else work.save(f"told{level}", told)
        one = F.col("lo") == F.col("hi")
        if level:
            found.append(told.filter(one).select("g", "c", F.array(F.struct(F.col("lo").alias("f"), F.col("hi").alias("t"))).alias("ranges")))
        small = told.filter(~one & (F.col("contexts") <= MOST)).drop("contexts", "lo", "hi")
        found.append(small.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_combine, _RANGES))
        large = told.filter(~one & (F.col("contexts") > MOST)).drop("contexts")
        if sizes.filter(F.col("contexts") > MOST).isEmpty() or large.isEmpty():
            break
        level += 1
        rest = work.save(f"divided{level}", _divided(large))
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    every = every.filter(F.size("ranges") > 0)
    return every if level == 0 else every.groupBy("g", "c").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _finish(batches):
    for batch in batches:
        rows = pa.record_batch([batch.column("row").field("id"), batch.column("row").field("text"), batch.column("runs")], names=["id", "text", "runs"])
        for piece in pieces([rows], "text"):
            data, at = text_bytes(piece.column("text"))
            runs, doc = _lists(piece.column("runs"))
            # One more place for each text, so that runs of neighbours stay apart.
            at1 = at + np.arange(len(at))
            change = np.zeros(at1[-1] + 1, np.int64)
            np.add.at(change, at1[doc] + np.asarray(runs.field("a"), np.int64), 1)
            np.add.at(change, at1[doc] + np.asarray(runs.field("b"), np.int64), -1)
            gone = np.cumsum(change)[: at1[-1]] > 0
            begins = np.diff(gone.astype(np.int8), prepend=0) == 1
            total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at1])
            ends_at = at1[1:] - 1
            inside = np.ones(at1[-1], bool)
            inside[ends_at] = False
            kept = ~gone[inside]
            left = data[kept].tobytes()
            cut = np.concatenate(([0], np.cumsum(kept)))[at].tolist()
            yield pa.record_batch(
                [piece.column("id"), pa.array(np.diff(at)), pa.array(total(gone)), pa.array(total(begins)), pa.array([left[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_bytes, n_removed, n_spans and kept, the bytes that stay."""
    work = Work(docs.sparkSession)
    keyed = _keys(docs, id_col, text_col)
    contexts = _contexts(keyed)
    again = contexts.groupBy(F.col("g").alias("r")).agg(F.count(F.lit(1)).alias("r_n"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("r_n > 1")
    again = work.save("groups", again.select("r", (F.col("lo") != F.col("hi")).alias("differ")))
    hits = work.save("hits", contexts.join(again, F.col("g") == F.col("r")).drop("r"))
    work.drop("groups")
    key = ["k1", "k2"]
    mixed_hits = hits.filter("differ")
    each = mixed_hits.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*key, "spot")).alias("rep"))
    wants = each.groupBy(*(F.col(f"rep.{k}").alias(k) for k in key)).agg(F.collect_list(F.struct("g", "c", "n", F.col("rep.spot").alias("spot"))).alias("wants"))
    # The text table is shuffled once: both joins below read the same exchange.
    shown = keyed.join(wants, key, "left").filter("wants is not null").select("row", "wants").mapInArrow(_cut, _PHRASES)
    verdict = work.save("verdict", _verdicts(work.save("phrases", shown), work))
    work.drop("phrases")
    # Each occurrence has its runs of bytes, at most a few; they stay together until its document has them all.
    place = F.shiftright("spot", 16).cast("int")
    run = lambda f, t: F.struct((place - t).alias("a"), (place - f + SPAN).alias("b"))
    found = mixed_hits.join(verdict.toDF("v_g", "v_c", "ranges"), F.expr("g = v_g and c = v_c")).select(*key, F.transform("ranges", lambda r: run(r["f"], r["t"])).alias("runs"))
    found = found.unionByName(hits.filter("not differ").select(*key, F.array(run(_least(F.col("spot")), _most(F.col("spot")))).alias("runs")))
    runs = found.groupBy(*key).agg(F.flatten(F.collect_set("runs")).alias("runs"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = keyed.join(runs, key, "left").select("row", "runs").mapInArrow(_finish, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def op6_suffix_dedup(spark, sf_dir):
    """Per document: its bytes, how many go in how many runs, and the sha256 of what is left."""
    found = dedup_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
