"""N-gram Jaccard join: documents whose sets of word shingles are alike, linked and put into classes.

Rare-first prefix filtering. How many different sets hold a shingle orders shingles from rare to frequent: exact counts
(of the first 48 bits of a shingle's hash), so that what counts as rare doesn't change with the size of the corpus. Blocks
of documents send their distinct shingles to parts of the hash range, which add up and send the counts back; nothing is
broadcast. Two sets of the wanted similarity must share one of the first few shingles of both (the prefix); shingles that
one set holds alone can't be shared and leave no row. Documents with equal sets are one candidate. Candidates that share a
prefix shingle pass a length, a positional and a suffix filter; the last is a lower bound of the difference of two sets
from a bitmap of parities. What passes is verified once per pair, on the texts.

So that a group of near copies doesn't meet as all its pairs, verification goes from few pairs to all that are left, and
what is linked is contracted to a class after each step. First each document meets one hub: of its rarest shared shingle,
the document with the fewest rare shingles before it (an original has fewer of its own than its copies). Then classes that
share a prefix shingle meet through one document each, as long as that links any. At last all pairs of documents in
different classes that share a prefix shingle and pass the filters are compared; pairs inside a class need no look, as
they can't change it. So no link between different classes is lost.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; shingles are hashed to 64 bits. Defined cases: texts that are null,
empty or without words have no shingles and link with nothing; texts of fewer words than a shingle have one, the whole
sequence; rows that share an id are linked through it; rows with a null id get a null component. Columns other than the
id and the text aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Work, lean, pieces, text_bytes
from quern.llm.components import components

BITS = 1024
#: Shingles of a block of documents, about; the counts come from as many parts as there are blocks.
BLOCK_SHINGLES = 1_500_000
#: Rounds in which classes meet through one document each; all that is left meets after them.
STEPS = 3
#: Ids are broadcast up to so many (8 bytes each), and shuffled beyond.
BROADCAST_IDS = 300_000
#: Bytes from which a word is hashed on its own.
LONG_WORD = 128

U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_BACK = pow(_MULT, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_BYTE = mixed(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, m in enumerate((_MULT, _BACK)):
                _powers[k] = np.concatenate((np.ones(1, U), np.cumprod(np.full(n + (n >> 2), m, U), dtype=U)))
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words, and the text of each."""
    filled = pc.fill_null(texts, "")
    data, at = text_bytes(pc.binary_join_element_wise(filled, pa.scalar("", filled.type), pa.scalar(" ", filled.type)))
    data = _LOWER[data]
    word = ~_WHITE[data]
    edge = np.diff(word.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(data))
    total = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[data] * up, dtype=U)))
    found = mixed((total[end] - total[start]) * down[start])
    # Sums of powers modulo 2^64 are equal for some long words by their make-up alone, so these get another hash.
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        found[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
    return found, np.searchsorted(at, start, side="right") - 1


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, one text after another, and where each text's start."""
    words, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    first = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
    m = max(len(words) - n + 1, 0)
    salts = mixed(np.arange(1, n + 1, dtype=U)) | U(1)
    value = np.zeros(m, U)
    for k in range(n):
        value += words[k : k + m] * salts[k]
    inside = owner[:m] == owner[n - 1 : n - 1 + m] if m else np.zeros(0, bool)
    value, who = mixed(value[inside]), owner[:m][inside]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.array([sum(int(w) * int(salts[k]) for k, w in enumerate(words[first[d] : first[d] + count[d]])) + int(count[d]) * 0x1B873593CC9E2D51 & (1 << 64) - 1 for d in short], U)
        value, who = np.concatenate((value, mixed(whole))), np.concatenate((who, short))
        order = np.argsort(who, kind="stable")
        value, who = value[order], who[order]
    ends = np.cumsum(np.bincount(who, minlength=len(texts))) if len(texts) else np.zeros(0, np.int64)
    lo = 0
    for hi in ends.tolist():
        value[lo:hi].sort()
        lo = hi
    if len(value):
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
        value, who = value[keep], who[keep]
    return value, np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(texts))))).astype(np.int64)


def _sets(docs: DataFrame, n: int, tokens: bool) -> DataFrame:
    """doc_id, n, k1 and k2 (128 bits of the set's digest) and, if asked for, tokens: 6 bytes of each shingle, ascending."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for piece in pieces(batches, "text"):
            value, at = shingle_sets(piece.column("text"), n)
            raw = value.tobytes()
            ends = (at * 8).tolist()
            keys = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)), np.int64).reshape(-1, 2)
            cols = [piece.column("doc_id"), pa.array(np.diff(at)), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
            if tokens:
                six = np.ascontiguousarray((value >> U(16)).view(np.uint8).reshape(-1, 8)[:, :6])
                cols.append(pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 6), pa.py_buffer(six)]).cast(pa.binary()))
            yield pa.record_batch(cols, names=["doc_id", "n", "k1", "k2", "tokens"][: len(cols)])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, k1 long, k2 long" + ", tokens binary" * tokens)


def _tokens_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens, one document after another, and where each document's start."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, at = text_bytes(arr)
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = data.reshape(-1, 6)
    return wide.view(U).reshape(-1), at // 6


def _firsts(group: pa.Table, reps: pa.Table) -> pa.Table:
    """Of a block's rows one for each set, the one with the set's smallest id."""
    wanted = set(zip(*(reps.column(c).to_pylist() for c in ("k1", "k2", "doc_id")), strict=True))
    keep = []
    for key in zip(*(group.column(c).to_pylist() for c in ("k1", "k2", "doc_id")), strict=True):
        keep.append(key in wanted)
        wanted.discard(key)
    return group.filter(pa.array(keep, pa.bool_()))


def _packed(numbers: np.ndarray) -> bytes:
    """Integers as zstd of their bytes, the lowest of all first."""
    return pa.compress(np.ascontiguousarray(numbers.astype(U).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(U).reshape(-1)


def _part_of(token: np.ndarray, parts: int) -> np.ndarray:
    return ((token >> U(16)) * U(parts) >> U(32)).astype(np.int64)


def _features(docs: DataFrame, slim: DataFrame, equal: DataFrame, n: int, least: int) -> DataFrame:
    """doc_id, n, bits and prefix of every set that shares a shingle of its prefix with another one.

    prefix: (token, pos), pos its place in the set's order of rareness, shingles of this set alone left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = slim.agg(F.sum("n")).first()[0] or 0
    blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_SHINGLES))
    block = F.pmod(F.xxhash64("doc_id", "k1", "k2"), F.lit(blocks)).cast("int")
    rows = _sets(docs, n, True).filter("n > 0").withColumn("block", block)
    reps = equal.select(F.col("rep").alias("doc_id"), "k1", "k2").withColumn("block", block)

    def send(group: pa.Table, firsts: pa.Table) -> pa.Table:
        some = _firsts(group, firsts)
        token, count = np.unique(_tokens_of(some.column("tokens"))[0], return_counts=True)
        part = _part_of(token, blocks)
        cut = np.searchsorted(part, np.arange(blocks + 1))
        there = np.flatnonzero(np.diff(cut))
        ends = list(zip(cut[there].tolist(), cut[there + 1].tolist(), strict=True))
        me = firsts.column("block")[0].as_py() if firsts.num_rows else 0
        return pa.table(
            [
                pa.array(there, pa.int32()),
                pa.array(np.full(len(there), me, np.int32)),
                pa.array(np.diff(cut)[there]),
                pa.array([_packed(np.diff(token[a:b], prepend=U(0))) for a, b in ends], pa.binary()),
                pa.array([_packed(count[a:b]) for a, b in ends], pa.binary()),
            ],
            names=["part", "block", "size", "tokens", "counts"],
        )

    def answer(group: pa.Table) -> pa.Table:
        size = group.column("size").to_pylist()
        tokens = [np.cumsum(_unpacked(r.as_py(), k), dtype=U) for r, k in zip(group.column("tokens"), size, strict=True)]
        counts = [_unpacked(r.as_py(), k).astype(np.int64) for r, k in zip(group.column("counts"), size, strict=True)]
        flat = np.concatenate(tokens)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=~flat[order[:1]]) != 0)
        every = np.add.reduceat(np.concatenate(counts)[order], first)
        level = np.empty(len(flat), np.uint8)
        level[order] = np.repeat(np.minimum(np.rint(8 * np.log2(every)), 255), np.diff(np.append(first, len(flat)))).astype(np.uint8)
        out = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in np.split(level, np.cumsum(size)[:-1])]
        return pa.table([group.column("block"), group.column("part"), pa.array(out, pa.binary())], names=["block", "part", "levels"])

    def finish(group: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.filter(right.column("part").is_valid()).select(["part", "levels"]).sort_by("part")
        some = _firsts(group, right.filter(right.column("part").is_null()))
        flat, at = _tokens_of(some.column("tokens"))
        token, inverse = np.unique(flat, return_inverse=True)
        size = np.bincount(_part_of(token, blocks), minlength=blocks) if len(token) else np.zeros(blocks, np.int64)
        got = [pa.decompress(r.as_py(), decompressed_size=int(size[p]), codec="zstd", asbytes=True) for p, r in zip(answers.column("part").to_pylist(), answers.column("levels"), strict=True)]
        level = np.frombuffer(b"".join(got), np.uint8)[inverse]
        del token, inverse, got
        key = level.astype(U)
        key <<= U(48)
        key |= flat
        bit = ((flat * U(_MULT)) >> U(54)).astype(np.int16)
        del flat
        ids, keep, bits, prefix, places = some.column("doc_id"), [], [], [], []
        for d, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            take = hi - lo - (least * (hi - lo) + 99) // 100 + 1
            if int((level[lo:hi] > 0).sum()) + take <= hi - lo:
                continue  # its prefix has nothing that another set holds
            mine = np.sort(key[lo:hi])[:take]
            place = np.flatnonzero(mine >> U(48))
            if len(place):
                keep.append(d)
                prefix.append(mine[place])
                places.append(place)
                bits.append(np.packbits((np.bincount(bit[lo:hi], minlength=BITS) & 1).astype(np.uint8)).tobytes())
        items = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, U), *prefix]).view(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int32))], names=["tok", "pos"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), items)
        words = np.frombuffer(b"".join(bits), np.int64)
        wide = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * (BITS // 64), pa.int32()), pa.array(words))
        return pa.table([ids.take(pa.array(keep, pa.int64())), pa.array(np.diff(at)[keep] if keep else np.zeros(0, np.int64)), wide, lists], names=["doc_id", "n", "bits", "prefix"])

    dealt, by = rows.groupBy("block"), reps.groupBy("block")
    sent = dealt.cogroup(by).applyInArrow(lambda group, firsts: lean(send, group, firsts), "part int, block int, size long, tokens binary, counts binary")
    answers = sent.groupBy("part").applyInArrow(lambda group: lean(answer, group), "block int, part int, levels binary")
    null = lambda t, *cs: [F.lit(None).cast(t).alias(c) for c in cs]
    right = reps.select("doc_id", "k1", "k2", "block", *null("int", "part"), *null("binary", "levels")).union(answers.select(*null(kind, "doc_id"), *null("long", "k1", "k2"), "block", "part", "levels"))
    return dealt.cogroup(right.groupBy("block")).applyInArrow(lambda group, right: lean(finish, group, right), f"doc_id {kind}, n long, bits array<long>, prefix array<struct<tok: long, pos: int>>")


def _likely(pairs: DataFrame, feats: DataFrame, least: int) -> DataFrame:
    """Pairs that pass the length filter and the suffix filter."""
    side = lambda c: feats.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    apart = F.aggregate(F.zip_with("bits_x", "bits_y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    both = both.filter((100 * F.least("n_x", "n_y") >= least * F.greatest("n_x", "n_y")) & (apart * (100 + least) <= (100 - least) * (F.col("n_x") + F.col("n_y"))))
    return both.select("x", "y")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, least: int, work: Work, name: str) -> DataFrame:
    """Of the pairs (x, y), those whose shingle sets are alike enough; texts of documents in no pair aren't moved."""
    pairs = work.save(f"{name}_pairs", pairs)
    ids = work.save(f"{name}_ids", pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct())
    n_ids = ids.count()
    if not n_ids:
        return work.save(f"{name}_links", pairs)
    few = n_ids <= BROADCAST_IDS
    texts = work.save(f"{name}_texts", docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == F.col("id"), "left_semi"))
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "text_x", "text_y")

    def run(batches):
        for batch in pieces(batches, "text_x"):
            for piece in pieces([batch], "text_y"):
                one, at1 = shingle_sets(piece.column("text_x"), n)
                two, at2 = shingle_sets(piece.column("text_y"), n)
                alike = []
                for k in range(piece.num_rows):
                    a, b = one[at1[k] : at1[k + 1]], two[at2[k] : at2[k + 1]]
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    alike.append(100 * shared >= least * (len(a) + len(b) - shared) and len(a) > 0)
                yield piece.select(["x", "y"]).filter(pa.array(alike, pa.bool_()))

    links = work.save(f"{name}_links", both.mapInArrow(run, both.select("x", "y").schema))
    work.drop(f"{name}_ids", f"{name}_texts")
    return links


def _fits(n1: str, p1: str, n2: str, p2: str, least: int) -> str:
    """Length and positional filter: if this is the first shingle that two sets share, what stands from here on must be enough.

    Any pair that is alike passes at the first one it shares.
    """
    return f"100 * least({n1}, {n2}) >= {least} * greatest({n1}, {n2}) and {100 + least} * least({n1} - {p1}, {n2} - {p2}) >= {least} * ({n1} + {n2})"


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]


def classes(docs: DataFrame, n: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row: documents are linked when 100 * shared >= least * union."""
    work = Work(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    slim = work.save("slim", _sets(docs, n, False))
    docs = docs.filter("doc_id is not null")
    equal = work.save("equal", slim.filter("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")))
    feats = work.save("features", _features(docs, slim, equal, n, least))
    band = F.floor(F.log("n") / np.log(100 / least)) if least < 100 else F.col("n")
    rows = feats.select("doc_id", "n", F.explode("prefix").alias("p")).select("doc_id", "n", "p.tok", "p.pos")

    # First step: each document with the hub of its rarest shared shingle, among those of about its length.
    one = feats.select("doc_id", "n", F.get("prefix", 0).alias("p"), band.alias("band")).select("doc_id", "n", "band", "p.tok", "p.pos")
    hubs = rows.withColumn("band", band).groupBy("tok", "band").agg(F.min(F.struct("pos", "n", "doc_id")).alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    near = one.join(hubs, ["tok", "band"]).filter(f"hub.doc_id != doc_id and {_fits('n', 'pos', 'hub.n', 'hub.pos', least)}")
    near = near.select(F.col("doc_id").alias("x"), F.col("hub.doc_id").alias("y")).select(*_pair("x", "y")).distinct()
    links = _verified(_likely(near, feats, least), docs, n, least, work, "links0")
    seen = ["links0_pairs"]
    found = work.save("found0", components(links, work, "first"))
    round_ = 0
    while True:
        round_ += 1
        now = rows.join(found, rows["doc_id"] == found["node"], "left").select("tok", "doc_id", "n", "pos", F.coalesce("component", "doc_id").alias("c"))
        split = now.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select(F.col("tok").alias("t"))
        open_ = work.save(f"open{round_}", now.join(split, now["tok"] == F.col("t"), "left_semi"))
        if round_ > STEPS:
            break
        spans = open_.groupBy("tok", "c").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("pos", "n", "doc_id")).alias("hub"))
        top = spans.groupBy("tok").agg(F.max_by(F.struct("c", "hub"), F.struct("m", "c")).alias("top"))
        meet = spans.join(top, "tok").filter(f"c != top.c and {_fits('hub.n', 'hub.pos', 'top.hub.n', 'top.hub.pos', least)}")
        meet = meet.select(F.col("hub.doc_id").alias("x"), F.col("top.hub.doc_id").alias("y")).select(*_pair("x", "y")).distinct()
        for name in seen:
            meet = meet.join(docs.sparkSession.read.parquet(f"{work.path}/{name}"), ["x", "y"], "left_anti")
        more = _verified(_likely(meet, feats, least), docs, n, least, work, f"links{round_}")
        seen.append(f"links{round_}_pairs")
        if more.isEmpty():
            break
        found = _contracted(found, more, work, round_)
        work.drop(f"open{round_}")
    # Last step: whatever shares a prefix shingle and isn't in one class yet. What a class can offer at most at a shingle
    # comes first, so that classes are only taken apart where members may pass the filters.
    spans = open_.groupBy("tok", "c").agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    a, b = spans.toDF("tok", "c1", "lo1", "hi1", "rest1"), spans.toDF("tok", "c2", "lo2", "hi2", "rest2")
    may = f"c1 < c2 and 100 * hi1 >= {least} * lo2 and 100 * hi2 >= {least} * lo1 and {100 + least} * least(rest1, rest2) >= {least} * (lo1 + lo2)"
    meet = a.join(b, "tok").filter(may).select("tok", "c1", "c2")
    one, two = open_.toDF("tok", "x", "n1", "p1", "c1"), open_.toDF("tok", "y", "n2", "p2", "c2")
    cross = meet.join(one, ["tok", "c1"]).join(two, ["tok", "c2"]).filter(_fits("n1", "p1", "n2", "p2", least))
    cross = cross.select(*_pair("x", "y")).distinct()
    for name in seen:
        cross = cross.join(docs.sparkSession.read.parquet(f"{work.path}/{name}"), ["x", "y"], "left_anti")
    more = _verified(_likely(cross, feats, least), docs, n, least, work, "cross")
    work.drop("features", f"open{round_}", "cross_pairs", *seen)
    found = _contracted(found, more, work, "cross")

    owned = slim.join(equal, ["k1", "k2"], "left").join(found, F.col("rep") == F.col("node"), "left")
    owned = work.save("owned", owned.select("doc_id", "n", F.coalesce("component", "rep").alias("c")))
    work.drop("slim", "equal", "found_cross", "cross_links")
    # Rows that share an id may have different texts: their classes are one.
    ends = owned.filter("c is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("c").alias("x"), F.max("c").alias("hi")).filter("x < hi")
    same = work.save("same", owned.join(ends, F.col("doc_id") == F.col("id")).select("x", F.col("c").alias("y")).filter("x != y").distinct())
    if not same.isEmpty():
        joined = work.save("joined", components(same, work, "ids"))
        owned = owned.join(joined, F.col("c") == F.col("node"), "left").select("doc_id", "n", F.coalesce("component", "c").alias("c"))
    return owned.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def _contracted(found: DataFrame, links: DataFrame, work: Work, name: object) -> DataFrame:
    """(node, component) after more links: they join classes, so only one edge for each pair of classes is followed."""
    of = lambda c: found.select(F.col("node").alias(f"node_{c}"), F.col("component").alias(f"c_{c}"))
    ends = links.join(of("x"), F.col("x") == F.col("node_x"), "left").join(of("y"), F.col("y") == F.col("node_y"), "left")
    ends = work.save(f"ends_{name}", ends.select("x", "y", F.coalesce("c_x", "x").alias("c_x"), F.coalesce("c_y", "y").alias("c_y")))
    step = work.save(f"step_{name}", components(ends.select(F.col("c_x").alias("x"), F.col("c_y").alias("y")), work, f"again_{name}"))
    fresh = ends.select(F.col("x").alias("node"), F.col("c_x").alias("component")).union(ends.select("y", "c_y")).distinct()
    every = found.union(fresh.join(found.select("node"), "node", "left_anti"))
    out = every.join(step.toDF("class", "to"), F.col("component") == F.col("class"), "left").select("node", F.coalesce("to", "component").alias("component"))
    out = work.save(f"found_{name}", out)
    work.drop(f"ends_{name}", f"step_{name}")
    return out


def keep_first(docs: DataFrame, n: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest id; all columns are kept.

    Of rows that share that id one stays, that with the smallest hash of its text. Rows with a null id stay, as they are
    in no class.
    """
    every = classes(docs, n, least, id_col, text_col)
    # Rows are packed, so that no column of theirs meets one of these names.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("k_id"), F.xxhash64(text_col).alias("k_text"))
    gone = every.filter("component_id != doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    kept = rows.join(gone, F.col("k_id") == F.col("gone_id"), "left_anti")
    twice = every.filter("doc_id is not null").groupBy(F.col("doc_id").alias("twice_id")).count().filter("count > 1").select("twice_id")
    if twice.isEmpty():
        return kept.select("row.*")
    on = F.col("k_id") == F.col("twice_id")
    again = kept.join(twice, on, "left_semi")
    least_text = again.groupBy(F.col("k_id").alias("l_id")).agg(F.min("k_text").alias("l_text"))
    again = again.join(least_text, (F.col("k_id") == F.col("l_id")) & (F.col("k_text") == F.col("l_text"))).dropDuplicates(["k_id"])
    return kept.join(twice, on, "left_anti").select("row").union(again.select("row")).select("row.*")


def op9_ngram_jaccard(spark, sf_dir):
    """Classes of documents whose sets of three-word shingles are alike to 0.9."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, least=90)
