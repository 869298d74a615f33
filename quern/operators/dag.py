"""Files and folders as Merkle trees of blocks: identifiers of files of any length and of the folders that hold them.

A file is cut into chunks, each a raw block; WIDTH nodes of a level become one node of the next, until one is left, so that
a file's blocks are rows and no task holds more of it than one node's links. A folder is one node over its files. All bytes
are built by expressions in hex, and no content is moved: what is shuffled are hashes and sizes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.cid import base32_of_hex
from quern.functions.formats import IMAGE_TYPES
from quern.functions.lets import let

#: The importer's chunk size and number of links a node, and the size of a folder's node from which it is divided into shards.
CHUNK, WIDTH, SHARD_BYTES = 262_144, 174, 262_144
#: Identifiers (version 1, sha2-256) of a raw block and of a dag-pb node.
RAW, DAG_PB = "01551220", "01701220"
SHARDED = "the folder is too large for one node, and folders in shards aren't built"


def varint_hex(n: Column) -> Column:
    """A number below 2^63 in groups of seven bits, the lowest first, as hex."""

    def groups(v: Column) -> Column:
        byte = lambda k: F.shiftright(v, 7 * k).bitwiseAND(127) + (F.when(v >= (1 << 7 * (k + 1)), 128).otherwise(0) if k < 8 else F.lit(0))
        digits = lambda k: F.lpad(F.hex(byte(k)), 2, "0")
        return F.lower(F.when(v < 128, digits(0)).otherwise(F.concat(digits(0), *(F.when(v >= (1 << 7 * k), digits(k)).otherwise("") for k in range(1, 9)))))

    return let(n.cast("long"), groups)


def bytes_of(hex_text: Column) -> Column:
    """Half the digits: how many bytes hex stands for."""
    return F.floor(F.length(hex_text) / 2).cast("long")


def field_hex(tag: str, hex_text: Column) -> Column:
    """A protobuf field of bytes."""
    return let(hex_text, lambda x: F.concat(F.lit(tag), varint_hex(bytes_of(x)), x))


def link_hex(cid: Column, name: Column, tsize: Column) -> Column:
    """A link of a dag-pb node: identifier, name and the size of all that it leads to."""
    return field_hex("12", F.concat(field_hex("0a", cid), field_hex("12", F.lower(F.hex(F.encode(name, "UTF-8")))), F.lit("18"), varint_hex(tsize)))


def _hash(hex_text: Column) -> Column:
    return F.sha2(F.unhex(hex_text), 256)


def file_roots(files: DataFrame, keys: list[str], content: str = "content", chunk: int = CHUNK, width: int = WIDTH) -> DataFrame:
    """keys, cid (hex), tsize (bytes of all blocks), size (of the file) and levels, for each file; keys must tell files apart.

    An empty file is one empty block; a null content gives no row.
    """
    n = F.greatest(F.ceil(F.octet_length(content) / chunk), F.lit(1)).cast("long")
    whole = files.filter(F.col(content).isNotNull()).select(*keys, F.col(content).cast("binary").alias("__content"), n.alias("n"))
    most = whole.agg(F.max("n")).first()[0] or 1
    cut = whole.select(*keys, "n", "__content", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("at"))
    part = F.substr("__content", (F.col("at") * chunk + 1).cast("int"), F.lit(chunk))
    size = F.octet_length(part).cast("long")
    nodes = cut.select(*keys, "n", "at", F.concat(F.lit(RAW), F.sha2(part, 256)).alias("cid"), size.alias("tsize"), size.alias("size"))
    roots, level = [nodes.filter("n = 1").select(*keys, "cid", "tsize", "size", F.lit(0).alias("levels"))], 0
    while most > 1:
        level += 1
        links = nodes.filter("n > 1").groupBy(*keys, "n", F.floor(F.col("at") / width).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "cid", "tsize", "size"))).alias("links"))
        total = lambda name: F.aggregate("links", F.lit(0).cast("long"), lambda s, x: s + x[name])
        links = links.select(*keys, "n", "up", "links", total("size").alias("size"), total("tsize").alias("below"))
        data = F.concat(F.lit("0802"), F.lit("18"), varint_hex(F.col("size")), F.array_join(F.transform("links", lambda x: F.concat(F.lit("20"), varint_hex(x["size"]))), ""))
        block = F.concat(F.array_join(F.transform("links", lambda x: link_hex(x["cid"], F.lit(""), x["tsize"])), ""), field_hex("0a", data))
        links = links.select(*keys, F.ceil(F.col("n") / width).cast("long").alias("n"), F.col("up").alias("at"), "size", "below", block.alias("block"))
        nodes = links.select(*keys, "n", "at", F.concat(F.lit(DAG_PB), _hash(F.col("block"))).alias("cid"), (F.col("below") + bytes_of(F.col("block"))).alias("tsize"), "size")
        roots.append(nodes.filter("n = 1").select(*keys, "cid", "tsize", "size", F.lit(level).alias("levels")))
        most = -(-most // width)
    return reduce(DataFrame.union, roots)


def folder_roots(roots: DataFrame, folder: str = "dir", name: str = "name", limit: int | None = SHARD_BYTES) -> DataFrame:
    """folder, cid (hex), tsize, n_files and problem: the node over the folder's files by the bytes of their names.

    A folder whose node would be larger than `limit` gets a null identifier and says so; without a limit all get one node.
    A folder's links stream in order past its hash and are never gathered, so a node may be of any size.
    """
    links = roots.select(folder, F.hex(F.encode(name, "UTF-8")).alias("place"), "tsize", link_hex(F.col("cid"), F.col(name), F.col("tsize")).alias("link"))
    sizes = links.groupBy(F.col(folder).alias("__dir")).agg(F.sum(bytes_of(F.col("link"))).alias("bytes"), F.count(F.lit(1)).alias("n_files"), F.sum("tsize").alias("below"))
    sizes = sizes.withColumn("fits", F.lit(True) if limit is None else F.col("bytes") + 4 <= limit)
    some = links if limit is None else links.join(sizes.filter("fits"), F.col(folder).eqNullSafe(F.col("__dir")), "left_semi")
    key = F.xxhash64(folder)
    ordered = some.select(key.alias("__key"), folder, "place", "link").repartition("__key").sortWithinPartitions("__key", folder, "place", "link").select(folder, "link")
    own = T.StructType([T.StructField("__own", links.schema[folder].dataType), T.StructField("digest", T.StringType())])
    per = ordered.mapInArrow(_node_digests, own).select("__own", F.concat(F.lit(DAG_PB), F.col("digest")).alias("cid"))
    found = sizes.join(per, F.col("__dir").eqNullSafe(F.col("__own")), "left")
    return found.select(F.col("__dir").alias(folder), "cid", F.when(F.col("fits"), F.col("below") + F.col("bytes") + 4).alias("tsize"), "n_files", F.when(~F.col("fits"), SHARDED).alias("problem"))


def _node_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The folder and the sha2-256 of its node for rows (folder, link in hex) that come folder by folder, in order."""
    held = None  # folder (an array of one), hash so far

    def ended():
        held[1].update(b"\x0a\x02\x08\x01")
        return pa.RecordBatch.from_arrays([held[0], pa.array([held[1].hexdigest()])], ["__own", "digest"])

    for batch in batches:
        folders, links = batch.columns
        names, at = folders.to_pylist(), 0
        while at < len(names):
            to = at + 1
            while to < len(names) and names[to] == names[at]:
                to += 1
            if held is None or held[0][0].as_py() != names[at]:
                if held is not None:
                    yield ended()
                held = folders.take(pa.array([at])), hashlib.sha256()
            held[1].update(bytes.fromhex("".join(x for x in links[at:to].to_pylist() if x is not None)))
            at = to
    if held is not None:
        yield ended()


def cid_text(cid_hex: Column) -> Column:
    """An identifier of 36 bytes in hex as base32."""
    return F.when(cid_hex.isNotNull(), F.concat(F.lit("b"), base32_of_hex(cid_hex, 58)))


def media_cids(files: DataFrame, chunk: int = CHUNK, width: int = WIDTH) -> DataFrame:
    """Dir, media_cid, problem for the pages and images of each folder. files: dir, name, content."""
    media = files.filter(F.lower("name").rlike(rf"\.(html?|{'|'.join(IMAGE_TYPES)})$"))
    found = folder_roots(file_roots(media, ["dir", "name"], "content", chunk, width))
    return found.select("dir", cid_text(F.col("cid")).alias("media_cid"), "problem")
