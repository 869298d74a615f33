"""Files as tables, and back: archives, JSON documents, CSV records."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of each ZIP archive (by extension or magic): archive, entry, content.

    An archive whose entries share one top folder loses that folder (S5).
    """
    return unpacked(spark.read.format("binaryFile").load(path))


def is_archive(path: Column, content: Column) -> Column:
    """By extension or magic."""
    return F.lower(path).endswith(".zip") | (F.substr(content, F.lit(1), F.lit(2)) == F.lit(b"PK"))


def unpacked(files: DataFrame) -> DataFrame:
    """The entries of those files (path, content) that are archives; folders have no row. A batch holds 16 MB or one entry."""
    zips = files.filter(is_archive(F.col("path"), F.col("content"))).select("path", "content")

    def unpack(frames):
        for frame in frames:
            held, size = [], 0
            for name, data in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
                    top = {n.split("/")[0] for n in names}
                    cut = len(top.pop()) + 1 if len(top) == 1 and all("/" in n for n in names) else 0
                    for n in names:
                        held.append((name, n[cut:], z.read(n)))
                        size += len(held[-1][2])
                        if size > 16 << 20:
                            yield pd.DataFrame(held, columns=["archive", "entry", "content"])
                            held, size = [], 0
            yield pd.DataFrame(held, columns=["archive", "entry", "content"])

    return zips.mapInPandas(unpack, "archive string, entry string, content binary")


def write_archives(files: DataFrame, group: str = "property_cid") -> DataFrame:
    """K-2, K-10: one ZIP per group as bytes, entries by name. files: group, entry, content; an archive must fit a task's memory.

    Entries come group by group, in order, and are packed as they come.
    """
    schema = T.StructType([T.StructField(group, files.schema[group].dataType), T.StructField("archive", T.BinaryType())])
    ordered = files.select(group, "entry", "content").repartition(group).sortWithinPartitions(group, "entry")
    return ordered.mapInArrow(_packed, schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives of rows (group, entry, content) that come in order; a batch of them holds 16 MB or one archive."""
    names, archives, size, z, out, own = [], [], 0, None, None, None

    def ready():
        return pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.array(archives, pa.binary())], [head, "archive"])

    for batch in batches:
        head, keys = batch.schema.names[0], batch.column(0).to_pylist()
        for i, (key, entry, data) in enumerate(zip(keys, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if z is None or key != own:
                if z is not None:
                    z.close()
                    archives.append(out.getvalue())
                    size += len(archives[-1])
                    if size > 16 << 20 or len(archives) >= 10_000:
                        yield ready()
                        names, archives, size = [], [], 0
                own, out = key, io.BytesIO()
                z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                names.append(batch.column(0).slice(i, 1))
            z.writestr(zipfile.ZipInfo(entry, (1980, 1, 1, 0, 0, 0)), data)
    if z is not None:
        z.close()
        archives.append(out.getvalue())
        yield ready()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON files below a folder: dir, name, raw, parsed (null where that isn't JSON)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    parts = F.split("path", "/")
    raw = F.decode("content", "UTF-8")
    return files.select(F.element_at(parts, -2).alias("dir"), F.element_at(parts, -1).alias("name"), raw.alias("raw"), F.try_parse_json(raw).alias("parsed"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; all columns are texts, quotes are doubled, fields may hold newlines, broken rows fail."""
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True, mode="FAILFAST")


def write_records(rows: DataFrame, path: str) -> None:
    """K-1 and K-3 to K-8: CSV with a header, quoted where needed; nulls are empty."""
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def unsigned_transactions(batched: DataFrame, to: str, chain_hex: str) -> DataFrame:
    """K-9: per batch a JSON text of the transaction's fields. batched: batch, gas_hex, nonce, data."""
    fields = F.struct(F.lit(to).alias("to"), F.col("gas_hex").alias("gas"), F.concat(F.lit("0x"), F.lower(F.hex("nonce"))).alias("nonce"), F.lit(chain_hex).alias("chainId"), F.col("data"))
    return batched.select("batch", F.to_json(fields).alias("transaction"))


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_r = 1").drop("_r")
