"""Report tables: the columns of each file that the engine writes, ready for sources.files.write_records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.formats import csv_field

#: The columns of reports, in order.
HASHES = ("propertyCid", "dataGroupCid", "dataCid", "filePath", "uploadedAt", "htmlLink")
ERRORS = ("property_cid", "data_group_cid", "file_path", "error_path", "error_message", "currentValue", "timestamp")
WARNINGS = ("propertyCid", "dataGroupCid", "filePath", "reason", "timestamp")
STATUSES = ("batchIndex", "transactionHash", "status", "blockNumber", "gasUsed", "itemCount", "error", "timestamp")
IDS = ("transactionHash", "batchIndex", "itemCount", "timestamp", "status")
CHECKED = (*IDS, "blockNumber", "gasUsed", "checkTimestamp", "error")
LINK = "https://ipfs.io/ipfs/"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def hash_rows(files: DataFrame) -> DataFrame:
    """K-1, F13: main files (those with a data group), when they were sent left empty, and a link to the media's folder.

    files: property_cid, data_group_cid, data_cid, path, media_cid.
    """
    main = files.filter(F.coalesce(F.col("data_group_cid"), F.lit("")) != "")
    link = F.when(F.coalesce(F.col("media_cid"), F.lit("")) != "", F.concat(F.lit(LINK), "media_cid")).otherwise("")
    return main.select(*(F.col(a).alias(b) for a, b in zip(("property_cid", "data_group_cid", "data_cid", "path"), HASHES, strict=False)), F.lit("").alias("uploadedAt"), link.alias("htmlLink"))


def upload_rows(files: DataFrame, results: DataFrame) -> DataFrame:
    """K-5, J8: sent files with the link of their page, found by the property's identifier, else by the folder's name.

    files: property_cid, dir, data_group_cid, data_cid, path, sent_at; results: key, link.
    """
    by = lambda c: results.select(F.col("key").alias(f"_{c}"), F.col("link").alias(f"_{c}_link"))
    found = files.join(by("cid"), F.col("property_cid") == F.col("_cid"), "left").join(by("dir"), F.col("dir") == F.col("_dir"), "left")
    link = F.coalesce("_cid_link", "_dir_link", F.lit(""))
    return found.select(*(F.col(a).alias(b) for a, b in zip(("property_cid", "data_group_cid", "data_cid", "path"), HASHES, strict=False)), text(F.col("sent_at")).alias("uploadedAt"), link.alias("htmlLink"))


def first_links(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first n pages of a report, each once; this report is meant to be short."""
    return rows.filter("htmlLink <> ''").groupBy("htmlLink").agg(F.min_by("propertyCid", "seq").alias("propertyCid"), F.min("seq").alias("seq")).orderBy("seq").limit(n)


def error_rows(errors: DataFrame, stamp: Column) -> DataFrame:
    """K-3: errors: property_cid, data_group_cid, file_path, error_path, error_message, value."""
    return errors.select(*ERRORS[:5], text(F.col("value")).alias("currentValue"), stamp.alias("timestamp"))


def warning_rows(warnings: DataFrame, stamp: Column) -> DataFrame:
    """K-4: warnings: property_cid, data_group_cid, path, reason."""
    return warnings.select(*(F.col(a).alias(b) for a, b in zip(("property_cid", "data_group_cid", "path", "reason"), WARNINGS, strict=False)), stamp.alias("timestamp"))


def status_rows(txs: DataFrame) -> DataFrame:
    """K-6: block 0 and gas 0 are as good as none. txs: batch, tx, status, block, gas, items, error, at."""
    some = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string")).otherwise("")
    values = (F.col("batch"), F.col("tx"), F.col("status"), F.coalesce(some("block"), F.lit("")), F.coalesce(some("gas"), F.lit("")), F.col("items"), text(F.col("error")), F.col("at"))
    return txs.select(*(v.cast("string").alias(c) for v, c in zip(values, STATUSES, strict=True)))


def checked_rows(ids: DataFrame, checked: DataFrame) -> DataFrame:
    """K-8, K-7: the transactions of an ids report with what a later look found. checked: tx, status, block, gas, at, error."""
    found = ids.drop("status").join(checked.withColumnRenamed("tx", "transactionHash"), "transactionHash", "left")
    values = (*(F.col(c) for c in IDS[:4]), F.coalesce("status", F.lit("pending")), F.col("block"), F.col("gas"), F.col("checked_at"), F.col("error"))
    return found.select(*(text(v).alias(c) for v, c in zip(values, CHECKED, strict=True)))


def csv_lines(rows: DataFrame) -> Column:
    """A row of a report as one line."""
    return F.concat_ws(",", *(csv_field(F.col(c)) for c in rows.columns))


def csv_parts(line: Column, columns: int) -> Column:
    """The fields of one line, quotes and doubled quotes undone."""
    schema = ", ".join(f"c{k} string" for k in range(columns))
    row = F.from_csv(line, schema, {"escape": '"', "quote": '"', "nullValue": "\u0001"})
    return F.transform(F.array(*(row[f"c{k}"] for k in range(columns))), lambda v: F.coalesce(v, F.lit("")))
