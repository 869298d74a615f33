"""Post-processing of validation errors: drop noise, fold an address's errors into one, keep one row per kind of error.

Rows carry seq, the order in which they were found; every first-wins rule is by seq, as a minimum that tasks aggregate
before the shuffle: there are few kinds of errors, so a sort by kind would meet most of a corpus's errors in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.functions.formats import last_segment

#: Messages that say nothing to a user, and the row that stands for all errors of an address.
TYPE_ERROR = "^must be (null|object|array)$"
NO_MATCH = ("must match a schema in anyOf", "must match exactly one schema in oneOf")
ADDRESS_PATH = "/relationships/property_has_address"
ADDRESS_MESSAGE = "Address should provide either unnormalized_address or normalized version distributed to other fields"


def is_address_path(path: Column) -> Column:
    return (path.contains("property_has_address") & path.contains("/to")) | (path.contains("address_has_fact_sheet") & path.contains("/from"))


def drop_noise(errors: DataFrame) -> DataFrame:
    """F12."""
    return errors.filter(~F.col("error_message").rlike(TYPE_ERROR) & ~F.col("error_message").isin(*NO_MATCH))


def consolidate_addresses(errors: DataFrame) -> DataFrame:
    """Files whose address matches no schema get one row for all errors of that address, after all other rows."""
    address = is_address_path(F.col("error_path"))
    failed = F.max(address & F.col("error_message").isin(*NO_MATCH) & ~F.col("error_message").rlike(TYPE_ERROR)).over(W.partitionBy("file_path"))
    kept = drop_noise(errors.withColumn("failed", failed)).withColumn("folds", F.col("failed") & address)
    first = F.row_number().over(W.partitionBy("file_path", "folds").orderBy("seq"))
    kept = kept.withColumn("rank", F.when(F.col("folds"), first)).filter("not folds or rank = 1")
    fold = F.col("folds")
    return kept.select(
        *(c for c in errors.columns if c not in ("error_path", "error_message")),
        F.when(fold, ADDRESS_PATH).otherwise(F.col("error_path")).alias("error_path"),
        F.when(fold, ADDRESS_MESSAGE).otherwise(F.col("error_message")).alias("error_message"),
        fold.cast("int").alias("late"),
    )


def dedupe_errors(errors: DataFrame) -> DataFrame:
    """One row per message and last path segment, across files; a path without has_fact_sheet is preferred."""
    errors = errors if "late" in errors.columns else errors.withColumn("late", F.lit(0))
    cols = [c for c in errors.columns if c != "late"]
    order = F.struct(F.col("error_path").contains("has_fact_sheet"), "late", "seq")
    best = errors.groupBy(F.col("error_message").alias("_message"), last_segment(F.col("error_path")).alias("_leaf")).agg(F.min_by(F.struct(*cols), order).alias("best"), F.min(F.struct("late", "seq")).alias("place"))
    return best.select("best.*", "place")


def post_process(errors: DataFrame) -> DataFrame:
    """All of the above; `place` gives the order of the report."""
    return dedupe_errors(consolidate_addresses(errors))


def repair_errors(errors: DataFrame) -> DataFrame:
    """The first error of each class and property (the last two path segments)."""
    parts = F.filter(F.split("error_path", "/"), lambda p: p != "")
    target = F.concat_ws(".", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1)))
    return errors.groupBy(target.alias("target")).agg(F.min_by(F.struct(*errors.columns), "seq").alias("first")).select("first.*", "target")
