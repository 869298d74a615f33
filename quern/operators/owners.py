"""Owners of properties: person or company, one row per name, owners by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Words that mark a company.
COMPANY_WORDS = ("inc", "llc", "ltd", "foundation", "alliance", "solutions", "corp", "co", "services", "trust", "tr")


def is_company(name: Column) -> Column:
    """The name holds one of the words as a whole word, whatever its case."""
    return name.rlike(rf"(?i)(^|[^a-z])({'|'.join(COMPANY_WORDS)})($|[^a-z])")


def classify(owners: DataFrame, column: str = "name") -> DataFrame:
    """Kind (company, person or invalid), first, middle and last name of a person; & parts names and vanishes."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.col(column), "&", " "), r"\s+", " "))
    parts = F.split(clean, " ")
    kind = F.when(F.coalesce(clean, F.lit("")) == "", "invalid").when(is_company(F.col(column)), "company").when(F.size(parts) < 2, "invalid").otherwise("person")
    person = F.col("kind") == "person"
    out = owners.withColumn("kind", kind).withColumn("first", F.when(person, F.get(parts, 0)))
    middle = F.when(person & (F.size(parts) > 2), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(1))), " "))
    return out.withColumn("middle", middle).withColumn("last", F.when(person, F.try_element_at(parts, F.lit(-1))))


def dedupe(owners: DataFrame, group: str, column: str = "name", order: str = "seq") -> DataFrame:
    """The first row of each trimmed, lower-cased name of a group; empty names vanish."""
    rows = owners.filter(F.coalesce(F.trim(column), F.lit("")) != "")
    rank = F.row_number().over(W.partitionBy(group, F.lower(F.trim(column))).orderBy(order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def by_date(owners: DataFrame, group: str, date: str, column: str = "name") -> DataFrame:
    """Owners of each group and date, names in order; the group's last date is `current`. Null dates are unknown_date."""
    day = F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("unknown_date"))
    per = owners.groupBy(group, day.alias("date")).agg(F.array_sort(F.collect_set(column)).alias("owners"))
    last = F.max(F.when(F.col("date") != "unknown_date", F.col("date"))).over(W.partitionBy(group))
    return per.withColumn("label", F.when(F.col("date") == last, "current").otherwise(F.col("date")))
