"""Relationship files into slots of a data group: ordered first-match rules over lower-cased names, all in one CASE.

A rule is (slot, words that must all occur, words that must not). Singleton slots keep the last file, others all in order.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rule = tuple[str, tuple[str, ...], tuple[str, ...]]

#: The order of the rules is part of their meaning.
COUNTY: tuple[Rule, ...] = (
    ("property_has_address", ("property_address",), ()),
    ("property_has_lot", ("property_lot",), ()),
    ("tax_exemption_has_fact_sheet", ("exemption", "fact_sheet"), ()),
    ("tax_jurisdiction_has_fact_sheet", ("jurisdiction", "fact_sheet"), ()),
    ("tax_jurisdiction_has_tax_exemption", ("exemption",), ()),
    ("tax_has_tax_jurisdiction", ("tax", "jurisdiction"), ()),
    ("property_has_tax", ("property_tax",), ("jurisdiction", "exemption")),
    ("property_has_sales_history", ("property_sales",), ()),
    ("property_has_layout", ("property_layout",), ()),
    ("property_has_flood_storm_information", ("property_flood_storm_information",), ()),
    ("property_has_utility", ("property_has_utility",), ()),
    ("property_has_utility", ("property_utility",), ()),
    ("property_has_structure", ("property_has_structure",), ()),
    ("property_has_structure", ("property_structure",), ()),
    ("parcel_has_geometry", ("parcel_geometry",), ()),
    ("parcel_has_geometry", ("parcel", "geometry"), ("property",)),
    ("address_has_geometry", ("address", "geometry"), ()),
    ("layout_has_geometry", ("layout_geometry",), ()),
    ("layout_has_geometry", ("layout", "geometry"), ("property",)),
    ("property_has_file", ("property_file",), ()),
    ("property_has_property_improvement", ("property_improvement",), ()),
    ("sales_history_has_person", ("relationship_sales", "person"), ()),
    ("sales_history_has_company", ("relationship_sales", "company"), ()),
    ("deed_has_file", ("relationship_deed", "file"), ()),
    ("sales_history_has_deed", ("relationship_sales", "deed"), ()),
    ("person_has_mailing_address", ("person", "mailing_address", "relationship"), ()),
    ("company_has_mailing_address", ("company", "mailing_address", "relationship"), ()),
    ("layout_has_layout", ("relationship", "layout*2"), ()),
    ("layout_has_utility", ("relationship", "layout", "utility"), ()),
    ("layout_has_structure", ("relationship", "layout", "structure"), ()),
)
COUNTY_SINGLE = ("property_has_address", "property_has_lot", "property_has_flood_storm_information", "property_has_utility", "property_has_structure", "address_has_geometry")
IMPROVEMENT_SLOTS = (
    "parcel_has_property_improvement",
    "property_has_property_improvement",
    "property_improvement_has_contractor",
    "property_improvement_has_file",
    "property_improvement_has_inspection",
    "property_improvement_has_layout",
    "property_improvement_has_structure",
    "property_improvement_has_utility",
    "company_has_communication",
    "contractor_has_person",
    "inspection_has_company",
    "inspection_has_file",
    "inspection_has_person",
)
IMPROVEMENT: tuple[Rule, ...] = tuple((slot, (slot,), ()) for slot in IMPROVEMENT_SLOTS)
IMPROVEMENT_SINGLE = ("parcel_has_property_improvement", "property_improvement_has_layout", "property_improvement_has_structure", "property_improvement_has_utility")


def _holds(name: Column, word: str) -> Column:
    text, _, times = word.partition("*")
    return name.rlike(".*".join([text] * int(times))) if times else name.contains(text)


def slot_of(file: Column, rules: tuple[Rule, ...] = COUNTY) -> Column:
    """The slot of a relationship file; null if no rule matches."""
    name, out = F.lower(file), F.lit(None).cast("string")
    for slot, words, without in reversed(rules):
        met = reduce(lambda a, b: a & b, [*(_holds(name, w) for w in words), *(~name.contains(w) for w in without)])
        out = F.when(met, slot).otherwise(out)
    return out


def slot_files(files: DataFrame, rules: tuple[Rule, ...] = COUNTY, single: tuple[str, ...] = COUNTY_SINGLE) -> DataFrame:
    """R-C, R-P: group, slot, files (array in order). files: group, seq, file."""
    slotted = files.withColumn("slot", slot_of(F.col("file"), rules)).filter("slot is not null")
    per = slotted.groupBy("group", "slot").agg(F.array_sort(F.collect_list(F.struct("seq", "file"))).alias("all"), F.max_by("file", "seq").alias("last"))
    return per.select("group", "slot", F.when(F.col("slot").isin(*single), F.array("last")).otherwise(F.transform("all", lambda x: x["file"])).alias("files"))


def data_groups(files: DataFrame, label: str = "County", rules: tuple[Rule, ...] = COUNTY, single: tuple[str, ...] = COUNTY_SINGLE) -> DataFrame:
    """The data group document of each group as JSON, slots without files left out, links as {"/": "./file"}."""
    slots = list(dict.fromkeys(r[0] for r in rules))
    links = slot_files(files, rules, single)
    link = lambda f: F.struct(F.concat(F.lit("./"), f).alias("/"))
    one = lambda s: F.max(F.when(F.col("slot") == s, F.transform("files", link)))
    per = links.groupBy("group").agg(*(one(s).alias(s) for s in slots))
    value = [F.get(F.col(s), 0).alias(s) if s in single else F.col(s) for s in slots]
    return per.select("group", F.to_json(F.struct(F.lit(label).alias("label"), F.struct(*value).alias("relationships"))).alias("document"))


def synthesised(files: DataFrame) -> DataFrame:
    """The relationship file from the property to every entity but those linked otherwise, and its content."""
    linked = is_entity(F.col("file")) & ~F.col("file").endswith("property.json") & ~F.col("file").rlike(LINKED_ELSEWHERE)
    link = lambda p: F.struct(p.alias("/"))
    content = F.to_json(F.struct(link(F.lit("./property.json")).alias("from"), link(F.concat(F.lit("./"), F.col("file"))).alias("to")))
    return files.filter(linked).withColumn("relationship", F.concat(F.lit("relationship_property_"), F.col("file"))).withColumn("content", content)


#: Entities that no relationship from the property is made for.
LINKED_ELSEWHERE = "^(person|company|structure|utility|mailing_address)|exemption|jurisdiction"


def is_entity(file: Column) -> Column:
    """P5: which files of a folder are entities: JSON, but no relationship and no raw data."""
    return file.endswith(".json") & ~file.startswith("relationship") & ~file.endswith("data.json")


@F.pandas_udf(T.StringType())
def with_provenance(raw: pd.Series, request: pd.Series, identifier: pd.Series) -> pd.Series:
    """P5: an entity with the seed's request where it has none, and the seed's identifier; null where it isn't an object."""

    def one(text: str | None, given: str | None, name: str | None) -> str | None:
        try:
            value = json.loads(text)
            if not isinstance(value, dict):
                return None
            value["source_http_request"] = value.get("source_http_request") or json.loads(given)
            return json.dumps(value | {"request_identifier": name}, ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return pd.Series([one(*x) for x in zip(raw, request, identifier, strict=True)], dtype=object)


def transformed(files: DataFrame, seeds: DataFrame, schema_cid: str, label: str = "County", rules: tuple[Rule, ...] = COUNTY, single: tuple[str, ...] = COUNTY_SINGLE) -> DataFrame:
    """R-D: group, name, content of what a folder's transform leaves: entities with their provenance, relationships (made
    ones and those there, each name once), and the data group that holds them.

    files: group, seq, file, raw; seeds: group, request (JSON text), identifier.
    """
    filled = files.join(seeds, "group", "left")
    kept = filled.select("group", F.col("file").alias("name"), F.when(is_entity(F.col("file")), with_provenance("raw", "request", "identifier")).otherwise(F.col("raw")).alias("content"))
    made = synthesised(files).select("group", "seq", F.col("relationship").alias("file"), "content")
    there = files.filter(F.col("file").startswith("relationship_") & F.col("file").endswith(".json"))
    # Made ones come first and replace those of their name; the rest follows in the folder's order.
    extra = there.join(made.select("group", "file"), ["group", "file"], "left_anti")
    links = made.select("group", F.struct(F.lit(0).alias("a"), F.col("seq").alias("b")).alias("seq"), "file").unionByName(extra.select("group", F.struct(F.lit(1).alias("a"), F.col("seq").alias("b")).alias("seq"), "file"))
    groups = data_groups(links, label, rules, single).select("group", F.lit(f"{schema_cid}.json").alias("name"), F.col("document").alias("content"))
    kept = kept.join(made.select("group", F.col("file").alias("name")), ["group", "name"], "left_anti")
    return kept.unionByName(made.select("group", F.col("file").alias("name"), "content")).unionByName(groups)
