"""What scripts extract, as rows: inputs of several requests, entities and their files, mapped values, relationships between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Classes of which a property has one entity at most, and classes whose entities are numbered.
SINGLE = ("property", "address", "lot", "flood_storm_information", "structure", "utility")
NUMBERED = ("tax", "sales", "deed", "file", "person", "company", "layout")


def request_inputs(inputs: DataFrame, raw: str = "raw") -> DataFrame:
    """The members of an input that hold a request and its response, as key, request, response; inputs without any have no row."""
    keys = inputs.withColumn("key", F.explode(F.json_object_keys(raw)))
    inner = keys.withColumn("inner", F.call_function("get_json_object", F.col(raw), F.concat(F.lit("$['"), "key", F.lit("']"))))
    names = F.json_object_keys("inner")
    found = inner.filter(F.array_contains(names, "source_http_request") & F.array_contains(names, "response"))
    return found.select(*(c for c in inputs.columns if c != raw), "key", F.get_json_object("inner", "$.source_http_request").alias("request"), F.get_json_object("inner", "$.response").alias("response"))


def layouts(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """E5: property, name, content: every room of a document keyed property_<id>, numbered in order."""
    parsed = docs.select(F.explode(F.from_json(raw, "map<string,struct<layouts:array<string>>>")).alias("key", "value"))
    rooms = parsed.select(F.regexp_replace("key", "^property_", "").alias("property"), F.posexplode("value.layouts").alias("pos", "content"))
    return rooms.select("property", F.concat(F.lit("layout_"), (F.col("pos") + 1).cast("string"), F.lit(".json")).alias("name"), "content")


def keyed(docs: DataFrame, name: str, raw: str = "raw") -> DataFrame:
    """E5: property, name, content: what documents keyed property_<id> hold of each property, as its file (structure, utility)."""
    parsed = docs.select(F.explode(F.from_json(raw, "map<string,string>")).alias("key", "content")).filter(F.col("key").startswith("property_") & F.col("content").isNotNull())
    return parsed.select(F.regexp_replace("key", "^property_", "").alias("property"), F.lit(f"{name}.json").alias("name"), "content")


def entity_files(entities: DataFrame) -> DataFrame:
    """Property, name, content: a file for each entity that is there, numbered within its class where it may have several.

    entities: property, class, seq, content (null: absent).
    """
    there = entities.filter(F.col("content").isNotNull())
    n = F.row_number().over(W.partitionBy("property", "class").orderBy("seq"))
    stem = F.when(F.col("class").isin(*SINGLE), F.col("class")).otherwise(F.concat_ws("_", "class", n.cast("string")))
    return there.select("property", F.concat(stem, F.lit(".json")).alias("name"), "content")


def mapped(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """Values with what the mapping says, or the error of one that it doesn't know (null stays null).

    values: path (class.property), value; mapping: path, source, target. The mapping is a dimension.
    """
    known = mapping.select(F.col("path").alias("_path"), F.col("source").alias("_source"), "target")
    found = values.join(known, (F.col("path") == F.col("_path")) & (F.col("value") == F.col("_source")), "left")
    error = F.to_json(F.struct(F.lit("error").alias("type"), F.concat(F.lit("Unknown enum value "), "value", F.lit(".")).alias("message"), F.col("path")))
    return found.withColumn("error", F.when(F.col("value").isNotNull() & F.col("target").isNull(), error)).drop("_path", "_source")


def linked_entities(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The relationship between entities of a property that agree on keys: property, name, content.

    left, right: property, name (a file), and the keys (a date, a number).
    """
    one = left.select("property", *keys, F.col("name").alias("_from"))
    met = one.join(right.select("property", *keys, F.col("name").alias("_to")), ["property", *keys])
    stem = lambda c: F.regexp_replace(c, r"\.json$", "")
    link = lambda c: F.struct(F.concat(F.lit("./"), c).alias("/"))
    name = F.concat(F.lit("relationship_"), stem("_from"), F.lit("_"), stem("_to"), F.lit(".json"))
    return met.select("property", name.alias("name"), F.to_json(F.struct(link("_from").alias("from"), link("_to").alias("to"))).alias("content"))


def numbered_dates(rows: DataFrame, group: str, date: str, order: str) -> DataFrame:
    """Rows with `label`, their date, or unknown_date_n for each one without."""
    unknown = F.row_number().over(W.partitionBy(group, F.col(date).isNull()).orderBy(order))
    return rows.withColumn("label", F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.concat(F.lit("unknown_date_"), unknown.cast("string"))))


def invalid_owner(raw: Column, kind: Column) -> Column:
    """What is reported of an owner that is neither person nor company; null for others."""
    reason = F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "empty name").otherwise("single word")
    return F.when(kind == "invalid", F.struct(F.coalesce(raw, F.lit("")).alias("raw"), reason.alias("reason")))


Extractor = Callable[[str], dict[str, str]]


def extracted(pages: DataFrame, extractors: dict[str, Extractor], key: str, text: str = "html") -> DataFrame:
    """Key, extractor, name, content: what each registered extractor finds in each page; one that fails leaves a row with `error`."""
    rows = pages.select(key, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, page in zip(frame[key], frame[text], strict=True):
                for name, f in extractors.items():
                    try:
                        out += [(k, name, file, content, None) for file, content in f(page or "").items()]
                    except Exception as e:  # a guest's fault is a row, not the end of the run
                        out.append((k, name, None, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "extractor", "name", "content", "error"])

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, extractor string, name string, content string, error string")


def class_schema(schema: dict) -> dict:
    """A class's schema without what every class has: its request, its identifier and rules that join schemas."""
    common = ("source_http_request", "request_identifier")
    if not isinstance(schema.get("required"), list):
        raise ValueError("required must be a list")
    out = {k: v for k, v in schema.items() if k != "allOf"}
    return out | {"properties": {k: v for k, v in schema.get("properties", {}).items() if k not in common}, "required": [k for k in schema["required"] if k not in common]}


def run_totals(states: DataFrame, group: str) -> DataFrame:
    """What a run processed, skipped and failed on, a row for each group."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return states.groupBy(group).agg(count("processed"), count("error"), count("skipped"), F.count(F.lit(1)).alias("total"))
