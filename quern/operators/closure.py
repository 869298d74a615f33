"""Documents fetched by identifier with all that they link to, from a table of contents: names of files, texts with paths.

Links are taken from all contents in one pass; the closure walks identifiers only, level by level, each level written
compressed; texts are parsed and written once, and read at the end for what was reached. Those without links move no more.
A file's name is kept without the identifier in it, and tables go as soon as nothing reads them. A content counts if its hash is its identifier's and its text is
a JSON object or another JSON value. What is missing or broken ends its branch and stays as a row that says so.

Of several ways to a document the shortest names its file; of those of a length, the one whose file and place come first.
A link becomes a path where its target was saved; one to the document itself, or to one on the way to it, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.cid import cid_raw
from quern.functions.formats import json_value, strict_cid
from quern.operators.documents import manifest_lookup
from quern.operators.schema_columns import link_target
from quern.session import Tables

MISSING, BROKEN, NO_JSON = "Failed to fetch", "Content does not match its identifier", "Content is not JSON"
LINK = r'\{"/":"([^"\\]+)"\}'


def _entries(v: Column) -> Column:
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def _link(target: Column, rel: Column, key: Column) -> Column:
    return F.struct(target.alias("target"), rel.alias("rel"), key.alias("key"))


def links_of(v: Column) -> Column:
    """(target, rel, key) of what is followed: relationships, one link or several by key or place, and links right below the document (rel null)."""
    none = F.array().cast("array<struct<target:string,rel:string,key:string>>")
    text = F.lit(None).cast("string")

    def of_relationship(e: Column) -> Column:
        by_key = F.transform(_entries(e["value"]), lambda x: _link(link_target(x["value"]), e["key"], x["key"]))
        by_place = F.transform(F.try_variant_get(e["value"], "$", "array<variant>"), lambda x, i: _link(link_target(x), e["key"], i.cast("string")))
        return F.when(link_target(e["value"]).isNotNull(), F.array(_link(link_target(e["value"]), e["key"], F.lit("")))).otherwise(F.coalesce(by_key, by_place, none))

    relationships = F.flatten(F.transform(_entries(F.try_variant_get(v, "$.relationships", "variant")), of_relationship))
    direct = F.transform(F.filter(_entries(v), lambda e: e["key"] != "relationships"), lambda e: _link(link_target(e["value"]), text, e["key"]))
    return F.filter(F.concat(F.coalesce(relationships, none), F.coalesce(direct, none)), lambda x: F.coalesce((F.length(x["target"]) >= 46) & strict_cid(x["target"]), F.lit(False)))


def fetched(roots: DataFrame, content: DataFrame, manifest: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Root, cid, depth, path, text, problem. roots: cid; content: cid, data; manifest: name, cid, type (see manifest_lookup).

    The root's file has the name of its label's data group, else its identifier; a relationship's that of the relationship,
    with key and identifier if it holds several; any other's that of what it was met in, key and identifier.
    """
    work, v = Tables(roots.sparkSession), json_value(F.col("data"))
    once = content.select("cid", "data").dropDuplicates(["cid"])
    known = once.select("cid", F.when(cid_raw(F.col("data")) != F.col("cid"), BROKEN).when(v.isNull(), NO_JSON).alias("problem"), v.alias("v"))
    ok = lambda x: F.when(F.col("problem").isNull(), x)
    known = known.select(F.col("cid").alias("k_cid"), F.coalesce("problem", F.lit("")).alias("state"), F.try_variant_get("v", "$.label", "string").alias("label"), ok(links_of(F.col("v"))).alias("links"), ok(F.to_json("v")).alias("text"))
    known = work.save("known", manifest_lookup(known, manifest).select("k_cid", "state", F.col("cid").alias("group_cid"), "links", "text"))
    texts, known = known.select(F.col("k_cid").alias("t_cid"), "text").filter("text is not null"), known.drop("text")

    null = F.lit(None).cast("string")
    stem_of = lambda stem, by_cid, cid: F.concat(stem, F.when(by_cid, cid).otherwise(""))  # noqa: E731  a file's name but for .json
    first = roots.select(F.col("cid").alias("root"), "cid").distinct()
    frontier = first.select("root", "cid", F.lit(0).alias("depth"), null.alias("rel"), null.alias("stem"), F.lit(False).alias("by_cid"), F.array().cast("array<string>").alias("above"))
    seen, depth = None, 0
    while True:
        met = frontier.join(known, F.col("cid") == F.col("k_cid"), "left")
        problem = F.when(F.col("k_cid").isNull(), MISSING).when(F.col("state") != "", F.col("state"))
        by_cid = F.coalesce("stem", "group_cid").isNull() | F.col("by_cid")
        met = met.select("root", "cid", "depth", "rel", F.coalesce("stem", "group_cid", F.lit("")).alias("stem"), by_cid.alias("by_cid"), "above", problem.alias("problem"), "links")
        met = work.save(f"met{depth}", met)
        seen = met.drop("links") if seen is None else seen.unionByName(met.drop("links"))
        depth += 1
        follow = met.filter("problem is null and size(links) > 0")
        if max_depth is not None and depth > max_depth or follow.isEmpty():
            break
        file = stem_of(F.col("stem"), F.col("by_cid"), F.col("cid"))
        out = follow.select("root", F.col("cid").alias("parent"), "rel", file.alias("file"), F.array_append("above", F.col("cid")).alias("above"), F.explode("links").alias("l"))
        parent = F.coalesce("l.rel", "rel", "file")
        stem = F.when(F.col("l.key") == "", F.col("l.rel")).otherwise(F.concat(parent, F.lit("_"), "l.key", F.lit("_")))
        way = F.struct(F.concat("file", F.lit(".json")).alias("file"), F.coalesce("l.rel", F.lit("~")).alias("by"), F.col("l.key").alias("key"), parent.alias("rel"), stem.alias("stem"), (F.col("l.key") != "").alias("by_cid"), "above")
        ways = out.select("root", F.col("l.target").alias("cid"), way.alias("way"))
        new = ways.groupBy("root", "cid").agg(F.min("way").alias("way")).join(seen.select("root", "cid"), ["root", "cid"], "left_anti")
        frontier = new.select("root", "cid", F.lit(depth).alias("depth"), "way.rel", "way.stem", "way.by_cid", "way.above")

    saved = seen.filter("problem is null").select("root", "cid", "depth", "above", "stem", "by_cid")
    held = F.array_distinct(F.regexp_extract_all("text", F.lit(LINK), 1))
    held = F.filter(held, lambda x: (x != F.col("cid")) & ~F.array_contains("above", x))
    texts = saved.join(texts, F.col("cid") == F.col("t_cid")).select(F.monotonically_increasing_id().alias("row"), "root", "cid", "depth", "stem", "by_cid", "text", held.alias("held"))
    texts = work.save("texts", texts)
    lost = work.save("lost", seen.filter("problem is not null").select("root", "cid", "depth", "problem"))
    for name in ("known", *(f"met{k}" for k in range(depth))):
        work.drop(name)

    # What is swapped in a text comes to it by the number of its row, which is shorter than two identifiers.
    refs = texts.select("row", "root", F.explode("held").alias("target"))
    to = texts.select(F.col("root").alias("s_root"), F.col("cid").alias("s_cid"), "stem", "by_cid")
    met = refs.join(to, (F.col("root") == F.col("s_root")) & (F.col("target") == F.col("s_cid")))
    maps = met.groupBy(F.col("row").alias("m_row")).agg(F.collect_list(F.struct("target", "stem", "by_cid")).alias("swaps"))
    path = F.concat(F.lit("./"), stem_of(F.col("stem"), F.col("by_cid"), F.col("cid")), F.lit(".json"))
    texts = texts.select("row", "root", "cid", "depth", path.alias("path"), "text", (F.size("held") > 0).alias("holds"))
    plain, full = texts.filter("not holds"), texts.filter("holds").join(maps, F.col("row") == F.col("m_row"), "left")
    quoted = lambda c: F.concat(F.lit('{"/":'), F.to_json(c.cast("variant")), F.lit("}"))
    name = lambda e: F.concat(F.lit("./"), stem_of(e["stem"], e["by_cid"], e["target"]), F.lit(".json"))
    swapped = F.aggregate(F.coalesce("swaps", F.array().cast("array<struct<target:string,stem:string,by_cid:boolean>>")), F.col("text"), lambda s, e: F.replace(s, quoted(e["target"]), quoted(name(e))))
    lost = lost.select("root", "cid", "depth", null.alias("path"), null.alias("text"), "problem")
    return full.select("root", "cid", "depth", "path", swapped.alias("text"), null.alias("problem")).unionByName(plain.select("root", "cid", "depth", "path", "text", null.alias("problem"))).unionByName(lost)
