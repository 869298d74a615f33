"""Folders of properties: which files count, what is wrong with a folder, which data groups there are.

files: path (from the input's root, slashes), and what else a reader gives; folders are the first part of a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.formats import json_value, loose_cid
from quern.operators.documents import is_datagroup_root, manifest_lookup

#: What stands before a folder's name until its seed's identifier is known, and what is wrong with folders.
PENDING = "SEED_PENDING:"
NO_FOLDERS = "No valid property CID directories found. Expected directories with CID names (e.g., bafkr...) or with a seed datagroup file."
MANY_FOLDERS, BAD_JSON = "Expected exactly one property directory", "File read/parse error"


def relative_path(path: Column, root: Column | None = None) -> Column:
    """P10: slashes one way, the input's folder and what stands before it gone."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    if root is None:
        return flat
    base = F.concat(F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"))
    name = F.try_element_at(F.split(flat, "/"), F.lit(-1))
    return F.when(flat.startswith(base), F.substr(flat, F.length(base) + 1)).otherwise(name)


def in_folders(files: DataFrame, path: str = "path") -> DataFrame:
    """dir and name of files that lie right below a folder; deeper ones and those of the root have name null."""
    parts = F.split(path, "/")
    return files.withColumn("dir", F.when(F.size(parts) > 1, F.get(parts, 0))).withColumn("name", F.when(F.size(parts) == 2, F.get(parts, 1)))


def property_root(files: DataFrame, path: str = "path") -> DataFrame:
    """Files of one property, below its only folder if it has one; else the problem that there are several.

    path becomes that below the property's folder; an input whose root holds the files is the property itself.
    """
    top = F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^([^/]+)/", 1))
    tops = files.agg(F.count_distinct(top).alias("n_dirs"))  # one row
    found = files.crossJoin(F.broadcast(tops))
    inside = F.when((F.col("n_dirs") == 1) & top.isNotNull(), F.regexp_replace(path, "^[^/]+/", "")).when(F.col("n_dirs") == 0, F.col(path))
    return found.select(*(c for c in files.columns if c != path), F.coalesce(inside, F.col(path)).alias(path), F.when(F.col("n_dirs") > 1, MANY_FOLDERS).alias("problem"))


def entries(files: DataFrame, seed_cid: str) -> DataFrame:
    """property_cid, data_group_cid, path of the files to work on.

    A folder counts if its name is an identifier or if it holds the seed's file; of its files those do that are named by an
    identifier, or by the seed's.
    """
    placed = in_folders(files).filter("dir is not null")
    seeds = placed.filter(F.col("name") == f"{seed_cid}.json").select(F.col("dir").alias("seed_dir")).distinct()
    known = placed.join(seeds, F.col("dir") == F.col("seed_dir"), "left")
    group = F.regexp_extract("name", r"^(.*)\.json$", 1)
    by_name = loose_cid(F.col("dir"))
    keep = F.col("name").endswith(".json") & (loose_cid(group) | (~by_name & (group == seed_cid))) & (by_name | F.col("seed_dir").isNotNull())
    return known.filter(keep).select(F.when(by_name, F.col("dir")).otherwise(F.concat(F.lit(PENDING), "dir")).alias("property_cid"), group.alias("data_group_cid"), "path")


def structure_errors(files: DataFrame, seed_cid: str) -> DataFrame:
    """Dir, error of every folder that has one; a row with a null dir where no folder counts at all.

    An empty folder is a row with its name and a slash at the end.
    """
    placed = in_folders(files).filter("dir is not null")
    group = F.regexp_extract("name", r"^(.*)\.json$", 1)
    per = placed.groupBy("dir").agg(F.count_if(F.coalesce("name", F.lit("x")) != "").alias("n"), F.count_if(F.col("name").endswith(".json") & (loose_cid(group) | (group == seed_cid))).alias("good"), F.max(F.coalesce(F.col("name") == f"{seed_cid}.json", F.lit(False))).alias("seeded"))
    by_name = loose_cid(F.col("dir"))
    text = F.when(by_name & (F.col("n") == 0), F.concat(F.lit("Property directory "), "dir", F.lit(" is empty"))).when(by_name & (F.col("good") == 0), F.concat(F.lit("No valid data group CID files found in "), "dir"))
    found = per.filter(by_name | F.col("seeded"))
    none = found.agg(F.count(F.lit(1)).alias("k")).filter("k = 0").select(F.lit(None).cast("string").alias("dir"), F.lit(NO_FOLDERS).alias("error"))
    return found.select("dir", text.alias("error")).filter("error is not null").unionByName(none)


def parsed(files: DataFrame, raw: str = "raw") -> DataFrame:
    """The files with `parsed` and, where the text isn't JSON, `error`; none is lost."""
    return files.withColumn("parsed", json_value(F.col(raw))).withColumn("error", F.when(F.col("parsed").isNull(), BAD_JSON))


def datagroups(files: DataFrame, manifest: DataFrame, raw: str = "raw") -> DataFrame:
    """Label, property and data group identifiers of the roots of data groups, at any depth.

    The label names the data group in the manifest (name, cid, type); the property is the folder that the file is in.
    """
    roots = files.filter(is_datagroup_root(F.col(raw))).withColumn("label", F.get_json_object(raw, "$.label"))
    groups = manifest.filter("type = 'dataGroup'").select("name", "cid", "type")
    folder = F.regexp_extract("path", "(?:^|/)([^/]+)/[^/]+$", 1)
    found = manifest_lookup(roots.select("path", "label"), groups)
    return found.select("path", "label", F.when(folder != "", folder).alias("property"), F.col("cid").alias("data_group_cid"))


def required_files(files: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """R-V: per dir and wanted stem the file that serves, whatever the case of its name; a page is preferred to JSON."""
    stem, ext = F.lower(F.regexp_extract("name", r"^(.*)\.[^.]+$", 1)), F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    rank = F.when(ext.isin("html", "htm"), 0).when(ext == "json", 1).when(ext == "csv", 2)
    found = files.withColumn("stem", stem).withColumn("rank", rank).filter(F.col("stem").isin(*wanted) & F.col("rank").isNotNull())
    return found.groupBy("dir", "stem").agg(F.min_by("name", F.struct("rank", "name")).alias("name"))


#: Seed files, which no script reads as its input.
SEED_FILES = ("address.json", "parcel.json", "unnormalized_address.json", "property_seed.json")


def script_inputs(files: DataFrame) -> DataFrame:
    """R-N: dir, name, target of the files that scripts get: seeds and CSVs as they are, and one page, else one JSON file, as input."""
    page, doc = F.col("name").rlike(r"(?i)\.html?$"), F.col("name").rlike(r"(?i)\.json$") & ~F.col("name").isin(*SEED_FILES)
    first = files.filter(page | doc).groupBy("dir").agg(F.min_by(F.struct("name", page.alias("page")), F.struct(~page, "name")).alias("f"))
    chosen = first.select("dir", F.col("f.name").alias("name"), F.when(F.col("f.page"), "input.html").otherwise("input.json").alias("target"))
    same = files.filter(F.col("name").isin(*SEED_FILES) | F.col("name").rlike(r"(?i)\.csv$")).select("dir", "name", F.col("name").alias("target"))
    return chosen.unionByName(same)


def used_names(groups: DataFrame, relationships: DataFrame) -> DataFrame:
    """Dir, name of files that count as used: relationships that a data group links to, and what these link to.

    groups: dir, name (a link of a data group); relationships: dir, name, from, to (its ends).
    """
    path = lambda c: F.regexp_replace(c, r"^(\./)+", "")
    linked = groups.select("dir", path("name").alias("name")).distinct()
    met = relationships.join(linked, ["dir", "name"], "left_semi")  # J3
    ends = met.select("dir", F.explode(F.array(path("from"), path("to"))).alias("name")).filter("name is not null")
    return linked.union(ends).distinct()


def staged(files: DataFrame) -> DataFrame:
    """K-13: files by stage (media or json) below their property; a property with a file of neither kind stages nothing.

    files: property, path. Returns those columns, stage and staged (the new path), or stage null and the failure of all.
    """
    name = F.try_element_at(F.split("path", "/"), F.lit(-1))
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    stage = F.when(ext == "json", "json").when(ext != "", "media")
    kinds = files.withColumn("stage", stage)
    failed = kinds.agg(F.coalesce(F.max(F.col("stage").isNull()), F.lit(False)).alias("failed"))  # one row
    out = kinds.crossJoin(F.broadcast(failed))
    return out.select(*files.columns, F.when(~F.col("failed"), F.col("stage")).alias("stage"), F.when(~F.col("failed"), F.concat_ws("/", "property", "stage", "path")).alias("staged"))
