"""Fact sheets: the class of every linked file, a relationship from each to the fact sheet, and data groups that list them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The file that all point to, and what is in it.
SHEET = "fact_sheet.json"
#: A guess: links that a task joins and sums up, far below what fits its memory.
TASK_ROWS = 200_000
COMMAND = "npx -y {tool}@{version} generate --input ${{inputDir}} --output ${{outputDir}} --inline-js --inline-css --inline-svg"


def sheet_text(tool: str, version: Column) -> Column:
    """K-17: the fact sheet's document; the command is null where the tool's version isn't known."""
    before, after = COMMAND.format(tool=tool, version="\u0001").split("\u0001")
    command = F.concat(F.lit(before), version, F.lit(after))
    known = F.to_json(F.struct(F.lit("./index.html").alias("ipfs_url"), command.alias("full_generation_command")))
    return F.when(version.isNotNull(), known).otherwise('{"ipfs_url":"./index.html","full_generation_command":null}')


def class_files(links: DataFrame, relationships: DataFrame, group_schemas: DataFrame, relationship_schemas: DataFrame, titles: DataFrame) -> DataFrame:
    """Dir, file, class of every file that a data group's relationships have at an end, the first class that it has.

    links: dir, seq, slot, file, schema_cid (of the data group); relationships: dir, file, from, to; group_schemas:
    schema_cid, slot, relationship_cid; relationship_schemas: relationship_cid, from_cid, to_cid; titles: cid, title. The
    last three are as many as a manifest's schemas and are broadcast: their few keys would gather all links in a few tasks.
    Slots of fact sheets are skipped.
    """
    some = links.filter(~F.col("slot").endswith("fact_sheet")).join(F.broadcast(group_schemas), ["schema_cid", "slot"]).join(F.broadcast(relationship_schemas), "relationship_cid")
    # Rows a task are bounded: merged by compressed size, which is small here, tasks would grow with the input.
    parts = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // TASK_ROWS))
    ends = some.repartition(parts, "dir", "file").join(relationships.repartition(parts, "dir", "file"), ["dir", "file"])
    path = lambda c: F.substr(F.col(c), F.lit(3))
    sides = F.array(F.struct(F.lit(0).alias("side"), path("from").alias("file"), F.col("from_cid").alias("cid")), F.struct(F.lit(1).alias("side"), path("to").alias("file"), F.col("to_cid").alias("cid")))
    each = ends.select("dir", "seq", F.explode(sides).alias("e")).select("dir", "seq", "e.side", "e.file", "e.cid")
    # Plain minima, which tasks keep by key, come first; rows are sorted only for what is left of them.
    first = each.repartition(parts, "dir", "file").groupBy("dir", "file", "side", "cid").agg(F.min("seq").alias("seq")).join(F.broadcast(titles), "cid")
    at = F.struct("seq", "side")
    return first.groupBy("dir", "file").agg(F.min_by("title", at).alias("class"), F.min(at).alias("at"))


def sheet_name(file: Column) -> Column:
    return F.concat(F.lit("relationship_"), F.regexp_replace(file, r"\.json", ""), F.lit("_to_fact_sheet.json"))


def sheet_relationships(classes: DataFrame) -> DataFrame:
    """R-F: dir, class, name, content of the relationship from each file to the fact sheet."""
    link = lambda c: F.struct(c.alias("/"))
    content = F.to_json(F.struct(link(F.concat(F.lit("./"), "file")).alias("from"), link(F.lit(f"./{SHEET}")).alias("to")))
    return classes.select("dir", "class", sheet_name(F.col("file")).alias("name"), content.alias("content"))


def sheet_slots(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """Dir, group, slot, files: what each data group lacks, for every class of its folder the links in order.

    groups: dir, group, slots (the names of the slots that it has). A class's files are as many as a folder's.
    """
    per = classes.groupBy("dir", "class").agg(F.array_sort(F.collect_list(F.struct("at", sheet_name(F.col("file")).alias("file")))).alias("all"))
    per = per.select("dir", F.concat("class", F.lit("_has_fact_sheet")).alias("slot"), F.transform("all", lambda x: F.concat(F.lit("./"), x["file"])).alias("files"))
    return groups.join(per, "dir").filter(~F.array_contains("slots", F.col("slot"))).select("dir", "group", "slot", "files")
