"""Sets of documents: manifest lookup, classification, seeds, links between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.functions.formats import json_value, normal_path
from quern.functions.lets import let

#: Files that need no reference to them.
ALWAYS_USED = ("parcel.json", "property_seed.json", "unnormalized_address.json")


def is_datagroup_root(raw: Column) -> Column:
    """Exactly the keys label (a text) and relationships (an object or array)."""
    return F.coalesce(
        (F.array_sort(F.json_object_keys(raw)) == F.array(F.lit("label"), F.lit("relationships")))
        & F.get_json_object(raw, "$.relationships").rlike(r"^\s*[\[{]")
        & (F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), "$.label", "variant")) == "STRING"),
        F.lit(False),
    )


def manifest_lookup(labels: DataFrame, manifest: DataFrame, column: str = "label", kind: str = "dataGroup") -> DataFrame:
    """The entry of a label as it is, else with _ for spaces, else with spaces for _; an entry of another kind ends the search.

    The manifest is a dimension table; adaptive execution broadcasts it if its measured size allows.
    """
    out = labels
    forms = {"as_is": F.col(column), "under": F.replace(F.col(column), F.lit(" "), F.lit("_")), "spaced": F.replace(F.col(column), F.lit("_"), F.lit(" "))}
    for name, form in forms.items():
        entry = manifest.select(F.col("name").alias(f"{name}_key"), F.struct("cid", "type").alias(name))
        out = out.join(entry, form == F.col(f"{name}_key"), "left").drop(f"{name}_key")
    hit = F.coalesce(*forms)
    return out.withColumn("cid", F.when(hit["type"] == kind, hit["cid"])).drop(*forms)


def seed_gate(files: DataFrame, failed: DataFrame) -> DataFrame:
    """Files wait for their folder's seed; those of a folder whose seed failed are skipped."""
    return files.join(failed.select("dir").distinct(), "dir", "left_anti")


def property_ids(files: DataFrame) -> DataFrame:
    """Every file has its folder's seed identifier, else the folder's name."""
    seed = F.max(F.when(F.col("is_seed"), F.col("cid"))).over(W.partitionBy("dir"))
    return files.withColumn("property_cid", F.coalesce(seed, F.col("dir")))


#: How a file that nothing names is reported.
UNUSED, NOT_REFERENCED = "Unused data JSON file detected: ", " is not referenced by any relationship included in the datagroup."


def relationship_shaped(raw: Column) -> Column:
    """F16: JSON whose from and to are links to files of the folder, whatever else it holds."""

    def end(v: Column, name: str) -> Column:
        return (F.schema_of_variant(F.try_variant_get(v, f"$.{name}['/']", "variant")) == "STRING") & F.try_variant_get(v, f"$.{name}['/']", "string").startswith("./")

    return let(json_value(raw), lambda v: F.coalesce(end(v, "from") & end(v, "to"), F.lit(False)))


def unused_files(files: DataFrame, links: DataFrame, raw: str | None = None) -> DataFrame:
    """Files that no link of the same folder names, but for those that need none. links: dir, name.

    raw: the files' texts, if there are any; unused relationships are let pass, and `error` says what is wrong.
    """
    used = links.select("dir", "name").distinct()
    found = files.filter(~F.col("name").isin(*ALWAYS_USED)).join(used, ["dir", "name"], "left_anti")
    return found if raw is None else found.filter(~relationship_shaped(F.col(raw))).withColumn("error", F.concat(F.lit(UNUSED), "name", F.lit(NOT_REFERENCED)))


def broken_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links whose path, normalised, is no file of the folder."""
    return links.withColumn("name", normal_path(F.col("ref"))).join(files.select("dir", "name").distinct(), ["dir", "name"], "left_anti")


def structure_problems(files: DataFrame) -> DataFrame:
    """Per folder the first structural problem, null if it has none."""
    per = files.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name").endswith(".json")).alias("n_json"), F.count_if(F.col("is_seed")).alias("n_seed"))
    problem = F.when(F.col("n_json") == 0, "no documents").when(F.col("n_seed") > 1, "more than one seed")
    return per.withColumn("problem", problem)
