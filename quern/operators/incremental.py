"""Validation that remembers: errors kept by content and schema, so that a later run judges only what is new.

A result is keyed by the document's identifier and that of its schema with all references resolved, so a change in either,
or in a schema that is referred to, makes a new key. Results are written run by run below a folder; a run that fails leaves
none, and one that is repeated adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quern.functions.canon import cid_v1
from quern.functions.cid import cid_raw
from quern.operators import validate

RESULTS = "v_cid string, v_schema string, errors array<struct<path:string,message:string>>, run int"


def _results(docs: DataFrame, folder: str) -> DataFrame:
    spark = docs.sparkSession
    try:
        return spark.read.schema(RESULTS).parquet(f"{folder}/results")
    except AnalysisException:
        return spark.createDataFrame([], RESULTS)


def validated(docs: DataFrame, schemas: dict[str, object], folder: str, schema_col: str = "schema_cid", doc_col: str = "raw") -> tuple[DataFrame, int]:
    """The rows of docs with their errors, and how many rows this run had a new result for.

    Documents that hold links depend on other documents too, so they are judged each time and not kept.
    """
    keys = {cid: cid_v1((text or "none").encode()) for cid, text in validate.ready_schemas(schemas).items()}
    named = F.create_map(*(F.lit(x) for kv in keys.items() for x in kv)) if keys else F.create_map().cast("map<string,string>")
    rows = docs.withColumn("v_cid", F.coalesce(cid_raw(F.col(doc_col)), F.lit("none"))).withColumn("v_schema", F.coalesce(F.try_element_at(named, F.col(schema_col)), F.lit("unknown")))
    linked = F.coalesce(F.col(doc_col).rlike(validate.LINK), F.lit(False))
    plain, before = rows.filter(~linked), _results(docs, folder)
    new = plain.join(before.select("v_cid", "v_schema"), ["v_cid", "v_schema"], "left_anti")
    judged, last = Observation(), before.agg(F.max("run")).first()[0]
    # Of rows with the same content one is judged for all.
    once = new.observe(judged, F.count(F.lit(1)).alias("n")).select("v_cid", "v_schema", schema_col, doc_col).distinct()
    found = validate.validate(once, schemas, schema_col, doc_col).select("v_cid", "v_schema", "errors")
    run = 0 if last is None else last + 1
    found.dropDuplicates(["v_cid", "v_schema"]).write.mode("overwrite").parquet(f"{folder}/results/run={run}")
    known = _results(docs, folder).drop("run")
    same = plain.join(known, ["v_cid", "v_schema"]).select(*docs.columns, "errors")
    others = validate.validate(rows.filter(linked), schemas, schema_col, doc_col).select(*docs.columns, "errors")
    return same.unionByName(others), judged.get["n"]
