"""Conversion for upload: links and addresses of files become identifiers, as each document's schema says where they are.

References are taken once, as rows; every distinct target is converted once, from the files that name no others up, and its
identifier joined back to the places that name it. Only keys and identifiers take part in the levels; a text is read when its
last reference is known.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.cid import cid_raw
from quern.functions.uploads import IMAGE, upload_references, upload_text

FAILED = "Failed to upload file "


def converted(docs: DataFrame, files: DataFrame, schemas: dict[str, object]) -> DataFrame:
    """Dir, name, schema_cid, converted (canonical text), cid, n_links and problem of each document.

    docs: dir, name (a path in the folder), schema_cid, raw; files: dir, name, content (bytes). A file that isn't JSON is a
    JSON string of its text; an image that an address names is uploaded as it is. Files are walked without a schema. A
    document with a file that isn't there, or that lies on a circle, isn't converted, nor is what needs it; `problem` says
    which file it was.
    """
    texts_of = {c: json.dumps(s) for c, s in schemas.items()}
    schema = F.create_map(*(F.lit(x) for kv in texts_of.items() for x in kv)) if texts_of else F.create_map().cast("map<string,string>")
    null = F.lit(None).cast("string")
    own = docs.select("dir", "name", F.coalesce("schema_cid", F.lit("-")).alias("as"), "raw", F.try_element_at(schema, F.col("schema_cid")).alias("schema"))
    plain = files.select("dir", "name", F.lit("").alias("as"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"), null.alias("schema"))
    refs_of = lambda df: df.select("dir", "name", "as", F.explode(upload_references("name", "raw", "schema")).alias("r")).select("dir", "name", "as", "r.*")
    by_docs, by_files = refs_of(own).checkpoint(), refs_of(plain.filter(~F.col("name").rlike(IMAGE))).checkpoint()
    wanted = by_docs.union(by_files).filter("kind = 'link'").select(F.col("dir").alias("w_dir"), F.col("file").alias("w_file")).distinct()
    is_wanted = lambda df: df.join(wanted, (F.col("dir") == F.col("w_dir")) & (F.col("name") == F.col("w_file")), "left_semi")
    refs = by_docs.union(is_wanted(by_files)).checkpoint()
    images = files.filter(F.col("name").rlike(IMAGE)).select("dir", F.lit("address").alias("kind"), F.col("name").alias("file"), cid_raw(F.col("content")).alias("cid"))
    nodes = own.unionByName(is_wanted(plain))
    pending = nodes.select("dir", "name", "as").distinct().checkpoint()

    need = lambda known: refs.join(known.select(F.col("dir").alias("k_dir"), F.col("kind").alias("k_kind"), F.col("file").alias("k_file"), "cid"), (F.col("dir") == F.col("k_dir")) & (F.col("kind") == F.col("k_kind")) & (F.col("file") == F.col("k_file"))).select("dir", "name", "as", "kind", "target", "file", "cid")
    known = need(images).checkpoint()
    still = refs.join(known, ["dir", "name", "as", "kind", "target"], "left_anti").checkpoint()
    done = None
    while True:
        ready = pending.join(still.select("dir", "name", "as").distinct(), ["dir", "name", "as"], "left_anti")
        swaps = known.join(ready, ["dir", "name", "as"], "left_semi").groupBy("dir", "name", "as").agg(F.collect_list(F.struct("kind", "target", "cid")).alias("swaps"))
        step = nodes.join(ready, ["dir", "name", "as"], "left_semi").dropDuplicates(["dir", "name", "as"]).join(swaps, ["dir", "name", "as"], "left")
        step = step.select("dir", "name", "as", upload_text("raw", "schema", "swaps").alias("converted"), F.coalesce(F.size("swaps"), F.lit(0)).alias("n_links"))
        step = step.withColumn("cid", cid_raw(F.col("converted"))).checkpoint()
        if step.isEmpty():
            break
        done = step if done is None else done.unionByName(step)
        pending = pending.join(step, ["dir", "name", "as"], "left_anti").checkpoint()
        fresh = step.filter(F.col("as") == "").select("dir", F.lit("link").alias("kind"), F.col("name").alias("file"), "cid")
        met = need(fresh).join(pending, ["dir", "name", "as"], "left_semi").checkpoint()
        if not met.isEmpty():
            known = known.unionByName(met)
            still = still.join(met, ["dir", "name", "as", "kind", "target"], "left_anti").checkpoint()
    lost = pending.join(still.groupBy("dir", "name", "as").agg(F.min("target").alias("first")), ["dir", "name", "as"])
    lost = lost.select("dir", "name", "as", null.alias("converted"), F.lit(None).cast("int").alias("n_links"), null.alias("cid"), F.concat(F.lit(FAILED), "first").alias("problem"))
    every = lost if done is None else done.withColumn("problem", null).unionByName(lost)
    return every.filter(F.col("as") != "").select("dir", "name", F.nullif(F.col("as"), F.lit("-")).alias("schema_cid"), "converted", "cid", "n_links", "problem")
