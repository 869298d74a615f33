"""Runs that remember what they judged, and what a pass counts while it works."""

from pyspark.sql import functions as F

from quern.operators import entities, incremental, stategraph
from quern.operators.validate import validate
from quern.streaming import progress

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_only_what_is_new_is_judged(spark, tmp_path):
    folder = f"file://{tmp_path}/kept"
    inner, outer = {"type": "integer"}, {"type": "object", "properties": {"n": {"type": "string", "cid": "inner"}}}
    schemas = {"outer": outer, "inner": inner}
    rows = [(k, '{"n":%s}' % ("1" if k % 3 else '"x"') + " " * (k % 10), "outer") for k in range(60)] + [(60, None, "outer"), (61, "{", "outer"), (62, "1", "nowhere"), (63, '{"n":{"/":"./a"}}', "outer")]
    docs = spark.createDataFrame(rows, "k int, raw string, schema_cid string").withColumn("v", F.lit(1))
    full = {r.k: r.errors for r in validate(docs, schemas).collect()}
    as_map = lambda df: {r.k: r.errors for r in df.collect()}
    first, n = incremental.validated(docs.filter("k < 30"), schemas, folder)
    assert n == 30 and as_map(first) == {k: e for k, e in full.items() if k < 30}
    again, n = incremental.validated(docs, schemas, folder)
    assert n == 3 and as_map(again) == full and again.columns == [*docs.columns, "errors"]  # 30 to 59 repeat known contents; 60, 61 and 62 are new, 63 holds a link
    assert incremental.validated(docs, schemas, folder)[1] == 0
    # A schema that another one refers to has changed: all of its documents are judged anew.
    changed, n = incremental.validated(docs, schemas | {"inner": {"type": "string"}}, folder)
    assert n == 62 and as_map(changed) == {r.k: r.errors for r in validate(docs, schemas | {"inner": {"type": "string"}}).collect()}
    assert incremental.validated(docs.limit(0), schemas, folder)[1] == 0


def test_counts_of_one_pass(spark):
    kind = F.col("event_type")
    rows = spark.read.parquet(EVENTS).withColumn("state", F.when(kind == "view", "processed").when(kind == "error", "error").when(kind == "click", "skipped")).withColumn("all", F.lit(1))
    want = entities.run_totals(rows, "all").first().asDict()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one pass", "")
    passed, seen = progress.counted(rows)
    passed.write.format("noop").mode("overwrite").save()
    jobs = tracker.getJobIdsForGroup("one pass")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1 and seen.get == {k: want[k] for k in ("processed", "error", "skipped", "total")}


def test_samples_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(10 * (k + 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    samples = progress.Samples()
    spark.streams.addListener(samples)
    try:
        run = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.format("noop").queryName("upload").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(samples)
    got = samples.table(spark).filter("phase = 'upload'").orderBy("done").collect()
    assert len(got) == 3 and got[-1].done == 60


def test_flow_graphs_odd(spark):
    rows = [("a", None), ("b", "{}"), ("c", '{"starts_at":"A","states":[]}'), ("d", '{"starts_at":"A","states":{"A":{"next":"A","next_on_timeout":"E"},"E":{"next":""}}}'), ("e", '{"states":{"A":7}}'), ("f", '"x"'), ("d2", '{"starts_at":"A","states":{"A":{"next":"B"},"B":{}, "E":{"next":"E"}}}')]
    got = {r.flow: r.problems for r in stategraph.flow_graph_problems(spark.createDataFrame(rows, "flow string, raw string")).collect()}
    lost = 'starts_at references unknown state "undefined"'
    assert got == {"a": [stategraph.NOT_JSON], "b": [stategraph.NO_STATES, lost], "c": [stategraph.NO_STATES, 'starts_at references unknown state "A"'], "d": [], "e": [lost, 'State "A" is never reached'], "f": [stategraph.NOT_JSON], "d2": ['State "E" is never reached', 'State "E" leads to no end']}
