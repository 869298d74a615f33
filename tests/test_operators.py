import zipfile

from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.functions import canon, cid, formats, html, multiformats, urls
from quern.operators import dag, errors, graph, owners, ranks, validate
from quern.sources import files
from quern.streaming import log

HEX, CID = "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9", "bafkreifzjut3te2nhyekklss27nh3k72ysco7y32koao5eei66wof36n5e"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_identifier_golden_vector(spark):
    assert one(spark, cid.cid_raw(F.lit("hello world")), cid.cid_of_hash(F.lit("0x" + HEX)), cid.hash_of_cid(F.lit(CID)), cid.hash_of_cid(F.lit("Qm" + "a" * 44))) == (CID, CID, HEX, None)


def test_canonical_json():
    cases = {1e21: "1e+21", 1e-7: "1e-7", 333333333.33333329: "333333333.3333333", 0.1: "0.1", -0.0: "0", 100.0: "100", 123456789012345680000: "123456789012345680000"}
    assert {canon.number_text(k) for k in cases} == set(cases.values())
    assert canon.canonical({"z": 1, "דּ": 2, "\U0001f600": [True, None]}) == '{"z":1,"\U0001f600":[true,null],"דּ":2}'
    assert canon.sort_links([{"/": "b"}, 1, {"/": "a"}]) == [{"/": "a"}, {"/": "b"}, 1]
    assert canon.cid_v1(b"hello world") == CID


def test_formats(spark):
    uri = [one(spark, formats.uri_ok(F.lit(x)))[0] for x in ("https://a.b/c?d=1", "https://u@a.b", "ftp://a.b", "https://localhost", "http://a.b c")]
    assert uri == [True, True, False, False, False]
    money = [one(spark, formats.currency_ok(F.lit(x).cast("double")))[0] for x in (0.0, 1.25, 1.255, -1.0, float("nan"), float("inf"))]
    assert money == [True, True, False, False, False, False]
    assert one(spark, formats.last_segment(F.lit("/a/b/")), formats.last_segment(F.lit("")), formats.csv_field(F.lit('a,"b'))) == ("b", "root", '"a,""b"')
    assert one(spark, formats.ipfs_uri_ok(F.lit("ipfs://" + CID)), formats.ipfs_uri_ok(F.lit("./x")), formats.ipfs_uri_ok(F.lit("./"))) == (True, True, False)


def test_urls(spark):
    got = one(spark, urls.url_request(F.lit("https://a.b/c/?x=1&y=%26&x=2")), urls.swap_first_uuid(F.lit("p/0F8fad5b-d9cb-469f-a165-70867728950e/q"), F.lit("7")))
    assert got == (Row(url="https://a.b/c", method="GET", multiValueQueryString={"x": ["1", "2"], "y": ["&"]}), "p/7/q")
    assert one(spark, urls.construct_url(F.lit("https://a.b/c?z=1"), F.from_json(F.lit("{}"), "map<string,array<string>>")))[0] == "https://a.b/c"


def test_html():
    assert html.clean('<p style="x" id=a>a<script>var t="</p>";</script>&amp;b<br/></p><link rel="stylesheet" href="x">') == '<!DOCTYPE html><p id="a">a&amp;b<br></p>'


def test_error_report(spark):
    rows = [(1, "a", "/property_has_address/to/x", "must match a schema in anyOf"), (2, "a", "/property_has_address/to/y", "must be string"), (3, "a", "/property_has_address/to/z", "must be integer"), (4, "b", "/h_has_fact_sheet/value", "bad"), (5, "c", "/t/value", "bad"), (6, "c", "/t", "must be null"), (7, "d", "/property_has_address/from", "must match a schema in anyOf")]
    got = errors.post_process(spark.createDataFrame(rows, "seq long, file_path string, error_path string, error_message string")).orderBy("place").collect()
    assert [(r.seq, r.error_path) for r in got] == [(5, "/t/value"), (2, errors.ADDRESS_PATH)]


def test_graph_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "src string, dst string")
    got = {(r.node, r.depth) for r in graph.reach(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}


def test_linked_identifiers(spark):
    docs = [("a", '{"note":"./b","to":{"/":"./b"}}'), ("b", "{ }"), ("x", '{"/":"./y"}'), ("y", '{"/":"./x"}'), ("lost", '{"/":"./gone"}'), ("page", '{"ipfs_url":"./i.html"}'), ("text", "not JSON")]
    docs = spark.createDataFrame([("d", *x) for x in docs], "dir string, name string, text string")
    got = {r.name: r.cid for r in graph.linked_cids(docs, spark.createDataFrame([("d", "bafym")], "dir string, media_cid string")).collect()}
    b = canon.cid_v1(b"{}")
    assert got == {"b": b, "a": canon.cid_v1(f'{{"note":"./b","to":{{"/":"{b}"}}}}'.encode()), "x": None, "y": None, "lost": None, "page": canon.cid_v1(b'{"ipfs_url":"ipfs://bafym"}'), "text": canon.cid_v1(b"not JSON")}


def test_ranks_of_wide_rows(spark):
    # Far more rows than ranges are sampled from, a key that a third of them share, nulls.
    rows = spark.range(0, 400_000, 1, 16).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 1000 == 1, None).otherwise((F.col("id") * 7919) % 100_003).alias("k"), F.repeat(F.lit("x"), 50).alias("wide"), (F.col("id") % 2).alias("g"))
    placed = ranks.ranked(rows, ["k"]).agg(F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.count_if(F.col("k").isNull() & (F.col("rank") >= 400))).first()
    assert tuple(placed) == (400_000, 0, 399_999, 0)
    steps = ranks.ranked(rows, ["k"]).selectExpr("k", "lag(k) over (order by rank) AS before").filter("k < before or (k is null and before is not null)")
    assert steps.count() == 0
    per = ranks.ranked(rows, ["k"], ["g"]).groupBy("g").agg(F.count_distinct("rank"), F.max("rank"))
    assert {tuple(r) for r in per.collect()} == {(0, 200_000, 199_999), (1, 200_000, 199_999)}


def test_owners(spark):
    rows = spark.createDataFrame([(1, "Acme LLC"), (2, "Ann & Lee"), (3, "Cooper Bob Ray"), (4, ""), (5, None), (6, "Solo")], "seq int, name string")
    got = [(r.kind, r.first, r.middle, r.last) for r in owners.classify(rows).orderBy("seq").collect()]
    assert got == [("company", None, None, None), ("person", "Ann", None, "Lee"), ("person", "Cooper", "Bob", "Ray"), ("invalid", None, None, None), ("invalid", None, None, None), ("invalid", None, None, None)]


def test_schemas(spark):
    schemas = {"leaf": {"type": "string", "minLength": 2, "format": "date"}, "root": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": ["string", "null"], "cid": "leaf"}, "c": {"enum": [1, 2]}, "d": {"oneOf": [{"type": "number"}, {"type": "integer"}]}}, "additionalProperties": False}, "loop": {"properties": {"x": {"type": "string", "cid": "loop"}}}}
    rows = [(1, '{"a":null,"b":1}', "root"), (2, '{"a":"2024-13-01","c":3,"d":1}', "root"), (3, "{", "root"), (4, "{}", "none"), (5, '{"x":{"x":1}}', "loop"), (6, None, "root")]
    got = {r.k: [tuple(e) for e in r.errors] for r in validate.validate(spark.createDataFrame(rows, "k int, raw string, schema_cid string"), schemas).collect()}
    assert got[1] == [("/", "unexpected property 'b'")] and got[5] == []
    assert got[2] == [("/", "missing required property 'b'"), ("/a", "must be null"), ("/a", "must be a valid ISO date in YYYY-MM-DD format"), ("/a", "must match a schema in anyOf"), ("/c", "must be one of: 1, 2"), ("/d", "must match exactly one schema in oneOf")]
    assert got[3] == got[6] == [("", "File read/parse error")] and got[4] == [("", "Validation error: Failed to resolve schema CID")]
    problem = lambda raw: one(spark, validate.datagroup_schema_problem(F.lit(raw)))[0]
    assert problem('{"type":"object","properties":{"label":{},"relationships":[]}}') is None and problem("3") == problem("{") == "Schema must be a valid JSON object"
    assert problem("[]") == 'Data group schema must describe an object (type: "object")' and problem('{"type":"object","properties":{"label":0,"relationships":1}}') == 'Data group schema must have a "label" property'


def test_archives_and_records(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("top/a.json", '{"label":"County","relationships":{}}')
        z.writestr("top/sub/b.json", "{")
    rows = files.read_archives(spark, f"{tmp_path}/*.zip")
    assert sorted((r.entry, bytes(r.content)[:1]) for r in rows.collect()) == [("a.json", b"{"), ("sub/b.json", b"{")]
    packed = files.write_archives(rows.select(F.lit("p").alias("property_cid"), "entry", "content")).first()
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "q.bin").write_bytes(bytes(packed.archive))
    assert files.read_archives(spark, f"{tmp_path}/out").count() == 2
    table = spark.createDataFrame([("a,b", 'x"y'), ("line\nbreak", None)], "k string, v string")
    files.write_records(table.coalesce(1), f"{tmp_path}/csv")
    assert {tuple(r) for r in files.read_records(spark, f"{tmp_path}/csv").collect()} == {("a,b", 'x"y'), ("line\nbreak", None)}


def test_streams(spark, tmp_path):
    spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("l", 1, "c")], "key string, block int, v string").write.json(f"{tmp_path}/log")
    stream = log.streaming_latest(spark.readStream.schema("key string, block int, v string").json(f"{tmp_path}/log"), ["key"], "v", ["block"])
    run = stream.writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("latest").collect()} == {("k", "b"), ("l", "c")}
    spark.createDataFrame([("t1", "pending"), ("t2", "success"), ("t1", "failed")], "tx string, status string").write.json(f"{tmp_path}/tx")
    polled = log.poll_status(spark.readStream.schema("tx string, status string").json(f"{tmp_path}/tx"))
    run = polled.writeStream.outputMode("append").format("memory").queryName("polled").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("polled").collect()} == {("t1", "failed"), ("t2", "success")}


def test_keywords_and_formats():
    of = lambda v, s: list(validate.errors_of(v, s))
    assert of({"a": 1}, {"definitions": {"t": {"type": "string"}}, "properties": {"a": {"$ref": "#/definitions/t"}}}) == [("/a", "must be string")]
    assert of([1, 2, 1], {"uniqueItems": True, "contains": {"const": 3}})[0] == ("", "must NOT have duplicate items (items ## 0 and 2 are identical)")
    assert of({"x1": "a", "y": 2}, {"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}) == [("", "unexpected property 'y'"), ("/x1", "must be integer")]
    assert of(5, {"multipleOf": 2, "not": {"type": "integer"}}) == [("", "must be multiple of 2"), ("", "must NOT be valid")]
    assert of({"k": 1}, {"if": {"required": ["k"]}, "then": {"required": ["z"]}}) == [("", "missing required property 'z'"), ("", 'must match "then" schema')]
    assert of({"k": 1}, {"dependencies": {"k": ["z"]}, "propertyNames": {"maxLength": 0}}) == [("", "must have property z when property k is present"), ("", "must NOT have more than 0 characters"), ("", "property name must be valid")]
    assert of([1, "x"], {"items": [{"type": "string"}], "additionalItems": False}) == [("", "must NOT have more than 1 items"), ("/0", "must be string")]
    good = {"ipv6": "::1", "hostname": "a-b.c", "json-pointer": "/a~0/b", "relative-json-pointer": "1/a", "regex": "a+", "cid": CID, "ipfs_uri": "ipfs://" + CID, "date": "2024-02-29", "date-time": "2024-02-29T10:00:00Z", "uuid": "0f8fad5b-d9cb-469f-a165-70867728950e"}
    bad = {"ipv6": "1.2.3.4", "hostname": "-a", "json-pointer": "a", "relative-json-pointer": "/a", "regex": "(", "cid": CID[:-1], "ipfs_uri": "ipfs://" + "Qm" + "a" * 44, "date": "2023-02-29", "date-time": "2024-02-29", "uuid": "x"}
    assert all(not of(v, {"format": k}) for k, v in good.items()) and all(of(v, {"format": k}) == [("", validate.FORMAT_MESSAGES[k])] for k, v in bad.items())
    assert validate.report("", "must be string", {"/": "./a"}) == ("/", "File ./a does not exist or is not a valid JSON file.")


def test_identifiers_of_any_base():
    v0 = "QmYwAPJzv5CZsnA625s3Xf2nemtYgPpHdWEz79ojWnPbdG"
    assert multiformats.parse_cid(v0).version == 0 and multiformats.parse_cid(CID).digest.hex() == HEX
    cid = multiformats.parse_cid(CID)
    z = "z" + multiformats.base58_text(bytes([1, 0x55, 0x12, 0x20]) + cid.digest)
    assert multiformats.parse_cid(z) == cid and multiformats.cid_text(0x55, cid.digest) == CID
    assert [multiformats.parse_cid(x) for x in ("", "b", CID + "a", CID.upper(), "hello", v0[:-1])] == [None] * 6


def test_nodes_golden_vectors():
    # Identifiers that other tools give to these files, and to an empty directory.
    assert canon.cid_v0(b"hello world") == "Qmf412jQZiuVUtdgnB36FXFX7xg5V6KEbSJ4dpQuhkLyfD" and canon.cid_v0(b"hello world\n") == "QmT78zSuBmuS4z925WZfrqQ1qHaJ56DQaTfyMUF7F8ff5o"
    assert canon.directory_cid({}) == "bafybeiczsscdsbs7ffqz55asqdf3smv6klcw3gofszvwlyarci47bgf354"


def test_media_folders(spark):
    rows = spark.createDataFrame([("d", "b.PNG", b"2"), ("d", "a.html", b"1"), ("d", "x.json", b"{}"), ("e", "x.json", b"{}")], "dir string, name string, content binary")
    assert [tuple(r) for r in dag.media_cids(rows).collect()] == [("d", canon.directory_cid({"a.html": b"1", "b.PNG": b"2"}), None)]
