"""What keeps queries whole and in bounds on larger tables."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from quern.functions import canon, cid, dagcodecs, formats
from quern.functions.canon import cid_v1
from quern.functions.multiformats import _base32_bytes, base32_text, varint
from quern.operators import closure, dag, factsheets, graph, incremental, stategraph, submit, upload, validate
from quern.session import Tables, table
from quern.sources import files

SF = "/root/testdata/sf0.001"


def times(df, part):
    """How often a part stands in the analyzed plan; within a lambda it would be computed once more for each element."""
    return df._jdf.queryExecution().analyzed().toString().count(part)


def test_identifiers_compute_a_value_once(spark):
    rows = spark.createDataFrame([("x",)], "t string")
    assert times(rows.select(cid.hash_of_cid(cid.cid_raw(F.col("t"))).alias("h")), "sha2(") == 1
    assert rows.select(cid.hash_of_cid(cid.cid_raw(F.col("t"))) == F.sha2("t", 256)).first()[0]
    bad = ["", "b", "b" + "a" * 58, "z" * 59, "bafkreifzjut3te2nhyekklss27nh3k72ysco7y32koao5eei66wof36n5f", None]
    found = spark.createDataFrame([(x,) for x in bad], "t string").select(cid.hash_of_cid(F.col("t")), cid.cid_of_hash(F.col("t"))).collect()
    assert all(tuple(r) == (None, None) for r in found)


def test_problems_of_identifiers_compute_a_value_once(spark):
    rows = spark.createDataFrame([("x",)], "t string")
    made = F.concat(F.lit("b"), F.sha2("t", 256))
    for check in (formats.cid_problem, formats.ipfs_uri_ok, formats.strict_cid):
        assert times(rows.select(check(made).alias("p")), "sha2(") == 1
    cases = {None: "CID must be a non-empty string", "baaaaaaa": "Invalid CID format", "bafkreifzjut3te2nhyekklss27nh3k72ysco7y32koao5eei66wof36n5e": None, "bafkreifzjut3te2nhyekklss27nh3k72ysco7y32koao5eei66wof36n5": "Invalid CID format", "bafkrgqaa": "Expected SHA-256 hash (0x12), got hash algorithm 0x13"}
    found = spark.createDataFrame([(x,) for x in cases], "t string").select("t", formats.cid_problem(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in found} == cases


def test_contract_hashes_compute_a_value_once(spark):
    rows = spark.createDataFrame([("x",)], "t string")
    found = submit.item_hashes(rows.select(F.concat(F.lit("."), cid.cid_raw(F.col("t"))).alias("property_cid"), F.lit("bafybad").alias("data_cid")), ("property_cid", "data_cid"))
    assert times(found, "sha2(") == 1
    assert found.select("property_hash", "data_hash").first() == ("0x" + hashlib.sha256(b"x").hexdigest(), None)


def test_links_are_not_gathered_by_schema(spark):
    links = spark.createDataFrame([("d", 2, "a", "r2", "g"), ("d", 1, "b", "r1", "g"), ("d", 3, "x_fact_sheet", "r3", "g")], "dir string, seq long, slot string, file string, schema_cid string")
    relationships = spark.createDataFrame([("d", "r1", "./p.json", "./t.json"), ("d", "r2", "./t.json", "./q.json"), ("d", "r3", "./z.json", "./z.json")], "dir string, file string, from string, to string")
    groups = spark.createDataFrame([("g", "a", "1"), ("g", "b", "2"), ("g", "x_fact_sheet", "1")], "schema_cid string, slot string, relationship_cid string")
    ends = spark.createDataFrame([("1", "c1", "c2"), ("2", "c2", "c3")], "relationship_cid string, from_cid string, to_cid string")
    titles = spark.createDataFrame([("c1", "one"), ("c2", "two"), ("c3", "three")], "cid string, title string")
    found = factsheets.class_files(links, relationships, groups, ends, titles)
    assert {r.file: (r["class"], tuple(r.at)) for r in found.collect()} == {"p.json": ("two", (1, 0)), "t.json": ("three", (1, 1)), "q.json": ("two", (2, 1))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(dir" in plan and not any(f"hashpartitioning({c}" in plan for c in ("schema_cid", "slot", "relationship_cid", "cid"))


def test_folder_nodes_of_any_size(spark):
    cid_hex = "01551220" + "ab" * 32
    rows = spark.range(9000).select(F.lit("d").alias("dir"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("name"), F.lit(cid_hex).alias("cid"), (F.col("id") + 1).alias("tsize"))
    rows = rows.unionByName(spark.createDataFrame([(None, "n", cid_hex, 7), ("e", "n", cid_hex, 7)], "dir string, name string, cid string, tsize long"))
    got = {r.dir: (r.cid, r.tsize, r.n_files, r.problem) for r in dag.folder_roots(rows, limit=None).collect()}

    def node(files):
        block = b""
        for name, size in sorted((n.encode(), s) for n, s in files):
            link = b"\x0a\x24" + bytes.fromhex(cid_hex) + b"\x12" + varint(len(name)) + name + b"\x18" + varint(size)
            block += b"\x12" + varint(len(link)) + link
        block += b"\x0a\x02\x08\x01"
        return "01701220" + hashlib.sha256(block).hexdigest(), len(block) + sum(s for _, s in files), len(files), None

    assert got == {"d": node([(f"é{i}", i + 1) for i in range(9000)]), None: node([("n", 7)]), "e": node([("n", 7)])} and got["d"][1] > dag.SHARD_BYTES


def test_linked_identifiers_keep_little_on_disk(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(Tables, "save", lambda self, name, df, save=Tables.save: saved.append((name, df.columns)) or save(self, name, df))
    docs = [("d", f"{i}.json", f'{{"to":{{"/":"./{i + 1}.json"}}}}') for i in range(4)] + [("d", "4.json", "{ }"), ("d", "loop", '{"/":"./loop"}')]
    found = graph.linked_cids(spark.createDataFrame(docs, "dir string, name string, text string"))
    got, want = {r.name: r.cid for r in found.collect()}, {"4.json": canon.cid_v1(b"{}"), "loop": None}
    for i in range(3, -1, -1):
        want[f"{i}.json"] = canon.cid_v1(f'{{"to":{{"/":"{want[f"{i + 1}.json"]}"}}}}'.encode())
    assert got == want
    # Tables are compressed files, not checkpoints; texts are in the first and in what was converted.
    assert {n for n, columns in saved if {"text", "converted"} & set(columns)} == {"docs", *(f"found{k}" for k in range(5))}
    assert [n for n, _ in saved if n.startswith("refs")] == [f"refs{k}" for k in range(5)]


def test_archives_of_many_groups_in_one_task(spark):
    rows = spark.range(0, 3000, 1, 1).select((F.col("id") % 700).alias("g"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("entry"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    packed = files.write_archives(rows, "g")
    assert "FlatMapGroups" not in packed._jdf.queryExecution().analyzed().toString()  # a frame for each group costs more than its archive
    found = files.unpacked(packed.select(F.col("g").cast("string").alias("path"), F.col("archive").alias("content")))
    got = sorted((int(r.archive), r.entry, bytes(r.content)) for r in found.collect())
    assert packed.count() == 700 and got == sorted((i % 700, f"e{i}", str(i).encode()) for i in range(3000))


def test_equal_contents_are_judged_once(spark, tmp_path, monkeypatch):
    judged = []
    monkeypatch.setattr(validate, "validate", lambda df, *rest, f=validate.validate: judged.append(df.count()) or f(df, *rest))
    docs = spark.range(1000).select("id", F.concat(F.lit('{"k":'), (F.col("id") % 5).cast("string"), F.lit("}")).alias("raw"), F.lit("s").alias("schema_cid"))
    schemas = {"s": {"type": "object", "properties": {"k": {"type": "integer", "maximum": 3}}}}
    found, n = incremental.validated(docs, schemas, f"file://{tmp_path}/kept")
    assert n == 1000 and found.filter("size(errors) = 1").count() == 200 and found.count() == 1000
    assert judged[0] == 5


def test_costly_work_on_a_small_file_is_dealt_out(spark):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, source in (("contract_hashes", "customer"), ("dag_codecs", "orders"), ("flow_graphs", "orders")):
        found = queries()[name](spark, SF)
        assert found.rdd.getNumPartitions() >= tasks and found.count() == table(spark, SF, source).count()


def test_codecs_read_a_text_once(spark):
    plan = queries()["dag_codecs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "dag_forms" in plan  # all forms of a text, and the way back
    cases = ['{"k":1e0}', "{", None, '"é"', "1e400"]
    got = spark.createDataFrame([(x,) for x in cases], "t string").select("t", dagcodecs.dag_forms("t").alias("f"), dagcodecs.cbor_of_json("t").alias("b"), dagcodecs.dag_cbor_cid("t").alias("c"), dagcodecs.dag_json_cid("t").alias("j")).collect()
    assert all((r.f.cbor, r.f.cbor_cid, r.f.json_cid) == (r.b, r.c, r.j) for r in got) and [r.j is None for r in got] == [False, True, True, False, True]


def test_base32_as_the_standard_library_has_it():
    for n in range(45):
        data = bytes((n * 37 + k * 91) % 256 for k in range(n))
        text = base64.b32encode(data).decode().rstrip("=").lower()
        assert base32_text(data) == text and _base32_bytes(text) == data
    for bad in ("a", "aaa", "aaaaaa", "ab", "A", "Aa", "a1", "aa==", "aé", "a_aa"):
        with pytest.raises(ValueError):
            _base32_bytes(bad)


def test_flows_are_judged_without_shuffles_by_flow(spark):
    long = '{"starts_at":"s0","states":{' + ",".join(f'"s{k}":{{"next":"s{k + 1}"}}' for k in range(3000)) + ',"s3000":{}}}'
    rows = spark.createDataFrame([("x", long), ("x", '{"starts_at":"é","states":{"é":{"next":"é"}}}'), (None, '{"starts_at":"A","states":{"A":{}}}')], "flow string, raw string")
    found = stategraph.flow_graph_problems(rows)
    assert sorted((r.flow or "", r.problems) for r in found.collect()) == [("", []), ("x", []), ("x", ['State "é" leads to no end'])]
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_fetched_texts_are_parsed_and_written_once(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(Tables, "save", lambda self, name, df, save=Tables.save: saved.append((name, df.columns)) or save(self, name, df))
    texts = {cid_v1(t.encode()): t for t in ('{"n":1}', "{ }")}
    a, b = texts
    top = f'{{"a":{{"/":"{a}"}},"b":{{"/":"{b}"}}}}'
    root = cid_v1(top.encode())
    content = spark.createDataFrame([(root, top), *texts.items(), (a, '{"n":1}')], "cid string, data string")
    manifest = spark.createDataFrame([], "name string, cid string, type string")
    got = {r.cid: r for r in closure.fetched(content.filter(F.col("cid") == root).select("cid"), content, manifest).collect()}
    assert len(got) == 3 and got[a].text == '{"n":1}' and got[b].text == "{}"
    assert got[root].text == f'{{"a":{{"/":"{got[a].path}"}},"b":{{"/":"{got[b].path}"}}}}'
    assert [n for n, columns in saved if "text" in columns] == ["known", "texts"]
    assert "met0" in dict(saved)  # compressed tables, not checkpoints


def test_uploads_of_a_small_file_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(upload, "converted", lambda docs, files, schemas: docs.select("dir").union(files.select("dir")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert queries()["upload_conversion"](spark, SF).rdd.getNumPartitions() >= 2 * tasks


def test_linked_identifiers_end_when_nothing_waits(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(Tables, "save", lambda self, name, df, save=Tables.save: saved.append(name) or save(self, name, df))
    leaf = '{ "n":1e0,"é":"\\u00e9"}'
    docs = [(str(k), *x) for k in range(3) for x in (("a", leaf), ("b", '{"to":[{"/":"./a"},{"/":"././a"}],"page":{"ipfs_url":"./i.html"}}'))]
    got = {(r.dir, r.name): (r.converted, r.cid) for r in graph.linked_cids(spark.createDataFrame(docs, "dir string, name string, text string"), spark.createDataFrame([(str(k), "bafym") for k in range(3)], "dir string, media_cid string")).collect()}
    a = '{"n":1,"é":"é"}'
    b = '{"page":{"ipfs_url":"ipfs://bafym"},"to":[{"/":"%s"},{"/":"%s"}]}' % ((canon.cid_v1(a.encode()),) * 2)
    assert got == {(str(k), n): (t, canon.cid_v1(t.encode())) for k in range(3) for n, t in (("a", a), ("b", b))}
    assert saved == ["docs", "refs0", "found0"]


def test_texts_in_plain_ascii_are_printed_as_all_others(spark):
    cids = {"./a": "bafya", "./z": "bafyz", "i.png": "bafyi"}
    texts = ['{"b":[{"/":"./z"},{"/":"./a"},1],"B":"\\"\x7f","ipfs_url":"i.png"}', "[1.50,-0,1e3]", "12345678901234567890", "[NaN]", "{", '{"a":1,"a":[true,null]}', '"\\ud83d\\ude00"', "{}"]
    for text in texts:
        plain = canon._safe(lambda v: canon.canonical(canon.sort_links(canon.with_targets(v, cids))), text) or text
        assert canon._linked(text, cids) == (plain, canon.cid_v1(plain.encode()))
    rows = spark.createDataFrame([(t,) for t in [*texts, *texts, None]], "t string").coalesce(1)
    assert rows.select(canon.link_forms("t").alias("f")).filter("f.cid is not null").count() == 14 and rows.select(canon.link_forms("t")["refs"].alias("r")).first().r == ["./z", "./a", "i.png"]


def test_fetched_tables_go_when_nothing_reads_them(spark, monkeypatch):
    saved = {}
    monkeypatch.setattr(Tables, "save", lambda self, name, df, save=Tables.save: saved.setdefault(name, (self.path, df.columns)) and save(self, name, df))
    leaf, lost = '{"n":1}', cid_v1(b"lost")
    a = cid_v1(leaf.encode())
    top = '{"relationships":{"r":{"x":{"/":"%s"},"y":{"/":"%s"}}}}' % (a, lost)
    root = cid_v1(top.encode())
    content = spark.createDataFrame([(root, top), (a, leaf)], "cid string, data string")
    found = closure.fetched(content.filter(F.col("cid") == root).select("cid"), content, spark.createDataFrame([], "name string, cid string, type string"))
    got = {r.cid: (r.path, r.text, r.problem) for r in found.collect()}
    path = f"./r_x_{a}.json"
    assert got == {root: (f"./{root}.json", top.replace(a, path), None), a: (path, leaf, None), lost: (None, None, closure.MISSING)}
    # No level for documents without links; names of files don't hold the identifier beside them.
    assert list(saved) == ["known", "met0", "met1", "texts", "lost"] and not {"path", "file"} & {c for _, columns in saved.values() for c in columns}
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    left = [n for n, (folder, _) in saved.items() if (p := jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")).getFileSystem(conf).exists(p)]
    assert left == ["texts", "lost"]
