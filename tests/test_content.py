"""Trees of blocks, fetched closures and binary codecs, on golden vectors and against plain versions."""

import hashlib
import random

from pyspark.sql import functions as F

from quern.functions import canon, dagcodecs, formats
from quern.functions.multiformats import base32_text, base58_text, parse_cid, varint
from quern.operators import closure, dag, upload


def test_codecs_golden_vectors():
    assert dagcodecs.cbor({"hello": "world"}).hex() == "a16568656c6c6f65776f726c64"
    assert canon.cid_v1(dagcodecs.cbor({"hello": "world"}), 0x71) == "bafyreidykglsfhoixmivffc5uwhcgshx4j465xwqntbmu43nb2dzqwfvae"
    assert canon.cid_v1(dagcodecs.dag_json({"hello": "world"}).encode(), 0x0129) == "baguqeerasords4njcts6vs7qvdjfcvgnume4hqohf65zsfguprqphs3icwea"
    assert dagcodecs.cbor({"bb": 1, "a": [True, None, -1, 1.5, 1.0], "c": 1 << 40}).hex() == "a36161" + "85f5f620fb3ff800000000000001" + "61631b0000010000000000" + "62626201"
    assert dagcodecs.dag_json({"b": 1e21, "a": [9007199254740992, 0.5, 2.0]}) == '{"a":[9007199254740992.0,0.5,2],"b":1e+21}'


def test_codecs_round_trip(spark):
    rng = random.Random(2)
    cid = "bafkreifzjut3te2nhyekklss27nh3k72ysco7y32koao5eei66wof36n5e"

    def value(depth):
        if not depth or rng.random() < 0.4:
            return rng.choice([None, True, False, 0, 23, 24, 255, 256, 65536, 1 << 33, -1, -24, -25, -300, 1.5, -0.1, 1e300, "", "é" * 30, "a" * 300, {"/": cid}, {"/": "QmYwAPJzv5CZsnA625s3Xf2nemtYgPpHdWEz79ojWnPbdG"}, {"/": "./x"}])
        return [value(depth - 1) for _ in range(rng.randrange(30))] if rng.random() < 0.5 else {rng.choice("abcdefgh") * rng.randrange(1, 4): value(depth - 1) for _ in range(rng.randrange(5))}

    for _ in range(200):
        v = value(4)
        assert canon.canonical(dagcodecs.of_cbor(dagcodecs.cbor(v))) == canon.canonical(v)
    rows = spark.createDataFrame([('{"b":{"/":"%s"},"a":1.50}' % cid,), ("{",), (None,)], "t string").select("t", dagcodecs.cbor_of_json("t").alias("b"), dagcodecs.dag_cbor_cid("t").alias("c"))
    found = rows.select(dagcodecs.json_of_cbor("b").alias("j"), "c").collect()
    assert [r.j for r in found] == ['{"a":1.5,"b":{"/":"%s"}}' % cid, None, None] and parse_cid(found[0].c).codec == 0x71 and found[1].c is None


def plain_file(data, chunk, width):
    """(identifier bytes, bytes of all blocks, size, levels) of a file."""
    raw = lambda d: (b"\x01\x55\x12\x20" + hashlib.sha256(d).digest(), len(d), len(d))
    nodes, levels = [raw(data[i : i + chunk]) for i in range(0, len(data), chunk)] or [raw(b"")], 0
    while len(nodes) > 1:
        levels += 1
        up = []
        for i in range(0, len(nodes), width):
            some, block = nodes[i : i + width], b""
            for cid, below, _ in some:
                link = b"\x0a" + varint(len(cid)) + cid + b"\x12\x00\x18" + varint(below)
                block += b"\x12" + varint(len(link)) + link
            size = sum(s for _, _, s in some)
            unixfs = b"\x08\x02\x18" + varint(size) + b"".join(b"\x20" + varint(s) for _, _, s in some)
            block += b"\x0a" + varint(len(unixfs)) + unixfs
            up.append((b"\x01\x70\x12\x20" + hashlib.sha256(block).digest(), len(block) + sum(b for _, b, _ in some), size))
        nodes = up
    return *nodes[0], levels


def test_files_of_many_blocks(spark):
    rng = random.Random(4)
    sizes = [0, 1, 9, 10, 11, 29, 30, 31, 90, 91, 270, 271, 1000]
    files = [("d", f"f{n}.html", rng.randbytes(n)) for n in sizes] + [("e", "é b.PNG", b"x" * 500), ("e", "x.json", b"{}"), ("none", "x.txt", b""), ("null", "n.html", None)]
    rows = spark.createDataFrame(files, "dir string, name string, content binary")
    got = {(r.dir, r.name): (r.cid, r.tsize, r.size, r.levels) for r in dag.file_roots(rows, ["dir", "name"], "content", 10, 3).collect()}
    want = {(d, n): (cid.hex(), below, size, levels) for d, n, c in files if c is not None for cid, below, size, levels in [plain_file(c, 10, 3)]}
    assert got == want and max(v[3] for v in got.values()) == 5
    large = spark.createDataFrame([("d", "a.html", b"ab" * 300_000), ("d", "b.png", b"1"), ("s", "a.html", b"1")], "dir string, name string, content binary")
    cid, below, _, levels = plain_file(b"ab" * 300_000, dag.CHUNK, dag.WIDTH)
    small = b"\x01\x55\x12\x20" + hashlib.sha256(b"1").digest()
    node = b"".join(b"\x12" + varint(len(x)) + x for x in (b"\x0a\x24" + c + b"\x12" + varint(len(n)) + n + b"\x18" + varint(t) for c, n, t in ((cid, b"a.html", below), (small, b"b.png", 1)))) + b"\x0a\x02\x08\x01"
    found = {r.dir: (r.media_cid, r.problem) for r in dag.media_cids(large).collect()}
    assert levels == 1 and found == {"d": ("b" + base32_text(b"\x01\x70\x12\x20" + hashlib.sha256(node).digest()), None), "s": (canon.directory_cid({"a.html": b"1"}), None)}
    many = dag.folder_roots(dag.file_roots(large, ["dir", "name"]), limit=100)
    assert {r.dir: (r.cid is None, r.problem) for r in many.collect()} == {"d": (True, dag.SHARDED), "s": (False, None)}


def test_varints(spark):
    some = [0, 1, 127, 128, 255, 300, 16383, 16384, 1 << 21, (1 << 28) - 1, 1 << 35, (1 << 49) + 5, (1 << 63) - 1]
    got = spark.createDataFrame([(n,) for n in some], "n long").select(dag.varint_hex(F.col("n")).alias("h")).collect()
    assert [r.h for r in got] == [varint(n).hex() for n in some]


def test_identifiers_as_expressions(spark):
    rng = random.Random(6)
    some = ["", "b", "z", "k", "Q", "hello", "b====", "B" + "a" * 58]
    for _ in range(60):
        head = varint(rng.choice([1, 1, 1, 0, 2])) + varint(rng.choice([0x55, 0x70, 0x0129, 0x71])) + varint(rng.choice([0x12, 0x13, 0xB220]))
        body = rng.randbytes(rng.choice([0, 20, 32, 64, 130]))
        data = head + varint(len(body) + rng.choice([0, 0, 0, 1])) + body
        some += ["b" + base32_text(data), "z" + base58_text(data), ("b" + base32_text(data))[:-1]]
    got = spark.createDataFrame([(x,) for x in some], "x string").select("x", formats.strict_cid(F.col("x")).alias("ok")).collect()
    assert {r.x: r.ok for r in got} == {x: parse_cid(x) is not None for x in some}


def test_closure_of_shared_documents(spark):
    put = lambda text: (canon.cid_v1(text.encode()), text)
    link = lambda c: '{"/":"%s"}' % c
    shared, shared_text = put('{"n": 1}')
    leaf, leaf_text = put('{"deep":%s,"list":[1,%s]}' % (link(shared), link("./x")))
    a, a_text = put('{"label":"Photo Metadata","relationships":{"one":%s,"many":{"x":%s,"y":{"no":1}},"rows":[%s,2]},"own":%s}' % (link(leaf), link(shared), link(shared), link(shared[:-1])))
    broken, lost = put("[1]")[0], put("[2]")[0]
    b, b_text = put('{"to":%s,"and":%s,"quoted":"{\\"/\\":\\"%s\\"}"}' % (link(broken), link(lost), leaf))
    text, no_json = put("plain text")
    content = spark.createDataFrame([(shared, shared_text), (leaf, leaf_text), (a, a_text), (a, a_text), (b, b_text), (broken, "[1] "), (text, no_json)], "cid string, data string")
    manifest = spark.createDataFrame([("Photo_Metadata", "bafyphoto", "dataGroup")], "name string, cid string, type string")
    roots = spark.createDataFrame([(a,), (a,), (b,), (text,), (lost,)], "cid string")
    found = {(r.root, r.cid): (r.depth, r.path, r.text, r.problem) for r in closure.fetched(roots, content, manifest).collect()}
    shared_path, leaf_path = f"./many_x_{shared}.json", "./one.json"
    assert found == {
        (a, a): (0, "./bafyphoto.json", '{"label":"Photo Metadata","own":%s,"relationships":{"many":{"x":%s,"y":{"no":1}},"one":%s,"rows":[%s,2]}}' % (link(shared[:-1]), link(shared_path), link(leaf_path), link(shared_path)), None),
        (a, leaf): (1, leaf_path, '{"deep":%s,"list":[1,{"/":"./x"}]}' % link(shared_path), None), (a, shared): (1, shared_path, '{"n":1}', None),
        (b, b): (0, f"./{b}.json", '{"and":%s,"quoted":"{\\"/\\":\\"%s\\"}","to":%s}' % (link(lost), leaf, link(broken)), None), (b, broken): (1, None, None, closure.BROKEN), (b, lost): (1, None, None, closure.MISSING),
        (text, text): (0, None, None, closure.NO_JSON), (lost, lost): (0, None, None, closure.MISSING),
    }
    assert {r.cid for r in closure.fetched(roots.limit(1), content, manifest, max_depth=0).collect()} == {a}


def test_conversion_for_upload(spark):
    cid_of = lambda text: canon.cid_v1(text.encode())
    files = [("d", "x/leaf.json", b' { "b": 1, "a": {"/":"%s"} } ' % cid_of("k").encode()), ("d", "note.txt", "é".encode()), ("d", "x/p.PNG", b"\x00\xff"), ("d", "c1.json", b'{"/":"./c2.json"}'), ("d", "c2.json", b'{"/":"c1.json"}'), ("d", "deep.json", b'[{"/":"./x/leaf.json"},{"ipfs_url":"x/p.PNG"}]'), ("d", "bad.json", b'{"/":"./nowhere.json"}')]
    docs = {
        "leaf": '{"to":{"/":"./x/leaf.json"},"again":{"/":"x/../x/leaf.json"}}', "text": '{"to":{"/":"note.txt"}}', "deep": '{"l":[1,{"/":"./deep.json"}],"ipfs_url":["x/p.PNG","no.gif.txt","ipfs://q"]}', "circle": '{"to":{"/":"c1.json"}}', "bad": '{"to":{"/":"bad.json"},"x":{"/":"note.txt"}}',
        "missing image": '{"ipfs_url":"gone.png"}', "cid": '{"ipfs_url":"%s","to":{"/":"%s"}}' % (cid_of("a"), cid_of("b")), "by format": '{"u":["x/p.PNG"],"v":"x/p.PNG"}', "no JSON": "plain",
    }
    rows = [("d", f"{k}.json", "s" if k == "by format" else None, t) for k, t in docs.items()] + [("d", "by format.json", None, docs["by format"]), ("d", "null.json", None, None)]
    found = upload.converted(spark.createDataFrame(rows, "dir string, name string, schema_cid string, raw string"), spark.createDataFrame(files, "dir string, name string, content binary"), {"s": {"properties": {"u": {"items": {"format": "ipfs_uri"}}}}})
    got = {(r.name.removesuffix(".json"), r.schema_cid): (r.converted, r.problem) for r in found.collect()}
    leaf, png = cid_of('{"a":{"/":"%s"},"b":1}' % cid_of("k")), canon.cid_v1(b"\x00\xff")
    deep = cid_of('[{"/":"%s"},{"ipfs_url":"ipfs://%s"}]' % (leaf, png))
    assert got == {
        ("leaf", None): ('{"again":{"/":"%s"},"to":{"/":"%s"}}' % (leaf, leaf), None), ("text", None): ('{"to":{"/":"%s"}}' % cid_of('"é"'), None), ("deep", None): ('{"ipfs_url":["ipfs://%s","no.gif.txt","ipfs://q"],"l":[{"/":"%s"},1]}' % (png, deep), None),
        ("circle", None): (None, upload.FAILED + "c1.json"), ("bad", None): (None, upload.FAILED + "bad.json"), ("missing image", None): (None, upload.FAILED + "gone.png"), ("cid", None): ('{"ipfs_url":"ipfs://%s","to":{"/":"%s"}}' % (cid_of("a"), cid_of("b")), None),
        ("by format", "s"): ('{"u":["ipfs://%s"],"v":"x/p.PNG"}' % png, None), ("by format", None): (docs["by format"], None), ("no JSON", None): ('"plain"', None), ("null", None): (None, None),
    }


def test_contents_by_either_hash(spark):
    text = lambda code, name: "b" + base32_text(varint(1) + varint(0x55) + varint(code) + varint(hashlib.new(name).digest_size) + hashlib.new(name, b"x").digest())
    rows = [(text(0x12, "sha256"), "x"), (text(0x13, "sha512"), "x"), (text(0x13, "sha512"), "y"), (text(0x11, "sha1"), "x"), ("Qm", "x"), (None, "x"), (text(0x12, "sha256"), None)]
    got = spark.createDataFrame(rows, "cid string, data string").select(formats.content_ok(F.col("cid"), F.col("data")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, True, False, False, False, False, False]
