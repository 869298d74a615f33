"""Schemas as expressions against the evaluator: the same errors for every keyword, format and link."""

import json
import random

from pyspark.sql import functions as F

from quern.operators import validate

CID = "bafkreifzjut3te2nhyekklss27nh3k72ysco7y32koao5eei66wof36n5e"
KEYWORDS = [
    {"type": "string"}, {"type": ["integer", "null"]}, {"type": "number"}, {"type": "object"}, {"type": ["string", "array"]}, {"type": "boolean"}, {"type": "string", "minLength": 2, "maxLength": 3}, {"pattern": "^a+$"},
    {"minimum": 2, "maximum": 7}, {"exclusiveMinimum": 2, "exclusiveMaximum": 7.5}, {"multipleOf": 0.5}, {"multipleOf": 3, "not": {"type": "integer"}},
    {"enum": [1, "a", None, True, [1], {"k": 1}]}, {"const": 1.0}, {"const": {"k": [1, {"z": "x"}]}}, {"const": [1, 2]}, {"const": None}, {"const": "a"},
    {"items": {"type": "integer"}, "minItems": 2, "maxItems": 3}, {"items": [{"type": "string"}, {"type": "integer"}], "additionalItems": False}, {"items": [{"type": "string"}], "additionalItems": {"type": "boolean"}}, {"uniqueItems": True}, {"contains": {"const": 3}}, {"items": {"items": {"maximum": 1}}},
    {"required": ["k", "z"]}, {"minProperties": 2, "maxProperties": 2}, {"properties": {"k": {"type": "string"}, "a/b": {"minimum": 5}, "it's": {"type": "null"}}, "additionalProperties": False}, {"patternProperties": {"^k": {"type": "integer"}, "z$": {"type": "string"}}, "additionalProperties": {"type": "null"}},
    {"propertyNames": {"maxLength": 1}}, {"dependencies": {"k": ["z", "y"], "z": {"required": ["x"]}, "x": ["k"]}},
    {"anyOf": [{"type": "string"}, {"minimum": 3, "type": "integer"}]}, {"oneOf": [{"type": "number"}, {"type": "integer"}, {"required": ["k"]}]}, {"allOf": [{"type": "object"}, {"required": ["q"]}]}, {"if": {"type": "object"}, "then": {"required": ["z"]}, "else": {"type": "string"}}, {"if": {"minimum": 3}, "else": False},
    {"$ref": "#/definitions/t", "definitions": {"t": {"properties": {"k": {"$ref": "#/definitions/u"}}}, "u": {"type": "string"}}}, True, False, {}, {"items": False}, {"properties": {"k": False}},
]
VALUES = [
    None, True, False, 0, 1, 1.0, 3, 6, 2.5, -0.0, 7.5, 1e21, 123456789012, "", "a", "aaaa", "é", "ab", [], [1], [1, 2], [1, 2, 1], ["a", 1], ["a", 1, True], ["a", "b", 3], [[1], [2, 0]], [3, 3.0], [{"k": 1}, {"k": 1}], {}, {"k": 1}, {"k": "x", "z": 2}, {"k": 1, "z": "s", "q": None}, {"a/b": 3, "it's": 1, "~": 0},
    {"k": [1, {"z": "x"}]}, {"k1": 1, "xz": 2, "zz": "s"}, {"x": 1}, {"/": "./a"}, {"/": 1}, {"/": "./a", "k": 1}, {"k": {"/": CID}}, {"long name": 1, "b": 2},
]
FORMATS = {
    "date": ["2024-02-29", "2023-02-29", "2024-1-1", "0000-01-01", "2024-13-01", "x"], "date-time": ["2024-02-29T10:00:00Z", "2024-02-29 10:00", "2024-02-30T10:00:00Z", "2024-02-29T25:00:00Z", "2024-02-29T10:00:00.123+01:00", "2024-02-29"],
    "time": ["10:00:00", "10:00:60.5Z", "24:00:00", "10:00"], "email": ["a@b.c", "a@b", "a b@c.d", "a@b.c.d"], "hostname": ["a-b.c", "-a", "a..b", "a" * 64, "a."], "ipv4": ["1.2.3.4", "1.2.3.256", "01.2.3.4", "1.2.3"],
    "ipv6": ["::1", "::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1::2::3", ":::", "1:2:3:4:5:6:7:8::", "::ffff:1.2.3.4", "1.2.3.4", "::1.2.3.400", "12345::", "fe80::1%eth0", "1:2:3:4:5:6:1.2.3.4", ":1", "1:"],
    "uri": ["https://a.b/c?d=1", "ftp://a.b", "https://localhost", "http://u@a.b"], "uri-reference": ["a b", "a/b", "<"], "uuid": ["0f8fad5b-d9cb-469f-a165-70867728950e", "urn:uuid:0F8fad5b-d9cb-469f-a165-70867728950e", "x"], "json-pointer": ["/a~0/b", "a", "", "/~2"], "relative-json-pointer": ["1/a", "0#", "/a", "01"],
    "cid": [CID, CID[:-1], CID + "a", CID.upper(), "bafybeiczsscdsbs7ffqz55asqdf3smv6klcw3gofszvwlyarci47bgf354", "QmYwAPJzv5CZsnA625s3Xf2nemtYgPpHdWEz79ojWnPbdG", "Qm" + "1" * 44, "Qm" + "z" * 44, "zb2rhe5P4gXftAwvA4eXQ5HJwsER2owDyS9sKaQRRVQPn93bA", "zb2rhe5P4gXftAwvA4eXQ5HJwsER2owDyS9sKaQRRVQPn93bB1", "k51qzi5uqu5dgkmm1afrkmex5mzpu5r774jstpxjmro6mdsaullur27nfxle1q", "z", "k", "b", "", "bb", "hello", "z0"],
    "ipfs_uri": ["./a", "./", f"ipfs://{CID}", "ipfs://QmYwAPJzv5CZsnA625s3Xf2nemtYgPpHdWEz79ojWnPbdG", "ipfs://zb2rhe5P4gXftAwvA4eXQ5HJwsER2owDyS9sKaQRRVQPn93bA", f"ipfs://{CID[:-1]}", CID], "rate_percent": ["12.345", "12.34"], "currency": ["12", ""], "nothing known": ["x"],
}


def both(spark, rows, schemas, files=None):
    """rows: (schema, text[, content]) through expressions and through the evaluator."""
    table = spark.createDataFrame([(k, *r, *([None] if len(r) == 2 else [])) for k, r in enumerate(rows)], "k int, schema_cid string, raw string, content map<string,string>").coalesce(4)
    one = validate.validate(table, schemas, content_col="content")
    assert "Python" not in one._jdf.queryExecution().executedPlan().toString()
    other = validate.validate(table, schemas, content_col="content", expressions=False)
    got, want = ({r.k: [tuple(e) for e in r.errors] for r in df.select("k", "errors").collect()} for df in (one, other))
    for k, r in enumerate(rows):
        assert got[k] == want[k], (r, schemas[r[0]] if r[0] in schemas else None)
    return want


def test_keywords(spark):
    texts = [json.dumps(v, ensure_ascii=False) for v in VALUES] + ["{", None, "", "nul", '{"a":1}{', "1 2"]
    for lo in range(0, len(KEYWORDS), 14):
        schemas = {f"s{k}": s for k, s in enumerate(KEYWORDS[lo : lo + 14])}
        found = both(spark, [(s, t) for s in schemas for t in texts], schemas)
        assert any(found.values())


def test_formats(spark):
    schemas = {name: {"format": name} for name in FORMATS}
    rows = [(name, json.dumps(v)) for name, values in FORMATS.items() for v in [*values, 1, 1.255, -1, 0.1, None]]
    both(spark, rows, schemas)


def test_nested_at_random(spark):
    rng = random.Random(11)
    names = ["k", "z", "a b", "q"]

    def schema(depth):
        out = dict(rng.choice([s for s in KEYWORDS if isinstance(s, dict) and "$ref" not in s]))
        if depth:
            out["properties"] = {n: schema(depth - 1) for n in rng.sample(names, 2)}
            if rng.random() < 0.5:
                out["items"] = schema(depth - 1)
            if rng.random() < 0.3:
                out["anyOf"] = [schema(0), schema(depth - 1)]
        return out

    def value(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(VALUES)
        return [value(depth - 1) for _ in range(rng.randrange(4))] if rng.random() < 0.3 else {n: value(depth - 1) for n in rng.sample(names, rng.randrange(1, 4))}

    schemas = {f"s{k}": schema(2) for k in range(8)}
    both(spark, [(s, json.dumps(value(3))) for s in schemas for _ in range(40)], schemas)


def test_links(spark):
    schemas = {
        "leaf": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}},
        "node": {"type": "object", "properties": {"n": {"type": "integer"}, "next": {"type": ["string", "null"], "cid": "leaf"}}},
        "root": {"type": "object", "properties": {"from": {"type": "string", "cid": "node"}, "to": {"type": "array", "items": {"type": "string", "cid": "node"}}, "plain": {"type": "string"}, "maybe": {"anyOf": [{"type": "null"}, {"type": "object", "required": ["z"]}]}}},
        "loop": {"properties": {"x": {"type": "string", "cid": "loop"}}}, "lost": {"properties": {"x": {"type": "string", "cid": "nowhere"}}}, "itself": {"type": "string", "cid": "leaf"},
    }
    content = {"a": '{"n":1}', "b": '{"n":"x","next":{"/":"./a"}}', "hop": '{"/":"a"}', "text": "no JSON", "c1": '{"/":"./c2"}', "c2": '{"/":"./c1"}', CID: '{"n":2,"next":{"/":"././b"}}'}
    ends = ["./a", "a", "././b", "hop", "./text", "c1", "./c1", CID, "./gone", "", CID[:-1] + "q", "QmYwAPJzv5CZsnA625s3Xf2nemtYgPpHdWEz79ojWnPbdG"]
    texts = [json.dumps({"from": {"/": t}}) for t in ends] + [json.dumps({"to": [{"/": t}, {"/": u}]}) for t in ends[:7] for u in ends[5:]] + [json.dumps({"plain": {"/": t}, "maybe": {"/": t}}) for t in ends]
    texts += [json.dumps({"to": [{"n": 1, "next": {"/": "./b"}}, {"next": None}], "from": {"n": "y"}, "zz": {"/": "./gone"}}), json.dumps({"x": {"x": {"/": "./gone"}}}), json.dumps({"x": {"/": "./gone"}}), "[]"]
    rows = [(s, t, c) for s in [*schemas, "unknown"] for t in texts for c in (content, None)]
    found = both(spark, rows, schemas)
    assert {m for e in found.values() for _, m in e} >= {"must be integer", "Validation error: Failed to resolve pointer - empty string is not a valid CID or file path", f"Validation error: Failed to resolve CID pointer: {ends[-1]}", "File ./a does not exist or is not a valid JSON file."}


def test_what_no_expression_states(spark):
    tree = {"definitions": {"t": {"type": "object", "properties": {"n": {"type": "integer"}, "sub": {"items": {"$ref": "#/definitions/t"}}}}}, "$ref": "#/definitions/t"}
    schemas = {"tree": tree, "regex": {"format": "regex"}, "own": {"format": "even"}, "plain": {"type": "integer"}}
    rows = [("tree", '{"n":1,"sub":[{"n":"x"},{"sub":[{"n":"y"}]}]}'), ("regex", '"("'), ("own", '"abc"'), ("plain", '"x"'), ("plain", "1"), ("none", "1")]
    table = spark.createDataFrame(rows, "schema_cid string, raw string")
    found = validate.validate(table, schemas, formats={"even": lambda v: len(v) % 2 == 0})
    assert "Python" in found._jdf.queryExecution().executedPlan().toString()
    assert [[tuple(e) for e in r.errors] for r in found.select(F.col("errors")).collect()] == [
        [("/sub/0/n", "must be integer"), ("/sub/1/sub/0/n", "must be integer")], [("/", "must be a valid regular expression")], [("/", 'must match format "even"')], [("/", "must be integer")], [], [("", "Validation error: Failed to resolve schema CID")],
    ]
