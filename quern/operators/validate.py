"""Documents against JSON Schemas (draft-07): all errors of each document.

Schemas are a small dimension that the driver resolves (references by content identifier); documents name their schema. A
schema becomes expressions (see schema_columns); one that refers to itself, or uses what no expression states, is left to an
evaluator that runs on Arrow batches and reports the same. What documents link to is joined to them level by level before,
so either only looks into a map that comes with its row. Errors about several properties come by the properties' names.
"""

from __future__ import annotations

import ipaddress
import json
import math
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import formats
from quern.functions import multiformats as mf
from quern.functions.canon import canonical
from quern.functions.formats import IPV4, URI
from quern.operators.schema_columns import NotExpressible, compiled, failure
from quern.operators.schema_columns import js_text as _js

#: What a format that fails is reported as.
FORMAT_MESSAGES = {
    "date": "must be a valid ISO date in YYYY-MM-DD format",
    "date-time": "must be a valid ISO date-time in YYYY-MM-DDTHH:mm:ss.sssZ format",
    "time": "must be a valid ISO time in HH:mm:ss format",
    "email": "must be a valid email address",
    "hostname": "must be a valid hostname",
    "ipv4": "must be a valid IPv4 address",
    "ipv6": "must be a valid IPv6 address",
    "uri": "must be a valid URI starting with http:// or https://",
    "uri-reference": "must be a valid URI reference",
    "iri": "must be a valid IRI (Internationalized Resource Identifier)",
    "iri-reference": "must be a valid IRI reference",
    "uuid": "must be a valid UUID",
    "json-pointer": "must be a valid JSON Pointer",
    "relative-json-pointer": "must be a valid relative JSON Pointer",
    "regex": "must be a valid regular expression",
    "cid": "must be a valid IPFS Content Identifier (CID)",
    "currency": "must be a positive number with at most 2 decimal places",
    "ipfs_uri": "must be a valid IPFS URI in format ipfs://[CID] with CIDv1 using raw codec and sha256 or a relative file path starting with ./",
    "rate_percent": 'must be a percentage rate with exactly 3 decimal places (e.g., "12.345")',
}
_POINTER = r"(/([^~/]|~[01])*)*"
_LABEL = r"[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_PATTERNS = {
    "rate_percent": r"^[0-9]+\.[0-9]{3}$",
    "uri": URI,
    "email": r"^[^@\s]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$",
    "uuid": r"^(urn:uuid:)?(?i:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$",
    "time": r"^([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?([Zz]|[+-][0-9]{2}:?[0-9]{2})?$",
    "hostname": rf"^(?=.{{1,253}}\.?$){_LABEL}(\.{_LABEL})*\.?$",
    "json-pointer": rf"^{_POINTER}$",
    "relative-json-pointer": rf"^(0|[1-9][0-9]*)(#|{_POINTER})$",
    "uri-reference": r"^[^\s<>\"{}|\\^`]*$",
    "ipv4": f"^{IPV4}$",
}
_DATE, _DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.,][0-9]+)?)?(Z|[+-]([01][0-9]|2[0-3])(:?[0-5][0-9])?)?$"


def _fits(f: Callable[[str], object]) -> Callable[[str], bool]:
    def ok(v: str) -> bool:
        try:
            return f(v) is not False
        except (ValueError, re.error):
            return False

    return ok


def _ipfs_uri(v: str) -> bool:
    if v.startswith("./"):
        return len(v) > 2
    cid = mf.parse_cid(v[7:]) if re.search("^ipfs://[A-Za-z0-9]{46,59}$", v) else None
    return cid is not None and cid.version == 1 and cid.codec in (mf.RAW, mf.DAG_PB) and cid.hash_code == mf.SHA2_256


#: The registry of formats of texts; validate() takes more of them.
FORMATS: dict[str, Callable[[str], bool]] = {name: (lambda v, p=re.compile(p, re.ASCII): p.search(v) is not None) for name, p in _PATTERNS.items()} | {
    "date": _fits(lambda v: re.search(_DATE, v) is not None and date.fromisoformat(v[:10])),
    "date-time": _fits(lambda v: re.search(_DATE_TIME, v) is not None and date.fromisoformat(v[:10])),
    "ipv6": _fits(lambda v: "%" not in v and ipaddress.IPv6Address(v)),
    "regex": _fits(re.compile),
    "cid": lambda v: mf.parse_cid(v) is not None,
    "ipfs_uri": _ipfs_uri,
}
_DAY = lambda v: F.try_to_date(F.substr(v, F.lit(1), F.lit(10)), "yyyy-MM-dd").isNotNull() & ~v.startswith("0000")
#: The same formats as expressions; None where there is none.
FORMAT_COLUMNS: dict[str, Callable[[Column], Column] | None] = {name: (lambda v, p=p: v.rlike(p)) for name, p in _PATTERNS.items()} | {
    "date": lambda v: v.rlike(_DATE) & _DAY(v),
    "date-time": lambda v: v.rlike(_DATE_TIME) & _DAY(v),
    "ipv6": formats.ipv6_ok,
    "cid": formats.strict_cid,
    "ipfs_uri": formats.ipfs_uri_ok,
    "regex": None,
}


def _kind(v: object) -> str:
    if v is None or isinstance(v, bool):
        return "null" if v is None else "boolean"
    if isinstance(v, (int, float)):
        return "integer" if float(v).is_integer() else "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def _is(v: object, kind: str) -> bool:
    return _kind(v) == kind or (kind == "number" and _kind(v) == "integer")


def _same(a: object, b: object) -> bool:
    return _kind(a) == _kind(b) and canonical(a) == canonical(b)


def is_cid_schema(schema: object) -> bool:
    """A part of a schema that stands for another schema: {type: string, cid: ...}."""
    if not isinstance(schema, dict) or not isinstance(schema.get("cid"), str) or not schema["cid"]:
        return False
    return schema.get("type") == "string" or (isinstance(schema.get("type"), list) and "string" in schema["type"])


def resolve(schema: object, schemas: dict[str, object], allowed: set[str] | None = None, path: str = "", above: tuple[str, ...] = ()) -> object:
    """V2: {type: string, cid: ...} replaced by the schema of that identifier, null still allowed if it was.

    `allowed` gets the paths (a.b[], as data has them) where data may hold a link instead. A cycle ends in a schema that
    all fits. Raises KeyError where a schema is missing.
    """
    allowed = set() if allowed is None else allowed
    if isinstance(schema, list):
        return [resolve(s, schemas, allowed, f"{path}[]", above) for s in schema]
    if not isinstance(schema, dict):
        return schema
    if is_cid_schema(schema):
        cid, kind = schema["cid"], schema["type"]
        allowed.add(path)
        if cid in above:
            return {}
        target = resolve(schemas[cid], schemas, allowed, path, (*above, cid))
        return {"anyOf": [{"type": "null"}, target]} if isinstance(kind, list) and "null" in kind and len(kind) > 1 else target
    out = {}
    for key, value in schema.items():
        if key == "properties" and isinstance(value, dict):
            out[key] = {k: resolve(s, schemas, allowed, f"{path}.{k}" if path else k, above) for k, s in value.items()}
        else:
            out[key] = resolve(value, schemas, allowed, f"{path}[]" if key == "items" else path, above)
    return out


class LinkError(Exception):
    """A link in data that leads nowhere."""


def follow(data: object, schema: object, allowed: set[str], content: dict[str, str], path: str = "", above: tuple[str, ...] = ()) -> object:
    """V3: links {"/": ...} in data replaced by what they lead to, where the schema allows it.

    content: texts by identifier, or by path without ./ in front. Links inside of what was read are of the same folder.
    """
    schema = schema if isinstance(schema, dict) else {}
    options = [o for o in schema.get("anyOf", []) if isinstance(o, dict)] if isinstance(schema.get("anyOf"), list) else []
    if isinstance(data, list):
        return [follow(x, schema.get("items"), allowed, content, f"{path}[]" if path else "[]", above) for x in data]
    if not isinstance(data, dict):
        return data
    target = data.get("/")
    if isinstance(target, str) and len(data) == 1:
        if path not in allowed and not any(o.get("type") != "null" and (o.get("type") == "object" or "properties" in o or not o.get("type")) for o in options):
            return data
        if not target:
            raise LinkError("Failed to resolve pointer - empty string is not a valid CID or file path")
        key = re.sub(r"^(\./)+", "", target)
        if key not in content or target in above:
            raise LinkError(f"Failed to resolve CID pointer: {target}" if mf.parse_cid(target) else f"Failed to resolve pointer - not a valid CID or accessible file path: {target}")
        try:
            value = json.loads(content[key])
        except ValueError:
            return content[key]
        return follow(value, schema, allowed, content, path, (*above, target))
    own = schema.get("properties") or {}
    inner = lambda k: own.get(k) or next((o["properties"][k] for o in options if k in (o.get("properties") or {})), None)
    return {k: follow(v, inner(k), allowed, content, f"{path}.{k}" if path else k, above) for k, v in sorted(data.items())}


def _format_ok(name: str, v: object, more: dict[str, Callable[[str], bool]]) -> bool:
    if name == "currency":
        return not _is(v, "number") or (math.isfinite(v) and v >= 0 and round(v, 2) == v)
    return not isinstance(v, str) or name not in more or more[name](v)


def _at(root: object, ref: str) -> object:
    """The part of a schema that a local reference names."""
    for part in ref.lstrip("#").split("/")[1:]:
        key = part.replace("~1", "/").replace("~0", "~")
        root = root[int(key)] if isinstance(root, list) else root[key]
    return root


def _many(n: int, what: str, more: bool) -> str:
    return f"must NOT have {'more' if more else 'fewer'} than {n} {what}"


def errors_of(v: object, schema: object, path: str = "", root: object = None, more: dict[str, Callable[[str], bool]] | None = None) -> Iterator[tuple[str, str]]:
    """All (path, message) of a value; keywords in the order in which validators report them, the path empty at the root."""
    root, more = schema if root is None else root, FORMATS if more is None else more
    if schema is False:
        yield path, "boolean schema is false"
    if not isinstance(schema, dict):
        return
    sub = lambda x, s, p=path: errors_of(x, s, p, root, more)
    step = lambda k: f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}"
    if "$ref" in schema:
        yield from sub(v, _at(root, schema["$ref"]))
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(v, k) for k in kinds):
            yield path, f"must be {','.join(kinds)}"
    if _is(v, "number"):
        for key, bad, sign in (("maximum", v > schema.get("maximum", v), "<="), ("minimum", v < schema.get("minimum", v), ">="), ("exclusiveMaximum", v >= schema.get("exclusiveMaximum", math.inf), "<"), ("exclusiveMinimum", v <= schema.get("exclusiveMinimum", -math.inf), ">")):
            if bad:
                yield path, f"must be {sign} {_js(schema[key])}"
        if "multipleOf" in schema and not float(v / schema["multipleOf"]).is_integer():
            yield path, f"must be multiple of {_js(schema['multipleOf'])}"
    if isinstance(v, str):
        size = len(v)
        for key, bad in (("maxLength", size > schema.get("maxLength", math.inf)), ("minLength", size < schema.get("minLength", 0))):
            if bad:
                yield path, _many(schema[key], "characters", key == "maxLength")
        if "pattern" in schema and not re.search(schema["pattern"], v):
            yield path, f'must match pattern "{schema["pattern"]}"'
    if "format" in schema and not _format_ok(schema["format"], v, more):
        yield path, FORMAT_MESSAGES.get(schema["format"], f'must match format "{schema["format"]}"')
    if isinstance(v, list):
        yield from _of_array(v, schema, path, sub, step)
    if isinstance(v, dict):
        yield from _of_object(v, schema, path, sub, step)
    if "const" in schema and not _same(v, schema["const"]):
        yield path, "must be equal to constant"
    if "enum" in schema and not any(_same(v, e) for e in schema["enum"]):
        yield path, f"must be one of: {', '.join(map(_js, schema['enum']))}"
    if "not" in schema and not any(True for _ in sub(v, schema["not"])):
        yield path, "must NOT be valid"
    for key, message in (("anyOf", "must match a schema in anyOf"), ("oneOf", "must match exactly one schema in oneOf")):
        if key in schema:
            found = [list(sub(v, s)) for s in schema[key]]
            fits = sum(not f for f in found)
            if fits == 0 or (key == "oneOf" and fits > 1):
                yield from (e for f in found for e in f)
                yield path, message
    for s in schema.get("allOf", []):
        yield from sub(v, s)
    if "if" in schema:
        key = "else" if any(True for _ in sub(v, schema["if"])) else "then"
        found = list(sub(v, schema.get(key, True)))
        yield from found
        if found:
            yield path, f'must match "{key}" schema'


def _of_array(v: list, schema: dict, path: str, sub: Callable, step: Callable) -> Iterator[tuple[str, str]]:
    for key, bad in (("maxItems", len(v) > schema.get("maxItems", math.inf)), ("minItems", len(v) < schema.get("minItems", 0))):
        if bad:
            yield path, _many(schema[key], "items", key == "maxItems")
    if schema.get("uniqueItems"):
        text = [_kind(x) + canonical(x) for x in v]
        pair = next(((i, j) for i in range(len(v) - 1, 0, -1) for j in range(i - 1, -1, -1) if text[i] == text[j]), None) if len(set(text)) < len(v) else None
        if pair:
            yield path, f"must NOT have duplicate items (items ## {pair[1]} and {pair[0]} are identical)"
    items = schema.get("items")
    if isinstance(items, list):
        rest = schema.get("additionalItems", True)
        if rest is False and len(v) > len(items):
            yield path, _many(len(items), "items", True)
        for k, x in enumerate(v):
            if k < len(items) or isinstance(rest, dict):
                yield from sub(x, items[k] if k < len(items) else rest, step(k))
    elif items is not None:
        for k, x in enumerate(v):
            yield from sub(x, items, step(k))
    if "contains" in schema:
        found = [list(sub(x, schema["contains"], step(k))) for k, x in enumerate(v)]
        if all(found):
            yield from (e for f in found for e in f)
            yield path, "must contain at least 1 valid item(s)"


def _of_object(v: dict, schema: dict, path: str, sub: Callable, step: Callable) -> Iterator[tuple[str, str]]:
    for key, bad in (("maxProperties", len(v) > schema.get("maxProperties", math.inf)), ("minProperties", len(v) < schema.get("minProperties", 0))):
        if bad:
            yield path, _many(schema[key], "properties", key == "maxProperties")
    for name in schema.get("required", []):
        if name not in v:
            yield path, f"missing required property '{name}'"
    for name, needs in schema.get("dependencies", {}).items():
        if name in v and isinstance(needs, list):
            what = f"property {needs[0]}" if len(needs) == 1 else f"properties {', '.join(needs)}"
            yield from ((path, f"must have {what} when property {name} is present") for n in needs if n not in v)
        elif name in v:
            yield from sub(v, needs)
    if "propertyNames" in schema:
        for name in sorted(v):
            found = list(sub(name, schema["propertyNames"]))
            yield from found
            if found:
                yield path, "property name must be valid"
    known, patterns, rest = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
    for name, x in sorted(v.items()):
        if rest is not True and name not in known and not any(re.search(p, name) for p in patterns):
            if rest is False:
                yield path, f"unexpected property '{name}'"
            else:
                yield from sub(x, rest, step(name))
    for name, s in known.items():
        if name in v:
            yield from sub(v[name], s, step(name))
    for p, s in patterns.items():
        for name, x in sorted(v.items()):
            if re.search(p, name):
                yield from sub(x, s, step(name))


def report(path: str, message: str, value: object) -> tuple[str, str]:
    """An error as it is reported: the root is /, and a link that wasn't followed says what it misses."""
    link = value.get("/") if isinstance(value, dict) else None
    if link is not None and "must be string" in message:
        message = f"File {_js(link)} does not exist or is not a valid JSON file." if _js(link).startswith("./") else f"Value {_js(link)} is not a valid CID or file path."
    return path or "/", message


def _value_at(root: object, path: str) -> object:
    for part in path.split("/")[1:]:
        key = part.replace("~1", "/").replace("~0", "~")
        try:
            root = root[int(key)] if isinstance(root, list) else root[key]
        except (KeyError, IndexError, ValueError, TypeError):
            return None
    return root


@lru_cache(maxsize=256)
def _parsed(text: str) -> tuple[object, frozenset[str]]:
    schema, allowed = json.loads(text)
    return schema, frozenset(allowed)


def check(raw: str | None, ready: str | None, content: dict[str, str], more: dict[str, Callable[[str], bool]]) -> list[tuple[str, str]]:
    """All reported errors of one document."""
    if ready is None:
        return [("", "Validation error: Failed to resolve schema CID")]
    schema, allowed = _parsed(ready)
    if is_cid_schema(schema):
        return [("", "Root schema cannot be a CID link. CID links are only allowed within schema properties.")]
    try:
        value = json.loads(raw)
    except (TypeError, ValueError, RecursionError):
        return [("", "File read/parse error")]
    try:
        value = follow(value, schema, allowed, content)
        return [report(p, m, _value_at(value, p)) for p, m in errors_of(value, schema, more=more)]
    except (LinkError, RecursionError, re.error, KeyError) as e:
        return [("", f"Validation error: {e}")]


def ready_schemas(schemas: dict[str, object]) -> dict[str, str | None]:
    """Each schema with its references resolved and the places where data may hold links, as JSON; None where a reference leads nowhere."""
    ready: dict[str, str | None] = {}
    for cid, schema in schemas.items():
        allowed: set[str] = set()
        try:
            ready[cid] = json.dumps([schema if is_cid_schema(schema) else resolve(schema, schemas, allowed, "", (cid,)), sorted(allowed)])
        except KeyError:
            ready[cid] = None
    return ready


def _fits_analyzer(docs: DataFrame, found: Column) -> None:
    """Spark's analyzer gives up on expressions nested too deeply; very deep schemas are the evaluator's as well."""
    try:
        docs.select(found)
    except Exception as e:
        if "Max iterations" in str(e):
            raise NotExpressible("a schema of too many levels") from e
        raise


def validate(docs: DataFrame, schemas: dict[str, object], schema_col: str = "schema_cid", doc_col: str = "raw", content_col: str | None = None, formats: dict[str, Callable[[str], bool]] | None = None, expressions: bool = True) -> DataFrame:
    """V1: the rows of docs with errors, an array of (path, message).

    content_col: a map of the texts that the document's links lead to (see linked_content). Text that isn't JSON, and a
    schema that is missing or refers to a missing one, are errors. `formats` adds to the registry of formats. Without
    `expressions`, all schemas are left to the evaluator.
    """
    ready, left = ready_schemas(schemas), {}
    content = F.lit(None).cast("map<string,string>") if content_col is None else F.col(content_col)
    errors = F.when(F.lit(False), failure(""))
    for cid, text in ready.items():
        schema, allowed = json.loads(text) if text is not None else (None, [])
        try:
            if text is None:
                found = failure("Validation error: Failed to resolve schema CID")
            elif is_cid_schema(schema):
                found = failure("Root schema cannot be a CID link. CID links are only allowed within schema properties.")
            elif not expressions:
                raise NotExpressible
            else:
                found = compiled(F.col(doc_col), schema, allowed, content, FORMAT_MESSAGES, FORMAT_COLUMNS | dict.fromkeys(formats or {}))
                _fits_analyzer(docs, found)
        except NotExpressible:
            left[cid] = text
        else:
            errors = errors.when(F.col(schema_col) == cid, found)
    if left:
        shared, more = docs.sparkSession.sparkContext.broadcast(left), FORMATS | (formats or {})  # a dimension of schemas

        @F.pandas_udf("array<struct<path: string, message: string>>")
        def run(raws: pd.Series, cids: pd.Series, contents: pd.Series) -> pd.Series:
            rows = [check(r, shared.value[c], dict(x) if x is not None else {}, more) if c in shared.value else [] for r, c, x in zip(raws, cids, contents, strict=True)]
            return pd.Series([[{"path": p, "message": m} for p, m in row] for row in rows], dtype=object)

        own = F.col(schema_col).isin(*left)
        errors = errors.when(own, run(F.when(own, F.col(doc_col)), F.col(schema_col), F.when(own, content)))
    return docs.withColumn("errors", errors.otherwise(failure("Validation error: Failed to resolve schema CID")))


LINK = r'\{\s*"/"\s*:\s*"([^"]*)"\s*\}'


def linked_content(docs: DataFrame, files: DataFrame, key: str = "doc_id", folder: str = "dir", doc_col: str = "raw") -> DataFrame:
    """docs with `content`: the texts that each document's links lead to, and the links of those, by path or identifier.

    files: folder, name, text; a null folder stands for content by identifier. Level by level, so that a cycle ends; a
    document's map holds as much as its folder does at most.
    """
    names = lambda text: F.transform(F.regexp_extract_all(text, F.lit(LINK), 1), lambda x: F.regexp_replace(x, r"^(\./)+", ""))
    frontier = docs.select(key, folder, F.explode(F.array_distinct(names(F.col(doc_col)))).alias("name"))
    theirs = files.select(F.col(folder).alias("_dir"), F.col("name").alias("_name"), F.col("text").alias("_text"))
    seen = None
    while True:
        own = frontier.join(theirs, (F.col("name") == F.col("_name")) & (F.col("_dir") == F.col(folder)))
        shared = frontier.join(theirs.filter("_dir is null"), F.col("name") == F.col("_name"))
        found = own.union(shared).select(key, folder, "name", F.col("_text").alias("text"))
        if seen is not None:
            found = found.join(seen.select(key, "name"), [key, "name"], "left_anti")
        found = found.checkpoint()
        if found.isEmpty():
            break
        seen = found if seen is None else seen.unionByName(found)
        frontier = found.select(key, folder, F.explode(F.array_distinct(names(F.col("text")))).alias("name")).distinct()
    if seen is None:
        return docs.withColumn("content", F.lit(None).cast("map<string,string>"))
    maps = seen.dropDuplicates([key, "name"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("content"))
    return docs.join(maps, key, "left")


def datagroup_schema_problem(raw: Column) -> Column:
    """The first thing wrong with the JSON text of a data group's schema, null if nothing is. The messages are fixed values.

    A property counts as there unless it is null, false, 0 or an empty text, as scripts see it.
    """
    value = F.try_parse_json(raw)
    at = lambda path: F.try_variant_get(value, path, "variant")
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    tree = lambda v: F.coalesce(kind(v).isin("OBJECT", "ARRAY"), F.lit(False))
    known, names = at("$.properties"), F.json_object_keys(F.get_json_object(raw, "$.properties"))
    there = lambda name: F.coalesce(~F.get_json_object(raw, f"$.properties.{name}").isin("", "null", "false", "0", "0.0", "-0"), F.lit(False)) | tree(at(f"$.properties.{name}"))
    checks = (
        (tree(value), "Schema must be a valid JSON object"),
        ((kind(value) == "OBJECT") & (F.get_json_object(raw, "$.type") == "object"), 'Data group schema must describe an object (type: "object")'),
        (tree(known), 'Data group schema must have a "properties" object'),
        (there("label"), 'Data group schema must have a "label" property'),
        (there("relationships"), 'Data group schema must have a "relationships" property'),
        (F.size(names) == 2, 'Data group schema must have exactly 2 properties: "label" and "relationships"'),
    )
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), message) for ok, message in checks))
