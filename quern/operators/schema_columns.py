"""JSON Schemas as expressions: a resolved schema becomes a Column that lists all errors of a document, held as a VARIANT.

Every keyword is an expression over the value at its place, items are a `transform`, alternatives are lists of errors of
which the emptiness counts. Links that the schema lets data hold are followed into a map of texts where they are met. What
no expression can state (schemas that refer to themselves, the format `regex`, formats of one's own) raises
NotExpressible, and validate() takes its evaluator for those schemas.

Differences from the evaluator: a text that repeats a key within an object isn't JSON here; numbers are compared as doubles;
in `uniqueItems`, numbers inside of items that are objects or arrays count as equal where a VARIANT holds them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import formats as fmt
from quern.functions.canon import number_text
from quern.functions.lets import let

ERRORS = "array<struct<path: string, message: string>>"
NAMES = "array<string>"


class NotExpressible(ValueError):
    """A schema that no expression states."""


def _none() -> Column:
    return F.array().cast(ERRORS)


def _all(parts: list[Column]) -> Column:
    """Lists of errors as one."""
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _entries(v: Column) -> Column:
    """(key, value) of an object by key."""
    return F.array_sort(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))


def _child(v: Column, name: str) -> Column:
    """The value of a property; null where it is absent, a VARIANT null where it is null."""
    if "\\" in name or ("'" in name and '"' in name):
        raise NotExpressible(f"property {name}")
    return F.try_variant_get(v, f'$["{name}"]' if "'" in name else f"$['{name}']", "variant")


_KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def kind_of(v: Column) -> Column:
    """null, boolean, integer, number, string, array or object."""
    named = F.try_element_at(F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv)), F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))
    n = _number(v)
    return F.coalesce(named, F.when((F.floor(n).cast("double") == n) | (F.abs(n) >= 9e15), "integer").otherwise("number"))


def _same(v: Column, const: object) -> Column:
    """Whether a value equals a constant; false where it is absent."""
    kind = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    if const is None:
        same = kind == "VOID"
    elif isinstance(const, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == const)
    elif isinstance(const, (int, float)):
        same = ~kind.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN", "VOID") & (_number(v) == float(const))
    elif isinstance(const, str):
        same = (kind == "STRING") & (_text(v) == const)
    elif isinstance(const, list):
        same = (kind == "ARRAY") & (F.size(_items(v)) == len(const))
        for i, x in enumerate(const):
            same &= let(F.get(_items(v), i), lambda y, x=x: _same(y, x))
    else:
        same = (kind == "OBJECT") & (F.size(_entries(v)) == len(const))
        for name, x in const.items():
            same &= let(_child(v, name), lambda y, x=x: _same(y, x))
    return F.coalesce(same, F.lit(False))


def js_text(v: object) -> str:
    """A constant as a script prints it in a list."""
    if isinstance(v, (list, dict)):
        return ",".join(map(js_text, v)) if isinstance(v, list) else "[object Object]"
    return "" if v is None else {True: "true", False: "false"}[v] if isinstance(v, bool) else v if isinstance(v, str) else number_text(v)


def _escaped(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


class Follow:
    """Where data may hold a link: what `follow` of the evaluator does at a place that is known from the schema.

    at: the place as a.b[]; schema: the schema that following goes by there.
    """

    def __init__(self, schema: object, allowed: frozenset[str], content: Column | None, at: str = ""):
        self.schema = schema if isinstance(schema, dict) else {}
        self.allowed, self.content, self.at = allowed, content, at
        any_of = self.schema.get("anyOf", [])
        self.options = [o for o in any_of if isinstance(o, dict)] if isinstance(any_of, list) else []

    def child(self, name: str) -> Follow:
        own = self.schema.get("properties") or {}
        inner = own.get(name) or next((o["properties"][name] for o in self.options if name in (o.get("properties") or {})), None)
        return Follow(inner, self.allowed, self.content, f"{self.at}.{name}" if self.at else name)

    def item(self) -> Follow:
        return Follow(self.schema.get("items"), self.allowed, self.content, f"{self.at}[]" if self.at else "[]")

    @property
    def here(self) -> bool:
        return self.at in self.allowed or any(o.get("type") != "null" and (o.get("type") == "object" or "properties" in o or not o.get("type")) for o in self.options)

    def names(self) -> list[str]:
        return sorted({*(self.schema.get("properties") or {}), *(k for o in self.options for k in (o.get("properties") or {}))})

    def below(self, depth: int = 0) -> bool:
        """Whether there is such a place here or below."""
        if depth > 40:
            raise NotExpressible("a schema of too many levels")
        return self.here or any(self.child(k).below(depth + 1) for k in self.names()) or ("items" in self.schema and self.item().below(depth + 1))

    def resolved(self, v: Column, above: Column) -> Column:
        """(value, lost, above): the value that a link leads to, from link to link, or the target that leads nowhere; above: the targets on the way here."""
        content = F.create_map().cast("map<string,string>") if self.content is None else F.coalesce(self.content, F.create_map().cast("map<string,string>"))
        state = lambda value, lost, seen: F.struct(value.alias("value"), lost.alias("lost"), seen.alias("above"))

        def hop(s: Column) -> Column:
            target = link_target(s["value"])
            text = F.try_element_at(content, F.regexp_replace(target, r"^(\./)+", ""))
            nowhere = (target == "") | text.isNull() | F.array_contains(s["above"], target)
            next_value = F.coalesce(fmt.json_value(text), text.cast("variant"))
            return F.when(target.isNull() | s["lost"].isNotNull(), s).when(nowhere, state(s["value"], target, s["above"])).otherwise(state(next_value, F.lit(None).cast("string"), F.array_append(s["above"], target)))

        # No chain without a circle is longer than the map.
        hops = F.when(link_target(v).isNotNull(), F.sequence(F.lit(0), F.size(content))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(hops, state(v, F.lit(None).cast("string"), above), lambda s, _: hop(s))

    def value(self, v: Column) -> Column:
        return self.resolved(v, F.array().cast(NAMES))["value"] if self.here else v

    def problems(self, v: Column, above: Column) -> Column:
        """The targets that lead nowhere, in order of the data (properties by name)."""
        if not self.below():
            return F.array().cast(NAMES)

        def inside(s: Column) -> Column:
            parts = [F.when(s["lost"].isNotNull(), F.array(s["lost"])).otherwise(F.array().cast(NAMES))] if self.here else []
            for name in self.names():
                below = self.child(name)
                if below.below():
                    parts.append(below.problems(_child(s["value"], name), s["above"]))
            if "items" in self.schema and self.item().below():
                parts.append(F.coalesce(F.flatten(F.transform(_items(s["value"]), lambda y: self.item().problems(y, s["above"]))), F.array().cast(NAMES)))
            return F.concat(*parts)

        state = self.resolved(v, above) if self.here else F.struct(v.alias("value"), F.lit(None).cast("string").alias("lost"), above.alias("above"))
        return let(state, inside)


def link_target(v: Column) -> Column:
    """The text of a value {"/": text}, null for all others."""
    return F.when(F.schema_of_variant(v) == "OBJECT<`/`: STRING>", F.try_variant_get(v, "$['/']", "string"))


def lost_message(target: Column) -> Column:
    """V3: what is said of a link that leads nowhere."""
    named = F.when(fmt.strict_cid(target), "Failed to resolve CID pointer: ").otherwise("Failed to resolve pointer - not a valid CID or accessible file path: ")
    return F.when(target == "", "Failed to resolve pointer - empty string is not a valid CID or file path").otherwise(F.concat(named, target))


def _nowhere() -> Follow:
    """A place that the schema doesn't name."""
    return Follow(None, frozenset(), None, "?")


class Compiler:
    """Errors of a value as expressions; keywords in the order in which the evaluator reports them."""

    def __init__(self, root: object, messages: dict[str, str], formats: dict[str, Callable[[Column], Column]]):
        self.root, self.messages, self.formats = root, messages, formats

    def at(self, ref: str) -> object:
        found = self.root
        for part in ref.lstrip("#").split("/")[1:]:
            key = part.replace("~1", "/").replace("~0", "~")
            found = found[int(key)] if isinstance(found, list) else found[key]
        return found

    def errors(self, v: Column, schema: object, path: Column, follow: Follow, refs: tuple[str, ...] = ()) -> Column:
        """v: a value that is used once (its links are followed already)."""
        if schema is False:
            return F.array(self.error(path, "boolean schema is false"))
        if not isinstance(schema, dict) or not schema:
            return _none()
        return let(F.struct(v.alias("v"), kind_of(v).alias("k"), path.alias("p")), lambda x: self.of(x["v"], x["k"], x["p"], schema, follow, refs))

    @staticmethod
    def error(path: Column, message: str | Column) -> Column:
        return F.struct(path.alias("path"), (F.lit(message) if isinstance(message, str) else message).alias("message"))

    def of(self, v: Column, kind: Column, path: Column, schema: dict, follow: Follow, refs: tuple[str, ...]) -> Column:
        same = lambda s: self.errors(v, s, path, follow, refs)
        bad = lambda when, message: F.when(F.coalesce(when, F.lit(False)), F.array(self.error(path, message))).otherwise(_none())
        parts: list[Column] = []
        if "$ref" in schema:
            if schema["$ref"] in refs:
                raise NotExpressible(f"{schema['$ref']} refers to itself")
            parts.append(self.errors(v, self.at(schema["$ref"]), path, follow, (*refs, schema["$ref"])))
        numeric = kind.isin("integer", "number")
        if schema.get("type") is not None:
            kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            message = f"must be {','.join(kinds)}"
            fits = kind.isin(*kinds) | ((kind == "integer") & F.lit("number" in kinds))
            if "must be string" in message:
                parts.append(bad(~fits, self.lost_link(v, kind, message)))
            else:
                parts.append(bad(~fits, message))
        n = _number(v)
        for key, wrong, sign in (("maximum", n.__gt__, "<="), ("minimum", n.__lt__, ">="), ("exclusiveMaximum", n.__ge__, "<"), ("exclusiveMinimum", n.__le__, ">")):
            if key in schema:
                parts.append(bad(numeric & wrong(float(schema[key])), f"must be {sign} {js_text(schema[key])}"))
        if "multipleOf" in schema:
            q = n / float(schema["multipleOf"])
            parts.append(bad(numeric & (F.rint(q) != q), f"must be multiple of {js_text(schema['multipleOf'])}"))
        for key in ("maxLength", "minLength"):
            if key in schema:
                size = F.length(_text(v))
                parts.append(bad((kind == "string") & (size > schema[key] if key == "maxLength" else size < schema[key]), self.many(schema[key], "characters", key == "maxLength")))
        if "pattern" in schema:
            parts.append(bad((kind == "string") & ~_text(v).rlike(schema["pattern"]), f'must match pattern "{schema["pattern"]}"'))
        if "format" in schema:
            parts.append(self.of_format(v, kind, schema["format"], bad))
        parts += self.of_array(v, kind, path, schema, follow, refs, bad) + self.of_object(v, kind, path, schema, follow, refs, bad)
        if "const" in schema:
            parts.append(bad(~_same(v, schema["const"]), "must be equal to constant"))
        if "enum" in schema:
            fits = F.lit(False)
            for x in schema["enum"]:
                fits |= _same(v, x)
            parts.append(bad(~fits, f"must be one of: {', '.join(map(js_text, schema['enum']))}"))
        if "not" in schema:
            parts.append(bad(F.size(same(schema["not"])) == 0, "must NOT be valid"))
        for key, message in (("anyOf", "must match a schema in anyOf"), ("oneOf", "must match exactly one schema in oneOf")):
            if key in schema:
                fits = lambda found: F.size(F.filter(found, lambda x: F.size(x) == 0))
                parts.append(let(F.array(*(same(s) for s in schema[key])), lambda found, key=key, message=message, fits=fits: F.when((fits(found) == 0) | ((fits(found) > 1) & F.lit(key == "oneOf")), F.array_append(F.flatten(found), self.error(path, message))).otherwise(_none())))
        parts += [same(s) for s in schema.get("allOf", [])]
        if "if" in schema:
            for key, when in (("else", F.size(same(schema["if"])) > 0), ("then", F.size(same(schema["if"])) == 0)):
                if key in schema:
                    parts.append(F.when(when, let(same(schema[key]), lambda found, key=key: F.when(F.size(found) > 0, F.array_append(found, self.error(path, f'must match "{key}" schema'))).otherwise(_none()))).otherwise(_none()))
        return _all(parts)

    @staticmethod
    def many(n: int, what: str, more: bool) -> str:
        return f"must NOT have {'more' if more else 'fewer'} than {n} {what}"

    @staticmethod
    def lost_link(v: Column, kind: Column, message: str) -> Column:
        """A link that stands where a text should says what it misses."""
        target = F.try_variant_get(v, "$['/']", "string")
        said = F.when(target.startswith("./"), F.concat(F.lit("File "), target, F.lit(" does not exist or is not a valid JSON file."))).otherwise(F.concat(F.lit("Value "), target, F.lit(" is not a valid CID or file path.")))
        return F.when((kind == "object") & target.isNotNull(), said).otherwise(message)

    def of_format(self, v: Column, kind: Column, name: str, bad: Callable) -> Column:
        message = self.messages.get(name, f'must match format "{name}"')
        if name == "currency":
            return bad(kind.isin("integer", "number") & ~fmt.currency_ok(_number(v)), message)
        if name not in self.formats:
            return _none()
        if self.formats[name] is None:
            raise NotExpressible(f"format {name}")
        return bad((kind == "string") & ~self.formats[name](_text(v)), message)

    def of_array(self, v: Column, kind: Column, path: Column, schema: dict, follow: Follow, refs: tuple[str, ...], bad: Callable) -> list[Column]:
        parts, array, size = [], kind == "array", F.size(_items(v))
        of_all = lambda f: F.when(array, F.flatten(F.transform(_items(v), lambda x, i: f(x, i)))).otherwise(_none())
        step = lambda i: F.concat(path, F.lit("/"), i.cast("string"))
        item = follow.item()
        sub = lambda x, s, i: self.errors(item.value(x), s, step(i), item, refs)
        for key in ("maxItems", "minItems"):
            if key in schema:
                parts.append(bad(array & (size > schema[key] if key == "maxItems" else size < schema[key]), self.many(schema[key], "items", key == "maxItems")))
        if schema.get("uniqueItems"):
            key = lambda x: F.when(kind_of(x).isin("integer", "number"), _number(x).cast("string")).otherwise(F.concat(kind_of(x), F.to_json(x)))

            def pair(keys: Column) -> Column:
                later = F.array_max(F.filter(F.transform(keys, lambda k, i: F.when(F.array_position(keys, k) <= i, i)), lambda i: i.isNotNull()))
                return let(later, lambda j: F.concat(F.lit("must NOT have duplicate items (items ## "), (j - F.array_position(F.reverse(F.slice(keys, F.lit(1), j)), F.get(keys, j)).cast("int")).cast("string"), F.lit(" and "), j.cast("string"), F.lit(" are identical)")))

            parts.append(let(F.when(array, F.transform(_items(v), key)), lambda keys: bad(F.size(keys) > F.size(F.array_distinct(keys)), pair(keys))))
        items = schema.get("items")
        if isinstance(items, list):
            rest = schema.get("additionalItems", True)
            if rest is False:
                parts.append(bad(array & (size > len(items)), self.many(len(items), "items", True)))
            for i, s in enumerate(items):
                parts.append(F.when(array & (size > i), sub(F.get(_items(v), i), s, F.lit(i))).otherwise(_none()))
            if isinstance(rest, dict) and rest:
                parts.append(of_all(lambda x, i: F.when(i >= len(items), sub(x, rest, i)).otherwise(_none())))
        elif items is not None and items is not True:
            parts.append(of_all(lambda x, i: sub(x, items, i)))
        if "contains" in schema:
            found = F.transform(_items(v), lambda x, i: sub(x, schema["contains"], i))
            parts.append(F.when(array, let(found, lambda f: F.when(F.forall(f, lambda x: F.size(x) > 0), F.array_append(F.flatten(f), self.error(path, "must contain at least 1 valid item(s)"))).otherwise(_none()))).otherwise(_none()))
        return parts

    def of_object(self, v: Column, kind: Column, path: Column, schema: dict, follow: Follow, refs: tuple[str, ...], bad: Callable) -> list[Column]:
        parts, tree, size = [], kind == "object", F.size(_entries(v))
        there = lambda name: _child(v, name).isNotNull()
        step = lambda name: F.concat(path, F.lit("/"), F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        of_all = lambda f: F.when(tree, F.flatten(F.transform(_entries(v), lambda e: f(e)))).otherwise(_none())
        for key in ("maxProperties", "minProperties"):
            if key in schema:
                parts.append(bad(tree & (size > schema[key] if key == "maxProperties" else size < schema[key]), self.many(schema[key], "properties", key == "maxProperties")))
        parts += [bad(tree & ~there(name), f"missing required property '{name}'") for name in schema.get("required", [])]
        for name, needs in schema.get("dependencies", {}).items():
            if isinstance(needs, list):
                what = f"property {needs[0]}" if len(needs) == 1 else f"properties {', '.join(needs)}"
                parts += [bad(tree & there(name) & ~there(n), f"must have {what} when property {name} is present") for n in needs]
            else:
                parts.append(F.when(tree & there(name), self.errors(v, needs, path, follow, refs)).otherwise(_none()))
        if "propertyNames" in schema:
            named = lambda e: let(self.errors(e["key"].cast("variant"), schema["propertyNames"], path, _nowhere(), refs), lambda f: F.when(F.size(f) > 0, F.array_append(f, self.error(path, "property name must be valid"))).otherwise(_none()))
            parts.append(of_all(named))
        known, patterns, rest = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
        if rest is not True:
            other = lambda e: ~e["key"].isin(*known) if known else F.lit(True)
            if patterns:
                other = lambda e, own=other: own(e) & ~F.array_contains(F.array(*(e["key"].rlike(p) for p in patterns)), True)
            if rest is False:
                parts.append(of_all(lambda e: F.when(other(e), F.array(self.error(path, F.concat(F.lit("unexpected property '"), e["key"], F.lit("'"))))).otherwise(_none())))
            elif rest:
                parts.append(of_all(lambda e: F.when(other(e), self.errors(e["value"], rest, step(e["key"]), _nowhere(), refs)).otherwise(_none())))
        for name, s in known.items():
            if s is True or s == {}:
                continue
            below = follow.child(name)
            parts.append(F.when(tree & there(name), self.errors(below.value(_child(v, name)), s, F.concat(path, F.lit(f"/{_escaped(name)}")), below, refs)).otherwise(_none()))
        for p, s in patterns.items():
            if any(follow.child(n).below() for n in known):
                raise NotExpressible("patternProperties beside properties that may hold links")
            parts.append(of_all(lambda e, p=p, s=s: F.when(e["key"].rlike(p), self.errors(e["value"], s, step(e["key"]), _nowhere(), refs)).otherwise(_none())))
        return parts


def compiled(raw: Column, schema: object, allowed: list[str], content: Column | None, messages: dict[str, str], formats: dict[str, Callable[[Column], Column] | None]) -> Column:
    """All reported errors of a document's text against a resolved schema."""
    follow = Follow(schema, frozenset(allowed), content)
    compiler = Compiler(schema, messages, formats)
    failed = lambda message: F.array(F.struct(F.lit("").alias("path"), message.alias("message")))

    def judged(v: Column) -> Column:
        found = compiler.errors(follow.value(v), schema, F.lit(""), follow)
        found = F.transform(found, lambda e: F.struct(F.when(e["path"] == "", "/").otherwise(e["path"]).alias("path"), e["message"].alias("message")))
        if not follow.below():
            return found
        lost = F.get(follow.problems(v, F.array().cast(NAMES)), 0)
        return let(lost, lambda target: F.when(target.isNotNull(), failed(F.concat(F.lit("Validation error: "), lost_message(target)))).otherwise(found))

    return let(fmt.json_value(raw), lambda v: F.when(v.isNull(), failed(F.lit("File read/parse error"))).otherwise(judged(v)))


def failure(message: str) -> Column:
    return F.array(F.struct(F.lit("").alias("path"), F.lit(message).alias("message")))

