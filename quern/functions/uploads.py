"""What a document's upload replaces, as its schema says: addresses of files and links, walked with data and schema together."""

from __future__ import annotations

import json
import posixpath
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.canon import ADDRESS_FIELD, canonical, is_link, sort_links
from quern.functions.multiformats import parse_cid

#: Extensions of files that are uploaded as they are.
_IMAGE = re.compile(r"(?i)\.(png|jpe?g|gif|svg|webp)$")
IMAGE = _IMAGE.pattern
URI = "ipfs://"


def _is_address(value: object, schema: object, field: str | None) -> bool:
    return isinstance(value, str) and (field == ADDRESS_FIELD or (isinstance(schema, dict) and schema.get("format") == "ipfs_uri"))


def _inner(value: object, schema: object, field: str | None) -> list[tuple[object, object, object, str | None]]:
    """(key, value, schema, field) of what is within a list or object; a list's items are still of its field."""
    schema = schema if isinstance(schema, dict) else {}
    if isinstance(value, list):
        return [(k, x, schema.get("items"), field) for k, x in enumerate(value)]
    known = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
    return [(k, x, known.get(k), k) for k, x in value.items()]


def references(value: object, schema: object, field: str | None = None) -> list[tuple[str, str]]:
    """(kind, target) of each place: `address` of an image, `link` to a file; identifiers are none."""
    if _is_address(value, schema, field):
        return [("address", value)] if not value.startswith(URI) and parse_cid(value) is None and _IMAGE.search(value) else []
    if is_link(value):
        return [("link", value["/"])] if parse_cid(value["/"]) is None else []
    return [r for _, x, s, f in _inner(value, schema, field) for r in references(x, s, f)] if isinstance(value, (list, dict)) else []


def replaced(value: object, schema: object, cids: dict[tuple[str, str], str], field: str | None = None) -> object:
    """The value with (kind, target) replaced by identifiers."""
    if _is_address(value, schema, field):
        if value.startswith(URI):
            return value
        cid = value if parse_cid(value) else cids.get(("address", value))
        return URI + cid if cid else value
    if is_link(value):
        return {"/": cids.get(("link", value["/"]), value["/"])}
    if not isinstance(value, (list, dict)):
        return value
    inner = [(k, replaced(x, s, cids, f)) for k, x, s, f in _inner(value, schema, field)]
    return [x for _, x in inner] if isinstance(value, list) else dict(inner)


def _loaded(text: str) -> object:
    """JSON, or else the text itself, which then is uploaded as a JSON string."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return text


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "target", "file")])))
def upload_references(names: pd.Series, texts: pd.Series, schemas: pd.Series) -> pd.Series:
    """The distinct references of documents, with the file each names from the document's own folder (rows of a schema's JSON text or null)."""
    rows = []
    for name, text, schema in zip(names, texts, schemas, strict=True):
        found = dict.fromkeys(references(_loaded(text), json.loads(schema) if schema else None)) if text is not None else {}
        rows.append([{"kind": k, "target": t, "file": posixpath.normpath(posixpath.join(posixpath.dirname(name), t))} for k, t in found])
    return pd.Series(rows, dtype=object)


@F.pandas_udf(T.StringType())
def upload_text(texts: pd.Series, schemas: pd.Series, swaps: pd.Series) -> pd.Series:
    """The canonical text after replacement; swaps: rows of (kind, target, cid)."""
    out = []
    for text, schema, swap in zip(texts, schemas, swaps, strict=True):
        cids = {(s["kind"], s["target"]): s["cid"] for s in (swap if swap is not None else [])}
        out.append(None if text is None else canonical(sort_links(replaced(_loaded(text), json.loads(schema) if schema else None, cids))))
    return pd.Series(out, dtype=object)
