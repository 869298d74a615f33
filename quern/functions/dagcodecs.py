"""The two codecs of linked data, dag-cbor and dag-json: deterministic bytes of a JSON value, and back.

dag-cbor: keys by length, then bytes; the shortest form of whole numbers that scripts hold exactly, 64 bits for all other
numbers; links as tag 42. dag-json: keys in order, no white space, numbers that aren't whole with a point. Values are trees
of any depth, which no expression walks, so both run on Arrow batches.
"""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.canon import canonical, cid_v1, is_link, keys_in_order, number_text
from quern.functions.multiformats import DAG_CBOR, DAG_JSON, Cid, base32_text, base58_text, parse_cid, varint

#: Fixed value: the greatest whole number that a double holds among all of its neighbours.
SAFE = (1 << 53) - 1
LINK_TAG = 42


def _cid_bytes(cid: Cid) -> bytes:
    head = b"" if cid.version == 0 else varint(1) + varint(cid.codec)
    return head + varint(cid.hash_code) + varint(len(cid.digest)) + cid.digest


def _cid_text(data: bytes) -> str:
    return base58_text(data) if data[:2] == b"\x12\x20" and len(data) == 34 else "b" + base32_text(data)


def _whole(v: float | int) -> bool:
    return float(v).is_integer() and abs(v) <= SAFE


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    size = next(k for k in (0, 1, 2, 3) if n < 1 << (8 << k))
    return bytes([major << 5 | 24 + size]) + n.to_bytes(1 << size, "big")


def cbor(v: object, links: bool = True) -> bytes:
    """links: whether {"/": identifier} is a link, else it is an object like others."""
    if v is None or isinstance(v, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[v]
    if isinstance(v, (int, float)):
        return (_head(0, int(v)) if v >= 0 else _head(1, -1 - int(v))) if _whole(v) else b"\xfb" + struct.pack(">d", v)
    if isinstance(v, str):
        return _head(3, len(v.encode())) + v.encode()
    if isinstance(v, list):
        return _head(4, len(v)) + b"".join(cbor(x, links) for x in v)
    if links and is_link(v) and (cid := parse_cid(v["/"])):
        data = b"\0" + _cid_bytes(cid)
        return _head(6, LINK_TAG) + _head(2, len(data)) + data
    keys = sorted((k.encode() for k in v), key=lambda k: (len(k), k))
    return _head(5, len(keys)) + b"".join(_head(3, len(k)) + k + cbor(v[k.decode()], links) for k in keys)


def of_cbor(data: bytes) -> object:
    """The value of dag-cbor bytes; ValueError where they are anything else."""
    value, at = _read(data, 0)
    if at != len(data):
        raise ValueError("more than one value")
    return value


def _read(data: bytes, at: int) -> tuple[object, int]:
    if at >= len(data):
        raise ValueError("cut off")
    major, low, at = data[at] >> 5, data[at] & 31, at + 1
    if major == 7:
        if low == 27:
            return struct.unpack(">d", data[at : at + 8])[0], at + 8
        if low not in (20, 21, 22):
            raise ValueError("not of this codec")
        return {20: False, 21: True, 22: None}[low], at
    if low > 27:
        raise ValueError("not of this codec")
    size = 0 if low < 24 else 1 << low - 24
    n = low if low < 24 else int.from_bytes(data[at : at + size], "big")
    at += size
    if major < 2:
        return n if major == 0 else -1 - n, at
    if major in (2, 3):
        if at + n > len(data):
            raise ValueError("cut off")
        return data[at : at + n] if major == 2 else data[at : at + n].decode(), at + n
    if major == 6:
        inner, at = _read(data, at)
        if n != LINK_TAG or not isinstance(inner, bytes) or inner[:1] != b"\0":
            raise ValueError("not a link")
        return {"/": _cid_text(inner[1:])}, at
    items = []
    for _ in range(n * (major - 3)):
        item, at = _read(data, at)
        items.append(item)
    return items if major == 4 else dict(zip(items[::2], items[1::2], strict=True)), at


def dag_json(v: object) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{canonical(k)}:{dag_json(v[k])}" for k in keys_in_order(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(dag_json, v)) + "]"
    if isinstance(v, (int, float)) and not isinstance(v, bool) and not _whole(v):
        text = number_text(v)
        return text if "." in text or "e" in text else text + ".0"
    return canonical(v)


def _or_null(f, v: object) -> object:
    try:
        return f(v)
    except (ValueError, RecursionError, OverflowError):
        return None


def _each(f, texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _or_null(lambda t: f(json.loads(t)), t), na_action="ignore")


@F.pandas_udf(T.BinaryType())
def cbor_of_json(texts: pd.Series) -> pd.Series:
    """The dag-cbor bytes of JSON text, null where it isn't JSON."""
    return _each(cbor, texts)


@F.pandas_udf(T.StringType())
def json_of_cbor(data: pd.Series) -> pd.Series:
    """The canonical JSON of dag-cbor bytes, null where they are none."""

    def one(b):
        try:
            return canonical(of_cbor(bytes(b)))
        except (ValueError, TypeError, RecursionError, struct.error):
            return None

    return data.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def dag_cbor_cid(texts: pd.Series) -> pd.Series:
    """The identifier of a JSON text as dag-cbor."""
    return _each(lambda v: cid_v1(cbor(v), DAG_CBOR), texts)


@F.pandas_udf(T.StringType())
def dag_json_cid(texts: pd.Series) -> pd.Series:
    """The identifier of a JSON text as dag-json."""
    return _each(lambda v: cid_v1(dag_json(v).encode(), DAG_JSON), texts)


@F.pandas_udf(T.StructType([T.StructField("cbor", T.BinaryType()), T.StructField("cbor_cid", T.StringType()), T.StructField("json_cid", T.StringType())]))
def dag_forms(texts: pd.Series) -> pd.DataFrame:
    """The dag-cbor bytes of JSON texts and their identifiers in both codecs, each text read once; null where there are none."""

    def forms(v):
        data = _or_null(cbor, v)
        return data, data and cid_v1(data, DAG_CBOR), _or_null(lambda v: cid_v1(dag_json(v).encode(), DAG_JSON), v)

    return pd.DataFrame([x if isinstance(x, tuple) else (None, None, None) for x in _each(forms, texts)], columns=["cbor", "cbor_cid", "json_cid"], dtype=object)
