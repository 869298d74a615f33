"""URLs and query maps: parse into a request, build from one, and the loosely quoted maps of seed files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decode(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def query_pairs(url: Column) -> Column:
    """The query of a URL as an array of (key, value) in order."""
    raw = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != "")
    return F.transform(raw, lambda p: F.struct(_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("key"), _decode(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("value")))


def multi_map(pairs: Column) -> Column:
    """(key, value) pairs as map key -> values, both in order of first appearance."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]).alias("value"))))


def url_base(url: Column) -> Column:
    """Scheme, host and path, without a slash at the end."""
    return F.regexp_replace(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*)", 1), "/$", "")


def url_request(url: Column) -> Column:
    """A GET request description of a URL."""
    return F.struct(url_base(url).alias("url"), F.lit("GET").alias("method"), multi_map(query_pairs(url)).alias("multiValueQueryString"))


def _form(x: Column) -> Column:
    return F.url_encode(x)


def construct_url(base: Column, query: Column) -> Column:
    """The URL with its whole query replaced by a map key -> values; a null map leaves it as it is, an empty one clears it."""
    parts = F.flatten(F.transform(F.map_entries(query), lambda e: F.transform(e["value"], lambda v: F.concat(_form(e["key"]), F.lit("="), _form(v)))))
    bare = F.regexp_replace(base, r"\?[^#]*", "")
    return F.when(query.isNull(), base).when(F.size(parts) == 0, bare).otherwise(F.concat(bare, F.lit("?"), F.array_join(parts, "&")))


def loose_query_map(text: Column) -> Column:
    """map<string, array<string>> from JSON, also with single quotes (an escaped one inside stays); null if neither."""
    kind = "map<string,array<string>>"
    repaired = F.replace(F.replace(F.replace(text, F.lit("\\'"), F.lit("\u0001")), F.lit("'"), F.lit('"')), F.lit("\u0001"), F.lit("'"))
    return F.coalesce(F.from_json(text, kind), F.from_json(repaired, kind))


def fill_template(text: Column, request_id: Column) -> Column:
    """The one template variable that requests use."""
    return F.replace(text, F.lit("{{=it.request_identifier}}"), request_id)


def swap_first_uuid(text: Column, value: Column) -> Column:
    """The first UUID of a text replaced."""
    found = F.regexp_extract(text, "(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1)
    at = F.position(found, text)
    return F.when(found == "", text).otherwise(F.concat(F.substr(text, F.lit(1), at - 1), value, F.substr(text, at + F.length(found))))
