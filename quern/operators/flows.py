"""Requests: templates, normal forms, rules of multi-request flows, their results, paged sources, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.urls import fill_template, query_pairs, url_base

PAIRS = "array<struct<key:string,values:array<string>>>"


def filled(request: Column, identifier: Column) -> Column:
    """Every text of a request's description (a struct of url, method, query, headers, json, body) with its template filled.

    query: map of lists, headers: map, json: a text of JSON. Only texts that hold a template change.
    """
    fill = lambda c: fill_template(c, identifier)
    return F.struct(
        fill(request["url"]).alias("url"),
        request["method"].alias("method"),
        F.transform_values(request["query"], lambda k, v: F.transform(v, fill)).alias("query"),
        F.transform_values(request["headers"], lambda k, v: fill(v)).alias("headers"),
        fill(request["json"]).alias("json"),
        fill(request["body"]).alias("body"),
    )


def normalized(request: Column) -> Column:
    """The URL's query moved into the map, what the map had after it; the URL keeps scheme, host and path."""
    entries = F.concat(F.transform(query_pairs(request["url"]), lambda p: F.struct(p["key"].alias("key"), F.array(p["value"]).alias("values"))), F.coalesce(F.transform(F.map_entries(request["query"]), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("values"))), F.array().cast(PAIRS)))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    merged = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.flatten(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["values"])).alias("value"))))
    return F.struct(
        F.regexp_extract(request["url"], "^([^?#]*)", 1).alias("url"),
        request["method"].alias("method"),
        F.when(F.size(keys) > 0, merged).alias("multiValueQueryString"),
        request["headers"].alias("headers"),
        F.try_parse_json(request["json"]).alias("json"),
        request["body"].alias("body"),
    )


#: The rules of a request, in order, and their messages.
METHODS, SENDING = ("GET", "POST", "PUT", "PATCH"), ("POST", "PUT", "PATCH")
BAD_URL = "URL must start with http:// or https://"
GET_BODY = "GET requests cannot have body or json fields"
TWO_BODIES = "Cannot have both json and body fields"
JSON_TYPE = "json body requires content-type: application/json"
BODY_TYPE = "body field requires content-type header to be set (and not application/json)"
JSON_MISSING = "POST/PUT/PATCH with content-type: application/json requires json field"
BODY_MISSING = "POST/PUT/PATCH with non-json content-type requires body field"
EMPTY_KEY, NO_REQUESTS = "Request key cannot be empty", "Multi-request flow must have at least one request"


def request_problems(request: Column) -> Column:
    """All rules that a request of a flow breaks."""
    kind, json, body = F.element_at(request["headers"], "content-type"), request["json"].isNotNull(), request["body"].isNotNull()
    is_json, sends = F.coalesce(kind == "application/json", F.lit(False)), request["method"].isin(*SENDING)
    typed = F.coalesce(kind != "", F.lit(False))
    rules = (
        (~request["url"].rlike("^https?://"), BAD_URL),
        ((request["method"] == "GET") & (json | F.coalesce(request["body"] != "", F.lit(False))), GET_BODY),
        (json & body, TWO_BODIES),
        (json & ~is_json, JSON_TYPE),
        (body & ~(typed & ~is_json), BODY_TYPE),
        (sends & is_json & ~json, JSON_MISSING),
        (sends & typed & ~is_json & ~body, BODY_MISSING),
    )
    return F.filter(F.array(*(F.when(bad, message) for bad, message in rules)), lambda m: m.isNotNull())


def flow_problems(requests: DataFrame) -> DataFrame:
    """Flow, problems: rules that its requests break, empty keys, and the first key that comes again.

    requests: flow, pos, key, request; a flow is short, so its problems are one list.
    """
    own = F.transform(F.concat(F.when(F.col("key") == "", F.array(F.lit(EMPTY_KEY))).otherwise(F.array().cast("array<string>")), request_problems(F.col("request"))), lambda m: F.concat(F.lit("requests."), F.col("pos").cast("string"), F.lit(": "), m))
    listed = requests.groupBy("flow").agg(F.array_sort(F.collect_list(F.struct("pos", own.alias("own")))).alias("all"))
    again = requests.groupBy("flow", "key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("pos")).alias("at")).filter("n > 1")
    again = again.groupBy("flow").agg(F.min_by("key", F.get("at", 1)).alias("twice"))
    message = F.when(F.col("twice").isNotNull(), F.array(F.concat(F.lit('Duplicate request key: "'), "twice", F.lit('"')))).otherwise(F.array().cast("array<string>"))
    return listed.join(again, "flow", "left").select("flow", F.concat(F.flatten(F.transform("all", lambda x: x["own"])), message).alias("problems"))


def flow_results(ids: DataFrame, flow: DataFrame, responses: DataFrame, column: str = "request_identifier") -> DataFrame:
    """Per identifier one JSON object, key -> {source_http_request, response}.

    flow: key, request (few rows); responses: the identifier, key, text. A response is embedded as JSON if it is an object
    or a list, else as text.
    """
    steps = flow.select("key", "request")
    asked = ids.filter(F.trim(F.col(column)) != "").crossJoin(F.broadcast(steps))  # a flow has a few requests
    asked = asked.withColumn("request", normalized(filled(F.col("request"), F.col(column))))
    met = asked.join(responses.select(F.col(column).alias("_id"), F.col("key").alias("_key"), "text"), (F.col(column) == F.col("_id")) & (F.col("key") == F.col("_key")))
    tree = F.try_parse_json("text")
    both = lambda response: F.to_json(F.struct(F.col("request").alias("source_http_request"), response.alias("response")))
    single = F.when(F.col("text").rlike(r"^\s*[\[{]") & tree.isNotNull(), both(tree)).otherwise(both(F.col("text")))
    each = met.select(column, F.col("key").alias("k"), F.concat(F.regexp_replace(F.to_json(F.array("key")), r"^\[|\]$", ""), F.lit(":"), single).alias("entry"))
    per = each.groupBy(column).agg(F.array_sort(F.collect_list(F.struct("k", "entry"))).alias("all"))
    return per.select(column, F.concat(F.lit("{"), F.array_join(F.transform("all", lambda x: x["entry"]), ","), F.lit("}")).alias("combined"))


def swapped_request(entry: Column, final_url: Column) -> Column:
    """After a walk through pages, the request that it ended with, and the one that it began with beside it."""
    moved = final_url.isNotNull() & (final_url != entry["url"])
    last = F.struct(F.when(moved, url_base(final_url)).otherwise(entry["url"]).alias("url"), F.when(moved, "GET").otherwise(entry["method"]).alias("method"))
    return F.struct(last.alias("source_http_request"), F.when(moved, entry).alias("entry_http_request"))


def paged_years(parcels: DataFrame, pages: DataFrame, last: int) -> DataFrame:
    """Per parcel the tax years from the last one down, up to the first that has no page, or an empty one.

    pages: parcel, year, amount (null or 0: an empty page). The run ends at the greatest year below which nothing counts,
    so no year is asked for in turn. Hyphens of a parcel's number don't count (G12).
    """
    good = pages.filter("amount <> 0").select(F.replace("parcel", F.lit("-"), F.lit("")).alias("p"), "year", "amount").filter(F.col("year") <= last)
    ranked = good.groupBy("p").agg(F.array_sort(F.collect_set("year")).alias("years"))  # a year each
    held = F.filter("years", lambda y: F.size(F.filter(F.col("years"), lambda z: z >= y)) == F.lit(last) - y + 1)
    runs = ranked.select("p", F.explode(held).alias("year"))
    return parcels.withColumn("p", F.replace("parcel", F.lit("-"), F.lit(""))).join(runs, "p").join(good, ["p", "year"]).select("parcel", "year", "amount")


def route(multi_flow: Column, county: Column, flow_file: Column, template: Column, browser: Column) -> Column:
    """Who fetches a row, the first that applies."""
    given = lambda c: F.coalesce(c.cast("string") != "", F.lit(False))
    return F.when(given(multi_flow), "multi-request").when(F.lower(F.trim(county)) == "orange", "county").when(given(flow_file), "flow file").when(given(template), "template").when(F.coalesce(browser, F.lit(False)), "browser").otherwise("fetch")
