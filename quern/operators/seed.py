"""Seed rows into documents: addresses, coordinates, source requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.urls import loose_query_map


def blank_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def full_address(direct: Column, street: list[Column], city: Column, state: Column, zip_code: Column, plus4: Column | None = None) -> Column:
    """The address as given, else street parts by spaces, city, state and code, by commas; empty parts vanish."""
    code = zip_code if plus4 is None else F.concat_ws("-", blank_null(zip_code), blank_null(plus4))
    tail = F.concat_ws(" ", blank_null(state), blank_null(code))
    composed = F.concat_ws(", ", blank_null(F.concat_ws(" ", *map(blank_null, street))), blank_null(city), blank_null(tail))
    return F.coalesce(blank_null(direct), blank_null(composed))


def leading_number(x: Column) -> Column:
    """The number at the start of a text, what follows ignored; null if there is none."""
    return F.regexp_extract(F.trim(x), r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def coordinates(lon: Column, lat: Column) -> Column:
    """Both or none."""
    both = blank_null(lon).isNotNull() & blank_null(lat).isNotNull()
    return F.struct(F.when(both, leading_number(lon)).alias("longitude"), F.when(both, leading_number(lat)).alias("latitude"))


#: What is wrong with a seed row.
BOTH_BODIES = "Both json and body fields are present in seed.csv. Only one of these fields can be processed at a time."
NO_COUNTY = "County field is required in seed.csv and cannot be empty"


def source_request(url: Column, method: Column, query: Column, headers: Column, json: Column, body: Column) -> Column:
    """A request description; a JSON body is embedded as JSON and sets the content type, a blank query map is empty."""
    given = lambda c: F.when(c != "", c)
    no_pairs = F.from_json(F.lit("{}"), "map<string,array<string>>")
    base = F.from_json(given(headers), "map<string,string>")
    typed = F.map_concat(F.map_filter(F.coalesce(base, F.from_json(F.lit("{}"), "map<string,string>")), lambda k, v: k != "content-type"), F.create_map(F.lit("content-type"), F.lit("application/json")))
    return F.struct(
        url.alias("url"),
        method.alias("method"),
        F.when(blank_null(query).isNull(), no_pairs).otherwise(loose_query_map(query)).alias("multiValueQueryString"),
        F.when(given(json).isNotNull(), typed).otherwise(base).alias("headers"),
        F.try_parse_json(given(json)).alias("json"),
        given(body).alias("body"),
    )


def with_headers(headers: Column) -> Column:
    """Headers without those that have no value; null if none is left."""
    kept = F.map_filter(headers, lambda k, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def seed_problem(county: Column, json: Column, body: Column) -> Column:
    """Why a seed row makes no documents, null if it does."""
    return F.when((json != "") & (body != ""), BOTH_BODIES).when(blank_null(county).isNull(), NO_COUNTY)


def seed_documents(seeds: DataFrame, seed_cid: str = "seed") -> DataFrame:
    """The documents of every seed row, as (parcel_id, name, content).

    seeds: parcel_id, source_identifier, county, address, longitude, latitude (numbers, both or none), request (a struct).
    """
    common = {"source_http_request": F.col("request"), "request_identifier": F.col("source_identifier")}
    text = lambda **f: F.to_json(F.struct(*(v.alias(k) for k, v in f.items())))
    doc = lambda name, content: F.struct(F.lit(name).alias("name"), content.alias("content"))
    link = lambda p: F.struct(F.lit(p).alias("/"))
    place = {"longitude": F.col("longitude"), "latitude": F.col("latitude")}
    address = {**common, "county_name": F.col("county"), "unnormalized_address": F.col("address")}
    # An address without coordinates says so; to_json would leave nulls out.
    bare = F.concat(F.regexp_replace(text(**address), r"\}$", ""), F.lit(',"longitude":null,"latitude":null}'))
    docs = F.array(
        doc(f"{seed_cid}.json", text(label=F.lit("Seed"), relationships=F.struct(link("./address_has_parcel.json").alias("address_has_parcel")))),
        doc("address_has_parcel.json", text(**{"from": link("./address.json"), "to": link("./parcel.json")})),
        doc("address.json", F.when(F.col("longitude").isNotNull() & F.col("latitude").isNotNull(), text(**address, **place)).otherwise(bare)),
        doc("parcel.json", text(**common, parcel_identifier=F.col("parcel_id"))),
        doc("unnormalized_address.json", text(**common, full_address=F.col("address"), county_jurisdiction=F.col("county"), **place)),
        doc("property_seed.json", text(**common, parcel_id=F.col("parcel_id"))),
    )
    return seeds.select("parcel_id", F.explode(docs).alias("d")).select("parcel_id", "d.name", "d.content")
