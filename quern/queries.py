"""Registry of the engine's own queries: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL for each that SQL can state.

The tables hold no records of the engine's own domain, so operators run on columns of the same shape: orders stand for
submissions, events for logs and errors, parts for files, pages for fetched documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import canon, cid, formats, html, urls
from quern.operators import documents, errors, fetch, graph, owners, relate, seed, submit, validate
from quern.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


CID_SQL = (
    "'b'||substr(array_to_string(list_transform(range(60), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', "
    "1+((('0x'||substr(rpad('01551220'||{h},75,'0'),((i//4)*5+1)::BIGINT,5))::BIGINT >> (15-5*(i%4))::BIGINT) & 31)::BIGINT,1)),''),1,58)"
)


# Identifiers and content.


@query(f"SELECT {CID_SQL.format(h='sha256(text)')} AS cid, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def cid_dedup_documents(spark, sf_dir):
    """A11 over C3: distinct contents with their number of copies."""
    return table(spark, sf_dir, "documents").groupBy(cid.cid_raw(F.col("text")).alias("cid")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT doc_id, {CID_SQL.format(h='sha256(text)')} AS cid FROM documents")
def cid_raw_documents(spark, sf_dir):
    """The identifier of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", cid.cid_raw(F.col("text")).alias("cid"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def cid_to_hex_roundtrip(spark, sf_dir):
    """From text to identifier and back to the hash."""
    return table(spark, sf_dir, "documents").select("doc_id", cid.hash_of_cid(cid.cid_raw(F.col("text"))).alias("hash"))


@query(f"SELECT cid, min(text) AS data FROM (SELECT {CID_SQL.format(h='sha256(text)')} AS cid, text FROM benchmark) GROUP BY 1")
def content_verify(spark, sf_dir):
    """Three gateways, the first with broken content; the next one that fits counts."""
    base = table(spark, sf_dir, "benchmark").select(cid.cid_raw(F.col("text")).alias("cid"), F.col("text"))
    tries = base.select("cid", F.explode(F.array(F.struct(F.lit(0).alias("gateway"), F.concat("text", F.lit("?")).alias("data")), F.struct(F.lit(1).alias("gateway"), F.col("text").alias("data")))).alias("t"))
    return fetch.verified(tries.select("cid", "t.gateway", "t.data"))


@query(r"""SELECT doc_id, CASE WHEN length(x) < 10 THEN false WHEN starts_with(x, 'Qm') AND length(x) = 46 THEN regexp_full_match(x, 'Qm[a-zA-Z0-9]+')
WHEN starts_with(x, 'b') AND length(x) > 20 THEN regexp_full_match(x, 'b[a-z2-7]+') ELSE regexp_full_match(x, '[a-zA-Z0-9]{20,}') END AS ok
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'b' || sha256(text) WHEN 1 THEN sha256(text) ELSE lang || source END AS x FROM documents)""")
def cid_loose_ok(spark, sf_dir):
    """what may be an identifier."""
    h = F.sha2(F.col("text").cast("binary"), 256)
    x = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("b"), h)).when(F.col("doc_id") % 3 == 1, h).otherwise(F.concat("lang", "source"))
    return table(spark, sf_dir, "documents").select("doc_id", formats.loose_cid(x).alias("ok"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'length' WHEN 2 THEN 'digits' END AS problem FROM documents")
def hash_problems(spark, sf_dir):
    """F8: the first thing wrong with a hash in hex."""
    h = F.sha2(F.col("text").cast("binary"), 256)
    k = F.col("doc_id") % 4
    x = F.when(k == 0, "").when(k == 1, F.substr(h, F.lit(2))).when(k == 2, F.concat(F.lit("x"), F.substr(h, F.lit(2)))).otherwise(F.concat(F.lit("0x"), h))
    return table(spark, sf_dir, "documents").select("doc_id", formats.hash_problem(x).alias("problem"))


@query("SELECT event_id, replace(props, ' ', '') AS canonical FROM events")
def canonical_json(spark, sf_dir):
    """Canonical JSON of the props (one key each, so SQL can state it)."""
    return table(spark, sf_dir, "events").select("event_id", canon.canonical_json(F.col("props")).alias("canonical"))


@query()
def canonical_cids(spark, sf_dir):
    """Identifiers of canonical JSON with a sorted array of links, as raw and as dag-pb."""
    links = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("./"), "event_type").alias("/")), F.struct(F.lit("./a").alias("/"))).alias("links"), F.col("value").alias("v")))
    text = canon.canonical_links_json(links)
    return table(spark, sf_dir, "events").select("event_id", text.alias("canonical")).select("event_id", cid.cid_raw(F.col("canonical")).alias("cid"), canon.cid_dag_pb_of(F.encode("canonical", "UTF-8")).alias("dag_pb"), canon.cid_v0_of(F.encode("canonical", "UTF-8")).alias("v0"))


# Formats.


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_extendedprice >= 0 AND round(l_extendedprice, 2) = l_extendedprice) AS prices, count(*) FILTER (WHERE round(l_extendedprice / 3, 2) = l_extendedprice / 3) AS thirds, count(*) AS n FROM lineitem GROUP BY 1")
def currency_ok(spark, sf_dir):
    """V5: amounts with at most two decimals."""
    ok = lambda c: F.count_if(formats.currency_ok(c))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(ok(F.col("l_extendedprice")).alias("prices"), ok(F.col("l_extendedprice") / 3).alias("thirds"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, regexp_full_match(x, '[0-9]+\\.[0-9]{3}') AS ok FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber || '.125' ELSE l_linenumber || '.5' END AS x FROM lineitem)")
def rate_percent_ok(spark, sf_dir):
    """V7: percentages with three decimals."""
    n = F.col("l_linenumber").cast("string")
    x = F.when(F.col("l_linenumber") % 2 == 0, F.concat(n, F.lit(".125"))).otherwise(F.concat(n, F.lit(".5")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", formats.rate_percent_ok(x).alias("ok"))


URI_SQL = r"^https?://([\w-]+@)?[\w-]+(\.[\w-]+)+([\w\-.,@?^=%&:/~+#]*[\w\-@?^=%&/~+#])?$"


@query(f"SELECT page_id, regexp_matches(CASE WHEN page_id % 2 = 0 THEN url ELSE replace(url, '.', '') END, '{URI_SQL}') AS ok FROM pages")
def uri_ok(spark, sf_dir):
    """V8: web addresses with a dotted host."""
    url = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.replace(F.col("url"), F.lit("."), F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", formats.uri_ok(url).alias("ok"))


_PATTERN_CASE = " ".join(f"WHEN contains(lower(html), '{p}') THEN '{p}'" for p in (*formats.ERROR_PATTERNS, "cookie", "login", "<nav>"))


@query(f"SELECT page_id, CASE {_PATTERN_CASE} END AS pattern FROM pages")
def html_error_patterns(spark, sf_dir):
    """the first error pattern of each page, with patterns of one's own."""
    return table(spark, sf_dir, "pages").select("page_id", formats.error_pattern(F.col("html"), ("cookie", "login", "<nav>")).alias("pattern"))


@query()
def html_clean(spark, sf_dir):
    """Pages without scripts and styles."""
    return table(spark, sf_dir, "pages").select("page_id", html.clean_html(F.col("html")).alias("html"))


@query("""SELECT page_id, CASE WHEN page_id % 4 IN (0, 1) THEN 'media' WHEN page_id % 4 = 2 THEN 'json' ELSE 'other' END AS kind FROM pages""")
def file_type_split(spark, sf_dir):
    """Kinds of files by extension."""
    ext = F.get(F.array(*map(F.lit, (".HTML", ".a.png", ".json", ".txt"))), F.col("page_id").cast("int") % 4)
    return table(spark, sf_dir, "pages").select("page_id", formats.file_kind(F.concat(F.col("page_id").cast("string"), ext)).alias("kind"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[,"\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM conversations""")
def csv_fields(spark, sf_dir):
    """G1: values as CSV fields."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", formats.csv_field(F.col("text")).alias("field"))


# URLs and requests.


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*)', 1), '/$', '') AS base, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages""")
def url_parts(spark, sf_dir):
    """Base and query pairs of each URL (the pairs joined again, as no value needs escapes here)."""
    pairs = F.array_join(F.transform(urls.query_pairs(F.col("url")), lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")
    return table(spark, sf_dir, "pages").select("page_id", urls.url_base(F.col("url")).alias("base"), pairs.alias("query"))


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/$', '') || '?id=' || page_id || '&id=x+y&q=%26' AS url FROM pages""")
def url_construct(spark, sf_dir):
    """A query map with repeated keys put on each URL."""
    query_map = F.create_map(F.lit("id"), F.array(F.col("page_id").cast("string"), F.lit("x y")), F.lit("q"), F.array(F.lit("&")))
    return table(spark, sf_dir, "pages").select("page_id", urls.construct_url(urls.url_base(F.col("url")), query_map).alias("url"))


@query("SELECT event_id, 1::INTEGER AS n_keys, 'x,' || user_id AS vals FROM events")
def query_map_parse(spark, sf_dir):
    """Query maps from JSON with single quotes."""
    text = F.concat(F.lit("{'k': ['x', '"), F.col("user_id").cast("string"), F.lit("']}"))
    m = urls.loose_query_map(text)
    return table(spark, sf_dir, "events").select("event_id", F.size(m).alias("n_keys"), F.array_join(m["k"], ",").alias("vals"))


@query("""SELECT c_custkey AS request_identifier, key, 'GET' AS method, url || c_custkey AS url FROM customer,
(VALUES ('owner', 'https://example.org/owner?id='), ('tax', 'https://example.org/tax/'), ('map', 'https://example.org/map#')) f(key, url)""")
def flow_fanout(spark, sf_dir):
    """Three requests for every identifier."""
    flow = [{"key": k, "url": f"https://example.org/{u}{{{{=it.request_identifier}}}}"} for k, u in (("owner", "owner?id="), ("tax", "tax/"), ("map", "map#"))]
    return fetch.flow_requests(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_identifier")), flow)


@query("""SELECT o_custkey AS request_identifier, '{' || string_agg('"' || key || '":"' || r || '"', ',' ORDER BY key) || '}' AS combined
FROM (SELECT o_custkey, o_orderpriority AS key, count(*) AS r FROM orders GROUP BY ALL) GROUP BY 1""")
def combined_responses(spark, sf_dir):
    """The responses of each identifier as one object."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("request_identifier"), F.col("o_orderpriority").alias("key")).agg(F.count("*").cast("string").alias("response"))
    return fetch.combine_responses(per)


@query("""SELECT c_custkey, lo AS from_block, least(lo + 1999, first + c_custkey % 9 * 1500 - 1) AS to_block FROM (SELECT c_custkey, 19000000 + c_custkey * 10 AS first, unnest(range(19000000 + c_custkey * 10, 19000000 + c_custkey * 10 + c_custkey % 9 * 1500, 2000)) AS lo FROM customer)""")
def block_ranges(spark, sf_dir):
    """Each contract's range of blocks in chunks, ranges without a block included."""
    first = F.lit(19_000_000) + F.col("c_custkey") * 10
    scans = table(spark, sf_dir, "customer").select("c_custkey", first.alias("first"), (first + F.col("c_custkey") % 9 * 1500 - 1).alias("last"))
    return fetch.block_ranges(scans).select("c_custkey", "from_block", "to_block")


# Seeds.

_ADDRESS_SQL = "concat_ws(', ', nullif(concat_ws(' ', nullif(c_name, ''), nullif(c_mktsegment, '')), ''), nullif(n_name, ''), nullif(concat_ws(' ', CASE WHEN c_custkey % 5 <> 0 THEN 'R' || n_regionkey END, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey::VARCHAR END), ''))"


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'as given' ELSE {_ADDRESS_SQL} END AS address FROM customer JOIN nation ON c_nationkey = n_nationkey")
def seed_address(spark, sf_dir):
    """Addresses from their parts, unless given."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    key = F.col("c_custkey")
    direct = F.when(key % 7 == 0, "as given").otherwise("")
    state = F.when(key % 5 != 0, F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))
    return rows.select("c_custkey", seed.full_address(direct, [F.col("c_name"), F.col("c_mktsegment")], F.col("n_name"), state, F.when(key % 3 != 0, key.cast("string"))).alias("address"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey + 0.5 END::DOUBLE AS longitude, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE -0.25 END::DOUBLE AS latitude FROM customer""")
def seed_coordinates(spark, sf_dir):
    """Both coordinates or none; what follows a number is ignored."""
    lat = F.when(F.col("c_custkey") % 4 != 0, "-.25 deg")
    c = seed.coordinates(F.concat(F.col("c_custkey").cast("string"), F.lit(".5E")), lat)
    return table(spark, sf_dir, "customer").select("c_custkey", c.alias("c")).select("c_custkey", "c.longitude", "c.latitude")


def _seed_rows(spark, sf_dir):
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    case = lambda k, x: F.when(key % 5 == k, x).otherwise("")
    pairs = F.when(key % 3 != 0, F.concat(F.lit("{'id': ['"), text, F.lit("', 'x']}"))).otherwise(" ")
    rows = table(spark, sf_dir, "customer").select(
        text.alias("parcel_id"), F.concat(F.lit("S"), text).alias("source_identifier"), F.when(key % 7 == 0, " ").otherwise(F.col("c_mktsegment")).alias("county"), F.col("c_name").alias("address"),
        F.when(key % 4 != 0, key + 0.5).alias("longitude"), F.when(key % 4 != 0, F.lit(-0.25)).alias("latitude"),
        pairs.alias("query"), F.when(key % 2 == 0, '{"accept": "*/*", "content-type": "text/plain"}').otherwise("").alias("headers"),
        F.when(key % 5 == 1, F.concat(F.lit('{"a": ['), text, F.lit("]}"))).when(key % 11 == 0, "[]").otherwise("").alias("json"), F.when((key % 5 == 2) | (key % 22 == 0), "x=1").otherwise("").alias("body"),
    )
    return rows.withColumn("problem", seed.seed_problem(F.col("county"), F.col("json"), F.col("body")))


_SEED_SQL = """WITH c AS (SELECT *, c_custkey AS k, c_custkey % 5 = 1 OR c_custkey % 11 = 0 AS j, c_custkey % 5 = 2 OR c_custkey % 22 = 0 AS b FROM customer),
p AS (SELECT *, CASE WHEN j AND b THEN '{both}' WHEN k % 7 = 0 THEN '{county}' END AS problem FROM c),
r AS (SELECT *, '{{"source_http_request":{{"url":"https://example.org","method":"get","multiValueQueryString":' || CASE WHEN k % 3 <> 0 THEN '{{"id":["' || k || '","x"]}}' ELSE '{{}}' END
|| CASE WHEN k % 2 = 0 AND j THEN ',"headers":{{"accept":"*/*","content-type":"application/json"}}' WHEN k % 2 = 0 THEN ',"headers":{{"accept":"*/*","content-type":"text/plain"}}' WHEN j THEN ',"headers":{{"content-type":"application/json"}}' ELSE '' END
|| CASE WHEN k % 5 = 1 THEN ',"json":{{"a":[' || k || ']}}' WHEN j THEN ',"json":[]' ELSE '' END || CASE WHEN b THEN ',"body":"x=1"' ELSE '' END || '}},"request_identifier":"S' || k || '"' AS head,
CASE WHEN k % 4 <> 0 THEN ',"longitude":' || k || '.5,"latitude":-0.25' ELSE '' END AS place FROM p)
""".format(both=seed.BOTH_BODIES, county=seed.NO_COUNTY).replace("{{", "{").replace("}}", "}")


@query(_SEED_SQL + "SELECT k::VARCHAR AS parcel_id, problem FROM r WHERE problem IS NOT NULL")
def seed_problems(spark, sf_dir):
    """Seed rows that make no documents, and why."""
    return _seed_rows(spark, sf_dir).filter("problem is not null").select("parcel_id", "problem")


@query(_SEED_SQL + """SELECT k::VARCHAR AS parcel_id, name, CASE name WHEN 'bafyseed.json' THEN '{"label":"Seed","relationships":{"address_has_parcel":{"/":"./address_has_parcel.json"}}}' WHEN 'address_has_parcel.json' THEN '{"from":{"/":"./address.json"},"to":{"/":"./parcel.json"}}'
WHEN 'address.json' THEN head || ',"county_name":"' || c_mktsegment || '","unnormalized_address":"' || c_name || '"' || CASE WHEN place = '' THEN ',"longitude":null,"latitude":null' ELSE place END || '}' WHEN 'parcel.json' THEN head || ',"parcel_identifier":"' || k || '"}'
WHEN 'unnormalized_address.json' THEN head || ',"full_address":"' || c_name || '","county_jurisdiction":"' || c_mktsegment || '"' || place || '}' ELSE head || ',"parcel_id":"' || k || '"}' END AS content
FROM r, (VALUES ('bafyseed.json'), ('address_has_parcel.json'), ('address.json'), ('parcel.json'), ('unnormalized_address.json'), ('property_seed.json')) f(name) WHERE problem IS NULL""")
def seed_documents(spark, sf_dir):
    """The documents of every seed row, contents and all."""
    request = seed.source_request(F.lit("https://example.org"), F.lit("get"), F.col("query"), F.col("headers"), F.col("json"), F.col("body"))
    return seed.seed_documents(_seed_rows(spark, sf_dir).filter("problem is null").withColumn("request", request), "bafyseed")


# Sets of documents.


@query("""WITH m AS (SELECT CASE n_nationkey % 3 WHEN 1 THEN replace(n_name, '_', ' ') ELSE n_name END AS name, 'cid' || n_nationkey AS cid, CASE WHEN n_nationkey % 5 = 0 THEN 'class' ELSE 'dataGroup' END AS type FROM nation),
l AS (SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN n_name ELSE replace(n_name, '_', ' ') END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, CASE WHEN coalesce(a.type, b.type, c.type) = 'dataGroup' THEN coalesce(a.cid, b.cid, c.cid) END AS cid
FROM l LEFT JOIN m a ON a.name = label LEFT JOIN m b ON b.name = replace(label, ' ', '_') LEFT JOIN m c ON c.name = replace(label, '_', ' ')""")
def manifest_lookup(spark, sf_dir):
    """Schemas by label in three spellings."""
    n = table(spark, sf_dir, "nation")
    spaced = F.replace(F.col("n_name"), F.lit("_"), F.lit(" "))
    manifest = n.select(F.when(F.col("n_nationkey") % 3 == 1, spaced).otherwise(F.col("n_name")).alias("name"), F.concat(F.lit("cid"), F.col("n_nationkey").cast("string")).alias("cid"), F.when(F.col("n_nationkey") % 5 == 0, "class").otherwise("dataGroup").alias("type"))
    labels = table(spark, sf_dir, "customer").join(n, F.expr("c_nationkey = n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(spaced).alias("label"))
    return documents.manifest_lookup(labels, manifest).select("c_custkey", "cid")


def _part_files(spark, sf_dir):
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("dir"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("name"))


@query("""SELECT p_partkey % 10 AS dir, 'p' || p_partkey || '.json' AS name FROM part WHERE p_partkey NOT IN (SELECT CASE WHEN l_quantity >= 49 THEN l_partkey ELSE l_partkey + 1000000 END FROM lineitem)""")
def unused_files(spark, sf_dir):
    """Files that nothing links to."""
    named = F.when(F.col("l_quantity") >= 49, F.col("l_partkey")).otherwise(F.col("l_partkey") + 1_000_000)  # most links name other files
    links = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 10).alias("dir"), F.concat(F.lit("p"), named.cast("string"), F.lit(".json")).alias("name"))
    return documents.unused_files(_part_files(spark, sf_dir), links)


@query("""SELECT DISTINCT l_partkey % 10 AS dir, 'p' || (l_partkey + 1000 * (l_linenumber % 2)) || '.json' AS name FROM lineitem
WHERE (l_partkey + 1000 * (l_linenumber % 2)) NOT IN (SELECT p_partkey FROM part)""")
def broken_links(spark, sf_dir):
    """Links to files that don't exist."""
    ref = F.concat(F.lit("./p"), (F.col("l_partkey") + 1000 * (F.col("l_linenumber") % 2)).cast("string"), F.lit(".json"))
    links = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 10).alias("dir"), ref.alias("ref")).distinct()
    return documents.broken_links(links, _part_files(spark, sf_dir)).select("dir", "name")


@query("SELECT o_custkey AS dir, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 17 = 0)")
def seed_gate(spark, sf_dir):
    """Files of folders whose seed didn't fail."""
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dir"), "o_orderkey")
    return documents.seed_gate(files, files.filter("o_orderkey % 17 = 0"))


@query("SELECT o_orderkey, coalesce(max(CASE WHEN o_orderkey % 11 = 0 THEN 'c' || o_orderkey END) OVER (PARTITION BY o_custkey), 'd' || o_custkey) AS property_cid FROM orders")
def property_ids(spark, sf_dir):
    """Files under their folder's seed identifier, else the folder's name."""
    files = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("dir"), (F.col("o_orderkey") % 11 == 0).alias("is_seed"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("cid"))
    return documents.property_ids(files).select("o_orderkey", "property_cid")


@query("SELECT o_custkey AS dir, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS n_json, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS n_seed, CASE WHEN count(*) FILTER (WHERE o_orderkey % 2 = 0) = 0 THEN 'no documents' WHEN count(*) FILTER (WHERE o_orderkey % 11 = 0) > 1 THEN 'more than one seed' END AS problem FROM orders GROUP BY 1")
def structure_problems(spark, sf_dir):
    """What is wrong with folders."""
    name = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".json").otherwise(".txt"))
    return documents.structure_problems(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dir"), name.alias("name"), (F.col("o_orderkey") % 11 == 0).alias("is_seed")))


@query("SELECT event_id, event_id % 3 = 0 AS ok FROM events")
def datagroup_roots(spark, sf_dir):
    """Which JSON texts are roots of a data group."""
    k = F.col("event_id") % 3
    raw = F.when(k == 0, '{"relationships": {}, "label": "County"}').when(k == 1, '{"label": 3, "relationships": {}}').otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", documents.is_datagroup_root(raw).alias("ok"))


_SLOT_FILES = ("relationship_property_address", "relationship_property_tax", "relationship_property_tax_exemption", "relationship_sales_person", "relationship_layout_layout", "relationship_sales_deed", "relationship_deed_file", "relationship_property_layout", "other", "relationship_person_mailing_address", "relationship_layout_utility")
_SLOT_LIST = "[" + ", ".join(f"'{f}'" for f in _SLOT_FILES) + "]"


def _slot_case(rules) -> str:
    has = lambda w: f"regexp_matches(f, '{'.*'.join([w.split('*')[0]] * int(w.split('*')[1]))}')" if "*" in w else f"contains(f, '{w}')"
    return "CASE " + " ".join("WHEN " + " AND ".join([*(has(w) for w in words), *(f"NOT contains(f, '{w}')" for w in without)]) + f" THEN '{slot}'" for slot, words, without in rules) + " END"


def _slot_rows(spark, sf_dir):
    file = F.concat(F.get(F.array(*map(F.lit, _SLOT_FILES)), (F.col("p_partkey") % len(_SLOT_FILES)).cast("int")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".json"))
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("group"), F.col("p_partkey").alias("seq"), file.alias("file"))


@query(f"""WITH r AS (SELECT p_size AS g, p_partkey AS seq, {_SLOT_LIST}[(p_partkey % {len(_SLOT_FILES)})::INTEGER + 1] || '_' || p_partkey || '.json' AS f FROM part),
s AS (SELECT *, {_slot_case(relate.COUNTY)} AS slot FROM r)
SELECT g AS "group", slot, CASE WHEN slot IN ({", ".join(f"'{s}'" for s in relate.COUNTY_SINGLE)}) THEN arg_max(f, seq) ELSE string_agg(f, ',' ORDER BY seq) END AS files FROM s WHERE slot IS NOT NULL GROUP BY 1, 2""")
def relationship_slots(spark, sf_dir):
    """R-C: files into the slots of a county's data group."""
    return relate.slot_files(_slot_rows(spark, sf_dir)).select("group", "slot", F.array_join("files", ",").alias("files"))


_COUNTY_SLOTS = list(dict.fromkeys(r[0] for r in relate.COUNTY))
_COUNTY_LINK = """'{"/":"./' || {f} || '"}'"""


@query(f"""WITH r AS (SELECT p_size AS g, p_partkey AS seq, {_SLOT_LIST}[(p_partkey % {len(_SLOT_FILES)})::INTEGER + 1] || '_' || p_partkey || '.json' AS f FROM part),
s AS (SELECT *, {_slot_case(relate.COUNTY)} AS slot FROM r),
e AS (SELECT g, slot, slot IN ({", ".join(f"'{s}'" for s in relate.COUNTY_SINGLE)}) AS single, {_COUNTY_LINK.replace("{f}", "arg_max(f, seq)")} AS one, '[' || string_agg({_COUNTY_LINK.replace("{f}", "f")}, ',' ORDER BY seq) || ']' AS many, '[' || string_agg({_COUNTY_LINK.replace("{f}", "f")}, ',' ORDER BY lower(f)) || ']' AS by_name FROM s WHERE slot IS NOT NULL GROUP BY 1, 2),
d AS (SELECT g, string_agg('"' || slot || '":' || CASE WHEN single THEN one ELSE many END, ',' ORDER BY list_position([{", ".join(f"'{s}'" for s in _COUNTY_SLOTS)}], slot)) AS document, string_agg('"' || slot || '":' || CASE WHEN single THEN one ELSE by_name END, ',' ORDER BY slot) AS canonical FROM e GROUP BY 1),
t AS (SELECT g, '{{"label":"County","relationships":{{' || document || '}}}}' AS document, '{{"label":"County","relationships":{{' || canonical || '}}}}' AS canonical FROM d)
SELECT g AS "group", document, {CID_SQL.format(h="sha256(canonical)")} AS cid FROM t""")
def county_data_groups(spark, sf_dir):
    """R-C, R-D: the data group documents themselves, with their identifiers."""
    groups = relate.data_groups(_slot_rows(spark, sf_dir)).select("group", "document", canon.canonical_links_json(F.col("document")).alias("canonical"))
    return groups.select("group", "document", cid.cid_raw(F.col("canonical")).alias("cid"))


_ENTITY_FILES = ("property", "my_property", "tax", "tax_exemption", "property_improvement", "relationship_tax", "person", "a_person", "company", "structure", "utility", "mailing_address", "mailing", "sales_data", "jurisdiction_tax", "layout", "deed.txt")
_ENTITY_LIST = "[" + ", ".join(f"'{f}'" for f in _ENTITY_FILES) + "]"


def _entity_rows(spark, sf_dir):
    """Folders of entity files, some with a request of their own; a few have a number before the extension."""
    key, name = F.col("p_partkey"), F.get(F.array(*map(F.lit, _ENTITY_FILES)), (F.col("p_partkey") % len(_ENTITY_FILES)).cast("int"))
    file = F.concat(name, F.when(key % 3 == 0, F.concat(F.lit("_"), key.cast("string"))).otherwise(""), F.lit(".json"))
    request = F.when(key % 2 == 0, F.lit(',"source_http_request":{}')).when(key % 5 == 0, ',"source_http_request":{"url":"own"}').otherwise("")
    raw = F.concat(F.lit('{"a":'), key.cast("string"), request, F.lit("}"))
    return table(spark, sf_dir, "part").select(F.floor(key / len(_ENTITY_FILES)).alias("group"), key.alias("seq"), file.alias("file"), raw.alias("raw"))


_ENTITY_SQL = f"""WITH f AS (SELECT p_partkey // {len(_ENTITY_FILES)} AS g, p_partkey AS seq, {_ENTITY_LIST}[(p_partkey % {len(_ENTITY_FILES)})::INTEGER + 1] || CASE WHEN p_partkey % 3 = 0 THEN '_' || p_partkey ELSE '' END || '.json' AS file FROM part),
e AS (SELECT *, NOT starts_with(file, 'relationship') AND NOT ends_with(file, 'data.json') AS entity FROM f),
l AS (SELECT *, entity AND NOT ends_with(file, 'property.json') AND NOT starts_with(file, 'person') AND NOT starts_with(file, 'company') AND NOT starts_with(file, 'structure') AND NOT starts_with(file, 'utility')
  AND NOT starts_with(file, 'mailing_address') AND NOT contains(file, 'exemption') AND NOT contains(file, 'jurisdiction') AS linked FROM e)
"""


@query(_ENTITY_SQL + """SELECT seq, 'relationship_property_' || file AS relationship, '{"from":{"/":"./property.json"},"to":{"/":"./' || file || '"}}' AS content FROM l WHERE linked""")
def relationship_synthesis(spark, sf_dir):
    """A relationship from the property to all other entities."""
    return relate.synthesised(_entity_rows(spark, sf_dir)).select("seq", "relationship", "content")


@query(_ENTITY_SQL + """SELECT seq, '{"a":' || seq || CASE WHEN seq % 2 <> 0 AND seq % 5 = 0 THEN ',"source_http_request":{"url":"own"}' ELSE ',"source_http_request":{"url":"https://example.org/' || g || '"}' END || ',"request_identifier":"id' || g || '"}' AS content FROM l WHERE entity""")
def provenance_fill(spark, sf_dir):
    """P5: entities with the request and identifier of their folder's seed."""
    rows = _entity_rows(spark, sf_dir).filter(relate.is_entity(F.col("file")))
    group = F.col("group").cast("string")
    request = F.concat(F.lit('{"url":"https://example.org/'), group, F.lit('"}'))
    return rows.select("seq", relate.with_provenance(F.col("raw"), request, F.concat(F.lit("id"), group)).alias("content"))


@query(_ENTITY_SQL + f""", m AS (SELECT g, seq, 'relationship_property_' || file AS file, 0 AS made FROM l WHERE linked), n AS (SELECT * FROM m UNION ALL SELECT g, seq, file, 1 FROM l WHERE starts_with(file, 'relationship_') AND (g, file) NOT IN (SELECT (g, file) FROM m)),
s AS (SELECT *, {{slots}} AS slot FROM (SELECT *, file AS f FROM n))
SELECT g AS "group", name, n FROM (SELECT g, file AS name, 1 AS n FROM f UNION ALL SELECT g, file, 1 FROM m WHERE (g, file) NOT IN (SELECT (g, file) FROM f) UNION ALL SELECT g, 'bafygroup.json', count(DISTINCT slot) FROM s WHERE slot IS NOT NULL GROUP BY 1)""".replace("{slots}", "@SLOTS@"))
def datagroup_transform(spark, sf_dir):
    """R-D, U1: what a folder's transform leaves; of data groups the number of slots."""
    rows = _entity_rows(spark, sf_dir)
    seeds = rows.select("group").distinct().withColumn("request", F.lit('{"url":"u"}')).withColumn("identifier", F.lit("id"))
    out = relate.transformed(rows, seeds, "bafygroup")
    return out.select("group", "name", F.when(F.col("name") == "bafygroup.json", F.size(F.json_object_keys(F.get_json_object("content", "$.relationships")))).otherwise(1).cast("long").alias("n"))


ORACLE_SQL["datagroup_transform"] = ORACLE_SQL["datagroup_transform"].replace("@SLOTS@", _slot_case(relate.COUNTY))

_IMPROVEMENT_FILES = (*relate.IMPROVEMENT_SLOTS, "other_has_nothing", "Property_Improvement_Has_File")
_IMPROVEMENT_LIST = "[" + ", ".join(f"'{f}'" for f in _IMPROVEMENT_FILES) + "]"


@query(f"""WITH r AS (SELECT p_size AS g, p_partkey AS seq, {_IMPROVEMENT_LIST}[(p_partkey % {len(_IMPROVEMENT_FILES)})::INTEGER + 1] || '_' || p_partkey || '.json' AS file FROM part), s AS (SELECT *, {_slot_case(relate.IMPROVEMENT)} AS slot FROM (SELECT *, lower(file) AS f FROM r))
SELECT g AS "group", slot, CASE WHEN slot IN ({", ".join(f"'{x}'" for x in relate.IMPROVEMENT_SINGLE)}) THEN arg_max(file, seq) ELSE string_agg(file, ',' ORDER BY seq) END AS files FROM s WHERE slot IS NOT NULL GROUP BY 1, 2""")
def improvement_slots(spark, sf_dir):
    """R-P: files into the slots of an improvement's data group."""
    file = F.concat(F.get(F.array(*map(F.lit, _IMPROVEMENT_FILES)), (F.col("p_partkey") % len(_IMPROVEMENT_FILES)).cast("int")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".json"))
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("group"), F.col("p_partkey").alias("seq"), file.alias("file"))
    return relate.slot_files(rows, relate.IMPROVEMENT, relate.IMPROVEMENT_SINGLE).select("group", "slot", F.array_join("files", ",").alias("files"))


# Graphs.


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem),
r AS (SELECT 'c' || c_custkey AS root, 'c' || c_custkey AS node, 0 AS depth FROM customer UNION SELECT root, dst, depth + 1 FROM r JOIN e ON node = src)
SELECT root, node, min(depth)::INTEGER AS depth FROM r GROUP BY 1, 2""")
def graph_reach(spark, sf_dir):
    """R2: all that customers reach by orders and parts."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))
    edges = edges.union(table(spark, sf_dir, "lineitem").select(name("o", "l_orderkey"), name("p", "l_partkey"))).distinct()
    return graph.reach(edges, table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("node")))


_LINKED_SQL = """WITH p AS (SELECT DISTINCT l_orderkey AS o, 'p' || l_partkey || '.json' AS ref, {leaf} AS cid FROM lineitem JOIN part ON p_partkey = l_partkey),
d AS (SELECT o, '{"page":{"ipfs_url":"ipfs://bafymedia"},"parts":[' || string_agg('{"/":"' || cid || '"}', ',' ORDER BY cid) || ']}' AS converted FROM p GROUP BY 1)
SELECT o, converted, {root} AS cid FROM d""".replace("{leaf}", CID_SQL.format(h="""sha256('{"brand":"' || p_brand || '","name":"' || p_name || '"}')""")).replace("{root}", CID_SQL.format(h="sha256(converted)"))


@query(_LINKED_SQL)
def linked_cids(spark, sf_dir):
    """orders' documents with the identifiers of their parts' documents and of their media, and their own."""
    link = F.concat(F.lit("./p"), F.col("l_partkey").cast("string"), F.lit(".json"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()  # dealt once, as numbers
    # Keys of a part's document stand in another order than their canonical one.
    part = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))).alias("text"))
    part = items.join(part, F.expr("p_partkey = l_partkey")).select(F.col("l_orderkey").cast("string").alias("dir"), F.substr(link, F.lit(3)).alias("name"), "text")
    text = F.to_json(F.struct(F.struct(F.lit("./index.html").alias("ipfs_url")).alias("page"), F.transform(F.collect_list(link), lambda x: F.struct(x.alias("/"))).alias("parts")))
    order = items.groupBy("l_orderkey").agg(text.alias("text")).select(F.col("l_orderkey").cast("string").alias("dir"), F.lit("order.json").alias("name"), "text")
    media = order.select("dir", F.lit("bafymedia").alias("media_cid"))
    found = graph.linked_cids(part.union(order), media).filter("name = 'order.json'")
    return found.select(F.col("dir").cast("long").alias("o"), "converted", "cid")


# Errors.

ERRORS_SQL = """WITH e AS (SELECT event_id AS seq, 'u' || (user_id % 50) AS file_path,
CASE event_type WHEN 'signup' THEN '/property_has_address/0/to/street' WHEN 'view' THEN '/tax_has_fact_sheet/value' WHEN 'error' THEN '/property_has_address/to' WHEN 'click' THEN '/x/' || (user_id % 7) || '/value' ELSE '' END AS error_path,
['must be null', 'must match a schema in anyOf', 'must be string', 'must be integer', 'missing required property'][(event_id % 5)::INTEGER + 1] AS error_message FROM events),
a AS (SELECT *, (contains(error_path, 'property_has_address') AND contains(error_path, '/to')) OR (contains(error_path, 'address_has_fact_sheet') AND contains(error_path, '/from')) AS address FROM e),
n AS (SELECT * FROM a WHERE NOT regexp_matches(error_message, '^must be (null|object|array)$') AND error_message NOT IN ('must match a schema in anyOf', 'must match exactly one schema in oneOf')),
f AS (SELECT file_path, bool_or(address AND error_message = 'must match a schema in anyOf') AS failed FROM a GROUP BY 1),
k AS (SELECT n.*, failed AND address AS folds, row_number() OVER (PARTITION BY n.file_path, failed AND address ORDER BY seq) AS rn FROM n JOIN f USING (file_path)),
c AS (SELECT seq, file_path, CASE WHEN folds THEN '{path}' ELSE error_path END AS error_path, CASE WHEN folds THEN '{message}' ELSE error_message END AS error_message, folds::INTEGER AS late FROM k WHERE NOT folds OR rn = 1),
d AS (SELECT *, coalesce(list_filter(string_split(error_path, '/'), lambda p: p <> '')[-1], 'root') AS leaf FROM c),
u AS (SELECT *, row_number() OVER (PARTITION BY error_message, leaf ORDER BY contains(error_path, 'has_fact_sheet'), late, seq) AS best FROM d)
""".replace("{path}", errors.ADDRESS_PATH).replace("{message}", errors.ADDRESS_MESSAGE)


def _errors(spark, sf_dir):
    kind = F.col("event_type")
    path = F.when(kind == "signup", "/property_has_address/0/to/street").when(kind == "view", "/tax_has_fact_sheet/value").when(kind == "error", "/property_has_address/to").when(kind == "click", F.concat(F.lit("/x/"), (F.col("user_id") % 7).cast("string"), F.lit("/value"))).otherwise("")
    messages = F.array(*map(F.lit, ("must be null", "must match a schema in anyOf", "must be string", "must be integer", "missing required property")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("file_path"), path.alias("error_path"), F.get(messages, (F.col("event_id") % 5).cast("int")).alias("error_message"))


@query(ERRORS_SQL + "SELECT seq, file_path, error_path, error_message FROM n")
def type_error_filter(spark, sf_dir):
    """errors without noise."""
    return errors.drop_noise(_errors(spark, sf_dir))


@query(ERRORS_SQL + "SELECT seq, file_path, error_path, error_message, late FROM c")
def address_consolidate(spark, sf_dir):
    """One row for all errors of an address."""
    return errors.consolidate_addresses(_errors(spark, sf_dir))


@query(ERRORS_SQL + "SELECT seq, file_path, error_path, error_message FROM u WHERE best = 1")
def error_post_process(spark, sf_dir):
    """The whole post-processing."""
    return errors.post_process(_errors(spark, sf_dir)).select("seq", "file_path", "error_path", "error_message")


@query(ERRORS_SQL + """, p AS (SELECT *, list_filter(string_split(error_path, '/'), lambda p: p <> '') AS parts FROM e)
SELECT seq, error_message, target FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY seq) AS rn FROM (SELECT *, concat_ws('.', parts[-2], parts[-1]) AS target FROM p)) WHERE rn = 1""")
def repair_errors(spark, sf_dir):
    """The first error of each class and property."""
    return errors.repair_errors(_errors(spark, sf_dir)).select("seq", "error_message", "target")


@query(ERRORS_SQL + "SELECT seq, 'noise free' AS part FROM n UNION ALL SELECT seq, 'consolidated' FROM c WHERE late = 1")
def unified_report(spark, sf_dir):
    """Two sets of rows as one report."""
    one = errors.drop_noise(_errors(spark, sf_dir)).select("seq", F.lit("noise free").alias("part"))
    return one.unionByName(errors.consolidate_addresses(_errors(spark, sf_dir)).filter("late = 1").select("seq", F.lit("consolidated").alias("part")))


@query("""SELECT event_id, concat_ws(';', CASE WHEN event_type = 'error' THEN '/|unexpected property ' || chr(39) || 'x' || chr(39) END, CASE WHEN event_type = 'click' THEN '/|missing required property ' || chr(39) || 'k' || chr(39) END, CASE WHEN event_type <> 'click' AND k > 80 THEN '/k|must be <= 80' END,
CASE WHEN event_type <> 'view' AND k % 2 = 1 THEN '/even|must be equal to constant' END, CASE WHEN k % 3 = 0 THEN '/d/u|must be a valid IPv6 address' WHEN k % 3 = 1 THEN '/d/u|must NOT be valid' END) AS report FROM (SELECT event_id, event_type, (props->>'$.k')::INTEGER AS k FROM events)""")
def schema_validate(spark, sf_dir):
    """Documents against schemas that refer to each other; paths and messages of all errors."""
    number = {"type": "integer", "maximum": 80}
    group = {
        "type": "object", "required": ["k"], "additionalProperties": False, "definitions": {"u": {"format": "ipv6", "not": {"const": "::1"}}},
        "properties": {"k": {"type": "string", "cid": "number"}, "even": {"const": True}, "d": {"type": "object", "patternProperties": {"^u$": {"$ref": "#/definitions/u"}}}},
    }
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    u = F.when(k % 3 == 0, "1.2.3.4").when(k % 3 == 1, "::1").otherwise("fe80::2")
    raw = F.to_json(F.struct(F.when(kind != "click", k).alias("k"), F.when(kind != "view", k % 2 == 0).alias("even"), F.when(kind == "error", 1).alias("x"), F.struct(u.alias("u")).alias("d")))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), F.lit("group").alias("schema_cid"))
    found = validate.validate(rows, {"number": number, "group": group})
    return found.select("event_id", F.array_join(F.transform("errors", lambda e: F.concat(e["path"], F.lit("|"), e["message"])), ";").alias("report"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/to/n|must be integer' WHEN 2 THEN '|Validation error: Failed to resolve pointer - not a valid CID or accessible file path: ./gone.json' ELSE '/to/next/n|must be integer' END AS report FROM customer""")
def linked_validation(spark, sf_dir):
    """Relationships whose links are followed into the files of their folder, also from file to file."""
    key = F.col("c_custkey")
    path = F.when(key % 4 == 2, "./gone.json").when(key % 4 == 3, "././outer.json").otherwise("./leaf.json")
    docs = table(spark, sf_dir, "customer").select("c_custkey", key.cast("string").alias("dir"), F.to_json(F.struct(F.struct(path.alias("/")).alias("to"))).alias("raw"), F.lit("relationship").alias("schema_cid"))
    leaf = F.when(key % 4 == 0, '{"n":1}').otherwise('{"n":"x"}')
    files = docs.select("dir", F.explode(F.array(F.struct(F.lit("leaf.json").alias("name"), leaf.alias("text")), F.struct(F.lit("outer.json").alias("name"), F.lit('{"n":2,"next":{"/":"./leaf.json"}}').alias("text")))).alias("f")).select("dir", "f.*")
    entity = {"type": "object", "properties": {"n": {"type": "integer"}, "next": {"type": "string", "cid": "leaf"}}}
    schemas = {"relationship": {"type": "object", "properties": {"to": {"type": "string", "cid": "entity"}}}, "entity": entity, "leaf": {"type": "object", "properties": {"n": {"type": "integer"}}}}
    found = validate.validate(validate.linked_content(docs, files, key="c_custkey"), schemas, content_col="content")
    return found.select("c_custkey", F.array_join(F.transform("errors", lambda e: F.concat(e["path"], F.lit("|"), e["message"])), ";").alias("report"))


# Submissions.


@query("SELECT user_id, event_type, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY 1, 2")
def latest_consensus(spark, sf_dir):
    """A3: the last event of each key."""
    return submit.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", ["ts", "event_id"])


ELIGIBLE_SQL = """WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders),
c AS (SELECT o_custkey, o_orderstatus, arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS agreed FROM orders GROUP BY 1, 2),
s AS (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority, true AS sent FROM orders WHERE o_orderkey % 5 = 0),
x AS (SELECT r.*, CASE WHEN agreed = o_orderpriority THEN 'already agreed' WHEN sent THEN 'already submitted' END AS reason FROM r LEFT JOIN c USING (o_custkey, o_orderstatus) LEFT JOIN s USING (o_custkey, o_orderstatus, o_orderpriority))
"""


def _eligibility(spark, sf_dir):
    orders, keys = table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"]
    return submit.eligibility(orders.select("o_orderkey", *keys, "o_orderpriority"), submit.latest(orders, keys, "o_orderpriority", ["o_orderdate", "o_orderkey"]), orders.filter("o_orderkey % 5 = 0"), keys, "o_orderpriority")


@query(ELIGIBLE_SQL + "SELECT o_orderkey, reason FROM x")
def eligibility_reasons(spark, sf_dir):
    """Why records are skipped."""
    return _eligibility(spark, sf_dir).select("o_orderkey", "reason")


@query(ELIGIBLE_SQL + ", e AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM x WHERE reason IS NULL) SELECT o_orderkey, k // 200 AS batch, k % 200 AS place FROM e")
def eligible_batches(spark, sf_dir):
    """What is left, in batches."""
    return submit.batches(_eligibility(spark, sf_dir).filter("reason is null"), "o_orderkey").select("o_orderkey", "batch", "place")


_BATCH_SQL = "SELECT o_orderkey, k // 200 AS batch, k % 200 AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)"


@query("SELECT * EXCLUDE (k), k // 200 AS batch, k % 200 AS place FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)")
def tx_batches(spark, sf_dir):
    """B1: consecutive batches of 200, of rows with all their columns."""
    return submit.batches(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT o_custkey, o_orderkey, k // 5 AS batch, k % 5 AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders)")
def group_batches(spark, sf_dir):
    """B1: batches of five of each sender."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return submit.batches(orders, "at", "o_custkey", 5).select("o_custkey", "o_orderkey", "batch", "place")


@query(f"SELECT * FROM ({_BATCH_SQL}) WHERE place < 3")
def batch_preview(spark, sf_dir):
    """The first three of each batch."""
    return tx_batches(spark, sf_dir).filter("place < 3").select("o_orderkey", "batch", "place")


@query(f"""SELECT batch, items, est + est * 20 // 100 AS gas_limit, 30000000000::DECIMAL(38,0) AS max_fee, 3000000000::DECIMAL(38,0) AS priority_fee, '0x' || lower(to_hex(est + est * 20 // 100)) AS gas_hex, 7 + batch AS nonce
FROM (SELECT batch, count(*) AS items, 21000 + count(*) * 53123 AS est FROM ({_BATCH_SQL}) GROUP BY 1)""")
def gas_plan(spark, sf_dir):
    """Limits, fees and nonces of the batches."""
    return submit.gas_plan(tx_batches(spark, sf_dir))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'view') AS "view", count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events""")
def status_summary(spark, sf_dir):
    """A1: counts by status."""
    return submit.status_summary(table(spark, sf_dir, "events"), "event_type", ["view", "error", "purchase"])


@query("""SELECT o_orderkey AS tx, CASE WHEN q IS NOT NULL THEN CASE WHEN q > 100 THEN 'success' ELSE 'failed' END WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'not_found' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING min(l_linenumber) = 1 AND count(*) <> 3) ON l_orderkey = o_orderkey""")
def transaction_status(spark, sf_dir):
    """Transactions with their receipts."""
    txs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), (F.col("o_orderstatus") == "O").alias("seen"))
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tx")).agg((F.sum("l_quantity") > 100).alias("ok"), F.min("l_linenumber").alias("first"), F.count(F.lit(1)).alias("n"))
    receipts = per.filter("first = 1 and n <> 3").select("tx", "ok")  # some transactions have no receipt
    return submit.status_of(txs, receipts).select("tx", "status")


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS items FROM events GROUP BY 1")
def items_by_property(spark, sf_dir):
    """A2: the items of each property in order."""
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("all"))
    return per.select("user_id", F.array_join(F.transform("all", lambda x: x["event_id"].cast("string")), ",").alias("items"))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS assigned FROM customer")
def assigned_members(spark, sf_dir):
    """A5: who is in the set of the assigned."""
    assigned = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("a", F.lit(True))
    return table(spark, sf_dir, "customer").join(assigned, "c_custkey", "left").select("c_custkey", F.coalesce("a", F.lit(False)).alias("assigned"))


@query("""WITH r AS (SELECT event_id, user_id, ts, (epoch_us(ts) // 1000 - epoch_us(first_value(ts) OVER w) // 1000) / 1000 AS seconds, event_id - first_value(event_id) OVER w AS gained, count(*) OVER w AS n, min(ts) OVER (PARTITION BY user_id) AS began
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
x AS (SELECT *, CASE WHEN n < 2 THEN 0.0 WHEN seconds > 0 THEN gained / seconds WHEN ts > began THEN event_id / ((epoch_us(ts) // 1000 - epoch_us(began) // 1000) / 1000) ELSE 0.0 END::DOUBLE AS rate FROM r)
SELECT event_id, seconds::DOUBLE AS seconds, gained, rate, CASE WHEN rate > 0 AND 10000000 > event_id THEN (10000000 - event_id) / rate END AS remaining FROM x""")
def rate_window(spark, sf_dir):
    """Progress against the oldest of the last sixty samples, and the time that is left."""
    found = fetch.rates(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return found.select("event_id", "seconds", "gained", "rate", fetch.remaining_seconds(F.lit(10_000_000), F.col("event_id"), F.col("rate")).alias("remaining"))


# Owners.

_OWNER_SQL = "CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ' Trust' WHEN c_custkey % 4 = 1 THEN 'Ann & ' || c_mktsegment WHEN c_custkey % 4 = 2 THEN 'Bo Lee ' || c_mktsegment ELSE ' ' END"


def _owners(spark, sf_dir):
    seg, k = F.col("c_mktsegment"), F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat(seg, F.lit(" Trust"))).when(k == 1, F.concat(F.lit("Ann & "), seg)).when(k == 2, F.concat(F.lit("Bo Lee "), seg)).otherwise(" ")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("property"), F.col("c_custkey").alias("seq"), name.alias("name"))


@query("""SELECT c_custkey AS seq, ['company', 'person', 'person', 'invalid'][(c_custkey % 4)::INTEGER + 1] AS kind, CASE c_custkey % 4 WHEN 1 THEN 'Ann' WHEN 2 THEN 'Bo' END AS first,
CASE c_custkey % 4 WHEN 2 THEN 'Lee' END AS middle, CASE WHEN c_custkey % 4 IN (1, 2) THEN c_mktsegment END AS last FROM customer""")
def owner_classify(spark, sf_dir):
    """Persons and companies."""
    return owners.classify(_owners(spark, sf_dir)).select("seq", "kind", "first", "middle", "last")


@query(f"SELECT property, min(seq) AS seq FROM (SELECT c_nationkey AS property, c_custkey AS seq, {_OWNER_SQL} AS name FROM customer) WHERE trim(name) <> '' GROUP BY property, lower(trim(name))")
def owner_dedupe(spark, sf_dir):
    """Each name once a property."""
    return owners.dedupe(_owners(spark, sf_dir), "property").select("property", "seq")


@query("""SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS date, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS owners, CASE WHEN strftime(o_orderdate, '%Y-%m-%d') = max(strftime(o_orderdate, '%Y-%m-%d')) OVER (PARTITION BY o_custkey) THEN 'current' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS label
FROM orders GROUP BY o_custkey, strftime(o_orderdate, '%Y-%m-%d')""")
def owners_by_date(spark, sf_dir):
    """Owners by date, the last one current."""
    return owners.by_date(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderpriority").withColumn("owners", F.array_join("owners", ","))
