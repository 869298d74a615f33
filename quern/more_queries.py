"""More of the engine's own queries: scans of folders, fact sheets, flows, logs, reports and small functions (see queries.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import canon, cid, formats, urls
from quern.operators import entities, events, factsheets, fetch, flows, owners, reports, scan, submit, validate
from quern.queries import CID_SQL, query
from quern.session import spread, table
from quern.sources import files

# Folders.

SEED = "bafkreiseedseedseedseed"


def _tree(spark, sf_dir):
    """Folders named by an identifier, by a word with and without a seed; files named by identifiers and not; deeper ones."""
    k = F.col("p_partkey")
    d = (k % 8).cast("string")
    folder = F.when(k % 8 < 3, F.concat(F.lit("bafkreifolderfolderfolder"), F.translate(d, "01289", "abcde"))).otherwise(F.concat(F.lit("dir"), d))
    name = F.when((k % 5 == 0) & (k % 8 != 2), F.concat(F.lit("bafkreifilefilefilefile"), F.translate(k.cast("string"), "0189", "abcd"), F.lit(".json"))).when((k % 8 == 4) & (k % 5 == 1), f"{SEED}.json").otherwise(F.concat(F.lit("f"), k.cast("string"), F.when(k % 2 == 0, ".json").otherwise(".txt")))
    deeper = F.when(k % 7 == 0, "sub/").otherwise("")
    return table(spark, sf_dir, "part").select(F.concat(folder, F.lit("/"), deeper, name).alias("path"), k.alias("seq"))


_TREE_SQL = f"""WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 8 < 3 THEN 'bafkreifolderfolderfolder' || translate((p_partkey % 8)::VARCHAR, '01289', 'abcde') ELSE 'dir' || p_partkey % 8 END AS d,
CASE WHEN p_partkey % 5 = 0 AND p_partkey % 8 <> 2 THEN 'bafkreifilefilefilefile' || translate(p_partkey::VARCHAR, '0189', 'abcd') || '.json' WHEN p_partkey % 8 = 4 AND p_partkey % 5 = 1 THEN '{SEED}.json' ELSE 'f' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.json' ELSE '.txt' END END AS n, p_partkey % 7 = 0 AS deep FROM part),
e AS (SELECT CASE WHEN k % 8 < 3 THEN d ELSE 'SEED_PENDING:' || d END AS property_cid, n[:-6] AS data_group_cid, d || '/' || n AS path FROM t WHERE NOT deep AND (k % 8 < 3 OR d IN (SELECT d FROM t WHERE n = '{SEED}.json' AND NOT deep)) AND ((k % 5 = 0 AND k % 8 <> 2) OR (k % 8 = 4 AND n = '{SEED}.json')))
"""


@query(_TREE_SQL + "SELECT * FROM e")
def scan_entries(spark, sf_dir):
    """The files of properties that are worked on."""
    return scan.entries(_tree(spark, sf_dir), SEED)


@query(_TREE_SQL + "SELECT property_cid, count(*) AS files, count(DISTINCT data_group_cid) AS groups FROM e GROUP BY 1")
def scan_totals(spark, sf_dir):
    """How many files and data groups each property has."""
    return scan.entries(_tree(spark, sf_dir), SEED).groupBy("property_cid").agg(F.count("*").alias("files"), F.count_distinct("data_group_cid").alias("groups"))


@query(_TREE_SQL + "SELECT d AS dir, 'No valid data group CID files found in ' || d AS error FROM t GROUP BY d HAVING starts_with(d, 'baf') AND count(*) FILTER (WHERE NOT deep AND k % 5 = 0 AND k % 8 <> 2) = 0")
def scan_structure(spark, sf_dir):
    """What is wrong with properties' folders."""
    return scan.structure_errors(_tree(spark, sf_dir), SEED)


@query("""WITH f AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"label":"County","relationships":{}}' WHEN 1 THEN '{"label":"Photo Metadata","relationships":[]}' WHEN 2 THEN '{' ELSE props END AS raw FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'County' WHEN 1 THEN 'Photo Metadata' END AS label, CASE event_id % 4 WHEN 0 THEN 'bafyc' WHEN 1 THEN 'bafyp' END AS data_group_cid, CASE WHEN event_id % 4 IN (0, 1) THEN 'u' || user_id END AS property, CASE event_id % 4 WHEN 2 THEN 'File read/parse error' END AS error FROM f JOIN events USING (event_id)""")
def datagroup_files(spark, sf_dir):
    """Roots of data groups by their labels, and files that can't be read."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, '{"label":"County","relationships":{}}').when(k == 1, '{"label":"Photo Metadata","relationships":[]}').when(k == 2, "{").otherwise(F.col("props"))
    files = table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", F.lit("in"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.col("event_id").cast("string"), F.lit(".json"))).alias("path"), raw.alias("raw"))
    manifest = spark.createDataFrame([("County", "bafyc", "dataGroup"), ("Photo_Metadata", "bafyp", "dataGroup"), ("County", "bafyx", "class")], "name string, cid string, type string")
    found = scan.datagroups(files, manifest)
    return scan.parsed(files).join(found, "path", "left").select("event_id", "label", "data_group_cid", "property", "error")


@query("""SELECT o_custkey AS dir, arg_min('f' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '.HTML' ELSE '.json' END, (o_orderkey % 3 <> 0, 'f' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '.HTML' ELSE '.json' END)) AS name,
CASE WHEN bool_or(o_orderkey % 3 = 0) THEN 'input.html' ELSE 'input.json' END AS target FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1 UNION ALL SELECT o_custkey, 's' || o_orderkey || '.csv', 's' || o_orderkey || '.csv' FROM orders WHERE o_orderkey % 5 = 0""")
def script_inputs(spark, sf_dir):
    """R-N: what scripts get of each folder."""
    key = F.col("o_orderkey")
    name = F.when(key % 5 == 0, F.concat(F.lit("s"), key.cast("string"), F.lit(".csv"))).otherwise(F.concat(F.lit("f"), key.cast("string"), F.when(key % 3 == 0, ".HTML").otherwise(".json")))
    return scan.script_inputs(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dir"), name.alias("name")))


@query("""SELECT o_custkey AS dir, stem, CASE WHEN bool_or(o_orderkey % 3 = 0) THEN upper(stem) || '.html' ELSE stem || '.json' END AS name FROM (SELECT *, 'page' || (o_orderkey % 4) AS stem FROM orders) WHERE stem <> 'page3' GROUP BY 1, 2""")
def required_files(spark, sf_dir):
    """R-V: the files that a generator needs, pages first."""
    key = F.col("o_orderkey")
    stem = F.concat(F.lit("page"), (key % 4).cast("string"))
    name = F.when(key % 3 == 0, F.concat(F.upper(stem), F.lit(".html"))).otherwise(F.concat(stem, F.lit(".json")))
    return scan.required_files(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dir"), name.alias("name")), ("page0", "page1", "page2"))


@query("""WITH r AS (SELECT o_custkey AS dir, 'rel' || o_orderkey || '.json' AS name, 'a' || o_orderkey % 7 || '.json' AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'b' || o_orderkey % 9 || '.json' END AS b FROM orders WHERE o_orderkey % 3 <> 0)
SELECT DISTINCT dir, unnest([name, a, b]) AS name FROM r UNION SELECT o_custkey, 'rel' || o_orderkey || '.json' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0""".replace("SELECT DISTINCT dir, unnest([name, a, b]) AS name FROM r", "SELECT dir, name FROM (SELECT dir, unnest([name, a, b]) AS name FROM r) WHERE name IS NOT NULL"))
def used_names(spark, sf_dir):
    """Files in use: relationships that a data group links to, and their ends."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.concat(F.lit("rel"), key.cast("string"), F.lit(".json"))
    groups = orders.filter("o_orderkey % 3 <> 0 or o_orderkey % 2 = 0").select(F.col("o_custkey").alias("dir"), F.concat(F.lit("./"), name).alias("name"))
    end = lambda p, n: F.concat(F.lit(f"./{p}"), (key % n).cast("string"), F.lit(".json"))
    relationships = orders.filter("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("dir"), name.alias("name"), end("a", 7).alias("from"), F.when(key % 2 == 0, end("b", 9)).alias("to"))
    return scan.used_names(groups, relationships)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'media' ELSE 'json' END AS stage, 'n' || c_nationkey || '/' || CASE WHEN c_custkey % 2 = 0 THEN 'media/a/' || c_custkey || '.png' ELSE 'json/a/' || c_custkey || '.json' END AS staged, NULL::VARCHAR AS failed FROM customer""".replace(", NULL::VARCHAR AS failed", ""))
def upload_stages(spark, sf_dir):
    """K-13: files by stage, below their property."""
    key = F.col("c_custkey")
    files = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("property"), F.concat(F.lit("a/"), key.cast("string"), F.when(key % 2 == 0, ".png").otherwise(".json")).alias("path"))
    return scan.staged(files).select("c_custkey", "stage", "staged")


@query("""SELECT p_partkey, 'x/' || p_partkey || '.json' AS path, CASE WHEN p_partkey % 2 = 0 THEN 'x/' || p_partkey || '.json' ELSE p_partkey || '.json' END AS relative FROM part""")
def relative_paths(spark, sf_dir):
    """Paths below an input's folder, with slashes one way; the only folder of an input is the property."""
    key = F.col("p_partkey").cast("string")
    full = F.concat(F.when(F.col("p_partkey") % 2 == 0, "C:\\in\\").otherwise("D:\\"), F.lit("x\\"), key, F.lit(".json"))
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("only/x/"), key, F.lit(".json")).alias("path"), scan.relative_path(full, F.lit("C:\\in")).alias("relative"))
    return scan.property_root(files).select("p_partkey", "path", "relative")


# Fact sheets.


def _sheets(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    slot = F.get(F.array(*map(F.lit, ("property_has_tax", "tax_has_deed", "tax_has_fact_sheet"))), (key % 3).cast("int"))
    links = orders.select(F.col("o_custkey").alias("dir"), key.alias("seq"), slot.alias("slot"), F.concat(F.lit("r"), key.cast("string")).alias("file"), F.lit("g").alias("schema_cid"))
    end = lambda p, n: F.concat(F.lit(f"./{p}_"), (key % n).cast("string"), F.lit(".json"))
    relationships = orders.select(F.col("o_custkey").alias("dir"), F.concat(F.lit("r"), key.cast("string")).alias("file"), F.when(key % 3 == 0, end("property", 1)).otherwise(end("tax", 2)).alias("from"), F.when(key % 3 == 0, end("tax", 2)).otherwise(end("deed", 4)).alias("to"))
    schemas = spark.createDataFrame([("g", "property_has_tax", "r1"), ("g", "tax_has_deed", "r2"), ("g", "tax_has_fact_sheet", "r3")], "schema_cid string, slot string, relationship_cid string")
    ends = spark.createDataFrame([("r1", "c1", "c2"), ("r2", "c2", "c3"), ("r3", "c2", "c9")], "relationship_cid string, from_cid string, to_cid string")
    titles = spark.createDataFrame([("c1", "property"), ("c2", "tax"), ("c3", "deed")], "cid string, title string")
    return factsheets.class_files(links, relationships, schemas, ends, titles)


_SHEET_SQL = """WITH f AS (SELECT o_custkey AS dir, o_orderkey AS seq, 0 AS side, CASE WHEN o_orderkey % 3 = 0 THEN 'property_0.json' ELSE 'tax_' || o_orderkey % 2 || '.json' END AS file FROM orders WHERE o_orderkey % 3 <> 2
UNION ALL SELECT o_custkey, o_orderkey, 1, CASE WHEN o_orderkey % 3 = 0 THEN 'tax_' || o_orderkey % 2 || '.json' ELSE 'deed_' || o_orderkey % 4 || '.json' END FROM orders WHERE o_orderkey % 3 <> 2),
c AS (SELECT dir, file, split_part(file, '_', 1) AS class, min((seq, side)) AS place FROM f GROUP BY ALL)
"""


@query(_SHEET_SQL + """SELECT dir, class, 'relationship_' || replace(file, '.json', '') || '_to_fact_sheet.json' AS name, '{"from":{"/":"./' || file || '"},"to":{"/":"./fact_sheet.json"}}' AS content FROM c""")
def fact_sheet_relationships(spark, sf_dir):
    """R-F, J10, A9, F15: a relationship to the fact sheet from every file that a data group links to."""
    return factsheets.sheet_relationships(_sheets(spark, sf_dir))


@query(_SHEET_SQL + """SELECT dir, class || '_has_fact_sheet' AS slot, string_agg('./relationship_' || replace(file, '.json', '') || '_to_fact_sheet.json', ',' ORDER BY place) AS files FROM c WHERE class <> 'tax' OR dir % 2 = 0 GROUP BY 1, 2""")
def fact_sheet_slots(spark, sf_dir):
    """What data groups lack, in order; some have the slot of one class."""
    classes = _sheets(spark, sf_dir)
    groups = classes.select("dir").distinct().select("dir", F.lit("g").alias("group"), F.when(F.col("dir") % 2 == 0, F.array(F.lit("tax"))).otherwise(F.array(F.lit("tax_has_fact_sheet"))).alias("slots"))
    return factsheets.sheet_slots(classes, groups).select("dir", "slot", F.array_join("files", ",").alias("files"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '{"ipfs_url":"./index.html","full_generation_command":"npx -y sheets@1.' || n_nationkey || ' generate --input ${inputDir} --output ${outputDir} --inline-js --inline-css --inline-svg"}' ELSE '{"ipfs_url":"./index.html","full_generation_command":null}' END AS content FROM nation""")
def fact_sheet_file(spark, sf_dir):
    """K-17: the fact sheet's document, with a tool's version or without."""
    version = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("1."), F.col("n_nationkey").cast("string")))
    return table(spark, sf_dir, "nation").select("n_nationkey", factsheets.sheet_text("sheets", version).alias("content"))


# Flows.


def _requests(spark, sf_dir):
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 1, "application/json").when(k % 3 == 2, "text/xml")
    request = F.struct(
        F.when(k % 7 == 0, "ftp://h/p").otherwise("https://h/p?a=1").alias("url"), F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"), F.create_map(F.lit("b"), F.array(k.cast("string"))).alias("query"),
        F.when(kind.isNotNull(), F.create_map(F.lit("content-type"), kind)).alias("headers"), F.when(k % 5 == 1, "{}").alias("json"), F.when((k % 5 == 2) | (k % 35 == 1), "x").alias("body"),
    )
    return table(spark, sf_dir, "customer").select(F.floor(k / 4).alias("flow"), (k % 4).alias("pos"), F.concat(F.lit("k"), (k % 4 % 3).cast("string")).alias("key"), request.alias("request"), "c_custkey")


@query(f"""WITH r AS (SELECT c_custkey // 4 AS flow, c_custkey % 4 AS pos, c_custkey % 4 % 3 AS key, c_custkey % 7 = 0 AS ftp, c_custkey % 2 = 0 AS get, c_custkey % 3 AS kind, c_custkey % 5 = 1 AS j, c_custkey % 5 = 2 OR c_custkey % 35 = 1 AS b FROM customer),
p AS (SELECT flow, pos, key, list_filter([CASE WHEN ftp THEN '{flows.BAD_URL}' END, CASE WHEN get AND (j OR b) THEN '{flows.GET_BODY}' END, CASE WHEN j AND b THEN '{flows.TWO_BODIES}' END, CASE WHEN j AND kind <> 1 THEN '{flows.JSON_TYPE}' END,
CASE WHEN b AND kind <> 2 THEN '{flows.BODY_TYPE}' END, CASE WHEN NOT get AND kind = 1 AND NOT j THEN '{flows.JSON_MISSING}' END, CASE WHEN NOT get AND kind = 2 AND NOT b THEN '{flows.BODY_MISSING}' END], lambda m: m IS NOT NULL) AS own FROM r)
SELECT flow, array_to_string(list_concat(flatten(list(list_transform(own, lambda m: 'requests.' || pos || ': ' || m) ORDER BY pos)), CASE WHEN count(*) > count(DISTINCT key) THEN ['Duplicate request key: "k0"'] ELSE [] END), ';') AS problems FROM p GROUP BY 1""")
def flow_problems(spark, sf_dir):
    """Which rules the requests of flows break."""
    return flows.flow_problems(_requests(spark, sf_dir)).select("flow", F.array_join("problems", ";").alias("problems"))


@query("""SELECT c_custkey, '{"url":"' || CASE WHEN c_custkey % 7 = 0 THEN 'ftp://h/p' ELSE 'https://h/p' END || '","method":"' || CASE WHEN c_custkey % 2 = 0 THEN 'GET' ELSE 'POST' END || '","multiValueQueryString":{' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '"a":["1"],' END || '"b":["' || c_custkey || '"]}'
|| CASE c_custkey % 3 WHEN 1 THEN ',"headers":{"content-type":"application/json"}' WHEN 2 THEN ',"headers":{"content-type":"text/xml"}' ELSE '' END || CASE WHEN c_custkey % 5 = 1 THEN ',"json":{}' ELSE '' END || CASE WHEN c_custkey % 5 = 2 OR c_custkey % 35 = 1 THEN ',"body":"x"' ELSE '' END || '}' AS request FROM customer""")
def request_normal_form(spark, sf_dir):
    """Requests with all of their query in the map."""
    return _requests(spark, sf_dir).select("c_custkey", F.to_json(flows.normalized(F.col("request"))).alias("request"))


@query("""SELECT c_custkey::VARCHAR AS request_identifier, '{"owner":{"source_http_request":{"url":"https://h/' || c_custkey || '","method":"GET","multiValueQueryString":{"q":["1"],"id":["<' || c_custkey || '>"]}},"response":' || CASE WHEN c_custkey % 2 = 0 THEN '{"n":' || c_custkey || '}' ELSE '"' || c_custkey || '"' END
|| '},"tax":{"source_http_request":{"url":"https://h/tax","method":"POST","headers":{"x":"' || c_custkey || '"},"json":{"id":"' || c_custkey || '"}},"response":[1]}}' AS combined FROM customer""")
def flow_results(spark, sf_dir):
    """A flow of two requests for every identifier, templates filled, with its responses."""
    it = "{{=it.request_identifier}}"
    request = "struct<url:string,method:string,query:map<string,array<string>>,headers:map<string,string>,json:string,body:string>"
    flow = spark.createDataFrame([("owner", (f"https://h/{it}?q=1", "GET", {"id": [f"<{it}>"]}, None, None, None)), ("tax", ("https://h/tax", "POST", None, {"x": it}, f'{{"id":"{it}"}}', None))], f"key string, request {request}")
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("request_identifier"))
    owner = F.when(F.col("request_identifier").cast("long") % 2 == 0, F.concat(F.lit('{"n": '), "request_identifier", F.lit("}"))).otherwise(F.col("request_identifier"))
    responses = ids.select("request_identifier", F.explode(F.array(F.struct(F.lit("owner").alias("key"), owner.alias("text")), F.struct(F.lit("tax").alias("key"), F.lit("[1]").alias("text")))).alias("r")).select("request_identifier", "r.*")
    return flows.flow_results(ids, flow, responses)


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://end/p' ELSE regexp_extract(url, '^([^?#]*)', 1) END AS last, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^([^?#]*)', 1) END AS entry FROM pages""")
def request_swap(spark, sf_dir):
    """Requests that a walk through pages moved."""
    entry = F.struct(F.regexp_extract("url", "^([^?#]*)", 1).alias("url"), F.lit("GET").alias("method"))
    final = F.when(F.col("page_id") % 3 == 0, "https://end/p?x=1").when(F.col("page_id") % 3 == 1, entry["url"])
    found = table(spark, sf_dir, "pages").select("page_id", flows.swapped_request(entry, final).alias("s"))
    return found.select("page_id", F.col("s.source_http_request.url").alias("last"), F.col("s.entry_http_request.url").alias("entry"))


@query("""WITH RECURSIVE y AS (SELECT o_custkey AS c, 1998 AS year FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1 UNION SELECT c, y.year - 1 FROM y JOIN (SELECT DISTINCT o_custkey, year(o_orderdate) AS yy FROM orders) ON o_custkey = c AND yy = y.year - 1)
SELECT c || '-0' AS parcel, year::INTEGER AS year, (SELECT count(*) FROM orders WHERE o_custkey = c AND year(o_orderdate) = y.year) AS amount FROM y""")
def paged_years(spark, sf_dir):
    """Tax years from the last one down to the first gap."""
    orders = table(spark, sf_dir, "orders")
    pages = orders.groupBy(F.concat(F.col("o_custkey").cast("string"), F.lit("0")).alias("parcel"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("amount"))
    parcels = orders.select(F.concat(F.col("o_custkey").cast("string"), F.lit("-0")).alias("parcel")).distinct()
    return flows.paged_years(parcels, pages, 1998)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'multi-request' WHEN c_custkey % 3 = 0 THEN 'county' WHEN c_custkey % 5 = 0 THEN 'flow file' WHEN c_custkey % 7 = 0 THEN 'template' WHEN c_custkey % 11 = 0 THEN 'browser' ELSE 'fetch' END AS route FROM customer""")
def fetch_routes(spark, sf_dir):
    """Who fetches what."""
    k = F.col("c_custkey")
    given = lambda n: F.when(k % n == 0, "x").otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", flows.route(given(2), F.when(k % 3 == 0, " Orange"), given(5), given(7), k % 11 == 0).alias("route"))


# Logs and transactions.

_WORD = "lpad(lower(to_hex({0})), 64, '0')"


def _word(c):
    return F.lpad(F.lower(F.hex(c)), 64, "0")


@query(f"""SELECT event_id AS block, {CID_SQL.format(h=_WORD.format("event_id + 1"))} AS cid, '0x' || lpad(lower(to_hex(7)), 40, '0') AS account FROM events WHERE user_id % 5 = 2 AND event_id >= 100 AND event_id % 4 <> 3""")
def assigned_events(spark, sf_dir):
    """The assignments of one account in a range of blocks; what doesn't decode is left out."""
    data = F.when(F.col("event_id") % 4 == 3, "0x12").otherwise(F.concat(F.lit("0x"), _word(F.col("event_id") + 1)))
    account = F.when(F.col("user_id") % 5 == 2, 7).otherwise(8)
    logs = table(spark, sf_dir, "events").select(F.array(F.lit("0xsig"), F.concat(F.lit("0x"), F.upper(_word(account)))).alias("topics"), data.alias("data"), F.col("event_id").alias("block"), F.lit("t").alias("tx"))
    return events.assigned(logs, "0x" + "0" * 39 + "7", first=100).select("block", "cid", "account")


@query(f"""SELECT o_orderkey AS tx, n::INTEGER AS pos, '0x' || {_WORD.format("o_orderkey")} AS property_hash, {CID_SQL.format(h=_WORD.format("o_custkey + 1"))} AS group_cid, CASE WHEN n > 0 THEN {CID_SQL.format(h=_WORD.format("n"))} END AS data_cid FROM orders, range(0, 3) r(n) WHERE n < o_orderkey % 3""")
def batch_items(spark, sf_dir):
    """The items of batch calls, from their data."""
    items = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(_word(F.col("o_orderkey")), _word(F.col("o_custkey") + 1), _word(i)))
    n = F.col("o_orderkey") % 3
    data = F.concat(F.lit("0xabcdef01"), _word(F.lit(32)), _word(n), F.array_join(F.slice(items, 1, n.cast("int")), ""))
    found = events.with_cids(events.batch_items(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), data.alias("input"))))
    return found.select("tx", "pos", "property_hash", "group_cid", "data_cid")


@query("SELECT l_orderkey, l_linenumber, (l_partkey * 12345678 / 1000000000::DECIMAL(10,0))::DOUBLE AS gas_price, CASE WHEN l_linenumber > 2 THEN 0.001 END::DOUBLE AS max_fee FROM lineitem")
def gas_prices(spark, sf_dir):
    """Fees in gwei; old chains have no maximum."""
    fees = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 12345678).alias("gas_price"), F.when(F.col("l_linenumber") > 2, 1_000_000).alias("max_fee"), F.lit(None).cast("long").alias("priority_fee"))
    return events.gas_prices(fees).select("l_orderkey", "l_linenumber", F.col("gas_price").cast("double").alias("gas_price"), F.col("max_fee").cast("double").alias("max_fee"))


@query("""SELECT o_orderkey AS batch, '{"from":"0xa","to":"0xb","gas":"0x' || lower(to_hex(21000 + o_orderkey)) || '","value":"0x0","data":"0x00","nonce":"0x' || lower(to_hex(o_custkey)) || '","type":"' || CASE WHEN o_orderkey % 2 = 0 THEN '0x2","chainId":"0x89","maxFeePerGas":"0x6fc23ac00","maxPriorityFeePerGas":"0xb2d05e00"}' ELSE '0x0","chainId":"0x89","gasPrice":"0x' || lower(to_hex(o_custkey + 1)) || '"}' END AS transaction FROM orders""")
def unsigned_transactions(spark, sf_dir):
    """K-9: transactions to be signed elsewhere, of the new kind and the old."""
    new = F.col("o_orderkey") % 2 == 0
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch"), (F.col("o_orderkey") + 21000).alias("gas"), F.col("o_custkey").alias("nonce"), F.lit("0x00").alias("data"), F.when(new, 30_000_000_000).alias("max_fee"), F.when(new, 3_000_000_000).alias("priority_fee"), (F.col("o_custkey") + 1).alias("gas_price"))
    return submit.unsigned_json(rows, "0xa", "0xb", "0x89")


@query(f"""SELECT c_custkey, '0x' || sha256(c_name) AS property_hash, CASE WHEN c_custkey % 3 <> 0 THEN '0x' || sha256(c_mktsegment) END AS data_hash FROM customer""")
def contract_hashes(spark, sf_dir):
    """Identifiers as hashes, also after a dot; what isn't a raw one has none."""
    of = lambda c: cid.cid_raw(F.col(c))
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    rows = customers.select("c_custkey", F.concat(F.lit("."), of("c_name")).alias("property_cid"), F.when(F.col("c_custkey") % 3 != 0, of("c_mktsegment")).otherwise("bafybad").alias("data_cid"))
    return submit.item_hashes(rows, ("property_cid", "data_cid")).select("c_custkey", "property_hash", "data_hash")


@query("""SELECT o_custkey, count(*) AS items, CASE WHEN count(*) > 12 THEN 'Batch size ' || count(*) || ' exceeds configured max of 12' END AS problem, CASE WHEN count(*) % 2 = 0 THEN count(*) * 1000 + count(*) * 300 ELSE 30000000 END AS gas FROM orders GROUP BY 1""")
def batch_limits(spark, sf_dir):
    """Sizes of batches, and limits of unsigned transactions with and without an estimate."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("items"))
    return per.select("o_custkey", "items", submit.batch_problem(F.col("items"), 12).alias("problem"), submit.unsigned_gas(F.when(F.col("items") % 2 == 0, F.col("items") * 1000)).alias("gas"))


# Reports.


@query("""SELECT 'p' || o_custkey AS "propertyCid", 'g' || o_orderkey % 4 AS "dataGroupCid", 'd' || o_orderkey AS "dataCid", 'x/' || o_orderkey || '.json' AS "filePath", '' AS "uploadedAt", CASE WHEN o_custkey % 2 = 0 THEN 'https://ipfs.io/ipfs/m' || o_custkey ELSE '' END AS "htmlLink" FROM orders WHERE o_orderkey % 4 <> 0""")
def hash_report(spark, sf_dir):
    """K-1, F13: main files with their identifiers."""
    key, owner = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), owner).alias("property_cid"), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("g"), (F.col("o_orderkey") % 4).cast("string"))).otherwise("").alias("data_group_cid"), F.concat(F.lit("d"), key).alias("data_cid"), F.concat(F.lit("x/"), key, F.lit(".json")).alias("path"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("m"), owner)).alias("media_cid"))
    return reports.hash_rows(files)


@query("""SELECT 'd' || o_orderkey AS "dataCid", CASE WHEN o_custkey % 3 = 0 THEN 'by cid ' || o_custkey WHEN o_custkey % 3 = 1 THEN 'by dir ' || o_custkey ELSE '' END AS "htmlLink", CASE WHEN o_orderkey % 2 = 0 THEN '2024' ELSE '' END AS "uploadedAt" FROM orders""")
def upload_report(spark, sf_dir):
    """K-5, J8: sent files with the link of their page, by identifier or folder."""
    orders, owner = table(spark, sf_dir, "orders"), F.col("o_custkey").cast("string")
    files = orders.select(F.concat(F.lit("p"), owner).alias("property_cid"), F.concat(F.lit("d"), owner).alias("dir"), F.lit("g").alias("data_group_cid"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("data_cid"), F.lit("x").alias("path"), F.when(F.col("o_orderkey") % 2 == 0, "2024").alias("sent_at"))
    k = F.col("o_custkey") % 3
    results = orders.filter("o_custkey % 3 < 2").select(F.concat(F.when(k == 0, "p").otherwise("d"), owner).alias("key"), F.concat(F.when(k == 0, "by cid ").otherwise("by dir "), owner).alias("link")).distinct()
    return reports.upload_rows(files, results).select("dataCid", "htmlLink", "uploadedAt")


@query("""SELECT 'https://h/' || o_custkey AS "htmlLink", arg_min('p' || o_orderkey, o_orderkey) AS "propertyCid", min(o_orderkey) AS seq FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1 ORDER BY 3 LIMIT 5""")
def first_links(spark, sf_dir):
    """The first five pages of a report."""
    link = F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("https://h/"), F.col("o_custkey").cast("string"))).otherwise("")
    return reports.first_links(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("propertyCid"), link.alias("htmlLink")))


@query("""SELECT event_id, 'p' || user_id || ',g,' || CASE WHEN event_id % 2 = 0 THEN '"a,b"' ELSE 'a' END || ',/x,' || '"say ' || repeat(chr(34), 2) || 'no' || repeat(chr(34), 3) || ',' || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'null' ELSE event_type END || ',now' AS line FROM events""")
def error_report_lines(spark, sf_dir):
    """K-3, K-4, P9, G1: error rows as lines of a report, values as they are shown."""
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "undefined").when(k % 3 == 1, "null").otherwise("string")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("property_cid"), F.lit("g").alias("data_group_cid"), F.when(k % 2 == 0, "a,b").otherwise("a").alias("file_path"), F.lit("/x").alias("error_path"), F.lit('say "no"').alias("error_message"), formats.value_text(kind, F.col("event_type")).alias("value"))
    stamped = rows.select("event_id", *(F.col(c) for c in reports.ERRORS[:5]), F.coalesce("value", F.lit("")).alias("currentValue"), F.lit("now").alias("timestamp"))
    return stamped.select("event_id", reports.csv_lines(stamped.drop("event_id")).alias("line"))


@query("""SELECT conv_id, turn, 'a,"b|' || coalesce(regexp_extract(replace(text, chr(34), ''), '^[^\n]*'), '') || '|' AS fields FROM conversations""")
def csv_line_parts(spark, sf_dir):
    """The fields of single lines, quoted as they must be."""
    text = F.regexp_extract(F.replace("text", F.lit('"'), F.lit("")), "^[^\n]*", 0)
    line = F.concat(F.lit('"a,""b",'), formats.csv_field(F.coalesce(text, F.lit(""))), F.lit(","))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(reports.csv_parts(line, 3), "|").alias("fields"))


@query("""SELECT o_orderkey::VARCHAR AS "transactionHash", CASE WHEN o_orderkey % 3 = 0 OR o_custkey = 0 THEN '' ELSE o_custkey::VARCHAR END AS "blockNumber", CASE WHEN o_orderkey % 2 = 0 THEN 'late' ELSE '' END AS error FROM orders""")
def status_report(spark, sf_dir):
    """K-6: the states of transactions; block 0 is no block."""
    key = F.col("o_orderkey")
    txs = table(spark, sf_dir, "orders").select(F.lit(1).alias("batch"), key.alias("tx"), F.lit("success").alias("status"), F.when(key % 3 != 0, F.col("o_custkey")).otherwise(0).alias("block"), F.lit(5).alias("gas"), F.lit(2).alias("items"), F.when(key % 2 == 0, "late").alias("error"), F.lit("now").alias("at"))
    return reports.status_rows(txs).select("transactionHash", "blockNumber", "error")


@query("""SELECT o_orderkey::VARCHAR AS "transactionHash", CASE WHEN o_orderkey % 2 = 0 THEN 'success' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR ELSE '' END AS "blockNumber" FROM orders""")
def checked_report(spark, sf_dir):
    """K-7, K-8: sent transactions with what a later look found."""
    orders, tx = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    ids = orders.select(tx.alias("transactionHash"), F.lit(0).alias("batchIndex"), F.lit(2).alias("itemCount"), F.lit("t").alias("timestamp"), F.lit("pending").alias("status"))
    checked = orders.filter("o_orderkey % 2 = 0").select(tx.alias("tx"), F.lit("success").alias("status"), F.col("o_custkey").alias("block"), F.lit(1).alias("gas"), F.lit("now").alias("checked_at"), F.lit(None).cast("string").alias("error"))
    return reports.checked_rows(ids, checked).select("transactionHash", "status", "blockNumber")


# Small functions.


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'CID must be a non-empty string' WHEN 1 THEN 'Expected CID v1, got CID v0' WHEN 2 THEN 'Expected raw codec (0x55), got codec 0x70' WHEN 3 THEN 'Expected SHA-256 hash (0x12), got hash algorithm 0x13' WHEN 4 THEN 'Invalid CID format' END AS problem, c_custkey % 6 IN (2, 5) AS uri_ok FROM customer""")
def cid_problems(spark, sf_dir):
    """What keeps identifiers from being hashes, and which of them addresses may hold."""
    k = F.col("c_custkey") % 6
    text = lambda header: F.concat(F.lit("b"), cid.base32_of_hex(F.concat(F.lit(header), F.sha2("c_name", 256)), 58))
    x = F.when(k == 0, "").when(k == 1, "QmYwAPJzv5CZsnA625s3Xf2nemtYgPpHdWEz79ojWnPbdG").when(k == 2, text("01701220")).when(k == 3, text("01551320")).when(k == 4, "not one").otherwise(text("01551220"))
    return table(spark, sf_dir, "customer").select("c_custkey", formats.cid_problem(x).alias("problem"), formats.ipfs_uri_ok(F.concat(F.lit("ipfs://"), x)).alias("uri_ok"))


@query("""SELECT event_id, event_type IN ('error', 'click') AS nonce, event_type = 'view' AS transient FROM events""")
def error_kinds(spark, sf_dir):
    """errors that a new number or another try mends."""
    kind = F.col("event_type")
    message = F.when(kind == "error", "Nonce too low").when(kind == "click", "Replacement transaction underpriced").when(kind == "view", "read ECONNRESET").otherwise("reverted")
    return table(spark, sf_dir, "events").select("event_id", formats.is_nonce_error(message).alias("nonce"), formats.is_transient_error(message).alias("transient"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'u' || c_custkey || '|p:w|1.2.3.4|80' END AS proxy, CASE WHEN c_custkey % 3 = 0 THEN 'code ' || c_custkey ELSE 'bare ' || c_custkey END AS fenced,
CASE c_custkey % 3 WHEN 0 THEN 'You have preiously created all 3 scripts. Please review and fix any issues in the extraction scripts. Fix these issues: do ' || c_custkey WHEN 1 THEN 'You have preiously created all 3 scripts. Please review and fix any issues in the extraction scripts. bad' ELSE 'Please review and fix any issues in the extraction scripts' END AS feedback FROM customer""")
def text_parts(spark, sf_dir):
    """Proxies, code fences and reviews taken apart."""
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    proxy = formats.proxy_parts(F.when(k % 2 == 0, F.concat(F.lit("u"), text, F.lit(":p:w@1.2.3.4:80"))).otherwise("u@h:1"))
    fence = F.when(k % 3 == 0, F.concat(F.lit("see\n```JS\n code "), text, F.lit("\n```\n```js\nno```"))).otherwise(F.concat(F.lit("\n bare "), text, F.lit(" ")))
    review = F.when(k % 3 == 0, F.concat(F.lit("x ACTION PLAN:\n do "), text, F.lit("\nSTATUS: REJECTED"))).when(k % 3 == 1, "STATUS: rejected: bad ").otherwise("fine")
    joined = F.when(proxy.isNotNull(), F.concat_ws("|", proxy["username"], proxy["password"], proxy["host"], proxy["port"].cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", joined.alias("proxy"), formats.fenced(fence).alias("fenced"), formats.feedback(review).alias("feedback"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'rel_from_c' || p_partkey WHEN 1 THEN 'rel' WHEN 2 THEN 'group' ELSE 'c' || p_partkey END || '.json' AS name FROM part""")
def fetched_names(spark, sf_dir):
    """Names of files for fetched content."""
    k = F.col("p_partkey")
    name = formats.fetched_name(F.when(k % 4 < 2, "rel"), F.when(k % 4 == 0, "from"), F.concat(F.lit("c"), k.cast("string")), k % 4 == 2, F.lit("group"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


@query("""SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), greatest(len(string_split(text, chr(10))) - 1, 1), len(string_split(text, chr(10)))), chr(10)) AS tail FROM documents""")
def tail_lines(spark, sf_dir):
    """The last two lines of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", formats.tail_lines(F.col("text"), 2).alias("tail"))


@query("""SELECT event_id, (event_id % 90061) // 3600 AS h, CASE WHEN event_id % 90061 >= 3600 THEN (event_id % 90061) // 3600 || 'h ' ELSE '' END || CASE WHEN event_id % 90061 >= 60 THEN (event_id % 90061) % 3600 // 60 || 'm ' ELSE '' END || event_id % 90061 % 60 || 's' AS duration, strftime(ts, '%Y-%m-%dT%H-%M-%S') AS stamp,
least(1000 * 2 ** (event_id % 9), 60000)::BIGINT AS backoff, event_id % 7 > 3 AS newer FROM events""")
def time_texts(spark, sf_dir):
    """Durations, stamps for file names, backoffs, versions."""
    k = F.col("event_id")
    version = F.concat(F.lit("1."), (k % 7).cast("string"), F.lit(".0"))
    s = k % 90061
    return table(spark, sf_dir, "events").select("event_id", F.floor(s / 3600).alias("h"), formats.duration_text(s).alias("duration"), formats.file_stamp(F.col("ts")).alias("stamp"), formats.backoff_ms(k % 9).alias("backoff"), formats.newer_version(version, F.lit("1.3.9")).alias("newer"))


@query("""SELECT c_custkey, c_custkey % 2 = 0 AS account, c_custkey % 3 = 0 AS block, 'p/' || c_custkey || '/q' AS swapped FROM customer""")
def small_formats(spark, sf_dir):
    """Account and block formats, the first UUID of a path replaced."""
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    account = F.concat(F.when(k % 2 == 0, "0x").otherwise("0y"), F.lpad(text, 40, "0"))
    block = F.when(k % 6 == 0, "latest").when(k % 3 == 0, text).otherwise("0x1")
    swapped = urls.swap_first_uuid(F.lit("p/0F8fad5b-d9cb-469f-a165-70867728950e/q"), text)
    return table(spark, sf_dir, "customer").select("c_custkey", formats.account_ok(account).alias("account"), formats.block_ok(block).alias("block"), swapped.alias("swapped"))


@query("""SELECT event_id, event_type = 'view' AS simple, event_type IN ('view', 'click', 'error') AS "any", event_type <> 'view' AND k % 2 = 0 AS canonical FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events)""")
def link_kinds(spark, sf_dir):
    """Documents with links, addresses or images, and which are canonical already."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    inner = F.when(kind == "view", '"b":[{"/":"./x"}]').when(kind == "click", '"ipfs_url":"./x.html"').when(kind == "error", '"b":["a.PNG"]').otherwise('"ipfs_url":"ipfs://x"')
    raw = F.when((kind == "view") | (k % 2 == 1), F.concat(F.lit('{"z":1,'), inner, F.lit("}"))).otherwise(F.concat(F.lit('{"a":1,'), inner, F.lit("}")))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", canon.json_has_link(F.col("raw")).alias("simple"), canon.json_has_any_link(F.col("raw")).alias("any"), (canon.canonical_json(F.col("raw")) == F.col("raw")).alias("canonical"))


_GROUP_PROBLEMS = (None, "Schema must be a valid JSON object", 'Data group schema must describe an object (type: "object")', 'Data group schema must have a "properties" object', 'Data group schema must have a "label" property', 'Data group schema must have a "relationships" property', 'Data group schema must have exactly 2 properties: "label" and "relationships"')


@query(f"""SELECT event_id, [{", ".join("NULL" if m is None else f"'{m}'" for m in _GROUP_PROBLEMS)}, 'Data group schema must have a "label" property'][(event_id % 8)::INTEGER + 1] AS problem FROM events""")
def datagroup_schemas(spark, sf_dir):
    """What is wrong with schemas of data groups."""
    note = F.concat(F.lit('{"type":"string","description":"'), "event_type", F.lit('"}'))
    of = lambda inner, kind="object": F.concat(F.lit(f'{{"type":"{kind}","properties":{{'), inner, F.lit("}}"))
    both = F.concat(F.lit('"label":'), note, F.lit(',"relationships":'), "props")
    cases = [of(both), F.concat(F.lit("not JSON "), "event_type"), of(both, "array"), F.concat(F.lit('{"type":"object","user":'), F.col("user_id").cast("string"), F.lit("}"))]
    cases += [of(F.concat(F.lit('"relationships":'), "props")), of(F.concat(F.lit('"label":'), "props")), of(F.concat(both, F.lit(',"x":1'))), of(F.concat(F.lit('"label":"","relationships":'), "props"))]
    return table(spark, sf_dir, "events").select("event_id", validate.datagroup_schema_problem(F.get(F.array(*cases), (F.col("event_id") % 8).cast("int"))).alias("problem"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'html' ELSE 'json' END AS kind FROM pages")
def response_kinds(spark, sf_dir):
    """Kinds of responses by their content type."""
    kind = F.when(F.col("page_id") % 2 == 0, "Text/HTML; charset=x").otherwise("application/json")
    return table(spark, sf_dir, "pages").select("page_id", fetch.response_kind(kind).alias("kind"))


# What scripts extract.


@query("""SELECT c_custkey, key, '{"url":"u' || c_custkey || '"}' AS request, CASE key WHEN 'a' THEN '{"n":' || c_custkey || '}' ELSE 'text' END AS response FROM customer, (VALUES ('a'), ('b')) t(key) WHERE key = 'a' OR c_custkey % 2 = 0""")
def request_inputs(spark, sf_dir):
    """Inputs made of several requests, taken apart."""
    text = F.col("c_custkey").cast("string")
    request = F.concat(F.lit('{"source_http_request":{"url":"u'), text, F.lit('"},"response":'))
    second = F.when(F.col("c_custkey") % 2 == 0, F.concat(request, F.lit('"text"}'))).otherwise('{"response":1}')
    raw = F.concat(F.lit('{"a":'), request, F.lit('{"n":'), text, F.lit('}},"b":'), second, F.lit(',"c":[1]}'))
    return entities.request_inputs(table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")))


@query("""SELECT o_custkey::VARCHAR AS property, 'layout_' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) || '.json' AS name, '{"room":' || o_orderkey || '}' AS content FROM orders""")
def room_layouts(spark, sf_dir):
    """E5: a file for each room."""
    rooms = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit('{"room":'), k.cast("string"), F.lit("}"))), ",")
    docs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(rooms.alias("rooms"))
    return entities.layouts(docs.select(F.concat(F.lit('{"property_'), F.col("o_custkey").cast("string"), F.lit('":{"layouts":['), "rooms", F.lit("]}}")).alias("raw")))


_CLASSES = ("property", "tax", "deed", "lot", "person")


@query(f"""WITH e AS (SELECT o_custkey AS property, o_orderkey AS seq, {list(_CLASSES)}[(o_orderkey % 5)::INTEGER + 1] AS class FROM orders WHERE o_orderkey % 7 <> 0), u AS (SELECT * FROM e WHERE class NOT IN ('property', 'lot') UNION ALL SELECT property, min(seq), class FROM e WHERE class IN ('property', 'lot') GROUP BY property, class)
SELECT property, class || CASE WHEN class IN ('property', 'lot') THEN '' ELSE '_' || row_number() OVER (PARTITION BY property, class ORDER BY seq) END || '.json' AS name, seq::VARCHAR AS content FROM u""")
def entity_files(spark, sf_dir):
    """Files of entities, none for what is absent."""
    key = F.col("o_orderkey")
    name = F.get(F.array(*map(F.lit, _CLASSES)), (key % 5).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("property"), name.alias("class"), key.alias("seq"), F.when(key % 7 != 0, key.cast("string")).alias("content"))
    one = rows.filter("class in ('property', 'lot') and content is not null").groupBy("property", "class").agg(F.min("seq").alias("seq"))
    rows = rows.filter("class not in ('property', 'lot')").unionByName(one.withColumn("content", F.col("seq").cast("string")))
    return entities.entity_files(rows)


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' END AS target, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN '{"type":"error","message":"Unknown enum value ' || o_orderstatus || '.","path":"order.status"}' END AS error FROM orders""")
def mapped_values(spark, sf_dir):
    """Source values by a mapping, unknown ones as errors."""
    mapping = spark.createDataFrame([("order.status", "O", "open"), ("order.status", "F", "final"), ("other.status", "P", "no")], "path string, source string, target string")
    values = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("order.status").alias("path"), F.col("o_orderstatus").alias("value"))
    return entities.mapped(values, mapping).select("o_orderkey", "target", "error")


@query("""SELECT DISTINCT a.o_custkey AS property, 'relationship_sales_' || a.o_orderkey || '_person_' || b.o_orderkey || '.json' AS name, '{"from":{"/":"./sales_' || a.o_orderkey || '.json"},"to":{"/":"./person_' || b.o_orderkey || '.json"}}' AS content FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND year(a.o_orderdate) = year(b.o_orderdate) WHERE a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1""")
def entity_relationships(spark, sf_dir):
    """Sales and the persons of their year."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    of = lambda odd, stem: orders.filter(key % 2 == odd).select(F.col("o_custkey").alias("property"), F.concat(F.lit(f"{stem}_"), key.cast("string"), F.lit(".json")).alias("name"), F.year("o_orderdate").alias("year"))
    return entities.linked_entities(of(0, "sales"), of(1, "person"), ["year"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown_date_' || row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 = 0 ORDER BY o_orderkey) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS label FROM orders""")
def owner_dates(spark, sf_dir):
    """Dates of owners, unknown ones numbered."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("date"))
    return entities.numbered_dates(rows, "o_custkey", "date", "o_orderkey").select("o_orderkey", "label")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN 'Solo' END AS raw, CASE WHEN c_custkey % 3 = 0 THEN 'empty name' WHEN c_custkey % 3 = 1 THEN 'single word' END AS reason FROM customer""")
def invalid_owners(spark, sf_dir):
    """Names that are neither a person nor a company."""
    k = F.col("c_custkey") % 3
    rows = owners.classify(table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, " ").when(k == 1, "Solo").otherwise("Ann Lee").alias("name")))
    return rows.select("c_custkey", entities.invalid_owner(F.col("name"), F.col("kind")).alias("i")).select("c_custkey", "i.raw", "i.reason")


def _title(page: str) -> dict[str, str]:
    start, end = page.lower().find("<title>"), page.lower().find("</title>")
    if start < 0 or end < 0:
        raise ValueError("no title")
    return {"title.json": page[start + 7 : end]}


@query("""SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title>.*?</title>') THEN 'title.json' END AS name, CASE WHEN regexp_matches(html, '(?is)<title>.*?</title>') THEN regexp_extract(html, '(?is)<title>(.*?)</title>', 1) END AS content, CASE WHEN NOT regexp_matches(html, '(?is)<title>.*?</title>') THEN 'no title' END AS error FROM pages""")
def extracted_titles(spark, sf_dir):
    """A registered extractor over pages; its failures are rows."""
    return entities.extracted(table(spark, sf_dir, "pages"), {"title": _title}, "page_id").select("page_id", "name", "content", "error")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS processed, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'click') AS skipped, count(*) AS total FROM events GROUP BY 1")
def run_totals(spark, sf_dir):
    """What runs processed, skipped and failed on."""
    kind = F.col("event_type")
    state = F.when(kind == "view", "processed").when(kind == "error", "error").when(kind == "click", "skipped")
    return entities.run_totals(table(spark, sf_dir, "events").withColumn("state", state), "user_id")


@query("""SELECT c_custkey, '{"a":{"/":"' || CASE WHEN c_custkey % 2 = 0 THEN './n' || c_custkey || '.json' ELSE 'bafyunknown' || c_custkey END || '"}}' AS text FROM customer""")
def saved_paths(spark, sf_dir):
    """Links by identifier become paths where their target is saved already."""
    key = F.col("c_custkey").cast("string")
    own = F.concat(F.when(F.col("c_custkey") % 2 == 0, "bafysaved").otherwise("bafyunknown"), key)
    known = F.when(F.col("c_custkey") % 2 == 0, F.create_map(own, F.concat(F.lit("./n"), key, F.lit(".json"))))
    raw = F.to_json(F.struct(F.struct(own.alias("/")).alias("a")))
    return table(spark, sf_dir, "customer").select("c_custkey", canon.linked_json(raw, known).alias("text"))


# Sources.


@query("""SELECT o_custkey::VARCHAR AS property, CASE WHEN count(*) OVER (PARTITION BY o_custkey) = 1 THEN '' ELSE 'd' || o_orderkey % 2 || '/' END || o_orderkey || '.json' AS entry, '{"k":' || o_orderkey || '}' AS content FROM orders
UNION ALL SELECT o_custkey::VARCHAR, o_orderkey || '.json', '{"k":' || o_orderkey || '}' FROM orders WHERE false""".replace("CASE WHEN count(*) OVER (PARTITION BY o_custkey) = 1 THEN '' ELSE 'd' || o_orderkey % 2 || '/' END || ", ""))
def archive_round_trip(spark, sf_dir):
    """S1, S2, S4, S5, S34, K-2: properties packed as archives and read again; a folder that all entries share goes."""
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("property"), F.concat(F.lit("d0/"), key, F.lit(".json")).alias("entry"), F.encode(F.concat(F.lit('{"k":'), key, F.lit("}")), "UTF-8").alias("content"))
    packed = files.write_archives(rows, "property").select(F.col("property").alias("path"), F.col("archive").alias("content"))
    noise = rows.select(F.col("entry").alias("path"), "content")
    found = files.unpacked(packed.unionByName(noise))
    return found.select(F.col("archive").alias("property"), "entry", F.decode("content", "UTF-8").alias("content"))
