"""Predicates and formatters on single values: identifiers, URLs, money, error pages, CSV fields, file kinds, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.cid import BASE32, BASE32HEX, hash_of_cid
from quern.functions.lets import let
from quern.functions.multiformats import BASE36, BASE58, base58_text

#: What marks a page as an error page, first match wins.
ERROR_PATTERNS = ("403 - forbidden", "access is denied", "server error 403", "404 not found", "request blocked", "access denied", "captcha", "verify you are human")
#: Extensions of images, and what a web address looks like.
IMAGE_TYPES = ("jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "tiff", "tif", "avif")
IPV4 = r"((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
URI = r"^https?://([\w-]+@)?[\w-]+(\.[\w-]+)+([\w\-.,@?^=%&:/~+#]*[\w\-@?^=%&/~+#])?$"


def loose_cid(x: Column) -> Column:
    """Looks like a content identifier; admits texts that aren't one."""
    return (
        F.when(x.isNull() | (F.length(x) < 10), False)
        .when(x.startswith("Qm") & (F.length(x) == 46), x.rlike("^Qm[a-zA-Z0-9]+$"))
        .when(x.startswith("b") & (F.length(x) > 20), x.rlike("^b[a-z2-7]+$"))
        .otherwise(x.rlike("^[a-zA-Z0-9]{20,}$"))
    )


def strict_raw_cid(x: Column) -> Column:
    return hash_of_cid(x).isNotNull()


def currency_ok(x: Column) -> Column:
    """A finite number, not negative, with at most two decimals in its shortest form."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x >= 0) & (F.round(x, 2) == x)


def rate_percent_ok(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[0-9]+\.[0-9]{3}$"), F.lit(False))


def uri_ok(x: Column) -> Column:
    return F.coalesce(x.rlike(URI), F.lit(False))


def ipfs_uri_ok(x: Column) -> Column:
    """A relative path, or ipfs:// and a CIDv1 (raw or dag-pb codec) with a sha2-256."""
    cid = lambda x: F.when(x.rlike("^ipfs://[A-Za-z0-9]{46,59}$"), cid_v1_hex(F.substr(x, F.lit(8))))
    return F.coalesce(let(x, lambda x: F.when(x.startswith("./"), F.length(x) > 2).otherwise(cid(x).rlike("^01(55|70)12"))), F.lit(False))


def json_value(raw: Column) -> Column:
    """Text as a VARIANT; null where it isn't JSON as a whole. Spark's parser stops at the end of the first value, so another one follows here that nobody can have written."""
    after = F.xxhash64(raw)
    both = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(","), after.cast("string"), F.lit("]")))
    return let(F.try_variant_get(both, "$", "array<variant>"), lambda v: F.when((F.size(v) == 2) & (F.try_variant_get(F.get(v, 1), "$", "bigint") == after), F.get(v, 0)))


def normal_path(path: Column) -> Column:
    """A path without empty and . segments, and without .. where a segment stands before it."""

    def step(seen: Column, x: Column) -> Column:
        back = (x == "..") & (F.size(seen) > 0) & F.coalesce(F.try_element_at(seen, F.lit(-1)) != "..", F.lit(False))
        return F.when(x.isin("", "."), seen).when(back, F.slice(seen, F.lit(1), F.size(seen) - 1)).otherwise(F.array_append(seen, x))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def content_ok(cid: Column, data: Column) -> Column:
    """Whether bytes are what a raw CIDv1 with a sha2-256 or sha2-512 stands for."""
    content = data.cast("binary")
    return F.coalesce(let(cid_v1_hex(cid), lambda h: F.when(h.startswith("01551220"), F.concat(F.lit("01551220"), F.sha2(content, 256)) == h).when(h.startswith("01551340"), F.concat(F.lit("01551340"), F.sha2(content, 512)) == h)), F.lit(False))


_VARINT = "(?:[89a-f][0-9a-f])*[0-7][0-9a-f]"
_LEAST_V0, _MOST_V0 = (base58_text(b"\x12\x20" + bytes([x]) * 32) for x in (0, 255))


def _hex_of_base32(x: Column) -> Column:
    """The bytes of unpadded base32 in hex, null where bits are left over that aren't zero."""

    def of(x: Column) -> Column:
        n = F.length(x)
        digits, groups = 2 * F.floor(n * 5 / 8).cast("int"), F.ceil(n / 12).cast("int")
        pieces = lambda upper: F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.lpad(F.conv(F.substr(upper, i * 12 + 1, F.lit(12)), 32, 16), 15, "0"))
        text = F.lower(F.array_join(let(F.rpad(F.translate(x, BASE32, BASE32HEX), groups * 12, "0"), pieces), ""))
        return F.when((n % 8).isin(0, 2, 4, 5, 7), let(text, lambda t: F.when(~F.substr(t, digits + 1).rlike("[^0]"), F.substr(t, F.lit(1), digits))))

    return let(x, of)


def _hex_of_digits(x: Column, alphabet: str) -> Column:
    """A number in digits of `alphabet` in hex, an even number of digits; long multiplication with limbs of 16 bits, the lowest first."""
    base = len(alphabet)
    carried = lambda s, limb: F.struct(F.array_append(s["out"], (limb * base + s["carry"]) % 65536).alias("out"), F.floor((limb * base + s["carry"]) / 65536).cast("long").alias("carry"))
    start = lambda digit: F.struct(F.array().cast("array<bigint>").alias("out"), digit.alias("carry"))
    zeros = F.array_repeat(F.lit(0).cast("long"), F.ceil(F.length(x) * 6 / 16).cast("int") + 1)
    limbs = F.aggregate(F.split(x, ""), zeros, lambda s, c: F.aggregate(s, start((F.position(c, F.lit(alphabet)) - 1).cast("long")), carried, lambda t: t["out"]))
    text = F.regexp_replace(F.array_join(F.transform(F.reverse(limbs), lambda v: F.lpad(F.hex(v), 4, "0")), ""), "^0+", "")
    return F.lower(let(text, lambda t: F.when(F.length(t) % 2 == 1, F.concat(F.lit("0"), t)).otherwise(t)))


def cid_v1_hex(x: Column) -> Column:
    """The bytes in hex of a CIDv1 in base32, base36 or base58 whose length is right; null where the text isn't one."""

    def bytes_hex(x: Column) -> Column:
        body = F.substr(x, F.lit(2))
        return F.when(x.rlike("^b[a-z2-7]+$"), _hex_of_base32(body)).when(x.rlike("^z[1-9A-HJ-NP-Za-km-z]+$"), _hex_of_digits(body, BASE58)).when(x.rlike("^k[0-9a-z]+$"), _hex_of_digits(body, BASE36))

    def whole(t: Column) -> Column:
        size, rest = F.regexp_extract(t, f"^01{_VARINT}{_VARINT}({_VARINT})", 1), F.length(t) - F.length(F.regexp_extract(t, f"^01{_VARINT}{_VARINT}{_VARINT}", 0))
        byte = lambda k: F.conv(F.substr(size, F.lit(2 * k + 1), F.lit(2)), 16, 10).cast("int")
        n = F.when(F.length(size) == 2, byte(0)).when(F.length(size) == 4, byte(0) % 128 + 128 * byte(1))
        return F.when(2 * n == rest, t)

    return let(let(x, bytes_hex), whole)


def cid_v0_ok(x: Column) -> Column:
    """A CIDv0: 46 digits in base58, of which the alphabet is in order, between the least and the greatest sha2-256."""
    return F.coalesce(let(x, lambda x: x.rlike("^[1-9A-HJ-NP-Za-km-z]{46}$") & x.between(_LEAST_V0, _MOST_V0)), F.lit(False))


def strict_cid(x: Column) -> Column:
    """an identifier of version 0 or 1, of any codec and hash."""
    return let(x, lambda x: cid_v0_ok(x) | cid_v1_hex(x).isNotNull())


def ipv6_ok(x: Column) -> Column:
    """Eight groups, or fewer around one ::, the last two perhaps as an IPv4 address."""
    plain = F.regexp_replace(x, f"(?<=:){IPV4}$", "0:0")
    group = "[0-9A-Fa-f]{1,4}"
    n = F.size(F.array_remove(F.split(plain, ":"), ""))
    return F.coalesce(plain.rlike(f"^({group}:){{7}}{group}$") | (plain.rlike(f"^({group}(:{group})*)?::({group}(:{group})*)?$") & (n <= 7)), F.lit(False))


def account_ok(x: Column) -> Column:
    return F.coalesce(x.rlike("^0x[0-9a-fA-F]{40}$"), F.lit(False))


def block_ok(x: Column) -> Column:
    return F.coalesce((x == "latest") | x.rlike("^[0-9]+$"), F.lit(False))


def hash_problem(x: Column) -> Column:
    """The first thing that is wrong with a sha2-256 in hex, null if nothing is."""
    bare = F.regexp_replace(F.coalesce(x, F.lit("")), "^0x", "")
    return F.when(F.length(F.trim(F.coalesce(x, F.lit("")))) == 0, "empty").when(F.length(bare) != 64, "length").when(~bare.rlike("^[0-9a-fA-F]*$"), "digits")


def error_pattern(html: Column, extra: tuple[str, ...] = (), skip_captcha: bool = False) -> Column:
    """The first error pattern that the page holds, null if none."""
    patterns = [p for p in (*ERROR_PATTERNS, *extra) if not (skip_captcha and p == "captcha")]
    lower = F.lower(html)
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(F.contains(lower, F.lit(p.lower())), p).otherwise(out)
    return out


def csv_field(x: Column) -> Column:
    """Quoted where a comma, quote or newline asks for it, quotes doubled."""
    return F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def file_kind(name: Column) -> Column:
    """`media` (pages and images), `json` or `other`, from the extension."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return F.when(ext.isin("html", "htm", *IMAGE_TYPES), "media").when(ext == "json", "json").otherwise("other")


def last_segment(path: Column) -> Column:
    """The last non-empty part of a slash path; `root` if there is none."""
    return F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(-1)), F.lit("root"))


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss")


def newer_version(a: Column, b: Column) -> Column:
    """Whether version a (three numbers) is later than b."""
    parts = lambda v: F.transform(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return parts(a) > parts(b)


def backoff_ms(attempt: Column, base: int = 1000, factor: float = 2.0, cap: int = 60000) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(cap)).cast("long")


def cid_problem(x: Column) -> Column:
    """F8: the first thing that keeps an identifier (version 0, or base32) from being a hash, null if nothing does. The messages are fixed values."""

    def header(x: Column) -> Column:
        """Ten digits: version, codec, hash, its size, and one byte of it; null where there are none."""
        return F.when(x.rlike("^b[a-z2-7]{8,}$"), F.lower(F.lpad(F.conv(F.translate(F.substr(x, F.lit(2), F.lit(8)), BASE32, BASE32HEX), 32, 16), 10, "0")))

    def judged(x: Column, code: Column) -> Column:
        part = lambda k: F.substr(code, F.lit(2 * k + 1), F.lit(2))
        of = lambda text, k: F.concat(F.lit(text), F.regexp_replace(part(k), "^0", ""))
        bad = F.when(x.rlike("^Qm[1-9A-HJ-NP-Za-km-z]{44}$"), "Expected CID v1, got CID v0").when(code.isNull() | (part(0) != "01"), "Invalid CID format")
        bad = bad.when(part(1) != "55", of("Expected raw codec (0x55), got codec 0x", 1)).when(part(2) != "12", of("Expected SHA-256 hash (0x12), got hash algorithm 0x", 2))
        bad = bad.when(part(3) != "20", F.concat(F.lit("Expected 32-byte hash, got "), F.conv(part(3), 16, 10), F.lit(" bytes"))).when(F.length(x) != 59, "Invalid CID format")
        return F.when(x == "", "CID must be a non-empty string").otherwise(bad)

    return let(F.coalesce(x, F.lit("")), lambda x: let(header(x), lambda code: judged(x, code)))


def is_nonce_error(message: Column) -> Column:
    """errors that a new sequence number mends. The texts are fixed values."""
    return F.coalesce(F.lower(message).contains("nonce") | F.lower(message).contains("replacement transaction underpriced"), F.lit(False))


def is_transient_error(message: Column) -> Column:
    """errors after which the same call may succeed. The patterns are fixed values."""
    return F.coalesce(message.rlike(r"(?i)streaming\.mjs|The server had an error while processing your request|ECONNRESET|ETIMEDOUT|ENETUNREACH|ECONNREFUSED|5[0-9][0-9]"), F.lit(False))


def value_text(kind: Column, value: Column) -> Column:
    """A value as a report shows it: nothing for a missing one, JSON for objects and lists, else its text."""
    return F.when(kind == "undefined", "").when(kind == "null", "null").otherwise(value)


def tail_lines(text: Column, n: int = 60) -> Column:
    """The last lines of an output."""
    lines = F.split(text, r"\r?\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), "\n")


def fenced(text: Column) -> Column:
    """What the first code fence holds, else all of the text, without white space around it."""
    pattern = r"(?is)```(?:javascript|js)?\s*(.*?)```"
    return F.regexp_replace(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text), r"^\s+|\s+$", "")


def proxy_parts(text: Column) -> Column:
    """User, password, host and port of user:password@host:port; null where it isn't that."""
    pattern = r"^(.+?):(.+?)@(.+?):([0-9]+)$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("username"), part(2).alias("password"), part(3).alias("host"), part(4).cast("int").alias("port")))


def fetched_name(relationship: Column, key: Column, cid: Column, is_root: Column, group_cid: Column) -> Column:
    """The file name of fetched content: by the relationship it came from, the data group it is, or its identifier."""
    by_link = F.when(key.isNotNull(), F.concat_ws("_", relationship, key, cid)).otherwise(relationship)
    return F.concat(F.when(relationship.isNotNull(), by_link).when(is_root & group_cid.isNotNull(), group_cid).otherwise(cid), F.lit(".json"))


def plain_parcel(x: Column) -> Column:
    """A parcel's number without hyphens."""
    return F.replace(x, F.lit("-"), F.lit(""))


def gwei(wei: Column) -> Column:
    """Wei in units of 10^9, exactly."""
    return wei.cast("decimal(38,9)") / F.lit(1_000_000_000).cast("decimal(10,0)")


def jittered_ms(delay: Column, spread: Column) -> Column:
    """A delay moved by up to a fifth; spread is a number from -1 to 1."""
    return F.round(delay * (1 + spread * 0.2)).cast("long")


def is_accepted(text: Column) -> Column:
    """Whether a review accepts."""
    return F.coalesce(F.contains(text, F.lit("STATUS: ACCEPTED")), F.lit(False))


#: What a writer of scripts is told.
FIX = "Please review and fix any issues in the extraction scripts"
FIX_ALL = "You have preiously created all 3 scripts. Please review and fix any issues in the extraction scripts."


def feedback(text: Column) -> Column:
    """What a review asks for: its plan of action up to the status, else what follows the rejection, else that there is something to mend."""
    plan, rejected = r"(?is)ACTION PLAN[:\s]*(.+?)(?:STATUS:|$)", r"(?is)REJECTED[:\s]*(.+?)$"
    part = lambda p: F.regexp_replace(F.regexp_extract(text, p, 1), r"^\s+|\s+$", "")
    return F.when(text.rlike(plan), F.concat(F.lit(f"{FIX_ALL} Fix these issues: "), part(plan))).when(text.rlike(rejected), F.concat(F.lit(f"{FIX_ALL} "), part(rejected))).otherwise(FIX)
