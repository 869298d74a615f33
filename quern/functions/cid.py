"""Content identifiers (CIDv1, raw codec, sha2-256, base32) as Catalyst expressions.

Digits are converted in groups of 60 bits, which is 15 digits of hex and 12 of base32, and every value that is cut into
groups is computed once: a value inside of a lambda would be computed again for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.lets import let

#: The multiformats headers of a CIDv1 with raw or dag-pb codec and a 32-byte sha2-256 digest, and base32's digits.
RAW_HEADER, DAG_PB_HEADER = "01551220", "01701220"
BASE32HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567"


def _groups(padded: Column, groups: int, width: int, of: int, to: int, digits: int) -> Column:
    """`groups` groups of `width` digits of base `of`, each as `digits` digits of base `to`."""
    return F.concat(*(F.lpad(F.conv(F.substr(padded, F.lit(i * width + 1), F.lit(width)), of, to), digits, "0") for i in range(groups)))


def base32_of_hex(hex_text: Column, digits: int) -> Column:
    """Unpadded base32 of an even-length hex string; `digits` is the length of the result."""
    groups = -(-digits // 12)
    text = let(F.rpad(hex_text, groups * 15, "0"), lambda padded: _groups(padded, groups, 15, 16, 32, 12))
    return F.substr(F.translate(text, BASE32HEX, BASE32), F.lit(1), F.lit(digits))


def cid_of_hash(hash_hex: Column) -> Column:
    """CIDv1 raw of a 64-digit sha2-256 in hex, with or without `0x`; null where it isn't one."""
    known = lambda h: F.when(h.rlike("^[0-9a-f]{64}$"), F.concat(F.lit("b"), base32_of_hex(F.concat(F.lit(RAW_HEADER), h), 58)))
    return let(F.lower(F.regexp_replace(hash_hex, "^0[xX]", "")), known)


def cid_raw(content: Column) -> Column:
    """CIDv1 raw of text (as UTF-8) or bytes."""
    return F.concat(F.lit("b"), base32_of_hex(F.concat(F.lit(RAW_HEADER), F.sha2(content.cast("binary"), 256)), 58))


def hash_of_cid(cid: Column, header: str = RAW_HEADER) -> Column:
    """The sha2-256 in hex of a CIDv1 of that header, by default raw; null where the text isn't one."""

    def of(x: Column) -> Column:
        padded = F.rpad(F.translate(F.substr(x, F.lit(2), F.lit(58)), BASE32, BASE32HEX), 60, "0")
        text = F.when(x.rlike("^b[a-z2-7]{57}[aeimquy4]$"), let(padded, lambda p: F.lower(_groups(p, 5, 12, 32, 16, 15))))  # the last two bits belong to no byte
        return let(text, lambda t: F.when(t.startswith(header), F.substr(t, F.lit(9), F.lit(64))))

    return let(cid, of)
