"""Event logs and transactions as tables: decoding, calls with batches of hashes, gas prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.cid import cid_of_hash
from quern.functions.formats import gwei

ZERO_HASH = "0x" + "0" * 64


def address_of_topic(topic: Column) -> Column:
    """The address in an indexed topic, its last 20 bytes, in lower case."""
    return F.when(topic.rlike("^0x[0-9a-fA-F]{64}$"), F.concat(F.lit("0x"), F.lower(F.substr(topic, F.lit(27)))))


def assigned(logs: DataFrame, account: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Cid, account, block, tx of the assignments of an account; what doesn't decode is left out.

    logs: topics (array), data (one 32-byte word in hex), block, tx. The filters on block reach the scan.
    """
    some = logs if first is None else logs.filter(F.col("block") >= first)
    some = some if last is None else some.filter(F.col("block") <= last)
    found = some.select(cid_of_hash(F.col("data")).alias("cid"), address_of_topic(F.get("topics", 1)).alias("account"), "block", "tx")
    return found.filter((F.col("account") == account.lower()) & F.col("cid").isNotNull())


def batch_items(calls: DataFrame) -> DataFrame:
    """Tx, pos and the three hashes of each item of a batch call, from its data in hex.

    The call has a selector of four bytes, the place and length of one list, and three words an item. Short data has no items.
    """
    body = F.substr(F.col("input"), F.lit(11))
    word = lambda k: F.substr(body, k * 64 + 1, F.lit(64))
    n = F.least(F.conv(F.substr(word(F.lit(1)), F.lit(49), F.lit(16)), 16, 10).cast("long"), F.floor(F.length(body) / 192))
    items = F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.struct(*(F.concat(F.lit("0x"), word(i * 3 + 2 + k)).alias(c) for k, c in enumerate(("property_hash", "group_hash", "data_hash"))))))
    return calls.select("tx", F.posexplode(items).alias("pos", "i")).select("tx", "pos", "i.*").filter(F.length("data_hash") == 66)


def with_cids(items: DataFrame) -> DataFrame:
    """The hashes of items as identifiers too; a hash of zeros stands for none."""
    of = lambda c: cid_of_hash(F.when(F.col(c) != ZERO_HASH, F.col(c)))
    return items.select("*", of("property_hash").alias("property_cid"), of("group_hash").alias("group_cid"), of("data_hash").alias("data_cid"))


def gas_prices(fees: DataFrame) -> DataFrame:
    """The fees of a table (wei, null where a chain has none) in gwei."""
    return fees.select(*(c for c in fees.columns if c not in ("gas_price", "max_fee", "priority_fee")), *(gwei(F.col(c)).alias(c) for c in ("gas_price", "max_fee", "priority_fee")))
