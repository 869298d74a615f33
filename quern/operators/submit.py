"""Planning and auditing submissions: consensus, eligibility, batches, fees, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.cid import hash_of_cid
from quern.operators.ranks import ranked

#: Fixed value: the hash that stands for none.
ZERO_HASH = "0x" + "0" * 64
BATCH = 200
GWEI = 1_000_000_000


def latest(events: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """A3: the last value of each key; a hash aggregate, no sort."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def eligibility(records: DataFrame, consensus: DataFrame, submissions: DataFrame, keys: list[str], value: str, checks: bool = True, lookup_error: str | None = None) -> DataFrame:
    """every record with the reason why it is skipped, null if it is to be submitted.

    Without checks nothing is skipped; a record whose lookup failed (a column that says how) is. A hash of zeros that was
    agreed on stands for none.

    consensus: keys and value; submissions: keys and value of what the user has sent before.
    """
    if not checks:
        return records.withColumn("reason", F.lit(None).cast("string"))
    agreed = consensus.select(*keys, F.when(~F.col(value).isin("", "0x", ZERO_HASH), F.col(value)).alias("agreed"))
    sent = submissions.select(*keys, value).distinct().withColumn("sent", F.lit(True))
    found = records.join(agreed, keys, "left").join(sent, [*keys, value], "left")
    failed = F.lit(None).cast("string") if lookup_error is None else F.col(lookup_error)
    reason = F.when(failed.isNotNull(), F.concat(F.lit("Error checking eligibility: "), failed)).when(F.col("agreed") == F.col(value), "already agreed").when(F.col("sent"), "already submitted")
    return found.withColumn("reason", reason).drop("agreed", "sent")


def batches(items: DataFrame, order: str, group: str | None = None, size: int = BATCH) -> DataFrame:
    """B1: consecutive batches in order, of all items or of each group's."""
    placed = ranked(items, [order], [group] if group else None, "__k")
    return placed.select(*items.columns, F.floor(F.col("__k") / size).cast("long").alias("batch"), (F.col("__k") % size).cast("long").alias("place"))


def gas_plan(batched: DataFrame, base_gas: int = 21000, item_gas: int = 53123, percent: int = 20, max_fee_gwei: int = 30, nonce: int = 7) -> DataFrame:
    """Per batch its gas limit, fees and nonce, in decimals that hold wei exactly."""
    money = lambda c: c.cast("decimal(38,0)")
    per = batched.groupBy("batch").agg(F.count(F.lit(1)).alias("items")).withColumn("estimate", F.lit(base_gas) + F.col("items") * item_gas)
    limit = F.col("estimate") + F.floor(F.col("estimate") * percent / 100)
    fee = max_fee_gwei * GWEI
    tip = max(fee // 10, GWEI)
    return per.select(
        "batch",
        "items",
        limit.cast("long").alias("gas_limit"),
        money(F.lit(fee)).alias("max_fee"),
        money(F.lit(tip)).alias("priority_fee"),
        F.concat(F.lit("0x"), F.lower(F.hex(limit.cast("long")))).alias("gas_hex"),
        (F.lit(nonce) + F.col("batch")).alias("nonce"),
    )


#: Fixed value: the limit of a batch whose cost can't be estimated.
FALLBACK_GAS = 30_000_000


def unsigned_gas(estimate: Column, percent: int = 30) -> Column:
    """The limit of an unsigned transaction; where there is no estimate, a fixed one."""
    return F.coalesce(estimate + F.floor(estimate * percent / 100), F.lit(FALLBACK_GAS)).cast("long")


def batch_problem(items: Column, size: int = BATCH) -> Column:
    """B2: what is wrong with a batch's size. The messages are fixed values."""
    return F.when(items == 0, "Cannot submit an empty batch.").when(items > size, F.concat(F.lit("Batch size "), items.cast("string"), F.lit(f" exceeds configured max of {size}")))


def item_hashes(rows: DataFrame, columns: tuple[str, ...] = ("property_cid", "data_group_cid", "data_cid")) -> DataFrame:
    """Identifiers, also with a dot before them, as the hashes that a contract takes; null where one isn't a raw one."""
    return rows.select("*", *(F.concat(F.lit("0x"), hash_of_cid(F.regexp_replace(c, r"^\.", ""))).alias(c.replace("cid", "hash")) for c in columns))


def unsigned_json(batched: DataFrame, sender: str, to: str, chain_hex: str) -> DataFrame:
    """K-9: per batch the fields of its transaction as JSON: those of EIP-1559 where fees are given, else of the old kind.

    batched: batch, gas, nonce, data, and max_fee, priority_fee or gas_price in wei.
    """
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(F.col(c).cast("long"))))
    new = F.col("max_fee").isNotNull()
    fields = F.struct(
        F.lit(sender).alias("from"), F.lit(to).alias("to"), hexed("gas").alias("gas"), F.lit("0x0").alias("value"), F.col("data"), hexed("nonce").alias("nonce"),
        F.when(new, "0x2").otherwise("0x0").alias("type"), F.lit(chain_hex).alias("chainId"), F.when(new, hexed("max_fee")).alias("maxFeePerGas"), F.when(new, hexed("priority_fee")).alias("maxPriorityFeePerGas"), F.when(~new, hexed("gas_price")).alias("gasPrice"),
    )
    return batched.select("batch", F.to_json(fields).alias("transaction"))


def status_of(txs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Success or failed with a receipt, pending with a transaction only, else not_found; an error leaves it pending."""
    out = txs.join(receipts, "tx", "left")
    lost = F.col("error").isNotNull() if "error" in txs.columns else F.lit(False)
    status = F.when(lost, "pending").when(F.col("ok").isNotNull(), F.when(F.col("ok"), "success").otherwise("failed")).when(F.col("seen"), "pending").otherwise("not_found")
    return out.withColumn("status", status)


def status_summary(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A1: how many there are of each status, and of all."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(column) == v).alias(v) for v in values))
