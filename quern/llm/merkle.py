"""Merkle manifest of a table: a tree over the rows of each group, a tree over the groups, and a proof for every row.

A leaf is the sha256 of a row's chosen columns. Leaves of a group stand in order of an id; every `FAN` consecutive nodes
become one of the next level, until one is left, and the groups' last nodes, in order of the group, become the root alike.
A level is one window: partitioned by (group, parent), ordered, its full frame collects at most FAN nodes, which are the
parent's preimage and the siblings of each of them; one row for each parent goes on. Levels shrink by FAN, so the first
dominates, and no task sees more than its share of a group: places within a group come from range partitions, numbered
where they were written, and their offsets. Proofs come back down the same way, level by level, to the rows.

Defined cases: null columns count as `-`; a null group comes first, a null id first in its group; rows with equal ids stand
in order of their leaves, and rows that repeat wholly get proofs of neighbouring places. A group of one row is its own
subroot. An empty table has no root and no rows. Columns that aren't named have no influence, whatever their names.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.llm.common import Work, crc_mod

FAN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(columns: list[Column]) -> Column:
    """sha256 (bytes) of the columns, each as its length in bytes, a colon and its text."""
    text = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text)).cast("binary"), 256))


def _hex(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: F.lower(F.hex(x))), "")


def _placed(work: Work, name: str, rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in order over all partitions, with the partition `part` and a number `at` that counts within it; written, so that they stay."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return work.save(name, parted.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))


def _shifts(placed: DataFrame, by: list[str]) -> DataFrame:
    """For each group and partition what turns `at` into the place within the group, and the group's size."""
    counts = placed.groupBy(*by, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.select(*by, F.col("part").alias("s_part"), (before - F.col("first")).alias("shift"), F.sum("n").over(W.partitionBy(*by)).alias("size"))


def _parent(pos: Column) -> Column:
    return F.floor(pos / FAN).cast("long")


def _up(work: Work, name: str, nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (gid, pos, size, node) -> the levels, each with (gid, run, size, members), and the tops (gid, depth, node)."""
    levels, tops = [], [nodes.filter("size = 1").select("gid", F.lit(0).alias("depth"), "node")]
    while largest > 1:
        several = nodes.filter("size > 1").select("gid", "pos", "size", "node").withColumn("run", _parent(F.col("pos")))
        frame = W.partitionBy("gid", "run").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        runs = several.withColumn("members", F.collect_list("node").over(frame)).filter(F.col("pos") % FAN == 0)
        levels.append(work.save(f"{name}_{len(levels)}", runs.select("gid", "run", "size", "members")))
        size = F.ceil(F.col("size") / FAN).cast("long")
        nodes = levels[-1].select("gid", F.col("run").alias("pos"), size.alias("size"), F.unhex(F.sha2(_hex(F.col("members")).cast("binary"), 256)).alias("node"))
        tops.append(nodes.filter("size = 1").select("gid", F.lit(len(levels)).alias("depth"), "node"))
        largest = -(-largest // FAN)
    return levels, reduce(DataFrame.union, tops)


def _step(pos: Column) -> Column:
    """The path of a node: its place among its siblings, and what is above them; a top has no siblings."""
    own = F.array(F.struct((pos % FAN).cast("int").alias("place"), F.col("u_members").alias("members")))
    return F.when(F.col("u_members").isNull(), F.col("u_above")).otherwise(F.concat(own, "u_above"))


PATH = "array<struct<place:int,members:array<binary>>>"


def _down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Tops (gid, depth, node, above) -> for each run of the first level (u_gid, u_run, u_members, u_above, u_top)."""

    def starts(depth: int) -> DataFrame:
        return tops.filter(F.col("depth") == depth).select(F.col("gid").alias("u_gid"), F.lit(0).cast("long").alias("u_run"), F.lit(None).cast("array<binary>").alias("u_members"), F.col("above").alias("u_above"), F.col("node").alias("u_top"))

    upper = starts(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        found = levels[k].join(upper, (F.col("gid") == F.col("u_gid")) & (_parent(F.col("run")) == F.col("u_run")))
        upper = found.select("gid", "run", "members", _step(F.col("run")).alias("above"), "u_top").toDF("u_gid", "u_run", "u_members", "u_above", "u_top").union(starts(k))
    return upper


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", id_col: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, group, leaf, subroot, root (bytes), `path` (places and runs from the leaf to the root) and what `carry` names."""
    spark, work, carry = docs.sparkSession, Work(docs.sparkSession), carry or {}
    rows = docs.select(F.col(id_col).alias("id"), F.col(group).alias("grp"), leaf_of([F.col(c) for c in columns]).alias("node"), *(c.alias(f"c_{n}") for n, c in carry.items()))
    rows = work.save("leaves", rows)  # so that the ranges are found without reading the texts again
    placed = _placed(work, "placed", rows, [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("node")])
    work.drop("leaves")
    shifts = _shifts(placed, ["grp"])
    groups = _placed(work, "groups", shifts.groupBy("grp").agg(F.max("size").alias("n")), [F.col("grp").asc_nulls_first()])
    numbers = groups.join(_shifts(groups, []), F.col("part") == F.col("s_part")).select(F.col("grp").alias("n_grp"), (F.col("at") + F.col("shift")).alias("gid"), F.col("n"), F.col("size").alias("n_groups"))
    numbers = work.save("numbers", numbers)
    largest, n_groups = numbers.agg(F.max("n"), F.max("n_groups")).first()
    shifts = shifts.join(numbers.select("n_grp", "gid"), F.col("grp").eqNullSafe(F.col("n_grp"))).select(F.col("grp").alias("s_grp"), "gid", "s_part", "shift", "size")
    nodes = placed.join(shifts, F.col("grp").eqNullSafe(F.col("s_grp")) & (F.col("part") == F.col("s_part")))
    nodes = nodes.select("id", "grp", "gid", (F.col("at") + F.col("shift")).alias("pos"), "size", "node", *(f"c_{n}" for n in carry))

    levels, tops = _up(work, "level", nodes, largest or 0)
    tops = work.save("tops", tops)
    over = tops.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("pos"), F.lit(n_groups or 0).cast("long").alias("size"), "node")
    over_levels, over_tops = _up(work, "over", over, n_groups or 0)
    root = over_tops.first()
    root = bytes(root["node"]) if root else None
    over_down = _down(over_levels, over_tops.withColumn("above", F.array().cast(PATH)))
    tops = tops.join(over_down, _parent(F.col("gid")) == F.col("u_run")).select("gid", "depth", "node", _step(F.col("gid")).alias("above"))
    down = _down(levels, work.save("tops_above", tops))
    found = nodes.join(down, (F.col("gid") == F.col("u_gid")) & (_parent(F.col("pos")) == F.col("u_run")))
    return found.select("id", "grp", F.col("node").alias("leaf"), F.col("u_top").alias("subroot"), F.lit(root).cast("binary").alias("root"), _step(F.col("pos")).alias("path"), *(F.col(f"c_{n}").alias(n) for n in carry))


def siblings(path: Column) -> Column:
    """A path as what stands left and right of the node at each level, in hex."""
    return F.transform(path, lambda e: F.struct(_hex(F.slice(e["members"], 1, e["place"])).alias("left"), _hex(F.slice(e["members"], e["place"] + 2, F.size(e["members"]) - e["place"] - 1)).alias("right")))


def folded(leaf: Column, sides: Column) -> Column:
    """The root (hex) that a leaf (bytes) and the siblings of its path lead to."""
    return F.aggregate(sides, F.lower(F.hex(leaf)), lambda s, e: F.sha2(F.concat(e["left"], s, e["right"]).cast("binary"), 256))


def proof_digest(sides: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sides, lambda e: F.concat(e["left"], e["right"])), "").cast("binary"), 256)


def op11_merkle_manifest(spark, sf_dir):
    """Every document's leaf, subroot, root and proof, and whether the root follows from it after some texts were lower-cased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = leaf_of([lower if c == "text" else F.col(c) for c in COLUMNS])
    rows = manifest(docs, carry={"seen": F.when(crc_mod(F.col("doc_id"), 3) == 0, tampered)})
    rows = rows.select("id", "leaf", "subroot", "root", F.coalesce("seen", "leaf").alias("seen"), siblings(F.col("path")).alias("sides"))
    low = lambda c: F.lower(F.hex(c))
    found = rows.select(F.col("id").alias("doc_id"), low("leaf").alias("leaf"), low("subroot").alias("subroot"), low("root").alias("root"), proof_digest(F.col("sides")).alias("proof_sha256"), folded(F.col("seen"), F.col("sides")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in COLUMNS[:-1]) + " || " + _FIELD.format(c="{text}") + ")"
#: crc32 of a decimal number: its bytes, each followed by eight shifts.
_CRC = "xor(list_reduce(list_concat([4294967295], flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(coalesce(doc_id::VARCHAR, ''), '')])), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295)"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UP = """{name}(level, g, idx, h, n) AS (
  {start}
  UNION ALL
  SELECT level + 1, g, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY level, g, idx // 8, n),
{name}_runs AS (SELECT level, g, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM {name} WHERE n > 1 GROUP BY level, g, idx // 8)"""
_FOLD = """{name}(level, k, i, g, idx, cur, proof, n) AS (
  {start}
  UNION ALL
  SELECT f.level + 1, k, i, f.g, idx // 8, sha256(array_to_string(hs[1:idx % 8], '') || cur || array_to_string(hs[idx % 8 + 2:], '')),
    proof || array_to_string(hs[1:idx % 8], '') || array_to_string(hs[idx % 8 + 2:], ''), (n + 7) // 8
  FROM {name} f JOIN {runs} r ON r.level = f.level AND r.g = f.g AND r.run = f.idx // 8)"""
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {_LEAF.format(text="text")} AS leaf,
  CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(text=_LOWER)} ELSE {_LEAF.format(text="text")} END AS seen FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d),
{_UP.format(name="a", start="SELECT 0, g, idx, leaf, n FROM p")},
{_UP.format(name="b", start="SELECT 0, 0::BIGINT, g, h, count(*) OVER () FROM a WHERE n = 1")},
{_FOLD.format(name="f", runs="a_runs", start="SELECT 0, g, idx, g, idx, seen, '', n FROM p")},
{_FOLD.format(name="e", runs="b_runs", start="SELECT 0, k, i, 0::BIGINT, g, cur, proof, (SELECT count(*) FROM a WHERE n = 1) FROM f WHERE n = 1")},
r AS (SELECT h AS root FROM b WHERE n = 1)
SELECT p.doc_id, p.leaf, a.h AS subroot, root, sha256(e.proof) AS proof_sha256, e.cur AS folded_root, e.cur = root AS verified
FROM p JOIN a ON a.g = p.g AND a.n = 1 JOIN e ON e.k = p.g AND e.i = p.idx AND e.n = 1 CROSS JOIN r
"""
