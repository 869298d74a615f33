"""Line dedup: overlapping windows of three lines, found again anywhere in the corpus, lose their later occurrences.

Built from DataFrame functions only. A line is what stands between newlines. Each window of three consecutive lines
gets a 128-bit hash; of equal windows the one with the smallest (doc_id, hash of the text, line number) stays, and the lines
that any other occurrence covers are removed, overlapping windows merged.

Defined cases: a null text stays null and has 0 lines; an empty text has one empty line; texts of fewer than three lines
have no window and stay; windows of three blank lines don't count. Rows that repeat both doc_id and text are one document
and come back as often as they came. A null doc_id sorts first. Extra columns of any name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _window_hashes(lines: Column) -> tuple[Column, Column, Column]:
    """Two hashes of each line, and whether it is blank."""
    h1 = F.transform(lines, lambda x: F.xxhash64(x))
    h2 = F.transform(lines, lambda x: F.xxhash64(x, F.lit(WINDOW)))
    blank = F.transform(lines, lambda x: F.trim(x) == "")
    return h1, h2, blank


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows as `row` (a struct of their columns), with n_lines, n_removed and `kept`, the text without repeated lines."""
    base = docs.select(F.struct("*").alias("row"))
    key = {"k_id": F.col("row")[id_col], "k_text": F.xxhash64(F.col("row")[text_col])}
    split = base.select(*(c.alias(n) for n, c in key.items()), F.split(F.col("row")[text_col], "\n", -1).alias("lines"))
    h1, h2, blank = _window_hashes(F.col("lines"))
    hashed = split.filter(F.size("lines") >= WINDOW).select("k_id", "k_text", h1.alias("h1"), h2.alias("h2"), blank.alias("blank"))
    at = lambda c, i: F.get(F.col(c), i)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("h1") - WINDOW),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*(at("h1", i + j) for j in range(WINDOW))).alias("w1"),
            F.xxhash64(*(at("h2", i + j) for j in range(WINDOW))).alias("w2"),
            (at("blank", i) & at("blank", i + 1) & at("blank", i + 2)).alias("void"),
        ),
    )
    occurrences = (
        hashed.select("k_id", "k_text", F.explode(windows).alias("w"))
        .filter(~F.col("w.void"))
        .select(F.struct("k_id", "k_text", F.col("w.pos").alias("pos")).alias("place"), F.struct(F.col("w.w1"), F.col("w.w2")).alias("window"))
    )
    # Partial aggregation meets the hot windows before the shuffle; the join below shuffles both sides anew, so that
    # adaptive execution can split a hot window there.
    again = (
        occurrences.groupBy(F.col("window.w1").alias("a1"), F.col("window.w2").alias("a2"))
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .filter("first != last")
        .select(F.struct("a1", "a2").alias("a"), "first")
    )
    later = occurrences.join(again, (F.col("window") == F.col("a")) & (F.col("place") != F.col("first"))).select("place.*")
    marks = later.groupBy(F.col("k_id").alias("m_id"), F.col("k_text").alias("m_text")).agg(F.sort_array(F.collect_set("pos")).alias("starts"))
    # Window starts as an array of flags by line, gap by gap: linear in the number of lines.
    gaps = F.zip_with("starts", F.concat(F.array(F.lit(-1)), F.slice("starts", 1, F.size("starts") - 1)), lambda p, q: p - q - 1)
    flags = F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(False), g), F.array(F.lit(True)))))
    marks = marks.select("m_id", "m_text", flags.alias("flags"))
    full = base.select("row", *(c.alias(n) for n, c in key.items())).join(marks, F.expr("k_id <=> m_id and k_text = m_text"), "left")
    lines = F.split(F.col("row")[text_col], "\n", -1)
    start = lambda i: F.coalesce(F.get(F.col("flags"), i), F.lit(False))
    covered = lambda i: start(i) | ((i >= 1) & start(i - 1)) | ((i >= 2) & start(i - 2))
    full = full.select("row", "flags", lines.alias("lines"))
    kept = F.when(F.col("flags").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~covered(i)))
    full = full.select("row", "lines", kept.alias("kept_lines"))
    n_lines = F.when(F.col("row")[text_col].isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_kept = F.when(F.col("row")[text_col].isNull(), 0).otherwise(F.size("kept_lines")).cast("long")
    return full.select("row", n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_removed"), F.array_join("kept_lines", "\n").alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with its own columns, repeated lines removed from the texts; documents of which nothing is left go."""
    marked = mark_lines(docs, id_col, text_col).filter((F.col("n_removed") == 0) | (F.trim("kept") != ""))
    return marked.select(F.col("row").withField(text_col, F.col("kept")).alias("row")).select("row.*")


def op1_line_dedup(spark, sf_dir):
    """Per document: its lines, how many of them go, and the sha256 of what is left."""
    marked = mark_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return marked.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, i - 1 AS pos, lines[i] || chr(10) || lines[i+1] || chr(10) || lines[i+2] AS win
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE len(lines) >= 3)
  WHERE trim(lines[i], ' ') <> '' OR trim(lines[i+1], ' ') <> '' OR trim(lines[i+2], ' ') <> ''),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS rn FROM w),
c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM f, (SELECT unnest([0, 1, 2]) AS k) WHERE rn > 1),
g AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
k AS (
  SELECT l.doc_id, len(lines) AS n_lines, coalesce(len(gone), 0) AS n_removed,
    array_to_string(list_filter(lines, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), chr(10)) AS kept
  FROM l LEFT JOIN g USING (doc_id))
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""
