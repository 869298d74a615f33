"""Quality rules: fixed rules on words and lines, then a likelihood ratio of hashed n-grams between trusted and all text.

Built from DataFrame functions only. Words and pairs of neighbouring words are hashed into `buckets` buckets; a multinomial
over them is fitted to the trusted documents and another to the whole corpus. The corpus counts, less one for the document
that is scored, are scaled to the size of the trusted ones, and one is added to every count of either, so that n-grams which
only this document holds say nothing. A document's score is the mean of log(trusted share / corpus share) over its n-grams,
so length doesn't matter, and it stays where the score is `least` or more: the same document, model and bound give the same
verdict everywhere.

The corpus model counts every document. The trusted model learns from MOST_TRUSTED documents at most, those with the
smallest hashes of their ids, so that their ids can be broadcast and no text is shuffled.

Defined cases: null and empty texts have no words and fail the fixed rules. Without a trusted document, or with one that
holds no words, only the fixed rules decide. A null id is never trusted. Repeated rows count as often as they come, and each
gets its verdict. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
MOST_TRUSTED = 50_000
#: Nats per n-gram.
LEAST = -0.15
SPAN = 8
FEWEST_WORDS = 20
MOST_REPEATED = 30
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def _pairs(values: Column, n: Column, f) -> Column:
    """f of each element and the next; `values` must be a column, as it is read twice."""
    m = F.greatest(n - 1, F.lit(0))
    return F.zip_with(F.slice(values, 1, m), F.slice(values, 2, m), f)


def measured(docs: DataFrame, text_col: str = "text", row: Column | None = None) -> DataFrame:
    """Columns `row` (a struct of all columns, or what `row` says), `hashes` of its words in order, and the counts that the fixed rules look at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.select((F.struct("*") if row is None else row).alias("row"), words_of(F.col(text_col)).alias("words"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    joined = F.array_join("words", "")
    some = some.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        (F.length(joined) - F.length(F.translate(joined, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    # Windows of words by hash. Most texts repeat none, and only the others sort theirs.
    spans = F.transform(F.sequence(F.lit(0), F.size("hashes") - SPAN), lambda i: F.xxhash64(*(F.get(F.col("hashes"), i + j) for j in range(SPAN))))
    some = some.withColumn("spans", F.when(F.col("n_words") >= SPAN, spans).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform("spans", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    some = some.withColumn("placed", F.when(F.size("spans") > F.size(F.array_distinct("spans")), placed))
    equal = _pairs(F.col("placed"), F.size("placed"), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    some = some.withColumn("starts", F.sort_array(F.array_distinct(F.flatten(equal))))
    gaps = _pairs(F.col("starts"), F.size("starts"), lambda a, b: F.least(b - a, F.lit(SPAN)))
    repeated = F.when(F.col("placed").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(SPAN), lambda s, x: s + x)).cast("long")
    return some.withColumn("n_repeat_words", repeated).select("row", "hashes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def grams(buckets: int = BUCKETS) -> Column:
    """The bucket of each word and each pair of words, from the column `hashes`."""
    pairs = _pairs(F.col("hashes"), F.size("hashes"), lambda a, b: F.xxhash64(a, b))
    return F.transform(F.concat("hashes", pairs), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def trusted_ids(labels: DataFrame, good: Column, id_col: str = "doc_id", most: int = MOST_TRUSTED) -> DataFrame:
    """At most `most` ids of good rows, those with the smallest hashes.

    What surely is not among them goes before rows are ordered, so that no task orders more than a few times `most`.
    """
    ids = labels.filter(good & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"))
    n = ids.count()
    order = F.shiftrightunsigned(F.xxhash64("id"), 1)
    if n > 2 * most:
        ids = ids.filter(order < int(2 * most / n * 2**63))
    return ids.distinct().orderBy(order, "id").limit(most)


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row with `ratios`, the log-ratio of each bucket; null where nothing trusted has words. trusted: a column of ids, of bounded number."""
    ids = F.broadcast(trusted.toDF("t_id").distinct().withColumn("is_trusted", F.lit(1)))
    rows = docs.select(F.col(id_col).alias("id"), F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w)).alias("hashes"))
    rows = rows.join(ids, F.col("id") == F.col("t_id"), "left").select(F.coalesce("is_trusted", F.lit(0)).alias("good"), "hashes")
    counts = rows.select("good", F.explode(grams(buckets)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("n_good"))
    dense = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, F.col("b") == F.col("bucket"), "left").select("b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_good", F.lit(0)).alias("n_good"))
    # As many rows as there are buckets, whatever the corpus.
    listed = dense.agg(F.sort_array(F.collect_list(F.struct("b", "n", "n_good"))).alias("cells"), F.sum("n").alias("total"), F.sum("n_good").alias("total_good"))
    expected = lambda c: F.greatest(c["n"] - 1, F.lit(0)) * F.col("total_good") / F.col("total")
    ratio = lambda c: F.log((c["n_good"] + 1) / (expected(c) + 1))
    return listed.select(F.when(F.col("total_good") > 0, F.transform("cells", ratio)).alias("ratios"))


def judge(docs: DataFrame, model: DataFrame, text_col: str = "text", least: float = LEAST, row: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """What `measured` gives but the hashes, and base_failed, score (0 without words or trusted text) and kept."""
    some = measured(docs, text_col, row).withColumn("grams", grams(buckets)).withColumn("ratios", model.scalar())
    total = F.aggregate("grams", F.lit(0.0), lambda s, g: s + F.get(F.col("ratios"), g))
    some = some.withColumn("score", F.coalesce(total / F.greatest(F.size("grams"), F.lit(1)), F.lit(0.0))).withColumn("base_failed", base_failed())
    return some.drop("hashes", "grams", "ratios").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


def op12_quality_rules(spark, sf_dir):
    """Every document's counts, score and verdict; trusted are documents labelled as good."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, trusted_ids(labels, F.col("quality") == 1))
    found = judge(docs, model, row=F.struct("doc_id"))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
