r"""Benchmark decontamination by canonical templates, also where a question comes back with other numbers, names or units.

Built from DataFrame functions only. Two rules say what a name is: a capitalised word within a sentence, or one anywhere
that isn't a function word; the latter finds questions whose sentences begin with another name, and a verbatim copy
wherever it stands. A document leaks an item that either rule finds. Numbers, names and units (words of a list
after a number) become typed placeholders; all else is lower-cased and cut into words of letters and digits. Windows of
five template words of the benchmark are hash-joined with those of the documents, after a sieve (a table of bits, of a
fixed size whatever the benchmark's) has let go nearly all windows that the benchmark doesn't have. A window keeps what stands in its
slots; along one alignment (document, item, distance of the two positions) a slot value of the item must always meet the
same value in the document, or the alignment doesn't count. A document leaks an item when at least 80 of 100 of the
item's distinct windows are found in it.

Defined cases: null and empty texts have no windows; items of fewer than five template words are one
window, found word for word only; windows of placeholders alone don't count; rows that repeat an id are one document or item with the windows of
all of them; null ids take no part. Columns other than the id and the text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
LEAST = 80  # of 100 windows of an item
#: Windows of the benchmark are broadcast up to so many rows (about 100 bytes each), and shuffled beyond.
BROADCAST_ROWS = 500_000
#: Windows of a piece of a text. Each window's row holds its piece's words until its slots are known, so a text must not be one piece.
PIECE = 256
#: Cells of the sieve, 64 bits each; about 50 bytes a cell once broadcast.
SIEVE_CELLS = 1 << 20
#: Words that count as units after a number.
UNITS = "km|m|cm|mm|kg|g|mg|l|ml|s|min|h|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|miles|mile|feet|foot|inches|inch|pounds|pound|ounces|ounce|dollars|dollar|euros|euro|cents|cent|percent"
NUM, NAME, UNIT = "\u0001", "\u0002", "\u0003"


#: What parts words; the ranges only save time, the classes hold them all.
APART = r"[^a-z0-9\x{1}-\x{3}\xdf-\xf6\xf8-\xff\p{L}\p{N}]+"


#: Words that are no names where they are capitalised (English, German, Spanish, French).
NO_NAMES = (
    "The|An|And|Or|But|If|Then|When|While|After|Before|Because|Since|So|As|At|By|For|From|In|Into|Of|On|To|With|Without|How|What|Which|Who|Whose|Why|Where|He|She|It|They|We|You|His|Her|Its|Their|Our|Your|My|This|That|These|Those|There|Is|Are|Was|Were|Do|Does|Did|Has|Have|Had|Can|Could|Will|Would|Should|Each|Every|Some|All|Both|One|No|Not|Now|"
    "Der|Die|Das|Den|Dem|Ein|Eine|Und|Oder|Wenn|Wie|Was|Wer|Wo|Er|Sie|Es|Wir|Ist|Im|Mit|El|La|Los|Las|Un|Una|Si|Cuando|Que|Qué|Cómo|Cuántos|Cuántas|De|En|Con|Por|Para|Se|Le|Les|Une|Des|Du|Et|Ou|Quand|Combien|Il|Elle|Est|Dans"
)
_ANY_NAME = rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}])(?!(?:{NO_NAMES})(?![\p{{L}}\p{{N}}]))"


def marked(text: Column, anywhere: bool = False) -> Column:
    """The text in lower case; what fills a slot has the slot's type before it. Names are found within sentences, or anywhere."""
    plain = F.translate(text, NUM + NAME + UNIT, "   ")
    named = F.regexp_replace(plain, _ANY_NAME, NAME) if anywhere else F.regexp_replace(plain, r" (?=\p{Lu}\p{Ll})(?<=[\p{Ll},;] )", f" {NAME}")
    joined = F.regexp_replace(named, r"([0-9]+)[.,]([0-9])", "$1$2")
    numbered = F.lower(F.regexp_replace(joined, r"(^|[^\p{L}\p{N}])([0-9]+)", f"$1{NUM}$2"))
    with_units = F.regexp_replace(numbered, rf"({NUM}[0-9]+) ?({UNITS})($|[^\p{{L}}\p{{N}}])", f"$1 {UNIT}$2$3")
    return F.when(text.rlike("[0-9]"), with_units).otherwise(F.lower(named))


def _is_slot(word: Column) -> Column:
    return word < "\u0004"


def _words(table: DataFrame, id_col: str, text_col: str, anywhere: bool = False) -> DataFrame:
    """id, has_slots and the template words of each text."""
    base = table.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), marked(F.col(text_col), anywhere).alias("t"))
    has_slots = F.col("t").contains(NUM) | F.col("t").contains(NAME) | F.col("t").contains(UNIT)
    base = base.select("id", has_slots.alias("has_slots"), F.split("t", APART).alias("words"))
    skip = F.when(F.get(F.col("words"), 0) == "", 1).otherwise(0)
    last = F.when(F.get(F.col("words"), F.size("words") - 1) == "", 1).otherwise(0)
    return base.select("id", "has_slots", F.slice("words", skip + 1, F.greatest(F.size("words") - skip - last, F.lit(0))).alias("words"))


def template_windows(table: DataFrame, id_col: str, text_col: str = "text", anywhere: bool = False) -> DataFrame:
    """One row per window: id, words (of its piece; null in a text without slots), at (place in the piece), pos and w, a 64-bit hash. A text too short has a row of nulls."""
    base = _words(table, id_col, text_col, anywhere)
    piece = lambda i: F.struct(i.alias("start"), F.slice("words", i + 1, PIECE + WINDOW - 1).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)), F.lit(PIECE))
    base = base.select("id", "has_slots", F.explode_outer(F.transform(starts, piece)).alias("p")).select("id", "has_slots", "p.start", "p.words")
    typed = lambda w: F.xxhash64(F.when(_is_slot(w), F.substr(w, F.lit(1), F.lit(1))).otherwise(w))
    hashes = F.when(F.col("has_slots"), F.transform("words", typed)).otherwise(F.transform("words", lambda w: F.xxhash64(w)))
    base = base.select("id", "start", F.when(F.col("has_slots"), F.col("words")).alias("words"), hashes.alias("h"))
    window = lambda i: F.xxhash64(*(F.get(F.col("h"), i + j) for j in range(WINDOW)))
    ws = F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), window))
    base = base.select("id", "start", "words", ws.alias("ws"))
    # A filter, also the one that a plain explode infers, would move below these steps and repeat them all for its own sake.
    return base.select("id", "start", "words", F.posexplode_outer("ws").alias("at", "w")).select("id", "words", "at", (F.col("start") + F.col("at")).alias("pos"), "w")


def _slots() -> Column:
    return F.filter(F.slice("words", F.col("at") + 1, WINDOW), _is_slot)


def _sieved(theirs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose w the items may have: all that they have, and few others."""
    cell, bit = f"w & {SIEVE_CELLS - 1}", f"shiftleft(1L, cast(shiftrightunsigned(w, {SIEVE_CELLS.bit_length() - 1}) & 63 as int))"
    sieve = items.groupBy(F.expr(cell).alias("cell")).agg(F.bit_or(F.expr(bit)).alias("bits"))
    return theirs.join(F.broadcast(sieve), (F.expr(cell) == F.col("cell")) & (F.expr(f"bits & {bit}") != 0)).drop("cell", "bits")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows (distinct ones of the item), n_found: one row per document and item that it leaks.

    The counts are those of names within sentences where that rule finds the item, else those of names anywhere.
    """
    cols = (docs, benchmark, id_col, text_col, item_col, item_text_col)
    found = _template_leaks(*cols, False).withColumn("rule", F.lit(0)).union(_template_leaks(*cols, True).withColumn("rule", F.lit(1)))
    short = _short_leaks(*cols)
    if short is not None:
        found = found.union(short.withColumn("rule", F.lit(2)))
    first = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("rule", "n_windows", "n_found")).alias("r"))
    return first.select("doc_id", "item_id", "r.n_windows", "r.n_found")


def _short_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame | None:
    """Leaks of items of fewer than WINDOW template words, each a window of its own: as a template it would be met anywhere, so the words are its own."""
    items = _words(benchmark, item_col, item_text_col).filter((F.size("words") > 0) & (F.size("words") < WINDOW) & F.exists("words", lambda w: (w != "") & ~_is_slot(w)))
    sizes = sorted(r.n for r in items.select(F.size("words").alias("n")).distinct().collect())  # four at most
    if not sizes:
        return None
    own = F.transform("words", lambda w: F.xxhash64(F.translate(w, NUM + NAME + UNIT, "")))
    items = items.select(F.col("id").alias("item_id"), F.xxhash64(own).alias("w")).distinct()
    window = lambda n: F.when(F.size("h") >= n, F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.xxhash64(F.slice("h", i + 1, n)))).otherwise(F.array().cast("array<bigint>"))
    theirs = _words(docs, id_col, text_col).select(F.col("id").alias("doc_id"), own.alias("h"))
    theirs = theirs.select("doc_id", F.array_distinct(F.concat(*(window(n) for n in sizes))).alias("ws")).select("doc_id", F.explode("ws").alias("w"))
    small = items.count() <= BROADCAST_ROWS
    totals = items.groupBy("item_id").agg(F.count("w").alias("n_windows"))
    found = _sieved(theirs, items).join(F.broadcast(items) if small else items, "w").groupBy("doc_id", "item_id").agg(F.count_distinct("w").alias("n_found"))
    found = found.join(F.broadcast(totals) if small else totals, "item_id")
    return found.filter(100 * F.col("n_found") >= LEAST * F.col("n_windows")).select("doc_id", "item_id", "n_windows", "n_found")


def _template_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, anywhere: bool) -> DataFrame:
    items = template_windows(benchmark, item_col, item_text_col, anywhere).filter("w is not null")
    items = items.select(F.col("id").alias("item_id"), F.col("pos").alias("b_pos"), "w", _slots().alias("b_slots"))
    items = items.filter(F.col("b_slots").isNull() | (F.size("b_slots") < WINDOW))
    small = items.count() <= BROADCAST_ROWS
    totals = items.groupBy("item_id").agg(F.count_distinct("w").alias("n_windows"))
    theirs = template_windows(docs, id_col, text_col, anywhere).withColumnRenamed("id", "doc_id")
    # Words are looked up where a window may be found, and go before its items come: a window of many items is many rows.
    theirs = _sieved(theirs, items).select("doc_id", "pos", "w", _slots().alias("slots"))
    hits = theirs.join(F.broadcast(items) if small else items, "w")
    # Repeated rows of a document or item, and items that share windows, stay apart by alignment.
    hits = hits.select("doc_id", "item_id", (F.col("pos") - F.col("b_pos")).alias("shift"), "w", F.arrays_zip("b_slots", "slots").alias("pairs"))
    lines = hits.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("w").alias("ws"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    fits = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["b_slots"])))
    good = lines.filter(fits).select("doc_id", "item_id", F.explode("ws").alias("w"))
    found = good.groupBy("doc_id", "item_id").agg(F.count_distinct("w").alias("n_found"))
    found = found.join(F.broadcast(totals) if small else totals, "item_id")
    return found.filter(100 * F.col("n_found") >= LEAST * F.col("n_windows")).select("doc_id", "item_id", "n_windows", "n_found")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that leak no item, all columns kept."""
    leaks = find_leaks(docs, benchmark, id_col).select(F.col("doc_id").alias("leaks_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("k_id"))  # packed, as columns of any name may come
    return rows.join(leaks, F.col("k_id") == F.col("leaks_id"), "left_anti").select("row.*")


def op10_benchmark_decontamination(spark, sf_dir):
    """All pairs of a document and a benchmark item that it holds."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_NAMED = "regexp_replace({t}, '([\\p{{Ll}},;] )(\\p{{Lu}}\\p{{Ll}})', '\\1'||chr(2)||'\\2', 'g')"
_WORDS = (
    "list_filter(string_split_regex(regexp_replace(lower(regexp_replace(regexp_replace({t}, "
    "'([0-9]+)[.,]([0-9])', '\\1\\2', 'g'), '(^|[^\\p{{L}}\\p{{N}}])([0-9]+)', '\\1'||chr(1)||'\\2', 'g')), "
    "'('||chr(1)||'[0-9]+) ?({u})($|[^\\p{{L}}\\p{{N}}])', '\\1 '||chr(3)||'\\2\\3', 'g'), '[^\\p{{L}}\\p{{N}}\\x01\\x02\\x03]+'), lambda w: w <> '')"
)


def _words_sql(table: str, key: str) -> str:
    # twice: a match takes the letter before it, which the next name may need
    named = _NAMED.format(t=_NAMED.format(t="coalesce(translate(text, chr(1)||chr(2)||chr(3), '   '), '')"))
    return f"SELECT {key} AS id, {_WORDS.format(t=named, u=UNITS)} AS words FROM {table}"


_WINDOWS_SQL = """SELECT id, pos, list_transform(v, lambda w: CASE WHEN w < chr(4) THEN w[1] ELSE w END) AS w, list_filter(v, lambda w: w < chr(4)) AS slots
  FROM (SELECT id, i - 1 AS pos, words[i:i+4] AS v FROM (SELECT id, words, unnest(range(1, len(words) - 3)) AS i FROM {t} WHERE len(words) >= 5))"""

#: The rule of names within sentences alone: what names anywhere and short items find besides isn't in it.
SQL = f"""
WITH dw AS MATERIALIZED ({_words_sql("documents", "doc_id")}),
bw AS MATERIALIZED ({_words_sql("benchmark", "item_id")}),
dv AS MATERIALIZED ({_WINDOWS_SQL.format(t="dw")}),
bv AS MATERIALIZED ({_WINDOWS_SQL.format(t="bw")}),
b AS MATERIALIZED (SELECT * FROM bv WHERE len(slots) < 5),
t AS (SELECT id AS item_id, count(DISTINCT w) AS n_windows FROM b GROUP BY id),
h AS MATERIALIZED (SELECT d.id AS doc_id, b.id AS item_id, d.pos - b.pos AS shift, d.w AS w, b.slots AS bs, d.slots AS ds FROM dv d JOIN b ON d.w = b.w),
p AS MATERIALIZED (SELECT doc_id, item_id, shift, count(DISTINCT (x, y)) AS pairs, count(DISTINCT x) AS vals
  FROM (SELECT doc_id, item_id, shift, unnest(bs) AS x, unnest(ds) AS y FROM h) GROUP BY ALL),
g AS (SELECT h.doc_id, h.item_id, count(DISTINCT w) AS n_found FROM h LEFT JOIN p USING (doc_id, item_id, shift)
  WHERE p.pairs IS NULL OR p.pairs = p.vals GROUP BY ALL)
SELECT doc_id, item_id, n_windows, n_found FROM g JOIN t USING (item_id) WHERE 100 * n_found >= 80 * n_windows
"""
